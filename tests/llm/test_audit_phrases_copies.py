"""The filter audit, phrases and exact copies against brute force, on odd rows and over batches."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from datavouch.llm import audit, collocations, exactdedup
from hypothesis import given, settings
from hypothesis import strategies as st

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FULL = "doc_id long, text string, lang string, source string"
ODD = [None, "", " \n\t ", "one", "x" * 50_000, "word " * 5000, "É à ü 漢字   z", "a b c d e f", "A" * 30, "100 % & more"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- 11 filter audit -----------------------------------------------------------------------------


def brute_audit(rows, labels):
    """Applies the filters of each order one after the other to every document."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    parts = defaultdict(list)
    for i, t, p in rows:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and t in first and i > first[t]}
        parts[p or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for p, every in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = list(every)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                out[p, "".join(order), step] = [len(left), len(gone), sum(f in x[0] for x in every) - len(gone), sum(x[0] == {f} for x in every), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                shapley[f] += len(gone)
        for (q, order, step), v in out.items():
            if q == p:
                v.append(shapley[order[step - 1]])
    return out


def test_audit_against_every_order(spark):
    random.seed(11)
    long = [" ".join(random.choices(["alpha", "beta", "Gamma", "DELTA"] + [f"w{i}" for i in range(k)], k=260)) for k in (2, 400, 400)]
    texts = ODD + long + [t + " #" for t in long] + [long[1].upper(), long[1], "", "one"]
    rows = [(random.choice([None, *range(40)]), random.choice(texts), random.choice(["s", "t", "", None])) for _ in range(120)]
    labels = [(random.choice([None, *range(40)]), random.choice([0, 1, None]), random.choice([0, 1, None])) for _ in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as part", "'x' as digest", "true as E", "2 as n", "3 as good")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got == brute_audit(rows, labels)


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    with pytest.raises(ValueError, match="too many orders"):
        audit.interactions(empty, [str(i) for i in range(9)])


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_paths_are_all_orders(k):
    forward, backward = audit.path_counts(k)
    total = len(list(permutations(range(k))))
    assert forward[-1] == backward[0] == total
    for n in range(k):  # every order passes each level once
        assert sum(w for s, _, w in audit.lattice(k) if s.bit_count() == n) == total


# --- 12 phrases ----------------------------------------------------------------------------------


def brute_phrases(rows, longest=3, least=10, share=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in found.items():
        inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if any(g == lang and inside(q) and 100 * b >= share * a for (g, q), b in found.items()):
            continue
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for i, (s, a, p, x, y) in enumerate(sorted(v)[:top], 1))


@pytest.mark.parametrize(("longest", "trigger", "top"), [(3, 16, 2000), (3, 1, 5), (2, 3, 2000), (4, 2, 2000)])
def test_phrases_against_brute_force(spark, longest, trigger, top):
    random.seed(12 + longest)
    vocabulary = ["the", "The", "of", "été", "ÉTÉ", "x", "漢字", "a b", "#", "z" * 80]
    phrase = lambda: " ".join(random.choices(vocabulary, k=random.randint(1, 9)))
    some = [phrase() for _ in range(12)]
    text = lambda: "".join(random.choice(some + [phrase()]) + random.choice([" ", ". ", ",", "\n", "\t", "  ", "\r\n", "!?"]) for _ in range(random.randint(1, 20)))
    rows = [(random.choice([text(), text(), "the of the of", *ODD]), random.choice(["en", "en", "de", None, "und", ""])) for _ in range(150)]
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 as n", "'x' as phrase", "2 as size", "3 as chunk")
    got = sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.mine(df, longest=longest, trigger=trigger, top=top).collect())
    assert got == brute_phrases(rows, longest, top=top)


def test_a_full_filter_and_small_blocks_change_nothing(spark, monkeypatch):
    random.seed(4)
    rows = [(" ".join(random.choices("abcd", k=40)) + "." + "a b c " * 3, "en") for _ in range(60)]
    want = brute_phrases(rows)
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)
    monkeypatch.setattr(collocations, "BLOCK", 100)
    got = collocations.mine(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()) == want


def test_phrases_of_nothing(spark):
    for rows in ([], [(None, "en")], [("", None)], [(" . ", "en")]):
        assert collocations.mine(spark.createDataFrame(rows, "text string, lang string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefg"), min_size=1, max_size=30), max_size=6), st.integers(1, 3), st.integers(1, 5))
def test_chunks_own_each_phrase_once(pieces, overlap, trigger):
    """Chunks cover pieces, overlap by the window, and their owned starts are all positions, once."""
    w = collocations.Words(("\n".join("  ".join(p) for p in pieces) + " \n").encode())
    first, after, last = collocations.chunks(w, overlap, trigger)
    owned = [i for a, b, z in zip(first, after, last, strict=True) for i in range(a, b if z else b - overlap)]
    assert owned == list(range(w.n))
    assert all(w.piece[a] == w.piece[b - 1] for a, b in zip(first, after, strict=True))
    texts = w.joined(first, after).to_pylist()
    assert texts == [" ".join(w.vocabulary[i].decode() for i in w.ids[a:b]) for a, b in zip(first, after, strict=True)]
    closed = {t for t, z in zip(texts, last, strict=True) if not z}
    assert not any(t != o and f"{o} ".startswith(f"{t} ") for t in closed for o in texts)


def test_scores_do_not_overflow(spark):
    many = 3 * 10**12
    found = spark.createDataFrame([("en", "a b", 2, many), ("en", "a", 1, many + 7), ("en", "b", 1, 4 * many)], "lang string, phrase string, size int, n long")
    r = collocations._cuts(found.filter("size > 1"), found).first()
    assert (r.a, r.l, r.r, r.score) == (many, many + 7, 4 * many, 10**6 * many * many // ((many + 7) * 4 * many))


# --- 13 exact copies -----------------------------------------------------------------------------


def folded(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute_copies(rows):
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        groups[folded(t)].append((-len(t or ""), i is None, i or 0, n))
    out = []
    for key, every in groups.items():
        best = min(every)
        for x in every:
            i = None if x[1] else x[2]
            out.append((i, None if best[1] else best[2], len(every), x == best, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


def results(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def test_copies_against_brute_force(spark):
    random.seed(13)
    texts = [*ODD, "a bcdef", "a bcdef", "o n\ne", "A b c d e f", "   one   ", "one "]
    rows = [(random.choice([None, *range(60)]), random.choice(texts)) for _ in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as digest", "1 as row", "2 as batch", "3 as keep_id", "4 as best")
    assert results(exactdedup.exact_copies(df)) == brute_copies(rows)
    assert exactdedup.exact_copies(df.limit(0)).count() == 0


def test_hot_copies_are_dealt_out(spark, monkeypatch):
    from datavouch.functions import tables

    monkeypatch.setattr(tables, "HOT_ROWS", 10)
    rows = [(i, "same" + " " * (i % 4)) for i in range(80)] + [(100 + i, f"other {i}") for i in range(9)]
    assert results(exactdedup.exact_copies(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_copies(rows)


def test_the_index_persists_over_batches(spark, tmp_path):
    path = str(tmp_path / "index")
    batch = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    one = exactdedup.DigestIndex(spark, path, buckets=4)
    first = [(1, "a b"), (2, "a  b"), (3, "c"), (4, None)]
    assert results(one.add(batch(first), "b1")) == brute_copies(first)
    one.close()
    two = exactdedup.DigestIndex(spark, path, buckets=4)  # as another session would
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in two.add(batch([(5, "ab" + " " * 50), (6, "d"), (7, "d"), (8, " ")]), "b2").collect()}
    assert got == {5: (2, 1, False), 6: (6, 2, True), 7: (6, 2, False), 8: (4, 1, False)}
    again = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in two.add(batch([(5, "ab" + " " * 50), (6, "d"), (7, "d"), (8, " ")]), "b2").collect()}
    assert again == got and two.rows().count() == 4  # a repeated batch appends nothing and decides alike
    small = two.compact(str(tmp_path / "compacted"))
    assert sorted(tuple(r[1:]) for r in small.rows().collect()) == sorted(tuple(r[1:]) for r in two.rows().collect())


def test_the_index_is_read_bucket_by_bucket(spark, tmp_path):
    """The anti-join neither shuffles nor broadcasts what the index has."""
    index = exactdedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    index.add(spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string"), "b1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        new = exactdedup.digests(spark.createDataFrame([(i, f"text {i}") for i in range(40, 90)], "doc_id long, text string"))
        left = new.repartition(4, "digest").join(index.rows().select("digest"), "digest", "left_anti")
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert left.count() == 40 and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_block_counts_are_integers():
    block = collocations.Block(__import__("pyarrow").array(["en", "en"]), __import__("pyarrow").array(["a b a", "a b"]), np.array([True, True]), np.array([2**40, 3]), 3)
    got = {(r["phrase"], r["n"]) for r in block.counted(np.flatnonzero(block.left >= 2), 2).to_pylist()}
    assert got == {("a b", 2**40 + 3), ("b a", 2**40)}
