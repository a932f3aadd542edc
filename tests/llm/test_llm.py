"""Small fixtures and brute-force comparisons for the training-data operators."""

import gzip
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from datavouch.llm import bpe, decontaminate, fingerprint, html, licences, quality, queries, simhash, substrings, urls, warc
from hypothesis import given, settings
from hypothesis import strategies as st

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, texts, extra=False):
    rows = list(texts.items()) if isinstance(texts, dict) else list(enumerate(texts))
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("doc_id", "text", "'x' as fp", "1 as chunk", "'y' as fingerprint", "2 as size") if extra else df


ODD = [None, "", " \n\t ", "one", "x" * 50_000, "word " * 5000, "É à ü 漢字 \u2028 z", "a b c d e f"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- 1 licences ----------------------------------------------------------------------------------


def licence_words(text):
    return re.sub(r"[^a-z0-9\u0080-\U0010ffff]+", " ", text.translate(LOWER)).split()


def brute_places(text, templates, mille=800):
    """(licence, dice, first word, words) of each template's best place, by trying all places."""
    w = licence_words(text or "")
    grams = [f"{a} {b}" for a, b in zip(w, w[1:])]
    out = []
    for name, template in templates:
        own = set(licences.bigrams(template))
        at = [p for p, g in enumerate(grams) if g in own]

        def worth(i, j):
            inside = [g for g in grams[i : j + 1] if g in own]  # noqa: B023
            return (2000 - mille) * len(set(inside)) - mille * (j - i + 1 - len(inside))

        best = max(((worth(i, j), -j, -i) for i in at for j in at if i <= j), default=None)
        if best and len(at) >= -(-len(own) * mille // (2000 - mille)):
            i, j = -best[2], -best[1]
            s = len({g for g in grams[i : j + 1] if g in own})
            a = s + sum(g not in own for g in grams[i : j + 1])
            if 2000 * s >= mille * (a + len(own)):
                out.append((name, round(2 * s / (a + len(own)), 12), i, j - i + 2))
    return out


def found_places(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.licence, round(r.dice, 12), r.first_word, r.n_words))
    return {k: sorted(v) for k, v in out.items()}


def test_licence_notices_anywhere(spark):
    mit = next(t for n, t in licences.TEMPLATES if n == "MIT" and len(t) > 100)
    gpl = next(t for n, t in licences.TEMPLATES if n == "GPL-3.0" and len(t) > 100)
    prose = "The tool reads a file of the user and writes to the same place. " * 30
    wrap = lambda t: "\n * ".join(re.findall(r".{1,70}(?:\s|$)", t))
    texts = ["Made in Bern. Released under the MIT License. See the manual for more.", f"/*\n * {wrap(mit)}\n */\n{prose}", f"{prose}\n{wrap(gpl)}\n{prose}", f"{mit} {mit}", "no licence here", None, "", "one", "This work is licensed under the GNU Lesser General Public License, version 3.", f"{prose} {mit} {prose} Licensed under CC BY 4.0."]
    got = found_places(licences.scan(docs(spark, texts, extra=True)))
    assert {i: [x[0] for x in v] for i, v in got.items()} == {0: ["MIT"], 1: ["MIT"], 2: ["GPL-3.0"], 3: ["MIT"], 8: ["LGPL-3.0"], 9: ["CC-BY-4.0", "MIT"]}
    assert got[1][0][1] > 0.99 and got[2][0][1] > 0.95 and got[3][0][1] > 0.99


def test_licence_places_against_brute_force(spark):
    random.seed(8)
    pick = lambda k: " ".join(random.choices("abcdef", k=k))
    templates = [(f"L{i}", pick(random.choice([2, 4, 9, 25]))) for i in range(6)]
    texts = [" ".join(random.choice([pick(random.randint(1, 9)), random.choice(templates)[1], "zz " * random.randint(1, 4)]) for _ in range(5)) for _ in range(40)]
    for one in templates:  # one at a time: overlaps are another rule
        got = found_places(licences.scan(docs(spark, texts), templates=[one]))
        assert got == {i: w for i, t in enumerate(texts) if (w := brute_places(t, [one]))}


@pytest.mark.parametrize("share", [0.3, 0.5, 0.6, 0.9])
def test_licences_whatever_precedes(spark, share):
    """A whole licence is found at its full coefficient after or before a part of itself."""
    mit = next(t for n, t in licences.TEMPLATES if n == "MIT" and len(t) > 100)
    w = licence_words(mit)
    part = " ".join(w[: int(share * len(w))])
    texts = {}
    for gap in (0, 1, 5, 20, 60, 100, 200, 400):
        other = " ".join(f"o{i}" for i in range(gap))
        texts |= {10 * gap: f"{part} {other} {mit}", 10 * gap + 1: f"{mit} {other} {part}", 10 * gap + 2: f"{part} {other} {mit} {other} {part}"}
    got = found_places(licences.scan(docs(spark, texts)))
    assert set(got) == set(texts)
    assert all([x[:2] for x in v if x[0] == "MIT"] == [("MIT", 1.0)] for i, v in got.items() if i >= 50)


def test_licence_of_a_whole_text(spark):
    random.seed(1)
    long = " ".join(f"w{random.randrange(900)}" for _ in range(5600))
    kinds, grams = licences.postings([("LONG", long)])
    assert len(grams) == kinds[0][2] <= 5599
    got = found_places(licences.scan(docs(spark, ["before " * 50 + long + " after" * 50, long[: len(long) // 2]]), templates=[("LONG", long)]))
    assert list(got) == [0] and got[0][0][1] > 0.999


def test_licence_rows(spark, tmp_path):
    line = "Released under the MIT License."
    rows = spark.createDataFrame([(1, line), (1, line), (1, "x " + line), (None, line), (2, line)], DOCS)
    assert sorted((r.doc_id or 0, r.licence, r.first_word) for r in licences.scan(rows).collect()) == [(0, "MIT", 0), (1, "MIT", 0), (1, "MIT", 1), (2, "MIT", 0)]
    assert licences.scan(docs(spark, {})).count() == 0
    assert licences.scan(docs(spark, [line]), templates=[]).count() == 0
    (tmp_path / "Own-1.0.txt").write_text("you may do as you please with this")
    own = licences.read_templates(spark, str(tmp_path))
    assert [(r.licence, r.dice) for r in licences.scan(docs(spark, ["so YOU may do as you please\nwith this."]), templates=own).collect()] == [("Own-1.0", 1.0)]


# --- 2 SimHash -----------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [t for t in ODD if t is None or len(t) < 100] + ["a b", "The THE the The", "a\u00a0b c\x0bd e"])
def test_fingerprint_is_the_contracts(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_near_duplicates_against_all_pairs(spark):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(60):
        base = random.choices(vocabulary, k=400)
        for k in range(random.choice([1, 1, 3])):
            copy = list(base)
            for _ in range(k):
                copy[random.randrange(400)] = "edited"
            texts[len(texts) * 3] = " ".join(copy)
    texts |= {1000 + i: t for i, t in enumerate([None, "", " ", texts[0], texts[0]])}
    want_fp = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(want_fp)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs(spark, texts, extra=True)).collect()}
    assert got == {i: (want_fp[i], want[i]) for i in texts}


@pytest.mark.parametrize("choices", [(2,), (3,), (2, 3)])
def test_hot_buckets_keep_all_links(spark, choices):
    """Hundreds of fingerprints that agree in most bits: groups far above the limit for pairs."""
    random.seed(5)
    base = random.getrandbits(64)
    fps = {base}
    while len(fps) < 400:
        f = random.choice(sorted(fps))
        fps.add(f ^ (1 << random.randrange(40)) ^ (1 << random.randrange(40)))
    fps |= {random.getrandbits(64) for _ in range(200)}
    from datavouch.llm.components import connected

    ids = dict(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in ids.items()], "fp long, rep long")
    got = {r.fp: r.component_id for r in connected(nodes, simhash.links(nodes.select("fp"), choices=choices)).collect()}
    want = brute_components(ids)
    assert {i: got[f - (1 << 64) if f >> 63 else f] for i, f in ids.items()} == want


def test_more_fingerprints_make_wider_groups():
    """The cheapest number of groups falls as buckets would fill up."""
    cheapest = lambda n: min((2, 3), key=lambda m: sum(n + n * n / 2 ** (64 // m) for _ in range(m)) if m == 3 else n * 34 + n * n * 34 / 2**32)
    assert cheapest(10**4) == 3 and cheapest(10**10) == 2


def test_hot_keys_are_dealt_to_several_tasks(spark, monkeypatch):
    from datavouch.functions import tables

    monkeypatch.setattr(tables, "HOT_ROWS", 10)
    texts = {i: "the same text of some words" for i in range(50)} | {100 + i: f"other text number {i} with words of its own {i * 7}" for i in range(30)}
    want_fp = {i: brute_fingerprint(t) for i, t in texts.items()}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == brute_components(want_fp)


def test_rows_of_equal_and_null_ids(spark):
    rows = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "x"), (1, "q r s t u"), (3, "word " * 200_000)], DOCS)
    got = sorted(((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(rows).collect()), key=str)
    assert got == [(0, 3), (0, None), (1, 1), (3, 3), (3, 3), (3, 3)]


def test_allocation_finds_the_least_cost():
    costs = [{-1: 0, 0: 10, 1: 300, 2: 900}, {-1: 0, 0: 50, 1: 60, 2: 75}, {-1: 0, 0: 500, 1: 900, 2: 990}]
    assert simhash.allocate(costs, 0) == (0, 1, -1)


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(docs(spark, {})).count() == 0


# --- 3 BPE ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    ranks = bpe.load_ranks(VOCABULARY)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_bpe_equals_the_library(text):
    codec = bpe.codec(VOCABULARY, public_tokenizers.PATTERN)
    own = tiktoken_encoding().encode_ordinary(text)
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == own
    assert b"".join(codec.decode(ids)) == text.encode()
    assert "".join(codec.decode_text(ids, 3)) == text


_HELD = []


def tiktoken_encoding():
    if not _HELD:
        _HELD.append(tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(VOCABULARY), special_tokens={}))
    return _HELD[0]


def test_bpe_without_room_for_states(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 3)
    monkeypatch.setattr(bpe, "MAX_PIECES", 2)
    codec = bpe.Codec(bpe.load_ranks(VOCABULARY), bpe.plain_pattern(public_tokenizers.PATTERN))
    for text in ("the theatre of théâtre", "aaaaaaaaaaaa", "antidisestablishmentarianism 12345", "🙂🙃"):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == tiktoken_encoding().encode_ordinary(text)


def test_utf8_machine_matches_replacement_decoding():
    random.seed(1)
    machine = bpe.Utf8Machine()
    every = [*range(0x7E, 0x84), 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC2, 0xDF, 0xE0, 0xE2, 0xED, 0xEF, 0xF0, 0xF3, 0xF4, 0xF5, 0xFF, 0x41]
    for _ in range(2000):
        data = bytes(random.choices(every, k=20))
        state, out, i = ("", b""), b"", 0
        while i < len(data):
            n = random.randint(1, 4)
            state, some = machine.feed(state, data[i : i + n])
            out += some
            i += n
        assert (out + machine.end(state)).decode() == data.decode("utf-8", "replace")


def test_rare_words_are_walked_and_build_no_states():
    """A walk tries longest tokens first and goes back where none follows; it gives BPE by its definition."""
    t = bpe.Transducer({bytes([b]): b for b in range(256)} | {x: 256 + i for i, x in enumerate((b"ab", b"bc", b"abc", b"cd", b"bcd", b"aa", b"aaa", b"abab"))})
    random.seed(14)
    for _ in range(3000):
        word = bytes(random.choice(b"abcd") for _ in range(random.randrange(1, 14)))
        assert t.walk(word) == [t.ranks[x] for x in t.merge(word)], word
    for _ in range(bpe.BUILT_AFTER):
        assert t.encode(b"abcabd") == t.walk(b"abcabd") and not t.steps
    for _ in range(6 * bpe.BUILT_AFTER):
        assert t.encode(b"abcabd") == t.walk(b"abcabd")
    assert len(t.steps) == 6


def test_decoding_tokens_that_split_characters(tokenizer):
    codec = bpe.codec(VOCABULARY, public_tokenizers.PATTERN)
    ids = [i for byte in "é漢🙂 a".encode() + b"\xe6\xbc" for i in [codec.pieces.transducer.ranks[bytes([byte])]]]
    assert "".join(codec.decode_text(np.array(ids, "<u4").tobytes(), 2)) == "é漢🙂 a\ufffd"


def test_tokenize_edges(spark):
    run = lambda df: bpe.tokenize(df, VOCABULARY, public_tokenizers.PATTERN)
    assert run(docs(spark, {})).count() == 0
    rows = run(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], DOCS)).collect()
    assert len(rows) == 3 and len({r.ids_sha256 for r in rows}) == 1


def test_tokenize_table(spark, tokenizer):
    got = {r.doc_id: r for r in bpe.tokenize(docs(spark, ODD, extra=True), VOCABULARY, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(ODD):
        ids = tokenizer.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


# --- 4 URLs --------------------------------------------------------------------------------------


def judge(spark, addresses, rules=queries.RULES):
    pages = spark.createDataFrame(list(enumerate(addresses)), "page_id long, url string").selectExpr("*", "'h' as host", "'p' as path", "'k' as key")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}


def test_url_verdicts(spark):
    got = judge(spark, ["http://WWW.Example.com/en/7?x", "https://a.example.com/en/8", "http://example.net/de/81#t", "http://example.net/de/", "http://notcom/en/", "no scheme", None, "http://h.org/fr/", "x://com/en/", "http://org", "http://u@example.com:80/en/"])
    assert got == {0: ("www.example.com", "/en/7", "example.com/en/7", "allow"), 1: ("a.example.com", "/en/8", "com/en/", "block"), 2: ("example.net", "/de/81", "example.net/de/8", "block"), 3: ("example.net", "/de/", "net/de/", "allow"), 4: ("notcom", "/en/", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("h.org", "/fr/", None, "allow"), 8: ("com", "/en/", "com/en/", "block"), 9: ("org", "", None, "allow"), 10: ("u@example.com:80", "/en/", None, "allow")}


def test_urls_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(urls, "SWEEP_ROWS", 5)
    random.seed(2)
    part = lambda: "/".join(random.choices(["a", "ab", "b", ""], k=random.randint(0, 3)))
    host = lambda: ".".join(random.choices(["x", "y", "com"], k=random.randint(1, 3)))
    rules = list({(h, p): (h, p, random.choice(["allow", "block"])) for h, p in ((host(), "/" + part()) for _ in range(40))}.values())
    addresses = [f"http://{host()}/{part()}" for _ in range(300)]
    got = judge(spark, addresses, rules)
    for i, u in enumerate(addresses):
        h, _, p = u[7:].partition("/")
        fit = [(len(a + b), len(a), a + b, v) for a, b, v in rules if (h == a or h.endswith("." + a)) and ("/" + p).startswith(b)]
        assert got[i] == (h, "/" + p, *(max(fit)[2:] if fit else (None, "allow")))


def test_very_long_urls_take_linear_time(spark):
    host = ".".join(["a"] * 20_000) + ".example.com"
    got = judge(spark, [f"http://{host}/en/7/{'x/' * 20_000}", f"http://{host}/no"])
    assert got[0][2:] == ("example.com/en/7", "allow") and got[1][2:] == (None, "allow")


def test_url_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/x"), (1, "http://a.com/en/x"), (None, "http://a.com/en/x"), (2, None)], "page_id long, url string")
    got = urls.judge(pages, spark.createDataFrame([*queries.RULES, ("com", "/en/", "allow"), (None, "/", "block"), ("", "", "block")], "host string, path string, verdict string")).collect()
    assert sorted(((r.page_id or 0), r.rule, r.verdict) for r in got) == [(0, "com/en/", "block"), (1, "com/en/", "block"), (1, "com/en/", "block"), (2, "", "block")]


def test_hosts_of_odd_characters_are_not_subdomains(spark):
    pages = spark.createDataFrame([(1, "http://example,evil.com/en/7x"), (2, "http://com,example/en/"), (3, "http://a.example.com/en/7"), (4, "http://.com/en/"), (5, "http://example.com./en/7")], "page_id long, url string")
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, rules).collect()}
    assert got == {1: ("com/en/", "block"), 2: (None, "allow"), 3: ("example.com/en/7", "allow"), 4: ("com/en/", "block"), 5: (None, "allow")}


def test_urls_of_nothing(spark):
    assert judge(spark, ["http://a/b"], [("z", "/", "block")])[0][3] == "allow"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(queries.RULES, "host string, path string, verdict string")).count() == 0


# --- 5 HTML --------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain words only", "plain words only"),
        ("<p>a b c<p>d &amp; e", "a b c\nd & e"),
        ("<nav>x y z</nav>", ""),
        ("<article></article><footer>f</footer>", ""),
        ("<article>one<script>x</script> two<!-- c --> three<style>p</style></article", "one two three"),
        ("<article><h1>T</h1><p>a</p><form><label>Name</label></form><aside>" + "w " * 500 + "</aside><p>b</p><section class=comments><p>hi</p></section></article>", "T\na\nb"),
        ("<body><ul class='menu'><li>x</ul><div id=main>A  text,\n here.<br>And there.</div><div class='cookie-banner'>ok?</div>", "A text, here.\nAnd there."),
    ],
)
def test_html_text(page, want):
    assert html.extract(page) == want


def test_html_raw_element_after_a_letter_that_grows_in_lower_case():
    assert html.extract("<div><p>İzmir</p><script>x</script><p>rest</p><STYLE>p{}</Style><p>end</p></div>") == "İzmir\nrest\nend"


@pytest.mark.parametrize("small", ['<div class="logo-text">ACME</div>', '<figure><figcaption class="post">A caption</figcaption></figure>', "<article>One teaser.</article>"])
def test_html_small_marked_text_does_not_discard_the_article(small):
    article = "The long article tells of a bridge over the river and of those who built it."
    assert article in html.extract(f"<body>{small}<div><p>{article}</p><p>{article}</p></div></body>")


def test_html_article_keeps_the_title_in_its_header_div():
    assert html.extract('<div class="header">Site</div><article><div class="header"><h1>Title</h1></div><p>One two three.</p></article>') == "Title\nOne two three."


def test_labelled_pages_come_out_as_labelled():
    for page in html.LABELLED:
        inside = " ".join(re.sub(r"<[^>]*>", " ", " ".join(re.findall(r"\[\[(.*?)\]\]", page, re.S))).split())
        got = html.extract(page.replace("[[", "").replace("]]", ""))
        assert re.sub(r"\W+", "", got) == re.sub(r"\W+", "", inside)


HELD_OUT = [
    ('<div class="content no-sidebar"><p>First words here.</p><p>And more of them.</p></div>', "First words here.\nAnd more of them."),
    ('<article><div class="article-header"><h1>A title</h1></div><p>One two three four.</p></article>', "A title\nOne two three four."),
    ('<article><p>One two three four.</p><p class="related-work">Others did the same before.</p><p>End of it.</p></article>', "One two three four.\nOthers did the same before.\nEnd of it."),
    ('<main><div class="search-and-replace">Find a word and put another.</div><p>That is all.</p></main>', "Find a word and put another.\nThat is all."),
    ('<body><div><p>See <a href="/x">the whole long title of the paper</a> for more on this.</p><p>It is short.</p></div></body>', "See the whole long title of the paper for more on this.\nIt is short."),
    ('<body><nav><a href="/">Home</a><a href="/b">Blog</a></nav><article><h2>Ten tips</h2></article><div><p>The long text is outside of any article here.</p><p>It goes on for a while, as texts do, and ends.</p></div><footer><p>Legal notes and more.</p></footer></body>', "Ten tips\nThe long text is outside of any article here.\nIt goes on for a while, as texts do, and ends."),
    ('<body><div class="cookie-consent"><p>We and our partners store things.</p></div><article><p>Rain <span class="ad">Buy!</span> fell.</p><div class="ad-slot"><p>Umbrellas at half the price, only today and only here.</p></div><p>It fell on.</p></article><ul class="comment-list"><li><p>Nice rain.</p></li></ul></body>', "Rain fell.\nIt fell on."),
    ("<div><h1>Nuts</h1>Some text<br>and some more<ul><li>one nut</li><li>two nuts</li></ul></div><aside><p>Seen in shops.</p></aside>", "Nuts\nSome text\nand some more\none nut\ntwo nuts"),
]


@pytest.mark.parametrize(("page", "want"), HELD_OUT)
def test_pages_that_were_not_learnt(page, want):
    assert html.extract(page) == want


@pytest.mark.parametrize("piece", ["<a ", "<a '>' ", '<a "', "<b></i>", "<b>", "<p><b>", "<div ", "<!--", "</x", "<script>a</script ", "<div><b></p>", "& &# &x; "])
def test_malformed_pages_take_linear_time(piece):
    import time

    def took(n):
        began = time.process_time()
        html.extract(piece * (n // len(piece)) + "<p>end</p>")
        return time.process_time() - began

    took(1000)
    assert took(1_000_000) < 60 * max(took(50_000), 0.02)


STORY = "<article><h1>Snow</h1><p>It fell all night, and by the morning the roads were closed.</p><p>Nobody went to work.</p></article>"


@pytest.mark.parametrize("other", ['<section id="feedback"><p>Anna: we had a metre of it, and no bread for two days.</p></section>', '<div class="kommentare"><p>Ben: bei uns war es noch mehr, und der Bus kam nicht.</p></div>', '<div class="werbung"><p>Kaufen Sie jetzt Schaufeln, nur heute zum halben Preis!</p></div>', '<div class="more-stories"><p>Ten winters that nobody who lived through them forgets</p></div>'])
def test_what_stands_beside_an_article_is_left_out(other):
    assert html.extract(f"<body>{STORY}{other}</body>") == "Snow\nIt fell all night, and by the morning the roads were closed.\nNobody went to work."


def test_tags_that_never_end():
    assert html.extract('<p>Text <a href="x>link</a> more</p>') == "Text link more"  # an unpaired quote is a character
    assert html.extract("<p>One two three</p><p title='a > b'>four five</p><p>six seven <a href='x") == "One two three\nfour five\nsix seven"


def test_main_text_of_a_table(spark):
    long = "<article>" + "<p>some words of a very long page</p>" * 20_000 + "</article>"
    rows = [(1, None, "<p>a b c</p>"), (1, None, "<p>a b c</p>"), (None, "u", None), (2, "u", ""), (3, "u", long), (4, "u", "<nav>x</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' as text", "5 as n_chars")
    got = html.main_text(pages).collect()
    assert sorted((r.page_id or 0, r.url, len(r.text), r.n_chars) for r in got if r.page_id != 1) == [(0, "u", 0, 0), (2, "u", 0, 0), (3, "u", 619_999, 619_999), (4, "u", 0, 0)]
    assert [(r.text, r.n_chars) for r in got if r.page_id == 1] == [("a b c", 5)] * 2
    assert html.main_text(pages.limit(0)).count() == 0


def test_given_pages_give_their_articles(spark):
    """The given pages hold one article element each: their text is its text, found by another parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.deep, self.words = 0, []

        def handle_starttag(self, tag, attrs):
            self.deep += tag == "article" or self.deep > 0 and tag == "article"

        def handle_endtag(self, tag):
            self.deep -= tag == "article"

        def handle_data(self, data):
            self.words += data.split() if self.deep > 0 else []

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        other = Article()
        other.feed(r.html or "")
        assert "".join(html.extract(r.html).split()) == "".join(other.words), r.page_id


def test_region_is_the_best_run():
    random.seed(4)
    for _ in range(200):
        s = [random.randint(-5, 5) for _ in range(12)]
        a, b = html.region(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(12) for j in range(i + 1, 13))])


# --- 6 substrings --------------------------------------------------------------------------------


def brute_repeats(rows):
    """doc_id to kept words; rows are (id, text) with different ids."""
    seen, kept = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        gone = set()
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone.update(range(p, p + 20))
            seen.add(k)
        kept[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest())
    return kept


@pytest.mark.parametrize("chunk", [300, 1_000_000])
def test_repeats_against_brute_force(spark, chunk):
    random.seed(6)
    passages = [" ".join(random.choices("abcdefghij", k=random.randint(18, 70))) for _ in range(6)]
    texts = {i * 2: " ".join(random.choice([passages[random.randrange(6)], " ".join(random.choices([f"u{k}" for k in range(500)], k=15)), "\n", "z " * 30]) for _ in range(4)) for i in range(60)}
    texts |= {501 + i: t for i, t in enumerate(t for t in ODD if t is None or len(t) < 30_000)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs(spark, texts, extra=True), chunk_chars=chunk, group_chars=2000).collect()}
    assert got == brute_repeats(texts.items())


def test_rows_with_equal_ids_are_one_place(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text + " end")], DOCS)
    got = sorted((r.doc_id or 0, r.n_removed) for r in substrings.remove_repeats(rows).collect())
    assert got == [(0, 0), (1, 30), (1, 30), (2, 30)]
    assert substrings.remove_repeats(docs(spark, {})).count() == 0


@pytest.mark.parametrize("width", [1, 2, 5, 10, 20])
def test_rolling_hash(width):
    w = np.arange(50, dtype=np.uint64) * np.uint64(977) + np.uint64(3)
    h = substrings.rolling(np.concatenate([w, w]), width, substrings._BASE[0])
    assert len(h) == 101 - width and (h[: 51 - width] == h[50:]).all() and len(set(h.tolist())) == 50


# --- 7 decontamination ---------------------------------------------------------------------------


def brute_hits(texts, items, width=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items.items():
        w = cut(t)
        for k in range(max(1, len(w) - width + 1)) if w else []:
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = {}
    for d, t in texts.items():
        w = cut(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("limit", [8_000_000, 300])
def test_decontamination_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", limit)
    random.seed(7)
    pick = lambda n: " ".join(random.choices(["A", "b", "c", "É", "7"], k=n))
    items = {i: pick(random.choice([0, 1, 3, 5, 12, 13, 14, 20, 40])) for i in range(25)} | {98: "", 99: None}
    items |= {50: "zebra", 51: "Zebra", 52: items[3]}
    texts = {i: " ".join([pick(random.randint(0, 30)), (items[random.choice(list(items))] or "").lower(), "- other words, here"]) for i in range(60)} | {200: None, 201: "", 202: "?!"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string").selectExpr("*", "'n' as n_words")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.decontaminate(docs(spark, texts, extra=True), bench).collect()}
    assert got == brute_hits(texts, items)


@pytest.mark.parametrize("limit", [8_000_000, 60])
def test_spans_are_cut_out(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", limit)
    item = " ".join(f"q{i}" for i in range(15))
    bench = spark.createDataFrame([("a", item), ("b", "other words of a test that no text here holds, none at all, ever")], "item_id string, text string")
    around = lambda n: " ".join(f"w{i}" for i in range(n))
    texts = [f"{around(400)}, {item.upper()}; {around(5)}\n", f"{around(20)} {item}", f"{around(3)}\n\tx", None, "", item]
    frame = docs(spark, texts, extra=True).selectExpr("*", "'l' as lang", "3 as spans")
    got = {r.doc_id: (r.text, [tuple(s) for s in r.spans], r.lang) for r in decontaminate.without_spans(frame, bench, keep=("lang",)).collect()}
    assert got == {0: (f"{around(400)}, ; {around(5)}\n".replace(", ;", ", ;"), [(400, 415)], "l"), 2: (texts[2], [], "l"), 3: (None, [], "l"), 4: ("", [], "l")}
    whole = {r.doc_id: r.text for r in decontaminate.without_spans(frame, bench, longest=15).collect()}
    assert whole[0] == texts[0] and set(whole) == {0, 2, 3, 4}
    judged = {r.doc_id: (r.contaminated, r.lang) for r in decontaminate.decontaminate(frame, bench, keep=("lang",)).collect()}
    assert judged == {0: (False, "l"), 1: (True, "l"), 2: (False, "l"), 3: (False, "l"), 4: (False, "l"), 5: (True, "l")}


def test_short_items_are_found_at_every_length():
    items = [("a", [b"x"]), ("b", [b"x", b"y"]), ("c", [b"q"] * 13), ("d", [b"y"])]
    a = decontaminate.Automaton(items, 13)
    assert a.scan([b"z", b"x", b"y", b"z", b"y"]) == ([(1, 3), (4, 5)], {"a", "b", "d"})
    assert a.scan([b"q"] * 15) == ([(0, 15)], {"c"})
    assert a.scan([]) == ([], set())


def test_no_items(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.decontaminate(docs(spark, ["a b"]), bench).collect()] == [False]


# --- 8 WARC --------------------------------------------------------------------------------------


def test_warc_round_trip_and_lookup(spark, tmp_path):
    long = "<p>é 漢 " + "x" * 200
    rows = [(0, "http://b.example.com/1", long), (1, "http://a.example.com/2?q", long), (2, None, None), (3, "http://a.org/\r\nx", "short"), (4, "http://a.org/", "short"), (5, "http://c.net/", "\x00\x1f\ud7ff" * 60), (6, "http://big.net/", "y" * 17_000_000), (6, "http://big.net/", "y" * 17_000_000), (None, "http://n.net/", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'d' as digest", "1 as size")
    archive = warc.write(pages, str(tmp_path / "w"))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.lookup(spark, archive, pages).collect()), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    want = [(i, size(t), sha(t), "revisit" if i == 1 or i is None else "response", 0 if i == 1 or i is None else None) for i, _, t in rows]
    assert got == sorted(want, key=str)
    found = warc.lookup(spark, archive, spark.createDataFrame([("https://a.example.com/2?q",), ("http://none.org/",), (None,), ("http://c.net/",)], "url string")).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in found) == [(1, size(long)), (2, 0), (5, size(rows[5][2]))]


def test_warc_index_of_several_levels_and_files(spark, tmp_path, monkeypatch):
    for name, value in (("BLOCK_ENTRIES", 3), ("TOP", 4), ("FILE_RECORDS", 7), ("COMMON", 5)):
        monkeypatch.setattr(warc, name, value)
    page = lambda i: ("w" * 150 if i % 3 == 0 else f"<p>{i // 2} " + "v" * 120 if i % 3 == 1 else f"t{i}")
    rows = [(i, None if i % 17 == 0 else f"http://h{i % 5}.org/{i if i % 4 else 'same'}", page(i)) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write(pages, str(tmp_path / "w"))
    assert archive.levels > 2
    files = [p for p in (tmp_path / "w-records").glob("part-*") if p.stat().st_size]
    assert len(files) >= 120 // 7
    first = {}
    for i, _, t in rows:
        first.setdefault(t, i)
    want = [(i, len(t), hashlib.sha256(t.encode()).hexdigest(), *(("revisit", first[t]) if len(t) >= 100 and first[t] != i else ("response", None))) for i, _, t in rows]
    got = warc.lookup(spark, archive, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == want
    some = warc.lookup(spark, archive, spark.createDataFrame([("http://h0.org/same",), ("http://h1.org/11",), ("http://h1.org/12",)], "url string")).collect()
    assert sorted(r.page_id for r in some) == [i for i, u, _ in rows if u in ("http://h0.org/same", "http://h1.org/11", "http://h1.org/12")]
    ids = [w for p in files for w in __import__("re").findall(rb"WARC-Record-ID: (\S+)", gzip.decompress(p.read_bytes()))]
    assert len(ids) == len(set(ids)) == 120


def test_archives_are_gzip_members(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "t" * i) for i in range(50)], "page_id long, url string, html string")
    archive = warc.write(pages, str(tmp_path / "w"))
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w-records").glob("part-*") if p.stat().st_size)
    assert whole.count(b"WARC/1.1\r\n") == 50


def test_warc_urls_with_outer_white_space(spark, tmp_path):
    urls_ = ["http://a.example/a", "http://a.example/b ", " http://a.example/c", "http://a.example/d \t ", "\u00a0http://a.example/e\u00a0", "http://a.example/f\x0b", " ", "", "\t", None, " x ", "http:// /", "http://a.example/\r\n"]
    pages = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(urls_)], "page_id long, url string, html string")
    got = warc.round_trip(pages, str(tmp_path / "w"))
    assert sorted(r.page_id for r in got.collect()) == list(range(len(urls_)))


def test_warc_of_nothing(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e")).count() == 0


# --- 9 quality -----------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r.score) for r in queries.op9_quality(spark, sf).filter("held_out").collect() if r.doc_id in labels]
    good, bad = [s for q, s in rows if q == 1], [s for q, s in rows if q == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.95 and np.mean(np.array(good) >= 0.5) > 0.9


def unlabelled(spark, rows):
    return spark.createDataFrame([(i % 2, bytearray(np.asarray(x, np.float32).tobytes())) for i, x in enumerate(rows)], "key int, x binary")


def test_quality_edges(spark):
    scored = quality.score(docs(spark, ODD, extra=True), None).collect()
    assert [r.score for r in scored] == [0.5] * len(ODD)
    model = quality.fit_pu(np.array([quality.features("a good text, with words.")] * 5), unlabelled(spark, [quality.features("!!! ###")] * 5))
    for r in quality.score(docs(spark, [*ODD, None]), model).collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs(spark, ["a"]), empty) is None
    assert quality.fit(docs(spark, {}), spark.createDataFrame([(1, 1, 0)], empty.schema)) is None


def test_quality_learns_from_repeated_and_null_ids(spark):
    good = [f"a fine day number {i}, with some words to tell of it." for i in range(40)]
    bad = [f"### {i} !!! $$$ %%% ***" for i in range(40)]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(i, good[0] + " again", 1) for i in range(40)] + [(1000 + i, t, 2) for i, t in enumerate(bad)] + [(None, t, 3) for t in bad]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key int").selectExpr("*", "'x' as half", "'y' as x")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, 0)] + [(0, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(frame, labels)
    got = quality.score(frame, model).collect()
    assert len(got) == len(rows)
    assert np.mean([r.score for r in got if r.doc_id is not None and r.doc_id < 1000]) > np.mean([r.score for r in got if r.doc_id is None]) + 0.3


def test_pu_risk_is_least_where_a_plain_search_finds_it(spark):
    """The Newton steps against gradient descent on the same risk, written out anew on one array."""
    rng = np.random.default_rng(3)
    pos, neg = rng.normal(0.6, 1, (300, quality.WIDTH)), rng.normal(-0.6, 1, (300, quality.WIDTH))
    pos[:, 4:] = neg[:, 4:] = 0
    mixed = np.concatenate([pos[150:], neg]).astype(np.float32)
    model = quality.fit_pu(pos[:150].astype(np.float32), unlabelled(spark, mixed))
    assert 0.15 < model.prior < 0.6
    ridge = 0.005 + 20 / 150
    z = lambda x: np.clip((x - model.mean) / model.scale, -6, 6)
    p, u = z(pos[:150].astype(np.float32).astype(np.float64)), z(mixed.astype(np.float64))

    def risk(w, b):
        loss = lambda f: np.log1p(np.exp(-f))
        fp, fu = p @ w + b, u @ w + b
        return model.prior * loss(fp).mean() + max(0.0, loss(-fu).mean() - model.prior * loss(-fp).mean()) + 0.5 * ridge * (w @ w)

    w, b = np.zeros(quality.WIDTH), 0.0
    for _ in range(4000):
        s = 1 / (1 + np.exp(-(u @ w + b)))
        w, b = w - 0.3 * (u.T @ s / len(u) - model.prior * p.mean(0) + ridge * w), b - 0.3 * (s.mean() - model.prior)
    assert risk(model.weights, model.bias) <= risk(w, b) + 1e-4
    assert np.mean(model.score(neg) < 0.5) > 0.8 and np.mean(model.score(pos) >= 0.5) > 0.6


# --- 10 fingerprints -----------------------------------------------------------------------------


def test_edited_fingerprints_against_brute_force(spark):
    texts = {i * 7: t for i, t in enumerate([*ODD, "Strasse", "STRASSE ", "straße", "ﬁne", "fine", *(f"text {i} " * (i % 9) for i in range(80))])}
    ids = sorted(texts)
    got = {r.doc_id: tuple(r)[1:] for r in fingerprint.edited_fingerprints(docs(spark, texts, extra=True)).collect()}
    canon, digest = fingerprint.canonical, fingerprint.digest
    for k, i in enumerate(ids):
        t, nxt = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert got[i] == (len(t), hashlib.sha256(edited.encode()).hexdigest(), digest(canon(t)), digest(canon(edited)), float(canon(t) == canon(edited)), float(canon(t) == canon(nxt)))
    assert canon("Straße \n x") == canon("STRASSE x") and canon("ﬁ") == b"fi"


def test_fingerprint_edges(spark):
    one = fingerprint.edited_fingerprints(docs(spark, {5: "abcdefgh"})).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0
    assert fingerprint.edited_fingerprints(docs(spark, {})).count() == 0
    twice = fingerprint.edited_fingerprints(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, "c")], DOCS)).collect()
    assert len(twice) == 4
    groups = {r.doc_id: r.group_id for r in fingerprint.exact_groups(docs(spark, ["A b", "a  B ", "c", None, ""])).collect()}
    assert groups == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}


def canonical_again(text):
    """Written anew, character by character."""
    import unicodedata

    out, gap = [], False
    folded = unicodedata.normalize("NFKC", "".join(c.casefold() for c in unicodedata.normalize("NFKC", text or "")))
    for c in folded:
        if c.isspace():
            gap = bool(out)
        else:
            out += [" ", c] if gap else [c]
            gap = False
    return "".join(out).encode()


def test_fingerprints_against_another_canonical_form(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(100_000 + i, t) for i, t in enumerate([*ODD, "ﬁne ÉTÉ\u3000x", "fine été X", "K \u212a", "\u1e9e", "SS"])]
    got = {r.doc_id: r.fingerprint for r in fingerprint.edited_fingerprints(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: xxhash.xxh3_128_hexdigest(canonical_again(t)) for i, t in rows}


@pytest.mark.parametrize("hot", [200_000, 10])
def test_bytes_are_compared_in_equal_buckets(spark, monkeypatch, hot):
    """A digest that says little brings different texts into one bucket; suffixes tell them apart."""
    from datavouch.functions import tables

    monkeypatch.setattr(tables, "HOT_ROWS", hot)
    texts = {i: f"{'ab'[i % 2]} text {i % 5 if i < 50 else 7}" for i in range(90)} | {200: None, 201: " "}
    source = docs(spark, texts)
    poor = lambda c: ("%032x" % (len(c) % 3)) if c != b"b text 7" else "%032x" % 9
    rows = [(i, poor(c), hashlib.sha256(c).digest()) for i, t in texts.items() for c in [fingerprint.canonical(t)]]
    monkeypatch.setattr(fingerprint, "digest", poor)
    marked = spark.createDataFrame(rows, "doc_id long, bucket string, sha binary")
    found = {(r.bucket, bytes(r.sha)) for r in fingerprint.different_texts(source, marked).collect()}
    groups = {}
    for _, b, sha in rows:
        groups.setdefault(b, set()).add(sha)
    assert found == {(b, s) for b, shas in groups.items() if len(shas) > 1 for s in shas} and len(groups) > 2
    names = {}
    for r in fingerprint._distinguished(marked, source, marked, "bucket").collect():
        names.setdefault(r.bucket, set()).add(bytes(r.sha))
    assert all(len(v) == 1 for v in names.values()) and len(names) == len({s for _, _, s in rows})


def test_rows_of_one_id_are_several_runs(spark):
    rows = [(7, f"text number {i} of one id") for i in range(400)] + [(None, f"no id {i}") for i in range(300)] + [(i, f"own {i}") for i in range(100, 140)]
    edges = fingerprint._edges(spark.createDataFrame(rows, DOCS).selectExpr(f"coalesce(doc_id, {-(1 << 63)}) as k", "xxhash64(text) as h"), 8)
    assert len([k for k, _ in edges if k == 7]) > 3 and len([k for k, _ in edges if k < 0]) > 3
    got = fingerprint.edited_fingerprints(spark.createDataFrame(rows, DOCS)).collect()
    h = {r.text: r.h for r in spark.createDataFrame(rows, DOCS).selectExpr("text", "xxhash64(text) as h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1]]))
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got if r.doc_id) == sorted(w for w in want if w[0])
    assert sorted(r.edited_sha256 for r in got if r.doc_id is None) == sorted(w[2] for w in want if w[0] is None)


def test_clashing_buckets_get_suffixes(spark):
    marked = spark.createDataFrame([(1, "b", bytearray(b"x")), (2, "b", bytearray(b"y")), (3, "b", bytearray(b"x")), (4, "c", bytearray(b"x"))], "doc_id long, bucket string, sha binary")
    assert sorted((r.doc_id, r.f) for r in fingerprint._suffixed(marked, "bucket", "sha", "f").collect()) == [(1, "b"), (2, "b-1"), (3, "b"), (4, "c")]


def test_a_worker_keeps_the_caches_of_one_operator():
    from datavouch.llm import common

    said = []
    common.claim("one", lambda: said.append("one"))
    common.claim("one", lambda: said.append("one"))
    common.claim("two", lambda: said.append("two"))
    common.claim("three")
    common.claim("one", lambda: None)
    assert said == ["one", "two"]
    common.claim("none")


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    kinds = frame.dtypes
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in frame.collect()}
        frame = stage(spark, frame, SF)
        assert frame.dtypes == kinds, name
        frame = spark.createDataFrame(frame.collect(), frame.schema)
        after = {r.doc_id: r.text for r in frame.collect()}
        assert set(after) <= set(before) and after
        if name == "near_copies":
            assert sorted(after, key=str) == brute_near_copies(list(before.items()))
        elif name == "repeats":
            assert {i: hashlib.sha256(" ".join(words(t)).encode()).hexdigest() for i, t in after.items()} == {i: k[2] for i, k in brute_repeats(before.items()).items()}
        elif name == "benchmark":
            items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
            assert set(after) == {i for i, h in brute_hits(before, items).items() if not h[4]}
    assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == frame.count()
    assert corpus_pipeline.run(spark, SF).count() == frame.count()


def five_word_shingles(text):
    w = words((text or "").translate(LOWER))
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_near_copies(rows):
    """The rows (id, text) that stay: smallest id of each component, nulls last."""
    sets = [five_word_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for k in range(i):
            if 5 * len(x & sets[k]) >= 4 * len(x | sets[k]):
                root[find(i)] = find(k)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return sorted((min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in groups.values()), key=str)


def near_copy_stage(spark, rows):
    import corpus_pipeline

    frame = spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, frame, SF)
    assert got.dtypes == frame.dtypes
    return [(r.doc_id, r.text) for r in got.collect()]


@pytest.mark.parametrize("rounds", [1, 2])
def test_near_copies_against_brute_jaccard(spark, monkeypatch, rounds):
    from datavouch.llm import nearcopies

    monkeypatch.setattr(nearcopies, "ROUNDS", rounds)
    random.seed(9)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for base in range(12):  # copies with up to ten edits in 300 words, around similarity 0.8; chains of them too
        text = [f"w{base}x{random.randrange(900)}" for _ in range(300)]
        for _ in range(8):
            copy = list(text)
            for _ in range(random.randrange(11)):
                copy[random.randrange(300)] = f"edit{random.random()}"
            rows.append((10_000 + len(rows), " ".join(copy)))
            text = copy if random.random() < 0.3 else text
    assert sorted((i for i, _ in near_copy_stage(spark, rows)), key=str) == brute_near_copies(rows)


def test_near_copies_begin_with_simhash(spark, monkeypatch):
    """The stage's first candidates are op2's: SimHash fingerprints within two bits, by pigeonhole."""
    from datavouch.llm import nearcopies

    own, seen = simhash.links, []

    def spy(nodes, tau):
        seen.append((tau, nodes.count()))
        return own(nodes, tau)

    monkeypatch.setattr(simhash, "links", spy)
    random.seed(12)
    text = [f"w{random.randrange(900)}" for _ in range(400)]
    rows = [(i, " ".join([*text[:k], "edit", *text[k + 1 :]])) for i, k in enumerate([0, 1, 2, 3, 395, 396, 397, 398])] + [(9, "quite another text"), (10, "")]
    assert sorted((i for i, _ in near_copy_stage(spark, rows)), key=str) == brute_near_copies(rows) == [0, 10, 9]
    assert seen and seen[0][0] == 2 and 1 < seen[0][1] <= 9
    sims = [random.getrandbits(64) for _ in range(20)]
    sims += [s ^ 1 << random.randrange(64) ^ 1 << random.randrange(64) for s in sims for _ in range(4)] + sims[:5]
    nodes = [(i, s - (1 << 64) if s >> 63 else s) for i, s in enumerate(sims)]
    pairs = {(r.a, r.b) for r in nearcopies._fingerprint_pairs(spark.createDataFrame(nodes, "fp long, sim long")).collect()}
    assert all((sims[a] ^ sims[b]).bit_count() <= 2 for a, b in pairs)
    head = {s: sims.index(s) for s in sims}
    want = {frozenset((i, k)) for i in head.values() for k in head.values() if i < k and (sims[i] ^ sims[k]).bit_count() <= 2} | {frozenset((i, head[s])) for i, s in enumerate(sims) if head[s] != i}
    assert {frozenset(p) for p in pairs} == want


@pytest.mark.parametrize(("lot", "hot"), [(2000, 200_000), (7, 20)])
def test_prefixes_find_all_similar_sets(spark, monkeypatch, lot, hot):
    """Sets that share common hashes, compared with all pairs; hashes in many sets are dealt out."""
    from datavouch.functions import tables
    from datavouch.llm import nearcopies

    monkeypatch.setattr(nearcopies, "LOT", lot)
    monkeypatch.setattr(tables, "HOT_ROWS", hot)
    random.seed(10)
    common, sets = [random.getrandbits(64) for _ in range(12)], []
    for _ in range(25):
        base = {random.getrandbits(64) for _ in range(random.choice([1, 5, 30, 60]))} | set(random.sample(common, 9))
        for _ in range(4):
            sets.append({x for x in base if random.random() > 0.06} | {random.getrandbits(64) for _ in range(random.randrange(4))})
    rows = [(i, i // 2, np.array(sorted(x), np.uint64).tobytes()) for i, x in enumerate(sets)]  # neighbours are one component
    got = {(r.a, r.b) for r in nearcopies._prefix_pairs(spark.createDataFrame(rows, "fp long, c long, found binary")).collect()}
    want = {(i, k) for i, x in enumerate(sets) for k, y in enumerate(sets) if i // 2 < k // 2 and 5 * len(x & y) >= 4 * len(x | y)}
    assert want <= got and len(want) > 20 and all(i // 2 < k // 2 for i, k in got)


def test_tau_beyond_the_links_is_an_error(spark):
    with pytest.raises(ValueError, match="tau"):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), tau=3)


def test_near_copies_count_rows_not_ids(spark):
    a, b, c = ("%s one two three four five six seven eight" % x for x in "abc")
    rows = [(None, a), (None, a), (7, a), (4, b), (4, b), (4, c), (2, b), (None, "x y"), (None, "x y"), (9, None), (None, "")]
    got = near_copy_stage(spark, rows)
    assert sorted(got, key=str) == sorted([(7, a), (2, b), (4, c), (None, "x y"), (9, None)], key=str)


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    shared = " ".join(f"s{i}" for i in range(40))
    texts = [None, None, "", " \n", "word " * 30_000, f"{shared} one end of it here", f"{shared} another end that is not the same at all, with more", "a few words only"]
    rows = [(None if i % 3 == 0 else i, t, None if i == 1 else "en", None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[7], rows[5], rows[6]]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(rows, kinds)
    odd = frame.selectExpr("*", "'x' as row", "1 as score", "'y' as spans", "2 as keep_text", "'z' as fp")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        left[name] = out.collect()
        assert stage(spark, odd.limit(0), SF).count() == 0, name
        if name != "tokens":
            assert out.columns == list(corpus_pipeline.COLUMNS), name
    assert len(left["repeats"]) == len(left["tokens"]) == len(rows)
    assert sorted((r.doc_id or 0, r.text or "") for r in left["near_copies"]) == sorted([(1, ""), (4, texts[4]), (5, texts[5]), (0, texts[6]), (7, texts[7])])
    assert {r.text for r in left["benchmark"]} == set(texts)
    cut = [r.text for r in left["repeats"] if r.doc_id == 5]
    assert cut == ["one end of it here"] * 2  # the rows without an id come first
    assert all(r.n_tokens == 0 for r in left["tokens"] if r.doc_id in (1, 2))
