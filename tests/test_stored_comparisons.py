"""Content trees, stored runs, evidence, bootstrap draws, written splits and the stream, against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from datavouch.operators import changes, explain, labels, metrics
from datavouch.streaming import run, watch
from pyspark.sql import functions as F

ROW = "f string, a long, b string, deletado boolean"


def verdicts(old, new):
    out = {}
    for k in {r[0] for r in old} | {r[0] for r in new}:
        x, y = (Counter(r for r in rows if r[0] == k) for rows in (old, new))
        up, down = y - x, x - y
        live_up, live_down = (sum(n for r, n in c.items() if not r[3]) for c in (up, down))
        dead = sum(n for c in (up, down) for r, n in c.items() if r[3])
        out[k] = ("AMBIGUA" if live_up and live_down else "REVISAO" if live_up or live_down or dead else "SEM_MUDANCA", sum(up.values()), sum(down.values()))
    return out


def test_content_is_compared_through_trees(spark):
    random.seed(9)
    make = lambda k, n: [(k, random.randrange(40), random.choice(["x", None]), random.random() < 0.2) for _ in range(n)]
    old = [r for k in ("same", "more", "less", "both", "dead", "turned", "gone", None) for r in make(k, 60)]
    new = [r for r in old if r[0] not in ("gone", "less", "both", "dead", "turned")] + make("fresh", 20) + [("more", 1, "x", False)] * 2
    of = lambda k: [r for r in old if r[0] == k]
    new += of("less")[1:] + [*of("both")[1:], ("both", 99, None, False)] + [r for r in of("dead") if not r[3]]
    turn = next(r for r in of("turned") if not r[3])
    rest = of("turned")
    rest.remove(turn)
    new += [*rest, (*turn[:3], True)]
    random.shuffle(new)
    a, b = spark.createDataFrame(old, ROW), spark.createDataFrame(new, ROW)
    want = verdicts(old, new)
    assert {v[0] for v in want.values()} == {"AMBIGUA", "REVISAO", "SEM_MUDANCA"} and want["turned"][0] == "REVISAO"
    count = lambda r: (r.veredito, r.incluidas_vivas + r.incluidas_deletadas, r.removidas_vivas + r.removidas_deletadas)
    assert {r.f: count(r) for r in changes.compare_content(a, b, ["f"], ["a", "b"]).collect()} == want
    assert {r.f: count(r) for r in changes.compare_versions(a, b, ["a", "b"], ["f"]).collect()} == want
    trees = tuple(changes.content_tree(x, ["f"], ["a", "b", "deletado"]) for x in (a, b))
    differ = {(r.f, r.balde) for r in changes.changed_buckets(*trees, ["f"]).collect()}
    assert not any(f in ("same", None) for f, _ in differ)
    assert len([x for x in differ if x[0] == "both"]) <= 2  # one row left, one came: no other bucket is read
    assert {r.f: count(r) for r in changes.compare_content(a, b, ["f"], ["a", "b"], trees=trees).collect()} == want


def test_keys_are_classified_by_content(spark):
    poll = "f string, artifact_id string, resultado string"
    prev = spark.createDataFrame([(k, "v1") for k in ("same", "repacked", "more", "both", "bytes", "gone", "failed")], "f string, artifact_id string")
    curr = spark.createDataFrame([("same", "v1", "OBTIDO"), ("repacked", "v2", "OBTIDO"), ("more", "v2", "OBTIDO"), ("both", "v2", "OBTIDO"), ("bytes", "v2", "OBTIDO"), ("failed", None, "FALHOU"), ("new", "v1", "OBTIDO")], poll)
    rows = [(k, i, "x", False) for k in ("repacked", "more", "both") for i in range(9)]
    later = [*rows, ("more", 10, "x", False), ("both", 11, "x", False)]
    later.remove(("both", 0, "x", False))
    content = changes.compare_content(spark.createDataFrame(rows, ROW), spark.createDataFrame(later[::-1], ROW), ["f"], ["a", "b"])
    got = {r.f: r.situacao for r in changes.classify_keys(prev, curr, ["f"], content=content).collect()}
    assert got == {"same": "INALTERADA", "repacked": "INALTERADA", "more": "REVISAO", "both": "AMBIGUA", "bytes": "BYTES_MUDARAM", "gone": "DESAPARECIDA", "failed": "INCONCLUSIVA", "new": "NOVA"}


def test_repeated_and_null_metrics(spark):
    m = lambda rows: spark.createDataFrame(rows, "e string, v long")
    got = {r.e: (r.valor_a, r.valor_b, r.situacao) for r in changes.diff_metrics(m([("a", 1), ("a", 1), (None, 2), ("b", 3), ("c", 4), ("n", None)]), m([("a", 1), ("a", 1), (None, 2), ("b", 5), ("c", 4), ("c", 4), ("d", 6), ("n", None)]), ["e"], "v").collect()}
    assert got == {"a": (1, 1, "IGUAL"), None: (2, 2, "IGUAL"), "b": (3, 5, "DIVERGENTE"), "c": (None, 4, "SOBRA"), "d": (None, 6, "SOBRA"), "n": (None, None, "IGUAL")}
    notes = lambda xs: spark.createDataFrame([(x,) for x in xs], "nota string")
    r = changes.diff_notes("i", notes(["x", "x", "y"]), notes(["x", "z"])).first()
    assert (r.faltando, r.sobrando, r.primeira, r.situacao) == (2, 1, "x", "DIVERGENTE")
    assert changes.diff_notes("i", notes(["x", "y"]), notes(["y", "x"])).first().situacao == "IGUAL"
    assert changes.diff_notes("i", None, notes(["x"])).first().situacao == "INCONCLUSIVO"


def test_every_fault_of_evidence_is_told(spark):
    ev = "ev_id string, tipo string, rule_id string, consulta string, parametros string, conjunto string, artifact_ids string, n_resultados string, conjunto_hash string"
    base = {"tipo": "VINCULO_ENCONTRADO", "rule_id": "r", "consulta": "existencia", "parametros": '{"chave":"k"}', "conjunto": "d", "artifact_ids": "f1;f2", "n_resultados": "3", "conjunto_hash": "h"}
    cases = {"fine": {}, "query": {"consulta": "outra"}, "set": {"conjunto": "gone"}, "hash": {"conjunto_hash": "old"}, "file": {"artifact_ids": "f1;f2;f9"}, "name": {"parametros": '{"chave":"k","x":1}'}, "count": {"n_resultados": "4"}, "recomputed": {"conjunto": "edited"}, "none": {"tipo": "APLICABILIDADE", "consulta": "aplicabilidade", "parametros": '{"instrumento":"C"}', "conjunto": None, "artifact_ids": "f7", "n_resultados": "0"}, "odd": {"parametros": "not json"}}
    rows = [tuple({**base, "ev_id": k, **v}[c.split()[0]] for c in ev.split(", ")) for k, v in cases.items()]
    manifest = spark.createDataFrame([("d", "h", "h", ["f1", "f2"]), ("edited", "h", "now", ["f1", "f2"])], "conjunto string, hash_declarado string, hash_atual string, artifact_ids array<string>")
    counted = spark.createDataFrame([("r", "f1", "k", 1), ("r", "f2", "k", 2)], "rule_id string, artifact_id string, chave string, n long")
    got = {r.ev_id: (r.divergencias, r.reproduzida) for r in explain.verify_evidence(spark.createDataFrame(rows, ev), manifest, counted).collect()}
    assert got["fine"] == ([], True) and got["none"] == ([], True)
    one = {"query": "consulta_desconhecida", "set": "conjunto_ausente", "hash": "hash_divergente", "file": "artefato_fora_do_conjunto", "name": "parametros_divergentes", "count": "n_resultados_divergente", "recomputed": "hash_divergente"}
    assert {k: got[k] for k in one} == {k: ([v], False) for k, v in one.items()}
    assert got["odd"] == (["parametros_divergentes", "n_resultados_divergente"], False)


def test_ranges_draw_as_plain_resampling_does(spark, monkeypatch):
    random.seed(3)
    sums = [(f"g{i}", random.randrange(5), random.randint(5, 9)) for i in range(3000)]
    df = spark.createDataFrame(sums, "grupo string, num long, den long")
    monkeypatch.setattr(metrics, "RANGES", 16)
    monkeypatch.setattr(metrics, "SPLIT_ROWS", 40)
    ones = metrics.multinomial_replicates(df.withColumn("den", F.lit(1).cast("long")), 3000, 50, 1)
    assert {r.den for r in ones.collect()} == {3000}  # each replicate draws 3000 times
    got = sorted(r.num / r.den for r in metrics.multinomial_replicates(df, 3000, 1500, 42).collect())
    again = sorted(r.num / r.den for r in metrics.multinomial_replicates(df.repartition(7), 3000, 1500, 42).collect())
    assert got == again
    rng, x = np.random.default_rng(5), np.array([s[1:] for s in sums])
    plain = sorted((t := x[rng.integers(0, 3000, 3000)].sum(axis=0))[0] / t[1] for _ in range(1500))
    for q in (0.025, 0.25, 0.5, 0.75, 0.975):
        assert abs(np.quantile(got, q) - np.quantile(plain, q)) < 0.25 * np.std(plain)
    each = Counter()  # how often one cluster comes is binomial too
    mark = df.withColumn("num", (F.col("grupo") == "g7").cast("long")).withColumn("den", F.lit(1).cast("long"))
    for r in metrics.multinomial_replicates(mark, 3000, 1500, 9).collect():
        each[r.num] += 1
    assert abs(sum(k * n for k, n in each.items()) / 1500 - 1) < 0.12 and 0.3 < each[0] / 1500 < 0.44


def test_draws_by_ranges_and_one_by_one_agree(spark):
    df = spark.createDataFrame([(f"g{i}", i % 4, 5) for i in range(400)], "grupo string, num long, den long")
    few, many = metrics.cluster_bootstrap(df, 800).first(), metrics.range_bootstrap(df, 800).first()
    assert (few.numerador, few.denominador, few.valor, few.grupos, few.replicas) == (many.numerador, many.denominador, many.valor, many.grupos, many.replicas)
    width = float(few.superior - few.inferior)
    assert abs(float(few.inferior - many.inferior)) < 0.15 * width and abs(float(few.superior - many.superior)) < 0.15 * width
    one = metrics.range_bootstrap(df.limit(1), 50).first()
    assert (one.inferior, one.replicas, one.grupos) == (None, 0, 1)


def test_splits_are_pruned_and_replaced_by_partition(spark, tmp_path):
    rows = [(f"r{i}", ("teste", "calibracao", "desenvolvimento")[i % 3]) for i in range(300)]
    path = str(tmp_path / "split")
    df = spark.createDataFrame(rows, "row_id string, particao string")
    labels.write_split(df, path)
    labels.write_split(df.filter("particao = 'teste'").limit(10), path)
    one = labels.read_split(spark, path, "teste")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 10 and "PartitionFilters: [isnotnull(particao" in plan or "particao#" in plan.split("PartitionFilters: ")[1][:120]
    assert labels.read_split(spark, path).groupBy("particao").count().count() == 3 and labels.read_split(spark, path, "calibracao").count() == 100


OBS = "chave string, observation_id string, observado_em timestamp, resultado string, artifact_id string"


@pytest.mark.parametrize("cuts", [(), (1,), (9,), (25, 26), (13, 30)])
def test_a_stream_cut_anywhere_ends_alike(spark, tmp_path, cuts):
    """Observations of some keys in any order of arrival, in files that come one run after another."""
    random.seed(4)
    day = lambda d: __import__("datetime").datetime(2024, 1, 1) + __import__("datetime").timedelta(days=d)
    rows = [(random.choice("abc"), f"o{i}", day(random.randrange(90)), random.choice(["OBTIDO"] * 4 + ["FALHOU"]), random.choice(["v1", "v2", "v2", None])) for i in range(40)]
    source, out = str(tmp_path / "in"), str(tmp_path / "run")
    for low, high in zip((0, *cuts), (*cuts, len(rows)), strict=True):
        spark.createDataFrame(rows[low:high], OBS).coalesce(1).write.mode("append").parquet(source)
        got = run.available_now(watch.watch_stream(spark.readStream.schema(OBS).parquet(source)), out)
    want = {}
    for key in "abc":
        before = None
        for _, name, _, result, content in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            ok = result == "OBTIDO" and content is not None
            want[name] = (key, content, "INCONCLUSIVA" if not ok else "NOVA" if before is None else "INALTERADA" if before == content else "CONTEUDO_MUDOU")
            before = content if ok else before
    assert {r.observation_id: (r.chave, r.artifact_id, r.situacao) for r in watch.latest(got).collect()} == want


def test_settled_observations_leave_the_state(spark, tmp_path):
    """What the watermark has passed is folded into the last content; later ones are compared with it."""
    day = lambda d: __import__("datetime").datetime(2024, 1, 1) + __import__("datetime").timedelta(days=d)
    source, out = str(tmp_path / "in"), str(tmp_path / "run")
    for batch in ([("a", "o1", day(0), "OBTIDO", "v1")], [("b", "o2", day(50), "OBTIDO", "v1")], [("b", "o3", day(51), "FALHOU", None)], [("a", "o4", day(60), "OBTIDO", "v1"), ("a", "o5", day(61), "OBTIDO", "v2")]):
        spark.createDataFrame(batch, OBS).coalesce(1).write.mode("append").parquet(source)
        got = run.available_now(watch.watch_stream(spark.readStream.schema(OBS).parquet(source), "5 days"), out)
    assert {r.observation_id: r.situacao for r in watch.latest(got).collect()} == {"o1": "NOVA", "o2": "NOVA", "o3": "INCONCLUSIVA", "o4": "INALTERADA", "o5": "CONTEUDO_MUDOU"}
