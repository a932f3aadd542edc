from decimal import Decimal

import pytest
from datavouch.functions import identity, months, text
from datavouch.operators import baseline, changes, metrics, normalize, sampling, temporal
from datavouch.sources import canonical, dbf, fixed_width, observations
from pyspark.sql import functions as F
from pyspark.sql import types as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def test_months(spark):
    assert one(spark, months.month_shift(F.col("m"), 1), m="202312") == "202401"
    assert one(spark, months.month_shift(F.col("m"), -13), m="202301") == "202112"
    assert one(spark, months.month_shift(F.col("m"), 1), m="202313") is None
    assert one(spark, months.month_diff(F.col("a"), F.col("b")), a="202402", b="202311") == 3


def test_full_match_is_not_find(spark):
    assert one(spark, text.full_match(F.col("c"), "[C]"), c="C\n") is False


def test_normalize_field(spark):
    df = spark.createDataFrame([(" 12 ",), ("",), ("  ",), ("99",), ("x",), (None,), ("\t12",)], "raw string").coalesce(1)
    value, _, reason = text.normalize_field(F.col("raw"), "[0-9]{2}", {"99": "IGNORADO"}, "int")
    assert [(r.v, r.w) for r in df.select(value.alias("v"), reason.alias("w")).collect()] == [(12, None), (None, "VAZIO"), (None, "VAZIO"), (None, "IGNORADO"), (None, "CODIFICACAO_INVALIDA"), (None, "VAZIO"), (None, "CODIFICACAO_INVALIDA")]


def test_implied_decimal(spark):
    assert one(spark, text.implied_decimal(F.col("c"), 2, 20), c="12345") == Decimal("123.45")
    assert one(spark, text.implied_decimal(F.col("c"), 2, 20), c="7") == Decimal("0.07")
    assert one(spark, text.implied_decimal(F.col("c"), 2, 20), c="1.5") is None


def test_fingerprint(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("a", 1)], "x string, y long")
    same = identity.logical_hash(df.repartition(3).orderBy("x"))
    assert identity.logical_hash(df) == same
    assert identity.logical_hash(df.distinct()) != same
    with pytest.raises(TypeError):
        identity.logical_hash(df.withColumn("z", F.lit(1.5)))


def test_intervals_a_b_a(spark):
    rows = [("s", "m", "p", i, f"o{i}", "OBTIDO" if a else "NAO_ENCONTRADO", a) for i, a in enumerate(["A", "A", "B", "A", None, "A"])]
    obs = spark.createDataFrame(rows, "fonte string, competencia string, parte string, observado_em int, observation_id string, resultado string, artifact_id string")
    got = sorted((r.inicio, r.fim, r.artifact_id) for r in temporal.observed_intervals(obs).collect())
    assert got == [(0, 1, "A"), (2, 2, "B"), (3, 3, "A"), (5, 5, "A")]


def test_parts(spark):
    obs = spark.createDataFrame([("s", "1", "a", "x", "o1", "OBTIDO", 1), ("s", "1", "b", "y", "o2", "OBTIDO", 1), ("s", "2", "a", "z", "o3", "OBTIDO", 1), ("s", "3", "c", "w", "o4", "OBTIDO", 1), ("t", "1", None, "q", "o5", "OBTIDO", 1), ("t", "2", None, "bad", "o6", "OBTIDO", 1), ("t", "3", None, None, "o7", "NAO_ENCONTRADO", 1), ("t", "4", None, "late", "o8", "OBTIDO", 9), ("t", "5", None, "q", "o9", "OBTIDO", 1), ("t", "5", None, "q2", "p1", "OBTIDO", 1)], "fonte string, competencia string, parte string, artifact_id string, observation_id string, resultado string, observado_em int")
    versions = spark.createDataFrame([(x, "OK") for x in ("x", "y", "z", "w", "q", "q2", "late")] + [("bad", "QUARENTENA_X")], "artifact_id string, estado string")
    expected = spark.createDataFrame([("s", str(m), p) for m in (1, 2, 3) for p in "ab"], "fonte string, competencia string, parte string")
    got = {(r.fonte, r.competencia): r.estado for r in temporal.combine_parts(temporal.resolve_parts(obs, versions, F.lit(5)), expected).collect()}
    assert got == {("s", "1"): "SELECIONADA", ("s", "2"): "INCOMPLETA", ("s", "3"): "INCOMPLETA", ("t", "1"): "SELECIONADA", ("t", "2"): "EM_QUARENTENA", ("t", "3"): "AUSENTE", ("t", "4"): "FORA_DO_CORTE", ("t", "5"): "AMBIGUA"}


def test_metric_values(spark):
    df = spark.createDataFrame([(1, 3), (6, 8), (1, 0)], "n long, d long").coalesce(1)
    assert [r[0] for r in df.select(metrics.ratio("n", "d")).collect()] == [Decimal("0.333333"), Decimal("0.750000"), None]


def test_bootstrap_does_not_depend_on_partitions(spark):
    sums = spark.createDataFrame([(f"g{i}", i % 3, 3) for i in range(12)], "grupo string, num long, den long")
    a, b = (metrics.cluster_bootstrap(sums.repartition(n), 50).first() for n in (1, 5))
    assert a == b and a.replicas == 50 and a.inferior <= float(a.valor) <= a.superior
    assert metrics.cluster_bootstrap(sums.limit(1), 50).first().inferior is None


def test_allocation_is_exact(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 500), ("d", 497)], "estrato string, n long")
    rows = sampling.allocate(counts, 20).collect()
    assert sum(r.alocado for r in rows) == 20 and all(r.alocado >= 1 for r in rows)
    assert sum(r.alocado for r in sampling.allocate(counts, 5000).collect()) == 1000


def test_multiset_difference_keeps_counts(spark):
    a = spark.createDataFrame([("x", None), ("x", None), ("y", 1)], "k string, v int")
    b = spark.createDataFrame([("x", None), ("y", 1), ("z", 2)], "k string, v int")
    assert sorted((r.k, r.saldo) for r in changes.multiset_difference(a, b, ["k", "v"]).collect()) == [("x", -1), ("z", 1)]


def test_canonical_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "x string, n int")
    schema = T.StructType([T.StructField("x", T.StringType()), T.StructField("n", T.LongType())])
    said = canonical.write_dataset(df, str(tmp_path / "t"), "t.v1")
    assert said["rows"] == 2
    assert canonical.conform(spark.read.parquet(str(tmp_path / "t")), schema).count() == 2
    with pytest.raises(ValueError):
        canonical.conform(df.withColumn("extra", F.lit(1)), schema)
    with pytest.raises(Exception, match="exist"):
        canonical.write_dataset(df, str(tmp_path / "t"), "t.v1")


def test_fixed_width_file(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes("01 \xe9A\r\n02bcD\r\n03x\r\n".encode("latin-1"))
    rows = fixed_width.read_fixed_width(spark, str(tmp_path / "f.txt"), [fixed_width.Field("n", 1, 2), fixed_width.Field("t", 3, 4), fixed_width.Field("c", 5, 5)]).collect()
    assert [(r.n, r.t, r.c, r.problema) for r in rows] == [("01", " é", "A", None), ("02", "bc", "D", None), ("03", "x", "", "LARGURA")]
    with pytest.raises(ValueError):
        fixed_width.check_layout([fixed_width.Field("n", 2, 3)])


def test_dbf(spark, tmp_path):
    import struct

    fields = [("CNES", 7), ("CBO", 6)]
    head = struct.pack("<BBBBIHH20x", 3, 24, 1, 1, 3, 32 + 32 * 2 + 1, 14) + b"".join(struct.pack("<11sc4xB15x", n.encode(), b"C", s) for n, s in fields) + b"\r"
    (tmp_path / "a.dbf").write_bytes(head + b" 0000001223505" + b"*0000002225125" + b" 00000\xe93      ")
    rows = dbf.read_dbf(spark, str(tmp_path / "a.dbf"), ["cnes", "cbo", "falta"]).orderBy("indice").collect()
    assert [(r.indice, r.deletado, r.cnes, r.cbo, r.falta) for r in rows] == [(0, False, "0000001", "223505", None), (1, True, "0000002", "225125", None), (2, False, "00000é3", "      ", None)]


def test_log_issues(spark):
    rows = [(1, None, "h1", "VERSAO", None, "v"), (2, "h1", "h2", "OBSERVACAO", "o1", "v"), (3, "hx", "h3", "OBSERVACAO", "o1", "w"), (5, "h4", "h5", "OBSERVACAO", "o2", None)]
    log = spark.createDataFrame(rows, "seq long, anterior string, hash string, tipo string, observation_id string, artifact_id string")
    assert sorted(map(tuple, observations.check_log(log).collect())) == [(3, "ELO_QUEBRADO"), (3, "OBSERVACAO_REPETIDA"), (3, "VERSAO_DESCONHECIDA"), (5, "LACUNA")]


def test_leak_guard(spark):
    df = spark.createDataFrame([("a", 1, 1.0)], "instrumento string, rotulo int, x double")
    with pytest.raises(ValueError, match="leak"):
        baseline.fit_encoder(df, ["rotulo"], [])
    with pytest.raises(TypeError):
        baseline.fit_encoder(df, [], ["instrumento"])


def test_checks_on_empty_tables(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert normalize.check_key(df, ["a"]).count() == 0
    assert normalize.multiplicity(df, []).first().linhas == 0
    assert {r.coluna: r.nulos for r in normalize.check_not_null(df, ["a", "c"]).collect()} == {"a": 0, "c": -1}
