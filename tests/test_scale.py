"""Plans that must not change with the size of the tables."""

from pyspark.sql import functions as F

from datavouch.functions import tables
from datavouch.plans.core import shared_flow

LIMIT = "spark.sql.autoBroadcastJoinThreshold"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_are_not_sent_by_their_size_on_disk(spark, tmp_path):
    """Codes take a few bytes in a file and fifty times as many in the driver."""
    before = spark.conf.get(LIMIT)
    try:
        spark.conf.set(LIMIT, "10m")
        shared_flow(spark, str(tmp_path))
        few = tables.written(spark.range(400_000).select(F.xxhash64("id").alias("k"), F.lit("abc").alias("v")))
        many = spark.range(10).select(F.xxhash64("id").alias("k"), "id").repartition(2)
        joined = many.join(few, "k", "left")
        assert "BroadcastHashJoin" not in _plan(joined) and joined.filter("v = 'abc'").count() == 10
        assert "BroadcastHashJoin" in _plan(many.join(tables.sent(few.filter("k > 0").limit(5)), "k", "left"))
        for given, kept in (("1k", "1k"), ("-1", "-1"), ("10485760b", str(tables.SENT_BYTES))):
            spark.conf.set(LIMIT, given)
            tables.bound_broadcasts(spark)
            assert spark.conf.get(LIMIT) == kept
    finally:
        spark.conf.set(LIMIT, before)


def test_evaluations_are_not_stored_and_only_rules_of_many_keys_are_shuffled(spark, monkeypatch):
    from datavouch.operators import rules
    from datavouch.plans import core, queries

    stored = []
    monkeypatch.setattr(core, "written", lambda df, what="": stored.append(set(df.columns)) or tables.written(df, what))
    flow = core.Flow(spark, "/root/testdata/sf0.001")
    sent = queries._r10(flow).collect()
    assert not any({"row_id", "motivos"} <= c for c in stored)
    monkeypatch.setattr(rules, "SENT_ROWS", 700)
    split = core.Flow(spark, "/root/testdata/sf0.001")
    assert "Union" in _plan(split.evaluations)
    assert sorted(queries._r10(split).collect()) == sorted(sent)
    listed = rules.aggregate_records(split.evaluations)
    assert split.aggregates.exceptAll(listed).isEmpty() and split.aggregates.count() == 6000


def test_outcomes_of_methods_move_a_record_once(spark):
    """Every method is a part of the rules, so one evaluation serves all, grouped by record alone."""
    from datavouch.operators import metrics, rules
    from datavouch.plans import core

    flow = core.Flow(spark, "/root/testdata/sf0.001")
    ids = [r.rule_id for r in core.RULES]
    each = {"regras": flow.aggregates, "par": rules.aggregate_records(flow.one_rule(0), known=ids[:1])}
    expected = metrics.method_outcomes(each).select("metodo", "row_id", "situacao", "vezes").collect()
    assert sorted(flow.outcomes.select("metodo", "row_id", "situacao", "vezes").collect()) == sorted(expected)
    plan = _plan(flow.outcomes)
    assert plan.count("hashpartitioning(row_id") == 1 and "hashpartitioning(metodo" not in plan


def test_coverage_of_results_counts_rows_of_any_method(spark):
    from datavouch.operators import metrics

    population = spark.createDataFrame([("a",), ("b",), ("c",)], "row_id string")
    given = [("m", "a", "ALERTA", 1), ("m", "x", "ALERTA", 2), ("n", "a", "SEM_ALERTA", 3), ("other", "b", "ALERTA", 1)]
    out = metrics.result_coverage(population, spark.createDataFrame(given, "metodo string, row_id string, situacao string, vezes long"), ["m", "n"])
    assert sorted(map(tuple, out.collect())) == [("m", 2, 1, 1), ("n", 2, 0, 1), ("other", 0, 1, 0)]


def test_generated_methods_of_the_evaluation_are_compiled(spark, monkeypatch):
    """The virtual machine only interprets methods of over 8000 bytes."""
    import re

    from datavouch.operators import rules
    from datavouch.plans import core

    monkeypatch.setattr(rules, "SENT_ROWS", 700)
    states = core.Flow(spark, "/root/testdata/sf0.001").evaluations.groupBy("estado", "aplicabilidade").count()
    states.collect()
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", states._jdf.queryExecution().explainString(mode))]
    assert sizes and max(sizes) < 8000


def test_a_file_of_many_splits_is_not_dealt_out(spark, tmp_path):
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    spark.range(1000).coalesce(1).write.parquet(one)
    spark.range(300_000).coalesce(1).write.option("parquet.block.size", 65536).option("parquet.block.size.row.check.min", 100).parquet(many)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        few, rest = spark.read.parquet(one), spark.read.parquet(many)
        assert tables.spread(rest, "id") is rest and tables.spread(few, "id") is not few
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_scopes_are_numbers_and_only_read_columns_of_records_are_stored(spark, monkeypatch):
    from datavouch.operators import rules
    from datavouch.plans import core

    kept, stored = {}, []
    monkeypatch.setattr(rules, "written", lambda df, what="": kept.setdefault(what, dict(df.dtypes)) and tables.written(df, what))
    monkeypatch.setattr(core, "written", lambda df, what="": stored.append(set(df.columns)) or tables.written(df, what))
    flow = core.Flow(spark, "/root/testdata/sf0.001")
    assert flow.evaluations.count() == 24_000
    assert kept["keys"]["escopo"] == kept["months"]["escopo"] == "bigint"
    assert not any({"row_id", "valor_apresentado"} <= c or {"l_orderkey", "h"} <= c for c in stored)


def test_a_table_in_half_as_many_splits_as_cores_is_not_dealt_out(spark):
    half, few = spark.range(1000).repartition(2), spark.range(1000).coalesce(1)  # of four cores
    assert tables.spread(half, "id") is half and tables.spread(few, "id") is not few


def test_bundles_move_only_what_the_checks_need(spark):
    from datavouch.operators import explain

    row = lambda i, ev, state, cover: (i, "r", ev, state, "SELECIONADA", "OK", cover, "file", ["v"])
    given = [row("a", None, "INCONCLUSIVO", "DISPONIVEL"), row("b", None, "VIOLACAO", "DISPONIVEL"), row("c", "odd", "CONFORME", "DISPONIVEL"), row("d", "e1", "VIOLACAO", "INSUFICIENTE"), row("e", "e1", "VIOLACAO", "DISPONIVEL"), row("f", "e2", "CONFORME", None), row("g", "e1", "VIOLACAO", None)]
    evals = spark.createDataFrame(given, "row_id string, rule_id string, ev_id string, estado string, sel_estado string, integridade string, cobertura string, artifact_id string, sel_artefatos array<string>")
    known = spark.createDataFrame([("e1", "AUSENCIA_NA_FONTE", "v"), ("e2", "VINCULO_ENCONTRADO", "v;w")], "ev_id string, tipo string, artifact_ids string")
    out = explain.check_bundles(evals, known)
    assert {(r.row_id, r.problema) for r in out.collect()} == {("b", "AUSENCIA_NAO_UTILIZAVEL"), ("c", "EVIDENCIA_INEXISTENTE"), ("d", "AUSENCIA_NAO_UTILIZAVEL"), ("f", "ARTEFATO_NAO_SELECIONADO"), ("g", "AUSENCIA_NAO_UTILIZAVEL")}
    joined = out._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
    assert "usavel" in joined
