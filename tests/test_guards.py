"""What operators refuse, and answers worked out by hand where a query can't show them."""

import pytest
from datavouch.functions import tables
from datavouch.operators import baseline, changes, coverage, explain, labels, metrics, report, rules, sampling, temporal, values
from datavouch.sources import canonical, fixed_width
from pyspark.sql import functions as F


def test_a_snapshot_key_twice_is_an_error(spark):
    snap = spark.createDataFrame([("sig", "P", "202301", "SELECIONADA", ["a"]), ("sig", "P", "202301", "AMBIGUA", ["b"])], "fonte string, base string, competencia_requerida string, estado string, artifact_ids array<string>")
    need = spark.createDataFrame([("r", "R", "sig", "P", "202301")], "row_id string, rule_id string, fonte string, base string, competencia_requerida string")
    with pytest.raises(ValueError, match="twice"):
        temporal.derive_selections(need, snap)
    assert temporal.derive_selections(need, snap.limit(1)).count() == 1


def test_a_swap_without_effect_is_an_error(spark):
    sel = spark.createDataFrame([("sig", ["a"])], "fonte string, artifact_ids array<string>")
    with pytest.raises(ValueError, match="changes no selection"):
        changes.swap_version(sel, "sig", "x", "y")


def test_rules_refuse_mixed_origins_and_repeats(spark):
    rule = rules.Rule("R", "F", "sig", "PROCESSAMENTO", 0, ("procedimento",), ("co_procedimento",))
    with pytest.raises(ValueError, match="twice"):
        rules.evaluate_rules([rule, rule], None, {}, None, None, None)
    with pytest.raises(ValueError, match="origins"):
        rules.evaluate_rules([rule], None, {}, None, None, None, origins={"real", "synthetic"})


def test_layout_windows():
    old, new = canonical.Layout(("a", "b", "c"), frozenset({"c"}), last="201912"), canonical.Layout(("a", "b", "d"), first="202001")
    assert canonical.match_layout(["a", "b"], "201901", [old, new]) == old
    assert canonical.match_layout(["a", "b", "d"], "202001", [old, new]) == new
    for columns, month in ((["b", "a"], "201901"), (["a"], "201901"), (["a", "b", "x"], "201901"), (["a", "b"], "202001")):
        with pytest.raises(ValueError, match="layout"):
            canonical.match_layout(columns, month, [old, new])
    with pytest.raises(ValueError, match="0 layouts"):
        canonical.match_layout(["a"], "202001", [old])


def test_fixed_width_layouts_are_checked():
    with pytest.raises(ValueError, match="type"):
        fixed_width.check_layout([fixed_width.Field("a", 1, 2, "FLOAT")])
    with pytest.raises(ValueError, match="characters"):
        fixed_width.check_layout([fixed_width.Field("a", 1, 2, declared=3)])


def test_leaks_are_refused(spark):
    train = spark.createDataFrame([("x", 1.0, "t")], "cbo string, pa_valor double, texto string")
    with pytest.raises(ValueError, match="leak"):
        baseline.check_features(train, ["rotulo"], [])
    with pytest.raises(ValueError, match="leak"):
        baseline.check_features(train, [], ["pa_valor"])
    with pytest.raises(TypeError, match="numbers"):
        baseline.check_features(train, [], ["texto"])


def test_youden_with_one_class_and_ties(spark):
    one = spark.createDataFrame([("0.9", 1)], "escore string, rejeitado int").withColumn("escore", F.col("escore").cast("decimal(10,9)"))
    assert float(baseline.youden_table(one).first().limiar) == 0.5
    tie = spark.createDataFrame([("0.9", 1), ("0.5", 0), ("0.4", 1), ("0.3", 0)], "escore string, rejeitado int").withColumn("escore", F.col("escore").cast("decimal(10,9)"))
    assert float(baseline.youden_table(tie).first().limiar) == 0.9


def test_bootstrap_with_few_or_many_clusters(spark, monkeypatch):
    sums = lambda rows: spark.createDataFrame(rows, "grupo string, num long, den long")
    none = metrics.cluster_bootstrap(sums([("a", 1, 2)]), 50).first()
    assert (none.inferior, none.replicas, none.grupos) == (None, 0, 1)
    rows = [(f"g{i:03}", i % 3, 4) for i in range(30)]
    held = metrics.cluster_bootstrap(sums(rows), 50).first()
    monkeypatch.setattr(metrics, "SENT_CLUSTERS", 5)
    assert metrics.cluster_bootstrap(sums(rows[::-1]), 50).first() == held


def test_hot_keys_join_as_others_do(spark, monkeypatch):
    monkeypatch.setattr(tables, "HOT_ROWS", 5)
    monkeypatch.setattr(tables, "SENT_ROWS", 0)
    big = spark.createDataFrame([("h", i) for i in range(40)] + [("a", 1), (None, 2), ("lost", 3)], "k string, v long")
    small = spark.createDataFrame([("h", "x"), ("a", "y")], "k string, w string")
    counts = big.groupBy("k").agg(F.count("*").alias("n"))
    for how, more in (("left", [("lost", 3, None), (None, 2, None)]), ("inner", [])):
        got = tables.split_join(big, small, ["k"], counts, F.xxhash64("v"), how).select("k", "v", "w").collect()
        assert sorted(map(tuple, got), key=str) == sorted([("h", i, "x") for i in range(40)] + [("a", 1, "y")] + more, key=str)


def test_cohort_partitions_and_profile(spark):
    r = spark.createDataFrame([(False, "202301", "350001", True, "C"), (False, "202307", "350001", True, "C"), (False, "202301", "350001", True, "Q")], "deletado boolean, competencia_processamento string, municipio_estabelecimento string, no_territorio boolean, instrumento string")
    order = labels.split_cohort("202301", "202312", ("C",), {"dev": ("202301", "202306")})
    assert [x[0] for x in r.select(labels.cohort_reason(order)).collect()] == [None, "FORA_DAS_PARTICOES", "INSTRUMENTO"]


def test_value_categories(spark):
    rows = [("a", ["R1"], "ALERTA", 10, 5), ("b", ["R2"], "ALERTA", 10, 5), ("c", [], "ABSTENCAO", 10, 5), ("d", [], "X", 1, 5), ("e", ["R1"], "ALERTA", None, 5), ("f", [], "X", 10, 5)]
    df = spark.createDataFrame(rows, "row_id string, violacoes array<string>, resultado string, valor_apresentado int, valor_aprovado int")
    df = values.with_families(df, {"R1": "F1", "R2": "F2"})
    got = {r.row_id: r.c for r in df.select("row_id", values.value_category({"F1": values.MUNICIPAL, "F2": "DESCONHECIDA"}).alias("c")).collect()}
    assert got == {"a": values.IDENTIFIED, "b": values.UNGOVERNED, "c": "ABSTENCAO_ELEGIVEL", "d": "DIFERENCA_NEGATIVA", "e": "CAMPOS_INSUFICIENTES", "f": "SEM_VIOLACAO_VERIFICADA"}


def test_executability_of_months(spark):
    plans = spark.createDataFrame([("202301", ["INCLUIR_CBO"]), ("202312", ["INCLUIR_CBO"]), ("202401", ["INCLUIR_CBO"])], "competencia string, operacoes array<string>")
    known = {"INCLUIR_CBO": (1, "GESTOR_MUNICIPAL", "MUNICIPAL_DOCUMENTADA")}
    states = lambda *a: [r.executabilidade for r in explain.executability(plans, *a).orderBy("competencia").collect()]
    assert states("202401", "202401", known) == ["HIPOTESE_PASSADA", "HIPOTESE_PASSADA", "POTENCIALMENTE_EXECUTAVEL_SOB_CONDICOES"]
    assert states("202401", None, known) == ["HIPOTESE_PASSADA", "INDETERMINADO", "INDETERMINADO"]
    assert states("202401", "201001", known) == ["HIPOTESE_PASSADA", "INDETERMINADO", "INDETERMINADO"]


def test_a_repair_needs_what_it_depends_on(spark):
    pair = "competencia string, cnes string, cbo string"
    wanted = spark.createDataFrame([("202301", "1", "x")], pair)
    pairs = spark.createDataFrame([("202301", "1", "y", 1)], pair + ", n_vinculos int")
    none = spark.createDataFrame([], "competencia string, cnes string")
    plans = explain.repair_plans(explain.repair_candidates(wanted, pairs, none))
    assert sorted(r.custo for r in plans.collect() if "INCLUIR_CBO" in r.operacoes or "RECLASSIFICAR_CBO" in r.operacoes) == [4, 5, 6]
    states = spark.createDataFrame([("202301", "1", "x", "VIOLACAO"), ("202301", "1", "y", "CONFORME")], pair + ", estado string")
    got = {r.plano: (r.resolvidos, r.prejudicados, r.minimo) for r in explain.repair_impact(plans, pairs, states, none).collect()}
    assert got["CADASTRAR_ESTABELECIMENTO:+INCLUIR_CBO:"] == (1, 0, True) and got["CADASTRAR_ESTABELECIMENTO:+RECLASSIFICAR_CBO:y"] == (1, 1, False)


def test_empty_comparisons_are_inconclusive(spark):
    assert changes.overall(spark.createDataFrame([], "situacao string")).first().situacao == "INCONCLUSIVA"
    nothing = spark.createDataFrame([], "situacao string"), spark.createDataFrame([], "janela_incompleta boolean")
    assert changes.watch_verdict(*nothing).first().veredito == "SEM_OBSERVACAO"


def test_report_has_all_tables(spark):
    import inspect

    assert len(inspect.signature(report.observability_report).parameters) == 11
    with pytest.raises(ValueError, match="blinding"):
        sampling.blind_package(None, None, ["row_id"])
    cov = spark.createDataFrame([("F", "C", "202301", "P", "AUSENTE", "sem_producao")], "familia_regra string, instrumento string, competencia string, base_temporal string, estado string, motivo string")
    assert coverage.mark_empty(cov, cov.select("competencia")).first().estado == "INSUFICIENTE"
