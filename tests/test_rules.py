"""Named scenarios of the rule evaluation with answers worked out by hand."""

from datavouch.operators import rules
from pyspark.sql import functions as F

RULE = rules.Rule("R", "FAM", "sig", "PROCESSAMENTO", 0, ("procedimento", "cbo"), ("co_procedimento", "co_ocupacao"), no_leading="APLICABILIDADE_DESCONHECIDA")
RECORD = "row_id string, artifact_id string, instrumento string, procedimento string, cbo string, cnes string, competencia_atendimento string, competencia_processamento string"


def evaluate(spark, records, aux, decided, coverage=(("FAM", "C", "202301", "PROCESSAMENTO", "DISPONIVEL"),), integrity=(("v1", "OK"), ("own", "OK")), rule=RULE):
    r = spark.createDataFrame(list(records), RECORD)
    a = spark.createDataFrame(list(aux), "artifact_id string, dt_competencia string, co_procedimento string, co_ocupacao string")
    d = spark.createDataFrame(list(decided), "fonte string, competencia string, estado string, artifact_ids array<string>")
    c = spark.createDataFrame(list(coverage), "familia_regra string, instrumento string, competencia string, base_temporal string, estado string")
    i = spark.createDataFrame(list(integrity), "artifact_id string, estado string")
    out = rules.evaluate_rule(rule, r, a, d, c, i)
    return {x.row_id: (x.estado, ";".join(x.motivos)) for x in out.collect()}


def rec(row_id, instrumento="C", procedimento="p1", cbo="o1", month="202301", artifact="own"):
    return (row_id, artifact, instrumento, procedimento, cbo, "c1", month, month)


AUX = [("v1", "202301", "p1", "o1"), ("v1", "202301", "p2", None), ("v1", "202301", "p3", "o9"), ("v1", "202301", "p4", "o1")]
SELECTED = [("sig", "202301", "SELECIONADA", ["v1"])]


def test_outcomes(spark):
    got = evaluate(spark, [rec("match"), rec("could", procedimento="p2"), rec("absent", procedimento="p3"), rec("nolead", procedimento="p7"), rec("nocode", cbo=None), rec("noinst", instrumento=None), rec("other", instrumento="Q"), rec("nomonth", month="202302"), rec("null", month=None)], AUX, SELECTED)
    assert got == {
        "match": ("CONFORME", ""),
        "could": ("INCONCLUSIVO", "CAMPO_INSUFICIENTE"),
        "absent": ("VIOLACAO", ""),
        "nolead": ("INCONCLUSIVO", "APLICABILIDADE_DESCONHECIDA"),
        "nocode": ("INCONCLUSIVO", "CAMPO_INSUFICIENTE"),
        "noinst": ("INCONCLUSIVO", "APLICABILIDADE_DESCONHECIDA;CAMPO_INSUFICIENTE"),
        "other": ("NAO_APLICAVEL", ""),
        "nomonth": ("INCONCLUSIVO", "ARQUIVO_AUSENTE"),
        "null": ("INCONCLUSIVO", "VIGENCIA_NAO_RESOLVIDA"),
    }


def test_null_leading_key_could_match(spark):
    got = evaluate(spark, [rec("a", procedimento="p7"), rec("b", procedimento="p7", cbo="o2")], [*AUX, ("v1", "202301", None, "o1")], SELECTED)
    assert got == {"a": ("INCONCLUSIVO", "CAMPO_INSUFICIENTE"), "b": ("INCONCLUSIVO", "APLICABILIDADE_DESCONHECIDA")}


def test_absence_needs_coverage_integrity_and_own_month(spark):
    r = [rec("x", procedimento="p3")]
    assert evaluate(spark, r, AUX, SELECTED, coverage=())["x"] == ("INCONCLUSIVO", "COBERTURA_INSUFICIENTE")
    assert evaluate(spark, r, AUX, SELECTED, integrity=(("v1", "NAO_VERIFICADO"), ("own", "OK")))["x"] == ("INCONCLUSIVO", "COBERTURA_INSUFICIENTE")
    shifted = rules.Rule("R", "FAM", "sig", "PROCESSAMENTO", -1, ("procedimento", "cbo"), ("co_procedimento", "co_ocupacao"), no_leading="APLICABILIDADE_DESCONHECIDA")
    assert evaluate(spark, [rec("x", procedimento="p3", month="202302")], AUX, SELECTED, coverage=[("FAM", "C", "202302", "PROCESSAMENTO", "DISPONIVEL")], rule=shifted)["x"] == ("INCONCLUSIVO", "COBERTURA_INSUFICIENTE")


def test_selection_states_and_quarantine(spark):
    states = {"AUSENTE": "ARQUIVO_AUSENTE", "AMBIGUA": "VERSAO_AMBIGUA", "INCOMPLETA": "COBERTURA_INSUFICIENTE", "EM_QUARENTENA": "ARQUIVO_EM_QUARENTENA", "FORA_DO_CORTE": "FORA_DO_CORTE"}
    decided = [("sig", f"20230{i + 2}", s, ["v1"]) for i, s in enumerate(states)]
    got = evaluate(spark, [rec(s, month=f"20230{i + 2}") for i, s in enumerate(states)], AUX, decided)
    assert got == {s: ("INCONCLUSIVO", w) for s, w in states.items()}
    assert evaluate(spark, [rec("q")], AUX, SELECTED, integrity=(("v1", "OK"), ("own", "QUARENTENA_HASH")))["q"] == ("INCONCLUSIVO", "APLICABILIDADE_DESCONHECIDA;ARQUIVO_EM_QUARENTENA")
    assert evaluate(spark, [rec("e")], [], SELECTED)["e"] == ("INCONCLUSIVO", "COBERTURA_INSUFICIENTE")
    assert evaluate(spark, [rec("d")], [("v1", "202212", "p1", "o1")], SELECTED)["d"] == ("INCONCLUSIVO", "VIGENCIA_NAO_RESOLVIDA")


def test_partition_count_and_repeats_do_not_matter(spark):
    records = [rec(f"r{i}", procedimento=f"p{i % 5}") for i in range(40)]
    once = evaluate(spark, records, AUX, SELECTED)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert evaluate(spark, records[::-1], [*AUX, ("v9", "202301", "p3", "o1")], SELECTED) == once
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_aggregates(spark):
    ev = spark.createDataFrame([("a", "r1", "VIOLACAO"), ("a", "r2", "CONFORME"), ("b", "r1", "CONFORME"), ("b", "r2", "INCONCLUSIVO"), ("c", "r1", "CONFORME"), ("d", "r1", "NAO_APLICAVEL")], "row_id string, rule_id string, estado string")
    assert {r.row_id: r.resultado for r in rules.aggregate_records(ev).collect()} == {"a": "ALERTA", "b": "ABSTENCAO", "c": "SEM_VIOLACAO_VERIFICADA", "d": "ABSTENCAO"}
    assert rules.check_aggregates(rules.aggregate_records(ev), ev).count() == 0
    assert rules.aggregate_records(ev, ev.filter("row_id = 'a'")).count() == 3


def test_decide_state(spark):
    rows = [("NAO_APLICAVEL_DEMONSTRADA", True, None, []), ("DESCONHECIDA", True, False, []), ("APLICAVEL", False, False, []), ("APLICAVEL", True, None, []), ("APLICAVEL", True, False, ["X"]), ("APLICAVEL", True, True, []), ("APLICAVEL", True, False, [])]
    df = spark.createDataFrame(rows, "a string, c boolean, i boolean, m array<string>").coalesce(1)
    got = [r[0] for r in df.select(rules.decide_state(F.col("a"), F.col("c"), F.col("i"), F.col("m"))).collect()]
    assert got == ["NAO_APLICAVEL", "INCONCLUSIVO", "INCONCLUSIVO", "INCONCLUSIVO", "INCONCLUSIVO", "VIOLACAO", "CONFORME"]
