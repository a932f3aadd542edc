from pyspark.sql import functions as F

from datavouch.operators import temporal


def test_selections_are_checked_against_their_records(spark):
    records = spark.createDataFrame([("a", "202001", "202003"), ("b", None, "202003"), ("c", "202012", "202101")], "row_id string, competencia_atendimento string, competencia_processamento string")
    sources = spark.createDataFrame([("R1", "x", "ATENDIMENTO", 0, True), ("R2", "y", "PROCESSAMENTO", -1, True), ("R3", "z", "PROCESSAMENTO", 0, False)], "rule_id string, fonte string, base string, deslocamento int, resolvido boolean")
    required = temporal.required_months(records, sources)
    state = F.when(F.col("competencia_requerida").isNull(), "NAO_RESOLVIDA").otherwise("SELECIONADA")
    right = required.withColumn("estado", state)
    assert temporal.check_selections(right, records, sources).isEmpty()
    mine = (F.col("row_id") == "a") & (F.col("rule_id") == "R2")
    other = (F.col("row_id") == "c") & (F.col("rule_id") == "R1")
    open_ = (F.col("row_id") == "b") & (F.col("rule_id") == "R1")
    wrong = right.withColumns({"competencia_requerida": F.when(mine, "202003").otherwise(F.col("competencia_requerida")), "estado": F.when(other, "OUTRO").when(open_, "AUSENTE").otherwise(F.col("estado")), "base": F.when(open_, "PROCESSAMENTO").otherwise(F.col("base"))})
    got = {(r.row_id, r.rule_id, r.estado, r.base, r.r_base, r.r_mes) for r in temporal.check_selections(wrong, records, sources).collect()}
    assert got == {("a", "R2", "SELECIONADA", "PROCESSAMENTO", "PROCESSAMENTO", "202002"), ("c", "R1", "OUTRO", "ATENDIMENTO", "ATENDIMENTO", "202012"), ("b", "R1", "AUSENTE", "PROCESSAMENTO", "ATENDIMENTO", None)}
