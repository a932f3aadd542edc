"""Coverage matrix: where reference data suffice to prove an absence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datavouch.functions.tables import written

_KEY = ["familia_regra", "instrumento", "competencia", "base_temporal"]


def available_months(aux: DataFrame, month_column: str, fields: tuple[str, ...], lossy: DataFrame | None = None, code: str | None = None) -> DataFrame:
    """(competencia[, codigo]): months with usable rows, without those that lost rows."""
    whole = aux.dropna(subset=[month_column, *fields])
    out = whole.select(F.col(month_column).alias("competencia"), *([F.col(code).alias("codigo")] if code else [])).distinct()
    return out if lossy is None else out.join(lossy.select("competencia").distinct(), "competencia", "left_anti")


def build_coverage(records: DataFrame, available: DataFrame, families: DataFrame, months: DataFrame, bases: DataFrame) -> DataFrame:
    """The complete grid family x instrument x month x base with its state.

    ``families``: (familia_regra, instrumento); ``available``: (familia_regra, instrumento,
    competencia). Needed months are the cell's own (PROCESSAMENTO) or the service months of its live
    records. All available: DISPONIVEL; none, or no production at all in the month: AUSENTE; else
    INSUFICIENTE, as where a service month is null or the instrument has no records."""
    live = records.filter(~F.col("deletado") & F.col("competencia_processamento").isNotNull())
    cells = written(live.groupBy("instrumento", F.col("competencia_processamento").alias("competencia")).agg(F.array_sort(F.collect_set("competencia_atendimento")).alias("atendimentos"), F.count_if(F.col("competencia_atendimento").isNull()).alias("nulos")), "cells")
    produced = cells.select("competencia").distinct().withColumn("produzida", F.lit(True))
    groups = cells.filter("instrumento is not null")
    have = available.groupBy("familia_regra", "instrumento").agg(F.collect_set("competencia").alias("disponiveis"))
    grid = families.crossJoin(F.broadcast(months)).crossJoin(F.broadcast(bases))
    g = grid.join(produced, "competencia", "left").join(groups, ["instrumento", "competencia"], "left").join(have, ["familia_regra", "instrumento"], "left")
    needed = F.when(F.col("base_temporal") == "PROCESSAMENTO", F.array("competencia")).otherwise(F.col("atendimentos"))
    g = g.withColumn("necessarias", needed).withColumn("faltam", F.array_except("necessarias", F.coalesce("disponiveis", F.array().cast("array<string>"))))
    state = (
        F.when(F.col("produzida").isNull(), "AUSENTE")
        .when(F.col("nulos").isNull() | (F.col("base_temporal") != "PROCESSAMENTO") & (F.col("nulos") > 0), "INSUFICIENTE")
        .when(F.size("faltam") == 0, "DISPONIVEL")
        .when(F.size("faltam") == F.size("necessarias"), "AUSENTE")
        .otherwise("INSUFICIENTE")
    )
    why = F.when(state != "DISPONIVEL", F.when(F.col("produzida").isNull(), "sem_producao").when(F.col("nulos").isNull(), "sem_registros").when((F.col("base_temporal") != "PROCESSAMENTO") & (F.col("nulos") > 0), "atendimento_nulo").otherwise(F.concat(F.lit("faltam="), F.array_join(F.array_sort("faltam"), ","))))
    return g.select(*_KEY, state.alias("estado"), why.alias("motivo"))


def mark_incomplete(coverage: DataFrame, marks: DataFrame) -> DataFrame:
    """Incomplete months (competencia, marca) never are DISPONIVEL; their reason starts with the mark."""
    j = coverage.join(marks.groupBy("competencia").agg(F.min("marca").alias("marca")), "competencia", "left")
    return j.select(*_KEY, F.when(F.col("marca").isNotNull() & (F.col("estado") == "DISPONIVEL"), "INSUFICIENTE").otherwise(F.col("estado")).alias("estado"), F.when(F.col("marca").isNotNull(), F.concat_ws(" ", F.concat(F.lit("incompleta="), "marca"), "motivo")).otherwise(F.col("motivo")).alias("motivo"))


def mark_empty(coverage: DataFrame, present: DataFrame) -> DataFrame:
    """Months whose source is there (``present``: competencia) although the population has none of
    their records are a limit of the population, not an absence."""
    j = coverage.join(present.select("competencia").distinct().withColumn("presente", F.lit(True)), "competencia", "left")
    empty = F.coalesce(F.col("presente"), F.lit(False)) & F.col("motivo").eqNullSafe(F.lit("sem_producao"))
    return j.select(*_KEY, F.when(empty, "INSUFICIENTE").otherwise(F.col("estado")).alias("estado"), F.when(empty, "populacao_vazia").otherwise(F.col("motivo")).alias("motivo"))


def recompute_coverage(old: DataFrame, records: DataFrame, available: DataFrame, families: DataFrame, months: DataFrame, bases: DataFrame, present: DataFrame) -> DataFrame:
    """The matrix of a cut population, with the marks of the ``old`` one and its empty months marked."""
    return mark_incomplete(mark_empty(build_coverage(records, available, families, months, bases), present), read_marks(old))


def incompleteness(parts: DataFrame, expected: DataFrame, failed: DataFrame) -> DataFrame:
    """(fonte, competencia, marca): months of a source whose files aren't whole, and why, the first
    that holds. ``parts`` as ``resolve_parts`` makes it; ``expected``: the declared parts; ``failed``:
    versions (artifact_id) that could not be normalized."""
    bad = failed.select("artifact_id").distinct().withColumn("falhou", F.lit(True))
    broken = parts.filter("estado = 'SELECIONADA'").select("fonte", "competencia", F.explode("artifact_ids").alias("artifact_id")).join(bad, "artifact_id").select("fonte", "competencia", "falhou").distinct()
    has = lambda *s: F.bool_or(F.col("estado").isin(*s))
    months = parts.groupBy("fonte", "competencia").agg(has("AMBIGUA").alias("dupla"), has("EM_QUARENTENA", "FORA_DO_CORTE").alias("ruim"), has("AUSENTE").alias("sem"), F.array_sort(F.collect_set("parte")).alias("partes"))
    declared = expected.groupBy("fonte", "competencia").agg(F.array_sort(F.collect_set("parte")).alias("esperadas"))
    j = months.join(declared, ["fonte", "competencia"], "left").join(broken, ["fonte", "competencia"], "left")
    mark = (
        F.when(F.col("dupla"), "republicada").when(F.col("ruim"), "sem_versao_integra").when(F.col("sem"), "nunca_obtida").when(F.col("falhou"), "nao_normalizada")
        .when(F.col("esperadas").isNull() & (F.size("partes") > 0), "partes_nao_declaradas").when(F.size(F.array_except("esperadas", "partes")) > 0, "parte_ausente").when(F.size(F.array_except("partes", "esperadas")) > 0, "parte_nao_declarada")
    )
    return j.select("fonte", "competencia", mark.alias("marca")).filter("marca is not null")


def read_marks(coverage: DataFrame) -> DataFrame:
    """The marks that ``mark_incomplete`` wrote."""
    mark = F.regexp_extract("motivo", r"\Aincompleta=(\S+)", 1)
    return coverage.select("competencia", mark.alias("marca")).filter("marca <> ''").distinct()


def incomplete_months(bad_files: DataFrame, records: DataFrame) -> DataFrame:
    """(competencia, marca): months of incomplete files, (competencia, artifact_id, marca), and the
    processing months found in their rows; a month's own mark wins."""
    own = bad_files.groupBy("competencia").agg(F.min("marca").alias("direta"))
    spread = records.select("artifact_id", F.col("competencia_processamento").alias("competencia")).distinct().join(bad_files.select("artifact_id", "marca"), "artifact_id").groupBy("competencia").agg(F.min("marca").alias("vinda"))
    return own.join(spread, "competencia", "full").select("competencia", F.coalesce("direta", "vinda").alias("marca"))


def month_mismatch(records: DataFrame) -> DataFrame:
    """Live rows whose processing month isn't the month in their file's id, by file."""
    month = F.regexp_extract("artifact_id", r"_([0-9]{6})", 1)
    return records.filter(~F.col("deletado")).groupBy("artifact_id").agg(F.count_if(~F.col("competencia_processamento").eqNullSafe(month)).alias("n_divergentes"), F.count("*").alias("n_linhas"))


def admit_versions(versions: DataFrame, allowed: list[str], cutoff_artifacts: DataFrame, region: str | None = None) -> DataFrame:
    """Versions with the reason why they are left out, null if admitted. With ``region``, those of
    another region (``uf``) are out; national ones (null) are admitted everywhere."""
    seen = cutoff_artifacts.select("artifact_id").distinct().withColumn("visto", F.lit(True))
    j = versions.join(seen, "artifact_id", "left")
    why = F.when(~F.col("fonte").isin(allowed), "FAMILIA_FORA")
    if region is not None:
        why = why.when(F.col("uf").isNotNull() & (F.col("uf") != region), "REGIAO_FORA")
    why = why.when(F.col("visto").isNull(), "FORA_DO_CORTE")
    return j.select("artifact_id", "fonte", why.alias("motivo"))
