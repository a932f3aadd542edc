"""Observability tables over the records of a cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datavouch.functions.months import month_diff


def field_missingness(df: DataFrame, fields: list[str]) -> DataFrame:
    """(campo, faltantes, total), one scan for all fields."""
    g = df.agg(F.count("*").alias("total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in fields])
    return g.select("total", F.explode(F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).alias("faltantes")) for c in fields])).alias("x")).select("x.campo", "x.faltantes", "total")


def dimension_counts(df: DataFrame, dims: list[str]) -> DataFrame:
    """(dimensao, valor, n); null is a value of its own."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimensao"), F.col(d).cast("string").alias("valor")) for d in dims]))
    return df.select(pairs.alias("x")).groupBy("x.dimensao", "x.valor").agg(F.count("*").alias("n"))


def exclusion_counts(df: DataFrame, reason: str = "motivo") -> DataFrame:
    return df.groupBy(F.coalesce(reason, F.lit("INCLUIDO")).alias("motivo")).agg(F.count("*").alias("n"))


def lag_histogram(df: DataFrame) -> DataFrame:
    """Months between service and processing; unknown lags are a class."""
    lag = month_diff(F.col("competencia_processamento"), F.col("competencia_atendimento"))
    return df.groupBy(lag.alias("defasagem")).agg(F.count("*").alias("n"))


def label_distribution(labels: DataFrame) -> DataFrame:
    """Counts before (trimmed raw code) and after (label)."""
    raw = F.struct(F.lit("ANTES").alias("momento"), F.btrim("pa_indica_bruto", F.lit(" ")).alias("valor"))
    done = F.struct(F.lit("DEPOIS").alias("momento"), F.col("rotulo").alias("valor"))
    return labels.select(F.explode(F.array(raw, done)).alias("x")).groupBy("x.momento", "x.valor").agg(F.count("*").alias("n"))


def inconclusive_classes(selections: DataFrame, obs: DataFrame) -> DataFrame:
    """Failed selections refined by what the observations that they cite returned."""
    o = obs.select("observation_id", "resultado")
    sets = selections.filter("estado <> 'SELECIONADA'").select("estado", F.array_join("observation_ids", ";").alias("citadas"), "observation_ids")
    each = sets.select("estado", "citadas", "observation_ids").distinct()
    refined = each.select("estado", "citadas", F.explode_outer("observation_ids").alias("observation_id")).join(o, "observation_id", "left").groupBy("estado", "citadas").agg(F.bool_or(F.col("resultado") == "NAO_ENCONTRADO").alias("nao_encontrado"), F.count("resultado").alias("n_obs"))
    name = F.when(F.col("estado") != "AUSENTE", F.col("estado")).when(F.col("n_obs") == 0, "AUSENTE_SEM_TENTATIVA").when(F.col("nao_encontrado"), "AUSENTE_NAO_ENCONTRADO").otherwise("AUSENTE_SEM_BYTES")
    return sets.join(refined.select("estado", "citadas", name.alias("classe")), ["estado", "citadas"]).groupBy("classe").agg(F.count("*").alias("n"))


def availability(coverage: DataFrame, months: DataFrame, instruments: tuple[str, ...] | None = None) -> DataFrame:
    """Coverage cells by state within the cohort's months and instruments."""
    if instruments is not None:
        coverage = coverage.filter(F.col("instrumento").isin(*instruments))
    return coverage.join(months.select("competencia").distinct(), "competencia", "left_semi").groupBy("familia_regra", "base_temporal", "estado").agg(F.count("*").alias("n"))


def inconclusive_rates(evals: DataFrame, sources: DataFrame) -> DataFrame:
    """(rule_id, fonte, base, numerador, denominador): inconclusive evaluations by rule and by the
    source and month kind that it asks for. ``sources``: (rule_id, fonte, base)."""
    g = evals.groupBy("rule_id").agg(F.count_if(F.col("estado") == "INCONCLUSIVO").alias("numerador"), F.count("*").alias("denominador"))
    return g.join(F.broadcast(sources.select("rule_id", "fonte", "base")), "rule_id").select("rule_id", "fonte", "base", "numerador", "denominador")


def observability_report(cohort: DataFrame, labels: DataFrame, selections: DataFrame, obs: DataFrame, coverage: DataFrame, months: DataFrame, evals: DataFrame, sources: DataFrame, fields: list[str], dims: list[str], instruments: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """All tables of the report by name. ``cohort`` has ``motivo``, null for included rows."""
    inside = cohort.filter("motivo is null")
    return {
        "ausencias": field_missingness(inside, fields),
        "dimensoes": dimension_counts(inside, dims),
        "exclusoes": exclusion_counts(cohort),
        "defasagens": lag_histogram(inside),
        "rotulos": label_distribution(labels),
        "inconclusivas": inconclusive_classes(selections, obs),
        "disponibilidade": availability(coverage, months, instruments),
        "metricas": report_metrics(cohort, fields),
        "taxas": inconclusive_rates(evals, sources),
    }


def report_metrics(df: DataFrame, fields: list[str], reason: str = "motivo") -> DataFrame:
    """(metrica, numerador, denominador): share of included rows, and of missing values among them."""
    inc = F.col(reason).isNull()
    g = df.agg(F.count("*").alias("todas"), F.count_if(inc).alias("incluidas"), *[F.count_if(inc & F.col(c).isNull()).alias(f"f_{c}") for c in fields])
    rows = [F.struct(F.lit("fracao_incluida").alias("metrica"), F.col("incluidas").alias("numerador"), F.col("todas").alias("denominador"))]
    rows += [F.struct(F.lit(f"ausencia.{c}").alias("metrica"), F.col(f"f_{c}").alias("numerador"), F.col("incluidas").alias("denominador")) for c in fields]
    return g.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
