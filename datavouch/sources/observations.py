"""The observation log: JSON lines, checked without a global order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "seq long, anterior string, hash string, tipo string, observation_id string, fonte string, competencia string, parte string, observado_em timestamp, resultado string, artifact_id string, estado string"


def check_log(log: DataFrame) -> DataFrame:
    """(seq, problema): gaps, broken hash links, repeated ids, observations of unknown versions."""
    before = log.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("hash_anterior"), F.lit(True).alias("tem_anterior"))
    first = log.agg(F.min("seq").alias("primeiro"))
    linked = log.join(before, "seq", "left").crossJoin(F.broadcast(first))
    why = F.when((F.col("seq") != F.col("primeiro")) & F.col("tem_anterior").isNull(), "LACUNA").when(F.col("tem_anterior") & ~F.col("anterior").eqNullSafe(F.col("hash_anterior")), "ELO_QUEBRADO")
    chain = linked.withColumn("problema", why).filter("problema is not null").select("seq", "problema")
    seen = log.filter("tipo = 'OBSERVACAO'")
    twice = seen.groupBy("observation_id").agg(F.count("*").alias("n"), F.max("seq").alias("seq")).filter("n > 1").select("seq", F.lit("OBSERVACAO_REPETIDA").alias("problema"))
    versions = log.filter("tipo = 'VERSAO'").select("artifact_id").distinct()
    dangling = seen.filter("artifact_id is not null").join(versions, "artifact_id", "left_anti").select("seq", F.lit("VERSAO_DESCONHECIDA").alias("problema"))
    return chain.unionByName(twice).unionByName(dangling)


def load_observation_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(versions, observations, issues)."""
    log = spark.read.schema(SCHEMA).json(path)
    versions = log.filter("tipo = 'VERSAO'").select("artifact_id", "estado")
    obs = log.filter("tipo = 'OBSERVACAO'").select("observation_id", "fonte", "competencia", "parte", "observado_em", "resultado", "artifact_id")
    return versions, obs, check_log(log)
