"""Outcome labels, stratified profiles, cohort exclusions and splits by time."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datavouch.functions.text import present

# The codebook of the label field.
CODEBOOK = {"0": "NAO_APROVADO", "5": "APROVADO_TOTAL", "6": "APROVADO_PARCIAL"}
# End of the fixed values.


def label(raw: Column, codebook: Mapping[str, str] = CODEBOOK) -> Column:
    """The label of a trimmed code, DESCONHECIDO for any other."""
    out = F.lit("DESCONHECIDO")
    for code, name in codebook.items():
        out = F.when(F.btrim(raw, F.lit(" ")) == code, name).otherwise(out)
    return out


def contradictions(name: Column | str = "rotulo") -> Column:
    """Sorted array of contradictions between the label and the amounts; nulls never contradict."""
    r = F.col(name) if isinstance(name, str) else name
    qa, qp, va, vp = (F.col(c) for c in ("quantidade_apresentada", "quantidade_aprovada", "valor_apresentado", "valor_aprovado"))
    rejected, whole, part = r == "NAO_APROVADO", r == "APROVADO_TOTAL", r == "APROVADO_PARCIAL"
    # The closed list of contradictions.
    checks = {
        "APROVADO_PARCIAL_SEM_REDUCAO": part & (qp == qa) & (vp == va),
        "APROVADO_SEM_QUANTIDADE_APROVADA": (whole | part) & (qp == 0),
        "APROVADO_TOTAL_COM_QUANTIDADE_DIVERGENTE": whole & (qp != qa),
        "APROVADO_TOTAL_COM_VALOR_DIVERGENTE": whole & (vp != va),
        "NAO_APROVADO_COM_QUANTIDADE_APROVADA": rejected & (qp > 0),
        "NAO_APROVADO_COM_VALOR_APROVADO": rejected & (vp > 0),
        "QUANTIDADE_APROVADA_MAIOR_QUE_APRESENTADA": qp > qa,
        "VALOR_APROVADO_MAIOR_QUE_APRESENTADO": vp > va,
    }
    # End of the fixed values.
    return present(*[F.when(c, n) for n, c in checks.items()])


def label_records(records: DataFrame) -> DataFrame:
    """Label and contradictions of each record; the raw code is kept."""
    cols = ("row_id", "pa_indica_bruto", "rotulo", "quantidade_apresentada", "quantidade_aprovada", "valor_apresentado", "valor_aprovado")
    return records.withColumn("rotulo", label(F.col("pa_indica_bruto"))).select(*cols, contradictions().alias("contradicoes"))


def profile(records: DataFrame, dims: list[str]) -> DataFrame:
    """Rows, deleted rows and rows of each label by every value of every dimension, in one pass."""
    marked = records.withColumn("rotulo", label(F.col("pa_indica_bruto")))
    grouped = marked.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims])
    sums = [F.count("*").alias("linhas"), F.count_if("deletado").alias("deletadas"), *[F.count_if(F.col("rotulo") == n).alias(n.lower()) for n in [*CODEBOOK.values(), "DESCONHECIDO"]]]
    out = grouped.agg(F.grouping_id().alias("gid"), *sums)
    n = len(dims)
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        hit = F.col("gid") == (2**n - 1) - 2 ** (n - 1 - i)
        which, value = F.when(hit, d).otherwise(which), F.when(hit, F.col(d).cast("string")).otherwise(value)
    return out.select(which.alias("dimensao"), value.alias("valor"), "linhas", "deletadas", *[n.lower() for n in [*CODEBOOK.values(), "DESCONHECIDO"]])


def cohort_reason(order: list[tuple[str, Column]]) -> Column:
    """The first reason whose condition holds; null for included rows."""
    out = F.when(F.coalesce(order[0][1], F.lit(False)), order[0][0])
    for name, condition in order[1:]:
        out = out.when(F.coalesce(condition, F.lit(False)), name)
    return out


def in_territory(records: DataFrame, places: DataFrame) -> DataFrame:
    """``records`` with ``no_territorio``: whether their municipality is one of ``places`` (codigo)."""
    known = places.select(F.substring("codigo", 1, 6).alias("municipio_estabelecimento")).distinct().withColumn("no_territorio", F.lit(True))
    return records.join(known, "municipio_estabelecimento", "left").withColumn("no_territorio", F.coalesce("no_territorio", F.lit(False)))


def split_cohort(first: str, last: str, instruments: tuple[str, ...] | None = None, spec: Mapping[str, tuple[str, str]] | None = None) -> list[tuple[str, Column]]:
    """The order of exclusions of the split by time, of records marked by ``in_territory``."""
    month, order = F.col("competencia_processamento"), _cohort_start(first, last)
    order.append(("INSTRUMENTO", F.col("instrumento").isNull() if instruments is None else F.col("instrumento").isNull() | ~F.col("instrumento").isin(*instruments)))
    if spec:
        inside = F.lit(False)
        for a, b in spec.values():
            inside = inside | month.between(a, b)
        order.append(("FORA_DAS_PARTICOES", ~inside))
    return order


def report_cohort(first: str, last: str, instruments: tuple[str, ...]) -> list[tuple[str, Column]]:
    """The order of the report: rows of concurrent versions (``concorrente``) go first, months late."""
    known = dict(_cohort_start(first, last))
    names = ("DELETADO", "SEM_MUNICIPIO", "FORA_DO_TERRITORIO", "SEM_COMPETENCIA", "FORA_DO_PERIODO")
    return [("VERSOES_CONCORRENTES", F.col("concorrente")), *[(n, known[n]) for n in names], ("INSTRUMENTO", F.col("instrumento").isNull() | ~F.col("instrumento").isin(*instruments))]


def crop_cohort(months: list[str]) -> list[tuple[str, Column]]:
    """The order of a validation's crop to some months."""
    known = dict(_cohort_start("", ""))
    names = ("DELETADO", "SEM_COMPETENCIA", "FORA_DO_PERIODO", "SEM_MUNICIPIO", "FORA_DO_TERRITORIO")
    return [(n, ~F.col("competencia_processamento").isin(months) if n == "FORA_DO_PERIODO" else known[n]) for n in names]


def _cohort_start(first: str, last: str) -> list[tuple[str, Column]]:
    month = F.col("competencia_processamento")
    return [
        ("DELETADO", F.col("deletado")),
        ("SEM_COMPETENCIA", month.isNull()),
        ("FORA_DO_PERIODO", ~month.between(first, last)),
        ("SEM_MUNICIPIO", F.col("municipio_estabelecimento").isNull()),
        ("FORA_DO_TERRITORIO", ~F.col("no_territorio")),
    ]


def split_by_time(records: DataFrame, spec: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows of the intervals with their partition's name; the intervals must not overlap."""
    spans = sorted(spec.values())
    if any(a[1] >= b[0] for a, b in zip(spans, spans[1:], strict=False)):
        raise ValueError("the partitions overlap")
    name = F.lit(None).cast("string")
    for k, (a, b) in spec.items():
        name = F.when(F.col("competencia_processamento").between(a, b), k).otherwise(name)
    return records.withColumn("particao", name).filter("particao is not null")


def write_split(parts: DataFrame, path: str) -> None:
    """Writes split rows, a folder a partition. Partitions that ``parts`` has replace those there, others
    stay; rows of a partition lie together, so a folder gets few files however many tasks write."""
    parts.repartition("particao", F.pmod(F.xxhash64("row_id"), F.lit(parts.sparkSession.sparkContext.defaultParallelism))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("particao").parquet(path)


def read_split(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """The rows of some partitions (all, without names); the folders of others are not opened."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col("particao").isin(*names)) if names else rows


def check_source_split(parts: DataFrame, sources: DataFrame, inspected: DataFrame | None = None, test: str = "teste") -> DataFrame:
    """(fonte_arquivo, particoes, n, n_versoes, problema): sources whose rows, of any of their
    versions, lie in more than one partition; inspected sources (fonte_arquivo) that come back in the
    test partition; and versions without a source. ``sources``: (artifact_id, fonte_arquivo)."""
    j = parts.select("artifact_id", "particao").distinct().join(sources.select("artifact_id", "fonte_arquivo").distinct(), "artifact_id", "left")
    g = j.groupBy("fonte_arquivo").agg(F.array_sort(F.collect_set("particao")).alias("lista"), F.count_distinct("artifact_id").alias("n_versoes"))
    if inspected is None:
        g = g.withColumn("vista", F.lit(False))
    else:
        g = g.join(inspected.select("fonte_arquivo").distinct().withColumn("vista", F.lit(True)), "fonte_arquivo", "left")
    why = F.when(F.col("fonte_arquivo").isNull(), "SEM_FONTE").when(F.size("lista") > 1, "EM_VARIAS_PARTICOES").when(F.col("vista") & F.array_contains("lista", test), "INSPECIONADA_NO_TESTE")
    return g.select("fonte_arquivo", F.array_join("lista", ";").alias("particoes"), F.size("lista").cast("long").alias("n"), "n_versoes", why.alias("problema")).filter("problema is not null")


def split_labels(labels: DataFrame, parts: DataFrame) -> DataFrame:
    """The labels of each partition's rows."""
    return labels.join(parts.select("row_id", "particao"), "row_id")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys repeated in either table and keys of one table alone."""
    na, nb = a.groupBy(key).agg(F.count("*").alias("na")), b.groupBy(key).agg(F.count("*").alias("nb"))
    return na.join(nb, key, "full").agg(F.count_if(F.col("na") > 1).alias("repetidas_a"), F.count_if(F.col("nb") > 1).alias("repetidas_b"), F.count_if(F.col("nb").isNull()).alias("so_a"), F.count_if(F.col("na").isNull()).alias("so_b"))


def straddling_datasets(datasets: DataFrame, files: DataFrame) -> DataFrame:
    """(dataset, dentro, fora): datasets (dataset, artifact_id) that lie partly in a window of files;
    such a window is refused, since a dataset is taken whole or not at all."""
    inside = files.select("artifact_id").distinct().withColumn("ha", F.lit(True))
    j = datasets.select("dataset", "artifact_id").distinct().join(inside, "artifact_id", "left")
    return j.groupBy("dataset").agg(F.count_if(F.col("ha").isNotNull()).alias("dentro"), F.count_if(F.col("ha").isNull()).alias("fora")).filter("dentro > 0 and fora > 0")


def check_profile(profiled: DataFrame, records: DataFrame) -> DataFrame:
    """(dimensao, linhas, deletadas, confere): each dimension's totals against the records'."""
    total = records.agg(F.count("*").alias("t"), F.count_if("deletado").alias("d"))
    g = profiled.groupBy("dimensao").agg(F.sum("linhas").alias("linhas"), F.sum("deletadas").alias("deletadas"))
    return g.crossJoin(F.broadcast(total)).select("dimensao", "linhas", "deletadas", ((F.col("linhas") == F.col("t")) & (F.col("deletadas") == F.col("d"))).alias("confere"))


def window_production(records: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of the files of a window (artifact_id)."""
    return records.join(files.select("artifact_id").distinct(), "artifact_id", "left_semi")
