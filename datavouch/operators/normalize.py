"""Canonical tables from raw ones, and conformance checks that return the offenders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datavouch.functions.text import full_match, in_domain, normalize_field

# Columns dropped as sensitive at normalization.
SENSITIVE = ("cns_paciente", "cpf_prof", "cns_prof", "nome", "prof_nome")
# End of the fixed values.


def normalize_production(raw: DataFrame, specs: dict[str, dict], artifact: str = "artifact_id", index: str = "indice") -> DataFrame:
    """One row for each physical row, deleted ones too: row_id, and for each field its value, raw
    text and missing reason. ``specs``: field to arguments of ``normalize_field`` (``column``: where it is)."""
    out = []
    for name, spec in specs.items():
        args = {k: v for k, v in spec.items() if k != "column"}
        value, text, reason = normalize_field(F.col(spec.get("column", name)), **args)
        out += [value.alias(name), text.alias(f"{name}_bruto"), reason.alias(f"{name}_motivo")]
    return raw.select(F.concat_ws("#", artifact, F.col(index).cast("string")).alias("row_id"), artifact, *out)


def add_absent(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Optional columns that the file lacks: typed nulls with the reason DESCONHECIDO."""
    missing = {c: t for c, t in columns.items() if c not in df.columns}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in missing.items()} | {f"{c}_motivo": F.lit("DESCONHECIDO") for c in missing})


def require_domain(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(coluna, n): values outside their pattern, by column; the table is rejected if any n > 0."""
    g = df.agg(*[F.count_if(~full_match(F.col(c), p)).alias(c) for c, p in patterns.items()])
    return g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("coluna"), F.col(c).alias("n")) for c in patterns])).alias("x")).select("x.*")


def pair_reason(a: str, b: str, pattern_a: str, pattern_b: str, deleted: str = "deletado"):
    """Why a row doesn't count as a pair: deleted, an empty code or an invalid one; null if it does."""
    out = F.when(F.col(deleted), "DELETADO")
    for c, p in ((a, pattern_a), (b, pattern_b)):
        out = out.when(F.col(c).isNull() | (F.btrim(c, F.lit(" ")) == ""), f"{c.upper()}_VAZIO").when(~full_match(F.col(c), p), f"{c.upper()}_INVALIDO")
    return out


def pair_counts(df: DataFrame, a: str, b: str, pattern_a: str, pattern_b: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Valid pairs with their counts, and the rows left out by reason."""
    marked = df.withColumn("motivo", pair_reason(a, b, pattern_a, pattern_b))
    return marked.filter("motivo is null").groupBy(*by, a, b).agg(F.count("*").alias("n_vinculos")), marked.filter("motivo is not null").groupBy("motivo").agg(F.count("*").alias("n"))


def distinct_entities(df: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Exact duplicates removed, and keys that still repeat with different content (an error)."""
    once = df.distinct()
    return once, once.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def require_month(df: DataFrame, column: str, month: str, deleted: str = "deletado") -> DataFrame:
    """(competencia, n): all months other than the file's among live rows, and how many rows have them."""
    return df.filter(~F.col(deleted) & ~F.col(column).eqNullSafe(F.lit(month))).groupBy(F.col(column).alias("competencia")).agg(F.count("*").alias("n"))


def reconcile(physical: DataFrame, canonical: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row: physical = canonical + excluded, and what is left unexplained."""
    p, c = physical.agg(F.count("*").alias("fisicas")), canonical.agg(F.coalesce(F.sum("n_vinculos"), F.lit(0)).alias("canonicas"))
    x = excluded.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("excluidas"))
    return p.crossJoin(c).crossJoin(x).withColumn("sem_explicacao", F.col("fisicas") - F.col("canonicas") - F.col("excluidas"))


def multiplicity(df: DataFrame, exclude: list[str]) -> DataFrame:
    """One row: rows, distinct contents, most repeats of one content."""
    cols = [c for c in df.columns if c not in exclude]
    return df.groupBy(*cols).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("linhas"), F.count("*").alias("combinacoes"), F.coalesce(F.max("n"), F.lit(0)).alias("maior_repeticao"))


def project_records(df: DataFrame, fields: dict[str, tuple[str, str]], keep: list[str]) -> DataFrame:
    """Codes outside their domain as null; ``fields``: new name to (column, pattern); columns that
    the table lacks are null."""
    return df.select(*keep, *[(in_domain(F.col(c), p) if c in df.columns else F.lit(None).cast("string")).alias(n) for n, (c, p) in fields.items()])


def drop_sensitive(df: DataFrame, names: tuple[str, ...] = SENSITIVE) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() in names])


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """(coluna, nulos): one scan; a column that is missing counts -1."""
    have = [c for c in columns if c in df.columns]
    g = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in have])
    rows = [F.struct(F.lit(c).alias("coluna"), (F.col(c) if c in have else F.lit(-1).cast("long")).alias("nulos")) for c in columns]
    return g.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def check_domain(df: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """(coluna, fora): values outside each list; null is outside."""
    g = df.agg(*[F.count_if(~F.coalesce(F.col(c).isin(v), F.lit(False))).alias(c) for c, v in allowed.items()])
    return g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("coluna"), F.col(c).alias("fora")) for c in allowed])).alias("x")).select("x.*")


def check_key(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keys that repeat or have a null part."""
    null = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in cols))
    return df.groupBy(*cols).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | null)


def check_lineage(df: DataFrame, declared: DataFrame) -> DataFrame:
    """(row_id, problema): row ids that name another file than artifact_id, or a file not declared."""
    named = F.regexp_extract("row_id", r"\A([^#/]+)", 1)
    known = declared.select("artifact_id").distinct().withColumn("declarado", F.lit(True))
    j = df.select("row_id", "artifact_id").join(known, "artifact_id", "left")
    why = F.when(named != F.col("artifact_id"), "ARTEFATO_DIVERGENTE").when(F.col("declarado").isNull(), "ARTEFATO_NAO_DECLARADO")
    return j.withColumn("problema", why).filter("problema is not null").select("row_id", "problema")


def territory_codes(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """(codigo, valido, n): six digits with the region's prefix, whose check digit fits if a seventh
    is there; a list is unique where every n, how often the code occurs, is one."""
    c = F.col(column)
    digits = [F.substring(c, i, 1).try_cast("int") for i in range(1, 7)]
    # weights 1 2 1 2 1 2; digits of a product are added
    parts = [d if i % 2 == 0 else F.floor(d * 2 / 10) + d * 2 % 10 for i, d in enumerate(digits)]
    check = F.pmod(10 - F.pmod(reduce(lambda a, b: a + b, parts), F.lit(10)), F.lit(10))
    right = full_match(c, f"{prefix}[0-9]{{4}}([0-9])?") & ((F.length(c) == 6) | (F.substring(c, 7, 1).try_cast("int") == check))
    return df.select(c.alias("codigo"), F.coalesce(right, F.lit(False)).alias("valido")).groupBy("codigo", "valido").agg(F.count("*").alias("n"))
