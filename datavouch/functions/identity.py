"""Hashes of tables as multisets, and ids derived from content."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LIMBS = 4


def _field(name: str, kind: T.DataType) -> Column:
    """``length:text`` of a field, N for null."""
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        raise TypeError(f"{name} is a float; floats have no canonical text")
    c = F.array_join(name, ";") if isinstance(kind, T.ArrayType) else F.col(name)
    if isinstance(kind, T.DecimalType) and kind.scale:
        c = F.regexp_replace(c.cast("string"), r"\.?0+\z", "")
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("N"))


def row_digest(df: DataFrame, cols: list[str] | None = None) -> Column:
    """SHA-256 of a row's fields, in the order of their names."""
    names = sorted(cols or df.columns)
    return F.sha2(F.concat_ws("|", *[_field(n, df.schema[n].dataType) for n in names]), 256)


def multiset_fingerprint(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row: the number of rows and the sums of their digests' parts. It doesn't depend on the
    order of rows or the number of tasks, and changes if a row is repeated; one partial aggregate."""
    digest = df.select(row_digest(df, cols).alias("d"))
    part = lambda i: F.conv(F.substring("d", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")
    return digest.agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(part(i)), F.lit(0).cast("decimal(38,0)")).cast("string").alias(f"limb_{i}") for i in range(_LIMBS)])


def logical_hash(df: DataFrame, cols: list[str] | None = None) -> str:
    """The fingerprint as one hexadecimal text."""
    return fingerprint_hash(multiset_fingerprint(df, cols).first())


def fingerprint_hash(row) -> str:
    """The text of the one row of ``multiset_fingerprint``."""
    return hashlib.sha256("|".join([str(row.n_rows), *[row[f"limb_{i}"] for i in range(_LIMBS)]]).encode()).hexdigest()


def content_id(prefix: str, *cols: str) -> Column:
    """Id from the canonical JSON (sorted names, nulls kept) of columns."""
    return F.concat(F.lit(prefix), F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256))
