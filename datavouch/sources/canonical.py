"""Reading and writing canonical tables with a declared schema and a content-derived descriptor."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datavouch.functions.identity import fingerprint_hash, logical_hash, multiset_fingerprint


def _fits(have: T.DataType, want: T.DataType) -> bool:
    if isinstance(want, T.LongType):
        return isinstance(have, T.IntegralType)
    if isinstance(want, T.DecimalType):
        return isinstance(have, T.DecimalType)
    return type(have) is type(want)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The table in the schema's order and types; a missing, extra or wrongly typed column is an error
    (any integer will do for a long, any decimal for a decimal)."""
    missing = [f.name for f in schema if f.name not in df.columns]
    extra = [c for c in df.columns if c not in schema.names]
    wrong = [f.name for f in schema if f.name in df.columns and not _fits(df.schema[f.name].dataType, f.dataType)]
    if missing or extra or wrong:
        raise ValueError(f"layout: missing {missing}, extra {extra}, wrong type {wrong}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


@dataclass(frozen=True)
class Layout:
    """A raw layout: columns in their order, those that may be missing, and the months (AAAAMM, both
    ends included, None: open) of files that it describes."""

    columns: tuple[str, ...]
    optional: frozenset[str] = frozenset()
    first: str | None = None
    last: str | None = None


def match_layout(columns: list[str], month: str, layouts: list[Layout]) -> Layout:
    """The layout of a file: the one whose window holds its month. Required columns must be there in
    order, optional ones may be missing, others are an error; so are no layout, or several."""
    fits = [x for x in layouts if (x.first is None or x.first <= month) and (x.last is None or month <= x.last)]
    if len(fits) != 1:
        raise ValueError(f"{len(fits)} layouts describe files of {month}")
    layout = fits[0]
    extra = [c for c in columns if c not in layout.columns]
    missing = [c for c in layout.columns if c not in columns and c not in layout.optional]
    if extra or missing or columns != [c for c in layout.columns if c in columns]:
        raise ValueError(f"layout of {month}: missing {missing}, extra {extra}, or another order")
    return layout


def read_canonical(spark: SparkSession, path: str, schema: T.StructType, verify: bool = False) -> DataFrame:
    """Reads a canonical table; with ``verify`` its rows must be those that the descriptor names."""
    df = conform(spark.read.parquet(path), schema)
    if verify:
        said = json.loads(spark.read.text(f"{path}.descriptor").first()[0])
        if said["hash"] != logical_hash(df):
            raise ValueError(f"{path} isn't what its descriptor says")
    return df


def write_dataset(df: DataFrame, path: str, schema_id: str) -> dict:
    """Writes a table that must not exist yet, and beside it its descriptor."""
    df.write.mode("errorifexists").parquet(path)
    spark = df.sparkSession
    content = multiset_fingerprint(spark.read.parquet(path)).first()  # rows and hash from one scan
    found = {"schema_id": schema_id, "hash": fingerprint_hash(content), "rows": content.n_rows}
    found["dataset_id"] = f"ds_{found['hash'][:32]}"
    spark.createDataFrame([(json.dumps(found, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}.descriptor")
    return found


def union_datasets(dfs: list[DataFrame]) -> DataFrame:
    """Tables of one schema, by column name; nothing is deduplicated."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
