"""Exact deduplication against a persistent index of digests.

The index is a Parquet table of (digest, keep_id, n_chars, batch), a row for each distinct normalised
text, bucketed and sorted by the SHA-256 of that text. A new batch is digested, its rows are grouped
(counts and the row that would stay are combined before the shuffle), digests that the index has are
taken out by a sort-merge anti-join that reads the buckets in place, and the others are appended.
Documents themselves are never shuffled: 32 bytes, the id and a length stand for each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datavouch.llm.common import saved, shared_dir, split_join

#: Characters that don't count when texts are compared.
IGNORED = " \t\n\x0b\x0c\r"
BUCKETS = 64


def normalised(text: Column) -> Column:
    """The text without white space of ASCII; null is as empty."""
    return F.translate(F.coalesce(text, F.lit("")), IGNORED, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_chars), a row for each row: digest of the normalised text, and code points of the given one."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"))


class DigestIndex:
    """The index in the folder ``path``, which driver and executors must share.

    A batch is named; to add one again after a failure, name it alike: what its first try has
    appended counts as the batch's own, so the answers are those of an undisturbed run. Batches are
    added one at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, id_type: str = "bigint"):
        """Opens the index, or makes an empty one. ``buckets`` and ``id_type`` are those it was made with."""
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id {id_type}, n_chars BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Appends the new texts of ``docs``; returns (doc_id, keep_id, group_size, kept, text_sha256), a
        row for each row.

        Of equal texts the one that an earlier batch has kept stays; else, within the batch, the row
        with the most code points, then the smallest id (nulls last). Of repeated rows with one id one
        stays. keep_id is the id of the row that stays, group_size counts the equal texts of this batch.
        Null texts are as empty; texts without other characters are one group; other columns are left
        out whatever their names; an empty batch gives no rows and appends none."""
        rows = saved(digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "digests")
        best = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row")
        groups = saved(rows.groupBy("digest").agg(F.min(best).alias("best"), F.count("*").alias("group_size")), "groups")
        known = self.rows()
        fresh = groups.repartition(self.buckets, "digest").join(known.select("digest"), "digest", "left_anti")
        fresh = fresh.select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.n")).alias("n_chars"), F.lit(batch).alias("batch"))
        saved(fresh, "fresh").repartition(self.buckets, "digest").write.insertInto(self.name)
        earlier = self.rows().filter(~F.col("batch").eqNullSafe(F.lit(batch))).select("digest", F.col("keep_id").alias("earlier_id"), F.lit(True).alias("earlier"))
        decided = groups.join(earlier, "digest", "left").select("digest", F.when(F.col("earlier"), F.col("earlier_id")).otherwise(F.col("best.id")).alias("keep_id"), F.when(F.col("earlier").isNull(), F.col("best.row")).alias("keep_row"), "group_size")
        out = split_join(rows, decided, ["digest"], groups.select("digest", F.col("group_size").alias("n")), F.xxhash64("row"), "inner")
        return out.select("doc_id", "keep_id", "group_size", F.col("row").eqNullSafe(F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    def compact(self, path: str) -> DigestIndex:
        """The same index in a new folder, where each bucket is one sorted file again."""
        new = DigestIndex(self.spark, path, self.buckets, dict(self.rows().dtypes)["keep_id"])
        self.rows().repartition(self.buckets, "digest").write.insertInto(new.name)
        return new

    def close(self) -> None:
        """Forgets the name in the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One batch on an empty index, in ``path`` or a new folder; see ``DigestIndex.add``."""
    spark = docs.sparkSession
    index = DigestIndex(spark, path or f"{shared_dir(spark)}-index", id_type=docs.schema[id_col].dataType.simpleString())
    return index.add(docs, "all", id_col, text_col)
