"""Intermediate tables in the folder that driver and executors share, and joins that stay even."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this many rows are sent to all tasks, once their rows are counted.
SENT_ROWS = 200_000
#: A key with more rows than this is dealt to several tasks.
HOT_ROWS = 200_000
#: Largest file, in bytes, that Spark may send to all tasks by its own estimate. Columns of codes take some
#: fifty times their file's size in memory, in the driver too, and Spark's own limit is 10 MB of file.
SENT_BYTES = 262_144


def shared_path(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``. On one machine, where tasks share the driver's
    folders, it is set to a folder of the warehouse if unset; on a cluster an unset one is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def bound_broadcasts(spark: SparkSession) -> None:
    """Lowers the session's limit of automatic broadcasts to ``SENT_BYTES``; a lower one stays. Joins then
    have the same plan at every size, but for tables that ``sent`` has counted."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", spark.conf.get(name).strip().lower()).groups()
    if int(number) * 1024 ** " kmgtp".index(unit or " ") > SENT_BYTES:
        spark.conf.set(name, str(SENT_BYTES))


def written(df: DataFrame, what: str = "") -> DataFrame:
    """Cuts the lineage of a table that later steps read several times."""
    path = shared_path(df.sparkSession) + (f"-{what}" if what else "")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df``, dealt by a hash of ``by`` to as many tasks as the session has cores, if its rows lie in
    splits for less than half of these; else it is left where it lies, as moving the whole table costs
    more than some idle cores. A file of one row group is read by one task however many splits it
    has, and joins with small tables never deal its rows out."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    filled = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count("*").alias("n"))
    return df.repartition(cores, *by) if 2 * filled.count() < cores else df


def sent(df: DataFrame) -> DataFrame:
    """``df`` (a stored table, counting it is cheap) marked for sending to all tasks if it has at most
    ``SENT_ROWS`` rows; else as it is, and joins shuffle."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def made_once(df: DataFrame, name: str) -> DataFrame:
    """``df``, whose column ``name`` is costly: filters on it aren't moved below it, where they would make it again, often in
    code too long to be compiled."""
    return df.select(*[c for c in df.columns if c != name], F.explode_outer(F.array(name)).alias(name))


def split_join(big: DataFrame, small: DataFrame, on: list[str], counts: DataFrame, by: Column, how: str = "left") -> DataFrame:
    """``big`` joined with ``small``, which has one row a key, without a task for all rows of a hot key.

    ``counts``: (*on, n), how many rows of ``big`` a key has at least where that is over ``HOT_ROWS``.
    Rows of hot keys are dealt by ``by`` (a hash of what differs among them) to n / HOT_ROWS parts,
    each of which gets the key's row of ``small``. There are at most rows / HOT_ROWS hot keys, so
    these are sent to all tasks while they are few, and joined else. Null keys match nothing."""
    hot = written(counts.filter(F.col("n") > HOT_ROWS).select(*on, F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("_parts")), "hot")
    if hot.isEmpty():
        return big.join(small, on, how)
    left = big.join(sent(hot), on, "left").withColumn("_part", F.coalesce(F.pmod(by, F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    parts = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    right = small.join(sent(hot), on, "left").withColumn("_part", F.explode(parts)).drop("_parts")
    return left.join(right, [*on, "_part"], how).drop("_part")
