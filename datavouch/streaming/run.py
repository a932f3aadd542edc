"""Running a stream over what is available now, and reading what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame

from datavouch.functions.tables import shared_path


def available_now(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the stream's output, with its checkpoint, under ``path`` (a new one under
    ``spark.checkpoint.dir``) and reads all that is there; the same path again goes on from where the
    last run ended."""
    spark = stream.sparkSession
    path = path or shared_path(spark)
    query = stream.writeStream.format("parquet").option("path", f"{path}-out").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}-out")
