"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datavouch.functions.tables import sent, split_join
from datavouch.functions.tables import shared_path as shared_dir
from datavouch.functions.tables import written as saved

__all__ = ["ascii_lower", "bit_set", "claim", "encode", "in_bit_set", "partitions", "ragged_offsets", "saved", "sent", "shared_dir", "split_join", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def ragged_offsets(lengths: np.ndarray) -> np.ndarray:
    """Start offsets of consecutive runs, with the total at the end."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def bit_set(hashes: DataFrame, bits: int) -> np.ndarray:
    """The set of hashes (one long column) modulo ``bits``, as 64-bit words: a filter of fixed size, which
    lets all members pass and, as it fills up, others too. Words are made by tasks; the driver gets one
    row a word that isn't empty."""
    bit = F.pmod(F.col(hashes.columns[0]), F.lit(bits))
    split = hashes.select(F.shiftright(bit, 6).cast("int").alias("word"), F.pmod(bit, F.lit(64)).cast("int").alias("bit"))
    held = np.zeros(bits // 64, np.uint64)
    for batch in split.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow().to_batches():
        held[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return held


def in_bit_set(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (unsigned 64-bit) pass the filter."""
    place = hashes % np.uint64(len(held) * 64)
    return held[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) > 0


_HELD: dict[str, Callable[[], object]] = {}


def claim(name: str, clear: Callable[[], object] | None = None) -> None:
    """Called by a task as it starts in its Python worker. A worker serves the tasks of one operator after
    another; the caches of the others are emptied and their memory is given back, so that they don't
    add up over a pipeline. ``clear`` empties those of the operator ``name``."""
    others = [k for k in _HELD if k != name]
    for k in others:
        _HELD.pop(k)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        libc = ctypes.util.find_library("c")
        trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
        if trim:  # where the C library has it
            trim(0)
    if clear is not None:
        _HELD[name] = clear
