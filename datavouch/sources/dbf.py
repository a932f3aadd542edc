"""dBASE tables as a distributed job: ranges of rows are read and decoded by tasks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are read together.
CHUNK_ROWS = 50_000


def header(data: bytes, length: int | None = None) -> tuple[int, int, int, list[tuple[str, int]]]:
    """(rows, first offset, row size, [(field, size)]) of a table; bad sizes are an error. ``data`` is
    at least the header, ``length`` the size of the whole table."""
    rows, first, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("ascii").lower()
        fields.append((name, data[at + 16]))
        at += 32
    if 1 + sum(n for _, n in fields) != size or (len(data) if length is None else length) < first + rows * size:
        raise ValueError("the table's sizes don't fit its header")
    return rows, first, size, fields


def read_dbf(spark: SparkSession, path: str, columns: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """All rows, deleted ones too, of the files at ``path``: file, indice, deletado and text columns.

    Each file's header is read once and gives a table of chunks (file, offset, rows), which are dealt
    to tasks; these seek and decode, so a file of any size is split. Columns that a file lacks are
    null. Paths are of file systems that pyarrow knows."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = fs.FileSystem.from_uri(name)
                with store.open_input_file(place) as f:
                    (first,) = struct.unpack_from("<H", f.read(32), 8)
                    f.seek(0)
                    rows, first, size, fields = header(f.read(first), length)
                layout = ",".join(f"{n}:{k}" for n, k in fields)
                out += [(name, first + i * size, i, min(chunk_rows, rows - i), size, layout) for i in range(0, rows, chunk_rows)]
            columns_ = zip(*out, strict=True) if out else [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns_, kinds, strict=True)], ["file", "offset", "first", "rows", "size", "layout"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, offset, start, rows, size, layout in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, place = fs.FileSystem.from_uri(name)
                with store.open_input_file(place) as f:
                    f.seek(offset)
                    raw = f.read(rows * size)
                at, places = 1, {}
                for field, n in (x.rsplit(":", 1) for x in layout.split(",")):
                    places[field] = (at, at + int(n))
                    at += int(n)
                part = [raw[i : i + size] for i in range(0, rows * size, size)]
                values = [pa.array([r[slice(*places[c])].decode("latin-1") for r in part], pa.string()) if c in places else pa.nulls(len(part), pa.string()) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(range(start, start + len(part)), pa.int64()), pa.array([r[:1] == b"*" for r in part], pa.bool_()), *values], ["file", "indice", "deletado", *columns])

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    table = files.mapInArrow(chunks, "file string, offset long, first long, rows long, size long, layout string")
    dealt = table.repartition(spark.sparkContext.defaultParallelism, F.col("file"), F.col("offset"))
    return dealt.mapInArrow(decode, "file string, indice long, deletado boolean, " + ", ".join(f"`{c}` string" for c in columns))
