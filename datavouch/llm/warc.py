"""WARC archives with a capture index of several levels.

Archives are written and indexed through Spark's own sources; ranges are read by tasks from the
shared folder's file system (local, S3, GCS, or HDFS where its client library is installed). Each
record is a gzip member of its own; index entries hold its file, offset and length. The index is
sorted by reversed-host URL key and cut into compressed blocks; a sparse directory holds the first
and last key of each block. A directory of more than ``TOP`` entries is itself cut into blocks with
a directory above, and so on. A lookup searches the top, then each level's blocks, by binary search,
and then cuts the records' ranges out of their files.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datavouch.llm.common import encode, saved, sent, shared_dir, split_join

#: Payloads of fewer bytes are always stored in full.
LEAST_REVISIT = 100
BLOCK_ENTRIES = 1000
#: Entries of the topmost directory, which every task holds, at most.
TOP = 10_000
#: Records in an archive file at most.
FILE_RECORDS = 20_000
#: Payloads that more pages share than this need no shuffle: these digests go to all tasks.
COMMON = 10_000
_DATE = "1970-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def url_key(url: str | None) -> str:
    """The canonical key: host labels in reverse, ``)`` and the rest, lower-cased host, no scheme."""
    rest = (url or "").partition("://")[2]
    m = re.match(r"[^/?#]*", rest)
    return ",".join(reversed(m[0].lower().split("."))) + ")" + rest[m.end() :]


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record as a gzip member. Its last byte is zero, as the writer's line separator:
    that is the high byte of the uncompressed size, and an empty member follows records of 16 MB."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    record = b"WARC/1.1\r\n" + encode(lines) + b"Content-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packed = gzip.compress(record, 5, mtime=0)
    return packed if packed[-1] == 0 else packed + _EMPTY_MEMBER


def _fields(kind: str, page_id: int | None, url: str | None, digest: str, size: int, place: tuple[int, int]) -> list[tuple[str, str]]:
    """``place``: the number of the writing task and of the record in it, so that every record's id
    is its own, also where page ids are missing or repeat."""
    own = hashlib.sha256(f"{page_id}|{url}|{digest}|{place}".encode("utf-8", "surrogatepass")).hexdigest()
    fields = [("WARC-Type", kind), ("WARC-Date", _DATE), ("WARC-Record-ID", f"<urn:uuid:{own[:8]}-{own[8:12]}-{own[12:16]}-{own[16:20]}-{own[20:32]}>"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(size))]
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", _one_line(url)))
    fields.append(("Content-Type", "application/http; msgtype=response"))
    return fields


def _one_line(url: str) -> str:
    """The URL as a header field holds it: line ends, and white space at its ends, by their codes."""
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    inner = url.strip(" \t")
    at = url.find(inner)
    code = lambda x: x.replace(" ", "%20").replace("\t", "%09")
    return code(url[:at]) + inner + code(url[at + len(inner) :])


def _response(page_id: int | None, url: str | None, payload: bytes, digest: str, place: tuple[int, int]) -> bytes:
    return _member(_fields("response", page_id, url, digest, len(payload), place), f"{_HTTP}{len(payload)}\r\n\r\n".encode() + payload)


def _revisit(page_id: int | None, url: str | None, digest: str, size: int, first: int, first_url: str | None, place: tuple[int, int]) -> bytes:
    fields = _fields("revisit", page_id, url, digest, size, place)
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Date", _DATE), ("WARC-Refers-To-Page", str(first))]
    if first_url is not None:
        fields.append(("WARC-Refers-To-Target-URI", _one_line(first_url)))
    return _member(fields, _HTTP.encode() + b"0\r\n\r\n")


def members(stream, size: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of the gzip members of an archive, read in pieces of ``size`` bytes;
    empty members are skipped."""
    start, held = 0, b""
    while True:
        held = held or stream.read(size)
        if not held:
            return
        inflate, record, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            held = held or stream.read(size)
            if not held:
                raise ValueError(f"the member at {start} is cut off")
            record.append(inflate.decompress(held))
            used += len(held) - len(inflate.unused_data)
            held = inflate.unused_data
        if whole := b"".join(record):
            yield start, used, whole
        start += used


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields, by lower-case name, and the payload of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.strip(" \t").lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


@dataclass(frozen=True)
class Archive:
    """Where the records and the index lie, and how many levels of blocks it has."""

    records: str
    index: str
    levels: int


def _raw(column: pa.Array) -> pa.Array:
    """Binary values as a string column, byte for byte, for the text writer."""
    return pa.Array.from_buffers(pa.string(), len(column), column.buffers(), column.null_count, column.offset)


def write(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> Archive:
    """Writes a record for each row and the capture index.

    Of rows with equal payloads of at least ``LEAST_REVISIT`` bytes those with the smallest id are
    responses and the others revisits; rows with a null id among them come last, and all are
    responses if no id is known. Null html is an empty payload; payloads are stored whole, however
    long. Repeated rows each get a record. Other columns are left out, whatever their names. Files
    hold ``FILE_RECORDS`` records at most. An empty table makes an archive without records.

    Payloads are found equal by their digests. Those of very common digests are not moved: their
    first pages are known to all tasks. The others meet their digest's first page in a join, in
    which none has more than ``COMMON`` rows.
    """
    spark = pages.sparkSession
    path = path or shared_dir(spark)
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [encode(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([hashlib.sha256(x).hexdigest() for x in payloads], pa.string()), pa.array(map(len, payloads), pa.int64())], ["page_id", "url", "digest", "size"])

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [encode(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([hashlib.sha256(x).hexdigest() for x in payloads], pa.string()), pa.array(map(len, payloads), pa.int64()), pa.array([zlib.compress(x, 1) for x in payloads], pa.binary())], ["page_id", "url", "digest", "size", "packed"])

    shared = source.mapInArrow(digested, "page_id long, url string, digest string, size long").filter(F.col("size") >= LEAST_REVISIT)
    firsts = saved(shared.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("f"), F.count("*").alias("n")).filter("n > 1 and f is not null").select("digest", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url"), "n"), "firsts")
    rows = source.mapInArrow(stored, "page_id long, url string, digest string, size long, packed binary")
    common = saved(firsts.filter(F.col("n") > COMMON), "common")
    if not common.isEmpty():
        rows = rows.join(sent(common.select("digest", F.col("first").alias("c_first"), F.col("first_url").alias("c_url"))), "digest", "left")
        settled = F.col("c_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("c_first"))
        # revisits of common payloads leave the digest's key and their payload behind
        rows = rows.withColumns({"packed": F.when(~settled, F.col("packed")), "key": F.when(F.col("c_first").isNull(), F.col("digest"))})
    else:
        rows = rows.withColumns({"c_first": F.lit(None).cast("long"), "c_url": F.lit(None).cast("string"), "key": F.col("digest")})
    rare = firsts.filter(F.col("n") <= COMMON).select(F.col("digest").alias("key"), "first", "first_url")
    kept = rows.filter("key is not null").join(rare, "key", "left").unionByName(rows.filter("key is null").withColumns({"first": F.lit(None).cast("long"), "first_url": F.lit(None).cast("string")}))
    kept = kept.select("page_id", "url", "digest", "size", "packed", F.coalesce("first", "c_first").alias("first"), F.when(F.col("first").isNotNull(), F.col("first_url")).otherwise(F.col("c_url")).alias("first_url"))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for page_id, url, digest, size, packed, first, first_url in zip(*(batch.column(i) for i in range(7)), strict=True):
                page_id, url, digest, first = page_id.as_py(), url.as_py(), digest.as_py(), first.as_py()
                n += 1
                whole = first is None or page_id == first
                out.append((_response(page_id, url, zlib.decompress(packed.as_py()), digest, (task, n)) if whole else _revisit(page_id, url, digest, size.as_py(), first, first_url.as_py(), (task, n)))[:-1])
            yield pa.RecordBatch.from_arrays([_raw(pa.array(out, pa.binary()))], ["value"])

    records, index = f"{path}-records", f"{path}-index"
    kept.mapInArrow(final, "value string").write.option("lineSep", "\x00").option("maxRecordsPerFile", FILE_RECORDS).text(records)
    return Archive(records, index, _index(spark, records, index))


def _index(spark: SparkSession, records: str, index: str) -> int:
    """Reads the archives, a piece at a time, and writes the levels of the index; their number."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(records)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for offset, length, record in members(stream):
                        fields, _ = parse(record)
                        rows.append((url_key(fields.get("warc-target-uri")), file, offset, length))
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "file", "offset", "length"])

    files = spark.read.format("binaryFile").load(records).filter("length > 0").select(F.element_at(F.split("path", "/"), -1).alias("file"))
    rows = saved(files.mapInArrow(entries, "key string, file string, offset long, length long"), "entries")
    order = rows.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    found = _packed(order.select("key", F.col("key").alias("last"), F.concat_ws(" ", F.col("offset").cast("string"), F.col("length").cast("string"), "file").alias("what")))
    found.write.parquet(f"{index}-0")
    level = 0
    while (blocks := spark.read.parquet(f"{index}-{level}").select("key", "last", "block")).count() > TOP:
        level += 1
        order = blocks.repartitionByRange("key", "block").sortWithinPartitions("key", "block")
        _packed(order.select("key", "last", F.col("block").alias("what"))).write.parquet(f"{index}-{level}")
    return level + 1


def _packed(order: DataFrame) -> DataFrame:
    """Sorted entries (key, last, what) in blocks of ``BLOCK_ENTRIES``: (key, last, block, data), with
    the first and the last key and the block's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple] = []
        task, n = TaskContext.get().partitionId(), 0

        def block(rows: list[tuple]) -> pa.RecordBatch:
            data = zlib.compress("\n".join(json.dumps(r) for r in rows).encode("utf-8", "surrogatepass"))
            return pa.RecordBatch.from_arrays([pa.array([rows[0][0]]), pa.array([max(r[1] for r in rows)]), pa.array([f"{task:08d}.{n:08d}"]), pa.array([data], pa.binary())], ["key", "last", "block", "data"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= BLOCK_ENTRIES:
                yield block(held[:BLOCK_ENTRIES])
                held, n = held[BLOCK_ENTRIES:], n + 1
        if held:
            yield block(held)

    return order.mapInArrow(run, "key string, last string, block string, data binary")


def _unpacked(data: bytes) -> list[tuple]:
    return [tuple(json.loads(x)) for x in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n")]


def _search(entries: list[tuple], key: str, lasts: list[str]) -> Iterator[str]:
    """What the entries (key, last, what), in order, say of ``key``, by binary search."""
    at = bisect.bisect_left(lasts, key)
    while at < len(entries) and entries[at][0] <= key:
        yield entries[at][2]
        at += 1


def _ranges(spark: SparkSession, archive: Archive, wanted: DataFrame) -> DataFrame:
    """Reads the records at ``wanted`` (file, offset, length): one row for each, of what it holds.
    Only the places are shuffled; a task opens its archives and reads the ranges in order."""
    root = archive.records

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        name, handle = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    if handle is not None:
                        handle.close()
                    name, handle = file, store.open_input_file(f"{base}/{file}")
                handle.seek(offset)
                fields, payload = parse(gzip.decompress(handle.read(length)))
                kind = fields["warc-type"]
                stored = fields["warc-payload-digest"].removeprefix("sha256:")
                if kind == "response":
                    digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                    if digest != stored:
                        raise ValueError(f"the record at {offset} of {file} is damaged")
                else:
                    digest, size, payload = stored, int(fields["warc-payload-length"]), b""
                numbers = [int(fields[k]) if k in fields else None for k in ("warc-page-id", "warc-refers-to-page")]
                rows.append((numbers[0], fields.get("warc-target-uri"), size, digest, kind, numbers[1], payload))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if handle is not None:
            handle.close()

    places = wanted.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def lookup(spark: SparkSession, archive: Archive, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The records of the given URLs: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, payload (empty for revisits); digests of responses are checked.

    URLs differ by their keys, so not in the scheme. A null URL, or one without ``://``, asks for the
    records without a host. URLs without a capture and repeated ones add nothing; all captures of a
    URL are returned. A key spread over many blocks is a row for each of them, and the keys that ask
    for one block come in lots of ``BLOCK_ENTRIES``."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(None if u is None else _one_line(u)) for u in batch.column(0).to_pylist()], pa.string())], ["key"])

    top = sorted((r.key, r.last, r.block) for r in spark.read.parquet(f"{archive.index}-{archive.levels - 1}").select("key", "last", "block").collect())

    def at_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lasts = [e[1] for e in top]
        for batch in batches:
            rows = [(k, block) for k in batch.column(0).to_pylist() for block in _search(top, k, lasts)]
            columns = zip(*rows, strict=True) if rows else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["key", "block"])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, keys in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                entries = _unpacked(data.as_py())
                lasts = [e[1] for e in entries]
                rows = [(k, what) for k in keys for what in _search(entries, k, lasts)]
                columns = zip(*rows, strict=True) if rows else [[]] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["key", "block"])

    hits = urls.select(F.col(url_col).cast("string").alias("url")).mapInArrow(keyed, "key string").distinct().mapInArrow(at_top, "key string, block string")
    for level in range(archive.levels - 1, -1, -1):
        lot = F.floor((F.row_number().over(Window.partitionBy("block").orderBy("key")) - 1) / BLOCK_ENTRIES)
        lots = hits.withColumn("lot", lot).groupBy("block", "lot").agg(F.collect_list("key").alias("keys"))
        blocks = spark.read.parquet(f"{archive.index}-{level}").select("block", "data")
        hits = blocks.join(lots, "block").select("data", "keys").mapInArrow(below, "key string, block string")
    part = F.split("block", " ", 3)
    return _ranges(spark, archive, hits.select(part[2].alias("file"), part[0].cast("long").alias("offset"), part[1].cast("long").alias("length")))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages, looks up the URLs of all of them in the index and returns what the archives
    hold: page_id, payload_bytes, payload_digest, record_type, refers_to, one row for each row of
    ``pages``."""
    archive = write(pages, path)
    return lookup(pages.sparkSession, archive, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
