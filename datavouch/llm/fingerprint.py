"""Exact document fingerprints: canonical text, wide xxhash, byte comparison inside equal buckets.

The canonical form is NFKC, case-folded, NFKC again, with each run of white space one space and none
at the ends. The fingerprint is the 128-bit xxHash3 of its UTF-8 bytes. Texts of equal fingerprints are
one bucket; those of buckets with several are compared byte by byte with one of them. Only these texts
are moved: a bit set of fixed size tells the tasks that read the texts which buckets have several, so
all others stay where they are. Should a bucket hold different texts, the later ones, in the order of
their SHA-256, get a suffix.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datavouch.llm.common import bit_set, encode, in_bit_set, partitions, saved, split_join

#: Bits of the set of buckets that hold several texts (16 MB), whatever the input.
FILTER_BITS = 1 << 27
_LOW = -(1 << 63)


def canonical(text: str | None) -> bytes:
    """The canonical bytes of a text; null is as empty."""
    if not text:
        return b""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return encode(" ".join(text.split()))


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, group_id): group_id is the smallest id of rows with equal canonical
    text. Null texts are as empty ones; null ids come last; repeated rows are kept."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            canon = [canonical(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(digest, canon), pa.string()), pa.array([hashlib.sha256(c).digest() for c in canon], pa.binary())], ["doc_id", "bucket", "sha"]
            )

    marked = saved(source.mapInArrow(run, f"doc_id {kind}, bucket string, sha binary"), "marked")
    firsts = marked.groupBy("bucket", "sha").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n"))
    found = split_join(marked, firsts.select("bucket", "sha", "group_id"), ["bucket", "sha"], firsts.select("bucket", "sha", "n"), F.xxhash64("doc_id"))
    return _distinguished(found, source, marked, "bucket").select("doc_id", F.col("bucket").alias("fingerprint"), "group_id")


def different_texts(source: DataFrame, marked: DataFrame) -> DataFrame:
    """(bucket, sha) of texts that share their bucket with another text, by comparing bytes.

    ``source`` has doc_id and text; ``marked`` the bucket of each of its rows. The texts of buckets with
    several rows are brought to one text of theirs; those of a bucket with very many rows are dealt to
    several tasks, each with that text."""
    lead = F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW))).alias("lead")
    many = saved(marked.groupBy("bucket").agg(F.count("*").alias("n"), lead).filter("n > 1"), "buckets")
    held = source.sparkSession.sparkContext.broadcast(bit_set(many.select(F.conv(F.substring("bucket", 18, 15), 16, 10).cast("long").alias("h")), FILTER_BITS))
    rows = source.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("k"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            canon = [canonical(t.as_py()) for t in batch.column(1)]
            buckets = [digest(c) for c in canon]
            keep = pa.array(in_bit_set(held.value, np.array([int(b[17:], 16) for b in buckets], np.uint64)) if buckets else np.zeros(0, bool))
            shas = [hashlib.sha256(c).digest() if k.as_py() else b"" for c, k in zip(canon, keep, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(buckets, pa.string()), pa.array(shas, pa.binary()), pa.array(canon, pa.binary())], ["k", "bucket", "sha", "canon"]).filter(keep)

    texts = rows.mapInArrow(run, "k long, bucket string, sha binary, canon binary")
    one = texts.join(many.select("bucket", F.col("lead").alias("k")), ["bucket", "k"], "left_semi").select("bucket", F.col("sha").alias("first_sha"), F.col("canon").alias("first")).dropDuplicates(["bucket"])
    met = split_join(texts, one, ["bucket"], many.select("bucket", "n"), F.xxhash64("k", "sha"), "inner")
    pairs = saved(met.filter(F.col("canon") != F.col("first")).select("bucket", F.explode(F.array("sha", "first_sha")).alias("sha")).distinct(), "clashes")
    return pairs


def _distinguished(df: DataFrame, source: DataFrame, marked: DataFrame, column: str) -> DataFrame:
    """``df`` with suffixes in ``column`` where a bucket holds different texts."""
    other = different_texts(source, marked)
    if other.isEmpty():
        return df
    return _suffixed(df, "bucket", "sha", "_own", _clashes(other, [("bucket", "sha")])).withColumn(column, F.col("_own")).drop("_own")


def _clashes(marked: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(bucket, sha, suffix) for buckets that hold different texts; the first has no suffix."""
    seen = None
    for bucket, sha in pairs:
        part = marked.select(F.col(bucket).alias("bucket"), F.col(sha).alias("sha")).distinct()
        seen = part if seen is None else seen.unionByName(part)
    found = seen.groupBy("bucket").agg(F.array_sort(F.collect_set("sha")).alias("shas")).filter(F.size("shas") > 1)
    return found.select("bucket", F.posexplode("shas").alias("n", "sha")).filter("n > 0").select("bucket", "sha", F.concat(F.lit("-"), F.col("n").cast("string")).alias("suffix"))


def _suffixed(marked: DataFrame, bucket: str, sha: str, out: str, clashes: DataFrame | None = None) -> DataFrame:
    clashes = _clashes(marked, [(bucket, sha)]) if clashes is None else clashes
    own = clashes.select(F.col("bucket").alias(bucket), F.col("sha").alias(sha), F.col("suffix"))
    return marked.join(own, [bucket, sha], "left").withColumn(out, F.concat(bucket, F.coalesce("suffix", F.lit("")))).drop("suffix")


def _edges(keyed: DataFrame, blocks: int) -> list[tuple[int, int]]:
    """Places (k, h), present in the table, that cut its rows, in the order of id and hash, into about
    equal runs; the least is the first. An id of many rows is cut at their hashes."""
    row = keyed.agg(F.count("*").alias("n"), F.min("k").alias("low"), F.percentile_approx("k", [i / blocks for i in range(1, blocks)], 100 * blocks).alias("cuts") if blocks > 1 else F.array().alias("cuts")).first()
    if row.low is None:
        return []
    ids = sorted({row.low, *(row.cuts or [])})  # at most as many as runs
    share = [i / blocks for i in range(1, blocks)] or [0.5]
    some = keyed.filter(F.col("k").isin(ids)).groupBy("k").agg(F.count("*").alias("n"), F.min("h").alias("least"), F.percentile_approx("h", share, 1000).alias("cuts"))
    return sorted({(r.k, h) for r in some.collect() for h in ([r.least, *r.cuts] if r.n * blocks > 2 * row.n else [r.least])})


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit_share: int = 4) -> DataFrame:
    """Fingerprints of every text, of an edited form of it, and their likeness.

    The edited text replaces the last floor(n / ``edit_share``) code points by as many of the first
    of the next document (or all that it has) in ascending id, after the last: of the first. Rows
    with equal ids follow each other in the order of their texts' hashes. Null texts are as empty; null
    ids come before all others. One document alone is its own next.

    Rows are dealt into runs of neighbours, and runs by ranges of about equal rows to tasks; the first
    text of each run also goes to the run before, so each task has every next text at hand and all
    texts are shuffled once. Rows of one id and text are one run, those of one id may be several. Texts are taken whole; other columns are
    left out, whatever their names; an empty table gives no rows.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next;
    near_* are 1.0 for equal canonical bytes and else 0.0. Edited texts, which lie in no table, keep the
    bare digest of theirs.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = source.select(F.coalesce("doc_id", F.lit(_LOW)).alias("k"), F.xxhash64("text").alias("h"), F.col("doc_id").isNull().alias("none"), "text")
    parts = partitions(spark)
    bounds = _edges(keyed.select("k", "h"), 2 * parts)
    ids, hashes = np.array([k for k, _ in bounds], np.int64), np.array([h for _, h in bounds], np.int64)

    @F.pandas_udf("array<long>")
    def runs(keys: pd.Series, of: pd.Series) -> pd.Series:
        """The run of a row; for the first row of a run, the run before too."""
        k, h = keys.to_numpy(), of.to_numpy()
        low, high = np.searchsorted(ids, k, side="left"), np.searchsorted(ids, k, side="right")
        run = high - 1
        for one in np.unique(k[high - low > 1]):
            at = np.flatnonzero(k == one)
            a, b = low[at[0]], high[at[0]]
            run[at] = a + np.searchsorted(hashes[a:b], h[at], side="right") - 1
        first = (ids[run] == k) & (hashes[run] == h)
        return pd.Series([[r, (r - 1) % len(ids)] if f and len(ids) > 1 else [r] for r, f in zip(run.tolist(), first.tolist(), strict=True)])

    dealt = keyed.withColumn("runs", runs("k", "h")).select("k", "h", "none", "text", F.explode("runs").alias("run"), F.element_at("runs", 1).alias("home"))
    dealt = dealt.select("run", (F.col("run") != F.col("home")).alias("guest"), "k", "h", "none", "text")
    width = F.lit(len(bounds))
    order = dealt.repartitionByRange(parts, "run").sortWithinPartitions("run", "guest", "k", "h", "text").select("run", "guest", "k", "none", "text", width.alias("width"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held, nxt, canon, canon_next):
            k, none, text = held
            n = len(text)
            cut = n // edit_share
            edited = text[: n - cut] + nxt[:cut]
            canon_edited = canonical(edited)
            return (None if none else k, n, hashlib.sha256(encode(edited)).hexdigest(), digest(canon), hashlib.sha256(canon).digest(), digest(canon_edited), float(canon == canon_edited), float(canon == canon_next))

        held, canon, run, first, waits = None, b"", None, None, False
        rows = []
        for batch in batches:
            for r, guest, k, none, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if r != run:
                    if held is not None:
                        rows.append(made(held, first, canon, canonical(first)))
                    held, run, first, waits = None, r, None, True
                if guest and not waits:
                    continue
                now = canonical(text)
                if held is not None:
                    rows.append(made(held, text, canon, now))
                if guest:
                    held, waits = None, False
                else:
                    first = text if first is None else first
                    held, canon = (k, none, text), now
            if len(rows) >= 1000:
                yield _batch(rows)
                rows = []
        if held is not None:
            rows.append(made(held, first, canon, canonical(first)))
        if rows:
            yield _batch(rows)

    marked = saved(order.mapInArrow(stream, "doc_id long, n_chars long, edited_sha256 string, bucket string, sha binary, edited_bucket string, near_edited double, near_next double"), "fingerprints")
    out = _distinguished(marked, source, marked, "bucket")
    return out.select("doc_id", "n_chars", "edited_sha256", F.col("bucket").alias("fingerprint"), F.col("edited_bucket").alias("edited_fingerprint"), "near_edited", "near_next")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.float64(), pa.float64())
    names = ("doc_id", "n_chars", "edited_sha256", "bucket", "sha", "edited_bucket", "near_edited", "near_next")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
