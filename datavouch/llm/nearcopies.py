"""Near copies by Jaccard similarity of five-word shingles, for the pipeline.

Rows with equal sets of shingles are one node. The first candidates are op2's: nodes whose SimHash
fingerprints over the same shingles differ in at most two bits, found by generalised pigeonhole;
the exact similarity of the sets then decides. Pairs at similarity 0.8 differ in up to 14 bits, a
radius at which no group of bits prunes, so further candidates are nodes, not yet of one component,
that agree in one of 32 bands of five min-hashes (a pair at 0.8 misses all bands with probability
3e-6, above it with less), decided in the same way. The nodes of a band value are not compared pair by
pair: in each round one of them, the centre, is compared with those of other components, after which
all its links there are known and it leaves. A value is done when what is left of it lies in one
component. What is still open after ``ROUNDS`` rounds, nodes that are alike in a band but not
similar, is compared where sets share one of their rarest hashes, as similar sets must; how many sets
hold a hash is counted by a shuffle, and hashes in very many sets are dealt to several tasks. So the
work is linear in a group of similar nodes, and no link of components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datavouch.llm import simhash
from datavouch.llm.common import claim, saved, split_join
from datavouch.llm.components import connected

WIDTH = 5
BANDS, ROWS = 32, 5
#: Rounds in which one node of each band value is compared with the others.
ROUNDS = 2
_DRAW = np.random.default_rng(42)
_TIMES = _DRAW.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False)[:, None] | np.uint64(1)
_PLUS = _DRAW.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False)[:, None]


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles (A-Z lower-cased; fewer words: all of them)."""
    return np.unique(simhash.shingle_hashes(text, width))


def signature(found: np.ndarray) -> np.ndarray:
    """The min-hashes of a set that isn't empty."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 1024):
        np.minimum(out, (found[i : i + 1024] * _TIMES + _PLUS).min(axis=1), out=out)
    return out


def _features(rows: DataFrame) -> DataFrame:
    """(row, fp, sim, bands, sketch) of (row, text); fp stands for the set, sim is the SimHash fingerprint,
    sketch has a byte a min-hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("nearcopies")
        for batch in batches:
            fps, sims, bands, sketches = [], [], [], []
            for text in batch.column(1):
                hashes = simhash.shingle_hashes(text.as_py(), WIDTH)
                sims.append(simhash.folded(hashes))
                found = np.unique(hashes)
                fps.append(xxhash.xxh3_64_intdigest(found.tobytes()))
                sig = signature(found) if len(found) else np.zeros(0, np.uint64)
                raw = sig.tobytes()
                bands.append(np.fromiter((xxhash.xxh3_64_intdigest(raw[k * ROWS * 8 : (k + 1) * ROWS * 8], k) for k in range(BANDS if raw else 0)), np.uint64).view(np.int64))
                sketches.append((sig >> np.uint64(8)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(np.array(sims, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["row", "fp", "sim", "bands", "sketch"])

    return rows.mapInArrow(run, "row long, fp long, sim long, bands array<long>, sketch binary")


def _sets(rows: DataFrame) -> DataFrame:
    """(fp, found) of (fp, text): the hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["fp", "found"])

    return rows.mapInArrow(run, "fp long, found binary")


def _agree(x: bytes, y: bytes) -> bool:
    """Whether the sketches leave similarity 0.8 open (128 of 160 bytes agree there, give or take 5)."""
    return int((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum()) >= 0.55 * len(x)


def _similar(x: bytes, y: bytes) -> bool:
    """Whether the sets' Jaccard similarity is 0.8 or more."""
    short, long = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    if 5 * len(short) < 4 * len(long):
        return False
    at = np.minimum(np.searchsorted(long, short), len(long) - 1)
    both = int((long[at] == short).sum())
    return 5 * both >= 4 * (len(short) + len(long) - both)


def _filtered(pairs: DataFrame, values: DataFrame, column: str, test) -> DataFrame:
    """The pairs (a, b) whose values of ``column`` in (fp, column) pass the test. ``a`` may be the
    centre of many pairs, whose rows are dealt to several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [test(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    per = pairs.groupBy("a").agg(F.count("*").alias("n"))
    one = split_join(pairs, values.select(F.col("fp").alias("a"), F.col(column).alias("x")), ["a"], per, F.xxhash64("b"), "inner")
    two = one.join(values.select(F.col("fp").alias("b"), F.col(column).alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of similarity 0.8 or more; nodes (fp, row, sketch), rows (row, text)."""
    pairs = saved(pairs.distinct(), "pairs")
    open_ = saved(_filtered(pairs, nodes, "sketch", _agree), "open")
    ends = open_.select(F.col("a").alias("fp")).unionByName(open_.select(F.col("b").alias("fp"))).distinct()
    texts = rows.join(nodes.join(ends, "fp", "left_semi").select("row", "fp"), "row").select("fp", "text")
    return saved(_filtered(open_, saved(_sets(texts), "sets"), "found", _similar), "links")


def _tokens(sets: DataFrame) -> DataFrame:
    """(fp, h): the hashes of the sets (fp, found), a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, data in zip(batch.column(0), batch.column(1), strict=True):
                own = np.frombuffer(data.as_py(), np.uint64).view(np.int64)
                for i in range(0, len(own), 1 << 16):
                    h = own[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), fp.as_py())), pa.array(h)], ["fp", "h"])

    return sets.select("fp", "found").mapInArrow(run, "fp long, h long")


def _prefix_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of the sets (fp, c, found) of different components that can reach 0.8: with the
    hashes of each set in one order, those in the fewest sets first, such sets share one among the
    first ``size - ceil(0.8 size) + 1`` of both (any order is right; this one makes few pairs), and what
    comes after the first that they share must suffice for 4/9 of both sizes. A hash that one set
    alone holds takes its place in the order, and then is left out; so is one whose sets are all of
    one component."""
    tokens = saved(_tokens(sets), "tokens")
    times = saved(tokens.groupBy("h").agg(F.count("*").alias("n")), "times")
    known = split_join(tokens, times.select("h", "n"), ["h"], times.select("h", "n"), F.xxhash64("fp"), "inner")
    order = F.array_sort(F.collect_list(F.struct("n", "h")))  # a set's own hashes, as many as its text has
    ranked = known.groupBy("fp").agg(order.alias("o")).withColumn("size", F.size("o"))
    first = F.slice("o", F.lit(1), F.col("size") - F.ceil(F.col("size") * 4 / 5).cast("int") + 1)
    prefix = ranked.select("fp", "size", F.posexplode(first).alias("at", "t")).select("fp", "size", "at", "t.h", "t.n").filter("n > 1")
    prefix = saved(prefix.join(sets.select("fp", "c"), "fp"), "prefixes")
    shared = saved(prefix.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).filter("low <> high").select("h", "n"), "shared")
    kept = split_join(prefix.drop("n"), shared, ["h"], shared, F.xxhash64("fp"), "inner").drop("n")
    return _met(saved(kept, "met"), shared)


#: Sets of one hash that are compared with each other in one task, at most.
LOT = 2000


def _met(kept: DataFrame, shared: DataFrame) -> DataFrame:
    """The pairs of rows (h, fp, c, size, at) of one hash that pass the tests. The rows of a hash are
    dealt into lots, and each pair of lots is a task's, so no task has all pairs of a hash."""
    lots = shared.select("h", F.ceil(F.col("n") / LOT).cast("int").alias("lots"))
    own = kept.join(lots, "h").withColumn("lot", F.pmod(F.xxhash64("fp"), F.col("lots")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("lots") - 1))
    left = own.withColumn("other_lot", every).drop("lots")
    right = own.withColumn("own_lot", every).select("h", F.col("own_lot").alias("lot"), F.col("lot").alias("other_lot"), F.col("fp").alias("b"), F.col("c").alias("other"), F.col("size").alias("m"), F.col("at").alias("there"))
    fits = "c < other and 5 * least(size, m) >= 4 * greatest(size, m) and 9 * least(size - at, m - there) >= 4 * (size + m)"
    return left.join(right, ["h", "lot", "other_lot"]).filter(fits).select(F.col("fp").alias("a"), "b")


#: Bits in which the SimHash fingerprints of the first candidates may differ.
TAU = 2


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of the nodes (fp, sim) by SimHash: a fingerprint's least node with its others, and with
    the least node of each fingerprint that is linked to it (``simhash.links``)."""
    heads = saved(nodes.groupBy("sim").agg(F.min("fp").alias("head"), F.count("*").alias("n")), "heads")
    own = split_join(nodes.select("fp", "sim"), heads.select("sim", "head"), ["sim"], heads.select("sim", "n"), F.xxhash64("fp"), "inner")
    near = saved(simhash.links(heads.select(F.col("sim").alias("fp")), TAU), "near")
    of = lambda end, name: heads.select(F.col("sim").alias(end), F.col("head").alias(name))
    per = near.groupBy("a").agg(F.count("*").alias("n"))
    met = split_join(near, of("a", "x"), ["a"], per, F.xxhash64("b"), "inner").join(of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return own.filter("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b")).unionByName(met)


def _of_several(members: DataFrame) -> DataFrame:
    """The members (v, fp, c, ...) of band values whose nodes are of several components."""
    mixed = members.groupBy("v").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("v", "n")
    return split_join(members, mixed.select("v"), ["v"], mixed, F.xxhash64("fp"), "inner")


def links(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): pairs of similarity 0.8 or more whose components are those of all such candidates."""
    found = _verified(_fingerprint_pairs(nodes.filter(F.size("bands") > 0)), nodes, rows)
    component = connected(nodes.select("fp", F.col("fp").alias("rep")), found)
    buckets = nodes.select("fp", F.explode("bands").alias("v"))
    sizes = buckets.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1")
    member = split_join(buckets, sizes, ["v"], sizes, F.xxhash64("fp"), "inner").select("v", "fp", "n")
    member = saved(member.join(component.select("fp", F.col("component_id").alias("c")), "fp"), "members")
    member = saved(_of_several(member), "members")
    weight = member.groupBy("fp").agg(F.sum("n").alias("w"))  # the nodes amid most others come first
    member = saved(member.join(weight, "fp").select("v", "fp", "w", "c"), "members")
    for _ in range(ROUNDS):
        centre = member.groupBy("v").agg(F.max(F.struct("w", "fp", "c")).alias("centre"), F.count("*").alias("n"))
        met = split_join(member, centre.select("v", "centre"), ["v"], centre.select("v", "n"), F.xxhash64("fp"), "inner")
        fresh = _verified(met.filter("c <> centre.c").select(F.col("centre.fp").alias("a"), F.col("fp").alias("b")), nodes, rows)
        found = found.unionByName(fresh)
        component = connected(nodes.select("fp", F.col("fp").alias("rep")), found)
        left = met.filter("fp <> centre.fp").select("v", "fp", "w").join(component.select("fp", F.col("component_id").alias("c")), "fp")
        left = saved(left, "left")
        member = saved(_of_several(left), "members")
        if member.isEmpty():
            return found
    open_ = saved(member.groupBy("fp").agg(F.first("c").alias("c")), "open")
    texts = rows.join(nodes.join(open_, "fp", "left_semi").select("row", "fp"), "row").select("fp", "text")
    sets = saved(_sets(texts).join(open_, "fp"), "open_sets")
    return found.unionByName(_verified(_prefix_pairs(sets), nodes, rows))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of rows whose similarity is 0.8 or more: that of the
    smallest id (nulls last), then of the smallest hash of the text.

    Rows count, not ids: repeated rows and rows with null ids are copies like any other, and a row
    whose text is no copy stays whatever its id. Null texts and those without words are equal.
    """
    tagged = saved(docs.withColumn("row", F.monotonically_increasing_id()), "tagged")
    rows = tagged.select("row", F.col(text_col).alias("text"))
    features = saved(_features(rows), "features")
    order: Column = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"), "row")
    keyed = tagged.select("row", order.alias("order")).join(features.select("row", "fp"), "row")
    best = saved(keyed.groupBy("fp").agg(F.min("order").alias("rep")), "nodes")
    nodes = saved(features.join(best.select(F.col("rep.row").alias("row")), "row", "left_semi"), "node_features")
    kept = connected(best, links(nodes, rows)).select(F.col("component_id.row").alias("row")).distinct()
    gone = features.select("row").join(kept, "row", "left_anti")
    return tagged.join(gone, "row", "left_anti").select(*docs.columns)
