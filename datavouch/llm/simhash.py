"""SimHash near-duplicate detection with the generalised pigeonhole principle.

A fingerprint has 64 bits. Two fingerprints are linked if at most ``tau`` bits differ. The bits are
put into ``m`` groups of strongly correlated bits. If the groups have the thresholds e_1..e_m with
sum tau - m + 1 (-1: group not probed), then linked fingerprints differ in at most e_i bits within
at least one group i. The thresholds come from a dynamic program over the candidates expected for
each group and threshold; these estimates use counts over all fingerprints.

Groups of copies stay linear: equal fingerprints are one node, and fingerprints that share a very
common group value meet through their neighbours at one bit instead of pair by pair (see ``_star``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datavouch.llm.common import encode, saved, split_join
from datavouch.llm.components import connected

BITS = 64
#: Group values held by more fingerprints than this are linked through one-bit neighbours.
HOT = 48
_SPLIT = re.compile(rb"[^\x20\x09-\x0d]+")
_WEIGHTS = np.uint64(1) << np.arange(BITS, dtype=np.uint64)


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    """The hashes of the shingles of ``width`` words in their order, repeats included (A-Z lower-cased; fewer
    words: one of all of them; no words: none)."""
    words = encode(text).lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    buffer = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(buffer, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = n - width + 1
    return np.fromiter((digest(buffer[a:b], seed) for a, b in zip(starts[:k].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, k)


def folded(hashes: np.ndarray) -> int:
    """SimHash of shingle hashes: a bit is set if it is set in over half of them. Of none: 0."""
    k = len(hashes)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, k, 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_WEIGHTS[counts * 2 > k].sum(dtype=np.uint64)) if (counts * 2 > k).any() else 0


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of one text over its shingles of ``width`` words. Without words: 0."""
    return folded(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long. Null texts have no words."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


@dataclass(frozen=True)
class Plan:
    """Bit groups and how many bits may differ within each (-1: the group isn't probed)."""

    groups: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def _bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, in how many both are set (64 x 64)."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        n = 0
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
            n += len(fps)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS), pa.int32()), pa.array(total.ravel()), pa.array(np.full(BITS * BITS, n))], ["cell", "both", "n"])

    rows = nodes.select("fp").mapInArrow(gram, "cell int, both long, n long").groupBy("cell").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS, np.int64)
    for r in rows:
        both[r.cell] = r.both
    return (rows[0].n if rows else 0), both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> tuple[tuple[int, ...], ...]:
    """Puts the bits into ``m`` groups of equal size, each grown from its most correlated bits."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, groups = list(range(BITS)), []
    for i in range(m):
        size = (BITS - sum(map(len, groups))) // (m - i)
        seed = max(left, key=lambda b: (corr[b, [x for x in left if x != b]].sum() if len(left) > 1 else 0, -b))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(tuple(sorted(group)))
    return tuple(groups)


def _ball(width: int, e: int) -> int:
    return sum(len(list(combinations(range(width), k))) if k > 1 else (1, width)[k] for k in range(e + 1))


def allocate(costs: list[dict[int, float]], total: int) -> tuple[int, ...]:
    """Thresholds of least total cost whose sum is ``total``: dynamic programming over the groups."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for cost in costs:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for s, (c, chosen) in best.items():
            for e, more in cost.items():
                x = (c + more, (*chosen, e))
                if s + e not in step or x < step[s + e]:
                    step[s + e] = x
        best = step
    return best[total][1]


def _group_value(groups: tuple[tuple[int, ...], ...], i: int):
    mask = sum(1 << b for b in groups[i])
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def plan(nodes: DataFrame, tau: int, choices: tuple[int, ...] = (2, 3)) -> Plan:
    """Groups and thresholds for all distinct fingerprints ``nodes`` (fp): of the numbers of groups in
    ``choices`` and the thresholds that the dynamic program finds for each, the cheapest. More
    fingerprints make fewer, wider groups the cheaper, so buckets don't fill up as the table grows."""
    n, both = _bit_statistics(nodes)
    if not n:
        m = choices[0]
        return Plan(tuple(tuple(range(BITS * i // m, BITS * (i + 1) // m)) for i in range(m)), (tau - m + 1, *[0] * (m - 1)))
    grouped = {m: group_bits(n, both, m) for m in choices}
    values = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("g"), _group_value(groups, i).alias("v")) for m, groups in grouped.items() for i in range(m)]
    counted = nodes.select(F.explode(F.array(*values)).alias("x")).groupBy("x.m", "x.g", "x.v").agg(F.count("*").cast("double").alias("c"))
    squares = {(r.m, r.g): r.s for r in counted.groupBy("m", "g").agg(F.sum(F.col("c") * F.col("c")).alias("s")).collect()}
    p = np.diag(both) / n
    found = []
    for m, groups in grouped.items():
        costs = []
        for i, bits in enumerate(groups):
            equal = p[list(bits)] ** 2 + (1 - p[list(bits)]) ** 2
            odds = (1 - equal) / np.maximum(equal, 1e-9)
            one, two = odds.sum(), (odds.sum() ** 2 - (odds**2).sum()) / 2
            near = [1.0, 1.0 + one, 1.0 + one + two]
            cost = {-1: 0.0}
            for e in range(min(tau, 2) + 1):
                cost[e] = n * _ball(len(bits), e) + squares[m, i] * near[e]
            costs.append(cost)
        chosen = allocate(costs, tau - m + 1)
        found.append((sum(c[e] for c, e in zip(costs, chosen, strict=True)), Plan(groups, chosen)))
    return min(found, key=lambda x: x[0])[1]


def _flips(bits: tuple[int, ...], most: int) -> list[int]:
    """Masks, as signed longs, that flip up to ``most`` of the bits."""
    out = [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(bits, k)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def _star(hot: DataFrame) -> DataFrame:
    """Links among fingerprints within two bits, without pairs: both have a common neighbour at one
    bit, so each sends itself to its 65 values within one bit, and those that meet at a value are
    linked to the smallest there. At most 65 different fingerprints meet at a value."""
    flips = F.explode(F.array(*[F.lit(x) for x in _flips(tuple(range(BITS)), 1)]))
    met = hot.select("fp", flips.alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    return met.groupBy("z").agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1).select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a <> b").distinct()


def links(nodes: DataFrame, tau: int = 2, choices: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(a, b) among distinct fingerprints whose connected components are those of all pairs that
    differ in at most ``tau`` bits (tau 0 to 2; every returned pair does so).

    Buckets of more than ``HOT`` fingerprints, which only dense clusters fill, are linked in linear
    time through one-bit neighbours; both ways give whole components."""
    if tau not in (0, 1, 2):
        raise ValueError(f"tau must be 0, 1 or 2, not {tau}")
    if tau == 0:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    chosen = plan(nodes, tau, choices)
    buckets = None
    for i, e in enumerate(chosen.thresholds):
        if e < 0:
            continue
        value = _group_value(chosen.groups, i)
        own = nodes.select("fp", F.lit(i).alias("g"), value.alias("v"), F.lit(0).alias("probe"))
        if e:
            flips = F.explode(F.array(*[F.lit(x) for x in _flips(chosen.groups[i], e)[1:]]))
            own = own.unionByName(nodes.select("fp", flips.alias("f")).select("fp", F.lit(i).alias("g"), value.bitwiseXOR(F.col("f")).alias("v"), F.lit(1).alias("probe")))
        buckets = own if buckets is None else buckets.unionByName(own)
    sizes = buckets.groupBy("g", "v").agg(F.count("*").alias("size"), F.min("probe").alias("indexed")).filter("size > 1 and indexed = 0").select("g", "v", "size")
    shared = saved(split_join(buckets, sizes, ["g", "v"], sizes.select("g", "v", F.col("size").alias("n")), F.xxhash64("fp"), "inner"), "buckets")
    hot = shared.filter(F.col("size") > HOT).select("fp").distinct()
    few = shared.filter(F.col("size") <= HOT).groupBy("g", "v").agg(F.collect_list(F.when(F.col("probe") == 0, F.col("fp"))).alias("own"), F.collect_list("fp").alias("all"))
    pairs = few.select(F.explode("own").alias("a"), "all").select("a", F.explode("all").alias("b")).filter("a <> b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.unionByName(_star(hot) if tau == 2 else _pairs_one(hot))


def _pairs_one(hot: DataFrame) -> DataFrame:
    """Pairs that differ in one bit: each fingerprint looks up its 64 neighbours."""
    flips = F.explode(F.array(*[F.lit(x) for x in _flips(tuple(range(BITS)), 1)[1:]]))
    return hot.select(F.col("fp").alias("a"), flips.alias("f")).select("a", F.col("a").bitwiseXOR(F.col("f")).alias("b")).filter("a < b").join(hot.select(F.col("fp").alias("b")), "b").select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 3, tau: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest id that can be reached through links of at most ``tau`` bits.
    Null and empty texts have the fingerprint zero and are linked like any other; texts are taken
    whole, however long. A null id keeps its fingerprint and takes part in its group; a group of null
    ids alone has a null component_id. Repeated rows are kept. Other columns of ``docs``, whatever
    their names, are left out. An empty table gives no rows.
    """
    fps = saved(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    component = connected(nodes.select("fp", "rep"), links(nodes.select("fp"), tau))
    out = split_join(fps, component, ["fp"], nodes.select("fp", "n"), F.xxhash64("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
