"""How filters share their removals: all orders of the filters, read from the lattice of their subsets.

A state is the set S of filters applied so far, an edge adds one filter f to it. An edge removes the
documents that fail f and no filter of S, so one table of edges (k * 2^(k-1) a part) holds what each
step of all k! orders does. The orders that reach a state (paths forward) and leave the next one
(paths backward) are counted over the lattice; their product weights the edge's removals, and the
weighted sum over f's edges is its removals in all orders, k! times its Shapley value. Documents are
read once and only counted: cells of (part, failed filters, labels) go into the edges.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datavouch.llm.common import saved, split_join

#: The lattice has 2^k states and the report k! orders.
MOST_FILTERS = 8


def path_counts(k: int) -> tuple[list[int], list[int]]:
    """For each state, as a bit set: how many orders reach it from none, and leave it for all."""
    forward, backward = [0] * (1 << k), [0] * (1 << k)
    forward[0] = backward[-1] = 1
    for s in range(1 << k):
        for f in range(k):
            if not s >> f & 1:
                forward[s | 1 << f] += forward[s]
    for s in reversed(range(1 << k)):
        for f in range(k):
            if not s >> f & 1:
                backward[s] += backward[s | 1 << f]
    return forward, backward


def lattice(k: int) -> list[tuple[int, int, int]]:
    """(state, filter, weight) of all edges; the weight is the number of orders through the edge."""
    forward, backward = path_counts(k)
    return [(s, f, forward[s] * backward[s | 1 << f]) for s in range(1 << k) for f in range(k) if not s >> f & 1]


def orders(names: Iterable[str]) -> list[tuple[str, int, int, int]]:
    """(filter_order, step, state before it, filter) for every step of every order."""
    names = list(names)
    out = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(names[i] for i in order), step, state, f))
            state |= 1 << f
    return out


def first_copies(rows: DataFrame, id_col: str, digest_col: str) -> DataFrame:
    """``rows`` with ``copy``: whether a row of a smaller id has the same digest. Null ids are neither
    smaller nor larger than any."""
    groups = saved(rows.groupBy(digest_col).agg(F.min(id_col).alias("_first"), F.count("*").alias("n")).filter("n > 1"), "copies")
    out = split_join(rows, groups.select(digest_col, "_first"), [digest_col], groups.select(digest_col, "n"), F.xxhash64(id_col))
    return out.withColumn("copy", F.coalesce(F.col(id_col) > F.col("_first"), F.lit(False))).drop("_first")


def cells(rows: DataFrame, names: list[str]) -> DataFrame:
    """(part, failed, good, toxic, n) of rows (part, a boolean for each of ``names``, good, toxic)."""
    failed = sum((F.when(F.col(c), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(names)), F.lit(0))
    return rows.select("part", failed.cast("int").alias("failed"), "good", "toxic").groupBy("part", "failed", "good", "toxic").agg(F.count("*").alias("n"))


def edges(counted: DataFrame, k: int) -> DataFrame:
    """What each edge of the lattice does in each part: (part, state, filter, weight, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost), zeros included."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(w).cast("long").alias("weight")) for s, f, w in lattice(k)]))
    e = counted.select("*", each.alias("e")).select("part", "failed", "good", "toxic", "n", "e.*")
    bit = F.expr("shiftleft(1, filter)")
    fails, before = F.col("failed").bitwiseAND(bit) != 0, F.col("failed").bitwiseAND(F.col("state")) != 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0).cast("long")))
    here = fails & ~before
    return e.groupBy("part", "state", "filter", "weight").agg(
        total(~fails & ~before).alias("kept"),
        total(here).alias("removed"),
        total(fails & before).alias("redundant"),
        total(F.col("failed") == bit).alias("unique_fails"),
        total(here & F.col("good")).alias("good_lost"),
        total(here & F.col("toxic")).alias("toxic_lost"),
    )


def interactions(counted: DataFrame, names: list[str]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley):
    a row for each part of the cells, order of the filters and step, zeros included. ``shapley`` sums
    what the step's filter removes over all orders. More than ``MOST_FILTERS`` filters are refused.
    No cells, no rows."""
    if len(names) > MOST_FILTERS:
        raise ValueError(f"{len(names)} filters have too many orders; at most {MOST_FILTERS}")
    spark = counted.sparkSession
    done = saved(edges(counted, len(names)), "edges")
    shares = done.groupBy("part", "filter").agg(F.sum(F.col("weight") * F.col("removed")).alias("shapley"))
    steps = spark.createDataFrame(orders(names), "filter_order string, step int, state int, filter int")
    out = done.join(shares, ["part", "filter"]).join(F.broadcast(steps), ["state", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions of a text alone: A: under 200 words; B: under half of the words distinct;
    C: over 2 % capitals A-Z; D: special characters. Words are maximal runs of other than ASCII white space."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals.cast("long") > 2 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The interactions of five filters over whole texts: those of ``text_failures`` and E: the text is
    identical to that of a smaller id, anywhere in the table.

    Null texts and parts are as empty ones. Documents without a label are neither good nor toxic; of
    repeated labels of one id any that says so counts; rows with null ids have no label and are
    nobody's copies. Repeated rows count each. Other columns are left out whatever their names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    rows = saved(source.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in text_failures(F.col("text")).items()]), "failures")
    marked = first_copies(rows, "doc_id", "digest").withColumnRenamed("copy", "E").withColumn("spread", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(1000))).otherwise(0))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    joined = marked.join(marks.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")}
    names = ["A", "B", "C", "D", "E"]
    return interactions(saved(cells(joined.withColumns(flags), names), "cells"), names)
