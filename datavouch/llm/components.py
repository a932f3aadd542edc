"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datavouch.llm.common import saved, split_join


def _to_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (a, b) with the least neighbour m of a; those of a node with many are dealt to several tasks."""
    return split_join(edges, least.select("a", "m"), ["a"], least.select("a", "n"), F.xxhash64("b"), "inner")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
    return _to_least(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = saved(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    moved = _to_least(down, least).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def connected(nodes: DataFrame, edges: DataFrame, most: int = 60) -> DataFrame:
    """(fp, component_id): nodes are (fp, rep), edges (a, b) over fp; component_id is the smallest
    rep of the component. Every round is written to the shared folder, so lost executors cost one
    round at most. Raises if ``most`` rounds don't suffice (their number grows with the logarithm
    of the longest path). No edges: every node is its own component."""
    state = saved(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    mark = None
    for _ in range(most):
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now.n == 0 or now == mark:
            break
        mark = now
        state = saved(_small_star(saved(_large_star(state), "stars")), "edges")
    else:
        raise RuntimeError("the components did not settle")
    root = saved(nodes.join(state.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "roots")
    best = root.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    return split_join(root, best.select("root", "component_id"), ["root"], best.select("root", "n"), F.xxhash64("fp"), "inner").select("fp", "component_id")
