"""URL filters: a sort-merge range join of pages with prefix rules, in DataFrame operations only.

A host's key is its labels in reverse, each followed by a slash (``com/example/``), which no host holds. The keys that
start with a rule's key, its host and all subdomains, are an interval of the sorted keys; so are the
paths that start with the rule's path. Intervals of prefixes are nested or apart, so a sweep over
starts, ends and pages in the order of keys needs only a stack of the rules that are open: the
number of starts less ends so far is its height, and its member at a height is the last start there.

Pages are swept twice: over the hosts of rules, which gives each page the sites it lies in, and
within each site over the paths of its rules, where the top of the stack is the longest that fits.
Keys are bytes; an end is its start followed by 0xFF, which no UTF-8 text holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datavouch.llm.common import ascii_lower, saved, sent, split_join

#: Pages that are swept together, at least; larger groups are split, and the rules go to each part.
SWEEP_ROWS = 2000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"\A[^/?#]*", 0)), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def _key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/"))


def _rules(rules: DataFrame) -> DataFrame:
    """(site, path, size, host_length, rule, verdict), one row for each host and path."""
    own = rules.filter("host is not null and path is not null").select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
    own = own.groupBy("host", "path").agg(F.when(F.bool_or(F.col("verdict") == "block"), "block").otherwise("allow").alias("verdict"))
    rule = F.concat("host", "path")
    return own.select(_key(F.col("host")).alias("site"), "path", F.length(rule).alias("size"), F.length("host").alias("host_length"), rule.alias("rule"), "verdict")


def _edges(starts: DataFrame, group: list[str], text: str) -> DataFrame:
    """Starts and ends of intervals: (*group, key, step), with the columns of ``starts``. ``level`` is
    the height of the stack after the event; a start is on top of it."""
    key = F.encode(text, "UTF-8")
    up = starts.withColumns({"key": key, "step": F.lit(1)})
    down = starts.withColumns({"key": F.concat(key, F.unhex(F.lit("FF"))), "step": F.lit(-1)})
    height = Window.partitionBy(*group).orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return up.unionByName(down).withColumn("level", F.sum("step").over(height))


def _parts(probes: DataFrame, group: list[str], rules: DataFrame) -> DataFrame:
    """(*group, parts): how many parts the probes of a group are swept in."""
    n = rules.groupBy(*group).agg(F.count("*").alias("rules"))
    return probes.groupBy(*group).agg(F.count("*").alias("n")).join(n, group).select(*group, F.ceil(F.col("n") / F.greatest(F.lit(SWEEP_ROWS), 4 * F.col("rules"))).cast("int").alias("parts"), "n")


def _dealt(probes: DataFrame, edges: DataFrame, group: list[str], rules: DataFrame, columns: list[str]) -> DataFrame:
    """Edges and probes of one sweep, in parts: (*group, part, key, kind, ...). Probes without any
    rule in their group are left out."""
    parts = saved(_parts(probes, group, rules), "parts")
    few = sent(parts.select(*group, "parts"))
    left = probes.join(few, group) if few is not parts else split_join(probes, parts.select(*group, "parts"), group, parts.select(*group, "n"), F.xxhash64("host", "path"), "inner")
    left = left.withColumns({"part": F.pmod(F.xxhash64("host", "path"), F.col("parts")).cast("int"), "kind": F.lit(1)}).drop("parts")
    right = edges.join(few, group).withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "kind": F.lit(0)}).drop("parts")
    return right.select(*group, "part", "key", "kind", *columns).unionByName(left.select(*group, "part", "key", "kind", "host", "path"), allowMissingColumns=True)


def _in_sites(probes: DataFrame, ruled: DataFrame) -> DataFrame:
    """(host, path, site): the sites that each probe lies in, from the sweep over hosts."""
    sites = saved(ruled.groupBy("site").agg(F.count("*").alias("n")).select(F.split_part("site", F.lit("/"), F.lit(1)).alias("first"), "site"), "sites")
    edges = saved(_edges(sites, ["first"], "site"), "site_edges")
    deepest = edges.agg(F.max("level")).first()[0] or 0
    probes = probes.withColumns({"first": F.element_at(F.split("host", r"\."), -1), "key": F.encode(_key(F.col("host")), "UTF-8")})
    events = _dealt(probes, edges, ["first"], sites, ["site", "step", "level"])
    sweep = Window.partitionBy("first", "part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = lambda k: F.last(F.when((F.col("step") == 1) & (F.col("level") == k), F.col("site")), ignorenulls=True).over(sweep)
    height = F.coalesce(F.last("level", ignorenulls=True).over(sweep), F.lit(0))
    open_ = F.slice(F.array(*[at(k + 1) for k in range(deepest)]), F.lit(1), height) if deepest else F.array().cast("array<string>")
    return events.withColumn("open", open_).filter("kind = 1").select("host", "path", F.explode("open").alias("site"))


def _in_paths(inside: DataFrame, ruled: DataFrame) -> DataFrame:
    """(host, path, best): the longest rule of each site that a probe lies in, from the sweep over
    paths. What lies under a start is the start itself; under an end, the last start one level up."""
    edges = _edges(ruled.withColumn("own", F.struct("size", "host_length", "rule", "verdict")), ["site"], "path")
    below = Window.partitionBy("site", "level").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.when(F.col("level") > 0, F.last(F.when(F.col("step") == 1, F.col("own")), ignorenulls=True).over(below))
    edges = saved(edges.withColumn("top", F.struct(top.alias("r"))).select("site", "key", "top"), "path_edges")
    events = _dealt(inside.withColumn("key", F.encode("path", "UTF-8")), edges, ["site"], ruled, ["top"])
    sweep = Window.partitionBy("site", "part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("best", F.last("top", ignorenulls=True).over(sweep)["r"]).filter("kind = 1 and best is not null")
    return swept.select("host", "path", "best")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all subdomains
    where the path starts with the rule's; the longest host and path wins (equal lengths: the longer
    host, then the greater text; the same rule twice with both verdicts blocks). Rules without a host
    or path are none. Pages without a rule have a null rule and the verdict ``default``. Null URLs
    and those without ``://`` have an empty host and path; URLs are taken whole, in time linear in
    their length. Repeated rows are kept; other columns of either table are left out, whatever their
    names. Empty tables work.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = saved(pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")), "parsed")
    ruled = saved(_rules(rules), "rules")
    counts = saved(parsed.groupBy("host", "path").agg(F.count("*").alias("n")), "urls")
    found = _in_paths(_in_sites(counts.select("host", "path"), ruled), ruled)
    best = found.groupBy("host", "path").agg(F.max("best").alias("best"))
    out = split_join(parsed, best, ["host", "path"], counts, F.xxhash64("page_id"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
