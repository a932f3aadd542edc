"""Comparison of methods: exact ratios by stratum, paired divergence, cluster bootstrap."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datavouch.functions.tables import written


def ratio(num: Column | str, den: Column | str, scale: int = 6) -> Column:
    """Half-even ratio; null where the denominator is zero."""
    n, d = (F.col(c) if isinstance(c, str) else c for c in (num, den))
    return F.when(d != 0, F.bround(n.cast("decimal(20,0)") / d.cast("decimal(20,0)"), scale)).cast(f"decimal(20,{scale})")


def method_outcomes(runs: dict[str, DataFrame]) -> DataFrame:
    """(metodo, row_id, situacao): ALERTA, SEM_ALERTA or ABSTENCAO from the aggregates of each run;
    of a repeated row the alert counts first, then the abstention."""
    parts = []
    for name, aggs in runs.items():
        s = F.when(F.col("resultado") == "ALERTA", "ALERTA").when(F.col("resultado") == "ABSTENCAO", "ABSTENCAO").otherwise("SEM_ALERTA")
        parts.append(aggs.select(F.lit(name).alias("metodo"), "row_id", s.alias("situacao")))
    rank = F.when(F.col("situacao") == "ALERTA", 2).when(F.col("situacao") == "ABSTENCAO", 1).otherwise(0)
    return reduce(DataFrame.unionByName, parts).groupBy("metodo", "row_id").agg(F.max(rank).alias("_rank"), F.count("*").alias("vezes")).select("metodo", "row_id", F.when(F.col("_rank") == 2, "ALERTA").when(F.col("_rank") == 1, "ABSTENCAO").otherwise("SEM_ALERTA").alias("situacao"), "vezes")


def rule_outcomes(evals: DataFrame, methods: dict[str, list[str]]) -> DataFrame:
    """As ``method_outcomes`` of the aggregates of each method's rules, from evaluations by the rules of
    all methods: a record's states are brought together once, as one small number a method."""
    bit = F.when(F.col("estado") == "VIOLACAO", 4).when(F.col("estado") == "INCONCLUSIVO", 2).when(F.col("estado") == "CONFORME", 1).otherwise(0)
    names = {m: f"_m{i}" for i, m in enumerate(methods)}
    states = evals.groupBy("row_id").agg(*[F.bit_or(F.when(F.col("rule_id").isin(ids), bit)).alias(names[m]) for m, ids in methods.items()])
    has = lambda c, b: F.col(c).bitwiseAND(F.lit(b)) > 0
    said = lambda c: F.when(has(c, 4), "ALERTA").when(has(c, 2) | ~has(c, 1), "ABSTENCAO").otherwise("SEM_ALERTA")
    each = F.explode(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(m).alias("metodo"), said(c).alias("situacao"))) for m, c in names.items()]))
    return states.select("row_id", each.alias("m")).filter("m is not null").select("m.metodo", "row_id", "m.situacao", F.lit(1).cast("long").alias("vezes"))


def common_domain() -> Column:
    """Binary label and all observable fields present; no result of any method is used."""
    fields = ("instrumento", "procedimento", "cbo", "cnes", "competencia_atendimento", "competencia_processamento")
    return F.col("rotulo").isin("NAO_APROVADO", "APROVADO_TOTAL") & reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in fields))


# The metrics' names.
METRICS = ("cobertura_rejeicoes", "cobertura_verificabilidade", "precisao_alertas", "falsos_alertas_aprovacoes", "abstencao", "alerta_aprovacao_parcial", "rejeicoes_sem_alerta_fora_de_escopo_documentada", "rejeicoes_sem_alerta_causa_indeterminada")
OUT_OF_SCOPE = "FORA_DE_ESCOPO_DOCUMENTADA"
# End of the fixed values.


def _counts() -> dict[str, tuple[Column, Column]]:
    s, r = F.col("situacao"), F.col("rotulo")
    alert, gave_up = s == "ALERTA", s == "ABSTENCAO"
    every = F.lit(True)
    pairs = [(alert, r == "NAO_APROVADO"), (~gave_up, every), (r == "NAO_APROVADO", alert & r.isin("NAO_APROVADO", "APROVADO_TOTAL")), (alert, r == "APROVADO_TOTAL"), (gave_up, every), (alert, r == "APROVADO_PARCIAL")]
    documented, missed = F.col("causa").eqNullSafe(F.lit(OUT_OF_SCOPE)), (r == "NAO_APROVADO") & ~alert
    pairs += [(documented, missed), (~documented, missed)]
    return dict(zip(METRICS, pairs, strict=True))


def by_strata(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """(*keys, estrato, *aggs): TOTAL, the common domain and a stratum for each instrument, month and
    establishment, by grouping sets, so that rows are counted where they are before any is moved."""
    dims = {"instrumento": "instrumento", "competencia": "competencia_processamento", "estabelecimento": "cnes"}
    cut = df.withColumns({f"_{k}": F.concat(F.lit(f"{k}="), F.coalesce(F.col(c), F.lit("None"))) for k, c in dims.items()}).withColumn("_comum", F.when(common_domain(), "dominio_comum").otherwise(""))
    own, names = [F.col(k) for k in keys], ["_comum", *[f"_{k}" for k in dims]]
    grouped = cut.groupingSets([own, *[[*own, F.col(c)] for c in names]], *own, *[F.col(c) for c in names]).agg(F.coalesce(*names, F.lit("TOTAL")).alias("estrato"), *aggs)
    return grouped.filter("estrato <> ''").drop(*names)


def ratio_metrics(population: DataFrame, outcomes: DataFrame, methods: list[str]) -> DataFrame:
    """(metodo, metrica, estrato, numerador, denominador, valor). Rows without an outcome abstain.
    ``causa`` of the population says where a rejection is documented as out of scope. Each stratum's
    size is there once, as the metric ``tamanho_estrato`` of ``populacao``."""
    if "causa" not in population.columns:
        population = population.withColumn("causa", F.lit(None).cast("string"))
    cols = ("causa", "row_id", "rotulo", "instrumento", "procedimento", "cbo", "cnes", "competencia_atendimento", "competencia_processamento")
    wide = population.select(*cols).crossJoin(F.broadcast(outcomes.sparkSession.createDataFrame([(m,) for m in methods], "metodo string")))
    j = wide.join(outcomes.select("metodo", "row_id", "situacao"), ["metodo", "row_id"], "left").fillna({"situacao": "ABSTENCAO"})
    counts = _counts()
    aggs = [x for k, (n, d) in counts.items() for x in (F.count_if(n & d).alias(f"n_{k}"), F.count_if(d).alias(f"d_{k}"))]
    out = by_strata(j, ["metodo"], aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("metrica"), F.col(f"n_{k}").alias("numerador"), F.col(f"d_{k}").alias("denominador")) for k in counts]))
    found = out.select("metodo", "estrato", rows.alias("m")).select("metodo", "m.metrica", "estrato", "m.numerador", "m.denominador")
    size = by_strata(population, [], [F.count("*").alias("numerador")]).crossJoin(F.broadcast(population.agg(F.count("*").alias("denominador"))))
    found = found.unionByName(size.select(F.lit("populacao").alias("metodo"), F.lit("tamanho_estrato").alias("metrica"), "estrato", "numerador", "denominador"))
    return found.withColumn("valor", ratio("numerador", "denominador"))


def paired_divergence(population: DataFrame, outcomes: DataFrame, a: str, b: str) -> DataFrame:
    """(metrica, numerador, denominador, valor): rejections that one method alone alerts on, and rows
    on which both differ."""
    of = lambda m: F.max(F.when(F.col("metodo") == m, F.col("situacao")))
    both = outcomes.filter(F.col("metodo").isin(a, b)).groupBy("row_id").agg(of(a).alias("sa"), of(b).alias("sb"))
    j = population.select("row_id", "rotulo").join(both, "row_id", "left").fillna({"sa": "ABSTENCAO", "sb": "ABSTENCAO"})
    rejected = F.col("rotulo") == "NAO_APROVADO"
    only_a, only_b = (F.col("sa") == "ALERTA") & (F.col("sb") != "ALERTA"), (F.col("sb") == "ALERTA") & (F.col("sa") != "ALERTA")
    g = j.agg(F.count_if(rejected & only_a).alias("x"), F.count_if(rejected & only_b).alias("y"), F.count_if(F.col("sa") != F.col("sb")).alias("z"), F.count_if(rejected).alias("r"), F.count("*").alias("n"))
    row = lambda name, n, d: F.struct(F.lit(name).alias("metrica"), F.col(n).alias("numerador"), F.col(d).alias("denominador"))
    out = g.select(F.explode(F.array(row(f"so_{a}", "x", "r"), row(f"so_{b}", "y", "r"), row("discordancia", "z", "n"))).alias("m")).select("m.*")
    return out.withColumn("valor", ratio("numerador", "denominador"))


def cluster_sums(df: DataFrame, num: Column, den: Column, cluster: str, missing: str = "SEM_GRUPO") -> DataFrame:
    """(grupo, num, den): the only table that a bootstrap needs; rows without a cluster form one."""
    return df.groupBy(F.coalesce(F.col(cluster), F.lit(missing)).alias("grupo")).agg(F.count_if(num & den).alias("num"), F.count_if(den).alias("den")).filter("den > 0")


def draw(seed: int, rep: Column, pos: Column, n: Column) -> Column:
    """A number from 0 to n - 1 that only depends on seed, replicate and position."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), rep.cast("string"), pos.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), n)


#: Clusters whose sums every task may hold at most; more of them are joined instead.
SENT_CLUSTERS = 1_000_000


def _bootstrap_columns() -> list:
    return ["numerador", "denominador", ratio("numerador", "denominador").alias("valor"), "inferior", "superior", "replicas", "grupos"]


def cluster_bootstrap(sums: DataFrame, replicates: int = 2000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """One row: the ratio, the percentile interval over whole clusters drawn with replacement, and
    the number of valid replicates; null below two clusters. Replicates whose denominator is zero
    don't count. ``sums`` (grupo, num, den) is ranked by name; draws are counter-based, so the result
    doesn't depend on partitions. Each task draws some replicates from the sums, which it holds. A draw is a
    step or a row here; ``range_bootstrap`` is for very many clusters."""
    sums = written(sums, "sums")
    point = sums.agg(F.sum("num").alias("numerador"), F.sum("den").alias("denominador"), F.count("*").alias("grupos"))
    n = point.first().grupos
    reps = sums.sparkSession.range(replicates).select(F.col("id").alias("rep"))
    if n < 2:
        per = reps.select(F.lit(None).cast("double").alias("r"))
    elif n <= SENT_CLUSTERS:
        held = sums.agg(F.array_sort(F.collect_list(F.struct("grupo", "num", "den"))).alias("c")).select(F.col("c.num").alias("nums"), F.col("c.den").alias("dens"))
        at = lambda k: draw(seed, F.col("rep"), k, F.lit(n)).cast("int")
        zero = F.struct(F.lit(0).cast("long").alias("num"), F.lit(0).cast("long").alias("den"))
        add = lambda acc, k: F.transform(F.array(at(k)), lambda i: F.struct((acc["num"] + F.get("nums", i)).alias("num"), (acc["den"] + F.get("dens", i)).alias("den")))[0]
        drawn = reps.repartition(64).crossJoin(F.broadcast(held)).select(F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), zero, add).alias("t"))
        per = drawn.select(F.when(F.col("t.den") > 0, F.col("t.num").cast("double") / F.col("t.den")).alias("r"))
    else:
        ranked = _ranked(sums)
        every = reps.select("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("k"))
        picked = every.select("rep", draw(seed, F.col("rep"), F.col("k"), F.lit(n)).alias("pos")).join(ranked, "pos")
        per = picked.groupBy("rep").agg(F.sum("num").alias("num"), F.sum("den").alias("den")).select(F.when(F.col("den") > 0, F.col("num").cast("double") / F.col("den")).alias("r"))
    return point.crossJoin(_interval(per, level)).select(*_bootstrap_columns())


def _interval(per: DataFrame, level: float) -> DataFrame:
    tail = (1 - level) / 2
    return per.agg(F.bround(F.percentile("r", tail), 9).alias("inferior"), F.bround(F.percentile("r", 1 - tail), 9).alias("superior"), F.count("r").alias("replicas"))


def range_bootstrap(sums: DataFrame, replicates: int = 2000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """As ``cluster_bootstrap``, for any number of clusters in bounded memory and without a row a draw:
    other draws of the same distribution, split among ranges of clusters (``multinomial_replicates``)."""
    sums = written(sums, "sums")
    point = sums.agg(F.sum("num").alias("numerador"), F.sum("den").alias("denominador"), F.count("*").alias("grupos"))
    n = point.first().grupos
    none = sums.sparkSession.range(replicates).select(F.lit(None).cast("double").alias("r"))
    per = none if n < 2 else multinomial_replicates(sums, n, replicates, seed).select(F.when(F.col("den") > 0, F.col("num").cast("double") / F.col("den")).alias("r"))
    return point.crossJoin(_interval(per, level)).select(*_bootstrap_columns())


def _ranked(sums: DataFrame) -> DataFrame:
    """``sums`` with ``pos``, the rank by name: within ranges of names, after the counts of those before."""
    placed = written(sums.repartitionByRange("grupo").withColumn("part", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")  # a row a range
    rank = F.row_number().over(Window.partitionBy("part").orderBy("grupo"))
    return placed.join(F.broadcast(before), "part").select("num", "den", (F.col("before") + rank - 1).cast("long").alias("pos"))


#: Ranges of clusters' hashes; the draws of a replicate are first split among them.
RANGES = 1024
#: Clusters among which a range's draws are split at once.
SPLIT_ROWS = 512


def _range_draws(sizes: list[int], own: int, n: int, replicates: int, seed: int) -> np.ndarray:
    """How many of the ``n`` draws of each replicate fall into one range, by halving the ranges: each
    half gets a binomial share. A node's draws depend on the seed and the node alone, so all tasks
    agree on them, and a task only walks down to its own range."""
    low, high = 0, len(sizes)
    left = np.full(replicates, n, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        total, first = sum(sizes[low:high]), sum(sizes[low:middle])
        taken = np.random.Generator(np.random.Philox(key=(seed, low << 32 | high))).binomial(left, first / total if total else 0.0)
        left, low, high = (taken, low, middle) if own < middle else (left - taken, middle, high)
    return left


def multinomial_replicates(sums: DataFrame, n: int, replicates: int, seed: int) -> DataFrame:
    """(rep, num, den): the sums of ``n`` clusters drawn with replacement from the ``n`` of ``sums``
    (grupo, num, den), for each replicate.

    Drawing n times is one multinomial draw of how often each cluster comes, which is split by
    binomials: among ranges of the clusters' hashes, then within a range among ``SPLIT_ROWS`` clusters
    at a time. A task holds one range, a 1024th of the clusters, and gives one row a replicate; no
    array of all clusters exists, and no draw is a row. Draws are seeded by range and place, and don't
    depend on partitions."""
    ranged = written(sums.withColumn("faixa", F.pmod(F.xxhash64("grupo"), F.lit(RANGES)).cast("int")), "ranges")
    counted = {r.faixa: r["count"] for r in ranged.groupBy("faixa").count().collect()}  # at most RANGES rows
    sizes = [counted.get(i, 0) for i in range(RANGES)]

    def run(table: pa.Table) -> pa.Table:
        own = table.column("faixa")[0].as_py()
        table = table.sort_by("grupo")
        pair = np.stack([table.column(c).to_numpy() for c in ("num", "den")], axis=1).astype(np.int64)
        left = _range_draws(sizes, own, n, replicates, seed)
        out = np.zeros((replicates, 2), np.int64)
        for low in range(0, len(pair), SPLIT_ROWS):
            some = pair[low : low + SPLIT_ROWS]
            rng = np.random.Generator(np.random.Philox(key=(seed, 1 << 63 | own << 32 | low // SPLIT_ROWS)))
            here = rng.binomial(left, len(some) / (len(pair) - low)) if low + len(some) < len(pair) else left
            out += rng.multinomial(here, np.full(len(some), 1 / len(some))) @ some
            left = left - here
        return pa.table({"rep": np.arange(replicates), "num": out[:, 0], "den": out[:, 1]})

    parts = ranged.groupBy("faixa").applyInArrow(run, "rep long, num long, den long")
    return parts.groupBy("rep").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


def paired_difference(population: DataFrame, outcomes: DataFrame, a: str, b: str, cluster: str, replicates: int = 2000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """The difference of two methods' coverage of rejections, with its interval: both are measured on
    the same draws of whole clusters. ``numerador`` is the difference of their alerts."""
    alert = lambda m: F.max(F.when((F.col("metodo") == m) & (F.col("situacao") == "ALERTA"), 1).otherwise(0))
    both = outcomes.filter(F.col("metodo").isin(a, b)).groupBy("row_id").agg((alert(a) - alert(b)).alias("d"))
    df = population.filter("rotulo = 'NAO_APROVADO'").select("row_id", F.coalesce(cluster, F.lit("SEM_GRUPO")).alias("grupo")).join(both, "row_id", "left")
    sums = df.groupBy("grupo").agg(F.sum(F.coalesce("d", F.lit(0)).cast("long")).alias("num"), F.count("*").alias("den"))
    return cluster_bootstrap(sums, replicates, seed, level)


def result_coverage(population: DataFrame, outcomes: DataFrame, methods: list[str]) -> DataFrame:
    """(metodo, faltam, sobram, repetidas): rows without an outcome, outcomes without a row, repeats."""
    given = outcomes.groupBy("row_id").agg(F.collect_list(F.struct("metodo", "vezes")).alias("saidas"))
    j = population.select("row_id", F.lit(True).alias("na_populacao")).join(given, "row_id", "full")
    known, of_row = F.col("na_populacao").isNotNull(), F.coalesce("saidas", F.array().cast("array<struct<metodo:string,vezes:bigint>>"))
    row = lambda m, missing, extra, times: F.struct(m.alias("metodo"), missing.alias("falta"), extra.alias("sobra"), times.alias("vezes"))
    there = F.transform(of_row, lambda s: row(s["metodo"], F.lit(False), ~known | ~s["metodo"].isin(methods), s["vezes"]))
    absent = [F.when(known & ~F.array_contains(of_row["metodo"], m), row(F.lit(m), F.lit(True), F.lit(False), F.lit(0).cast("long"))) for m in methods]
    rows = j.select(F.explode(F.concat(there, F.array_compact(F.array(*absent)))).alias("r")).select("r.*")
    return rows.groupBy("metodo").agg(F.count_if("falta").alias("faltam"), F.count_if("sobra").alias("sobram"), F.count_if(F.col("vezes") > 1).alias("repetidas"))
