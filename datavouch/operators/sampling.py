"""Reproducible stratified samples and the agreement of annotators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datavouch.functions.months import month_diff
from datavouch.functions.tables import written


def hash_order(seed: int, key: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key)), 256)


def strata(df: DataFrame) -> DataFrame:
    """row_id and its stratum: instrument, year, volume tercile of the establishment, lag class."""
    volume = df.groupBy("cnes").agg(F.count("*").alias("n"))
    tercile = volume.select("cnes", F.ntile(3).over(Window.orderBy("n", "cnes")).alias("tercil"))  # as many rows as establishments
    lag = month_diff(F.col("competencia_processamento"), F.col("competencia_atendimento"))
    name = F.when(lag.isNull(), "desconhecida").when(lag < 0, "negativa").when(lag <= 1, lag.cast("string")).when(lag <= 3, "2-3").otherwise("4+")
    j = df.join(tercile, "cnes")
    return j.select("row_id", F.concat_ws("|", F.coalesce("instrumento", F.lit("nulo")), F.substring("competencia_processamento", 1, 4), F.col("tercil").cast("string"), name).alias("estrato"))


def allocate(counts: DataFrame, total: int) -> DataFrame:
    """(estrato, n, alocado, probabilidade): proportional, at least one a stratum, exactly ``total`` (all
    rows if they are fewer). ``counts`` has a row (estrato, n) a stratum.

    Each stratum begins with its target's whole part, or one. While cases are missing, the stratum that
    lies farthest below its target gets one; while there are too many, the one that lies farthest above
    loses one, never its last; ties go by name. Units of one stratum rank a whole case apart, so units
    are dealt in rounds: a round is full or takes from the strata in the order of their remainders, and
    the number of full rounds is where the water level of what strata can lose meets the surplus. So no
    unit is a row. More strata than cases, no case and empty strata are refused."""
    if total < 1:
        raise ValueError(f"a sample of {total} cases")
    counts = written(counts.select("estrato", F.col("n").cast("long").alias("n")), "strata")
    seen = counts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.min("n").alias("least")).first()
    if seen.k and seen.least < 1:
        raise ValueError("a stratum is empty")
    if seen.k and total < seen.n and seen.k > total:
        raise ValueError(f"{seen.k} strata, but {total} cases")
    size, every = min(total, seen.n or 0), seen.n or 1
    product = F.lit(size).cast("decimal(18,0)") * F.col("n").cast("decimal(19,0)")
    base = counts.withColumn("piso", F.greatest(F.lit(1), F.expr(f"cast(cast({size} as decimal(18,0)) * cast(n as decimal(19,0)) div {every} as bigint)")))
    base = base.withColumn("resto", (product % F.lit(every)).cast("long")).withColumn("teto", F.col("piso") - 1)
    missing = size - (base.agg(F.sum("piso")).first()[0] or 0)
    if missing >= 0:
        place = F.row_number().over(Window.orderBy(F.col("piso").cast("decimal(19,0)") * F.lit(every).cast("decimal(18,0)") - product, "estrato"))  # a row a stratum
        given = base.withColumn("alocado", F.col("piso") + F.when((place <= missing), 1).otherwise(0))
    else:
        rounds, over = _full_rounds(base, -missing)
        can = F.when(F.col("teto") > rounds, F.lit(0)).otherwise(1)
        place = F.row_number().over(Window.orderBy(can, "resto", "estrato"))
        given = base.withColumn("alocado", F.col("piso") - F.least("teto", F.lit(rounds)) - F.when((can == 0) & (place <= over), 1).otherwise(0))
    return given.select("estrato", "n", F.col("alocado").cast("long").alias("alocado"), F.bround(F.col("alocado").cast("decimal(20,0)") / F.col("n").cast("decimal(20,0)"), 12).cast("decimal(20,12)").alias("probabilidade"))


def _full_rounds(base: DataFrame, surplus: int) -> tuple[int, int]:
    """How many whole rounds of one case from each stratum that can lose it (``teto``: how many it can)
    the surplus holds, and what is left of it."""
    levels = base.groupBy("teto").agg(F.count("*").alias("k"))
    up, all_ = Window.orderBy("teto"), Window.partitionBy()
    lost = F.sum(F.col("teto") * F.col("k")).over(up) + F.col("teto") * (F.sum("k").over(all_) - F.sum("k").over(up))  # strata at or below a level, and above it
    at = levels.select("teto", lost.alias("lost"), (F.sum("k").over(all_) - F.sum("k").over(up)).alias("above"))
    r = at.filter(F.col("lost") <= surplus).agg(F.max(F.struct("teto", "lost", "above")).alias("m")).first().m
    level, lost_, above = (r.teto, r.lost, r.above) if r else (0, 0, base.count())
    more = (surplus - lost_) // above if above else 0
    return level + more, surplus - lost_ - more * above


#: Ranges of hashes that a stratum's rows are counted in, each of about a sample's rows.
RANGES = 64


def stratified_sample(rows: DataFrame, allocation: DataFrame, seed: int = 42) -> DataFrame:
    """The first rows of each stratum in hash order; it doesn't depend on the order of rows.

    Rows are first counted in ranges of their hashes, which are narrow where a stratum is large; those
    after the range in which the sample is complete are left out, so what is sorted is about twice the
    sample at most, however large a stratum is. Strata without an allocation, or of none, give no rows."""
    own = allocation.filter("alocado > 0").select("estrato", "alocado", F.col("n").alias("_n"))
    order = hash_order(seed, "row_id")
    share = F.conv(F.substring("ordem", 1, 12), 16, 10).cast("double") / float(1 << 48)
    ranged = rows.select("estrato", "row_id", order.alias("ordem")).join(F.broadcast(own), "estrato").withColumn("faixa", F.least(F.lit(RANGES - 1), F.floor(share * F.col("_n") / F.col("alocado"))).cast("int"))
    counted = ranged.groupBy("estrato", "alocado", "faixa").agg(F.count("*").alias("c"))
    until = F.sum("c").over(Window.partitionBy("estrato").orderBy("faixa"))
    last = counted.withColumn("ate", until).groupBy("estrato").agg(F.coalesce(F.min(F.when(F.col("ate") >= F.col("alocado"), F.col("faixa"))), F.lit(RANGES)).alias("ultima"))
    few = ranged.join(F.broadcast(last), "estrato").filter("faixa <= ultima")
    r = F.row_number().over(Window.partitionBy("estrato").orderBy("ordem", "row_id"))
    return few.withColumn("posicao", r).filter("posicao <= alocado").select("estrato", "row_id", "posicao")


def blind_package(sample: DataFrame, records: DataFrame, allowed: list[str], seed: int = 42) -> tuple[DataFrame, DataFrame, list[str]]:
    """Cases with anonymous ids in hash order, of allowed columns alone; the private map (caso,
    row_id), whose hash ``identity.logical_hash`` gives; and the columns that were left out."""
    if "row_id" in allowed:
        raise ValueError("row_id would undo the blinding")
    chosen = sample.select("row_id").join(records.select("row_id", *allowed), "row_id")
    n = F.row_number().over(Window.orderBy(hash_order(seed + 1, "row_id"), "row_id"))  # as many rows as the sample
    named = written(chosen.withColumn("caso", F.concat(F.lit("caso_"), F.lpad(n.cast("string"), 6, "0"))), "cases")
    return named.select("caso", *allowed), named.select("caso", "row_id"), sorted(c for c in records.columns if c not in allowed)


def check_batches(a: DataFrame, b: DataFrame, cases: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """(problema, n): what makes two batches (caso, categoria, avaliador, amostra, formulario) unfit for
    comparison: another sample or form, a case left out, added or judged twice, a case of the
    ``training`` set, or the same rater in both."""
    parts = []
    for df in (a, b):
        parts += [df.join(cases.select("caso"), "caso", "left_anti").select(F.lit("CASO_ESTRANHO").alias("problema")), cases.select("caso").join(df, "caso", "left_anti").select(F.lit("CASO_FALTANTE").alias("problema"))]
        parts.append(df.groupBy("caso").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("CASO_REPETIDO").alias("problema")))
        if training is not None:
            parts.append(df.join(training.select("caso"), "caso", "left_semi").select(F.lit("CASO_DE_TREINO").alias("problema")))
    both = a.select("amostra", "formulario", "avaliador", F.lit("a").alias("lote")).unionByName(b.select("amostra", "formulario", "avaliador", F.lit("b").alias("lote")))
    g = both.agg(F.count_distinct("amostra").alias("s"), F.count_distinct("formulario").alias("f"))
    parts += [g.filter("s > 1").select(F.lit("AMOSTRA_DIFERENTE").alias("problema")), g.filter("f > 1").select(F.lit("FORMULARIO_DIFERENTE").alias("problema"))]
    parts.append(both.groupBy("avaliador").agg(F.count_distinct("lote").alias("n")).filter("n > 1").select(F.lit("MESMO_AVALIADOR").alias("problema")))
    return reduce(DataFrame.unionByName, parts).groupBy("problema").agg(F.count("*").alias("n"))


def agreement(pairs: DataFrame) -> DataFrame:
    """(familia, n, iguais, concordancia, kappa) from (familia, cat_a, cat_b), and for all (TODAS).
    Kappa is null where the expected agreement is one."""
    both = pairs.select("familia", "cat_a", "cat_b").unionByName(pairs.select(F.lit("TODAS").alias("familia"), "cat_a", "cat_b"))
    cells = both.groupBy("familia", "cat_a", "cat_b").agg(F.count("*").alias("c"))
    total = cells.groupBy("familia").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("cat_a") == F.col("cat_b"), F.col("c")).otherwise(0)).alias("iguais"))
    a = cells.groupBy("familia", F.col("cat_a").alias("cat")).agg(F.sum("c").alias("x"))
    b = cells.groupBy("familia", F.col("cat_b").alias("cat")).agg(F.sum("c").alias("y"))
    chance = a.join(b, ["familia", "cat"]).groupBy("familia").agg(F.sum(F.col("x") * F.col("y")).alias("acaso"))
    j = total.join(chance, "familia", "left").fillna({"acaso": 0})
    square = F.col("n") * F.col("n")
    return j.select("familia", "n", "iguais", F.round(F.col("iguais") / F.col("n"), 9).alias("concordancia"), F.when(square != F.col("acaso"), F.round((F.col("iguais") * F.col("n") - F.col("acaso")) / (square - F.col("acaso")), 9)).alias("kappa"))


def close_reference(a: DataFrame, b: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """(caso, categoria, origem): consensus, else adjudication, else open."""
    j = a.select("caso", F.col("categoria").alias("ca")).join(b.select("caso", F.col("categoria").alias("cb")), "caso").join(adjudicated.select("caso", F.col("categoria").alias("cj")), "caso", "left")
    same = F.col("ca") == F.col("cb")
    return j.select("caso", F.when(same, F.col("ca")).otherwise(F.col("cj")).alias("categoria"), F.when(same, "CONSENSO").when(F.col("cj").isNotNull(), "ADJUDICADA").otherwise("ABERTA").alias("origem"))


def compare_with_engine(reference: DataFrame, engine: DataFrame, categories: list[str]) -> DataFrame:
    """Counts of (reference, engine) outcomes, zero rows included."""
    spark = reference.sparkSession
    grid = spark.createDataFrame([(x,) for x in categories], "categoria string").crossJoin(spark.createDataFrame([(x,) for x in ("ALERTA", "ABSTENCAO", "SEM_VIOLACAO_VERIFICADA")], "resultado string"))
    counts = reference.join(engine, "row_id").groupBy("categoria", "resultado").agg(F.count("*").alias("n"))
    return grid.join(counts, ["categoria", "resultado"], "left").fillna({"n": 0})
