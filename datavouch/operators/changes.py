"""Comparison of versions, runs and reports as multisets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datavouch.functions.identity import multiset_fingerprint, row_digest
from datavouch.functions.tables import sent, written


def multiset_difference(old: DataFrame, new: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct rows with how often they were added (positive) or removed; nulls are equal. One pass."""
    both = old.select(*cols, F.lit(-1).alias("sinal")).unionByName(new.select(*cols, F.lit(1).alias("sinal")))
    return both.groupBy(*cols).agg(F.sum("sinal").alias("saldo")).filter("saldo <> 0")


def compare_versions(old: DataFrame, new: DataFrame, cols: list[str], by: list[str], deleted: str = "deletado") -> DataFrame:
    """For each key ``by``: rows added and removed, live and deleted, and the verdict: SEM_MUDANCA,
    REVISAO (live rows only added or only removed, or just deleted ones changed) or AMBIGUA (live rows
    both added and removed: which became which isn't known). Null keys are keys like any other."""
    keys = old.select(*by).unionByName(new.select(*by)).distinct()
    return _verdicts(multiset_difference(old, new, list(dict.fromkeys([*by, *cols, deleted]))), keys, by, deleted)


def _verdicts(d: DataFrame, keys: DataFrame, by: list[str], deleted: str) -> DataFrame:
    plus, minus = F.when(F.col("saldo") > 0, F.col("saldo")).otherwise(0), F.when(F.col("saldo") < 0, -F.col("saldo")).otherwise(0)
    g = d.groupBy(*by).agg(*[F.sum(F.when(F.col(deleted) == F.lit(flag), x).otherwise(0)).alias(f"{n}_{k}") for k, flag in (("vivas", False), ("deletadas", True)) for n, x in (("incluidas", plus), ("removidas", minus))])
    counts = [c for c in g.columns if c not in by]
    j = _null_safe(keys, g, by, "left").fillna(0, counts)
    added, removed, other = F.col("incluidas_vivas") > 0, F.col("removidas_vivas") > 0, F.col("incluidas_deletadas") + F.col("removidas_deletadas") > 0
    return j.withColumn("veredito", F.when(added & removed, "AMBIGUA").when(added | removed | other, "REVISAO").otherwise("SEM_MUDANCA"))


def _null_safe(a: DataFrame, b: DataFrame, by: list[str], how: str) -> DataFrame:
    """``a`` and ``b`` joined where all of ``by`` are equal or both null; ``by`` is there once."""
    on = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by))
    rest = [F.col(f"{side}.{c}") for side, df in (("a", a), ("b", b)) for c in df.columns if c not in by]
    return a.alias("a").join(b.alias("b"), on, how).select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in by], *rest)


#: Buckets that the rows of one file are counted in; a change of few rows is sought in few of them.
BUCKETS = 256


def _bucketed(rows: DataFrame, cols: list[str]) -> DataFrame:
    digest = row_digest(rows, cols)
    return rows.withColumn("_digest", digest).withColumn("balde", F.conv(F.substring("_digest", 61, 4), 16, 10).cast("int") % BUCKETS)


def content_tree(rows: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """(*key, balde, n_rows, limb_0 to limb_3): the content of each file (``key``) as fingerprints of
    buckets of equal rows, which is stored beside a version once and compared without its rows."""
    part = lambda i: F.conv(F.substring("_digest", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")
    return _bucketed(rows, cols).groupBy(*key, "balde").agg(F.count("*").alias("n_rows"), *[F.sum(part(i)).alias(f"limb_{i}") for i in range(4)])


def changed_buckets(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(*key, balde) in which two trees differ. Whole files are compared first, by the sums of their
    buckets, which are their own fingerprints; only those that differ are looked at bucket by bucket."""
    prints = ["n_rows", *[f"limb_{i}" for i in range(4)]]
    same = lambda a, b: reduce(lambda x, y: x & y, (F.col(f"{a}_{c}").eqNullSafe(F.col(f"{b}_{c}")) for c in prints))
    named = lambda df, p: df.select(*[c for c in df.columns if c not in prints], *[F.col(c).alias(f"{p}_{c}") for c in prints])
    roots = [named(df.groupBy(*key).agg(*[F.sum(c).alias(c) for c in prints]), p) for df, p in ((old, "o"), (new, "n"))]
    differ = sent(written(_null_safe(*roots, key, "full").filter(~same("o", "n")).select(*key), "files"))
    kept = lambda df: df.join(differ, reduce(lambda x, y: x & y, (df[k].eqNullSafe(differ[k]) for k in key)), "left_semi")
    leaves = [named(kept(df), p) for df, p in ((old, "o"), (new, "n"))]
    return _null_safe(*leaves, [*key, "balde"], "full").filter(~same("o", "n")).select(*key, "balde")


def compare_content(old: DataFrame, new: DataFrame, key: list[str], cols: list[str], deleted: str = "deletado", trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """As ``compare_versions``, by way of the versions' trees (made here, or those stored with them): rows
    of files and buckets whose fingerprints agree are filtered out where they are read, and only the
    rows of the others are brought together."""
    every = list(dict.fromkeys([*cols, deleted]))
    a, b = trees or (content_tree(old, key, every), content_tree(new, key, every))
    a, b = (df if trees else written(df, "tree") for df in (a, b))
    differ = sent(written(changed_buckets(a, b, key), "buckets"))
    on = lambda df: reduce(lambda x, y: x & y, (df[k].eqNullSafe(differ[k]) for k in [*key, "balde"]))
    rows = [x.join(differ, on(x), "left_semi").drop("_digest", "balde") for x in (_bucketed(old, every), _bucketed(new, every))]
    keys = a.select(*key).unionByName(b.select(*key)).distinct()
    return _verdicts(multiset_difference(*rows, list(dict.fromkeys([*key, *every]))), keys, key, deleted)


def classify_keys(prev: DataFrame, curr: DataFrame, key: list[str], window_start: DataFrame | None = None, content: DataFrame | None = None) -> DataFrame:
    """One outcome for each key of two polls (with artifact_id and resultado). Where the bytes changed,
    ``content`` (*key, veredito, as ``compare_content`` gives it) says what the rows did: the same ones
    make the key INALTERADA, else it is REVISAO or AMBIGUA; keys that it doesn't have, of sources that
    aren't compared by rows, stay BYTES_MUDARAM. A key that is gone is DESAPARECIDA only from its source's ``window_start`` (fonte, inicio) on; older ones have merely left
    the window (FORA_DA_JANELA)."""
    p = prev.select(*key, F.col("artifact_id").alias("antes"), F.lit(True).alias("havia"))
    c = curr.select(*key, F.col("artifact_id").alias("agora"), "resultado", F.lit(True).alias("ha"))
    out = F.when(F.col("ha").isNull(), "DESAPARECIDA").when(F.col("resultado") != "OBTIDO", "INCONCLUSIVA").when(F.col("havia").isNull() | F.col("antes").isNull(), "NOVA").when(F.col("antes") == F.col("agora"), "INALTERADA").otherwise("BYTES_MUDARAM")
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}"))
    j = p.alias("p").join(c.alias("c"), on, "full").select(*[F.coalesce(f"p.{k}", f"c.{k}").alias(k) for k in key], "antes", "agora", out.alias("situacao"))
    if content is not None:
        said = F.when(F.col("veredito") == "SEM_MUDANCA", "INALTERADA").otherwise(F.col("veredito"))
        j = _null_safe(j, content.select(*key, "veredito"), key, "left").withColumn("situacao", F.when((F.col("situacao") == "BYTES_MUDARAM") & F.col("veredito").isNotNull(), said).otherwise(F.col("situacao"))).drop("veredito")
    if window_start is None:
        return j
    left = (F.col("situacao") == "DESAPARECIDA") & ~F.coalesce(F.col("competencia") >= F.col("inicio"), F.lit(False))
    return j.join(window_start.select("fonte", "inicio"), "fonte", "left").withColumn("situacao", F.when(left, "FORA_DA_JANELA").otherwise(F.col("situacao"))).drop("inicio")


def recent_months(listing: DataFrame, k: int, by: str = "fonte", first: str | None = None, last: str | None = None) -> DataFrame:
    """(by, competencia, ordem, janela_incompleta): the last ``k`` months with a listed file of each
    source, within the study's bounds; sources with fewer have an incomplete window."""
    months = listing.select(by, "competencia").distinct()
    if first is not None:
        months = months.filter(F.col("competencia") >= first)
    if last is not None:
        months = months.filter(F.col("competencia") <= last)
    ranked = months.withColumn("ordem", F.dense_rank().over(Window.partitionBy(by).orderBy(F.col("competencia").desc()))).filter(F.col("ordem") <= k)
    return ranked.withColumn("janela_incompleta", F.count("*").over(Window.partitionBy(by)) < k)


def watch_verdict(outcomes: DataFrame, windows: DataFrame) -> DataFrame:
    """One row: the verdict over the outcomes (situacao) of a poll, and how many of each there are.
    Nothing is said beyond what was observed: an outcome that failed or a window that is incomplete
    makes the poll inconclusive."""
    n = lambda *s: F.count_if(F.col("situacao").isin(*s))
    g = outcomes.agg(F.count("*").alias("chaves"), n("INCONCLUSIVA", "DESAPARECIDA").alias("inconclusivas"), n("BYTES_MUDARAM", "REVISAO", "AMBIGUA").alias("revisoes"), n("NOVA").alias("novas"))
    open_ = windows.agg(F.coalesce(F.bool_or("janela_incompleta"), F.lit(True)).alias("aberta"))
    verdict = F.when(F.col("chaves") == 0, "SEM_OBSERVACAO").when(F.col("aberta") | (F.col("inconclusivas") > 0), "VIGILANCIA_INCONCLUSIVA").when(F.col("revisoes") > 0, "REVISAO_OBSERVADA").when(F.col("novas") > 0, "ARQUIVOS_NOVOS").otherwise("SEM_REVISAO_OBSERVADA")
    return g.crossJoin(open_).select("chaves", "inconclusivas", "revisoes", "novas", verdict.alias("veredito"))


def concurrent_versions(loaded: DataFrame, key: list[str]) -> DataFrame:
    """File keys with more than one loaded version."""
    return loaded.groupBy(*key).agg(F.count_distinct("artifact_id").alias("n_versoes"), F.array_join(F.array_sort(F.collect_set("artifact_id")), ";").alias("artifact_ids")).filter("n_versoes > 1")


def without_concurrent(records: DataFrame, loaded: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records without those of any version of a month (``competencia`` of ``key``) that has concurrent
    ones, and (competencia, marca): the processing months found in what left, as incomplete."""
    months = concurrent_versions(loaded, key).select(*[k for k in key if k != "parte"]).distinct()
    gone = loaded.join(months, months.columns, "left_semi").select("artifact_id").distinct()
    marks = records.join(gone, "artifact_id", "left_semi").select(F.col("competencia_processamento").alias("competencia")).distinct().withColumn("marca", F.lit("versoes_concorrentes"))
    return records.join(gone, "artifact_id", "left_anti"), marks


def plan_files(listing: DataFrame, pattern: str, months: DataFrame, parts: list[str] | None = None, region: str | None = None) -> DataFrame:
    """(competencia, parte, nome, regiao, versao, situacao): listed names that match the pattern, whose
    named groups may be ``mes``, ``parte``, ``regiao`` and ``versao``; requested months without a file
    and, with ``parts`` declared, parts of a month that are missing. Names of another ``region``
    don't count; the versions of one file are all planned."""
    names = [g for g in re.compile(pattern.replace("\\A", "^").replace("\\z", "$")).groupindex]
    plain = re.sub(r"\?P?<[a-z]+>", "", pattern)
    group = lambda g: F.regexp_extract("nome", plain, names.index(g) + 1) if g in names else F.lit(None).cast("string")
    named = listing.select("nome", group("mes").alias("competencia"), group("parte").alias("parte"), group("regiao").alias("regiao"), group("versao").alias("versao")).filter("competencia <> ''")
    if region is not None:
        named = named.filter(F.col("regiao").eqNullSafe(F.lit(region)))
    asked = months.select("competencia").distinct()
    if parts is None:
        j = asked.join(named, "competencia", "left")
    else:
        j = asked.select("competencia", F.explode(F.array(*[F.lit(p) for p in parts])).alias("parte")).join(named, ["competencia", "parte"], "left")
    some = named.select("competencia").distinct().withColumn("ha", F.lit(True))
    state = F.when(F.col("nome").isNotNull(), "PLANEJADO").when(F.col("ha").isNull(), "SEM_ARQUIVO").otherwise("PARTE_AUSENTE")
    return j.join(some, "competencia", "left").select("competencia", "parte", "nome", "regiao", "versao", state.alias("situacao"))


def swap_version(selections: DataFrame, source: str, old: str, new: str) -> DataFrame:
    """One version of one source replaced in all selections, which say so in ``troca``; the others are
    untouched. A swap without effect is an error."""
    swapped = F.array_sort(F.transform("artifact_ids", lambda a: F.when(a == old, F.lit(new)).otherwise(a)))
    hit = (F.col("fonte") == source) & F.array_contains("artifact_ids", old)
    if old == new or selections.filter(hit).isEmpty():
        raise ValueError(f"replacing {old} by {new} changes no selection of {source}")
    return selections.withColumns({"troca": F.when(hit, F.lit(f"{old}>{new}")), "artifact_ids": F.when(hit, swapped).otherwise(F.col("artifact_ids"))})


def check_ablation(base: DataFrame, variant: DataFrame, affected: list[str]) -> DataFrame:
    """(problema, n): what makes two runs more than one ablation: other records or rules, other
    selections of sources than the ablated one (rules not in ``affected``), a version of another month
    in place of the required one, and pairs whose inputs are the same but whose state isn't."""
    cols = ("estado", "sel_competencia", "sel_estado", "sel_artefatos")
    b, v = (df.select("row_id", "rule_id", *[F.col(c).alias(f"{p}_{c}") for c in cols]) for df, p in ((base, "b"), (variant, "v")))
    j = b.join(v, ["row_id", "rule_id"], "full")
    same = lambda c: F.col(f"b_{c}").eqNullSafe(F.col(f"v_{c}"))
    inputs = same("sel_competencia") & same("sel_estado") & same("sel_artefatos")
    why = (
        F.when(F.col("b_estado").isNull() | F.col("v_estado").isNull(), "PARES_DIFERENTES")
        .when(~F.col("rule_id").isin(*affected) & ~inputs, "OUTRO_FATOR_MUDOU")
        .when(~same("sel_competencia"), "MES_TROCADO")
        .when(inputs & ~same("estado"), "PAR_NAO_AFETADO_MUDOU")
    )
    return j.withColumn("problema", why).filter("problema is not null").groupBy("problema").agg(F.count("*").alias("n"))


def compare_ablation(base: DataFrame, variant: DataFrame) -> DataFrame:
    """(rule_id, antes, depois, n): how the states of two runs over the same records differ."""
    b, v = base.select("row_id", "rule_id", F.col("estado").alias("antes")), variant.select("row_id", "rule_id", F.col("estado").alias("depois"))
    j = b.join(v, ["row_id", "rule_id"], "full").filter(~F.col("antes").eqNullSafe(F.col("depois")))
    return j.groupBy("rule_id", "antes", "depois").agg(F.count("*").alias("n"))


def diff_outputs(a: DataFrame, b: DataFrame, drop: tuple[str, ...] = ("run_id",), lineage: str = "artifact_id") -> DataFrame:
    """One row: how two runs' tables compare, and by what: DIVERGENTE if the schemas, the numbers of
    rows, the contents without the columns ``drop`` or the multisets of lineage differ, else IGUAL."""
    kinds = lambda df: sorted((n, t) for n, t in df.dtypes if n not in drop)
    same = kinds(a) == kinds(b)
    cols = [n for n, _ in kinds(a)]
    of = lambda df, p: multiset_fingerprint(df, cols).select(F.col("n_rows").alias(f"{p}_n"), F.concat_ws("|", *[f"limb_{i}" for i in range(4)]).alias(f"{p}_h"))
    if not same:
        n = lambda df, p: df.agg(F.count("*").alias(f"{p}_n"))
        return n(a, "a").crossJoin(n(b, "b")).select(F.lit(False).alias("esquema"), (F.col("a_n") == F.col("b_n")).alias("linhas"), F.lit(False).alias("conteudo"), F.lit(None).cast("boolean").alias("linhagem"), F.lit("DIVERGENTE").alias("situacao"))
    j = of(a, "a").crossJoin(of(b, "b"))
    if lineage in cols:
        line = a.groupBy(lineage).agg(F.count("*").alias("n")).exceptAll(b.groupBy(lineage).agg(F.count("*").alias("n"))).agg((F.count("*") == 0).alias("linhagem"))
    else:
        line = j.select(F.lit(True).alias("linhagem"))
    out = j.crossJoin(line).select(F.lit(True).alias("esquema"), (F.col("a_n") == F.col("b_n")).alias("linhas"), (F.col("a_h") == F.col("b_h")).alias("conteudo"), "linhagem")
    return out.withColumn("situacao", F.when(F.col("linhas") & F.col("conteudo") & F.col("linhagem"), "IGUAL").otherwise("DIVERGENTE"))


# How a stored table and its reproduction compare.
EQUAL, BYTES, DIVERGENT, INCONCLUSIVE = "IGUAL", "BYTES_DIFERENTES", "DIVERGENTE", "INCONCLUSIVO"
# End of the fixed values.


def compare_stored(declared: DataFrame, original: DataFrame, remade: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """(item, situacao, detalhe) of many stored tables and their reproductions, each by what is known:
    first the hash of the remade rows against the declared one, then where they come from, then the
    original's schema and rows against what was declared of it, and last the files' bytes.

    ``declared`` (item, hash, linhas), ``original`` and ``remade`` (item, hash, linhas, esquema, bytes):
    hashes of contents recomputed from the rows, ``bytes`` those of the files (``stored_identity``).
    ``artifacts``: (item, lado, artifact_id), lado ``declarado`` or ``refeito``, compared as multisets.
    A declared item that wasn't remade is divergent, one that was remade alone has nothing to be
    compared with, and an original that can't be read (null hash) or is gone leaves equality with the
    declaration."""
    j = declared.select("item", F.col("hash").alias("d_hash"), F.col("linhas").alias("d_n"), F.lit(True).alias("d"))
    for df, p in ((remade, "r"), (original, "o")):
        j = j.join(df.select("item", F.col("hash").alias(f"{p}_hash"), F.col("linhas").alias(f"{p}_n"), F.col("esquema").alias(f"{p}_esquema"), F.col("bytes").alias(f"{p}_bytes"), F.lit(True).alias(p)), "item", "full" if p == "r" else "left")
    if artifacts is not None:
        signed = artifacts.groupBy("item", "artifact_id").agg(F.sum(F.when(F.col("lado") == "declarado", 1).otherwise(-1)).alias("s")).filter("s <> 0")
        j = j.join(signed.groupBy("item").agg(F.count("*").alias("outros")), "item", "left")
    else:
        j = j.withColumn("outros", F.lit(None).cast("long"))
    differs = lambda p: ~(F.col("d_hash").eqNullSafe(F.col(f"{p}_hash")) & F.col("d_n").eqNullSafe(F.col(f"{p}_n")))
    case = lambda s, why: F.struct(F.lit(s).alias("situacao"), F.lit(why).alias("detalhe"))
    said = (
        F.when(F.col("d").isNull(), case(INCONCLUSIVE, "original_ausente"))
        .when(F.col("r").isNull(), case(DIVERGENT, "ausente_no_refeito"))
        .when(differs("r"), case(DIVERGENT, "refeito_diverge"))
        .when(F.col("outros") > 0, case(DIVERGENT, "linhagem_diverge"))
        .when(F.col("o").isNull(), case(EQUAL, "original_ausente"))
        .when(F.col("o_hash").isNull(), case(EQUAL, "original_ilegivel"))
        .when(~F.col("o_esquema").eqNullSafe(F.col("r_esquema")), case(DIVERGENT, "esquema_divergente"))
        .when(differs("o"), case(DIVERGENT, "original_diverge"))
        .when(~F.col("o_bytes").eqNullSafe(F.col("r_bytes")), case(BYTES, "bytes_diferem"))
        .otherwise(case(EQUAL, ""))
    )
    return j.select("item", said.alias("s")).select("item", "s.*")


def stored_identity(spark: SparkSession, item: str, path: str) -> DataFrame:
    """One row (item, hash, linhas, esquema, bytes) of a stored Parquet table: its rows' fingerprint, its
    columns in order, and the multiset of its files' digests, each read by a task."""
    df = spark.read.parquet(path)
    schema = ",".join(f"{n} {t}" for n, t in df.dtypes)
    limbs = F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), *[f"limb_{i}" for i in range(4)]), 256)
    rows = multiset_fingerprint(df).select(limbs.alias("hash"), F.col("n_rows").alias("linhas"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.sha2("content", 256).alias("d"))
    part = lambda i: F.sum(F.conv(F.substring("d", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    digest = files.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *[part(i) for i in range(4)]), 256).alias("bytes"))
    return rows.crossJoin(digest).select(F.lit(item).alias("item"), "hash", "linhas", F.lit(schema).alias("esquema"), "bytes")


def diff_metrics(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Metrics that differ, are missing or are extra, by name and stratum, null strata too. A repeated
    row of a key is compared as often as it is there: equal values cancel out, one left on each side
    diverges, and what one side has more of is missing or extra. One row a key (the least values left,
    or the least equal one)."""
    x, y = (df.groupBy(*key, value).agg(F.count("*").alias("k")).withColumn("lado", F.lit(sign)) for df, sign in ((a, 1), (b, -1)))
    net = x.unionByName(y).groupBy(*key, value).agg(F.sum(F.col("k") * F.col("lado")).alias("saldo"))
    one = lambda c, name: F.min(F.when(c, F.struct(F.col(value).alias("v")))).alias(name)
    g = net.groupBy(*key).agg(one(F.col("saldo") > 0, "xa"), one(F.col("saldo") < 0, "xb"), one(F.lit(True), "eq"), F.sum("saldo").alias("saldo"))
    state = F.when(F.col("saldo") > 0, "FALTA").when(F.col("saldo") < 0, "SOBRA").when(F.col("xa").isNotNull() | F.col("xb").isNotNull(), "DIVERGENTE").otherwise("IGUAL")
    equal = state == "IGUAL"
    return g.select(*key, F.when(equal, F.col("eq.v")).otherwise(F.col("xa.v")).alias("valor_a"), F.when(equal, F.col("eq.v")).otherwise(F.col("xb.v")).alias("valor_b"), state.alias("situacao"))


def diff_notes(item: str, expected: DataFrame | None, found: DataFrame) -> DataFrame:
    """One row (item, faltando, sobrando, primeira, situacao): the notes (nota) of a report against those
    of the registered one, as multisets; without those it is inconclusive. ``primeira`` is the first
    missing note, else the first extra one."""
    if expected is None:
        return found.agg(F.lit(0).cast("long").alias("faltando"), F.count("*").alias("sobrando")).select(F.lit(item).alias("item"), "faltando", F.lit(0).cast("long").alias("sobrando"), F.lit(None).cast("string").alias("primeira"), F.lit(INCONCLUSIVE).alias("situacao"))
    d = multiset_difference(found.select("nota"), expected.select("nota"), ["nota"])
    lost, more = F.when(F.col("saldo") > 0, F.col("saldo")).otherwise(0), F.when(F.col("saldo") < 0, -F.col("saldo")).otherwise(0)
    g = d.agg(F.coalesce(F.sum(lost), F.lit(0)).alias("faltando"), F.coalesce(F.sum(more), F.lit(0)).alias("sobrando"), F.coalesce(F.min(F.when(F.col("saldo") > 0, F.col("nota"))), F.min("nota")).alias("primeira"))
    return g.select(F.lit(item).alias("item"), "faltando", "sobrando", "primeira", F.when((F.col("faltando") == 0) & (F.col("sobrando") == 0), EQUAL).otherwise(DIVERGENT).alias("situacao"))


def diff_splits(a: DataFrame, b: DataFrame) -> DataFrame:
    """(particao, so_a, so_b, situacao): rows of each partition that one split alone has."""
    x, y = (df.groupBy("particao", "row_id").agg(F.count("*").alias(p)) for df, p in ((a, "na"), (b, "nb")))
    g = x.join(y, ["particao", "row_id"], "full").groupBy("particao").agg(F.count_if(F.col("nb").isNull()).alias("so_a"), F.count_if(F.col("na").isNull()).alias("so_b"))
    return g.withColumn("situacao", F.when((F.col("so_a") == 0) & (F.col("so_b") == 0), "IGUAL").otherwise("DIVERGENTE"))


def overall(items: DataFrame) -> DataFrame:
    """The worst state of a list of comparisons; none at all is inconclusive."""
    severity = F.when(F.col("situacao") == "IGUAL", 0).when(F.col("situacao") == "DIVERGENTE", 2).otherwise(1)
    return items.agg(F.coalesce(F.max_by("situacao", F.struct(severity, "situacao")), F.lit("INCONCLUSIVA")).alias("situacao"), F.count("*").alias("itens"))
