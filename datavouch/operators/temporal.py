"""Which version of a reference file applies to a month: exact months only, never a neighbour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datavouch.functions.identity import logical_hash
from datavouch.functions.months import month_index, month_text

_INTACT = ("OK", "NAO_VERIFICADO")


def scope_observations(obs: DataFrame, region: str | None = None, channel: str | None = None) -> DataFrame:
    """Regional files of their own region only, national ones (null) always; listings are left out."""
    kept = obs
    if "uf" in obs.columns:
        kept = kept.filter(F.col("uf").isNull() | (F.col("uf") == F.lit(region)))
    if channel is not None and "canal" in obs.columns:
        kept = kept.filter(F.col("canal") == channel)
    return kept.filter(~F.coalesce(F.col("resultado") == "LISTAGEM", F.lit(False)))


def as_known_at(obs: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """Observations up to the cutoff."""
    return obs if cutoff is None else obs.filter(F.col("observado_em") <= cutoff)


def resolve_parts(obs: DataFrame, versions: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """One row for each (fonte, competencia, parte): its state, artifact ids, and how often it was
    observed before and after the cutoff. Two intact contents are ambiguous; contents that are all
    quarantined or of unknown version put the part in quarantine; none at all is absence."""
    seen = F.lit(True) if cutoff is None else F.col("observado_em") <= cutoff
    known = obs.join(versions.select("artifact_id", F.col("estado").alias("integridade")), "artifact_id", "left")
    marked = known.select("fonte", "competencia", "parte", "artifact_id", "observation_id", seen.alias("visto"), ((F.col("resultado") == "OBTIDO") & F.coalesce(F.col("integridade").isin(*_INTACT), F.lit(False))).alias("integro"), ((F.col("resultado") == "OBTIDO") & F.col("artifact_id").isNotNull()).alias("obtido"))
    grouped = marked.groupBy("fonte", "competencia", "parte").agg(
        F.count_if("visto").alias("n_vistos"),
        F.count("*").alias("n_total"),
        F.array_sort(F.collect_set(F.when(F.col("visto") & F.col("integro"), F.col("artifact_id")))).alias("artifact_ids"),
        F.array_sort(F.collect_set(F.when(F.col("visto"), F.col("observation_id")))).alias("observation_ids"),
        F.array_sort(F.collect_set(F.when(F.col("visto") & F.col("obtido") & ~F.col("integro"), F.col("artifact_id")))).alias("ruins"),
    )
    n = F.size("artifact_ids")
    state = F.when(F.col("n_vistos") == 0, "FORA_DO_CORTE").when(n >= 2, "AMBIGUA").when(n == 1, "SELECIONADA").when(F.size("ruins") > 0, "EM_QUARENTENA").otherwise("AUSENTE")
    return grouped.select("fonte", "competencia", "parte", state.alias("estado"), F.when(n > 0, F.col("artifact_ids")).otherwise(F.col("ruins")).alias("artifact_ids"), "observation_ids", "n_vistos", "n_total")


def combine_parts(parts: DataFrame, expected: DataFrame) -> DataFrame:
    """One row for each (fonte, competencia): AMBIGUA before EM_QUARENTENA before AUSENTE (all parts
    absent); then the parts with content must be exactly the declared ones, else INCOMPLETA. Files
    without parts need no declaration. Parts seen only after the cutoff don't count, and months of
    which nothing else is known are FORA_DO_CORTE."""
    live = F.col("estado") != "FORA_DO_CORTE"
    has = lambda s: F.bool_or(F.col("estado") == s)
    months = parts.groupBy("fonte", "competencia").agg(
        F.bool_or(live).alias("vivo"),
        has("AMBIGUA").alias("ambigua"),
        has("EM_QUARENTENA").alias("quarentena"),
        F.bool_and((F.col("estado") == "AUSENTE") | ~live).alias("ausente"),
        F.array_sort(F.collect_set(F.when(F.col("estado") == "SELECIONADA", F.col("parte")))).alias("com_conteudo"),
        F.array_sort(F.collect_set(F.when(live, F.col("parte")))).alias("partes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("artifact_ids")))).alias("artifact_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("observation_ids")))).alias("observation_ids"),
    )
    declared = expected.groupBy("fonte", "competencia").agg(F.array_sort(F.collect_set("parte")).alias("esperadas"))
    joined = months.join(declared, ["fonte", "competencia"], "left")
    whole = F.coalesce((F.size(F.array_except("esperadas", "com_conteudo")) == 0) & (F.size(F.array_except("partes", "esperadas")) == 0), F.lit(False))
    state = F.when(~F.col("vivo"), "FORA_DO_CORTE").when(F.col("ambigua"), "AMBIGUA").when(F.col("quarentena"), "EM_QUARENTENA").when(F.col("ausente"), "AUSENTE").when(((F.size("partes") > 0) | F.col("esperadas").isNotNull()) & ~whole, "INCOMPLETA").otherwise("SELECIONADA")
    return joined.select("fonte", "competencia", state.alias("estado"), "artifact_ids", "observation_ids")


def rule_sources(rules: DataFrame, criteria: DataFrame, policy: str = "DOCUMENTADA") -> DataFrame:
    """(rule_id, fonte, base, deslocamento, resolvido, motivo): the policy's criterion for each rule's source.
    ATENDIMENTO and PROCESSAMENTO baselines ask every source for that month; the documented method
    takes a criterion only where source, base and offset are the rule's own. Unresolved rules say
    whether the source has no criterion or another one."""
    if policy in ("ATENDIMENTO", "PROCESSAMENTO"):
        return rules.select("rule_id", "fonte", F.lit(policy).alias("base"), F.lit(0).alias("deslocamento"), F.lit(True).alias("resolvido"), F.lit(None).cast("string").alias("motivo"))
    c = criteria.select(F.col("fonte").alias("c_fonte"), F.col("base").alias("c_base"), F.col("deslocamento").alias("c_desl")).distinct()
    same = (F.col("fonte") == F.col("c_fonte")) & F.col("base").eqNullSafe(F.col("c_base")) & F.col("deslocamento").eqNullSafe(F.col("c_desl"))
    some = c.select(F.col("c_fonte").alias("fonte"), F.lit(True).alias("ha")).distinct()
    found = F.col("c_fonte").isNotNull()
    why = F.when(~found, F.when(F.col("ha").isNull(), "CRITERIO_AUSENTE").otherwise("CRITERIO_DIVERGENTE"))
    return rules.join(some, "fonte", "left").join(c, same, "left").select("rule_id", "fonte", "base", "deslocamento", found.alias("resolvido"), why.alias("motivo"))


def _required_month(base: Column, offset: Column, resolved: Column) -> Column:
    own = F.when(base == "ATENDIMENTO", F.col("competencia_atendimento")).when(base == "PROCESSAMENTO", F.col("competencia_processamento"))
    return F.when(resolved, month_text(month_index(own) + offset))


def required_months(records: DataFrame, sources: DataFrame) -> DataFrame:
    """(row_id, rule_id, fonte, base, competencia_requerida): records x rules; the month is null where
    the record's base month is unknown or the criterion unresolved. ``sources`` has a row a rule."""
    wide = records.select("row_id", "competencia_atendimento", "competencia_processamento").crossJoin(F.broadcast(sources))
    month = _required_month(F.col("base"), F.col("deslocamento"), F.col("resolvido"))
    return wide.select("row_id", "rule_id", "fonte", "base", month.alias("competencia_requerida"))


def select_versions(required: DataFrame, obs: DataFrame, versions: DataFrame, expected: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """A selection for each required (record, rule): state, artifact ids and observation ids.

    Every (source, month) is decided once; the decisions, as many as there are months of sources,
    are then joined to the records. No month: NAO_RESOLVIDA; month never observed: AUSENTE."""
    return join_decisions(required, combine_parts(resolve_parts(obs, versions, cutoff), expected))


def join_decisions(required: DataFrame, decided: DataFrame) -> DataFrame:
    """Decisions by month (fonte, competencia, ...) joined to the months that records require."""
    joined = required.join(decided.withColumnRenamed("competencia", "competencia_requerida"), ["fonte", "competencia_requerida"], "left")
    state = F.when(F.col("competencia_requerida").isNull(), "NAO_RESOLVIDA").otherwise(F.coalesce("estado", F.lit("AUSENTE")))
    none = F.array().cast("array<string>")
    return joined.select("row_id", "rule_id", "fonte", "base", "competencia_requerida", state.alias("estado"), F.coalesce("artifact_ids", none).alias("artifact_ids"), F.coalesce("observation_ids", none).alias("observation_ids"))


def derive_selections(required: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Selections from a given snapshot set, by exact (fonte, base, month); months that it doesn't have are
    absent, without versions. A key that the set has twice is an error, since it would multiply records."""
    key = ["fonte", "base", "competencia_requerida"]
    if twice := repeated_snapshot_keys(snapshot).limit(1).collect():
        raise ValueError(f"the snapshot set has a key twice: {twice[0].asDict()}")
    joined = required.join(snapshot.select(*key, "estado", "artifact_ids"), key, "left")
    state = F.when(F.col("competencia_requerida").isNull(), "NAO_RESOLVIDA").otherwise(F.coalesce("estado", F.lit("AUSENTE")))
    return joined.withColumns({"estado": state, "artifact_ids": F.coalesce("artifact_ids", F.array().cast("array<string>"))})


def repeated_snapshot_keys(snapshot: DataFrame) -> DataFrame:
    """(fonte, base, competencia_requerida, n): keys that a snapshot set has more than once."""
    return snapshot.groupBy("fonte", "base", "competencia_requerida").agg(F.count("*").alias("n")).filter("n > 1")


def check_selections(sel: DataFrame, records: DataFrame, sources: DataFrame) -> DataFrame:
    """Selections whose base or month isn't the policy's (``required_months`` of the records), or whose
    state is unknown.

    Only selections that can be wrong meet their records, of which one row is moved, not one a rule.
    The ids are led by a hash: they begin alike, and the first bytes of a key decide how fast it is sorted."""
    states = ["SELECIONADA", "AUSENTE", "AMBIGUA", "INCOMPLETA", "EM_QUARENTENA", "FORA_DO_CORTE", "NAO_RESOLVIDA"]
    key = F.xxhash64("row_id").alias("chave")
    some = sel.filter(F.col("estado") != "NAO_RESOLVIDA").select(key, "row_id", "rule_id", "estado", "base", "competencia_requerida")
    own = records.select(key, "row_id", "competencia_atendimento", "competencia_processamento")
    rule = sources.select("rule_id", F.col("base").alias("r_base"), "deslocamento", "resolvido")
    met = some.join(own, ["chave", "row_id"]).join(F.broadcast(rule), "rule_id").withColumn("r_mes", _required_month(F.col("r_base"), F.col("deslocamento"), F.col("resolvido")))
    bad = ~F.col("estado").isin(states) | ~(F.col("base").eqNullSafe(F.col("r_base")) & F.col("competencia_requerida").eqNullSafe(F.col("r_mes")))
    return met.filter(bad).select("row_id", "rule_id", "estado", "base", "competencia_requerida", "r_base", "r_mes")


def observed_intervals(obs: DataFrame, key: tuple[str, ...] = ("fonte", "competencia", "parte")) -> DataFrame:
    """Runs of consecutive observations of the same content; not finding the file ends a run."""
    w = Window.partitionBy(*key).orderBy("observado_em", "observation_id")
    content = F.when(F.col("resultado") == "OBTIDO", F.col("artifact_id"))
    marked = obs.withColumn("conteudo", content).withColumn("novo", (~F.lag("conteudo").over(w).eqNullSafe(F.col("conteudo"))).cast("int"))
    islands = marked.withColumn("ilha", F.sum("novo").over(w)).filter(F.col("conteudo").isNotNull())
    return islands.groupBy(*key, "ilha", F.col("conteudo").alias("artifact_id")).agg(F.min("observado_em").alias("inicio"), F.max("observado_em").alias("fim"), F.count("*").alias("n_observacoes")).drop("ilha")


def version_integrity(obs: DataFrame, versions: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """The worst state of each version: quarantine first; an unfinished transfer makes OK unverified."""
    seen = as_known_at(obs, cutoff).filter(F.col("artifact_id").isNotNull()).groupBy("artifact_id").agg(F.bool_or(F.col("resultado") == "PARCIAL").alias("parcial"))
    severity = F.when(F.col("estado").startswith("QUARENTENA_"), 2).when(F.col("estado") == "NAO_VERIFICADO", 1).otherwise(0)
    worst = versions.groupBy("artifact_id").agg(F.max_by("estado", F.struct(severity, "estado")).alias("estado"))
    state = F.when((F.col("estado") == "OK") & F.coalesce("parcial", F.lit(False)), "NAO_VERIFICADO").otherwise(F.col("estado"))
    return worst.join(seen, "artifact_id", "left").select("artifact_id", state.alias("estado"))


def snapshot_set(sel: DataFrame, cutoff: Column | None = None, now: Column | None = None) -> DataFrame:
    """Distinct selections, one for each (fonte, base, month), all of one cutoff; ``congelado``: the
    cutoff has passed, so later observations can't change them. ``snapshot_id`` names the set."""
    cut = F.lit(None).cast("timestamp") if cutoff is None else cutoff
    passed = F.coalesce(cut < (F.current_timestamp() if now is None else now), F.lit(False))
    return sel.filter(F.col("competencia_requerida").isNotNull()).select("fonte", "base", "competencia_requerida", "estado", F.array_join("artifact_ids", ";").alias("artifact_ids")).distinct().withColumns({"corte": cut.cast("timestamp"), "congelado": passed})


def snapshot_id(snapshot: DataFrame) -> str:
    """The id of a set from its content, whatever the order of rows."""
    return "snap_" + logical_hash(snapshot.select("fonte", "base", "competencia_requerida", "estado", "artifact_ids", F.col("corte").cast("string").alias("corte")))[:32]


def latest_versions(obs: DataFrame, key: tuple[str, ...] = ("fonte", "competencia", "parte")) -> DataFrame:
    """The last content obtained for each file key."""
    got = obs.filter((F.col("resultado") == "OBTIDO") & F.col("artifact_id").isNotNull())
    return got.groupBy(*key).agg(F.max_by("artifact_id", F.struct("observado_em", "observation_id")).alias("artifact_id"), F.max("observado_em").alias("observado_em"))


def check_loaded_versions(loaded: DataFrame, selected: DataFrame) -> DataFrame:
    """(competencia, artifact_id, problema): loaded but not selected, selected but not loaded, or of a
    month that isn't SELECIONADA. ``loaded``: (competencia, artifact_id); ``selected``: with states."""
    chosen = selected.select("competencia", "estado", F.explode_outer("artifact_ids").alias("artifact_id"))
    l = loaded.select("competencia", "artifact_id").distinct().withColumn("carregado", F.lit(True))  # noqa: E741
    joined = l.join(chosen.withColumn("escolhido", F.lit(True)), ["competencia", "artifact_id"], "full")
    why = F.when(F.col("carregado") & (F.col("escolhido").isNull()), "NAO_SELECIONADO").when(F.col("estado") != "SELECIONADA", "ESTADO_INVALIDO").when(F.col("carregado").isNull() & F.col("artifact_id").isNotNull(), "NAO_CARREGADO")
    return joined.withColumn("problema", why).filter("problema is not null").select("competencia", "artifact_id", "problema")
