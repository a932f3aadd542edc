"""Rule evaluation: every (record, rule) gets one of four states; missing evidence is never a violation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datavouch.functions.months import month_index, month_text, valid_month
from datavouch.functions.tables import SENT_ROWS, made_once, sent, split_join, written
from datavouch.functions.text import full_match, present


@dataclass(frozen=True)
class Rule:
    """An existence rule: the record's key must be in the selected version of a reference table.

    ``record_key`` and ``aux_key`` are parallel; the first is the leading column. ``no_leading`` is
    the outcome where the leading key is absent (None: there is no such outcome). ``positive``: a
    count column that must be above zero. ``mapping``: codes that stand for the instrument.
    """

    rule_id: str
    family: str
    source: str
    base: str
    offset: int
    record_key: tuple[str, ...]
    aux_key: tuple[str, ...]
    no_leading: str | None = None
    positive: str | None = None
    mapping: tuple[tuple[str, str], ...] = ()
    instruments: tuple[str, ...] = ("C", "I", "P", "S", "A", "B")
    valid_on: str | None = None
    valid_from: str | None = None
    valid_to: str | None = None
    month_column: str = "dt_competencia"

    def fields(self) -> tuple[str, ...]:
        return tuple(c for c in self.record_key if c != "co_registro")


# Reasons by the state of a selection.
REASON_OF_SELECTION = {"AUSENTE": "ARQUIVO_AUSENTE", "AMBIGUA": "VERSAO_AMBIGUA", "INCOMPLETA": "COBERTURA_INSUFICIENTE", "EM_QUARENTENA": "ARQUIVO_EM_QUARENTENA", "FORA_DO_CORTE": "FORA_DO_CORTE", "NAO_RESOLVIDA": "VIGENCIA_NAO_RESOLVIDA"}
# End of the fixed values.


def _month(base: str | None) -> Column:
    return F.col({"ATENDIMENTO": "competencia_atendimento", "PROCESSAMENTO": "competencia_processamento"}[base or "PROCESSAMENTO"])


def _quarantined() -> Column:
    return F.coalesce(F.col("integridade_registro").startswith("QUARENTENA_"), F.lit(False))


def applicability(rule: Rule) -> Column:
    """Of a record with ``integridade_registro``, before its inputs are looked at."""
    out = F.when(_quarantined() | F.col("instrumento").isNull(), "DESCONHECIDA").when(~F.col("instrumento").isin(*rule.instruments), "NAO_APLICAVEL_DEMONSTRADA")
    if rule.valid_on:
        month = _month(rule.valid_on)
        outside = F.lit(False)
        if rule.valid_from:
            outside = outside | (month < rule.valid_from)
        if rule.valid_to:
            outside = outside | (month > rule.valid_to)
        out = out.when(month.isNull(), "DESCONHECIDA").when(outside, "NAO_APLICAVEL_DEMONSTRADA")
    return out.otherwise("APLICAVEL")


def _selection_reason(chosen: Column) -> Column:
    """Why the selection's state doesn't suffice; ``chosen`` is the reason where a version is selected."""
    out = F.when(F.col("sel_estado").isNull(), "VIGENCIA_NAO_RESOLVIDA")
    for state, why in REASON_OF_SELECTION.items():
        out = out.when(F.col("sel_estado") == state, why)
    return out.when(F.col("sel_estado") == "SELECIONADA", chosen).otherwise("VIGENCIA_NAO_RESOLVIDA")


def input_reasons(rule: Rule, layout: str = "OK", policy_resolved: bool = True) -> Column:
    """Sorted distinct reasons why the inputs of a (record, selection, scope) don't suffice."""
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in rule.fields()), F.lit(False))
    if rule.mapping:
        missing = missing | ~F.coalesce(F.col("instrumento").isin(*[a for a, _ in rule.mapping]), F.lit(False))
    of_state = _selection_reason(F.col("esc_motivo") if layout == "OK" else F.lit(layout))
    return present(F.lit(None if policy_resolved else "POLITICA_NAO_RESOLVIDA"), F.when(missing, "CAMPO_INSUFICIENTE"), of_state)


def auxiliary_status(aux: DataFrame | None, patterns: dict[str, str]) -> str:
    """OK, ARQUIVO_AUSENTE for no table, or LEIAUTE_INCOMPATIVEL for a missing or non-text column or
    any value outside its pattern (one pass)."""
    if aux is None:
        return "ARQUIVO_AUSENTE"
    kinds = dict(aux.dtypes)
    if any(kinds.get(c) != "string" for c in patterns):
        return "LEIAUTE_INCOMPATIVEL"
    bad = aux.agg(*[F.count_if(~full_match(F.col(c), p)).alias(c) for c, p in patterns.items()]).first()
    return "LEIAUTE_INCOMPATIVEL" if any(bad) else "OK"


def scopes(decided: DataFrame) -> DataFrame:
    """The selected scopes (escopo, competencia, artifact_id) of decisions by month (competencia,
    estado, artifact_ids). ``escopo`` names a month and its set of versions; there are as many as
    months of sources, never as records."""
    chosen = decided.filter("estado = 'SELECIONADA'").select("competencia", "artifact_ids").distinct()
    return chosen.select(scope_name(F.col("artifact_ids"), F.col("competencia")).alias("escopo"), "competencia", F.explode("artifact_ids").alias("artifact_id"))


def scope_name(artifacts: Column, month: Column) -> Column:
    return F.concat_ws("|", month, F.array_join(artifacts, ";"))


def scope_state(scope: DataFrame, aux: DataFrame, integrity: DataFrame, month_column: str) -> DataFrame:
    """(escopo, esc_motivo, todas_com_linhas, integridade_ok, pior_integridade) for each scope.

    A version that the table's versions don't know of is absent, then quarantine, then rows of
    another month, then no rows at all. The worst integrity is the first, by name, that isn't OK."""
    rows = aux.groupBy("artifact_id").agg(F.count("*").alias("linhas"), F.min(month_column).alias("mes_min"), F.max(month_column).alias("mes_max"), F.count_if(F.col(month_column).isNull()).alias("mes_nulo"))
    known = integrity.select("artifact_id", F.col("estado").alias("integridade"))
    j = scope.join(rows, "artifact_id", "left").join(known, "artifact_id", "left")
    state = F.coalesce("integridade", F.lit("NAO_VERIFICADO"))
    other = F.col("linhas").isNotNull() & ((F.col("mes_nulo") > 0) | (F.col("mes_min") != F.col("competencia")) | (F.col("mes_max") != F.col("competencia")))
    g = j.groupBy("escopo").agg(
        F.bool_or(F.col("integridade").isNull()).alias("fora"),
        F.bool_or(state.startswith("QUARENTENA_")).alias("quarentena"),
        F.bool_or(other).alias("divergente"),
        F.bool_and(F.col("linhas").isNull()).alias("vazio"),
        F.bool_and(F.col("linhas").isNotNull()).alias("todas_com_linhas"),
        F.bool_and(state == "OK").alias("integridade_ok"),
        F.coalesce(F.min(F.when(state != "OK", state)), F.lit("OK")).alias("pior_integridade"),
    )
    why = F.when(F.col("fora"), "ARQUIVO_AUSENTE").when(F.col("quarentena"), "ARQUIVO_EM_QUARENTENA").when(F.col("divergente"), "VIGENCIA_NAO_RESOLVIDA").when(F.col("vazio"), "COBERTURA_INSUFICIENTE")
    return g.select("escopo", why.alias("esc_motivo"), "todas_com_linhas", "integridade_ok", "pior_integridade")


def existence(keys: DataFrame, scope: DataFrame, aux: DataFrame, record_key: tuple[str, ...], aux_key: tuple[str, ...], positive: str | None = None) -> DataFrame:
    """``keys`` (escopo and the record key) with ``achados``, ``poderia`` and ``tem_lider``.

    achados: rows of the scope with the exact key (and a positive count); poderia: some row with a
    null would match if the null were known; tem_lider: the leading key occurs. No theta join: for
    each set of key columns, one equi-join on these brings all that rows whose other key columns are
    null say. Rows of the scope are counted by key once, and the sets are cut from those counts."""
    scoped = scope.select("escopo", "artifact_id").join(aux, "artifact_id")
    sure, unsure = (F.col(positive) > 0, F.col(positive).isNull()) if positive else (F.lit(True), F.lit(False))
    counted = scoped.groupBy("escopo", *aux_key).agg(F.count_if(sure).alias("certas"), F.count_if(unsure).alias("incertas"))
    maybe = (F.col("certas") > 0) | (F.col("incertas") > 0)
    names = dict(zip(aux_key, record_key, strict=True))
    out, could = keys, []
    for size in range(len(aux_key), -1, -1):
        for known in combinations(aux_key, size):
            mine = reduce(lambda a, b: a & b, [F.col(c).isNotNull() if c in known else F.col(c).isNull() for c in aux_key])
            wanted, flag = mine, f"poderia_{len(could)}"
            could.append(flag)
            if known == aux_key:
                facts = [F.sum("certas").alias("achados"), F.bool_or(F.col("incertas") > 0).alias(flag)]
            else:
                facts = [F.bool_or(mine & maybe).alias(flag)]
            if known == aux_key[:1]:
                wanted = F.col(aux_key[0]).isNotNull()
                facts.append(F.bool_or(F.lit(True)).alias("tem_lider"))
            side = counted.filter(wanted).groupBy("escopo", *known).agg(*facts)
            side = side.select("escopo", *[F.col(c).alias(names[c]) for c in known], *[c for c in side.columns if c not in ("escopo", *known)])
            out = out.join(side, ["escopo", *[names[c] for c in known]], "left")
    either = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in could])
    return out.select(*keys.columns, F.coalesce("achados", F.lit(0)).alias("achados"), either.alias("poderia"), F.coalesce("tem_lider", F.lit(False)).alias("tem_lider"))


def outcome(rule: Rule) -> Column:
    """The ordered outcomes of the existence test."""
    out = F.when(F.col("achados") > 0, "CORRESPONDENCIA").when(F.col("poderia"), "CAMPO_INSUFICIENTE")
    if rule.no_leading:
        out = out.when(~F.col("tem_lider"), rule.no_leading)
    return out.otherwise("AUSENCIA")


def absence_supported() -> Column:
    """Absence counts only if coverage is there, all versions are intact and have rows, and the month
    asked for is the record's own."""
    return F.col("cobertura_estado").eqNullSafe(F.lit("DISPONIVEL")) & F.coalesce("integridade_ok", F.lit(False)) & F.coalesce("todas_com_linhas", F.lit(False)) & F.col("mes_proprio")


def decide_state(applic: Column, complete: Column, incompatible: Column, reasons: Column | None = None) -> Column:
    """The truth table. Without ``reasons``, ``complete`` also says that there are none."""
    unsure = (applic == "DESCONHECIDA") | ~complete | incompatible.isNull()
    if reasons is not None:
        unsure = unsure | (F.size(reasons) > 0)
    return F.when(applic == "NAO_APLICAVEL_DEMONSTRADA", "NAO_APLICAVEL").when(unsure, "INCONCLUSIVO").when(incompatible, "VIOLACAO").otherwise("CONFORME")


def _valid(base: str) -> str:
    return f"_valido_{base}"


def _asked(rule: Rule) -> Column:
    """What one rule asks of a record, under names that all rules share; ``_valid(rule.base)`` says whether
    the record's own month is one."""
    code = F.create_map(*[F.lit(x) for p in rule.mapping for x in p])[F.col("instrumento")] if rule.mapping else None
    key = [code if c == "co_registro" else F.col(c) for c in rule.record_key]
    missing = reduce(lambda x, y: x | y, (c.isNull() for c in key))
    own, valid = _month(rule.base), F.col(_valid(rule.base))
    month = month_text(month_index(own) + rule.offset) if rule.offset else F.when(valid, own)
    columns = {"rule_id": F.lit(rule.rule_id), "familia": F.lit(rule.family), "sel_base": F.lit(rule.base), "sel_competencia": month, "k1": key[0], "k2": key[1] if len(key) > 1 else F.lit(""), "falta": missing, "previa": applicability(rule), "mes_proprio": month.eqNullSafe(own) if rule.offset else own.isNull() | valid}
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def _shared_aux(rules: list[Rule], aux: dict[str, DataFrame]) -> DataFrame:
    """The rows of all rules' reference tables as (rule_id, artifact_id, mes, k1, k2, n)."""
    parts = []
    for r in rules:
        n = F.col(r.positive).cast("long") if r.positive else F.lit(1).cast("long")
        k2 = F.col(r.aux_key[1]) if len(r.aux_key) > 1 else F.lit("")
        parts.append(aux[r.rule_id].select(F.lit(r.rule_id).alias("rule_id"), "artifact_id", F.col(r.month_column).alias("mes"), F.col(r.aux_key[0]).alias("k1"), k2.alias("k2"), n.alias("n")))
    return reduce(DataFrame.unionByName, parts)


def by_month(rules: list[Rule], decided: DataFrame, aux: DataFrame, integrity: DataFrame) -> DataFrame:
    """All that the records of one required month share under a rule: (rule_id, sel_competencia,
    sel_estado, sel_artefatos, escopo, esc_motivo, todas_com_linhas, integridade_ok,
    pior_integridade); a row for each rule and known month of its source. ``aux`` is as
    ``_shared_aux`` makes it; ``decided`` as ``combine_parts`` does."""
    of = F.explode(F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.source).alias("fonte")) for r in rules]))
    mine = decided.select(of.alias("r"), "*").filter("r.fonte = fonte").select("r.rule_id", "competencia", "estado", "artifact_ids")
    name = F.when(F.col("estado") == "SELECIONADA", F.concat_ws("|", "rule_id", scope_name(F.col("artifact_ids"), F.col("competencia"))))
    months = mine.select("rule_id", F.col("competencia").alias("sel_competencia"), F.col("estado").alias("sel_estado"), F.col("artifact_ids").alias("sel_artefatos"), name.alias("escopo"))
    tagged = aux.select(F.concat_ws("|", "rule_id", "artifact_id").alias("artifact_id"), "mes")
    tags = F.explode(F.array(*[F.lit(r.rule_id) for r in rules]))
    known = integrity.select(tags.alias("r"), "*").select(F.concat_ws("|", "r", "artifact_id").alias("artifact_id"), "estado")
    scope = _members(months).select("escopo", "competencia", F.concat_ws("|", "rule_id", "artifact_id").alias("artifact_id"))
    return months.join(scope_state(scope, tagged, known, "mes"), "escopo", "left")


#: Bits of a scope's number that tell the scopes of one rule apart.
SCOPE_BITS = 32


def numbered_scopes(rules: list[Rule], months: DataFrame) -> DataFrame:
    """``months`` with numbers for the names of scopes, which would be the widest part of every key: the
    rule's place above ``SCOPE_BITS``, and the scope's among the rule's (as many as months)."""
    place = F.row_number().over(Window.partitionBy("rule_id").orderBy("escopo"))
    rule = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.rule_id, i)])[F.col("rule_id")].cast("long")
    names = months.filter("escopo is not null").select("rule_id", "escopo").distinct().select("escopo", (F.shiftleft(rule, SCOPE_BITS) + place).alias("numero"))
    return months.join(names, "escopo", "left").withColumn("escopo", F.col("numero")).drop("numero")


def _scope_of(i: int) -> Column:
    """Whether a scope's number is one of the rule at a place."""
    return F.shiftright("escopo", SCOPE_BITS) == i


def _members(months: DataFrame) -> DataFrame:
    return months.filter("escopo is not null").select("rule_id", "escopo", F.col("sel_competencia").alias("competencia"), F.explode("sel_artefatos").alias("artifact_id"))


def _target() -> Column:
    """Whether the existence test is asked for a record at all."""
    return F.col("testado")


def _prior_reasons() -> Column:
    """Sorted distinct; as there are two at most, without a loop over an array."""
    why, field = F.col("porque"), F.lit("CAMPO_INSUFICIENTE")
    both = F.when(why == field, F.array(field)).when(why < field, F.array(why, field)).otherwise(F.array(field, why))
    return F.when(F.col("falta"), F.when(why.isNull(), F.array(field)).otherwise(both)).when(why.isNotNull(), F.array(why)).otherwise(F.array().cast("array<string>"))


_KEY = ["escopo", "k1", "k2"]


def key_outcomes(rules: list[Rule], asked: DataFrame, months: DataFrame, aux: DataFrame) -> DataFrame:
    """(*_KEY, achados, resultado) of the distinct keys ``asked``: each is tested once, however many
    records have it."""
    scope = _members(months).select("escopo", F.concat_ws("|", "rule_id", "artifact_id").alias("artifact_id"))
    rows = aux.select(F.concat_ws("|", "rule_id", "artifact_id").alias("artifact_id"), "k1", "k2", "n")
    found = existence(asked.select(*_KEY), scope, rows, ("k1", "k2"), ("k1", "k2"), "n")
    missing = F.lit(None).cast("string")
    for i, r in enumerate(rules):
        if r.no_leading:
            missing = F.when(_scope_of(i), r.no_leading).otherwise(missing)
    result = F.when(F.col("achados") > 0, "CORRESPONDENCIA").when(F.col("poderia"), "CAMPO_INSUFICIENTE").when(~F.col("tem_lider") & missing.isNotNull(), missing).otherwise("AUSENCIA")
    return found.select(*_KEY, "achados", result.alias("resultado"))


def _reasons() -> Column:
    """The reasons of an evaluation, from its inputs, ``resultado``, ``achou``, ``faltou`` and ``sustentada``."""
    some = lambda *x: F.array(*[F.lit(y) for y in x])
    none = F.array().cast("array<string>")
    unknown = F.when(_quarantined(), some("APLICABILIDADE_DESCONHECIDA", "ARQUIVO_EM_QUARENTENA")).otherwise(some("APLICABILIDADE_DESCONHECIDA", "CAMPO_INSUFICIENTE"))
    tested = F.when(F.col("achou") | F.col("faltou") & F.col("sustentada"), none).when(F.col("faltou"), some("COBERTURA_INSUFICIENTE")).otherwise(F.array("resultado"))
    return F.when(_target(), tested).when(F.col("previa") == "APLICAVEL", _prior_reasons()).when(F.col("previa") == "DESCONHECIDA", unknown).otherwise(none)


def _decided(rows: DataFrame) -> DataFrame:
    """``rows``, which have ``sustentada``, with the columns of an evaluation, step by step: one expression for all of them makes methods
    of generated code that the virtual machine only interprets (over 8000 bytes). The state is decided without the list of reasons, which
    is empty just where a tested row is ``certa`` (or the rule doesn't apply): filters by state are moved below the list with all that
    they are made of, and steps that don't read the reasons don't make them."""
    is_ = lambda x: F.coalesce(_target() & (F.col("resultado") == x), F.lit(False))
    out = rows.withColumns({"achou": is_("CORRESPONDENCIA"), "faltou": is_("AUSENCIA")})
    applies = F.when(is_("APLICABILIDADE_DESCONHECIDA"), "DESCONHECIDA").otherwise(F.col("previa"))
    out = out.withColumns({"certa": F.col("achou") | F.col("faltou") & F.col("sustentada"), "aplicabilidade": applies, "motivos": _reasons()})
    out = out.withColumns({"insumos_completos": F.size(F.array_remove("motivos", "APLICABILIDADE_DESCONHECIDA")) == 0, "incompatibilidade": F.when(F.col("certa"), F.col("faltou"))})
    return out.withColumn("estado", decide_state(F.col("aplicabilidade"), F.col("certa"), F.col("incompatibilidade")))


def _rules_of_many_keys(rules: list[Rule], asked: DataFrame) -> list[str]:
    """The rules whose tested keys don't fit among the ``SENT_ROWS`` that are sent, most keys first."""
    counts = asked.agg(*[F.count_if(_scope_of(i)).alias(f"n{i}") for i in range(len(rules))]).first()
    sizes, many = {r.rule_id: counts[i] for i, r in enumerate(rules)}, []
    for rule_id in sorted(sizes, key=sizes.get, reverse=True):
        if sum(n for r, n in sizes.items() if r not in many) <= SENT_ROWS:
            break
        many.append(rule_id)
    return many


def evaluate_rules(rules: list[Rule], records: DataFrame, aux: dict[str, DataFrame], decided: DataFrame, coverage: DataFrame, integrity: DataFrame, origins: set[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """All rules over all records, as many rows as records x rules. ``aux`` holds the reference table
    of each rule id.

    Records are read once for all rules: each becomes a row a rule, of the few columns needed. What
    depends on the month, the coverage cell or the file has few rows and is sent to all tasks; the
    existence test runs over distinct keys, and its outcomes come back by a join. Only the rows of rules
    with too many keys to be sent, and of these only those that are tested, are shuffled for it. All joins are left joins by unique keys, so no record is
    multiplied. ``testado`` says whether the existence test was asked, ``sustentada`` whether an absence
    would be proven. ``keep``: columns of the records that are kept. ``origins``: where the inputs come from; more than one is refused, as is a rule
    given twice."""
    if len({r.rule_id for r in rules}) < len(rules):
        raise ValueError("a rule is given twice")
    if origins is not None and len(origins) > 1:
        raise ValueError(f"inputs of different origins: {sorted(origins)}")
    own = sent(written(integrity.select("artifact_id", F.col("estado").alias("integridade_registro")), "own"))
    given = _shared_aux(rules, aux)
    known = by_month(rules, decided, given, integrity).withColumn("sel_estado", F.coalesce("sel_estado", F.lit("AUSENTE")))
    months = written(numbered_scopes(rules, known.withColumn("porque", _selection_reason(F.col("esc_motivo")))), "months")  # a row a month, not a record
    cover = coverage.filter(F.col("familia_regra").isin([r.family for r in rules])).select(F.col("familia_regra").alias("familia"), "instrumento", F.col("competencia").alias("competencia_processamento"), F.col("base_temporal").alias("sel_base"), F.col("estado").alias("cobertura_estado"))
    base = records.join(own, "artifact_id", "left").withColumn("integridade_registro", F.coalesce("integridade_registro", F.lit("NAO_VERIFICADO")))
    base = base.withColumns({_valid(r.base): valid_month(_month(r.base)) for r in rules})  # once for all rules
    own_columns = list(dict.fromkeys(["row_id", "artifact_id", "instrumento", "competencia_processamento", "integridade_registro", *keep]))
    # the array is made apart from where it is exploded, and so in a generated method of its own
    wide = base.select(*own_columns, F.array(*[_asked(r) for r in rules]).alias("q")).select(*own_columns, F.explode_outer("q").alias("q")).select(*own_columns, "q.*")
    absent = lambda c, unknown, missing: F.when(F.col("sel_estado").isNotNull(), F.col(c)).when(F.col("sel_competencia").isNull(), unknown).otherwise(missing)
    why, state = absent("porque", REASON_OF_SELECTION["NAO_RESOLVIDA"], REASON_OF_SELECTION["AUSENTE"]), absent("sel_estado", "NAO_RESOLVIDA", "AUSENTE")
    ready = wide.join(sent(months), ["rule_id", "sel_competencia"], "left").withColumns({"porque": why, "sel_estado": state, "sel_artefatos": F.coalesce("sel_artefatos", F.array().cast("array<string>"))})
    ready = ready.withColumn("testado", (F.col("previa") == "APLICAVEL") & ~F.col("falta") & F.col("porque").isNull())
    asked = written(ready.filter(_target()).groupBy(*_KEY).agg(F.count("*").alias("n")), "keys")
    facts = written(key_outcomes(rules, asked, months, given), "outcomes")
    tested = ready.join(sent(cover), ["familia", "instrumento", "competencia_processamento", "sel_base"], "left").withColumn("sustentada", absence_supported())
    many = _rules_of_many_keys(rules, asked)
    of = lambda some: reduce(lambda a, b: a | b, (_scope_of(i) for i, r in enumerate(rules) if r.rule_id in some), F.lit(False))
    apart = F.col("rule_id").isin(many) & _target()
    rest = tested.filter(~apart) if many else tested
    parts = [rest.join(F.broadcast(facts.filter(of([r.rule_id for r in rules if r.rule_id not in many]))), _KEY, "left")] if len(many) < len(rules) else [rest.withColumns({"achados": F.lit(0).cast("long"), "resultado": F.lit(None).cast("string")})]
    if many:
        # what all tested rows have in common isn't moved
        same = {"testado": F.lit(True), "falta": F.lit(False), "previa": F.lit("APLICAVEL"), "porque": F.lit(None).cast("string"), "sel_estado": F.lit("SELECIONADA")}
        moved = split_join(tested.filter(apart).drop(*same), facts.filter(of(many)), _KEY, asked, F.xxhash64("row_id"))
        parts.append(moved.withColumns(same))
    tested = reduce(DataFrame.unionByName, parts)
    tested = _decided(tested)
    found = F.when(_target(), F.coalesce("achados", F.lit(0))).otherwise(0).cast("long")
    key = F.when(F.col("k2") == "", F.col("k1")).otherwise(F.concat_ws("|", "k1", "k2"))
    return tested.select("row_id", "rule_id", "estado", "aplicabilidade", "insumos_completos", "incompatibilidade", "motivos", "artifact_id", "instrumento", "sel_base", "sel_competencia", "sel_estado", "sel_artefatos", F.coalesce("cobertura_estado", F.lit("AUSENTE")).alias("cobertura"), F.coalesce("pior_integridade", F.lit("NAO_VERIFICADO")).alias("integridade"), "integridade_registro", found.alias("n_resultados"), key.alias("chave"), "testado", "sustentada", *[c for c in keep if c not in ("row_id", "artifact_id", "instrumento")])


def evaluate_rule(rule: Rule, records: DataFrame, aux: DataFrame, decided: DataFrame, coverage: DataFrame, integrity: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each record."""
    return evaluate_rules([rule], records, {rule.rule_id: aux}, decided, coverage, integrity, keep=keep)


def check_invariant(records: DataFrame, evals: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row: records, rules, evaluations and whether the latter are their product; the run's id is
    the hash of the rules and of what was evaluated, whatever the order of rows."""
    from datavouch.functions.identity import content_id, multiset_fingerprint

    n = records.agg(F.count("*").alias("registros"))
    content = multiset_fingerprint(evals.select("row_id", "rule_id", "estado"))
    j = n.crossJoin(content).withColumns({"regras": F.lit(",".join(sorted(r.rule_id for r in rules))), "n_regras": F.lit(len(rules)).cast("long")})
    return j.select("registros", "n_regras", F.col("n_rows").alias("avaliacoes"), (F.col("n_rows") == F.col("registros") * F.col("n_regras")).alias("completo"), content_id("val_", "regras", "n_rows", *[f"limb_{i}" for i in range(4)]).alias("run_id"))


def single_result(state: Column) -> Column:
    """A record's outcome under one rule alone."""
    return F.when(state == "VIOLACAO", "ALERTA").when(state == "CONFORME", "SEM_VIOLACAO_VERIFICADA").otherwise("ABSTENCAO")


def _evidence_fields(artifacts: Column | None = None) -> dict[str, Column]:
    """``artifacts``: the selected versions as one text, where they are that already."""
    na = F.col("estado") == "NAO_APLICAVEL"
    kind = F.when(na, "APLICABILIDADE").when(F.col("estado") == "CONFORME", "VINCULO_ENCONTRADO").when(F.col("estado") == "VIOLACAO", "AUSENCIA_NA_FONTE")
    return {
        "tipo": kind,
        "rule_id": F.col("rule_id"),
        "consulta": F.when(na, "aplicabilidade").otherwise("existencia"),
        "parametros": F.when(na, F.to_json(F.struct("instrumento"), {"ignoreNullFields": "false"})).otherwise(F.to_json(F.struct("chave"), {"ignoreNullFields": "false"})),
        "conjunto": F.when(~na, F.concat(F.lit("aux_"), "rule_id")),
        "artifact_ids": F.when(na, F.col("artifact_id")).otherwise(F.array_join("sel_artefatos", ";") if artifacts is None else artifacts),
        "cobertura": F.when(na, "DISPONIVEL").otherwise(F.col("cobertura")),
        "integridade": F.when(na, F.col("integridade_registro")).otherwise(F.col("integridade")),
        "n_resultados": F.when(na, 0).otherwise(F.col("n_resultados")).cast("string"),
        "chaves_amostra": F.when(~na & (F.col("n_resultados") > 0), F.col("chave")),
    }


def evidence_id() -> Column:
    """The id of an evaluation's evidence: the hash of its content; null for inconclusive ones."""
    return F.when(F.col("estado") != "INCONCLUSIVO", _digest(_evidence_fields().values()))


def _digest(fields) -> Column:
    return F.concat(F.lit("ev_"), F.sha2(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in fields]), 256))


def _evidence_content(evals: DataFrame) -> DataFrame:
    """Distinct contents of evidence, under the names that ``_evidence_fields`` reads: each field is made of
    these, most of them several times, so they are what is moved and compared."""
    na = F.col("estado") == "NAO_APLICAVEL"
    only, but = lambda c: F.when(na, F.col(c)).alias(c), lambda c: F.when(~na, F.col(c)).alias(c)
    return evals.filter("estado <> 'INCONCLUSIVO'").select("rule_id", "estado", *[only(c) for c in ("instrumento", "artifact_id", "integridade_registro")], *[but(c) for c in ("chave", "cobertura", "integridade", "n_resultados")], F.when(~na, F.array_join("sel_artefatos", ";")).alias("versoes")).distinct()


def evidence(evals: DataFrame, datasets: dict[str, str] | None = None) -> DataFrame:
    """Evidence of violations, matches and proven inapplicability; its id is the hash of its content.
    ``datasets``: the hash of each rule's reference table, kept beside it."""
    fields = _evidence_fields(F.col("versoes"))
    rows = _evidence_content(evals).select(*[c.alias(n) for n, c in fields.items()])
    rows = rows.select(_digest(F.col(n) for n in fields).alias("ev_id"), *fields)  # hashed where each is there once
    if datasets is None:
        return rows
    hashes = F.create_map(*[F.lit(x) for p in datasets.items() for x in p])
    return rows.withColumn("conjunto_hash", F.when(F.col("conjunto").isNotNull(), hashes[F.col("rule_id")]))


def known_apart(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``known`` (ev_id, rule_id, ...), stored, in two: the evidence of rules that have little of it, which is cited by most
    evaluations and is sent to all tasks, and the rest."""
    known = written(known, "known")
    sizes = {r.rule_id: r.n for r in known.groupBy("rule_id").agg(F.count("*").alias("n")).collect()}
    few, room = [], SENT_ROWS
    for rule_id in sorted((r for r in sizes if r is not None), key=sizes.get):
        room -= sizes[rule_id]
        if room < 0:
            break
        few.append(rule_id)
    mine = F.coalesce(F.col("rule_id").isin(few), F.lit(False))
    return known.filter(mine), known.filter(~mine)


def with_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` left-joined with ``known`` (ev_id, perhaps rule_id, and other columns) by ``ev_id``. Rows that cite
    evidence of rules with little of it, and those that cite none, stay where they are: only the others are shuffled.
    Both kinds are read from ``rows``, which should come from a stored table."""
    few, rest = known_apart(known if "rule_id" in known.columns else known.withColumn("rule_id", F.lit("")))
    names = [c for c in known.columns if c not in ("ev_id", "rule_id")]
    near = made_once(rows, "ev_id").join(F.broadcast(few.select("ev_id", *names, F.lit(True).alias("_near"))), "ev_id", "left")
    done = F.col("_near").isNotNull() | F.col("ev_id").isNull()
    far = near.filter(~done).drop("_near", *names).join(rest.select("ev_id", *names), "ev_id", "left")
    return near.filter(done).drop("_near").unionByName(far)


def validate_evaluations(evals: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(row_id, rule_id, problema): rows that break the output contract.

    The state must be the truth table's; a violation or match needs a selected version; an
    inconclusive row needs a reason; all others need evidence, their ``ev_id`` (as computed where the
    column is absent), which must be among ``known`` (ev_id, perhaps rule_id) if that is given. Only rows without
    another problem are looked up there."""
    expected = decide_state(F.col("aplicabilidade"), F.col("insumos_completos"), F.col("incompatibilidade"), F.col("motivos"))
    rows = evals if "ev_id" in evals.columns else evals.withColumn("ev_id", evidence_id())
    problem = (
        F.when(~F.col("estado").eqNullSafe(expected), "ESTADO_DIVERGENTE")
        .when(F.col("estado").isin("VIOLACAO", "CONFORME") & ~F.col("sel_estado").eqNullSafe(F.lit("SELECIONADA")), "SELECAO_INVALIDA")
        .when((F.col("estado") == "INCONCLUSIVO") & (F.size("motivos") == 0), "SEM_MOTIVO")
    )
    cites = F.col("estado") != "INCONCLUSIVO"
    if known is None:
        return rows.withColumn("problema", problem.when(cites & F.col("ev_id").isNull(), "SEM_EVIDENCIA")).filter("problema is not null").select("row_id", "rule_id", "problema")
    rows = made_once(rows.select("row_id", "rule_id", F.when(cites, F.col("ev_id")).alias("ev_id"), cites.alias("_cites"), problem.alias("problema")), "ev_id")
    rows = rows.filter("_cites or problema is not null").withColumn("problema", F.coalesce("problema", F.when(F.col("_cites") & F.col("ev_id").isNull(), "SEM_EVIDENCIA")))
    rows = rows.withColumn("ev_id", F.when(F.col("problema").isNull(), F.col("ev_id"))).drop("_cites")
    j = with_known(rows, known.select(*[c for c in ("ev_id", "rule_id") if c in known.columns], F.lit(True).alias("_known")))
    lost = F.when(F.col("_known").isNull(), "SEM_EVIDENCIA")
    return j.withColumn("problema", F.coalesce("problema", lost)).filter("problema is not null").select("row_id", "rule_id", "problema")


_LISTS = {"violacoes": "VIOLACAO", "conformes": "CONFORME", "inconclusivas": "INCONCLUSIVO", "nao_aplicaveis": "NAO_APLICAVEL"}


def _result() -> Column:
    return F.when(F.size("violacoes") > 0, "ALERTA").when((F.size("inconclusivas") > 0) | (F.size("conformes") == 0), "ABSTENCAO").otherwise("SEM_VIOLACAO_VERIFICADA")


def aggregate_records(evals: DataFrame, failures: DataFrame | None = None, known: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Four sorted rule lists and the outcome of each record; records with failures have none. Where all
    rule ids are ``known``, they are counted instead of listed, so rows are combined before they are moved
    and need no sorting. ``keep``: columns of the records, the same in all of a record's evaluations."""
    if failures is not None:
        evals = evals.join(failures.select("row_id").distinct(), "row_id", "left_anti")
    if known:
        counts = evals.groupBy("row_id", *keep).agg(*[F.count_if((F.col("estado") == s) & (F.col("rule_id") == r)).cast("int").alias(f"{n}_{i}") for n, s in _LISTS.items() for i, r in enumerate(sorted(known))])
        lists = {n: F.flatten(F.array(*[F.array_repeat(F.lit(r), F.col(f"{n}_{i}")) for i, r in enumerate(sorted(known))])) for n in _LISTS}
        return counts.select("row_id", *keep, *[c.alias(n) for n, c in lists.items()]).withColumn("resultado", _result())
    grouped = evals.groupBy("row_id", *keep).agg(*[F.array_sort(F.collect_list(F.when(F.col("estado") == s, F.col("rule_id")))).alias(n) for n, s in _LISTS.items()])
    return grouped.withColumn("resultado", _result())


def check_aggregates(aggs: DataFrame, evals: DataFrame) -> DataFrame:
    """Stored aggregates that the evaluations don't give, and the other way round."""
    again = aggregate_records(evals).select(*aggs.columns)
    return aggs.exceptAll(again).withColumn("lado", F.lit("GRAVADO")).unionByName(again.exceptAll(aggs).withColumn("lado", F.lit("RECALCULADO")))
