"""Evidence re-execution, claims, provenance and repair candidates, for all records at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datavouch.functions.months import month_shift
from datavouch.functions.tables import made_once, sent, written
from datavouch.operators import rules


def reverify_evidence(evidence: DataFrame, counted: DataFrame) -> DataFrame:
    """(ev_id, citados, recontados, divergente): matches counted again in the cited versions.
    ``counted``: (rule_id, artifact_id, chave, n) from the reference tables as they are now."""
    ev = evidence.filter("tipo <> 'APLICABILIDADE'").select("ev_id", "rule_id", F.get_json_object("parametros", "$.chave").alias("chave"), F.col("n_resultados").try_cast("long").alias("citados"), F.explode(F.split("artifact_ids", ";")).alias("artifact_id"))
    j = ev.join(counted, ["rule_id", "artifact_id", "chave"], "left")
    return j.groupBy("ev_id", "citados").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("recontados")).withColumn("divergente", F.col("citados") != F.col("recontados"))


# The parameters of each query that evidence may cite.
QUERY_PARAMETERS = {"existencia": ("chave",), "aplicabilidade": ("instrumento",)}
# End of the fixed values.


def verify_evidence(evidence: DataFrame, manifest: DataFrame, counted: DataFrame) -> DataFrame:
    """(ev_id, consulta, recontados, divergencias, reproduzida): all that evidence says, against the data
    sets as they are now.

    ``evidence`` is as ``rules.evidence`` makes it with the hashes of the data sets; ``manifest`` has a
    row for each data set (conjunto, hash_declarado, hash_atual, artifact_ids): the hash it is stored
    under, that of its rows now, and its files; ``counted`` as for ``reverify_evidence``. Divergences, in
    this order: the query isn't known; the data set is gone; its hash is another, stored or recomputed;
    files are cited that it doesn't have; the query has other parameters; and matches are more or fewer
    than cited. Only queries of existence count matches; evidence of inapplicability cites no data set."""
    ev = evidence.withColumns({"cited": F.array_compact(F.split(F.coalesce("artifact_ids", F.lit("")), ";")), "nomes": F.array_sort(F.json_object_keys("parametros"))})
    known = sent(written(manifest.select("conjunto", "hash_declarado", "hash_atual", F.col("artifact_ids").alias("_files"), F.lit(True).alias("_known")), "manifest"))
    j = ev.join(known, "conjunto", "left")
    counts = reverify_evidence(evidence, counted).select("ev_id", "recontados", F.col("divergente").alias("_counts"))
    j = j.join(counts, "ev_id", "left")
    parameters = F.create_map(*[x for k, v in QUERY_PARAMETERS.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in sorted(v)]))])
    unknown = ~F.col("consulta").isin(*QUERY_PARAMETERS)
    cites, exists = F.col("conjunto").isNotNull(), F.coalesce("_known", F.lit(False))
    wrong = {
        "consulta_desconhecida": unknown,
        "conjunto_ausente": cites & ~exists,
        "hash_divergente": cites & exists & ~(F.col("conjunto_hash").eqNullSafe(F.col("hash_declarado")) & F.col("conjunto_hash").eqNullSafe(F.col("hash_atual"))),
        "artefato_fora_do_conjunto": cites & exists & (F.size(F.array_except("cited", F.coalesce("_files", F.array().cast("array<string>")))) > 0),
        "parametros_divergentes": ~unknown & ~F.coalesce(F.col("nomes") == F.try_element_at(parameters, "consulta"), F.lit(False)),
        "n_resultados_divergente": F.col("consulta").eqNullSafe(F.lit("existencia")) & cites & exists & F.coalesce("_counts", F.lit(True)),
    }
    found = F.array_compact(F.array(*[F.when(c, k) for k, c in wrong.items()]))
    return j.select("ev_id", "consulta", "recontados", found.alias("divergencias"), (F.size(found) == 0).alias("reproduzida"))


# Sentences of the claims by state, of selections and of outcomes.
CLAIMS = {"VIOLACAO": "A regra %s nao encontra a chave %s na versao aplicavel.", "CONFORME": "A regra %s encontra a chave %s na versao aplicavel.", "INCONCLUSIVO": "A regra %s nao pode ser decidida para a chave %s.", "NAO_APLICAVEL": "A regra %s nao se aplica (%s)."}
SELECTION_CLAIM = "Para a regra %s, a versao do mes %s esta %s."
RESULT_CLAIM = "O resultado do registro e %s."
# End of the fixed values.


def _evaluation() -> Column:
    return F.concat_ws("/", F.lit("avaliacao"), "row_id", "rule_id")


def claims(evals: DataFrame, aggregates: DataFrame | None = None) -> DataFrame:
    """(row_id, assunto, afirmacao, referencias): a sentence for each evaluation, which refers to the
    evaluation and its evidence; one for its selection, which refers to the versions; and one for each
    outcome of ``aggregates``, which refers to the rules that it rests on."""
    text = F.lit(None).cast("string")
    for state, pattern in CLAIMS.items():
        text = F.when(F.col("estado") == state, F.format_string(pattern, "rule_id", F.coalesce("chave", F.lit("")))).otherwise(text)
    claim = lambda subject, said, refers: F.struct(subject.alias("assunto"), said.alias("afirmacao"), refers.alias("referencias"))
    own = claim(F.col("rule_id"), text, F.array_compact(F.array(_evaluation(), rules.evidence_id())))
    chosen = F.format_string(SELECTION_CLAIM, "rule_id", F.coalesce("sel_competencia", F.lit("?")), "sel_estado")
    selection = claim(F.concat(F.lit("selecao/"), "rule_id"), chosen, F.transform("sel_artefatos", lambda a: F.concat(F.lit("artefato/"), a)))
    out = evals.select("row_id", F.explode(F.array(own, selection)).alias("c")).select("row_id", "c.*")
    if aggregates is None:
        return out
    rests = F.when(F.col("resultado") == "ALERTA", F.col("violacoes")).when(F.col("resultado") == "ABSTENCAO", F.concat("inconclusivas", "nao_aplicaveis")).otherwise(F.col("conformes"))
    result = aggregates.select("row_id", F.lit("resultado").alias("assunto"), F.format_string(RESULT_CLAIM, "resultado").alias("afirmacao"), F.transform(rests, lambda r: F.concat(F.lit("regra/"), r)).alias("referencias"))
    return out.unionByName(result)


#: Kinds of nodes of which there are few, however many records: files and rules.
FEW = ("artefato/", "regra/")


def unresolved_references(claimed: DataFrame, known: DataFrame) -> DataFrame:
    """(row_id, assunto, referencia): references of claims that no known node (nome) has. References to the kinds of ``FEW``
    nodes, as most are, stay where they are while the known nodes of these kinds are few enough to be sent."""
    each = claimed.select("row_id", "assunto", F.explode_outer("referencias").alias("referencia")).filter("referencia is not null")
    few = reduce(lambda a, b: a | b, (F.col("referencia").startswith(k) for k in FEW))
    names = known.select(F.col("nome").alias("referencia"))
    near = each.filter(few).join(sent(written(names.filter(few).distinct(), "names")), "referencia", "left_anti")
    far = each.filter(~few).join(names.filter(~few), "referencia", "left_anti")
    return near.unionByName(far).select("row_id", "assunto", "referencia")


def provenance_edges(evals: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """(sujeito, relacao, objeto): datasets from their files, records from datasets, evidence from
    the rule's table and the versions, evaluations from records, rules and evidence.
    ``datasets``: (artifact_id, dataset) of the records' files; without it records come from files."""
    edge = lambda df, subject, relation, target: df.select(subject.alias("sujeito"), F.lit(relation).alias("relacao"), target.alias("objeto"))
    name, record, file = _evaluation(), F.concat(F.lit("registro/"), "row_id"), F.concat(F.lit("artefato/"), "artifact_id")
    if datasets is None:
        parts = [edge(evals, record, "DERIVADO_DE", file).distinct()]
    else:
        owned = evals.select("row_id", "artifact_id").distinct().join(datasets.select("artifact_id", "dataset").distinct(), "artifact_id")
        dataset = F.concat(F.lit("conjunto/"), "dataset")
        parts = [edge(datasets, dataset, "DERIVADO_DE", file).distinct(), edge(owned, record, "DERIVADO_DE", dataset)]
    parts.append(evals.select(name.alias("sujeito"), F.lit("USOU").alias("relacao"), F.explode_outer(_needed()).alias("objeto")))
    shown = evals.withColumn("ev_id", rules.evidence_id()).filter("estado <> 'INCONCLUSIVO'")
    evidence = F.concat(F.lit("evidencia/"), "ev_id")
    rests = F.when(F.col("estado") == "NAO_APLICAVEL", F.array(file)).otherwise(F.concat(F.array(F.concat(F.lit("conjunto/aux_"), "rule_id")), F.transform("sel_artefatos", lambda a: F.concat(F.lit("artefato/"), a))))
    parts.append(edge(shown.select("ev_id", F.explode(rests).alias("o")).distinct(), evidence, "DERIVADO_DE", F.col("o")))
    return reduce(DataFrame.unionByName, parts)


def provenance_nodes(evals: DataFrame) -> DataFrame:
    """(nome): what the edges of ``provenance_edges(evals)`` name, without making the edges. Evaluations, records and evidence
    may be named more than once, as often as they are cited; of the others each is there once."""
    cites = F.col("estado") != "INCONCLUSIVO"
    file, found, own = F.concat(F.lit("artefato/"), "artifact_id"), F.concat(F.lit("evidencia/"), rules.evidence_id()), [_evaluation(), F.concat(F.lit("registro/"), "row_id")]
    many = evals.select(F.explode_outer(F.when(cites, F.array(*own, found)).otherwise(F.array(*own))).alias("nome"))
    shared = evals.select("rule_id", "artifact_id", F.when(cites & (F.col("estado") != "NAO_APLICAVEL"), F.col("sel_artefatos")).alias("sel_artefatos")).distinct()
    aux = F.when(F.col("sel_artefatos").isNotNull(), F.concat(F.array(F.concat(F.lit("conjunto/aux_"), "rule_id")), F.transform("sel_artefatos", lambda a: F.concat(F.lit("artefato/"), a)))).otherwise(F.array().cast("array<string>"))
    return many.unionByName(shared.select(F.explode(F.concat(F.array(file, F.concat(F.lit("regra/"), "rule_id")), aux)).alias("nome")).distinct())


def _needed() -> Column:
    """What an evaluation must have used: the record, the rule, and its evidence unless it is inconclusive."""
    own = [F.concat(F.lit("registro/"), "row_id"), F.concat(F.lit("regra/"), "rule_id")]
    return F.when(F.col("estado") != "INCONCLUSIVO", F.array(*own, F.concat(F.lit("evidencia/"), rules.evidence_id()))).otherwise(F.array(*own))


def missing_edges(edges: DataFrame, evals: DataFrame) -> DataFrame:
    """(sujeito, objeto): edges that evaluations need and don't have: to the record and the rule,
    and to their evidence unless they are inconclusive. An evaluation is moved as one row with all that it needs, and
    edges by their subject alone, which only those from evaluations can match."""
    have = edges.filter(F.col("sujeito").startswith("avaliacao/")).select("sujeito", "objeto").repartition("sujeito").groupBy("sujeito").agg(F.collect_set("objeto").alias("tem"))
    need = evals.select(_evaluation().alias("sujeito"), _needed().alias("objetos"))
    lost = F.array_except("objetos", F.coalesce("tem", F.array().cast("array<string>")))
    return need.join(have, "sujeito", "left").select("sujeito", F.explode(lost).alias("objeto"))


def limitations(evals: DataFrame, synthetic: bool = False) -> DataFrame:
    """(row_id, limitacoes): what a reader must keep in mind about a record's result; of a run over
    ``synthetic`` data, that too."""
    g = evals.groupBy("row_id").agg(F.bool_or(F.col("estado") == "VIOLACAO").alias("v"), F.bool_or(F.col("sel_estado") == "SELECIONADA").alias("s"))
    return g.select("row_id", F.array_compact(F.array(F.lit("NAO_E_CAUSA_OFICIAL"), F.lit("RETROSPECTIVO"), F.when(F.col("s"), "INSTANTANEO"), F.when(F.col("v"), "AUSENCIA"), F.lit("DADOS_SINTETICOS" if synthetic else None))).alias("limitacoes"))


def check_bundles(evals: DataFrame, known: DataFrame) -> DataFrame:
    """(row_id, rule_id, problema): evaluations whose evidence doesn't bear them. ``evals`` has
    ``ev_id``, what the evaluation cites; ``known`` is the evidence (ev_id, tipo, artifact_ids, and rule_id where rules
    with little evidence are to be told from others).

    Cited evidence must exist; a violation needs evidence of absence, from intact and covered
    versions; the versions that evidence cites must be the selected ones (for inapplicability the
    record's own file)."""
    ev = known.select("ev_id", *[c for c in ("rule_id",) if c in known.columns], F.col("tipo").alias("ev_tipo"), F.col("artifact_ids").alias("ev_artefatos"))
    # only what the checks need is moved
    allowed = F.when(F.col("estado") == "NAO_APLICAVEL", F.array("artifact_id")).otherwise(F.col("sel_artefatos"))
    usable = (F.col("sel_estado") == "SELECIONADA") & (F.col("integridade") == "OK") & (F.col("cobertura") == "DISPONIVEL")
    violated = F.coalesce(F.col("estado") == "VIOLACAO", F.lit(False))
    cited = evals.select("row_id", "rule_id", "ev_id", violated.alias("violada"), F.coalesce(usable, F.lit(False)).alias("usavel"), allowed.alias("permitidos"))
    j = rules.with_known(made_once(cited, "ev_id").filter("ev_id is not null or violada"), ev)  # without evidence only violations are at fault
    why = (
        F.when(F.col("ev_id").isNotNull() & F.col("ev_tipo").isNull(), "EVIDENCIA_INEXISTENTE")
        .when(F.col("violada") & ~(F.col("usavel") & F.coalesce(F.col("ev_tipo") == "AUSENCIA_NA_FONTE", F.lit(False))), "AUSENCIA_NAO_UTILIZAVEL")
        .when(F.size(F.array_except(F.split("ev_artefatos", ";"), "permitidos")) > 0, "ARTEFATO_NAO_SELECIONADO")
    )
    return j.withColumn("problema", why).filter("problema is not null").select("row_id", "rule_id", "problema")


# The operations, their cost, authority and governance.
OPERATIONS = {"INCLUIR_CBO": (1, "DESCONHECIDA", "DESCONHECIDA"), "RECLASSIFICAR_CBO": (2, "DESCONHECIDA", "DESCONHECIDA"), "CADASTRAR_ESTABELECIMENTO": (3, "DESCONHECIDA", "DESCONHECIDA")}
OUTSIDE_AUTHORITIES = ("GESTOR_ESTADUAL", "MINISTERIO_SAUDE")
# End of the fixed values.
_PAIR = ["competencia", "cnes", "cbo"]


def repair_candidates(violations: DataFrame, pairs: DataFrame, establishments: DataFrame) -> DataFrame:
    """(competencia, cnes, cbo, operacao, custo, origem, admissivel, depende_de): single operations
    that could clear each violated pair. Adding the pair and reclassifying another occupation that
    has links need the establishment (``establishments``: competencia, cnes); where it is absent they
    depend on its registration, which is admissible just there. The violated pairs are stored, so the
    plan that finds them is there once."""
    wanted = violations.select(*_PAIR).distinct()
    there = establishments.select("competencia", "cnes").distinct().withColumn("existe", F.lit(True))
    linked = pairs.filter("n_vinculos > 0").select("competencia", "cnes", F.col("cbo").alias("origem")).distinct()
    j = written(wanted.join(there, ["competencia", "cnes"], "left").withColumn("existe", F.coalesce("existe", F.lit(False))), "wanted")
    cost = lambda op: F.lit(OPERATIONS[op][0])
    none = F.lit(None).cast("string")
    needs = F.when(~F.col("existe"), "CADASTRAR_ESTABELECIMENTO")
    add = j.select(*_PAIR, F.lit("INCLUIR_CBO").alias("operacao"), cost("INCLUIR_CBO").alias("custo"), none.alias("origem"), F.col("existe").alias("admissivel"), needs.alias("depende_de"))
    move = j.join(linked, ["competencia", "cnes"]).filter("origem <> cbo").select(*_PAIR, F.lit("RECLASSIFICAR_CBO").alias("operacao"), cost("RECLASSIFICAR_CBO").alias("custo"), "origem", F.col("existe").alias("admissivel"), needs.alias("depende_de"))
    new = j.filter("not existe").select(*_PAIR, F.lit("CADASTRAR_ESTABELECIMENTO").alias("operacao"), cost("CADASTRAR_ESTABELECIMENTO").alias("custo"), none.alias("origem"), F.lit(True).alias("admissivel"), none.alias("depende_de"))
    return add.unionByName(move).unionByName(new)


def repair_plans(candidates: DataFrame, most: int = 3, budget: int | None = None) -> DataFrame:
    """(competencia, cnes, cbo, operacoes, origens, custo, delta): sequences of up to ``most``
    operations on a pair that can be carried out in their order, whatever they achieve: what an
    operation depends on comes before it, and none is done twice. ``delta`` is the change of each
    occupation's links. With ``budget``, plans of higher cost are left out and ``minimo_provado`` is
    false where that may have cut something."""
    one = written(candidates.select(*_PAIR, "operacao", "origem", "custo", "depende_de", F.concat_ws(":", "operacao", F.coalesce("origem", F.lit(""))).alias("nome")), "operations")
    plans = one.select(*_PAIR, F.array("nome").alias("nomes"), F.array("operacao").alias("operacoes"), F.array(F.coalesce("origem", F.lit(""))).alias("origens"), "custo", F.array_compact(F.array("depende_de")).alias("precisa"))
    found = plans
    least = None if budget is None else one.agg(F.min("custo")).first()[0]
    for _ in range(most - 1):
        if least is not None:
            plans = plans.filter(F.col("custo") + least <= budget)  # others can't be made longer
        longer = plans.join(one.select(*_PAIR, "nome", "operacao", F.coalesce("origem", F.lit("")).alias("origem"), F.col("custo").alias("mais"), "depende_de"), _PAIR)
        # names ascend but for what others depend on, which goes first: each set is made once
        after = (F.col("nome") > F.element_at("nomes", -1)) & ~F.array_contains("nomes", F.col("nome"))
        plans = longer.filter(after if budget is None else after & (F.col("custo") + F.col("mais") <= budget)).select(*_PAIR, F.concat("nomes", F.array("nome")).alias("nomes"), F.concat("operacoes", F.array("operacao")).alias("operacoes"), F.concat("origens", F.array("origem")).alias("origens"), (F.col("custo") + F.col("mais")).alias("custo"), F.array_distinct(F.concat("precisa", F.array_compact(F.array("depende_de")))).alias("precisa"))
        found = found.unionByName(plans)
    ready = found.filter(F.size(F.array_except("precisa", "operacoes")) == 0)
    within = F.lit(True) if budget is None else F.col("custo") <= budget
    gain = F.array_repeat(F.struct(F.col("cbo").alias("cbo"), F.lit(1).alias("n")), F.size(F.filter("operacoes", lambda o: o != "CADASTRAR_ESTABELECIMENTO")))
    loss = F.transform(F.filter("origens", lambda o: o != ""), lambda o: F.struct(o.alias("cbo"), F.lit(-1).alias("n")))
    return ready.filter(within).select(*_PAIR, "operacoes", "origens", "custo", F.concat(gain, loss).alias("delta"), F.lit(budget is None).alias("minimo_provado"))


def repair_impact(plans: DataFrame, pairs: DataFrame, records: DataFrame, establishments: DataFrame) -> DataFrame:
    """Plans with ``resolvidos``, ``prejudicados`` and ``minimo``: records that the plan's new counts
    clear, and records that lose their match since the occupation's count falls to zero. The test is
    made again for the pairs that a plan changes alone. ``records``: (competencia, cnes, cbo, estado);
    ``pairs``: (competencia, cnes, cbo, n_vinculos). A plan clears its pair where the establishment is
    there, or is registered first; ``minimo`` marks the cheapest plans of a pair that clear it and
    harm none."""
    by = records.groupBy(*_PAIR).agg(F.count_if(F.col("estado") == "VIOLACAO").alias("violados"), F.count_if(F.col("estado") == "CONFORME").alias("conformes"))
    now = pairs.groupBy(*_PAIR).agg(F.sum("n_vinculos").alias("antes"))
    there = establishments.select("competencia", "cnes").distinct().withColumn("existe", F.lit(True))
    numbered = written(plans.withColumn("plano", F.concat_ws("+", F.zip_with("operacoes", "origens", lambda o, g: F.concat_ws(":", o, g)))), "plans")
    change = numbered.select("competencia", "cnes", F.col("cbo").alias("alvo"), "plano", F.explode("delta").alias("d")).groupBy("competencia", "cnes", "alvo", "plano", F.col("d.cbo").alias("cbo")).agg(F.sum("d.n").alias("delta"))
    j = change.join(now, _PAIR, "left").join(by, _PAIR, "left").fillna({"antes": 0, "violados": 0, "conformes": 0})
    after = F.col("antes") + F.col("delta")
    effect = j.groupBy("competencia", "cnes", F.col("alvo").alias("cbo"), "plano").agg(F.sum(F.when((F.col("antes") <= 0) & (after > 0), F.col("violados")).otherwise(0)).alias("r"), F.sum(F.when((F.col("antes") > 0) & (after <= 0), F.col("conformes")).otherwise(0)).alias("prejudicados"), F.bool_and(after >= 0).alias("possivel"))
    out = numbered.join(effect, [*_PAIR, "plano"], "left").join(there, ["competencia", "cnes"], "left")
    stands = F.coalesce("existe", F.lit(False)) | F.array_contains("operacoes", "CADASTRAR_ESTABELECIMENTO")
    out = out.filter(F.coalesce("possivel", F.lit(True))).withColumns({"resolvidos": F.when(stands, F.coalesce("r", F.lit(0))).otherwise(0), "prejudicados": F.coalesce("prejudicados", F.lit(0))})
    good = (F.col("resolvidos") > 0) & (F.col("prejudicados") == 0)
    least = F.min(F.when(good, F.col("custo"))).over(Window.partitionBy(*_PAIR))
    return out.withColumn("minimo", F.coalesce(good & (F.col("custo") == least), F.lit(False))).select(*_PAIR, "plano", "operacoes", "custo", "resolvidos", "prejudicados", "minimo", "minimo_provado")


# What a search says of its cheapest plans.
MINIMAL, UNPROVEN, INCONCLUSIVE = "MINIMO_NO_CATALOGO", "SOLUCAO_SEM_PROVA_DE_MINIMALIDADE", "BUSCA_INCONCLUSIVA"
# End of the fixed values.


def cheapest_repairs(candidates: DataFrame, pairs: DataFrame, tested: DataFrame, most_operations: int = 3, most_candidates: int = 10_000) -> DataFrame:
    """(competencia, cnes, cbo, operacoes, origens, custo, avaliados, minimalidade): of each pair all
    cheapest plans that clear it and violate nothing new, or one row without a plan.

    A search by levels. An operation is tried where what it depends on is done. A plan that gives the
    pair a link is finished: more operations only cost more, so it is never made longer. An operation that
    takes a last link from records with a match, whose absence would count, or that brings the first
    row of an establishment where the absence of other occupations would then count, is dropped, as no
    other one mends that. What is left open has only prepared others; of open plans that did the same the cheapest stays. So a pair with k
    linked occupations makes about k plans a level instead of all combinations.

    Plans of a pair are judged in the order of cost, then name, and ``most_candidates`` of them at most
    (``avaliados``): a search that this cuts is no proof, and one cut before it found a plan is
    inconclusive; nor is one a proof where an open plan of ``most_operations`` might go on more cheaply.
    ``tested`` is as ``tested_keys`` makes it, of all rules that read the table; link counts are not
    negative."""
    candidates = written(candidates, "candidates")
    matched = tested.filter("estado = 'CONFORME' and sustentada").select("competencia", "cnes", F.col("cbo").alias("origem")).distinct().withColumn("casa", F.lit(True))
    others = tested.filter("estado = 'INCONCLUSIVO' and sustentada").select("competencia", "cnes", F.col("cbo").alias("outra")).distinct().join(pairs.select("competencia", "cnes").distinct(), ["competencia", "cnes"], "left_anti")
    first = candidates.select(*_PAIR).distinct().join(others, ["competencia", "cnes"]).filter("outra <> cbo").select(*_PAIR).distinct().withColumn("estreia", F.lit(True))
    links = pairs.groupBy("competencia", "cnes", F.col("cbo").alias("origem")).agg(F.sum("n_vinculos").alias("antes"))
    own = candidates.join(links, ["competencia", "cnes", "origem"], "left").join(matched, ["competencia", "cnes", "origem"], "left").join(first, _PAIR, "left")
    harms = F.coalesce(F.col("casa") & (F.col("antes") <= 1), F.lit(False)) | (F.coalesce("estreia", F.lit(False)) & (F.col("operacao") != "CADASTRAR_ESTABELECIMENTO"))
    one = written(own.filter(~harms).select(*_PAIR, F.struct(F.concat_ws(":", "operacao", F.coalesce("origem", F.lit(""))).alias("nome"), "operacao", F.coalesce("origem", F.lit("")).alias("origem"), "custo").alias("op"), "depende_de"), "operations")
    gives = F.col("op.operacao") != "CADASTRAR_ESTABELECIMENTO"
    level = one.filter("depende_de is null").select(*_PAIR, F.array("op").alias("ops"), F.col("op.custo").alias("custo"), gives.alias("pronto"))
    found = level
    for _ in range(most_operations - 1):
        done = F.array_sort(F.transform("ops", lambda o: o["nome"]))
        open_ = level.filter("not pronto").groupBy(*_PAIR, done.alias("_feitas")).agg(F.min(F.struct("custo", "ops")).alias("m")).select(*_PAIR, "m.ops", "m.custo")
        longer = open_.withColumnRenamed("custo", "_antes").join(one, _PAIR)
        ready = F.col("depende_de").isNull() | F.exists("ops", lambda o: o["operacao"] == F.col("depende_de"))
        longer = longer.filter(ready & ~F.exists("ops", lambda o: o["nome"] == F.col("op.nome")))
        level = written(longer.select(*_PAIR, F.concat("ops", F.array("op")).alias("ops"), (F.col("_antes") + F.col("op.custo")).alias("custo"), gives.alias("pronto")), "level")
        found = found.unionByName(level)
    every = Window.partitionBy(*_PAIR)
    ranked = found.withColumn("lugar", F.row_number().over(every.orderBy("custo", F.transform("ops", lambda o: o["nome"]))))
    ranked = ranked.withColumn("minimo", F.min(F.when(F.col("pronto") & (F.col("lugar") <= most_candidates), F.col("custo"))).over(every))
    cheapest_step = F.min(F.col("ops")[0]["custo"]).over(every)
    ranked = ranked.withColumn("passo", cheapest_step)
    may_go_on = F.max(~F.col("pronto") & (F.size("ops") == most_operations) & (F.col("custo") + F.col("passo") < F.col("minimo"))).over(every)
    cut = F.max(F.when(F.col("custo") <= F.col("minimo"), F.col("lugar"))).over(every) > most_candidates
    said = F.when(F.col("minimo").isNull(), INCONCLUSIVE).when(cut | F.coalesce(may_go_on, F.lit(False)), UNPROVEN).otherwise(MINIMAL)
    ranked = ranked.withColumns({"minimalidade": said, "avaliados": F.least(F.count("*").over(every), F.lit(most_candidates))})
    chosen = F.col("pronto") & (F.col("custo") == F.col("minimo")) & (F.col("lugar") <= most_candidates)
    judged = written(ranked.filter(F.coalesce(chosen, F.lit(False)) | (F.col("minimo").isNull() & (F.col("lugar") == 1))), "judged")
    plans = judged.filter("minimo is not null").select(*_PAIR, F.transform("ops", lambda o: o["operacao"]).alias("operacoes"), F.transform("ops", lambda o: o["origem"]).alias("origens"), "custo", "avaliados", "minimalidade")
    tried = judged.filter("minimo is null").select(*_PAIR, "avaliados")
    without = candidates.select(*_PAIR).distinct().join(plans.select(*_PAIR).distinct(), _PAIR, "left_anti").join(tried, _PAIR, "left")
    lost = without.select(*_PAIR, F.lit(None).cast("array<string>").alias("operacoes"), F.lit(None).cast("array<string>").alias("origens"), F.lit(None).cast("int").alias("custo"), F.coalesce("avaliados", F.lit(0)).alias("avaliados"), F.lit(INCONCLUSIVE).alias("minimalidade"))
    return plans.withColumn("custo", F.col("custo").cast("int")).unionByName(lost)


def tested_keys(evals: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(rule_id, competencia, cnes, cbo, estado, sustentada, n): how many records each key of a version
    was tested for, by state; of rules that read one table by (cnes, cbo). Without ``records`` the
    evaluations have kept these columns."""
    key = ["cnes", "cbo"]
    asked = evals.filter("testado").select("row_id", "rule_id", F.col("sel_competencia").alias("competencia"), "estado", "sustentada", *(key if records is None else []))
    rows = asked if records is None else asked.join(records.select("row_id", *key), "row_id")
    return rows.groupBy("rule_id", *_PAIR, "estado", "sustentada").agg(F.count("*").alias("n"))


def repair_effects(plans: DataFrame, pairs: DataFrame, tested: DataFrame) -> DataFrame:
    """(competencia, cnes, cbo, plano, custo, resolvidos, novas_violacoes, novas_inconclusivas, regras):
    what each plan changes in the states of all rules that read the table.

    The changes of counts run through the existence test by keys, not by evaluating again. A changed
    pair matches while it has links (its rows become one with the total; at none the row goes). Where an
    establishment's first row comes or its last goes, the test of its other occupations turns too:
    without any row of the establishment nothing is known of them, with one their absence counts.
    ``tested`` is as ``tested_keys`` makes it, for every such rule (``no_leading`` ones, whose tables
    have no null keys); ``regras`` are those in which some record changes its state. Plans that take
    more links than there are, are left out."""
    place, one = ["competencia", "cnes"], ["competencia", "cnes", "alvo", "plano"]
    numbered = written(plans.withColumn("plano", F.concat_ws("+", F.zip_with("operacoes", "origens", lambda o, g: F.concat_ws(":", o, g)))), "plans")
    rows = pairs.groupBy(*_PAIR).agg(F.coalesce(F.sum("n_vinculos"), F.lit(0)).alias("antes"), F.count("*").alias("linhas"))
    change = numbered.select(*place, F.col("cbo").alias("alvo"), "plano", F.explode("delta").alias("d")).groupBy(*one, F.col("d.cbo").alias("cbo")).agg(F.sum("d.n").alias("delta")).filter("delta <> 0")
    change = change.join(rows, _PAIR, "left").fillna({"antes": 0, "linhas": 0}).withColumn("depois", F.col("antes") + F.col("delta"))
    change = written(change, "changes")
    there = rows.groupBy(*place).agg(F.sum("linhas").alias("total"))
    lead = change.groupBy(*one).agg(F.sum(F.when(F.col("depois") > 0, 1).otherwise(0) - F.col("linhas")).alias("mais"), F.bool_and(F.col("depois") >= 0).alias("possivel"))
    lead = written(lead.join(there, place, "left").fillna({"total": 0}).select(*one, "possivel", (F.col("total") > 0).alias("havia"), (F.col("total") + F.col("mais") > 0).alias("ha")), "leads")
    absent = F.when(F.col("ha") & F.col("sustentada"), "VIOLACAO").otherwise("INCONCLUSIVO")
    exact = change.join(lead, one).join(tested, _PAIR).withColumn("novo", F.when(F.col("depois") > 0, "CONFORME").otherwise(absent))
    turned = lead.filter("havia <> ha").join(tested, place).join(change.select(*one, "cbo"), [*one, "cbo"], "left_anti").withColumn("novo", absent)
    columns = [*one, "cbo", "rule_id", "estado", "novo", "n"]
    moved = exact.select(*columns).unionByName(turned.select(*columns)).filter("estado <> novo")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    effect = moved.groupBy(*one).agg(
        count((F.col("estado") == "VIOLACAO") & (F.col("novo") == "CONFORME") & (F.col("cbo") == F.col("alvo"))).alias("resolvidos"),
        count(F.col("novo") == "VIOLACAO").alias("novas_violacoes"),
        count((F.col("estado") == "CONFORME") & (F.col("novo") == "INCONCLUSIVO")).alias("novas_inconclusivas"),
        F.array_sort(F.collect_set("rule_id")).alias("regras"),
    )
    out = numbered.withColumnRenamed("cbo", "alvo").join(lead.select(*one, "possivel"), one, "left").filter("coalesce(possivel, true)").join(effect, one, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(*place, F.col("alvo").alias("cbo"), "plano", "custo", zero("resolvidos"), zero("novas_violacoes"), zero("novas_inconclusivas"), F.coalesce("regras", F.array().cast("array<string>")).alias("regras"))


def executability(plans: DataFrame, now_month: str, open_month: str | None = None, operations: dict[str, tuple[int, str, str]] | None = None) -> DataFrame:
    """Plans with ``executabilidade`` and ``condicoes``. A closed month makes a plan a past hypothesis,
    an unknown one leaves it undetermined; then authority and governance decide.

    ``open_month`` counts only if it is the clock's month (``now_month``) or the one before; without
    it months before that are closed and later ones unknown."""
    ops = operations or OPERATIONS
    last = month_shift(F.lit(now_month), -1)
    if open_month is None:
        closed = F.when(F.col("competencia") < last, F.lit(True))
    else:
        current = F.lit(open_month).isin(now_month) | (F.lit(open_month) == last)
        closed = F.when(current, F.when(F.col("competencia") < open_month, F.lit(True)).when(F.col("competencia") == open_month, F.lit(False))).otherwise(F.when(F.col("competencia") < last, F.lit(True)))
    look = lambda i: F.create_map(*[F.lit(x) for k, v in ops.items() for x in (k, v[i])])
    authority, governance = look(1), look(2)
    outside, unknown = "FORA_DA_GOVERNANCA_MUNICIPAL", "DESCONHECIDA"
    clash = F.exists("operacoes", lambda o: authority[o].isin(*OUTSIDE_AUTHORITIES) & (governance[o] != outside))
    state = (
        F.when(closed.eqNullSafe(F.lit(True)), "HIPOTESE_PASSADA")
        .when(closed.isNull() | clash, "INDETERMINADO")
        .when(F.exists("operacoes", lambda o: governance[o] == outside), outside)
        .when(F.exists("operacoes", lambda o: (governance[o] == unknown) | (authority[o] == unknown)), "INDETERMINADO")
        .otherwise("POTENCIALMENTE_EXECUTAVEL_SOB_CONDICOES")
    )
    why = F.array_compact(F.array(F.when(closed.isNull(), "CONFIRMAR_COMPETENCIA_ABERTA"), F.when(F.exists("operacoes", lambda o: authority[o] == unknown), "CONFIRMAR_AUTORIDADE"), F.when(F.exists("operacoes", lambda o: governance[o] == unknown), "CONFIRMAR_GOVERNANCA"), F.lit("CONFIRMAR_VERDADE_FACTUAL")))
    return plans.withColumns({"executabilidade": state, "condicoes": why})
