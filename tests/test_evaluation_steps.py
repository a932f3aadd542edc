"""Steps over evaluations: what they move, what they compile to, and that nothing is lost by it."""

import re

import pytest
from pyspark.sql import functions as F

from datavouch.operators import explain, rules
from datavouch.plans import core, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def flow(spark):
    return core.Flow(spark, SF)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _sizes(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    return [int(x) for x in re.findall(r"maxMethodCodeSize:(-?\d+)", df._jdf.queryExecution().explainString(mode))]


def test_states_without_reasons_are_the_truth_tables(flow):
    """Every state is decided without the list of reasons, as the truth table decides it with them."""
    again = rules.decide_state(F.col("aplicabilidade"), F.col("insumos_completos"), F.col("incompatibilidade"), F.col("motivos"))
    ev = flow.evaluations.withColumn("tabela", again)
    assert ev.filter(~F.col("estado").eqNullSafe(F.col("tabela"))).isEmpty()
    assert ev.filter((F.size("motivos") > 0) != (F.col("estado") == "INCONCLUSIVO")).isEmpty()
    assert ev.select("estado").distinct().count() == 4
    assert "COBERTURA_INSUFICIENTE" not in _plan(flow.evaluations.select("row_id", "rule_id", "estado"))


def test_evidence_is_compared_by_what_it_is_made_of(spark, flow, monkeypatch):
    """The distinct contents are moved, not the fields made of them, and the stage that finds them is compiled."""
    monkeypatch.setattr(rules, "SENT_ROWS", 700)
    ev = rules.evidence(core.Flow(spark, SF).evaluations)
    ev.collect()
    sizes = _sizes(spark, ev)
    assert sizes and min(sizes) > 0 and max(sizes) < 8000
    moved = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", _plan(ev))
    assert moved and not any("parametros" in m or "chaves_amostra" in m for m in moved)
    each = flow.evaluations.filter("estado <> 'INCONCLUSIVO'").select(rules.evidence_id().alias("ev_id"))
    assert sorted(r.ev_id for r in each.distinct().collect()) == sorted(r.ev_id for r in ev.select("ev_id").collect())


def _moved(df):
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", _plan(df))


def test_only_rows_that_cite_evidence_of_rules_with_much_of_it_are_moved(spark, monkeypatch):
    rows = spark.createDataFrame([(str(i), "a" if i % 2 else "b", e) for i, e in enumerate(["a1", "b1", "a2", None, "b9", "a1", "zz", "b2"])], "row_id string, rule_id string, ev_id string")
    known = spark.createDataFrame([("a1", "a", 1), ("a2", "a", 2), *[(f"b{i}", "b", 10 + i) for i in range(1, 6)], ("n1", None, 0)], "ev_id string, rule_id string, x int")
    expected = sorted(map(str, rows.join(known.drop("rule_id"), "ev_id", "left").select("row_id", "ev_id", "x").collect()))
    for most, parts in ((3, (2, 6)), (100, (7, 1)), (1, (0, 8))):
        monkeypatch.setattr(rules, "SENT_ROWS", most)
        few, rest = rules.known_apart(known)
        assert (few.count(), rest.count()) == parts
        assert sorted(map(str, rules.with_known(rows, known).select("row_id", "ev_id", "x").collect())) == expected
        assert sorted(map(str, rules.with_known(rows, known.drop("rule_id")).select("row_id", "ev_id", "x").collect())) == expected


def test_faults_in_evaluations_need_no_join_by_record(flow):
    joins = re.findall(r"Join \w+, (.*)", queries._r14(flow)._jdf.queryExecution().optimizedPlan().toString())
    assert any("ev_id" in j for j in joins) and not any("row_id" in j for j in joins)


def test_bundles_of_rules_with_little_evidence_stay_where_they_are(flow):
    text = queries._e5(flow)._jdf.queryExecution().optimizedPlan().toString()
    assert "_near" in text and "rightHint=(strategy=broadcast)" in text


def test_missing_edges_are_found_by_evaluation(spark):
    """All edges that are needed and not there, by their subject; other subjects and other objects don't matter."""
    fields = "row_id string, rule_id string, estado string, instrumento string, chave string, sel_artefatos array<string>, artifact_id string, cobertura string, integridade string, integridade_registro string, n_resultados long"
    ev = spark.createDataFrame([(i, "r", s, "C", "k", ["v"], "f", "DISPONIVEL", "OK", "OK", 1) for i, s in (("a", "CONFORME"), ("b", "INCONCLUSIVO"), ("c", "VIOLACAO"), ("c", "VIOLACAO"))], fields)
    edges = explain.provenance_edges(ev)
    assert explain.missing_edges(edges, ev).isEmpty()
    assert edges.filter("relacao = 'USOU'").count() == 11 and edges.filter("objeto is null").isEmpty()
    some = edges.filter("sujeito <> 'avaliacao/b/r' and objeto <> 'registro/a'").unionByName(spark.createDataFrame([("avaliacao/b/r", "USOU", "regra/other"), ("registro/a", "USOU", "registro/a")], "sujeito string, relacao string, objeto string"))
    out = explain.missing_edges(some, ev.unionByName(ev.filter("row_id = 'b'")))
    assert sorted((r.sujeito, r.objeto) for r in out.collect()) == [("avaliacao/a/r", "registro/a"), *[("avaliacao/b/r", "registro/b")] * 2, *[("avaliacao/b/r", "regra/r")] * 2]
    assert explain.missing_edges(edges.filter("objeto not like 'evidencia/%'"), ev).count() == 3
    assert all("objeto" not in m for m in _moved(explain.missing_edges(edges.filter("relacao = 'USOU'"), ev)))


def test_nodes_are_those_that_edges_name(flow):
    """Made without the edges, and each shared node once."""
    edges, nodes = explain.provenance_edges(flow.stored_evaluations), explain.provenance_nodes(flow.stored_evaluations)
    ends = edges.select(F.explode(F.array("sujeito", "objeto")).alias("nome")).distinct()
    assert ends.exceptAll(nodes.distinct()).isEmpty() and nodes.distinct().exceptAll(ends).isEmpty()
    shared = nodes.filter("nome rlike '^(artefato|regra|conjunto)/'")
    assert shared.count() == shared.distinct().count()


def test_references_to_shared_nodes_are_looked_up_where_they_are(spark):
    claimed = spark.createDataFrame([("1", "r", ["avaliacao/1/r", "ev_1", "artefato/a"]), ("2", "r", ["avaliacao/2/r", "artefato/z", "regra/r", None]), ("3", "r", []), ("4", "r", ["regra/z", "artefato/a", "registro/4"])], "row_id string, assunto string, referencias array<string>")
    known = spark.createDataFrame([("avaliacao/1/r",), ("artefato/a",), ("artefato/a",), ("regra/r",), ("ev_2",)], "nome string")
    out = explain.unresolved_references(claimed, known)
    assert sorted((r.row_id, r.referencia) for r in out.collect()) == [("1", "ev_1"), ("2", "artefato/z"), ("2", "avaliacao/2/r"), ("4", "registro/4"), ("4", "regra/z")]
    assert "rightHint=(strategy=broadcast)" in out._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_is_stored_before_it_is_counted_again(flow):
    """Its kind is filtered where it is read, not where evaluations are made."""
    plan = queries._e1(flow)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "tipo" in plan
