"""Repairs against brute force: every sequence of operations, and the rules evaluated anew."""

import random
from collections import Counter
from itertools import permutations

import pytest
from datavouch.operators import explain
from pyspark.sql import functions as F

PAIRS = "competencia string, cnes string, cbo string, n_vinculos long"
TESTED = "rule_id string, competencia string, cnes string, cbo string, estado string, sustentada boolean, n long"


def world(seed):
    """Links and tested keys of a few establishments, in the states that the links give."""
    random.seed(seed)
    pairs, tested, viol, places = [], [], [], []
    for e in range(8):
        cnes = f"e{e}"
        links = {f"o{i}": random.choice([0, 1, 1, 2]) for i in range(random.choice([0, 1, 3, 5]))}
        pairs += [("m", cnes, o, n) for o, n in links.items()]
        if random.random() < 0.6:
            places.append(("m", cnes))
        for rule in ("r1", "r2"):
            for o in [f"o{i}" for i in range(6)]:
                for sure in (True, False):
                    if random.random() < 0.5:
                        state = "CONFORME" if links.get(o, 0) > 0 else "INCONCLUSIVO" if not links or not sure else "VIOLACAO"
                        tested.append((rule, "m", cnes, o, state, sure, random.randint(1, 4)))
        viol += sorted({("m", cnes, t[3]) for t in tested if t[2] == cnes and t[0] == "r1" and t[4] == "VIOLACAO"} | ({("m", cnes, "o0")} if not links else set()))
    return pairs, tested, viol, places


def judged(links, key, sure):
    return "CONFORME" if links.get(key, 0) > 0 else "VIOLACAO" if links and sure else "INCONCLUSIVO"


def applied(links, there, ops, cbo):
    """The links and registration after operations, or None where one can't be carried out."""
    links = dict(links)
    for op, origin in ops:
        if op == "CADASTRAR_ESTABELECIMENTO":
            if there:
                return None
            there = True
            continue
        if not there or origin and links.get(origin, 0) <= 0:
            return None
        for key, d in ([(origin, -1)] if origin else []) + [(cbo, 1)]:
            links[key] = links.get(key, 0) + d
            if links[key] <= 0:
                del links[key]
    return links


def brute(world_, costs, most=3):
    pairs, tested, viol, places = world_
    out = {}
    for _, cnes, cbo in viol:
        links = {o: n for _, c, o, n in pairs if c == cnes}
        there = ("m", cnes) in places
        every = [("INCLUIR_CBO", ""), *[("RECLASSIFICAR_CBO", o) for o, n in links.items() if n > 0 and o != cbo]] + ([] if there else [("CADASTRAR_ESTABELECIMENTO", "")])
        found = {}
        for k in range(1, most + 1):
            for ops in permutations(every, k):
                after = applied(links, there, ops, cbo)
                if after is None or after.get(cbo, 0) <= 0:
                    continue
                new = any(judged(after, o, sure) == "VIOLACAO" and state != "VIOLACAO" for _, _, c, o, state, sure, _ in tested if c == cnes)
                if not new:
                    found.setdefault(sum(costs[o] for o, _ in ops), set()).add(frozenset(ops))
        out[cnes, cbo] = (min(found), found[min(found)]) if found else None
    return out


def frames(spark, world_, costs):
    pairs, tested, viol, places = world_
    p, t = spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(tested, TESTED)
    v = spark.createDataFrame(viol, "competencia string, cnes string, cbo string")
    cost = F.create_map(*[F.lit(x) for kv in costs.items() for x in kv])
    return explain.repair_candidates(v, p, spark.createDataFrame(places, "competencia string, cnes string")).withColumn("custo", cost[F.col("operacao")]), p, t


@pytest.mark.parametrize(("seed", "costs"), [(1, (1, 2, 3)), (2, (5, 2, 3)), (3, (2, 2, 1)), (4, (9, 2, 2))])
def test_cheapest_repairs_are_those_of_all_sequences(spark, seed, costs):
    costs = dict(zip(("INCLUIR_CBO", "RECLASSIFICAR_CBO", "CADASTRAR_ESTABELECIMENTO"), costs, strict=True))
    w = world(seed)
    got = {}
    for r in explain.cheapest_repairs(*frames(spark, w, costs)).collect():
        key = (r.cnes, r.cbo)
        if r.operacoes is None:
            assert r.minimalidade == explain.INCONCLUSIVE and key not in got
            got[key] = None
        else:
            assert r.minimalidade == explain.MINIMAL
            got.setdefault(key, (r.custo, set()))[1].add(frozenset(zip(r.operacoes, r.origens, strict=True)))
    assert got == brute(w, costs)


def test_a_search_that_is_cut_proves_nothing(spark):
    pairs = spark.createDataFrame([("m", "e", f"o{i}", 2) for i in range(1, 40)], PAIRS)
    tested = spark.createDataFrame([("r", "m", "e", "o0", "VIOLACAO", True, 1)], TESTED)
    viol = spark.createDataFrame([("m", "e", "o0")], "competencia string, cnes string, cbo string")
    found = explain.repair_candidates(viol, pairs, spark.createDataFrame([("m", "e")], "competencia string, cnes string"))
    run = lambda most, c=found: {(r.minimalidade, r.avaliados) for r in explain.cheapest_repairs(c, pairs, tested, most_candidates=most).collect()}
    assert run(10_000) == {(explain.MINIMAL, 40)}  # linear in the occupations
    assert run(1) == {(explain.MINIMAL, 1)}  # the level of the cheapest is whole
    assert run(5, found.withColumn("custo", F.lit(2))) == {(explain.UNPROVEN, 5)}
    absent = explain.repair_candidates(viol, pairs, spark.createDataFrame([], "competencia string, cnes string"))
    assert {r.minimalidade for r in explain.cheapest_repairs(absent, pairs, tested, most_operations=1).collect()} == {explain.INCONCLUSIVE}
    assert explain.cheapest_repairs(found.limit(0), pairs, tested).count() == 0


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_effects_are_those_of_evaluating_anew(spark, seed):
    w = world(seed)
    pairs, tested, _, places = w
    candidates, p, t = frames(spark, w, {"INCLUIR_CBO": 1, "RECLASSIFICAR_CBO": 2, "CADASTRAR_ESTABELECIMENTO": 3})
    plans = explain.repair_plans(candidates, most=2)
    got = {(r.cnes, r.cbo, r.plano): (r.resolvidos, r.novas_violacoes, r.novas_inconclusivas, tuple(r.regras)) for r in explain.repair_effects(plans, p, t).collect()}
    want, seen = {}, Counter()
    for r in plans.collect():
        links = {o: n for _, c, o, n in pairs if c == r.cnes}
        after, rows = dict(links), {o for o in links}
        for d in r.delta:
            after[d.cbo] = after.get(d.cbo, 0) + d.n
        if any(n < 0 for n in after.values()):
            continue
        changed = {o for o, d in Counter({d.cbo: 0 for d in r.delta}).items()}
        net = Counter()
        for d in r.delta:
            net[d.cbo] += d.n
        changed = {o for o, n in net.items() if n}
        rows = {o for o in set(links) | changed if (after[o] > 0 if o in changed else o in links)}
        solved = violated = lost = 0
        touched = set()
        for rule, _, c, o, state, sure, n in tested:
            if c != r.cnes:
                continue
            # an occupation that a plan doesn't change turns only with the establishment's first or last row
            same = o not in changed and (o in links or bool(rows) == bool(links))
            new = state if same else "CONFORME" if after.get(o, 0) > 0 else "VIOLACAO" if rows and sure else "INCONCLUSIVO"
            solved += n * (state == "VIOLACAO" and new == "CONFORME" and o == r.cbo)
            violated += n * (state != "VIOLACAO" and new == "VIOLACAO")
            lost += n * (state == "CONFORME" and new == "INCONCLUSIVO")
            touched |= {rule} if state != new else set()
        plan = "+".join(f"{a}:{b}" for a, b in zip(r.operacoes, r.origens, strict=True))
        want[r.cnes, r.cbo, plan] = (solved, violated, lost, tuple(sorted(touched)))
        seen.update(violated=violated, lost=lost, solved=solved)
    assert got == want and seen["violated"] and seen["lost"] and seen["solved"]


def test_plans_that_the_budget_ends_are_not_made_longer(spark, monkeypatch):
    """Costs of two: pairs fit a budget of four, and no third operation is joined to them."""
    from datavouch.operators import explain

    rows = [("199601", "1", "a", "RECLASSIFICAR_CBO", o, 2, None) for o in "bcdefgh"]
    cand = spark.createDataFrame(rows, "competencia string, cnes string, cbo string, operacao string, origem string, custo int, depende_de string")
    plans = explain.repair_plans(cand, budget=4)
    assert sorted(r.n for r in plans.selectExpr("size(operacoes) as n").collect()) == [1] * 7 + [2] * 21
    assert "custo#" in plans._jdf.queryExecution().optimizedPlan().toString() and "+ 2) <= 4" in plans._jdf.queryExecution().optimizedPlan().toString()
    assert explain.repair_plans(cand.limit(0), budget=4).isEmpty()
