import random

import pytest

from axiomata.operators import clusters, graph
from axiomata.plans.components import connected_components


def edges(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, src long, dst long, kind string, status string")


def test_components_of_a_long_chain_and_a_star(spark):
    rows = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 40)] + [(7, 7), (None, 3), (500, 501), (501, 500)]
    df = spark.createDataFrame(rows, "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 0 for k in range(40)}, 500: 500, 501: 500}
    assert connected_components(df.limit(0)).count() == 0


def test_quotient(spark):
    own = edges(spark, [(1, 2, "equivalence", "accepted"), (2, 3, "implication", "accepted"), (1, 3, "implication", "accepted"), (1, 2, "implication", "accepted"), (4, 9, "specialization", "accepted")])
    nodes = spark.createDataFrame([(k,) for k in range(1, 6)], "id long")
    reps = graph.representatives(nodes, own.filter("kind = 'equivalence'"))
    assert {r.id: r.rep for r in reps.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert {tuple(r) for r in graph.collapse(own, reps).collect()} == {(1, 3, "implication", 1), (4, 9, "specialization", 4)}


def test_composition_is_partial(spark):
    own = edges(spark, [(1, 2, "specialization", ""), (2, 3, "implication", ""), (4, 5, "implication", ""), (5, 6, "specialization", ""), (3, 1, "implication", "")])
    starts = spark.createDataFrame([(1,), (4,)], "id long")
    got = {(r.start, r.node): (r.kind, list(r.path)) for r in graph.derivations(own, starts).collect()}
    assert got[1, 3] == ("implication", [0, 1])
    assert (4, 6) not in got  # an implication followed by a specialisation has no kind
    assert got[1, 1] == ("implication", [0, 1, 4])  # back to the start, but not by an empty path
    assert {(r.start, r.node): r.depth for r in graph.reachable(own, starts).collect()}[4, 6] == 2


def test_derivations_against_brute_force(spark):
    random.seed(5)
    kinds = [graph.EQUIVALENCE, graph.IMPLICATION, graph.SPECIALIZATION, graph.GENERALIZATION]
    rows = [(random.randrange(9), random.randrange(9), random.choice(kinds), "") for _ in range(22)]
    table = {(a, b): c for a, b, c in graph.COMPOSED}
    best = {}
    frontier = [(s, d, k, (i,)) for i, (s, d, k, _) in enumerate(rows)]
    while frontier:
        fresh = {}
        for s, d, k, p in frontier:
            if (s, d, k) not in best:
                fresh[s, d, k] = min(fresh.get((s, d, k), p), p)
        best |= fresh
        frontier = [(s, rows[i][1], table[k, rows[i][2]], (*p, i)) for (s, d, k), p in fresh.items() for i in range(len(rows)) if rows[i][0] == d and (k, rows[i][2]) in table]
    got = graph.derivations(edges(spark, rows), spark.range(9)).collect()
    assert {(r.start, r.node, r.kind): tuple(r.path) for r in got} == best


def test_chain_depths(spark):
    own = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 3), (1, 5)], "src long, dst long")
    assert {r.node: r.depth for r in graph.chain_depths(own).collect()} == {3: 0, 5: 0, 2: 1, 4: 1, 1: 2}
    with pytest.raises(ValueError):
        graph.chain_depths(spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long"))


def test_spine_and_layers(spark):
    own = spark.createDataFrame([(1, 2), (1, 3), (3, 4), (2, 5), (5, 6), (1, 9)], "src long, dst long")
    roots = spark.createDataFrame([(1,)], "id long")
    spine = graph.spines(own, roots)
    assert [r.node for r in spine.orderBy("step").collect()] == [1, 2, 5, 6]
    shown = graph.layers(own, roots, spine, depth=2, per_layer=2)
    assert {(r.depth, r.node) for r in shown.collect()} == {(0, 1), (1, 2), (1, 3), (2, 5), (2, 4)}


def test_rejected_edges_stay_rejected(spark):
    log = [(1, 1, 2, "k", "propose"), (2, 1, 2, "k", "accept"), (3, 1, 2, "k", "reject"), (4, 1, 2, "k", "accept"), (5, 1, 2, "m", "accept"), (6, 3, 4, "k", "propose"), (7, 3, 4, "m", "accept"), (8, 3, 4, "n", "accept")]
    events = spark.createDataFrame(log, "id long, src long, dst long, kind string, action string")
    assert {(r.src, r.kind): r.status for r in graph.edge_states(events).collect()} == {(1, "k"): "rejected", (1, "m"): "accepted", (3, "k"): "rejected", (3, "m"): "accepted", (3, "n"): "refused"}
    assert [(r.src, r.kind, r.refused) for r in graph.exclusive_conflicts(events).collect()] == [(3, "n", 1)]
    assert [(r.src, r.kind) for r in graph.competing(events).collect()] == [(3, "k")]


def test_an_equivalence_stands_in_both_directions(spark):
    e, i, s = graph.EQUIVALENCE, graph.IMPLICATION, graph.SPECIALIZATION
    log = [(1, 1, 2, i, "propose"), (2, 2, 1, s, "propose"), (3, 2, 1, e, "accept"), (4, 2, 1, i, "accept"), (5, 5, 6, i, "accept"), (6, 6, 5, i, "accept"), (7, 6, 5, e, "accept"), (8, 6, 5, i, "reject"), (9, 5, 6, e, "accept"), (10, 5, 6, i, "reject"), (11, 5, 6, e, "accept")]
    events = spark.createDataFrame(log, "id long, src long, dst long, kind string, action string")
    got = {(r.src, r.dst, r.kind): (r.status, r.refused, r.suppressed) for r in graph.edge_log(events).collect()}
    assert got[1, 2, e] == ("accepted", 0, False) and got[1, 2, i][0] == got[2, 1, s][0] == "rejected" and got[1, 2, i][2] and got[2, 1, s][2]
    assert got[2, 1, i] == ("refused", 1, False)
    assert got[5, 6, i][0] == got[6, 5, i][0] == "rejected" and got[5, 6, e] == ("accepted", 2, False)


def test_long_chains_keep_short_plans(spark):
    own = spark.createDataFrame([(k, k + 1) for k in range(24)], "src long, dst long")
    starts = spark.createDataFrame([(0,)], "id long")
    for found in (graph.reachable(own, starts), graph.chain_depths(own), graph.spines(own, starts)):
        assert found.count() == 25
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 1


def test_qualified_names(spark):
    rows = [(1, "group"), (2, "abelian_group"), (3, "free-group-action"), (4, "subgroup"), (5, "commring"), (6, "ring"), (7, "Group"), (8, None), (9, "group_action"), (10, "finite_subgroup")]
    got = {(r.src, r.dst) for r in graph.qualified_names(spark.createDataFrame(rows, "id long, name string")).collect()}
    assert got == {(1, 2), (7, 2), (1, 3), (7, 3), (9, 3), (6, 5), (1, 10), (7, 10), (4, 10)}


def test_hidden_and_omitted(spark):
    own = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 5), (5, 6), (2, 4)], "src long, dst long")
    roots = spark.createDataFrame([(1,)], "id long")
    shown = graph.layers(own, roots, graph.spines(own, roots), depth=2, per_layer=1)
    assert {(r.depth, r.node) for r in shown.collect()} == {(0, 1), (1, 2), (2, 5)}
    assert {(r.node, r.unseen) for r in graph.hidden(own, shown).collect()} == {(1, 2), (2, 1), (5, 1)}
    assert [tuple(r) for r in graph.omitted(own, shown, 2).collect()] == [(1, 3)]
    policies = own.selectExpr("*", "case when dst < 4 then 'default_traversal' when dst = 4 then 'visible_only' end as policy")
    assert graph.traversable(policies, True).count() == 2 and graph.traversable(policies, False).count() == 6

def test_proposals(spark):
    rows = [(1, "a", "h", [1, 2]), (2, "b", "h", [2, 1]), (3, "c", "h", [1, 1, 2]), (4, "a_iff_b", "x4", []), (5, "c_of_a", "x5", []), (6, "Cor_c", "x6", []), (7, "a_implies_b", "x7", []), (8, "finite_group", "x8", []), (9, "group", "x9", [])]
    judgments = spark.createDataFrame(rows, "id long, name string, hash string, context array<long>")
    got = {(r.src, r.dst, r.kind): r.confidence for r in graph.proposals(judgments).collect()}
    assert got == {(1, 2, "equivalence"): 0.9, (1, 3, "specialization"): 0.75, (2, 3, "specialization"): 0.75, (1, 3, "implication"): 0.4, (3, 6, "implication"): 0.3, (1, 2, "implication"): 0.55, (9, 8, "specialization"): 0.35}
    known = spark.createDataFrame([(9, 8, "specialization")], "src long, dst long, kind string")
    assert {(r.src, r.dst) for r in graph.new_proposals(judgments, 5, known).collect()} == {(3, 6)}


TRIANGLES = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (4, 5, 1.0), (5, 6, 1.0), (4, 6, 1.0), (3, 4, 0.1), (8, 9, 1.0)]


@pytest.mark.parametrize("method,resolution", [("cpm", 0.3), ("louvain", 1.0), ("lpa", 0.0)])
def test_two_triangles(spark, method, resolution):
    own = spark.createDataFrame(TRIANGLES, "i long, j long, w double")
    found = clusters.detect(own, method, resolution)
    assert {r.node: r.community for r in found.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 8: 8, 9: 8}
    alone = found.select("node", found.node.alias("community"))
    assert clusters.cpm_quality(own, found, 0.3).first()[0] > clusters.cpm_quality(own, alone, 0.3).first()[0]
    assert clusters.modularity(own, found).first()[0] > clusters.modularity(own, alone).first()[0]
