"""Typed dependency graphs: quotients, reachability, derivations, lineage, proposals, edge states.

Loops run level by level; each level is a written table, so neither lineage
nor a lost executor makes a later level dearer, and the driver sees row counts
only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.stages import Levels, written

EQUIVALENCE, IMPLICATION, SPECIALIZATION, GENERALIZATION = "equivalence", "implication", "specialization", "generalization"
# What two kinds of edges in sequence amount to; other pairs end a path.
COMPOSED = (
    *((EQUIVALENCE, k, k) for k in (EQUIVALENCE, IMPLICATION, SPECIALIZATION, GENERALIZATION)),
    *((k, EQUIVALENCE, k) for k in (IMPLICATION, SPECIALIZATION, GENERALIZATION)),
    (IMPLICATION, IMPLICATION, IMPLICATION),
    (SPECIALIZATION, SPECIALIZATION, SPECIALIZATION),
    (GENERALIZATION, GENERALIZATION, GENERALIZATION),
    (SPECIALIZATION, IMPLICATION, IMPLICATION),
)

# --- quotient ----------------------------------------------------------------


def representatives(nodes: DataFrame, equivalences: DataFrame) -> DataFrame:
    """G-01: (id, rep) of all nodes; the least id of a class represents it. Equivalences: (src, dst)."""
    found = connected_components(equivalences, "src", "dst")
    return nodes.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("rep"))


def absorb(reps: DataFrame, fresh: DataFrame) -> DataFrame:
    """G-04: representatives after new equivalences (src, dst), from the old ones alone.

    Only the classes that the new edges touch are joined; the rest is kept.
    Taking an equivalence back needs ``representatives`` anew.
    """
    a, b = reps.toDF("src", "rs"), reps.toDF("dst", "rd")
    lifted = fresh.join(a, "src").join(b, "dst").select(F.col("rs").alias("src"), F.col("rd").alias("dst"))
    moved = connected_components(lifted, "src", "dst").toDF("rep", "to")
    return reps.join(moved, "rep", "left").select("id", F.coalesce("to", "rep").alias("rep"))


def classes(reps: DataFrame) -> DataFrame:
    """G-02: (rep, size, members) of classes with more than one member."""
    return reps.groupBy("rep").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("id")).alias("members")).filter("size > 1")


def collapse(edges: DataFrame, reps: DataFrame) -> DataFrame:
    """G-03: (src, dst, kind, witness): edges between classes, the first edge of each as its witness.

    Ends that no class knows stand for themselves; equivalences and loops go.
    """
    a, b = reps.toDF("src", "rs"), reps.toDF("dst", "rd")
    joined = edges.filter(F.col("kind") != EQUIVALENCE).join(a, "src", "left").join(b, "dst", "left")
    moved = joined.select("id", F.coalesce("rs", "src").alias("src"), F.coalesce("rd", "dst").alias("dst"), "kind").filter("src <> dst")
    return moved.groupBy("src", "dst", "kind").agg(F.min("id").alias("witness"))


# --- paths -------------------------------------------------------------------


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int = 1000) -> DataFrame:
    """G-06: (start, node, depth): the nodes that each start reaches, itself at depth 0."""
    levels = Levels(edges.sparkSession, "reach")
    frontier = levels.add(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct())
    hop = edges.select(F.col("src").alias("node"), "dst")
    for depth in range(1, max_depth + 1):
        step = frontier.join(hop, "node").select("start", F.col("dst").alias("node")).distinct()
        frontier = levels.add(step.join(levels.all(), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
    return levels.all()


def derivations(edges: DataFrame, starts: DataFrame, max_depth: int = 50) -> DataFrame:
    """G-07: (start, node, kind, depth, path): the shortest composable path to each node and composed kind.

    A path's state is its node with the kind composed so far. Of equally short
    paths the one of least edge ids stays. Edges: (id, src, dst, kind).
    """
    spark = edges.sparkSession
    table = spark.createDataFrame(COMPOSED, "kind string, next string, composed string")
    hop = edges.select(F.col("src").alias("node"), F.col("dst"), F.col("kind").alias("next"), "id")
    least = lambda df: df.groupBy("start", "node", "kind").agg(F.min("path").alias("path"))
    first = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct().join(hop, "node")
    levels = Levels(spark, "paths")
    frontier = levels.add(least(first.select("start", F.col("dst").alias("node"), F.col("next").alias("kind"), F.array("id").alias("path"))).withColumn("depth", F.lit(1)))
    for depth in range(2, max_depth + 1):
        # the table of compositions has eleven rows
        step = frontier.join(hop, "node").join(F.broadcast(table), ["kind", "next"])
        step = step.select("start", F.col("dst").alias("node"), F.col("composed").alias("kind"), F.concat("path", F.array("id")).alias("path"))
        frontier = levels.add(least(step).join(levels.all(), ["start", "node", "kind"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
    return levels.all()


def chain_depths(edges: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """G-15: (node, depth): the length of the longest chain of (src depends on dst) below each node.

    Defined on acyclic graphs; a cycle is an error. Each round strips the
    nodes whose dependencies are all known, so there are as many rounds as the
    longest chain has nodes.
    """
    own = edges.select("src", "dst").distinct()
    rest = written(own, "chain")
    known = Levels(edges.sparkSession, "chain-depths")
    ready = known.add(own.select(F.col("dst").alias("node")).union(own.select("src")).distinct().join(own.select(F.col("src").alias("node")), "node", "left_anti").withColumn("depth", F.lit(0)))
    for _ in range(max_depth):
        if rest.isEmpty():
            return known.all()
        joined = rest.join(known.all().withColumnRenamed("node", "dst"), "dst", "left")
        ready = known.add(joined.groupBy("src").agg(F.count_if(F.col("depth").isNull()).alias("open"), (F.max("depth") + 1).alias("depth")).filter("open = 0").select(F.col("src").alias("node"), "depth"))
        if ready.isEmpty():
            raise ValueError("the dependencies have a cycle")
        rest = written(rest.join(ready.select(F.col("node").alias("src")), "src", "left_anti"), "chain")
    raise ValueError("the chains are longer than max_depth")


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def spines(edges: DataFrame, roots: DataFrame, max_depth: int = 1000) -> DataFrame:
    """G-16: (root, step, node): from each root always to the child of the deepest chain, then most dependencies, then least id."""
    depth, degree = chain_depths(edges), out_degrees(edges)
    children = edges.select("src", "dst").distinct().join(depth.withColumnRenamed("node", "dst"), "dst").join(degree.withColumnRenamed("node", "dst"), "dst", "left")
    key = F.struct((-(F.col("depth") * 1000 + F.coalesce("degree", F.lit(0)))).alias("k"), F.col("dst"))
    follow = written(children.groupBy(F.col("src").alias("node")).agg(F.min(key).alias("b")).select("node", F.col("b.dst").alias("to")), "spine-next")
    levels = Levels(edges.sparkSession, "spine")
    level = levels.add(roots.select(F.col("id").alias("root"), F.lit(0).alias("step"), F.col("id").alias("node")).distinct())
    for step in range(1, max_depth + 1):
        level = levels.add(level.join(follow, "node").select("root", F.lit(step).alias("step"), F.col("to").alias("node")))
        if level.isEmpty():
            break
    return levels.all()


def layers(edges: DataFrame, roots: DataFrame, spine: DataFrame, depth: int = 4, per_layer: int = 6) -> DataFrame:
    """G-17, W-08: (root, depth, node): what is shown below each root, at most ``per_layer`` nodes a level.

    A level shows nodes of the spine first, in its order, then those of most dependencies,
    then of least id.
    """
    degree = out_degrees(edges)
    follow = edges.select(F.col("src").alias("node"), "dst").distinct()
    levels = Levels(edges.sparkSession, "layers")
    level = levels.add(roots.select(F.col("id").alias("root"), F.lit(0).alias("depth"), F.col("id").alias("node")).distinct())
    for d in range(1, depth + 1):
        step = level.join(follow, "node").select("root", F.col("dst").alias("node")).distinct().join(levels.all().select("root", "node"), ["root", "node"], "left_anti")
        marked = step.join(spine.groupBy("root", "node").agg(F.min("step").alias("on")), ["root", "node"], "left").join(degree, "node", "left")
        order = Window.partitionBy("root").orderBy(F.asc_nulls_last("on"), F.desc(F.coalesce("degree", F.lit(0))), "node")
        level = levels.add(marked.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_layer).select("root", F.lit(d).alias("depth"), "node"))
        if level.isEmpty():
            break
    return levels.all()


def hidden(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """G-17: (root, node, unseen): shown nodes with dependencies that are not shown, and how many."""
    follow = edges.select(F.col("src").alias("node"), F.col("dst").alias("child")).distinct()
    unseen = shown.select("root", "node").join(follow, "node").join(shown.select("root", F.col("node").alias("child")), ["root", "child"], "left_anti")
    return unseen.groupBy("root", "node").agg(F.count(F.lit(1)).alias("unseen"))


def omitted(edges: DataFrame, shown: DataFrame, depth: int = 4) -> DataFrame:
    """G-17: (root, omitted): the candidates that found no place in their level, over all levels up to ``depth``."""
    follow = edges.select(F.col("src").alias("node"), F.col("dst").alias("child")).distinct()
    asked = shown.filter(F.col("depth") < depth).join(follow, "node").select("root", (F.col("depth") + 1).alias("level"), "child").distinct()
    placed = asked.join(shown.select("root", F.col("node").alias("child"), F.col("depth").alias("at")), ["root", "child"], "left")
    return placed.groupBy("root").agg(F.count_if(F.col("at").isNull() | (F.col("at") > F.col("level"))).alias("omitted"))


def traversable(edges: DataFrame, trusted_only: bool) -> DataFrame:
    """G-18: the edges that may be followed: all, or with ``trusted_only`` those whose policy is to follow them by default."""
    return edges.filter(F.coalesce(F.col("policy") == "default_traversal", F.lit(False))) if trusted_only else edges


def spine_outline(edges: DataFrame, spine: DataFrame, sides: int = 6) -> DataFrame:
    """G-19: (root, step, node, next, sides, remaining): each step's next node and its other dependencies."""
    ordered = spine.withColumn("next", F.lead("node").over(Window.partitionBy("root").orderBy("step")))
    follow = edges.select(F.col("src").alias("node"), "dst").distinct()
    other = ordered.join(follow, "node").filter(~F.col("dst").eqNullSafe(F.col("next")))
    ranked = other.withColumn("n", F.row_number().over(Window.partitionBy("root", "step").orderBy("dst")))
    side = ranked.groupBy("root", "step").agg(F.array_sort(F.collect_list(F.when(F.col("n") <= sides, F.col("dst")))).alias("sides"), F.sum(F.when(F.col("n") > sides, 1).otherwise(0)).alias("remaining"))
    return ordered.join(side, ["root", "step"], "left").select("root", "step", "node", "next", F.coalesce("sides", F.array()).alias("sides"), F.coalesce("remaining", F.lit(0)).alias("remaining"))


def neighborhood(edges: DataFrame, node: int, most: int = 12) -> DataFrame:
    """G-20: (direction, node, omitted): the first dependencies and users of a node, and how many are not shown."""
    own = edges.select("src", "dst").distinct()
    down = own.filter(F.col("src") == node).select(F.lit("depends_on").alias("direction"), F.col("dst").alias("node"))
    up = own.filter(F.col("dst") == node).select(F.lit("used_by").alias("direction"), F.col("src").alias("node"))
    w = Window.partitionBy("direction")
    ranked = down.union(up).withColumns({"n": F.row_number().over(w.orderBy("node")), "all": F.count(F.lit(1)).over(w)})
    return ranked.filter(F.col("n") <= most).select("direction", "node", F.greatest(F.lit(0), F.col("all") - most).alias("omitted"))


def concept_map(edges: DataFrame, start: int, per_node: int = 6, most: int = 36) -> DataFrame:
    """G-21: (a, b, w): edges among the nodes within two hops of ``start``, each hop to the heaviest neighbours."""
    edges = written(edges.select("i", "j", "w"), "map-edges")
    both = edges.select(F.col("i").alias("a"), F.col("j").alias("b"), "w").union(edges.select("j", "i", "w"))
    # few nodes are asked for: only their edges are ranked
    heavy = lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))).filter(F.col("n") <= per_node)
    one = written(heavy(both.filter(F.col("a") == start)).select(F.col("b").alias("node"), F.lit(1).alias("hop"), "w"), "map-hop")
    two = heavy(both.join(F.broadcast(one.select(F.col("node").alias("a"))), "a", "left_semi")).filter(F.col("b") != start).select(F.col("b").alias("node"), F.lit(2).alias("hop"), "w")
    best = one.union(two).groupBy("node").agg(F.min(F.struct("hop", (-F.col("w")).alias("w"))).alias("k"))
    nodes = written(best.orderBy("k", "node").limit(most - 1).select("node").union(edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("node"))), "map-nodes")
    inside = edges.join(F.broadcast(nodes.withColumnRenamed("node", "i")), "i", "left_semi").join(F.broadcast(nodes.withColumnRenamed("node", "j")), "j", "left_semi")
    return inside.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max("w").alias("w"))


# --- proposals ---------------------------------------------------------------


def _context_counts(column: str) -> Column:
    return F.map_from_entries(F.transform(F.array_distinct(column), lambda x: F.struct(x, F.size(F.filter(column, lambda y: y == x)))))


def within(small: Column, large: Column) -> Column:
    """G-10: whether each element of the first array is as often in the second."""
    return F.forall(F.array_distinct(small), lambda x: F.size(F.filter(small, lambda y: y == x)) <= F.size(F.filter(large, lambda y: y == x)))


def same_statement(judgments: DataFrame) -> DataFrame:
    """J-09, G-09: proposals from equal statement hashes: equivalence for equal contexts, specialisation for a wider one.

    ``judgments``: (id, name, hash, context as an array).
    """
    own = judgments.select("id", "hash", F.array_sort("context").alias("context"))
    a, b = own.toDF("i", "hash", "ci"), own.toDF("j", "hash", "cj")
    met = a.join(b, "hash").filter("i < j")
    equal = F.col("ci") == F.col("cj")
    up, down = within(F.col("ci"), F.col("cj")), within(F.col("cj"), F.col("ci"))
    return met.filter(equal | up | down).select(
        F.when(equal | up, F.col("i")).otherwise(F.col("j")).alias("src"),
        F.when(equal | up, F.col("j")).otherwise(F.col("i")).alias("dst"),
        F.when(equal, EQUIVALENCE).otherwise(SPECIALIZATION).alias("kind"),
        F.when(equal, F.lit(0.9)).otherwise(F.lit(0.75)).alias("confidence"),
    )


def _split_once(name: Column, mark: str) -> tuple[Column, Column]:
    at = F.instr(name, mark)
    left, right = F.substring(name, F.lit(1), at - 1), F.substring(name, at + len(mark), F.length(name))
    good = (at > 1) & (F.length(right) > 0)
    return F.when(good, left), F.when(good, right)


def name_pattern(judgments: DataFrame, mark: str, kind: str, confidence: float, swap: bool = False, every: bool = False, distinct_from_self: bool = False) -> DataFrame:
    """J-10: proposals from names ``left<mark>right`` whose parts are names too.

    Of several judgments with one name the last counts, or all with ``every``.
    """
    named = judgments.filter("name is not null").select("id", F.lower("name").alias("name"))
    lookup = named.select("name", "id") if every else named.groupBy("name").agg(F.max("id").alias("id"))
    left, right = _split_once(F.col("name"), mark)
    split = named.select(F.col("id").alias("self"), left.alias("l"), right.alias("r")).filter("l is not null and r is not null")
    met = split.join(lookup.toDF("l", "li"), "l").join(lookup.toDF("r", "ri"), "r").filter("li <> ri")
    if distinct_from_self:
        met = met.filter("li <> self and ri <> self")
    src, dst = ("ri", "li") if swap else ("li", "ri")
    return met.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))


def corollaries(judgments: DataFrame) -> DataFrame:
    """J-10: a judgment named corollary of another follows from it."""
    named = judgments.filter("name is not null").select("id", F.lower("name").alias("name"))
    lookup = named.groupBy("name").agg(F.max("id").alias("src"))
    base = named.select(F.col("id").alias("dst"), F.regexp_extract("name", r"^(?:corollary|coroll|cor)_(.+)$", 1).alias("name")).filter("name <> ''")
    return base.join(lookup, "name").filter("src <> dst").select("src", "dst", F.lit(IMPLICATION).alias("kind"), F.lit(0.3).alias("confidence"))


# Words that mark a special case inside a name.
QUALIFIERS = (
    "abelian", "commutative", "comm", "finite", "noetherian", "artinian", "complete", "compact", "linear",
    "free", "simple", "normal", "local", "graded", "connected", "hausdorff", "metric",
)


def qualified_names(judgments: DataFrame, qualifiers: tuple[str, ...] = QUALIFIERS) -> DataFrame:
    """J-11: a name that has another inside it, and a qualifier in what is left, is a special case of the other.

    The names inside a name are found among its substrings, so the join is on
    equality and costs the square of a name's length, not of the names. Hyphens
    count as ``_``.
    """
    named = judgments.filter("name is not null and name <> ''").select("id", F.replace(F.lower("name"), F.lit("-"), F.lit("_")).alias("name"))
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("name") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda i: F.substring(F.col("name"), i, n))))
    inside = named.filter(F.length("name") > 1).select(F.col("id").alias("dst"), "name", F.explode(F.array_distinct(parts)).alias("part"))
    met = inside.join(named.select(F.col("id").alias("src"), F.col("name").alias("part")), "part").filter("src <> dst")
    rest = F.replace(F.col("name"), F.col("part"), F.lit(""))
    special = F.lit(False)
    for q in qualifiers:
        special = special | F.contains(rest, F.lit(q))
    return met.filter(special).select("src", "dst", F.lit(SPECIALIZATION).alias("kind"), F.lit(0.35).alias("confidence")).distinct()


def proposals(judgments: DataFrame) -> DataFrame:
    """G-09, O-05: all rules, the first rule of each edge kept, ranked by confidence."""
    judgments = written(judgments.select("id", "name", "hash", "context"), "judgments")
    rules = [
        same_statement(judgments),
        name_pattern(judgments, "_iff_", EQUIVALENCE, 0.45, every=True),
        name_pattern(judgments, "_equiv_", EQUIVALENCE, 0.45, every=True),
        qualified_names(judgments),
        name_pattern(judgments, "_of_", IMPLICATION, 0.4, swap=True, distinct_from_self=True),
        name_pattern(judgments, "_from_", IMPLICATION, 0.4, swap=True, distinct_from_self=True),
        name_pattern(judgments, "_to_", IMPLICATION, 0.4, distinct_from_self=True),
        name_pattern(judgments, "_implies_", IMPLICATION, 0.55),
        name_pattern(judgments, "_entails_", IMPLICATION, 0.55),
        name_pattern(judgments, "_generalizes_", SPECIALIZATION, 0.5),
        name_pattern(judgments, "_specializes_", SPECIALIZATION, 0.5, swap=True),
        corollaries(judgments),
    ]
    every = reduce(DataFrame.unionByName, [r.withColumn("rule", F.lit(k)) for k, r in enumerate(rules)])
    turned = (F.col("kind") == EQUIVALENCE) & (F.col("src") > F.col("dst"))
    keyed = every.withColumns({"a": F.when(turned, F.col("dst")).otherwise(F.col("src")), "b": F.when(turned, F.col("src")).otherwise(F.col("dst"))})
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("a", "b", "kind").orderBy("rule", "src", "dst"))).filter("n = 1")
    return first.select("src", "dst", "kind", "confidence", "rule").orderBy(F.desc("confidence"), "src", "dst")


def new_proposals(judgments: DataFrame, last_id: int, existing: DataFrame) -> DataFrame:
    """G-11: proposals that touch a judgment after ``last_id`` and no edge (src, dst, kind) has yet."""
    fresh = proposals(judgments).filter((F.col("src") > last_id) | (F.col("dst") > last_id))
    return fresh.join(existing.select("src", "dst", "kind").distinct(), ["src", "dst", "kind"], "left_anti")


# --- edge states -------------------------------------------------------------


LOG = "src long, dst long, kind string, status string, refused long, suppressed boolean"


def _event(edges: dict[tuple[int, int, str], dict], e: tuple) -> None:
    """One event on the edges between two nodes."""
    src, dst = (min(e.src, e.dst), max(e.src, e.dst)) if e.kind == EQUIVALENCE else (e.src, e.dst)
    own = edges.setdefault((src, dst, e.kind), {"status": "refused", "refused": 0, "suppressed": False})
    if e.action == "reject":
        own["status"] = "rejected"
    elif e.action == "propose" and own["status"] == "refused":
        own["status"] = "proposed"
    elif e.action == "accept" and own["status"] in ("refused", "proposed"):
        other = [(k, x, (a, b) == (src, dst), (b, a) == (src, dst)) for (a, b, k), x in edges.items() if k != e.kind]
        if any(x["status"] == "accepted" and (along or (back and k == EQUIVALENCE)) for k, x, along, back in other):
            own["refused"] += 1
            return
        own["status"] = "accepted"
        for _, x, along, back in other:
            if x["status"] == "proposed" and (along or (back and e.kind == EQUIVALENCE)):
                x |= {"status": "rejected", "suppressed": True}


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of each pair of nodes after its events; the rows come by pair and in order."""
    pair, edges = None, {}
    rows = lambda: [(*key, *x.values()) for key, x in edges.items()]
    columns = ["src", "dst", "kind", "status", "refused", "suppressed"]
    for pdf in batches:
        done = []
        for e in pdf.itertuples(index=False):
            if (e.p, e.q) != pair:
                done += rows()
                pair, edges = (e.p, e.q), {}
            _event(edges, e)
        yield pd.DataFrame(done, columns=columns)
    yield pd.DataFrame(rows(), columns=columns)


def edge_log(events: DataFrame) -> DataFrame:
    """G-08: (src, dst, kind, status, refused, suppressed) from a log of (id, src, dst, kind, action).

    A rejected edge stays rejected. An accept is refused while an edge of
    another kind is accepted from the same node to the same node, or an
    equivalence between the two; an edge that was only ever refused has that
    status. An accept rejects the proposals of other kinds that compete with
    it, an equivalence those of both directions. The log of two nodes is
    folded in one task; logs of different pairs are independent.
    """
    pair = events.withColumns({"p": F.least("src", "dst"), "q": F.greatest("src", "dst")})
    return pair.repartition("p", "q").sortWithinPartitions("p", "q", "id").mapInPandas(_folded, LOG)


def edge_states(events: DataFrame) -> DataFrame:
    """G-08: (src, dst, kind, status) after the log."""
    return edge_log(events).select("src", "dst", "kind", "status")


def exclusive_conflicts(events: DataFrame) -> DataFrame:
    """G-08: (src, dst, kind, refused): edges whose acceptance was refused, and how often."""
    return edge_log(events).filter("refused > 0").select("src", "dst", "kind", "refused")


def competing(events: DataFrame) -> DataFrame:
    """G-08: (src, dst, kind): proposals that an accepted edge of another kind has rejected."""
    return edge_log(events).filter("suppressed").select("src", "dst", "kind")


def dangling(rows: DataFrame, ref: str, targets: DataFrame, key: str) -> DataFrame:
    """G-23: the rows whose reference has no target."""
    return rows.filter(F.col(ref).isNotNull()).join(targets.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")
