"""Graph operators on analogues: parts as judgments, lines of an order as edges, turns as dependency chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..plans.stages import dealt, written
from ..session import table

EDGES_SQL = """
nx AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst,
  CASE WHEN l_quantity = 50 AND l_discount >= 0.095 THEN 'equivalence' WHEN l_returnflag = 'A' THEN 'implication' WHEN l_returnflag = 'R' THEN 'specialization' ELSE 'generalization' END AS kind,
  CASE WHEN l_linestatus = 'O' THEN 'accepted' ELSE 'proposed' END AS status FROM lineitem),
edges AS (SELECT * FROM nx WHERE dst IS NOT NULL AND src <> dst)
"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between parts that follow each other in an order."""
    lines = table(spark, sf_dir, "lineitem")
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    kind = F.when((F.col("l_quantity") == 50) & (F.col("l_discount") >= 0.095), G.EQUIVALENCE).when(F.col("l_returnflag") == "A", G.IMPLICATION).when(F.col("l_returnflag") == "R", G.SPECIALIZATION).otherwise(G.GENERALIZATION)
    # whole orders in partitions of bounded size
    own = dealt(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"), lines.count(), "l_orderkey")
    made = own.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("src"), nxt.alias("dst"), kind.alias("kind"), F.when(F.col("l_linestatus") == "O", "accepted").otherwise("proposed").alias("status"))
    return made.filter("dst is not null and src <> dst")


def _reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return G.representatives(nodes, edges(spark, sf_dir).filter("kind = 'equivalence'"))


REPS_SQL = f"""
{EDGES_SQL},
eq AS (SELECT src AS a, dst AS b FROM edges WHERE kind = 'equivalence' UNION SELECT dst, src FROM edges WHERE kind = 'equivalence'),
reach AS (SELECT p_partkey AS a, p_partkey AS b FROM part UNION SELECT reach.a, eq.b FROM reach JOIN eq ON reach.b = eq.a),
reps AS (SELECT a AS id, min(b) AS rep FROM reach GROUP BY a),
collapsed AS (SELECT coalesce(x.rep, src) AS src, coalesce(y.rep, dst) AS dst, kind, min(e.id) AS witness FROM edges e LEFT JOIN reps x ON x.id = src LEFT JOIN reps y ON y.id = dst
  WHERE kind <> 'equivalence' AND coalesce(x.rep, src) <> coalesce(y.rep, dst) GROUP BY ALL)
"""


def components_quotient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reps(spark, sf_dir)


def quotient_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.classes(_reps(spark, sf_dir)).select("rep", "size", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def collapsed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.collapse(edges(spark, sf_dir), _reps(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn depends on the two turns before it; a node is conv_id * 100 + turn."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    back = own.select("conv_id", F.col("turn").alias("before"))
    met = own.join(back, "conv_id").filter("before < turn and before >= turn - 2")
    return met.select((F.col("conv_id") * 100 + F.col("turn")).alias("src"), (F.col("conv_id") * 100 + F.col("before")).alias("dst"))


TURNS_SQL = "dep AS (SELECT a.conv_id * 100 + a.turn AS src, b.conv_id * 100 + b.turn AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.turn >= a.turn - 2)"


def chain_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.chain_depths(turns(spark, sf_dir))


def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-06: what each turn depends on, over any number of steps."""
    starts = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"))
    return G.reachable(turns(spark, sf_dir), starts)


def shortest_composable_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-07: from each turn; the kind of a dependency follows from its ends."""
    own = turns(spark, sf_dir)
    kinds = F.array(*[F.lit(k) for k in (G.EQUIVALENCE, G.IMPLICATION, G.SPECIALIZATION, G.GENERALIZATION)])
    typed = own.select((F.col("src") * 10 + F.col("src") - F.col("dst")).alias("id"), "src", "dst", F.get(kinds, ((F.col("src") * 3 + F.col("dst")) % 4).cast("int")).alias("kind"))
    found = G.derivations(typed, own.select(F.col("src").alias("id")).distinct())
    return found.select("start", "node", "kind", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("t")).select((F.col("conv_id") * 100 + F.col("t")).alias("id"))


def lineage_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.spines(turns(spark, sf_dir), _roots(spark, sf_dir))


SPINE_SQL = f"""
{TURNS_SQL}, roots AS (SELECT conv_id * 100 + max(turn) AS root FROM conversations GROUP BY conv_id),
depths AS (SELECT n, max(d) AS depth FROM (SELECT src AS n, (src % 100) AS d FROM dep UNION ALL SELECT dst, dst % 100 FROM dep) GROUP BY n),
spine AS (SELECT root, 0 AS step, root AS node FROM roots UNION ALL SELECT root, step + 1, node - 1 FROM spine WHERE node % 100 > 0)
"""


def lineage_layers_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, roots = turns(spark, sf_dir), _roots(spark, sf_dir)
    return G.layers(own, roots, G.spines(own, roots), depth=4, per_layer=1)


def lineage_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-17: shown turns with dependencies that aren't shown, and the candidates that found no place."""
    own, roots = turns(spark, sf_dir), _roots(spark, sf_dir)
    shown = written(G.layers(own, roots, G.spines(own, roots), depth=4, per_layer=1), "shown")
    unseen = G.hidden(own, shown).select("root", "node", F.col("unseen").alias("n"))
    return unseen.union(G.omitted(own, shown, 4).filter("omitted > 0").select("root", F.lit(-1).cast("long"), "omitted"))


def spine_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = turns(spark, sf_dir)
    out = G.spine_outline(own, G.spines(own, _roots(spark, sf_dir)))
    return out.select("root", "step", "node", "next", F.array_join(F.transform("sides", lambda x: x.cast("string")), ",").alias("sides"), "remaining")


def one_hop_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighborhood(edges(spark, sf_dir), 7)


def concept_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = edges(spark, sf_dir).select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"))
    weights = dealt(ends, table(spark, sf_dir, "lineitem").count(), "i", "j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("w"))
    return G.concept_map(weights, 7)


MAP_SQL = f"""
WITH {EDGES_SQL}, wt AS (SELECT least(src, dst) AS i, greatest(src, dst) AS j, count(*) AS w FROM edges GROUP BY ALL),
both_ AS (SELECT i AS a, j AS b, w FROM wt UNION ALL SELECT j, i, w FROM wt),
heavy AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, b) <= 6),
hops AS (SELECT b AS node, 1 AS hop, w FROM heavy WHERE a = 7 UNION ALL SELECT y.b, 2, y.w FROM heavy x JOIN heavy y ON y.a = x.b WHERE x.a = 7 AND y.b <> 7),
best AS (SELECT node, min((hop, -w)) AS k FROM hops GROUP BY node ORDER BY k, node LIMIT 35), ns AS (SELECT node FROM best UNION ALL SELECT 7)
SELECT i AS a, j AS b, max(w) AS w FROM wt WHERE i IN (SELECT node FROM ns) AND j IN (SELECT node FROM ns) GROUP BY ALL
"""


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as judgments: the type and size as the statement, the suppliers of few lines as the context."""
    context = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").groupBy(F.col("l_partkey").alias("id")).agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 3)).alias("context"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.concat_ws("/", "p_type", "p_size", "p_brand").alias("hash"))
    return parts.join(context, "id", "left").withColumn("context", F.coalesce("context", F.array().cast("array<bigint>")))


JUDGMENTS_SQL = """
ctx AS (SELECT l_partkey AS id, list_sort(list(DISTINCT l_suppkey % 3)) AS context FROM lineitem WHERE l_quantity >= 49 GROUP BY 1),
j AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name, p_type || '/' || p_size || '/' || p_brand AS hash, coalesce(context, []) AS context FROM part LEFT JOIN ctx ON ctx.id = p_partkey),
pr AS (SELECT a.id AS i, b.id AS j, a.context = b.context AS eq, list_has_all(b.context, a.context) AS up, list_has_all(a.context, b.context) AS down FROM j a JOIN j b ON a.hash = b.hash AND a.id < b.id)
"""


def equal_statement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.same_statement(judgments(spark, sf_dir))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judgment for each name of a part, and others whose names are built from these."""
    own = judgments(spark, sf_dir).groupBy("name").agg(F.min_by(F.struct("id", "hash", "context"), "id").alias("r")).select("r.id", "name", "r.hash", "r.context")
    pick = lambda words: F.get(F.array(*[F.lit(x) for x in words]), (F.col("id") % len(words)).cast("int"))
    none = F.array().cast("array<bigint>").alias("context")
    built = lambda shift, name: own.select((F.col("id") + shift).alias("id"), name.alias("name"), F.concat(F.lit("x"), F.col("id") + shift).alias("hash"), none)
    parts = [built(1_000_000, F.concat("name", pick(MARKS), F.lit("red_ring"))), built(2_000_000, F.concat(F.lit("Cor_"), "name")), built(3_000_000, F.concat(pick(G.QUALIFIERS), F.lit("-"), "name"))]
    for p in parts:
        own = own.union(p)
    return own


#: Marks of the names that are built.
MARKS = ("_iff_", "_of_", "_implies_", "_to_", "_generalizes_")


def name_pattern_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _named(spark, sf_dir)
    return G.name_pattern(own, "_implies_", G.IMPLICATION, 0.55).union(G.name_pattern(own, "_of_", G.IMPLICATION, 0.4, swap=True, distinct_from_self=True)).union(G.corollaries(own)).distinct()


_MARKS = ", ".join(f"'{m}'" for m in MARKS)
_QUALIFIERS = ", ".join(f"'{q}'" for q in G.QUALIFIERS)
NAMED_SQL = f"""{JUDGMENTS_SQL},
o AS (SELECT name, min(id) AS id, arg_min(hash, id) AS hash, arg_min(context, id) AS context FROM j GROUP BY name),
n AS (SELECT id, lower(name) AS name FROM o UNION ALL SELECT id + 1000000, lower(name || [{_MARKS}][id % {len(MARKS)} + 1] || 'red_ring') FROM o
  UNION ALL SELECT id + 2000000, 'cor_' || lower(name) FROM o UNION ALL SELECT id + 3000000, lower([{_QUALIFIERS}][id % {len(G.QUALIFIERS)} + 1] || '-' || name) FROM o)"""
NAMES_SQL = f"""
WITH {NAMED_SQL},
last AS (SELECT name, max(id) AS id FROM n GROUP BY name),
s AS (SELECT n.id AS self, m, string_split(name, m)[1] AS l, substr(name, instr(name, m) + length(m)) AS r FROM n, (SELECT unnest(['_implies_', '_of_']) AS m) WHERE instr(name, m) > 1 AND instr(name, m) + length(m) <= length(name)),
x AS (SELECT self, m, a.id AS li, b.id AS ri FROM s JOIN last a ON a.name = l JOIN last b ON b.name = r WHERE a.id <> b.id)
SELECT DISTINCT li AS src, ri AS dst, 'implication' AS kind, 0.55::DOUBLE AS confidence FROM x WHERE m = '_implies_' UNION
SELECT DISTINCT ri, li, 'implication', 0.4::DOUBLE FROM x WHERE m = '_of_' AND li <> self AND ri <> self UNION
SELECT DISTINCT last.id, n.id, 'implication', 0.3::DOUBLE FROM n JOIN last ON last.name = regexp_extract(n.name, '^(corollary|coroll|cor)_(.+)$', 2) WHERE last.id <> n.id
"""


def qualifier_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.qualified_names(_named(spark, sf_dir))


QUALIFIED_SQL = f"""u AS (SELECT id, replace(name, '-', '_') AS name FROM n),
qn AS (SELECT g.id AS src, s.id AS dst FROM u g JOIN u s ON contains(s.name, g.name) AND s.name <> g.name WHERE {' OR '.join(f"contains(replace(s.name, g.name, ''), '{q}')" for q in G.QUALIFIERS)})"""


def _mark_sql(rule: int, mark: str, kind: str, confidence: float, swap: bool = False, every: bool = False, distinct: bool = False) -> str:
    """One rule on names in SQL."""
    src, dst = ("b.id", "a.id") if swap else ("a.id", "b.id")
    of = "n" if every else "lst"
    cut = f"instr(x.name, '{mark}')"
    return f"""SELECT {src} AS src, {dst} AS dst, '{kind}' AS kind, {confidence}::DOUBLE AS confidence, {rule} AS rule FROM n x JOIN {of} a ON a.name = substr(x.name, 1, {cut} - 1) JOIN {of} b ON b.name = substr(x.name, {cut} + {len(mark)})
      WHERE {cut} > 1 AND {cut} + {len(mark)} <= length(x.name) AND a.id <> b.id{' AND a.id <> x.id AND b.id <> x.id' if distinct else ''}"""


RULES_SQL = " UNION ALL ".join([
    "SELECT CASE WHEN eq OR up THEN i ELSE j END AS src, CASE WHEN eq OR up THEN j ELSE i END AS dst, CASE WHEN eq THEN 'equivalence' ELSE 'specialization' END AS kind, CASE WHEN eq THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END AS confidence, 0 AS rule FROM op WHERE eq OR up OR down",
    _mark_sql(1, "_iff_", G.EQUIVALENCE, 0.45, every=True),
    _mark_sql(2, "_equiv_", G.EQUIVALENCE, 0.45, every=True),
    "SELECT src, dst, 'specialization', 0.35::DOUBLE, 3 FROM qn",
    _mark_sql(4, "_of_", G.IMPLICATION, 0.4, swap=True, distinct=True),
    _mark_sql(5, "_from_", G.IMPLICATION, 0.4, swap=True, distinct=True),
    _mark_sql(6, "_to_", G.IMPLICATION, 0.4, distinct=True),
    _mark_sql(7, "_implies_", G.IMPLICATION, 0.55),
    _mark_sql(8, "_entails_", G.IMPLICATION, 0.55),
    _mark_sql(9, "_generalizes_", G.SPECIALIZATION, 0.5),
    _mark_sql(10, "_specializes_", G.SPECIALIZATION, 0.5, swap=True),
    "SELECT lst.id, n.id, 'implication', 0.3::DOUBLE, 11 FROM n JOIN lst ON lst.name = regexp_extract(n.name, '^(corollary|coroll|cor)_(.+)$', 2) WHERE lst.id <> n.id",
])
PROPOSALS_SQL = f"""WITH {NAMED_SQL}, lst AS (SELECT name, max(id) AS id FROM n GROUP BY name), {QUALIFIED_SQL},
op AS (SELECT a.id AS i, b.id AS j, a.context = b.context AS eq, list_has_all(b.context, a.context) AS up, list_has_all(a.context, b.context) AS down FROM o a JOIN o b ON a.hash = b.hash AND a.id < b.id),
every_ AS ({RULES_SQL}),
keyed AS (SELECT *, CASE WHEN kind = 'equivalence' THEN least(src, dst) ELSE src END AS a, CASE WHEN kind = 'equivalence' THEN greatest(src, dst) ELSE dst END AS b FROM every_)
SELECT src, dst, kind, confidence, rule FROM keyed QUALIFY row_number() OVER (PARTITION BY a, b, kind ORDER BY rule, src, dst) = 1"""


def morphism_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.proposals(_named(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of edge events by analogy: users and event types as ends, the types as actions."""
    action = F.when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "purchase", "accept").otherwise("propose")
    kind = F.when(F.col("event_id") % 3 == 0, G.IMPLICATION).otherwise(G.SPECIALIZATION)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("src"), (F.col("event_id") % 40).alias("dst"), kind.alias("kind"), action.alias("action"))


def _step(own: str, other: str) -> tuple[str, str, str, str]:
    """What an event does to the status of its own edge and of the other kind's, to the refusals and to the suppression."""
    open_ = f"{own} IN ('none', 'refused', 'proposed')"
    new = f"""CASE action WHEN 'reject' THEN 'rejected' WHEN 'propose' THEN CASE WHEN {own} IN ('none', 'refused') THEN 'proposed' ELSE {own} END
      ELSE CASE WHEN NOT {open_} THEN {own} WHEN {other} = 'accepted' THEN CASE WHEN {own} = 'none' THEN 'refused' ELSE {own} END ELSE 'accepted' END END"""
    hit = f"action = 'accept' AND {open_} AND {other} = 'proposed'"
    return new, f"CASE WHEN {hit} THEN 'rejected' ELSE {other} END", f"CASE WHEN action = 'accept' AND {open_} AND {other} = 'accepted' THEN 1 ELSE 0 END", hit


_A, _B = _step("a", "b"), _step("b", "a")
#: The log of each pair of nodes folded event by event; a is the implication, b the specialization.
STATES_SQL = f"""
ev AS (SELECT event_id AS id, user_id AS src, event_id % 40 AS dst, CASE WHEN event_id % 3 = 0 THEN 'implication' ELSE 'specialization' END AS kind,
  CASE event_type WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'accept' ELSE 'propose' END AS action FROM events),
od AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY id) AS n FROM ev),
fold AS (SELECT DISTINCT src, dst, 0::BIGINT AS n, 'none' AS a, 'none' AS b, 0 AS ra, 0 AS rb, FALSE AS xa, FALSE AS xb FROM ev
  UNION ALL SELECT f.src, f.dst, od.n, CASE WHEN kind = 'implication' THEN {_A[0]} ELSE {_B[1]} END, CASE WHEN kind = 'implication' THEN {_A[1]} ELSE {_B[0]} END,
    ra + CASE WHEN kind = 'implication' THEN {_A[2]} ELSE 0 END, rb + CASE WHEN kind = 'implication' THEN 0 ELSE {_B[2]} END,
    xa OR (kind = 'specialization' AND {_B[3]}), xb OR (kind = 'implication' AND {_A[3]}) FROM fold f JOIN od ON od.src = f.src AND od.dst = f.dst AND od.n = f.n + 1),
fin AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY n DESC) = 1),
st AS (SELECT src, dst, 'implication' AS kind, a AS status, ra::BIGINT AS refused, xa AS suppressed FROM fin WHERE a <> 'none' UNION ALL SELECT src, dst, 'specialization', b, rb::BIGINT, xb FROM fin WHERE b <> 'none')
"""


def edge_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edge_states(_events(spark, sf_dir))


def exclusive_kind_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.exclusive_conflicts(_events(spark, sf_dir))


def competing_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.competing(_events(spark, sf_dir))


def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dangling(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'"), "c_custkey").select("o_orderkey", "o_custkey")


QUERIES = {f.__name__: f for f in (components_quotient, quotient_classes, collapsed_edges, reachability, shortest_composable_path, chain_depth, lineage_spine, lineage_layers_capped, lineage_hidden, spine_outline, one_hop_neighborhood, concept_map, equal_statement_pairs, name_pattern_proposals, qualifier_names, morphism_proposals, edge_status_fold, exclusive_kind_conflicts, competing_proposals, dangling_references)}

ORACLES = {
    "components_quotient": f"WITH RECURSIVE {REPS_SQL} SELECT * FROM reps",
    "quotient_classes": f"WITH RECURSIVE {REPS_SQL} SELECT rep, count(*) AS size, string_agg(id::VARCHAR, ',' ORDER BY id) AS members FROM reps GROUP BY rep HAVING count(*) > 1",
    "collapsed_edges": f"WITH RECURSIVE {REPS_SQL} SELECT * FROM collapsed",
    "reachability": "SELECT a.conv_id * 100 + a.turn AS start, b.conv_id * 100 + b.turn AS node, ((a.turn - b.turn + 1) // 2)::INT AS depth FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn <= a.turn",
    "lineage_hidden": """WITH r AS (SELECT conv_id, max(turn) AS t FROM conversations GROUP BY 1), s AS (SELECT conv_id, t, unnest(range(0, least(t, 4) + 1)) AS d FROM r),
      h AS (SELECT conv_id * 100 + t AS root, conv_id * 100 + t - d AS node, (CASE WHEN t - d >= 1 AND d + 1 > 4 THEN 1 ELSE 0 END + CASE WHEN t - d >= 2 AND d + 2 > 4 THEN 1 ELSE 0 END)::BIGINT AS n FROM s)
      SELECT * FROM h WHERE n > 0 UNION ALL SELECT conv_id * 100 + t, -1, least(4, t - 1) FROM r WHERE t > 1""",
    "chain_depth": f"WITH RECURSIVE {SPINE_SQL} SELECT n AS node, depth FROM depths",
    "lineage_spine": f"WITH RECURSIVE {SPINE_SQL} SELECT * FROM spine",
    "lineage_layers_capped": f"WITH RECURSIVE {SPINE_SQL} SELECT root, step AS depth, node FROM spine WHERE step <= 4",
    "spine_outline": f"WITH RECURSIVE {SPINE_SQL} SELECT root, step, node, CASE WHEN node % 100 > 0 THEN node - 1 END AS next, CASE WHEN node % 100 > 1 THEN (node - 2)::VARCHAR ELSE '' END AS sides, 0 AS remaining FROM spine",
    "one_hop_neighborhood": f"WITH {EDGES_SQL}, n AS (SELECT DISTINCT 'depends_on' AS direction, dst AS node FROM edges WHERE src = 7 UNION SELECT DISTINCT 'used_by', src FROM edges WHERE dst = 7) SELECT direction, node, greatest(0, count(*) OVER (PARTITION BY direction) - 12) AS omitted FROM n QUALIFY row_number() OVER (PARTITION BY direction ORDER BY node) <= 12",
    "concept_map": MAP_SQL,
    "equal_statement_pairs": f"WITH {JUDGMENTS_SQL} SELECT CASE WHEN eq OR up THEN i ELSE j END AS src, CASE WHEN eq OR up THEN j ELSE i END AS dst, CASE WHEN eq THEN 'equivalence' ELSE 'specialization' END AS kind, CASE WHEN eq THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END AS confidence FROM pr WHERE eq OR up OR down",
    "name_pattern_proposals": NAMES_SQL,
    "qualifier_names": f"WITH {NAMED_SQL}, {QUALIFIED_SQL} SELECT DISTINCT src, dst, 'specialization' AS kind, 0.35::DOUBLE AS confidence FROM qn",
    "morphism_proposals": PROPOSALS_SQL,
    "edge_status_fold": f"WITH RECURSIVE {STATES_SQL} SELECT src, dst, kind, status FROM st",
    "exclusive_kind_conflicts": f"WITH RECURSIVE {STATES_SQL} SELECT src, dst, kind, refused FROM st WHERE refused > 0",
    "competing_proposals": f"WITH RECURSIVE {STATES_SQL} SELECT src, dst, kind FROM st WHERE suppressed",
    "dangling_references": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')",
}
