"""Provenance on analogues: orders as assertions, lines as evidence, events as reviews, suppliers as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cooccurrence as C
from ..operators import graph as G
from ..operators import lookups as L
from ..operators import provenance as P
from ..session import table
from .mining import RELATIONS_SQL, _relation_sources

_PREDICATES = "CASE o_orderkey % 9 WHEN 0 THEN 'depends_on' WHEN 1 THEN 'cites' WHEN 2 THEN 'imports' WHEN 3 THEN 'implies' WHEN 4 THEN 'specializes' WHEN 5 THEN 'generalizes' WHEN 6 THEN 'equivalent_to' WHEN 7 THEN 'related_to' ELSE 'uses_concept' END"
_STATES = "CASE o_custkey % 6 WHEN 0 THEN 'proposed' WHEN 1 THEN 'extracted' WHEN 2 THEN 'observed' WHEN 3 THEN 'reviewed' WHEN 4 THEN 'verified' ELSE 'rejected' END"
_KIND = "CASE WHEN o_orderkey % 11 = {n} THEN 'paper' WHEN o_orderkey % 4 = 1 THEN 'concept' ELSE 'judgment' END"
#: Select lists that both engines read alike.
ASSERTION_COLUMNS = [
    "o_orderkey AS id",
    "o_custkey AS subject",
    "o_orderkey % 1500 AS object",
    f"{_KIND.format(n=1)} AS subject_kind",
    f"{_KIND.format(n=2)} AS object_kind",
    f"{_PREDICATES} AS predicate",
    f"{_STATES} AS state",
    "CASE WHEN o_orderstatus = 'F' THEN 'r1' ELSE 'r2' END AS release",
    "concat('order:', CASE WHEN o_orderkey % 97 = 1 THEN o_orderkey - 1 ELSE o_orderkey END) AS legacy_ref",
    "CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey - 3 END AS supersedes_id",
]
EVIDENCE_COLUMNS = [
    "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS id",
    "l_orderkey AS assertion_id",
    "l_suppkey AS source_id",
    "CASE WHEN l_returnflag = 'A' THEN 'formal_export' WHEN l_returnflag = 'R' THEN 'source_span' WHEN l_linestatus = 'O' THEN 'model_output' ELSE 'reviewer_note' END AS kind",
    "concat('line ', l_linenumber) AS locator",
    "l_discount AS metric",
    "CASE WHEN l_quantity >= 45 THEN 'external_literal_dependency' WHEN l_quantity >= 40 THEN 'external_structural_candidate' END AS classification",
]
REVIEW_COLUMNS = [
    "event_id AS id",
    "user_id * 20 + event_id % 20 AS assertion_id",
    "CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'supersede' ELSE 'comment' END AS decision",
    "CASE WHEN event_id % 5 <> 0 THEN concat('rev', user_id % 7) ELSE ' ' END AS reviewer",
    "CASE WHEN event_id % 7 <> 0 THEN 'maintainer' END AS authorization",
    "event_id * 60 AS decided_at",
    "CASE WHEN event_id % 3 = 0 THEN event_id * 61 END AS expires_at",
    "CASE WHEN event_id % 2 = 0 THEN 'r1' ELSE 'r2' END AS release",
]
SOURCE_COLUMNS = [
    "s_suppkey AS id",
    "CASE WHEN s_nationkey < 12 THEN 'arxiv' ELSE 'lean' END AS provider",
    "CASE WHEN s_suppkey % 10 <> 3 THEN 'CC-BY-4.0' WHEN s_suppkey % 20 = 3 THEN ' ' END AS licence",
    "CASE WHEN s_suppkey % 9 <> 4 THEN s_name END AS attribution",
    "sha2(s_name, 256) AS content_hash",
]


def _sql(name: str, columns: list[str], of: str) -> str:
    return f"{name} AS (SELECT {', '.join(columns)} FROM {of})".replace("sha2(s_name, 256)", "sha256(s_name)")


TABLES_SQL = ",\n".join([_sql("a", ASSERTION_COLUMNS, "orders"), _sql("ev", EVIDENCE_COLUMNS, "lineitem"), _sql("rv", REVIEW_COLUMNS, "events"), _sql("src", SOURCE_COLUMNS, "supplier")])
POLICY_SQL = """CASE WHEN state = 'rejected' THEN 'excluded' WHEN predicate IN ('depends_on', 'cites', 'imports') AND state IN ('observed', 'verified') THEN 'default_traversal'
  WHEN predicate IN ('specializes', 'generalizes', 'equivalent_to', 'related_to', 'uses_concept') AND state IN ('reviewed', 'verified') THEN 'default_traversal' WHEN predicate = 'implies' AND state = 'verified' THEN 'default_traversal'
  WHEN predicate = 'implies' AND state = 'reviewed' THEN 'formal_only' ELSE 'visible_only' END"""
KINDS_SQL = """CASE WHEN predicate = 'depends_on' THEN subject_kind = 'judgment' AND object_kind = 'judgment' WHEN predicate = 'cites' THEN subject_kind = 'paper' AND object_kind = 'paper'
  WHEN predicate IN ('implies', 'specializes', 'generalizes', 'equivalent_to') THEN subject_kind = object_kind AND subject_kind IN ('judgment', 'concept')
  WHEN predicate = 'uses_concept' THEN subject_kind IN ('judgment', 'paper') AND object_kind = 'concept' ELSE TRUE END"""


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return (
        table(spark, sf_dir, "orders").selectExpr(*ASSERTION_COLUMNS),
        table(spark, sf_dir, "lineitem").selectExpr(*EVIDENCE_COLUMNS),
        table(spark, sf_dir, "events").selectExpr(*REVIEW_COLUMNS),
        table(spark, sf_dir, "supplier").selectExpr(*SOURCE_COLUMNS),
    )


def traversal_policy_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, *_ = tables(spark, sf_dir)
    return a.select("id", P.traversal_policy(F.col("predicate"), F.col("state")).alias("policy"))


def relation_schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.schema_violations(tables(spark, sf_dir)[0]).select("id", "predicate", "subject_kind", "object_kind")


def current_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.current(tables(spark, sf_dir)[0]).select("id", "predicate", "state")


def effective_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.effective_reviews(tables(spark, sf_dir)[2])


def authenticated_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)[2].filter(P.authenticated(F.lit(100_000), F.lit("r1"))).select("id", "assertion_id", "reviewer")


def predicate_state_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-02: counts by predicate, by state, by both and in all."""
    a, *_ = tables(spark, sf_dir)
    return a.cube("predicate", "state").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("gid"))


def evidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-03."""
    _, ev, *_ = tables(spark, sf_dir)
    return ev.groupBy("assertion_id").agg(F.count(F.lit(1)).alias("pieces")).groupBy("pieces").agg(F.count(F.lit(1)).alias("assertions"))


def stats_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-01, A-20, A-24: all counts of the store as rows."""
    a, ev, rv, src = tables(spark, sf_dir)
    parts = {"assertions": a.agg(F.count(F.lit(1)).alias("n")), "trusted": a.agg(F.count_if(P.traversal_policy(F.col("predicate"), F.col("state")) == "default_traversal").alias("n")), "evidence": ev.agg(F.count(F.lit(1)).alias("n")), "formal_evidence": ev.agg(F.count_if(F.col("kind") == "formal_export").alias("n")), "reviews": rv.agg(F.count(F.lit(1)).alias("n")), "reviewers": rv.agg(F.countDistinct(F.nullif(F.trim("reviewer"), F.lit(""))).alias("n")), "sources": src.agg(F.count(F.lit(1)).alias("n")), "subjects": a.agg(F.countDistinct("subject").alias("n"))}
    out = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("metric"), "n")
        out = row if out is None else out.union(row)
    return out


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-21: assertions by predicate, with evidence and without."""
    a, ev, *_ = tables(spark, sf_dir)
    known = ev.select(F.col("assertion_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    return a.join(known, "id", "left").groupBy("predicate").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("covered"), F.min(F.when(F.col("hit").isNull(), F.col("id"))).alias("first_uncovered"))


def dependency_edges_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, ev, *_ = tables(spark, sf_dir)
    return P.dependency_export(a, ev)


def trusted_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-18: the dependencies that a trusted traversal follows, by node."""
    a, ev, *_ = tables(spark, sf_dir)
    return G.out_degrees(G.traversable(P.dependency_export(a, ev), True))


def assertions_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-07: the assertions of a release that touch an entity, and the one of a reference."""
    a, *_ = tables(spark, sf_dir)
    found = L.touching(L.where(a, release="r1"), 7).withColumn("by", F.lit("entity"))
    return found.union(L.where(a, legacy_ref="order:4").withColumn("by", F.lit("reference"))).select("id", "by")


def release_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-16: a manifest against its release, sidecars, input files and counts; regions stand for releases, tables for files."""
    releases = table(spark, sf_dir, "region").selectExpr("r_regionkey AS id", "r_name AS tag", "concat('c', r_regionkey) AS git_commit")
    manifest = spark.createDataFrame([("ASIA", 1, "c9", "old")], "release_tag string, release_id long, git_commit string, mapping_version string")
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey"), F.sha2("n_name", 256).alias("sha256"))
    recorded, live = nations.select("name", "sha256"), nations.select(F.when(F.col("n_regionkey") == 0, F.concat("name", F.lit(".new"))).otherwise(F.col("name")).alias("name"), F.when(F.col("n_regionkey") == 1, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    told = counts.select("kind", (F.col("n") + F.when(F.col("kind") == "F", 1).otherwise(0)).alias("n"))
    sidecars = spark.createDataFrame([("judgments", "ASIA"), ("relations", "EUROPE")], "name string, release_tag string")
    return P.release_violations(manifest, releases, sidecars, told, counts, recorded, live, "new")


def morphism_edges_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, ev, rv, _ = tables(spark, sf_dir)
    return P.morphism_export(a, ev, rv)


def relation_edges_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, ev, *_ = tables(spark, sf_dir)
    return P.relation_export(a, ev)


def discovery_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.discovery_source(tables(spark, sf_dir)[1]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def project_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, ev, *_ = tables(spark, sf_dir)
    sourced = P.discovery_source(ev).withColumnRenamed("assertion_id", "id").join(a.select("id", (F.col("subject") % 25).alias("project")), "id")
    return P.project_counts(sourced)


def assertion_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, ev, rv, _ = tables(spark, sf_dir)
    out = P.assertion_details(a, ev, rv)
    return out.select("id", F.coalesce(F.size("evidence"), F.lit(0)).alias("n_evidence"), F.get("evidence", F.lit(0))["kind"].alias("first_kind"), F.coalesce(F.size("reviews"), F.lit(0)).alias("n_reviews"), F.element_at("reviews", -1)["decision"].alias("last_decision"), "policy")


def evidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-14."""
    _, ev, _, src = tables(spark, sf_dir)
    joined = ev.join(src.select(F.col("id").alias("source_id"), "provider"), "source_id")
    return joined.groupBy("provider", P.source_kind_label(F.col("kind")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def reconcile_traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, ev, *_ = tables(spark, sf_dir)
    shown = ev.select(F.col("kind").alias("group"), F.concat(F.lit("order:"), "assertion_id").alias("legacy_ref"))
    return P.reconcile(shown, a)


def set_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables(spark, sf_dir)[1]
    return P.set_compare(ev.filter("kind = 'formal_export'"), ev.filter("kind = 'source_span'"), ["assertion_id", "source_id"])


def gate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.violations(*tables(spark, sf_dir))


GATE_SQL = f"""
WITH {TABLES_SQL}
SELECT 'kinds_do_not_suit_predicate' AS "check", id::VARCHAR AS detail FROM a WHERE NOT ({KINDS_SQL})
UNION ALL SELECT 'no_evidence', id::VARCHAR FROM a WHERE id NOT IN (SELECT assertion_id FROM ev)
UNION ALL SELECT 'evidence_without_assertion', id::VARCHAR FROM ev WHERE assertion_id NOT IN (SELECT id FROM a)
UNION ALL SELECT 'review_without_assertion', id::VARCHAR FROM rv WHERE assertion_id NOT IN (SELECT id FROM a)
UNION ALL SELECT 'evidence_without_source', id::VARCHAR FROM ev WHERE source_id NOT IN (SELECT id FROM src)
UNION ALL SELECT 'trusted_without_qualifying_evidence', id::VARCHAR FROM a WHERE {POLICY_SQL} = 'default_traversal' AND id NOT IN (SELECT assertion_id FROM ev WHERE kind IN ('formal_export', 'source_span', 'reviewer_note'))
UNION ALL SELECT 'relates_to_itself', id::VARCHAR FROM a WHERE subject = object AND predicate <> 'equivalent_to'
UNION ALL SELECT 'ambiguous_key', legacy_ref FROM a GROUP BY release, legacy_ref HAVING count(DISTINCT id) > 1
UNION ALL SELECT 'supersedes_unknown', id::VARCHAR FROM a WHERE supersedes_id IS NOT NULL AND supersedes_id NOT IN (SELECT id FROM a)
UNION ALL SELECT 'no_licence', id::VARCHAR FROM src WHERE coalesce(trim(licence), '') = ''
UNION ALL SELECT 'no_attribution', id::VARCHAR FROM src WHERE coalesce(trim(attribution), '') = ''
"""


def import_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-03: edges from order lines, the citations imported before."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", "l_partkey AS src", "l_suppkey AS dst", "CASE l_returnflag WHEN 'A' THEN 'dependency' WHEN 'R' THEN 'citation' ELSE 'implication' END AS kind", "CASE WHEN l_linestatus = 'O' THEN 'rejected' ELSE 'proposed' END AS status")
    before = P.import_edges(lines.filter("kind = 'citation'"), spark.createDataFrame([], "legacy_ref string, release string"), "r1")
    return P.import_edges(lines, before, "r1")


def import_relation_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-04."""
    return P.import_relations(C.merge_relations(*_relation_sources(spark, sf_dir)))


def import_manifest_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-05, J-08."""
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name"))
    pairs = table(spark, sf_dir, "lineitem").join(named.toDF("l_partkey", "name"), "l_partkey").join(named.select(((F.col("id") + 1).alias("k")), F.col("name").alias("needs")), F.col("l_partkey") == F.col("k")).select("name", "needs", F.col("l_returnflag").alias("origin"))
    return P.import_manifest(pairs, named)


def import_reference_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-06: references inside and outside the snapshot of all orders."""
    works = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("work")).agg(F.collect_set((F.col("l_partkey") * 7) % 30000).alias("refs"))
    inside, outside = P.import_references(works)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("citing").alias("works")).select(F.lit(name).alias("scope"), "n", "works")
    return count(inside, "inside").union(count(outside, "outside"))


def import_statement_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-07."""
    statements = table(spark, sf_dir, "part").filter("p_size < 40").select(F.col("p_partkey").alias("id"))
    edges = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS src", "l_suppkey AS dst", "CASE WHEN l_returnflag = 'A' THEN 'proof' ELSE 'sig' END AS type")
    return P.import_statements(statements, edges)


def entity_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-08, M-04."""
    named = table(spark, sf_dir, "customer").withColumn("label", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")))
    return P.catalog((named, P.JUDGMENT, "c_custkey", "label"), (table(spark, sf_dir, "supplier"), P.PAPER, "s_suppkey", "s_name"), (table(spark, sf_dir, "nation"), P.CONCEPT, "n_nationkey", "n_name"))


def entity_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-09: one set of references is complete, the other is not."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c:"), "o_custkey").alias("subject"), F.concat(F.lit("c:"), F.col("o_custkey") % 10).alias("object"))
    refs = table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("ref"), (F.col("c_custkey") + 1000).alias("entity"))
    done = P.backfill(rows, refs).withColumn("try", F.lit("complete"))
    return done.union(P.backfill(rows, refs.filter("entity <> 1003")).withColumn("try", F.lit("incomplete"))).groupBy("try").agg(F.count("subject_entity").alias("resolved"), F.sum("object_entity").alias("check"))


def ambiguous_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-10."""
    return P.ambiguous(tables(spark, sf_dir)[0], "legacy_ref", "id").select(F.col("key").alias("legacy_ref"), "n")


def retract_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-19: what is left of each table."""
    left = P.retract(7, *tables(spark, sf_dir))
    out = None
    for name, df in zip(("assertions", "evidence", "reviews", "sources"), left, strict=True):
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("id").cast("decimal(38,0)")).cast("string").alias("ids")).select(F.lit(name).alias("table"), "n", "ids")
        out = row if out is None else out.union(row)
    return out


def promote_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-20."""
    a, ev, rv, _ = tables(spark, sf_dir)
    chosen = a.filter("state = 'extracted'").select("id", F.lit("rev1").alias("reviewer"))
    new, notes, accepts = P.promote(a, rv, ev, chosen, 10_000_000, 5)
    return new.select("id", "supersedes_id", "state").join(notes.select(F.col("assertion_id").alias("id"), "kind"), "id").join(accepts.select(F.col("assertion_id").alias("id"), "decision", "reviewer"), "id")


def export_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-17: an export whose rows of one kind were tampered with."""
    a, ev, *_ = tables(spark, sf_dir)
    derived = P.dependency_export(a, ev)
    written = derived.withColumn("policy", F.when(F.col("assertion_id") % 27 == 0, "default_traversal").otherwise(F.col("policy")))
    return P.export_differences(written, derived)


QUERIES = {f.__name__: f for f in (traversal_policy_export, relation_schema_violations, current_assertions, effective_review, authenticated_accept, predicate_state_grouping_sets, evidence_histogram, stats_bundle, coverage_report, dependency_edges_export, morphism_edges_export, relation_edges_export, discovery_sources, project_edge_counts, trusted_dependencies, assertions_touching, release_violations, assertion_details, evidence_labels, reconcile_traced, set_compare, gate_violations, import_graph_edges, import_relation_evidence, import_manifest_unique_names, import_reference_scope, import_statement_reasons, entity_catalog, entity_backfill, ambiguous_keys, retract_cascade, promote_review, export_gate)}

_DEP = f"dep AS (SELECT a.id AS assertion_id, subject AS src, object AS dst, {POLICY_SQL} AS policy, CASE WHEN id IN (SELECT assertion_id FROM ev WHERE kind = 'formal_export') THEN 'checker-derived' ELSE 'text-extracted' END AS origin FROM a WHERE predicate = 'depends_on' AND subject_kind = 'judgment' AND object_kind = 'judgment')"
ORACLES = {
    "traversal_policy_export": f"WITH {TABLES_SQL} SELECT id, {POLICY_SQL} AS policy FROM a",
    "relation_schema_violations": f"WITH {TABLES_SQL} SELECT id, predicate, subject_kind, object_kind FROM a WHERE NOT ({KINDS_SQL})",
    "current_assertions": f"WITH {TABLES_SQL} SELECT id, predicate, state FROM a WHERE id NOT IN (SELECT supersedes_id FROM a WHERE supersedes_id IS NOT NULL)",
    "effective_review": f"WITH {TABLES_SQL} SELECT assertion_id, id AS review_id, decision, decided_at FROM rv QUALIFY row_number() OVER (PARTITION BY assertion_id ORDER BY decided_at DESC, id DESC) = 1",
    "authenticated_accept": f"WITH {TABLES_SQL} SELECT id, assertion_id, reviewer FROM rv WHERE decision IN ('accept', 'supersede') AND trim(reviewer) <> '' AND trim(coalesce(\"authorization\", '')) <> '' AND (expires_at IS NULL OR expires_at > 100000) AND release = 'r1'",
    "predicate_state_grouping_sets": f"WITH {TABLES_SQL} SELECT predicate, state, count(*) AS n, grouping(predicate, state)::BIGINT AS gid FROM a GROUP BY CUBE (predicate, state)",
    "evidence_histogram": "SELECT pieces, count(*) AS assertions FROM (SELECT l_orderkey, count(*) AS pieces FROM lineitem GROUP BY 1) GROUP BY pieces",
    "stats_bundle": f"""WITH {TABLES_SQL} SELECT 'assertions' AS metric, count(*) AS n FROM a UNION ALL SELECT 'trusted', count(*) FROM a WHERE {POLICY_SQL} = 'default_traversal' UNION ALL SELECT 'evidence', count(*) FROM ev UNION ALL SELECT 'formal_evidence', count(*) FROM ev WHERE kind = 'formal_export'
      UNION ALL SELECT 'reviews', count(*) FROM rv UNION ALL SELECT 'reviewers', count(DISTINCT nullif(trim(reviewer), '')) FROM rv UNION ALL SELECT 'sources', count(*) FROM src UNION ALL SELECT 'subjects', count(DISTINCT subject) FROM a""",
    "coverage_report": f"WITH {TABLES_SQL} SELECT predicate, count(*) AS total, count(e) AS covered, min(id) FILTER (e IS NULL) AS first_uncovered FROM a LEFT JOIN (SELECT DISTINCT assertion_id AS e FROM ev) ON e = id GROUP BY predicate",
    "dependency_edges_export": f"WITH {TABLES_SQL}, {_DEP} SELECT * FROM dep",
    "morphism_edges_export": f"""WITH {TABLES_SQL}, note AS (SELECT assertion_id, arg_min(kind, id) AS note, arg_min(locator, id) AS locator FROM ev WHERE kind IN ('reviewer_note', 'model_output') GROUP BY assertion_id)
      SELECT id, subject AS src, object AS dst, predicate AS kind, CASE WHEN note = 'reviewer_note' THEN 'manual' ELSE 'heuristic' END AS origin, CASE WHEN state = 'rejected' THEN 'rejected' WHEN id IN (SELECT assertion_id FROM rv WHERE decision = 'accept') THEN 'accepted' ELSE 'proposed' END AS status,
      locator AS rationale, {POLICY_SQL} AS policy FROM a LEFT JOIN note ON assertion_id = id WHERE predicate IN ('implies', 'specializes', 'generalizes', 'equivalent_to') AND subject_kind = 'judgment' AND object_kind = 'judgment'""",
    "relation_edges_export": f"""WITH {TABLES_SQL}, g AS (SELECT assertion_id, arg_min(kind, id) AS ground, arg_min(locator, id) AS locator FROM ev WHERE kind IN ('source_span', 'reviewer_note') GROUP BY assertion_id), m AS (SELECT assertion_id, arg_min(metric, id) AS metric FROM ev WHERE kind = 'model_output' GROUP BY assertion_id)
      SELECT a.id AS assertion_id, subject, object, predicate AS kind, CASE WHEN ground = 'reviewer_note' THEN 'reviewed' WHEN m.assertion_id IS NOT NULL THEN 'confirmed' ELSE 'grounded' END AS status, metric AS confidence, coalesce(locator, '') AS sentence, {POLICY_SQL} AS policy
      FROM a JOIN g ON g.assertion_id = a.id LEFT JOIN m ON m.assertion_id = a.id WHERE subject_kind = 'concept' AND object_kind = 'concept'""",
    "trusted_dependencies": f"WITH {TABLES_SQL}, {_DEP} SELECT src AS node, count(*) AS degree FROM dep WHERE policy = 'default_traversal' GROUP BY src",
    "assertions_touching": f"WITH {TABLES_SQL} SELECT id, 'entity' AS by FROM a WHERE release = 'r1' AND (subject = 7 OR object = 7) UNION ALL SELECT id, 'reference' FROM a WHERE legacy_ref = 'order:4'",
    "release_violations": """SELECT 'source_mapping_policy_mismatch' AS "check", 'old' AS detail UNION ALL SELECT 'manifest_release_id_mismatch', 'ASIA' UNION ALL SELECT 'manifest_release_commit_mismatch', 'ASIA' UNION ALL SELECT 'sidecar_release_mismatch', 'relations'
      UNION ALL SELECT 'input_file_not_in_manifest', n_name || '.new' FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'input_file_hash_mismatch', n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'counts_mismatch', 'F'""",
    "discovery_sources": f"""WITH {TABLES_SQL}, f AS (SELECT assertion_id, arg_min(kind, id) AS kind, arg_min(coalesce(classification, ''), id) AS c FROM ev GROUP BY assertion_id)
      SELECT CASE WHEN c = 'external_literal_dependency' THEN 'external_literal' WHEN c = 'external_structural_candidate' THEN 'external_structural' WHEN kind = 'formal_export' THEN 'checker' ELSE 'text' END AS source, count(*) AS n FROM f GROUP BY 1""",
    "project_edge_counts": f"""WITH {TABLES_SQL}, f AS (SELECT assertion_id, arg_min(coalesce(classification, ''), id) AS c FROM ev GROUP BY assertion_id)
      SELECT subject % 25 AS project, count(*) FILTER (c = 'external_literal_dependency') AS literal, count(*) FILTER (c = 'external_structural_candidate') AS structural, count(*) AS total FROM f JOIN a ON a.id = assertion_id WHERE c <> '' GROUP BY 1""",
    "assertion_details": f"""WITH {TABLES_SQL}, e AS (SELECT assertion_id, count(*) AS n, arg_min(kind, id) AS k FROM ev GROUP BY 1), r AS (SELECT assertion_id, count(*) AS n, arg_max(decision, (decided_at, id)) AS d FROM rv GROUP BY 1)
      SELECT a.id, coalesce(e.n, 0) AS n_evidence, e.k AS first_kind, coalesce(r.n, 0) AS n_reviews, r.d AS last_decision, {POLICY_SQL} AS policy FROM a LEFT JOIN e ON e.assertion_id = a.id LEFT JOIN r ON r.assertion_id = a.id""",
    "evidence_labels": f"WITH {TABLES_SQL} SELECT provider, CASE kind WHEN 'formal_export' THEN 'checked by a proof assistant' WHEN 'source_span' THEN 'stated in a text' WHEN 'model_output' THEN 'computed by a model' ELSE 'noted by a reviewer' END AS label, count(*) AS n FROM ev JOIN src ON src.id = source_id GROUP BY ALL",
    "reconcile_traced": f"WITH {TABLES_SQL} SELECT kind AS \"group\", count(*) AS total, count(*) FILTER ('order:' || assertion_id IN (SELECT legacy_ref FROM a)) AS traced FROM ev GROUP BY kind",
    "set_compare": f"""WITH {TABLES_SQL}, x AS (SELECT DISTINCT assertion_id, source_id FROM ev WHERE kind = 'formal_export'), y AS (SELECT DISTINCT assertion_id, source_id FROM ev WHERE kind = 'source_span')
      SELECT 'both' AS side, count(*) AS n FROM (SELECT * FROM x INTERSECT SELECT * FROM y) HAVING count(*) > 0 UNION ALL SELECT 'first_only', count(*) FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT 'second_only', count(*) FROM (SELECT * FROM y EXCEPT SELECT * FROM x)""",
    "gate_violations": GATE_SQL,
    "import_graph_edges": """SELECT l_partkey AS subject, l_suppkey AS object, CASE l_returnflag WHEN 'A' THEN 'depends_on' WHEN 'R' THEN 'cites' ELSE 'implies' END AS predicate,
      CASE WHEN l_returnflag = 'A' THEN 'extracted' WHEN l_returnflag = 'R' THEN 'observed' WHEN l_linestatus = 'O' THEN 'rejected' ELSE 'proposed' END AS state,
      CASE l_returnflag WHEN 'A' THEN 'dependency' WHEN 'R' THEN 'citation' ELSE 'implication' END || ':' || (l_orderkey * 10 + l_linenumber) AS legacy_ref, 'r1' AS release FROM lineitem
      WHERE l_returnflag <> 'R'""",
    "import_relation_evidence": f"""WITH {RELATIONS_SQL}, m AS (SELECT *, CASE WHEN kind = 'specialization_of' THEN 'specializes' ELSE 'equivalent_to' END AS predicate, CASE WHEN status = 'proposed' THEN 'proposed' ELSE 'extracted' END AS state FROM merged)
      SELECT subject, object, predicate, state, 'source_span' AS evidence_kind, evidence_sentence AS locator, NULL::DOUBLE AS metric FROM m WHERE status <> 'proposed'
      UNION ALL SELECT subject, object, predicate, state, 'model_output', NULL, confidence::DOUBLE FROM m WHERE status <> 'grounded'""",
    "import_manifest_unique_names": """WITH n AS (SELECT p_partkey AS id, p_name || ' ' || p_brand || ' ' || p_type AS name FROM part), u AS (SELECT name, min(id) AS id FROM n GROUP BY name HAVING count(*) = 1)
      SELECT DISTINCT a.id AS subject, b.id AS object, l_returnflag AS origin FROM lineitem JOIN n x ON x.id = l_partkey JOIN n y ON y.id + 1 = l_partkey JOIN u a ON a.name = x.name JOIN u b ON b.name = y.name WHERE a.id <> b.id""",
    "import_reference_scope": """WITH p AS (SELECT DISTINCT l_orderkey AS citing, (l_partkey * 7) % 30000 AS cited FROM lineitem), k AS (SELECT DISTINCT citing AS w FROM p)
      SELECT CASE WHEN cited IN (SELECT w FROM k) THEN 'inside' ELSE 'outside' END AS scope, count(*) AS n, count(DISTINCT citing) AS works FROM p GROUP BY 1""",
    "import_statement_reasons": """WITH s AS (SELECT p_partkey AS id FROM part WHERE p_size < 40)
      SELECT CASE WHEN l_partkey NOT IN (SELECT id FROM s) THEN 'unknown_source' WHEN l_returnflag = 'A' THEN 'proof_excluded' WHEN l_suppkey NOT IN (SELECT id FROM s) THEN 'out_of_scope' ELSE 'imported' END AS reason, count(*) AS n FROM lineitem GROUP BY 1""",
    "entity_catalog": """SELECT 'judgment:' || c_custkey AS ref, 'judgment' AS kind, CASE WHEN c_custkey % 4 <> 0 THEN c_name ELSE c_custkey::VARCHAR END AS label, CASE WHEN c_custkey % 4 <> 0 THEN 'given' ELSE 'fallback' END AS origin FROM customer
      UNION ALL SELECT 'paper:' || s_suppkey, 'paper', s_name, 'given' FROM supplier UNION ALL SELECT 'concept:' || n_nationkey, 'concept', n_name, 'given' FROM nation""",
    "entity_backfill": "SELECT 'complete' AS try, count(*) AS resolved, sum(o_custkey % 10 + 1000)::BIGINT AS \"check\" FROM orders UNION ALL SELECT 'incomplete', 0, NULL",
    "ambiguous_keys": f"WITH {TABLES_SQL} SELECT legacy_ref, count(DISTINCT id) AS n FROM a GROUP BY legacy_ref HAVING count(DISTINCT id) > 1",
    "retract_cascade": f"""WITH {TABLES_SQL}, g AS (SELECT id FROM a WHERE subject = 7 OR object = 7), k AS (SELECT * FROM ev WHERE assertion_id NOT IN (SELECT id FROM g)), s AS (SELECT * FROM src WHERE id NOT IN (SELECT source_id FROM ev WHERE assertion_id IN (SELECT id FROM g)) OR id IN (SELECT source_id FROM k))
      SELECT 'assertions' AS "table", count(*) AS n, sum(id)::VARCHAR AS ids FROM a WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'evidence', count(*), sum(id)::VARCHAR FROM k UNION ALL SELECT 'reviews', count(*), sum(id)::VARCHAR FROM rv WHERE assertion_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'sources', count(*), sum(id)::VARCHAR FROM s""",
    "promote_review": f"WITH {TABLES_SQL} SELECT 9999999 + row_number() OVER (ORDER BY id) AS id, id AS supersedes_id, 'reviewed' AS state, 'reviewer_note' AS kind, 'accept' AS decision, 'rev1' AS reviewer FROM a WHERE state = 'extracted'",
    "export_gate": f"WITH {TABLES_SQL}, {_DEP} SELECT assertion_id, src, dst, 'default_traversal' AS policy, origin, 'written' AS side FROM dep WHERE assertion_id % 27 = 0 AND policy <> 'default_traversal' UNION ALL SELECT assertion_id, src, dst, policy, origin, 'derived' FROM dep WHERE assertion_id % 27 = 0 AND policy <> 'default_traversal'",
}
