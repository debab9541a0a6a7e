"""Evidence-first provenance: policies, reviews, imports, exports, reconciliation, integrity.

Tables: assertions (id, subject, object, subject_kind, object_kind, predicate,
state, release, legacy_ref, supersedes_id), evidence (id, assertion_id,
source_id, kind, locator, metric, classification), reviews (id, assertion_id,
decision, reviewer, authorization, decided_at, expires_at, release), sources
(id, provider, licence, attribution, content_hash).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import stages
from . import sinks

JUDGMENT, PAPER, CONCEPT = "judgment", "paper", "concept"
FACTUAL = ("depends_on", "cites", "imports")
SEMANTIC = ("specializes", "generalizes", "equivalent_to", "related_to", "uses_concept")
MORPHISMS = ("implies", "specializes", "generalizes", "equivalent_to")
STATES = ("proposed", "extracted", "observed", "reviewed", "verified", "rejected")


def traversal_policy(predicate: Column, state: Column) -> Column:
    """R-02: whether an assertion may be followed by default, by formal tools only, seen only, or not at all."""
    trusted = (predicate.isin(*FACTUAL) & state.isin("observed", "verified")) | (predicate.isin(*SEMANTIC) & state.isin("reviewed", "verified")) | ((predicate == "implies") & (state == "verified"))
    return F.when(state == "rejected", "excluded").when(trusted, "default_traversal").when((predicate == "implies") & (state == "reviewed"), "formal_only").otherwise("visible_only")


def valid_kinds(predicate: Column, subject: Column, object_: Column) -> Column:
    """R-01: whether a predicate may stand between two kinds of entities."""
    same = lambda k: (subject == k) & (object_ == k)
    return (
        F.when(predicate == "depends_on", same(JUDGMENT))
        .when(predicate == "cites", same(PAPER))
        .when(predicate.isin(*MORPHISMS), same(JUDGMENT) | same(CONCEPT))
        .when(predicate == "uses_concept", subject.isin(JUDGMENT, PAPER) & (object_ == CONCEPT))
        .otherwise(F.lit(True))
    )


def schema_violations(assertions: DataFrame) -> DataFrame:
    """R-01: assertions whose ends don't suit their predicate."""
    return assertions.filter(~valid_kinds(F.col("predicate"), F.col("subject_kind"), F.col("object_kind")))


def current(assertions: DataFrame) -> DataFrame:
    """Assertions that no other supersedes."""
    gone = assertions.filter("supersedes_id is not null").select(F.col("supersedes_id").alias("id")).distinct()
    return assertions.join(gone, "id", "left_anti")


# --- reviews -----------------------------------------------------------------


def effective_reviews(reviews: DataFrame) -> DataFrame:
    """W-02: the last decision of each assertion by (decided_at, id)."""
    last = reviews.groupBy("assertion_id").agg(F.max(F.struct("decided_at", "id", "decision")).alias("r"))
    return last.select("assertion_id", F.col("r.id").alias("review_id"), F.col("r.decision").alias("decision"), F.col("r.decided_at").alias("decided_at"))


def authenticated(now: Column, release: Column) -> Column:
    """R-10: whether a review is an accept by a known, authorised reviewer, in force, for this release."""
    given = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    in_force = F.col("expires_at").isNull() | (F.col("expires_at") > now)
    return F.col("decision").isin("accept", "supersede") & given("reviewer") & given("authorization") & in_force & F.coalesce(F.col("release") == release, F.lit(False))


def promote(assertions: DataFrame, reviews: DataFrame, evidence: DataFrame, chosen: DataFrame, first_id: int, decided_at: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """R-20: new rows for assertions, evidence and reviews that promote the chosen assertions (id, reviewer) to reviewed.

    The old assertions stay; the new ones name them in supersedes_id. Ids count
    up from ``first_id`` in the order of the old ids.
    """
    picked = assertions.join(chosen.select("id", "reviewer"), "id")
    numbered = sinks.numbered(picked, ["id"], "__n").withColumn("__new", F.lit(first_id) + F.col("__n"))
    new = numbered.select(*[F.col("__new").alias("id") if c == "id" else F.lit("reviewed").alias("state") if c == "state" else F.col("id").alias("supersedes_id") if c == "supersedes_id" else F.col(c) for c in assertions.columns])
    fill = {"id": F.col("__new"), "assertion_id": F.col("__new"), "kind": F.lit("reviewer_note"), "decision": F.lit("accept"), "reviewer": F.col("reviewer"), "decided_at": F.lit(decided_at), "release": F.col("release")}
    made = lambda like: numbered.select(*[(fill[c] if c in fill else F.lit(None)).cast(like.schema[c].dataType).alias(c) for c in like.columns])
    return new, made(evidence), made(reviews)


# --- imports -----------------------------------------------------------------


def import_edges(edges: DataFrame, existing: DataFrame, release: str) -> DataFrame:
    """R-03: new assertions (subject, object, predicate, state, legacy_ref, release) for typed edges (id, src, dst, kind, status).

    An edge that the release has already, by its reference, is left out, so a
    second import adds nothing.
    """
    name = F.when(F.col("kind") == "dependency", "depends_on").when(F.col("kind") == "citation", "cites").when(F.col("kind") == "implication", "implies").when(F.col("kind") == "specialization", "specializes").when(F.col("kind") == "generalization", "generalizes").otherwise("equivalent_to")
    state = F.when(F.col("kind") == "dependency", "extracted").when(F.col("kind") == "citation", "observed").when(F.col("status") == "rejected", "rejected").otherwise("proposed")
    rows = edges.select(F.col("src").alias("subject"), F.col("dst").alias("object"), name.alias("predicate"), state.alias("state"), F.concat_ws(":", "kind", "id").alias("legacy_ref"), F.lit(release).alias("release"))
    return rows.join(existing.select("legacy_ref", "release").distinct(), ["legacy_ref", "release"], "left_anti").select("subject", "object", "predicate", "state", "legacy_ref", "release")


def import_relations(relations: DataFrame) -> DataFrame:
    """R-04: (subject, object, predicate, state, evidence_kind, locator, metric): a row for each piece of evidence.

    A text gives a source span, a statistic a model output; a confirmed relation has both.
    """
    predicate = F.when(F.col("kind") == "specialization_of", "specializes").otherwise("equivalent_to")
    state = F.when(F.col("status") == "proposed", "proposed").otherwise("extracted")
    span = F.when(F.col("status") != "proposed", F.struct(F.lit("source_span").alias("evidence_kind"), F.col("evidence_sentence").alias("locator"), F.lit(None).cast("double").alias("metric")))
    model = F.when(F.col("status") != "grounded", F.struct(F.lit("model_output").alias("evidence_kind"), F.lit(None).cast("string").alias("locator"), F.col("confidence").cast("double").alias("metric")))
    return relations.select("subject", "object", predicate.alias("predicate"), state.alias("state"), F.explode(F.filter(F.array(span, model), lambda e: e.isNotNull())).alias("e")).select("subject", "object", "predicate", "state", "e.*")


def unique_names(judgments: DataFrame) -> DataFrame:
    """J-08: (name, id) of names that exactly one judgment has."""
    return judgments.filter("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n = 1").select("name", "id")


def import_manifest(dependencies: DataFrame, judgments: DataFrame) -> DataFrame:
    """R-05: (subject, object, origin) of named dependencies (name, needs, origin) whose both names are unique."""
    own = unique_names(judgments)
    return dependencies.join(own.toDF("name", "subject"), "name").join(own.toDF("needs", "object"), "needs").filter("subject <> object").select("subject", "object", "origin").distinct()


def import_references(works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R-06: (citing, cited) inside the snapshot, and outside it, of works (work, refs)."""
    pairs = works.select(F.col("work").alias("citing"), F.explode("refs").alias("cited")).distinct()
    known = works.select(F.col("work").alias("cited")).distinct()
    return pairs.join(known, "cited", "left_semi").select("citing", "cited"), pairs.join(known, "cited", "left_anti").select("citing", "cited")


def import_statements(statements: DataFrame, edges: DataFrame) -> DataFrame:
    """R-07: (reason, n): what becomes of external edges (src, dst, type): imported, proof edges, out of scope, unknown source."""
    known = statements.select("id").distinct()
    joined = edges.join(known.select(F.col("id").alias("src"), F.lit(True).alias("s")), "src", "left").join(known.select(F.col("id").alias("dst"), F.lit(True).alias("d")), "dst", "left")
    reason = F.when(F.col("s").isNull(), "unknown_source").when(F.col("type") == "proof", "proof_excluded").when(F.col("d").isNull(), "out_of_scope").otherwise("imported")
    return joined.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def catalog(*parts: tuple[DataFrame, str, str, str]) -> DataFrame:
    """R-08: (ref, kind, label, origin): entities of several tables (table, kind, id, label); the id names what has no label."""
    made = [df.select(F.concat(F.lit(f"{kind}:"), F.col(ident)).alias("ref"), F.lit(kind).alias("kind"), F.coalesce(F.col(label).cast("string"), F.col(ident).cast("string")).alias("label"), F.when(F.col(label).isNotNull(), "given").otherwise("fallback").alias("origin")) for df, kind, ident, label in parts]
    return reduce(DataFrame.union, made)


def backfill(assertions: DataFrame, refs: DataFrame) -> DataFrame:
    """R-09, J-05: assertions with entity ids for both ends, or unchanged with nulls if any end of any row is unknown.

    The guard is one aggregated row.
    """
    a, b = refs.select(F.col("ref").alias("subject"), F.col("entity").alias("subject_entity")), refs.select(F.col("ref").alias("object"), F.col("entity").alias("object_entity"))
    joined = assertions.join(a, "subject", "left").join(b, "object", "left")
    good = joined.agg((F.count_if(F.col("subject_entity").isNull() | F.col("object_entity").isNull()) == 0).alias("complete"))
    return joined.join(F.broadcast(good)).select(*assertions.columns, *[F.when(F.col("complete"), F.col(c)).alias(c) for c in ("subject_entity", "object_entity")])


# --- exports -----------------------------------------------------------------


def dependency_export(assertions: DataFrame, evidence: DataFrame) -> DataFrame:
    """R-11: (assertion_id, src, dst, policy, origin) of dependencies between judgments."""
    n = evidence.count()
    formal = stages.dealt(evidence.filter("kind = 'formal_export'").select(F.col("assertion_id").alias("id")), n, "id").distinct().withColumn("formal", F.lit(True))
    own = stages.dealt(assertions.filter(f"predicate = 'depends_on' and subject_kind = '{JUDGMENT}' and object_kind = '{JUDGMENT}'"), n, "id").join(formal, "id", "left")
    return own.select(F.col("id").alias("assertion_id"), F.col("subject").alias("src"), F.col("object").alias("dst"), traversal_policy(F.col("predicate"), F.col("state")).alias("policy"), F.when(F.coalesce("formal", F.lit(False)), "checker-derived").otherwise("text-extracted").alias("origin"))


def first_evidence(evidence: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The evidence row of least id of each assertion, of some kinds or any."""
    rows = evidence.filter(F.col("kind").isin(*kinds)) if kinds else evidence
    return rows.groupBy("assertion_id").agg(F.min_by(F.struct(*[c for c in evidence.columns if c != "assertion_id"]), "id").alias("e")).select("assertion_id", "e.*")


def morphism_export(assertions: DataFrame, evidence: DataFrame, reviews: DataFrame) -> DataFrame:
    """R-12: (id, src, dst, kind, origin, status, rationale, policy); accepted if any review accepts."""
    note = first_evidence(evidence, ("reviewer_note", "model_output")).select(F.col("assertion_id").alias("id"), F.col("kind").alias("note"), "locator")
    accepted = reviews.groupBy(F.col("assertion_id").alias("id")).agg(F.bool_or(F.col("decision") == "accept").alias("accepted"))
    own = assertions.filter(F.col("predicate").isin(*MORPHISMS) & (F.col("subject_kind") == JUDGMENT) & (F.col("object_kind") == JUDGMENT)).join(note, "id", "left").join(accepted, "id", "left")
    status = F.when(F.col("state") == "rejected", "rejected").when(F.coalesce("accepted", F.lit(False)), "accepted").otherwise("proposed")
    return own.select("id", F.col("subject").alias("src"), F.col("object").alias("dst"), F.col("predicate").alias("kind"), F.when(F.col("note") == "reviewer_note", "manual").otherwise("heuristic").alias("origin"), status.alias("status"), F.col("locator").alias("rationale"), traversal_policy(F.col("predicate"), F.col("state")).alias("policy"))


def relation_export(assertions: DataFrame, evidence: DataFrame) -> DataFrame:
    """R-13: (assertion_id, subject, object, kind, status, confidence, sentence, policy) of grounded concept relations, in their order."""
    ground = first_evidence(evidence, ("source_span", "reviewer_note")).select(F.col("assertion_id").alias("id"), F.col("kind").alias("ground"), "locator")
    model = first_evidence(evidence, ("model_output",)).select(F.col("assertion_id").alias("id"), "metric", F.lit(True).alias("model"))
    own = assertions.filter((F.col("subject_kind") == CONCEPT) & (F.col("object_kind") == CONCEPT)).join(ground, "id").join(model, "id", "left")
    status = F.when(F.col("ground") == "reviewer_note", "reviewed").when(F.col("model"), "confirmed").otherwise("grounded")
    rows = own.select(F.col("id").alias("assertion_id"), "subject", "object", F.col("predicate").alias("kind"), status.alias("status"), F.col("metric").alias("confidence"), F.coalesce("locator", F.lit("")).alias("sentence"), traversal_policy(F.col("predicate"), F.col("state")).alias("policy"))
    rank = F.when(F.col("status") == "reviewed", 0).when(F.col("status") == "confirmed", 1).otherwise(2)
    return rows.orderBy(rank, F.desc_nulls_last("confidence"), "subject", "assertion_id")


def discovery_source(evidence: DataFrame) -> DataFrame:
    """R-21: (assertion_id, source) from each assertion's first evidence."""
    first = first_evidence(evidence)
    source = F.when(F.col("classification") == "external_literal_dependency", "external_literal").when(F.col("classification") == "external_structural_candidate", "external_structural").when(F.col("kind") == "formal_export", "checker").otherwise("text")
    return first.select("assertion_id", source.alias("source"))


def project_counts(sourced: DataFrame) -> DataFrame:
    """A-23: (project, literal, structural, total) of external edges (project, source), the largest first."""
    n = lambda s: F.count_if(F.col("source") == s)
    counts = sourced.filter(F.col("source").startswith("external")).groupBy("project").agg(n("external_literal").alias("literal"), n("external_structural").alias("structural"), F.count(F.lit(1)).alias("total"))
    return counts.orderBy(F.desc("total"), "project")


def assertion_details(assertions: DataFrame, evidence: DataFrame, reviews: DataFrame) -> DataFrame:
    """K-16, R-14: each assertion with its ordered evidence and reviews nested, and its policy."""
    ev = evidence.groupBy(F.col("assertion_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*["id", *[c for c in evidence.columns if c not in ("id", "assertion_id")]]))).alias("evidence"))
    rv = reviews.groupBy(F.col("assertion_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("decided_at", "id", "decision"))).alias("reviews"))
    return assertions.join(ev, "id", "left").join(rv, "id", "left").withColumn("policy", traversal_policy(F.col("predicate"), F.col("state")))


def source_kind_label(kind: Column) -> Column:
    """R-14: a reader's name for a kind of evidence."""
    return F.when(kind == "formal_export", "checked by a proof assistant").when(kind == "source_span", "stated in a text").when(kind == "model_output", "computed by a model").otherwise("noted by a reviewer")


# --- reconciliation and integrity --------------------------------------------


def reconcile(shown: DataFrame, assertions: DataFrame) -> DataFrame:
    """R-15: (group, total, traced) of displayed edges (group, legacy_ref) that have an assertion."""
    known = assertions.select("legacy_ref").distinct().withColumn("hit", F.lit(1))
    return shown.join(known, "legacy_ref", "left").groupBy("group").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("traced"))


def set_compare(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """A-22, O-08: (side, n): keys in both, in the first only, in the second only."""
    x, y = a.select(on).distinct().withColumn("a", F.lit(True)), b.select(on).distinct().withColumn("b", F.lit(True))
    side = F.when(F.col("a").isNull(), "second_only").when(F.col("b").isNull(), "first_only").otherwise("both")
    return x.join(y, on, "full").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def violations(assertions: DataFrame, evidence: DataFrame, reviews: DataFrame, sources: DataFrame) -> DataFrame:
    """R-16, R-18, R-19: (check, detail): one row for each fault; none means that the release may go out."""
    fault = lambda df, name, detail: df.select(F.lit(name).alias("check"), F.col(detail).cast("string").alias("detail"))
    empty = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    trusted = assertions.filter(traversal_policy(F.col("predicate"), F.col("state")) == "default_traversal")
    strong = evidence.filter(F.col("kind").isin("formal_export", "source_span", "reviewer_note")).select(F.col("assertion_id").alias("id"))
    # both sides of a join are dealt alike, to partitions of bounded size; few sources are unknown, so these are looked for first
    n_a, n_e, n_r = assertions.count(), evidence.count(), reviews.count()
    lacks = lambda df, key, other, of, n: stages.dealt(df.select("id", key) if key != "id" else df.select("id"), n, key).join(stages.dealt(other.select(F.col(of).alias(key)), n, key), key, "left_anti")
    unknown = stages.written(evidence.select("source_id").distinct().join(sources.select(F.col("id").alias("source_id")), "source_id", "left_anti").withColumnRenamed("source_id", "s"), "unknown-sources")
    keys = stages.dealt(assertions.filter("legacy_ref is not null").select("release", "legacy_ref", "id"), n_a, "release", "legacy_ref").groupBy("release", "legacy_ref").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    parts = [
        fault(schema_violations(assertions), "kinds_do_not_suit_predicate", "id"),
        fault(lacks(assertions, "id", evidence, "assertion_id", max(n_a, n_e)), "no_evidence", "id"),
        fault(lacks(evidence, "assertion_id", assertions, "id", max(n_a, n_e)), "evidence_without_assertion", "id"),
        fault(lacks(reviews, "assertion_id", assertions, "id", max(n_a, n_r)), "review_without_assertion", "id"),
        fault(evidence.join(unknown, F.col("source_id").eqNullSafe(F.col("s")), "left_semi"), "evidence_without_source", "id"),
        fault(lacks(trusted, "id", strong, "id", max(n_a, n_e)), "trusted_without_qualifying_evidence", "id"),
        fault(assertions.filter(~F.col("state").isin(*STATES)), "unknown_state", "id"),
        fault(assertions.filter("subject = object and predicate <> 'equivalent_to'"), "relates_to_itself", "id"),
        fault(keys.filter("a <> b"), "ambiguous_key", "legacy_ref"),
        fault(lacks(assertions.filter("supersedes_id is not null"), "supersedes_id", assertions, "id", n_a), "supersedes_unknown", "id"),
        fault(sources.filter(empty("licence")), "no_licence", "id"),
        fault(sources.filter(empty("attribution")), "no_attribution", "id"),
        fault(sources.filter(~F.coalesce(F.col("content_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))), "bad_content_hash", "id"),
    ]
    return reduce(DataFrame.union, parts)


def release_violations(manifest: DataFrame, releases: DataFrame, sidecars: DataFrame, told: DataFrame, counts: DataFrame, recorded: DataFrame, live: DataFrame, mapping_version: str) -> DataFrame:
    """R-16: (check, detail): faults of a manifest, a row of (release_tag, release_id, git_commit, mapping_version).

    It is held against ``releases`` (id, tag, git_commit), the ``sidecars``
    (name, release_tag), the counts it tells and those found (kind, n), and the
    input files it recorded and those that are there (name, sha256).
    """
    fault = lambda df, name, detail: df.select(F.lit(name).alias("check"), F.col(detail).cast("string").alias("detail"))
    known = manifest.join(releases.withColumnsRenamed({"tag": "release_tag", "git_commit": "commit"}), "release_tag")
    files = live.join(recorded.withColumnRenamed("sha256", "was"), "name", "left")
    own = told.withColumnRenamed("n", "told").join(counts.withColumnRenamed("n", "found"), "kind", "full")
    return reduce(DataFrame.union, [
        fault(manifest.filter((F.col("mapping_version") != "") & (F.col("mapping_version") != mapping_version)), "source_mapping_policy_mismatch", "mapping_version"),
        fault(manifest.join(releases.select(F.col("tag").alias("release_tag")), "release_tag", "left_anti"), "manifest_release_not_found", "release_tag"),
        fault(known.filter("id <> release_id"), "manifest_release_id_mismatch", "release_tag"),
        fault(known.filter(~F.col("git_commit").eqNullSafe(F.col("commit"))), "manifest_release_commit_mismatch", "release_tag"),
        fault(sidecars.join(manifest.select("release_tag"), "release_tag", "left_anti"), "sidecar_release_mismatch", "name"),
        fault(files.filter("was is null"), "input_file_not_in_manifest", "name"),
        fault(files.filter("was <> sha256"), "input_file_hash_mismatch", "name"),
        fault(own.filter(~F.coalesce("told", F.lit(0)).eqNullSafe(F.coalesce("found", F.lit(0)))), "counts_mismatch", "kind"),
    ])


def catalog_violations(assertions: DataFrame, refs: DataFrame, told: DataFrame, found: DataFrame) -> DataFrame:
    """R-16: (check, detail): ends of assertions (id, subject, object, subject_entity, object_entity) that the catalogue (ref, entity) doesn't know or names otherwise, and catalogue metadata (field, value) that a manifest tells otherwise."""
    a, b = refs.select(F.col("ref").alias("subject"), F.col("entity").alias("s")), refs.select(F.col("ref").alias("object"), F.col("entity").alias("o"))
    joined = assertions.join(a, "subject", "left").join(b, "object", "left")
    fault = lambda df, name: df.select(F.lit(name).alias("check"), F.col("id").cast("string").alias("detail"))
    drift = joined.filter((F.col("s").isNotNull() & ~F.col("s").eqNullSafe(F.col("subject_entity"))) | (F.col("o").isNotNull() & ~F.col("o").eqNullSafe(F.col("object_entity"))))
    other = told.join(found.withColumnRenamed("value", "live"), "field", "left").filter(~F.col("value").eqNullSafe(F.col("live")))
    return fault(joined.filter("s is null or o is null"), "unresolved_entity_reference").union(fault(drift, "entity_endpoint_drift")).union(other.select(F.lit("catalog_metadata_mismatch"), "field"))


def formal_violations(evidence: DataFrame, sources: DataFrame, policy_version: str) -> DataFrame:
    """R-16, R-19: (check, detail): formal evidence whose source's reproducibility record (a JSON text) is absent, incomplete or of another filter policy."""
    own = evidence.filter("kind = 'formal_export'").join(sources.select(F.col("id").alias("source_id"), "reproducibility"), "source_id", "left")
    field = lambda k: F.coalesce(F.trim(F.get_json_object("reproducibility", f"$.{k}")), F.lit(""))
    lacking = F.lit(False)
    for k in REPRODUCIBLE:
        lacking = lacking | (field(k) == "")
    other = (field("filteringPolicyVersion") != "") & (field("filteringPolicyVersion") != policy_version)
    made = lambda df, name: df.select(F.lit(name).alias("check"), F.col("id").cast("string").alias("detail"))
    return made(own.filter(lacking), "formal_evidence_missing_reproducibility_metadata").union(made(own.filter(other), "filter_policy_mismatch"))


#: What a record of formal evidence has to name.
REPRODUCIBLE = ("leanToolchain", "mathlibRev", "extractorVersion", "filteringPolicyVersion", "rawSha256", "normalizedSha256")


def output_violations(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """R-17: (check, detail): exported files (name, sha256) that are missing, changed, or not in the manifest."""
    both = recorded.withColumnRenamed("sha256", "was").join(live.withColumnRenamed("sha256", "now"), "name", "full")
    check = F.when(F.col("now").isNull(), "export_file_missing").when(F.col("was").isNull(), "output_file_not_in_manifest").when(F.col("was") != F.col("now"), "output_hash_mismatch")
    return both.select(check.alias("check"), F.col("name").alias("detail")).filter("check is not null")


def export_differences(written: DataFrame, derived: DataFrame) -> DataFrame:
    """R-17: rows that only the written export or only the new derivation has, duplicates counted.

    Both are written once; equal rows meet in partitions of bounded size, and
    what one side has more of stands as often in the result.
    """
    columns = written.columns
    both = stages.written(written.withColumn("__n", F.lit(1)).union(derived.withColumn("__n", F.lit(-1))), "export-rows")
    more = stages.dealt(both, both.count(), *columns).groupBy(*columns).agg(F.sum("__n").alias("__n")).filter("__n <> 0")
    return more.withColumn("__k", F.explode(F.sequence(F.lit(1), F.abs("__n").cast("int")))).select(*columns, F.when(F.col("__n") > 0, "written").otherwise("derived").alias("side"))


def ambiguous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """O-10: (key, n) of keys with several values."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.countDistinct(value).alias("n")).filter("n > 1")


def retract(entity: int, assertions: DataFrame, evidence: DataFrame, reviews: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """K-19: the four tables without the assertions that touch an entity, what hangs on these, and sources left without evidence."""
    gone = assertions.filter((F.col("subject") == entity) | (F.col("object") == entity)).select(F.col("id").alias("assertion_id"))
    kept = evidence.join(gone, "assertion_id", "left_anti")
    lost = evidence.join(gone, "assertion_id", "left_semi").select(F.col("source_id").alias("id")).distinct().join(kept.select(F.col("source_id").alias("id")), "id", "left_anti")
    return assertions.join(gone.withColumnRenamed("assertion_id", "id"), "id", "left_anti"), kept, reviews.join(gone, "assertion_id", "left_anti"), sources.join(lost, "id", "left_anti")
