"""From documents to a published taxonomy: candidates, vectors, graph, clusters, relations, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import clusters, cooccurrence, hearst, keyphrases, provenance, search, sinks, vectors
from .plans.stages import written

TABLES = ("concepts", "links", "vectors", "edges", "clusters", "relations", "taxonomy", "related")


def concepts(docs: DataFrame, labels: DataFrame, min_docs: int = 3) -> tuple[DataFrame, DataFrame]:
    """(concepts, links) of documents (doc, text) and labels (doc, label): (id, phrase, key, doc_freq) and (doc, id).

    Variants of a phrase are one concept, named by the most frequent of them;
    phrases of no field and stock phrases are left out.
    """
    scored = written(keyphrases.rake_scores(docs, "doc", "text"), "scored")
    found = keyphrases.accumulate(scored, min_docs)
    known = scored.join(found.select("phrase"), "phrase", "left_semi").select("doc", "phrase")
    spread = keyphrases.field_concentration(known, labels, keyphrases.field_prior(labels, "doc", "label"))
    judged = found.join(spread.select("phrase", "concentration"), "phrase", "left")
    kept = judged.join(keyphrases.boilerplate(judged).select("phrase"), "phrase", "left_anti").withColumn("key", T.canonical_key(F.col("phrase")))
    named = cooccurrence.last_per(kept, ["key"], [F.desc("doc_freq"), F.length("phrase"), F.col("phrase")]).select("key", F.col("phrase").alias("name"))
    ids = sinks.intern(named.select("name"), docs.sparkSession.createDataFrame([], "id long, name string"), ["name"])
    of = written(named.join(ids, "name").join(kept.select("key", "phrase"), "key").select("id", "name", "key", "phrase"), "concept-variants")
    links = known.join(of, "phrase").select("doc", "id").distinct()
    counted = links.groupBy("id").agg(F.count(F.lit(1)).alias("doc_freq"))
    return of.select("id", "name", "key").distinct().join(counted, "id").select("id", F.col("name").alias("phrase"), "key", "doc_freq"), links


def build(docs: DataFrame, labels: DataFrame, out: str, codes: DataFrame | None = None, min_docs: int = 3, dim: int = 16, neighbours: int = 8, least: float = 0.35, resolution: float = 0.1) -> dict[str, DataFrame]:
    """Run all stages and publish a table for each name of ``TABLES`` under ``out``.

    ``codes``: (position, code, name) of a subject classification, if there is one.
    """
    spark = docs.sparkSession

    def published(name: str, df: DataFrame) -> DataFrame:
        sinks.publish(df, f"{out}/{name}")
        return sinks.published(spark, f"{out}/{name}")

    found, links = concepts(docs, labels, min_docs)
    found, links = published("concepts", found), published("links", links)
    held = links.select(F.col("doc").alias("g"), F.col("id").alias("x"))
    weights = written(cooccurrence.ppmi(cooccurrence.pairs(held, 2)), "ppmi")
    space = published("vectors", vectors.spectral(cooccurrence.symmetric(weights), dim).select(F.col("u").alias("node"), "vector"))
    near = vectors.top_k(vectors.similar_pairs(space, "node", "vector", least, dim), neighbours)
    grounded = keyphrases.ground(found.select("phrase", F.col("id").alias("node")), codes) if codes is not None else found.select(F.col("id").alias("node"), F.lit(None).cast("string").alias("code"))
    coded = grounded.select("node", "code", F.substring("code", 1, 3).alias("section"), F.substring("code", 1, 2).alias("top"))
    edges = published("edges", clusters.concept_graph(space, vectors.mutual(near), held, coded))
    grouped = published("clusters", clusters.detect(edges.withColumnRenamed("weight", "w"), "cpm", resolution))

    name = found.select("id", "phrase")
    inside = cooccurrence.classify(cooccurrence.inclusion(cooccurrence.symmetric(weights), weights))
    statistical = inside.join(name.toDF("subject", "s"), "subject").join(name.toDF("object", "o"), "object").select(F.col("s").alias("subject"), F.col("o").alias("object"), "kind", "confidence")
    textual = hearst.hits(docs, "doc", "text", found.select("phrase"))
    published("relations", cooccurrence.without_contradictions(cooccurrence.merge_relations(statistical, textual)))
    members = grouped.join(found, grouped["node"] == found["id"]).select(F.lit("all").alias("field"), F.col("community").alias("cluster"), "phrase", "doc_freq")
    published("taxonomy", sinks.json_lines(sinks.taxonomy_export(members)))
    published("related", near.select(F.col("i").alias("source"), F.col("j").alias("target"), F.col("sim").alias("score")))
    return {t: sinks.published(spark, f"{out}/{t}") for t in TABLES}


def entries(spark: SparkSession, out: str) -> DataFrame:
    """The published concepts as entries of a search: (entry, phrase, doc_freq, cluster)."""
    own, groups = sinks.published(spark, f"{out}/concepts"), sinks.published(spark, f"{out}/clusters")
    return own.join(groups.withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias("entry"), "phrase", "doc_freq", F.col("community").alias("cluster"))


def find(spark: SparkSession, out: str, queries: list[str], top_k: int = 5) -> DataFrame:
    """(query, tier, rank, phrase, score): the published concepts that queries find."""
    asked = spark.createDataFrame(list(enumerate(queries)), "qid int, query string")
    own = entries(spark, out)
    hits = search.tiered(asked, own, top_k, sinks.published(spark, f"{out}/related"))
    return hits.join(own.select("entry", "phrase"), "entry").join(asked, "qid").select("query", "tier", "rank", "phrase", "score")


def provenance_of(spark: SparkSession, out: str, release: str) -> tuple[DataFrame, DataFrame]:
    """(assertions, evidence) of the published relations for a release; each row of evidence names its assertion."""
    made = provenance.import_relations(sinks.published(spark, f"{out}/relations"))
    own = made.select("subject", "object", "predicate", "state").distinct()
    ids = sinks.intern(own, spark.createDataFrame([], f"id long, {', '.join(f'{c} string' for c in own.columns)}"), own.columns)
    assertions = ids.select("id", "subject", "object", F.lit(provenance.CONCEPT).alias("subject_kind"), F.lit(provenance.CONCEPT).alias("object_kind"), "predicate", "state", F.lit(release).alias("release"), F.concat(F.lit("relation:"), "id").alias("legacy_ref"), F.lit(None).cast("long").alias("supersedes_id"))
    number = F.row_number().over(Window.partitionBy("id").orderBy("evidence_kind"))
    evidence = made.join(ids, own.columns).select((F.col("id") * 10 + number).alias("evidence_id"), F.col("id").alias("assertion_id"), F.col("evidence_kind").alias("kind"), "locator", "metric")
    return assertions, evidence.withColumnRenamed("evidence_id", "id")
