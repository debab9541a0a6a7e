"""Co-occurrence of items in groups, and the relations read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import dealt, written


def incidence(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Distinct (g, x) of a fact table, whole groups in partitions of bounded size, so that a join on the group needs no other shuffle."""
    own = rows.select(F.col(group).alias("g"), F.col(item).alias("x")).filter("g is not null and x is not null")
    return dealt(own, rows.count(), "g").distinct()


def pairs(incident: DataFrame, min_count: int = 1) -> DataFrame:
    """J-12, A-08: (i, j, n), i < j: how many groups hold both.

    The join is on the group; its cost is the sum of squared group sizes, so
    the groups are meant to be documents, not stop words. The pairs are
    counted first, by the sizes of the groups, and dealt to as many
    partitions as they need.
    """
    size = F.count(F.lit(1))
    met = incident.groupBy("g").agg((size * (size - 1) / 2).alias("n")).agg(F.sum("n")).first()[0] or 0
    left, right = incident.withColumnRenamed("x", "i"), incident.withColumnRenamed("x", "j")
    return dealt(left.join(right, "g").filter("i < j").select("i", "j"), met, "i", "j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def jaccard(counts: DataFrame, incident: DataFrame) -> DataFrame:
    """A-10: (i, j, n, jaccard)."""
    size = incident.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    joined = counts.join(size.withColumnsRenamed({"x": "i", "df": "di"}), "i").join(size.withColumnsRenamed({"x": "j", "df": "dj"}), "j")
    return joined.select("i", "j", "n", (F.col("n") / (F.col("di") + F.col("dj") - F.col("n"))).alias("jaccard"))


def ppmi(counts: DataFrame, alpha: float = 0.75) -> DataFrame:
    """A-09: (i, j, w): positive pointwise mutual information with smoothed contexts.

    Row sums and the total are over the surviving pairs, each counted from
    both of its ends. The counts are written once and read four times.
    """
    counts = written(counts.select("i", "j", "n"), "pair-counts")
    rows = counts.select(F.col("i").alias("x"), "n").union(counts.select("j", "n")).groupBy("x").agg(F.sum("n").alias("r"))
    rows = rows.withColumn("q", F.pow("r", F.lit(alpha)))
    sums = rows.agg(F.sum("r").alias("total"), F.sum("q").alias("mass"))
    p = rows.join(F.broadcast(sums)).select("x", (F.col("q") / F.col("mass")).alias("p"), "total")
    joined = counts.join(p.withColumnsRenamed({"x": "i", "p": "pi"}), "i").join(p.select(F.col("x").alias("j"), F.col("p").alias("pj")), "j")
    weighed = joined.select("i", "j", F.log(F.col("n") / F.col("total") / (F.col("pi") * F.col("pj"))).alias("w"))
    return weighed.filter("w > 0")


def symmetric(weights: DataFrame) -> DataFrame:
    """(u, k, w) from both ends of (i, j, w)."""
    return weights.select(F.col("i").alias("u"), F.col("j").alias("k"), "w").union(weights.select("j", "i", "w"))


def inclusion(adjacent: DataFrame, candidates: DataFrame) -> DataFrame:
    """V-06: (i, j, p_ij, p_ji): the share of each one's weights on features that both have, for the pairs (i, j)."""
    total = adjacent.groupBy("u").agg(F.sum("w").alias("t"))
    left = candidates.select("i", "j").join(adjacent.select(F.col("u").alias("i"), "k", F.col("w").alias("wi")), "i")
    both = left.join(adjacent.select(F.col("u").alias("j"), "k", F.col("w").alias("wj")), ["j", "k"])
    shared = both.groupBy("i", "j").agg(F.sum("wi").alias("si"), F.sum("wj").alias("sj"))
    out = candidates.select("i", "j").join(shared, ["i", "j"], "left").join(total.withColumnsRenamed({"u": "i", "t": "ti"}), "i", "left").join(total.withColumnsRenamed({"u": "j", "t": "tj"}), "j", "left")
    share = lambda s, t: F.coalesce(F.col(s) / F.col(t), F.lit(0.0))
    return out.select("i", "j", share("si", "ti").alias("p_ij"), share("sj", "tj").alias("p_ji"))


def inv_cl(p: Column, q: Column) -> Column:
    """V-07: how much the one includes the other and is not included by it."""
    return F.sqrt(F.greatest(F.lit(0.0), p * (1 - q)))


def classify(included: DataFrame, equivalent: float = 0.85, special: float = 0.35, margin: float = 0.12) -> DataFrame:
    """V-08: (subject, object, kind, confidence) of the pairs that have a relation; the subject is the narrower."""
    c = included.withColumns({"a": inv_cl(F.col("p_ij"), F.col("p_ji")), "b": inv_cl(F.col("p_ji"), F.col("p_ij"))})
    same = (F.col("p_ij") >= equivalent) & (F.col("p_ji") >= equivalent)
    down = (F.col("a") >= special) & (F.col("a") - F.col("b") >= margin)
    up = (F.col("b") >= special) & (F.col("b") - F.col("a") >= margin)
    kind = F.when(same, "equivalent_to").when(down | up, "specialization_of")
    turned = ~same & ~down & up
    return c.withColumn("kind", kind).filter("kind is not null").select(
        F.when(turned, F.col("j")).otherwise(F.col("i")).alias("subject"),
        F.when(turned, F.col("i")).otherwise(F.col("j")).alias("object"),
        "kind",
        F.when(same, F.least("p_ij", "p_ji")).when(down, F.col("a")).otherwise(F.col("b")).alias("confidence"),
    )


def merge_relations(statistical: DataFrame, textual: DataFrame) -> DataFrame:
    """O-06: both sources by (subject, object, kind): confirmed if both have it, grounded from text only, else proposed.

    ``textual`` also has sentence and doc; of several hits the first by (doc, sentence) is the evidence.
    """
    key = ["subject", "object", "kind"]
    best = textual.groupBy(*key).agg(F.min(F.struct("doc", "sentence")).alias("e"))
    joined = statistical.select(*key, "confidence").join(best, key, "full")
    status = F.when(F.col("e").isNull(), "proposed").when(F.col("confidence").isNull(), "grounded").otherwise("confirmed")
    return joined.select(*key, status.alias("status"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.col("e.sentence").alias("evidence_sentence"), F.col("e.doc").alias("evidence_doc"))


def without_contradictions(relations: DataFrame, kind: str = "specialization_of") -> DataFrame:
    """O-07: without the specialisations that stand in both directions."""
    back = relations.filter(F.col("kind") == kind).select(F.col("object").alias("subject"), F.col("subject").alias("object"), "kind").distinct()
    return relations.join(back, ["subject", "object", "kind"], "left_anti")


def rank_relations(relations: DataFrame) -> DataFrame:
    """O-03, K-14: rows with their position: reviewed, confirmed, grounded; then by confidence and subject."""
    order = F.when(F.col("status") == "reviewed", 0).when(F.col("status") == "confirmed", 1).when(F.col("status") == "grounded", 2).otherwise(3)
    return relations.withColumn("status_rank", order).orderBy("status_rank", F.desc("confidence"), "subject", "object")


def last_per(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """W-02, K-01: the last row of each key under a total order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")
