"""Writes as table rewrites: upserts, interning, pruning, nested exports, manifests.

Spark files are immutable, so a mutation is a new version of a table: made,
written beside the old one, and then made current by ``publish``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.stages import remove, written


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """K-01, K-03: the newest row of each key over both tables; columns in ``keep`` stay as in the oldest.

    One shuffle on the key; a row of the new table wins a tie.
    """
    both = old.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c not in ("__side", *key)]
    order = F.struct(F.col(version), F.col("__side"))
    picked = both.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("r"), *[F.min_by(c, order).alias(f"__{c}") for c in keep])
    return picked.select(*key, *[F.col(f"__{c}" if c in keep else f"r.{c}").alias(c) for c in columns])


def prune(rows: DataFrame, key: str, valid: DataFrame) -> DataFrame:
    """K-04: the rows whose key is still in use."""
    return rows.join(valid.select(key).distinct(), key, "left_semi")


def intern(values: DataFrame, known: DataFrame, key: list[str], ident: str = "id") -> DataFrame:
    """K-05: ``known`` (id, key) with an id for each new key; null parts of a key are equal.

    Ids count on from the greatest known one in the order of the keys.
    """
    fresh = values.select(key).distinct()
    met = fresh.alias("n").join(known.alias("o"), _same(key), "left_anti")
    top = known.agg(F.coalesce(F.max(ident), F.lit(0)).alias("__top"))
    added = numbered(met, key, "__n").join(F.broadcast(top)).select((F.col("__top") + F.col("__n") + 1).cast(known.schema[ident].dataType).alias(ident), *key)
    return known.select(ident, *key).union(added)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their number from 0 on in an order, nulls first.

    Each task numbers its own range; the sizes of the ranges, one row for each
    partition, give where it starts.
    """
    by = [F.asc_nulls_first(c) for c in order]
    ranged = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*by)) - 1
    return ranged.withColumn("__n", within).join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__n")).select(*rows.columns, name)


def _same(key: list[str]) -> Column:
    out = F.lit(True)
    for c in key:
        out = out & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    return out


def insert_or_ignore(old: DataFrame, new: DataFrame) -> DataFrame:
    """K-07: the union of two edge sets."""
    return old.unionByName(new).distinct()


#: The file that names a published table's version.
POINTER = "CURRENT"


def _versions(spark: SparkSession, path: str) -> list[str]:
    """The current version of a published table and the one before it, as far as there are any."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    if not file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file):
        return []
    return [r.value for r in spark.read.text(f"{path}/{POINTER}").collect()]


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The table last published at ``path``, or none."""
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/{found[0]}") if found else None


def point(spark: SparkSession, path: str, versions: list[str]) -> None:
    """Make a version current: one file is written and moved over the pointer in one step."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    made, target = (jvm.org.apache.hadoop.fs.Path(f"{path}/{x}") for x in (f"{POINTER}-{uuid.uuid4().hex}", POINTER))
    out = made.getFileSystem(conf).create(made)
    out.write(bytearray("\n".join(versions), "utf-8"))
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), conf).rename(made, target, how)


def publish(df: DataFrame, path: str) -> str:
    """K-02, K-20: replace the table at ``path`` whole.

    Each version is a folder; readers follow the pointer, which names a whole
    version at any time. A failure before the pointer moves leaves the old
    version current. The version before the current one stays for readers that
    have begun; older ones go.
    """
    spark = df.sparkSession
    before = _versions(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    point(spark, path, [version, *before[:1]])
    for old in before[1:]:
        remove(spark, f"{path}/{old}")
    return path


def graph_export(judgments: DataFrame, papers: DataFrame, citations: DataFrame) -> DataFrame:
    """K-08: (paper, judgment_count, cites, judgments) nested: a row for each paper."""
    own = judgments.groupBy("paper").agg(F.count(F.lit(1)).alias("judgment_count"), F.array_sort(F.collect_list(F.struct("id", "name"))).alias("judgments"))
    cites = citations.groupBy(F.col("src").alias("paper")).agg(F.array_sort(F.collect_set("dst")).alias("cites"))
    return papers.select("paper").join(own, "paper", "left").join(cites, "paper", "left").select("paper", F.coalesce("judgment_count", F.lit(0)).alias("judgment_count"), F.coalesce("cites", F.array()).alias("cites"), "judgments")


def taxonomy_export(members: DataFrame) -> DataFrame:
    """K-09: (field, clusters) of members (field, cluster, phrase, doc_freq), nested and ordered."""
    clusters = members.groupBy("field", "cluster").agg(F.sum("doc_freq").alias("weight"), F.array_sort(F.collect_list(F.struct((-F.col("doc_freq")).alias("order"), "phrase"))).alias("m"))
    made = F.struct((-F.col("weight")).alias("order"), F.col("cluster"), F.transform("m", lambda x: x["phrase"]).alias("phrases"))
    return clusters.groupBy("field").agg(F.array_sort(F.collect_list(made)).alias("clusters"))


def head_shard(entries: DataFrame, size: int = 800) -> DataFrame:
    """K-10: the entries of most documents."""
    return entries.orderBy(F.desc("doc_freq"), "entry").limit(size)


def related_export(neighbours: DataFrame) -> DataFrame:
    """K-11, V-14: (source, related): neighbours (source, target, score) nested, best first, scores to three places."""
    item = F.struct((-F.col("score")).alias("order"), F.col("target"), F.round("score", 3).alias("score"))
    return neighbours.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["target"].alias("target"), x["score"].alias("score"))).alias("related"))


def papers_export(links: DataFrame, titles: DataFrame, most: int = 12) -> DataFrame:
    """K-12: (concept, paper, rank): a concept's papers: title has the concept, then papers of few concepts, then id.

    Only papers that appear are listed, so a dictionary of them is a distinct of the result.
    """
    many = links.groupBy("paper").agg(F.count(F.lit(1)).alias("n"))
    joined = links.join(many, "paper").join(titles, "paper")
    order = Window.partitionBy("concept").orderBy(F.desc(F.contains(F.lower("title"), F.lower("concept"))), "n", "paper")
    return joined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("concept", "paper", "rank")


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """K-18: (path, bytes, sha256) of files, by any store that Spark reads."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def json_lines(df: DataFrame) -> DataFrame:
    """K-08, K-15..K-17: each row as one JSON text, ready for a text writer."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
