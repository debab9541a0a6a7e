"""Readers of harvests, code lists, manifests and snapshots, each with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

RECORD = "header struct<identifier: string>, metadata struct<arXivRaw: struct<id: string, title: string, authors: string, categories: string, `msc-class`: string, abstract: string, version: array<struct<date: string>>>>"
MANIFEST = "project string, leanToolchain string, mathlibRev string, entryModule string, extractorVersion string, filteringPolicyVersion string, totalDeclarations bigint, declarations array<struct<name: string, qualifiedName: string, module: string, rawConstants: array<string>, publishedDependencies: array<struct<name: string, origin: string>>, filteredOutCount: bigint>>"
STATEMENTS = "statementId string, declName string, module string, kind string, filePath string, isInstance boolean, repoSlug string, leanToolchain string, mathlibRev string, gitCommit string, classification string"
EDGES = "srcId string, depId string, edgeType string, role string, viaProj boolean"
WORKS = "arxiv_id string, work_id string, doi string, title string, referenced_work_ids array<string>, retrieved_at_unix bigint"


def papers(spark: SparkSession, path: str) -> DataFrame:
    """S-01, S-03, S-04: papers of saved harvest pages, without records that have no id.

    The first version's date is when a paper was submitted.
    """
    raw = spark.read.format("xml").option("rowTag", "record").schema(RECORD).load(path)
    p = F.col("metadata.arXivRaw")
    return raw.filter(F.coalesce(F.trim(p["id"]), F.lit("")) != "").select(
        F.trim(p["id"]).alias("arxiv_id"),
        T.squeeze(p["title"]).alias("title"),
        T.squeeze(p["abstract"]).alias("abstract_text"),
        T.author_list(T.squeeze(p["authors"])).alias("authors"),
        F.split(T.squeeze(p["categories"]), " ").alias("categories"),
        F.coalesce(T.subject_codes(p["msc-class"]), F.array()).alias("msc_codes"),
        F.get(p["version"], F.lit(0))["date"].alias("submitted"),
        T.first_year(F.get(p["version"], F.lit(0))["date"]).alias("year"),
    )


def subject_codes(spark: SparkSession, path: str) -> DataFrame:
    """S-06: (position, code, name, notes, level, parent, section, top) of a tab-separated code list; an unknown shape fails the read."""
    rows = spark.read.csv(path, sep="\t", schema="code string, name string, notes string", header=True)
    return classified(rows)


def classified(rows: DataFrame) -> DataFrame:
    """S-06, S-07: levels, parents and ancestors of codes by their shape: 12-XX, 12Axx, 12-01 or 12A34."""
    c = F.col("code")
    top, section = F.concat(F.substring(c, 1, 2), F.lit("-XX")), F.concat(F.substring(c, 1, 3), F.lit("xx"))
    level = F.when(c.rlike("^[0-9]{2}-XX$"), "top").when(c.rlike("^[0-9]{2}[A-Z]xx$"), "section").when(c.rlike("^[0-9]{2}-[0-9]{2}$"), "special").when(c.rlike("^[0-9]{2}[A-Z][0-9]{2}$"), "leaf").otherwise(F.raise_error(F.concat(F.lit("unknown shape of code: "), c)))
    leveled = rows.withColumn("level", level)
    lv = F.col("level")
    return leveled.select(*rows.columns, "level", F.when(lv == "leaf", section).when(lv.isin("section", "special"), top).alias("parent"), F.when(lv.isin("leaf", "section"), section).alias("section"), top.alias("top"))


def lean_manifest(spark: SparkSession, path: str) -> DataFrame:
    """S-11: (project, name, module, needs, origin): a row for each published dependency."""
    raw = spark.read.schema(MANIFEST).json(path, multiLine=True)
    rows = raw.select("project", F.explode("declarations").alias("d"))
    return rows.select("project", F.col("d.name").alias("name"), F.col("d.module").alias("module"), F.explode("d.publishedDependencies").alias("p")).select("project", "name", "module", F.col("p.name").alias("needs"), F.col("p.origin").alias("origin"))


def statements(spark: SparkSession, path: str) -> DataFrame:
    """S-12: statements of an external project."""
    return spark.read.schema(STATEMENTS).json(path, multiLine=True)


def edges(spark: SparkSession, path: str) -> DataFrame:
    """S-12: edges of an external project."""
    return spark.read.schema(EDGES).json(path, multiLine=True)


def works(spark: SparkSession, path: str) -> DataFrame:
    """S-10: works of a citation snapshot, with a hash of what counts in them."""
    raw = spark.read.schema(WORKS).json(path)
    return raw.withColumn("content_hash", F.sha2(F.concat_ws("\n", "work_id", "title", F.array_join(F.array_sort("referenced_work_ids"), ",")), 256))


def archives(spark: SparkSession, path: str) -> DataFrame:
    """S-08: (path, source): the TeX of saved submissions, packed by tar or gzip or plain; null where there is none."""
    import gzip
    import io
    import tarfile

    import pandas as pd

    def tex(data: bytes) -> str | None:
        if data[:4] == b"%PDF":
            return None
        if data[:2] == b"\x1f\x8b":
            data = gzip.decompress(data)
        try:
            with tarfile.open(fileobj=io.BytesIO(data)) as tar:
                parts = [tar.extractfile(m).read().decode("utf-8", "replace") for m in sorted(tar.getmembers(), key=lambda m: m.name) if m.isfile() and m.name.endswith(".tex")]
            return "\n".join(parts) or None
        except tarfile.TarError:
            text = data.decode("utf-8", "replace")
            return text if "\\" in text else None

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "source": [tex(bytes(c)) for c in pdf["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, source string")


def verdicts(df: DataFrame, text: str) -> DataFrame:
    """P-15: ``df`` with the verdict of the last JSON object in a model's answer; malformed if there is none."""
    found = F.regexp_extract_all(F.col(text), F.lit(r'\{[^{}]*"verdict"[^{}]*\}'), F.lit(0))
    value = F.get_json_object(F.element_at(F.when(F.size(found) > 0, found), -1), "$.verdict")
    known = F.lower(value).isin("correct", "incorrect", "malformed")
    return df.withColumn("verdict", F.when(known, F.lower(value)).otherwise("malformed"))


def cascade(small: Column, large: Column) -> Column:
    """P-15: the small model's rejection is final, its acceptance is decided by the large one."""
    return F.when(small.isin("incorrect", "malformed"), small).otherwise(F.coalesce(large, F.lit("malformed")))
