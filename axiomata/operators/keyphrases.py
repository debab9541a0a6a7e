"""Keyphrases, their scores, and how concentrated they are in fields."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from ..plans.stages import dealt, spread, written

#: Words of a phrase at most.
LONGEST = 6
STOP = frozenset(T.STOP_WORDS) | frozenset(T.CONNECTIVE_WORDS)
_OLD_ID, _COMMAND = re.compile(T.OLD_ID), re.compile(T.TEX_COMMAND)
#: Letters, digits, hyphens and white space continue a segment.
_SEPARATOR = re.compile(r"(?:[^\w\s-]|_)+")
_ACCENT = re.compile(r"\\(.)(?:\{(.)\}?|(.))")
_LETTERS = {(mark, plain): accented for mark, plain, accented in T.TEX_ACCENTS}
_CONTENT = re.compile(r"[^\W_](?:.*[^\W_])?")


def plain_text(text: str) -> str:
    """T-01..T-03: a text without old ids and commands of TeX, its accents as letters, in lower case."""
    if "/" in text:
        text = _OLD_ID.sub(" ", text)
    if "\\" in text:
        text = _ACCENT.sub(lambda m: _LETTERS.get((m[1], m[2] or m[3]), m[0]), text)
        text = _COMMAND.sub(" ", text)
    return text.lower()


def is_content_word(word: str) -> bool:
    """T-05: first and last character alphanumeric, two letters at least."""
    return bool(_CONTENT.fullmatch(word)) and sum(map(str.isalpha, word)) >= 2


class _Kept(dict):
    """Whether a word can stand in a phrase; words beyond the bound start the store anew."""

    def __missing__(self, word: str) -> bool:
        if len(self) >= 100_000:
            self.clear()
        self[word] = out = word not in STOP and is_content_word(word)
        return out


_kept = _Kept()


def candidate_phrases(text: str | None) -> list[tuple[str, ...]]:
    """T-04, T-06: maximal runs of content words in each segment, of at most ``LONGEST`` words, repeats included."""
    out = []
    for segment in _SEPARATOR.split(plain_text(text or "")):
        run: list[str] = []
        for word in segment.split():
            if _kept[word]:
                run.append(word)
            elif run:
                if len(run) <= LONGEST:
                    out.append(tuple(run))
                run = []
        if 0 < len(run) <= LONGEST:
            out.append(tuple(run))
    return out


def scored_phrases(text: str | None) -> dict[str, float]:
    """T-07: the distinct phrases of a document; a phrase scores the sum of degree over frequency of its words."""
    found = candidate_phrases(text)
    degree: Counter[str] = Counter()
    times: Counter[str] = Counter()
    for phrase in found:
        for word in phrase:
            degree[word] += len(phrase)
            times[word] += 1
    return {" ".join(p): sum(degree[w] / times[w] for w in p) for p in dict.fromkeys(found)}


def rake_scores(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """T-07, A-05: (doc, phrase, score) of the distinct phrases of each row.

    A score is a statistic of one document, so the texts are read once, an
    Arrow batch at a time, and no word is shuffled.
    """
    schema = S.StructType([S.StructField("doc", docs.schema[doc].dataType), S.StructField("phrase", S.StringType()), S.StructField("score", S.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows, phrases, scores = [], [], []
                for row, t in enumerate(part.column(1).to_pylist()):
                    found = scored_phrases(t)
                    rows += [row] * len(found)
                    phrases += found.keys()
                    scores += found.values()
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), pa.array(phrases, pa.string()), pa.array(scores, pa.float64())], names=["doc", "phrase", "score"])

    return spread(docs.select(F.col(doc), F.col(text).cast("string"))).mapInArrow(run, schema)


def phrase_rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, phrase) for each distinct candidate phrase of each row; no scores are made."""
    schema = S.StructType([S.StructField("doc", docs.schema[doc].dataType), S.StructField("phrase", S.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows, phrases = [], []
                for row, t in enumerate(part.column(1).to_pylist()):
                    found = set(candidate_phrases(t))
                    rows += [row] * len(found)
                    phrases += map(" ".join, found)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), pa.array(phrases, pa.string())], names=["doc", "phrase"])

    return spread(docs.select(F.col(doc), F.col(text).cast("string"))).mapInArrow(run, schema)


def accumulate(scored: DataFrame, min_docs: int = 3, samples: int = 3) -> DataFrame:
    """A-04: (phrase, word_count, doc_freq, mean_score, sample_ids) of phrases in enough documents.

    The first ids are taken by rank before they are collected, so no list grows with the corpus.
    The scores are written once and read twice.
    """
    scored = written(scored.select("doc", "phrase", "score"), "scored-phrases")
    stats = scored.groupBy("phrase").agg(F.count(F.lit(1)).alias("doc_freq"), F.avg("score").alias("mean_score")).filter(F.col("doc_freq") >= min_docs)
    ranked = scored.join(stats.select("phrase"), "phrase", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("phrase").orderBy("doc"))).filter(F.col("n") <= samples)
    first = ranked.groupBy("phrase").agg(F.array_sort(F.collect_list("doc")).alias("sample_ids"))
    return stats.join(first, "phrase").select("phrase", F.size(F.split("phrase", " ")).alias("word_count"), "doc_freq", "mean_score", "sample_ids")


def field_prior(labels: DataFrame, doc: str, label: str) -> DataFrame:
    """A-06: (label, mass, prior); a document shares one unit among its distinct labels."""
    rows = labels.select(F.col(doc).alias("doc"), F.col(label).alias("label")).filter("label is not null").distinct()
    weights = rows.groupBy("doc").agg((F.lit(1.0) / F.count(F.lit(1))).alias("w"))
    mass = rows.join(weights, "doc").groupBy("label").agg(F.sum("w").alias("mass"))
    return mass.withColumn("prior", F.col("mass") / F.sum("mass").over(Window.partitionBy()))


def field_concentration(links: DataFrame, labels: DataFrame, prior: DataFrame, min_labelled: int = 50, smoothing: float = 10.0) -> DataFrame:
    """A-07: (phrase, labelled, concentration): the smoothed divergence of a phrase's fields from the prior.

    ``links``: (doc, phrase); ``labels``: (doc, label). Null below
    ``min_labelled`` labelled documents. The labels are a small dimension, so
    the dense sum is a sum over seen labels plus a closed form for the others.
    """
    own = labels.select("doc", "label").filter("label is not null").distinct()
    by_doc = own.groupBy("doc").agg((F.lit(1.0) / F.count(F.lit(1))).alias("w"), F.min("label").alias("least"))
    # the first label of a document counts it
    share = own.join(by_doc, "doc").select("doc", "label", "w", (F.col("label") == F.col("least")).cast("long").alias("one"))
    links = written(links.select("doc", "phrase"), "links")
    n = links.count()
    seen = dealt(links, n, "doc").distinct().join(dealt(share, n, "doc"), "doc").select("phrase", "label", "w", "one")
    counts = dealt(seen, n, "phrase").groupBy("phrase", "label").agg(F.sum("w").alias("c"), F.sum("one").alias("ones"))
    totals = counts.groupBy("phrase").agg(F.sum("ones").alias("labelled"), F.sum("c").alias("total")).filter(F.col("labelled") >= min_labelled)
    denominator = F.col("total") + smoothing
    p = (F.col("c") + smoothing * F.col("prior")) / denominator
    part = counts.join(totals, "phrase").join(F.broadcast(prior.select("label", "prior")), "label").groupBy("phrase").agg(
        F.first("labelled").alias("labelled"), F.first("total").alias("total"), F.sum(p * F.log(p / F.col("prior"))).alias("kl"), F.sum("prior").alias("covered")
    )
    # labels never seen with the phrase: p / q is smoothing / denominator for each
    rest = (1 - F.col("covered")) * (smoothing / denominator) * F.log(F.lit(smoothing) / denominator)
    return part.select("phrase", "labelled", (F.col("kl") + rest).alias("concentration"))


# Stock phrases that concentration doesn't tell from concepts.
REGISTER_PHRASES = (
    "main theorem", "short proof", "rigorous proof", "mild assumptions", "suitable assumptions", "additional assumptions", "additional assumption", "general assumptions",
    "simple proof", "simple proofs", "elementary proof", "alternative proof", "easy proof", "shorter proof", "complete proof", "complete proofs", "direct proof", "proof relies",
    "simplified proof", "detailed proof", "proof involves", "proof follows", "proof consists", "simpler proof",
    "wide class", "general class", "special class", "special classes", "broad class", "larger class", "wider class", "different classes",
    "basic properties", "general properties", "main properties", "following properties", "nice properties", "special properties", "interesting properties", "remarkable properties",
    "revised version", "expanded version", "final version", "effective version", "general version", "simplified version", "refined version", "relative version",
    "part ii", "part iii", "last section", "final section", "main part", "last part", "third part",
    "interesting examples", "illustrative examples", "important example", "important examples", "specific example", "typical example",
    "general conjecture", "conjecture stated", "conjecture made", "conjecture holds",
)


def boilerplate(candidates: DataFrame, most: float = 0.22) -> DataFrame:
    """Phrases that belong to no field: by a known, low concentration, or as known stock phrases."""
    return candidates.filter((F.col("concentration").isNotNull() & (F.col("concentration") < most)) | F.col("phrase").isin(*REGISTER_PHRASES))


def ground(phrases: DataFrame, codes: DataFrame, longest: int = 4) -> DataFrame:
    """T-14: each phrase with the first code whose name has it as an n-gram, in singular or plural.

    ``codes``: (position, code, name).
    """
    words = codes.select("position", "code", F.filter(F.split(F.lower("name"), r"[^\p{L}\p{N}\-]+"), lambda w: w != "").alias("w"))
    grams = words.select("position", "code", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))))).alias("gram"))
    index = grams.groupBy("gram").agg(F.min_by("code", F.struct("position", "code")).alias("code"))
    exact = phrases.join(index.withColumnsRenamed({"gram": "phrase", "code": "exact"}), "phrase", "left")
    other = exact.withColumn("other", T.toggle_s(F.col("phrase"))).join(index.withColumnsRenamed({"gram": "other", "code": "toggled"}), "other", "left")
    return other.select(*phrases.columns, F.coalesce("exact", "toggled").alias("code"))
