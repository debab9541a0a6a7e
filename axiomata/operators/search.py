"""Search over phrases and judgments as set operations: any number of queries at once.

The inverted index is a table of (token, entry); a query meets it on its
tokens, so the work is proportional to the postings that it touches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.stages import written
from .lookups import where

#: The symbols of a query, as in the statements.
_SYMBOL = re.compile("[Ͱ-Ͽ‖℀-⅏←-⇿∀-⋿⟀-⟯⨀-⫿\U0001d400-\U0001d7ff]")
BETA, POPULARITY = 2.0, 0.15


def postings(entries: DataFrame) -> DataFrame:
    """Q-02: distinct (entry, token) of entries (entry, phrase)."""
    return entries.select("entry", F.explode(F.array_distinct(T.query_words(F.col("phrase")))).alias("token"))


def idf(index: DataFrame, entries: DataFrame) -> DataFrame:
    """A-17: (token, df, idf)."""
    total = entries.agg(F.count(F.lit(1)).alias("n"))
    # one row
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total)).select("token", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def masses(index: DataFrame, weights: DataFrame, entries: DataFrame) -> DataFrame:
    """A-17: (entry, form, n_tokens, mass): an entry's normal form, its words and the sum of its tokens' weights."""
    mass = index.join(weights, "token").groupBy("entry").agg(F.sum("idf").alias("mass"))
    words = T.query_words(F.col("phrase"))
    return entries.select("entry", "doc_freq", "cluster", F.array_join(words, " ").alias("form"), F.size(words).alias("n_tokens")).join(mass, "entry", "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))


def corrections(words: DataFrame, weights: DataFrame) -> DataFrame:
    """T-24, T-25: (word, corrected) of unknown words of four letters or more.

    Candidates begin with the same letter, so the join is on it and on the
    length; within one edit for five letters or fewer, else two; the least
    distance, then most postings, then the least word.
    """
    unknown = words.select("word").distinct().join(weights.select(F.col("token").alias("word")), "word", "left_anti").filter(F.length("word") >= 4)
    limit = F.when(F.length("word") <= 5, 1).otherwise(2)
    asked = unknown.select("word", limit.alias("limit"), F.substring("word", 1, 1).alias("first"), F.explode(F.sequence(F.length("word") - limit, F.length("word") + limit)).alias("size"))
    known = weights.select("token", "df", F.substring("token", 1, 1).alias("first"), F.length("token").alias("size"))
    near = asked.join(known, ["first", "size"]).withColumn("d", F.levenshtein("word", "token")).filter(F.col("d") <= F.col("limit"))
    best = near.groupBy("word").agg(F.min(F.struct("d", (-F.col("df")).alias("f"), "token")).alias("b"))
    return best.select("word", F.col("b.token").alias("corrected"))


def resolved(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """T-23, T-26: (qid, at, token) with unknown words corrected, hyphenated ones by their parts."""
    rows = queries.select("qid", F.posexplode(T.query_tokens(F.col("query"))).alias("at", "word"))
    known = weights.select(F.col("token").alias("word"), F.lit(True).alias("known"))
    parted = rows.join(known, "word", "left").select("qid", "at", F.explode(F.when(F.col("known").isNull() & F.contains("word", F.lit("-")), F.filter(F.split("word", "-"), lambda w: w != "")).otherwise(F.array("word"))).alias("word"))
    fixed = corrections(parted, weights)
    return parted.join(fixed, "word", "left").select("qid", "at", F.coalesce("corrected", "word").alias("token"))


def matches(tokens: DataFrame, index: DataFrame, weights: DataFrame) -> DataFrame:
    """Q-03: (qid, entry, matched, matched_idf) over distinct query tokens."""
    asked = tokens.select("qid", "token").distinct()
    return asked.join(index, "token").join(weights, "token").groupBy("qid", "entry").agg(F.count(F.lit(1)).alias("matched"), F.sum("idf").alias("matched_idf"))


def relevance(matched: Column, asked: Column, mass: Column, doc_freq: Column) -> Column:
    """V-11: F-measure of shared weight, recall counting more, with a share for popularity."""
    recall, precision = F.least(F.lit(1.0), matched / asked), F.least(F.lit(1.0), matched / mass)
    b2 = BETA * BETA
    bottom = b2 * precision + recall
    f = F.when(bottom > 0, (1 + b2) * precision * recall / bottom).otherwise(F.lit(0.0))
    popular = F.least(F.lit(1.0), F.log10(1 + doc_freq) / 4)
    return F.when((asked > 0) & (mass > 0), (1 - POPULARITY) * f + POPULARITY * popular).otherwise(F.lit(0.0))


TIERS = ("exact", "same_concept", "specialization", "closest", "related")


def tiered(queries: DataFrame, entries: DataFrame, top_k: int = 5, related: DataFrame | None = None) -> DataFrame:
    """Q-04, W-07: (qid, tier, rank, entry, score): exact, same concept, specialisation, closest and related hits.

    Exact: the same set of words; verbatim forms come first. Related: the
    neighbours (source, target, score) of the best hit of the first tier that
    has one. Each entry shows once for a query, in its first tier. The index is written once and read by every tier.
    """
    entries = written(entries, "entries")
    index = written(postings(entries), "postings")
    weights = written(idf(index, entries), "idf")
    mass = masses(index, weights, entries)
    tokens = written(resolved(queries, weights), "query-tokens")
    form = tokens.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), " ").alias("asked_form"), F.countDistinct("token").alias("n_asked"))
    asked = tokens.select("qid", "token").distinct().join(weights, "token").groupBy("qid").agg(F.sum("idf").alias("asked"))
    hits = matches(tokens, index, weights).join(mass, "entry").join(form, "qid").join(asked, "qid")
    scored = hits.select(
        "qid",
        "entry",
        "cluster",
        F.when(F.col("matched") < F.col("n_asked"), "closest").when(F.col("n_tokens") == F.col("n_asked"), "exact").otherwise("specialization").alias("tier"),
        (F.col("form") == F.col("asked_form")).alias("verbatim"),
        relevance(F.col("matched_idf"), F.col("asked"), F.col("mass"), F.col("doc_freq")).alias("score"),
    )
    scored = written(scored, "scored-hits")
    order = Window.partitionBy("qid", "tier").orderBy(F.desc("verbatim"), F.desc("score"), "entry")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    exact = ranked.filter("tier = 'exact'")
    shown = exact.select("qid", "entry")
    clusters = exact.filter("cluster is not null").select("qid", "cluster").distinct()
    same = clusters.join(entries.select("entry", "cluster", "doc_freq"), "cluster").join(shown, ["qid", "entry"], "left_anti")
    same = same.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("doc_freq"), "entry"))).filter(F.col("rank") <= top_k)
    same = same.select("qid", F.lit("same_concept").alias("tier"), "rank", "entry", F.lit(1.0).alias("score"))
    rest = scored.filter("tier <> 'exact'").join(same.select("qid", "entry"), ["qid", "entry"], "left_anti").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    columns = ["qid", "tier", "rank", "entry", "score"]
    found = reduce(DataFrame.union, [exact.select(columns), same.select(columns), rest.select(columns)])
    if related is None:
        return found
    first = F.when(F.col("tier") == "exact", 0).when(F.col("tier") == "specialization", 1).otherwise(2)
    anchor = ranked.filter("rank = 1").groupBy("qid").agg(F.min_by("entry", first).alias("source"))
    near = anchor.join(related, "source").select("qid", F.col("target").alias("entry"), "score").join(found.select("qid", "entry"), ["qid", "entry"], "left_anti")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "entry"))).filter(F.col("rank") <= top_k)
    return found.union(near.select("qid", F.lit("related").alias("tier"), "rank", "entry", F.col("score").cast("double").alias("score")))


def phrase_search(queries: DataFrame, entries: DataFrame, top_k: int = 5, vectors: DataFrame | None = None) -> DataFrame:
    """Q-01: (qid, tier, entry, score): raw equality, same cluster, longer phrases that contain the query's words in sequence, then related ones.

    Longer phrases are found by the word runs of the phrases, so the join is on
    equality. Related: the nearest of ``vectors`` (entry, vector) to the
    query's vector, a column ``vector`` of ``queries``, or else to that of its
    exact hit.
    """
    asked = queries.select("qid", F.lower(F.trim("query")).alias("q"))
    exact = asked.join(entries, F.col("q") == F.col("phrase")).select("qid", "entry", "cluster")
    same = exact.select("qid", "cluster").filter("cluster is not null").distinct().join(entries, "cluster").join(exact.select("qid", "entry"), ["qid", "entry"], "left_anti")
    same = same.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("doc_freq"), "entry"))).filter(F.col("n") <= top_k)
    words = F.split("phrase", r"\s+")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    longer = entries.select("entry", "doc_freq", words.alias("w")).filter(F.size("w") > 1).select("entry", "doc_freq", F.size("w").alias("size"), F.explode(F.array_distinct(runs)).alias("q"))
    special = asked.join(longer, "q").join(exact.select("qid", "entry").union(same.select("qid", "entry")), ["qid", "entry"], "left_anti")
    special = special.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("doc_freq"), "entry"))).filter(F.col("n") <= top_k)
    one = lambda df, tier, score: df.select("qid", F.lit(tier).alias("tier"), "entry", score.alias("score"))
    found = one(exact, "exact", F.lit(1.0)).union(one(same, "same_concept", F.lit(1.0))).union(one(special, "specialization", F.size(F.split("q", r"\s+")) / F.col("size")))
    if vectors is None:
        return found
    own = exact.join(vectors, "entry").groupBy("qid").agg(F.min_by("vector", "entry").alias("vector"))
    if "vector" in queries.columns:
        given = queries.select("qid", F.col("vector").alias("given"))
        own = given.join(own, "qid", "left").select("qid", F.coalesce("given", "vector").alias("vector")).filter("vector is not null")
    near = nearest_entries(own, vectors.join(entries.select("entry"), "entry", "left_semi"), found.select("qid", "entry"), top_k)
    return found.union(near.select("qid", F.lit("related"), "entry", "score"))


def nearest_entries(asked: DataFrame, vectors: DataFrame, shown: DataFrame, top_k: int) -> DataFrame:
    """(qid, entry, score): the entries (entry, vector) nearest to the vectors of a stated set of queries, without those shown.

    The queries and what each shows already are sent to the tasks; each task
    compares its rows with all queries as matrices and keeps the best of each.
    """
    held: dict[int, set] = {}
    for r in shown.join(asked.select("qid").distinct(), "qid", "left_semi").distinct().collect():
        held.setdefault(r["qid"], set()).add(r["entry"])
    rows = [(r["qid"], np.asarray(r["vector"], dtype=np.float64)) for r in asked.collect()]
    unit = lambda v: v / n if (n := np.linalg.norm(v)) > 0 else v * 0.0
    ids, matrix = [q for q, _ in rows], np.array([unit(v) for _, v in rows])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) and len(ids):
                own = np.array([unit(np.asarray(v, dtype=np.float64)) for v in pdf["vector"]])
                entry = pdf["entry"].to_numpy()
                for q, scores in zip(ids, matrix @ own.T, strict=True):
                    free = ~np.isin(entry, list(held.get(q, ())))
                    best = np.lexsort((entry[free], -scores[free]))[:top_k]
                    yield pd.DataFrame({"qid": q, "entry": entry[free][best], "score": scores[free][best]})

    types = f"qid {asked.schema['qid'].dataType.simpleString()}, entry {vectors.schema['entry'].dataType.simpleString()}, score double"
    near = vectors.select("entry", "vector").mapInPandas(run, types)
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "entry")))
    return ranked.filter(F.col("r") <= top_k).select("qid", "entry", "score")


def evaluate(hits: DataFrame, accepted: DataFrame, queries: DataFrame, depth: int = 10) -> DataFrame:
    """A-26: (mrr, top1, dead) over all queries; hits: (qid, position, entry), accepted: (qid, entry)."""
    good = hits.filter(F.col("position") <= depth).join(accepted, ["qid", "entry"]).groupBy("qid").agg(F.min("position").alias("best"))
    any_ = hits.select("qid").distinct().withColumn("any", F.lit(True))
    joined = queries.select("qid").join(good, "qid", "left").join(any_, "qid", "left")
    share = lambda c: F.avg(c.cast("double"))
    return joined.agg(F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("mrr"), share(F.coalesce(F.col("best") == 1, F.lit(False))).alias("top1"), share(F.col("any").isNull()).alias("dead"))


def positions(hits: DataFrame) -> DataFrame:
    """(qid, position, entry): one list from the tiers in their order."""
    order = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    return hits.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(order, "rank", "entry"))).select("qid", "position", "entry")


def relation_rates(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """A-27: (group, pairs, connected, rate) of labelled pairs (group, a, b) by links (a, b) of either direction."""
    both = links.select("a", "b").union(links.select("b", "a")).distinct().withColumn("hit", F.lit(1))
    return pairs.join(both, ["a", "b"], "left").groupBy("group").agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("connected"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("rate"))


def name_score(name: Column, tokens: Column, raw: Column) -> Column:
    """V-12: half coverage of the name, half exactness, if each query token begins a token of the name; 0.1 for a bare substring, else null.

    ``tokens`` are the query's identifier tokens, ``raw`` its lower-cased text.
    """
    own = T.identifier_tokens(name)
    every = (F.size(tokens) > 0) & F.forall(tokens, lambda q: F.exists(own, lambda t: t.startswith(q)))
    exact = F.size(F.filter(tokens, lambda q: F.array_contains(own, q)))
    score = 0.5 * F.least(F.lit(1.0), F.size(tokens) / F.size(own)) + 0.5 * exact / F.size(tokens)
    return F.when(every, score).when((F.size(tokens) > 0) & F.contains(F.lower(name), raw), F.lit(0.1))


def symbol_weights(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """A-18: (symbol, df, weight) of the symbols of statements."""
    found = rows.select(F.col(ident).alias("id"), F.explode(T.math_symbols(F.col(text))).alias("symbol"))
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy("symbol").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total)).select("symbol", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("weight"))


def judgment_search(queries: list[tuple[int, str]], judgments: DataFrame, edges: DataFrame, top_k: int = 5, **filters: object) -> DataFrame:
    """Q-05, F-09: (qid, tier, entry, score): exact name or statement, similar name, statement, and one hop from these.

    ``queries``: a stated set of (qid, text), which is part of the plan, so
    each judgment (id, name, statement, context as an array) is read once and
    scored against all of them. ``filters``: values of further columns that
    hits must have; None asks for nothing.
    """
    rows = where(judgments, **filters)
    hay = F.lower(F.concat_ws(" ", "statement", F.array_join(F.col("context").cast("array<string>"), " ")))
    wanted = sorted({s for _, q in queries for s in _SYMBOL.findall(q)})
    weight = {r["symbol"]: r["weight"] for r in symbol_weights(rows, "id", "statement").filter(F.col("symbol").isin(wanted)).collect()} if wanted else {}
    nothing = F.array().cast("array<string>")
    asked = []
    for qid, text in queries:
        raw, symbols = text.strip().lower(), list(dict.fromkeys(_SYMBOL.findall(text)))
        if raw:
            weights = F.array(*[F.lit(float(weight.get(s, 1.0))) for s in symbols]) if symbols else F.array().cast("array<double>")
            asked.append(F.struct(F.lit(qid).alias("qid"), F.lit(raw).alias("raw"), T.identifier_tokens(F.lit(text)).alias("tokens"), (F.array(*[F.lit(s) for s in symbols]) if symbols else nothing).alias("symbols"), weights.alias("weights")))
    met = rows.select("id", "name", "statement", hay.alias("hay"), F.explode(F.array(*asked)).alias("q"))
    raw = F.col("q.raw")
    exact = F.coalesce(F.lower("name") == raw, F.lit(False)) | F.coalesce(F.lower("statement") == raw, F.lit(False))
    scored = met.withColumns({"ns": name_score(F.coalesce("name", F.lit("")), F.col("q.tokens"), raw), "ss": statement_score(F.col("hay"), F.col("q.tokens"), F.col("q.symbols"), F.col("q.weights"))})
    tier = F.when(exact, "exact").when(F.col("ns").isNotNull(), "name").when(F.col("ss").isNotNull(), "statement")
    hits = scored.select(F.col("q.qid").alias("qid"), tier.alias("tier"), F.col("id").alias("entry"), "name", F.when(exact, F.lit(1.0)).otherwise(F.coalesce("ns", "ss")).alias("score")).filter("tier is not null")
    ranked = hits.withColumn("n", F.row_number().over(Window.partitionBy("qid", "tier").orderBy(F.desc("score"), F.coalesce("name", F.lit("")), "entry")))
    ranked = written(ranked, "judgment-hits")
    own = ranked.filter(F.col("n") <= top_k).select("qid", "tier", "entry", "score")
    anchors = ranked.filter((F.col("tier") == "exact") | (F.col("n") <= top_k))
    fresh = connected(anchors, edges, top_k, ranked).join(rows.select(F.col("id").alias("entry")), "entry", "left_semi")
    return own.union(fresh.select("qid", F.lit("connected").alias("tier"), "entry", "score"))


def connected(anchors: DataFrame, edges: DataFrame, top_k: int, shown: DataFrame | None = None) -> DataFrame:
    """A-19: (qid, entry, fan_in, via, score): neighbours of a query's hits by the share of hits that reach them, without what is ``shown``."""
    both = edges.select(F.col("src").alias("entry"), F.col("dst").alias("near")).union(edges.select("dst", "src")).distinct()
    count = anchors.groupBy("qid").agg(F.countDistinct("entry").alias("n"))
    reached = anchors.select("qid", "entry").distinct().join(both, "entry").groupBy("qid", F.col("near").alias("found")).agg(F.count(F.lit(1)).alias("fan_in"), F.min("entry").alias("via"))
    fresh = reached.join((anchors if shown is None else shown).select("qid", F.col("entry").alias("found")).distinct(), ["qid", "found"], "left_anti").join(count, "qid")
    ranked = fresh.withColumn("score", F.col("fan_in") / F.col("n")).withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "found")))
    return ranked.filter(F.col("r") <= top_k).select("qid", F.col("found").alias("entry"), "fan_in", "via", "score")


def statement_score(statement: Column, tokens: Column, symbols: Column, weights: Column) -> Column:
    """V-13: how well a statement matches query tokens (all must occur) and weighed symbols; null if neither does.

    ``weights`` are the weights of ``symbols`` in their order; short statements score higher.
    """
    own = T.math_symbols(statement)
    whole = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    hit = F.aggregate(F.zip_with(symbols, weights, lambda s, w: F.when(F.array_contains(own, s), w).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, w: a + w)
    covered = F.when(whole > 0, hit / whole).otherwise(F.lit(0.0))
    every = (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(F.lower(statement), t))
    brevity = 1 / (1 + F.length(statement) / 120)
    return F.when(every & (F.size(symbols) == 0), brevity).when(every, (0.5 + 0.5 * covered) * brevity).when(covered > 0, covered * brevity)


def federated(concepts: DataFrame, judgments: DataFrame, top_k: int = 5) -> DataFrame:
    """Q-06: (qid, source, rank, entry, score): the best hits of both searches in one list."""
    both = concepts.select("qid", F.lit("concept").alias("source"), "entry", "score").union(judgments.select("qid", F.lit("judgment").alias("source"), "entry", "score"))
    best = both.groupBy("qid", "source", "entry").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "source", "entry"))).filter(F.col("rank") <= top_k)
