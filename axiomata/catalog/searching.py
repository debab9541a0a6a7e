"""Search queries over part names as phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S
from ..session import table
from . import graphs

ASKED = ((1, "red ring"), (2, "ring red"), (3, "widgets"), (4, "smal gear"), (5, "the blue"), (6, "zzzz"), (7, "redd-bolt"))
_VALUES = ", ".join(f"({i}, '{q}')" for i, q in ASKED)
#: What the queries resolve to, worked out by hand from the rules.
_RESOLVED = "(1, 0, 'red'), (1, 1, 'ring'), (2, 0, 'ring'), (2, 1, 'red'), (3, 0, 'widget'), (4, 0, 'small'), (4, 1, 'gear'), (5, 0, 'blue'), (6, 0, 'zzzz')"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as phrases; a name's last word stands for its cluster."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("phrase")).agg(F.count(F.lit(1)).alias("doc_freq"), F.min("p_partkey").alias("entry"))
    return names.withColumn("cluster", F.substring_index("phrase", " ", -1))


ENTRIES_SQL = """
ent AS (SELECT p_name AS phrase, count(*) AS doc_freq, min(p_partkey) AS entry, string_split(p_name, ' ')[-1] AS cluster FROM part GROUP BY p_name),
post AS (SELECT DISTINCT entry, unnest(string_split(phrase, ' ')) AS token FROM ent),
wt AS (SELECT token, count(*) AS df, ln(1 + ((SELECT count(*) FROM ent) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY token),
mass AS (SELECT entry, any_value(phrase) AS form, any_value(doc_freq) AS doc_freq, any_value(cluster) AS cluster, count(*) AS n_tokens, sum(idf) AS mass FROM ent JOIN post USING (entry) JOIN wt USING (token) GROUP BY entry)
"""


def _queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "qid int, query string")


def idf_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = entries(spark, sf_dir)
    return S.idf(S.postings(own), own).select("token", "df", F.round("idf", 6).alias("idf"))


def entry_idf_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = entries(spark, sf_dir)
    index = S.postings(own)
    return S.masses(index, S.idf(index, own), own).select("entry", "form", "n_tokens", F.round("mass", 6).alias("mass"))


def spelling_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-25 on words of the documents' first lines against part-name words: each word with its correction, if any."""
    own = entries(spark, sf_dir)
    weights = S.idf(S.postings(own), own)
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter("word <> ''")
    return S.corrections(words, weights)


CORRECT_SQL = f"""
WITH {ENTRIES_SQL}, w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents),
c AS (SELECT word, token, df, levenshtein(word, token) AS d FROM w JOIN wt ON left(word, 1) = left(token, 1) WHERE length(word) >= 4 AND word NOT IN (SELECT token FROM wt) AND levenshtein(word, token) <= CASE WHEN length(word) <= 5 THEN 1 ELSE 2 END)
SELECT word, token AS corrected FROM c QUALIFY row_number() OVER (PARTITION BY word ORDER BY d, df DESC, token) = 1
"""


def tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-04; phrases with one first word are neighbours."""
    own = entries(spark, sf_dir)
    word = F.substring_index("phrase", " ", 1).alias("w")
    near = own.select(word, F.col("entry").alias("source")).join(own.select(word, F.col("entry").alias("target")), "w").filter("source <> target")
    related = near.select("source", "target", (1 / (1 + F.abs(F.col("source") - F.col("target")))).alias("score"))
    return S.tiered(_queries(spark).filter("qid < 7"), own, related=related).withColumn("score", F.round("score", 6))


TIERED_SQL = f"""
{ENTRIES_SQL}, tok(qid, place, token) AS (VALUES {_RESOLVED}),
form AS (SELECT qid, string_agg(token, ' ' ORDER BY place) AS asked_form, count(DISTINCT token) AS n_asked FROM tok GROUP BY qid),
asked AS (SELECT qid, sum(idf) AS asked FROM tok JOIN wt USING (token) GROUP BY qid),
m AS (SELECT qid, entry, count(*) AS matched, sum(idf) AS mi FROM tok JOIN post USING (token) JOIN wt USING (token) GROUP BY ALL),
p AS (SELECT *, least(1, mi / asked) AS r, least(1, mi / mass) AS pr FROM m JOIN mass USING (entry) JOIN form USING (qid) JOIN asked USING (qid)),
scored AS (SELECT qid, entry, cluster, CASE WHEN matched < n_asked THEN 'closest' WHEN n_tokens = n_asked THEN 'exact' ELSE 'specialization' END AS tier, form = asked_form AS verbatim,
  0.85 * (5 * pr * r / (4 * pr + r)) + 0.15 * least(1, log10(1 + doc_freq) / 4) AS score FROM p),
ex AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY verbatim DESC, score DESC, entry) AS rank FROM scored WHERE tier = 'exact' QUALIFY rank <= 5),
same AS (SELECT qid, entry, row_number() OVER (PARTITION BY qid ORDER BY doc_freq DESC, entry) AS rank FROM (SELECT DISTINCT qid, cluster FROM ex) JOIN ent USING (cluster) WHERE (qid, entry) NOT IN (SELECT qid, entry FROM ex) QUALIFY rank <= 5),
rest AS (SELECT *, row_number() OVER (PARTITION BY qid, tier ORDER BY verbatim DESC, score DESC, entry) AS rank FROM scored WHERE tier <> 'exact' AND (qid, entry) NOT IN (SELECT qid, entry FROM same) QUALIFY rank <= 5),
nr AS (SELECT a.entry AS source, b.entry AS target, 1 / (1 + abs(a.entry - b.entry)) AS score FROM ent a JOIN ent b ON string_split(a.phrase, ' ')[1] = string_split(b.phrase, ' ')[1] AND a.entry <> b.entry),
first_ AS (SELECT qid, entry, tier FROM scored QUALIFY row_number() OVER (PARTITION BY qid, tier ORDER BY verbatim DESC, score DESC, entry) = 1),
anchor AS (SELECT qid, arg_min(entry, CASE tier WHEN 'exact' THEN 0 WHEN 'specialization' THEN 1 ELSE 2 END) AS source FROM first_ GROUP BY qid),
hits AS (SELECT qid, tier, rank, entry, score FROM ex UNION ALL SELECT qid, 'same_concept', rank, entry, 1.0 FROM same UNION ALL SELECT qid, tier, rank, entry, score FROM rest)
"""


def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _queries(spark).union(spark.createDataFrame([(8, "Ring "), (9, "gear")], "qid int, query string"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("entry"), F.col("embedding").alias("vector"))
    return S.phrase_search(asked, entries(spark, sf_dir), 100, vectors).withColumn("score", F.round("score", 6))


PHRASE_SQL = f"""
WITH {ENTRIES_SQL}, q AS (SELECT qid, lower(trim(query)) AS q FROM (VALUES {_VALUES}, (8, 'Ring '), (9, 'gear')) v(qid, query)),
ex AS (SELECT qid, entry, cluster FROM q JOIN ent ON q = phrase),
same AS (SELECT DISTINCT qid, e.entry FROM ex JOIN ent e USING (cluster) WHERE (qid, e.entry) NOT IN (SELECT qid, entry FROM ex)),
sp AS (SELECT qid, entry, len(string_split(q, ' ')) / len(string_split(phrase, ' ')) AS score FROM q JOIN ent ON contains(' ' || phrase || ' ', ' ' || q || ' ') AND len(string_split(phrase, ' ')) > len(string_split(q, ' ')) WHERE (qid, entry) NOT IN (SELECT qid, entry FROM ex UNION ALL SELECT qid, entry FROM same))
SELECT qid, 'exact' AS tier, entry, 1.0 AS score FROM ex UNION ALL SELECT qid, 'same_concept', entry, 1.0 FROM same UNION ALL SELECT qid, 'specialization', entry, round(score, 6) FROM sp
UNION ALL SELECT qid, 'related', entry, round(s, 6) FROM (SELECT qv.qid, ent.entry, list_cosine_similarity(v.embedding::DOUBLE[], qv.v) AS s FROM (SELECT qid, e.embedding::DOUBLE[] AS v FROM ex JOIN embeddings e ON e.vec_id = ex.entry) qv, ent JOIN embeddings v ON v.vec_id = ent.entry
  WHERE (qv.qid, ent.entry) NOT IN (SELECT qid, entry FROM ex UNION ALL SELECT qid, entry FROM same UNION ALL SELECT qid, entry FROM sp)) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, entry) <= 100
"""


def search_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-26, Q-07: the accepted entry of a query is the part name that it means."""
    own, asked = entries(spark, sf_dir), _queries(spark).filter("qid < 7")
    want = spark.createDataFrame([(1, "red ring"), (2, "red ring"), (3, "red widget"), (4, "small gear"), (5, "blue bolt"), (6, "none")], "qid int, phrase string")
    accepted = want.join(own, "phrase").select("qid", "entry")
    found = S.evaluate(S.positions(S.tiered(asked, own)), accepted, asked)
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


MRR_SQL = f"""
WITH {TIERED_SQL}, want(qid, phrase) AS (VALUES (1, 'red ring'), (2, 'red ring'), (3, 'red widget'), (4, 'small gear'), (5, 'blue bolt'), (6, 'none')),
pos AS (SELECT qid, entry, row_number() OVER (PARTITION BY qid ORDER BY CASE tier WHEN 'exact' THEN 0 WHEN 'same_concept' THEN 1 WHEN 'specialization' THEN 2 ELSE 3 END, rank, entry) AS p FROM hits),
best AS (SELECT qid, min(p) AS b FROM pos JOIN ent USING (entry) JOIN want USING (qid, phrase) WHERE p <= 10 GROUP BY qid)
SELECT round(avg(coalesce(1 / b, 0)), 6) AS mrr, round(avg(CASE WHEN b = 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN qid IN (SELECT qid FROM pos) THEN 0.0 ELSE 1 END), 6) AS dead FROM want LEFT JOIN best USING (qid)
"""


def relation_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-27: labelled pairs by analogy: all pairs of parts by return flag, links from other orders."""
    edges = graphs.edges(spark, sf_dir)
    pairs = edges.select(F.col("kind").alias("group"), F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    links = edges.filter("status = 'accepted' and kind = 'implication'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return S.relation_rates(pairs, links).withColumn("rate", F.round("rate", 6))


JUDGMENTS_ASKED = ((1, "red_ring"), (2, "smallGear"), (3, "brand 11"), (4, "re"))


def judgment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-05, A-19, V-12, V-13; a judgment's hash stands for its statement."""
    own = graphs.judgments(spark, sf_dir).withColumnRenamed("hash", "statement")
    return S.judgment_search(list(JUDGMENTS_ASKED), own, graphs.edges(spark, sf_dir)).withColumn("score", F.round("score", 6))


JUDGED_SQL = f"""
WITH {graphs.EDGES_SQL}, {graphs.JUDGMENTS_SQL}, q(qid, raw, toks) AS (VALUES (1, 'red_ring', ['red', 'ring']), (2, 'smallgear', ['small', 'gear']), (3, 'brand 11', ['brand', '11']), (4, 're', ['re'])),
m AS (SELECT qid, id, name, string_split(name, '_') AS w, toks, raw, lower(hash || ' ' || array_to_string(context, ' ')) AS hay, lower(name) = raw OR lower(hash) = raw AS ex FROM j, q),
s AS (SELECT *, CASE WHEN len(list_filter(toks, lambda t: len(list_filter(w, lambda x: starts_with(x, t))) > 0)) = len(toks) THEN 0.5 * least(1, len(toks) / len(w)) + 0.5 * len(list_filter(toks, lambda t: list_contains(w, t))) / len(toks)
  WHEN contains(lower(name), raw) THEN 0.1 END AS ns, CASE WHEN len(list_filter(toks, lambda t: contains(hay, t))) = len(toks) THEN 1 / (1 + length(hay) / 120) END AS ss FROM m),
h AS (SELECT qid, id AS entry, name, CASE WHEN ex THEN 'exact' WHEN ns IS NOT NULL THEN 'name' ELSE 'statement' END AS tier, CASE WHEN ex THEN 1.0 ELSE coalesce(ns, ss) END AS score FROM s WHERE ex OR ns IS NOT NULL OR ss IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, tier ORDER BY score DESC, name, entry) AS n FROM h),
an AS (SELECT DISTINCT qid, entry FROM r WHERE tier = 'exact' OR n <= 5),
both_ AS (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
f AS (SELECT qid, b AS entry, count(*) AS fan FROM an JOIN both_ ON a = an.entry WHERE (qid, b) NOT IN (SELECT qid, entry FROM h) GROUP BY ALL),
c AS (SELECT f.qid, f.entry, fan / n AS score FROM f JOIN (SELECT qid, count(*) AS n FROM an GROUP BY qid) USING (qid) QUALIFY row_number() OVER (PARTITION BY f.qid ORDER BY fan / n DESC, f.entry) <= 5)
SELECT qid, tier, entry, round(score, 6) AS score FROM r WHERE n <= 5 UNION ALL SELECT qid, 'connected', entry, round(score, 6) FROM c
"""


def name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-12, T-27."""
    own = graphs.judgments(spark, sf_dir)
    return own.select("id", F.round(S.name_score(F.col("name"), F.array(F.lit("re")), F.lit("re")), 6).alias("score")).filter("score is not null")


QUERIES = {f.__name__: f for f in (idf_index, entry_idf_mass, spelling_correction, tiered_search, phrase_search, search_mrr, relation_recall, judgment_search, name_scores)}

ORACLES = {
    "idf_index": f"WITH {ENTRIES_SQL} SELECT token, df, round(idf, 6) AS idf FROM wt",
    "entry_idf_mass": f"WITH {ENTRIES_SQL} SELECT entry, form, n_tokens, round(mass, 6) AS mass FROM mass",
    "spelling_correction": CORRECT_SQL,
    "tiered_search": f"""WITH {TIERED_SQL}, rel AS (SELECT qid, target AS entry, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, target) AS rank FROM anchor JOIN nr USING (source) WHERE (qid, target) NOT IN (SELECT qid, entry FROM hits) QUALIFY rank <= 5)
      SELECT qid, tier, rank, entry, round(score, 6) AS score FROM hits UNION ALL SELECT qid, 'related', rank, entry, round(score, 6) FROM rel""",
    "phrase_search": PHRASE_SQL,
    "search_mrr": MRR_SQL,
    "relation_recall": f"""WITH {graphs.EDGES_SQL}, p AS (SELECT DISTINCT kind AS g, src AS a, dst AS b FROM edges), l AS (SELECT src AS a, dst AS b FROM edges WHERE status = 'accepted' AND kind = 'implication'), b AS (SELECT a, b FROM l UNION SELECT b, a FROM l)
      SELECT g AS group, count(*) AS pairs, count(b.a) AS connected, round(avg(CASE WHEN b.a IS NULL THEN 0.0 ELSE 1 END), 6) AS rate FROM p LEFT JOIN b ON p.a = b.a AND p.b = b.b GROUP BY g""".replace("AS group", 'AS "group"'),
    "judgment_search": JUDGED_SQL,
    "name_scores": """WITH n AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS w, p_name FROM part)
      SELECT id, round(CASE WHEN len(list_filter(w, lambda x: starts_with(x, 're'))) > 0 THEN 0.5 / len(w) + CASE WHEN list_contains(w, 're') THEN 0.5 ELSE 0 END ELSE 0.1 END, 6) AS score FROM n WHERE contains(replace(p_name, ' ', '_'), 're')""",
}
