"""Keyphrases, concentration, entity resolution, co-occurrence and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cooccurrence as C
from ..operators import keyphrases as K
from ..plans.stages import written
from ..session import table

_STOP = ", ".join(f"'{w}'" for w in (*T.STOP_WORDS, *T.CONNECTIVE_WORDS))
#: Phrases of documents in SQL: (doc, at, phrase).
PHRASES_SQL = rf"""
segs AS (SELECT doc_id AS doc, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}\s\p{{Z}}\-]+')) AS s FROM documents),
marked AS (SELECT doc, array_to_string(list_transform(regexp_split_to_array(s, '[\s\p{{Z}}]+'), lambda w:
    CASE WHEN regexp_matches(w, '^[\p{{L}}\p{{N}}]') AND regexp_matches(w, '[\p{{L}}\p{{N}}]$') AND regexp_matches(w, '\p{{L}}.*\p{{L}}') AND w NOT IN ({_STOP}) THEN w ELSE '|' END), ' ') AS m FROM segs),
runs AS (SELECT doc, trim(unnest(string_split(m, '|'))) AS phrase FROM marked),
phrases AS (SELECT doc, phrase FROM runs WHERE phrase <> '' AND len(string_split(phrase, ' ')) <= 6)
"""
RAKE_SQL = f"""
{PHRASES_SQL},
words AS (SELECT doc, len(string_split(phrase, ' ')) AS n, unnest(string_split(phrase, ' ')) AS word FROM phrases),
ratio AS (SELECT doc, word, sum(n) / count(*) AS ratio FROM words GROUP BY ALL),
parts AS (SELECT doc, phrase, unnest(string_split(phrase, ' ')) AS word FROM (SELECT DISTINCT doc, phrase FROM phrases)),
scores AS (SELECT doc, phrase, sum(ratio) AS score FROM parts JOIN ratio USING (doc, word) GROUP BY ALL)
"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.rake_scores(table(spark, sf_dir, "documents"), "doc_id", "text")


def phrase_doc_freq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-04, T-06, A-04, O-02: the hundred phrases of most documents."""
    rows = K.phrase_rows(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.groupBy("phrase").agg(F.count(F.lit(1)).alias("doc_freq")).orderBy(F.desc("doc_freq"), "phrase").limit(100)


def rake_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select(F.col("doc").alias("doc_id"), "phrase", F.round("score", 6).alias("score"))


def phrase_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.accumulate(_scores(spark, sf_dir))
    return found.select("phrase", "word_count", "doc_freq", F.round("mean_score", 9).alias("mean_score"), F.array_join(F.transform("sample_ids", lambda x: x.cast("string")), ",").alias("sample_ids"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("label"))


def field_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.field_prior(_labels(spark, sf_dir), "doc", "label")
    return found.select("label", F.round("mass", 6).alias("mass"), F.round("prior", 6).alias("prior"))


def field_concentration_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    links = K.phrase_rows(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = K.field_concentration(links, labels, K.field_prior(labels, "doc", "label"))
    return found.select("phrase", "labelled", F.round("concentration", 6).alias("concentration"))


def _fold_sql(x: str) -> str:
    out = f"translate(lower({x}), '{T.ACCENTED}', '{T.PLAIN}')"
    for a, b in T.LIGATURES:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _singular_sql(w: str) -> str:
    kept = ", ".join(f"'{x}'" for x in T.INVARIANT)
    return f"""CASE WHEN {w} IN ({kept}) OR length({w}) <= 3 THEN {w}
      WHEN {w} LIKE '%sses' THEN left({w}, length({w}) - 2)
      WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y'
      WHEN regexp_matches({w}, '(ches|shes|xes|zes)$') THEN left({w}, length({w}) - 2)
      WHEN {w} LIKE '%ss' OR {w} LIKE '%us' OR {w} LIKE '%is' THEN {w}
      WHEN {w} LIKE '%s' THEN left({w}, length({w}) - 1) ELSE {w} END"""


def _umlaut_sql(w: str) -> str:
    for a, b in T.UMLAUT_SUFFIXES:
        w = f"regexp_replace({w}, '{a}$', '{b}')"
    return w


KEY_SQL = f"array_to_string(list_transform(list_transform(list_filter(regexp_split_to_array({_fold_sql('phrase')}, '[\\s\\-_/]+'), lambda w: w <> ''), lambda w: {_umlaut_sql('w')}), lambda w: {_singular_sql('w')}), ' ')"


def boilerplate_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-07: the phrases of the documents and of the list of stock phrases that the filter drops."""
    found = field_concentration_kl(spark, sf_dir).select("phrase", "concentration")
    stock = spark.createDataFrame([(p,) for p in K.REGISTER_PHRASES], "phrase string").withColumn("concentration", F.lit(None).cast("double"))
    return K.boilerplate(found.union(stock), 0.01).select("phrase").distinct()


def _phrase_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.phrase_rows(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("phrase").agg(F.count(F.lit(1)).alias("doc_freq"))


def canonical_key_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-09..T-12, K-13: groups of phrase variants."""
    keyed = _phrase_freq(spark, sf_dir).withColumn("key", T.canonical_key(F.col("phrase")))
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("variants"), F.sum("doc_freq").alias("doc_freq"), F.array_join(F.array_sort(F.collect_list("phrase")), ",").alias("phrases"))
    return groups.filter("variants > 1")


def representative_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-03: the phrase that stands for a group."""
    keyed = _phrase_freq(spark, sf_dir).withColumn("key", T.canonical_key(F.col("phrase")))
    return C.last_per(keyed, ["key"], [F.desc("doc_freq"), F.length("phrase"), F.col("phrase")]).select("key", F.col("phrase").alias("representative"), "doc_freq")


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.incidence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


PAIRS_SQL = """
inc AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS x FROM lineitem),
pairs AS (SELECT a.x AS i, b.x AS j, count(*) AS n FROM inc a JOIN inc b ON a.g = b.g AND a.x < b.x GROUP BY ALL HAVING count(*) >= 2)
"""
PPMI_SQL = f"""
{PAIRS_SQL},
rs AS (SELECT x, sum(n) AS r FROM (SELECT i AS x, n FROM pairs UNION ALL SELECT j, n FROM pairs) GROUP BY x),
p AS (SELECT x, pow(r, 0.75) / sum(pow(r, 0.75)) OVER () AS p, sum(r) OVER () AS total FROM rs),
ppmi AS (SELECT * FROM (SELECT i, j, ln(n / a.total / (a.p * b.p)) AS w FROM pairs JOIN p a ON a.x = i JOIN p b ON b.x = j) WHERE w > 0)
"""


def cooccur_pairs_min_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pairs(_baskets(spark, sf_dir), 2)


def cooccur_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    inc = _baskets(spark, sf_dir)
    return C.jaccard(C.pairs(inc, 2), inc).select("i", "j", "n", F.round("jaccard", 6).alias("jaccard"))


def cooccur_ppmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ppmi(C.pairs(_baskets(spark, sf_dir), 2)).select("i", "j", F.round("w", 6).alias("w"))


def weeds_invcl_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = written(C.ppmi(C.pairs(_baskets(spark, sf_dir), 2)), "weights")
    found = C.classify(C.inclusion(C.symmetric(weights), weights))
    return found.select("subject", "object", "kind", F.round("confidence", 6).alias("confidence"))


CLASSIFY_SQL = f"""
WITH {PPMI_SQL},
adj AS (SELECT i AS u, j AS k, w FROM ppmi UNION ALL SELECT j, i, w FROM ppmi),
tot AS (SELECT u, sum(w) AS t FROM adj GROUP BY u),
sh AS (SELECT c.i, c.j, sum(a.w) AS si, sum(b.w) AS sj FROM ppmi c JOIN adj a ON a.u = c.i JOIN adj b ON b.u = c.j AND b.k = a.k GROUP BY ALL),
inc2 AS (SELECT c.i, c.j, coalesce(si / a.t, 0) AS p, coalesce(sj / b.t, 0) AS q FROM ppmi c LEFT JOIN sh USING (i, j) JOIN tot a ON a.u = c.i JOIN tot b ON b.u = c.j),
x AS (SELECT *, sqrt(greatest(0, p * (1 - q))) AS a, sqrt(greatest(0, q * (1 - p))) AS b, p >= 0.85 AND q >= 0.85 AS same FROM inc2),
y AS (SELECT *, a >= 0.35 AND a - b >= 0.12 AS down, b >= 0.35 AND b - a >= 0.12 AS up FROM x)
SELECT CASE WHEN NOT same AND NOT down AND up THEN j ELSE i END AS subject, CASE WHEN NOT same AND NOT down AND up THEN i ELSE j END AS object,
  CASE WHEN same THEN 'equivalent_to' ELSE 'specialization_of' END AS kind, round(CASE WHEN same THEN least(p, q) WHEN down THEN a ELSE b END, 6) AS confidence
FROM y WHERE same OR down OR up
"""


def _relation_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Statistical and textual relations by analogy: lineitem by return flag, and by line status."""
    lines = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linestatus") == "O", "specialization_of").otherwise("equivalent_to")
    statistical = lines.filter("l_returnflag = 'R'").groupBy((F.col("l_partkey") % 50).alias("subject"), F.col("l_suppkey").alias("object"), kind.alias("kind")).agg((F.count(F.lit(1)) / 100).alias("confidence"))
    textual = lines.filter("l_returnflag = 'A'").select((F.col("l_suppkey") % 50).alias("subject"), (F.col("l_partkey") % 100).alias("object"), kind.alias("kind"), F.col("l_orderkey").alias("doc"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sentence"))
    return statistical, textual


RELATIONS_SQL = """
l AS (SELECT *, CASE WHEN l_linestatus = 'O' THEN 'specialization_of' ELSE 'equivalent_to' END AS kind FROM lineitem),
st AS (SELECT l_partkey % 50 AS subject, l_suppkey AS object, kind, count(*) / 100 AS confidence FROM l WHERE l_returnflag = 'R' GROUP BY ALL),
tx AS (SELECT l_suppkey % 50 AS subject, l_partkey % 100 AS object, kind, l_orderkey AS doc, l_orderkey || '-' || l_linenumber AS sentence FROM l WHERE l_returnflag = 'A'),
best AS (SELECT subject, object, kind, arg_min(doc, (doc, sentence)) AS doc, arg_min(sentence, (doc, sentence)) AS sentence FROM tx GROUP BY ALL),
merged AS (SELECT subject, object, kind, CASE WHEN best.doc IS NULL THEN 'proposed' WHEN st.confidence IS NULL THEN 'grounded' ELSE 'confirmed' END AS status,
  coalesce(confidence, 1.0) AS confidence, sentence AS evidence_sentence, doc AS evidence_doc FROM st FULL JOIN best USING (subject, object, kind))
"""


def relation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merge_relations(*_relation_sources(spark, sf_dir))


def cycle_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.without_contradictions(C.merge_relations(*_relation_sources(spark, sf_dir))).select("subject", "object", "kind", "status")


def relations_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-03, K-14: confirmed and grounded relations, ranked."""
    merged = C.merge_relations(*_relation_sources(spark, sf_dir)).filter("status <> 'proposed'")
    return C.rank_relations(merged).select("subject", "object", "kind", "status", "confidence", "status_rank")


def msc_ngram_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-14: document phrases grounded in a code list; the benchmark items stand for codes."""
    codes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("position"), F.concat(F.lit("B"), F.col("item_id")).alias("code"), F.col("text").alias("name"))
    phrases = K.phrase_rows(table(spark, sf_dir, "documents"), "doc_id", "text").select("phrase").distinct()
    return K.ground(phrases, codes).filter("code is not null")


GROUND_SQL = rf"""
WITH {PHRASES_SQL},
w AS (SELECT item_id, 'B' || item_id AS code, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}\-]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT item_id, code, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS n))),
idx AS (SELECT gram, arg_min(code, (item_id, code)) AS code FROM g GROUP BY gram),
p AS (SELECT DISTINCT phrase, CASE WHEN phrase LIKE '%s' THEN left(phrase, length(phrase) - 1) ELSE phrase || 's' END AS other FROM phrases)
SELECT phrase, coalesce(a.code, b.code) AS code FROM p LEFT JOIN idx a ON a.gram = phrase LEFT JOIN idx b ON b.gram = other WHERE coalesce(a.code, b.code) IS NOT NULL
"""

KL_SQL = f"""{PHRASES_SQL},
      prior AS (SELECT source AS label, count(*) / sum(count(*)) OVER () AS q FROM documents GROUP BY source),
      links AS (SELECT DISTINCT doc, phrase, source AS label FROM phrases JOIN documents ON doc = doc_id),
      tot AS (SELECT phrase, count(*) AS labelled FROM links GROUP BY phrase HAVING count(*) >= 50),
      dense AS (SELECT t.phrase, t.labelled, q, (SELECT count(*) FROM links l WHERE l.phrase = t.phrase AND l.label = p.label) AS c FROM tot t, prior p),
      pr AS (SELECT *, (c + 10 * q) / (labelled + 10) AS p FROM dense),
      kl AS (SELECT phrase, labelled, sum(p * ln(p / q)) AS concentration FROM pr GROUP BY ALL)"""
_REGISTER = ", ".join(f"'{p}'" for p in K.REGISTER_PHRASES)

QUERIES = {
    "phrase_doc_freq_topk": phrase_doc_freq_topk,
    "rake_scores": rake_scores,
    "phrase_candidates": phrase_candidates,
    "field_prior": field_prior,
    "field_concentration_kl": field_concentration_kl,
    "boilerplate_phrases": boilerplate_phrases,
    "canonical_key_groups": canonical_key_groups,
    "representative_choice": representative_choice,
    "msc_ngram_grounding": msc_ngram_grounding,
    "cooccur_pairs_min_support": cooccur_pairs_min_support,
    "cooccur_jaccard": cooccur_jaccard,
    "cooccur_ppmi": cooccur_ppmi,
    "weeds_invcl_classify": weeds_invcl_classify,
    "relation_merge": relation_merge,
    "cycle_removal": cycle_removal,
    "relations_ranked": relations_ranked,
}

ORACLES = {
    "phrase_doc_freq_topk": f"WITH {PHRASES_SQL} SELECT phrase, count(DISTINCT doc) AS doc_freq FROM phrases GROUP BY phrase ORDER BY doc_freq DESC, phrase LIMIT 100",
    "rake_scores": f"WITH {RAKE_SQL} SELECT doc AS doc_id, phrase, round(score, 6) AS score FROM scores",
    "phrase_candidates": f"""WITH {RAKE_SQL} SELECT phrase, len(string_split(phrase, ' ')) AS word_count, count(*) AS doc_freq, round(avg(score), 9) AS mean_score,
      array_to_string(list_sort(list(doc))[1:3], ',') AS sample_ids FROM scores GROUP BY phrase HAVING count(*) >= 3""",
    "field_prior": "SELECT source AS label, count(*)::DOUBLE AS mass, round(count(*) / sum(count(*)) OVER (), 6) AS prior FROM documents GROUP BY source",
    "field_concentration_kl": f"WITH {KL_SQL} SELECT phrase, labelled, round(concentration, 6) AS concentration FROM kl",
    "boilerplate_phrases": f"WITH {KL_SQL} SELECT phrase FROM kl WHERE round(concentration, 6) < 0.01 UNION SELECT unnest([{_REGISTER}])",
    "canonical_key_groups": f"""WITH {PHRASES_SQL}, f AS (SELECT phrase, count(DISTINCT doc) AS doc_freq FROM phrases GROUP BY phrase), k AS (SELECT *, {KEY_SQL} AS key FROM f)
      SELECT key, count(*) AS variants, sum(doc_freq)::BIGINT AS doc_freq, string_agg(phrase, ',' ORDER BY phrase) AS phrases FROM k GROUP BY key HAVING count(*) > 1""",
    "representative_choice": f"""WITH {PHRASES_SQL}, f AS (SELECT phrase, count(DISTINCT doc) AS doc_freq FROM phrases GROUP BY phrase), k AS (SELECT *, {KEY_SQL} AS key FROM f)
      SELECT key, phrase AS representative, doc_freq FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_freq DESC, length(phrase), phrase) = 1""",
    "msc_ngram_grounding": GROUND_SQL,
    "cooccur_pairs_min_support": f"WITH {PAIRS_SQL} SELECT * FROM pairs",
    "cooccur_jaccard": f"WITH {PAIRS_SQL}, df AS (SELECT x, count(*) AS d FROM inc GROUP BY x) SELECT i, j, n, round(n / (a.d + b.d - n), 6) AS jaccard FROM pairs JOIN df a ON a.x = i JOIN df b ON b.x = j",
    "cooccur_ppmi": f"WITH {PPMI_SQL} SELECT i, j, round(w, 6) AS w FROM ppmi",
    "weeds_invcl_classify": CLASSIFY_SQL,
    "relation_merge": f"WITH {RELATIONS_SQL} SELECT * FROM merged",
    "cycle_removal": f"""WITH {RELATIONS_SQL}, m AS MATERIALIZED (SELECT subject, object, kind, status FROM merged), back AS (SELECT DISTINCT object AS s, subject AS o FROM m WHERE kind = 'specialization_of')
      SELECT subject, object, kind, status FROM m LEFT JOIN back ON s = subject AND o = object AND kind = 'specialization_of' WHERE s IS NULL""",
    "relations_ranked": f"WITH {RELATIONS_SQL} SELECT subject, object, kind, status, confidence, CASE status WHEN 'confirmed' THEN 1 ELSE 2 END AS status_rank FROM merged WHERE status <> 'proposed'",
}
