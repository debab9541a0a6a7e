"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, chat, exact_dedup, html_text, licenses, line_templates, pii, quality, simhash, winnow

#: The vocabulary of byte-level BPE.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str = RANKS) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(docs, ranks_path)


def bpe_digests(docs: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    coded = bpe.encode_decode(docs.select("doc_id", "text"), ranks_path, public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = exact_dedup.group_copies(docs)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)
         AND points = max(points) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM t
"""


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in pii.BASE], F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.with_main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_score(docs, machine)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.with_licenses(table(spark, sf_dir, "documents"))
    spans = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["stop"].cast("string")))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"])))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_notices"), F.array_join(names, ",").alias("licenses"), F.array_join(spans, ",").alias("spans"))


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.without_recurring(docs).select("doc_id", "n_lines", "n_dropped", "text")


#: The rules of the operator on lists of tokens; an empty string stands for a variable place.
OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT rid, unnest(range(1, len(ls) + 1)) AS place, unnest(ls) AS line FROM d),
t AS (SELECT rid, place, list_filter(regexp_split_to_array(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
k AS (SELECT rid, place, w, len(w) AS n, w[1:{line_templates.DEPTH}] AS head, CASE WHEN len(w) >= {line_templates.LONG} THEN 2 ELSE {line_templates.MIN_DOCS} END AS least FROM t WHERE len(w) > 0),
leaf AS (SELECT n, head FROM k GROUP BY n, head, least HAVING count(DISTINCT rid) >= least),
ln AS (SELECT n, head, least, w, count(DISTINCT rid) AS docs FROM k SEMI JOIN leaf USING (n, head) GROUP BY ALL),
tok AS (SELECT n, head, least, w, docs, unnest(range(1, n + 1)) AS p, unnest(w) AS x FROM ln),
com AS (SELECT n, head, p, x, TRUE AS common FROM tok WHERE x <> '<*>' GROUP BY n, head, least, p, x HAVING sum(docs) >= least),
sh AS (SELECT n, head, least, w, list(CASE WHEN common THEN x ELSE '' END ORDER BY p) AS shape FROM tok LEFT JOIN com USING (n, head, p, x) GROUP BY n, head, least, w HAVING avg(CASE WHEN common THEN 1.0::DOUBLE ELSE 0 END) >= {line_templates.CONSTANT}::DOUBLE),
good AS (SELECT n, head, shape FROM sh JOIN k USING (n, head, w) GROUP BY n, head, sh.least, shape HAVING count(DISTINCT rid) >= sh.least),
gone AS (SELECT rid, list(place) AS g FROM k SEMI JOIN (SELECT w FROM sh SEMI JOIN good USING (n, head, shape)) USING (w) GROUP BY rid)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_dropped,
       CASE WHEN g IS NULL THEN text ELSE array_to_string([ls[i] for i in range(1, len(ls) + 1) if NOT list_contains(g, i)], chr(10)) END AS text
FROM d LEFT JOIN gone USING (rid)
"""


def op8_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        winnow.contaminated().alias("contaminated"),
    )


OP8_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
items AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
doc_windows AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM item_windows))),
hits AS (SELECT rid, i, n, item FROM doc_windows JOIN item_windows USING (n, gram)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
named AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""


#: The text of the conversation that op9 formats beside the table's own; it comes as a JSON record of another layout.
CONTROL = r"\### Assistant: </turn> ok"
RECORD = json.dumps({"id": "control", "data": {"conversations": [{"from": "user", "value": CONTROL}, {"from": "assistant", "value": CONTROL}]}})


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(RECORD).alias("record"))
    turns = chat.canonical_turns(chat.gathered(own), keep=("conv_id",)).union(chat.canonical_turns_json(extra, "record", keep=("conv_id",)).select("conv_id", "turns"))
    out = chat.formatted(turns).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("back"), chat.learned(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + 15 AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_pii": op3_pii,
    "op4_html_text": op4_html_text,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_licenses": op7_licenses,
    "op8_winnow": op8_winnow,
    "op9_chat": op9_chat,
    "op10_line_templates": op10_line_templates,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": OP2_SQL,
    "op8_winnow": OP8_SQL,
    "op9_chat": OP9_SQL,
    "op10_line_templates": OP10_SQL,
}
