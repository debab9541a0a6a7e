"""Parsers and text functions on sources built from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import hearst, search
from ..sources import expressions, latex, lean, readers
from ..session import table


def _tex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper of ten benchmark items each: a lemma for each item, proved by the one before and citing a neighbour paper."""
    own = table(spark, sf_dir, "benchmark").select("item_id", F.expr("item_id div 10").alias("paper"), F.expr("item_id % 10").alias("n"))
    part = F.concat(
        F.when(F.col("n") % 3 == 2, F.lit("\\begin{remark}\\label{r")).otherwise(F.lit("\\begin{lemma}\\label{t")), F.col("item_id"), F.lit("} item \\x{"), F.col("item_id"), F.lit("} % note \\ref{t0}\n"),
        F.when(F.col("n") % 3 == 2, F.lit("\\end{remark}\n")).otherwise(F.concat(F.lit("\\end{lemma}\n\\begin{proof} by \\ref{t"), F.col("item_id") - 1, F.lit("} and \\cite{k"), F.col("n"), F.lit("} \\end{proof}\n"))),
    )
    body = own.groupBy("paper").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("p")))), lambda x: x["p"]), "").alias("body"))
    entry = F.concat(F.lit("\\bibitem{k0} A, arXiv:2001."), F.lpad((F.col("paper") + 1).cast("string"), 5, "0"), F.lit(". \\bibitem{k1} B, no id. \\bibitem{k3} C, arXiv: math/0101"), F.lpad(F.col("paper").cast("string"), 3, "0"), F.lit("\n"))
    return body.select(F.concat(F.lit("2001."), F.lpad(F.col("paper").cast("string"), 5, "0")).alias("paper"), F.concat(F.lit("\\newcommand{\\x}[1]{<#1>}\\begin{document}\n"), "body", F.lit("\\begin{thebibliography}{9} "), entry, F.lit("\\end{thebibliography}\\end{document}")).alias("tex"))


_PAPER = "'2001.' || lpad((item_id // 10)::VARCHAR, 5, '0')"


def latex_theorems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-08..P-12, W-05."""
    found = latex.parsed(_tex(spark, sf_dir), "paper", "tex")
    return found.select("paper", "order", "kind", "label", "has_proof", "proof_match", F.array_join("depends", ",").alias("depends"), F.array_join("cites", ",").alias("cites"), "statement")


def theorem_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-06: references that hit and how many miss, by paper."""
    hit, missed = latex.dependencies(latex.parsed(_tex(spark, sf_dir), "paper", "tex"))
    return hit.groupBy("paper").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("hit")).union(missed.groupBy("paper").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("missed")))


def bibitem_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-11, T-33."""
    return latex.bibliography(_tex(spark, sf_dir), "paper", "tex").select("paper", "key", "cited")


def citation_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-07."""
    tex = _tex(spark, sf_dir)
    return latex.citations(latex.parsed(tex, "paper", "tex"), latex.bibliography(tex, "paper", "tex"), tex)


def _lean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part brand: a declaration for each of its parts that uses the one before."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("path"))
    numbered = parts.selectExpr("path", "p_partkey AS k", "lag(p_partkey) OVER (PARTITION BY path ORDER BY p_partkey) AS b")
    word = F.when(F.col("k") % 3 == 0, "def").when(F.col("k") % 3 == 1, "theorem").otherwise("lemma")
    line = F.concat(word, F.lit(" p"), F.col("k"), F.lit(" (h : A"), F.col("k"), F.lit(") {n : Nat} : x"), F.col("k") % 4, F.lit(" + n = n := by\n  exact p"), F.coalesce("b", F.lit(0)), F.lit(" h -- not p1\n/- nor p2 /- p3 -/ -/\n"))
    return numbered.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("l")))), lambda x: x["l"]), "").alias("value"))


def lean_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-04, P-05, S-09."""
    found = lean.parsed(_lean(spark, sf_dir))
    return found.select("path", "order", "kind", "name", F.array_join("context", ";").alias("context"), "statement", "status", "line")


def lean_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-06, P-07."""
    return lean.dependencies(lean.parsed(_lean(spark, sf_dir)))


def expression_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-01..P-03 on formulas built from part keys."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("∀ (v"), k, F.lit(" : Nat), v"), k, F.lit(" + "), k % 7, F.lit(" * c ^ 2 ≤ f v"), k, F.lit(" → P -> Q"))
    found = expressions.parsed(table(spark, sf_dir, "part").select("p_partkey", text.alias("t")), "t", ("p_partkey",))
    return found.select("p_partkey", "display", "canonical", "status")


def equal_up_to_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-02, J-02: classes of formulas that differ in bound names only."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("λ v"), k, F.lit(", v"), k, F.lit(" + "), k % 7)
    found = expressions.parsed(table(spark, sf_dir, "part").select("p_partkey", text.alias("t")), "t", ("p_partkey",))
    return found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first")).select("n", "first")


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-11 by analogy: the targets of each page's links."""
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


def code_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-06, S-07: codes of all four shapes from brand numbers."""
    n = F.lpad(F.regexp_extract("p_brand", "[0-9]+", 0), 2, "0")
    codes = table(spark, sf_dir, "part").select(n.alias("n")).distinct().select(F.explode(F.array(F.concat("n", F.lit("-XX")), F.concat("n", F.lit("Axx")), F.concat("n", F.lit("-01")), F.concat("n", F.lit("A34")))).alias("code"))
    return readers.classified(codes)


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-01, T-03, T-15, T-16, T-27, T-30, T-32, S-04 on the parts' texts."""
    p = table(spark, sf_dir, "part")
    built = F.concat("p_name", F.lit(" math.AG/"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.lit(" \\alpha of (1"), F.col("p_size") + 900, F.lit(") the"))
    return p.select(
        "p_partkey",
        T.squeeze(T.strip_tex_commands(T.strip_old_ids(built))).alias("stripped"),
        T.glue(built).alias("glued"),
        T.strip_article(F.col("p_name")).alias("plain"),
        T.ref_kind(F.concat(F.lit("judgment:"), "p_partkey")).alias("kind"),
        F.array_join(T.identifier_tokens(F.concat(F.initcap("p_brand"), F.lit("OfPart2x"))), ",").alias("tokens"),
        F.array_join(T.author_list(F.concat("p_name", F.lit(" and "), "p_type", F.lit(", X"))), ";").alias("authors"),
    )


def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-15: answers built from events; small and large model by event number."""
    word = F.when(F.col("event_type") == "error", "incorrect").when(F.col("event_type") == "click", "correct").when(F.col("event_type") == "purchase", "Correct").otherwise("maybe")
    text = F.concat(F.lit('thinking {"verdict": "malformed"} then {"verdict": "'), word, F.lit('", "n": '), "event_id", F.lit("} end"))
    found = readers.verdicts(table(spark, sf_dir, "events").select("event_id", text.alias("answer")), "answer")
    return found.select("event_id", "verdict", readers.cascade(F.col("verdict"), F.when(F.col("event_id") % 2 == 0, "correct")).alias("final"))


def context_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-10: orders whose parts' types include those of order 1, with their counts."""
    types = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("p_type")).alias("types"))
    small = types.orderBy("l_orderkey").limit(1).select(F.slice("types", 1, 2).alias("small"))
    return types.join(F.broadcast(small), G.within(F.col("small"), F.col("types"))).select("l_orderkey", F.array_join("types", ",").alias("types"))


def hearst_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-04: sentences about part names built from parts; the names are the known phrases."""
    p = table(spark, sf_dir, "part")
    links = F.array(*[F.lit(x) for x in (" is a special case of ", ", such as ", " is equivalent to the ", " and also ", " is a ")])
    text = F.concat(F.lit("Then. Here "), "p_name", F.get(links, (F.col("p_partkey") % 5).cast("int")), F.lit("old anvil. After"))
    return hearst.hits(p.select(F.col("p_partkey").alias("doc"), text.alias("text")), "doc", "text", p.select(F.col("p_name").alias("phrase")))


def tex_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-29."""
    text = F.concat(F.lit(r"\\int_\\Omega |\\nabla u| \\leq "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", T.looks_like_tex(text).alias("tex"), T.looks_like_tex(F.col("p_name")).alias("plain"), F.array_join(T.tex_terms(text), " ").alias("terms"))


def statement_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-13, A-18."""
    p = table(spark, sf_dir, "part")
    statement = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " ∀ x").otherwise(" x"), F.when(F.col("p_partkey") % 3 == 0, " ∈ ℝ").otherwise(""))
    score = search.statement_score(statement, F.array(F.lit("red")), F.array(F.lit("∀"), F.lit("∈")), F.array(F.lit(1.0), F.lit(3.0)))
    return p.select("p_partkey", F.round(score, 6).alias("score"))


QUERIES = {f.__name__: f for f in (latex_theorems, theorem_dependencies, bibitem_ids, citation_resolution, lean_declarations, lean_dependencies, expression_forms, equal_up_to_names, html_links, code_levels, text_functions, verdict_parse, context_subset, hearst_hits, tex_query_terms, statement_scores)}

_LEAN_SQL = "f AS (SELECT p_brand AS path, p_partkey AS k, lag(p_partkey) OVER w AS b, row_number() OVER w - 1 AS o FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey))"
ORACLES = {
    "latex_theorems": f"""SELECT {_PAPER} AS paper, (item_id % 10)::INT AS "order", CASE WHEN item_id % 10 % 3 = 2 THEN 'remark' ELSE 'lemma' END AS kind, CASE WHEN item_id % 10 % 3 = 2 THEN 'r' ELSE 't' END || item_id AS label, item_id % 10 % 3 <> 2 AS has_proof,
      CASE WHEN item_id % 10 % 3 = 2 THEN 'none' ELSE 'adjacent' END AS proof_match, CASE WHEN item_id % 10 % 3 = 1 THEN 't' || (item_id - 1) ELSE '' END AS depends, CASE WHEN item_id % 10 % 3 = 2 THEN '' ELSE 'k' || (item_id % 10) END AS cites,
      '\\label{{' || CASE WHEN item_id % 10 % 3 = 2 THEN 'r' ELSE 't' END || item_id || '}} item <' || item_id || '>' AS statement FROM benchmark""",
    "theorem_dependencies": f"""SELECT {_PAPER} AS paper, count(*) AS n, 'hit' AS side FROM benchmark WHERE item_id % 10 % 3 = 1 GROUP BY 1""",
    "bibitem_ids": f"""WITH p AS (SELECT DISTINCT {_PAPER} AS paper, item_id // 10 AS n FROM benchmark) SELECT paper, 'k0' AS key, '2001.' || lpad((n + 1)::VARCHAR, 5, '0') AS cited FROM p UNION ALL SELECT paper, 'k1', NULL FROM p UNION ALL SELECT paper, 'k3', 'math/0101' || lpad(n::VARCHAR, 3, '0') FROM p""",
    "citation_resolution": f"""WITH p AS (SELECT DISTINCT {_PAPER} AS paper, item_id // 10 AS n FROM benchmark) SELECT a.paper AS src, b.paper AS dst FROM p a JOIN p b ON b.n = a.n + 1""",
    "lean_declarations": f"""WITH {_LEAN_SQL} SELECT path, o::INT AS "order", CASE WHEN k % 3 = 0 THEN 'definition' ELSE 'theorem' END AS kind, 'p' || k AS name, 'h : A' || k || ';n : Nat' AS context, 'x' || (k % 4) || ' + n = n' AS statement, 'full' AS status, (o * 3 + 1)::INT AS line FROM f""",
    "lean_dependencies": f"WITH {_LEAN_SQL} SELECT path, o::INT AS from_order, (o - 1)::INT AS to_order FROM f WHERE o > 0",
    "expression_forms": """SELECT p_partkey, '∀ (v' || p_partkey || ' : Nat), (((v' || p_partkey || ' + (' || (p_partkey % 7) || ' * (c ^ 2))) ≤ f v' || p_partkey || ') → (P → Q))' AS display,
      'P[C3:Nat;](C3:→ (C3:≤ (C1:+ #0 (C1:* L1:' || (p_partkey % 7) || ' (C1:^ C1:c L1:2))) (C1:f #0)) (C3:→ C1:P C1:Q))' AS canonical, 'full' AS status FROM part""",
    "equal_up_to_names": "SELECT count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_partkey % 7",
    "html_links": "SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY ALL",
    "code_levels": """WITH b AS (SELECT DISTINCT lpad(regexp_extract(p_brand, '[0-9]+'), 2, '0') AS n FROM part)
      SELECT n || '-XX' AS code, 'top' AS level, NULL AS parent, NULL AS section, n || '-XX' AS top FROM b UNION ALL SELECT n || 'Axx', 'section', n || '-XX', n || 'Axx', n || '-XX' FROM b UNION ALL SELECT n || '-01', 'special', n || '-XX', NULL, n || '-XX' FROM b UNION ALL SELECT n || 'A34', 'leaf', n || 'Axx', n || 'Axx', n || '-XX' FROM b""",
    "text_functions": """SELECT p_partkey, p_name || ' of (1' || (p_size + 900) || ') the' AS stripped, p_name || ' math ag ' || lpad(p_partkey::VARCHAR, 7, '0') || ' alpha of 1' || (p_size + 900) || ' the' AS glued, p_name AS plain, 'judgment' AS kind,
      'brand,' || regexp_extract(p_brand, '[0-9]+') || ',of,part,2,x' AS tokens, p_name || ';' || p_type || ';X' AS authors FROM part""",
    "verdict_parse": """WITH v AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'incorrect' WHEN 'click' THEN 'correct' WHEN 'purchase' THEN 'correct' ELSE 'malformed' END AS verdict FROM events)
      SELECT event_id, verdict, CASE WHEN verdict IN ('incorrect', 'malformed') THEN verdict WHEN event_id % 2 = 0 THEN 'correct' ELSE 'malformed' END AS final FROM v""",
    "context_subset": """WITH t AS (SELECT l_orderkey, list_sort(list(p_type)) AS types FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), s AS (SELECT types[1:2] AS s FROM t ORDER BY l_orderkey LIMIT 1)
      SELECT l_orderkey, array_to_string(types, ',') AS types FROM t, s WHERE len(list_filter(types, lambda x: x = s[1])) >= len(list_filter(s, lambda x: x = s[1])) AND (len(s) < 2 OR len(list_filter(types, lambda x: x = s[2])) >= len(list_filter(s, lambda x: x = s[2])))""",
    "hearst_hits": """WITH t AS (SELECT p_partkey AS k, p_name, [' is a special case of ', ', such as ', ' is equivalent to the ', ' and also ', ' is a '][p_partkey % 5 + 1] AS l FROM part)
      SELECT CASE WHEN k % 5 = 1 THEN 'old anvil' ELSE p_name END AS subject, CASE WHEN k % 5 = 1 THEN p_name ELSE 'old anvil' END AS object, CASE WHEN k % 5 = 2 THEN 'equivalent_to' ELSE 'specialization_of' END AS kind,
      'Here ' || p_name || l || 'old anvil.' AS sentence, k::VARCHAR AS doc FROM t WHERE k % 5 <> 3 AND EXISTS (SELECT 1 FROM part WHERE p_name = 'old anvil')""",
    "tex_query_terms": """SELECT p_partkey, TRUE AS tex, FALSE AS plain, '∫ ∇ ≤ integral gradient ' || p_name AS terms FROM part""",
    "statement_scores": """WITH s AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' ∀ x' ELSE ' x' END || CASE WHEN p_partkey % 3 = 0 THEN ' ∈ ℝ' ELSE '' END AS s,
      (CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 3.0 ELSE 0 END) / 4 AS c, contains(p_name, 'red') AS t FROM part)
      SELECT p_partkey, round(CASE WHEN t THEN (0.5 + 0.5 * c) / (1 + length(s) / 120) WHEN c > 0 THEN c / (1 + length(s) / 120) END, 6) AS score FROM s""",
}
