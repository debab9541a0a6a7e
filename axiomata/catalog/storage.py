"""Table rewrites, exports, and the relational and window operators beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lookups as L
from ..operators import sinks as K
from ..operators import vectors as V
from ..session import table
from ..streaming import events as E
from .spaces import KNN_SQL


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-01: the last state of each user, purchases merged into the other events, first time kept."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("event_id").alias("first_seen"))
    return K.upsert(rows.filter("event_type <> 'purchase'"), rows.filter("event_type = 'purchase'"), ["user_id"], "event_id", keep=("first_seen",))


def orphan_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-04."""
    return K.prune(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", table(spark, sf_dir, "labels").filter("quality = 1"))


def intern_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-05, S-14, T9: ids for (provider, revision) pairs with null revisions."""
    known = table(spark, sf_dir, "part").filter("p_brand = 'Brand#11'").groupBy("p_type", F.when(F.col("p_size") > 25, F.col("p_brand")).alias("revision")).agg(F.min("p_partkey").alias("id")).select("id", "p_type", "revision")
    values = table(spark, sf_dir, "part").select("p_type", F.when(F.col("p_size") > 25, F.col("p_brand")).alias("revision"))
    return K.intern(values, known, ["p_type", "revision"])


def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-07."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    return K.insert_or_ignore(rows.filter("l_returnflag = 'A'").drop("l_returnflag"), rows.filter("l_returnflag = 'R'").drop("l_returnflag"))


def anti_join_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-06: what a second load of the same keys adds: the keys that the first had not."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return rows.join(table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", "left_anti")


def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-08."""
    judgments = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("paper"))
    papers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper"))
    citations = table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 30).alias("dst"))
    out = K.graph_export(judgments, papers, citations)
    return out.select("paper", "judgment_count", F.array_join(F.transform("cites", lambda x: x.cast("string")), ",").alias("cites"), F.coalesce(F.array_join(F.transform("judgments", lambda x: F.concat_ws("=", x["id"].cast("string"), x["name"])), ";"), F.lit("")).alias("judgments"))


def taxonomy_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-09."""
    members = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("field"), F.col("p_brand").alias("cluster"), F.col("p_name").alias("phrase")).agg(F.count(F.lit(1)).alias("doc_freq"))
    out = K.taxonomy_export(members)
    return out.select("field", F.array_join(F.transform("clusters", lambda c: F.concat(c["cluster"], F.lit(":"), F.array_join(c["phrases"], ","))), ";").alias("clusters"))


def head_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-10."""
    entries = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("entry")).agg(F.count(F.lit(1)).alias("doc_freq"))
    return K.head_shard(entries)


def related_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-11, V-14."""
    pairs = V.nearest_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.35, 6)
    out = K.related_export(pairs.select(F.col("i").alias("source"), F.col("j").alias("target"), F.col("sim").alias("score")))
    return out.select("source", F.array_join(F.transform("related", lambda r: r["target"].cast("string")), ",").alias("related"))


def papers_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-12."""
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.concat(F.lit("Part "), F.col("l_partkey") % 97).alias("concept")).distinct()
    titles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"), F.concat(F.lit("On part "), F.col("o_custkey") % 97, F.lit(" and more")).alias("title"))
    return K.papers_export(links, titles)


def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-15..K-17: rows as JSON texts."""
    return K.json_lines(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-14: papers without a source, by a seeded order."""
    missing = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return missing.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(25)


def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-06: every tenth part by key, as the operator is defined."""
    return K.numbered(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], "n").filter("n % 10 = 0").orderBy("n").select("p_partkey").limit(50)


def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-12, F-01, O-01: the second page of fifty."""
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").offset(50).limit(50)


def incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-02: lines of one part, by optional flags."""
    return L.where(table(spark, sf_dir, "lineitem"), l_partkey=7, l_returnflag="A", l_linestatus=None).select("l_orderkey", "l_linenumber", "l_suppkey")


def adjacency_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-03: suppliers as what a part depends on, parts as what depends on a supplier."""
    return L.adjacent(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")), 7)


def equality_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-04: by name, and by the hash of a statement."""
    rows = table(spark, sf_dir, "part").withColumn("hash", F.sha2(F.concat_ws("/", "p_type", "p_size"), 256))
    asked = rows.filter("p_partkey = 7").select("hash")
    return L.where(rows, p_name="red ring").select("p_partkey", F.lit("name").alias("by")).union(rows.join(asked, "hash", "left_semi").select("p_partkey", F.lit("hash")))


def failed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-05: orders as attempts: of one target, of one pattern, of both."""
    rows = table(spark, sf_dir, "orders")
    asked = {"target": {"o_custkey": 7, "o_orderpriority": None}, "pattern": {"o_custkey": None, "o_orderpriority": "1-URGENT"}, "both": {"o_custkey": 7, "o_orderpriority": "1-URGENT"}}
    found = [L.where(rows, **equal).select("o_orderkey", F.lit(name).alias("by")) for name, equal in asked.items()]
    return found[0].union(found[1]).union(found[2])


def listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-13: the third page of a listing."""
    return L.listing(table(spark, sf_dir, "part"), ["p_partkey", "p_name"], ["p_name", "p_partkey"], page=2, size=20, p_type=None)


def labels_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-31: the field labels of documents by analogy: two categories for each, aliases among them."""
    names = F.array(*[F.lit(x) for x in ("math-ph", "math.MP", "cs.IT", "stat.TH", "cs.NA", "math.AG")])
    pair = F.array(F.get(names, (F.col("doc_id") % 6).cast("int")), F.get(names, (F.col("doc_id") % 5).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.field_labels(pair), ",").alias("labels"))


def refuted_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-06: customers with a counterexample, here an order of status F."""
    bad = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(bad, "c_custkey", "left_semi").select("c_custkey")


def prefix_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-08: distinct keys by prefix of a reference."""
    return table(spark, sf_dir, "customer").filter(F.col("c_name").startswith("Customer#00000000")).select("c_name").distinct()


def relation_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-11: each edge seen from both of its ends."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag").distinct()
    down, up = F.when(F.col("l_returnflag") == "N", "equivalent").otherwise("narrower"), F.when(F.col("l_returnflag") == "N", "equivalent").otherwise("broader")
    views = F.array(F.struct(F.col("l_partkey").alias("of"), F.col("l_suppkey").alias("other"), up.alias("view")), F.struct(F.col("l_suppkey").alias("of"), F.col("l_partkey").alias("other"), down.alias("view")))
    return rows.select(F.explode(views).alias("v")).select("v.*")


def hydrate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-10, J-02: ordered lists of ids with their names."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("items"))
    at = lists.select("l_orderkey", F.posexplode("items").alias("at", "item")).select("l_orderkey", "at", F.col("item.l_partkey").alias("p_partkey"))
    named = at.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    return named.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "p_name"))), lambda x: x["p_name"]), ",").alias("names"))


def bridge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-01, J-03: three tables through a bridge, with counts."""
    li, s, n = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    joined = li.select("l_suppkey", "l_returnflag").join(s.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")), "l_suppkey").join(n, "n_nationkey")
    return joined.groupBy("n_name", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def rollup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-28."""
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().cast("long").alias("gid"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-08, O-11: union, intersection and difference of keys."""
    a = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    label = lambda df, name: df.distinct().withColumn("op", F.lit(name))
    return label(a.union(b), "union").union(label(a.intersect(b), "intersect")).union(label(a.exceptAll(b), "except_all"))


def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-10: running sums, lags, ranks and quantiles."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 6).alias("moving"), F.lag("event_id").over(w).alias("before"), F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("prank"), F.round(F.cume_dist().over(w), 6).alias("cdist"))


def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-16: each purchase with the user's last click at or before it, by one sort of both sides."""
    rows = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "purchase", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.filter("event_type in ('click', 'purchase')").withColumn("click_id", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w))
    return marked.filter("event_type = 'purchase'").select("event_id", "click_id")


def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-16: events within an hour after each error of the user, met on (user, hour) buckets and not on users alone."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    hour = 3_600_000_000
    left = rows.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("t").alias("t0"), F.explode(F.array(F.floor(F.col("t") / hour), F.floor(F.col("t") / hour) + 1)).alias("h"))
    right = rows.select("user_id", "event_id", "t", F.floor(F.col("t") / hour).alias("h"))
    return left.join(right, ["user_id", "h"]).filter(f"t > t0 and t <= t0 + {hour}").select("error_id", "event_id")


QUERIES = {f.__name__: f for f in (upsert_latest, orphan_prune, intern_keys, insert_or_ignore, anti_join_idempotent, graph_export, taxonomy_export, head_shard, related_export, papers_export, json_export, work_list, stride_sample, paged_listing, incident_edges, adjacency_lookups, equality_lookups, failed_attempts, listing_page, labels_canonical, refuted_targets, prefix_refs, relation_views, hydrate_records, bridge_join, rollup_report, set_operations, window_frames, asof_join, range_join)}
QUERIES |= {f"events_{f.__name__}": f for f in (E.tumbling, E.sliding, E.sessions, E.gaps, E.latest_decisions)}

ORACLES = {
    "upsert_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS first_seen FROM events GROUP BY user_id",
    "orphan_prune": "SELECT vec_id AS doc_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "intern_keys": """WITH v AS (SELECT p_partkey, p_brand, p_type, CASE WHEN p_size > 25 THEN p_brand END AS revision FROM part), k AS (SELECT min(p_partkey) AS id, p_type, revision FROM v WHERE p_brand = 'Brand#11' GROUP BY p_type, revision),
      f AS (SELECT DISTINCT p_type, revision FROM v EXCEPT SELECT p_type, revision FROM k)
      SELECT * FROM k UNION ALL SELECT (SELECT max(id) FROM k) + row_number() OVER (ORDER BY p_type NULLS FIRST, revision NULLS FIRST), p_type, revision FROM f""",
    "insert_or_ignore": "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'",
    "anti_join_idempotent": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'",
    "graph_export": """WITH o AS (SELECT o_custkey AS paper, count(*) AS n, string_agg(o_orderkey || '=' || o_orderpriority, ';' ORDER BY o_orderkey) AS j FROM orders GROUP BY 1), c AS (SELECT user_id AS paper, string_agg(DISTINCT (event_id % 30)::VARCHAR, ',' ORDER BY (event_id % 30)::VARCHAR) AS c, list_sort(list(DISTINCT event_id % 30)) AS l FROM events GROUP BY 1)
      SELECT c_custkey AS paper, coalesce(n, 0) AS judgment_count, coalesce(array_to_string(l, ','), '') AS cites, coalesce(j, '') AS judgments FROM customer LEFT JOIN o ON o.paper = c_custkey LEFT JOIN c ON c.paper = c_custkey""",
    "taxonomy_export": """WITH m AS (SELECT p_type AS field, p_brand AS cluster, p_name AS phrase, count(*) AS n FROM part GROUP BY ALL), c AS (SELECT field, cluster, sum(n) AS w, string_agg(phrase, ',' ORDER BY n DESC, phrase) AS p FROM m GROUP BY ALL)
      SELECT field, string_agg(cluster || ':' || p, ';' ORDER BY w DESC, cluster) AS clusters FROM c GROUP BY field""",
    "head_shard": "SELECT l_partkey AS entry, count(*) AS doc_freq FROM lineitem GROUP BY 1 ORDER BY doc_freq DESC, entry LIMIT 800",
    "related_export": f"WITH {KNN_SQL} SELECT i AS source, string_agg(j::VARCHAR, ',' ORDER BY sim DESC, j) AS related FROM knn WHERE rank <= 6 GROUP BY i",
    "papers_export": """WITH l AS (SELECT DISTINCT l_orderkey AS paper, 'Part ' || (l_partkey % 97) AS concept FROM lineitem), n AS (SELECT paper, count(*) AS n FROM l GROUP BY paper)
      SELECT concept, l.paper, row_number() OVER (PARTITION BY concept ORDER BY contains(lower('On part ' || (o_custkey % 97) || ' and more'), lower(concept)) DESC, n, l.paper) AS rank FROM l JOIN n USING (paper) JOIN orders ON o_orderkey = l.paper QUALIFY rank <= 12""",
    "json_export": "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS value FROM nation",
    "work_list": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 25",
    "stride_sample": "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part) WHERE n % 10 = 0 ORDER BY p_partkey LIMIT 50",
    "paged_listing": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 50",
    "incident_edges": "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_partkey = 7 AND l_returnflag = 'A'",
    "adjacency_lookups": "SELECT DISTINCT 'out' AS direction, l_suppkey AS node FROM lineitem WHERE l_partkey = 7 UNION SELECT DISTINCT 'in', l_partkey FROM lineitem WHERE l_suppkey = 7",
    "equality_lookups": "SELECT p_partkey, 'name' AS by FROM part WHERE p_name = 'red ring' UNION ALL SELECT p_partkey, 'hash' FROM part WHERE (p_type, p_size) IN (SELECT (p_type, p_size) FROM part WHERE p_partkey = 7)",
    "failed_attempts": "SELECT o_orderkey, 'target' AS by FROM orders WHERE o_custkey = 7 UNION ALL SELECT o_orderkey, 'pattern' FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 'both' FROM orders WHERE o_custkey = 7 AND o_orderpriority = '1-URGENT'",
    "listing_page": "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40",
    "labels_canonical": """WITH n AS (SELECT ['math-ph', 'math.MP', 'cs.IT', 'stat.TH', 'cs.NA', 'math.AG'] AS v), p AS (SELECT doc_id, [v[doc_id % 6 + 1], v[doc_id % 5 + 1]] AS l FROM documents, n)
      SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(l, lambda x: CASE x WHEN 'math-ph' THEN 'math.MP' WHEN 'cs.IT' THEN 'math.IT' WHEN 'stat.TH' THEN 'math.ST' WHEN 'cs.NA' THEN 'math.NA' ELSE x END))), ',') AS labels FROM p""",
    "refuted_targets": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "prefix_refs": "SELECT DISTINCT c_name FROM customer WHERE c_name LIKE 'Customer#00000000%'",
    "relation_views": """WITH r AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s, l_returnflag AS f FROM lineitem) SELECT p AS of, s AS other, CASE WHEN f = 'N' THEN 'equivalent' ELSE 'broader' END AS view FROM r
      UNION ALL SELECT s, p, CASE WHEN f = 'N' THEN 'equivalent' ELSE 'narrower' END FROM r""",
    "hydrate_records": "SELECT l_orderkey, string_agg(p_name, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS names FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey",
    "bridge_join": "SELECT n_name, l_returnflag, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL",
    "rollup_report": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, grouping(o_orderstatus, o_orderpriority)::BIGINT AS gid FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "set_operations": """WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING')
      SELECT k, 'union' AS op FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT k, 'intersect' FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT DISTINCT k, 'except_all' FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b)""",
    "window_frames": """SELECT event_id, round(sum(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving, lag(event_id) OVER w AS before, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS prank, round(cume_dist() OVER w, 6) AS cdist
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "asof_join": """SELECT p.event_id, (SELECT c.event_id FROM events c WHERE c.user_id = p.user_id AND c.event_type = 'click' AND c.ts <= p.ts ORDER BY c.ts DESC, c.event_id DESC LIMIT 1) AS click_id FROM events p WHERE p.event_type = 'purchase'""",
    "range_join": "SELECT a.event_id AS error_id, b.event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR",
    **E.ORACLES,
}
