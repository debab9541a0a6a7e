"""Whole results, and figures of a task that don't grow with the tables."""

from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from axiomata.catalog import graphs, spaces, trust
from axiomata.functions import text as T
from axiomata.operators import clusters, cooccurrence, graph, hearst, keyphrases, provenance, vectors
from axiomata.plans import stages
from axiomata.sources import expressions, lean


def enlarged(spark, sf_dir, folder, table, **columns):
    """A copy of a table with some columns made anew by SQL expressions, beside the others as they are."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    df.withColumns({c: F.expr(e) for c, e in columns.items()}).write.parquet(f"{folder}/{table}.parquet")


def test_retraction_sums_ids_beyond_a_long(spark, sf_dir, tmp_path):
    enlarged(spark, sf_dir, tmp_path, "lineitem", l_orderkey="900000000 + l_orderkey % 7")
    for t in ("orders", "events", "supplier"):
        enlarged(spark, sf_dir, tmp_path, t)
    ids = sum(r.id for r in spark.read.parquet(f"{tmp_path}/lineitem.parquet").selectExpr(*trust.EVIDENCE_COLUMNS).select("id").collect())
    got = {r.table: r.ids for r in trust.retract_cascade(spark, str(tmp_path)).collect()}
    assert ids > 2**63 and got["evidence"] == str(ids)


def test_hashed_pairs_depend_on_the_rows_alone(spark, sf_dir, tmp_path, monkeypatch):
    few = {(r.i, r.j) for r in spaces.lsh_candidates(spark, sf_dir).collect()}
    # a table of many more rows, which are similar to none
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id < 300").selectExpr("vec_id", "embedding", "label")
    more = own.limit(1).selectExpr("explode(sequence(1000, 6000)) AS vec_id", "transform(embedding, x -> float(0)) AS embedding", "label")
    own.union(more.selectExpr("CAST(vec_id AS BIGINT) AS vec_id", "embedding", "label")).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 500)
    monkeypatch.setattr(vectors, "TILE", 64)
    assert few and {(r.i, r.j) for r in spaces.lsh_candidates(spark, str(tmp_path)).collect()} == {(i, j) for i, j in few if j < 300}


def test_neighbours_of_blocks_are_those_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    own = rng.normal(size=(60, 8))
    # copies tie, wherever their blocks are
    rows = [(k, [float(x) for x in own[k % 60]]) for k in range(240)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    for k, v in (("BLOCK_ROWS", 100), ("TILE", 16), ("CHUNK", 50), ("KEPT_ROWS", 300)):
        monkeypatch.setattr(vectors, k, v)
    unit = own / np.linalg.norm(own, axis=1, keepdims=True)
    sims = {(i, j): round(float(unit[i % 60] @ unit[j % 60]), 9) for i in range(240) for j in range(240) if i != j}
    want = {(i, j) for i in range(240) for j in sorted((j for j in range(240) if j != i and sims[i, j] >= 0.2), key=lambda j: (-sims[i, j], j))[:5]}
    assert {(r.i, r.j) for r in vectors.nearest_pairs(df, "id", "v", 0.2, 5).collect()} == want


def test_neighbours_are_found_once_for_a_graph(spark, sf_dir, monkeypatch):
    plans = []
    real = clusters.connected_components
    monkeypatch.setattr(clusters, "connected_components", lambda df, *a: plans.append(df._jdf.queryExecution().toString()) or real(df, *a))
    assert clusters.detect(spaces._edges(spark, sf_dir), "louvain", 1.0).count() > 0
    assert "FlatMapGroupsIn" not in plans[0]


def test_formulas_of_one_file_are_parsed_on_all_cores(spark):
    df = spark.createDataFrame([(k, f"x{k} + 1") for k in range(40)], "k long, t string").coalesce(1)
    found = expressions.parsed(df, "t", ("k",))
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and found.filter("status = 'full'").count() == 40


def test_texts_of_one_file_are_searched_on_all_cores(spark):
    df = spark.createDataFrame([(k, f"Here. A ring{k} is a group. End") for k in range(40)], "k long, t string").coalesce(1)
    found = hearst._occurrences(df, "k", "t")
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and found.filter("phrase = 'group' AND tail = 'group.'").count() == 40


def parts(df):
    return df.rdd.getNumPartitions()


def test_pairs_are_counted_in_partitions_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(stages, "TASK_ROWS", 100)
    rows = [(g, x) for g in range(60) for x in range(g % 9 + 2)] + [(3, 1), (None, 1), (2, None)]
    inc = cooccurrence.incidence(spark.createDataFrame(rows, "a long, b long"), "a", "b")
    want = Counter(p for g in range(60) for p in combinations(range(g % 9 + 2), 2))
    found = cooccurrence.pairs(inc, 2)
    assert {(r.i, r.j): r.n for r in found.collect()} == {p: n for p, n in want.items() if n >= 2}
    assert parts(inc) == -(-len(rows) // 100) and parts(found) == -(-sum(want.values()) // 100)


def test_edges_of_orders_are_made_in_partitions_of_bounded_size(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(stages, "TASK_ROWS", 500)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert parts(graphs.edges(spark, sf_dir)) == -(-lines // 500) > spark.sparkContext.defaultParallelism


def test_a_map_ranks_the_edges_of_its_nodes_alone(spark):
    rng = np.random.default_rng(4)
    w = {(i, j): int(rng.integers(1, 5)) for i in range(40) for j in range(i + 1, 40) if rng.random() < 0.4}
    near = {a: sorted(((-x, i + j - a) for (i, j), x in w.items() if a in (i, j)))[:3] for a in range(40)}
    hops = {}
    for hop, b, x in [(1, b, x) for x, b in near[7]] + [(2, c, x) for _, b in near[7] for x, c in near[b] if c != 7]:
        hops[b] = min(hops.get(b, (9, 0)), (hop, x))
    nodes = {7, *sorted(hops, key=lambda b: (hops[b], b))[:5]}
    df = spark.createDataFrame([(i, j, x) for (i, j), x in w.items()], "i long, j long, w long")
    found = graph.concept_map(df, 7, per_node=3, most=6)
    assert {(r.a, r.b): r.w for r in found.collect()} == {(i, j): x for (i, j), x in w.items() if i in nodes and j in nodes}
    assert "Window" not in found._jdf.queryExecution().toString()


def rows_of(spark, n):
    """A store with faults of each join: n assertions, evidence and reviews, some of unknown assertions and sources."""
    a = spark.range(n).selectExpr("id", "id AS subject", "id + 1 AS object", "'judgment' AS subject_kind", "'judgment' AS object_kind", "'depends_on' AS predicate", "if(id % 3 = 0, 'verified', 'extracted') AS state", "'r' AS release", "concat('k', id div 2 * 2 + if(id % 10 = 0, 0, id % 2)) AS legacy_ref", "if(id % 7 = 0, id + 5, NULL) AS supersedes_id")
    ev = spark.range(n).selectExpr("id", "id * 2 AS assertion_id", "if(id % 11 = 0, NULL, id % 9) AS source_id", "if(id % 2 = 0, 'formal_export', 'model_output') AS kind")
    rv = spark.range(n).selectExpr("id", "id * 3 AS assertion_id")
    src = spark.range(8).selectExpr("id", "'x' AS licence", "'x' AS attribution", "repeat('0', 64) AS content_hash")
    return a, ev, rv, src


def test_the_gate_joins_in_partitions_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(stages, "TASK_ROWS", 50)
    n = 600
    found = Counter(r.check for r in provenance.violations(*rows_of(spark, n)).collect())
    assert found == {
        "no_evidence": n // 2, "evidence_without_assertion": n // 2, "review_without_assertion": n * 2 // 3,
        "evidence_without_source": sum(k % 11 == 0 or k % 9 == 8 for k in range(n)),
        "trusted_without_qualifying_evidence": sum(k % 3 == 0 and k % 4 != 0 for k in range(n)),
        "supersedes_unknown": sum(k % 7 == 0 and k + 5 >= n for k in range(n)),
    }
    plan = provenance.violations(*rows_of(spark, n))._jdf.queryExecution().toString()
    assert plan.count("hashpartitioning(assertion_id#") and f", {n // 50})" in plan


def test_export_differences_count_duplicates_in_partitions_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(stages, "TASK_ROWS", 10)
    frame = lambda rows: spark.createDataFrame(rows, "id long, policy string")
    a = [(k, "x") for k in range(40)] + [(1, "x"), (1, "x"), (2, None), (2, None)]
    b = [(k, "x") for k in range(5, 40)] + [(2, None), (3, "y"), (3, "y")]
    found = provenance.export_differences(frame(a), frame(b))
    assert Counter(map(tuple, found.collect())) == Counter({(*r, "written"): n for r, n in (Counter(a) - Counter(b)).items()} | {(*r, "derived"): n for r, n in (Counter(b) - Counter(a)).items()})
    assert parts(found) == -(-(len(a) + len(b)) // 10)


def test_concentration_of_documents_with_several_labels(spark, monkeypatch):
    monkeypatch.setattr(stages, "TASK_ROWS", 20)
    labels = [(d, f) for d in range(120) for f in "abc" if d % 2 == 0 or f == "abc"[d % 3]]
    links = [(d, p) for d in range(120) for p in ("even", "first") if p == "even" or d < 55] * 2
    frames = spark.createDataFrame(links, "doc long, phrase string"), spark.createDataFrame(labels, "doc long, label string")
    found = keyphrases.field_concentration(*frames, keyphrases.field_prior(frames[1], "doc", "label"))
    of = Counter(d for d, _ in labels)
    share = lambda docs: {f: sum(1 / of[d] for d, g in labels if g == f and d in docs) for f in "abc"}
    q = {f: m / 120 for f, m in share(range(120)).items()}
    for r in found.collect():
        n = 120 if r.phrase == "even" else 55
        p = {f: (c + 10 * q[f]) / (n + 10) for f, c in share(range(n)).items()}
        assert r.labelled == n and abs(r.concentration - sum(p[f] * np.log(p[f] / q[f]) for f in p)) < 1e-9
    assert "hashpartitioning(phrase#" in (plan := found._jdf.queryExecution().toString()) and f", {-(-len(links) // 20)})" in plan


def test_a_lean_file_is_read_line_by_line(spark):
    text = "-- head\n" + "".join(f"theorem t{k} (h : A) : x = x := by\n  /- theorem u : y -/\n  exact t{k - 1}\n" for k in range(300)) + "def last := 1"
    files = spark.createDataFrame([("a", text), ("b", None), ("c", ""), ("d", text)], "path string, value string").coalesce(1)
    found = lean.parsed(files)
    assert "Generate posexplode" in found._jdf.queryExecution().toString()
    rows = sorted(found.select("path", "order", "name", "line", "raw").collect())
    want = [(p, k, d["name"], d["line"], d["raw"]) for p in "ad" for k, d in enumerate(lean.declarations(text))]
    assert [tuple(r) for r in rows] == want and len(want) == 602


def test_a_key_folds_each_word_once(spark):
    df = spark.createDataFrame([("Kaehler-Manifolds of goedel",)], "p string").select(T.canonical_key(F.col("p")).alias("k"))
    assert df.first().k == "kahler manifold of godel"
    assert df._jdf.queryExecution().analyzed().toString().count("goedel$") == 1


def test_phrases_are_found_without_scores(spark):
    df = spark.createDataFrame([(1, "Finite groups of finite groups and finite rings"), (2, None)], "doc long, text string").coalesce(1)
    assert sorted(map(tuple, keyphrases.phrase_rows(df, "doc", "text").collect())) == [(1, "finite groups"), (1, "finite rings")]
