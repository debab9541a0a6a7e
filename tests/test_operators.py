import math
import random

import numpy as np
from pyspark.sql import functions as F

from axiomata.functions import text as T
from axiomata.operators import keyphrases, provenance, search, vectors


def column(spark, f, *values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(f(F.col("v"))).collect()]


def test_text_functions(spark):
    assert column(spark, T.canonical_key, "Kähler manifolds", "Kaehler-Manifold", "classes", "series", "analysis", "théories", "boxes", "gas_es") == ["kahler manifold", "kahler manifold", "class", "series", "analysis", "theory", "box", "gas es"]
    assert column(spark, T.strip_old_ids, "see math.AG/0102003 and x/01020034") == ["see   and x/01020034"]
    assert column(spark, T.unescape_tex_accents, 'G\\"{o}del Poincar\\\'e') == ["Gödel Poincaré"]
    assert column(spark, T.unescape_tex_accents, "\\'Etale \\'{A \\~{a}") == ["Étale Á ã"]
    assert column(spark, T.query_tokens, "the Gas of rings", "the of", "how to define one ring") == [["gas", "ring"], ["the", "of"], ["one", "ring"]]
    labels = spark.createDataFrame([(["math-ph", "math.MP", "cs.IT"],), (["math.NA", "cs.NA", "stat.TH"],)], "c array<string>")
    assert [r[0] for r in labels.select(T.field_labels(F.col("c"))).collect()] == [["math.IT", "math.MP"], ["math.NA", "math.ST"]]
    assert column(spark, T.identifier_tokens, "addCommGroup_of2x") == [["add", "comm", "group", "of", "2", "x"]]
    assert column(spark, T.math_symbols, "∀ x ∈ ℝ ∀ ‖α‖ 𝔽 ⌀") == [["∀", "∈", "ℝ", "‖", "α", "𝔽"]]
    assert column(spark, T.first_year, "in 1850 or 2001 or 1999", "none") == [2001, None]
    assert column(spark, T.cited_id, "x arXiv:2001.12345 y", "arXiv: math.AG/0102003", "no") == ["2001.12345", "math.AG/0102003", None]
    assert column(spark, lambda c: T.is_specialization(c, F.lit("finite group")), "finite group", "a finite group", "finite simple group") == [False, True, False]
    assert column(spark, lambda c: T.enclosing_sentence(c, F.lit(12)), "First one. The second! Third") == ["The second"]
    assert len(T.ACCENTED) == len(T.PLAIN)


def phrases(text):
    return [" ".join(p) for p in keyphrases.candidate_phrases(text)]


def test_candidate_phrases():
    assert phrases("The finite p-group, of x1 rank; -bad word") == ["finite p-group", "rank", "word"]
    assert phrases(None) == phrases("") == phrases("of the a1 1 x") == []
    assert phrases("one two three four five six. one two three four five six seven") == ["one two three four five six"]
    assert phrases('see math/9912150, the Schr\\"{o}dinger operator in \\mathfrak{g}') == ["schrödinger operator"]
    numerals = phrases("The genus one curve. The genus two curve. The genus three curve.")
    assert {"genus one curve", "genus two curve", "genus three curve"} <= set(numerals)
    junk = " ".join(phrases("The approach based here. The following property. The manifold admits a metric. The corresponding bundle. The polynomials satisfy this. The spaces having this. The pairs consisting of this. The constant depending on this. The conjecture implies this. The conditions required here.")).split()
    assert not set(junk) & {"based", "following", "admits", "corresponding", "satisfy", "having", "consisting", "depending", "implies", "required"}
    real = ["associated primes", "generating functions", "defining relations", "induced representations", "universal cover", "lie algebra", "implied volatility"]
    assert set(real) <= set(phrases(". ".join(f"The {p}" for p in real)))
    assert not {"-1", "-2", "-n", "--"} & set(" ".join(phrases("We show that $f(-1) = -2$ and $g(-n) = -3$, unlike $h(--) = 0$.")).split())


def test_stock_phrases_are_boilerplate(spark):
    rows = [("main theorem", 0.9), ("moduli space", 0.9), ("general thing", 0.1), ("rare thing", None)]
    df = spark.createDataFrame(rows, "phrase string, concentration double")
    assert {r.phrase for r in keyphrases.boilerplate(df).collect()} == {"main theorem", "general thing"}


def test_rake_by_hand(spark):
    docs = spark.createDataFrame([(1, "finite group, finite simple group and group"), (2, ""), (3, None)], "d long, t string")
    got = {(r.doc, r.phrase): r.score for r in keyphrases.rake_scores(docs, "d", "t").collect()}
    finite, simple, group = 5 / 2, 3.0, 6 / 3
    assert got == {(1, "finite group"): finite + group, (1, "finite simple group"): finite + simple + group, (1, "group"): group}


def test_concentration_tells_fields_apart(spark):
    labels = spark.createDataFrame([(k, "a" if k < 60 else "b") for k in range(120)], "doc long, label string")
    links = spark.createDataFrame([(k, "even") for k in range(120)] + [(k, "only") for k in range(60)] + [(1, "rare")], "doc long, phrase string")
    found = {r.phrase: r.concentration for r in keyphrases.field_concentration(links, labels, keyphrases.field_prior(labels, "doc", "label")).collect()}
    p = (60 + 5) / 70
    assert abs(found["even"]) < 1e-9 and math.isclose(found["only"], p * math.log(2 * p) + (1 - p) * math.log(2 * (1 - p))) and "rare" not in found


def test_edit_distance_limits(spark):
    known = spark.createDataFrame([("ring", 5, 1.0), ("rings", 2, 1.0), ("manifold", 3, 1.0), ("abc", 9, 1.0)], "token string, df long, idf double")
    words = spark.createDataFrame([("rign",), ("ringz",), ("manyfolt",), ("manyfolts",), ("abx",), ("ring",), ("xing",)], "word string")
    assert {r.word: r.corrected for r in search.corrections(words, known).collect()} == {"ringz": "ring", "manyfolt": "manifold"}


def test_exact_pairs_in_many_blocks(spark, monkeypatch):
    random.seed(3)
    rows = [(k, [random.gauss(0, 1) for _ in range(6)]) for k in range(90)] + [(90, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    m = np.array([v for _, v in rows])
    norm = np.linalg.norm(m, axis=1)
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if m[i] @ m[j] / norm[i] / norm[j] >= 0.5}
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 40)
    assert {(r.i, r.j) for r in vectors.exact_pairs(df, "id", "v", 0.5).collect()} == want
    assert {(r.i, r.j) for r in vectors.lsh_pairs(df, "id", "v", 0.5, 6, 91).collect()} <= want
    assert vectors.hyperplanes(6, 8).shape == (4, 8, 6) and vectors.bits_for(10) == 6 and vectors.bits_for(64 * 2**9) == 9


def test_spectral_embedding_by_its_products(spark):
    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.normal(size=(24, 3)))[0]
    a = basis @ np.diag([9.0, -6.0, 4.0]) @ basis.T
    df = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(24) for j in range(24)], "u long, k long, w double")
    got = {r.u: np.array(r.vector) for r in vectors.spectral(df, 3, extra=4).collect()}
    want = basis * np.sqrt([9.0, 6.0, 4.0])
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    mine = np.array([got[k] for k in range(24)])
    assert np.allclose(mine @ mine.T, want @ want.T, atol=1e-6)


def store(spark):
    a = spark.createDataFrame([(1, 10, 11, "judgment", "judgment", "depends_on", "verified", "r", "k:1", None), (2, 10, 12, "concept", "concept", "specializes", "reviewed", "r", "k:2", None)], "id long, subject long, object long, subject_kind string, object_kind string, predicate string, state string, release string, legacy_ref string, supersedes_id long")
    ev = spark.createDataFrame([(1, 1, 5, "formal_export", "l", None, None), (2, 2, 5, "source_span", "s", None, None)], "id long, assertion_id long, source_id long, kind string, locator string, metric double, classification string")
    rv = spark.createDataFrame([(1, 2, "accept", "x", "lead", 5, None, "r")], "id long, assertion_id long, decision string, reviewer string, authorization string, decided_at long, expires_at long, release string")
    src = spark.createDataFrame([(5, "arxiv", "CC0", "me", "0" * 64)], "id long, provider string, licence string, attribution string, content_hash string")
    return a, ev, rv, src


def test_the_gate_passes_a_sound_store_and_names_each_fault(spark):
    a, ev, rv, src = store(spark)
    checks = lambda *t: {r.check for r in provenance.violations(*t).collect()}
    assert checks(a, ev, rv, src) == set()
    assert checks(a.withColumn("subject_kind", F.lit("paper")), ev, rv, src) == {"kinds_do_not_suit_predicate"}
    assert checks(a, ev.filter("id = 1"), rv, src) == {"no_evidence", "trusted_without_qualifying_evidence"}
    assert checks(a.filter("id = 1"), ev, rv.limit(0), src) == {"evidence_without_assertion"}
    assert checks(a.filter("id = 1"), ev.filter("id = 1"), rv, src) == {"review_without_assertion"}
    assert checks(a, ev.withColumn("source_id", F.lit(6)), rv, src) == {"evidence_without_source"}
    assert checks(a, ev.withColumn("kind", F.lit("model_output")), rv, src) == {"trusted_without_qualifying_evidence"}
    assert checks(a.withColumn("state", F.lit("odd")), ev, rv, src) == {"unknown_state"}
    assert checks(a.withColumn("object", F.col("subject")), ev, rv, src) == {"relates_to_itself"}
    assert checks(a.withColumn("legacy_ref", F.lit("same")), ev, rv, src) == {"ambiguous_key"}
    assert checks(a.withColumn("supersedes_id", F.lit(99)), ev, rv, src) == {"supersedes_unknown"}
    assert checks(a, ev, rv, src.withColumn("licence", F.lit(" "))) == {"no_licence"}
    assert checks(a, ev, rv, src.withColumn("attribution", F.lit(None).cast("string"))) == {"no_attribution"}
    assert checks(a, ev, rv, src.withColumn("content_hash", F.lit("x"))) == {"bad_content_hash"}


def test_a_second_import_adds_nothing(spark):
    rows = spark.createDataFrame([(1, 2, 3, "dependency", "x"), (2, 2, 4, "implication", "rejected")], "id long, src long, dst long, kind string, status string")
    first = provenance.import_edges(rows, spark.createDataFrame([], "legacy_ref string, release string"), "r")
    assert {(r.predicate, r.state) for r in first.collect()} == {("depends_on", "extracted"), ("implies", "rejected")}
    assert provenance.import_edges(rows, first, "r").count() == 0 and provenance.import_edges(rows, first, "other").count() == 2


def test_retraction_leaves_nothing_hanging(spark):
    left = provenance.retract(12, *store(spark))
    assert [df.count() for df in left] == [1, 1, 0, 1]
    assert [df.count() for df in provenance.retract(10, *store(spark))] == [0, 0, 0, 0]


def test_encoder_is_called_by_batch_and_checked(spark):
    df = spark.createDataFrame([(1, "ab", "x"), (2, None, "y")], "id long, text string, extra string")
    found = vectors.encoded(df, "text", lambda texts: [[len(t), 1.0] for t in texts], 2)
    assert {r.id: (list(r.vector), r.extra) for r in found.collect()} == {1: ([2.0, 1.0], "x"), 2: ([0.0, 1.0], "y")}


def test_incremental_quotient_equals_a_new_one(spark):
    from axiomata.operators import graph

    nodes = spark.createDataFrame([(k,) for k in range(12)], "id long")
    old, new = [(1, 2), (3, 4), (6, 7)], [(2, 3), (7, 9), (10, 11)]
    frame = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    step = graph.absorb(graph.representatives(nodes, frame(old)), frame(new))
    assert {tuple(r) for r in step.collect()} == {tuple(r) for r in graph.representatives(nodes, frame(old + new)).collect()}


def test_federated_hits(spark):
    a = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.2), (1, 10, 0.5)], "qid int, entry long, score double")
    b = spark.createDataFrame([(1, 10, 0.6), (2, 5, 0.1)], "qid int, entry long, score double")
    got = [(r.qid, r.source, r.rank, r.entry) for r in search.federated(a, b, 2).orderBy("qid", "rank").collect()]
    assert got == [(1, "concept", 1, 10), (1, "judgment", 2, 10), (2, "judgment", 1, 5)]


def test_release_checks(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    told = lambda df: sorted((r.check, r.detail) for r in df.collect())
    releases = frame([(1, "v1", "abc")], "id long, tag string, git_commit string")
    files = frame([("a", "1"), ("b", "2")], "name string, sha256 string")
    counts = frame([("edges", 3)], "kind string, n long")
    side = frame([("judgments", "v1")], "name string, release_tag string")
    made = lambda tag, number, commit: frame([(tag, number, commit, "p1")], "release_tag string, release_id long, git_commit string, mapping_version string")
    assert told(provenance.release_violations(made("v1", 1, "abc"), releases, side, counts, counts, files, files, "p1")) == []
    live = frame([("a", "9"), ("c", "3")], "name string, sha256 string")
    got = told(provenance.release_violations(made("v1", 2, None), releases, side, counts, frame([], "kind string, n long"), files, live, "p2"))
    assert got == [("counts_mismatch", "edges"), ("input_file_hash_mismatch", "a"), ("input_file_not_in_manifest", "c"), ("manifest_release_commit_mismatch", "v1"), ("manifest_release_id_mismatch", "v1"), ("source_mapping_policy_mismatch", "p1")]
    assert ("manifest_release_not_found", "v9") in told(provenance.release_violations(made("v9", 1, "abc"), releases, side, counts, counts, files, files, "p1"))
    assert told(provenance.output_violations(files, live)) == [("export_file_missing", "b"), ("output_file_not_in_manifest", "c"), ("output_hash_mismatch", "a")]

    refs = frame([("c:1", 11), ("c:2", 12)], "ref string, entity long")
    a = frame([(1, "c:1", "c:2", 11, 12), (2, "c:1", "c:2", 11, 99), (3, "c:1", "c:9", 11, None)], "id long, subject string, object string, subject_entity long, object_entity long")
    meta = frame([("build", "x"), ("schema", "1")], "field string, value string")
    live_meta = frame([("build", "y"), ("schema", "1")], "field string, value string")
    assert told(provenance.catalog_violations(a, refs, meta, live_meta)) == [("catalog_metadata_mismatch", "build"), ("entity_endpoint_drift", "2"), ("unresolved_entity_reference", "3")]

    whole = '{"leanToolchain":"l","mathlibRev":"m","extractorVersion":"e","filteringPolicyVersion":"f1","rawSha256":"r","normalizedSha256":"n"}'
    sources = frame([(1, whole), (2, whole.replace("f1", "f2")), (3, "no json"), (4, None)], "id long, reproducibility string")
    evidence = frame([(k, k, "formal_export") for k in range(1, 5)] + [(9, 4, "source_span")], "id long, source_id long, kind string")
    assert told(provenance.formal_violations(evidence, sources, "f1")) == [("filter_policy_mismatch", "2"), ("formal_evidence_missing_reproducibility_metadata", "3"), ("formal_evidence_missing_reproducibility_metadata", "4")]


def test_numbers_without_one_task(spark):
    from axiomata.operators import sinks

    df = spark.createDataFrame([(k * 7 % 50 or None, k) for k in range(50)], "a int, b int").repartition(5)
    got = sorted((r.n, r.a or 0) for r in sinks.numbered(df, ["a"], "n").collect())
    assert got == [(k, k) for k in range(50)]


def test_lookups(spark):
    from axiomata.operators import lookups

    df = spark.createDataFrame([(1, 2, "x"), (2, 1, "y"), (3, 4, "x")], "src int, dst int, kind string")
    assert lookups.where(df, kind="x", src=None).count() == 2 and lookups.where(df).count() == 3
    assert lookups.touching(df, 1, ("src", "dst")).count() == 2
    assert [tuple(r) for r in lookups.adjacent(df, 1).collect()] == [("in", 2), ("out", 2)]
    assert [r.src for r in lookups.listing(df, ["src"], ["src"], page=1, size=2).collect()] == [3]


def test_related_and_statement_tiers(spark):
    entries = spark.createDataFrame([(1, "red ring", 5, "a"), (2, "old bolt", 3, "b"), (3, "red", 2, None)], "entry long, phrase string, doc_freq long, cluster string")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "entry long, vector array<double>")
    asked = spark.createDataFrame([(1, "red ring", None), (2, "nothing known", [0.0, 1.0])], "qid int, query string, vector array<double>")
    got = {(r.qid, r.tier, r.entry) for r in search.phrase_search(asked, entries, 1, vecs).collect()}
    assert got == {(1, "exact", 1), (1, "related", 2), (2, "related", 3)}
    judgments = spark.createDataFrame([(1, "addComm", "a + b = b + a", ["x"], "theorem"), (2, None, "∀ x, x ≤ x", [], "axiom"), (3, "other", "∫ f = 0", [], "theorem"), (4, "near", "c", [], "theorem")], "id long, name string, statement string, context array<string>, kind string")
    edges = spark.createDataFrame([(1, 4)], "src long, dst long")
    hits = {(r.qid, r.tier, r.entry) for r in search.judgment_search([(1, "add"), (2, "∀ ≤"), (3, "A + b = b + a"), (4, "")], judgments, edges).collect()}
    assert hits == {(1, "name", 1), (1, "connected", 4), (2, "statement", 2), (3, "exact", 1), (3, "connected", 4)}
    assert search.judgment_search([(2, "∀ ≤")], judgments, edges, kind="theorem").count() == 0
