import hashlib
import re

from pyspark.sql import functions as F

from axiomata.llm import exact_dedup

SCHEMA = "doc_id long, text string, key string"


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in rows]
    groups = {}
    for k, n in enumerate(norm):
        groups.setdefault(n, []).append(k)
    out = []
    for k, n in enumerate(norm):
        best = min(groups[n], key=lambda j: (-len(rows[j][1] or ""), rows[j][0] is None, rows[j][0] or 0))
        same = rows[k][0] == rows[best][0] and len(rows[k][1] or "") == len(rows[best][1] or "")
        out.append((rows[k][0], hashlib.sha256(n.encode()).hexdigest(), rows[best][0], len(groups[n]), same))
    return sorted(out, key=str)


ROWS = [(1, "a b", "x"), (2, "ab", "y"), (3, "a\tb\n", "z"), (-4, "a b ", None), (5, None, "q"), (6, "", "q"), (None, " ", "n"), (None, "zz", "n"), (7, "z z", "n"), (8, "é é", "n"), (9, "éé", "n"), (1, "a b", "x"), (10, "w" * 100_000, "l"), (11, "w " * 100_000, "l")]


def test_groups(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted([tuple(r) for r in exact_dedup.group_copies(df).collect()], key=str)
    assert got == brute(ROWS)


def test_one_row_of_each_group_stays(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    kept = exact_dedup.distinct_kept(df)
    assert kept.columns == ["doc_id", "text", "key"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[2]) for r in {x[1]: x for x in brute(ROWS)}.values())


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(3, "abc", "k")] * 5 + [(4, "ab c ", "k")] * 2, SCHEMA)
    assert [r.doc_id for r in exact_dedup.distinct_kept(df).collect()] == [4]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.group_copies(df).count() == 0
    assert exact_dedup.distinct_kept(df).count() == 0


def test_directory_splits_overfull_buckets(spark):
    entries = spark.range(4000).select(F.xxhash64("id").alias("key"))
    found = exact_dedup.directory(entries, capacity=100)
    cells = entries.withColumn("cell", F.shiftrightunsigned("key", 64 - exact_dedup.MAX_DEPTH)).join(found, "cell")
    assert cells.count() == 4000
    sizes = cells.groupBy("depth", "bucket").count()
    assert sizes.agg(F.max("count")).first()[0] <= 100
    assert sizes.agg(F.max("depth")).first()[0] >= 6
    wide = exact_dedup.directory(entries, capacity=10_000).select("depth").distinct().collect()
    assert [r.depth for r in wide] == [0]


def test_the_directory_doubles_and_marks_repeated_keys(spark):
    rows = [(k, f"text {k}", "") for k in range(900)] + [(1000 + k, f"text{k}", "") for k in range(0, 900, 30)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = exact_dedup.marked_directory(df, "text", capacity=16)
    assert found.agg(F.max("depth")).first()[0] >= 5
    sent = exact_dedup.routed(exact_dedup.signed(df, "text", "doc_id"), found, "key", "bucket", "shared").filter("shared")
    assert {r.id % 1000 for r in sent.collect()} >= set(range(0, 900, 30)) and sent.count() < 80
    index = exact_dedup.build_index(df, found)
    assert index.filter("group_size = 2").count() == 30 and index.agg(F.max("chain")).first()[0] == 1
    assert sorted([tuple(r) for r in exact_dedup.group_copies(df, capacity=16).collect()], key=str) == brute(rows)


def test_names_that_clash_pass_through(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "key as digest", "key as points", "key as `number`", "key as cell", "key as bucket", "key as marks", "key as shared", "key as id")
    kept = exact_dedup.distinct_kept(df)
    assert kept.columns == df.columns
    assert all(r.digest == r.key == r.cell == r.bucket for r in kept.collect()) and kept.count() == 6


def test_colliding_keys_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(5).cast("long"))
    df = spark.createDataFrame([(1, "a", ""), (2, "b", ""), (3, "a ", "")], SCHEMA)
    got = {r.id: (r.keep_id, r.group_size) for r in exact_dedup.group_copies(df).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (2, 1)}
