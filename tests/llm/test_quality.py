import zlib

import numpy as np

from axiomata.llm import quality, queries


def brute_logit(machine, columns, values):
    z = machine.bias + sum(machine.weights[c] * v for c, v in zip(columns, values))
    for i in range(len(columns)):
        for j in range(i):
            z += machine.vectors[columns[i]] @ machine.vectors[columns[j]] * values[i] * values[j]
    return z


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    machine = quality.Machine(0.3, rng.normal(size=quality.WIDTH), rng.normal(size=(quality.WIDTH, quality.RANK)))
    rows = [quality.extract(t) for t in ("a b c a", "", None, "one | two | three\nfour")]
    starts = np.concatenate([[0], np.cumsum([len(c) for c, _ in rows])[:-1]]).astype(int)
    got = machine.logits(np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows]), starts)
    assert np.allclose(got, [brute_logit(machine, c, v) for c, v in rows], atol=1e-4)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op6_quality(spark, sf).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in labels)
    test = [(rows[i].predicted, q) for i, q in labels if rows[i].held_out]
    assert np.mean([p == q for p, q in test]) > 0.95
    assert np.mean([p for p, q in test if q == 1]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.createDataFrame([(k, "good words here again" if k % 2 else "x | x | x | x") for k in range(60)], "doc_id long, text string")
    labels = [(k, k % 2) for k in range(60)]
    turned = [(k, 1 - q if zlib.crc32(str(k).encode()) % 3 == 1 else q) for k, q in labels]
    a, b = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, turned))
    assert (a.weights == b.weights).all() and (a.vectors == b.vectors).all() and a.bias == b.bias


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, "s"), (1, None, "s"), (None, "", "s"), (2, "w " * 50_000, "s")], "doc_id long, text string, score string")
    for labels in ([], [(2, 1)], [(None, 1), (2, None)], [(1, 1), (1, 0)]):
        machine = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        got = quality.with_score(docs, machine, keep=("doc_id", "score"), score="__score").collect()
        assert len(got) == 4 and all(0 <= r["__score"] <= 1 for r in got)
    assert quality.with_score(docs.limit(0), machine).count() == 0


def test_repeated_ids_send_one_row_each(spark):
    once = [(k, "good words here again" if k % 2 else "x | x | x | x") for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    a, b = (quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels) for rows in (once, once * 30))
    assert (a.weights == b.weights).all() and a.bias == b.bias
    df = spark.createDataFrame([(1, "words", "k")], "doc_id long, text string, __text string")
    assert quality.with_score(df, a, keep=("doc_id", "__text")).first()["__text"] == "k"
