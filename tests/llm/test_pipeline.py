import random

import corpus_pipeline
from axiomata.llm import queries


def write(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_take_effect(spark, tmp_path):
    random.seed(4)
    prose = lambda n: " ".join(f"{random.choice('bcdfgh')}{random.randrange(10**6)}a".translate(str.maketrans("0123456789", "aeiouklmnr")) for _ in range(n)) + "."
    docs = [(k, prose(random.randrange(80, 300))) for k in range(150)] + [(1000 + k, "same same same | | | " * 40) for k in range(30)]
    item = prose(40)
    docs += [(2000, docs[0][1]), (2001, docs[1][1] + " extra"), (2002, docs[2][1].replace(" ", "\n", 3)), (2003, prose(60) + " " + item)]
    labels = [(i, 0 if 1000 <= i < 1100 else 1, 0) for i, _ in docs if i < 2000]
    write(spark, str(tmp_path), [(i, t, "en", "s", len(t)) for i, t in docs], labels, [(1, item)])
    left = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not {i for i in left if 1000 <= i < 1100}
    assert not left & {2000, 2001, 2003}
    assert len({2, 2002} & left) == 1
    assert len(left & set(range(150))) >= 147


def test_each_stage_keeps_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_empty_documents(spark, tmp_path):
    write(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    numbers = {int(n[2:].split("_")[0]) for n in queries.QUERIES}
    assert numbers == set(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
