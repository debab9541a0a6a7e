import random
import re

from axiomata.llm import winnow


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def brute(docs, items):
    out = []
    for i, text in docs:
        own, hit, found = words(text), set(), set()
        for item, t in items:
            w = words(t)
            n = min(13, len(w))
            if not n:
                continue
            grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            for k in range(len(own) - n + 1):
                if tuple(own[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found |= {str(item)} - {"None"}
        out.append((i, len(own), len(hit), sorted(found)))
    return sorted(out, key=str)


def got(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted([(r.id, r.n_words, r.n_hit, list(r.item_ids)) for r in winnow.contamination(d, b).collect()], key=str)


def test_random_texts(spark):
    random.seed(11)
    vocabulary = ["a", "b", "c", "d"]  # few words, so that grams repeat and tie
    some = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(k, some(random.randrange(10, 40))) for k in range(12)] + [(100, "Zebra stripes, ZEBRA!"), (101, "éa b"), (102, ""), (103, None), (104, some(13)), (104, "x1 x2"), (None, some(20)), (None, "y1 y2 y3")]
    docs = [(k, some(random.randrange(0, 80))) for k in range(40)] + [(50, "zebra stripes zebra stripes zebra " + some(20)), (51, "Éa b éa-b"), (52, None), (53, ""), (53, ""), (None, items[3][1]), (54, items[0][1] + " . " + items[1][1] + " end"), (55, "x1,x2 x1 x2"), (56, "y1 y2 y3"), (57, items[-2][1])]
    assert got(spark, docs, items) == brute(docs, items)


def test_long_words_and_spans(spark):
    item = " ".join(f"k{j}" for j in range(60))
    docs = [(1, "pre " * 500 + item + " post" * 500), (2, " ".join(f"k{j}" for j in range(12))), (3, " ".join(f"k{j}" for j in range(5, 18)))]
    assert got(spark, docs, [(7, item)]) == brute(docs, [(7, item)])


def test_empty_tables_and_clean(spark):
    d = spark.createDataFrame([(1, "some text here", "x"), (1, "some text here", "x"), (None, None, "y")], "doc_id long, text string, item string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert winnow.contamination(d, none).count() == 3
    assert winnow.contamination(d.limit(0), none).count() == 0
    item = spark.createDataFrame([(5, "some text")], "item_id long, text string")
    left = winnow.clean(d, item)
    assert left.columns == d.columns and [tuple(r) for r in left.collect()] == [(None, None, "y")]


def test_one_passage_drops_a_document_of_any_length(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    filler = " ".join(f"f{k}" for k in range(2000))
    docs = spark.createDataFrame([(1, f"{filler} {passage} {filler}", "b"), (2, f"{filler} tiny item {filler}", "b"), (3, "tiny item", "b")], "doc_id long, text string, bad_id string")
    items = spark.createDataFrame([(1, passage), (None, "tiny item")], "item_id long, text string")
    left = winnow.clean(docs, items)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [2]
    many = spark.createDataFrame([(1, " , ".join([passage] * 300))], "doc_id long, text string")
    assert tuple(winnow.contamination(many, items).select("n_words", "n_hit").first()) == (6000, 6000)
