import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from axiomata.llm import simhash


def brute_print(text, width=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    if not shingles:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = ["", None, "one", "one two", "A b C d e f É g", "x y z x y z x y z", "  lead and\ttrail \n", " ".join(map(str, range(500)))]


def test_fingerprints():
    for t in TEXTS:
        assert simhash.fingerprint(t) & (2**64 - 1) == brute_print(t)


def test_blocks_don_t_change_a_fingerprint(monkeypatch):
    text = " ".join(str(k * k) for k in range(300))
    whole, sketch = simhash.fingerprint(text), simhash.sketch(text.encode(), 5)
    monkeypatch.setattr(simhash, "BLOCK", 40)
    assert simhash.fingerprint(text) == whole
    again = simhash.sketch(text.encode(), 5)
    assert again[0] == sketch[0] and (again[1] == sketch[1]).all()


def test_the_code_is_perfect():
    syndromes, patterns = simhash.code_table()
    assert all(len(p[0]) == 1 for p in patterns)
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 2000)
    homes = np.array([w ^ patterns[syndromes[w]][0][0] for w in words])
    assert (syndromes[homes] == 0).all() and (np.bitwise_count(homes ^ words) <= 3).all()


def components(prints, ids, most=2):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                parent[root(i)] = root(j)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [least.get(root(k)) for k in range(len(prints))]


def test_links_and_components(spark):
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(40)]
    prints = base + [p ^ 1 << random.randrange(64) for p in base] + [p ^ 1 << random.randrange(64) ^ 1 << random.randrange(64) for p in base for _ in range(2)] + [0, 1, 3, 7, 15]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in set(signed)], "fingerprint long")
    for most in (0, 1, 2):
        got = {(r.a, r.b) for r in simhash.links(df, most).collect()}
        want = {(a, b) for a in set(signed) for b in set(signed) if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= most}
        assert got == want


def test_anchors_are_never_broadcast(spark):
    random.seed(7)
    prints = simhash.written(spark.createDataFrame([(random.getrandbits(63),) for _ in range(500)], "fingerprint long"), "prints")
    found = simhash.links(prints)  # a file this small is below any threshold
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_near_groups(spark):
    words = [f"w{k}" for k in range(120)]
    rows = [(9, " ".join(words)), (4, " ".join(words).upper()), (7, "alone in the world"), (None, "alone in the world"), (2, None), (3, ""), (None, None), (5, " ".join(words) + "  "), (5, "fully different text of five words")]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = components([brute_print(t) for _, t in rows], [i for i, _ in rows])
    assert sorted(((r.id, r.fingerprint & (2**64 - 1), r.component_id) for r in got), key=str) == sorted(((i, brute_print(t), c) for (i, t), c in zip(rows, want)), key=str)
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_groups_find_edited_copies_and_leave_others(spark):
    random.seed(1)
    text = lambda n: [f"t{random.randrange(10**6)}" for _ in range(n)]
    rows, group = [], {}
    for g in range(60):
        own = text(random.randrange(60, 400))
        for c in range(1 + g % 4):
            edited = list(own)
            for k in random.sample(range(len(own)), max(0, len(own) // 150)) if c else []:
                edited[k] = "edit"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(edited), "same"))
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = simhash.distinct_kept(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    first = {}
    for k, g in group.items():
        first.setdefault(g, k)
    assert set(first.values()) <= set(ids)
    assert len(ids) <= len(first) + 2


@pytest.mark.parametrize("joined", [32, 2])
def test_similar_groups_are_those_of_exact_similarity(spark, monkeypatch, joined):
    monkeypatch.setattr(simhash, "JOINED", joined)  # 2: bands are compared in blocks
    monkeypatch.setattr(simhash, "BLOCK_NODES", 16)
    random.seed(8)
    text = lambda n: [f"t{random.randrange(10**6)}" for _ in range(n)]
    line, footer = text(12), text(10)
    texts = [text(200) + line * 40 for _ in range(2)]  # a repeated line makes no copies
    body = text(200)
    texts += [body + footer * 2, body + footer * 40]  # but counts once
    base = text(120)
    for _ in range(80):  # a dense group, most pairs of it on either side of the threshold
        own = list(base)
        for k in random.sample(range(120), random.randrange(4)):
            own[k] = f"e{random.randrange(4)}"
        texts.append(own)
    texts += [[], ["One"], ["one"], ["one", "two"]]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} or {tuple(w.lower() for w in t)} for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    got = simhash.similar_groups(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.id: r.component_id for r in got} == {k: root(k) for k in range(len(texts))}
    assert root(1) == 1 and root(3) == 2


def test_linked_fingerprints_make_similar_groups(spark, monkeypatch):
    """Without bands the fingerprints still find what they link, and the exact similarity still decides."""
    with_bands = simhash.with_bands
    monkeypatch.setattr(simhash, "with_bands", lambda *a: with_bands(*a).withColumn("bands", F.array().cast("array<long>")))
    random.seed(12)
    text = lambda n: [f"t{random.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(30):
        own = text(400)
        texts += [own, own + ["end"], own[1:]]
    line = text(13)  # of an odd number of shingles: it alone decides the fingerprint
    body, other = text(60), text(60)
    texts += [line * 400 + body, line * 400 + other]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    prints = [brute_print(" ".join(t)) for t in texts]
    apart = lambda i, j: bin(prints[i] ^ prints[j]).count("1")
    assert apart(90, 91) <= 2 and 5 * len(sets[90] & sets[91]) < 4 * len(sets[90] | sets[91])
    parent = list(range(len(texts)))
    for g in range(0, 90, 3):
        for i, j in ((g, g + 1), (g, g + 2), (g + 1, g + 2)):
            if apart(i, j) <= 2 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((parent[i], parent[j]))
                parent = [low if p == high else p for p in parent]
    assert sum(p != k for k, p in enumerate(parent)) > 30
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r.id: r.component_id for r in simhash.similar_groups(df).collect()} == dict(enumerate(parent))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert kept == set(parent)


def test_bands_of_similar_sets_meet_at_any_size():
    rng = np.random.default_rng(2)
    missed = pairs = 0
    for n, times in ((10, 600), (45, 400), (180, 300), (1800, 60)):
        for _ in range(times):
            # two sets of n that share 8/9 of their shingles: similarity 0.8
            own = rng.integers(0, 1 << 63, n + n // 9 or 1, dtype=np.uint64) * np.uint64(2)
            a, b = own[:n], own[n // 9 :]
            pairs += 1
            missed += not (simhash.bands(a) == simhash.bands(b)).any()
    assert pairs > 1300 and missed == 0
    apart = rng.integers(0, 1 << 63, (2, 500), dtype=np.uint64)
    assert not (simhash.bands(apart[0]) == simhash.bands(apart[1])).any()


def test_similar_groups_in_tables_of_several_sizes(spark):
    """Recall against brute force by construction: edited copies at 0.8 or a little more, among ever more other texts."""
    random.seed(6)
    for others in (50, 1500):
        text = lambda n: [f"t{random.randrange(10**7)}" for _ in range(n)]
        rows = [(10_000 + k, " ".join(text(30))) for k in range(others)]
        for g in range(200):
            own = text(94)  # 90 shingles; two edits far apart change 10 of them: 80 of 100
            edited = list(own)
            edited[20], edited[70] = "x", "y"
            rows += [(2 * g, " ".join(own)), (2 * g + 1, " ".join(edited))]
        got = {r.id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert sum(got[2 * g + 1] == 2 * g for g in range(200)) == 200
        assert all(got[i] == i for i, _ in rows if i >= 10_000)


def test_rows_that_repeat_and_names_that_clash(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a, 0), (1, a, 0), (2, b, 1), (2, a, 2), (None, a, 3), (None, "other words only", 4), (3, None, 5), (4, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int").selectExpr("*", "key as id", "key as absent", "key as node", "key as component_id")
    kept = simhash.distinct_kept(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", a), ("2", b), ("None", "other words only"), ("3", None)], key=lambda x: (x[0], x[1]))
