import random
from collections import defaultdict

from axiomata.llm import line_templates as L


def brute(texts):
    """The rules of the module on lists."""
    docs_of_leaf, docs_of_line, leaf_of = defaultdict(set), defaultdict(set), {}
    for d, text in enumerate(texts):
        for line in (text or "").split("\n"):
            tokens = tuple(L.masked(line))
            if tokens:
                leaf_of[tokens] = (len(tokens), tokens[: L.DEPTH])
                docs_of_leaf[leaf_of[tokens]].add(d)
                docs_of_line[tokens].add(d)
    enough = lambda n: 2 if n >= L.LONG else L.MIN_DOCS
    good = {leaf for leaf, d in docs_of_leaf.items() if len(d) >= enough(leaf[0])}
    at = defaultdict(int)
    for tokens, d in docs_of_line.items():
        if leaf_of[tokens] in good:
            for place, token in enumerate(tokens):
                at[leaf_of[tokens], place, token] += len(d)
    shape = {t: (leaf_of[t], tuple(w if w != L.WILD and at[leaf_of[t], p, w] >= enough(len(t)) else None for p, w in enumerate(t))) for t in docs_of_line if leaf_of[t] in good}
    shape = {t: s for t, s in shape.items() if sum(x is not None for x in s[1]) / len(t) >= L.CONSTANT}
    rows = defaultdict(set)
    for t, s in shape.items():
        rows[s] |= docs_of_line[t]
    drop = {t for t, s in shape.items() if len(rows[s]) >= enough(len(t))}
    return [None if t is None else "\n".join(x for x in t.split("\n") if tuple(L.masked(x)) not in drop) for t in texts]


def test_against_brute_force(spark):
    random.seed(2)
    lines = ["All rights reserved here today", "Page {} of {} total pages", "User {} logged in from home office", "short", "", "  "]
    texts = []
    for _ in range(40):
        own = [" ".join(random.choice("abcdefgh") for _ in range(random.randrange(1, 6))) for _ in range(4)]
        own += [x.replace("{}", str(random.randrange(1000))) for x in random.sample(lines, 3)] + [f"User {random.choice(['ann', 'bob', 'cy', 'di'])} logged in from home office"]
        random.shuffle(own)
        texts.append("\n".join(own))
    passage = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    texts += [f"before\n{passage}\nafter", f"other\n{passage}", "Only here 1 of it\nOnly here 2 of it\nOnly here x of it\nOnly here y of it"]
    texts += [None, "", "\n\n", texts[0], texts[0]]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, key string")
    got = {r.doc_id: r for r in L.without_recurring(df).collect()}
    want = brute(texts)
    for k, t in enumerate(texts):
        assert got[k].text == want[k], k
        assert got[k].n_lines == (0 if t is None else len(t.split("\n")))
    assert any(r.n_dropped for r in got.values())


def test_variable_fields_are_one_template(spark):
    own = ["zeta alpha kilo", "more own words stand here", "some other text of its own"]
    df = spark.createDataFrame([(k, f"Order {k} shipped to customer on day {k * 7}\n{own[k]}") for k in range(3)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in L.without_recurring(df).collect()} == dict(enumerate(own))


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a line of text", 0)] * 3 + [(None, "own line", 0)], "doc_id long, text string, n int")
    got = L.without_recurring(df, n_lines="lines", n_dropped="dropped").collect()
    assert sorted(r.text for r in got) == ["", "", "", "own line"]
    assert L.without_recurring(df.limit(0)).count() == 0


def test_long_passages_of_two_documents_go_and_lines_of_one_stay(spark):
    passage = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(55))
    texts = [f"one own line\n{passage}", f"{passage}\nanother own line", "Item 1 of my list\nItem 2 of my list\nItem 3 of my list\nItem 4 of my list", "short line here", "short line here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.without_recurring(df).collect()}
    assert got == {0: "one own line", 1: "another own line", 2: texts[2], 3: texts[3], 4: texts[4]}


def test_names_that_clash(spark):
    df = spark.createDataFrame([(k, "the same line in all", "x") for k in range(3)], "doc_id long, text string, n_lines string").selectExpr("*", "n_lines as key", "n_lines as key2", "n_lines as gone", "n_lines as line", "n_lines as __key")
    got = L.without_recurring(df)
    assert got.columns == ["doc_id", "text", "key", "key2", "gone", "line", "__key", "n_lines", "n_dropped"]
    assert [(r.text, r.key, r.n_lines, r.n_dropped) for r in got.collect()] == [("", "x", 1, 1)] * 3
