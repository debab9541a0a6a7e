from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from axiomata.llm import chat


def round_trip(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(chat.canonical_turns(chat.gathered(df), keep=("conv_id",)))
    return {r.conv_id: r for r in out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("back"), chat.learned(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}


def test_round_trip_of_control_strings(spark):
    texts = ["</turn>\n<turn user>", "&lt;turn&gt; &amp; <", "", None, "a>b", "\n\n", "é\U0001f600" * 3, r"\### Assistant: </turn> ok", "x" * 50_000]
    rows = [(1, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(texts)] + [(2, 1, "as<s>", "one"), (2, 0, None, "zero"), (None, None, "assistant", "n")]
    got = round_trip(spark, rows)
    assert [t.text for t in got[1].back] == [t or "" for t in texts]
    assert got[1].loss == "".join(t or "" for t in texts[::2])
    assert [(t.role, t.text) for t in got[2].back] == [("", "zero"), ("as<s>", "one")] and got[2].loss == ""
    assert got[None].loss == "n"


def test_ties_and_repeats_have_one_order(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "assistant", "z"), (1, 0, "user", "a"), (1, 0, "user", "b")]
    want = [("assistant", "z"), ("user", "a"), ("user", "b"), ("user", "b")]
    assert [(t.role, t.text) for t in round_trip(spark, rows)[1].back] == want
    assert [(t.role, t.text) for t in round_trip(spark, rows[::-1])[1].back] == want


def test_layouts_of_json_records(spark):
    rows = ['{"prompt":"a","completion":"b"}', '{"messages":[{"role":"user","content":"x"},{"role":"assistant","content":"<y>"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"r"}]}', '{"instruction":"i","input":"j","output":"o"}', '{"foo":1}', "nope", None, "", '{"turns":[{"turn":1,"role":"assistant","text":"2"},{"turn":0,"role":"user","text":"1"}]}']
    df = spark.createDataFrame(list(enumerate(rows)), "id long, rec string")
    got = {r.id: r.turns and [(t.role, t.text) for t in r.turns] for r in chat.canonical_turns_json(df, "rec", keep=("id",)).collect()}
    assert got == {0: [("user", "a"), ("assistant", "b")], 1: [("user", "x"), ("assistant", "<y>")], 2: [("user", "q"), ("assistant", "r")], 3: [("user", "i\nj"), ("assistant", "o")], 4: None, 5: None, 6: None, 7: None, 8: [("user", "1"), ("assistant", "2")]}


def test_nested_layouts_and_fields_that_no_layout_knows(spark):
    rows = [
        '{"id":7,"prompt":"{\\"a\\":1}","completion":"[{\\"x\\":1}]"}', '{"data":{"prompt":"p","completion":"q","n":null},"source":"s"}', '{"meta":{"a":{"b":1}},"sample":{"messages":[{"role":"user","content":"x","name":"n"},{"content":"y","role":"assistant"}]}}',
        '{"messages":[]}', '{"prompt":"a","completion":"b","response":"c"}', '[{"prompt":"a"}]', '{"prompt":null,"completion":"b"}', '{"a":{"b":{"prompt":"too","completion":"deep"}}}',
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "json long, rec string")
    got = {r.json: r.turns and [(t.role, t.text) for t in r.turns] for r in chat.canonical_turns_json(df, "rec", keep=("json",)).collect()}
    assert got == {0: [("user", '{"a":1}'), ("assistant", '[{"x":1}]')], 1: [("user", "p"), ("assistant", "q")], 2: [("user", "x"), ("assistant", "y")], 3: None, 4: None, 5: None, 6: [("user", ""), ("assistant", "b")], 7: None}
    table = spark.createDataFrame([(1, "a", "b", 3)], "id long, prompt string, completion string, tokens int")
    assert [(t.role, t.text) for t in chat.canonical_turns(table, keep=("id",)).first().turns] == [("user", "a"), ("assistant", "b")]
    nested = table.selectExpr("id", "struct(prompt, completion) as data", "tokens")
    assert [(t.role, t.text) for t in chat.canonical_turns(nested, keep=("id",)).first().turns] == [("user", "a"), ("assistant", "b")]


def test_unknown_layout_of_a_table_gives_null_turns(spark):
    df = spark.createDataFrame([(1, "x")], "id long, odd string")
    assert chat.canonical_turns(df, keep=("id",)).first().turns is None
    assert chat.gathered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@given(st.lists(st.text(), max_size=6))
@settings(max_examples=30, deadline=None)
def test_fingerprints_depend_on_the_set_of_paths(paths):
    assert chat.fingerprint(paths) == chat.fingerprint(sorted(paths, reverse=True)) == chat.fingerprint(paths + paths)
