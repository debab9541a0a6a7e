import re

from pyspark.sql import functions as F

from axiomata.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]():
                out.append((m.start(), rank, m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


TEXTS = [
    None, "", "no data", "1.2.3.4@x.com 4111111111111111@y.z +14111111111111111", "a@b.c_d@e.f x@y", "a.b%c@d-e.f.g, @x.y a@.b c@d..e", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3 999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111110000 4111111111111111 5500 0000 0000 0004 378282246310005", "+1 (535) 555-5412 ++1 23 +1234567890123456 +49.30.1234567-",
    "é\U0001f600 a@b.de \U0001f600 +1 (535) 555-5412", "1 " * 40, "4" * 3000, "a" * 5000 + "@", "." * 3000, "+" * 500 + "12345678901", "x@y.z" * 700, "9-" * 200,
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and john (at) example (dot) com or call (535) 555-5412',
]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.personal_data(df).collect()}


def test_base_spans(spark):
    got = found(spark, TEXTS)
    for k, t in enumerate(TEXTS):
        assert [(s.start, s.stop, s.kind) for s in got[k].base] == brute(t), t
        assert {(s.start, s.stop, s.kind) for s in got[k].base} <= {(s.start, s.stop, s.kind) for s in got[k].spans}


def test_added_spans(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f96"
    texts = [f'token = "{key}{k % 10}" ok' for k in range(40)] + [f"see averylongwordwithoutdigits{'x' * k} now 1" for k in range(20)] + ["a@b.com plain"] * 20
    got = found(spark, texts)
    assert all([(s.start, s.stop, s.kind) for s in got[k].spans] == [(9, 49, "secret")] for k in range(40))
    assert all(not got[k].spans for k in range(40, 60))


def test_empty_table_and_kept_columns(spark):
    df = spark.createDataFrame([(1, "a@b.c", "z")] * 2, "doc_id long, text string, kind string")
    assert [r.kind for r in pii.personal_data(df, keep=("doc_id", "kind")).collect()] == ["z", "z"]
    assert pii.personal_data(df.limit(0)).count() == 0


def test_wider_kinds_and_dates_of_nobody(spark):
    kinds = {
        "iban": "Bank account IBAN DE89 3704 0044 0532 0130 00 for payment", "national_id": "her SSN 123-45-6789 is", "passport": "passport no C1234567 of", "birth_date": "born 1980-02-03 in",
        "street_address": "lives at 12 Oak Street now", "person": "signed by Dr. Maria Lopez today",
    }
    texts = [t for t in kinds.values() for _ in range(12)] + ["on 1999-01-02 and 3.4.2005 we met", "code AB123456 and part 123-45-6789 in stock", "XX12 3456 7890 1234 of it"] * 12
    got = found(spark, texts)
    for k, t in enumerate(texts):
        want = [kind for kind, x in kinds.items() if x == t]
        assert [s.kind for s in got[k].spans] == want, (t, got[k].spans)


def test_added_spans_that_overlap_base_ones_go(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f96"
    texts = [f'token = "{key}{k % 10}" ok' for k in range(40)]
    texts += [f'token = "{key}1@mail.com" x', f'1.2.3.4 token = "{key}2" a@b.com password = "{key}3"', f'token = "{key}4" ' * 900 + "a@b.com " * 900, "Call (535) 555-5412+14155550123 now"]
    got = found(spark, texts)
    for k, t in enumerate(texts):
        base = [(s.start, s.stop) for s in got[k].base]
        assert all(b <= s.start or s.stop <= a for s in got[k].spans if s.kind not in BASE for a, b in base), t[:60]
    assert [s.kind for s in got[40].spans] == ["email"] and [s.kind for s in got[41].spans] == ["ip", "secret", "email", "secret"]
    assert len(got[42].spans) == 1800 and [s.start for s in got[42].spans] == sorted(s.start for s in got[42].spans)


def test_running_folds_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 4)
    for n in (0, 3, 4, 9, 40):
        xs = [(7 * k) % 11 for k in range(n)]
        row = spark.createDataFrame([(xs,)], "v array<bigint>").select(pii.prefix_sums("v").alias("s"), pii.prefixes("v", F.lit(-1).cast("bigint"), lambda a, x: F.greatest(a, x)).alias("m")).first()
        assert row.s == [sum(xs[:k]) for k in range(n)] and row.m == [max(xs[:k], default=-1) for k in range(n)]


def test_kept_columns_may_have_any_name(spark):
    df = spark.createDataFrame([(1, "mail a@b.com")], "doc_id long, text string").selectExpr("*", "doc_id as found", "doc_id as __text", "doc_id as __m_email", "doc_id as every", "doc_id as reach")
    row = pii.personal_data(df, keep=("doc_id", "found", "__text", "__m_email", "every", "reach")).first()
    assert row.found == row.__getitem__("__text") == row.every == row.reach == 1 and len(row.spans) == 1


def test_reliabilities_tell_good_labelers_from_bad():
    counts = [("k", (1, 1, 0), 400), ("k", (-1, -1, 0), 500), ("k", (1, -1, 1), 10), ("k", (-1, 1, -1), 10), ("k", (1, 1, -1), 60), ("k", (-1, -1, 1), 60)]
    _, model, post = pii.reliabilities(counts)
    assert post["k", (1, 1, 0)] > 0.9 > 0.1 > post["k", (-1, -1, 0)]
    assert model["k"][0][1][0] > model["k"][0][1][1]
