"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from patterns: the four base kinds (e-mail, IP address,
card, phone), which always stay when they are valid, and wider ones (secrets,
phone numbers without a plus, spelled-out e-mail addresses, bank accounts,
national and passport numbers, dates of birth, street addresses, persons with
a title), which the method decides. Base matches that fail their check are
never added, but their votes count in the estimation. Three labelers vote on
each candidate, for, against or not at all: a regex on its shape, a gazetteer
of names, places, providers and prefixes, and the words around it. The table
of vote patterns is counted over all documents; its size is bounded by kinds
times votes whatever the input. Expectation-maximisation on that table
estimates how reliable each labeler is and how likely each pattern is personal
data. A logistic classifier over votes and shape features is then fitted to
these soft labels, again on a counted table of bounded size, and becomes one
SQL expression that decides the added spans where the text is read.

A secret has at least one digit. Positions are sums of the lengths of matches and of the gaps between them,
built in blocks so that a text with very many matches costs little more than
its length; which added spans overlap a base one is found by running limits
over the ordered spans in the same way. All patterns are anchored and
possessive: none goes back over a long run, and none recurses.

Defined results: a null or empty text has no spans; positions are code points,
the end exclusive; base matches that fail their check are dropped without a
retry; repeated rows get the same result each; an added span that overlaps a
base span of its document is left out; an empty table gives an empty table, and
a table without candidates trains nothing and adds nothing. Further columns of
the input, of any name, are passed in ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: The base kinds in the order in which equal starts are listed.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {
    "secret": r"[A-Za-z0-9+/_-]{16,}+=*+",
    "local_phone": r"(?=[0-9(])(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])",
    "spelled_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "passport": r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,8}(?![A-Za-z0-9])",
    "birth_date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9])",
    "street_address": r"(?<![A-Za-z0-9])[0-9]{1,5}\x20(?:[A-Z][a-z]{1,20}\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Sq|Way|Place|Pl)(?![A-Za-z])",
    "person": r"(?<![A-Za-z])(?:Mrs|Mr|Ms|Dr|Herr|Frau|Mme|Sra|Sr)\.?+\x20[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?+(?![a-z])",
}
TITLES = ("Mrs", "Mr", "Ms", "Dr", "Herr", "Frau", "Mme", "Sra", "Sr")
#: Strings of which a text must contain one before a pattern is tried, or None for a digit; saves passes and loses no candidate.
NEEDS = {"email": ("@",), "ip": None, "card": None, "phone": ("+",), "secret": None, "local_phone": None, "spelled_email": ("(at)", "[at]", "{at}"), "iban": None, "national_id": None, "passport": None, "birth_date": None, "street_address": None, "person": TITLES}
#: Code points of context on each side.
AROUND = 32
BLOCK = 512
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: The gazetteer: given names, providers and top-level domains of mail, places that bank accounts begin with, dialling codes, first digits of cards, private networks, prefixes of keys, names of streets.
GIVEN_NAMES = "Alice Anna Anne Antonio Barbara Carlos Carmen Charles Christine Claire Daniel David Elena Elizabeth Emma Francois Hans James Jan Jean Jennifer John Jose Juan Karl Laura Linda Lucas Luis Maria Marie Mark Mary Michael Miguel Patricia Paul Peter Pierre Robert Sarah Sofia Sophie Susan Thomas William".split()
PROVIDERS = "gmail googlemail yahoo hotmail outlook live icloud aol gmx web proton protonmail mail fastmail orange free laposte telefonica yandex".split()
DOMAINS = "com org net edu gov io de fr es uk".split()
BANK_PLACES = "AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK".split()
DIALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 81 82 86 90 91".split()
CARD_PREFIXES = "4 5[1-5] 2[2-7] 3[47] 6".split()
PRIVATE_NETWORKS = "10 127 172 192".split()
KEY_PREFIXES = "AKIA ASIA ghp_ gho_ xoxb xoxa xoxp sk- pk_ eyJ".split()
STREETS = "Main Oak Pine Maple Cedar Elm Park Lake Hill Church High Station King Queen Victoria Washington Broadway Mill Bridge".split()


def _any(words: list[str]) -> str:
    return f"(?:{'|'.join(words)})"


#: Shape, known values and surrounding words that speak for and against a kind.
SHAPE_FOR = {
    "email": r"\.[A-Za-z]{2,}$",
    "ip": rf"^{PART}(?:\.{PART}){{3}}$",
    "card": r"^[0-9 -]{14,}$",
    "phone": r"^\+[0-9]{1,3}[ (.-]",
    "secret": r"^(?=.*[0-9])(?=.*[a-zA-Z])[A-Za-z0-9+/_=-]{20,}$",
    "local_phone": r"^\([0-9]{3}\)",
    "spelled_email": r"(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z]{2,}$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4})+",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "birth_date": r"^(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-|[./](?:19|20)[0-9]{2}$",
    "street_address": r"^[0-9]{1,5} ",
    "person": r"[a-z] [A-Z]",
}
SHAPE_AGAINST = {"secret": r"^[A-Za-z]+$|^[0-9]+$|^[-_=+/]+$|/.*/", "local_phone": r"[.].*[-]|[-].*[.]", "ip": r"^0"}
KNOWN_FOR = {
    "email": rf"(?i)@{_any(PROVIDERS)}\.|\.{_any(DOMAINS)}$",
    "card": rf"^{_any(CARD_PREFIXES)}",
    "phone": rf"^\+{_any(DIALLING_CODES)}(?![0-9])",
    "ip": rf"^{_any(PRIVATE_NETWORKS)}\.",
    "secret": rf"^{_any(KEY_PREFIXES)}|^[0-9a-f]{{32,}}$",
    "local_phone": r"[. -]555[. -]",
    "spelled_email": rf"(?i){_any(DOMAINS)}$",
    "iban": rf"^{_any(BANK_PLACES)}",
    "street_address": rf" {_any(STREETS)} ",
    "person": rf" {_any(GIVEN_NAMES)}(?![a-z])",
}
#: What no one of the gazetteer is: a date or a number alone is nobody's.
KNOWN_AGAINST = {"iban": rf"^(?!{_any(BANK_PLACES)})"}
WORDS_FOR = {
    "email": r"(?i)e-?mail|contact|write to|reach",
    "ip": r"(?i)\bip\b|address|host|server|login",
    "card": r"(?i)card|visa|master|credit|payment|account",
    "phone": r"(?i)phone|tel\b|call|mobile|fax|cell",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|pwd|credential|api[ _-]?key|access[ _-]?key|private[ _-]?key)[\"' ]{0,3}[:=]",
    "local_phone": r"(?i)phone|tel\b|call|mobile|fax|cell",
    "spelled_email": r"(?i)e-?mail|contact|write to|reach",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
    "national_id": r"(?i)\bssn\b|social security|national id|identity",
    "passport": r"(?i)passport|reisepass|passeport|pasaporte",
    "birth_date": r"(?i)\bborn\b|birth|\bdob\b|geboren|n\u00e9e? le|nacid[oa]",
    "street_address": r"(?i)address|lives|resides|office|home|mail to|ship",
    "person": r"(?i)contact|name|signed|dear|patient|customer|from|by",
}
WORDS_AGAINST = {
    "secret": r"(?i)(?:sha|md5|commit|digest|checksum|hash|https?:|www\.)",
    "local_phone": r"(?i)(?:isbn|order|invoice|serial)",
    "ip": r"(?i)version",
    # without a word for them these are numbers and dates of any kind
    "national_id": r"(?i)^(?!.*(?:\bssn\b|social security|national id|identity))",
    "passport": r"(?i)^(?!.*(?:passport|reisepass|passeport|pasaporte))",
    "birth_date": r"(?i)^(?!.*(?:\bborn\b|birth|\bdob\b|geboren|n\u00e9e? le|nacid[oa]))",
}
KINDS = [*BASE, *WIDER]
CANDIDATE = "array<struct<start: bigint, stop: bigint, kind: string, shape: int, known: int, words: int, size: int, digits: int, valid: boolean>>"


def prefixes(name: str, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each element of the array column ``name`` (bigint) the fold of the elements before it, from ``first``.

    ``step`` is associative with ``first`` as its neutral element. Blocks keep
    the growing arrays short; ``name`` has to be a plain column, as an
    expression would be built anew for every element.
    """
    values = F.col(name)
    none = F.array().cast("array<bigint>")
    n = F.size(values)

    def running(block: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), none.alias("out"))
        return F.aggregate(block, state, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    starts = F.sequence(F.lit(1), n, F.lit(BLOCK))
    blocks = F.transform(starts, lambda k: F.slice(values, k, BLOCK))
    totals = F.transform(starts, lambda k: F.aggregate(F.slice(values, k, BLOCK), first, step))
    return F.when(n == 0, none).when(n <= BLOCK, running(values, first)).otherwise(F.flatten(F.zip_with(blocks, running(totals, first), running)))


def prefix_sums(name: str) -> Column:
    """The sums of the elements before each element."""
    return prefixes(name, F.lit(0).cast("bigint"), lambda a, x: a + x)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check; characters are counted from the right."""
    places = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.substring(digits, -i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)).otherwise(value(i))
    return F.aggregate(F.transform(places, doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    """The check of a base match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(value) > 37, F.lit(False)).otherwise(F.length(digits).between(14, 19) & luhn(digits))
    return F.length(digits).between(10, 15)


def _vote(kind: str, text: Column, for_: dict[str, str], against: dict[str, str]) -> Column:
    """1 for, -1 against, 0 no opinion."""
    out = F.lit(0)
    if kind in for_:
        out = F.when(text.rlike(for_[kind]), F.lit(1)).otherwise(out)
    if kind in against:
        out = F.when(text.rlike(against[kind]), F.lit(-1)).otherwise(out)
    return out


def candidates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "found") -> DataFrame:
    """``keep`` and ``out``: the array of candidates of each row, with votes and features."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    u = "__"
    while any(c.lower().startswith(u) for c in keep):
        u += "_"
    rows = docs.select(*keep, body.alias(f"{u}text"))
    patterns = BASE | WIDER
    none = F.array().cast("array<string>")
    rows = rows.withColumn(f"{u}digit", F.col(f"{u}text").rlike("[0-9]"))

    def some(kind: str) -> Column:
        if NEEDS[kind] is None:
            return F.col(f"{u}digit")
        out = F.lit(False)
        for needed in NEEDS[kind]:
            out = out | F.contains(F.col(f"{u}text"), F.lit(needed))
        return out

    rows = rows.select(*keep, f"{u}text", *[F.when(some(k), F.regexp_extract_all(f"{u}text", F.lit(patterns[k]), F.lit(0))).otherwise(none).alias(f"{u}m_{k}") for k in KINDS])
    rows = rows.select(*keep, *[f"{u}m_{k}" for k in KINDS], *[F.when(F.size(f"{u}m_{k}") > 0, F.split(f"{u}text", patterns[k], -1)).otherwise(none).alias(f"{u}g_{k}") for k in KINDS])
    # gap and match lengths: an element for each match, and the gap alone before it
    rows = rows.withColumns({f"{u}l_{k}": F.zip_with(F.col(f"{u}m_{k}"), F.slice(f"{u}g_{k}", 1, F.size(f"{u}m_{k}")), lambda m, g: (F.length(m) + F.length(g)).cast("bigint")) for k in KINDS})
    rows = rows.withColumns({f"{u}s_{k}": prefix_sums(f"{u}l_{k}") for k in KINDS})
    return rows.select(*keep, F.concat(*[_structs(k, u) for k in KINDS]).alias(out))


def _structs(kind: str, u: str) -> Column:
    matches, gaps, sums = (F.col(f"{u}{x}_{kind}") for x in "mgs")

    def one(value: Column, i: Column) -> Column:
        left, right = F.right(F.get(gaps, i), F.lit(AROUND)), F.left(F.get(gaps, i + 1), F.lit(AROUND))
        start = F.get(sums, i) + F.length(F.get(gaps, i))
        return F.struct(
            start.alias("start"),
            (start + F.length(value)).alias("stop"),
            F.lit(kind).alias("kind"),
            _vote(kind, value, SHAPE_FOR, SHAPE_AGAINST).alias("shape"),
            _vote(kind, value, KNOWN_FOR, KNOWN_AGAINST).alias("known"),
            _vote(kind, F.concat(left, F.lit(" | "), right), WORDS_FOR, WORDS_AGAINST).alias("words"),
            F.least(F.lit(4), F.floor(F.length(value) / 10)).cast("int").alias("size"),
            F.floor(F.length(F.regexp_replace(value, "[^0-9]", "")) * 4 / F.length(value)).cast("int").alias("digits"),
            (_valid(kind, value) if kind in BASE else F.lit(False)).alias("valid"),
        )

    # plain numbers would make candidates of every digit pair; those that can't be cards are no candidates
    out = F.transform(matches, one)
    if kind == "card":
        out = F.filter(out, lambda c: c["valid"] | (c["stop"] - c["start"]).between(12, 40))
    return out.cast(CANDIDATE)


# --- estimation on counted tables of bounded size -------------------------------------------------


#: Votes that labelers are believed to give personal data and other spans, and the share that this belief has in what is estimated, so that a kind on which one labeler votes has a solution.
BELIEF, WEIGHT = {1: (0.7, 0.1), 0: (0.25, 0.4), -1: (0.05, 0.5)}, 0.5


def reliabilities(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> tuple[dict[str, float], dict[str, list[dict[int, tuple[float, float]]]], dict[tuple[str, tuple[int, ...]], float]]:
    """(prior by kind, for each kind and labeler P(vote | personal) and P(vote | other), posterior by pattern) by expectation-maximisation.

    ``counts``: kind, votes, number. Labelers are taken as independent given
    the truth, and each has its own reliability for each kind, so a labeler
    that never votes on a kind says nothing there. Of the two solutions the one
    is found that ``BELIEF`` and a start from majorities lead to.
    """
    post = {(k, v): min(0.95, max(0.05, 0.35 + 0.25 * sum(v))) for k, v, _ in counts}
    prior: dict[str, float] = {}
    model: dict[str, list[dict[int, tuple[float, float]]]] = {}
    for _ in range(rounds):
        total, good = {}, {}
        sums = {k: [{x: [0.0, 0.0] for x in BELIEF} for _ in v] for k, v, _ in counts}
        for k, v, n in counts:
            p = post[k, v]
            total[k] = total.get(k, 0) + n
            good[k] = good.get(k, 0) + n * p
            for own, x in zip(sums[k], v, strict=True):
                own[x][0] += n * p
                own[x][1] += n * (1 - p)
        prior = {k: (good[k] + 0.15 * total[k]) / (1.5 * total[k]) for k in total}
        mixed = lambda x, seen, side: (1 - WEIGHT) * seen[x][side] / max(1e-9, sum(y[side] for y in seen.values())) + WEIGHT * BELIEF[x][side]
        model = {k: [{x: (mixed(x, seen, 0), mixed(x, seen, 1)) for x in BELIEF} for seen in own] for k, own in sums.items()}
        for k, v, _ in counts:
            yes, no = log(prior[k]), log(1 - prior[k])
            for own, x in zip(model[k], v, strict=True):
                yes, no = yes + log(own[x][0]), no + log(own[x][1])
            post[k, v] = 1 / (1 + exp(max(-50.0, min(50.0, no - yes))))
    return prior, model, post


def features(kind: str, votes: tuple[int, ...], size: int, digits: int) -> list[str]:
    """The names of a candidate's active features."""
    return ["bias", f"kind={kind}", *(f"vote{j}={x}" for j, x in enumerate(votes)), *(f"{kind}.vote{j}={x}" for j, x in enumerate(votes)), f"{kind}.size={size}", f"{kind}.digits={digits}"]


def fit(rows: list[tuple[list[str], float, int]], rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> dict[str, float]:
    """Logistic weights from (features, soft label, number) by gradient steps scaled for each feature."""
    weights: dict[str, float] = {}
    scale: dict[str, float] = {}
    total = float(sum(n for _, _, n in rows)) or 1.0
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for names, label, n in rows:
            z = sum(weights.get(f, 0.0) for f in names)
            error = (1 / (1 + exp(-max(-30.0, min(30.0, z)))) - label) * n / total
            for f in names:
                slope[f] = slope.get(f, 0.0) + error
        for f, g in slope.items():
            g += ridge * weights.get(f, 0.0)
            scale[f] = scale.get(f, 0.0) + g * g
            weights[f] = weights.get(f, 0.0) - rate * g / (scale[f] ** 0.5 + 1e-12)
    return weights


def train(found: DataFrame, column: str = "found") -> dict[str, float]:
    """The classifier's weights, from all candidates of ``candidates``.

    The driver gets counts by kind, votes, size and digit share: at most
    13 * 27 * 5 * 5 rows.
    """
    # The outer form infers no filter on the array's size. Pushed below the columns that the
    # array is built from, that filter would build them anew for every candidate.
    table = found.select(F.inline_outer(column)).groupBy("kind", "shape", "known", "words", "size", "digits").count().collect()
    table = [r for r in table if r["kind"] is not None]
    patterns: dict[tuple[str, tuple[int, ...]], int] = {}
    for r in table:
        key = (r["kind"], (r["shape"], r["known"], r["words"]))
        patterns[key] = patterns.get(key, 0) + r["count"]
    _, _, post = reliabilities(sorted((k, v, n) for (k, v), n in patterns.items()))
    rows = [(features(r["kind"], v, r["size"], r["digits"]), post[r["kind"], v], r["count"]) for r in table for v in [(r["shape"], r["known"], r["words"])]]
    return fit(sorted(rows))


def _score(weights: dict[str, float], c: Column) -> Column:
    """The classifier's log-odds for a candidate, as one expression."""

    def pick(value: Column, names: dict) -> Column:
        out = F.lit(0.0)
        for x, w in names.items():
            out = F.when(value == x, F.lit(w)).otherwise(out)
        return out

    z = F.lit(weights.get("bias", 0.0)) + pick(c["kind"], {k: weights.get(f"kind={k}", 0.0) for k in WIDER})
    for j, vote in enumerate(("shape", "known", "words")):
        z = z + pick(c[vote], {x: weights.get(f"vote{j}={x}", 0.0) for x in (-1, 0, 1)})
    for k in WIDER:
        own = F.lit(0.0)
        for j, vote in enumerate(("shape", "known", "words")):
            own = own + pick(c[vote], {x: weights.get(f"{k}.vote{j}={x}", 0.0) for x in (-1, 0, 1)})
        own = own + pick(c["size"], {x: weights.get(f"{k}.size={x}", 0.0) for x in range(5)}) + pick(c["digits"], {x: weights.get(f"{k}.digits={x}", 0.0) for x in range(5)})
        z = z + F.when(c["kind"] == k, own).otherwise(F.lit(0.0))
    return z


def personal_data(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), base: str = "base", spans: str = "spans") -> DataFrame:
    """``keep``, ``base`` and ``spans``: arrays of (start, rank, stop, kind), ordered; spans holds base and added ones."""
    own = docs.select(*keep)
    column, every, ends, starts, reach, ahead = free_name(own, "found", "every", "ends", "starts", "reach", "ahead")
    found = candidates(docs, text, keep, column)
    weights = train(found, column)
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    plain = lambda c: F.struct(c["start"].alias("start"), F.element_at(rank, c["kind"]).alias("rank"), c["stop"].alias("stop"), c["kind"].alias("kind"))
    added = lambda c: c["kind"].isin([*WIDER]) & (_score(weights, c) >= 0)
    rows = found.select(*keep, F.array_sort(F.transform(F.filter(column, lambda c: c["valid"] | added(c)), plain)).alias(every))
    is_base = lambda s: s["rank"] < len(BASE)
    # an added span is apart from all base ones if none before it reaches into it and none after it starts in it
    none, far = F.lit(-1).cast("bigint"), F.lit(1 << 62).cast("bigint")
    rows = rows.withColumns({ends: F.transform(every, lambda s: F.when(is_base(s), s["stop"]).otherwise(none)), starts: F.reverse(F.transform(every, lambda s: F.when(is_base(s), s["start"]).otherwise(far)))})
    mixed = F.exists(every, lambda s: ~is_base(s)) & F.exists(every, is_base)
    rows = rows.withColumns({reach: F.when(mixed, prefixes(ends, none, lambda a, x: F.greatest(a, x))), ahead: F.when(mixed, F.reverse(prefixes(starts, far, lambda a, x: F.least(a, x))))})
    apart = F.filter(every, lambda s, i: is_base(s) | ((F.get(F.col(reach), i) <= s["start"]) & (F.get(F.col(ahead), i) >= s["stop"])))
    return rows.select(*keep, F.filter(every, is_base).alias(base), F.when(mixed, apart).otherwise(F.col(every)).alias(spans))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
