"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records of chat data come in many layouts: prompt and answer, instruction and
input, lists of messages under several names, at the top of a record or inside
an object of it. The sorted paths of a record's nested fields that any layout
knows are hashed to a fingerprint, and the fingerprint selects a declarative
mapping of fields to canonical turns, ``array<struct<role, text>>``; fields
that no layout knows are passed over. The fingerprint comes from the table's
schema where the table is one layout, and from each record's own paths where
records are JSON documents of mixed layouts.

A conversation is written as one string, a turn as ``<turn role>text</turn>``
and a newline. In texts and roles ``&``, ``<`` and ``>`` are written ``&amp;``,
``&lt;`` and ``&gt;``, so that no text can be taken for a mark and unescaping
gives the text back. The loss mask is a list of runs (code points to skip, code
points to learn), one for each turn; the learned runs are the assistants'
escaped texts.

Defined results: a null text or role counts as empty; turns are ordered by
number (null first), then by role and text, so that ties and repeated rows have
one order and all stay; rows with a null conversation id are one conversation;
a record whose fingerprint has no mapping, or that is no JSON object, gets null
turns and is not dropped; of several objects with a known layout the record
itself counts first, then its fields in their order;
an empty table gives an empty table; columns that a mapping doesn't name are
passed in ``keep``. The turns of a conversation come together because its
string is one value: a conversation is never larger than the row that holds it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

TURNS = "array<struct<role: string, text: string>>"
#: Canonical roles by the names that layouts use; other names stay.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """From a layout's fields to turns: fixed roles with their fields, or a list of items with the fields of role and text.

    Several fields for a role are joined by newlines, empty ones left out.
    ``order`` names an item's number where the list's own order doesn't count;
    ``renamed`` gives the roles their canonical names.
    """

    name: str
    pairs: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: tuple[str, str, str] | None = None
    order: str | None = None
    renamed: bool = False

    @property
    def paths(self) -> list[str]:
        if self.items:
            array, role, text = self.items
            return sorted(f"{array}[].{x}" for x in (role, text, self.order) if x)
        return sorted(f for _, fields in self.pairs for f in fields)

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)

    @property
    def schema(self) -> str:
        """The layout as a type, an item's number before its other fields."""
        if self.items:
            array, role, text = self.items
            number = f"`{self.order}`: bigint, " if self.order else ""
            return f"`{array}` array<struct<{number}`{role}`: string, `{text}`: string>>"
        return ", ".join(f"`{f}` string" for f in self.paths)

    def turns(self, record: Column) -> Column:
        """The turns of a struct of this layout."""
        if self.items:
            array, role, text = self.items
            items = record[array]
            if self.order:
                numbered = F.transform(items, lambda m: F.struct(m[self.order].alias("n"), F.coalesce(m[role], F.lit("")).alias("r"), F.coalesce(m[text], F.lit("")).alias("t")))
                return F.transform(F.sort_array(numbered), lambda m: _turn(m["r"], m["t"], self.renamed))
            return F.transform(items, lambda m: _turn(m[role], m[text], self.renamed))
        made = [F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *[F.nullif(record[f], F.lit("")) for f in fields]).alias("text")) for role, fields in self.pairs]
        return F.array(*made).cast(TURNS)


MAPPINGS = (
    Mapping("prompt_completion", (("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", (("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question_answer", (("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("system_question_response", (("system", ("system_prompt",)), ("user", ("question",)), ("assistant", ("response",)))),
    Mapping("instruction_output", (("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input_output", (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("messages", items=("messages", "role", "content")),
    Mapping("conversations", items=("conversations", "from", "value"), renamed=True),
    Mapping("numbered_turns", items=("turns", "role", "text"), order="turn"),
)


def fingerprint(paths: list[str]) -> str:
    """The hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def known_paths(mappings: tuple[Mapping, ...]) -> list[str]:
    """The paths that any layout knows."""
    return sorted({p for m in mappings for p in m.paths})


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The paths of the leaves of a type; arrays add ``[]``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def _members(json: Column) -> Column:
    """The members of a JSON object as (key, value), values as variants; none if it is no object."""
    return F.map_entries(F.coalesce(F.from_json(json, "map<string, variant>"), F.expr("cast(map() as map<string, variant>)")))


def json_paths(json: Column, depth: int = 3) -> Column:
    """The paths of the leaves of a JSON object, ``depth`` objects deep; lists give the keys of all objects in them."""

    def of(m: Column) -> Column:
        key, kind = m["key"], F.schema_of_variant(m["value"])
        keys = F.flatten(F.transform(m["value"].cast("array<variant>"), lambda x: F.coalesce(F.json_object_keys(x.cast("string")), F.array().cast("array<string>"))))
        listed = F.transform(keys, lambda k: F.concat(key, F.lit("[]."), k))
        out = F.when(kind.startswith("ARRAY<OBJECT"), listed)
        if depth > 1:
            out = out.when(kind.startswith("OBJECT"), F.transform(json_paths(m["value"].cast("string"), depth - 1), lambda p: F.concat(key, F.lit("."), p)))
        return out.otherwise(F.array(key))

    return F.array_distinct(F.flatten(F.transform(_members(json), of)))


def _turn(role: Column, text: Column, renamed: bool) -> Column:
    name = F.coalesce(role, F.lit(""))
    for a, b in ROLES.items() if renamed else ():
        name = F.when(role == a, F.lit(b)).otherwise(name)
    return F.struct(name.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def canonical_turns(df: DataFrame, keep: tuple[str, ...] = (), turns: str = "turns", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``keep`` and the turns of a table whose other columns are one layout, or hold a column that is one."""
    known = set(known_paths(mappings))
    by_mark = {m.fingerprint: m for m in reversed(mappings)}
    own = T.StructType([f for f in df.schema.fields if f.name not in keep])
    roots = [(F.struct(*[F.col(f"`{f.name}`") for f in own.fields]), own), *((F.col(f"`{f.name}`"), f.dataType) for f in own.fields if isinstance(f.dataType, T.StructType))] if own.fields else []
    out = F.lit(None).cast(TURNS)
    for record, kind in reversed(roots):
        found = by_mark.get(fingerprint([p for p in field_paths(kind) if p in known]))
        out = found.turns(record) if found else out
    return df.select(*keep, out.alias(turns))


def canonical_turns_json(df: DataFrame, record: str, keep: tuple[str, ...] = (), turns: str = "turns", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``keep``, ``fingerprint`` and the turns of a column of JSON records of mixed layouts.

    The layout may be the record's own or that of an object among its fields.
    A record without a known layout has the fingerprint of all its paths.
    """
    json, found = free_name(df.select(*keep), "json", "found")
    known = F.array(*[F.lit(p) for p in known_paths(mappings)])
    hashed = lambda paths: F.sha2(F.array_join(F.array_sort(paths), "\n"), 256)
    inner = F.transform(F.filter(_members(F.col(json)), lambda m: F.schema_of_variant(m["value"]).startswith("OBJECT")), lambda m: m["value"].cast("string"))
    marked = F.transform(F.concat(F.array(F.col(json)), inner), lambda r: F.struct(r.alias("record"), hashed(F.array_intersect(json_paths(r), known)).alias("mark")))
    rows = df.select(*keep, F.col(record).cast("string").alias(json)).withColumn(found, F.get(F.filter(marked, lambda x: x["mark"].isin([m.fingerprint for m in mappings])), 0))
    out = F.lit(None).cast(TURNS)
    for m in reversed(mappings):
        out = F.when(F.col(f"{found}.mark") == m.fingerprint, m.turns(F.from_json(F.col(f"{found}.record"), m.schema))).otherwise(out)
    return rows.select(*keep, F.coalesce(f"{found}.mark", hashed(json_paths(F.col(json)))).alias("fingerprint"), out.alias(turns))


def gathered(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): a table of one row for each turn in the layout of numbered turns."""
    item = F.struct(F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.collect_list(item).alias("turns"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def formatted(df: DataFrame, turns: str = "turns", out: str = "formatted", mask: str = "loss_mask") -> DataFrame:
    """``df`` with its conversations as strings and their loss masks; null turns give null.

    ``mask``: (skip, learn) code points for each turn; what follows the last
    run is skipped.
    """
    lines = F.transform(turns, lambda t: F.concat(F.lit("<turn "), escaped(t["role"]), F.lit(">"), escaped(t["text"]), F.lit("</turn>\n")))
    head = lambda t: F.length(escaped(t["role"])) + 7
    body = lambda t: F.length(escaped(t["text"]))
    tail = 8  # </turn> and the newline, skipped before the next turn
    learned = lambda t: t["role"] == "assistant"
    runs = F.transform(
        turns,
        lambda t, i: F.struct(
            (head(t) + F.when(i > 0, F.lit(tail)).otherwise(0) + F.when(learned(t), F.lit(0)).otherwise(body(t))).alias("skip"),
            F.when(learned(t), body(t)).otherwise(0).alias("learn"),
        ),
    )
    return df.withColumns({out: F.array_join(lines, ""), mask: runs})


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string."""
    lines = F.filter(F.split(formatted, "</turn>\n"), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(unescaped(F.substring(F.substring_index(x, ">", 1), 7, 1 << 30)).alias("role"), unescaped(F.substring_index(x, ">", -1)).alias("text")))


def learned(formatted: Column, mask: Column) -> Column:
    """The text under the loss mask, unescaped."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    step = lambda acc, run: F.struct(
        (acc["at"] + run["skip"] + run["learn"]).alias("at"),
        F.concat(acc["text"], formatted.substr(acc["at"] + run["skip"] + 1, run["learn"])).alias("text"),
    )
    return unescaped(F.aggregate(mask, start, step, lambda acc: acc["text"]))
