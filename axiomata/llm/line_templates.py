"""Line dedup by a tree of log templates.

Each line is a list of tokens; a token with a digit is a variable field. The
tree has a fixed depth: a line goes to the leaf named by its number of tokens
and its ``DEPTH`` leading tokens, variable ones as wild cards. Inside a leaf a
token is constant at its position if lines that have it there occur in
documents often enough, summed over the lines; what remains is the line's
template. Templates recur if enough different documents have a line of them
and at least ``CONSTANT`` of the tokens are constant; all lines that follow
one are dropped. Enough is ``MIN_DOCS`` documents, or two for lines of
``LONG`` tokens or more, which don't meet by chance.

All counts cover all documents and are sums that combine before their
shuffles. Equal lines are counted once as (leaf, line) with their documents;
only one line of each such group, and only in leaves that recur and have lines
that don't recur by themselves, has its tokens read. So a line that a third of the documents share is one row of the
tree. Documents that have several lines of a template count once for it: where
a template has more than one line its occurrences are joined by document. A
line is known by 96 bits of hashes beside its leaf, a row by 96 bits.

Defined results: a null text stays null and has no lines; blank lines belong
to no template and stay; the remaining lines keep their order and are joined
by newlines; a line that repeats inside one document counts once for it;
repeated rows count as separate documents and get the same result each; the
other columns stay, but for columns named like the two results, which give
way; an empty table gives an empty table. Lines of any length are taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, written

DEPTH, MIN_DOCS, CONSTANT = 3, 3, 0.6
#: Tokens from which a line recurs in two documents already.
LONG = 20
WILD = b"<*>"
_digit = re.compile(rb"[0-9]").search


_hash = xxhash.xxh64_intdigest


def masked(line: str | bytes) -> list[bytes]:
    """The tokens of a line, between ASCII white space, in UTF-8; variable fields as wild cards."""
    data = line.encode("utf-8", "surrogatepass") if isinstance(line, str) else line
    tokens = data.split()
    return [WILD if _digit(t) else t for t in tokens] if _digit(data) else tokens


def leaf_and_line(line: str | bytes, depth: int = DEPTH) -> tuple[int, int, int, int, int] | None:
    """(number of tokens, variable ones, hash of the leaf, two hashes of the masked tokens) of a line; none for a blank one."""
    tokens = masked(line)
    if not tokens:
        return None
    whole = b" ".join(tokens)
    return len(tokens), tokens.count(WILD), _hash(b"%d %b" % (len(tokens), b" ".join(tokens[:depth]))), _hash(whole), xxhash.xxh32_intdigest(whole) - (1 << 31)


def _signed(values: tuple[int, ...]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


#: What tells two masked lines apart, and two rows.
LINE, ROW = ["line", "check"], ["key", "key2"]


def _marks(rows: DataFrame, depth: int) -> DataFrame:
    """(key, key2, at, width, wild, leaf, line, check, fresh_leaf, fresh_line) for each line that isn't blank; fresh: the first such in its row."""
    names = [*ROW, "at", "width", "wild", "leaf", *LINE, "fresh_leaf", "fresh_line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out: list[tuple] = []
                for key, key2, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    leaves, lines = set(), set()
                    for at, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
                        if found := leaf_and_line(line, depth):
                            width, wild, leaf, whole, check = found
                            out.append((key, key2, at, width, wild, leaf, whole, check, leaf not in leaves, (whole, check) not in lines))
                            leaves.add(leaf)
                            lines.add((whole, check))
                if out:
                    key, key2, at, width, wild, leaf, whole, check, a, b = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *[pa.array(x, pa.int32()) for x in (key2, at, width, wild)], _signed(leaf), _signed(whole), pa.array(check, pa.int32()), pa.array(a), pa.array(b)], names=names)

    return rows.mapInArrow(run, "key long, key2 int, at int, width int, wild int, leaf long, line long, check int, fresh_leaf boolean, fresh_line boolean")


def _tokens(rows: DataFrame) -> DataFrame:
    """(line, check, leaf, docs, place, token, width) for each token of the chosen lines of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                out: list[tuple[int, ...]] = []
                for text, chosen in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                    for c in chosen:
                        tokens = masked(lines[c["at"]])
                        out += [(c["line"], c["check"], c["leaf"], c["docs"], place, _hash(token) if token != WILD else 0, len(tokens)) for place, token in enumerate(tokens)]
                if out:
                    line, check, leaf, docs, place, token, width = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(line, pa.int64()), pa.array(check, pa.int32()), pa.array(leaf, pa.int64()), pa.array(docs, pa.int64()), pa.array(place, pa.int32()), _signed(token), pa.array(width, pa.int32())], names=[*LINE, "leaf", "docs", "place", "token", "width"])

    return rows.mapInArrow(run, "line long, check int, leaf long, docs long, place int, token long, width int")


def _rows_of(shapes: DataFrame, shaped: DataFrame, marks: DataFrame) -> DataFrame:
    """(leaf, shape, docs): the rows that have a line of each template of ``shapes``, repeated rows counted each."""
    own = shaped.join(shapes.select("leaf", "shape"), ["leaf", "shape"], "left_semi").select(*LINE, "leaf", "shape")
    at = marks.select(*ROW, "at", *LINE).join(own, LINE).groupBy("leaf", "shape", *ROW, "at").agg(F.count(F.lit(1)).alias("times"))
    # rows that repeat have one key: as many as there are marks at one place
    return at.groupBy("leaf", "shape", *ROW).agg(F.max("times").alias("times")).groupBy("leaf", "shape").agg(F.sum("times").alias("docs"))


def recurring(texts: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, constant: float = CONSTANT, long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """(marks of all lines, the lines to drop as (line, check)) of ``texts`` (key, key2, text)."""
    enough = F.when(F.col("width") >= long, F.least(F.lit(2), F.lit(min_docs))).otherwise(F.lit(min_docs))
    marks = written(_marks(texts, depth), "line-marks")
    # one row for each masked line: in how many documents it is, and whether enough of it is no variable
    lines = marks.groupBy("leaf", *LINE).agg(F.count_if("fresh_line").alias("docs"), F.max("width").alias("width"), (F.max("wild") <= (1 - constant) * F.max("width") + 1e-9).alias("firm"))
    lines = written(lines, "lines")
    leaves = marks.groupBy("leaf").agg(F.count_if("fresh_leaf").alias("n"), F.max("width").alias("width")).filter(F.col("n") >= enough)
    fewest = lines.groupBy("leaf").agg(F.min("docs").alias("fewest"))
    leaves = written(leaves.join(fewest, "leaf").select("leaf", (F.col("fewest") >= enough).alias("certain")), "leaves")
    # where every line recurs by itself, each token that isn't a variable is constant
    sure = lines.join(leaves.filter("certain"), "leaf", "left_semi").filter("firm").select(*LINE)
    chosen = lines.join(leaves.filter("not certain"), "leaf", "left_semi").select("leaf", *LINE, "docs")
    first = marks.select(*ROW, "at", "leaf", *LINE).join(chosen, ["leaf", *LINE]).groupBy("leaf", *LINE).agg(F.min(F.struct(*ROW, "at")).alias("place"), F.first("docs").alias("docs"))
    wanted = first.select("leaf", *LINE, "docs", "place.*").groupBy(*ROW).agg(F.collect_list(F.struct("at", *LINE, "leaf", "docs")).alias("chosen"))
    read = written(_tokens(texts.join(wanted, ROW).dropDuplicates(ROW).select("text", "chosen")), "line-tokens")
    common = read.filter("token <> 0").groupBy("leaf", "place", "token").agg(F.sum("docs").alias("n"), F.max("width").alias("width")).filter(F.col("n") >= enough).select("leaf", "place", "token", F.lit(True).alias("common"))
    fixed = read.join(common, ["leaf", "place", "token"], "left").withColumn("fixed", F.coalesce("common", F.lit(False)))
    # an order-free digest of (place, constant token) names the template in its leaf
    part = F.when(F.col("fixed"), F.xxhash64("place", "token")).otherwise(F.xxhash64("place", F.lit("*")))
    shaped = fixed.groupBy(*LINE).agg(F.first("leaf").alias("leaf"), F.first("docs").alias("docs"), F.first("width").alias("width"), F.bit_xor(part).alias("shape"), F.avg(F.col("fixed").cast("int")).alias("share"))
    shaped = written(shaped.filter(F.col("share") >= constant), "line-shapes")
    shapes = shaped.groupBy("leaf", "shape").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("lines"), F.max("width").alias("width")).filter(F.col("docs") >= enough)
    exact = _rows_of(shapes.filter("lines > 1"), shaped, marks).join(shapes.select("leaf", "shape", "width"), ["leaf", "shape"]).filter(F.col("docs") >= enough)
    good = shapes.filter("lines = 1").select("leaf", "shape").union(exact.select("leaf", "shape"))
    return marks, shaped.join(good, ["leaf", "shape"], "left_semi").select(*LINE).union(sure)


def without_recurring(docs: DataFrame, text: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped", depth: int = DEPTH, min_docs: int = MIN_DOCS, constant: float = CONSTANT, long: int = LONG) -> DataFrame:
    """``docs`` without the lines of recurring templates, with the numbers of lines and of dropped lines."""
    docs = docs.select([c for c in docs.columns if c not in (n_lines, n_dropped)])
    key, key2, gone = free_name(docs, "key", "key2", "gone")
    whole = [F.to_json(c) if isinstance(f.dataType, T.MapType) else F.col(c) for c, f in zip(docs.columns, docs.schema.fields, strict=True)]
    keyed = docs.withColumns({key: F.xxhash64(*whole), key2: F.hash(*whole)})
    marks, drop = recurring(keyed.select(F.col(key).alias("key"), F.col(key2).alias("key2"), F.col(text).cast("string").alias("text")), depth, min_docs, constant, long)
    found = marks.join(drop, LINE, "left_semi").groupBy(F.col("key").alias(key), F.col("key2").alias(key2)).agg(F.collect_set("at").alias(gone))
    joined = keyed.join(found, [key, key2], "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains(gone, i))
    return joined.select(
        *[F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text) if c == text else F.col(c) for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(n_lines),
        F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long").alias(n_dropped),
    )
