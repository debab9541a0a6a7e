"""Benchmark decontamination by winnowed fingerprints, in DataFrame functions only.

Words are hashed, ``GRAM`` consecutive word hashes make a gram, and of every
``WINDOW - GRAM + 1`` consecutive grams the least is selected, so two texts
that share ``WINDOW`` consecutive words share a selected gram. The selected
grams of documents and items are joined; each hit names a diagonal (document
position minus item position), and the shared words along it are compared
themselves and extended to whole windows.

An item of fewer than ``WINDOW`` words is one window of its own length, for
which winnowing gives no such promise: for each length that occurs (at most
``WINDOW`` - 1 of them) all grams of that length are joined instead.

The grams of the items are not broadcast by hand: the optimiser broadcasts them
where they are small and shuffles both sides otherwise. A gram that very many
documents share is combined in each task before its shuffle, and a document
keeps only its distinct diagonals.

Defined results: a null or empty text has no words, no hits and is clean; an
item without words is ignored; repeated items count once for each item id; an
item with a null id is searched like any other and only has no name to list;
repeated rows of documents get the same result each; rows with a null id are
handled by their text. Empty tables give an empty result, or one without hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name

WINDOW, GRAM = 13, 5
#: A string has fewer words than this, so a position and 34 bits of a gram's hash fit in one number.
POSITION_BITS = 30
LAST = (1 << POSITION_BITS) - 1
#: All that is no word character: ASCII but for digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The lower-cased words of a text; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _packed(gram: Column, at: Column) -> Column:
    """Leading bits of a gram's hash with its position counted down, so that the least is the rightmost of equal grams."""
    return gram.bitwiseAND(F.lit(-1 - LAST)).bitwiseOR(F.lit(LAST) - at)


def _grams(hashes: Column, width: int) -> Column:
    """Packed (gram, position) of each ``width`` consecutive word hashes."""
    return F.when(
        F.size(hashes) >= width,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: _packed(F.xxhash64(*[F.get(hashes, i + k) for k in range(width)], F.lit(width)), i)),
    ).otherwise(F.array().cast("array<bigint>"))


def _marks(words: DataFrame, lengths: list[int], whole_items: bool) -> DataFrame:
    """``words`` with its column ``h`` of word hashes replaced by rows of (gram, at).

    Long windows give their least grams. Grams of the lengths of short items
    are all taken, or, with ``whole_items``, the one that is a whole row.
    Each array is a column of its own: inside a lambda it would be built anew
    for every element.
    """
    kept = [c for c in words.columns if c != "h"]
    span = WINDOW - GRAM + 1
    packed = words.withColumn("grams", _grams(F.col("h"), GRAM))
    least = F.transform(F.sequence(F.lit(0), F.size("grams") - span), lambda i: F.array_min(F.slice("grams", i + 1, span)))
    chosen = F.when(F.size("grams") >= span, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))
    short = [F.when(F.size("h") == n, _grams(F.col("h"), n)).otherwise(F.array().cast("array<bigint>")) if whole_items else _grams(F.col("h"), n) for n in lengths]
    rows = packed.select(*kept, F.explode(F.concat(chosen, *short) if short else chosen).alias("m"))
    return rows.select(*kept, F.shiftright("m", POSITION_BITS).alias("gram"), (F.lit(LAST) - F.col("m").bitwiseAND(F.lit(LAST))).cast("int").alias("at"))


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(id, key, n_words, n_hit, n_whole, item_ids) for each row of ``docs``; key is the hash of its text.

    n_hit: words inside occurrences of windows; n_whole: occurrences of windows
    of ``WINDOW`` words; item_ids: sorted distinct ids of the items with
    occurring windows, as strings, without nulls.
    """
    bench = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(item_text)).alias("item_words")).filter("size(item_words) > 0").distinct()
    bench = bench.withColumn("code", F.xxhash64("item", "item_words"))  # an id may be null or stand for several texts
    lengths = sorted(r[0] for r in bench.select(F.size("item_words").alias("n")).filter(F.col("n") < WINDOW).distinct().collect())

    hashes = F.transform("words", lambda w: F.xxhash64(w)).alias("h")
    marks = _marks(bench.select("code", F.transform("item_words", lambda w: F.xxhash64(w)).alias("h")), lengths, whole_items=True).withColumnRenamed("at", "item_at")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    seen = _marks(rows.select("id", "key", words_of(F.col("text")).alias("words")).select("id", "key", hashes), lengths, whole_items=False)
    hits = seen.join(marks, "gram").select("id", "key", "code", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    # an item's words come once to a document, however often it occurs there
    along = hits.groupBy("id", "key", "code").agg(F.collect_list("diagonal").alias("diagonals"))
    found = along.join(bench, "code").groupBy("id", "key").agg(F.collect_list(F.struct("item", "item_words", "diagonals")).alias("found"))

    joined = rows.join(found.withColumnsRenamed({"id": "hit_id", "key": "hit_key"}), F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    counted = joined.select("id", "key", "found", words_of(F.col("text")).alias("words"))
    spans = F.flatten(F.transform("found", lambda f: F.flatten(F.transform(f["diagonals"], lambda d: F.transform(_windows(F.col("words"), f["item_words"], d), lambda s: F.struct(f["item"].alias("item"), s["start"].alias("start"), s["stop"].alias("stop")))))))
    spanned = counted.select("id", "key", F.size("words").cast("long").alias("n_words"), F.when(F.col("found").isNull(), F.array().cast("array<struct<item: string, start: int, stop: int>>")).otherwise(spans).alias("spans"))
    whole = F.size(F.filter("spans", lambda s: s["stop"] - s["start"] == WINDOW)).cast("long")
    names = F.filter(F.transform("spans", lambda s: s["item"]), lambda x: x.isNotNull())
    return spanned.select("id", "key", "n_words", _covered(F.col("spans")).cast("long").alias("n_hit"), whole.alias("n_whole"), F.array_sort(F.array_distinct(names)).alias("item_ids"))


def _windows(words: Column, item: Column, diagonal: Column) -> Column:
    """Document spans (start, stop) along a diagonal where a whole window of the item occurs."""
    width = F.least(F.lit(WINDOW), F.size(item))
    same = F.transform(item, lambda w, i: F.when((i + diagonal >= 0) & (F.get(words, i + diagonal) == w), F.lit("1")).otherwise(F.lit("0")))
    # inside an array of one, the string of equal and other words is built once
    hit = lambda runs: F.filter(F.sequence(F.lit(1), F.size(item) - width + 1), lambda k: F.substring(runs, k, width) == F.repeat(F.lit("1"), width))
    starts = F.get(F.transform(F.array(F.array_join(same, "")), hit), 0)
    return F.transform(starts, lambda k: F.struct((k - 1 + diagonal).cast("int").alias("start"), (k - 1 + diagonal + width).cast("int").alias("stop")))


def _covered(spans: Column) -> Column:
    """The number of positions inside the union of spans."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
    start = F.struct(F.lit(0).alias("total"), F.lit(-1).alias("reach"))
    step = lambda acc, s: F.struct(
        (acc["total"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], acc["reach"]))).alias("total"),
        F.greatest(acc["reach"], s["stop"]).alias("reach"),
    )
    return F.aggregate(ordered, start, step, lambda acc: acc["total"])


def contaminated(share: int = 20) -> Column:
    """Whether at least one in ``share`` words is hit, over the columns of ``contamination``."""
    return (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", share: int = 20, **names: str) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with their columns.

    One whole window is enough to drop a document of any length; items of
    fewer words, which may stand in a text by chance, count by their share.
    """
    bad_id, bad_key = free_name(docs, "bad_id", "bad_key")
    bad = contamination(docs, items, text, doc_id, **names).filter((F.col("n_whole") > 0) | contaminated(share)).select(F.col("id").alias(bad_id), F.col("key").alias(bad_key)).distinct()
    return docs.join(bad, F.col(doc_id).cast("long").eqNullSafe(F.col(bad_id)) & (F.xxhash64(F.col(text).cast("string")) == F.col(bad_key)), "left_anti")
