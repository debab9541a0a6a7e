"""Exact duplicates through an extendible-hash index on shared files.

1. Keys. Every text is reduced to its normalised bytes and a 64-bit key. The
   keys are counted; copies are combined in each task before the shuffle, so a
   text that fills a third of the table costs each task one row.
2. Directory. Keys are counted in cells of ``MAX_DEPTH`` leading bits, at most
   2 ** MAX_DEPTH counts whatever the input. The directory doubles from one
   bucket on: while a bucket holds more than ``capacity`` keys it splits on the
   next bit. Each cell also has ``WORDS`` * 64 bits that mark the keys seen more
   than once. It is a bounded table and is broadcast.
3. Insert. The directory routes each text to its bucket. A text whose key is
   marked for no second row is alone and sends no bytes. The others go to the
   owners of their key: equal bytes are combined in each task first, then the
   owner compares the bytes under a key and keeps an entry for each different
   text. The owners of the key ranges chain the entries that share a key and
   write the buckets to files in the shared folder.
4. Probe. Documents look their entry up by bucket, key and digest. A hot entry
   makes a skewed join, whose large side adaptive execution splits.

The bits rule out nothing wrongly: where they are full, more texts send their
bytes and the results are the same.

Defined results: null counts as the empty text; rows with equal normalised
texts form a group; in it the row with the most code points in the original
text stays, then the least doc_id (a null id after all others). Repeated rows
with the id and the text of the row that stays are the same document and are
all marked kept; ``distinct_kept`` leaves one of them. An empty table gives an
empty table; further columns, of any name, pass through ``distinct_kept``
untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, written

#: Leading bits of the key that the directory may use, and words of 64 bits in a cell that mark repeated keys.
MAX_DEPTH, WORDS = 16, 16
#: Keys of a bucket before it splits.
CAPACITY = 4096
#: White space that normalisation deletes.
SPACES = (" ", "\n", "\t", "\r", "\x0b", "\x0c")


def normalised(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _cell(key: str) -> Column:
    return F.shiftrightunsigned(key, 64 - MAX_DEPTH)


def _place(key: str) -> tuple[Column, Column]:
    """(word, bit) of a key in its cell's marks."""
    return F.shiftrightunsigned(key, 54 - MAX_DEPTH).bitwiseAND(F.lit(WORDS - 1)).cast("int"), F.shiftrightunsigned(key, 48 - MAX_DEPTH).bitwiseAND(F.lit(63)).cast("int")


def directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(cell, depth, bucket): the bucket of each occupied cell, at most 2 ** max_depth rows.

    A bucket of depth d covers the cells with its d leading bits. It is split
    while it holds more than ``capacity`` keys and bits are left; overfull
    buckets of full depth keep growing.
    """
    cells = keys.groupBy(F.shiftrightunsigned("key", 64 - max_depth).alias("cell")).count()
    depths = F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")
    at = cells.select("cell", "count", depths).withColumn("bucket", F.expr(f"shiftright(cell, {max_depth} - depth)"))
    fits = at.groupBy("depth", "bucket").agg(F.sum("count").alias("n")).filter((F.col("n") <= capacity) | (F.col("depth") == max_depth))
    # fewer than 2 ** (max_depth + 1) buckets of all depths
    return at.join(F.broadcast(fits), ["depth", "bucket"]).groupBy("cell").agg(F.min(F.struct("depth", "bucket")).alias("leaf")).select("cell", "leaf.depth", "leaf.bucket")


def marked_directory(docs: DataFrame, text: str, capacity: int = CAPACITY) -> DataFrame:
    """The directory over the texts of ``docs``, with ``marks``: for each word of a cell the bits of its repeated keys."""
    keys = written(docs.select(F.xxhash64(normalised(F.col(text))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")), "keys")
    word, bit = _place("key")
    again = keys.filter("n > 1").select(_cell("key").alias("cell"), word.alias("word"), bit.alias("bit"))
    words = again.withColumn("bits", F.expr("shiftleft(1L, bit)")).groupBy("cell", "word").agg(F.bit_or("bits").alias("bits"))
    marks = words.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("marks"))
    return written(directory(keys, capacity).join(marks, "cell", "left"), "directory")


def routed(rows: DataFrame, found: DataFrame, key: str, bucket: str, shared: str) -> DataFrame:
    """``rows`` with the bucket of their key, and whether another row may have that key."""
    cell, marks, depth = free_name(rows, "cell", "marks", "depth")
    word, bit = _place(key)
    own = found.select(F.col("cell").alias(cell), F.col("bucket").alias(bucket), F.col("marks").alias(marks), F.col("depth").alias(depth))
    # at most 2 ** MAX_DEPTH rows
    met = rows.withColumn(cell, _cell(key)).join(F.broadcast(own), cell, "left")
    held = F.coalesce(F.try_element_at(marks, word), F.lit(0).cast("long"))
    return met.withColumn(shared, F.getbit(held, bit) == 1).drop(cell, marks, depth)


def signed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(id, points, body, key) of each row."""
    return docs.select(
        F.col(doc_id).cast("long").alias("id"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("points"),
        normalised(F.col(text)).alias("body"),
    ).withColumn("key", F.xxhash64("body"))


def insert(rows: DataFrame) -> DataFrame:
    """An entry (bucket, key, digest, keep_id, keep_points, group_size) for each different text of routed rows."""
    # Most points, then least id, as one number that the hash aggregate keeps in
    # place: points * 2**65 - (id + 2**63), with 2**64 for a null id.
    order = F.expr("cast(points as decimal(20, 0)) * 36893488147419103232BD - coalesce(cast(id as decimal(20, 0)) + 9223372036854775808BD, 18446744073709551616BD)")
    entries = rows.withColumn("best", order.cast("decimal(38, 0)")).groupBy("bucket", "key", "body").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("group_size"))
    offset = "pmod(-best, 36893488147419103232BD)"
    return entries.select(
        "bucket",
        "key",
        F.sha2("body", 256).alias("digest"),
        F.expr(f"cast(nullif({offset}, 18446744073709551616BD) - 9223372036854775808BD as bigint)").alias("keep_id"),
        F.expr(f"cast((best + {offset}) div 36893488147419103232BD as bigint)").alias("keep_points"),
        "group_size",
    )


def build_index(docs: DataFrame, found: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The index of the texts that may have copies: (bucket, key, digest, keep_id, keep_points, group_size, chain).

    Each range of buckets is written by the task that owns it.
    """
    entries = insert(routed(signed(docs, text, doc_id), found, "key", "bucket", "shared").filter("shared"))
    chained = Window.partitionBy("bucket", "key").orderBy("digest")
    owned = entries.repartitionByRange("bucket", "key").withColumn("chain", F.row_number().over(chained))
    return written(owned, "index")


def group_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(id, digest, keep_id, group_size, kept) of each row of ``docs``."""
    found = marked_directory(docs, text, capacity)
    entries = build_index(docs, found, text, doc_id).filter("group_size > 1").drop("chain")
    rows = routed(signed(docs, text, doc_id).select("id", "points", "key", F.sha2("body", 256).alias("digest")), found, "key", "bucket", "shared")
    out = rows.join(entries, ["bucket", "key", "digest"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "id",
        "digest",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points")))).alias("kept"),
    )


def distinct_kept(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; one of rows repeated with id and text.

    Rows that no other row can equal are not shuffled.
    """
    found = marked_directory(docs, text, capacity)
    index = build_index(docs, found, text, doc_id)
    key, digest, points, absent, number, bucket, shared = free_name(docs, "key", "digest", "points", "absent", "number", "bucket", "shared")
    stay = index.select(F.col("key").alias(key), F.col("digest").alias(digest), F.col("keep_points").alias(points), F.col("keep_id").isNull().alias(absent), F.coalesce("keep_id", F.lit(0)).alias(number))
    body = normalised(F.col(text))
    rows = routed(docs.withColumn(key, F.xxhash64(body)), found, key, bucket, shared)
    several = rows.filter(shared).withColumns({
        digest: F.sha2(body, 256),
        points: F.length(F.coalesce(text, F.lit(""))).cast("long"),
        absent: F.col(doc_id).isNull(),
        number: F.coalesce(F.col(doc_id).cast("long"), F.lit(0)),
    })
    names = [key, digest, points, absent, number]
    # the id is part of the join key, so no group of copies meets in one task; repeated rows combine before the shuffle
    left = several.dropDuplicates(names).join(stay, names, "left_semi").select(docs.columns)
    return rows.filter(~F.col(shared)).select(docs.columns).union(left)
