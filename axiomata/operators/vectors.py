"""Vectors: similarity, neighbours, hashing, pooling, spectral embedding."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import dealt, written

# Seed, constants of the generator, tables, bucket size, bits, rows below which pairs are exact.
LSH_SEED = 0xA5F31C9E4B77D02D
LSH_TABLES, LSH_BUCKET, LSH_BITS = 4, 64, (6, 22)
EXACT_BELOW = 1500
#: Rows that meet in one task of a pair join: two blocks; rows of a tile, and pairs, that are compared at once; pairs that a task holds.
BLOCK_ROWS, TILE, CHUNK, KEPT_ROWS = 65_536, 2048, 65_536, 2_000_000


def cosine(a: Column, b: Column) -> Column:
    """V-01: cosine of two arrays in double; zero for unequal lengths, empty arrays or zero norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    """Columns of all batches as arrays, one of lists as a matrix of doubles."""
    parts: dict[str, list[np.ndarray]] = {name: [] for name in names}
    for batch in batches:
        for name, column in ((n, batch.column(n)) for n in names):
            if pa.types.is_list(column.type):
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                width = len(flat) // len(column) if len(column) else 0
                if any(k != width for k in column.value_lengths().unique().to_pylist()):
                    raise ValueError("the vectors differ in length")
                parts[name].append(flat.reshape(len(column), width))
            else:
                parts[name].append(column.to_numpy(zero_copy_only=False))
    return [np.concatenate([x for x in parts[n] if len(x)]) for n in names]


def _close(left: np.ndarray, right: np.ndarray, least: float, same: bool, k: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in left, places in right, cosines) of the pairs of unit rows at ``least`` or more, a tile of both at a time.

    With ``same`` each pair of different rows comes once. A product of
    matrices rounds equal rows differently by their places; the cosines are
    summed pair by pair instead, so that copies tie. With ``k`` a tile may
    leave out pairs that are among the k best of neither row.
    """
    for x in range(0, len(left), TILE):
        for y in range(x if same else 0, len(right), TILE):
            sims = left[x : x + TILE] @ right[y : y + TILE].T
            near = sims >= least - 1e-12
            if same and x == y:
                near &= np.tri(*sims.shape, -1, dtype=bool).T
            if k and min(sims.shape) > k and np.count_nonzero(near) > 16 * k * sum(sims.shape):
                held = np.where(near, sims, -np.inf)
                if same and x == y:
                    held = np.maximum(held, held.T)
                near &= (sims >= np.partition(held, -k, axis=1)[:, -k, None] - 1e-12) | (sims >= np.partition(held, -k, axis=0)[-k] - 1e-12)
            at = np.flatnonzero(near)
            for n in range(0, len(at), CHUNK):
                a, b = np.divmod(at[n : n + CHUNK], sims.shape[1])
                yield a + x, b + y, np.einsum("ij,ij->i", left[a + x], right[b + y])


def _blocks(n: int, cores: int) -> int:
    """Blocks of bounded size, and enough that all cores have pairs of them."""
    return max(1, ceil(2 * n / BLOCK_ROWS), min(ceil(n / TILE), ceil(sqrt(4 * cores))))


def _met(vectors: DataFrame, ident: str, vector: str, blocks: int) -> DataFrame:
    """(id, v, b, p, q): each row once for each block that its own is to meet."""
    own = vectors.filter(F.col(vector).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(ident), F.lit(blocks)).cast("int").alias("b"))
    return own.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("id", "v", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))


def _sides(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """Ids and unit vectors of both blocks, and whether they are one."""
    ident, v, b, p, q = _columns(batches, ["id", "v", "b", "p", "q"])
    first, second = b == p[0], b == q[0]
    v = _unit(v)
    return ident[first], v[first], ident[second], v[second], bool(p[0] == q[0])


def exact_pairs(vectors: DataFrame, ident: str, vector: str, least: float, rows: int | None = None) -> DataFrame:
    """J-14: (i, j, sim), i < j, for all pairs with cosine of at least ``least``, in blocks.

    Rows are dealt to B blocks of bounded size; each pair of blocks meets in
    one task, so every pair is compared exactly once and each row is sent B
    times. The vectors have one length.
    """
    blocks = _blocks(vectors.count() if rows is None else rows, vectors.sparkSession.sparkContext.defaultParallelism)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, v, j, w, same = _sides(batches)
        for a, b, s in _close(v, w, least, same):
            x, y = i[a], j[b]
            keep = x != y
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[keep]), pa.array(np.maximum(x, y)[keep]), pa.array(s[keep])], names=["i", "j", "sim"])

    return _met(vectors, ident, vector, blocks).groupBy("p", "q").applyInArrow(compare, "i long, j long, sim double")


def _best(i: np.ndarray, j: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of each i of greatest sim, ties by the lesser j."""
    order = np.lexsort((j, -sim, i))
    i, j, sim = i[order], j[order], sim[order]
    start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, np.int64)
    keep = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)])) < k
    return i[keep], j[keep], sim[keep]


def nearest_pairs(vectors: DataFrame, ident: str, vector: str, least: float, k: int) -> DataFrame:
    """J-14, W-01: (i, j, sim, rank): ``top_k`` of ``exact_pairs``.

    A task keeps the k nearest of each row in the block that it meets, so
    what is shuffled are k rows for each row and block, not all pairs.
    """
    n = vectors.count()
    blocks = _blocks(n, vectors.sparkSession.sparkContext.defaultParallelism)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, v, j, w, same = _sides(batches)
        best, more, held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)], [], 0
        for a, b, s in _close(v, w, least, same, k):
            keep = i[a] != j[b]
            x, y, s = i[a][keep], j[b][keep], s[keep]
            more += [(x, y, s), (y, x, s)]
            held += 2 * len(x)
            if held > KEPT_ROWS:
                best, more, held = _best(*map(np.concatenate, zip(best, *more, strict=True)), k), [], 0
        i, j, s = _best(*map(np.concatenate, zip(best, *more, strict=True)), k)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(s)], names=["i", "j", "sim"])

    found = dealt(_met(vectors, ident, vector, blocks).groupBy("p", "q").applyInArrow(compare, "i long, j long, sim double"), n * min(n, blocks * k), "i")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("sim"), "j"))).filter(F.col("rank") <= k)


def hyperplanes(dim: int, bits: int, tables: int = LSH_TABLES, seed: int = LSH_SEED) -> np.ndarray:
    """V-02: normals with entries in [-1, 1) from a 64-bit mixing generator, the same on every machine."""
    steps = np.arange(1, tables * bits * dim + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + steps * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) / 2.0**53 * 2.0 - 1.0).astype(np.float32).reshape(tables, bits, dim)


def bits_for(n: int) -> int:
    """Bits of a signature, so that a bucket holds about ``LSH_BUCKET`` rows."""
    return LSH_BITS[0] if n <= LSH_BUCKET else min(LSH_BITS[1], max(LSH_BITS[0], ceil(log2(n / LSH_BUCKET))))


def signatures(vectors: DataFrame, ident: str, vector: str, dim: int, bits: int) -> DataFrame:
    """V-03: (id, v, slot, bucket) for each hash table; the normals are a few thousand numbers."""
    return _marked(vectors, ident, vector, dim, bits).select("id", "v", F.posexplode("marks").alias("slot", "bucket"))


def _marked(vectors: DataFrame, ident: str, vector: str, dim: int, bits: int) -> DataFrame:
    """(id, v, marks): the bucket of a vector in each hash table; the signs are those of products of doubles."""
    planes = hyperplanes(dim, bits).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(bits)).astype(np.int64)
        for batch in batches:
            if batch.num_rows:
                m = _columns([batch], ["v"])[0]
                marks = np.stack([((m @ normals.T) >= 0) @ weights for normals in planes], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(list(marks), pa.list_(pa.int64()))], names=["id", "v", "marks"])

    rows = vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).filter(F.size("v") == dim)
    return rows.mapInArrow(run, "id long, v array<float>, marks array<long>")


def lsh_pairs(vectors: DataFrame, ident: str, vector: str, least: float, dim: int, rows: int | None = None) -> DataFrame:
    """J-14: pairs that share a bucket in some table and pass the exact check.

    The signatures have ``LSH_BITS[0]`` bits, or with ``rows`` those for that
    many rows. The rows of a bucket are dealt to blocks of bounded size that
    meet as in ``exact_pairs``. A row brings its buckets in all tables, and a
    pair comes from the first table only in which they are equal, so no
    candidate is shuffled.
    """
    marked = written(_marked(vectors, ident, vector, dim, LSH_BITS[0] if rows is None else bits_for(rows)), "signatures")
    spots = marked.select("*", F.posexplode("marks").alias("slot", "bucket"))
    sizes = spots.groupBy("slot", "bucket").agg(F.ceil(2 * F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
    own = spots.join(sizes, ["slot", "bucket"]).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", "v", "marks", "slot", "bucket", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident, v, marks, slot, b, p, q = _columns(batches, ["id", "v", "marks", "slot", "b", "p", "q"])
        first, second, v = b == p[0], b == q[0], _unit(v)
        before = marks[:, : slot[0]]
        for x, y, s in _close(v[first], v[second], least, bool(p[0] == q[0])):
            i, j = ident[first][x], ident[second][y]
            keep = (i != j) & ~(before[first][x] == before[second][y]).any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)[keep]), pa.array(np.maximum(i, j)[keep]), pa.array(s[keep])], names=["i", "j", "sim"])

    return met.groupBy("slot", "bucket", "p", "q").applyInArrow(compare, "i long, j long, sim double")


def similar_pairs(vectors: DataFrame, ident: str, vector: str, least: float, dim: int) -> DataFrame:
    """J-14: exact below ``EXACT_BELOW`` rows, hashed from there on, as the operator is defined."""
    n = vectors.count()
    return exact_pairs(vectors, ident, vector, least, n) if n < EXACT_BELOW else lsh_pairs(vectors, ident, vector, least, dim, n)


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """W-01: (i, j, sim, rank): the k most similar of each node, ties by the lesser id."""
    both = pairs.select("i", "j", "sim").union(pairs.select("j", "i", "sim"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("sim"), "j")))
    return ranked.filter(F.col("rank") <= k)


def mutual(neighbours: DataFrame) -> DataFrame:
    """G-12: (i, j, sim), i < j, of pairs that are each among the other's neighbours."""
    back = neighbours.select(F.col("j").alias("i"), F.col("i").alias("j"))
    return neighbours.join(back, ["i", "j"]).filter("i < j").select("i", "j", "sim")


def either(neighbours: DataFrame) -> DataFrame:
    """G-12: (i, j, sim), i < j, of pairs of which one at least is among the other's neighbours."""
    return neighbours.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "sim").dropDuplicates(["i", "j"])


def nearest(vectors: DataFrame, ident: str, vector: str, query: list[float], k: int) -> DataFrame:
    """W-09: the k rows nearest to one vector."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(ident).alias("id"), cosine(F.col(vector), asked).alias("sim")).orderBy(F.desc("sim"), "id").limit(k)


def pooled(vectors: DataFrame, group: str, vector: str, weight: str) -> DataFrame:
    """A-11: (group, size, vector): the normalised weighted sum of each group's vectors.

    Sums are by (group, position), so a group of any size combines in parallel.
    """
    cells = vectors.select(F.col(group).alias("group"), F.col(weight).alias("w"), F.posexplode(vector).alias("at", "x"))
    sums = cells.groupBy("group", "at").agg(F.sum(F.col("x").cast("double") * F.col("w")).alias("s"), F.count(F.lit(1)).alias("n"))
    norm = sums.groupBy("group").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"), F.max("n").alias("size"), F.array_sort(F.collect_list(F.struct("at", "s"))).alias("cells"))
    return norm.select("group", "size", F.transform("cells", lambda c: F.when(F.col("norm") > 0, c["s"] / F.col("norm")).otherwise(F.lit(0.0))).alias("vector"))


def multiply(matrix: DataFrame, dense: DataFrame) -> DataFrame:
    """V-05: a symmetric sparse matrix (u, k, w) times dense rows (k, v)."""
    cells = matrix.join(dense, "k").select("u", "w", F.posexplode("v").alias("at", "x"))
    sums = cells.groupBy("u", "at").agg(F.sum(F.col("w") * F.col("x")).alias("s"))
    return sums.groupBy("u").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda c: c["s"]).alias("v"))


def spectral(matrix: DataFrame, dim: int, extra: int = 10, power: int = 2, seed: int = 7) -> DataFrame:
    """V-04: (u, vector): leading eigenvectors of a symmetric sparse matrix, scaled by the root of the eigenvalue's size.

    A random subspace of dim + extra columns is multiplied by the matrix and
    made orthonormal ``power`` + 1 times. Only products of two such narrow
    matrices, (dim + extra) squared numbers, come to the driver; each stage is
    written. Rows are normalised; sign and rotation are not determined.
    """
    width = dim + extra
    matrix = written(matrix.select("u", "k", "w"), "matrix")
    nodes = matrix.select("u").distinct()
    start = nodes.select(F.col("u").alias("k"), F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (F.pmod(F.xxhash64(F.col("u"), i, F.lit(seed)), F.lit(1 << 30)) / float(1 << 29) - 1.0)).alias("v"))

    def gram(a: DataFrame, b: DataFrame) -> np.ndarray:
        cells = a.toDF("k", "x").join(b.toDF("k", "y"), "k").select(F.posexplode("x").alias("r", "p"), "y").select("r", "p", F.posexplode("y").alias("c", "q"))
        out = np.zeros((width, width))
        for row in cells.groupBy("r", "c").agg(F.sum(F.col("p") * F.col("q")).alias("s")).collect():
            out[row["r"], row["c"]] = row["s"]
        return out

    def times(rows: DataFrame, small: np.ndarray) -> DataFrame:
        columns = [F.array(*[F.lit(float(x)) for x in small[:, c]]) for c in range(small.shape[1])]
        made = F.array(*[F.aggregate(F.zip_with("v", c, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z) for c in columns])
        return rows.select("k", made.alias("v"))

    def orthonormal(rows: DataFrame) -> DataFrame:
        values, vectors = np.linalg.eigh(gram(rows, rows))
        keep = np.where(values > values.max() * 1e-12, values, np.inf)
        return written(times(rows, vectors / np.sqrt(keep)), "basis")

    basis = orthonormal(written(start, "start"))
    for _ in range(power + 1):
        basis = orthonormal(written(multiply(matrix, basis).toDF("k", "v"), "product"))
    image = written(multiply(matrix, basis).toDF("k", "v"), "image")
    small = gram(basis, image)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[:dim]
    scaled = times(basis, vectors[:, order] * np.sqrt(np.abs(values[order])))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return scaled.select(F.col("k").alias("u"), F.transform("v", lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))).alias("vector"))


def encoded(df: DataFrame, text: str, encode, dim: int, out: str = "vector") -> DataFrame:
    """P-16: ``df`` with the vectors of a text column by an encoder from a list of texts to a matrix, a batch at a time.

    The encoder is sent to the workers; an error in it fails the job. Order and rows are kept.
    """

    def run(batches):
        for pdf in batches:
            made = np.asarray(encode(pdf[text].fillna("").tolist()), dtype=np.float32)
            if made.shape != (len(pdf), dim):
                raise ValueError(f"the encoder gave {made.shape}, not {(len(pdf), dim)}")
            yield pdf.assign(**{out: list(made)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, `{out}` array<float>")
