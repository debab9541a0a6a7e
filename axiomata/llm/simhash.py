"""Near-duplicates by SimHash fingerprints, compared at the anchors of a covering code.

A fingerprint bit is set where more than half of the text's shingle hashes set
it. To find all pairs within ``LINK`` differing bits, anchors are taken from
the product of two perfect [23, 12] codes over bits 0-22 and 23-45: every
23-bit word lies within three bits of exactly one code word, its home. If two
fingerprints differ in at most t bits, then in the blocks they differ in e1 + e2
<= t bits, and each block of the one lies within 3 + e of the other's home. So
each fingerprint is replicated to the anchors whose blocks exceed the covering
radius by no more than t bits in sum (61 on average for t = 2, the same for
any table), and a pair is compared at the home of its lesser fingerprint; all
64 bits decide. No pair is missed and none is proposed without a comparison.

Fingerprints are made distinct first, so copies never meet at an anchor; a
distinct fingerprint has at most 2,080 others within two bits. Links go to
connected components by repeated hooking to the least neighbour, each round a
written table in the shared folder.

``similar_groups`` wants texts that share four fifths of their five-word
shingles. Its candidates are the pairs that their fingerprints link, found at
the anchors as above. Most such texts differ in about 10 of 64 bits though, far
beyond what anchors can cover, so bands find the rest: a text's shingles are
put in ``BANDS`` * ``ROWS`` random orders, and the least ones of a band of
orders make one key. A pair that is similar shares a key but for one pair in
twenty million, in a table of any size and in a group of any density, as each
pair's chance is its own. All candidates of either kind that other links don't
connect are compared by the exact similarity of their sets, which alone decides.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; texts of fewer words than a shingle are one shingle; texts of any
length are read whole, block by block; repeated rows fall into one component;
a null id never is a component's name unless all of its ids are null; an empty
table gives an empty table; the input may have any further columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from .common import free_name, written

SEED = 42
#: Differing bits of linked fingerprints.
LINK = 2
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 22
#: Generator polynomial of the perfect [23, 12] code.
GENERATOR = 0b110001110101


def shingle_hashes(data: bytes, width: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """(hashes of shingles, words so far unseen joined by spaces) of a lower-cased text, a block of it at a time."""
    carried: list[bytes] = []
    at = total = 0
    hash_ = xxhash.xxh64_intdigest
    while at < len(data):
        end = at + BLOCK
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        words = carried + data[at:end].split()
        at = end
        if len(words) < width:
            carried = words
            continue
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        hashes = np.array([hash_(joined[s : e - 1], SEED) for s, e in zip([0, *ends], ends[width - 1 :], strict=False)], dtype=np.uint64)
        yield hashes, joined if not total else b" " + joined[ends[width - 2] :] if width > 1 else joined
        total += len(hashes)
        carried = words[len(words) - width + 1 :] if width > 1 else []
    if not total and carried:
        joined = b" ".join(carried)
        yield np.array([hash_(joined, SEED)], dtype=np.uint64), joined


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint of a text as a signed 64-bit integer."""
    if not text:
        return 0
    counts, total = np.zeros(64, dtype=np.int64), 0
    for hashes, _ in shingle_hashes(text.encode("utf-8", "surrogatepass").lower(), width):
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    bits = (counts * 2 > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3) -> DataFrame:
    """(id, fingerprint) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                prints = [fingerprint(t, width) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.int64())], names=["id", "fingerprint"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "id long, fingerprint long")


@lru_cache
def code_table() -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Syndromes of all 23-bit words, and for each syndrome its error patterns by excess over the covering radius (0, 1, 2 bits)."""
    words = np.arange(1 << 23, dtype=np.uint32)
    for bit in range(22, 10, -1):
        words ^= ((words >> bit) & 1) * np.uint32(GENERATOR << (bit - 11))
    syndromes = words.astype(np.uint16)
    patterns: list[list[list[int]]] = [[[] for _ in range(3)] for _ in range(2048)]
    for weight in range(3 + LINK + 1):
        for places in combinations(range(23), weight):
            word = sum(1 << p for p in places)
            patterns[syndromes[word]][max(0, weight - 3)].append(word)
    return syndromes, [[np.array(x, dtype=np.int64) for x in row] for row in patterns]


def homes(prints: np.ndarray) -> np.ndarray:
    """The anchor that covers each fingerprint."""
    syndromes, patterns = code_table()
    nearest = np.array([p[0][0] for p in patterns])
    words = prints.view(np.uint64)
    blocks = [((words >> np.uint64(at)) & np.uint64(0x7FFFFF)).astype(np.int64) for at in (0, 23)]
    low, high = (x ^ nearest[syndromes[x]] for x in blocks)
    return low << 23 | high


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): all anchors at which each fingerprint is present."""
    syndromes, patterns = code_table()
    words = prints.view(np.uint64)
    low, high = (words & np.uint64(0x7FFFFF)).astype(np.int64), ((words >> np.uint64(23)) & np.uint64(0x7FFFFF)).astype(np.int64)
    rows, found = [], []
    for k, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        pa_, pb_ = patterns[syndromes[a]], patterns[syndromes[b]]
        for i in range(LINK + 1):
            near = np.concatenate(pb_[: LINK + 1 - i]) ^ b
            block = ((pa_[i] ^ a)[:, None] << 23 | near[None, :]).ravel()
            found.append(block)
            rows.append(np.full(len(block), k))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(found)


def placed(prints: DataFrame, everywhere: bool) -> DataFrame:
    """(anchor, fingerprint): at its home only, or at all of its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(own), 2048):
                part = own[k : k + 2048]
                rows, found = anchors(part) if everywhere else (slice(None), homes(part))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(part[rows])], names=["anchor", "fingerprint"])

    return prints.select("fingerprint").mapInArrow(run, "anchor long, fingerprint long")


def links(prints: DataFrame, most: int = LINK) -> DataFrame:
    """(a, b), a < b: the pairs of distinct fingerprints that differ in at most ``most`` (0 to 2) bits.

    The optimiser can't see that ``near`` is 61 times its input and would
    broadcast it by the size of the fingerprints, so it has to be shuffled.
    """
    if not 0 <= most <= LINK:
        raise ValueError(f"the anchors cover up to {LINK} differing bits")
    own = placed(prints, everywhere=False).select(F.col("anchor").alias("home"), F.col("fingerprint").alias("a"))
    near = placed(prints, everywhere=True).select("anchor", F.col("fingerprint").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
    return own.join(near.hint("merge"), (F.col("home") == F.col("anchor")) & (F.col("a") < F.col("b")) & close).select("a", "b")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, most: int = LINK) -> DataFrame:
    """(id, fingerprint, component_id) of each row; component_id is the least id reachable over links."""
    rows = written(with_fingerprint(docs, text, doc_id, width), "fingerprints")
    prints = written(rows.groupBy("fingerprint").agg(F.min("id").alias("least")), "distinct-fingerprints")
    found = connected_components(links(prints, most), "a", "b").withColumnRenamed("node", "fingerprint")
    named = prints.join(found, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(least, "component").select("fingerprint", "component_id"), "fingerprint").select("id", "fingerprint", "component_id")


#: Bands of a text's minima and minima in a band: a pair at 0.8 shares no band once in twenty million.
BANDS, ROWS = 32, 4
#: Nodes of a band up to which its pairs are joined row by row; nodes on each side of a block in larger bands.
JOINED, BLOCK_NODES = 32, 512
#: 64-bit words of a node's parities, and bits of the filter of the texts whose shingles are read.
PARITIES, FILTER_BITS = 8, 22
_FACTORS = np.array([xxhash.xxh64_intdigest(str(k), SEED) | 1 for k in range(BANDS * ROWS)], dtype=np.uint64)


def sketch(data: bytes, width: int) -> tuple[int, np.ndarray]:
    """(hash of the words, sorted distinct hashes of the shingles) of a lower-cased text."""
    whole = xxhash.xxh64(seed=SEED)
    parts = [np.zeros(0, dtype=np.uint64)]
    for hashes, words in shingle_hashes(data, width):
        whole.update(words)
        parts.append(hashes)
    return whole.intdigest(), np.unique(np.concatenate(parts))


def _lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def bands(own: np.ndarray) -> np.ndarray:
    """A hash for each band of the least values of the shingles under BANDS * ROWS orders.

    Two sets have one order's least value in common with the probability of
    their similarity, whatever the sets and however many there are.
    """
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(own), 1024):
        np.minimum(low, (own[k : k + 1024, None] * _FACTORS).min(axis=0), out=low)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, ROWS))], dtype=np.uint64)


def _parities(own: np.ndarray) -> np.ndarray:
    """For each of PARITIES * 64 classes of shingles whether an odd number of them is here.

    A shingle that only one of two sets has changes one bit, so the bits that
    differ are no more than the shingles that differ.
    """
    odd = np.bincount((own & np.uint64(PARITIES * 64 - 1)).astype(np.int64), minlength=PARITIES * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _text_key(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def with_bands(docs: DataFrame, text: str, doc_id: str, width: int) -> DataFrame:
    """(id, key, node, fingerprint, n, parities, bands) of each row: key is a hash of the text, node of its words, n the distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                nodes, prints, sizes, odd, marks = [], [], [], [], []
                for t in part.column(2).to_pylist():
                    node, own = sketch(_lowered(t), width)
                    nodes.append(node)
                    prints.append(fingerprint(t))
                    sizes.append(len(own))
                    odd.append(_parities(own))
                    marks.append(bands(own).view(np.int64) if len(own) else [])
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(odd, longs), pa.array(marks, longs)], names=["id", "key", "node", "fingerprint", "n", "parities", "bands"])

    rows = docs.select(F.col(doc_id).cast("long"), _text_key(text), F.col(text).cast("string"))
    return rows.mapInArrow(run, "id long, key long, node long, fingerprint long, n int, parities array<long>, bands array<long>")


def _comparable(n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of so many shingles can be similar at all."""
    return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9


def _sets_of(wanted: DataFrame, docs: DataFrame, text: str, width: int) -> DataFrame:
    """(node, shingles) of ``wanted`` (node, key): the texts are read again, and those outside a filter of fixed size left out."""
    place = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    marked = wanted.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - FILTER_BITS}) & 63 as int))").alias("bit"))
    words = [(r.word, r.bits) for r in marked.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
        for word, bits in words:
            held[word] = bits
        done: set[int] = set()  # a copy is read once in a task
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = (keys.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            near = np.flatnonzero(held.view(np.uint64)[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
            for k in range(0, len(near), 256):
                found, sets = [], []
                for row in near[k : k + 256].tolist():
                    if (key := int(keys[row])) not in done:
                        done.add(key)
                        found.append(key)
                        sets.append(sketch(_lowered(batch.column(1)[row].as_py()), width)[1].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"])

    read = docs.select(_text_key(text).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, shingles array<long>")
    return written(wanted.join(read.dropDuplicates(["key"]), "key").select("node", "shingles"), "shingle-sets")


def _similar(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose shingles have at least this similarity.

    Pairs whose parities show too many differing shingles need no comparison.
    """
    side = lambda df, x, *own: df.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in own])
    odd = pairs.join(side(nodes, "a", "n", "parities"), "a").join(side(nodes, "b", "n", "parities"), "b")
    apart = sum((F.bit_count(F.get("parities_a", F.lit(k)).bitwiseXOR(F.get("parities_b", F.lit(k)))) for k in range(PARITIES)), F.lit(0))
    close = odd.filter(apart <= (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + 1e-9).select("a", "b")
    met = close.join(side(sets, "a", "shingles"), "a").join(side(sets, "b", "shingles"), "b").withColumn("both", F.size(F.array_intersect("shingles_a", "shingles_b")))
    return written(met.filter(F.col("both") >= similarity * (F.size("shingles_a") + F.size("shingles_b") - F.col("both")) - 1e-9).select("a", "b"), "links")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _blocked(large: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of different components in bands of many nodes that the parities don't rule out.

    The nodes outside a band's main component meet all of its nodes, block by
    block, as matrices: no pair becomes a row before it is compared, and a
    band of any size is dealt to as many tasks as it needs.
    """
    held = large.join(nodes.select("node", "parities"), "node")
    rests, wholes = F.ceil(F.col("rest") / BLOCK_NODES), F.ceil(F.col("whole") / BLOCK_NODES)
    i, j = F.pmod(F.xxhash64("node", F.lit(1)), rests), F.pmod(F.xxhash64("node", F.lit(2)), wholes)
    own = ["s", "node", "n", "c", "parities"]
    few = held.filter("c <> main").select(*own, F.lit(True).alias("few"), i.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), wholes - 1)).alias("j"))
    every = held.select(*own, F.lit(False).alias("few"), F.explode(F.sequence(F.lit(0).cast("long"), rests - 1)).alias("i"), j.alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["few"]], pdf[~pdf["few"]]
        found = [np.zeros((0, 2), dtype=np.int64)]
        if len(x) and len(y):
            bits, n, c, node = np.stack(y["parities"]), y["n"].to_numpy(), y["c"].to_numpy(), y["node"].to_numpy()
            for p, m, d, k in zip(x["parities"], x["n"], x["c"], x["node"], strict=True):
                near = np.bitwise_count(bits ^ p).sum(axis=1) <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-9
                near &= (c != d) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9)
                found.append(np.sort(np.stack([node[near], np.full(near.sum(), k)], axis=1), axis=1))
        return pd.DataFrame(np.concatenate(found), columns=["a", "b"])

    return few.union(every).groupBy("s", "i", "j").applyInPandas(compare, "a long, b long")


def _close_prints(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: nodes whose fingerprints are equal or linked; of equal ones the least node stands for the others."""
    held = nodes.filter("n > 0").select("fingerprint", "node")
    prints = written(held.groupBy("fingerprint").agg(F.min("node").alias("head")), "distinct-fingerprints")
    same = held.join(prints, "fingerprint").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    side = lambda x: prints.select(F.col("fingerprint").alias(x), F.col("head").alias(f"head_{x}"))
    near = links(prints).join(side("a"), "a").join(side("b"), "b").select(*_ordered("head_a", "head_b"))
    return written(same.union(near), "close-fingerprints")


def _similar_links(nodes: DataFrame, docs: DataFrame, text: str, width: int, similarity: float) -> DataFrame:
    """(a, b), a < b: links of exact similarity that connect all nodes connected by such pairs of linked fingerprints or with a band in common.

    Each node is first compared with the least one that its fingerprint is
    linked to. In each band the node with most company stands for the others;
    each node is also compared with the one of these that it shares most bands
    with. In a group of copies of one text that is the text itself. Within the
    components that follow nothing needs comparing; nodes of different
    components whose fingerprints are linked or that share a band are all compared.
    """
    close = _close_prints(nodes)
    placed = nodes.filter("n > 0").select("node", "n", F.explode("bands").alias("s"))
    full = placed.groupBy("s").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = written(placed.join(full, "s"), "shared-bands")
    company = shared.groupBy("node").agg(F.sum("m").alias("company"), F.any_value("n").alias("n"))
    wanted = company.select("node").union(close.select("a")).union(close.select("b")).distinct()
    sets = _sets_of(wanted.join(nodes.select("node", "first.key"), "node"), docs, text, width)

    head = shared.select("s", "node").join(company, "node").groupBy("s").agg(F.max(F.struct("company", "node", "n")).alias("head"))
    offered = shared.join(head, "s").filter((F.col("node") != F.col("head.node")) & _comparable(F.col("n"), F.col("head.n"), similarity))
    often = offered.groupBy("node", F.col("head.node").alias("other"), F.col("head.company").alias("company")).agg(F.count(F.lit(1)).alias("times"))
    best = often.groupBy("node").agg(F.max(F.struct("times", "company", "other")).alias("best")).select(*_ordered("node", "best.other"))
    known = _similar(close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(best).distinct(), nodes, sets, similarity)

    groups = connected_components(known, "a", "b")
    own = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    open_ = close.join(own("a"), "a", "left").join(own("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    named = written(shared.join(groups, "node", "left").select("s", "node", "n", F.coalesce("component", "node").alias("c")), "shared-by-group")
    parts = named.groupBy("s", "c").agg(F.count(F.lit(1)).alias("m"))
    main = parts.groupBy("s").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.sum("m").alias("whole"), (F.sum("m") - F.max("m")).alias("rest")).filter("rest > 0")
    mixed = written(named.join(main, "s"), "mixed-bands")
    small = mixed.filter(F.col("whole") <= JOINED)
    x, y = small.filter("c <> main").select("s", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("c").alias("cx")), small.select("s", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("c").alias("cy"), "main")
    apart = (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("x") < F.col("y"))) & _comparable(F.col("nx"), F.col("ny"), similarity)
    rest = x.join(y, "s").filter(apart).select(*_ordered("x", "y")).union(_blocked(mixed.filter(F.col("whole") > JOINED), nodes, similarity)).union(open_).distinct()
    return known.union(_similar(rest, nodes, sets, similarity))


def _similar_nodes(docs: DataFrame, text: str, doc_id: str, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(rows with bands, (node, first, component)); first: (absent, id, key) of a node's row of least id."""
    rows = written(with_bands(docs, text, doc_id, width), "text-bands")
    first = F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "key")).alias("first")
    nodes = written(rows.groupBy("node").agg(first, *[F.any_value(c).alias(c) for c in ("fingerprint", "n", "parities", "bands")]), "nodes")
    found = connected_components(_similar_links(nodes, docs, text, width, similarity), "a", "b")
    return rows, nodes.select("node", "first").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def similar_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id) of each row: groups linked by ``similarity`` or more of their distinct shingles.

    component_id is the least id of the group.
    """
    rows, named = _similar_nodes(docs, text, doc_id, width, similarity)
    ids = named.groupBy("component").agg(F.min("first").alias("f")).select("component", F.col("f.id").alias("component_id"))
    return rows.select("id", "node").join(named.join(ids, "component").select("node", "component_id"), "node").select("id", "component_id")


def distinct_kept(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of similar texts one row, that of least id, then of least hash of its text.

    Rows with a null id stay only where their whole group has none. Of rows
    repeated with id and text one stays.
    """
    rows, named = _similar_nodes(docs, text, doc_id, width, similarity)
    absent, number, key = names = free_name(docs, "absent", "id", "key")
    f = named.groupBy("component").agg(F.min("first").alias("f"))
    stay = f.select(F.col("f.absent").alias(absent), F.coalesce("f.id", F.lit(0)).alias(number), F.col("f.key").alias(key))
    marked = docs.withColumns({absent: F.col(doc_id).cast("long").isNull(), number: F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), key: _text_key(text)})
    if not rows.groupBy("id", "key").count().filter("count > 1").isEmpty():
        marked = marked.dropDuplicates(names)
    return marked.join(stay, names, "left_semi").select(docs.columns)
