"""Quality classifier: a factorisation machine over words, structure and metadata.

A document's features are its words, hashed into ``WORD_BUCKETS`` columns with
damped, length-normalised counts, and statistics of its structure and its
length, cut into steps. The score adds a weight for each feature and the
interaction of every pair, of which each has the dot product of two vectors of
``RANK`` numbers. The pairs are not formed: half of the squared sum less the
sum of squares gives them in time linear in the features.

The machine is fitted with Adagrad on the driver, on at most ``SAMPLE``
labelled rows, those whose ids hash lowest; their features are extracted on
the executors. Scoring reads every whole text. The model is a fixed number of
weights (under a megabyte) and is broadcast.

Defined results: a null or empty text is scored by its structure features
alone; a label row with a null in it is ignored, repeated label rows of a
document count as their least label, and of rows repeated with an id one is
learnt from, that of least features; documents with a null id are never used
for learning; without labels of both classes every score is the share of label
1 (one half without any); repeated rows get the same score each; an empty table
gives an empty table; further columns are passed in ``keep``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

WORD_BUCKETS, RANK = 1 << 14, 4
#: Labelled rows at most from which the machine is fitted.
SAMPLE = 4000
EPOCHS, BATCH, RATE, RIDGE = 12, 128, 0.1, 1e-4
#: Steps into which each statistic is cut.
STEPS = 12
STATISTICS = (
    ("log_chars", 0.0, 14.0),
    ("log_words", 0.0, 12.0),
    ("mean_word", 0.0, 14.0),
    ("distinct_words", 0.0, 1.0),
    ("repeated_next", 0.0, 1.0),
    ("top_word", 0.0, 0.6),
    ("symbols", 0.0, 0.4),
    ("digits", 0.0, 0.4),
    ("punctuation", 0.0, 0.3),
    ("capitals", 0.0, 0.4),
    ("bars", 0.0, 0.2),
    ("spaces", 0.0, 0.5),
    ("line_words", 0.0, 60.0),
    ("repeated_lines", 0.0, 1.0),
    ("symbol_words", 0.0, 1.0),
    ("lone_words", 0.0, 1.0),
)
WIDTH = WORD_BUCKETS + len(STATISTICS) * (STEPS + 1)
_CLASS = np.zeros(256, dtype=np.int8)  # 1 symbol, 2 digit, 3 punctuation, 4 capital, 5 bar, 6 space
for _c in b"#*%&$@^~=+<>{}[]\\_/`":
    _CLASS[_c] = 1
for _c in b"0123456789":
    _CLASS[_c] = 2
for _c in b".,;:!?'\"()-":
    _CLASS[_c] = 3
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _CLASS[_c] = 4
_CLASS[ord("|")] = 5
for _c in b" \t\n\r":
    _CLASS[_c] = 6


class Buckets(dict):
    """Word to column; words beyond the bound start the store anew."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = out = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        return out


_buckets = Buckets()


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """The values of STATISTICS."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    by = np.bincount(_CLASS[data], minlength=7) / max(1, len(data))
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    repeated = sum(map(str.__eq__, words, words[1:])) / n
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        len(text) / n,
        len(counts) / n,
        repeated,
        max(counts.values(), default=0) / n if len(words) > 1 else 0.0,
        by[1],
        by[2],
        by[3],
        by[4],
        by[5],
        by[6],
        len(words) / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?'\")-") / n,
        sum(c for w, c in counts.items() if len(w) == 1) / n,
    ]


def extract(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of a document."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    stats = statistics(text, words, counts)
    columns = np.fromiter((_buckets[w] for w in counts), dtype=np.int32, count=len(counts))
    values = np.log1p(np.fromiter(counts.values(), dtype=np.float32, count=len(counts)))
    if len(values):
        values /= np.sqrt((values * values).sum())
    at = WORD_BUCKETS
    steps = np.empty(len(stats), dtype=np.int32)
    for k, (value, (_, low, high)) in enumerate(zip(stats, STATISTICS, strict=True)):
        steps[k] = at + k * (STEPS + 1) + min(STEPS, max(0, int((value - low) / (high - low) * STEPS)))
    return np.concatenate([columns, steps]), np.concatenate([values, np.full(len(steps), 0.5, dtype=np.float32)])


@dataclass
class Machine:
    """Weights of a fitted factorisation machine."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, columns: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The score of each document; document k has the features from starts[k] on, at least one."""
        x = values[:, None]
        v = self.vectors[columns] * x
        sums = np.add.reduceat(v, starts, axis=0)
        squares = np.add.reduceat(v * v, starts, axis=0)
        return self.bias + np.add.reduceat(self.weights[columns] * values, starts) + 0.5 * (sums * sums - squares).sum(axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Machine:
    """A machine from features and labels 0 or 1; rows weigh the same, so that the rarer class must earn its scores."""
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    machine = Machine(0.0, np.zeros(WIDTH, dtype=np.float32), rng.normal(0, 0.05, (WIDTH, RANK)).astype(np.float32))
    if not 0 < share < 1:
        machine.vectors[:] = 0
        machine.bias = float(np.log((share + 1e-9) / (1 - share + 1e-9))) if len(labels) else 0.0
        return machine
    gw, gv, gb = np.full(WIDTH, 1e-6, dtype=np.float32), np.full((WIDTH, RANK), 1e-6, dtype=np.float32), 1e-6
    order = np.arange(len(documents))
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            columns = np.concatenate([documents[i][0] for i in part])
            values = np.concatenate([documents[i][1] for i in part])
            size = np.array([len(documents[i][0]) for i in part])
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            v = machine.vectors[columns]
            sums = np.add.reduceat(v * values[:, None], starts, axis=0)
            error = (_sigmoid(machine.logits(columns, values, starts)) - labels[part]) / len(part)
            own = np.repeat(error, size).astype(np.float32) * values
            near = np.repeat(sums, size, axis=0) - v * values[:, None]
            found, slot = np.unique(columns, return_inverse=True)
            dw = np.bincount(slot, own, len(found)) + RIDGE * machine.weights[found]
            dv = np.stack([np.bincount(slot, own * near[:, f], len(found)) for f in range(RANK)], axis=1) + RIDGE * machine.vectors[found]
            gw[found] += dw * dw
            gv[found] += dv * dv
            gb += float(error.sum()) ** 2
            machine.weights[found] -= RATE * dw / np.sqrt(gw[found])
            machine.vectors[found] -= RATE * dv / np.sqrt(gv[found])
            machine.bias -= RATE * float(error.sum()) / gb**0.5
    return machine


def held_out(doc_id: str) -> Column:
    """Whether a row is never used for learning: crc32 of its id as text, mod 3, is 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most ``sample`` labelled rows that are not held out."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("__id")).agg(F.min(label).cast("int").alias("__label"))
    chosen = known.filter(~held_out("__id")).orderBy(F.xxhash64("__id"), "__id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                made = [extract(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c, _ in made], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in made], pa.binary())], names=["id", "label", "columns", "values"])

    # at most ``sample`` rows of an id and a label are broadcast
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text")).join(F.broadcast(chosen), "__id").select(F.col("__id").cast("long").alias("id"), F.col("__label").alias("label"), "__text")
    made = texts.mapInArrow(run, "id long, label int, columns binary, values binary")
    # one row for each of at most ``sample`` ids comes to the driver
    least = made.groupBy("id").agg(F.min(F.struct("label", "columns", "values")).alias("r")).select("id", "r.*")
    rows = sorted(least.collect(), key=lambda r: r["id"])
    documents = [(np.frombuffer(r["columns"], dtype=np.int32), np.frombuffer(r["values"], dtype=np.float32)) for r in rows]
    return fit(documents, np.array([r["label"] for r in rows], dtype=np.float32))


def with_score(docs: DataFrame, machine: Machine, text: str = "text", keep: tuple[str, ...] = ("doc_id",), score: str = "score") -> DataFrame:
    """``keep`` and the score, 0 to 1, of each row."""
    held = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weights, machine.vectors))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(*held.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                made = [extract(t) for t in part.column(at).to_pylist()]
                starts = np.concatenate([[0], np.cumsum([len(c) for c, _ in made])[:-1]]).astype(int)
                z = own.logits(np.concatenate([c for c, _ in made]), np.concatenate([v for _, v in made]), starts)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(_sigmoid(z).astype(np.float64))], names=[*keep, score])

    (own_text,) = free_name(docs, "text")
    # a text that is kept is not sent twice
    at = keep.index(text) if text in keep and docs.schema[text].dataType == T.StringType() else len(keep)
    sent = docs.select(*keep) if at < len(keep) else docs.select(*keep, F.col(text).cast("string").alias(own_text))
    return sent.mapInArrow(run, schema)
