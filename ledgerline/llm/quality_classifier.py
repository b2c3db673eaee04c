"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every word bucket has a sparse ternary index vector, made from its number alone. The vector of a word is the sum of the index
vectors of its neighbours over the whole corpus, so it grows out of all documents; tables of counts
of fixed size (``BUCKETS`` x ``DIMS``) are added up over the tasks. A document is the mean of its words' vectors and their
spread. A network with one hidden layer, in NumPy, learns from a bounded sample of labelled rows
(``max_rows``, chosen by a hash of the id); a temperature fitted on rows kept back makes its probabilities honest.

Words here are runs of letters and digits, or runs of other visible characters, in their own case.

Edge cases: NULL and empty texts pool to a zero vector and get a score like any other. Without labelled rows, or with one class only, the
score is the share of label 1 (0.5 without any). Repeated rows are scored each on its own; labels of an id with several
labels all count. Rows without an id are scored, never learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.stages import SLICE, arrow, materialize, texts_of

BUCKETS = 1 << 13
DIMS = 64
SPARSE = 4
WINDOW = 2
PARTS = 16
FOLD_IN = 32
MAX_ROWS = 20_000
HIDDEN = 32
KEPT_WORDS = 200_000
TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\s]+")


class WordBuckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word) % BUCKETS
        return out


def buckets_of(text: bytes, words: WordBuckets) -> np.ndarray:
    found = TOKEN.findall(text)
    return np.fromiter(map(words.__getitem__, found), np.int64, len(found))


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the non-zero entries, ``SPARSE`` for each bucket."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIMS, (BUCKETS, SPARSE)), rng.choice(np.array([-1, 1]), (BUCKETS, SPARSE))


# --- word vectors of the whole corpus -----------------------------------------------------------


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Context sums per bucket, scaled to length one; the last row is free of words.

    A task adds up its documents in one table; tables travel in ``PARTS`` slices and are added in
    two rounds, so no task gets more than a slice of a bounded number of tables at once.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordBuckets()
        positions, signs = index_vectors()
        sums = np.zeros(BUCKETS * DIMS)
        held: list[np.ndarray] = []
        size = 0

        def add() -> None:
            # neighbours never cross documents: a gap of WINDOW stands between them
            flat = np.concatenate(held)
            for step in range(1, WINDOW + 1):
                left, right = flat[:-step], flat[step:]
                both = (left >= 0) & (right >= 0)
                left, right = left[both], right[both]
                for centre, context in ((left, right), (right, left)):
                    for k in range(SPARSE):
                        at = centre * DIMS + positions[context, k]
                        sums[:] += np.bincount(at, weights=signs[context, k], minlength=BUCKETS * DIMS)

        gap = np.full(WINDOW, -1, np.int64)
        any_rows = False
        for batch in batches:
            for text in texts_of(batch.column(0)):
                any_rows = True
                held += [buckets_of(text, words), gap]
                size += len(held[-2])
                if size > 500_000:
                    add()
                    held, size = [], 0
        if held:
            add()
        if any_rows:
            group = TaskContext.get().partitionId() % FOLD_IN
            slices = [s.astype(np.int64).tobytes() for s in np.split(sums, PARTS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(PARTS), pa.int32()), pa.array([group] * PARTS, pa.int32()), pa.array(slices, pa.binary())],
                ["part", "fold", "sums"])

    schema = "part int, fold int, sums binary"
    tables = docs.select("text").mapInArrow(collect, schema)
    folded = _added(_added(tables, ["part", "fold"]).withColumn("fold", F.lit(0)), ["part"])
    out = np.zeros((PARTS, BUCKETS * DIMS // PARTS))
    for r in folded.collect():  # PARTS rows, together one table
        out[r["part"]] = np.frombuffer(r["sums"], np.int64)
    vectors = out.reshape(BUCKETS, DIMS)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.maximum(length, 1)).astype(np.float32)


def _added(tables: DataFrame, keys: list[str]) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, fold, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                got = np.frombuffer(data, np.int64)
                key = (part, fold)
                sums[key] = sums[key] + got if key in sums else got
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()),
                 pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["part", "fold", "sums"])

    return tables.repartition(*keys).mapInArrow(add, "part int, fold int, sums binary")


# --- pooling ---------------------------------------------------------------------------------------


def pooled(texts: list[bytes], vectors: np.ndarray, words: WordBuckets) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and how varied its words are."""
    out = np.zeros((len(texts), 2 * DIMS + 1), np.float32)
    for i, text in enumerate(texts):
        found = buckets_of(text, words)
        if len(found):
            kinds, counts = np.unique(found, return_counts=True)
            share = (counts / len(found)).astype(np.float32)
            rows = vectors[kinds]
            mean = share @ rows
            out[i, :DIMS] = mean
            out[i, DIMS : 2 * DIMS] = np.sqrt(np.maximum(share @ (rows * rows) - mean * mean, 0))
            out[i, -1] = len(kinds) / len(found)
    return out


# --- the network -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4, seed: int = 3) -> Network:
    """Adam on the logistic loss; every eighth row is kept back for the temperature."""
    inputs = x.shape[1] if x.ndim == 2 else 2 * DIMS + 1
    if len(y) < 8 or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Network(np.zeros(inputs), np.ones(inputs), np.zeros((inputs, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))), 1.0)
    rng = np.random.default_rng(seed)
    back = rng.permutation(len(y)) % 8 == 0
    mean, scale = x[~back].mean(axis=0), x[~back].std(axis=0) + 1e-6
    xs, ys = (x[~back] - mean) / scale, y[~back].astype(np.float64)
    p = {
        "w1": rng.normal(0, np.sqrt(2 / inputs), (inputs, HIDDEN)), "b1": np.zeros(HIDDEN),
        "w2": rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), "b2": np.zeros(1),
    }
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(ys))
        for low in range(0, len(order), 256):
            rows = order[low : low + 256]
            hidden = np.maximum(xs[rows] @ p["w1"] + p["b1"], 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ p["w2"] + p["b2"], -60, 60))) - ys[rows]) / len(rows)
            through = np.outer(error, p["w2"]) * (hidden > 0)
            slope = {
                "w1": xs[rows].T @ through + decay * p["w1"], "b1": through.sum(axis=0),
                "w2": hidden.T @ error + decay * p["w2"], "b2": np.array([error.sum()]),
            }
            step += 1
            for k, g in slope.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p["w1"], p["b1"], p["w2"], float(p["b2"][0]), 1.0)
    logits, truth = net.logits(x[back]), y[back]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, -np.where(truth > 0, 1, -1) * logits / t)) for t in grid]
    return Network(mean, scale, p["w1"], p["b1"], p["w2"], net.b2, float(grid[int(np.argmin(loss))]))


# --- learning and scoring ----------------------------------------------------------------------------


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    network: Network

    def score(self, texts: list[bytes], words: WordBuckets) -> np.ndarray:
        return self.network.scores(pooled(texts, self.vectors, words))


def fit_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = MAX_ROWS) -> QualityModel:
    """Vectors from all of ``docs``, the network from up to ``max_rows`` of its labelled rows."""
    vectors = word_vectors(docs)
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
    chosen = known.select("doc_id", F.col(target).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    chosen = materialize(chosen, "labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows rows of two numbers
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = pooled(texts_of(batch.column(1)), shared.value, words)
        return pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2), batch.column(0)], ["x", "y", "doc_id"])

    words = WordBuckets()
    found = arrow(rows.select("doc_id", "text", "y"), pool, "x binary, y int, doc_id long").orderBy("doc_id", "y").limit(2 * max_rows).collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in found], np.float64)
    return QualityModel(vectors, fit_network(x, np.array([r["y"] for r in found], np.int64)))


def score_documents(
    docs: DataFrame, model: QualityModel, threshold: float = 0.3, columns: tuple[str, ...] = ("doc_id",), kept_only: bool = False
) -> DataFrame:
    """``columns``, ``score`` and ``predicted`` of every document; with ``kept_only`` of those predicted 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sent = [*columns, *(c for c in ("text",) if c not in columns)]
    text_at = sent.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = shared.value.score(texts_of(batch.column(text_at)), words)
        made = [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]
        out = pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *made], [*columns, "score", "predicted"])
        return out.filter(pa.array(score >= threshold)) if kept_only else out

    words = WordBuckets()
    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], "score double, predicted int"])
    return arrow(docs.select(*sent), run, schema, rows=SLICE if "text" in columns else None)
