"""Nearest neighbours by learned partitions.

On a bounded sample (``SAMPLE`` vectors, by a hash of the id) a neighbour graph is built and cut into balanced
parts. A small network learns which parts a vector's neighbours lie in. It then places every row of the whole
table, and routes each query to its most probable parts; all rows there are reranked by
exact inner products in double precision. How many parts a query visits is set on the sample: the
fewest that find ``TARGET`` of the true neighbours, both of sample queries and of distinct ones (copies find each
other in one part, whatever the others need). A query whose parts hold fewer than ``k`` other rows goes on in the
router's order until they do or no part is left.

Parts of any size are searched in units of at most about ``UNIT_ROWS`` rows by ``UNIT_QUERIES`` queries.

Edge cases: vectors that are NULL, zero, of another length than most of the sample, or hold NULL or non-finite components take no
part. Equal scores are ordered by id. Repeated ids are candidates each on its own, but never of a query with
the same id. Fewer candidates than ``k`` give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.stages import arrow, materialize

SAMPLE = 8_192
GRAPH = 10
HIDDEN = 128
TARGET = 0.97
MIN_PARTS, MAX_PARTS = 16, 256
UNIT_ROWS, UNIT_QUERIES = 4_096, 4_096
SLACK = 1e-9


# --- the sample ----------------------------------------------------------------------------------


def top_neighbours(vectors: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest inner products of each query, itself left out."""
    k = min(k, len(vectors) - 1)
    found = np.empty((len(queries), k), np.int64)
    for low in range(0, len(queries), 512):
        scores = queries[low : low + 512] @ vectors.T
        rows = np.arange(len(scores))
        scores[rows, own[low : low + 512]] = -np.inf
        found[low : low + 512] = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k else 0
    return found


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Parts of nearly equal size with few graph edges between them.

    Start: repeated halving along the direction of largest spread. Then nodes move to the part most of
    their neighbours are in, best gain first, while sizes stay within 10 % of even.
    """
    rng = np.random.default_rng(seed)
    n = len(vectors)
    part = np.zeros(n, np.int64)
    size = 1
    while size < parts:
        for p in range(size):
            rows = np.flatnonzero(part == p)
            if len(rows) > 1:
                centred = vectors[rows] - vectors[rows].mean(axis=0)
                direction = rng.normal(size=vectors.shape[1])
                for _ in range(8):  # power iteration
                    direction = centred.T @ (centred @ direction)
                    direction /= max(np.linalg.norm(direction), 1e-30)
                order = np.argsort(centred @ direction, kind="stable")
                part[rows[order[len(rows) // 2 :]]] += size
        size *= 2
    most, least = int(np.ceil(1.1 * n / parts)), int(0.9 * n / parts)
    # edges count both ways
    left = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    right = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    for _ in range(rounds):
        ties = np.bincount(left * parts + part[right], minlength=n * parts).reshape(n, parts)
        here = ties[np.arange(n), part]
        wish = ties.argmax(axis=1)
        gain = ties[np.arange(n), wish] - here
        sizes = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[wish[i]] < most and sizes[part[i]] > least:
                sizes[part[i]] -= 1
                sizes[wish[i]] += 1
                part[i] = wish[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass(frozen=True)
class Router:
    """Network from a vector to the probabilities (unscaled) of the parts; ``probes`` parts a query."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def part(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(axis=1)

    def best(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def fit_router(vectors: np.ndarray, parts: int, k: int = 20, epochs: int = 30, seed: int = 2) -> Router:
    n, d = vectors.shape
    graph = top_neighbours(vectors, vectors, np.arange(n), GRAPH)
    part = balanced_parts(vectors, graph, parts)
    wanted = np.zeros((n, parts))
    for column in range(graph.shape[1]):
        np.add.at(wanted, (np.arange(n), part[graph[:, column]]), 1)
    np.add.at(wanted, (np.arange(n), part), 1 + graph.shape[1] / 2)
    wanted /= wanted.sum(axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    mean, scale = vectors.mean(axis=0), 1 / max(float(vectors.std()), 1e-12)
    p = {
        "w1": rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), "b1": np.zeros(HIDDEN),
        "w2": rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), "b2": np.zeros(parts),
    }
    first, second = ({name: np.zeros_like(v) for name, v in p.items()} for _ in range(2))
    x, step = (vectors - mean) * scale, 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for low in range(0, n, 256):
            rows = order[low : low + 256]
            hidden = np.maximum(x[rows] @ p["w1"] + p["b1"], 0)
            z = hidden @ p["w2"] + p["b2"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            error = (z / z.sum(axis=1, keepdims=True) - wanted[rows]) / len(rows)
            through = error @ p["w2"].T * (hidden > 0)
            slope = {"w1": x[rows].T @ through, "b1": through.sum(axis=0), "w2": hidden.T @ error, "b2": error.sum(axis=0)}
            step += 1
            for name, g in slope.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                p[name] -= 3e-3 * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    router = Router(mean, scale, **p, probes=parts)
    return Router(mean, scale, **p, probes=_probes(router, vectors, parts, k, rng))


def _probes(router: Router, vectors: np.ndarray, parts: int, k: int, rng: np.random.Generator) -> int:
    """Fewest parts a query must visit to find ``TARGET`` of its true neighbours in the sample."""
    if len(vectors) < 2:
        return parts
    distinct = np.unique(vectors, axis=0, return_index=True)[1]
    return max(_reach(router, vectors, rng.permutation(own)[:512], parts, k) for own in (len(vectors), distinct))


def _reach(router: Router, vectors: np.ndarray, own: np.ndarray, parts: int, k: int) -> int:
    """Parts that hold ``TARGET`` of the neighbours of the rows ``own``."""
    truth = router.part(vectors)[top_neighbours(vectors, vectors[own], own, k)]
    order = router.best(vectors[own], parts)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(parts), order.shape), axis=1)
    needed = np.sort(np.take_along_axis(rank, truth, axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))) - 1)]) + 1


# --- the whole table --------------------------------------------------------------------------------


def usable(embeddings: DataFrame) -> DataFrame:
    """Rows with a vector to compare: finite, not zero."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def search(embeddings: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best rows found for each query row."""
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = Counter(len(r["embedding"]) for r in chosen).most_common(1)[0][0]
    sample = np.array([r["embedding"] for r in chosen if len(r["embedding"]) == dims], np.float64)
    rows = rows.where(F.size("embedding") == dims)
    total = rows.count()
    parts = MIN_PARTS
    while parts < MAX_PARTS and parts * parts * 4 < total:
        parts *= 2
    router = spark.sparkContext.broadcast(fit_router(sample, parts, k))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        part = router.value.part(_matrix(batch.column(1), dims))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], ["vec_id", "embedding", "part"])

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        best = router.value.best(_matrix(batch.column(1), dims), parts)
        # rows with the query's id are no candidates of it, wherever they are
        wanted = k + batch.column(2).to_numpy()
        needed = 1 + (np.cumsum(held[best], axis=1) < wanted[:, None]).sum(axis=1)
        visited = [b[:n] for b, n in zip(best.astype(np.int32).tolist(), np.maximum(needed, router.value.probes), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(visited, pa.list_(pa.int32()))], ["vec_id", "embedding", "parts"])

    kind = rows.schema["embedding"].dataType.simpleString()
    placed = materialize(arrow(rows, place, f"vec_id long, embedding {kind}, part int"), "placed")
    # at most MAX_PARTS parts
    counted = materialize(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part_sizes")
    held = np.zeros(parts, np.int64)
    for r in counted.collect():
        held[r["part"]] = r["n"]
    repeated = materialize(placed.groupBy("vec_id").agg(F.count(F.lit(1)).alias("same")).where("same > 1"), "repeated_ids")
    asked = usable(queries).where(F.size("embedding") == dims).join(repeated, "vec_id", "left")
    asked = asked.select("vec_id", "embedding", F.coalesce("same", F.lit(1)).alias("same"))
    routed = arrow(asked, route, f"vec_id long, embedding {kind}, parts array<int>")
    routed = materialize(routed.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.explode("parts").alias("part")), "routed")
    sizes = counted.select("part", F.ceil(F.col("n") / UNIT_ROWS).cast("int").alias("tall"))
    loads = routed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / UNIT_QUERIES).cast("int").alias("wide"))
    units = F.broadcast(materialize(sizes.join(loads, "part"), "units"))
    left = placed.join(units, "part").select(
        "part", F.pmod(F.xxhash64("vec_id"), "tall").cast("int").alias("x"),
        F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("y"), "vec_id", "embedding")
    right = routed.join(units, "part").select(
        "part", F.explode(F.sequence(F.lit(0), F.col("tall") - 1)).alias("x"),
        F.pmod(F.xxhash64("query_id"), "wide").cast("int").alias("y"), "query_id", "query")

    def rerank(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out = ([], [], [])
        if candidates.num_rows and asked.num_rows:
            c, q = _matrix(candidates["embedding"], dims), _matrix(asked["query"], dims)
            ids, query_ids = candidates["vec_id"].to_numpy(), asked["query_id"].to_numpy()
            for low in range(0, len(q), 256):
                rough = q[low : low + 256] @ c.T
                for i, scores in enumerate(rough):
                    query, vector = query_ids[low + i], q[low + i]
                    scores[ids == query] = -np.inf
                    at = max(0, len(scores) - k)
                    limit = np.partition(scores, at)[at]
                    near = np.flatnonzero(scores >= limit - SLACK * max(1.0, abs(limit))) if limit > -np.inf else np.flatnonzero(scores > -np.inf)
                    # product by product, so that equal vectors get equal scores wherever they stand
                    exact = (c[near] * vector).sum(axis=1)
                    best = np.lexsort((ids[near], -exact))[:k]
                    out[0].append(np.full(len(best), query))
                    out[1].append(ids[near][best])
                    out[2].append(exact[best])
        made = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table([pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.float64())], names=["query_id", "vec_id", "score"])

    unit = ["part", "x", "y"]
    found = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
