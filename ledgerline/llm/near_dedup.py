"""Near-duplicate groups by HyperMinHash.

A document is the set of its word shingles, hashed to 64 bits. The hash space is cut into 128 buckets; of the smallest
hash in a bucket a register keeps its leading-zero count and the bits behind the leading one (6 + 6
bits). Bands of five registers pack into one BIGINT. Documents with equal sets are one class from the
start, so copies cost nothing further.

Candidates of a band value are not paired with each other. First every class meets only the smallest class of
its band value; pairs whose collision-corrected estimate is near enough are verified on their full sets, and the links
give components. Then, on a fifth of the bands, every class outside the largest component of its band
value meets the class it resembles most in another component: copies of one text meet that
text. Last, all classes of one band value that are still in different components are compared: those outside the
largest component with all the others, in units of bounded size, a pair only in the first band it shares. What
the 128 registers leave possible there is estimated again from 1,024 registers, which the classes of mixed
band values get in a second pass over their texts: pairs of one large group that lie just under the threshold end in
the unit. Nothing is capped. A link is a verified pair with ``100 * intersection >= percent * union``. Two sets at 85 % share
no band with probability below 1e-6, and either estimate lies under its cut (four standard deviations) with
probability below 1e-4; a group is lost only if all its links are.

Edge cases: NULL text, empty text and text of white space have no shingles and are linked with nothing. Fewer words
than a shingle has make one shingle of the whole. Rows with the same id count as one document when ids are compared. A row
without an id is linked with nothing and kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.stages import arrow, materialize, partitions, texts_of
from ledgerline.llm.url_filter import BlockedBloom

REGISTERS = 128
BUCKET_BITS = 7
FINE_BITS = 10
MANTISSA = 6
EMPTY = (1 << 12) - 1
BAND = 5
UNIT = 512
NEAREST_ROUNDS = 1
KEPT_WORDS = 100_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


# --- shingles and registers ------------------------------------------------------------------


class WordHashes(dict):
    """Word -> 64-bit hash, kept for repeated words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def shingle_set(text: bytes, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z in lower case."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(w) - size + 1)
    with np.errstate(over="ignore"):
        h = np.full(n, min(len(w), size), np.uint64)
        for i in range(min(size, len(w))):
            h = (h ^ w[i : i + n]) * _A
            h ^= h >> np.uint64(32)
        h = (h + _C) * _B
        h ^= h >> np.uint64(29)
    return np.unique(h)


def registers_of(hashes: np.ndarray, bits: int = BUCKET_BITS) -> np.ndarray:
    """One 12-bit register per bucket of the hash space."""
    out = np.full(1 << bits, EMPTY, np.uint16)
    if len(hashes):
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        rest = hashes[first] << np.uint64(bits)
        # 52 leading bits are exact in a double, so is their exponent
        lead = np.minimum(52 - np.frexp((rest >> np.uint64(12)).astype(np.float64))[1], 52)
        lead[rest >> np.uint64(12) == 0] = 52
        tail = (rest << (lead + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
        out[bucket[first]] = (lead << MANTISSA) | tail.astype(np.int64)
    return out


def bands_of(registers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, band and packed registers of every band that is not empty, for registers row by row."""
    used = REGISTERS // BAND * BAND
    parts = registers[:, :used].reshape(len(registers), -1, BAND)
    keys = np.zeros(parts.shape[:2], np.int64)
    for i in range(BAND):
        keys = keys << 12 | parts[:, :, i]
    row, band = np.nonzero((parts != EMPTY).any(axis=2))
    return row, band, keys[row, band]


def collision_rate(per_bucket: float) -> float:
    """Chance that different minima give the same register, at so many hashes a bucket."""
    lead = np.arange(53)[:, None]
    step = 0.5 ** (lead + 1 + MANTISSA)
    low = 0.5 ** (lead + 1) + np.arange(1 << MANTISSA)[None, :] * step
    inside = np.exp(-per_bucket * low) * -np.expm1(-per_bucket * step)
    # only buckets that hold anything count
    return float((inside**2).sum() / max(1e-12, -np.expm1(-per_bucket)) ** 2)


_RATES = np.array([collision_rate(2.0**k) for k in range(-8, 45)])


def estimate(mine: np.ndarray, other: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimate row by row, and the registers it rests on."""
    used = ((mine != EMPTY) | (other != EMPTY)).sum(axis=-1)
    equal = ((mine == other) & (mine != EMPTY)).sum(axis=-1)
    rate = _RATES[np.clip(np.round(np.log2(np.maximum(sizes, 1) / mine.shape[-1])) + 8, 0, len(_RATES) - 1).astype(int)]
    return np.clip((equal / np.maximum(used, 1) - rate) / (1 - rate), 0, 1), used


def near_enough(mine: np.ndarray, other: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Not lower than the threshold by more than four standard deviations, for sets of ``n`` and ``m`` shingles.

    The registers hold a random part of the union, drawn without replacement: the more of a small
    union they hold, the less the estimate varies. A chance collision of one register is left on top.
    """
    found, used = estimate(mine, other, np.maximum(n, m))
    j = percent / 100
    union = np.maximum((n + m) / (1 + j), 1)
    used = np.maximum(used, 1)
    left = np.clip(1 - (used - 1) / np.maximum(union - 1, 1), 0, 1)
    return found >= j - 4 * np.sqrt(j * (1 - j) / used * left) - 1 / used


# --- classes of equal sets ---------------------------------------------------------------------


def signatures(docs: DataFrame, size: int, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_shingles, class id (NULL without shingles), registers, and the columns ``carried``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = ([], [], [])
        for text in texts_of(batch.column(1)):
            found = shingle_set(text, size, words)
            cols[0].append(len(found))
            cols[1].append(_class_id(found) if len(found) else None)
            cols[2].append(registers_of(found).tobytes() if len(found) else None)
        arrays = [batch.column(0).cast(pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())]
        return pa.RecordBatch.from_arrays([*arrays, *batch.columns[2:]], ["doc_id", "n_shingles", "cid", "registers", *carried])

    words = WordHashes()
    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id long, n_shingles long, cid long, registers binary", *[f"`{c}` {kinds[c]}" for c in carried]])
    return arrow(docs.select("doc_id", "text", *carried), run, schema)


def _class_id(found: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(found.tobytes())
    return h - (1 << 64) if h >> 63 else h


def band_rows(classes: DataFrame, shared: Broadcast | None = None) -> DataFrame:
    """A hash of every band value of every class; with the filter ``shared`` band, key, class and its size of
    the values the filter may hold."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
        row, band, key = bands_of(registers)
        value = _band_hash(band, key)
        if shared is None:
            return pa.RecordBatch.from_arrays([pa.array(value)], ["h"])
        if len(row):
            held = shared.value.may_hold(value)
            row, band, key = row[held], band[held], key[held]
        cid, n = (batch.column(i).to_numpy()[row] for i in (0, 2))
        return pa.RecordBatch.from_arrays([pa.array(band.astype(np.int32)), pa.array(key), pa.array(cid), pa.array(n)], ["band", "key", "cid", "n"])

    return arrow(classes.select("cid", "registers", "n_shingles"), run, "h long" if shared is None else "band int, key long, cid long, n long")


def _band_hash(band: np.ndarray, key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (key.astype(np.uint64) + band.astype(np.uint64) * _C) * _A
        h = (h ^ (h >> np.uint64(32))) * _B
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def shared_bands(classes: DataFrame) -> DataFrame:
    """Rows of the band values that two classes or more hold, and of few others.

    Most values belong to one class: their hashes are shuffled once, to be counted, and a fixed-size Bloom
    filter of the shared ones keeps them out of everything that follows.
    """
    shared = band_rows(classes).groupBy("h").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = materialize(shared.select("h"), "shared_values")
    bloom = classes.sparkSession.sparkContext.broadcast(BlockedBloom.build(shared, "h"))
    return materialize(band_rows(classes, bloom), "bands")


# --- pairs -----------------------------------------------------------------------------------------


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the registers leave possible."""

    @F.pandas_udf("boolean")
    def possible(a, b, n, m):
        import pandas as pd

        mine, other = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, REGISTERS) for x in (a, b))
        return pd.Series(near_enough(mine, other, n.to_numpy(), m.to_numpy(), percent))

    def side(name: str) -> DataFrame:
        return classes.select(F.col("cid").alias(name), F.col("registers").alias(f"r_{name}"), F.col("n_shingles").alias(f"n_{name}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    # sizes alone bound the ratio
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return both.where(sizes).where(possible("r_a", "r_b", "n_a", "n_b")).select("a", "b")


def rebuilt_sets(
    spark: SparkSession, docs: DataFrame, cids: DataFrame, classes: DataFrame, size: int, name: str, form: Callable[[np.ndarray], np.ndarray]
) -> DataFrame:
    """cid and ``form`` of the full set, for the classes in ``cids``.

    Sets are made from the texts again, for the smallest document of the classes in question
    only: a fixed-size Bloom filter of their ids keeps other texts out of the shuffle.
    """
    asked = materialize(cids.join(classes.select("cid", "doc_min"), "cid"), "asked_classes")
    bloom = spark.sparkContext.broadcast(BlockedBloom.build(asked.select(F.xxhash64("doc_min").alias("h")), "h"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            hashes = batch.column(2).to_numpy()
            chosen = np.flatnonzero(bloom.value.may_hold(hashes)) if len(hashes) else []
            if len(chosen):
                part = batch.take(pa.array(chosen))
                found = [shingle_set(t, size, words) for t in texts_of(part.column(1))]
                ids = [_class_id(f) if len(f) else None for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(ids, pa.int64()), pa.array([form(f).tobytes() for f in found], pa.binary())],
                    ["doc_min", "cid", "set"])

    read = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
    made = read.mapInArrow(sets, "doc_min long, cid long, set binary")
    return materialize(made.join(asked, ["doc_min", "cid"], "left_semi").dropDuplicates(["cid"]).drop("doc_min"), name)


def verified(spark: SparkSession, docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose full sets are near enough."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    made = rebuilt_sets(spark, docs, asked, classes, size, "shingle_sets", lambda found: found)

    @F.pandas_udf("boolean")
    def linked(a, b):
        import pandas as pd

        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * common >= percent * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    def side(name: str) -> DataFrame:
        return made.select(F.col("cid").alias(name), F.col("set").alias(f"s_{name}"))

    return pairs.join(side("b"), "b").join(side("a"), "a").where(linked("s_a", "s_b")).select("a", "b")


# --- components --------------------------------------------------------------------------------------


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """``node``, ``root`` (smallest node reached) of every node with a link.

    Alternating large-star and small-star steps; every step is stored. Stops when every node has one
    parent and no parent has one itself, or when a step changes nothing.
    """
    current = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, name)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = materialize(small.unionByName(lowest.withColumnRenamed("m", "v")).distinct(), name)
        parents = current.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("p")).distinct()
        per_node = current.withColumn("p", F.col("v")).select("u", "p").unionByName(parents).groupBy("u").agg(
            F.count("p").alias("up"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "p").cast("decimal(38,0)")).alias("h"))
        # a node with a parent that is a parent as well, or with two parents, is not at its root yet
        state = per_node.agg(F.coalesce(F.sum((F.col("up") * F.col("n") > 1).cast("long")), F.lit(0)).alias("open"), F.sum("h").alias("h")).first()
        if not state["open"] or state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def _first_pairs(bands: DataFrame, percent: int) -> DataFrame:
    """Every class with the smallest class of each of its band values, if their sizes allow a link."""
    lead = bands.groupBy("band", "key").agg(F.min("cid").alias("a"), F.min_by("n", "cid").alias("n_a"), F.count(F.lit(1)).alias("held"))
    sizes = 100 * F.least("n_a", "n") >= percent * F.greatest("n_a", "n")
    return bands.join(lead.where("held > 1"), ["band", "key"]).where("cid <> a").where(sizes).select("a", F.col("cid").alias("b")).distinct()


def _mixed_bands(bands: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bands with the component of each class; band values with more than one component."""
    bucket = ["band", "key"]
    rooted = bands.join(roots, bands["cid"] == roots["node"], "left").select(*bucket, "cid", F.coalesce("root", "cid").alias("root"))
    rooted = materialize(rooted, "rooted_bands")
    per_root = rooted.groupBy(*bucket, "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = per_root.groupBy(*bucket).agg(
        F.count(F.lit(1)).alias("roots"), F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("main")).where("roots > 1")
    mixed = mixed.select(*bucket, "all", (F.col("all") - F.col("main.n")).alias("rest"), F.col("main.root").alias("main"))
    return rooted, materialize(mixed, "mixed_bands")


def _cross_pairs(rooted: DataFrame, mixed: DataFrame, sketches: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Possible pairs of one band value that lie in different components; with ``nearest``
    only the best of each class in its unit.

    Members outside the value's largest component meet all members, in units of about ``UNIT`` by
    ``UNIT`` classes; units, not band values, are the tasks' groups.
    """
    spark = rooted.sparkSession
    bucket = ["band", "key"]
    carried = ["cid", "root", "registers", "fine", "n_shingles"]
    rows = rooted.join(mixed, bucket).join(sketches, "cid")
    rows = rows.withColumns({
        "tall": F.ceil(F.col("all") / UNIT).cast("int"), "wide": F.ceil(F.col("rest") / UNIT).cast("int"),
        "h": F.xxhash64("cid"), "other": F.col("root") != F.col("main")})
    rows = rows.withColumns({"x0": F.pmod("h", "tall").cast("int"), "y0": F.pmod("h", "wide").cast("int")})
    # a member stands in all units of its column; one outside the largest component in those of its row as well
    column = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda y: F.struct(
        F.col("x0").alias("x"), y.alias("y"), F.lit(True).alias("member"), (F.col("other") & (y == F.col("y0"))).alias("outer")))
    across = F.transform(F.filter(F.sequence(F.lit(0), F.col("tall") - 1), lambda x: F.col("other") & (x != F.col("x0"))), lambda x: F.struct(
        x.alias("x"), F.col("y0").alias("y"), F.lit(False).alias("member"), F.lit(True).alias("outer")))
    units = rows.select(*bucket, *carried, F.explode(F.concat(column, across)).alias("_u")).select(*bucket, "_u.x", "_u.y", *carried, "_u.member", "_u.outer")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            # rows come sorted by unit; a unit may go on in the next batch
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                key = tuple(keys[i])
                if key != last and held:
                    yield from _unit_pairs(held, percent, nearest)
                    held = []
                last = key
                held.append(batch.slice(i, j - i))
        if held:
            yield from _unit_pairs(held, percent, nearest)

    n = partitions(spark)
    ordered = units.repartition(n, *bucket, "x", "y").sortWithinPartitions(*bucket, "x", "y")
    return ordered.mapInArrow(compare, "a long, b long").distinct()


def _unit_pairs(held: Sequence[pa.RecordBatch], percent: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    unit = pa.Table.from_batches(held)
    cid, root, n = (unit[c].to_numpy() for c in ("cid", "root", "n_shingles"))
    registers = np.frombuffer(b"".join(unit["registers"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
    fine = np.frombuffer(b"".join(unit["fine"].to_pylist()), np.uint16).reshape(-1, 1 << FINE_BITS)
    band = unit["band"][0].as_py()
    rows, everyone = (np.flatnonzero(unit[c].to_numpy(zero_copy_only=False)) for c in ("outer", "member"))
    a, b = [], []
    for i in rows:
        apart = everyone[root[everyone] != root[i]]
        apart = apart[100 * np.minimum(n[apart], n[i]) >= percent * np.maximum(n[apart], n[i])]
        if len(apart):
            hit = apart[near_enough(registers[i][None, :], registers[apart], n[apart], n[i], percent)]
            if not nearest and len(hit):
                hit = hit[_first_shared(registers[i], registers[hit]) == band]
            if len(hit):
                hit = hit[near_enough(fine[i][None, :], fine[hit], n[hit], n[i], percent)]
            if nearest and len(hit):
                hit = hit[[estimate(fine[i][None, :], fine[hit], np.maximum(n[hit], n[i]))[0].argmax()]]
            a.append(np.minimum(cid[hit], cid[i]))
            b.append(np.maximum(cid[hit], cid[i]))
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _first_shared(mine: np.ndarray, others: np.ndarray) -> np.ndarray:
    """First band that is equal and not empty."""
    used = REGISTERS // BAND * BAND
    mine, others = mine[:used].reshape(-1, BAND), others[:, :used].reshape(len(others), -1, BAND)
    return ((others == mine).all(axis=2) & (mine != EMPTY).any(axis=1)).argmax(axis=1)


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    With ``carried``, these columns as well and ``root``, the component's smallest class (NULL for a row
    linked with nothing): unlike ids, it never stands for texts of two components."""
    spark = docs.sparkSession
    sig = materialize(signatures(docs, size, carried), "signatures")
    linkable = sig.where("cid IS NOT NULL AND doc_id IS NOT NULL")
    classes = linkable.groupBy("cid").agg(
        F.min("doc_id").alias("doc_min"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    classes = materialize(classes, "classes")
    bands = shared_bands(classes)

    first = materialize(_first_pairs(bands, percent), "first_pairs")
    possible = materialize(estimated(first, classes, percent), "possible_pairs")
    links = materialize(verified(spark, docs, possible, classes, size, percent), "first_links")
    roots = components(links)

    known = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rooted, mixed = _mixed_bands(bands, roots)
    # components only grow, so no later round has other classes in mixed band values
    unsettled = rooted.join(mixed, ["band", "key"], "left_semi").select("cid").distinct()
    fine = rebuilt_sets(spark, docs, unsettled, classes, size, "fine_sketches", lambda found: registers_of(found, FINE_BITS))
    sketches = fine.withColumnRenamed("set", "fine").join(classes.select("cid", "registers", "n_shingles"), "cid")
    sketches = materialize(sketches, "sketches")
    for step in (*range(NEAREST_ROUNDS), None):
        if step is None:
            rooted, mixed = _mixed_bands(bands, roots)
        chosen = mixed if step is None else mixed.where(F.col("band") % 5 == step)
        pairs = _cross_pairs(rooted, chosen, sketches, percent, step is not None)
        pairs = materialize(pairs.join(known, ["a", "b"], "left_anti"), "cross_pairs")
        more = verified(spark, docs, pairs, classes, size, percent)
        roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more), "all_links")
        known = known.unionByName(pairs)

    placed = classes.join(roots, classes["cid"] == roots["node"], "left").select("cid", "doc_min", F.coalesce("root", "cid").alias("root"))
    placed = materialize(placed, "placed_classes")
    smallest = placed.groupBy("root").agg(F.min("doc_min").alias("component_id"))
    more = [*carried, "root"] if carried else []
    by_class = placed.join(smallest, "root").select("cid", "component_id", *more[-1:])
    joined = linkable.join(by_class, "cid").select("doc_id", "n_shingles", "component_id", *more)
    alone = sig.where("cid IS NULL OR doc_id IS NULL").withColumn("root", F.lit(None).cast("long"))
    alone = alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *more)
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
