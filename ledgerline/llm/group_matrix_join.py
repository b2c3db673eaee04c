"""Similarity join of documents through a token-group matrix.

A document is the set of its word shingles (64-bit hashes); equal sets are one class. Similar classes are partitioned into groups of
about ``GROUP`` members, and a group stores the union of its members' tokens next to the members' places in it: its row
of the matrix. A query meets a group by two steps. First the number of its tokens that the union holds bounds its overlap with every
member; a group whose bound is below ``percent`` of the query's size is not opened. Then, in an opened group, one
pass over the members' places counts the overlap with each of them, and ``100 * intersection >= percent * union`` decides.

Which groups a query asks at all: two sets that are near enough differ in at most k tokens, k following from their sizes. The hash
space is cut into k + 2 ranges; the tokens of a set in one range give a signature. One range at least is the same on both sides, so
near sets share a signature that holds tokens (sets with so few filled ranges that this could fail also give signatures of empty
ranges). Signatures depend on about ten tokens each, so that a passage shared by many otherwise different texts does not bring them
together. Sizes fall into classes of a ratio of ``100 / percent``; a pair lies in one class or two neighbouring ones, and
a set gives the signatures of its own class and of the next.

Groups: a class's home is the smallest class it shares a signature with; a home is cut by a hash of its members, so that a third of all
rows in one home is many groups. Groups are compared first inside, then each with the smallest group of each of its signatures. The links
give components. Then, among groups that share a signature held by more than one component, those with members outside its
largest component are compared with all others. No pair of groups that could hold a link between two components is left out, and nothing is
capped or sampled; only groups already joined are not compared again. Pairs of groups, not of documents, are
shuffled.

Edge cases: NULL text, empty text and text of white space have no shingles and are linked with nothing; fewer words
than a shingle has make one shingle of the whole. Rows with one id and different texts count each; what either is linked with shares a
component through its own row. A row without an id is linked with nothing, its component is NULL. Repeated rows are one class. Other
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.near_dedup import WordHashes, _class_id, components, rebuilt_sets, shingle_set
from ledgerline.llm.stages import arrow, materialize, partitions, small_batches, texts_of

GROUP = 128
GROUP_TOKENS = 150_000
BATCH = 32  # rows that carry groups are handed over in batches of so many
_MIX, _STEP, _PART = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


# --- signatures ----------------------------------------------------------------------------------------


def difference(size: int, percent: int) -> int:
    """Most tokens in which two sets of up to ``size`` can differ and be near enough."""
    return 2 * size * (100 - percent) // (100 + percent)


@lru_cache(maxsize=None)
def _classes(percent: int, largest: int) -> list[int]:
    """First size of each class: what is near enough to a set lies in its class or the one before."""
    firsts = [1]
    while firsts[-1] <= largest:
        low = firsts[-1]
        # smallest x > low whose nearest smaller sets are not below low
        firsts.append(max(low + 1, 100 * (low - 1) // percent + 1))
    return firsts


def size_class(size: int, percent: int) -> tuple[int, int, int]:
    """Number of the size class, and the largest sizes in it and in the next one."""
    firsts = _classes(percent, 1 << max(8, (2 * size).bit_length()))
    at = int(np.searchsorted(firsts, size, "right")) - 1
    return at, firsts[at + 1] - 1, firsts[at + 2] - 1


def signatures_of(found: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a sorted set for its size class and the next one."""
    size = len(found)
    at, *largest = size_class(size, percent)
    out = []
    with np.errstate(over="ignore"):
        mixed = (found ^ (found >> np.uint64(31))) * _MIX
        mixed ^= mixed >> np.uint64(29)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        for scheme, most in enumerate(largest, at):
            k = difference(most, percent)
            if not k:
                continue  # only equal sets are near enough
            n = k + 2
            part = ((found >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(n + 1, dtype=np.uint64))
            filled = np.flatnonzero(cuts[1:] > cuts[:-1])
            # at most k ranges differ: with more than k filled ones, one of them is equal
            used = filled if len(filled) > k else np.arange(n)
            s = sums[cuts[used + 1]] - sums[cuts[used]]
            s = (s ^ (np.uint64(scheme + 1) * _STEP)) * _MIX + (used.astype(np.uint64) + np.uint64(1)) * _PART
            s ^= s >> np.uint64(32)
            out.append(s * _MIX)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def signed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, cid (NULL without shingles), signatures."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, ids, marks = [], [], []
        for text in texts_of(batch.column(1)):
            found = shingle_set(text, size, words)
            sizes.append(len(found))
            ids.append(_class_id(found) if len(found) else None)
            marks.append(signatures_of(found, percent).tobytes() if len(found) else None)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(marks, pa.binary())],
            ["doc_id", "n_shingles", "cid", "marks"])

    words = WordHashes()
    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_shingles long, cid long, marks binary")


def shared_signatures(classes: DataFrame) -> DataFrame:
    """mark, cid, lead (smallest class of the signature) for signatures of two classes or more."""

    def opened(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = [np.frombuffer(m, np.int64) for m in batch.column(1).to_pylist()]
        cids = np.repeat(batch.column(0).to_numpy(), [len(m) for m in marks])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(marks)), pa.array(cids)], ["mark", "cid"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted; of a signature only the first class is held, until a second one follows."""
        last_mark = last_cid = lead = None
        single = False
        for batch in batches:
            mark, cid = (batch.column(i).to_numpy() for i in range(2))
            if not len(mark):
                continue
            if last_mark is not None:
                mark, cid = np.append(last_mark, mark), np.append(last_cid, cid)
            fresh = (mark[1:] != mark[:-1]) | (cid[1:] != cid[:-1])
            keep = np.append(True, fresh)
            mark, cid = mark[keep], cid[keep]
            new = np.append(True, mark[1:] != mark[:-1])
            start = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            leads = cid[start]
            carried = last_mark is not None and mark[0] == last_mark and not single
            if carried:
                leads = leads.copy()
                leads[0] = lead
            size = np.diff(np.append(start, len(mark)))
            several_ = size > 1
            if carried:
                several_[0] = True
            out = several_[run]
            if carried:
                out[0] = False  # given out with the batch before
            # the last run may go on: what it holds is given out if it has two already, else it waits
            waits = not several_[-1]
            if waits:
                out[start[-1] :] = False
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(mark[out]), pa.array(cid[out]), pa.array(leads[run[out]])], ["mark", "cid", "lead"])
            last_mark, last_cid, lead, single = mark[-1:], cid[-1:], leads[-1], waits

    marks = arrow(classes.where("octet_length(marks) > 0").select("cid", "marks"), opened, "mark long, cid long")
    n = partitions(classes.sparkSession)
    return marks.repartition(n, "mark").sortWithinPartitions("mark", "cid").mapInArrow(several, "mark long, cid long, lead long")


# --- groups --------------------------------------------------------------------------------------------


def grouped(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """cid, gid, n_shingles: similar classes together, about ``GROUP`` of them or ``GROUP_TOKENS`` tokens."""
    home = shared.groupBy("cid").agg(F.min("lead").alias("home")).join(classes.select("cid", "n_shingles"), "cid")
    home = materialize(home, "homes")
    size = home.groupBy("home").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("n_shingles") / GROUP_TOKENS)).cast("long").alias("cells"))
    cell = F.pmod(F.xxhash64("cid"), "cells")
    return home.join(size, "home").select("cid", F.xxhash64("home", cell).alias("gid"), "n_shingles")


GROUP_ROW = "gid long, cids binary, starts binary, tokens binary, places binary, links array<struct<a: long, b: long>>"


class Group:
    """Members, the sorted union of their tokens, and the members' places in it one after the other."""

    def __init__(self, cids: np.ndarray, starts: np.ndarray, union: np.ndarray, places: np.ndarray) -> None:
        self.cids, self.starts, self.union, self.places = cids, starts, union, places
        self.sizes = np.diff(np.append(starts, len(places)))

    @classmethod
    def of(cls, cids: Sequence[int], sets: Sequence[bytes]) -> Group:
        parts = [np.frombuffer(s, np.uint64) for s in sets]
        union, places = np.unique(np.concatenate(parts), return_inverse=True)
        starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
        return cls(np.array(cids, np.int64), starts.astype(np.int64), union, places.astype(np.int32))

    @classmethod
    def read(cls, cids: bytes, starts: bytes, tokens: bytes, places: bytes) -> Group:
        return cls(np.frombuffer(cids, np.int64), np.frombuffer(starts, np.int64), np.frombuffer(tokens, np.uint64), np.frombuffer(places, np.int32))

    def row(self) -> list[bytes]:
        return [self.cids.tobytes(), self.starts.tobytes(), self.union.tobytes(), self.places.tobytes()]

    def member(self, i: int) -> np.ndarray:
        return self.places[self.starts[i] : self.starts[i] + self.sizes[i]]


def linked_members(queries: Group, group: Group, percent: int, inside: bool = False) -> list[tuple[int, int]]:
    """Links between members of two groups (or ``inside`` one): enough of them to join all that are linked."""
    if inside:
        place = np.arange(len(group.union))
        bound = queries.sizes
    else:
        # the union's places of the queries' tokens, -1 where it lacks them
        at = np.searchsorted(group.union, queries.union)
        at[at == len(group.union)] = 0
        place = np.where(group.union[at] == queries.union, at, -1)
        bound = np.add.reduceat((place >= 0)[queries.places].astype(np.int64), queries.starts)
    root = list(range(len(queries.cids) + len(group.cids)))
    offset = 0 if inside else len(queries.cids)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    held = np.zeros(len(group.union), bool)
    for i in np.flatnonzero(100 * bound >= percent * queries.sizes):
        mine = place[queries.member(i)]
        mine = mine[mine >= 0]
        held[mine] = True
        common = np.add.reduceat(held[group.places].astype(np.int64), group.starts)
        held[mine] = False
        near = 100 * common >= percent * (queries.sizes[i] + group.sizes - common)
        for j in np.flatnonzero(near).tolist():
            x, y = find(int(i)), find(offset + j)
            if x != y:
                root[y] = x
                links.append((int(queries.cids[i]), int(group.cids[j])))
    return links


def group_rows(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every group with its union, and the links inside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, cids, held = None, [], []
        for batch in batches:
            for g, c, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if g != gid and cids:
                    yield closed(gid, cids, held)
                    cids, held = [], []
                gid = g
                cids.append(c)
                held.append(s)
        if cids:
            yield closed(gid, cids, held)

    def closed(gid: int, cids: list[int], held: list[bytes]) -> pa.RecordBatch:
        group = Group.of(cids, held)
        links = [{"a": a, "b": b} for a, b in linked_members(group, group, percent, inside=True)]
        kinds = [pa.int64(), *[pa.binary()] * 4, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
        return pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in zip([gid, *group.row(), links], kinds, strict=True)], [c.split()[0] for c in GROUP_ROW.split(", ")[:5]] + ["links"])

    n = partitions(members.sparkSession)
    rows = members.join(sets, "cid").select("gid", "cid", "set").repartition(n, "gid").sortWithinPartitions("gid", "cid")
    return rows.mapInArrow(run, GROUP_ROW)


def compared(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """a, b: links between the members of each pair of groups (x, y)."""

    def run(batch: pa.RecordBatch) -> pa.Table | None:
        found = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found += linked_members(Group.read(*row[:4]), Group.read(*row[4:]), percent)
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())}) if found else None

    def side(name: str) -> DataFrame:
        return groups.select(F.col("gid").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))

    columns = ["cids", "starts", "tokens", "places"]
    both = pairs.join(side("y"), "y").join(side("x"), "x")
    return arrow(both.select(*(f"{n}_{c}" for n in "xy" for c in columns)), run, "a long, b long")


# --- the join --------------------------------------------------------------------------------------------


def similarity_join(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    rows = materialize(signed(docs, size, percent), "signed")
    linkable = rows.where("cid IS NOT NULL AND doc_id IS NOT NULL")
    classes = linkable.groupBy("cid").agg(F.min("doc_id").alias("doc_min"), F.first("n_shingles").alias("n_shingles"), F.first("marks").alias("marks"))
    shared = materialize(shared_signatures(classes), "shared_signatures")
    classes = materialize(linkable.groupBy("cid").agg(F.min("doc_id").alias("doc_min"), F.first("n_shingles").alias("n_shingles")), "classes")
    members = materialize(grouped(shared, classes), "members")
    sets = rebuilt_sets(spark, docs, members.select("cid"), classes, size, "shingle_sets", lambda found: found)
    with small_batches(spark, BATCH):
        groups = materialize(group_rows(members, sets, percent), "groups")
    links = groups.select(F.explode("links").alias("l")).select("l.a", "l.b")

    # the smallest group of each signature first: most of what belongs together meets there
    marks = materialize(shared.select("mark", "cid").join(members.select("cid", "gid"), "cid"), "grouped_marks")
    lead = marks.groupBy("mark").agg(F.min("gid").alias("x"), F.max("gid").alias("last")).where("x <> last").drop("last")
    first = marks.join(lead, "mark").where("gid <> x").select("x", F.col("gid").alias("y")).distinct()
    first = materialize(first, "first_pairs")
    links = links.unionByName(_links(spark, first, groups, percent))
    roots = components(links)

    rooted = marks.join(roots, marks["cid"] == roots["node"], "left").select("mark", "gid", F.coalesce("root", "cid").alias("root"))
    cross = _mixed_pairs(materialize(rooted, "rooted_marks")).join(first, ["x", "y"], "left_anti")
    cross = materialize(cross, "cross_pairs")
    more = _links(spark, cross, groups, percent)
    roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more), "all_links")

    placed = classes.join(roots, classes["cid"] == roots["node"], "left").select("cid", "doc_min", F.coalesce("root", "cid").alias("root"))
    placed = materialize(placed, "placed_classes")
    smallest = placed.groupBy("root").agg(F.min("doc_min").alias("component_id"))
    by_class = placed.join(smallest, "root").select("cid", "component_id")
    joined = linkable.join(by_class, "cid").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("cid IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone)


def _mixed_pairs(rooted: DataFrame) -> DataFrame:
    """Pairs of groups (x, y) that share a signature and are not known to be one component.

    Groups that hold only the largest component of a signature do not meet each other there. Of signatures held by the
    same groups one is enough.
    """
    cells = rooted.groupBy("mark", "gid").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    sums = [F.sum(F.xxhash64("gid", "low", "high", F.lit(i)).cast("decimal(38,0)")).alias(f"h{i}") for i in range(2)]
    marks = cells.groupBy("mark").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("n"), *sums)
    marks = materialize(marks.where("low <> high AND n > 1").groupBy("n", "h0", "h1").agg(F.min("mark").alias("mark")).select("mark"), "mixed_marks")
    held = rooted.join(marks, "mark").groupBy("mark", "root").agg(F.count(F.lit(1)).alias("n"))
    main = held.groupBy("mark").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    cells = cells.join(main, "mark").withColumn("other", (F.col("low") != F.col("main")) | (F.col("high") != F.col("main"))).drop("main")
    cells = materialize(cells, "mixed_groups")
    others = cells.where("other").select("mark", F.col("gid").alias("y"), F.col("low").alias("y_low"), F.col("high").alias("y_high"))
    both = cells.join(others, "mark").where("gid < y OR (gid > y AND NOT other)").where("low <> high OR y_low <> y_high OR low <> y_low")
    return both.select(F.least("gid", "y").alias("x"), F.greatest("gid", "y").alias("y")).distinct()


def _links(spark: SparkSession, pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    with small_batches(spark, BATCH):
        return materialize(compared(pairs, groups, percent), "links")
