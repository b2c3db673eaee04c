"""Prefix trie of conversations, built from adaptive radix trees.

A turn is a fixed-width id: the 16 bytes of a hash of role and text, most significant byte first. A conversation is the
concatenation of its turns' ids. Equal conversations are one key, counted before anything is built, so copies cost nothing
further. Keys are sorted into ranges, about ``RANGE_TURNS`` turns each; every range becomes one adaptive radix tree, whose
inner nodes grow through four layouts (4, 16, 48 and 256 children) and whose edges hold compressed paths. Walking a
tree emits a node at every depth that is a multiple of the id width, and nowhere else.

Ranges split hot prefixes: the nodes on the path to a range's first or last key may go on in the next range. These, two
paths a range, are emitted as parts and merged; all others are complete in their range. How many parts there are depends on the number
of ranges and the length of conversations, not on how many conversations share a prefix.

The SHA-256 over the conversations that end at a node takes ids in order, so it is fed by pieces of up to 4,096 ids which Spark sorts
apart; one stream per node then only reads pieces.

Edge cases: turns are ordered by ``turn``, NULL first, equal numbers by the id of role and text. NULL role or text is empty; rows
without a ``conv_id`` belong to no conversation. Repeated rows are repeated turns. Other columns are not read. An empty table has no
conversations and gives no rows, not even a root. One conversation is one key: it must fit a row (16 bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.stages import materialize, partitions

WIDTH = 16  # bytes of a turn id
RANGE_TURNS = 1_000_000
PIECE_BITS = 12  # ids of a piece of an end list lie in a range of 2 ** PIECE_BITS
WORDS = r"[^\x20\x09-\x0D]+"


# --- the tree ----------------------------------------------------------------------------------------


class Node:
    """An inner node or leaf: the compressed path to it, and children by the byte that follows.

    Up to 16 children stand in order beside their bytes; up to 48 are found through an index of 256 slots; beyond that
    every byte has its own place.
    """

    __slots__ = ("path", "row", "end", "keys", "kids", "size")

    def __init__(self, path: bytes, row: int, end: int = -1) -> None:
        self.path, self.row, self.end = path, row, end
        self.keys: bytearray | None = bytearray()
        self.kids: list[Node | None] = []
        self.size = 0

    @property
    def layout(self) -> int:
        return next(n for n in (4, 16, 48, 256) if self.size <= n)

    def find(self, byte: int) -> Node | None:
        if self.size <= 16:
            at = self.keys.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.size <= 48:
            at = self.keys[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Adds a child for a byte that has none, in the next larger layout if this one is full."""
        if self.size < 16:
            at = sum(b < byte for b in self.keys)
            self.keys.insert(at, byte)
            self.kids.insert(at, kid)
        else:
            if self.size == 16:
                index = bytearray(256)
                for slot, b in enumerate(self.keys, 1):
                    index[b] = slot
                self.keys = index
            elif self.size == 48:
                places: list[Node | None] = [None] * 256
                for b, slot in enumerate(self.keys):
                    if slot:
                        places[b] = self.kids[slot - 1]
                self.keys, self.kids = None, places
            if self.size < 48:
                self.kids.append(kid)
                self.keys[byte] = len(self.kids)
            else:
                self.kids[byte] = kid
        self.size += 1

    def swap(self, byte: int, kid: Node) -> None:
        """Another child for a byte that has one."""
        if self.size <= 16:
            self.kids[self.keys.find(byte)] = kid
        elif self.size <= 48:
            self.kids[self.keys[byte] - 1] = kid
        else:
            self.kids[byte] = kid

    def children(self) -> Iterator[Node]:
        """In the order of their bytes."""
        if self.size <= 16:
            yield from self.kids
        elif self.size <= 48:
            yield from (self.kids[slot - 1] for slot in self.keys if slot)
        else:
            yield from (k for k in self.kids if k is not None)


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        middle = (low + n) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            n = middle
    return low


def insert(root: Node, key: bytes, row: int) -> None:
    """Adds a key that is not in the tree."""
    node, above, at = root, None, 0
    while True:
        same = _shared(node.path, key[at : at + len(node.path)])
        if same < len(node.path):
            # the path is cut; what it led to goes below the cut
            upper = Node(node.path[:same], node.row)
            above.swap(key[at], upper)
            node.path = node.path[same:]
            upper.put(node.path[0], node)
            node = upper
        at += same
        if at == len(key):
            node.end = row
            return
        below = node.find(key[at])
        if below is None:
            node.put(key[at], Node(key[at:], row, row))
            return
        node, above = below, node


def tree_of(keys: list[bytes]) -> Node:
    root = Node(b"", 0)
    for row, key in enumerate(keys):
        insert(root, key, row)
    return root


def aligned_nodes(root: Node) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Depth, parent, a key below, and the key that ends there (-1: none) of every turn-aligned depth, parents first."""
    depth, parent, below, end = [0], [-1], [root.row], [root.end]
    waiting = [(kid, 0, 0) for kid in root.children()]
    while waiting:
        node, at, above = waiting.pop()
        last = at + len(node.path)
        for d in range(at // WIDTH + 1, last // WIDTH + 1):
            depth.append(d)
            parent.append(above)
            below.append(node.row)
            end.append(-1)
            above = len(depth) - 1
        if node.end >= 0:
            end[above] = node.end
        for kid in node.children():
            waiting.append((kid, last, above))
    return tuple(np.array(x, np.int64) for x in (depth, parent, below, end))


def rolled_up(parent: np.ndarray, n: np.ndarray, low: np.ndarray, kids: np.ndarray, leaves: np.ndarray, saved: np.ndarray, words: np.ndarray) -> None:
    """Adds every node to its parent, last first; the arrays hold what each node has itself."""
    for i in range(len(parent) - 1, -1, -1):
        if not kids[i]:
            leaves[i] = 1
        saved[i] += (n[i] - 1) * words[i]
        p = parent[i]
        if p >= 0:
            n[p] += n[i]
            low[p] = min(low[p], low[i])
            kids[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]


# --- conversations -----------------------------------------------------------------------------------------


def turn_id() -> Column:
    """16 bytes for role and text; the length keeps the two apart."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, pos, id, words: the first turns of the conversation at the last multiple of 20, then the own ones behind as many."""
    own = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_id().alias("id"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "id")
    own = materialize(own.withColumn("pos", F.row_number().over(order)).drop("turn"), "conversation_turns")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    convs = own.select("conv_id").distinct().withColumn("taken", taken.cast("int"))
    first = own.where("pos <= 3 AND conv_id % 20 = 0").select(F.col("conv_id").alias("base"), "pos", "id", "words")
    # three turns at most of each base, twenty conversations at most to each
    borrowed = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(first, "base").where("pos <= taken")
    rest = own.withColumn("taken", taken).where("pos > taken").drop("taken")
    return borrowed.select("conv_id", "pos", "id", "words").unionByName(rest.select("conv_id", "pos", "id", "words")), convs


def keyed_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, key (ids of all turns in order), words (of each turn); turnless conversations have an empty key."""
    rebuilt, convs = rebuilt_turns(turns)
    listed = F.array_sort(F.collect_list(F.struct("pos", "id", "words")))
    whole = rebuilt.groupBy("conv_id").agg(listed.alias("t"))
    keys = convs.select("conv_id").join(whole, "conv_id", "left")
    ids = F.transform(F.coalesce("t.id", F.array().cast("array<binary>")), lambda x: F.hex(x))
    return keys.select(
        "conv_id", F.unhex(F.array_join(ids, "")).alias("key"), F.coalesce("t.words", F.array().cast("array<long>")).alias("words"))


def distinct_keys(conversations: DataFrame) -> DataFrame:
    """key, words, n, low (smallest conversation), ends (SHA-256 of the conversations' ids) of every distinct key."""
    # conversations are distinct, so a piece holds 2 ** PIECE_BITS ids at most
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = conversations.withColumn("kid", F.md5("key")).groupBy("kid", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(
        F.first("key").alias("key"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), ids.alias("ids"))
    columns = ["kid", "key", "words", "n", "low", "ids"]

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per key from its pieces in order."""
        held = None
        names = ["key", "words", "n", "low", "ends"]
        types = [pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            out = []
            for kid, key, words, n, low, text in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if held is None or held[0] != kid:
                    if held:
                        out.append([*held[1:5], held[5].hexdigest()])
                    held = [kid, key, words, 0, low, hashlib.sha256()]
                else:
                    held[5].update(b",")
                held[5].update(text.encode())
                held[3] += n
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([*held[1:5], held[5].hexdigest()], types, strict=True)], names)

    n = partitions(conversations.sparkSession)
    ordered = pieces.repartition(n, "kid").sortWithinPartitions("kid", "piece").select(*columns)
    return ordered.mapInArrow(closed, "key binary, words array<long>, n long, low long, ends string")


# --- nodes -----------------------------------------------------------------------------------------------------

NODE = "id binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
NODE += "ends_sha256 string, words long, part boolean"
NONE_END = hashlib.sha256(b"").hexdigest()
NODE_TYPES = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.int64(), pa.bool_()]
NODE_NAMES = [c.split()[0] for c in NODE.split(", ")]


def range_nodes(keys: list[bytes], words: list[list[int]], n: np.ndarray, low: np.ndarray, ends: list[str]) -> pa.RecordBatch:
    """The nodes of one range of sorted keys: complete ones, and parts of those on the first and the last path.

    A part counts in ``n_children``, ``n_leaves`` and ``saved_tokens`` only what hangs on it in complete nodes.
    """
    depth, parent, below, end = aligned_nodes(tree_of(keys))
    size = len(depth)
    has = end >= 0
    members = np.where(has, n[end], 0)
    smallest = np.where(has, low[end], np.iinfo(np.int64).max)
    last_words = np.array([words[r][d - 1] if d else 0 for r, d in zip(below.tolist(), depth.tolist(), strict=True)], np.int64)
    open_ = np.zeros(size, bool)
    ended = np.empty(len(keys), np.int64)
    ended[end[has]] = np.flatnonzero(has)
    for row in (0, len(keys) - 1):
        at = ended[row]
        while at >= 0 and not open_[at]:
            open_[at] = True
            at = parent[at]
    kids, leaves, saved = (np.zeros(size, np.int64) for _ in range(3))
    total, least = members.copy(), smallest.copy()
    all_parent, all_kids, all_leaves, all_saved = parent, kids.copy(), leaves.copy(), saved.copy()
    rolled_up(all_parent, total, least, all_kids, all_leaves, all_saved, last_words)
    # parts: complete children only
    inner = np.flatnonzero(~open_)
    hung = inner[open_[parent[inner]]]
    np.add.at(kids, parent[hung], 1)
    np.add.at(leaves, parent[hung], all_leaves[hung])
    np.add.at(saved, parent[hung], all_saved[hung])
    pick = lambda part, whole: np.where(open_, part, whole)
    names = _path_names(keys, ended, parent, depth, open_)
    parents = [names.get(p) for p in parent.tolist()]
    known = np.where((parent >= 0) & ~open_[parent], least[parent], 0)
    arrays = [
        [names.get(i) for i in range(size)], parents, least, depth,
        pa.array(known, mask=(parent < 0) | open_[parent]), total, pick(kids, all_kids), pick(leaves, all_leaves), pick(saved, all_saved),
        [ends[e] if e >= 0 else NONE_END for e in end.tolist()], last_words, open_]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(arrays, NODE_TYPES, strict=True)], NODE_NAMES)


def _path_names(keys: list[bytes], ended: np.ndarray, parent: np.ndarray, depth: np.ndarray, open_: np.ndarray) -> dict[int, bytes]:
    """Node -> digest of its whole prefix, for the nodes on the first and the last path."""
    names: dict[int, bytes] = {}
    for row in (0, len(keys) - 1):
        path, at = [], int(ended[row])
        while at >= 0:
            path.append(at)
            at = int(parent[at])
        digest = hashlib.md5()
        for node in reversed(path):
            d = int(depth[node])
            if d:
                digest.update(keys[row][(d - 1) * WIDTH : d * WIDTH])
            names[node] = digest.copy().digest()
    return names


def merged_parts(parts: DataFrame) -> DataFrame:
    """Whole nodes from the parts; two paths a range, so they fit one task."""
    summed = parts.groupBy("id", "depth").agg(
        F.max("parent").alias("parent"), F.sum("n_convs").alias("n"), F.min("conv_id").alias("low"), F.sum("n_children").alias("kids"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("words").alias("words"),
        F.max(F.when(F.col("ends_sha256") != NONE_END, F.col("ends_sha256"))).alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([("depth", "ascending"), ("id", "ascending")])
        place = {i: at for at, i in enumerate(rows["id"].to_pylist())}
        parent = np.array([-1 if not d else place[p] for d, p in zip(rows["depth"].to_pylist(), rows["parent"].to_pylist(), strict=True)])
        n, low, kids, leaves, saved, words = (rows[c].to_numpy().astype(np.int64) for c in ("n", "low", "kids", "leaves", "saved", "words"))
        # members are whole already, so only what hangs below is added up
        rolled_up(parent, n.copy(), low, kids, leaves, saved, np.zeros_like(words))
        own = (n - 1) * words
        for i in range(len(parent) - 1, -1, -1):
            if parent[i] >= 0:
                own[parent[i]] += own[i]
        saved += own
        above = pa.array(low[parent], mask=parent < 0)
        arrays = [
            rows["id"].combine_chunks(), rows["parent"].combine_chunks(), low, rows["depth"].to_numpy(), above, n, kids, leaves, saved,
            [e or NONE_END for e in rows["ends"].to_pylist()], words, np.zeros(len(n), bool)]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(arrays, NODE_TYPES, strict=True)], NODE_NAMES)

    return summed.coalesce(1).mapInArrow(run, NODE)


def prefix_nodes(turns: DataFrame) -> DataFrame:
    """One row per node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    keys = materialize(distinct_keys(materialize(keyed_conversations(turns), "conversations")), "conversation_keys")
    size = keys.agg(F.sum(F.size("words")).alias("turns")).first()["turns"] or 0
    ranges = max(partitions(spark), -(-size // RANGE_TURNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            yield from pa.Table.from_batches([range_nodes(
                table["key"].to_pylist(), table["words"].to_pylist(), table["n"].to_numpy(), table["low"].to_numpy(),
                table["ends"].to_pylist())]).to_batches(20_000)

    sorted_keys = keys.repartitionByRange(ranges, "key").sortWithinPartitions("key")
    nodes = materialize(sorted_keys.mapInArrow(run, NODE), "trie_nodes")
    merged = materialize(merged_parts(nodes.where("part")), "trie_paths")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = nodes.where("NOT part")
    # children of a path learn their parent's smallest member here
    hanging = whole.where("parent_conv_id IS NULL").drop("parent_conv_id").join(
        merged.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    out = whole.where("parent_conv_id IS NOT NULL").select(*columns).unionByName(hanging.select(*columns))
    return out.unionByName(merged.select(*columns))
