"""Exact removal of long byte strings that an earlier document already holds.

A byte goes if it lies in a ``span``-byte string that also starts in a document with a smaller id. Strings
never cross documents and are judged on the input.

Steps. (1) Documents are put into blocks of a few MB, stored once. (2) Every window of ``span`` bytes chooses an
anchor, its 16-byte gram of smallest hash: equal windows choose equal anchors. Each block
sends its distinct anchor hashes to hash buckets and gets back one bit for each: does another block have it? (3) Runs of
windows with a repeated anchor go to the anchor's bucket, equal runs of a block once. A
bucket puts all suffixes of runs that differ into order: multikey quicksort, eight bytes a character, to ``SHALLOW``
bytes; blind tries order the groups that still agree. Neighbours that agree in ``span`` bytes are one
string, and its smallest document id goes back to the blocks. (4) Blocks cut their documents.

Only hashes and repeated runs are shuffled by content, once per block: a passage in a third of all
documents costs a bucket one entry per block. Texts travel twice, compressed, to meet the replies of
their block.

Edge cases: NULL text is empty, an empty or short text keeps everything. A document without an id comes after all others
and takes nothing from them. Rows with equal ids are not compared with each
other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.stages import arrow, materialize, partitions, texts_of

SPAN = 50
GRAM = 16
SHALLOW = 24
BLOCK_BYTES = 2 << 20
SEGMENT_BYTES = 1 << 20
POSITION_BITS = 24
BUCKET_BYTES = 16 << 20
LAST = np.iinfo(np.int64).max
BLOCK = "block long, ids binary, sizes binary, text binary"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_CODEC = pa.Codec("zstd", compression_level=1)


# --- blocks --------------------------------------------------------------------------------


def to_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents in blocks; a document is never split. Stored, so that block numbers stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                if held and held + len(text) > block_bytes:
                    yield _block(number, ids, texts)
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(LAST if doc is None else doc)
                texts.append(text)
                held += len(text)
        if ids:
            yield _block(number, ids, texts)

    return materialize(docs.select("doc_id", "text").mapInArrow(run, BLOCK + ", bytes long"), "blocks")


def _block(number: int, ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
    text = b"".join(texts)
    packed = len(text).to_bytes(8, "little") + _CODEC.compress(text, asbytes=True)
    columns = [[number], [np.array(ids, np.int64).tobytes()], [np.array([len(t) for t in texts], np.int64).tobytes()], [packed], [len(text)]]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "ids", "sizes", "text", "bytes"])


@dataclass
class Block:
    """One block with its runs: maximal ranges of window starts that share an anchor."""

    ids: np.ndarray
    ends: np.ndarray
    text: bytes
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray  # hash of the anchor
    doc: np.ndarray

    @classmethod
    def read(cls, ids: bytes, sizes: bytes, packed: bytes, span: int) -> Block:
        n = int.from_bytes(packed[:8], "little")
        text = _CODEC.decompress(packed[8:], decompressed_size=n, asbytes=True) if n else b""
        ends = np.cumsum(np.frombuffer(sizes, np.int64))
        return cls(np.frombuffer(ids, np.int64), ends, text, *_runs(text, ends, span))


def _runs(text: bytes, ends: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(text + bytes(GRAM), np.uint8)
    parts = []
    step = SEGMENT_BYTES
    for low in range(0, max(0, len(text) - span + 1), step):
        high = min(low + step, len(text) - span + 1)
        parts.append(_segment(data, low, high, span))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    at = np.concatenate([p[0] for p in parts])
    hashes = np.concatenate([p[1] for p in parts])
    starts = np.arange(len(at))
    doc = np.searchsorted(ends, starts, "right")
    fits = starts + span <= ends[doc]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~fits[:-1]
    new &= fits
    first = np.flatnonzero(new)
    number = np.cumsum(new)[fits] - 1
    return first, np.bincount(number, minlength=len(first)).astype(np.int64), hashes[first], doc[first]


def _segment(data: np.ndarray, low: int, high: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor position and hash of every window start in [low, high)."""
    width = span - GRAM + 1
    n = high - low + width - 1
    piece = np.ascontiguousarray(data[low : low + n + GRAM])
    words = np.ndarray((n + 8,), "<u8", piece.data, 0, (1,))
    with np.errstate(over="ignore"):
        h = words[:n] * _A
        h ^= h >> np.uint64(29)
        h += words[8 : 8 + n] * _B
        h ^= h >> np.uint64(32)
        h *= _A
        h ^= h >> np.uint64(29)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    least = (h & ~mask) | np.arange(n, dtype=np.uint64)
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    at = (least & mask).astype(np.int64)
    return at + low, h[at]


def _distinct_anchors(block: Block, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hashes ordered by bucket and value, their counts, and their buckets."""
    hashes, counts = np.unique(block.anchor, return_counts=True)
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return hashes[order], counts[order], bucket[order]


def _slices(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, end) of each run of equal values."""
    cuts = np.flatnonzero(np.diff(sorted_values, prepend=sorted_values[:1] - 1)) if len(sorted_values) else []
    for first, end in zip(cuts, [*cuts[1:], len(sorted_values)], strict=True):
        yield int(sorted_values[first]), int(first), int(end)


# --- which anchors are shared --------------------------------------------------------------


def shared_anchors(blocks: DataFrame, buckets: int, span: int) -> DataFrame:
    """One bit per distinct anchor of each block and bucket: another block has it too."""

    def ask(batch: pa.RecordBatch) -> pa.Table:
        rows = []
        for number, ids, sizes, packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            hashes, _, bucket = _distinct_anchors(Block.read(ids, sizes, packed, span), buckets)
            rows += [(number, b, hashes[i:j].tobytes()) for b, i, j in _slices(bucket)]
        return _rows(rows, [("block", pa.int64()), ("bucket", pa.int64()), ("blob", pa.binary())])

    def answer(asked: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, np.uint64) for x in asked["blob"].to_pylist()]
        hashes = np.concatenate(blobs)
        order = np.argsort(hashes)
        ranked = hashes[order]
        same = np.zeros(len(hashes) + 1, bool)
        same[1:-1] = ranked[1:] == ranked[:-1]
        shared = np.zeros(len(hashes), bool)
        shared[order] = same[1:] | same[:-1]
        cuts = np.cumsum([len(b) for b in blobs])[:-1]
        masks = [np.packbits(m).tobytes() for m in np.split(shared, cuts)]
        return asked.set_column(2, "blob", pa.array(masks, pa.binary()))

    schema = "block long, bucket long, blob binary"
    asked = arrow(blocks.select("block", "ids", "sizes", "text"), ask, schema)
    return _by_bucket(asked, buckets, answer)


def _by_bucket(asked: DataFrame, buckets: int, answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """``answer`` over the questions of one bucket at a time, of (block, bucket, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for b, i, j in _slices(batch.column(1).to_numpy()):
                if held and b != last:
                    yield from answer(pa.Table.from_batches(held)).to_batches()
                    held = []
                last = b
                held.append(batch.slice(i, j - i))
        if held:
            yield from answer(pa.Table.from_batches(held)).to_batches()

    ordered = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(run, "block long, bucket long, blob binary")


def _rows(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


# --- runs that repeat ------------------------------------------------------------------------


def _repeated_runs(block: Block, masks: pa.Table, buckets: int, span: int):
    """Runs with a shared anchor: per bucket the distinct texts with their place and smallest
    id, and for every such run its bucket and the place of its text."""
    hashes, counts, bucket = _distinct_anchors(block, buckets)
    shared = counts > 1
    by_bucket = dict(zip(masks["bucket"].to_pylist(), masks["blob"].to_pylist(), strict=True))
    for b, i, j in _slices(bucket):
        shared[i:j] |= np.unpackbits(np.frombuffer(by_bucket[b], np.uint8), count=j - i).astype(bool)
    wanted = np.sort(hashes[shared])
    if not len(wanted):
        return {}, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(wanted, block.anchor), len(wanted) - 1)
    chosen = np.flatnonzero(wanted[place] == block.anchor)
    starts, tails = block.start[chosen], block.start[chosen] + block.windows[chosen] + span - 1
    buckets_of = (block.anchor[chosen] % np.uint64(buckets)).astype(np.int64)
    ids = block.ids[block.doc[chosen]]
    found: dict[int, dict[bytes, list]] = {}
    at = np.empty(len(chosen), np.int64)
    text = block.text
    for k, (b, i, j, d) in enumerate(zip(buckets_of.tolist(), starts.tolist(), tails.tolist(), ids.tolist(), strict=True)):
        entries = found.setdefault(b, {})
        entry = entries.get(run := text[i:j])
        if entry is None:
            entry = entries[run] = [len(entries), d]
        elif d < entry[1]:
            entry[1] = d
        at[k] = entry[0]
    return found, chosen, buckets_of, at


def send_runs(blocks: DataFrame, masks: DataFrame, buckets: int, span: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for number, ids, sizes, packed in zip(*[left[c].to_pylist() for c in ("block", "ids", "sizes", "text")], strict=True):
            found, *_ = _repeated_runs(Block.read(ids, sizes, packed, span), right, buckets, span)
            rows += [(number, b, _pack(runs=list(e), first=[x[1] for x in e.values()])) for b, e in found.items()]
        return _rows(rows, [("block", pa.int64()), ("bucket", pa.int64()), ("blob", pa.binary())])

    left = blocks.select("block", "ids", "sizes", "text")
    return left.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(run, "block long, bucket long, blob binary")


_KINDS = {"runs": pa.binary(), "first": pa.int64(), "count": pa.int64()}


def _pack(**columns) -> bytes:
    table = pa.table({k: pa.array(v, _KINDS[k]) for k, v in columns.items()})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def smallest_ids(runs: DataFrame, buckets: int, span: int) -> DataFrame:
    """For every run sent: the smallest document id of each of its windows, run-length coded."""

    def answer(sent_runs: pa.Table) -> pa.Table:
        distinct: dict[bytes, int] = {}
        first, asked = [], []
        for blob in sent_runs["blob"].to_pylist():
            sent = _unpack(blob)
            places = []
            for run, d in zip(*[sent[c].to_pylist() for c in ("runs", "first")], strict=True):
                at = distinct.setdefault(run, len(distinct))
                if at == len(first):
                    first.append(d)
                elif d < first[at]:
                    first[at] = d
                places.append(at)
            asked.append(np.array(places, np.int64))
        texts = list(distinct)
        del distinct
        windows = np.array([len(t) for t in texts], np.int64) - span + 1
        ends = np.cumsum(windows)
        least = window_minima(texts, _anchors(texts, span), np.array(first, np.int64), windows, span)
        blobs = []
        for places in asked:
            values = least[_ranges(ends[places] - windows[places], windows[places])]
            new = np.flatnonzero(np.diff(values, prepend=~values[:1]))
            blobs.append(_pack(first=values[new], count=np.diff(new, append=len(values))))
        return sent_runs.set_column(2, "blob", pa.array(blobs, pa.binary()))

    return _by_bucket(runs, buckets, answer)


def _anchors(texts: list[bytes], span: int) -> np.ndarray:
    """Anchor hash of each run, whose windows all share it."""
    heads = b"".join([t[:span] for t in texts])
    data = np.frombuffer(heads + bytes(GRAM), np.uint8)
    step = SEGMENT_BYTES // span * span
    parts = [_segment(data, i, min(i + step, len(heads)) - span + 1, span)[1][::span] for i in range(0, len(heads), step)]
    return np.concatenate(parts)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All integers of the ranges [first, first + count), one after another."""
    total = int(count.sum())
    begin = np.cumsum(count) - count
    return np.arange(total) + np.repeat(first - begin, count)


# --- the suffix order ------------------------------------------------------------------------


def window_minima(texts: list[bytes], anchor: np.ndarray, first: np.ndarray, windows: np.ndarray, span: int) -> np.ndarray:
    """Smallest id over all runs that hold the same window, for every window of every run."""
    least = np.repeat(first, windows)
    _, group, size = np.unique(anchor, return_inverse=True, return_counts=True)
    varied = np.flatnonzero(size[group] > 1)  # runs that share their anchor with a different run
    if not len(varied):
        return least
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(windows) - windows
    local = [texts[i] for i in varied]
    data = np.frombuffer(b"".join(local) + bytes(span + 8), np.uint8)
    offset = np.cumsum(sizes[varied]) - sizes[varied]
    suffix = _ranges(offset, windows[varied])
    slot = _ranges(begins[varied], windows[varied])
    found = least[slot]
    for members in equal_suffixes(data, suffix, np.repeat(group[varied], windows[varied]), span):
        found[members] = found[members].min()
    least[slot] = found
    return least


def equal_suffixes(data: np.ndarray, suffix: np.ndarray, group: np.ndarray, span: int) -> Iterator[np.ndarray]:
    """Places in ``suffix`` whose first ``span`` bytes agree, class by class (two or more).

    Deep-shallow order: suffixes are sorted within ``group`` by multikey quicksort down to ``SHALLOW`` bytes; what
    still agrees there goes through blind tries.
    """
    words = np.ndarray((len(data) - 7,), ">u8", np.ascontiguousarray(data).data, 0, (1,))
    alive = np.arange(len(suffix))
    for depth in range(0, SHALLOW, 8):
        key = words[suffix[alive] + depth].astype(np.uint64)
        order = np.lexsort((key, group))
        alive, key, group = alive[order], key[order], group[order]
        new = np.ones(len(alive), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new)
        size = np.bincount(group)[group]
        alive, group = alive[size > 1], group[size > 1]
        if not len(alive):
            return
    text = data.tobytes()
    places, starts = alive.tolist(), (suffix[alive] + SHALLOW).tolist()
    for _, i, j in _slices(group):
        trie = BlindTrie(span - SHALLOW)
        for k in range(i, j):
            trie.insert(text[starts[k] : starts[k] + span - SHALLOW], places[k])
        for members in trie.ordered():
            if len(members) > 1:
                yield np.array(members)


class BlindTrie:
    """Patricia trie of equally long strings: inner nodes know only where strings branch.

    A string descends by its branching characters alone, is compared once with the leaf it reaches, and is
    put in at the first character where they differ.
    """

    def __init__(self, length: int) -> None:
        self.length = length
        self.root = None

    def insert(self, string: bytes, member: int) -> None:
        node = self.root
        if node is None:
            self.root = (string, [member])
            return
        while type(node[1]) is dict:
            children = node[1]
            node = children.get(string[node[0]]) or next(iter(children.values()))
        known = node[0]
        if known == string:
            node[1].append(member)
            return
        differ = (int.from_bytes(known, "big") ^ int.from_bytes(string, "big")).bit_length()
        at = self.length - 1 - (differ - 1) // 8
        leaf = (string, [member])
        parent, node = None, self.root
        while type(node[1]) is dict and node[0] < at:
            parent, node = node, node[1][string[node[0]]]
        if type(node[1]) is dict and node[0] == at:
            node[1][string[at]] = leaf
            return
        inner = (at, {known[at]: node, string[at]: leaf})
        if parent is None:
            self.root = inner
        else:
            parent[1][string[parent[0]]] = inner

    def ordered(self) -> Iterator[list[int]]:
        """Members of every leaf, in the order of the strings."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if type(node[1]) is dict:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                yield node[1]


# --- the cut -----------------------------------------------------------------------------------


def cut_documents(blocks: DataFrame, masks: DataFrame, replies: DataFrame, buckets: int, span: int, texts: bool) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        is_mask = right["reply"].to_numpy(zero_copy_only=False) == 0
        replied = right.filter(pa.array(~is_mask))
        answer = dict(zip(replied["bucket"].to_pylist(), replied["blob"].to_pylist(), strict=True))
        rows = []
        for ids, sizes, packed in zip(*[left[c].to_pylist() for c in ("ids", "sizes", "text")], strict=True):
            block = Block.read(ids, sizes, packed, span)
            found, chosen, bucket, at = _repeated_runs(block, right.filter(pa.array(is_mask)), buckets, span)
            order = np.argsort(bucket, kind="stable")
            hits = []
            for b, i, j in _slices(bucket[order]):
                coded = _unpack(answer[b])
                least = np.repeat(coded["first"].to_numpy(), coded["count"].to_numpy())
                windows = np.array([len(r) - span + 1 for r in found[b]], np.int64)
                begin = np.cumsum(windows) - windows
                mine = order[i:j]
                count = windows[at[mine]]
                from_reply = least[_ranges(begin[at[mine]], count)]
                start = _ranges(block.start[chosen[mine]], count)
                owner = np.repeat(block.ids[block.doc[chosen[mine]]], count)
                hits.append(start[from_reply < owner])
            start = np.concatenate(hits) if hits else np.zeros(0, np.int64)
            covered = np.bincount(start, minlength=len(block.text) + 1)
            covered -= np.bincount(start + span, minlength=len(covered))
            gone = np.cumsum(covered[:-1]) > 0
            rows += _cut(block, gone, texts)
        return _rows(rows, fields)

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if texts:
        fields += [("kept", pa.binary()), ("input_hash", pa.int64())]
        schema += ", kept binary, input_hash long"
    both = masks.withColumn("reply", F.lit(0)).unionByName(replies.withColumn("reply", F.lit(1)))
    left = blocks.select("block", "ids", "sizes", "text")
    return left.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(run, schema)


def _cut(block: Block, gone: np.ndarray, texts: bool) -> Iterator[tuple]:
    data = np.frombuffer(block.text, np.uint8)
    low = 0
    for doc, high in zip(block.ids.tolist(), block.ends.tolist(), strict=True):
        cut = gone[low:high]
        removed = int(np.count_nonzero(cut))
        kept = data[low:high][~cut].tobytes() if removed else block.text[low:high]
        spans = int(np.count_nonzero(cut[1:] & ~cut[:-1]) + bool(len(cut) and cut[0])) if removed else 0
        row = (None if doc == LAST else doc, high - low, removed, spans, hashlib.sha256(kept).hexdigest())
        yield (*row, kept, _spark_hash(block.text[low:high])) if texts else row
        low = high


def _spark_hash(text: bytes) -> int:
    """The value of Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(text, seed=42)
    return h - (1 << 64) if h >> 63 else h


def remove_repeats(docs: DataFrame, span: int = SPAN, texts: bool = False) -> DataFrame:
    """Counts and digest of what is kept of every document; with ``texts``, its bytes as well, and
    Spark's xxhash64 of the input text: with the id it tells which rows a cut belongs to."""
    spark = docs.sparkSession
    blocks = to_blocks(docs)
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(partitions(spark), -(-total // BUCKET_BYTES))
    masks = materialize(shared_anchors(blocks, buckets, span), "anchor_bits")
    runs = send_runs(blocks, masks, buckets, span)
    replies = materialize(smallest_ids(runs, buckets, span), "window_ids")
    return cut_documents(blocks, masks, replies, buckets, span, texts)
