"""Alignment of two tokenizers' tokens over the same bytes.

Each text is encoded by a byte-level BPE (A, behind a space) and by a SentencePiece model (B, which adds that space itself). Per
batch the tokens of either side form one frame, keyed by document, with their first bytes; ``pandas.merge_asof`` gives every
token start of one side the token of the other side that covers it. The two directions together are all overlapping
pairs (a pair whose tokens start at the same byte comes from the first direction only), and bytes at which tokens of both sides end
cut the text into groups.

How often an id pair is linked is counted over the whole corpus: workers send counts, not links, and Spark adds
them up. ``HEAD_PAIRS`` pairs at most, the most frequent, go to the workers by broadcast (16 bytes each, so a fixed
size); what a document holds of all other pairs is joined with the counts by Spark. Both ways together cover every link.

A text is encoded stretch by stretch: no token of either side reaches across a space that stands behind a
non-space and before a visible character, so every distinct stretch goes to the libraries once per worker, as long as two
bounded generations remember it. That A's pieces end there follows from the byte-level pattern, that B's do is read off its
vocabulary; otherwise whole texts are encoded. Long texts are aligned in slices that end between stretches, where both sides
end a token, so memory does not grow with a text's length; one stretch (a run without such a space) is the smallest unit.

Edge cases: NULL and empty texts, and texts in which either side's bytes are not the text's (a marker character U+2581, or what
a normaliser changes) have no tokens: zeros and an empty ``groups_sha256``. Rows are judged each on its own, so repeated rows and
rows without an id count each. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm.byte_bpe import _byte_letters, by_ranks, splits_by_pattern
from ledgerline.llm.sentence_pieces import BYTE, MARK, PieceModel
from ledgerline.llm.stages import materialize

HEAD_PAIRS = 1 << 20
KEPT_STRETCHES = 200_000  # a generation; two are held
SLICE_TOKENS = 200_000  # tokens of A in one frame
COUNTED_PAIRS = 400_000  # pairs a task holds before it sends their counts
STRETCH_ENDS = re.compile(r"(?<=[^ ])(?= \S)")
ODD = re.compile(r" \s|\s$").search
WINDOW = 1 << 20  # characters of a long text that are encoded at once
LAST_LETTER = "\u0590"


# --- the two tokenizers ----------------------------------------------------------------------------


Ids = tuple[bytes, bytes]


@dataclass
class Sides:
    """Both tokenizers, the bytes of all their ids, and the stretches encoded last."""

    a: Tokenizer
    b: sentencepiece.SentencePieceProcessor
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    by_stretch: bool
    ranks: tiktoken.Encoding | None
    new: dict[str, Ids | None] = field(default_factory=dict)
    old: dict[str, Ids | None] = field(default_factory=dict)

    @classmethod
    def build(cls, a_file: str, b_model: bytes) -> Sides:
        a = Tokenizer.from_str(a_file)
        a.encode_special_tokens = True
        letters = {letter: byte for byte, letter in _byte_letters().items()}
        a_bytes = [b""] * (1 + max(a.get_vocab(with_added_tokens=True).values()))
        for token, i in a.get_vocab(with_added_tokens=True).items():
            a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        model = PieceModel.parse(b_model)
        b_bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in model.pieces]
        plain = not model.charsmap and not model.remove_extra and model.escape and model.dummy_prefix
        form = json.loads(a_file)
        by_pattern = splits_by_pattern(form)
        return cls(
            a, sentencepiece.SentencePieceProcessor(model_proto=b_model), a_bytes, b_bytes, plain and model.splits_at_mark and by_pattern,
            by_ranks(form["model"], letters) if by_pattern else None)

    def windows(self, text: str) -> Iterator[str]:
        """Space and text, cut into parts of about ``WINDOW`` characters where both sides end a token."""
        low = 0
        while self.by_stretch and len(text) - low > 2 * WINDOW:
            cut = STRETCH_ENDS.search(text, low + WINDOW)
            if cut is None:
                break
            yield text[low : cut.start()] if low else " " + text[: cut.start()]
            low = cut.start()
        yield text[low:] if low else " " + text

    def stretches(self, window: str) -> list[str]:
        if not self.by_stretch:
            return [window]
        if ODD(window, 1):
            return STRETCH_ENDS.split(window)
        return [" " + w for w in window[1:].split(" ")]

    def learn(self, wanted: list[str]) -> None:
        """Makes every wanted stretch known, the unknown ones encoded in one batch."""
        if len(self.new) > KEPT_STRETCHES:
            self.old, self.new = self.new, {}
        missing = []
        for s in dict.fromkeys(wanted):
            if s not in self.new:
                if s in self.old:
                    self.new[s] = self.old[s]
                else:
                    missing.append(s)
        if self.ranks is None:
            self._one_by_one(missing)
            return
        # side by side, stretches keep their ends unless one ends in white space; letters of later
        # scripts are left to the tokenizer's own pattern
        fit = [s for s in missing if max(s) < LAST_LETTER and MARK not in s and not s[-1].isspace()]
        if fit:
            joined = "".join(fit)
            ends = np.cumsum([len(s.encode()) for s in fit])
            x = np.array(self.ranks.encode_ordinary(joined), "<u4")
            parts = ["".join(fit[k : k + 500])[1:] for k in range(0, len(fit), 500)]
            y = np.array([i for part in self.b.encode(parts, num_threads=1) for i in part], "<u4")
            if b"".join([self.b_bytes[i] for i in y]) == joined.encode():
                x_at, y_at = ([0, *(4 * (1 + np.searchsorted(np.cumsum(self.sizes(n)[v]), ends))).tolist()] for n, v in ((0, x), (1, y)))
                x, y = x.tobytes(), y.tobytes()
                for i, s in enumerate(fit):
                    self.new[s] = (x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]])
                missing = [s for s in missing if s not in self.new]
        self._one_by_one(missing)

    def sizes(self, side: int) -> np.ndarray:
        if not hasattr(self, "_lengths"):
            self._lengths = tuple(np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        return self._lengths[side]

    def _one_by_one(self, missing: list[str]) -> None:
        if missing:
            ids = [e.ids for e in self.a.encode_batch_fast(missing, add_special_tokens=False)]
            pieces = self.b.encode([s[1:] for s in missing], num_threads=1)
            for s, x, y in zip(missing, ids, pieces, strict=True):
                raw = s.encode()
                same = b"".join([self.a_bytes[i] for i in x]) == raw == b"".join([self.b_bytes[i] for i in y])
                self.new[s] = (np.array(x, "<u4").tobytes(), np.array(y, "<u4").tobytes()) if same else None


_SIDES: dict[tuple[str, bytes], Sides] = {}


def sides(a_file: str, b_model: bytes) -> Sides:
    """One pair of tokenizers per worker process and pair of files."""
    key = (hashlib.sha256(a_file.encode()).hexdigest(), hashlib.sha256(b_model).digest())
    if key not in _SIDES:
        _SIDES[key] = Sides.build(a_file, b_model)
    return _SIDES[key]


# --- the alignment -----------------------------------------------------------------------------------


@dataclass
class Aligned:
    """Links (A id, B id, document) and, per token, the group it lies in."""

    doc: np.ndarray
    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    groups: np.ndarray  # per document


def align(docs: np.ndarray, a: np.ndarray, b: np.ndarray, a_doc: np.ndarray, b_doc: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> Aligned:
    """Tokens of several documents, in order; ``*_doc`` are indices into ``docs``, ``*_size`` byte lengths.

    Both sides of a document hold the same bytes, so places in the joined bytes of all documents order
    either frame as ``merge_asof`` asks.
    """
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    left = pd.DataFrame({"at": a_end - a_size, "doc": a_doc, "a": a, "a_at": a_end - a_size}, copy=False)
    right = pd.DataFrame({"at": b_end - b_size, "doc": b_doc, "b": b, "b_at": b_end - b_size}, copy=False)
    from_a = pd.merge_asof(left[["at", "doc", "a"]], right, on="at", by="doc")
    from_b = pd.merge_asof(right[["at", "doc", "b"]], left, on="at", by="doc")
    # tokens that start together were paired from A's side already
    from_b = from_b[from_b["a_at"].to_numpy() != from_b["at"].to_numpy()]
    doc, x, y = (np.concatenate([from_a[c].to_numpy(), from_b[c].to_numpy()]) for c in ("doc", "a", "b"))
    # an end of one side is also one of the other: whether it starts there, or nothing is left
    shared = np.intersect1d(a_end, b_end, assume_unique=True)
    total = np.bincount(a_doc[np.searchsorted(a_end, shared)], minlength=len(docs))
    return Aligned(
        doc, x.astype(np.int64), y.astype(np.int64), np.searchsorted(shared, a_end - 1, "right"), np.searchsorted(shared, b_end - 1, "right"), total)


class Digits:
    """Decimal ids of both sides, written between their separators by gathering from one table of bytes."""

    def __init__(self, largest: int) -> None:
        text = [str(i).encode() for i in range(largest + 1)]
        self.width = max(map(len, text))
        self.size = np.array([len(t) for t in text])
        self.table = np.frombuffer(b"".join(t.ljust(self.width) for t in text), np.uint8).reshape(-1, self.width)

    def written(self, found: Aligned, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ``a1,a2|b1;a3|b2,b3;`` and, per group, where it ends."""
        group = np.concatenate([found.a_group, found.b_group])
        side = np.repeat(np.array([0, 1]), [len(a), len(b)])
        order = np.argsort(group * 2 + side, kind="stable")
        ids, group, side = np.concatenate([a, b])[order], group[order], side[order]
        # behind a token: a comma, or the bar at the end of A's part, or the semicolon at the end of the group
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[:-1][side[1:] != side[:-1]] = ord("|")
        last = np.append(group[1:] != group[:-1], True)
        mark[last] = ord(";")
        size = self.size[ids]
        cells = np.empty((len(ids), self.width + 1), np.uint8)
        cells[:, :-1] = self.table[ids]
        cells[np.arange(len(ids)), size] = mark
        ends = np.cumsum(size + 1)
        return cells[np.arange(self.width + 1)[None, :] <= size[:, None]], ends[last]


@dataclass
class _Document:
    """What is known of one document after some of its slices."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    differs: bool = False
    digest: object = field(default_factory=hashlib.sha256)
    pairs: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)


def _held(document: _Document) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a document and their links."""
    if not document.pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(document.pairs) == 1:
        return document.pairs[0], document.counts[0]
    keys, place = np.unique(np.concatenate(document.pairs), return_inverse=True)
    return keys, np.bincount(place, np.concatenate(document.counts), len(keys)).astype(np.int64)


class _Frame:
    """Slices of documents gathered until they make a frame."""

    def __init__(self, digits: Digits, sizes: tuple[np.ndarray, np.ndarray], width: int) -> None:
        self.digits, self.sizes, self.width = digits, sizes, width
        self.slices: list[tuple[_Document, bytes, bytes]] = []
        self.tokens = 0

    def add(self, document: _Document, a: bytes, b: bytes) -> None:
        self.slices.append((document, a, b))
        self.tokens += len(a) // 4
        if self.tokens >= SLICE_TOKENS:
            self.settle()

    def settle(self) -> None:
        """Aligns what is held and adds it to the documents."""
        slices, self.slices, self.tokens = self.slices, [], 0
        if not slices:
            return
        a, b = (np.frombuffer(b"".join([s[i] for s in slices]), "<u4").astype(np.int64) for i in (1, 2))
        n_a, n_b = (np.array([len(s[i]) // 4 for s in slices]) for i in (1, 2))
        numbers = np.arange(len(slices))
        found = align(numbers, a, b, np.repeat(numbers, n_a), np.repeat(numbers, n_b), self.sizes[0][a], self.sizes[1][b])
        text, ends = self.digits.written(found, a, b)
        cuts = [0, *ends[np.cumsum(found.groups) - 1].tolist()]
        # links of a slice, each distinct pair once
        key = np.sort(found.doc * (self.width * len(self.sizes[0])) + found.a * self.width + found.b)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        often = np.diff(np.append(first, len(key)))
        owner, pair = np.divmod(key[first], self.width * len(self.sizes[0]))
        bounds = np.searchsorted(owner, np.arange(len(slices) + 1))
        for i, (document, *_) in enumerate(slices):
            low, high = bounds[i], bounds[i + 1]
            document.n_a += int(n_a[i])
            document.n_b += int(n_b[i])
            # between slices stands the semicolon that the last group of a document lacks
            document.digest.update((b";" if document.n_groups else b"") + text[cuts[i] : cuts[i + 1] - 1].tobytes())
            document.n_groups += int(found.groups[i])
            document.n_links += int(often[low:high].sum())
            document.pairs.append(pair[low:high])
            document.counts.append(often[low:high])


SPANS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, counts binary"


def _spans(docs: DataFrame, a_file: str, b_model: bytes) -> DataFrame:
    """One row per document with its distinct pairs, and rows without a number that carry pair counts of a task."""
    shared = docs.sparkSession.sparkContext.broadcast((a_file, b_model))

    def packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
        return keys.astype("<i8").tobytes(), counts.astype("<i8").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = sides(*shared.value)
        width = len(tokenizers.b_bytes)
        sizes = (tokenizers.sizes(0), tokenizers.sizes(1))
        digits = Digits(max(len(s) for s in sizes))
        row = TaskContext.get().partitionId() << 40
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        schema = pa.schema([
            *[pa.field(c, pa.int64()) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")],
            pa.field("groups_sha256", pa.string()), pa.field("pairs", pa.binary()), pa.field("counts", pa.binary())])

        def counted() -> tuple[np.ndarray, np.ndarray]:
            nonlocal waiting, held
            keys, place = np.unique(np.concatenate([w[0] for w in waiting]), return_inverse=True)
            waiting = [(keys, np.bincount(place, np.concatenate([w[1] for w in waiting]), len(keys)).astype(np.int64))]
            held = len(keys)
            return waiting[0]

        def sent() -> pa.RecordBatch:
            nonlocal waiting, held
            keys, counts = packed(*counted())
            waiting, held = [], 0
            return pa.RecordBatch.from_pylist([{"pairs": keys, "counts": counts}], schema)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for low, high in _portions(texts):
                frame = _Frame(digits, sizes, width)
                documents = _encoded([t or "" for t in texts.slice(low, high - low).to_pylist()], tokenizers, frame)
                rows = []
                for i, document in zip(ids[low:high], documents, strict=True):
                    keys, counts = _held(document)
                    if len(keys):
                        waiting.append((keys, counts))
                        held += len(keys)
                    x, y = packed(keys, counts)
                    rows.append({
                        "row": row, "doc_id": i, "n_a": document.n_a, "n_b": document.n_b, "n_groups": document.n_groups,
                        "n_links": document.n_links, "groups_sha256": document.digest.hexdigest() if document.n_a else "", "pairs": x, "counts": y})
                    row += 1
                yield pa.RecordBatch.from_pylist(rows, schema)
                if held > 2 * COUNTED_PAIRS:
                    counted()
                    if held > COUNTED_PAIRS:
                        yield sent()
        if waiting:
            yield sent()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(run, SPANS)


def _portions(texts: pa.Array, size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes each; a longer text stands alone."""
    low = held = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if held and held + (n or 0) > size:
            yield low, i
            low, held = i, 0
        held += n or 0
    if low < len(texts):
        yield low, len(texts)


def _encoded(texts: list[str], tokenizers: Sides, frame: _Frame) -> list[_Document]:
    """Encodes texts and hands their windows to the frame; what stands in a window with other bytes counts for nothing."""
    documents = [_Document() for _ in texts]
    parts = ((d, tokenizers.stretches(w)) for d, t in zip(documents, texts, strict=True) if t for w in tokenizers.windows(t))
    while waiting := list(_some(parts)):
        tokenizers.learn([s for _, stretches in waiting for s in stretches])
        for document, stretches in waiting:
            got = [tokenizers.new[s] for s in stretches]
            if None in got:
                document.differs = True
            elif not document.differs:
                frame.add(document, b"".join([g[0] for g in got]), b"".join([g[1] for g in got]))
    frame.settle()
    return [_Document() if d.differs else d for d in documents]


def _some(parts: Iterator[tuple[_Document, list[str]]]) -> Iterator[tuple[_Document, list[str]]]:
    """The next windows, about as many stretches as are remembered."""
    held = 0
    for document, stretches in parts:
        yield document, stretches
        held += len(stretches)
        if held >= KEPT_STRETCHES:
            return


# --- counts of the corpus ------------------------------------------------------------------------------


def pair_counts(spans: DataFrame, width: int) -> DataFrame:
    """pair, n (its links in the corpus), best (no pair of the same B id has more)."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, "<i8")), pa.array(np.frombuffer(counts, "<i8"))], ["pair", "n"])

    sent = spans.where("row IS NULL").select("pairs", "counts").mapInArrow(opened, "pair long, n long")
    counts = materialize(sent.groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts")
    highest = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("highest"))
    joined = counts.withColumn("b", F.col("pair") % width).join(highest, "b")
    return materialize(joined.select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "ranked_pairs")


def _head(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The most frequent pairs, ``most`` at most, and the rest; levels of eighths of a power of two decide."""
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"])
    total, least = 0, None
    for r in levels:  # as many rows as there are levels, a few hundred at most
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    if least is None:
        return counts.where(F.lit(False)), counts
    return counts.where(level >= least), counts.where(level < least)


def align_documents(docs: DataFrame, a_file: str, b_model: bytes, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    ``a_file`` is the JSON of a byte-level BPE tokenizer, ``b_model`` the content of a SentencePiece model: vocabularies, whose
    size does not grow with the data.
    """
    spark = docs.sparkSession
    width = len(PieceModel.parse(b_model).pieces)
    spans = materialize(_spans(docs, a_file, b_model), "token_spans")
    counts = pair_counts(spans, width)
    head, tail = _head(counts, head_pairs)
    known = head.orderBy("pair").toPandas()  # head_pairs rows at most
    shared = spark.sparkContext.broadcast(tuple(known[c].to_numpy() for c in ("pair", "n", "best")))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            keys = [np.frombuffer(x, "<i8") for x in batch.column("pairs").to_pylist()]
            often = np.concatenate([np.frombuffer(x, "<i8") for x in batch.column("counts").to_pylist()])
            owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            every = np.concatenate(keys)
            place = np.minimum(np.searchsorted(pair, every), max(0, len(pair) - 1))
            hit = pair[place] == every if len(pair) else np.zeros(len(every), bool)
            total, top = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            at = place[hit]
            np.add.at(total, owner[hit], often[hit] * n[at])
            np.add.at(top, owner[hit], often[hit] * best[at])
            rest = np.flatnonzero(~hit)
            cuts = np.searchsorted(owner[rest], np.arange(len(keys) + 1)).astype(np.int32)
            left = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(
                [pa.array(every[rest]), pa.array(often[rest])], ["pair", "often"]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(top), pa.array(total), left], [*kept, "n_best", "count_sum", "rest"])

    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    rows = spans.where("row IS NOT NULL").mapInArrow(summed, schema + ", rest array<struct<pair: long, often: long>>")
    rows = materialize(rows, "aligned")
    rest = rows.select("row", F.explode("rest").alias("r")).select("row", "r.pair", "r.often").join(tail, "pair")
    rest = rest.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("more_best"), F.sum(F.col("often") * F.col("n")).alias("more_sum"))
    more = lambda name, extra: (F.col(name) + F.coalesce(extra, F.lit(0))).alias(name)
    return rows.join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256")
