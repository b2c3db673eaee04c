"""SentencePiece models run by the tokenizers library.

The model protobuf is read field by field; normaliser, metaspace marker, pieces with their scores and byte fallback are
rebuilt. A unigram model keeps its scores; of a BPE model the merges are derived from them (a merge is as early as the
score of what it makes is high). Texts are cut before the markers no piece can contain inside,
and each distinct stretch is encoded once per worker, in multithreaded batches, and compared with the SentencePiece library: the
``parity`` of a text says that all its stretches agree. With a BPE model new stretches are encoded and compared in runs, and one by
one where a run differs. A model whose pieces hold a marker inside encodes and compares whole texts.

Edge cases: NULL and empty texts have no ids, and agree. A text that holds the marker character itself
encodes like a space and so does not come back from decoding: ``round_trip`` is false. Repeated rows are encoded each on its
own. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from ledgerline.llm.stages import arrow

MARK = "▁"
KEPT_STRETCHES = 400_000
TOGETHER = 32
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
THREADS = "2"


# --- the protobuf --------------------------------------------------------------------------------


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message; nested messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
        elif kind == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield number, data[at : at + size]
            at += size


@dataclass(frozen=True)
class PieceModel:
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    unknown: int
    charsmap: bytes
    dummy_prefix: bool
    remove_extra: bool
    escape: bool

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        pieces, trainer, normalizer = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        return cls(
            pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), unknown, normalizer.get(2, b""),
            bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1)))

    @property
    def splits_at_mark(self) -> bool:
        """No piece has a marker behind another character."""
        return self.escape and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind != CONTROL)


def merges_of(model: PieceModel) -> list[tuple[str, str]]:
    usable = {p: (score, i) for i, (p, score, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, (score, _) in usable.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in usable and right in usable:
                found.append((-score, usable[left][1], usable[right][1], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def rebuild(model: PieceModel, normalized: bool = True) -> Tokenizer:
    """The model as a tokenizer; without ``normalized`` it takes text that is so already."""
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    elif model.kind == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(
            vocabulary, merges_of(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    out = Tokenizer(core)
    if normalized:
        steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.remove_extra:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if model.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if model.escape else " "))
        if model.escape:
            steps.append(normalizers.Replace(" ", MARK))
        out.normalizer = normalizers.Sequence(steps)
    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence([*steps, decoders.Strip(" ", 1, 0)] if model.dummy_prefix and normalized else steps)
    return out


# --- encoding ----------------------------------------------------------------------------------------


class PieceEncoder:
    """Encodes texts stretch by stretch and remembers stretches with their verdicts."""

    def __init__(self, data: bytes) -> None:
        # read by the library's thread pool when it starts
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
        self.model = PieceModel.parse(data)
        self.inner = rebuild(self.model, normalized=False)
        self.normal = rebuild(self.model).normalizer
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.plain = not self.model.charsmap and not self.model.remove_extra and self.model.escape and self.model.dummy_prefix
        self.by_mark = self.plain and self.model.splits_at_mark
        self.cut = re.compile(f"(?<=[^{MARK}])(?={MARK})").split
        self.first_byte = next((i for i, p in enumerate(self.model.pieces) if p[2] == BYTE), len(self.model.pieces))
        self.begins = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        # two generations: a full one is set aside, and what is still met comes back from it
        self.stretches: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        # parity, round trip and byte pieces of the few stretches that differ from SentencePiece, do not come back or have byte pieces
        self.odd: dict[str, tuple[bool, bool, int]] = {}
        self.odd_before: dict[str, tuple[bool, bool, int]] = {}

    def cuts(self, text: str) -> list[str]:
        if not text:
            return []
        if self.by_mark and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return [MARK + w for w in text.split(" ")]
        whole = MARK + text.replace(" ", MARK) if self.plain else self.normal.normalize_str(text)
        return self.cut(whole) if self.model.splits_at_mark else [whole]

    def learn(self, wanted: Iterable[str]) -> None:
        """Encodes the stretches not known yet, in one batch, and compares."""
        if len(self.stretches) > KEPT_STRETCHES // 2:
            self.before, self.stretches = self.stretches, {}
            self.odd_before, self.odd = self.odd, {}
        new = []
        for s in dict.fromkeys(wanted):
            if s not in self.stretches:
                if s in self.before:
                    self.stretches[s] = self.before[s]
                    if s in self.odd_before:
                        self.odd[s] = self.odd_before[s]
                else:
                    new.append(s)
        if not new:
            return
        self.learn_alone(self.learn_together(new) if self.by_mark and self.model.kind == BPE else new)

    def learn_together(self, new: list[str]) -> list[str]:
        """Learns ``new`` from runs of ``TOGETHER`` stretches encoded, decoded and compared at once, as no merge crosses a marker.

        The stretches of a run that differs from SentencePiece or does not come back are returned.
        """
        runs = [new[i : i + TOGETHER] for i in range(0, len(new), TOGETHER)]
        joined = ["".join(r) for r in runs]
        ids = [e.ids for e in self.inner.encode_batch_fast(joined, add_special_tokens=False)]
        decoded = self.inner.decode_batch(ids, skip_special_tokens=False)
        spaced = [j.replace(MARK, " ") for j in joined]
        known = self.reference.encode([t[1:] for t in spaced], num_threads=int(THREADS))
        flat = np.fromiter(chain.from_iterable(ids), "<u4")
        first = self.begins[flat]
        found = np.concatenate([[0], np.cumsum(first)])[np.cumsum([0, *map(len, ids)])]
        right = [
            mine == theirs and back == t and f == len(r) == t.count(" ") and t[-1] != " "
            for mine, theirs, back, t, f, r in zip(ids, known, decoded, spaced, np.diff(found).tolist(), runs, strict=True)]
        kept = np.repeat(right, list(map(len, ids)))
        flat, first = flat[kept], first[kept]
        self.hold(list(chain.from_iterable(r for r, ok in zip(runs, right, strict=True) if ok)), flat, np.flatnonzero(first))
        return list(chain.from_iterable(r for r, ok in zip(runs, right, strict=True) if not ok))

    def hold(self, new: list[str], flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Keeps the ids of stretches that begin at ``starts`` of ``flat``; returns how many of each are byte pieces."""
        ends = np.append(starts[1:], len(flat)) if len(starts) else starts
        packed = flat.tobytes()
        self.stretches.update(zip(new, map(packed.__getitem__, map(slice, (4 * starts).tolist(), (4 * ends).tolist())), strict=True))
        is_byte = np.concatenate([[0], np.cumsum((flat >= self.first_byte) & (flat < self.first_byte + 256))])
        n_bytes = is_byte[ends] - is_byte[starts]
        for i in np.flatnonzero(n_bytes).tolist():
            self.odd[new[i]] = (True, True, int(n_bytes[i]))
        return n_bytes

    def learn_alone(self, new: list[str]) -> None:
        if not new:
            return
        encoded = self.inner.encode_batch_fast(new, add_special_tokens=False)
        ids = [e.ids for e in encoded]
        decoded = self.inner.decode_batch(ids, skip_special_tokens=False)
        if self.plain:
            known = self.reference.encode([s[1:].replace(MARK, " ") for s in new], num_threads=int(THREADS))
            # an empty text gets no dummy prefix, so a marker alone is asked behind a letter
            alone = self.reference.encode("a ")[len(self.reference.encode("a")) :]
            known = [alone if s == MARK else k for s, k in zip(new, known, strict=True)]
        else:
            known = ids  # compared as whole texts
        flat = np.fromiter(chain.from_iterable(ids), "<u4")
        n_bytes = self.hold(new, flat, np.cumsum([0, *map(len, ids[:-1])]))
        same = np.fromiter(map(eq, ids, known), bool, len(new))
        # a stretch in the middle of a text starts with its marker, as the dummy prefix does
        back = np.fromiter((b == s.replace(MARK, " ") for s, b in zip(new, decoded, strict=True)), bool, len(new))
        for i in np.flatnonzero(~same | ~back | (n_bytes > 0)).tolist():
            self.odd[new[i]] = (bool(same[i]), bool(back[i]), int(n_bytes[i]))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool, bool, int]]:
        """Ids (little-endian, unsigned 32-bit), parity, round trip and byte pieces of each text."""
        parts = [self.cuts(t) for t in texts]
        out = []
        low = 0
        while low < len(parts):
            # so many texts that their stretches fit beside each other
            high, size = low, 0
            while high < len(parts) and (high == low or size + len(parts[high]) <= KEPT_STRETCHES // 2):
                size += len(parts[high])
                high += 1
            self.learn(chain.from_iterable(parts[low:high]))
            for text, stretches in zip(texts[low:high], parts[low:high], strict=True):
                ids = b"".join(map(self.stretches.__getitem__, stretches))
                odd = [] if self.odd.keys().isdisjoint(stretches) else [self.odd[s] for s in stretches if s in self.odd]
                same = all([o[0] for o in odd])
                if not self.plain:
                    same = np.frombuffer(ids, "<u4").tolist() == self.reference.encode(text)
                back = all([o[1] for o in odd]) and MARK not in text
                out.append((ids, same, back, sum([o[2] for o in odd])))
            low = high
        return out


_ENCODERS: dict[bytes, PieceEncoder] = {}


def encoder(data: bytes) -> PieceEncoder:
    """One encoder per worker process and model."""
    if data not in _ENCODERS:
        _ENCODERS[data] = PieceEncoder(data)
    return _ENCODERS[data]


def encode_documents(docs: DataFrame, model: bytes, ids: bool = False) -> DataFrame:
    """n_ids, checksum, byte pieces, parity and round trip of every text (and its ids).

    ``model`` is the content of the model file: a vocabulary, of a size that does not grow with
    the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = encoder(shared.value).encode([t or "" for t in batch.column(1).to_pylist()])
        arrays = [
            batch.column(0), pa.array([len(f[0]) // 4 for f in found], pa.int64()), pa.array([zlib.crc32(f[0]) for f in found], pa.int64()),
            pa.array([f[3] for f in found], pa.int64()), pa.array([f[1] for f in found]), pa.array([f[2] for f in found]),
        ]
        if ids:
            arrays.append(pa.array([np.frombuffer(f[0], "<u4").astype(np.int32) for f in found], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "n_ids", "ids_crc32", "n_byte_pieces", "parity", "round_trip", *(["ids"] if ids else [])]
    schema = "doc_id long, n_ids long, ids_crc32 long, n_byte_pieces long, parity boolean, round_trip boolean"
    return arrow(docs.select("doc_id", "text"), run, schema + (", ids array<int>" if ids else ""))


def decode_documents(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text from doc_id and ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "t" not in held:
            held["t"] = rebuild(PieceModel.parse(shared.value))
        texts = held["t"].decode_batch([i or [] for i in batch.column(1).to_pylist()], skip_special_tokens=True)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    held: dict[str, Tokenizer] = {}
    return arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")
