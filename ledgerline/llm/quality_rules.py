"""Quality rules: distribution divergence from a reference of the document's language.

Two histograms describe a document: character classes, and the common words of its language with one further bin
for all other words. The references come from the whole corpus: class shares per
language, and as common words all words that make up at least ``COMMON_SHARE`` of a language (so at most 1 /
COMMON_SHARE of them). A document is rejected if the Jensen-Shannon distance (base 2, so between 0 and 1) to
a reference is above its threshold; a histogram with fewer than its minimum of characters or words is not judged.

A text without any common word lies at a distance that depends on how much the common words hold, so
the word distance counts in units of that distance as well: beyond ``LACKING`` of it, and with less than ``FEW`` of the
common words due, a text lacks the words of its language, and a text nearer to another language's reference by ``NEARER`` is in the wrong one. Both need
``EXPECTED`` common words to be due at the text's length: where common words are rare (scripts without spaces, say), a text
may lack them by chance.

References are small (languages with at least ``LANGUAGE_SHARE`` of the words, so at most 1 / LANGUAGE_SHARE
of them). A document whose language is NULL or has no reference is compared with that of the whole corpus. That one
mixes languages, so lacking its words says nothing: without a language a text goes if it lacks the words of every
language, and with one that has no reference only the thresholds hold.

Edge cases: NULL and empty texts have zero counts and fail the base rule. Every row is judged by itself, so
repeated rows and ids do no harm. An empty table gives no rows. Columns besides id, text and
language are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.stages import SLICE, arrow, materialize, texts_of

COMMON_SHARE = 0.004
LANGUAGE_SHARE = 0.001
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.4
LACKING = 0.8
FEW = 0.6
NEARER = 0.05
EXPECTED = 16
MIN_CHARS = 200
MIN_WORDS = 80
PARTIAL_WORDS = 200_000
ALL = "*"
CLASSES = ("lower", "upper", "digit", "space", "point", "symbol", "letter beyond ASCII", "control")
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def _class_table() -> np.ndarray:
    """Class of every UTF-8 byte; -1 for bytes that continue a character."""
    table = np.full(256, 7, np.int64)
    for byte in range(256):
        c = chr(byte)
        if byte >= 0xC0:
            table[byte] = 6
        elif byte >= 0x80:
            table[byte] = -1
        elif c.islower():
            table[byte] = 0
        elif c.isupper():
            table[byte] = 1
        elif c.isdigit():
            table[byte] = 2
        elif byte in SPACES:
            table[byte] = 3
        elif c in ".,;:!?'\"()-":
            table[byte] = 4
        elif byte > 32 and byte < 127:
            table[byte] = 5
    return table


_CLASS = _class_table()
_GROUPED = np.stack([_CLASS == k for k in range(len(CLASSES))]).astype(np.float64)


def class_counts(text: bytes) -> np.ndarray:
    return _GROUPED @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)


def common_form(word: bytes) -> bytes:
    """A-Z in lower case, without punctuation at the ends."""
    return word.lower().strip(b".,;:!?'\"()-")


def js_distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2, of two histograms given by counts or shares."""
    p, q = counts / counts.sum(), reference / reference.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum()
        right = np.where(q > 0, q * np.log2(q / m), 0).sum()
    return math.sqrt(max(0.0, (left + right) / 2))


# --- references ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Reference:
    classes: np.ndarray
    words: Mapping[bytes, int]  # common word -> bin
    shares: np.ndarray  # of the common words, then of all others
    bare: float  # distance of a text without common words

    @classmethod
    def of(cls, classes: np.ndarray, counts: Mapping[bytes, int], total: int) -> Reference:
        ordered = sorted(counts)
        shares = [counts[w] / total for w in ordered]
        shares = np.array([*shares, max(0.0, 1 - sum(shares))])
        none = np.zeros(len(shares))
        none[-1] = 1
        return cls(classes, {w: i for i, w in enumerate(ordered)}, shares, js_distance(none, shares))

    def expects(self, n_words: int) -> bool:
        """Enough common words are due in a text of this length."""
        return n_words * (1 - self.shares[-1]) >= EXPECTED

    def lacks(self, distance: float, found: Mapping[bytes, int], n_words: int) -> bool:
        """Too far, and not only because a short text has the common words in other shares."""
        common = sum(found[w] for w in found.keys() & self.words.keys())
        return distance > LACKING * self.bare and common < FEW * n_words * (1 - self.shares[-1])

    def word_distance(self, found: Mapping[bytes, int], n_words: int) -> float:
        counts = np.zeros(len(self.shares))
        for word, n in found.items():
            at = self.words.get(word)
            if at is not None:
                counts[at] = n
        counts[-1] = n_words - counts.sum()
        return js_distance(counts, self.shares)


def fit_references(docs: DataFrame, common_share: float = COMMON_SHARE) -> dict[str, Reference]:
    """References per language, and of the whole corpus under ``*``, from all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                lang = "" if lang is None else lang
                if lang not in words:
                    words[lang], classes[lang] = Counter(), np.zeros(len(CLASSES))
                before = len(words[lang])
                words[lang].update(text.split())
                classes[lang] += class_counts(text)
                held += len(words[lang]) - before
            if held > PARTIAL_WORDS:
                yield from _counted(words, classes)
                words, classes, held = {}, {}, 0
        yield from _counted(words, classes)

    # counters per task first, so a frequent word is one row per task, not one per use
    rows = docs.select("lang", "text").mapInArrow(count, "lang string, kind int, word binary, n long")
    totals = rows.groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    totals = materialize(totals, "word_counts")
    words = totals.where("kind = 0")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("total"))
    everything = sizes.agg(F.sum("total")).first()[0] or 0
    # rows without a language are no language, however many
    kept = materialize(sizes.where((F.col("lang") != "") & (F.col("total") >= LANGUAGE_SHARE * everything)), "languages")
    found = words.join(F.broadcast(kept), "lang").where(F.col("n") >= common_share * F.col("total"))
    pooled = words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= common_share * everything)
    per_class = totals.where("kind = 1").join(F.broadcast(kept), "lang").select("lang", "word", "n")
    all_classes = totals.where("kind = 1").groupBy("word").agg(F.sum("n").alias("n"))
    # at most 1 / LANGUAGE_SHARE languages of 1 / common_share words
    size_of = {r["lang"]: r["total"] for r in kept.collect()} | {ALL: everything}
    counts: dict[str, dict[bytes, int]] = {lang: {} for lang in size_of}
    for r in found.collect():
        counts[r["lang"]][bytes(r["word"])] = r["n"]
    counts[ALL] = {bytes(r["word"]): r["n"] for r in pooled.collect()}
    classes = {lang: np.zeros(len(CLASSES)) for lang in size_of}
    for r in per_class.collect():
        classes[r["lang"]][int(bytes(r["word"]))] = r["n"]
    for r in all_classes.collect():
        classes[ALL][int(bytes(r["word"]))] = r["n"]
    return {lang: Reference.of(classes[lang], counts[lang], max(1, size_of[lang])) for lang in size_of}


def _counted(words: dict[str, Counter], classes: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    rows = []
    for lang, counter in words.items():
        common: Counter = Counter()
        for word, n in counter.items():
            common[common_form(word)] += n
        rows += [(lang, 0, w, n) for w, n in common.items()]
        rows += [(lang, 1, b"%d" % k, int(n)) for k, n in enumerate(classes[lang]) if n]
    if rows:
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "kind", "word", "n"])


# --- one document -----------------------------------------------------------------------------


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
    if len(number) == n:
        return 0
    # pairs get dense numbers first, so triples stay within 64 bits for any text
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, place, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[place] > 1
    marked = np.zeros(n, bool)
    for i in range(3):
        marked[i : n - 2 + i] |= twice
    return int(marked.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


@dataclass(frozen=True)
class Limits:
    max_class_distance: float = MAX_CLASS_DISTANCE
    max_word_distance: float = MAX_WORD_DISTANCE
    min_chars: int = MIN_CHARS
    min_words: int = MIN_WORDS


def lacks_words(by_word: float, found: Mapping[bytes, int], n_words: int, own: Reference | None, others: Sequence[Reference]) -> bool:
    """The text has too few of its language's common words, or another language's rather.

    Without an own reference: too few of every language's."""
    if own is not None:
        if not own.expects(n_words):
            return False
        mine = by_word / own.bare
        rivals = (r for r in others if r is not own and r.expects(n_words) and not found.keys().isdisjoint(r.words))
        return own.lacks(by_word, found, n_words) or any(r.word_distance(found, n_words) / r.bare < mine - NEARER for r in rivals)
    return bool(others) and all(r.expects(n_words) and r.lacks(r.word_distance(found, n_words), found, n_words) for r in others)


def judge(text: bytes, lang: str | None, references: Mapping[str, Reference], limits: Limits) -> tuple:
    """Counts, base verdict, both distances (None below their minimum) and the final verdict."""
    own = references.get(lang) if lang else None
    reference = own or references[ALL]
    words = text.split()
    repeated = repeated_words(words)
    word_chars = len(b"".join(words).decode())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    failed = len(words) < 50 or 100 * repeated > 50 * len(words)
    classes = class_counts(text)
    by_class = by_word = None
    lacking = False
    if classes.sum() >= max(1, limits.min_chars) and reference.classes.sum():
        by_class = js_distance(classes, reference.classes)
    if len(words) >= max(1, limits.min_words) and len(reference.words):
        found = Counter(map(common_form, words))
        by_word = reference.word_distance(found, len(words))
        if own or not lang:
            lacking = lacks_words(by_word, found, len(words), own, [r for g, r in references.items() if g != ALL])
    diverges = (by_class or 0) > limits.max_class_distance or (by_word or 0) > limits.max_word_distance or lacking
    return len(words), word_chars, symbols, duplicate_lines(text), repeated, failed, not failed and not diverges, by_class, by_word


OUT = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
    ("class_distance", pa.float64()), ("word_distance", pa.float64()),
]
OUT_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, class_distance double, word_distance double"
)


def judge_documents(docs: DataFrame, limits: Limits = Limits(), columns: tuple[str, ...] = ("doc_id",), kept_only: bool = False) -> DataFrame:
    """``columns`` of every document, its counts, distances and verdict; with ``kept_only`` of the kept ones."""
    references = fit_references(docs)
    # language and text travel once, also where they are among ``columns``
    sent = [*columns, *(c for c in ("lang", "text") if c not in columns)]
    lang_at, text_at = sent.index("lang"), sent.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, texts = batch.column(lang_at).to_pylist(), texts_of(batch.column(text_at))
        rows = [judge(t, g, references, limits) for g, t in zip(langs, texts, strict=True)]
        made = [pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), OUT, strict=True)]
        out = pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *made], [*columns, *[n for n, _ in OUT]])
        return out.filter(out.column("kept")) if kept_only else out

    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], OUT_SCHEMA])
    return arrow(docs.select(*sent), run, schema, rows=SLICE if "text" in columns else None)
