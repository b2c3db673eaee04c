"""Token ids of a byte-level BPE file.

Where the file's merges stand in rank order, tiktoken encodes a text as a whole over the same ranks. Texts with letters from U+0590 on
(whose classes the two libraries may know from different Unicode versions), with special tokens or beyond ``WHOLE`` characters (tiktoken's pattern
gives up on about a million white-space characters in a row) take a dictionary in front of the tokenizer, as do all texts of other files.

The pattern of byte-level BPE never crosses from a visible character to a space, so such a text may be cut before any
space that follows a visible character and precedes another. Pieces repeat; each is
encoded once per worker and its ids kept as bytes.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import regex
import tiktoken
from tokenizers import Tokenizer

KEPT_PIECES = 400_000
WHOLE = 100_000
BEYOND = re.compile("[\u0590-\U0010ffff]").search
# Fixed value: the split pattern of this kind of tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it: printable bytes themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def splits_by_pattern(form: dict) -> bool:
    """The tokenizer file cuts texts by ``PATTERN`` and changes nothing before."""
    cut = form["pre_tokenizer"] or {}
    return form["normalizer"] is None and cut == {
        "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": cut.get("trim_offsets"), "use_regex": True}


def by_ranks(model: dict, letters: dict[str, int]) -> tiktoken.Encoding | None:
    """The same byte-level BPE run over ranks, if its merges stand in the order of the ids they make and every byte has one."""
    vocabulary, merges = model["vocab"], model["merges"]
    made = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1), -1) for m in merges]
    known = set(made)
    ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if all(c in letters for c in t) and (len(t) == 1 or i in known)}
    if made != sorted(made) or min(made, default=0) < 256 or any(bytes([b]) not in ranks for b in range(256)):
        return None
    return tiktoken.Encoding("by ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.letters, self.split = _byte_letters(), regex.compile(PATTERN).findall
        self.words: dict[str, bytes] = {}
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def __missing__(self, piece: str) -> bytes:
        if any(s in piece for s in self.special):
            out = self.whole(piece)
        else:
            out = b"".join([self.words.get(w) or self._word(w) for w in self.split(piece)])
        if len(self) >= KEPT_PIECES:
            self.clear()
        self[piece] = out
        return out

    def _word(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.letters)
        out = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])
        if len(self.words) >= KEPT_PIECES:
            self.words.clear()
        self.words[word] = out
        return out


class ByteBpe:
    """Encodes texts to the same ids as ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        letters = {letter: byte for byte, letter in _byte_letters().items()}
        self.ranks = by_ranks(form["model"], letters) if splits_by_pattern(form) else None
        self.pieces = _Pieces(Tokenizer.from_file(path))
        self.odd = regex.compile(r"  |\s \s| \s|^ | $").search

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.ranks is not None and len(text) <= WHOLE and (text.isascii() or not BEYOND(text)) and not any(s in text for s in self.pieces.special):
            ids = array("I", self.ranks.encode_ordinary(text))
            if sys.byteorder == "big":
                ids.byteswap()
            return ids.tobytes()
        return self.by_pieces(text)

    def by_pieces(self, text: str) -> bytes:
        """The same ids by the dictionary of pieces."""
        if self.odd(text):
            return self._odd(text)
        first, *rest = text.split(" ")
        get = self.pieces.__getitem__
        return get(first) + b"".join([get(" " + w) for w in rest]) if text else b""

    def _odd(self, text: str) -> bytes:
        """Runs of white space: cut only at a space between two visible characters."""
        get = self.pieces.__getitem__
        return b"".join([get(p) for p in regex.split(r"(?<=\S)(?= \S)", text) if p])


_CACHED: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One encoder per worker process and file."""
    if path not in _CACHED:
        _CACHED[path] = ByteBpe(path)
    return _CACHED[path]
