"""Encodes whole texts with a byte-level BPE of the tokenizers library, each distinct word once per worker.

The library's pre-tokenizer never joins characters over a single space that a non-space follows, so the ids
of a text are the ids of its pieces cut before such spaces, one after the other. Pieces repeat; their ids are
kept. A new piece that is a word with a mark after it, or a line break and a second word, is taken apart where the
pre-tokenizer would; the new words and all other new pieces of a batch are encoded as one string and cut apart by the
tokens' byte lengths. A text that holds the string of a special token is encoded whole,
since the library cuts such tokens out first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

_RUN = re.compile(r" \s")
_CUT = re.compile(r" (?=\S)")
#: Letters in every version of Unicode; a word, a mark, and perhaps a line break with another word and mark.
_LETTERS = "[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+"
_WORD = re.compile(_LETTERS)
_LINES = re.compile(f"({_LETTERS})([.,;:!?]?)\n({_LETTERS})([.,;:!?]?)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """``keep``: entries kept at most; pieces beyond it are encoded anew in each batch, with equal results."""

    def __init__(self, path: str, keep: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.bytes_of[k] = len(token)  # in a byte-level vocabulary a character stands for a byte
        self.dtype = np.dtype("<u2" if len(self.bytes_of) <= 1 << 16 else "<u4")
        self.keep = keep
        self.known: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = {m: self._plain(m) for m in ".,;:!?\n"} | {"": b""}

    def _first(self, piece: str) -> bytes:
        """The ids of the piece that no space precedes."""
        ids = self.first.get(piece)
        if ids is None:
            ids = self._plain(piece)
            if len(piece) < 32 and len(self.first) < self.keep // 10:
                self.first[piece] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _words(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """The ids of each piece with a space before it."""
        new, made, known, marks = set(), [], self.known, self.marks
        for p in pieces:
            if p.isalpha():
                new.add(p)
            elif (p[-1:] in marks and (word := p[:-1]) and _WORD.fullmatch(word)):
                made.append((p, word, marks[p[-1]]))
            elif shape := _LINES.fullmatch(p):
                word, mark, second, last = shape.groups()
                made.append((p, word, marks[mark] + marks["\n"] + self._first(second) + marks[last]))
            else:
                new.add(p)
        new.update([word for _, word, _ in made if word not in known])
        out = self._encoded(list(new))
        for p, word, rest in made:
            out[p] = (known.get(word) or out[word]) + rest
        return out

    def _encoded(self, pieces: list[str]) -> dict[str, bytes]:
        joined = "".join([f" {p}" for p in pieces])
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
        sizes = map(len, pieces) if joined.isascii() else (len(p.encode()) for p in pieces)
        ends = np.cumsum(np.fromiter(sizes, np.int64, len(pieces)) + 1)
        at = (np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1) * self.dtype.itemsize
        raw, stops = ids.tobytes(), at.tolist()
        return dict(zip(pieces, [raw[a:b] for a, b in zip([0, *stops], stops)], strict=False))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers of ``dtype``."""
        known, cut, new = self.known, [], set()
        for text in texts:
            if any(a in text for a in self.added):
                cut.append((None, self._plain(text)))
                continue
            pieces = text.split(" ") if not _RUN.search(text) else _CUT.split(text)
            found = list(map(known.get, pieces[1:]))
            if None in found:
                new.update([p for p, ids in zip(pieces[1:], found, strict=True) if ids is None])
                found = None
            cut.append((pieces, found))
        extra = self._words(new) if new else {}
        if len(known) < self.keep:
            known.update(extra)
            extra = {}
        lookup = known.__getitem__ if not extra else (lambda p: known.get(p) or extra[p])
        return [found if pieces is None else self._first(pieces[0]) + b"".join(found if found is not None else map(lookup, pieces[1:])) for pieces, found in cut]

    def ids(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.dtype)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder; its kept pieces outlive a task."""
    return Encoder(path)


def crc32(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def slices(texts: list[str | None], characters: int = 2_000_000) -> Iterable[tuple[int, list[str]]]:
    """(first index, texts) with bounded text length; null counts as empty."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= characters or k == len(texts) - 1:
            yield start, [t or "" for t in texts[start:k + 1]]
            start, size = k + 1, 0
