"""Language identification by multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, and every run of characters that are no letters becomes one space. Its runs of one to ``longest``
characters are hashed to ``buckets``. Training counts buckets per language over all training rows: each task sums its own
counts and emits the buckets that it met, and the sums are one row per language and bucket. The model is a matrix of
smoothed log-probabilities, as whole numbers of 1/``UNIT``, so that a text's score does not depend on the order in which it is
added up. It is broadcast: its size is bounded by ``MATRIX`` entries whatever the number of languages, since the
buckets are folded (halved) until it fits. Scoring takes a batch of texts as sparse rows of buckets, gathers the matrix' rows
for the buckets and sums them per text, in numpy, a bounded number of characters at a time.

Cases: null texts and texts without a letter are ``und`` with score 0; with nothing learned every text is ``und``; equal
scores go to the alphabetically first language; rows with a null language teach nothing; rows that repeat count as often as
they occur; very long texts are scored whole, in pieces; null ids are not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_step, materialize

BUCKETS = 1 << 16
#: Entries of the matrix at most; 8 bytes each.
MATRIX = 1 << 22
UNIT = 1 << 16
#: Characters turned into numbers at once.
PIECE = 500_000
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """``weights``: (buckets, languages) log-probabilities, ``prior``: (languages), both in units of 1/UNIT."""

    langs: tuple[str, ...]
    weights: np.ndarray
    prior: np.ndarray
    longest: int


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), np.bool_, 0x110000)


def pieces(texts: list[str | None], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(characters, text index of each, characters already seen) of lower-cased texts, about ``PIECE`` at a time.

    Only letters and single spaces are left, and a text begins and ends with a space. A longer text comes in several pieces,
    each of which repeats the last ``longest`` - 1 characters of the one before.
    """
    batch, index, size = [], [], 0
    for k, text in enumerate(texts):
        low = f" {text.lower()} " if text else " "
        if batch and size + len(low) > PIECE:
            yield *_characters(batch, index), 0
            batch, index, size = [], [], 0
        if len(low) > PIECE:
            seen, letter_before = np.zeros(0, np.uint32), True
            for start in range(0, len(low), PIECE):
                code, _ = _characters([low[start:start + PIECE]], [k], letter_before)
                letter_before = low[min(start + PIECE, len(low)) - 1].isalpha()
                code = np.concatenate([seen, code])
                yield code, np.full(len(code), k, np.int64), len(seen)
                seen = code[len(code) - min(len(code), longest - 1):]
        else:
            batch.append(low)
            index.append(k)
            size += len(low)
    if batch:
        yield *_characters(batch, index), 0


def _characters(batch: list[str], index: list[int], letter_before: bool = True) -> tuple[np.ndarray, np.ndarray]:
    code = np.frombuffer("".join(batch).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.array(index, np.int64), [len(b) for b in batch])
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])  # of a run of other characters the first one stays, as a space
    keep[0] |= letter_before
    return np.where(letter, code, 32)[keep].astype(np.uint32), owner[keep]


def grams(code: np.ndarray, owner: np.ndarray, seen: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, owners) of all runs of one to ``longest`` characters inside a text that end after the ``seen`` ones."""
    h = code * np.uint32(0x9E3779B1)
    for n in range(1, longest + 1):
        if n > 1:
            if len(code) < n:
                return
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + code[n - 1:] * np.uint32(0x9E3779B1)
        mixed = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        bucket = (mixed ^ (mixed >> np.uint32(16))) & np.uint32(BUCKETS - 1)
        own = owner[:len(h)] == owner[n - 1:]
        own[:max(0, seen - n + 1)] = False
        if n == 1:
            own &= code != 32
        yield bucket[own].astype(np.int64), owner[:len(h)][own]


def counts(docs: DataFrame, longest: int, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n) over all rows with a language; bucket -1 counts rows."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == name]
                total = sums.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                total[-1] += len(own)
                for piece in pieces(own, longest):
                    for bucket, _ in grams(*piece, longest):
                        total[:-1] += np.bincount(bucket, minlength=BUCKETS)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(np.where(at == BUCKETS, -1, at)), pa.array(total[at])], ["lang", "bucket", "n"])

    rows = docs.where(F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, longest: int = 4, smooth: float = 0.5, text: str = "text", lang: str = "lang") -> Model:
    """The model of all rows of ``docs`` whose language is known. The languages and ``MATRIX`` sums at most go to the driver."""
    sums = materialize(counts(docs, longest, text, lang))
    rows = {r["lang"]: r["n"] for r in sums.where("bucket < 0").collect()}
    langs = sorted(rows)
    width = BUCKETS
    while width * len(langs) > MATRIX and width > 1:
        width //= 2
    folded = sums.where("bucket >= 0").groupBy("lang", (F.col("bucket") % width).alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    drop_step(sums)
    table = np.zeros((width, len(langs)))
    place = {name: k for k, name in enumerate(langs)}
    table[folded["bucket"].to_numpy(), [place[x] for x in folded["lang"].to_pylist()]] = folded["n"].to_numpy()
    weights = np.log(table + smooth) - np.log((table + smooth).sum(0, keepdims=True))
    prior = np.log(np.array([rows[x] for x in langs], float)) - np.log(max(1, sum(rows.values())))
    return Model(tuple(langs), np.rint(weights * UNIT).astype(np.int64), np.rint(prior * UNIT).astype(np.int64), longest)


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """(languages, probability of each) of whole texts."""
    n, width = len(texts), len(model.langs)
    scores, lettered = np.zeros((n, width), np.int64), np.zeros(n, bool)
    fold, step = len(model.weights) - 1, max(1, (1 << 21) // max(1, width))
    for code, owner, seen in pieces(texts, model.longest):
        lettered[owner[code != 32]] = True
        if not width:
            continue
        for bucket, own in grams(code, owner, seen, model.longest):
            for k in range(0, len(bucket), step):
                part = own[k:k + step]
                at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                scores[part[at]] += np.add.reduceat(model.weights[bucket[k:k + step] & fold], at, axis=0)
    if not width:
        return [UNKNOWN] * n, np.zeros(n)
    scores += model.prior
    best = scores.argmax(1)
    gap = (scores - scores.max(1, keepdims=True)) / UNIT
    sure = 1 / np.exp(gap).sum(1)
    return [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, sure, 0.0)


def identify(docs: DataFrame, model: Model, keep: list[Column], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs``, with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(f"`{text}`").cast("string").alias("_text"))
    fields = rows.schema.fields[:-1]
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "lang_pred string, score double"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            langs, sure = predict(batch.column(batch.num_columns - 1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(sure)], [*[f.name for f in fields], "lang_pred", "score"])

    return rows.mapInArrow(run, ddl)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text mod 5 is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
