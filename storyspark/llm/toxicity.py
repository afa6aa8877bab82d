"""Toxicity by compression distance: zstandard dictionaries of ordinary and of toxic text.

Training rows are bounded (``bound`` labels, see ``labelled.training_rows``), and near copies among them count once. The
ordinary dictionary is trained on windows of ordinary texts. The toxic one is trained on windows of toxic texts; of its
words those stay that toxic training texts have far more often than ordinary ones, and they are put before the ordinary
dictionary, so that a window without them is compressed alike by both. The bytes that the toxic dictionary saves on a
window are its distance. A document is all its windows, which overlap by half: the largest saving, the mean, the shares of
windows above small savings. Boosted lookup tables over these, fitted on the training rows, are the calibrated thresholds.

The driver gets at most ``windows`` training windows per class, counts of dictionary words, and a few numbers per training
row; texts stay distributed. Scoring is a narrow pass over whole texts.

Cases: a null or empty text has no windows, savings of 0, and is scored like any other; without labels of both kinds
the score is the share of label 1 among the training rows, or one half without any; repeated rows are scored alike; an
empty table gives no rows.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality_gam as gam
from .common import materialize
from .labelled import training_rows

WINDOW, STRIDE = 10, 5
_EDGE = string.punctuation.encode()


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def windows(text: str | None) -> list[bytes]:
    w = _words(text)
    return [b" " + b" ".join(w[i:i + WINDOW]) for i in range(0, max(1, len(w) - STRIDE), STRIDE)] if w else []


@dataclass
class Toxicity:
    ordinary: bytes = b""
    toxic: bytes = b""
    calibration: gam.Model = field(default_factory=gam.Model)


@lru_cache(maxsize=8)
def _compressor(content: bytes):
    import zstandard as z

    settings = z.ZstdCompressionParameters(
        format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, strategy=z.STRATEGY_LAZY2, min_match=5,
        search_log=4, target_length=32, hash_log=14, chain_log=15, window_log=17)
    given = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
    return z.ZstdCompressor(dict_data=given, compression_params=settings)


def savings(model: Toxicity, text: str | None) -> tuple[float, ...]:
    """What the toxic dictionary saves on the windows of a text: largest, mean, shares above 1, 2 and 3 bytes, count."""
    plain, other = _compressor(model.ordinary).compress, _compressor(model.toxic).compress
    saved = np.array([len(plain(w)) - len(other(w)) for w in windows(text)], np.float64)
    if not len(saved):
        return (0.0,) * 6
    return (saved.max(), saved.mean(), (saved > 1).mean(), (saved > 2).mean(), (saved > 3).mean(), np.log1p(len(saved)))


def _trained(samples: list[bytes], size: int) -> bytes:
    import zstandard as z

    if len(samples) < 100:  # the trainer refuses very few samples; then they are the dictionary
        return b"".join(samples)[-size:]
    try:
        return z.train_dictionary(size, samples).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-size:]


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds two minima over runs of three words; near copies share one of them."""
    for b in batches:
        first, second = [], []
        for text in b["text"]:
            w = _words(text)
            h = np.fromiter((zlib.crc32(b" ".join(w[i:i + 3])) for i in range(max(1, len(w) - 2))), np.uint64)
            first.append(int(h.min()))
            second.append(int((h * np.uint64(2654435761) % np.uint64(1 << 32)).min()))
        yield b.assign(first=first, second=second)


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        own = [(y, w) for y, text in zip(b["y"], b["text"], strict=True) for w in windows(text)[::2]]
        yield pd.DataFrame({"y": [y for y, _ in own], "w": [w for _, w in own]})


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = 20_000, n_windows: int = 60_000,
          ordinary_size: int = 16_384, toxic_size: int = 65_536, **names) -> Toxicity:
    rows = training_rows(docs, labels, label, bound, **names).withColumn("_id", F.col("_id").cast("string"))
    rows = materialize(rows.mapInPandas(_signed, "_id string, text string, y double, first long, second long"))
    once = rows
    for c in ("first", "second"):
        once = once.groupBy(c).agg(F.min(F.struct("_id", "text", "y", *[x for x in ("first", "second") if x != c])).alias("r")).select("r.*", c)
    once = materialize(once.select("_id", "text", "y"))
    sample = once.mapInPandas(_sampled, "y double, w binary")

    def some(y: float) -> list[bytes]:
        own = sample.where(F.col("y") == y).orderBy(F.xxhash64("w"), "w").limit(n_windows)
        return [bytes(r["w"]) for r in own.select("w").collect()]

    ordinary, toxic = _trained(some(0.0), ordinary_size), _trained(some(1.0), toxic_size)
    candidates = frozenset(w.strip(_EDGE) for w in re.findall(rb"[^\x00-\x20]+", toxic)) - {b""}

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [(w, y) for y, text in zip(b["y"], b["text"], strict=True) for w in candidates & {x.strip(_EDGE) for x in _words(text)}]
            yield pd.DataFrame({"w": [w for w, _ in own], "y": [y for _, y in own]})

    size = {r["y"]: r["n"] for r in once.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1.0, 0), size.get(0.0, 0)
    kept = []
    if n1 and n0:
        found = once.mapInPandas(counted, "w binary, y double").groupBy("w").agg(
            F.sum("y").alias("in1"), F.sum(1 - F.col("y")).alias("in0")).collect()
        kept = sorted((r["in1"], bytes(r["w"])) for r in found
                      if r["in1"] >= max(2, 0.01 * n1) and r["in1"] * n0 > 10 * (r["in0"] + 1) * n1 or r["in0"] == 0 and r["in1"] >= max(2, 0.01 * n1))
    # words of many toxic texts come last, nearest to the ordinary dictionary
    model = Toxicity(ordinary, b" " + b" ".join(w for _, w in kept) + b" " + ordinary)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["_id"], "y": b["y"], "x": [list(map(float, savings(model, t))) for t in b["text"]]})

    got = rows.mapInPandas(measured, "id string, y double, x array<double>").limit(2 * bound).toPandas().sort_values(["id", "y"])
    if len(got):
        model.calibration = gam.fit(np.array(got["x"].tolist()), got["y"].to_numpy(), rounds=60, n_pairs=6)
    return model


def score(model: Toxicity, text: Column) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.calibration.score(np.array([savings(model, t) for t in texts], np.float64).reshape(len(texts), 6)))

    return run(text)
