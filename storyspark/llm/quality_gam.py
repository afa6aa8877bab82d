"""Quality classifier: a generalised additive model with pairwise interactions.

Every document becomes a dozen measures of its whole text. Each measure is cut into bins at quantiles of the training
rows. Shallow trees of up to three leaves are boosted on one measure after the other, round by round, and summed
into a table per measure; then trees with one cut on each of two measures are boosted for the pairs that explain most of
what is left. A score is the sum of table entries, looked up for a whole batch at once, through the logistic function.

Training takes at most ``bound`` labelled rows (see ``labelled.training_rows``): the driver gets their measures, a few
numbers each, never texts. Scoring is a narrow pass over all documents.

Cases: a null or empty text has measures of 0 and gets a score like any other; without labels of both kinds the score is
the share of label 1, or one half without any; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import training_rows

FEATURES = ("words", "word_length", "distinct", "distinct_pairs", "same_as_last", "upper", "shout", "symbol", "bar", "digit",
            "stop", "comma", "lines", "repeated_lines", "short_words")


def features(text: str | None) -> tuple[float, ...]:
    """Measures of a whole text, in the order of ``FEATURES``."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    chars = sum(map(len, words))
    count = lambda chars_: len(raw) - len(raw.translate(None, chars_))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    follow = words[1:]
    return (
        np.log1p(n), chars / n, len(set(words)) / n, len(set(zip(words, follow, strict=False))) / max(1, n - 1),
        sum(map(bytes.__eq__, words, follow)) / n, count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars, count(b"!") / n, count(b"#*$%&<>") / n,
        count(b"|") / n, count(b"0123456789") / chars, count(b".") / n, count(b",") / n, len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)), sum(len(w) < 4 for w in words) / n)


@dataclass
class Model:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: int = 4  # bins of a measure that fall into one bin of a pair

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if self.edges:
            b = self.bins(x)
            for j, t in enumerate(self.tables):
                out += t[b[:, j]]
            for i, j, t in self.pairs:
                out += t[b[:, i] // self.coarse, b[:, j] // self.coarse]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """A step function over bins with gradients ``g`` and weights ``h``: the best cuts, one after the other."""
    spans = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in spans:
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            left = cg[:-1] ** 2 / (ch[:-1] + 1) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1) - cg[-1] ** 2 / (ch[-1] + 1)
            k = int(np.argmax(left))
            if left[k] > best[0]:
                best = (left[k], (a, a + k + 1, b))
        if best[1] is None:
            break
        a, m, b = best[1]
        spans = [s for s in spans if s != (a, b)] + [(a, m), (m, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut on each of two measures at once: (gain, value per cell)."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best = (0.0, np.zeros_like(g))
    for a in range(g.shape[0] - 1):
        for b in range(g.shape[1] - 1):
            parts = []
            for s, c in ((cg, 0), (ch, 1)):
                q = s[a, b]
                parts.append((q, s[a, -1] - q, s[-1, b] - q, s[-1, -1] - s[a, -1] - s[-1, b] + q))
            gain = sum(x * x / (w + 1) for x, w in zip(*parts, strict=True))
            if gain > best[0]:
                v = [_leaf(x, w) for x, w in zip(*parts, strict=True)]
                cells = np.empty_like(g)
                cells[:a + 1, :b + 1], cells[:a + 1, b + 1:], cells[a + 1:, :b + 1], cells[a + 1:, b + 1:] = v
                best = (gain, cells)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, pair_rounds: int = 20, n_pairs: int = 8, n_bins: int = 32, rate: float = 0.15) -> Model:
    model = Model()
    if not len(y):
        return model
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model.base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return model
    cuts = np.linspace(0, 1, n_bins + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, j], cuts, method="lower")) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    b, f = model.bins(x), np.full(len(y), model.base)
    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-f))
            step = rate * _tree(np.bincount(b[:, j], y - p, len(table)), np.bincount(b[:, j], p * (1 - p), len(table)), 3)
            table += step
            f += step[b[:, j]]
    c = b // model.coarse
    sizes = c.max(0) + 1

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p, at, shape = 1 / (1 + np.exp(-f)), c[:, i] * sizes[j] + c[:, j], (sizes[i], sizes[j])
        return (np.bincount(at, y - p, sizes[i] * sizes[j]).reshape(shape), np.bincount(at, p * (1 - p), sizes[i] * sizes[j]).reshape(shape))

    ranked = sorted(((-_quadrants(*cells(i, j))[0], i, j) for i in range(x.shape[1]) for j in range(i)))[:n_pairs]
    full = [-(-(len(e) + 1) // model.coarse) for e in model.edges]
    model.pairs = [(i, j, np.zeros((full[i], full[j]))) for _, i, j in ranked]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            step = rate * _quadrants(*cells(i, j))[1]
            table[:step.shape[0], :step.shape[1]] += step
            f += step[c[:, i], c[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 20_000, **names) -> Model:
    rows = training_rows(docs, labels, label, bound, **names)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["_id"].astype(str), "y": batch["y"], "x": [list(map(float, features(t))) for t in batch["text"]]})

    got = rows.mapInPandas(measured, "id string, y double, x array<double>").limit(2 * bound).toPandas().sort_values(["id", "y"])
    if not len(got):
        return Model()
    return fit(np.array(got["x"].tolist()), got["y"].to_numpy())


def score(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))))

    return run(text)
