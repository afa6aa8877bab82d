"""Exact top-k inner products with an impact-ordered index, processed score at a time.

Components are whole numbers, floor(scale * x). A block of candidates is indexed by posting segments: for each
dimension the candidates whose component has a certain quantised impact, the highest bit of its size. Segments
are processed by descending impact, for a block of queries at once: accumulating a segment level is one matrix
product with the postings of that level. After each level a candidate's score is known up to what its unprocessed
postings can add: by Cauchy-Schwarz at most |query| times the length of its remaining components. A query's search
stops when, by these bounds, no other candidate can reach the k-th best lower bound: that is the proof. The
candidates that may still be members are rescored exactly with whole numbers and ranked, ties to the smaller id.

Queries meet candidates in a grid of blocks, so neither side has to fit one task, and each task returns k rows per
query; only those are merged. Scores that could exceed 53 bits are computed with 64-bit integers instead of doubles.

Cases: vectors that are null or hold null or non-finite components take no part; a shorter vector counts as filled
up with zeros; of several rows with one id the one with the smallest vector counts; null ids take no part; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

RESULT = "query_id bigint, vec_id bigint, score bigint"


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, v): one row per id with whole components."""
    e = F.col(f"`{embedding}`")
    usable = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(usable & F.col(f"`{vec_id}`").isNotNull()).select(
        F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def levels(x: np.ndarray) -> list[np.ndarray]:
    """The postings by quantised impact, highest first; the last level holds all small components."""
    size = np.abs(x)
    bits = np.frexp(size.astype(np.float64))[1]
    top = int(bits.max(initial=0))
    cuts = [top - 1, top - 2]  # a level for each of the two highest bits, one for the rest
    masks = [bits > cuts[0], (bits <= cuts[0]) & (bits > cuts[1]), bits <= cuts[1]]
    return [np.where(m, x, 0) for m in masks if m.any()]


def search_block(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterable[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, candidate ids, scores): exact best ``k`` of the block for each query. ``ids`` ascend."""
    biggest = float(np.abs(queries).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    exact = np.float64 if biggest < 2.0**52 else np.int64
    index = levels(x)
    left = x.astype(np.float64)
    remaining = []  # the length of what a level leaves unprocessed
    for level in index:
        left = left - level
        remaining.append(np.sqrt((left * left).sum(1)))
    planes = [level.T.astype(np.float64) for level in index]
    norms = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    exact_x = x.astype(exact)
    for start in range(0, len(queries), 128):
        q = queries[start:start + 128]
        qf, own = q.astype(np.float64), query_ids[start:start + 128, None] == ids[None, :]
        known = np.zeros((len(q), len(ids)))
        open_ = np.arange(len(q))
        members: dict[int, np.ndarray] = {}
        for plane, rest in zip(planes, remaining, strict=True):
            known[open_] += qf[open_] @ plane
            still = []
            for i in open_:
                # a little more than the bound, for rounding in the doubles
                room = norms[i] * rest * (1 + 1e-9) + 1e-6 * (1 + np.abs(known[i]))
                low = known[i] - room
                low[own[i]] = -np.inf
                n = min(k, len(ids) - int(own[i].sum()))
                if n <= 0:
                    members[i] = np.zeros(0, np.int64)
                    continue
                bar = np.partition(low, len(low) - n)[len(low) - n]
                may = np.flatnonzero((known[i] + room >= bar) & ~own[i])
                if len(may) <= 8 * k or plane is planes[-1]:
                    members[i] = may
                else:
                    still.append(i)
            open_ = np.array(still, np.int64)
            if not len(open_):
                break
        for i, may in members.items():
            scores = (exact_x[may] @ q[i].astype(exact)).astype(np.int64)
            best = np.lexsort((ids[may], -scores))[:k]
            yield int(query_ids[start + i]), ids[may][best], scores[best]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    if all(len(v) == width for v in vectors):
        return np.stack([np.asarray(v, np.int64) for v in vectors])
    out = np.zeros((len(vectors), width), np.int64)
    for r, v in enumerate(vectors):
        out[r, :len(v)] = v
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, block: int = 8192, query_block: int = 2048, **names) -> DataFrame:
    """(query_id, rank, vec_id, score). ``is_query`` is a predicate on ``id``; blocks are rows a task holds, on average."""
    every = materialize(whole_vectors(vectors, **names))
    n, n_queries = every.count(), every.where(is_query).count()
    across, down = max(1, -(-n // block)), max(1, -(-n_queries // query_block))
    place = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    # each side is copied to the blocks of the other one
    candidates = every.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("qb"), place(across).alias("cb"))
    queries = every.where(is_query).select("id", "v", place(down).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("cb"))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        right = right.sort_values("id")
        width = max(left["v"].map(len).max(), right["v"].map(len).max())
        found = list(search_block(_matrix(left["v"], width), left["id"].to_numpy(), _matrix(right["v"], width), right["id"].to_numpy(), k))
        return pd.DataFrame({
            "query_id": np.repeat([q for q, _, _ in found], [len(c) for _, c, _ in found]).astype(np.int64),
            "vec_id": np.concatenate([c for _, c, _ in found]), "score": np.concatenate([s for _, _, s in found])})

    parts = max(across * down, 1)
    best = (queries.repartition(parts, "qb", "cb").groupBy("qb", "cb")
            .cogroup(candidates.repartition(parts, "qb", "cb").groupBy("qb", "cb")).applyInPandas(run, RESULT))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
