"""Hard negatives of anchors by an inverted multi-index over vectors, with certified windows.

Vectors hold whole components. Each half of a vector has a codebook of ``codes`` centres, trained by k-means on a bounded
sample; every row is indexed: its cell is the pair of its halves' nearest centres. A centre's radius is the greatest
distance of its rows' halves, over all rows. For an anchor, |half of the anchor| times the radius, added to its
product with the centre, bounds the half-scores of the centre's rows, and the sum over both halves the scores of a cell.

Cells are dealt, in their order, to blocks of ``block`` rows; a cell with more rows is split over several by a hash of the id,
so no task holds a whole hot cell. Inside a block a heap over the two ranked lists of half-score bounds visits the cells by
falling bound (multi-sequence). A visit scores the cell's rows; it stops when a window is certified: the wanted number of
rows has been found and no cell left can hold a row that comes before the last of them, or the bound has fallen below
the window.

Anchors are first sent to the block of their best cell. What they find there sets a threshold, and they go on only to blocks
whose best bound reaches it: first for the positives, then, when the windows are known, for the negatives.

Cases: rows with a null id, label or vector, or a null or non-finite component take no part; of rows with one id the one with
the smallest label, then vector, counts; shorter vectors count as filled up with zeros; equal scores go to the smaller id; an
anchor without a positive, or a positive without a negative in its window, gives no rows; an empty table gives none; other
columns are ignored. Products and sums must fit 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_step, materialize


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class MineConfig:
    codes: int = 32
    sample: int = 20_000
    rounds: int = 6
    block: int = 16_384
    anchor_block: int = 2_048
    positives: int = 5
    negatives: int = 3
    low_pct: int = 50
    high_pct: int = 95
    seed: int = 17


def whole_rows(rows: DataFrame, scale: int, vec_id: str, label: Column, embedding: str) -> DataFrame:
    """(id, label, v): one row per id with whole components."""
    e = F.col(f"`{embedding}`")
    usable = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col(f"`{vec_id}`").isNotNull()
    own = rows.where(usable).select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), label.cast("bigint").alias("label"),
                                    F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))
    return own.where(F.col("label").isNotNull()).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*")


def matrix(vectors: Iterable, width: int, dtype=np.int64) -> np.ndarray:
    vectors = list(vectors)
    out = np.zeros((len(vectors), width), dtype)
    for r, v in enumerate(vectors):
        out[r, :len(v)] = v
    return out


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = (x.shape[1] + 1) // 2
    return x[:, :at].astype(np.float64), x[:, at:].astype(np.float64)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, distance) of each row's nearest centre."""
    code = ((centres**2).sum(1)[None, :] - 2 * (x @ centres.T)).argmin(1)
    return code, np.sqrt(((x - centres[code]) ** 2).sum(1))


def codebook(x: np.ndarray, codes: int, rounds: int, seed: int) -> np.ndarray:
    """k-means centres of the distinct rows of ``x``."""
    x = np.unique(x, axis=0)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:codes]]
    for _ in range(rounds):
        code, _ = nearest(x, centres)
        for c in range(len(centres)):
            if (own := code == c).any():
                centres[c] = x[own].mean(0)
    return centres


class Index:
    """The codebooks, radii and block plan; ``codes``² cells and blocks of ``block`` rows at least, so small beside the rows."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], radii: tuple[np.ndarray, np.ndarray], cells: np.ndarray, width: int):
        self.books, self.radii, self.width = books, radii, width
        self.cells = cells  # (code1, code2, first block, parts), in order

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-score bounds by code, a little above what rounding in doubles could hide."""
        out = []
        for q, book, radius in zip(halves(anchors), self.books, self.radii, strict=True):
            size = np.sqrt((q**2).sum(1))[:, None]
            bound = q @ book.T + size * radius[None, :]
            out.append(bound + 1e-9 * size * (radius + np.sqrt((book**2).sum(1)))[None, :] + 1e-6)
        return out[0], out[1]

    def block_bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bound per anchor and block, block of the best cell)."""
        b1, b2 = self.bounds(anchors)
        by_cell = b1[:, self.cells[:, 0]] + b2[:, self.cells[:, 1]]
        spread = np.repeat(np.arange(len(self.cells)), self.cells[:, 3])
        block = np.concatenate([f + np.arange(p) for f, p in self.cells[:, 2:]])
        order = np.argsort(block, kind="stable")
        starts = np.flatnonzero(np.diff(block[order], prepend=-1))
        best = by_cell.argmax(1)
        return np.maximum.reduceat(by_cell[:, spread[order]], starts, axis=1), self.cells[best, 2]


def plan(counts: list[tuple[int, int, int]], block: int) -> np.ndarray:
    """Deals cells (code1, code2, rows), in their order, to blocks of about ``block`` rows."""
    out, current, held = [], 0, 0
    for c1, c2, n in sorted(counts):
        if held and held + n > block:
            current, held = current + 1, 0
        parts = max(1, -(-n // block))
        out.append((c1, c2, current, parts))
        if parts > 1:
            current, held = current + parts, 0
        else:
            held += n
    return np.array(out, np.int64).reshape(-1, 4)


def build(rows: DataFrame, config: MineConfig) -> tuple[DataFrame, Index]:
    """The rows with the block and cell of each, and the index. ``sample`` rows, codes² counts and radii go to the driver."""
    chosen = rows.orderBy(F.xxhash64("id", F.lit(config.seed)), "id").limit(config.sample).select("v").toPandas()["v"]
    width = max(2, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    books = tuple(codebook(h, config.codes, config.rounds, config.seed) for h in halves(matrix(chosen, width)))

    def assign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [nearest(h, book) for h, book in zip(halves(matrix(b["v"], width)), books, strict=True)]
            yield b.assign(c1=found[0][0], c2=found[1][0], r1=found[0][1], r2=found[1][1])

    coded = materialize(rows.mapInPandas(assign, "id long, label long, v array<long>, c1 int, c2 int, r1 double, r2 double"))
    cells = coded.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).collect()
    radii = tuple(np.zeros(len(book)) for book in books)
    for c in cells:
        radii[0][c["c1"]], radii[1][c["c2"]] = max(radii[0][c["c1"]], c["r1"]), max(radii[1][c["c2"]], c["r2"])
    index = Index(books, radii, plan([(c["c1"], c["c2"], c["n"]) for c in cells], config.block), width)
    dealt = rows.sparkSession.createDataFrame([tuple(map(int, c)) for c in index.cells], "d1 int, d2 int, first int, parts int")
    # a row per non-empty cell, codes² at most
    placed = coded.join(F.broadcast(dealt), (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2"))).select(
        "id", "label", "v", "c1", "c2", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("block"))
    return placed, index


@dataclass
class Span:
    """Rows wanted with a score in [low, high]: the ``k`` best."""

    low: float
    high: float
    k: int


class Block:
    """Rows of a block by cell."""

    def __init__(self, rows: pd.DataFrame, index: Index):
        rows = rows.sort_values(["c1", "c2", "id"])
        self.ids, self.labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        x = matrix(rows["v"], index.width)
        self.exact, self.x = x, x.astype(np.float64)
        self.small = float(np.abs(self.x).max(initial=0)) * max(1, index.width)
        code = rows["c1"].to_numpy(np.int64) * (1 << 32) + rows["c2"].to_numpy(np.int64)
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        stops = [*starts[1:].tolist(), len(code)]
        self.cells = {(int(code[a] >> 32), int(code[a] & 0xFFFFFFFF)): (int(a), b) for a, b in zip(starts, stops, strict=True)}
        self.codes = (np.unique(rows["c1"]), np.unique(rows["c2"]))

    def visits(self, b1: np.ndarray, b2: np.ndarray) -> Iterator[tuple[float, tuple[int, int]]]:
        """(bound, rows from and to) of the cells by falling bound: a heap over the two lists of half-score bounds."""
        own1, own2 = self.codes
        rank1, rank2 = own1[np.argsort(-b1[own1], kind="stable")], own2[np.argsort(-b2[own2], kind="stable")]
        s1, s2 = b1[rank1].tolist(), b2[rank2].tolist()
        heap = [(-(s1[0] + s2[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if rows := self.cells.get((int(rank1[i]), int(rank2[j]))):
                yield -bound, rows
            if j + 1 < len(s2):
                heapq.heappush(heap, (-(s1[i] + s2[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(s1):
                heapq.heappush(heap, (-(s1[i + 1] + s2[0]), i + 1, 0))

    def scores(self, q: np.ndarray, rows: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        starts, sizes = np.array([a for a, _ in rows]), np.array([b - a for a, b in rows])
        at = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        if self.small * float(np.abs(q).max(initial=0)) < 2.0**52:
            return at, (self.x[at] @ q.astype(np.float64)).astype(np.int64)
        return at, self.exact[at] @ q

    def search(self, q: np.ndarray, b1: np.ndarray, b2: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray],
               windows: list[Span]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the best rows of each window; ``wanted`` says which row places may count."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        open_, waiting, held, chunk = set(range(len(windows))), [], 0, 128

        def flush() -> None:
            nonlocal waiting, held, chunk
            at, s = self.scores(q, waiting)
            keep = wanted(at)
            at, s = at[keep], s[keep]
            for w in open_:
                inside = (s >= windows[w].low) & (s <= windows[w].high)
                if not inside.any():
                    continue
                ids, best = np.concatenate([found[w][0], self.ids[at[inside]]]), np.concatenate([found[w][1], s[inside]])
                order = np.lexsort((ids, -best))[:windows[w].k]
                found[w] = ids[order], best[order]
            waiting, held, chunk = [], 0, min(2 * chunk, 4096)  # a search that has not ended soon scores more at once

        for bound, rows in self.visits(b1, b2):
            if held >= chunk:
                flush()
            if not waiting:
                # a window is certified when what is left cannot come before its last row, or lies below it
                open_ = {w for w in open_ if bound >= windows[w].low and not (
                    len(found[w][0]) == windows[w].k and found[w][1][-1] > bound)}
                if not open_:
                    return found
            waiting.append(rows)
            held += rows[1] - rows[0]
        if waiting:
            flush()
        return found


def _in_blocks(anchors: DataFrame, placed: DataFrame, index: Index, config: MineConfig, fn: Callable, schema: str) -> DataFrame:
    """Calls ``fn(block, anchor row, bounds)`` for every anchor at every block that it was sent to; anchors come in bounded groups."""
    anchors = materialize(anchors)
    n_blocks = int(index.cells[:, 2:].sum(1).max())
    down = max(1, -(-anchors.count() // (config.anchor_block * n_blocks)))
    group = F.pmod(F.xxhash64("aid", F.lit(3)), F.lit(down)).cast("int")
    left = anchors.withColumn("part", group)
    right = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    shared = placed.sparkSession.sparkContext.broadcast(index)

    def run(key, a: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(a) and len(rows):
            own = Block(rows, shared.value)
            for start in range(0, len(a), 512):
                part = a.iloc[start:start + 512]
                b1, b2 = shared.value.bounds(q := matrix(part["q"], shared.value.width))
                for k, row in enumerate(part.itertuples(index=False)):
                    out += fn(own, row, q[k], b1[k], b2[k])
        names = [c.split()[0] for c in schema.split(", ")]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in names})

    parts = n_blocks * down
    return (left.repartition(parts, "block", "part").groupBy("block", "part")
            .cogroup(right.repartition(parts, "block", "part").groupBy("block", "part")).applyInPandas(run, schema))


def _route(anchors: DataFrame, index: Index, seed: bool, need: str | None = None) -> DataFrame:
    """Copies anchors to blocks: to that of their best cell, or to all others whose bound reaches ``need`` (null: any)."""
    shared = anchors.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 512):
                b = whole.iloc[start:start + 512]
                bound, first = shared.value.block_bounds(matrix(b["q"], shared.value.width))
                if seed:
                    yield b.assign(block=first)
                    continue
                go = bound >= (b[need].fillna(-np.inf).to_numpy(np.float64)[:, None] if need else -np.inf)
                go[np.arange(len(b)), first] = False
                at, block = np.nonzero(go)
                yield b.iloc[at].assign(block=block)

    ddl = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields] + ["block int"])
    return anchors.mapInPandas(run, ddl)


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, config: MineConfig = MineConfig(), scale: int = 256, vec_id: str = "vec_id",
         label: Column | None = None, embedding: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). ``is_anchor`` is a predicate on ``id``."""
    rows = materialize(whole_rows(vectors, scale, vec_id, F.col("label") if label is None else label, embedding))
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], RESULT)
    placed, index = build(rows, config)
    placed = materialize(placed)
    drop_step(rows)
    anchors = placed.where(is_anchor).select(F.col("id").alias("aid"), F.col("label").alias("alabel"), F.col("v").alias("q"))
    found = "aid long, vec_id long, score long"

    def positives(own: Block, row, q, b1, b2) -> list[pd.DataFrame]:
        low = -np.inf if "need" not in row._fields or pd.isna(row.need) else row.need
        [(ids, s)] = own.search(q, b1, b2, lambda at: (own.labels[at] == row.alabel) & (own.ids[at] != row.aid), [Span(low, np.inf, config.positives)])
        return [pd.DataFrame({"aid": row.aid, "vec_id": ids, "score": s})] if len(ids) else []

    def threshold(df: DataFrame, keys: list[str], k: int) -> DataFrame:
        return df.groupBy(*keys).agg(F.when(F.count("*") >= k, F.min("score")).alias("need"))

    near = materialize(_best(_in_blocks(_route(anchors, index, True), placed, index, config, positives, found), ["aid"], config.positives))
    known = anchors.join(threshold(near, ["aid"], config.positives).withColumnRenamed("aid", "a"), F.col("aid") == F.col("a"), "left").drop("a")
    far = _in_blocks(_route(known, index, False, "need"), placed, index, config, positives, found)
    top = materialize(_best(near.drop("rank").unionByName(far), ["aid"], config.positives))

    # a window per different positive score of an anchor; whole numbers: 50 p <= 100 n <= 95 p
    span = top.where("score >= 0").groupBy("aid").agg(F.sort_array(F.collect_set("score")).alias("spans"))
    asking = anchors.join(span.withColumnRenamed("aid", "a"), F.col("aid") == F.col("a")).drop("a")
    hits = "aid long, pscore long, vec_id long, score long"

    def negatives(own: Block, row, q, b1, b2) -> list[pd.DataFrame]:
        need = dict(zip(row.spans, row.floors, strict=True)) if "floors" in row._fields else {}
        windows = [Span(max(-(-config.low_pct * int(p) // 100), need.get(p, -np.inf)), config.high_pct * int(p) // 100, config.negatives) for p in row.spans]
        got = own.search(q, b1, b2, lambda at: own.labels[at] != row.alabel, windows)
        return [pd.DataFrame({"aid": row.aid, "pscore": int(p), "vec_id": ids, "score": s}) for p, (ids, s) in zip(row.spans, got, strict=True) if len(ids)]

    close = materialize(_best(_in_blocks(_route(asking, index, True), placed, index, config, negatives, hits), ["aid", "pscore"], config.negatives))
    floors = threshold(close, ["aid", "pscore"], config.negatives)
    # what a window still needs: a score as high as its last row so far, or its lower end
    lower = F.ceil(F.lit(config.low_pct) * F.col("pscore") / 100).cast("bigint")
    each = asking.select("aid", F.explode("spans").alias("pscore")).join(floors.withColumnRenamed("aid", "a").withColumnRenamed("pscore", "p"), (
        F.col("aid") == F.col("a")) & (F.col("pscore") == F.col("p")), "left").select("aid", "pscore", F.greatest(F.coalesce("need", lower), lower).alias("floor"))
    levels = each.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("pscore", "floor"))).alias("f"), F.min("floor").alias("least")).select(
        F.col("aid").alias("a"), "least", F.transform("f", lambda x: x["floor"]).alias("floors"))
    going = asking.join(levels, F.col("aid") == F.col("a")).drop("a")
    rest = _in_blocks(_route(going, index, False, "least"), placed, index, config, negatives, hits)
    best = _best(close.drop("rank").unionByName(rest), ["aid", "pscore"], config.negatives)
    pairs = top.select(F.col("aid").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(best, (F.col("anchor_id") == F.col("aid")) & (F.col("positive_score") == F.col("pscore"))).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
