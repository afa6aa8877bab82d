"""Near-duplicate documents by a chosen-path set similarity join on minwise shingles.

A document's set are its distinct runs of ``words`` words. Documents with equal sets form a class at once, represented
by the smallest id. Representatives enter ``trees`` independent trees. In a tree a node chooses a few of the minwise
functions and sends each of its documents, for each function, to the child named by the document's minimum: documents
with similarity s share a child with chance s per function. All documents of a node are compared with its first one, so
that a large group of near copies becomes one cluster with as many comparisons as it has members. Nodes whose documents
are all in one cluster end. In others, if at most ``leaf`` documents are outside the largest cluster, these are compared
with all others. If more are, the node branches again, as long as its children hold at most half of its comparisons: so crowds
that share a frequent run of words fall apart, and what a document is dealt to does not grow with the crowd. Families of texts just
below the threshold do not fall apart; they, and what is left at ``depth``, are compared exhaustively. In nodes of up to
``small`` documents pairs are joined. In larger ones no pair becomes
a row: a tile of documents outside and a tile of all meet in one task, first by sketches, then, those that have a candidate,
with their full sets, whose intersections are counted at once; a task returns the groups that it linked. Below the
roots a hash of the node chooses its functions, so nodes that two documents share lose them independently: two documents of
similarity 0.8 are missed by all trees with a chance of 4e-9 at the roots, 1.9e-8 one level below and 3.2e-8 at level 10 (computed
over the shared functions of the 64).

Comparisons are filtered by set sizes and by a sketch of two bits of each of 64 minima (agreement in fewer than ``agree``
symbols has a chance of about 2e-7 at similarity 0.8), and every link is confirmed on full sets. Connected components of the
links give the groups. All steps are joins and sums over ids, minima and sketches; sets are built only for documents that
have a candidate. Steps are kept in the shared folder and deleted when the next has been written.

Cases: documents without words, null texts included, have an empty set and are linked with nothing; fewer than
``words`` words are one shingle; a null id is linked with nothing, has a null component and is kept; rows with one id are
one document, and its texts' links are all its links; very long texts are hashed whole; equal sets are one class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_step, materialize

FUNCTIONS = 64
#: Rows of ids that may be broadcast; beyond it the texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Documents and runs of a tile of sets, about, and runs whose presence is laid out at once; a tile of sketches has ``SKETCHES`` times the documents.
TILE, TILE_RUNS, WIDTH, SKETCHES = 2048, 2_000_000, 2048, 4


@dataclass(frozen=True)
class JoinConfig:
    words: int = 5
    pct: int = 80
    trees: int = 3
    root_branches: int = 4
    branches: int = 3
    leaf: int = 2048
    small: int = 64
    depth: int = 10
    agree: int = 38
    same: int = 33
    seed: int = 11


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``words`` words of a whole text, A-Z lowered."""
    from xxhash import xxh3_64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, w), np.uint64, len(w))
    n = min(words, len(h))
    runs = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        runs = (runs ^ h[k:len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
    runs *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(runs ^ (runs >> np.uint64(32)))


def minima(runs: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The least value of each function over the set, as 32-bit numbers."""
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(runs), 2048):
        part = runs[start:start + 2048]
        np.minimum(out, (part[None, :] * factors[:, None] + shifts[:, None]).min(1), out=out)
    # the low bits of a minimum tell no more than its rank; mixing makes every bit usable
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (out >> np.uint64(32)).astype(np.uint32)


SIGNED = "id long, n long, key binary, s0 long, s1 long, sig array<int>"


def signatures(docs: DataFrame, config: JoinConfig, doc_id: str, text: str) -> DataFrame:
    rng = np.random.default_rng(config.seed)
    factors = rng.integers(0, 1 << 63, FUNCTIONS, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, FUNCTIONS, np.uint64)
    words = config.words

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for batch in batches:
            out: dict[str, list] = {"n": [], "key": [], "s0": [], "s1": [], "sig": []}
            for t in batch.column(1).to_pylist():
                runs = shingles(t, words)
                low = minima(runs, factors, shifts)
                out["n"].append(len(runs))
                out["key"].append(xxh3_128_digest(runs.tobytes()))
                for name, bit in (("s0", 0), ("s1", 1)):
                    out[name].append(int((((low >> np.uint32(bit)) & np.uint32(1)) * powers).sum().astype(np.int64)))
                out["sig"].append(low.view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["key"], pa.binary()), pa.array(out["s0"], pa.int64()),
                 pa.array(out["s1"], pa.int64()), pa.array(out["sig"], pa.list_(pa.int32()))], ["id", "n", "key", "s0", "s1", "sig"])

    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, SIGNED)


def _close(a: str, b: str, config: JoinConfig) -> Column:
    """Necessary for a link: sizes, then the sketch's symbols."""
    col = lambda side, name: F.col(f"{side}.{name}")
    differ = F.bit_count(col(a, "s0").bitwiseXOR(col(b, "s0")).bitwiseOR(col(a, "s1").bitwiseXOR(col(b, "s1"))))
    return ((100 * col(a, "n") >= config.pct * col(b, "n")) & (100 * col(b, "n") >= config.pct * col(a, "n")) & (64 - differ >= config.agree))


def confirm(pairs: DataFrame, docs: DataFrame, config: JoinConfig, doc_id: str, text: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. ``pairs`` is materialized."""
    ids = materialize(pairs.select(F.col("a").alias("i")).union(pairs.select(F.col("b").alias("i"))).distinct())
    sets = full_sets(ids, docs, config, doc_id, text)
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("runs").alias("ra")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("runs").alias("rb")), "b"))
    shared = both.withColumn("both", F.size(F.array_intersect("ra", "rb")).cast("bigint")).withColumn("n", F.size("ra").cast("bigint") + F.size("rb"))
    links = materialize(shared.where(100 * F.col("both") >= config.pct * (F.col("n") - F.col("both"))).select("a", "b").distinct())
    drop_step(sets)
    drop_step(ids)
    return links


def full_sets(ids: DataFrame, docs: DataFrame, config: JoinConfig, doc_id: str, text: str) -> DataFrame:
    """(id, runs) of the documents named by ``ids(i)``, which is materialized."""
    words = config.words
    own = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    few = ids.count() <= BROADCAST_IDS
    own = own.join(F.broadcast(ids) if few else ids, F.col("id") == F.col("i"), "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "runs"])

    return materialize(own.mapInArrow(run, "id long, runs array<long>"))


def _meet(rows: DataFrame, match: Callable[[pd.DataFrame], pd.DataFrame], schema: str, tile: int, tile_runs: float) -> DataFrame:
    """``match`` on each cell of a node: a tile of its documents outside the main cluster (``left`` is ``l``) and a tile of all (``right`` is ``r``)."""
    out = F.col("lead") != F.col("main")
    tiles = lambda n, runs: F.ceil(F.greatest(n / tile, runs / tile_runs)).cast("int")
    of = rows.groupBy(F.col("node").alias("of")).agg(tiles(F.count_if(out), F.sum(F.when(out, F.col("n")))).alias("lefts"), tiles(F.count("*"), F.sum("n")).alias("rights"))
    own = rows.join(of.where("lefts > 0"), F.col("node") == F.col("of")).drop("of")
    own = own.withColumns({"left": F.when(out, F.pmod(F.xxhash64("id"), "lefts").cast("int")), "right": F.pmod(F.xxhash64("id", F.lit("right")), "rights").cast("int")})
    cell = lambda left, right: F.struct(left.alias("l"), right.alias("r"))
    as_right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda k: cell(k, F.col("right")))
    as_left = F.when(out, F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda k: cell(F.col("left"), k))).otherwise(F.slice(as_right, 1, 0))
    dealt = own.select("*", F.inline(F.array_distinct(F.concat(as_right, as_left)))).drop("lefts", "rights")
    return dealt.groupBy("node", "l", "r").applyInPandas(match, schema)


def _close_in(config: JoinConfig) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The documents of a cell that are close, by sizes, sketches and the low bytes of the minima, to one of another cluster."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        x_at, y_at = np.flatnonzero(pdf["left"] == pdf["l"]), np.flatnonzero(pdf["right"] == pdf["r"])
        x, y, low = pdf.iloc[x_at], pdf.iloc[y_at], np.stack(pdf["sig"].to_list()).astype(np.uint8)
        n, s0, s1, lead = (y[c].to_numpy() for c in ("n", "s0", "s1", "lead"))
        hit = np.zeros(len(y), bool)
        ids = []
        for at in range(0, len(x), 64):
            m, t0, t1, own = (x[c].to_numpy()[at:at + 64, None] for c in ("n", "s0", "s1", "lead"))
            near = np.bitwise_count((t0 ^ s0) | (t1 ^ s1)) <= 64 - config.agree
            near &= (100 * m >= config.pct * n) & (100 * n >= config.pct * m) & (own != lead)
            i, j = np.nonzero(near)
            for part in range(0, len(i), 1 << 16):
                k, q = i[part:part + (1 << 16)], j[part:part + (1 << 16)]
                near[k, q] = (low[x_at[at + k]] == low[y_at[q]]).sum(1) >= config.same
            hit |= near.any(0)
            ids.append(x["id"].to_numpy()[at:at + 64][near.any(1)])
        ids = np.unique(np.concatenate([*ids, y["id"].to_numpy()[hit]]))
        return pd.DataFrame({"node": np.full(len(ids), pdf["node"].iloc[0]), "id": ids})

    return match


def _linked_in(config: JoinConfig) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Each document of a cell with the smallest one that links of the cell, decided on full sets, connect it with."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, n = pdf["id"].to_numpy(), pdf["runs"].str.len().to_numpy()
        x, y = np.flatnonzero(pdf["left"] == pdf["l"]), np.flatnonzero(pdf["right"] == pdf["r"])
        _, run, often = np.unique(np.concatenate(pdf["runs"].to_list()), return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(len(ids)), n)
        place = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[run]  # runs of one document only are in no intersection
        order = np.argsort(place, kind="stable")
        place, doc = place[order], doc[order]
        both = np.zeros((len(x), len(y)), np.float32)
        for at in range(0, int((often > 1).sum()), WIDTH):
            lo, hi = np.searchsorted(place, [at, at + WIDTH])
            has = np.zeros((len(ids), WIDTH), np.float32)
            has[doc[lo:hi], place[lo:hi] - at] = 1
            both += has[x] @ has[y].T
        both = both.astype(np.int64)
        near = np.zeros((len(ids), len(ids)), bool)
        near[x[:, None], y] = 100 * both >= config.pct * (n[x][:, None] + n[y] - both)
        near |= near.T
        a, b = [], []
        seen = np.zeros(len(ids), bool)
        for k in np.flatnonzero(near.sum(1) > near.diagonal()):
            if seen[k]:
                continue
            group, size = near[k].copy(), 0
            group[k] = True
            while size < (size := int(group.sum())):
                group |= near[group].any(0)
            seen |= group
            b.append(ids[group & (np.arange(len(ids)) != k)])
            a.append(np.full(len(b[-1]), ids[k]))
        return pd.DataFrame({"a": np.concatenate([*a, np.zeros(0, np.int64)]), "b": np.concatenate([*b, np.zeros(0, np.int64)])})

    return match


def _functions(level: int, config: JoinConfig) -> list[Column]:
    """The minwise functions that a node chooses: own ones for each tree's root, below it distinct ones by a hash of the node."""
    if level == 0:
        return [F.col("tree") * config.root_branches + k for k in range(config.root_branches)]
    h = F.xxhash64("tree", "node", F.lit("functions"))
    step = F.pmod(F.shiftright(h, 32), F.lit(FUNCTIONS // 2)) * 2 + 1  # odd, so that a node's functions differ
    return [F.pmod(h + step * k, F.lit(FUNCTIONS)).cast("int") for k in range(config.branches)]


def _branch(rows: DataFrame, level: int, config: JoinConfig) -> DataFrame:
    """Sends rows to the children of their nodes."""
    return rows.withColumn("node", F.explode(F.array(*[
        F.xxhash64("tree", "node", F.lit(k), F.get("sig", c)) for k, c in enumerate(_functions(level, config))]))).drop("sig")


def _split(nodes: DataFrame, kids: DataFrame) -> DataFrame:
    """(of): the nodes whose children hold at most half of their comparisons, of documents outside the largest cluster with all.

    Comparisons halve with every level, so branching deals out fewer rows than the tiles in its place would.
    """
    held = kids.groupBy("of", "node").agg(F.count("*").alias("c"), F.count_if("out").alias("o")).groupBy("of").agg(F.sum(F.col("c") * F.col("o")).alias("held"))
    return nodes.join(held, F.col("node") == F.col("of")).where(2 * F.col("held") <= F.col("rest") * nodes["size"]).select("of")


def _lead(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``lead``: the smallest document that a row's document is known to be connected with."""
    rows = rows.drop("lead")
    if roots is None:
        return rows.withColumn("lead", F.col("id"))
    known = roots.select(F.col("id").alias("rid"), "root")
    return rows.join(known, F.col("id") == F.col("rid"), "left").withColumn("lead", F.coalesce("root", "id")).drop("rid", "root")


def candidate_links(reps: DataFrame, docs: DataFrame, config: JoinConfig, doc_id: str, text: str) -> DataFrame:
    """Pairs (a < b) of representatives that connect every group: each document with its group's smallest."""
    data = ("id", "n", "s0", "s1")
    me = F.struct(*data)
    sig = reps.select(F.struct(*data).alias("me"), "sig")
    rows = reps.select(*data, F.col("id").alias("lead"), "sig", F.lit(0).cast("bigint").alias("node"),
                       F.explode(F.sequence(F.lit(0), F.lit(config.trees - 1))).alias("tree"))
    rows = _branch(rows, 0, config)
    roots = None

    def grow(pairs: DataFrame) -> None:
        """Confirms pairs and joins the clusters that they link."""
        pairs = materialize(pairs.distinct())
        join(confirm(pairs, docs, config, doc_id, text))
        drop_step(pairs)

    def join(found: DataFrame) -> None:
        nonlocal roots
        if roots is None or not found.isEmpty():
            roots = components(found if roots is None else found.unionByName(roots.select(F.col("root").alias("a"), F.col("id").alias("b"))))

    for level in range(config.depth + 1):
        stats = rows.groupBy("node").agg(F.count("*").alias("size"), F.min(me).alias("first"), F.min("lead").alias("lo"), F.max("lead").alias("hi"),
                                         F.min(F.struct("id", "lead")).alias("top")).where("lo <> hi")
        live = materialize(rows.join(stats.drop("lo", "hi"), "node"))
        if level:
            drop_step(kids)
        # every document of a node against its first: a large group of near copies becomes one cluster
        star = live.where(F.col("lead") != F.col("top.lead")).select(me.alias("x"), F.col("first").alias("y")).where(_close("x", "y", config))
        grow(star.select(F.col("y.id").alias("a"), F.col("x.id").alias("b")))
        # documents outside a node's largest cluster, if they are few or branching does not part them, against all others
        own = materialize(_lead(live.drop("first", "top", "size"), roots))
        drop_step(live)
        nodes = own.groupBy("node", "lead").agg(F.count("*").alias("c")).groupBy("node").agg(
            F.max(F.struct("c", "lead")).alias("main"), F.sum("c").alias("size")).where("main.c < size")
        nodes = materialize(nodes.select("node", F.col("main.lead").alias("main"), (F.col("size") - F.col("main.c")).alias("rest"), "size"))
        large = nodes.where(F.col("rest") > config.leaf)
        ends, deeper = nodes, level < config.depth and not large.isEmpty()
        if deeper:
            big = own.join(large, "node").withColumns({"_me": me, "of": F.col("node"), "out": F.col("lead") != F.col("main")})
            kids = materialize(_branch(big.join(sig, F.col("_me") == F.col("me")).select(*data, "lead", "out", "of", "node", "tree", "sig"), level + 1, config))
            split = materialize(_split(large, kids))
            ends = nodes.join(split, F.col("node") == F.col("of"), "left_anti")
        few = own.join(ends, "node")
        pairs = few.where(F.col("size") <= config.small)
        near = pairs.where("lead <> main").alias("x").join(pairs.alias("y"), (F.col("x.node") == F.col("y.node")) & (F.col("x.lead") != F.col("y.lead")) & (
            (F.col("y.lead") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))) & _close("x", "y", config))
        grow(near.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")))
        crowds = few.where(F.col("size") > config.small).select("node", "id", "lead", "main", "n", "s0", "s1")
        signed = crowds.withColumn("_me", me).join(sig, F.col("_me") == F.col("me")).drop("_me", "me")
        close = materialize(_meet(signed, _close_in(config), "node long, id long", SKETCHES * TILE, float("inf")).distinct())
        if not close.isEmpty():
            ids = materialize(close.select(F.col("id").alias("i")).distinct())
            sets = full_sets(ids, docs, config, doc_id, text)
            family = crowds.select("node", "id", "lead", "main", "n").join(close, ["node", "id"], "left_semi").join(sets, "id")
            links = materialize(_meet(family, _linked_in(config), "a long, b long", TILE, TILE_RUNS).distinct())
            join(links)
            for step in (ids, sets):
                drop_step(step)
        for step in (close, own, nodes):
            drop_step(step)
        if not deeper:
            break
        rows = _lead(kids.join(split, "of", "left_semi").drop("of", "out"), roots)
    return roots.select(F.col("root").alias("a"), F.col("id").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable, for ids that have an edge (a, b). Large and small stars by turns."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = mark
        # every neighbour above a document is tied to the least document near it
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).withColumn("m", F.least("m", "w"))
        large = ways.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every neighbour below a document, and it, are tied to the least of them
        down = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(down, F.col("u") == F.col("w"))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = materialize(small.select("e.*").where("u <> v").distinct())
        drop_step(edges)
        edges = after


def groups(docs: DataFrame, config: JoinConfig = JoinConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    return _groups(docs, config, doc_id, text)[0]


def _groups(docs: DataFrame, config: JoinConfig, doc_id: str, text: str) -> tuple[DataFrame, list[DataFrame]]:
    """The groups, and the steps that they are read from."""
    signed = materialize(signatures(docs, config, doc_id, text))
    known = signed.where(F.col("id").isNotNull() & (F.col("n") > 0))
    reps = materialize(known.groupBy("key").agg(F.min(F.struct("id", "n", "s0", "s1", "sig")).alias("r")).select("key", "r.*"))
    links = candidate_links(reps, docs, config, doc_id, text)
    # texts of one id in several classes tie these together
    several = known.groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select(F.col("id").alias("i"))
    ties = known.join(several, F.col("id") == F.col("i"), "left_semi").select("id", "key").join(reps.select("key", F.col("id").alias("rep")), "key")
    roots = components(links.unionByName(ties.select(F.col("id").alias("a"), F.col("rep").alias("b"))))
    named = reps.join(roots.withColumnRenamed("id", "rid"), F.col("id") == F.col("rid"), "left").select(
        F.col("key").alias("k"), F.coalesce("root", "id").alias("root"))
    steps = [signed, reps]
    out = signed.select("id", "n", "key").join(named, F.col("id").isNotNull() & (F.col("n") > 0) & (F.col("key") == F.col("k")), "left")
    root = F.coalesce("root", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), root.alias("component_id"),
                      F.coalesce(F.col("id") == root, F.lit(True)).alias("kept")), steps


def keep_one(docs: DataFrame, config: JoinConfig = JoinConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one document of each group; of rows that repeat an id the first by its JSON text stays."""
    own, steps = _groups(docs, config, doc_id, text)
    per_id = own.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_i")).agg(F.count("*").alias("_n"), F.min("kept").alias("_kept"))
    marked = materialize(per_id.where("_n > 1 or not _kept"))
    for step in steps:
        drop_step(step)
    few = marked.count() <= BROADCAST_IDS
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.col(f"`{doc_id}`").cast("bigint").alias("_key"))
    df = rows.join(F.broadcast(marked) if few else marked, F.col("_key") == F.col("_i"), "left")
    first = F.row_number().over(Window.partitionBy("_i").orderBy(F.to_json("_row")))
    repeated = df.where(F.col("_kept") & (F.col("_n") > 1)).withColumn("_first", first).where("_first = 1")
    return df.where(F.col("_i").isNull()).select("_row.*").unionByName(repeated.select("_row.*"))
