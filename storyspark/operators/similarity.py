"""Pairs for fuzzy comparisons, found by tiles of rows that meet in tasks.

Distinct titles are dealt to tiles by size and hash; every two tiles whose sizes allow a pair meet once, and a task rules pairs
out by bounds before it compares the rest. Token sets travel in packs that a join brings together. Candidates are never stored or
shuffled. Exact copies are collapsed to one node before any pair is formed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..functions.arrow import ratios, story_score
from ..session import cut

#: Rows of a tile at most, and the sizes (characters or tokens) of its rows together; two tiles meet in one task.
TILE_ROWS, TILE_SIZE = 4_096, 1 << 19


def _cells(left: DataFrame, right: DataFrame | None, keys: Sequence[str], reach: float) -> DataFrame:
    """Rows ``(keys, node, size, text)`` dealt to cells, each of a left and a right tile: (keys, a, i, b, j, is_left, ...).

    Sizes that differ by less than ``reach`` lie in one size class or in two that adjoin, and a class of a key is cut
    into tiles of bounded size by a hash. Every left row so meets every right row it can be similar to in exactly one
    cell. Without ``right`` rows meet each other once: a cell has ``(a, i) <= (b, j)``, and a tile meets itself.
    """
    step = F.floor(F.ln(F.col("size").cast("double")) / F.ln(F.lit(reach * 1.0001))).cast("int")

    def classed(df: DataFrame) -> DataFrame:
        return df.where(F.col("size") > 0).withColumn("cls", step)

    def tiles(df: DataFrame, name: str) -> DataFrame:
        n = F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum("size") / TILE_SIZE)).cast("int")
        return df.groupBy(*keys, "cls").agg(n.alias("n")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cls", "n"))).alias(name))

    once = right is None
    left = classed(left)
    right = left if once else classed(right)
    plan = cut(tiles(left, "tl").join(tiles(right, "tr"), list(keys)))

    def dealt(df: DataFrame, own: str, other: str, is_left: bool) -> DataFrame:
        rows = df.join(F.broadcast(plan), list(keys)).withColumn("me", F.pmod(F.xxhash64("node"), F.try_element_at(own, F.col("cls"))).cast("int"))
        parts = []
        for d in ((0, 1) if is_left else (0, -1)) if once else (-1, 0, 1):
            met, me, cls = F.try_element_at(other, F.col("cls") + d), F.col("me"), F.col("cls")
            low, high = F.lit(0), met - 1
            if once and d == 0:
                low, high = (me, high) if is_left else (low, me)
            cell = (lambda x: F.struct(cls.alias("a"), me.alias("i"), (cls + d).alias("b"), x.alias("j"))) if is_left else (
                lambda x: F.struct((cls + d).alias("a"), x.alias("i"), cls.alias("b"), me.alias("j")))
            parts.append(F.when(met.isNotNull(), F.transform(F.sequence(low, high), cell)).otherwise(F.array().cast("array<struct<a:int,i:int,b:int,j:int>>")))
        return rows.select(*keys, "node", "size", "text", F.lit(is_left).alias("is_left"), F.inline(F.concat(*parts)))

    both = dealt(left, "tl", "tr", True).unionByName(dealt(right, "tr", "tl", False))
    # a cell is much work on few bytes: adaptive execution must not put many into one task
    return both.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "a", "i", "b", "j")


def _counts(ids: list[np.ndarray], width: int) -> np.ndarray:
    """How many ids of each row fall into each of ``width`` buckets."""
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    flat = row * width + (np.concatenate(ids) & (width - 1))
    return np.bincount(flat, minlength=len(ids) * width).reshape(len(ids), width).astype(np.float32)


def _numbered(ids: list[np.ndarray]) -> list[np.ndarray]:
    """Bags as sets: the first, second, ... of equal ids become different ids."""
    sizes = [len(x) for x in ids]
    row, flat = np.repeat(np.arange(len(ids)), sizes), np.concatenate(ids)
    order = np.lexsort((flat, row))
    row, flat, at = row[order], flat[order], np.arange(len(flat))
    first = np.ones(len(flat), dtype=bool)
    first[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    return np.split((flat * 0x2545F491 + nth * 0x9E3779B1) >> 7, np.cumsum(sizes)[:-1])


def _near(left: list[np.ndarray], right: list[np.ndarray], share: float, less: float, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of bags that may share ``share * (m + n) - less`` of their m and n ids and whose sizes differ by ``ratio`` at most.

    Bags are numbered, so that they share as much as sets. Frequent ids have a column of their own and the rest are hashed to
    few columns: the product of the counts is what two sets share, or a little more, so it rules pairs out, but never one that
    shares enough.
    """
    m, n = (np.array([len(x) for x in side], dtype=np.float32) for side in (left, right))
    width = int(min(16_384, max(256, 1 << int(8 * max(m.max(), n.max())).bit_length())))
    left, right = _numbered(left), _numbered(right)
    _, column, often = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), dtype=np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(often))
    own = width - width // 8
    column = np.split(np.where(rank < own, rank, own + rank % (width // 8))[column], np.cumsum([len(x) for x in (*left, *right)])[:-1])
    l, r = _counts(column[:len(left)], width), _counts(column[len(left):], width)
    lx = np.column_stack([l, -share * m, np.ones_like(m)]).astype(np.float32)
    rx = np.column_stack([r, np.ones_like(n), -share * n]).astype(np.float32).T.copy()
    out = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))]
    for at in range(0, len(l), 512):
        i, j = np.divmod(np.flatnonzero((lx[at:at + 512] @ rx).ravel() >= -less - 0.05), len(r))
        i += at
        fits = (m[i] >= n[j] * ratio - 1e-3) & (n[j] >= m[i] * ratio - 1e-3)
        out.append((i[fits], j[fits]))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


#: Left texts of more words of 64 characters are taken one after the other.
BATCH_WORDS = 8


def _subsequences(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of texts ``left[i]`` and ``right[j]``, all pairs of a batch at once.

    Bit p of a pair's row is cleared when the length at character p of the left text grows; a character of the right text
    moves all of them by one addition over 64-bit words, or over one long number for a long left text.
    """
    out = np.zeros(len(i), dtype=np.int64)
    la, lb = (np.array([len(x) for x in side], dtype=np.int64) for side in (left, right))
    words_of = (la[i] + 63) // 64
    held, stands = -1, {}
    for k in np.flatnonzero(words_of > BATCH_WORDS):
        if i[k] != held:
            held, stands = i[k], {}
            for p, c in enumerate(left[held].tolist()):
                stands[c] = stands.get(c, 0) | 1 << p
        full = state = (1 << int(la[held])) - 1
        for c in right[j[k]].tolist():
            hit = state & stands.get(c, 0)
            state = ((state + hit) | (state - hit)) & full
        out[k] = la[held] - state.bit_count()
    known = np.unique(np.concatenate([*left, *right]))
    order = np.lexsort((lb[j], words_of))
    for words in np.unique(words_of[words_of <= BATCH_WORDS]):
        mine = order[words_of[order] == words]
        step = max(256, 16_384 // int(words))
        for s in range(0, len(mine), step):
            part = mine[s:s + step]
            rows, which = np.unique(i[part], return_inverse=True)
            cols, other = np.unique(j[part], return_inverse=True)
            # where each character stands in the left texts, as bits; 0 stands for no character
            code = np.searchsorted(known, np.concatenate([left[r] for r in rows])) + 1
            at = np.concatenate([np.arange(la[r]) for r in rows])
            slot = (np.repeat(np.arange(len(rows)), la[rows]) * (len(known) + 1) + code) * words + at // 64
            by = np.argsort(slot, kind="stable")
            heads = np.flatnonzero(np.r_[True, slot[by][1:] != slot[by][:-1]])
            bits = np.zeros(len(rows) * (len(known) + 1) * words, dtype=np.uint64)
            bits[slot[by][heads]] = np.bitwise_or.reduceat((np.uint64(1) << (at % 64).astype(np.uint64))[by], heads)
            bits = bits.reshape(-1, words)
            longest = int(lb[cols].max())
            text = np.zeros((longest, len(cols)), dtype=np.int64)
            for k, c in enumerate(cols):
                text[:lb[c], k] = np.searchsorted(known, right[c]) + 1
            base = which * (len(known) + 1)
            state = np.full((int(words), len(part)), ~np.uint64(0))
            for line in text:
                here = bits[base + line[other]].T
                carry = np.zeros(len(part), dtype=np.uint64)
                for w in range(int(words)):
                    old, hit = state[w], here[w]
                    both = old & hit
                    total = old + both
                    over = total < both
                    moved = total + carry
                    carry = (over | (moved < total)).astype(np.uint64)
                    state[w] = moved | (old & ~hit)
            out[part] = 64 * int(words) - np.bitwise_count(state).sum(axis=0, dtype=np.int64)
    return out


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """Left and right tile of a cell, and whether they are the same tile."""
    left, right = pdf[pdf["is_left"]], pdf[~pdf["is_left"]]
    one = pdf.iloc[0]
    return left, right, bool(one["a"] == one["b"] and one["i"] == one["j"])


def _keyed(pdf: pd.DataFrame, keys: Sequence[str], columns: dict) -> pd.DataFrame:
    made = pd.DataFrame(columns)
    for c in reversed(keys):
        made.insert(0, c, pd.Series([pdf[c].iloc[0]] * len(made), dtype=pdf[c].dtype))
    return made


def _resembling(left: list[str], right: list[str], threshold: float, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of titles whose ratio may reach the threshold in some direction; the bounds are those of :func:`title_edges`.

    Pairs of a tile that is the ``same`` on both sides are found once.
    """
    shortest, share = threshold / (2.0 - threshold), 1.5 * threshold - 1.0

    def read(side: list[str]) -> tuple[list, list]:
        chars = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) for x in side]
        return chars, [((c[:-1] * 0x9E3779B1 + c[1:] * 0x85EBCA6B) >> 7) for c in chars]

    lc, lg = read(left)
    rc, rg = read(right)
    # n bigrams are n + 1 characters, so sizes only nearly have the ratio of lengths, which is looked at below
    i, j = _near(lg, rg, share, 1.0 - 2.0 * share, shortest * 0.5)
    la, lb = np.array([len(c) for c in lc])[i], np.array([len(c) for c in rc])[j]
    fits = (la >= lb * shortest - 1e-9) & (lb >= la * shortest - 1e-9) & ((i < j) | (not same))
    i, j, need = i[fits], j[fits], threshold * (la + lb)[fits] / 2.0 - 0.01
    cl, cr = _counts(lc, 256), _counts(rc, 256)
    keep = np.ones(len(i), dtype=bool)
    for s in range(0, len(i), 8_192):
        keep[s:s + 8_192] = np.minimum(cl[i[s:s + 8_192]], cr[j[s:s + 8_192]]).sum(axis=1) >= need[s:s + 8_192]
    i, j, need = i[keep], j[keep], need[keep]
    # matching blocks are a common subsequence
    keep = _subsequences(lc, rc, i, j) >= need
    return i[keep], j[keep]


def title_edges(nodes: DataFrame, blocks: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Directed (keys, new, old, ratio): ratio of the newer title against the older one.

    ``nodes(node, title)`` are distinct titles. Both directions are computed because the
    ratio depends on the order of its arguments. Titles of lengths a and b with this ratio share at least (1.5t-1)(a+b)-1
    bigrams (k blocks over M matched characters keep M-k of them, and k <= a+b-2M+1), and the shorter one has at least
    t/(2-t) of the longer one's length. Tiles of titles meet in tasks, which rule pairs out by counted bigrams and
    characters and by their longest common subsequence, which is at least as long as all matching blocks together; no pair
    is stored before its ratio is known.
    """
    keys = list(keys)
    # a title of one character resembles no other one
    rows = blocks.join(nodes.where(F.length("title") > 1), "node").select(*keys, "node", F.length("title").alias("size"), F.col("title").alias("text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields] + ["new string", "old string", "ratio double"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(pdf)
        empty = _keyed(pdf, keys, {"new": pd.Series(dtype=object), "old": pd.Series(dtype=object), "ratio": pd.Series(dtype=float)})
        if left.empty or right.empty:
            return empty
        right = left if same else right
        i, j = _resembling(left["text"].tolist(), right["text"].tolist(), threshold, same)
        lt, rt = left["text"].to_numpy(dtype=object)[i], right["text"].to_numpy(dtype=object)[j]
        ln, rn = left["node"].to_numpy(dtype=object)[i], right["node"].to_numpy(dtype=object)[j]
        made = pd.DataFrame({"new": np.concatenate([ln, rn]), "old": np.concatenate([rn, ln]),
                             "ratio": ratios(pd.Series(np.concatenate([lt, rt])), pd.Series(np.concatenate([rt, lt])))})
        made = made[made["ratio"] >= threshold].reset_index(drop=True)
        return _keyed(pdf, keys, {c: made[c] for c in made.columns})

    cells = _cells(rows, None, keys, (2.0 - threshold) / threshold)
    return cells.groupBy(*keys, "a", "i", "b", "j").applyInPandas(compare, schema)


#: Sets are packed into one row by so many tiles; a key's packs of one side are dealt to chunks of so many packs.
PACK_TILES, CHUNK_PACKS = 4, 16


def _packs(rows: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Rows ``(keys, node, ids)`` in packs by size and hash: (keys, cls, pack, nodes, sizes, ids), sets one after the other.

    Sets that differ in size by less than the threshold lie in one size class or in two that adjoin.
    """
    keys = list(keys)
    rows = rows.withColumn("size", F.size("ids")).where("size > 0").withColumn(
        "cls", F.floor(F.ln(F.col("size").cast("double")) / F.ln(F.lit(1.0001 / threshold))).cast("int"))
    n = F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum("size") / TILE_SIZE) / PACK_TILES).cast("int")
    plan = rows.groupBy(*keys, "cls").agg(n.alias("n"))
    dealt = rows.join(F.broadcast(plan), [*keys, "cls"]).withColumn("pack", F.pmod(F.xxhash64("node"), "n").cast("int"))
    packs = dealt.repartition(*keys, "cls", "pack").groupBy(*keys, "cls", "pack").agg(F.collect_list(F.struct("node", "size", "ids")).alias("rows"))
    return packs.select(*keys, "cls", "pack", F.col("rows.node").alias("nodes"), F.col("rows.size").alias("sizes"), F.flatten("rows.ids").alias("ids"))


def _pack_pairs(left: DataFrame, right: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Every two packs of a key whose sizes allow a pair: (keys, nodes, sizes, ids, and those of the right pack, null for the same pack).

    Packs meet in a join, whose output goes straight to the comparison: a pack is not stored for every pack that it meets,
    but once for each chunk of the other side, which bounds what a task holds, and for each part of its key, if there are
    fewer keys than cores.
    """
    keys, once, spark = list(keys), right is None, left.sparkSession
    right = left if once else right

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias(name), (F.sum(F.size("nodes")) / (TILE_ROWS * PACK_TILES)).alias(f"{name}_rows"), (F.sum(F.size("ids")) / (TILE_SIZE * PACK_TILES)).alias(f"{name}_size"))

    plan = cut(counted(left, "l").join(counted(right, "r"), keys))
    cores = spark.sparkContext.defaultParallelism
    parts = F.least(F.col("l"), F.lit(-(-2 * cores // max(1, plan.count())))).cast("int")
    chunks = F.ceil(F.greatest("r_rows", "r_size") / CHUNK_PACKS).cast("int")
    plan = F.broadcast(plan.select(*keys, parts.alias("parts"), chunks.alias("chunks")))

    def dealt(df: DataFrame, own: str, of: str, other: str, to: str) -> DataFrame:
        df = df.join(plan, keys).withColumn(own, F.pmod(F.hash("cls", "pack"), of)).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(to) - 1)))
        # a pair of packs is much work on few bytes: adaptive execution must not put many into one task
        return df.repartition(max(8 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys, "part", "chunk").drop("parts", "chunks")

    met = [*keys, "part", "chunk"]
    l = dealt(left, "part", "parts", "chunk", "chunks")
    r = dealt(right, "chunk", "chunks", "part", "parts").select(*met, *[F.col(c).alias(f"r_{c}") for c in ("cls", "pack", "nodes", "sizes", "ids")])
    apart, same = F.col("r_cls") - F.col("cls"), (F.col("r_cls") == F.col("cls")) & (F.col("r_pack") == F.col("pack"))
    fits = (apart == 1) | ((apart == 0) & (F.col("r_pack") >= F.col("pack"))) if once else F.abs(apart) <= 1
    other = [(F.when(~same, F.col(f"r_{c}")) if once else F.col(f"r_{c}")).alias(f"r_{c}") for c in ("nodes", "sizes", "ids")]
    return l.hint("merge").join(r, met).where(fits).select(*keys, "nodes", "sizes", "ids", *other)


#: Places that two beginnings of sets share are looked at in parts of so many.
HITS = 1 << 21


def _sharing(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the index pairs of sets with at least this Jaccard, with it; without ``right`` pairs of ``left``, once.

    Two sets of m and n ids that reach t share at least t/(1+t)(m+n) ids. Ids are put in order from the rarest, so that at
    least one shared id lies in both beginnings, which leave out the last ceil(t m) - 1 ids; and what beginnings share
    and those left out of the one that ends first bound what the sets share. Sizes are looked at before ids meet.
    """
    same = right is None
    right = left if same else right
    m, n = (np.array([len(x) for x in side], dtype=np.int64) for side in (left, right))
    mine, theirs = np.argsort(m, kind="stable"), np.argsort(n, kind="stable")
    left, right, m, n = [left[k] for k in mine], [right[k] for k in theirs], m[mine], n[theirs]
    names, word = np.unique(np.concatenate(left if same else [*left, *right]), return_inverse=True)
    lw, rw = (word, word) if same else np.split(word, [m.sum()])
    often = np.bincount(lw, minlength=len(names)) * (np.bincount(rw, minlength=len(names)) - same)
    rank = np.empty(len(names), dtype=np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(names))
    alone = int((often == 0).sum())

    def beginnings(word: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Set and id of every place, then for each set the last id and how many are left out."""
        row, word = np.divmod(np.sort(np.repeat(np.arange(len(sizes)), sizes) * len(names) + rank[word]), len(names))
        starts, out = np.cumsum(sizes) - sizes, np.ceil(threshold * sizes - 1e-9).astype(np.int64) - 1
        use = (np.arange(len(word)) < (starts + sizes - out)[row]) & (word >= alone)
        return row[use], word[use], word[starts + sizes - out - 1], out

    li, lw, llast, lout = beginnings(lw, m)
    rj, rw, rlast, rout = (li, lw, llast, lout) if same else beginnings(rw, n)
    place = rw * len(n) + rj
    order = np.argsort(place)
    place, rj = place[order], rj[order]
    low = np.searchsorted(n, np.ceil(threshold * m - 1e-9))
    high = np.arange(len(m)) if same else np.searchsorted(n, np.floor(m / threshold + 1e-9), side="right")
    start = np.searchsorted(place, lw * len(n) + low[li])
    hits = np.maximum(np.searchsorted(place, lw * len(n) + high[li]) - start, 0)
    first = np.searchsorted(li, np.arange(len(m) + 1))
    total = np.concatenate([[0], np.cumsum(hits)])[first]
    row = 0
    while row < len(m):
        to = max(row + 1, int(np.searchsorted(total, total[row] + HITS, side="right")) - 1)
        a, b = first[row], first[to]
        row = to
        k = np.repeat(np.arange(a, b), hits[a:b])
        at = np.arange(len(k)) - np.repeat(np.cumsum(hits[a:b]) - hits[a:b], hits[a:b]) + start[k]
        pair, count = np.unique(li[k] * len(n) + rj[at], return_counts=True)
        i, j = np.divmod(pair, len(n))
        most = count + np.where(llast[i] <= rlast[j], lout[i], rout[j])
        fits = most >= threshold / (1.0 + threshold) * (m[i] + n[j]) - 1e-6
        i, j = i[fits], j[fits]
        sets: dict[tuple, set] = {}
        shared = np.zeros(len(i), dtype=np.int64)
        for at, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
            for of, side, k in ((True, left, x), (same, right, y)):
                if (of, k) not in sets:
                    sets[of, k] = set(side[k].tolist())
            shared[at] = len(sets[True, x] & sets[same, y])
        jaccard = shared / (m[i] + n[j] - shared)
        keep = jaccard >= threshold
        yield mine[i[keep]], theirs[j[keep]], jaccard[keep]


def _similar_sets(left: DataFrame, right: DataFrame | None, keys: Sequence[str], threshold: float) -> DataFrame:
    """(keys, left, right, jaccard) of sets ``(keys, node, ids)`` that are that similar; without ``right`` those of ``left``, once."""
    keys = list(keys)
    left = cut(_packs(left, keys, threshold))
    pairs = _pack_pairs(left, None if right is None else cut(_packs(right, keys, threshold)), keys)
    schema = T.StructType([*pairs.select(*keys).schema.fields, *(T.StructField(c, T.StringType()) for c in ("left", "right")), T.StructField("jaccard", T.DoubleType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: k for k, c in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                def sets(side: str) -> tuple[pa.Array, list[np.ndarray]]:
                    nodes, sizes, ids = (batch.column(at[side + c])[k].values for c in ("nodes", "sizes", "ids"))
                    return nodes, np.split(ids.to_numpy(zero_copy_only=False), np.cumsum(sizes.to_numpy(zero_copy_only=False))[:-1])

                ln, ls = sets("")
                rn, rs = (ln, None) if batch.column(at["r_nodes"])[k].values is None else sets("r_")
                for i, j, jaccard in _sharing(ls, rs, threshold):
                    named = [pa.array([batch.column(at[c])[k].as_py()] * len(i), type=batch.schema.field(c).type) for c in keys]
                    yield pa.RecordBatch.from_arrays([*named, ln.take(pa.array(i)), rn.take(pa.array(j)), pa.array(jaccard)], [*keys, "left", "right", "jaccard"])

    return pairs.mapInArrow(compare, schema)


def token_ids(tokens: str) -> Column:
    """Words as 64-bit ids, a third of the room."""
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _sets(nodes: DataFrame) -> DataFrame:
    """(node, ids) of ``nodes(node, tokens)``; tokens are words or already ids."""
    words = isinstance(nodes.schema["tokens"].dataType.elementType, T.StringType)
    return nodes.select("node", (token_ids("tokens") if words else F.col("tokens")).alias("ids"))


def jaccard_edges(nodes: DataFrame, blocks: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Directed (keys, new, old, jaccard) in both directions for token sets."""
    rows = blocks.join(_sets(nodes), "node").select(*keys, "node", "ids")
    return _similar_sets(rows, None, keys, threshold).select(*keys, F.inline(F.array(
        F.struct(F.col("left").alias("new"), F.col("right").alias("old"), F.col("jaccard")),
        F.struct(F.col("right").alias("new"), F.col("left").alias("old"), F.col("jaccard")),
    )))


def jaccard_pairs(nodes: DataFrame, left: DataFrame, right: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Distinct (left, right) nodes whose token sets are that similar and that meet under a key: ``left`` and ``right`` are (node, keys)."""
    sets = _sets(nodes)
    left, right = (side.join(sets, "node").select(*keys, "node", "ids") for side in (left, right))
    return _similar_sets(left, right, keys, threshold).where("left <> right").select("left", "right").distinct()


def story_similarity(left: str, right: str, title_weight: float = 0.65, content_weight: float = 0.35,
                     short_title: float = 0.92, min_words: int = 6) -> Column:
    """Similarity of two normalised stories held in struct columns.

    Structs carry ``title``, ``excerpt`` and ``tokens``; ``left`` is the newer story.
    """
    a, b = F.col(left), F.col(right)
    scores = story_score(
        a["title"], b["title"], t.jaccard(a["tokens"], b["tokens"]), F.lit(float(title_weight)), F.lit(float(content_weight)))
    return _decide(a, b, scores["ratio"], scores["mixed"], short_title, min_words)


def _decide(a: Column, b: Column, ratio: Column, mixed: Column, short_title: float, min_words: int) -> Column:
    def few(x: Column) -> Column:
        return F.size(F.filter(F.split(x["excerpt"], " "), lambda w: F.length(w) > 0)) < min_words

    return (
        F.when((F.length(a["title"]) == 0) | (F.length(b["title"]) == 0), F.lit(0.0))
        .when((a["title"] == b["title"]) & (a["excerpt"] == b["excerpt"]), F.lit(1.0))
        .when((few(a) | few(b)) & (ratio < short_title), F.lit(0.0))
        .otherwise(mixed)
    )
