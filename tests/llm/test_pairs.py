"""Near-duplicates and vector search against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyspark.llm import impact_search as search
from storyspark.llm import near_dedup as near


def sets(text, n):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i:i + n]) for i in range(len(w) - n + 1)])


def brute(rows, n, pct=80):
    """Smallest id reachable for each (id, text) row."""
    own = [(i, sets(t, n)) for i, t in rows if i is not None]
    root = {i: i for i, _ in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (a, x) in enumerate(own):
        for b, y in own[:k]:
            both = len(x & y)
            if x and y and 100 * both >= pct * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in own}


def near_copies(seed, groups):
    rng = random.Random(seed)
    word = lambda: rng.choice(["of", "the", "and"]) if rng.random() < 0.4 else "w" + str(rng.randrange(3000))
    rows, k = [], 0
    for size, length, changes in groups:
        base = [word() for _ in range(length)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(changes + 1)):
                own[rng.randrange(length)] = word()
            rows.append((k, " ".join(own)))
            k += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "leaf"), [(2, 256), (5, 4)])
def test_groups_equal_all_pairs(spark, n, leaf):
    rows = near_copies(n, [(1, 60, 0)] * 30 + [(4, 80, 12)] * 15 + [(30, 120, 6)] + [(2, 3, 1)] * 5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near.groups(df, near.JoinConfig(words=n, leaf=leaf)).collect()
    want = brute(rows, n)
    texts = dict(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(sets(texts[r["doc_id"]], n)) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_group_of_near_copies_needs_few_comparisons(spark):
    rows = near_copies(9, [(300, 200, 4), (1, 50, 0), (1, 50, 0)])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    config = near.JoinConfig(words=2, leaf=8)
    reps = near.signatures(df, config, "doc_id", "text").where("n > 0")
    links = near.candidate_links(reps, df, config, "doc_id", "text")
    assert links.count() < 300 * 40  # all pairs would be 44,850
    assert len({r["component_id"] for r in near.groups(df, config).collect()}) == 3


def test_family_below_the_threshold_meets_in_tasks(spark, monkeypatch):
    """Most of its texts are a little less similar than a link needs: they meet, and no pair of them is a row."""
    rows = near_copies(4, [(240, 120, 22), (1, 50, 0)])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    pairs, confirm = [], near.confirm
    monkeypatch.setattr(near, "TILE", 50)  # several tiles
    monkeypatch.setattr(near, "confirm", lambda found, *a: pairs.append(found.count()) or confirm(found, *a))
    got = {r["doc_id"]: r["component_id"] for r in near.groups(df, near.JoinConfig(words=2, small=8)).collect()}
    assert got == brute(rows, 2) and 2 < len(set(got.values())) < 241
    assert sum(pairs) < 240 * 14  # with the first of each node; all pairs would be 28,680


def test_crowd_that_shares_a_run_is_not_dealt_to_more_tiles_the_larger_it_is(spark, monkeypatch):
    """Texts that have nothing in common but a frequent pair of words fall apart by branching; a few of them are near copies."""
    rng = random.Random(7)
    rows = [(k, " ".join(["of", "the", *(f"w{rng.randrange(100_000)}" for _ in range(3 + k % 3))])) for k in range(5_000)]
    rows += [(5_000 + k, t + f" of the {t}") for k, (_, t) in enumerate(rows[:60])] + [(5_100 + k, t + f" of the {t} of the") for k, (_, t) in enumerate(rows[:60])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    dealt, close_in = spark.sparkContext.accumulator(0), near._close_in

    def counted(config):
        match = close_in(config)
        return lambda pdf: (dealt.add(len(pdf)), match(pdf))[1]

    monkeypatch.setattr(near, "TILE", 512)
    monkeypatch.setattr(near, "_close_in", counted)
    got = {r["doc_id"]: r["component_id"] for r in near.groups(df, near.JoinConfig(words=2)).collect()}
    assert all(got[5_100 + k] == got[5_000 + k] != k for k in range(60)) and len(set(got.values())) == 5_060
    assert dealt.value < 4 * len(rows)


def test_nodes_of_a_tree_lose_a_pair_independently(spark):
    """400 pairs whose minima agree with chance 0.8, followed down one tree for as long as a node holds both documents."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(400):
        x, y = rng.integers(0, 1 << 30, (2, near.FUNCTIONS))
        rows += [(k, 0, x.tolist()), (k, 1, np.where(rng.random(near.FUNCTIONS) < 0.8, x, y).tolist())]
    docs = spark.createDataFrame(rows, "pair long, side int, sig array<int>").localCheckpoint()
    config = near.JoinConfig(trees=1)
    at, left = docs.withColumns({"tree": F.lit(0), "node": F.lit(0).cast("bigint")}), []
    for level in range(6):
        down = near._branch(at, level, config)
        both = down.groupBy("pair", "tree", "node").agg(F.count("*").alias("c")).where("c = 2").drop("c").localCheckpoint()
        left.append(both.select("pair").distinct().count())
        at = both.join(docs, "pair")
    # a tree misses 0.2 % at any depth (one pair of these); with the same functions for all nodes of a level 4 % at level 5 (16 pairs)
    assert left[0] >= 396 and left[-1] >= 396


def test_near_dedup_odd_rows(odd, empty, spark):
    got = near.groups(odd, near.JoinConfig(words=2)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 10 and by[6]["component_id"] == 5 and not by[6]["kept"] and by[None]["component_id"] is None and by[None]["kept"]
    assert by[2]["n_shingles"] == by[3]["n_shingles"] == by[7]["n_shingles"] == 0 and by[2]["kept"] and by[3]["kept"]
    one = near.keep_one(odd, near.JoinConfig(words=2))
    assert one.columns == odd.columns and sorted(r["doc_id"] or 0 for r in one.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]
    assert near.groups(empty).count() == 0 and near.keep_one(empty).count() == 0
    # texts of one id tie their classes together
    tied = spark.createDataFrame([(9, "a b c d"), (9, "e f g h"), (3, "a b c d"), (4, "e f g h")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near.groups(tied, near.JoinConfig(words=2)).collect()} == {(9, 3), (3, 3), (4, 3)}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(10, 60)] + [(100, k) for k in range(101, 180)] + [(60, 5)]
    got = {r["id"]: r["root"] for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 5 for k in range(10, 61)}, **{k: 100 for k in range(101, 180)}}


def best(vectors, k, every):
    out = []
    for q in vectors:
        if q % every == 0:
            scored = sorted(((-int(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e7])
def test_search_equals_all_pairs(spark, scale):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(300, 16)) * 0.2 * scale).astype(np.float32)
    x[100:180] = x[7]  # a third of all rows ties
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    whole = {i: np.array([int(np.floor(float(a) * 64)) for a in v], object) for i, v in enumerate(x)}
    got = search.top_k(df, F.col("id") % 20 == 0, k=7, block=90, query_block=6)
    assert sorted(map(tuple, got.collect())) == best(whole, 7, 20)


def test_search_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [3.0]), (None, [1.0, 1.0]),
            (6, [1.0, 1.0]), (6, [1.0, 1.0]), (7, [-1.0, 0.0]), (8, [])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, id long, score long")
    got = sorted(map(tuple, search.top_k(df, F.col("id") == 0, k=20).collect()))
    assert got == [(0, 1, 5, 192 * 64), (0, 2, 6, 64 * 64 + 128 * 64), (0, 3, 8, 0), (0, 4, 7, -64 * 64)] or got == [
        (0, 1, 5, 12288), (0, 2, 6, 12288), (0, 3, 8, 0), (0, 4, 7, -4096)]
    assert search.top_k(df.limit(0), F.col("id") == 0).count() == 0
    assert search.top_k(df.where("vec_id = 0"), F.col("id") == 0).count() == 0
