"""Hard negatives against plain Python."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from storyspark.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, block int, score double"


def brute(rows, every=10):
    own = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = (label, [math.floor(float(np.float32(c)) * 256) for c in v])
        own[i] = min(own.get(i, x), x)
    width = max((len(x[1]) for x in own.values()), default=0)
    vec = {i: x[1] + [0] * (width - len(x[1])) for i, x in own.items()}
    out = []
    for a in own:
        if a % every:
            continue
        score = {i: sum(p * q for p, q in zip(vec[a], vec[i], strict=True)) for i in own if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if own[i][0] == own[a][0]][:5]:
            fit = [i for i in order if own[i][0] != own[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k, n, score[p], score[n]) for k, n in enumerate(fit[:3], 1)]
    return sorted(out)


def found(df, config, every=10):
    return sorted(tuple(r) for r in hard.mine(df, F.col("id") % every == 0, config).collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "x", 2, 0.5) for i, v, y in rows], SCHEMA).repartition(3)


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (6, 12))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.4, 12)).tolist(), int(rng.integers(0, 4))) for i in range(160)]
    rows += [(200 + i, [0.5] * 12, i % 3) for i in range(60)]  # one very common vector, ties
    rows += [(300 + i, [0.0] * 12, i % 2) for i in range(8)]
    config = hard.MineConfig(codes=5, block=40, anchor_block=8)  # cells split over blocks, anchors over groups
    assert found(frame(spark, rows), config) == brute(rows)


def test_odd_vectors(spark):
    rows = [(None, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (10, [1.0], 1), (11, None, 1), (12, [1.0, None], 1), (13, [math.nan, 1.0], 1),
            (14, [math.inf, 1.0], 1), (15, [1.0, 1.0], None), (16, [0.9, 1.9], 2), (17, [0.7, 1.2, 0.1], 2), (18, [0.5, 1.0], 3), (19, [-1.0, -1.0], 3),
            (20, [-3.0, 1.0], 1), (21, [], 2), (30, [0.5, 0.9], 2), (0, [9.0, 9.0], 2), (40, [0.5, 0.9], 2)]
    assert found(frame(spark, rows), hard.MineConfig(codes=2)) == brute(rows) != []
    assert found(frame(spark, rows[:1]), hard.MineConfig()) == []
    assert found(spark.createDataFrame([], SCHEMA), hard.MineConfig()) == []


def test_cells_beyond_a_certified_window_are_not_scored():
    rng = np.random.default_rng(5)
    centres = rng.integers(-2000, 2000, (64, 8))
    x = centres[np.arange(4000) % 64] + rng.integers(-20, 20, (4000, 8))
    books = tuple(hard.codebook(h, 32, 6, 1) for h in hard.halves(x))
    codes = [hard.nearest(h, b) for h, b in zip(hard.halves(x), books, strict=True)]
    radii = tuple(np.array([d[c == k].max(initial=0) for k in range(32)]) for c, d in codes)
    cells = [(int(a), int(b), 1) for a, b in sorted(set(zip(codes[0][0].tolist(), codes[1][0].tolist())))]
    index = hard.Index(books, radii, hard.plan(cells, 10**6), 8)
    block = hard.Block(pd.DataFrame({"id": np.arange(4000), "label": np.zeros(4000, int), "v": list(x), "c1": codes[0][0], "c2": codes[1][0]}), index)
    scored = 0
    real = block.scores

    def counted(q, rows):
        nonlocal scored
        scored += sum(b - a for a, b in rows)
        return real(q, rows)

    block.scores = counted
    queries = x[:100]
    b1, b2 = index.bounds(queries)
    for k, q in enumerate(queries):
        [(ids, s)] = block.search(q, b1[k], b2[k], lambda at: at >= 0, [hard.Span(-np.inf, np.inf, 5)])
        every = x @ q
        assert list(zip(ids, s, strict=True)) == [(i, every[i]) for i in sorted(range(4000), key=lambda i: (-every[i], i))[:5]]
    assert scored < 0.3 * 100 * 4000


def test_hot_cells_are_split():
    plan = hard.plan([(0, 0, 10), (0, 1, 95), (1, 0, 5), (1, 1, 30)], 40)
    assert plan.tolist() == [[0, 0, 0, 1], [0, 1, 1, 3], [1, 0, 4, 1], [1, 1, 4, 1]]


def test_random_blocks_keep_order_of_ties(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.25, 0.5]) for _ in range(3)], rng.randrange(2)) for i in range(120)]
    assert found(frame(spark, rows), hard.MineConfig(codes=3, block=17, anchor_block=2)) == brute(rows)
