"""Classifiers on held-out rows, and mixing against a walk in plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyspark.llm import mixing, toxicity
from storyspark.llm import quality_gam as gam


def test_additive_model_learns_single_and_paired_effects():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = (((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)) | (x[:, 2] > 0.9)).astype(float)
    model = gam.fit(x[:2000], y[:2000])
    p = model.score(x[2000:])
    assert ((p >= 0.5) == (y[2000:] == 1)).mean() > 0.95
    assert {(i, j) for i, j, _ in model.pairs[:1]} == {(1, 0)}
    alone = gam.fit(x[:2000], y[:2000], n_pairs=0)
    assert ((alone.score(x[2000:]) >= 0.5) == (y[2000:] == 1)).mean() < 0.75
    # a score is the sum of table entries
    b = model.bins(x[:1])[0]
    total = model.base + sum(t[b[j]] for j, t in enumerate(model.tables)) + sum(t[b[i] // 4, b[j] // 4] for i, j, t in model.pairs)
    assert abs(total - model.logit(x[:1])[0]) < 1e-9


def labelled(spark, seed, bad, label):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "the", "or", "ing", "es"]) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for k in range(240):
        own = [word() for _ in range(rng.randrange(20, 90))]
        y = k % 3 == 0
        rows.append((k, " ".join(bad(rng, own) if y else own)))
        labels.append((k, int(y) if label == "toxic" else int(not y)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame([*labels, (0, None), (None, 1), (9999, 1)], f"doc_id long, {label} int"), dict(labels)


def hurt(rng, own):
    for _ in range(3):
        own.insert(rng.randrange(len(own)), rng.choice(["scoundrel", "blockhead", "vermin"]))
    return own


@pytest.mark.parametrize(("module", "label", "bad", "bar"), [
    (gam, "quality", lambda rng, own: [w.upper() + "!!" for w in own], 0.5), (toxicity, "toxic", hurt, 0.7)])
def test_classifiers_tell_held_out_rows(spark, odd, empty, module, label, bad, bar):
    docs, labels, truth = labelled(spark, 2, bad, label)
    model = module.train(docs, labels)
    from storyspark.llm.common import held_out

    got = docs.select("doc_id", held_out(F.col("doc_id")).alias("h"), module.score(model, F.col("text")).alias("p")).where("h").collect()
    assert len(got) > 40 and sum((r["p"] >= bar) == (truth[r["doc_id"]] == 1) for r in got) >= 0.93 * len(got)
    scored = odd.select(module.score(model, F.col("text")).alias("p")).collect()
    assert len(scored) == 10 and all(0 <= r["p"] <= 1 for r in scored)
    assert empty.select(module.score(model, F.col("text")).alias("p")).count() == 0
    blank = module.train(docs, labels.limit(0))
    assert {r["p"] for r in docs.limit(3).select(module.score(blank, F.col("text")).alias("p")).collect()} == {0.5}


def shares(children, budget):
    """{name: budget} of {name: (weight, capacity)}: the short ones take all, the rest share anew, until none is short."""
    out, live = {n: 0 for n, (w, _) in children.items() if not w}, {n: x for n, x in children.items() if x[0]}
    while live:
        wide = sum(w for w, _ in live.values())
        short = [n for n, (w, c) in live.items() if c * wide <= budget * w]
        if not short:
            return out | {n: budget * w // wide for n, (w, _) in live.items()}
        for n in short:
            out[n] = live.pop(n)[1]
            budget -= out[n]
    return out


def test_budgets_go_to_siblings_before_ancestors(spark):
    leaves = [("a", "x", 10), ("a", "y", 500), ("b", "x", 40), ("b", "y", 40), ("b", "z", 70), ("c", "x", 900), (None, "x", 30)]
    mix = mixing.Mix(levels=("p", "q"), weights={"p": {"a": 5, "b": 3, "c": 1}, "q": {"x": 3, "z": 0}}, epochs=2)
    df = spark.createDataFrame(leaves, "p string, q string, size long")
    got = {(r["p"], r["q"]): r["budget"] for r in mixing.budgets(df, mix, 1000).collect()}
    weight = lambda level, v: mix.weights[level].get(v, 1)
    capacity = {(p, q): 2 * n * (weight("q", q) > 0) for p, q, n in leaves}
    top = shares({p: (weight("p", p), sum(c for (x, _), c in capacity.items() if x == p)) for p, _, _ in leaves}, 1000)
    want = {}
    for p in top:
        want |= {(p, q): b for q, b in shares({q: (weight("q", q), c) for (x, q), c in capacity.items() if x == p}, top[p]).items()}
    assert got == want and got["b", "z"] == 0 and got["a", "x"] == 20


def test_prefixes_of_seeded_epochs(spark, odd, empty):
    rng = random.Random(5)
    rows = [(k, "w " * rng.randrange(1, 40), "big" if k % 3 else "small") for k in range(400)] + [(1000, "w w", None), (1001, None, "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mix = mixing.Mix(levels=("source",), weights={"source": {"small": 6, "big": 2}}, epochs=3, budget_pct=90)
    got = sorted(((r["source"] or "", r["epoch"], r["doc_id"]) for r in mixing.select(df, mix).collect()))
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in ("big", "small", None)}
    budget = shares({s: ({"small": 6, "big": 2}.get(s, 1), 3 * n) for s, n in size.items()}, sum(size.values()) * 90 // 100)
    want = []
    for s in size:
        left = budget[s]
        for epoch in range(3):
            own = sorted((hashlib.md5(f"7:{epoch}:{i}".encode()).hexdigest(), i, len((t or "").split())) for i, t, x in rows if x == s)
            for _, i, n in own:
                if n > left:
                    left = -1
                    break
                want.append((s or "", epoch, i))
                left -= n
            if left <= 0:
                break
    assert got == sorted(want)
    some = odd.withColumn("domain", F.lit(None).cast("string"))
    taken = mixing.select(some, mixing.Mix(budget_pct=100))
    assert taken.columns == ["tokens", *[c for c in some.columns if c != "tokens"], "epoch"] and taken.count() == 9
    assert mixing.select(empty.withColumn("domain", F.lit("d")), mixing.Mix()).count() == 0
