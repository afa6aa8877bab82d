"""Running values against plain Python, with keys cut into blocks and without, and the plans that they give."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from storyspark.operators import analytics, indicators, stories
from storyspark.operators.scan import Blocks, greatest_before, nearest_after, nearest_before, previous, running, total


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def make(seed, n, keys, span):
    rng = random.Random(seed)
    return [(rng.choice(keys), rng.randrange(span), i, rng.choice([None, *range(9)])) for i in range(n)]


def brute(rows):
    out = {}
    for k, t, i, v in rows:
        before = sorted((t2, i2, v2) for k2, t2, i2, v2 in rows if k2 == k and (t2, i2) < (t, i))
        values = [v2 for *_, v2 in before if v2 is not None]
        out[i] = (before[-1][2] if before else None, bool(before), sum(values) + (v or 0), max(values, default=None))
    return out


@pytest.mark.parametrize("block_rows", [None, 40])
def test_running_values_equal_brute_force(spark, block_rows):
    # a third of the rows and more have one key, and all of its rows one moment
    rows = make(1, 150, ["a", None, "b"], 20) + [("hot", 5, 1000 + i, i * 7 % 11) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t long, id long, v long").repartition(3)
    values = F.coalesce("v", F.lit(0))
    blocks = Blocks(df, ["k"], [F.col("t"), F.col("id")], block_rows)
    assert (blocks.bounds is None) == (block_rows is None)
    got = blocks.add(df, {"p": previous(F.col("v")), "s": total(values), "m": greatest_before(F.col("v"))})
    # a second value that builds on the first
    got = blocks.add(got, {"changes": total(F.when(F.col("p").eqNullSafe(F.col("v")), 0).otherwise(1).cast("bigint"))})
    want = brute(rows)
    changes = {}
    for k in {r[0] for r in rows}:
        last, n = None, 0
        for _, _, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            n += v != last
            changes[i], last = n, v
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        p, _, s, m = want[r["id"]]
        assert (r["p"], r["s"], r["m"], r["changes"]) == (p, s, m, changes[r["id"]])


def test_hot_keys_are_cut_into_bounded_blocks(spark):
    df = spark.range(4000).select(F.lit("one").alias("k"), F.lit(0).cast("long").alias("t"), F.col("id"), F.lit(1).cast("long").alias("v"))
    blocks = Blocks(df, ["k"], [F.col("t"), F.col("id")], 400)
    bounds = [b["o1"] for b in blocks.bounds.first()["__bounds"]]
    sizes = [b - a for a, b in zip([0, *bounds], [*bounds, 4000])]
    assert len(sizes) >= 6 and max(sizes) < 3 * 400
    assert blocks.add(df, {"s": total(F.col("v"))}).where("s <> id + 1").count() == 0


@pytest.mark.parametrize("block_rows", [None, 30])
def test_nearest_values(spark, block_rows):
    rows = [(k, t, v) for k, t, _, v in make(3, 120, ["a", "b"], 400)] + [("hot", i, i % 13 or None) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, t long, v long").dropDuplicates(["k", "t"])
    rows = [tuple(r) for r in df.collect()]
    for r in running(df, ["k"], [F.col("t")], {"b": nearest_before(F.col("v")), "a": nearest_after(F.col("v"))}, block_rows).collect():
        own = sorted((t, v) for k, t, v in rows if k == r["k"] and v is not None)
        assert r["b"] == next((v for t, v in reversed(own) if t < r["t"]), None)
        assert r["a"] == next((v for t, v in own if t > r["t"]), None)


def test_plans_read_their_input_once(spark, tmp_path):
    at = datetime(2024, 1, 1)
    events = [(i, f"u{i % 3}", at + timedelta(minutes=i * 17 % 900)) for i in range(60)]
    spark.createDataFrame(events, "event_id long, user_id string, created_at timestamp_ntz").write.parquet(f"{tmp_path}/e")
    sessions = analytics.sessionize(spark.read.parquet(f"{tmp_path}/e"))
    assert plan(sessions).count("FileScan") == 1 and plan(sessions).count("Exchange hashpartitioning(user_id#") == 1
    points = [(i, "usd", Decimal(i % 5), at + timedelta(seconds=i), "{}") for i in range(40)]
    spark.createDataFrame(points, "id long, indicator_code string, value decimal(18,6), collected_at timestamp_ntz, raw_payload string").write.parquet(f"{tmp_path}/p")
    repaired = indicators.repair_outliers(spark.read.parquet(f"{tmp_path}/p"))
    assert plan(repaired).count("FileScan") == 1 and plan(repaired).count("Exchange") == 1


def test_exact_matches_read_texts_once(spark):
    rows = [(i, f"title {i % 4}", "", "body " * 9, "salud", "s", f"https://x.org/{i % 6}", datetime(2024, 1, 1, i), datetime(2024, 1, 1, i), True) for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, title string, description string, content string, category string, source string, url string, "
                               "published_at timestamp_ntz, collected_at timestamp_ntz, is_active boolean")
    got = stories.match_exact(df)
    assert plan(got).count("Scan ExistingRDD") <= 1 and plan(got).count("Exchange") <= 2
    assert {r["id"] for r in got.collect()} == set(range(4, 20))


def test_a_key_of_a_few_hundred_thousand_rows_is_cut(spark):
    df = spark.range(650_000).select(F.lit("k").alias("k"), F.col("id").alias("t"))
    bounds = Blocks(df, ["k"], [F.col("t")]).bounds
    assert bounds is not None and len(bounds.first()["__bounds"]) >= 2
