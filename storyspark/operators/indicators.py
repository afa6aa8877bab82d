"""Economic indicator series: latest values, history, change suppression, outlier repair."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import micros, parse_decimal
from .scan import attach, nearest_after, nearest_before, previous, running

SERIES_KEY = ("source", "indicator_code", "currency", "asset", "side")


def _day() -> Column:
    return F.coalesce("observed_at", F.to_date("collected_at"))


def latest_values(df: DataFrame, day: date | None = None, key: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Row with the greatest id per key, optionally of one day. One pass, no self join."""
    rows = df.where(_day() == F.lit(day)) if day else df
    others = [c for c in df.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.col("id")).alias("b"))
    return best.select(*key, *[F.col(f"b.{c}").alias(c) for c in others])


def history(df: DataFrame, codes: DataFrame, since: datetime) -> DataFrame:
    """Points of the asked codes since a time, as rows; a code without points gives one empty row."""
    points = df.where(F.col("collected_at") >= F.lit(since).cast("timestamp_ntz")).select(
        "indicator_code", "id", F.col("value").cast("double").alias("value"), "observed_at", "collected_at")
    return codes.select("indicator_code").distinct().join(points, "indicator_code", "left")


def series_points(df: DataFrame) -> DataFrame:
    """One point per code and second, the last value wins."""
    second = F.floor(micros(F.col("collected_at")) / 1_000_000).cast("bigint")
    return df.groupBy("indicator_code", second.alias("time")).agg(
        F.max_by("value", F.struct("collected_at", "id")).cast("double").alias("value"))


def rate_spread(df: DataFrame, official: str, parallel: str) -> DataFrame:
    """Latest official and parallel value, their gap and the gap in percent."""
    last = F.struct("collected_at", "id")
    out = df.where(F.col("indicator_code").isin(official, parallel)).agg(
        F.max_by("value", F.when(F.col("indicator_code") == official, last)).cast("double").alias("official"),
        F.max_by("value", F.when(F.col("indicator_code") == parallel, last)).cast("double").alias("parallel"))
    gap = F.col("parallel") - F.col("official")
    return out.withColumn("gap", gap).withColumn("gap_pct", F.try_divide(gap, F.nullif("official", F.lit(0.0))) * 100)


def change_only(df: DataFrame, key: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Rows whose day or value differs from the row before; adds ``outcome`` to every row.

    Comparing with the preceding row equals comparing with the last stored one, since a
    suppressed row equals its predecessor. Rows without a value are skipped.
    """
    valued = df.where(F.col("value").isNotNull())
    current = F.struct(_day().alias("day"), F.col("value").alias("v"))
    seen = running(valued, key, [F.col("collected_at"), F.col("id")], {"prev": previous(current)})
    same = F.col("prev").isNotNull() & F.col("prev.day").eqNullSafe(_day()) & (F.col("prev.v") == F.col("value"))
    return seen.withColumn("outcome", F.when(same, "unchanged").otherwise("inserted")).drop("prev")


def save_report(df: DataFrame, key: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Counts of inserted, unchanged and skipped rows."""
    done = change_only(df, key).agg(
        F.count_if(F.col("outcome") == "inserted").alias("inserted"),
        F.count_if(F.col("outcome") == "unchanged").alias("unchanged"))
    return attach(done, df.agg(F.count_if(F.col("value").isNull()).alias("skipped")))


def reliable_advertiser(advertiser: Column, min_orders: int = 10, min_rate: float = 0.80) -> Column:
    """Verified merchant with enough orders and completions."""
    return F.coalesce(
        (advertiser["userType"] == "merchant")
        & (advertiser["monthOrderCount"].try_cast("int") >= min_orders)
        & (advertiser["monthFinishRate"].try_cast("double") >= min_rate),
        F.lit(False))


BOOK_SCHEMA = (
    "struct<data:array<struct<adv:struct<price:string>,advertiser:struct<monthOrderCount:string,"
    "monthFinishRate:string,userType:string>>>>"
)


def best_quotes(books: DataFrame) -> DataFrame:
    """Best price per quote book: lowest for BUY, highest for SELL, reliable sellers first.

    ``books(book_id, trade_type, payload)``. Both extremes come from one aggregation.
    """
    quotes = books.select(
        "book_id", "trade_type", F.posexplode(F.from_json("payload", BOOK_SCHEMA)["data"]).alias("pos", "q"))
    quotes = quotes.select(
        "book_id", "trade_type", parse_decimal(F.col("q.adv.price")).alias("price"),
        reliable_advertiser(F.col("q.advertiser")).alias("reliable")).where("price IS NOT NULL")
    sell = F.col("trade_type") == "SELL"
    found = quotes.groupBy("book_id", "trade_type").agg(
        F.max(F.when(F.col("reliable"), F.col("price"))).alias("rmax"),
        F.min(F.when(F.col("reliable"), F.col("price"))).alias("rmin"),
        F.max("price").alias("amax"), F.min("price").alias("amin"), F.count("*").alias("quotes"),
        F.count_if("reliable").alias("reliable_quotes"))
    kind = F.when(sell, "highest_price").otherwise("lowest_price")
    suffix = F.when(F.col("reliable_quotes") == 0, "_unfiltered_fallback").otherwise("")
    return found.select(
        "book_id", "trade_type",
        F.when(sell, F.coalesce("rmax", "amax")).otherwise(F.coalesce("rmin", "amin")).alias("price"),
        F.concat(kind, suffix).alias("selection"), "quotes", "reliable_quotes")


ADVERT_SCHEMA = "struct<advertisement:struct<advertiser:struct<monthOrderCount:string,monthFinishRate:string,userType:string>>>"


def repair_outliers(
    df: DataFrame, codes: Sequence[str] | None = None, forced: Sequence[int] = (), min_deviation: str = "0.03",
    key: Sequence[str] = ("indicator_code",),
) -> DataFrame:
    """Time-linear interpolation of unreliable values between reliable neighbours.

    Reliability is read from ``raw_payload``. A row changes only if the expected value
    deviates by more than ``min_deviation``. Adds ``new_value``, ``action`` and
    ``repair_reason``; nothing is overwritten, so it doubles as the dry run.
    """
    rows = df.where(F.col("indicator_code").isin(*codes)) if codes else df
    payload = F.from_json("raw_payload", ADVERT_SCHEMA)
    is_forced = F.col("id").isin(*forced) if forced else F.lit(False)
    good = reliable_advertiser(payload["advertisement"]["advertiser"]) & ~is_forced
    at = micros(F.col("collected_at"))
    rows = rows.withColumns({"good": good, "at": at})
    point = F.when(F.col("good"), F.struct(F.col("at").alias("t"), F.col("value").alias("v")))
    rows = running(rows, key, [F.col("at")], {"b": nearest_before(point), "a": nearest_after(point)})
    share = ((F.col("at") - F.col("b.t")) / (F.col("a.t") - F.col("b.t"))).cast("decimal(18,12)")
    between = (F.col("b.v") + (F.col("a.v") - F.col("b.v")) * share).cast("decimal(18,6)")
    expected = F.when(F.col("b").isNull(), F.col("a.v")).when(F.col("a").isNull(), F.col("b.v")).otherwise(between)
    deviation = F.coalesce(F.try_divide(F.abs(expected - F.col("value")), F.abs(F.nullif("value", F.lit(0)))), F.lit(0))
    rows = rows.withColumn("expected", F.when(~F.col("good"), expected))
    action = (
        F.when(F.col("good"), "reliable").when(F.col("expected").isNull(), "no_neighbour")
        .when(deviation <= F.lit(min_deviation).cast("decimal(9,6)"), "close_enough").otherwise("repaired")
    )
    rows = rows.withColumn("action", action)
    changed = F.col("action") == "repaired"
    return rows.withColumns({
        "new_value": F.when(changed, F.col("expected")).otherwise(F.col("value")),
        "repair_reason": F.when(changed, F.when(is_forced, "manual_forced_correction").otherwise(
            "unreliable_advertiser_backfill_correction")),
    }).drop("good", "at", "b", "a")


def apply_repair(repaired: DataFrame, corrected_at: datetime) -> DataFrame:
    """Writes the new value and an audit record into the payload."""
    changed = F.col("action") == "repaired"
    audit = F.to_json(F.struct(
        F.col("value").cast("string").alias("original_value"), F.col("repair_reason").alias("reason"),
        F.lit(corrected_at.isoformat()).alias("corrected_at")))
    body = F.regexp_replace(F.coalesce("raw_payload", F.lit("{}")), r"\}\s*$", "")
    glue = F.when(F.trim(body) == "{", "").otherwise(",")
    payload = F.concat(body, glue, F.lit('"corrected":'), audit, F.lit("}"))
    return repaired.withColumns({
        "raw_payload": F.when(changed, payload).otherwise(F.col("raw_payload")), "value": F.col("new_value"),
    }).drop("new_value", "expected", "action", "repair_reason")


def revert_repair(df: DataFrame) -> DataFrame:
    """Puts original values back from the audit record."""
    original = F.get_json_object("raw_payload", "$.corrected.original_value").try_cast("decimal(18,6)")
    return df.withColumns({
        "reverted": original.isNotNull(), "value": F.coalesce(original, F.col("value")),
        "reverted_reason": F.get_json_object("raw_payload", "$.corrected.reason"),
    })
