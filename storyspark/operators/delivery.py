"""Subscribers, eligibility and delivery items."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CATEGORIES, SummaryConfig
from ..functions import text as t
from .scan import first_per, running, top_per, total
from .summaries import story_key


def known_zone(zone: Column, default: str = "America/La_Paz") -> Column:
    """The zone if it exists, else the default."""
    names = sorted(n for n in available_timezones() if "/" in n or n == "UTC")
    return F.when(F.array_contains(F.array(*[F.lit(n) for n in names]), zone), zone).otherwise(F.lit(default))


def eligible_subscribers(subscribers: DataFrame, as_of_utc: datetime, hour: int | None) -> DataFrame:
    """Active subscribers of an hour whose frequency allows their local weekday."""
    local = F.convert_timezone(F.lit("UTC"), known_zone(F.col("timezone")), F.lit(as_of_utc).cast("timestamp_ntz"))
    day = F.weekday(local)
    frequency = F.lower(F.coalesce(F.nullif("frequency", F.lit("")), F.lit("diario")))
    right_day = (
        F.when(frequency == "dias_habiles", day < 5).when(frequency == "tres_veces_semana", day.isin(0, 2, 4))
        .when(frequency == "semanal", day == 0).otherwise(F.lit(True)))
    keep = F.col("is_active")
    if hour is not None:
        keep = keep & (F.coalesce("preferred_hour", F.lit(9)) == hour) & right_day
    return subscribers.where(keep).withColumn("local_weekday", day)


#: Sets of categories that may be broadcast with their items.
BROADCAST_SETS = 1024


def _askers(eligible: DataFrame, categories: Sequence[str]) -> DataFrame:
    """(subscriber_id, channel, wanted): the sorted set of categories that a subscriber gets; without a known one no row."""
    everything = F.array(*[F.lit(c) for c in categories])
    wanted = F.when(F.coalesce(F.size("categories") > 0, F.lit(False)), F.array_distinct("categories")).otherwise(everything)
    asked = eligible.select(F.col("id").alias("subscriber_id"), "channel", F.explode(wanted).alias("category")).where(F.col("category").isin(*categories))
    return asked.groupBy("subscriber_id").agg(F.min("channel").alias("channel"), F.array_sort(F.collect_set("category")).alias("wanted"))


def _item_lists(askers: DataFrame, summaries: DataFrame, categories: Sequence[str], cfg: SummaryConfig) -> DataFrame:
    """First ``delivery_rows`` distinct stories in summary order per set of categories that is ``wanted``.

    An item among the first k has fewer than k distinct stories before it in its own category, so k distinct stories per
    category are all that can be needed. They are chosen without their texts, which are read for these few only.
    """
    def short(rows: DataFrame) -> DataFrame:
        return top_per(first_per(rows, ["category", "story_key"], [F.col("ord")]), ["category"], [F.col("ord")], cfg.delivery_rows)

    known = summaries.where(F.col("category").isin(*categories))
    chosen = short(known.select("id", "category", "ord", story_key(t.title_key(F.col("title"))).alias("story_key"))).select("id")
    few = short(known.join(F.broadcast(chosen), "id", "left_semi").withColumn("story_key", story_key(t.title_key(F.col("title")))))
    sets = askers.select("wanted").distinct().withColumn("category", F.explode("wanted"))
    pairs = sets.join(F.broadcast(few.withColumnRenamed("id", "summary_id")), "category")
    return top_per(first_per(pairs, ["wanted", "story_key"], [F.col("ord")]), ["wanted"], [F.col("ord")], cfg.delivery_rows, "position")


def _per_subscriber(askers: DataFrame, per_set: DataFrame, categories: Sequence[str]) -> DataFrame:
    few = 2 ** len(categories) <= BROADCAST_SETS
    return askers.join(F.broadcast(per_set) if few else per_set, "wanted").drop("wanted")


def delivery_items(
    eligible: DataFrame, summaries: DataFrame, categories: Sequence[str] = tuple(CATEGORIES), cfg: SummaryConfig = SummaryConfig(),
) -> DataFrame:
    """First ``delivery_rows`` distinct stories per subscriber in summary order.

    Items depend only on the set of categories, so they are found per set and joined to the subscribers that want it:
    no texts are shuffled or sorted per subscriber.
    """
    askers = _askers(eligible, categories)
    return _per_subscriber(askers, _item_lists(askers, summaries, categories, cfg), categories)


def delivery_messages(
    eligible: DataFrame, summaries: DataFrame, categories: Sequence[str] = tuple(CATEGORIES), cfg: SummaryConfig = SummaryConfig(),
) -> DataFrame:
    """One message per subscriber over :func:`delivery_items`; the text is put together once per set of categories."""
    askers = _askers(eligible, categories)
    texts = render_messages(_item_lists(askers, summaries, categories, cfg), by=("wanted",))
    return _per_subscriber(askers, texts, categories)


def render_messages(
    items: DataFrame, header: str = "Brief del dia\n\n", footer: str = "---\n/preferencias | /cancelar", by: Sequence[str] = ("subscriber_id", "channel"),
) -> DataFrame:
    """One message text per ``by``; at most ``delivery_rows`` items are joined."""

    def line(prefix: str, c: str) -> Column:
        return F.when(F.length(c) > 0, F.concat(F.lit(prefix), F.col(c), F.lit("\n"))).otherwise(F.lit(""))

    entry = F.concat(
        F.col("position").cast("string"), F.lit(". "), F.left("title", F.lit(80)), F.lit("\n   "), F.left("summary", F.lit(150)),
        F.lit("\n"), line("   Dato: ", "fact"), line("   ", "update_note"), F.lit("\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("position", entry.alias("entry")))), lambda s: s["entry"])
    return items.groupBy(*by).agg(
        F.concat(F.lit(header), F.array_join(parts, ""), F.lit(footer)).alias("message"), F.count("*").alias("n_items"))


def since_cursor(subscribers: DataFrame, summaries: DataFrame) -> DataFrame:
    """New items per subscriber since the last notification, and where the cursor moves.

    ``subscribers(id, categories, last_notified_at)``; ``summaries(id, category, created_at)``.
    Counts come from a running total per category: each cursor is looked up in the
    category's cumulative counts, so nobody's items are listed out. Subscribers without a
    cursor get the category's total and are not looked up.
    """
    asks = subscribers.where(F.col("is_active")).select(
        F.explode("categories").alias("category"), F.col("last_notified_at").alias("at"), F.col("id").alias("who"))
    items = summaries.select("category", F.col("created_at").alias("at"), F.col("id").cast("bigint").alias("who"), F.lit(False).alias("is_ask"))
    # items at the cursor's own time are already delivered: they sort before the question
    both = items.unionByName(asks.where(F.col("at").isNotNull()).withColumn("is_ask", F.lit(True)))
    n = F.when(F.col("is_ask"), F.lit(0)).otherwise(F.lit(1)).cast("bigint")
    seen = running(both, ["category"], [F.col("at"), F.col("is_ask"), F.col("who")], {"seen": total(n)}).where("is_ask").select("category", "who", "seen")
    every = seen.unionByName(asks.where(F.col("at").isNull()).select("category", "who", F.lit(0).cast("bigint").alias("seen")))
    totals = summaries.groupBy("category").agg(F.count("*").alias("total"), F.max("created_at").alias("newest"))
    per_ask = every.join(totals, "category", "left").withColumn("fresh", F.coalesce(F.col("total") - F.col("seen"), F.lit(0)))
    return per_ask.groupBy(F.col("who").alias("subscriber_id")).agg(
        F.sum("fresh").alias("new_items"),
        F.max(F.when(F.col("fresh") > 0, F.col("newest"))).alias("new_cursor"))
