"""Product events, pipeline runs and impact metrics."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CATEGORIES, CHANNELS
from ..functions.values import micros
from .scan import Blocks, attach, previous, running, total

RUN_COUNTERS = (
    "raw_collected_count", "usable_count", "quality_dropped_count", "deduplicated_count",
    "duplicate_dropped_count", "summary_candidates_count", "summaries_count", "ai_dedup_count",
)


def _ts(value: datetime) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def event_counts(events: DataFrame, since: datetime) -> DataFrame:
    return events.where(F.col("created_at") >= _ts(since)).groupBy("event_name").agg(F.count("*").alias("n"))


def event_totals(events: DataFrame, since: datetime, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return events.where(F.col("created_at") >= _ts(since)).agg(
        F.count("*").alias("events"), distinct(F.col("session_id")).alias("unique_sessions"),
        distinct(F.col("user_id")).alias("unique_users"))


def event_summary(events: DataFrame, since: datetime) -> DataFrame:
    """Counts per event name next to the distinct sessions and users of the window."""
    return attach(event_counts(events, since), event_totals(events, since).drop("events"))


def daily_sketches(events: DataFrame, lg_k: int = 12) -> DataFrame:
    """(day, event_name, n, session_sketch, user_sketch): one row per day and name, to be kept and merged for any range.

    The sketches are HyperLogLog with 2^``lg_k`` registers: an estimate is off by about 1.04 / 2^(lg_k / 2) of the count
    (1.6 % for 12), however many days are merged, and a row has a few kilobytes whatever the number of events.
    """
    return events.groupBy(F.to_date("created_at").alias("day"), "event_name").agg(
        F.count("*").alias("n"), F.hll_sketch_agg(F.col("session_id").cast("string"), F.lit(lg_k)).alias("session_sketch"),
        F.hll_sketch_agg(F.col("user_id").cast("string"), F.lit(lg_k)).alias("user_sketch"))


def range_summary(sketches: DataFrame, ranges: DataFrame) -> DataFrame:
    """Counts and estimated distinct sessions and users of every range and name, from daily rows alone.

    ``ranges(range_id, first_day, last_day)`` is a list that someone asked for; it is broadcast if it is short.
    """
    asked = F.broadcast(ranges) if ranges.count() <= 10_000 else ranges
    met = sketches.join(asked, F.col("day").between(F.col("first_day"), F.col("last_day")))
    return met.groupBy("range_id", "event_name").agg(
        F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("session_sketch")).alias("sessions"),
        F.hll_sketch_estimate(F.hll_union_agg("user_sketch")).alias("users"))


def run_totals(runs: DataFrame, since: datetime) -> DataFrame:
    """Sums of the run counters, kept and removed rows of the semantic dedup apart."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c.removesuffix("_count")) for c in RUN_COUNTERS if c != "ai_dedup_count"]
    return runs.where(F.col("started_at") >= _ts(since)).agg(
        F.count("*").alias("total_runs"), F.count_if(F.col("status") == "failed").alias("failed_runs"), *sums,
        F.coalesce(F.sum("ai_dedup_count"), F.lit(0)).alias("ai_dedup_kept"),
        F.coalesce(F.sum(F.greatest(F.col("summary_candidates_count") - F.col("ai_dedup_count"), F.lit(0))), F.lit(0)).alias("ai_dedup_removed"))


def returning_rate(events: DataFrame, since: datetime, cohort_days: int = 7) -> DataFrame:
    """Share of current sessions that were seen in the days before. One shuffle."""
    start = since - timedelta(days=cohort_days)
    rows = events.where(F.col("session_id").isNotNull() & (F.col("created_at") >= _ts(start)))
    sessions = rows.groupBy("session_id").agg(
        F.bool_or(F.col("created_at") >= _ts(since)).alias("now"), F.bool_or(F.col("created_at") < _ts(since)).alias("before"))
    total = sessions.agg(F.count_if("now").alias("current_sessions"), F.count_if(F.col("now") & F.col("before")).alias("returning_sessions"))
    rate = F.coalesce(F.round(F.try_divide("returning_sessions", "current_sessions"), 4), F.lit(0.0))
    return total.select(F.lit(cohort_days).alias("cohort_days"), "current_sessions", "returning_sessions", rate.alias("returning_rate"))


def category_counts(rows: DataFrame, day_column: Column, day: date) -> DataFrame:
    """Rows per category of a day with label and total; empty categories do not appear."""
    labels = rows.sparkSession.createDataFrame(list(CATEGORIES.items()), "category string, label string")
    counts = rows.where(day_column == F.lit(day)).groupBy("category").agg(F.count("*").alias("n"))
    counts = counts.join(F.broadcast(labels), "category")
    return attach(counts, counts.agg(F.sum("n").alias("total")))


def latest_day(sources: Sequence[tuple[DataFrame, Column]], requested: date) -> DataFrame:
    """Latest day up to ``requested`` with data in any source, and whether it is a fallback."""
    maxima = None
    for df, day in sources:
        one = df.where(day <= F.lit(requested)).agg(F.max(day).alias("d"))
        maxima = one if maxima is None else maxima.unionByName(one)
    return maxima.agg(F.max("d").alias("effective_date")).select(
        F.lit(requested).alias("requested_date"), "effective_date",
        F.coalesce(F.col("effective_date") != F.lit(requested), F.lit(False)).alias("is_fallback"))


def impact_daily(articles: DataFrame, summaries: DataFrame, runs: DataFrame, minutes_per_page: float = 0.5, mb_per_page: float = 0.8) -> DataFrame:
    """Impact figures of every day.

    Collected, unique and summary counts are real rows. What cannot be counted from rows
    comes from the day's newest run that has metrics; inserted and updated are summed.
    """
    a = articles.where("published_at IS NOT NULL").groupBy(F.to_date("published_at").alias("day")).agg(
        F.count("*").alias("a_collected"), F.count_if(F.col("duplicate_of_article_id").isNull()).alias("a_unique"))
    s = summaries.groupBy(F.col("summary_date").alias("day")).agg(F.count("*").alias("s_count"))
    counters = ("raw_collected_count", "usable_count", "quality_dropped_count", "deduplicated_count", "duplicate_dropped_count",
                "ranked_count", "summary_candidates_count", "summaries_count")
    clean = runs.withColumns({c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in (*counters, "inserted_count", "updated_count")})
    with_metrics = F.coalesce("used_cached_articles", F.lit(False)) | F.coalesce("used_cached_summaries", F.lit(False))
    for c in counters:
        with_metrics = with_metrics | (F.col(c) > 0)
    cached = F.coalesce("used_cached_articles", F.lit(False)) | F.coalesce("used_cached_summaries", F.lit(False))
    r = clean.where(with_metrics).groupBy(F.to_date("started_at").alias("day")).agg(
        F.max_by(F.struct(*counters, cached.alias("cached")), F.struct("started_at", "id")).alias("run"),
        F.sum("inserted_count").alias("inserted"), F.sum("updated_count").alias("updated"))
    days = a.join(s, "day", "full").join(r, "day", "full")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("a_collected", "a_unique", "s_count", "inserted", "updated")}
    days = days.withColumns(zero)
    has_run = F.col("run").isNotNull()

    def either(first: Column, second: Column) -> Column:
        return F.when(first > 0, first).otherwise(second)

    days = days.withColumns({
        "collected_articles": F.when(has_run, either(F.col("a_collected"), F.col("run.raw_collected_count"))).otherwise(F.col("a_collected")),
        "unique_articles": F.when(has_run, either(F.col("a_unique"), F.col("inserted"))).otherwise(F.col("a_unique")),
        "summaries": F.when(has_run, either(F.col("s_count"), F.col("run.summaries_count"))).otherwise(F.col("s_count")),
    })
    c, u, n = F.col("collected_articles"), F.col("unique_articles"), F.col("summaries")
    pages = F.greatest(c - n, F.lit(0))
    rate = F.when(c > 0, F.round(1 - n / c, 4)).otherwise(0.0)
    return days.select(
        "day", c, u, n,
        F.when(has_run, "pipeline_run").when((c > 0) | (n > 0), "derived").otherwise("empty").alias("data_source"),
        F.when(has_run, either(F.col("run.usable_count"), c)).otherwise(c).alias("usable_articles"),
        F.when(has_run, either(F.col("run.ranked_count"), c)).otherwise(u).alias("ranked_articles"),
        F.when(has_run, either(F.col("run.summary_candidates_count"), u)).otherwise(u).alias("summary_candidates"),
        F.coalesce("run.quality_dropped_count", F.lit(0)).alias("quality_dropped_articles"),
        F.coalesce("run.duplicate_dropped_count", F.lit(0)).alias("duplicate_dropped_articles"),
        F.greatest(c - u, F.lit(0)).alias("duplicate_articles"),
        F.col("inserted").alias("inserted_articles"), F.col("updated").alias("updated_articles"),
        F.coalesce("run.cached", F.lit(False)).alias("cache_reused"),
        F.greatest(F.least(rate, F.lit(1.0)), F.lit(0.0)).alias("reduction_rate"),
        pages.alias("estimated_pages_avoided"),
        F.round(pages * minutes_per_page, 1).alias("estimated_minutes_saved"),
        F.round(pages * mb_per_page, 1).alias("estimated_data_saved_mb"))


def impact_funnel(impact: DataFrame) -> DataFrame:
    """The five funnel steps of every day as rows."""
    steps = (("Recolectadas", "collected_articles"), ("Utiles", "usable_articles"), ("Unicas", "unique_articles"),
             ("Candidatas", "summary_candidates"), ("Briefs", "summaries"))
    return impact.select("day", F.posexplode(F.array(*[
        F.struct(F.lit(label).alias("label"), F.col(c).cast("bigint").alias("value")) for label, c in steps])).alias("step", "s")
    ).select("day", "step", "s.label", "s.value")


def run_funnel(runs: DataFrame) -> DataFrame:
    """Counters of each run with the day's briefs so far; runs without any work are left out."""
    fields = ("raw_collected_count", "usable_count", "inserted_count", "summaries_count", "summary_candidates_count", "ranked_count")
    clean = runs.withColumns({c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in fields})
    worked = clean.where(F.greatest(*[F.col(c) for c in fields[:4]]) > 0).withColumn("day", F.to_date("started_at"))
    out = running(worked, ["day"], [F.col("started_at"), F.col("id")], {"briefs_so_far": total(F.col("summaries_count").cast("bigint"))})
    return out.select("id", "day", "started_at", *fields, "briefs_so_far")


def dashboard(events: DataFrame, runs: DataFrame, subscribers: DataFrame, since: datetime, cohort_days: int = 7) -> DataFrame:
    """One row: event totals, run totals, returning sessions, active subscribers."""
    active = subscribers.agg(F.count_if("is_active").alias("active_subscribers"))
    out = event_totals(events, since)
    for part in (run_totals(runs, since), returning_rate(events, since, cohort_days), active):
        out = attach(out, part)
    return out


def delivery_stats(deliveries: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Sent and failed messages per channel; channels without messages show zeros."""
    all_channels = deliveries.sparkSession.createDataFrame([(c,) for c in channels], "channel string")
    done = deliveries.groupBy("channel").agg(
        F.count_if("delivered").alias("sent"), F.count_if(~F.col("delivered")).alias("failed"))
    return F.broadcast(all_channels).join(done, "channel", "left").select(
        "channel", F.coalesce("sent", F.lit(0)).alias("sent"), F.coalesce("failed", F.lit(0)).alias("failed"))


def source_stats(articles: DataFrame) -> DataFrame:
    """Collected, reused and dropped rows per source in one pass."""
    return articles.groupBy("source").agg(
        F.count("*").alias("scraped"), F.count_if("detail_reused").alias("reused"),
        F.count_if(F.col("drop_reason").isNotNull()).alias("dropped"))


def sessionize(events: DataFrame, gap_minutes: int = 30, key: str = "user_id", ts: str = "created_at") -> DataFrame:
    """Sessions by inactivity gap: one row per session with its span and event count."""
    order = [F.col(ts), F.col("event_id")]
    rows = events.select(key, ts, "event_id")
    blocks = Blocks(rows, [key], order)
    rows = blocks.add(rows, {"prev": previous(F.col(ts))})
    new = F.col("prev").isNull() | (micros(F.col(ts)) - micros(F.col("prev")) >= gap_minutes * 60_000_000)
    rows = rows.withColumn("starts", F.when(new, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    rows = blocks.add(rows, {"session_no": total(F.col("starts"))})
    return rows.groupBy(key, "session_no").agg(
        F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count("*").alias("events"))


def event_windows(events: DataFrame, size: str = "1 hour", ts: str = "created_at") -> DataFrame:
    """Counts and distinct sessions per event name and tumbling window (batch form)."""
    return events.groupBy(F.window(F.col(ts).cast("timestamp"), size).alias("w"), "event_name").agg(
        F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions")
    ).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_name", "n", "sessions")
