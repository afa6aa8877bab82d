"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import EVENT_NAMES, SummaryConfig
from ..functions.urls import url_fingerprint
from ..operators import alerts, indicators, quality
from ..operators.dedupe import dedup_url
from ..operators.select import diverse_topk


def event_counts(
    stream: DataFrame, size: str = "1 hour", delay: str = "1 hour", slide: str | None = None, names: Sequence[str] = EVENT_NAMES
) -> DataFrame:
    """Counts and distinct sessions (sketch) per window of accepted events.

    ``stream(event_name, session_id, created_at)``; the watermark needs a zoned time.
    """
    window = F.window("at", size, slide) if slide else F.window("at", size)
    return (
        stream.where(F.col("event_name").isin(*names)).withColumn("at", F.col("created_at").cast("timestamp"))
        .withWatermark("at", delay).groupBy(window.alias("w"), "event_name")
        .agg(F.count("*").alias("n"), F.approx_count_distinct("session_id").alias("sessions"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_name", "n", "sessions"))


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions by inactivity gap per user."""
    return (
        stream.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", delay)
        .groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
        .select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events"))


def dedup_articles(stream: DataFrame, horizon: str = "3 days") -> DataFrame:
    """First article per URL fingerprint within the horizon; state is dropped behind it."""
    keyed = stream.withColumns({
        "at": F.col("collected_at").cast("timestamp"),
        "url_key": F.coalesce(F.nullif(url_fingerprint(F.col("url")), F.lit("")), F.concat(F.lit("row-"), F.col("id").cast("string")))})
    return keyed.withWatermark("at", horizon).dropDuplicatesWithinWatermark(["url_key"])


def _earlier(folder: str, schema: str, epoch: int, spark: Any) -> DataFrame | None:
    """What batches before ``epoch`` have stored in ``folder``."""
    return None if epoch == 0 else spark.read.schema(f"{schema}, epoch bigint").parquet(folder).where(F.col("epoch") < epoch)


def run_change_only(stream: DataFrame, key: Sequence[str], sink: str, state: str, checkpoint: str) -> None:
    """Points whose day or value differs from the last one of their series, batch by batch.

    The state is a table with the last point per series. A batch puts it before its own points, so the batch operator
    decides all of them in one window per series, with hot series cut into blocks; nothing is gathered in a worker. A batch
    that is run again replaces its own folders and reads only the state of those before it.
    """
    fields = [*key, "id", "observed_at", "collected_at", "value"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.select(*fields).schema)

    def handle(batch: DataFrame, epoch: int) -> None:
        points = batch.select(*fields).where(F.col("value").isNotNull()).withColumn("__new", F.lit(True))
        before = _earlier(state, schema, epoch, batch.sparkSession)
        if before is not None:
            points = points.unionByName(before.where(F.col("epoch") == epoch - 1).select(*fields, F.lit(False).alias("__new")))
        points = points.persist()
        done = indicators.change_only(points, key)
        done.where("__new and outcome = 'inserted'").select(
            *fields, F.coalesce("observed_at", F.to_date("collected_at")).alias("day")).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
        order = F.struct("collected_at", "id")
        last = points.groupBy(*key).agg(F.max_by(F.struct("id", "observed_at", "collected_at", "value"), order).alias("l")).select(*key, "l.*")
        last.select(*fields).write.mode("overwrite").parquet(f"{state}/epoch={epoch}")
        points.unpersist()

    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def price_alerts(stream: DataFrame, threshold: float | str = "0.01") -> DataFrame:
    """Alerts against the last delivered alert; state is the reference value of a code.

    A worker gathers a batch's points of a code; :func:`run_price_alerts` does not.
    """
    limit = Fraction(str(threshold))
    points = stream.where(F.col("value").isNotNull()).select(
        "indicator_code", "id", F.col("collected_at").cast("timestamp").alias("collected_at"),
        alerts.millionths(F.col("value")).alias("value"), F.coalesce("delivered", F.lit(True)).alias("delivered"))

    def walk(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reference = state.get[0] if state.exists else None
        batch = pd.concat(list(frames)).sort_values(["collected_at", "id"])
        out, reference = alerts.fold(zip(batch["id"], map(int, batch["value"]), batch["delivered"]), reference, limit)
        if reference is not None:
            state.update((reference,))
        yield pd.DataFrame(out, columns=["id", "reference", "value", "delivered"]).assign(indicator_code=key[0])

    found = points.groupBy("indicator_code").applyInPandasWithState(
        walk, "id bigint, reference bigint, value bigint, delivered boolean, indicator_code string", "reference bigint", "append", GroupStateTimeout.NoTimeout)
    return alerts.with_ratio(found)


def run_price_alerts(stream: DataFrame, sink: str, state: str, checkpoint: str, threshold: float | str = "0.01", block: str = "hour") -> None:
    """Alerts against the last delivered alert, batch by batch; a worker holds the points of one time block of a code.

    The state is a table with the reference per code, from which the batch operator starts. A batch that is run again
    replaces its own folders and reads only the state of those before it.
    """
    schema = "indicator_code string, reference bigint"

    def handle(batch: DataFrame, epoch: int) -> None:
        before = _earlier(state, schema, epoch, batch.sparkSession)
        start = None if before is None else before.where(F.col("epoch") == epoch - 1).select("indicator_code", "reference")
        found, after = alerts.alerts_from(batch, start, threshold, block)
        found.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
        after.write.mode("overwrite").parquet(f"{state}/epoch={epoch}")

    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what is available into a Parquet folder."""
    query = (
        df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()


@dataclass(frozen=True)
class LateRule:
    """Rows more than ``delay`` behind the greatest event time of earlier batches are late; rows dated more than ``ahead``
    after their event time lie in the future."""

    at: str = "collected_at"
    delay: str = "3 days"
    dated: str = "published_at"
    ahead: str = "1 day"


def run_batches(
    stream: DataFrame, process: Callable[[DataFrame], DataFrame], sink: str, metrics_sink: str, checkpoint: str,
    counters: dict[str, Any], late: LateRule | None = None, late_sink: str | None = None,
) -> None:
    """Micro-batch runner: one pass per batch writes rows and the run's counters.

    ``counters`` maps names to aggregates over the processed rows, which ``observe`` reads while they are written. With
    ``late``, rows that are late or in the future are not processed: they go to ``late_sink``, and the metrics count them in
    ``late`` and ``future`` beside all rows in ``raw`` and keep the greatest event time, which is the state that later batches
    read. A batch that is run again replaces its own output folders, so the result stays the same.
    """
    from pyspark.sql import Observation

    kept = "raw bigint, late bigint, future bigint, max_at timestamp_ntz"
    names = ", ".join(f"{n} bigint" for n in counters)

    def handle(batch: DataFrame, epoch: int) -> None:
        spark, extra = batch.sparkSession, []
        if late is not None:
            before = _earlier(metrics_sink, f"run bigint, {names}, {kept}", epoch, spark)
            edge = None if before is None else before.agg(F.max("max_at")).first()[0]
            at = F.col(late.at)
            is_late = F.coalesce(at < F.lit(edge).cast("timestamp_ntz") - F.expr(f"INTERVAL {late.delay}"), F.lit(False)) if edge else F.lit(False)
            ahead = F.coalesce(F.col(late.dated) > at + F.expr(f"INTERVAL {late.ahead}"), F.lit(False))
            marked = batch.withColumns({"__late": is_late, "__future": ahead & ~is_late}).persist()
            marked.where("__late or __future").withColumnsRenamed({"__late": "late", "__future": "future"}).write.mode("overwrite").parquet(f"{late_sink}/epoch={epoch}")
            extra = list(marked.agg(F.count("*"), F.count_if("__late"), F.count_if("__future"), F.max(at.cast("timestamp_ntz"))).first())
            batch = marked.where("not __late and not __future").drop("__late", "__future")
        seen = Observation(f"run_{epoch}")
        rows = process(batch).observe(seen, *[expr.alias(name) for name, expr in counters.items()])
        rows.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
        values = {name: int(seen.get[name] or 0) for name in counters}
        schema = f"run bigint, {names}" + (f", {kept}" if late is not None else "")
        row = spark.createDataFrame([(epoch, *values.values(), *extra)], schema)
        row.coalesce(1).write.mode("overwrite").parquet(f"{metrics_sink}/epoch={epoch}")
        if late is not None:
            marked.unpersist()

    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def selection_steps(batch: DataFrame, summarised: DataFrame | None = None, cfg: SummaryConfig = SummaryConfig()) -> DataFrame:
    """Rows of a batch with the steps that they reach: usable, unique, ranked, candidate, summary_due.

    Unique is the first usable row of a URL, ranked a unique row with a score, candidates are the diverse best per category, and
    a summary is due for candidates that have none.
    """
    marked = batch.withColumn("usable", quality.usable_text())
    unique = dedup_url(marked.where("usable")).select("id", F.lit(True).alias("__unique"))
    marked = marked.join(unique, "id", "left").withColumn("unique", F.coalesce("__unique", F.lit(False))).drop("__unique")
    marked = marked.withColumn("ranked", F.col("unique") & F.col("score").isNotNull())
    best = diverse_topk(marked.where("ranked"), cfg).select("id", F.lit(True).alias("__best"))
    marked = marked.join(best, "id", "left").withColumn("candidate", F.coalesce("__best", F.lit(False))).drop("__best")
    due = F.col("candidate")
    if summarised is not None:
        marked = marked.join(summarised.select("id", F.lit(True).alias("__told")).distinct(), "id", "left")
        due = due & F.col("__told").isNull()
    return marked.withColumn("summary_due", due).drop("__told")


def run_counters() -> dict[str, Any]:
    """Counters of a run over rows of :func:`selection_steps`."""
    return {f"{c}_count": F.count_if(c) for c in ("usable", "unique", "ranked", "candidate", "summary_due")}
