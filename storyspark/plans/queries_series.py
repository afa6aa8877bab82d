"""Registered queries: events, runs, indicators, delivery and streams."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators import analytics as an
from ..operators import delivery as dl
from ..operators import indicators as ic
from ..operators import quality as q
from ..operators import select
from ..operators.dedupe import dedup_url
from ..session import cut, ensure_checkpoint_dir
from ..sources import tables
from ..streaming import jobs
from ..functions.urls import normalize_url
from . import fixtures as fx
from .queries_core import _NH, _NP, _NQ
from .registry import query

SINCE = datetime(2024, 1, 15)


# --- events and runs ---------------------------------------------------------
@query("event_summary", f"""WITH {fx.EVENTS}, w AS (SELECT * FROM ev WHERE created_at >= TIMESTAMP '2024-01-15')
SELECT event_name, count(*) AS n, (SELECT count(DISTINCT session_id) FROM w) AS unique_sessions, (SELECT count(DISTINCT user_id) FROM w) AS unique_users FROM w GROUP BY event_name""")
def _(spark, sf):
    return an.event_summary(fx.events(spark, sf), SINCE)


_TOTALS = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c.removesuffix('_count')}" for c in an.RUN_COUNTERS if c != "ai_dedup_count")
_RUN_SUM = f"""count(*) AS total_runs, count(*) FILTER (WHERE status = 'failed') AS failed_runs, {_TOTALS}, coalesce(sum(ai_dedup_count), 0)::BIGINT AS ai_dedup_kept,
coalesce(sum(greatest(summary_candidates_count - ai_dedup_count, 0)), 0)::BIGINT AS ai_dedup_removed"""


@query("run_totals", f"WITH {fx.RUNS} SELECT {_RUN_SUM} FROM runs WHERE started_at >= TIMESTAMP '2024-01-15'")
def _(spark, sf):
    return an.run_totals(fx.runs(spark, sf), SINCE)


_RET = """cu AS (SELECT DISTINCT session_id FROM ev WHERE created_at >= TIMESTAMP '2024-01-18'), pr AS (SELECT DISTINCT session_id FROM ev WHERE created_at >= TIMESTAMP '2024-01-11' AND created_at < TIMESTAMP '2024-01-18'),
rt AS (SELECT (SELECT count(*) FROM cu) AS current_sessions, (SELECT count(*) FROM cu JOIN pr USING (session_id)) AS returning_sessions)"""


@query("returning_rate", f"WITH {fx.EVENTS}, {_RET} SELECT 7 AS cohort_days, *, coalesce(round(returning_sessions / nullif(current_sessions, 0), 4), 0)::DOUBLE AS returning_rate FROM rt")
def _(spark, sf):
    return an.returning_rate(fx.events(spark, sf), datetime(2024, 1, 18), 7)


@query("dashboard", f"""WITH {fx.EVENTS}, {fx.RUNS}, {fx.SUBSCRIBERS}, {_RET}, e AS (SELECT count(*) AS events, count(DISTINCT session_id) AS unique_sessions, count(DISTINCT user_id) AS unique_users FROM ev WHERE created_at >= TIMESTAMP '2024-01-18'),
r AS (SELECT {_RUN_SUM} FROM runs WHERE started_at >= TIMESTAMP '2024-01-18')
SELECT *, 7 AS cohort_days, coalesce(round(returning_sessions / nullif(current_sessions, 0), 4), 0)::DOUBLE AS returning_rate, (SELECT count(*) FROM subs WHERE is_active) AS active_subscribers FROM e, r, rt""")
def _(spark, sf):
    return an.dashboard(fx.events(spark, sf), fx.runs(spark, sf), fx.subscribers(spark, sf), datetime(2024, 1, 18))


@query("category_counts", f"""WITH {fx.SUMMARIES}, c AS (SELECT 'recolectadas' AS view, category, count(*) AS n FROM stored WHERE is_active AND published_at::DATE = DATE '2024-01-20' GROUP BY category
UNION ALL SELECT 'resumenes', category, count(*) FROM summaries WHERE summary_date = DATE '2024-01-20' GROUP BY category)
SELECT view, category, upper(left(category, 1)) || substr(category, 2) AS label, n, sum(n) OVER (PARTITION BY view)::BIGINT AS total FROM c""")
def _(spark, sf):
    a = an.category_counts(fx.stored_articles(spark, sf).where("is_active"), F.to_date("published_at"), fx.DAY).withColumn("view", F.lit("recolectadas"))
    s = an.category_counts(fx.summaries(spark, sf), F.col("summary_date"), fx.DAY).withColumn("view", F.lit("resumenes"))
    return a.unionByName(s)


@query("latest_day_fallback", f"""WITH {fx.SUMMARIES}, {fx.RUNS}, m AS (SELECT max(published_at::DATE) AS d FROM stored WHERE published_at::DATE <= DATE '2024-02-12' UNION ALL SELECT max(summary_date) FROM summaries WHERE summary_date <= DATE '2024-02-12'
UNION ALL SELECT max(started_at::DATE) FROM runs WHERE started_at::DATE <= DATE '2024-02-12') SELECT DATE '2024-02-12' AS requested_date, max(d) AS effective_date, max(d) <> DATE '2024-02-12' AS is_fallback FROM m""")
def _(spark, sf):
    sources = [(fx.stored_articles(spark, sf), F.to_date("published_at")), (fx.summaries(spark, sf), F.col("summary_date")), (fx.runs(spark, sf), F.to_date("started_at"))]
    return an.latest_day(sources, date(2024, 2, 12))


_COUNTERS = ("raw_collected_count", "usable_count", "quality_dropped_count", "deduplicated_count", "duplicate_dropped_count", "ranked_count", "summary_candidates_count", "summaries_count")
_IMPACT = f"""{fx.SUMMARIES}, {fx.RUNS}, ia AS (SELECT published_at::DATE AS day, count(*) AS ac, count(*) FILTER (WHERE duplicate_of_article_id IS NULL) AS au FROM stored WHERE published_at IS NOT NULL GROUP BY 1),
js AS (SELECT summary_date AS day, count(*) AS sc FROM summaries GROUP BY 1), rm AS (SELECT *, started_at::DATE AS day FROM runs WHERE used_cached_articles OR {" OR ".join(f"{c} > 0" for c in _COUNTERS)}),
rr AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY started_at DESC, id DESC) AS rn, sum(greatest(inserted_count, 0)) OVER (PARTITION BY day)::BIGINT AS ins, sum(greatest(updated_count, 0)) OVER (PARTITION BY day)::BIGINT AS upd FROM rm),
rl AS (SELECT * FROM rr WHERE rn = 1), dd AS (SELECT coalesce(ia.day, js.day, rl.day) AS day, coalesce(ac, 0) AS ac, coalesce(au, 0) AS au, coalesce(sc, 0) AS sc, coalesce(ins, 0) AS ins, coalesce(upd, 0) AS upd, rl.id IS NOT NULL AS hr, rl.* EXCLUDE (day, ins, upd)
  FROM ia FULL JOIN js ON ia.day = js.day FULL JOIN rl ON rl.day = coalesce(ia.day, js.day)),
ff AS (SELECT *, CASE WHEN hr AND ac = 0 THEN raw_collected_count ELSE ac END AS c, CASE WHEN hr AND au = 0 THEN ins ELSE au END AS u, CASE WHEN hr AND sc = 0 THEN summaries_count ELSE sc END AS n FROM dd),
impact AS (SELECT day, c AS collected_articles, u AS unique_articles, n AS summaries, CASE WHEN hr THEN 'pipeline_run' WHEN c > 0 OR n > 0 THEN 'derived' ELSE 'empty' END AS data_source,
 CASE WHEN hr AND usable_count > 0 THEN usable_count ELSE c END AS usable_articles, CASE WHEN hr THEN CASE WHEN ranked_count > 0 THEN ranked_count ELSE c END ELSE u END AS ranked_articles,
 CASE WHEN hr AND summary_candidates_count > 0 THEN summary_candidates_count ELSE u END AS summary_candidates, coalesce(quality_dropped_count, 0) AS quality_dropped_articles, coalesce(duplicate_dropped_count, 0) AS duplicate_dropped_articles,
 greatest(c - u, 0) AS duplicate_articles, ins AS inserted_articles, upd AS updated_articles, coalesce(used_cached_articles, false) AS cache_reused,
 greatest(least(CASE WHEN c > 0 THEN round(1 - n / c, 4) ELSE 0 END, 1), 0)::DOUBLE AS reduction_rate, greatest(c - n, 0) AS estimated_pages_avoided, round(greatest(c - n, 0) * 0.5, 1)::DOUBLE AS estimated_minutes_saved, round(greatest(c - n, 0) * 0.8, 1)::DOUBLE AS estimated_data_saved_mb FROM ff)"""


def _impact(spark, sf):
    return an.impact_daily(fx.stored_articles(spark, sf), fx.summaries(spark, sf), fx.runs(spark, sf))


@query("impact_daily", f"WITH {_IMPACT} SELECT * FROM impact")
def _(spark, sf):
    return _impact(spark, sf)


@query("impact_funnel", f"""WITH {_IMPACT} SELECT day, s.step, s.label, s.value FROM (SELECT day, unnest([{{'step': 0, 'label': 'Recolectadas', 'value': collected_articles}}, {{'step': 1, 'label': 'Utiles', 'value': usable_articles}},
{{'step': 2, 'label': 'Unicas', 'value': unique_articles}}, {{'step': 3, 'label': 'Candidatas', 'value': summary_candidates}}, {{'step': 4, 'label': 'Briefs', 'value': summaries}}]) AS s FROM impact)""")
def _(spark, sf):
    return an.impact_funnel(_impact(spark, sf))


@query("run_funnel", f"""WITH {fx.RUNS} SELECT id, started_at::DATE AS day, started_at, raw_collected_count, usable_count, greatest(inserted_count, 0) AS inserted_count, summaries_count, summary_candidates_count, ranked_count,
sum(summaries_count) OVER (PARTITION BY started_at::DATE ORDER BY started_at, id)::BIGINT AS briefs_so_far FROM runs WHERE greatest(raw_collected_count, usable_count, inserted_count, summaries_count) > 0""")
def _(spark, sf):
    return an.run_funnel(fx.runs(spark, sf))


@query("delivery_stats", f"""WITH {fx.SUBSCRIBERS}, d AS (SELECT channel, id % 3 <> 0 AS ok FROM subs WHERE is_active AND channel <> 'whatsapp')
SELECT c AS channel, count(*) FILTER (WHERE ok) AS sent, count(*) FILTER (WHERE NOT ok) AS failed FROM (VALUES ('email'), ('telegram'), ('whatsapp')) v(c) LEFT JOIN d ON d.channel = c GROUP BY c""")
def _(spark, sf):
    rows = fx.subscribers(spark, sf).where("is_active AND channel <> 'whatsapp'").withColumn("delivered", F.expr("id % 3 <> 0"))
    return an.delivery_stats(rows)


@query("source_stats", f"""WITH {fx.ARTICLES} SELECT source, count(*) AS scraped, count(*) FILTER (WHERE published_at_from_detail) AS reused, count(*) FILTER (WHERE published_at > TIMESTAMP '2024-01-26' OR skipped_detail_reason IS NOT NULL OR published_at IS NULL
  OR length({fx.sql_match_key("concat_ws(' ', description, content)")}) = 0 OR {fx.sql_match_key("concat_ws(' ', description, content)")} = {fx.sql_match_key("title")}
  OR ({fx.sql_words("concat_ws(' ', description, content)")} < 8 AND length(trim(concat_ws(' ', description, content))) < 50)) AS dropped FROM articles GROUP BY source""")
def _(spark, sf):
    a = fx.articles(spark, sf)
    rows = a.withColumns({"detail_reused": F.col("published_at_from_detail"), "drop_reason": q.drop_reason(datetime(2024, 1, 25), ("description", "content"))})
    return an.source_stats(rows)


@query("sessionize", f"""WITH {fx.EVENTS}, l AS (SELECT *, lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at, event_id) AS p FROM ev),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(created_at) - epoch_us(p) >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY created_at, event_id)::BIGINT AS session_no FROM l)
SELECT user_id, session_no, min(created_at) AS session_start, max(created_at) AS session_end, count(*) AS events FROM s GROUP BY 1, 2""")
def _(spark, sf):
    return an.sessionize(fx.events(spark, sf))


@query("event_windows", f"""WITH {fx.EVENTS} SELECT date_trunc('hour', created_at) AS window_start, event_name, count(*) AS n, count(DISTINCT session_id) AS sessions FROM ev GROUP BY 1, 2""")
def _(spark, sf):
    return an.event_windows(fx.events(spark, sf))


# --- indicators --------------------------------------------------------------
@query("latest_indicators", f"""WITH {fx.INDICATORS} SELECT id, indicator_code, currency, value::DOUBLE AS value, collected_at FROM ind WHERE coalesce(observed_at, collected_at::DATE) = DATE '2024-01-20'
QUALIFY row_number() OVER (PARTITION BY source, indicator_code, currency, asset, side ORDER BY id DESC) = 1""")
def _(spark, sf):
    return ic.latest_values(fx.indicators(spark, sf), fx.DAY).select("id", "indicator_code", "currency", "value", "collected_at")


@query("indicator_history", f"""WITH {fx.INDICATORS}, c(indicator_code) AS (VALUES ('view'), ('purchase'), ('missing'))
SELECT indicator_code, id, value::DOUBLE AS value, observed_at, collected_at FROM c LEFT JOIN (SELECT * FROM ind WHERE collected_at >= TIMESTAMP '2024-01-15') i USING (indicator_code)""")
def _(spark, sf):
    codes = spark.createDataFrame([("view",), ("purchase",), ("missing",)], "indicator_code string")
    return ic.history(fx.indicators(spark, sf), codes, SINCE)


@query("series_points", f"""WITH {fx.INDICATORS} SELECT indicator_code, epoch(date_trunc('second', collected_at))::BIGINT AS time, arg_max(value, (collected_at, id))::DOUBLE AS value FROM ind GROUP BY 1, 2""")
def _(spark, sf):
    return ic.series_points(fx.indicators(spark, sf))


@query("rate_spread", f"""WITH {fx.INDICATORS}, l AS (SELECT arg_max(value, (collected_at, id)) FILTER (WHERE indicator_code = 'view') AS o, arg_max(value, (collected_at, id)) FILTER (WHERE indicator_code = 'purchase') AS p FROM ind)
SELECT o::DOUBLE AS official, p::DOUBLE AS parallel, p::DOUBLE - o::DOUBLE AS gap, (p::DOUBLE - o::DOUBLE) / nullif(o::DOUBLE, 0) * 100 AS gap_pct FROM l""")
def _(spark, sf):
    return ic.rate_spread(fx.indicators(spark, sf), "view", "purchase")


@query("change_only", f"""WITH {fx.INDICATORS}, l AS (SELECT *, coalesce(observed_at, collected_at::DATE) AS day, lag(coalesce(observed_at, collected_at::DATE)) OVER w AS pd, lag(value) OVER w AS pv FROM ind
WINDOW w AS (PARTITION BY source, indicator_code, currency, asset, side ORDER BY collected_at, id)) SELECT id, CASE WHEN pd = day AND pv = value THEN 'unchanged' ELSE 'inserted' END AS outcome FROM l""")
def _(spark, sf):
    return ic.change_only(fx.indicators(spark, sf)).select("id", "outcome")


_GOOD = "(k % 5 <> 0 AND k >= 10 AND round((50 + k % 50) / 100.0, 2) >= 0.8)"
_REPAIR = f"""{fx.INDICATORS}, g AS (SELECT *, {_GOOD} AS good FROM ind),
n AS (SELECT g.*, b.collected_at AS bt, b.value AS bv, a.collected_at AS nt, a.value AS nv FROM g
 ASOF LEFT JOIN (SELECT * FROM g WHERE good) b ON b.indicator_code = g.indicator_code AND b.collected_at < g.collected_at
 ASOF LEFT JOIN (SELECT * FROM g WHERE good) a ON a.indicator_code = g.indicator_code AND a.collected_at > g.collected_at),
x AS (SELECT *, CASE WHEN good THEN NULL WHEN bt IS NULL THEN nv WHEN nt IS NULL THEN bv
 ELSE (bv + (nv - bv) * ((epoch_us(collected_at) - epoch_us(bt)) / (epoch_us(nt) - epoch_us(bt)))::DECIMAL(18,12))::DECIMAL(18,6) END AS expected FROM n),
y AS (SELECT *, CASE WHEN good THEN 'reliable' WHEN expected IS NULL THEN 'no_neighbour' WHEN coalesce(abs(expected - value)::DOUBLE / nullif(abs(value)::DOUBLE, 0), 0) <= 0.03 THEN 'close_enough' ELSE 'repaired' END AS action FROM x)"""


@query("outlier_repair", f"WITH {_REPAIR} SELECT id, action, CASE WHEN action = 'repaired' THEN expected ELSE value END::DOUBLE AS new_value FROM y")
def _(spark, sf):
    return ic.repair_outliers(fx.indicators(spark, sf)).select("id", "action", "new_value")


@query("revert_repair", f"""WITH {_REPAIR} SELECT id, value::DOUBLE AS value, action = 'repaired' AS reverted FROM y""")
def _(spark, sf):
    repaired = ic.apply_repair(ic.repair_outliers(fx.indicators(spark, sf)), fx.AS_OF)
    return ic.revert_repair(repaired).select("id", "value", "reverted")


# prices of two digits, so that moves of exactly one per cent occur
_PRICE = "CAST(CAST(CAST(value AS BIGINT) % 60 AS DECIMAL(18,6)) * 0.05 + 10 AS DECIMAL(18,6))"
_ALERT_SQL = f"""WITH RECURSIVE {fx.INDICATORS}, p AS MATERIALIZED (SELECT indicator_code, id, {_PRICE} AS v, id % 10 <> 3 AS ok, row_number() OVER (PARTITION BY indicator_code ORDER BY collected_at, id) AS rn FROM ind),
w(indicator_code, rn, ref, id, oldref, v, ok, hit) AS (SELECT indicator_code, rn, v, id, v, v, ok, false FROM p WHERE rn = 1
 UNION ALL SELECT p.indicator_code, p.rn, CASE WHEN w.ref <> 0 AND abs(p.v - w.ref) >= 0.01 * abs(w.ref) AND p.ok THEN p.v ELSE w.ref END, p.id, w.ref, p.v, p.ok, w.ref <> 0 AND abs(p.v - w.ref) >= 0.01 * abs(w.ref)
 FROM w JOIN p ON p.indicator_code = w.indicator_code AND p.rn = w.rn + 1)
SELECT indicator_code, id, oldref::DOUBLE AS reference, v::DOUBLE AS value, (CAST(v * 1000000 AS BIGINT) - CAST(oldref * 1000000 AS BIGINT))::DOUBLE / CAST(oldref * 1000000 AS BIGINT)::DOUBLE AS change_ratio, ok AS delivered FROM w WHERE hit"""


def _priced(df: DataFrame) -> DataFrame:
    return df.withColumns({"delivered": F.expr("id % 10 <> 3"), "value": F.expr(_PRICE)})


@query("price_alerts", _ALERT_SQL)
def _(spark, sf):
    return al.price_alerts(_priced(fx.indicators(spark, sf)), threshold="0.01")


# --- delivery ----------------------------------------------------------------
_ELIG = f"""{fx.SUBSCRIBERS}, z AS (SELECT *, CASE WHEN timezone IN ('America/La_Paz', 'Europe/Madrid', 'Asia/Tokyo', 'UTC') THEN timezone ELSE 'America/La_Paz' END AS tz FROM subs),
wd AS (SELECT *, isodow(timezone(tz, timezone('UTC', TIMESTAMP '2024-01-21 23:30:00'))) - 1 AS local_weekday FROM z),
el AS (SELECT * FROM wd WHERE is_active AND preferred_hour = 12 AND (frequency = 'diario' OR (frequency = 'dias_habiles' AND local_weekday < 5) OR (frequency = 'tres_veces_semana' AND local_weekday IN (0, 2, 4)) OR (frequency = 'semanal' AND local_weekday = 0)))"""


def _eligible(spark, sf):
    return dl.eligible_subscribers(fx.subscribers(spark, sf), datetime(2024, 1, 21, 23, 30), 12)


@query("eligible_subscribers", f"WITH {_ELIG} SELECT id, local_weekday FROM el")
def _(spark, sf):
    return _eligible(spark, sf).select("id", "local_weekday")


_CATS4 = ["politica", "economia", "deportes", "sociedad"]
_ITEMS = f"""{fx.SUMMARIES}, {_ELIG}, sk AS (SELECT *, 'cluster:' || story_cluster_id AS story_key, row_number() OVER (ORDER BY score DESC, id) AS ord FROM summaries),
ct AS (SELECT DISTINCT el.id AS subscriber_id, channel, c.category FROM el, unnest(CASE WHEN len(categories) > 0 THEN categories ELSE ['politica', 'economia', 'deportes', 'sociedad'] END) c(category)),
pr AS (SELECT subscriber_id, channel, sk.* FROM ct JOIN sk ON sk.category = ct.category AND sk.category IN ('politica', 'economia', 'deportes', 'sociedad')),
un AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY subscriber_id, story_key ORDER BY score DESC, id) = 1),
nt AS (SELECT story_cluster_id AS note_of, 'Actualizacion: ' || max(title) AS update_note FROM summaries WHERE story_cluster_id IS NOT NULL GROUP BY 1 HAVING max(id) % 2 = 0),
it AS (SELECT un.*, nt.update_note, row_number() OVER (PARTITION BY subscriber_id ORDER BY score DESC, id) AS position FROM un LEFT JOIN nt ON nt.note_of = un.story_cluster_id QUALIFY position <= 10)"""


def _items(spark, sf):
    s = fx.summaries(spark, sf).withColumn("ord", F.struct((-F.col("score")).alias("s"), F.col("id").alias("i")))
    notes = s.where("story_cluster_id IS NOT NULL").groupBy(F.col("story_cluster_id").alias("story_id")).agg(
        F.concat(F.lit("Actualizacion: "), F.max("title")).alias("last_update_note"), F.max("id").alias("m")).where("m % 2 = 0").drop("m")
    return _eligible(spark, sf), select.with_update_notes(s, notes), _CATS4


@query("delivery_items", f"WITH {_ITEMS} SELECT subscriber_id, position, id AS summary_id, update_note FROM it")
def _(spark, sf):
    return dl.delivery_items(*_items(spark, sf)).select("subscriber_id", "position", "summary_id", "update_note")


@query("delivery_messages", f"""WITH {_ITEMS} SELECT subscriber_id, count(*) AS n_items, md5('Brief del dia' || chr(10) || chr(10) || string_agg(position || '. ' || left(title, 80) || chr(10) || '   ' || left(summary, 150) || chr(10)
|| CASE WHEN length(fact) > 0 THEN '   Dato: ' || fact || chr(10) ELSE '' END || CASE WHEN length(update_note) > 0 THEN '   ' || update_note || chr(10) ELSE '' END || chr(10), '' ORDER BY position) || '---' || chr(10) || '/preferencias | /cancelar') AS message_md5 FROM it GROUP BY 1""")
def _(spark, sf):
    return dl.delivery_messages(*_items(spark, sf)).select("subscriber_id", "n_items", F.md5("message").alias("message_md5"))


@query("since_cursor", f"""WITH {fx.SUMMARIES}, {fx.SUBSCRIBERS}, a AS (SELECT s.id AS subscriber_id, c.category, coalesce(last_notified_at, TIMESTAMP '0001-01-01') AS tm FROM subs s, unnest(categories) c(category) WHERE is_active)
SELECT subscriber_id, count(m.id) AS new_items, max(m.created_at) AS new_cursor FROM a LEFT JOIN summaries m ON m.category = a.category AND m.created_at > a.tm GROUP BY 1""")
def _(spark, sf):
    return dl.since_cursor(fx.subscribers(spark, sf), fx.summaries(spark, sf))


# --- streams, drained with availableNow and read back ------------------------
def _folders(spark: SparkSession) -> tuple[str, str, str]:
    """Input, output and checkpoint of a replayed stream, in the shared folder."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    return f"{base}/in", f"{base}/out", f"{base}/ckpt"


def _replay(df: DataFrame, batch: Column | None = None) -> tuple[DataFrame, str, str]:
    """Write a table to a folder and open it as a stream; with ``batch``, rows of one number are one micro-batch, in that order."""
    spark = df.sparkSession
    source, sink, ckpt = _folders(spark)
    if batch is None:
        df.write.parquet(source)
        return spark.readStream.schema(df.schema).parquet(source), sink, ckpt
    rows = cut(df.withColumn("__batch", batch))
    for n in sorted(r[0] for r in rows.select("__batch").distinct().collect()):
        rows.where(F.col("__batch") == n).drop("__batch").coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source), sink, ckpt


def _drain(out: DataFrame, sink: str, ckpt: str) -> DataFrame:
    jobs.run_available(out, sink, ckpt)
    return out.sparkSession.read.schema(out.schema).parquet(sink)


@query("stream_event_counts", f"""WITH {fx.EVENTS} SELECT date_trunc('hour', created_at) AS window_start, event_name, count(*) AS n FROM ev WHERE event_name <> 'client_error'
GROUP BY 1, 2 HAVING date_trunc('hour', created_at) + INTERVAL 1 HOUR <= (SELECT max(created_at) FROM ev WHERE event_name <> 'client_error') - INTERVAL 1 HOUR""")
def _(spark, sf):
    stream, sink, ckpt = _replay(fx.events(spark, sf).select("event_name", "session_id", "created_at"))
    out = _drain(jobs.event_counts(stream), sink, ckpt)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_name", "n")


@query("stream_sessions", f"""WITH {fx.EVENTS}, l AS (SELECT *, lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at) AS p FROM ev),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(created_at) - epoch_us(p) >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY created_at) AS n FROM l)
SELECT user_id, min(created_at) AS session_start, max(created_at) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM s GROUP BY user_id, n
HAVING max(created_at) + INTERVAL 30 MINUTE <= (SELECT max(created_at) FROM ev) - INTERVAL 1 HOUR""")
def _(spark, sf):
    """Sessions that the watermark has closed."""
    stream, sink, ckpt = _replay(fx.events(spark, sf).select("user_id", "created_at"))
    out = _drain(jobs.sessions(stream), sink, ckpt)
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "events")


_SERIES_KEY = "('feed|' || indicator_code || '|' || coalesce(currency, chr(0)) || '|' || chr(0) || '|' || chr(0))"


@query("stream_change_only", f"""WITH {fx.INDICATORS}, l AS (SELECT *, coalesce(observed_at, collected_at::DATE) AS day, lag(coalesce(observed_at, collected_at::DATE)) OVER w AS pd, lag(value) OVER w AS pv FROM ind
WINDOW w AS (PARTITION BY source, indicator_code, currency, asset, side ORDER BY collected_at, id)) SELECT id, day, value::DOUBLE AS value FROM l WHERE NOT coalesce(pd = day AND pv = value, false)""")
def _(spark, sf):
    """Replayed in order, four batches a run."""
    rows = fx.indicators(spark, sf).drop("raw_payload")
    stream, sink, ckpt = _replay(rows, F.floor((F.dayofyear("collected_at") - 1) / 8).cast("int"))
    jobs.run_change_only(stream, ic.SERIES_KEY, sink, sink + "-state", ckpt)
    out = spark.read.schema(f"id {dict(rows.dtypes)['id']}, day date, value decimal(18,6)").parquet(sink)
    return out.select("id", "day", "value")


@query("stream_price_alerts", _ALERT_SQL)
def _(spark, sf):
    stream, sink, ckpt = _replay(_priced(fx.indicators(spark, sf)).drop("raw_payload"))
    jobs.run_price_alerts(stream, sink, sink + "-state", ckpt, "0.01")
    out = spark.read.schema("indicator_code string, id bigint, reference decimal(18,6), value decimal(18,6), change_ratio double, delivered boolean").parquet(sink)
    return out.select("indicator_code", "id", "reference", "value", "change_ratio", "delivered")


@query("stream_dedup", f"""WITH {fx.ARTICLES} SELECT DISTINCT 'https://' || {_NH} || {_NP} || CASE WHEN {_NQ} <> '' THEN '?' || {_NQ} ELSE '' END AS normal_url FROM articles""")
def _(spark, sf):
    """One row per URL, whichever of its articles came first."""
    a = fx.articles(spark, sf).select("id", "url", "collected_at")
    stream, sink, ckpt = _replay(a)
    return _drain(jobs.dedup_articles(stream, "40 days"), sink, ckpt).select(normalize_url(F.col("url")).alias("normal_url"))


_WEEK = "CAST((extract(dayofyear FROM collected_at) - 1) // 7 AS INTEGER) + CASE WHEN id % 10 = 3 THEN 1 ELSE 0 END"


@query("run_metrics", f"""WITH {fx.ARTICLES}, b AS (SELECT id, title, source, category, score, url, collected_at, published_at + to_hours(CASE WHEN id % 31 = 0 THEN 40 ELSE 0 END) AS pub, {_WEEK} AS wk,
  {fx.sql_squeeze("lower(concat_ws(' ', description, content, ''))")} AS x, {fx.sql_squeeze("lower(title)")} AS y FROM articles),
e AS (SELECT wk, max(collected_at) AS hi, row_number() OVER (ORDER BY wk) - 1 AS run FROM b GROUP BY wk), w AS (SELECT *, max(hi) OVER (ORDER BY wk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM e),
m AS (SELECT b.*, w.run, coalesce(collected_at < edge - INTERVAL 3 DAY, false) AS late FROM b JOIN w USING (wk)), f AS (SELECT *, coalesce(pub > collected_at + INTERVAL 1 DAY, false) AND NOT late AS future FROM m),
u AS (SELECT *, length(x) > 0 AND x <> y AND (length(x) >= 50 OR len(string_split(x, ' ')) >= 8) AS usable FROM f WHERE NOT late AND NOT future),
d AS (SELECT *, usable AND row_number() OVER (PARTITION BY run, usable, url ORDER BY collected_at, id) = 1 AS uq FROM u),
p0 AS (SELECT *, row_number() OVER (PARTITION BY run, category, source ORDER BY score DESC, id) AS rs FROM d WHERE uq), p1 AS (SELECT *, row_number() OVER (PARTITION BY run, category ORDER BY rs > 2, score DESC, id) AS pick FROM p0),
c AS (SELECT run, id, id IN (SELECT doc_id FROM labels WHERE quality = 1) AS told FROM p1 WHERE pick <= CASE WHEN category IN ('politica', 'economia') THEN 8 ELSE 5 END)
SELECT f.run, count(*) AS raw, count(*) FILTER (WHERE f.late) AS late, count(*) FILTER (WHERE f.future) AS future, count(*) FILTER (WHERE d.usable) AS usable_count, count(*) FILTER (WHERE d.uq) AS unique_count,
  count(*) FILTER (WHERE d.uq) AS ranked_count, count(c.id) AS candidate_count, count(*) FILTER (WHERE NOT c.told) AS summary_due_count FROM f LEFT JOIN d USING (id) LEFT JOIN c ON c.id = f.id GROUP BY f.run""")
def _(spark, sf):
    """Weekly batches, some of whose rows arrive a week late and some dated ahead."""
    rows = fx.articles(spark, sf).select("id", "title", "description", "content", "excerpt", "source", "category", "score", "url", "collected_at", (
        F.col("published_at") + F.when(F.col("id") % 31 == 0, F.expr("INTERVAL 40 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))).alias("published_at"))
    week = F.floor((F.dayofyear("collected_at") - 1) / 7).cast("int") + F.when(F.col("id") % 10 == 3, 1).otherwise(0)
    stream, sink, ckpt = _replay(rows, week)
    told = tables.read_table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    jobs.run_batches(stream, lambda b: jobs.selection_steps(b, told), sink, sink + "-metrics", ckpt, jobs.run_counters(), jobs.LateRule(), sink + "-late")
    names = ["usable_count", "unique_count", "ranked_count", "candidate_count", "summary_due_count"]
    schema = ", ".join(f"{n} bigint" for n in ("run", *names, "raw", "late", "future"))
    return spark.read.schema(schema).parquet(sink + "-metrics").select("run", "raw", "late", "future", *names)
