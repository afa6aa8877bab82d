"""Registered queries: listings, story parts, request items, reasons, context, run counters, devices and JSON text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.urls import date_from_url, normalize_url
from ..functions.values import json_safe, parse_date_text
from ..operators import analytics as an
from ..operators import rank as rk
from ..operators import select as sel
from ..operators import stories as st
from ..operators import summaries as sm
from . import fixtures as fx
from .queries_core import _CFG, AS_OF, _in, diverse_sql, rank_ctes
from .queries_stories import _claims, _CLAIMS
from .registry import query


@query("related_members", f"""WITH {fx.STORED} SELECT story_cluster_id AS story_id, id, duplicate_of_article_id IS NOT NULL AS is_duplicate,
  row_number() OVER (PARTITION BY story_cluster_id ORDER BY duplicate_of_article_id IS NOT NULL, published_at NULLS LAST, id) AS position FROM stored WHERE is_active""")
def _(spark, sf):
    return st.related_members(fx.stored_articles(spark, sf))


@query("related_listing", f"""WITH {fx.STORED}, l AS (SELECT story_cluster_id, id, duplicate_of_article_id IS NOT NULL AS is_duplicate,
  row_number() OVER (PARTITION BY story_cluster_id ORDER BY duplicate_of_article_id IS NOT NULL, published_at NULLS LAST, id) AS position FROM stored WHERE is_active)
SELECT a.id AS asked_id, l.position, l.id, l.is_duplicate FROM stored a JOIN labels ON doc_id = a.id AND toxic = 1 JOIN l USING (story_cluster_id) WHERE a.is_active""")
def _(spark, sf):
    """Listings for the articles that readers have reported."""
    asked = fx.read_table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return st.related_listing(fx.stored_articles(spark, sf), asked)


@query("bucketed_claims", f"""WITH {_CLAIMS} SELECT story_id, article_id, claim, created_at, CASE WHEN confidence IN ('multi_source', 'official_statement') THEN confidence ELSE 'single_source' END AS bucket FROM claims""")
def _(spark, sf):
    return st.bucketed_claims(_claims(spark, sf)).select("story_id", "article_id", "claim", "created_at", "bucket")


@query("story_parts", f"""WITH {_CLAIMS}, cl AS (SELECT story_id, article_id * 2 AS claim_id, claim, confidence FROM claims),
e AS (SELECT id * 2 AS claim_id, url, published_at FROM stored WHERE id % 3 <> 0 UNION ALL SELECT id * 2, url || '#2', published_at FROM stored WHERE id % 5 = 0),
p AS (SELECT story_cluster_id AS story_id, 'member' AS part, id AS ref_id, title AS text, source AS detail, published_at AS "at", coalesce(published_at, TIMESTAMP '9999-01-01') AS rank FROM stored
  UNION ALL SELECT story_id, 'claim', claim_id, confidence || ': ' || claim, url, published_at, TIMESTAMP '9999-01-01' FROM cl LEFT JOIN e USING (claim_id)
  UNION ALL SELECT story_cluster_id, 'correction', 0, 'score ' || id, source_type, created_at, TIMESTAMP '9999-01-01' - (created_at - TIMESTAMP '1970-01-01')
    FROM summaries JOIN (SELECT id, source_type FROM stored) USING (id) WHERE score > 50)
SELECT story_id, part, row_number() OVER (PARTITION BY story_id, part ORDER BY rank, ref_id, detail NULLS FIRST, text) AS position, ref_id, text, detail, "at" FROM p""")
def _(spark, sf):
    a = fx.stored_articles(spark, sf)
    claims = _claims(spark, sf).withColumn("claim_id", F.col("article_id") * 2)
    url = a.select((F.col("id") * 2).alias("claim_id"), F.col("id").alias("article_id"), F.col("url").alias("source_url"), "published_at")
    evidence = url.where("article_id % 3 <> 0").unionByName(url.where("article_id % 5 = 0").withColumn("source_url", F.concat("source_url", F.lit("#2"))))
    corrections = fx.summaries(spark, sf).where("score > 50").join(a.select("id", "source_type"), "id").select(
        F.col("story_cluster_id").alias("story_id"), F.concat(F.lit("score "), F.col("id").cast("string")).alias("reason"),
        F.col("source_type").alias("corrected_by"), F.col("created_at").alias("corrected_at"))
    return st.story_parts(st.story_articles(a), a, claims, evidence, corrections)


@query("cleared_claims", f"""WITH {_CLAIMS}, s AS (SELECT story_id, created_at FROM claims UNION ALL SELECT story_cluster_id, created_at FROM summaries WHERE quality = 0),
n AS (SELECT story_id, max(created_at) AS created_at FROM s GROUP BY 1) SELECT story_id, article_id, created_at FROM claims JOIN n USING (story_id, created_at)""")
def _(spark, sf):
    """Claims left when a newer summary without claims has cleared older ones."""
    empty = fx.summaries(spark, sf).where("quality = 0").select(F.col("story_cluster_id").alias("story_id"), "created_at")
    return sm.current_claims(_claims(spark, sf), empty).select("story_id", "article_id", "created_at")


@query("summary_items", f"""WITH {fx.STORED}, {diverse_sql("stored")}, w AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, id) AS pos FROM p2
  WHERE pick <= CASE WHEN category IN ('politica', 'economia') THEN 8 ELSE 5 END),
sb AS (SELECT w.id, b.id AS sid, row_number() OVER (PARTITION BY w.id ORDER BY b.published_at NULLS LAST, b.id) AS k FROM w JOIN stored b ON b.story_cluster_id = w.story_cluster_id AND b.id <> w.id AND b.is_active),
sl AS (SELECT id, string_agg(sid, ',' ORDER BY k) AS siblings FROM sb WHERE k <= 4 GROUP BY id)
SELECT category, pos, w.id AS article_id, title, url, source, left(description, 200) AS description, published_at, coalesce(siblings, '') AS siblings FROM w LEFT JOIN sl USING (id) WHERE pos <= 10""")
def _(spark, sf):
    """The items of every request, one row each."""
    a = fx.stored_articles(spark, sf)
    items = sm.summary_batches(sel.diverse_topk(a), a).select("category", F.inline("items"))
    return items.select("category", F.col("pos").cast("bigint").alias("pos"), "article_id", "title", "url", "source", "description", "published_at",
                        F.array_join(F.transform("siblings", lambda s: s["article_id"].cast("string")), ",").alias("siblings"))


_REASON = "array_to_string(list_filter([{}], lambda z: z IS NOT NULL), ',')"
_WHY = _REASON.format(
    "CASE WHEN published_at IS NULL THEN 'no_date' END, CASE WHEN csrc = '' THEN 'no_source' WHEN csrc IN " + _in(_CFG.source_scores) + " THEN 'source:' || csrc ELSE 'unknown_source:' || csrc END, "
    "'impact:' || CASE s4 " + " ".join(f"WHEN {points} THEN '{name}'" for name, points, _ in _CFG.impact_terms) + " ELSE 'none' END, "
    "CASE WHEN nsrc >= 2 THEN 'corroborated:' || nsrc END")


@query("rank_reasons", f"""WITH {fx.STORED}, ns AS (SELECT *, count(DISTINCT source) OVER (PARTITION BY story_cluster_id) AS story_sources FROM stored), {rank_ctes("ns", "story_sources")}
SELECT id, score, s6 AS corroboration_score, {_WHY} AS reasons FROM ranked""")
def _(spark, sf):
    """Scores with the number of sources that tell a story, and the reasons shown for them."""
    a = fx.stored_articles(spark, sf)
    told = a.groupBy("story_cluster_id").agg(F.countDistinct("source").alias("source_count"))
    scored = rk.score_articles(a.join(told, "story_cluster_id"), AS_OF, _CFG)
    shown = F.filter("score_reasons", lambda r: ~r.startswith("penalty:"))
    return scored.select("id", "score", "corroboration_score", F.array_join(shown, ",").alias("reasons"))


def _clean(x: str) -> str:
    return fx.sql_squeeze(f"regexp_replace({x}, '^{fx.SP}*([0-9]+[.)]{fx.SP}*)+', '')")


_SENT = f"list_filter(list_transform(string_split(regexp_replace(c, '([.!?]){fx.SP}+', '\\1' || chr(1), 'g'), chr(1)), lambda z: trim(z)), lambda z: length(z) > 0)"


@query("summary_context", f"""WITH {fx.ARTICLES}, x AS (SELECT id, {_clean("title")} AS b, {_clean("description")} AS c FROM articles),
y AS (SELECT id, b, CASE WHEN length(b) >= 120 THEN b ELSE list_reduce(list_prepend(b, {_SENT}), lambda a, s: CASE WHEN length(a) >= 120 OR length({_clean("s")}) = 0
    OR contains(lower({_clean("a")}), lower({_clean("s")})) OR contains(lower({_clean("s")}), lower({_clean("a")})) THEN a
  WHEN length(a) = 0 THEN s ELSE a || CASE WHEN right(a, 1) IN ('.', '!', '?') THEN ' ' ELSE '. ' END || s END) END AS e FROM x)
SELECT id, CASE WHEN length(e) <= 360 THEN e ELSE coalesce(nullif(trim(regexp_replace(left(e, 360), ' [^ ]*$', '')), ''), trim(left(e, 360))) END AS summary FROM y""")
def _(spark, sf):
    a = fx.articles(spark, sf)
    return a.select("id", t.summary_with_context(F.col("title"), F.col("description")).alias("summary"))


_AGENT = "CASE event_type WHEN 'view' THEN 'Mozilla/5.0 (Linux; Android 14) ' || event_id WHEN 'click' THEN 'Mozilla/5.0 (X11; Linux) ' || event_id WHEN 'signup' THEN 'App/' || event_id || ' MOBI' END"


@query("device_class", f"""SELECT CAST(ts AS DATE) AS day, CASE WHEN agent IS NULL THEN 'unknown' WHEN regexp_matches(agent, '(?i)mobi|android') THEN 'mobile' ELSE 'desktop' END AS device, count(*) AS n
FROM (SELECT *, {_AGENT} AS agent FROM events) GROUP BY 1, 2""")
def _(spark, sf):
    events = fx.read_table(spark, sf, "events").withColumn("agent", F.expr(_AGENT))
    return events.groupBy(F.to_date("ts").alias("day"), t.is_mobile(F.col("agent")).alias("device")).agg(F.count("*").alias("n"))


@query("json_rows", f"""WITH {fx.ARTICLES} SELECT id, '{{"id":' || id || ',"published_at":' || coalesce('"' || strftime(published_at, '%Y-%m-%dT%H:%M:%S') || '"', 'null') || ',"source":' || to_json(source)
  || ',"active":' || is_active || ',"places":["' || lang || '","' || category || '"],"image":' || coalesce(to_json(image)::VARCHAR, 'null') || ',"weight":' || CAST(score AS DECIMAL(9,2)) || '}}' AS body FROM articles""")
def _(spark, sf):
    a = fx.articles(spark, sf)
    return a.select("id", json_safe(
        F.col("id"), F.col("published_at"), F.col("source"), F.col("is_active").alias("active"), F.array("lang", "category").alias("places"), F.col("image"),
        F.col("score").cast("decimal(9,2)").alias("weight")).alias("body"))


@query("event_ranges", f"""WITH {fx.EVENTS}, r AS (SELECT DISTINCT created_at::DATE AS first_day FROM ev), x AS (SELECT first_day, ev.event_name, count(*) AS n, count(DISTINCT session_id) AS s, count(DISTINCT user_id) AS u
  FROM r JOIN ev ON ev.created_at::DATE BETWEEN first_day AND first_day + 6 GROUP BY 1, 2)
SELECT strftime(first_day, '%Y-%m-%d') AS range_id, event_name, n, true AS sessions_close, true AS users_close FROM x""")
def _(spark, sf):
    """The week from every day on, merged from daily rows; estimates are held against exact counts with a tolerance of 8 %."""
    ev = fx.events(spark, sf)
    days = ev.select(F.to_date("created_at").alias("first_day")).distinct()
    ranges = days.select(F.col("first_day").cast("string").alias("range_id"), "first_day", F.date_add("first_day", 6).alias("last_day"))
    got = an.range_summary(an.daily_sketches(ev), ranges)
    exact = ev.join(F.broadcast(ranges), F.to_date("created_at").between(F.col("first_day"), F.col("last_day"))).groupBy("range_id", "event_name").agg(
        F.countDistinct("session_id").alias("s"), F.countDistinct("user_id").alias("u"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.08 * F.col(b)
    return got.join(exact, ["range_id", "event_name"]).select("range_id", "event_name", "n", close("sessions", "s").alias("sessions_close"), close("users", "u").alias("users_close"))


#: Written forms of a time, and what is left of it in each.
_FORMS = (
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "microseconds"), ("yyyy-MM-dd'T'HH:mm:ss.SSS", "milliseconds"), ("yyyy-MM-dd'T'HH:mm:ss", "second"), ("yyyy-MM-dd'T'HH:mm", "minute"),
    ("yyyy-MM-dd HH:mm:ss", "second"), ("yyyy-MM-dd HH:mm", "minute"), ("yyyy-MM-dd", "day"), ("d/M/yyyy HH:mm:ss", "second"), ("d/M/yyyy HH:mm", "minute"),
    ("d/M/yyyy", "day"), ("d-M-yyyy", "day"), ("yyyy/MM/dd", "day"))


@query("date_texts", f"""SELECT event_id, CASE event_id % {len(_FORMS)} {' '.join(f"WHEN {k} THEN date_trunc('{left}', ts)" for k, (_, left) in enumerate(_FORMS))} END AS from_text,
  date_trunc('minute', ts) AS from_stamp FROM events""")
def _(spark, sf):
    """Every event's time written in one of the listed forms and read back, and as the numeric stamp of a URL."""
    ev = fx.read_table(spark, sf, "events")
    text = F.coalesce(*[F.when(F.col("event_id") % len(_FORMS) == k, F.date_format("ts", form)) for k, (form, _) in enumerate(_FORMS)])
    stamp = F.concat(F.lit("https://x.example/nota-"), F.date_format("ts", "yyyyMMddHHmm"), F.lit(".html"))
    return ev.select("event_id", parse_date_text(F.concat(F.lit("Hoy, hace 3 horas: "), text)).alias("from_text"), date_from_url(stamp).alias("from_stamp"))


@query("url_escapes", """SELECT doc_id AS id, 'https://x.example/' || lang || '%20n/a-' || doc_id || '?k=' || source || '+b&q=%C3%A9' AS normal_url FROM documents""")
def _(spark, sf):
    """Escapes in whatever case and form become one form; tracking parameters go."""
    docs = fx.read_table(spark, sf, "documents")
    url = F.concat(F.lit("HTTP://www.X.example/"), "lang", F.lit("%20n/a-"), F.col("doc_id").cast("string"), F.lit("/?q=%c3%a9&utm_campaign=z&k="), "source", F.lit("%20b#part"))
    return docs.select(F.col("doc_id").alias("id"), normalize_url(url).alias("normal_url"))
