"""Registered queries: cleaning, text functions, classification, ranking, selection."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..config import (
    BODY_NOISE_MARKERS, BODY_STOP_MARKERS, CATEGORIES, DECORATION_IMAGE_FRAGMENTS, FOREIGN_TERMS, IMPACT_TERMS, LOCAL_TERMS,
    NON_ARTICLE_URL_FRAGMENTS, STORY_STOPWORDS, TRACKER_IMAGE_FRAGMENTS, ScoringConfig,
)
from ..functions import text as t
from ..functions import urls as u
from ..functions import values as v
from ..functions.arrow import repair_text
from ..operators import classify as cl
from ..operators import quality as q
from ..operators import rank as rk
from ..operators import select as sel
from ..sources import feeds, pages, tables
from . import fixtures as fx
from .registry import query

AS_OF = fx.AS_OF
_NOW = f"TIMESTAMP '{AS_OF}'"


def _pages(spark, sf):
    return tables.spread(tables.read_table(spark, sf, "pages"), "page_id")


def _in(values) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + ")"


def _like_any(x: str, fragments) -> str:
    return "(" + " OR ".join(f"contains({x}, '{f}')" for f in fragments) + ")"


# --- cleaning ----------------------------------------------------------------
_JOINED = "concat_ws(' ', coalesce(description, ''), coalesce(content, ''), coalesce(excerpt, ''))"


@query("usable_articles", f"""WITH {fx.ARTICLES}, n AS (SELECT id, {fx.sql_squeeze(f"lower({_JOINED})")} AS x, {fx.sql_squeeze("lower(title)")} AS y FROM articles)
SELECT id FROM n WHERE length(x) > 0 AND x <> y AND (length(x) >= 50 OR len(string_split(x, ' ')) >= 8)""")
def _(spark, sf):
    return q.usable_articles(fx.articles(spark, sf)).select("id")


@query("drop_reasons", f"""WITH {fx.ARTICLES}, n AS (SELECT *, trim({_JOINED}) AS j FROM articles),
k AS (SELECT *, {fx.sql_match_key("j")} AS jk, {fx.sql_match_key("title")} AS tk, {fx.sql_words("j")} AS w FROM n)
SELECT CASE WHEN jk = '' OR jk = tk THEN 'no_text' WHEN w < 8 AND length(j) < 50 THEN 'too_short'
  WHEN published_at > TIMESTAMP '2024-01-25' + INTERVAL 1 DAY THEN 'future_date' WHEN skipped_detail_reason = 'non_today_detail_date' THEN 'old_detail'
  WHEN published_at IS NULL THEN 'no_date' ELSE 'kept' END AS drop_reason, count(*) AS n FROM k GROUP BY 1""")
def _(spark, sf):
    return q.drop_report(fx.articles(spark, sf), datetime(2024, 1, 25))


@query("same_day_filter", f"""WITH {fx.ARTICLES} SELECT id, published_at FROM articles
WHERE published_at >= date_trunc('day', timezone('America/La_Paz', timezone('UTC', TIMESTAMP '2024-01-21 02:30:00')))""")
def _(spark, sf):
    keep = q.published_since_local_midnight(datetime(2024, 1, 21, 2, 30))
    return fx.articles(spark, sf).where(keep).select("id", "published_at")


@query("article_search", f"""WITH {fx.STORED} SELECT id, title, published_at FROM stored
WHERE is_active AND duplicate_of_article_id IS NULL AND published_at >= TIMESTAMP '2024-01-20' AND published_at < TIMESTAMP '2024-01-21'
  AND category = 'politica' AND (contains(lower(title), 'the') OR contains(lower(description), 'the') OR contains(lower(content), 'the'))""")
def _(spark, sf):
    return fx.stored_articles(spark, sf).where(q.article_filters(category=" Politica", q="The ", day=fx.DAY)).select("id", "title", "published_at")


@query("summary_search", f"""WITH {fx.SUMMARIES} SELECT s.id, s.title, s.created_at FROM summaries s LEFT JOIN stored a ON a.id = s.article_id
LEFT JOIN (SELECT story_id FROM stories WHERE current_status = 'unpublished') h ON h.story_id = s.story_cluster_id
WHERE s.summary_date = DATE '2024-01-20' AND s.category = 'politica' AND (a.id IS NULL OR a.duplicate_of_article_id IS NULL) AND h.story_id IS NULL""")
def _(spark, sf):
    rows = sel.summary_with_article(fx.summaries(spark, sf), fx.stored_articles(spark, sf))
    rows = sel.summaries_published(rows, fx.stories(spark, sf))
    return rows.where(q.summary_filters(category="politica", day=fx.DAY)).select("id", "title", "created_at")


@query("event_allowlist", f"""WITH {fx.EVENTS} SELECT event_name, count(*) AS n, event_name <> 'client_error' AS accepted FROM ev GROUP BY event_name""")
def _(spark, sf):
    rows = fx.events(spark, sf).withColumn("accepted", q.event_allowed())
    return rows.groupBy("event_name", "accepted").agg(F.count("*").alias("n"))


@query("content_not_description", f"""WITH {fx.ARTICLES} SELECT id, length(CASE WHEN length(content) > 0 AND NOT (length(lower({fx.sql_squeeze("description")})) > 0
  AND lower({fx.sql_squeeze("content")}) = lower({fx.sql_squeeze("description")})) THEN content END) AS shown FROM articles""")
def _(spark, sf):
    return fx.articles(spark, sf).select("id", F.length(q.content_for_response(F.col("content"), F.col("description"))).alias("shown"))


@query("image_url_filter", f"""WITH {fx.ARTICLES} SELECT id, CASE WHEN length(image) > 0 AND NOT {_like_any("lower(image)", TRACKER_IMAGE_FRAGMENTS)} THEN trim(image) END AS public_image,
  CASE WHEN NOT {_like_any("lower(image)", DECORATION_IMAGE_FRAGMENTS)} THEN image END AS article_image FROM articles""")
def _(spark, sf):
    return fx.articles(spark, sf).select("id", u.public_image(F.col("image")).alias("public_image"), u.article_image(F.col("image")).alias("article_image"))


_DIGITS = r"regexp_replace(trim(phone), '[\s().-]+', '', 'g')"
_P1 = f"CASE WHEN starts_with({_DIGITS}, '00') THEN '+' || substr({_DIGITS}, 3) ELSE {_DIGITS} END"
_P2 = f"nullif(CASE WHEN length({_P1}) > 0 AND NOT starts_with({_P1}, '+') THEN '+' || ({_P1}) ELSE {_P1} END, '')"


@query("subscriber_validation", f"""WITH {fx.SUBSCRIBERS}, n AS (SELECT *, {_P2} AS p, nullif(lower(trim(email)), '') AS e, nullif(trim(telegram_id), '') AS g,
  list_sort(list_distinct(list_filter(list_transform(categories, lambda c: lower(trim(c))), lambda c: length(c) > 0))) AS w FROM subs),
b AS (SELECT *, e IS NOT NULL AND (length(e) > 254 OR NOT regexp_matches(e, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) AS bad FROM n)
SELECT id, p AS clean_phone, CASE WHEN NOT bad THEN e END AS clean_email, g AS clean_telegram_id, array_to_string(w, ',') AS clean_categories,
  concat_ws(',', CASE WHEN bad THEN 'email_invalid' END,
   CASE WHEN len(list_filter(w, lambda c: c NOT IN {_in(CATEGORIES)})) > 0 THEN 'category_unknown' END, CASE WHEN len(w) = 0 THEN 'category_missing' END,
   CASE WHEN NOT regexp_matches(timezone, '^[A-Za-z_]+/[A-Za-z_-]+$') THEN 'timezone_invalid' END,
   CASE WHEN preferred_hour < 9 OR preferred_hour > 23 THEN 'hour_invalid' END, CASE WHEN NOT consent_accepted THEN 'consent_missing' END,
   CASE WHEN channel = 'whatsapp' AND p IS NULL THEN 'phone_missing' END,
   CASE WHEN channel = 'whatsapp' AND p IS NOT NULL AND NOT regexp_matches(p, '^\\+[0-9]{{8,15}}$') THEN 'phone_invalid' END,
   CASE WHEN channel = 'telegram' AND g IS NULL THEN 'telegram_missing' END, CASE WHEN channel = 'email' AND (e IS NULL OR bad) THEN 'email_missing' END) AS errors FROM b""")
def _(spark, sf):
    rows = q.validate_subscribers(fx.subscribers(spark, sf))
    return rows.select("id", "clean_phone", "clean_email", "clean_telegram_id", F.array_join("clean_categories", ",").alias("clean_categories"),
                       F.array_join("errors", ",").alias("errors"))


@query("preferred_hour_recode", f"""WITH {fx.SUBSCRIBERS} SELECT id, CASE preferred_time WHEN 'manana' THEN 9 WHEN 'tarde' THEN 16 WHEN 'noche' THEN 20 ELSE 9 END AS hour FROM subs""")
def _(spark, sf):
    return fx.subscribers(spark, sf).select("id", q.preferred_hour(F.col("preferred_time")).alias("hour"))


@query("review_queue", f"""WITH {fx.ARTICLES} SELECT id, collected_at, raw_payload ->> '$.category_method' AS category_method, raw_payload ->> '$.category_llm_error' AS review_error
FROM articles WHERE is_active AND collected_at >= TIMESTAMP '2024-01-10' AND (raw_payload ->> '$.category_method' = 'rules_low_confidence'
  OR length(raw_payload ->> '$.category_llm_error') > 0) ORDER BY collected_at DESC, id DESC LIMIT 50""")
def _(spark, sf):
    return q.review_queue(fx.articles(spark, sf), datetime(2024, 1, 10), 50).select("id", "collected_at", "category_method", "review_error")


# --- sources -----------------------------------------------------------------
_HOST = "lower(regexp_extract(url, '//([^/?#]*)', 1))"
_PATH = "regexp_replace(regexp_extract(url, '//[^/?#]*(/[^?#]*)', 1), '^/+|/+$', '', 'g')"


@query("article_url_filter", f"""SELECT page_id, coalesce(NOT {_like_any("url", NON_ARTICLE_URL_FRAGMENTS)} AND length({_PATH}) > 8, false) AS looks_like_article, {_HOST} AS host FROM pages""")
def _(spark, sf):
    p = _pages(spark, sf)
    home = F.concat(F.lit("https://"), u.host(F.col("url")), F.lit("/"))
    return p.select("page_id", u.looks_like_article(F.col("url"), home).alias("looks_like_article"), u.host(F.col("url")).alias("host"))


@query("page_articles")
def _(spark, sf):
    # the given pages list their links in the navigation
    layout = pages.PageLayout(card="nav li", title="a")
    return pages.page_articles(pages.read_pages(_pages(spark, sf), layout))


@query("page_links")
def _(spark, sf):
    # no card matches, so links are the fallback; the given pages have short link texts
    layout = pages.PageLayout(card="article .teaser")
    return pages.page_links(pages.read_pages(_pages(spark, sf), layout), min_text=8)


@query("page_body")
def _(spark, sf):
    return pages.page_body(pages.read_pages(_pages(spark, sf))).select("page_id", "title", "method", "words", F.md5("body").alias("body_md5"))


@query("page_meta", f"""SELECT page_id, {_HOST} AS host, {fx.sql_squeeze("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g')")} AS title,
  regexp_extract(html, '(?is)<html[^>]*lang="([^"]*)"', 1) AS lang,
  {fx.sql_squeeze("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g')")} AS h1, length(html) AS html_chars FROM pages""")
def _(spark, sf):
    return pages.page_title_columns(_pages(spark, sf))


@query("page_metadata")
def _(spark, sf):
    return pages.page_meta(pages.read_pages(_pages(spark, sf)))


def _skip_sql() -> str:
    low = "lower(trim(line))"
    return f"""l AS (SELECT doc_id, i, {fx.sql_squeeze("x")} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
f AS (SELECT *, contains({low}, 'te puede interesar') AS teaser, {_like_any(low, BODY_STOP_MARKERS)} AS stop, {_like_any(low, BODY_NOISE_MARKERS)} OR length(line) < 35 AS noise FROM l WHERE length(line) > 0),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn, row_number() OVER (PARTITION BY doc_id, teaser ORDER BY i) AS rt FROM f),
h AS (SELECT *, CASE WHEN teaser THEN row_number() OVER (PARTITION BY doc_id, teaser, rn - rt ORDER BY i) % 2 = 1 ELSE false END AS active FROM g),
s AS (SELECT *, coalesce(lag(active) OVER (PARTITION BY doc_id ORDER BY i), false) AS skipped FROM h),
e AS (SELECT *, coalesce(bool_or(stop AND NOT teaser AND NOT skipped) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), false) AS done FROM s),
k AS (SELECT doc_id, line, min(i) AS i FROM e WHERE NOT done AND NOT active AND NOT skipped AND NOT noise AND NOT teaser GROUP BY doc_id, line)"""


@query("boilerplate_lines", f"""WITH {_skip_sql()}
SELECT d.doc_id, count(k.i) AS n_lines, md5(coalesce(string_agg(k.line, chr(10) || chr(10) ORDER BY k.i), '')) AS body_md5 FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id""")
def _(spark, sf):
    rows = pages.clean_text_lines(tables.spread(tables.read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id"))
    return rows.select("doc_id", F.size("body_lines").alias("n_lines"), F.md5("body").alias("body_md5"))


@query("indicator_cards")
def _(spark, sf):
    ev = tables.read_table(spark, sf, "events")
    cell = F.concat(F.lit("<div class='bcb-row'><span class='bcb-lbl'>"), F.expr("CASE event_id % 2 WHEN 0 THEN 'Compra' ELSE 'Venta' END"),
                    F.lit("</span><span class='bcb-val'>Bs "), F.regexp_replace(F.format_number("value", 2), r"(\d),(\d{3})\.(\d+)", "$1.$2,$3"), F.lit("</span></div>"))
    snapshot = F.concat(
        F.lit("<div class='bcb-kpi2'><h3 class='bcb-kpi2-name'>Dólar "), F.col("event_type"), F.lit("</h3><p class='bcb-kpi2-asof'>"),
        F.dayofmonth("ts").cast("string"), F.lit(" de enero, 2024</p>"), cell, F.lit("</div>"))
    return pages.indicator_cards(ev.select(F.col("event_id").alias("page_id"), snapshot.alias("html")))


@query("best_quote_per_side", """WITH qb AS (SELECT l_orderkey AS book_id, CASE WHEN l_orderkey % 2 = 0 THEN 'SELL' ELSE 'BUY' END AS trade_type,
  l_extendedprice::DECIMAL(18,6) AS price, l_returnflag <> 'A' AND l_suppkey % 40 >= 10 AND round(0.5::DOUBLE + l_discount * 5, 2) >= 0.8 AS ok FROM lineitem),
a AS (SELECT book_id, trade_type, max(price) FILTER (WHERE ok) AS rmax, min(price) FILTER (WHERE ok) AS rmin, max(price) AS amax, min(price) AS amin, count(*) AS quotes,
  count(*) FILTER (WHERE ok) AS reliable_quotes FROM qb GROUP BY ALL)
SELECT book_id, trade_type, (CASE WHEN trade_type = 'SELL' THEN coalesce(rmax, amax) ELSE coalesce(rmin, amin) END)::DOUBLE AS price,
  (CASE WHEN trade_type = 'SELL' THEN 'highest_price' ELSE 'lowest_price' END) || (CASE WHEN reliable_quotes = 0 THEN '_unfiltered_fallback' ELSE '' END) AS selection, quotes, reliable_quotes FROM a""")
def _(spark, sf):
    # one book per order; its lines are the quotes
    li = tables.read_table(spark, sf, "lineitem")
    entry = F.struct(
        F.struct(F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("price")).alias("adv"),
        F.struct((F.col("l_suppkey") % 40).cast("string").alias("monthOrderCount"), F.round(F.lit(0.5) + F.col("l_discount") * 5, 2).cast("string").alias("monthFinishRate"),
                 F.when(F.col("l_returnflag") == "A", "user").otherwise("merchant").alias("userType")).alias("advertiser"))
    books = li.groupBy("l_orderkey").agg(F.collect_list(entry).alias("data")).select(
        F.col("l_orderkey").alias("book_id"), F.expr("CASE WHEN l_orderkey % 2 = 0 THEN 'SELL' ELSE 'BUY' END").alias("trade_type"),
        F.to_json(F.struct("data")).alias("payload"))
    from ..operators.indicators import best_quotes

    return best_quotes(books)


@query("weather_normalize", """SELECT event_id AS request_id, CASE user_id % 5 WHEN 0 THEN 'santa_cruz' WHEN 1 THEN 'sucre' WHEN 2 THEN 'trinidad' WHEN 3 THEN 'cobija' ELSE 'la_paz' END AS location,
  value::DOUBLE AS temperature, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (value + 1)::DOUBLE END AS temperature_max FROM events""")
def _(spark, sf):
    ev = tables.read_table(spark, sf, "events")
    place = F.expr("CASE user_id % 5 WHEN 0 THEN 'Santa Cruz' WHEN 1 THEN ' chuquisaca' WHEN 2 THEN 'BENI' WHEN 3 THEN 'cobija' ELSE 'Springfield' END")
    daily = F.when(F.col("event_id") % 3 == 0, F.array().cast("array<double>")).otherwise(F.array(F.col("value") + 1, F.lit(0.0)))
    payload = F.to_json(F.struct(F.struct(F.col("value").alias("temperature_2m")).alias("current"), F.struct(daily.alias("temperature_2m_max")).alias("daily")))
    return feeds.weather_normalize(ev.select(F.col("event_id").alias("request_id"), place.alias("place"), payload.alias("payload"))).select(
        "request_id", "location", "temperature", "temperature_max")


@query("known_detail_reuse", f"""WITH {fx.ARTICLES}, one AS (SELECT * FROM articles QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY id) = 1),
l AS (SELECT id, url_hash, published_at + INTERVAL 1 HOUR AS published_at, CASE WHEN id % 2 = 0 THEN description END AS description, image FROM articles)
SELECT l.id, coalesce(length(o.content) > 0 AND o.published_at <= {_NOW} - INTERVAL 3 HOUR, false) AS detail_reused,
  CASE WHEN coalesce(length(o.content) > 0 AND o.published_at <= {_NOW} - INTERVAL 3 HOUR, false) THEN o.published_at ELSE l.published_at END AS published_at,
  length(CASE WHEN coalesce(length(o.content) > 0 AND o.published_at <= {_NOW} - INTERVAL 3 HOUR, false) THEN coalesce(nullif(l.description, ''), o.description) ELSE l.description END) AS description_chars
FROM l LEFT JOIN (SELECT * FROM one WHERE collected_at >= {_NOW} - INTERVAL 20 DAY AND content IS NOT NULL) o USING (url_hash)""")
def _(spark, sf):
    a = fx.articles(spark, sf)
    from ..operators.scan import first_per

    stored = first_per(a, ["url_hash"], [F.col("id")])
    listing = a.select("id", "url_hash", (F.col("published_at") + F.expr("INTERVAL 1 HOUR")).alias("published_at"),
                       F.expr("CASE WHEN id % 2 = 0 THEN description END").alias("description"), "image")
    out = feeds.reuse_known_details(listing, stored, AS_OF, datetime(2024, 1, 11, 12, 0))
    return out.select("id", "detail_reused", "published_at", F.length("description").alias("description_chars"))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels",
           "conversations")


@query("table_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in _TABLES))
def _(spark, sf):
    return tables.table_counts({n: tables.read_table(spark, sf, n) for n in _TABLES})


# --- scalar functions --------------------------------------------------------
_EXC = f"left(coalesce(nullif({fx.sql_story_text('content')}, ''), nullif({fx.sql_story_text('description')}, ''), ''), 280)"
_KEY = f"left(concat_ws(' | ', nullif({fx.sql_story_text('category')}, ''), nullif({fx.sql_story_text('title')}, ''), nullif(excerpt280, '')), 500)"


@query("text_normalize", f"""WITH {fx.ARTICLES}, x AS (SELECT *, 'VIDEO: Última hora: ' || title AS noisy, {_EXC} AS excerpt280 FROM articles)
SELECT id, {fx.sql_fold("title")} AS folded, {fx.sql_story_text("noisy")} AS story_text, {fx.sql_title_key("title")} AS title_key, {fx.sql_title_key_raw("title")} AS title_key_raw,
  sha256({_KEY}) AS content_fingerprint, {fx.sql_words("content")} AS words, regexp_replace(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM x""")
def _(spark, sf):
    a = fx.articles(spark, sf)
    ex = t.story_excerpt(F.col("content"), F.col("description"))
    return a.select(
        "id", t.fold(F.col("title")).alias("folded"), t.story_text(F.concat(F.lit("VIDEO: Última hora: "), "title")).alias("story_text"),
        t.title_key(F.col("title")).alias("title_key"), t.title_key_raw(F.col("title")).alias("title_key_raw"),
        t.content_fingerprint(t.canonical_key(F.col("category"), F.col("title"), ex)).alias("content_fingerprint"),
        t.word_count(F.col("content")).alias("words"), t.slugify(F.col("title")).alias("slug"))


_TOK = (lambda x: f"list_distinct(list_filter(regexp_extract_all({x}, '{fx.WD}+'), lambda z: length(z) >= 4 AND z NOT IN {_in(STORY_STOPWORDS)}))")


@query("text_tokens", f"""WITH {fx.ARTICLES}, k AS (SELECT id, {_TOK(fx.sql_story_text("title"))} AS a, {_TOK(fx.sql_story_text("description"))} AS b, content FROM articles),
n AS (SELECT *, len(list_intersect(a, b)) AS s FROM k)
SELECT id, len(a) AS title_tokens, len(b) AS description_tokens, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE s::DOUBLE / (len(a) + len(b) - s) END AS jaccard,
  regexp_matches({fx.sql_fold("content")}, '(^|[^\\p{{L}}\\p{{N}}_])the($|[^\\p{{L}}\\p{{N}}_])') AS has_term FROM n""")
def _(spark, sf):
    a = fx.articles(spark, sf).select(
        "id", t.significant_tokens(t.story_text(F.col("title"))).alias("a"), t.significant_tokens(t.story_text(F.col("description"))).alias("b"), "content")
    return a.select("id", F.size("a").alias("title_tokens"), F.size("b").alias("description_tokens"), t.jaccard(F.col("a"), F.col("b")).alias("jaccard"),
                    t.contains_term(t.fold(F.col("content")), "the").alias("has_term"))


def _cut(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE coalesce(nullif(trim(regexp_replace(left({x}, {n}), ' [^ ]*$', '')), ''), trim(left({x}, {n}))) END"


@query("text_cut", f"""WITH {fx.ARTICLES}, x AS (SELECT id, {fx.sql_squeeze("content")} AS c, {fx.sql_squeeze(f"regexp_replace('1. 2) ' || title, '^{fx.SP}*([0-9]+[.)]{fx.SP}*)+', '')")} AS g FROM articles)
SELECT id, {_cut("c", 140)} AS limited, CASE WHEN length(c) <= 280 THEN c ELSE trim(regexp_replace(left(c, 280), ' [^ ]*$', '')) || '...' END AS excerpt, g AS generated FROM x""")
def _(spark, sf):
    a = fx.articles(spark, sf)
    return a.select("id", t.limit_text(t.squeeze(F.col("content")), 140).alias("limited"), t.excerpt(F.col("content")).alias("excerpt"),
                    t.clean_generated(F.concat(F.lit("1. 2) "), "title")).alias("generated"))


@query("text_repair")
def _(spark, sf):
    return _pages(spark, sf).select("page_id", t.strip_invisible(repair_text(F.col("html"))).alias("repaired"))


_NH = "regexp_replace(lower(regexp_extract(url, '//([^/?#]*)', 1)), '^www\\.', '')"
_NP = "regexp_replace(regexp_extract(url, '//[^/?#]*(/[^?#]*)', 1), '/+$', '')"
_NQ = "array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_.*|fbclid|ref)='))), '&')"


@query("url_normalize", f"""WITH {fx.ARTICLES}, b AS (SELECT id, url FROM articles UNION ALL SELECT -1 - page_id, url FROM pages),
n AS (SELECT id, 'https://' || {_NH} || {_NP} || CASE WHEN {_NQ} <> '' THEN '?' || {_NQ} ELSE '' END AS u, url FROM b)
SELECT id, u AS normal_url, sha256(u) AS url_fingerprint, md5(url) AS url_hash FROM n""")
def _(spark, sf):
    a = fx.articles(spark, sf).select("id", "url").unionByName(_pages(spark, sf).select((-1 - F.col("page_id")).alias("id"), "url"))
    return a.select("id", u.normalize_url(F.col("url")).alias("normal_url"), u.url_fingerprint(F.col("url")).alias("url_fingerprint"), u.url_hash(F.col("url")).alias("url_hash"))


_MON = "['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre']"


@query("date_number_parse", f"""SELECT event_id, round(value, 2)::DOUBLE AS amount, ts::DATE AS spanish_date, timezone('America/La_Paz', timezone('UTC', date_trunc('second', ts))) AS from_epoch,
  date_trunc('day', ts) AS from_url, date_trunc('minute', ts) AS from_text, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((microsecond(ts) % 1000000)::VARCHAR, 6, '0') END || '-04:00' AS iso,
  1.0::DOUBLE - (1.0::DOUBLE - 0.85::DOUBLE) * least(abs(k)::DOUBLE / 72.0::DOUBLE, 1.0) AS closeness FROM (SELECT *, (props ->> '$.k')::INT AS k FROM events)""")
def _(spark, sf):
    ev = tables.read_table(spark, sf, "events")
    number = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.format_number("value", 2), r"\.", ";"), ",", "."), ";", ",")
    month = F.element_at(F.array(*[F.lit(m) for m in ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")]), F.month("ts"))
    spanish = F.concat(F.lit("Al "), F.dayofmonth("ts").cast("string"), F.lit(" de "), month, F.lit(" de "), F.year("ts").cast("string"))
    epoch = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    return ev.select(
        "event_id", v.parse_decimal(F.concat(F.lit("Bs "), number)).alias("amount"), v.parse_spanish_date(spanish).alias("spanish_date"),
        v.numeric_timestamp(epoch).alias("from_epoch"), u.date_from_url(F.concat(F.lit("https://x.example/"), F.date_format("ts", "yyyyMMdd"), F.lit("/n"))).alias("from_url"),
        v.parse_date_text(F.concat(F.lit("Publicado: "), F.date_format("ts", "d/M/yyyy HH:mm"))).alias("from_text"), v.iso_with_offset(F.col("ts")).alias("iso"),
        v.temporal_proximity(F.get_json_object("props", "$.k").cast("double"), 72).alias("closeness"))


# --- classification ----------------------------------------------------------
def _folded(terms) -> list[str]:
    return rk._expanded(terms)


_BND = r"(^|[^\p{L}\p{N}_])"
_END = r"($|[^\p{L}\p{N}_])"


def _rule_structs() -> str:
    """One constant pattern per rule, so that DuckDB compiles each only once."""
    out = []
    for cat_ord, (category, spec) in enumerate(fx.RULES.items()):
        ord_ = 0
        for polarity in ("positive", "negative"):
            for r in spec[polarity]:
                folded = _folded([r["term"]])[0].replace(".", "[.]")
                pat = "(?i)" + r["term"] if r.get("regex") else _BND + folded + _END
                field = " ".join(f"WHEN regexp_matches({c}, '{pat}') THEN '{n}'" for c, n in (("t", "title"), ("d", "description"), ("c", "content")))
                out.append(f"{{'category': '{category}', 'cat_ord': {cat_ord}, 'polarity': '{polarity}', 'ord': {ord_}, 'term': '{r['term']}', "
                           f"'weight': {float(r['weight'])}::DOUBLE, 'ambiguous': {str(bool(r.get('ambiguous'))).lower()}, 'field': CASE {field} END}}")
                ord_ += 1
    return ", ".join(out)


_RULE_MATCH = f"""{fx.ARTICLES}, {fx.RULES_SQL},
ft AS (SELECT id, {fx.sql_fold("title")} AS t, {fx.sql_fold("description")} AS d, {fx.sql_fold("content")} AS c FROM articles),
mt AS MATERIALIZED (SELECT id, m.* FROM (SELECT id, unnest([{_rule_structs()}]) AS m FROM ft)),
tm AS (SELECT *, weight * CASE field WHEN 'title' THEN 3.0 WHEN 'description' THEN 2.0 ELSE 1.0 END AS value FROM mt WHERE field IS NOT NULL)"""


@query("term_matches", f"WITH {_RULE_MATCH} SELECT id, category, polarity, term, field, value::DOUBLE AS value FROM tm")
def _(spark, sf):
    return cl.term_matches(fx.articles(spark, sf), fx.rules(spark)).select("id", "category", "polarity", "term", "field", "value")


def _num(x: str) -> str:
    return f"regexp_replace(regexp_replace(CAST(CAST({x} AS DECIMAL(18,4)) AS VARCHAR), '0+$', ''), '\\.$', '')"


_SCORED = f"""{_RULE_MATCH},
bn AS (SELECT id, category FROM articles WHERE category IN (SELECT category FROM rules)),
al AS (SELECT id, category, term, ambiguous, value, polarity = 'positive' AS pos FROM tm UNION ALL SELECT id, category, 'categoria_fuente', false, 2.5, true FROM bn),
nt AS (SELECT id, category, ord, field || ':' || term || '(' || CASE polarity WHEN 'positive' THEN '+' ELSE '-' END || {_num("value")} || ')' AS note FROM tm
  UNION ALL SELECT id, category, 1073741824, 'source_category:categoria_fuente(+2.5)' FROM bn),
ns AS (SELECT id, category, array_to_string((list(note ORDER BY ord, note))[1:8], ';') AS notes FROM nt GROUP BY id, category),
cs AS (SELECT id, category, greatest(round(sum(CASE WHEN pos THEN value ELSE -value END), 4), 0)::DOUBLE AS score, max(CASE WHEN pos THEN value END)::DOUBLE AS top_term,
  coalesce(bool_or(ambiguous) FILTER (WHERE pos), false) AS ambiguous FROM al GROUP BY id, category)"""


def _with_source(spark, sf):
    return fx.articles(spark, sf).withColumn("source_category", F.col("category"))


@query("category_scores", f"WITH {_SCORED} SELECT id, category, score, top_term, ambiguous FROM cs")
def _(spark, sf):
    return cl.category_scores(_with_source(spark, sf), fx.rules(spark)).select("id", "category", "score", "top_term", "ambiguous")


_DECIDED = f"""{_SCORED}, co AS (SELECT category, min(cat_ord) AS cat_ord FROM rules GROUP BY category),
rk AS (SELECT cs.*, row_number() OVER (PARTITION BY id ORDER BY score DESC, cat_ord) AS rn FROM cs JOIN co USING (category)),
tp AS (SELECT a.id, coalesce(x.score, 0) AS top, coalesce(y.score, 0) AS second, x.category AS cat, coalesce(x.top_term / x.score, 0) AS ratio, coalesce(x.ambiguous, false) AS amb, ns.notes
  FROM articles a LEFT JOIN rk x ON x.id = a.id AND x.rn = 1 LEFT JOIN ns ON ns.id = x.id AND ns.category = x.category LEFT JOIN rk y ON y.id = a.id AND y.rn = 2),
dc AS MATERIALIZED (SELECT id, CASE WHEN top >= 2 THEN cat ELSE 'general' END AS category, CASE WHEN top >= 2 THEN round_even(top / (top + second + 1), 4) ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN top >= 2 AND (top - second < 2 OR top / (top + second + 1) < 0.62 OR ratio >= 0.5 OR amb) THEN 'rules_low_confidence' ELSE 'rules' END AS method,
  CASE WHEN top < 2 THEN 0.0 WHEN amb THEN greatest(round_even(greatest(ratio, 1 - top / (top + second + 1)), 4), 10.0) ELSE round_even(greatest(ratio, 1 - top / (top + second + 1)), 4) END::DOUBLE AS risk_score,
  CASE WHEN top >= 2 THEN cat || ':score=' || {_num("top")} || ';margin=' || {_num("top - second")} || ';' || notes ELSE 'sin_senales_suficientes' END AS reason FROM tp)"""


@query("classify", f"WITH {_DECIDED} SELECT id, category, confidence, method, risk_score, reason FROM dc")
def _(spark, sf):
    return cl.classify(_with_source(spark, sf), fx.rules(spark)).select("id", "category", "confidence", "method", "risk_score", "reason")


@query("review_quota", f"""WITH {_DECIDED}, b AS (SELECT dc.*, a.collected_at::DATE AS batch FROM dc JOIN articles a USING (id)),
n AS (SELECT *, row_number() OVER (PARTITION BY batch, method ORDER BY risk_score DESC, id) AS rn FROM b)
SELECT id, batch, CASE WHEN method <> 'rules_low_confidence' THEN 'not_eligible' WHEN rn <= 12 THEN 'review' ELSE 'ai_fallback_batch_limit_reached' END AS review_status FROM n""")
def _(spark, sf):
    a = _with_source(spark, sf)
    d = cl.classify(a, fx.rules(spark)).join(a.select("id", F.to_date("collected_at").alias("batch")), "id")
    return cl.review_quota(d, ["batch"]).select("id", "batch", "review_status")


_OPIN = "SELECT doc_id AS id, CASE WHEN quality = 0 THEN 'magia' WHEN toxic = 1 THEN 'Policiales' ELSE 'Economía' END AS oc, (doc_id % 10) / 10.0::DOUBLE AS conf FROM labels"


@query("merge_opinions", f"""WITH {_DECIDED}, op AS ({_OPIN}), j AS (SELECT dc.*, op.oc, op.conf, op.id IS NOT NULL AS given, {fx.sql_fold("op.oc")} AS c FROM dc LEFT JOIN op USING (id)),
k AS (SELECT *, CASE WHEN given AND c NOT IN {_in(CATEGORIES)} THEN 'invalid_category:' || c WHEN given AND conf < 0.55 THEN 'low_confidence:' || regexp_replace(conf::DECIMAL(18,4)::VARCHAR, '\\.?0+$', '') END AS err FROM j)
SELECT id, CASE WHEN given AND err IS NULL THEN c ELSE category END AS category, CASE WHEN given AND err IS NULL THEN conf ELSE confidence END AS confidence,
  CASE WHEN given AND err IS NULL THEN 'llm_fallback' ELSE method END AS method, CASE WHEN given AND err IS NULL THEN category END AS rule_category, err AS opinion_error FROM k""")
def _(spark, sf):
    labels = tables.read_table(spark, sf, "labels")
    opinions = labels.select(
        F.col("doc_id").alias("id"), F.expr("CASE WHEN quality = 0 THEN 'magia' WHEN toxic = 1 THEN 'Policiales' ELSE 'Economía' END").alias("opinion_category"),
        F.expr("(doc_id % 10) / 10.0D").alias("opinion_confidence"), F.lit("").alias("opinion_reason"))
    return cl.merge_opinions(cl.classify(_with_source(spark, sf), fx.rules(spark)), opinions).select("id", "category", "confidence", "method", "rule_category", "opinion_error")


@query("apply_corrections", f"""WITH {fx.ARTICLES}, c0 AS (SELECT doc_id AS article_id, 'salud' AS new_category, TIMESTAMP '2024-02-01' AS tm FROM labels UNION ALL
  SELECT doc_id, 'mundo', TIMESTAMP '2024-02-02' FROM labels WHERE toxic = 1), c AS (SELECT article_id, arg_max(new_category, tm) AS nc, max(tm) AS tm FROM c0 GROUP BY 1)
SELECT id, CASE WHEN is_active AND nc IS NOT NULL THEN nc ELSE category END AS category, CASE WHEN is_active AND nc IS NOT NULL THEN 'manual_correction' ELSE raw_payload ->> '$.category_method' END AS category_method,
  CASE WHEN NOT (is_active AND nc IS NOT NULL) THEN raw_payload ->> '$.category_llm_error' END AS review_error, CASE WHEN is_active AND nc IS NOT NULL THEN category END AS previous_category,
  CASE WHEN is_active AND nc IS NOT NULL THEN tm END AS corrected_at FROM articles LEFT JOIN c ON article_id = id""")
def _(spark, sf):
    labels = tables.read_table(spark, sf, "labels")

    def made(df, category, day):
        return df.select(F.col("doc_id").alias("article_id"), F.lit(category).alias("new_category"), F.lit("review").alias("reason"), F.lit("editor").alias("corrected_by"),
                         F.lit(day).cast("timestamp_ntz").alias("corrected_at"))

    corrections = made(labels, "salud", "2024-02-01").unionByName(made(labels.where("toxic = 1"), "mundo", "2024-02-02"))
    return cl.apply_corrections(fx.articles(spark, sf), corrections).select("id", "category", "category_method", "review_error", "previous_category", "corrected_at")


@query("rule_coverage", f"""WITH {fx.ARTICLES}, {fx.RULES_SQL}, used AS (SELECT DISTINCT category FROM articles), known AS (SELECT category FROM used UNION SELECT 'clima')
SELECT category, 'category_without_rules' AS problem FROM known WHERE category NOT IN (SELECT category FROM rules)
UNION ALL SELECT DISTINCT category, 'rules_without_category' FROM rules WHERE category NOT IN (SELECT category FROM known)""")
def _(spark, sf):
    known = fx.articles(spark, sf).select("category").unionByName(spark.createDataFrame([("clima",)], "category string"))
    return cl.rule_coverage(fx.rules(spark), known)


_MAPPED = (("global", "en", "politica"), ("global", "fr", "economia"), ("src1", "en", "mundo"), ("src2", "de", "magia"), ("global", "de", "deportes"))


@query("source_category", f"""WITH {fx.ARTICLES}, m(s, r, c) AS (VALUES {", ".join(str(x) for x in _MAPPED)}),
v AS (SELECT * FROM m WHERE c IN {_in(CATEGORIES)})
SELECT id, coalesce(o.c, g.c, CASE WHEN lang IN {_in(CATEGORIES)} THEN lang END, '') AS source_category FROM articles a
LEFT JOIN v o ON o.s = lower(a.source) AND o.r = lang LEFT JOIN v g ON g.s = 'global' AND g.r = lang""")
def _(spark, sf):
    mapping = spark.createDataFrame(list(_MAPPED), "source string, raw string, mapped string")
    return cl.map_source_category(fx.articles(spark, sf), mapping, raw="lang").select("id", "source_category")


# --- ranking -----------------------------------------------------------------
_CFG = ScoringConfig(
    source_scores={**{k: v for k, v in ScoringConfig().source_scores.items()}, "src1": 84, "src2": 78, "src3": 82},
    local_terms=(*LOCAL_TERMS, "the", "avec", "und", "para"), foreign_terms=(*FOREIGN_TERMS, "with", "dans"),
    impact_terms=tuple((n, s, (*terms, extra)) for (n, s, terms), extra in zip(IMPACT_TERMS, ("which", "nicht", "pour"))))


def _rx(terms) -> str:
    return _BND + "(" + "|".join(_folded(terms)) + ")" + _END


def _count_terms(x: str, terms) -> str:
    return " + ".join(f"CASE WHEN regexp_matches({x}, '{_BND}{term}{_END}') THEN 1 ELSE 0 END" for term in _folded(terms))


def rank_ctes(source: str = "articles", sources: str = "1") -> str:
    desc, cont, titl = "trim(coalesce(description, ''))", "trim(coalesce(content, ''))", "trim(coalesce(title, ''))"
    buckets = " ".join(f"WHEN hrs < {h} THEN {s}" for h, s in _CFG.recency_buckets)
    scores = " ".join(f"WHEN '{k}' THEN {s}" for k, s in _CFG.source_scores.items())
    impact = " ".join(f"WHEN regexp_matches(stext, '{_rx(terms)}') THEN {s}" for _, s, terms in _CFG.impact_terms)
    return f"""r0 AS MATERIALIZED (SELECT *, {sources} AS nsrc, replace({fx.sql_fold("source")}, ' ', '_') AS csrc, {fx.sql_fold("concat_ws(' ', coalesce(title, ''), coalesce(description, ''), coalesce(content, ''))")} AS stext,
  {fx.sql_words("content")} AS cw, greatest(epoch_us({_NOW} - published_at) / 3600000000.0::DOUBLE, 0) AS hrs FROM {source}),
r1 AS MATERIALIZED (SELECT *, {_count_terms("stext", _CFG.local_terms)} AS loc, regexp_matches(stext, '{_rx(_CFG.foreign_terms)}') AS forn FROM r0),
r2 AS (SELECT *, CASE WHEN published_at IS NULL THEN 20 {buckets} ELSE 10 END AS s1, CASE csrc {scores} ELSE 55 END AS s2,
  least(35 + CASE WHEN cw >= 120 THEN 20 ELSE 0 END + CASE WHEN cw >= 300 THEN 10 ELSE 0 END + CASE WHEN coalesce(length(image), 0) > 0 THEN 10 ELSE 0 END
   + CASE WHEN length({desc}) BETWEEN 60 AND 280 THEN 10 ELSE 0 END + CASE WHEN length({titl}) BETWEEN 30 AND 140 THEN 10 ELSE 0 END, 100) AS s3,
  CASE {impact} ELSE 0 END AS s4, CASE WHEN loc >= 2 THEN 100 WHEN loc = 1 THEN 75 WHEN forn THEN 5 ELSE 45 END AS s5,
  CASE WHEN nsrc >= 3 THEN 100 WHEN nsrc = 2 THEN 70 ELSE 0 END AS s6,
  CASE WHEN category_confidence IS NULL THEN 45 WHEN category_confidence >= 0.8 THEN 100 WHEN category_confidence >= 0.6 THEN 75 WHEN category_confidence >= 0.4 THEN 55 ELSE 35 END AS s7,
  CASE WHEN {cont} = '' THEN 25 WHEN cw < 60 THEN 15 ELSE 0 END + CASE WHEN {desc} <> '' AND {cont} <> '' AND {fx.sql_fold(desc)} = {fx.sql_fold(cont)} THEN 20 ELSE 0 END
   + CASE WHEN published_at IS NULL THEN 10 ELSE 0 END + CASE WHEN csrc IN {_in(_CFG.source_scores)} THEN 0 ELSE 8 END + CASE WHEN coalesce(category_confidence < 0.4, false) THEN 10 ELSE 0 END
   + CASE WHEN forn AND loc = 0 THEN 20 ELSE 0 END AS pen FROM r1),
ranked AS MATERIALIZED (SELECT * EXCLUDE (score), least(greatest(0.15 * s1 + 0.10 * s2 + 0.17 * s3 + 0.20 * s4 + 0.20 * s5 + 0.10 * s6 + 0.08 * s7 - pen, 0), 100)::DECIMAL(18,2)::DOUBLE AS score FROM r2)"""


@query("rank_articles", f"""WITH {fx.ARTICLES}, {rank_ctes()} SELECT id, score, s1 AS recency_score, s2 AS source_score, s3 AS quality_score, s4 AS impact_score, s5 AS local_score,
  s7 AS confidence_score, pen AS penalties FROM ranked""")
def _(spark, sf):
    return rk.score_articles(fx.articles(spark, sf), AS_OF, _CFG).select(
        "id", "score", "recency_score", "source_score", "quality_score", "impact_score", "local_score", "confidence_score", "penalties")


@query("rank_top", f"WITH {fx.ARTICLES}, {rank_ctes()} SELECT id, title, score FROM ranked ORDER BY score DESC, id LIMIT 100")
def _(spark, sf):
    """The ranking itself is a top-k report: no full sort."""
    return rk.rank_articles(fx.articles(spark, sf), AS_OF, 100, _CFG).select("id", "title", "score")


# --- selection ---------------------------------------------------------------
@query("unique_stories", f"""WITH {fx.STORED} SELECT id, story_cluster_id, score FROM stored WHERE duplicate_of_article_id IS NULL
QUALIFY row_number() OVER (PARTITION BY story_cluster_id ORDER BY score DESC, id) = 1""")
def _(spark, sf):
    return sel.unique_stories(fx.stored_articles(spark, sf)).select("id", "story_cluster_id", "score")


def diverse_sql(source: str) -> str:
    return f"""p1 AS (SELECT *, row_number() OVER (PARTITION BY category, lower(trim(source)) ORDER BY score DESC, id) AS rs FROM {source}),
p2 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY CASE WHEN rs > 2 THEN 1 ELSE 0 END, score DESC, id) AS pick FROM p1)"""


_K = "CASE WHEN category IN ('politica', 'economia') THEN 8 ELSE 5 END"


@query("diverse_topk", f"WITH {fx.ARTICLES}, {diverse_sql('articles')} SELECT id, category, source, score, pick FROM p2 WHERE pick <= {_K}")
def _(spark, sf):
    return sel.diverse_topk(fx.articles(spark, sf)).select("id", "category", "source", "score", "pick")


@query("paginate", f"""WITH {fx.ARTICLES} SELECT id, published_at, count(*) OVER () AS total, 3 AS page, 20 AS page_size, ceil(count(*) OVER () / 20)::BIGINT AS total_pages
FROM articles ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 20 OFFSET 40""")
def _(spark, sf):
    rows = fx.articles(spark, sf).select("id", "published_at")
    return sel.paginate(rows, [F.col("published_at").desc_nulls_last(), F.col("id").desc()], page=3)


@query("keyset_page", f"""WITH {fx.ARTICLES} SELECT id, published_at FROM articles WHERE published_at < TIMESTAMP '2024-01-15' OR (published_at = TIMESTAMP '2024-01-15' AND id < 100)
ORDER BY published_at DESC, id DESC LIMIT 20""")
def _(spark, sf):
    return sel.after_key(fx.articles(spark, sf).select("id", "published_at"), datetime(2024, 1, 15), 100)


@query("top_stories", f"""WITH {fx.STORED}, u0 AS (SELECT *, {fx.sql_squeeze(f"lower({_JOINED})")} AS x, {fx.sql_squeeze("lower(title)")} AS y FROM stored),
us AS (SELECT * EXCLUDE (x, y) FROM u0 WHERE length(x) > 0 AND x <> y AND (length(x) >= 50 OR len(string_split(x, ' ')) >= 8)),
du AS (SELECT * FROM us QUALIFY row_number() OVER (PARTITION BY md5(url) ORDER BY collected_at, id) = 1), {rank_ctes("du")},
un AS (SELECT * FROM ranked WHERE duplicate_of_article_id IS NULL QUALIFY row_number() OVER (PARTITION BY story_cluster_id ORDER BY score DESC, id) = 1), {diverse_sql("un")}
SELECT id, category, source, title, score, pick FROM p2 WHERE pick <= {_K}""")
def _(spark, sf):
    """Flagship: usable articles, URL dedup, score, one per story, diverse top-k per category."""
    from ..operators.dedupe import dedup_url

    rows = dedup_url(q.usable_articles(fx.stored_articles(spark, sf)))
    ranked = rk.score_articles(rows.drop("score"), AS_OF, _CFG)
    best = sel.diverse_topk(sel.unique_stories(ranked))
    return best.select("id", "category", "source", "title", "score", "pick")
