"""Logical tables of the engine bound to the given tables, in Spark and in SQL.

Every frame is derived from whole tables. The SQL text of each binding stands next to
its Spark form, so that a query and its SQL check read the same rows.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.urls import url_hash
from ..sources.tables import read_table, spread

AS_OF = datetime(2024, 1, 31, 12, 0)
DAY = date(2024, 1, 20)

SP = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"
WD = r"[\p{L}\p{N}_]"
NOT_WD_SP = r"[^\p{L}\p{N}_\s\p{Z}\x0B\x1C-\x1F\x85]"


# --- SQL text of the shared scalar functions ---------------------------------
def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SP}+', ' ', 'g'))"


def sql_fold(x: str) -> str:
    return sql_squeeze(f"lower(strip_accents(coalesce({x}, '')))")


def sql_match_key(x: str) -> str:
    return sql_squeeze(f"regexp_replace(lower(strip_accents(coalesce({x}, ''))), '{NOT_WD_SP}', ' ', 'g')")


def sql_title_key(x: str) -> str:
    return sql_squeeze(f"regexp_replace(lower(strip_accents(coalesce({x}, ''))), '{NOT_WD_SP}', '', 'g')")


def sql_title_key_raw(x: str) -> str:
    return sql_squeeze(f"regexp_replace(lower({sql_squeeze(x)}), '{NOT_WD_SP}', '', 'g')")


def sql_story_text(x: str) -> str:
    return f"regexp_replace({sql_match_key(x)}, '^((video|ultima hora|ultimo momento|en vivo|envivo) )+', '')"


def sql_words(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '{WD}+'))"


# --- articles ----------------------------------------------------------------
_CATEGORY = "CASE lang WHEN 'en' THEN 'politica' WHEN 'fr' THEN 'economia' WHEN 'de' THEN 'deportes' ELSE 'sociedad' END"
_IMAGE = (
    "CASE WHEN doc_id % 7 = 0 THEN 'https://img.example.com/logo-' || doc_id || '.png' "
    "WHEN doc_id % 11 = 0 THEN ' https://tracker.metricool.com/c3po.jpg?i=' || doc_id "
    "WHEN doc_id % 3 = 0 THEN 'https://img.example.com/' || doc_id || '.jpg' END"
)
_URL = (
    "'http://www.' || source || '.example.com/' || lang || '/nota-' || (doc_id - CASE WHEN doc_id % 10 = 9 THEN 1 ELSE 0 END) "
    "|| CASE WHEN doc_id % 10 = 9 THEN '?utm_source=x&b=2&a=1#top' WHEN doc_id % 10 = 8 THEN '/?b=2&fbclid=q&a=1' "
    "WHEN doc_id % 10 = 7 THEN '?' || 'q=' || lang ELSE '' END"
)
_METHOD = (
    "'{\"category_method\": \"' || CASE WHEN doc_id % 4 = 0 THEN 'rules_low_confidence' ELSE 'rules' END || '\"' || "
    "CASE WHEN doc_id % 17 = 0 THEN ', \"category_llm_error\": \"timeout\"' ELSE '' END || '}'"
)


def articles(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(read_table(spark, sf, "documents"), "doc_id")
    first = t.squeeze(F.split_part("text", F.lit("."), F.lit(1)))
    base = F.lit("2024-01-01").cast("timestamp_ntz")
    minutes = (F.col("doc_id") * 37) % 43200

    def at(m: Column) -> Column:
        return base + F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"))

    published = F.when(F.col("doc_id") % 97 != 0, at(minutes))
    return docs.select(
        F.col("doc_id").alias("id"), first.alias("title"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("description"),
        F.col("text").alias("content"), F.lit(None).cast("string").alias("excerpt"),
        F.expr(_CATEGORY).alias("category"), "lang", "source",
        F.expr("CASE WHEN doc_id % 5 = 0 THEN 'api' ELSE 'scraper' END").alias("source_type"),
        F.expr(_URL).alias("url"), url_hash(F.expr(_URL)).alias("url_hash"), F.expr(_IMAGE).alias("image"),
        F.lit(None).cast("string").alias("country"), published.alias("published_at"),
        at(minutes + (F.col("doc_id") * 13) % 600).alias("collected_at"),
        F.expr("doc_id % 2 = 0").alias("published_at_from_listing"), F.expr("doc_id % 3 = 0").alias("published_at_from_detail"),
        F.expr("CASE WHEN doc_id % 13 <> 0 THEN (doc_id % 11) / 10.0D END").alias("category_confidence"),
        F.expr("doc_id % 29 <> 0").alias("is_active"), F.expr(_METHOD).alias("raw_payload"),
        F.expr("CASE WHEN doc_id % 19 = 0 THEN 'non_today_detail_date' END").alias("skipped_detail_reason"),
        F.expr("((doc_id * 7919) % 10001) / 100.0D").alias("score"),
    )


ARTICLES = f"""articles AS (
  SELECT doc_id AS id, {sql_squeeze("split_part(text, '.', 1)")} AS title, split_part(text, chr(10), 1) AS description,
    text AS content, NULL::VARCHAR AS excerpt, {_CATEGORY} AS category, lang, source,
    CASE WHEN doc_id % 5 = 0 THEN 'api' ELSE 'scraper' END AS source_type,
    {_URL} AS url, md5({_URL}) AS url_hash, {_IMAGE} AS image, NULL::VARCHAR AS country,
    CASE WHEN doc_id % 97 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(((doc_id * 37) % 43200)::INT) END AS published_at,
    TIMESTAMP '2024-01-01' + to_minutes(((doc_id * 37) % 43200 + (doc_id * 13) % 600)::INT) AS collected_at,
    doc_id % 2 = 0 AS published_at_from_listing, doc_id % 3 = 0 AS published_at_from_detail,
    CASE WHEN doc_id % 13 <> 0 THEN (doc_id % 11) / 10.0::DOUBLE END AS category_confidence,
    doc_id % 29 <> 0 AS is_active, {_METHOD} AS raw_payload,
    CASE WHEN doc_id % 19 = 0 THEN 'non_today_detail_date' END AS skipped_detail_reason,
    ((doc_id * 7919) % 10001) / 100.0::DOUBLE AS score
  FROM documents)"""


def stored_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles with a story: equal titles form one story, its lowest id is the original."""
    rows = articles(spark, sf).withColumn("story_cluster_id", F.md5(t.title_key(F.col("title"))))
    lead = rows.groupBy("story_cluster_id").agg(F.min("id").alias("lead"))
    dup = F.when(F.col("id") != F.col("lead"), F.col("lead"))
    return rows.join(lead, "story_cluster_id").withColumns({
        "duplicate_of_article_id": dup, "similarity_score": F.when(dup.isNotNull(), F.lit(1.0)),
        "duplicate_reason": F.when(dup.isNotNull(), F.lit("fingerprint"))}).drop("lead")


STORED = f"""{ARTICLES},
keyed AS (SELECT *, md5({sql_title_key("title")}) AS story_cluster_id FROM articles),
stored AS (SELECT *, nullif(min(id) OVER (PARTITION BY story_cluster_id), id) AS duplicate_of_article_id,
    CASE WHEN min(id) OVER (PARTITION BY story_cluster_id) <> id THEN 1.0::DOUBLE END AS similarity_score FROM keyed)"""


# --- stories -----------------------------------------------------------------
def stories(spark: SparkSession, sf: str) -> DataFrame:
    """Rolled-up stories; some are corrected, contradictory or unpublished by their id."""
    from ..operators.stories import story_rollup

    status = F.expr(
        "CASE substr(story_id, 1, 1) WHEN '0' THEN 'unpublished' WHEN '1' THEN 'corrected' "
        "WHEN '2' THEN 'contradictory' ELSE 'developing' END")
    return story_rollup(stored_articles(spark, sf)).withColumn("current_status", status)


_ROLLUP = """SELECT story_cluster_id AS story_id,
    first(title ORDER BY published_at ASC NULLS LAST, id) AS canonical_title,
    first(category ORDER BY published_at ASC NULLS LAST, id) AS category,
    coalesce(first(country ORDER BY published_at ASC NULLS LAST, id), 'BO') AS country,
    min(published_at) AS first_published_at, max(published_at) AS last_updated_at,
    'developing' AS status0, count(*) AS article_count, count(DISTINCT source) AS source_count
  FROM stored GROUP BY story_cluster_id"""
STORIES = f"""{STORED},
rollup AS ({_ROLLUP}),
stories AS (SELECT * EXCLUDE (status0), CASE substr(story_id, 1, 1) WHEN '0' THEN 'unpublished' WHEN '1' THEN 'corrected'
    WHEN '2' THEN 'contradictory' ELSE 'developing' END AS current_status FROM rollup)"""


# --- summaries: the labelled documents ---------------------------------------
def summaries(spark: SparkSession, sf: str) -> DataFrame:
    labels = read_table(spark, sf, "labels").select("doc_id", "quality")
    rows = stored_articles(spark, sf).join(labels, F.col("id") == F.col("doc_id"))
    at = F.coalesce("published_at", "collected_at")
    return rows.select(
        "id", F.col("id").alias("article_id"), "category", "story_cluster_id", "title",
        t.squeeze(F.col("content")).alias("summary"), F.col("description").alias("fact"),
        F.to_date(at).alias("summary_date"), (at + F.expr("INTERVAL 30 MINUTES")).alias("created_at"), "quality", "score")


SUMMARIES = f"""{STORIES},
summaries AS (SELECT id, id AS article_id, category, story_cluster_id, title, {sql_squeeze("content")} AS summary,
    description AS fact, coalesce(published_at, collected_at)::DATE AS summary_date,
    coalesce(published_at, collected_at) + INTERVAL 30 MINUTE AS created_at, quality, score
  FROM stored JOIN labels ON id = doc_id)"""


# --- product events ----------------------------------------------------------
_EVENT_NAME = (
    "CASE event_type WHEN 'view' THEN 'story_opened' WHEN 'click' THEN 'source_clicked' WHEN 'signup' THEN 'user_registered' "
    "WHEN 'purchase' THEN 'story_saved' ELSE 'client_error' END"
)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select(
        "event_id", F.expr(_EVENT_NAME).alias("event_name"), "user_id",
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.weekofyear("ts").cast("string")).alias("session_id"),
        F.col("ts").alias("created_at"), F.get_json_object("props", "$.k").cast("int").alias("k"), "value")


EVENTS = f"""ev AS (SELECT event_id, {_EVENT_NAME} AS event_name, user_id, user_id || '-' || weekofyear(ts) AS session_id,
    ts AS created_at, (props ->> '$.k')::INT AS k, value FROM events)"""


# --- indicator values --------------------------------------------------------
_ADVERT = (
    "'{\"advertisement\": {\"advertiser\": {\"monthOrderCount\": ' || {k} || ', \"monthFinishRate\": 0.' || (50 + {k} % 50) || "
    "', \"userType\": \"' || CASE WHEN {k} % 5 = 0 THEN 'user' ELSE 'merchant' END || '\"}}}'"
)
_SPARK_K = "CAST(get_json_object(props, '$.k') AS INT)"
_SQL_K = "(props ->> '$.k')::INT"
_CURRENCY = "CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'BOB' END"


def indicators(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.lit("feed").alias("source"), F.col("event_type").alias("indicator_code"),
        F.expr("CAST(round(value, 0) AS DECIMAL(18,6))").alias("value"), F.expr(_CURRENCY).alias("currency"),
        F.lit(None).cast("string").alias("asset"), F.lit(None).cast("string").alias("side"),
        F.expr("CASE WHEN event_id % 4 = 0 THEN CAST(NULL AS DATE) ELSE CAST(ts AS DATE) END").alias("observed_at"),
        F.col("ts").alias("collected_at"), F.expr(_ADVERT.replace("{k}", _SPARK_K)).alias("raw_payload"))


INDICATORS = f"""ind AS (SELECT event_id AS id, 'feed' AS source, event_type AS indicator_code, round(value, 0)::DECIMAL(18,6) AS value,
    {_CURRENCY} AS currency, NULL::VARCHAR AS asset, NULL::VARCHAR AS side,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts::DATE END AS observed_at, ts AS collected_at,
    {_ADVERT.replace("{k}", _SQL_K)} AS raw_payload, {_SQL_K} AS k FROM events)"""


# --- collection runs: one per order ------------------------------------------
_RUN = {
    "raw_collected_count": "o_custkey % 200",
    "usable_count": "(o_custkey % 200) - (o_custkey % 200) % 17",
    "quality_dropped_count": "(o_custkey % 200) % 17",
    "deduplicated_count": "(o_custkey % 200) - (o_custkey % 200) % 31",
    "duplicate_dropped_count": "(o_custkey % 200) % 31",
    "ranked_count": "(o_custkey % 200) - (o_custkey % 200) % 31",
    "summary_candidates_count": "o_custkey % 50",
    "summaries_count": "o_custkey % 23",
    "ai_dedup_count": "(o_custkey % 50) - (o_custkey % 50) % 7",
    "inserted_count": "(o_custkey % 60) - 5",
    "updated_count": "o_custkey % 40",
}


def runs(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders")
    day = F.date_diff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")) % 45
    started = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        day, (F.col("o_orderkey") % 24).cast("int"), (F.col("o_orderkey") % 60).cast("int"))
    return orders.select(
        F.col("o_orderkey").alias("id"), started.alias("started_at"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'partial' END").alias("status"),
        *[F.expr(e).cast("bigint").alias(n) for n, e in _RUN.items()],
        F.expr("o_orderpriority = '1-URGENT'").alias("used_cached_articles"), F.lit(False).alias("used_cached_summaries"))


RUNS = f"""runs AS (SELECT o_orderkey AS id,
    TIMESTAMP '2024-01-01' + to_days((date_diff('day', DATE '1995-01-01', o_orderdate::DATE) % 45)::INT)
      + to_hours((o_orderkey % 24)::INT) + to_minutes((o_orderkey % 60)::INT) AS started_at,
    CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'partial' END AS status,
    {", ".join(f"({e})::BIGINT AS {n}" for n, e in _RUN.items())},
    o_orderpriority = '1-URGENT' AS used_cached_articles, false AS used_cached_summaries FROM orders)"""


# --- subscribers -------------------------------------------------------------
_CHANNEL = "CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'AUTOMOBILE') THEN 'email' WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'telegram' ELSE 'whatsapp' END"
_FREQ = "CASE c_nationkey % 4 WHEN 0 THEN 'diario' WHEN 1 THEN 'dias_habiles' WHEN 2 THEN 'tres_veces_semana' ELSE 'semanal' END"
_ZONE = "CASE c_nationkey % 5 WHEN 0 THEN 'America/La_Paz' WHEN 1 THEN 'Europe/Madrid' WHEN 2 THEN 'Asia/Tokyo' WHEN 3 THEN 'UTC' ELSE 'Nowhere/Else' END"
_CATS = "CASE c_nationkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'politica' WHEN 2 THEN 'economia,sociedad' WHEN 3 THEN 'deportes,politica' WHEN 4 THEN 'Sociedad ,economia,economia' ELSE 'politica,magia' END"
_PHONE = "CASE c_nationkey % 3 WHEN 0 THEN '00591 7' || (1000000 + c_custkey) WHEN 1 THEN '(591) 7-' || c_custkey ELSE '' END"
_MAIL = "CASE c_nationkey % 4 WHEN 0 THEN ' User' || c_custkey || '@Example.com ' WHEN 1 THEN 'no-at-sign' ELSE '' END"
_TELEGRAM = "CASE WHEN c_nationkey % 2 = 0 THEN 'tg' || c_custkey ELSE '  ' END"
_PERIOD = "CASE c_nationkey % 5 WHEN 0 THEN 'manana' WHEN 1 THEN 'tarde' WHEN 2 THEN 'noche' WHEN 3 THEN 'otro' END"
_HOUR = "CAST(7 + c_custkey % 18 AS INT)"


def subscribers(spark: SparkSession, sf: str) -> DataFrame:
    cats = F.expr(_CATS)
    return read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.expr(_CHANNEL).alias("channel"), F.expr(_FREQ).alias("frequency"), F.expr(_ZONE).alias("timezone"),
        F.when(cats == "", F.array().cast("array<string>")).otherwise(F.split(cats, ",")).alias("categories"),
        F.expr(_PHONE).alias("phone"), F.expr(_MAIL).alias("email"), F.expr(_TELEGRAM).alias("telegram_id"), F.expr(_PERIOD).alias("preferred_time"),
        F.expr(_HOUR).alias("preferred_hour"), F.expr("c_acctbal > 0").alias("is_active"), F.expr("c_custkey % 9 <> 0").alias("consent_accepted"),
        (F.lit("2024-01-10").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("c_custkey") % 400).cast("int"))).alias("notified"),
    ).withColumn("last_notified_at", F.when(F.col("id") % 7 != 0, F.col("notified"))).drop("notified")


SUBSCRIBERS = f"""subs AS (SELECT c_custkey AS id, {_CHANNEL} AS channel, {_FREQ} AS frequency, {_ZONE} AS timezone,
    CASE WHEN ({_CATS}) = '' THEN []::VARCHAR[] ELSE string_split({_CATS}, ',') END AS categories,
    {_PHONE} AS phone, {_MAIL} AS email, {_TELEGRAM} AS telegram_id, {_PERIOD} AS preferred_time, {_HOUR} AS preferred_hour,
    c_acctbal > 0 AS is_active, c_custkey % 9 <> 0 AS consent_accepted,
    CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '2024-01-10' + to_hours((c_custkey % 400)::INT) END AS last_notified_at FROM customer)"""


# --- generated responses: one batch per conversation -------------------------
def conversation_batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(originals, responses, evidence): user turns are the articles, assistant turns the answers."""
    turns = read_table(spark, sf, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    batch = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.floor(F.col("turn") / 2).cast("string"))
    lang = F.expr("CASE conv_id % 4 WHEN 0 THEN 'Futbol' WHEN 1 THEN 'Política' WHEN 2 THEN 'nacional' ELSE 'cosas' END")
    first = t.squeeze(F.split_part("text", F.lit("."), F.lit(1)))
    originals = turns.where("role = 'user'").select(
        batch.alias("batch_id"), F.lit(0).alias("pos"), key.alias("id"), first.alias("title"), F.col("text").alias("description"),
        F.col("text").alias("content"), lang.alias("category"), F.concat(F.lit("src"), (F.col("conv_id") % 5).cast("string")).alias("source"),
        F.concat(F.lit("https://news.example.com/"), key.cast("string")).alias("url"), F.lit(None).cast("string").alias("story_cluster_id"),
        F.array(F.lit("A "), F.lit("a"), F.concat(F.lit("s"), (F.col("conv_id") % 3).cast("string"))).alias("corroborating_sources"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("conv_id") % 500).cast("int"))).alias("published_at"))
    claim = F.struct(
        F.concat(F.lit("1. "), F.col("text")).alias("claim"),
        F.expr("CASE conv_id % 3 WHEN 0 THEN 'Multi_Source' WHEN 1 THEN 'rumour' END").alias("confidence"), F.lit("dato").alias("claim_type"),
        F.when(F.col("conv_id") % 2 == 0, key - 1).otherwise(F.lit(-1).cast("bigint")).alias("article_id"), F.col("text").alias("excerpt"))
    item = F.struct(
        F.when(F.col("conv_id") % 2 == 0, key - 1).alias("article_id"), first.alias("title"),
        F.concat(F.lit("2) "), F.col("text")).alias("summary"), F.col("text").alias("fact"), F.array(claim, claim, claim, claim).alias("claims"))
    body = F.to_json(F.array(item))
    wrapped = (
        F.when(F.col("conv_id") % 3 == 0, body).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("Claro:\n```json\n"), body, F.lit("\n```\n")))
        .otherwise(F.concat(F.lit('{"summaries": '), body, F.lit("}"))))
    # an answer that breaks off inside its first item
    wrapped = F.when(F.col("conv_id") % 10 == 9, F.concat(F.lit('[{"summary": "'), F.regexp_replace("text", r'["\\\[\]{}]', " "))).otherwise(wrapped)
    category = F.expr("CASE conv_id % 2 WHEN 0 THEN 'Politica nacional' ELSE 'otra' END")
    responses = turns.where("role = 'assistant'").select(batch.alias("batch_id"), category.alias("category"), wrapped.alias("response"))
    evidence = originals.select("batch_id", F.lit(0).alias("idx"), F.lit(0).alias("ord"), F.col("id").alias("article_id"), "url", "published_at")
    return originals, responses, evidence


# --- rules on the vocabulary of the texts ------------------------------------
RULES = {
    "politica": {
        "positive": [{"term": "the", "weight": 1}, {"term": "with this", "weight": 2}, {"term": "and", "weight": 2}, {"term": "for the", "weight": 3}],
        "negative": [{"term": "avec", "weight": 2}],
    },
    "economia": {
        "positive": [{"term": "avec", "weight": 3}, {"term": "de la", "weight": 2, "ambiguous": True}, {"term": "êtes", "weight": 2}, {"term": "dans", "weight": 2}],
        "negative": [{"term": "und", "weight": 1}],
    },
    "deportes": {
        "positive": [{"term": "nicht", "weight": 3}, {"term": "und", "weight": 2}, {"term": "für", "weight": 2}, {"term": "sch[a-z]*en", "weight": 2, "regex": True}],
        "negative": [],
    },
    "sociedad": {
        "positive": [{"term": "para", "weight": 3}, {"term": "con", "weight": 2}, {"term": "que la", "weight": 2, "ambiguous": True}, {"term": "re.", "weight": 1}],
        "negative": [{"term": "the", "weight": 1}],
    },
    "viajes": {"positive": [{"term": "from", "weight": 2}], "negative": []},
}


def rules(spark: SparkSession) -> DataFrame:
    from ..operators.classify import rules_from_mapping

    return rules_from_mapping(spark, RULES)


def _rule_rows() -> str:
    rows = []
    for cat_ord, (category, spec) in enumerate(RULES.items()):
        ord_ = 0
        for polarity in ("positive", "negative"):
            for r in spec[polarity]:
                rows.append(
                    f"('{category}', {cat_ord}, '{polarity}', {ord_}, '{r['term']}', {str(bool(r.get('regex'))).lower()}, "
                    f"{float(r['weight'])}::DOUBLE, {str(bool(r.get('ambiguous'))).lower()})")
                ord_ += 1
    return ", ".join(rows)


RULES_SQL = f"rules(category, cat_ord, polarity, ord, term, is_regex, weight, ambiguous) AS (VALUES {_rule_rows()})"
