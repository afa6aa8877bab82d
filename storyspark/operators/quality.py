"""Predicates, filters and record cleaning."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CATEGORIES, EVENT_NAMES, PREFERRED_HOURS
from ..functions import text as t


def _joined(*columns: str) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])


def usable_text(title: str = "title", fields: Sequence[str] = ("description", "content", "excerpt")) -> Column:
    """Some text that is not just the title: 50 characters or 8 words at least."""
    short_title = t.squeeze(F.lower(F.col(title)))

    def usable(text: Column) -> Column:
        long_enough = (F.length(text) >= 50) | (F.size(F.split(text, " ")) >= 8)
        return (F.length(text) > 0) & (text != short_title) & long_enough

    return t.once(t.squeeze(F.lower(_joined(*fields))), usable)


def usable_articles(df: DataFrame) -> DataFrame:
    return df.where(usable_text())


def drop_reason(as_of: datetime, fields: Sequence[str] = ("description", "content", "excerpt")) -> Column:
    """Why the collector drops a row; NULL for kept rows."""
    joined = F.trim(_joined(*fields))
    no_text = t.once(t.match_key(joined), lambda key: (F.length(key) == 0) | (key == t.match_key(F.col("title"))))
    short = (t.word_count(joined) < 8) & (F.length(joined) < 50)
    return (
        F.when(no_text, "no_text")
        .when(short, "too_short")
        .when(F.col("published_at") > F.lit(as_of).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"), "future_date")
        .when(F.coalesce(F.col("skipped_detail_reason") == "non_today_detail_date", F.lit(False)), "old_detail")
        .when(F.col("published_at").isNull(), "no_date")
    )


def drop_report(df: DataFrame, as_of: datetime) -> DataFrame:
    reason = F.coalesce(drop_reason(as_of), F.lit("kept"))
    return df.groupBy(reason.alias("drop_reason")).agg(F.count("*").alias("n"))


def published_since_local_midnight(
    as_of_utc: datetime, zone: str = "America/La_Paz", column: str = "published_at", utc_column: str | None = None
) -> Column:
    """Rows of the local day of ``as_of_utc``. ``utc_column`` holds zone-aware times as UTC."""
    now = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.lit(as_of_utc).cast("timestamp_ntz"))
    midnight = F.to_date(now).cast("timestamp_ntz")
    local = F.col(column)
    if utc_column:
        local = F.coalesce(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(utc_column)), local)
    return local.isNotNull() & (local >= midnight)


def day_range(column: Column, day: date) -> Column:
    """Half-open day range; reaches the Parquet scan as two comparisons."""
    start = F.lit(datetime(day.year, day.month, day.day)).cast("timestamp_ntz")
    return (column >= start) & (column < start + F.expr("INTERVAL 1 DAY"))


def article_filters(
    category: str | None = None, source: str | None = None, q: str | None = None, day: date | None = None
) -> Column:
    """Listing predicate over article columns; anti joins are separate operators."""
    keep = F.col("is_active") & F.col("duplicate_of_article_id").isNull()
    if day:
        keep = keep & day_range(F.col("published_at"), day)
    if category:
        keep = keep & (F.col("category") == category.strip().lower())
    if source:
        keep = keep & (F.lower("source") == source.strip().lower())
    if q:
        needle = F.lit(q.strip().lower())
        hit = F.lit(False)
        for name in ("title", "description", "content"):
            hit = hit | F.coalesce(F.contains(F.lower(F.col(name)), needle), F.lit(False))
        keep = keep & hit
    return keep


def summary_filters(category: str | None = None, day: date | None = None, article_id: int | None = None) -> Column:
    """Summary predicate: duplicates are hidden unless one article is asked for."""
    keep = F.lit(True)
    if day:
        keep = keep & (F.col("summary_date") == F.lit(day))
    if category:
        keep = keep & (F.col("category") == category.strip().lower())
    if article_id is not None:
        return keep & (F.col("article_id") == article_id)
    return keep & (F.col("linked_article_id").isNull() | F.col("duplicate_of_article_id").isNull())


def event_allowed(names: Sequence[str] = EVENT_NAMES) -> Column:
    return F.coalesce(F.col("event_name").isin(*names), F.lit(False))


def content_for_response(content: Column, description: Column) -> Column:
    """NULL for a content that only repeats the description."""
    d = F.lower(t.squeeze(description))
    same = (F.length(d) > 0) & (F.lower(t.squeeze(content)) == d)
    return F.when((F.length(content) > 0) & ~same, content)


def validate_subscribers(df: DataFrame, categories: Sequence[str] = tuple(CATEGORIES)) -> DataFrame:
    """Clean columns plus ``errors``; an empty array means a valid record."""
    digits = F.regexp_replace(F.trim("phone"), r"[\s().-]+", "")
    digits = F.when(digits.startswith("00"), F.concat(F.lit("+"), F.substr(digits, F.lit(3)))).otherwise(digits)
    phone = F.nullif(
        F.when((F.length(digits) > 0) & ~digits.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits),
        F.lit(""),
    )
    email = F.nullif(F.lower(F.trim("email")), F.lit(""))
    telegram = F.nullif(F.trim("telegram_id"), F.lit(""))
    wanted = F.array_sort(F.array_distinct(F.filter(
        F.transform("categories", lambda c: F.lower(F.trim(c))), lambda c: F.length(c) > 0)))
    zone = F.coalesce(F.nullif(F.trim("timezone"), F.lit("")), F.lit("America/La_Paz"))
    bad_email = email.isNotNull() & (
        (F.length(email) > 254) | ~email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"))
    ok_email = F.when(~bad_email, email)
    known = F.array(*[F.lit(c) for c in categories])
    ch = F.col("channel")
    rules = [
        ("email_invalid", bad_email),
        ("category_unknown", F.size(F.array_except(wanted, known)) > 0),
        ("category_missing", F.coalesce(F.size(wanted) <= 0, F.lit(True))),
        ("timezone_invalid", ~zone.rlike(r"^[A-Za-z_]+/[A-Za-z_-]+$")),
        ("hour_invalid", ~F.col("preferred_hour").between(9, 23)),
        ("consent_missing", ~F.coalesce(F.col("consent_accepted"), F.lit(False))),
        ("phone_missing", (ch == "whatsapp") & phone.isNull()),
        ("phone_invalid", (ch == "whatsapp") & phone.isNotNull() & ~phone.rlike(r"^\+[0-9]{8,15}$")),
        ("telegram_missing", (ch == "telegram") & telegram.isNull()),
        ("email_missing", (ch == "email") & ok_email.isNull()),
    ]
    errors = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules]))
    return df.withColumns({
        "clean_phone": phone, "clean_email": ok_email, "clean_telegram_id": telegram,
        "clean_categories": wanted, "clean_timezone": zone, "errors": errors,
    })


def preferred_hour(period: Column) -> Column:
    """Old period names to hours; 9 for anything else."""
    out = F.lit(9)
    for name, hour in PREFERRED_HOURS.items():
        out = F.when(period == name, F.lit(hour)).otherwise(out)
    return out


def review_queue(df: DataFrame, since: datetime, limit: int = 50) -> DataFrame:
    """Recent rows with a doubtful category, newest first."""
    method = F.get_json_object("raw_payload", "$.category_method")
    error = F.get_json_object("raw_payload", "$.category_llm_error")
    doubtful = (method == "rules_low_confidence") | (F.length(error) > 0)
    return (
        df.where(F.col("is_active") & (F.col("collected_at") >= F.lit(since).cast("timestamp_ntz")))
        .where(F.coalesce(doubtful, F.lit(False)))
        .withColumns({"category_method": method, "review_error": error})
        .orderBy(F.col("collected_at").desc(), F.col("id").desc())
        .limit(limit)
    )
