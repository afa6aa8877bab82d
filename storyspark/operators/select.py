"""Selection, ordering, paging and joins to dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SummaryConfig
from ..functions import text as t
from .scan import attach, first_per, top_per


def with_dimensions(articles: DataFrame, categories: DataFrame, sources: DataFrame) -> DataFrame:
    """article x category x source by id. Spark broadcasts a dimension whose size allows it."""
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"), "display_name")
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"), "source_type")
    return articles.join(c, "category_id").join(s, "source_id")


def summary_with_article(summaries: DataFrame, articles: DataFrame) -> DataFrame:
    """summary left join article: link columns are NULL when the article is gone."""
    linked = articles.select(
        F.col("id").alias("linked_article_id"), F.col("url").alias("article_url"), F.col("title").alias("article_title"),
        "source", "published_at", "duplicate_of_article_id")
    return summaries.join(linked, F.col("article_id") == F.col("linked_article_id"), "left")


def not_summarized(articles: DataFrame, summaries: DataFrame) -> DataFrame:
    done = summaries.select(F.col("article_id").alias("id"))
    return articles.join(done, "id", "left_anti")


def published_only(articles: DataFrame, links: DataFrame, stories: DataFrame) -> DataFrame:
    """Articles of no unpublished story."""
    hidden = links.join(stories.where("current_status = 'unpublished'").select("story_id"), "story_id", "left_semi").select(
        F.col("article_id").alias("id"))
    return articles.join(hidden, "id", "left_anti")


def summaries_published(summaries: DataFrame, stories: DataFrame) -> DataFrame:
    """Summaries of no unpublished story; without a story they pass."""
    hidden = stories.where("current_status = 'unpublished'").select(F.col("story_id").alias("story_cluster_id"))
    return summaries.join(hidden, "story_cluster_id", "left_anti")


def with_source_count(articles: DataFrame, stories: DataFrame) -> DataFrame:
    counts = stories.select(F.col("story_id").alias("story_cluster_id"), "source_count")
    return articles.drop("source_count").join(counts, "story_cluster_id", "left").withColumn(
        "source_count", F.coalesce("source_count", F.lit(1)))


def with_update_notes(summaries: DataFrame, notes: DataFrame) -> DataFrame:
    return summaries.join(notes.select(F.col("story_id").alias("story_cluster_id"), F.col("last_update_note").alias("update_note")),
                          "story_cluster_id", "left")


def unique_stories(articles: DataFrame) -> DataFrame:
    """Best article per story in score order; duplicates are left out, rows without a story stay."""
    key = F.coalesce(F.nullif("story_cluster_id", F.lit("")), F.concat(F.lit("row-"), F.col("id").cast("string")))
    free = articles.where(F.col("duplicate_of_article_id").isNull()).withColumn("__key", key)
    return first_per(free, ["__key"], [F.col("score").desc(), F.col("id")]).drop("__key")


def diverse_topk(articles: DataFrame, cfg: SummaryConfig = SummaryConfig(), category: str = "category", source: str = "source") -> DataFrame:
    """Top k per category with at most ``max_per_source`` per source first, then by score.

    Two top-k windows: per (category, source) no more than k rows can be needed, so Spark
    limits each group before its shuffle; the second window sees k rows per source.
    """
    most = max(cfg.per_category, cfg.extended_limit)
    name = F.coalesce(F.nullif(F.lower(F.trim(source)), F.lit("")), F.lit("unknown"))
    k = F.when(F.lower(F.trim(category)).isin(*cfg.extended_categories), F.lit(cfg.extended_limit)).otherwise(F.lit(cfg.per_category))
    order = [F.col("score").desc(), F.col("id")]
    per_source = top_per(articles.withColumn("__src", name), [category, "__src"], order, most, "__rs")
    tier = F.when(F.col("__rs") > cfg.max_per_source, F.lit(1)).otherwise(F.lit(0))
    ranked = top_per(per_source.withColumn("__tier", tier), [category], [F.col("__tier"), *order], most, "pick")
    return ranked.where(F.col("pick") <= k).drop("__src", "__rs", "__tier")


def paginate(df: DataFrame, order: Sequence[Column], page: int = 1, page_size: int = 20) -> DataFrame:
    """One page with the totals on each row. Deep pages: use :func:`after_key`."""
    page, page_size = max(page, 1), min(max(page_size, 1), 100)
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    return attach(rows, total).withColumns({
        "page": F.lit(page), "page_size": F.lit(page_size), "total_pages": F.ceil(F.col("total") / page_size)})


def after_key(df: DataFrame, published_before: datetime, id_before: int, page_size: int = 20) -> DataFrame:
    """Next page after the last row seen: a filter and a top-k at any depth."""
    at = F.lit(published_before).cast("timestamp_ntz")
    later = (F.col("published_at") < at) | ((F.col("published_at") == at) & (F.col("id") < id_before))
    return df.where(later).orderBy(F.col("published_at").desc(), F.col("id").desc()).limit(page_size)


def list_stories(stories: DataFrame, category: str | None = None, min_sources: int = 1, page: int = 1, page_size: int = 20) -> DataFrame:
    keep = (F.col("source_count") >= max(min_sources, 1)) & (F.col("current_status") != "unpublished")
    if category:
        keep = keep & (F.col("category") == category)
    return paginate(stories.where(keep), [F.col("last_updated_at").desc_nulls_last(), F.col("story_id")], page, page_size)


def brief_preview(
    summaries: DataFrame, stories: DataFrame, categories: Sequence[str], as_of: date, since: datetime | None = None, limit: int = 5
) -> DataFrame:
    """Newest summaries with distinct titles of the latest day of some categories."""
    wanted = summaries_published(summaries.where(F.col("category").isin(*categories)), stories)
    day = wanted.where(F.col("summary_date") <= F.lit(as_of)).agg(F.max("summary_date").alias("effective_date"))
    rows = wanted.join(F.broadcast(day), F.col("summary_date") == F.col("effective_date"))
    if since is not None:
        rows = rows.where(F.col("created_at") > F.lit(since).cast("timestamp_ntz"))
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    unique = first_per(rows.withColumn("title_key", t.title_key_raw(F.col("title"))), ["title_key"], newest)
    return unique.orderBy(*newest).limit(limit)
