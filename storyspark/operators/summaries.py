"""Summary requests and responses as tables; claims with evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CATEGORIES, CATEGORY_ALIASES, SummaryConfig
from ..functions import text as t
from .scan import first_per, top_per
from .stories import story_siblings

CLAIM = "struct<claim:string,confidence:string,claim_type:string,article_id:bigint,excerpt:string>"
ITEM = f"struct<article_id:bigint,title:string,summary:string,fact:string,category:string,source:string,url:string,claims:array<{CLAIM}>>"


def valid_category(value: Column, aliases: dict = CATEGORY_ALIASES, valid: Sequence[str] = tuple(CATEGORIES)) -> Column:
    """Slug of a free category name, NULL if there is none."""
    key = t.category_text(value)
    pairs = []
    for alias, slug in aliases.items():
        pairs += [F.lit(alias), F.lit(slug)]
    slug = F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)
    return F.when(slug.isin(*valid), slug)


def summary_batches(selected: DataFrame, articles: DataFrame, cfg: SummaryConfig = SummaryConfig()) -> DataFrame:
    """One request row per category with its best articles and their siblings.

    Bounded by ``batch_rows`` articles of ``siblings`` sources each, so the collected
    arrays have a fixed size.
    """
    top = top_per(selected, ["category"], [F.col("score").desc(), F.col("id")], cfg.batch_rows, "pos")
    wanted = top.select("id")
    sibs = story_siblings(articles, cfg.siblings).join(wanted, "id", "left_semi").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct(
            "position", F.col("sibling_id").alias("article_id"), F.col("sibling_title").alias("title"),
            F.col("sibling_source").alias("source"), F.col("sibling_url").alias("url")))).alias("siblings"))
    rows = top.join(sibs, "id", "left")
    item = F.struct(
        "pos", F.col("id").alias("article_id"), "title", F.left("description", F.lit(200)).alias("description"),
        t.truncate_content(F.coalesce(F.nullif("content", F.lit("")), F.lit(""))).alias("detail"), "url", "source", "published_at",
        F.coalesce("siblings", F.array()).alias("siblings"))
    return rows.groupBy("category").agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.count("*").alias("n_items"),
        F.sum(F.size(F.coalesce("siblings", F.array()))).alias("n_siblings"))


def decode_responses(responses: DataFrame) -> DataFrame:
    """(batch_id, idx, item) from response texts.

    Candidates are the whole text, fenced blocks and the outermost bracketed span, each
    read as an array or as an object holding one; the candidate with the most complete
    items wins, the earliest on ties.
    """
    text = F.trim(F.coalesce("response", F.lit("")))
    fenced = F.regexp_extract_all(text, F.lit(r"(?is)```(?:json)?\s*(.*?)```"), 1)
    span = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    candidates = F.filter(F.concat(F.array(text), F.transform(fenced, F.trim), F.array(span)), lambda c: F.length(c) > 0)
    wrapped = f"struct<summaries:array<{ITEM}>,items:array<{ITEM}>,data:array<{ITEM}>>"

    def read(c: Column) -> Column:
        as_object = F.from_json(c, wrapped)
        nested = F.coalesce(as_object["summaries"], as_object["items"], as_object["data"])
        return F.when(c.startswith("["), F.from_json(c, f"array<{ITEM}>")).when(c.startswith("{"), nested)

    def full(item: Column) -> Column:
        return F.coalesce((F.length(item["title"]) > 0) & (F.length(item["summary"]) > 0), F.lit(False))

    def scored(c: Column, i: Column) -> Column:
        items = read(c)
        score = F.coalesce(F.size(F.filter(items, full)), F.lit(0))
        return F.struct(score.alias("score"), (-i).alias("neg"), items.alias("items"))

    ranked = F.transform(candidates, scored)
    best_score = F.array_max(F.transform(ranked, lambda s: F.struct(s["score"].alias("score"), s["neg"].alias("neg"))))
    rows = responses.select("batch_id", "category", ranked.alias("ranked"), best_score.alias("best")).where("best.score > 0")
    chosen = F.element_at(F.filter("ranked", lambda s: (s["score"] == F.col("best.score")) & (s["neg"] == F.col("best.neg"))), 1)
    return rows.select("batch_id", F.col("category").alias("requested_category"), F.posexplode(chosen["items"]).alias("idx", "item")).where("item IS NOT NULL")


def summary_rows(responses: DataFrame, originals: DataFrame, cfg: SummaryConfig = SummaryConfig()) -> DataFrame:
    """Summaries matched to their article by id, else by position in the batch.

    ``originals(batch_id, pos, id, title, description, content, category, source, url,
    story_cluster_id, corroborating_sources, published_at)``.
    """
    items = decode_responses(responses)
    o = originals.select("batch_id", "pos", F.struct(
        "id", "title", "description", "content", "category", "source", "url", "story_cluster_id", "corroborating_sources", "published_at").alias("o"))
    by_id = o.groupBy("batch_id", F.col("o.id").alias("item_id")).agg(F.min_by("o", "pos").alias("oi"))
    by_pos = o.select("batch_id", F.col("pos").alias("idx"), F.col("o").alias("op"))
    rows = items.withColumn("item_id", F.col("item.article_id")).join(by_id, ["batch_id", "item_id"], "left").join(by_pos, ["batch_id", "idx"], "left")
    rows = rows.withColumn("orig", F.coalesce("oi", "op")).drop("oi", "op", "item_id")

    def first_text(*columns: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))

    title = t.limit_text(t.clean_generated(first_text("orig.title", "item.title")), cfg.title_chars)
    summary = t.summary_with_context(
        F.col("item.summary"), first_text("orig.description", "orig.content"), cfg.summary_min_chars, cfg.summary_chars)
    sources = F.filter(F.transform("orig.corroborating_sources", lambda s: F.lower(F.trim(s))), lambda s: F.length(s) > 0)
    n_sources = F.when(F.size("orig.corroborating_sources") > 0, F.size(F.array_distinct(sources))).otherwise(F.lit(1))
    category = F.coalesce(
        valid_category(F.col("requested_category")), valid_category(F.col("item.category")),
        valid_category(F.col("orig.category")), F.lit("general"))
    return rows.withColumns({
        "title": title, "summary": summary,
        "fact": t.limit_text(t.clean_generated(F.col("item.fact")), cfg.fact_chars),
        "category": category,
        "article_id": F.coalesce("item.article_id", "orig.id"),
        "story_cluster_id": F.col("orig.story_cluster_id"),
        "source_article_count": F.coalesce(n_sources, F.lit(1)),
        "source": first_text("item.source", "orig.source"), "url": first_text("item.url", "orig.url"),
    }).where((F.length("title") > 0) & (F.length("summary") > 0))


def claims_evidence(rows: DataFrame, evidence: DataFrame, cfg: SummaryConfig = SummaryConfig()) -> DataFrame:
    """Up to ``max_claims`` claims per summary, each tied to a real article.

    ``rows`` come from :func:`summary_rows`; ``evidence(batch_id, idx, ord, article_id, url,
    published_at)`` lists the articles a summary may cite, main article first. A claim
    that cites anything else falls back to the first of them.
    """
    valid = evidence.where(F.length("url") > 0)
    first = valid.groupBy("batch_id", "idx").agg(F.min_by(F.struct("article_id", "url", "published_at"), "ord").alias("main"))
    claims = rows.select("batch_id", "idx", "story_cluster_id", F.posexplode("item.claims").alias("claim_no", "c"))
    text = t.limit_text(t.clean_generated(F.col("c.claim")), cfg.claim_chars)
    claims = claims.withColumn("claim", text).where(F.length("claim") > 0)
    # claims come from one response row, so this group is as short as the response
    claims = top_per(claims, ["batch_id", "idx"], [F.col("claim_no")], cfg.max_claims, "claim_pos")
    cited = valid.groupBy("batch_id", "idx", F.col("article_id").alias("cited_id")).agg(
        F.min_by(F.struct("article_id", "url", "published_at"), "ord").alias("e"))
    out = (
        claims.withColumn("cited_id", F.col("c.article_id")).join(first, ["batch_id", "idx"])
        .join(cited, ["batch_id", "idx", "cited_id"], "left").withColumn("ev", F.coalesce("e", "main")))
    level = F.lower(F.trim(F.coalesce("c.confidence", F.lit(""))))
    return out.select(
        "batch_id", "idx", "claim_pos", "story_cluster_id", "claim",
        F.when(level.isin("multi_source", "single_source", "official_statement"), level).otherwise("single_source").alias("confidence"),
        F.nullif(F.left(t.clean_generated(F.col("c.claim_type")), F.lit(30)), F.lit("")).alias("claim_type"),
        F.col("ev.article_id").alias("article_id"), F.col("ev.url").alias("source_url"),
        F.nullif(t.limit_text(t.clean_generated(F.col("c.excerpt")), cfg.claim_excerpt_chars), F.lit("")).alias("source_excerpt"),
        F.col("ev.published_at").alias("published_at"))


def current_claims(claims: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Claims of the newest set of each story: ``claims(story_id, created_at, ...)``.

    ``sets(story_id, created_at)`` names all sets, empty ones too: where the newest is empty, a story has no claims any more.
    """
    known = claims.select("story_id", "created_at")
    newest = (known if sets is None else known.unionByName(sets.select("story_id", "created_at"))).groupBy("story_id").agg(F.max("created_at").alias("created_at"))
    return claims.join(newest, ["story_id", "created_at"], "left_semi")


def story_key(title_key: Column) -> Column:
    cluster = F.nullif(F.trim("story_cluster_id"), F.lit(""))
    return F.coalesce(F.concat(F.lit("cluster:"), cluster), F.concat(F.lit("title:"), title_key))


def dedup_summaries(summaries: DataFrame) -> DataFrame:
    """First summary per article, then first per category and story."""
    per_article = F.coalesce(F.col("article_id").cast("string"), F.concat(F.lit("row-"), F.col("id").cast("string")))
    once = first_per(summaries.withColumn("__a", per_article), ["__a"], [F.col("id")]).drop("__a")
    key = F.concat(F.lower(F.trim(F.coalesce(F.nullif("category", F.lit("")), F.lit("general")))), F.lit(":"),
                   story_key(t.title_key(F.col("title"))))
    return first_per(once.withColumn("__k", key), ["__k"], [F.col("id")]).drop("__k")


def rewrite_merge(originals: DataFrame, responses: DataFrame, cfg: SummaryConfig = SummaryConfig()) -> DataFrame:
    """Rewritten texts replace summaries by position; a batch without any keeps its originals.

    ``originals(batch_id, pos, summary, ...)`` with ``pos`` from 0,
    ``responses(batch_id, response)`` with lines ``n. title | text``.
    """
    lines = F.transform(F.split("response", "\n"), t.squeeze)
    good = F.filter(lines, lambda s: s.rlike(r"^[0-9][^.]*\.[^|]*\|"))
    texts = F.transform(good, lambda s: t.limit_text(
        t.clean_generated(F.get(F.split(F.regexp_replace(s, r"^[^.]*\.", ""), r"\|"), F.lit(1))), cfg.summary_chars))
    parsed = responses.select("batch_id", texts.alias("texts")).where(F.size("texts") > 0)
    counted = parsed.select("batch_id", F.size("texts").alias("n_rewritten"))
    new = parsed.select("batch_id", F.posexplode("texts").alias("pos", "new_summary"))
    out = originals.join(new, ["batch_id", "pos"], "left").join(counted, "batch_id", "left")
    # rows past the last rewritten line drop out, as in a positional merge
    return out.where(F.col("n_rewritten").isNull() | (F.col("pos") < F.col("n_rewritten"))).withColumns({
        "rewritten": F.col("new_summary").isNotNull(), "summary": F.coalesce("new_summary", "summary"),
    }).drop("new_summary", "n_rewritten")
