"""The whole daily run as one plan: articles in, summary requests out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ClassifyConfig, ScoringConfig, StoryConfig, SummaryConfig
from ..operators.classify import classify
from ..operators.dedupe import dedup_title, dedup_url
from ..operators.quality import usable_articles
from ..operators.rank import score_articles
from ..operators.select import diverse_topk, not_summarized, unique_stories
from ..operators.stories import cluster_ids, corroboration, match_stories
from ..operators.summaries import summary_batches
from ..session import cut


@dataclass(frozen=True)
class DailyConfig:
    classify: ClassifyConfig = field(default_factory=ClassifyConfig)
    scoring: ScoringConfig = field(default_factory=ScoringConfig)
    story: StoryConfig = field(default_factory=StoryConfig)
    summary: SummaryConfig = field(default_factory=SummaryConfig)


def select_articles(
    articles: DataFrame, rules: DataFrame, summaries: DataFrame, as_of: datetime, batch: Sequence[str],
    cfg: DailyConfig = DailyConfig(),
) -> tuple[DataFrame, DataFrame]:
    """(selected articles, all clustered articles) of a run.

    Steps: usable text, URL dedup, title dedup inside a batch, rule categories, stories,
    corroboration inside a batch, score, rows without a summary, one per story, diverse
    top-k. Results read more than once are cut, so that no step runs twice.
    """
    clean = cut(dedup_url(usable_articles(articles)))
    kept = clean.join(dedup_title(clean, batch, cfg.story.title_dedup_threshold), "id", "left_semi")
    decided = classify(kept, rules, cfg.classify).select(
        "id", F.col("category").alias("rule_category"), F.col("confidence").alias("rule_confidence"), "method")
    labelled = cut(
        kept.join(decided, "id").withColumns({"category": F.col("rule_category"), "category_confidence": F.col("rule_confidence")})
        .drop("rule_category", "rule_confidence").withColumnRenamed("method", "category_method"))
    clustered = cut(cluster_ids(labelled, match_stories(labelled, cfg.story), cfg.story))
    together = corroboration(clustered, batch, cfg.scoring).drop("cluster_id")
    scored = score_articles(clustered.drop("score").join(together, "id"), as_of, cfg.scoring)
    fresh = not_summarized(scored.where(F.col("published_at").isNotNull()), summaries)
    return diverse_topk(unique_stories(fresh), cfg.summary), clustered


def summary_requests(
    articles: DataFrame, rules: DataFrame, summaries: DataFrame, as_of: datetime, batch: Sequence[str], cfg: DailyConfig = DailyConfig()
) -> DataFrame:
    """One request row per category."""
    selected, clustered = select_articles(articles, rules, summaries, as_of, batch, cfg)
    return summary_batches(selected, clustered, cfg.summary)
