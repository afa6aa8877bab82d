"""Editorial score: seven weighted components minus penalties."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ScoringConfig
from ..functions import text as t
from ..functions.values import hours_between

_SCORE = "decimal(18,6)"


def _map(values: dict) -> Column:
    flat = []
    for key, value in values.items():
        flat += [F.lit(key), F.lit(value)]
    return F.create_map(*flat)


def canonical_source(source: Column, cfg: ScoringConfig = ScoringConfig()) -> Column:
    key = F.replace(t.fold(source), F.lit(" "), F.lit("_"))
    return F.coalesce(F.try_element_at(_map(cfg.source_aliases), key), key)


def article_text(chars: int | None = None) -> Column:
    content = F.coalesce("content", F.lit(""))
    return t.fold(F.concat_ws(
        " ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")), content if chars is None else F.left(content, F.lit(chars))))


def _folded(terms: Sequence[str]) -> list[str]:
    import unicodedata

    def one(term: str) -> str:
        marks = unicodedata.normalize("NFD", term.lower())
        return " ".join("".join(c for c in marks if unicodedata.category(c) != "Mn").split())

    return list(dict.fromkeys(one(x) for x in terms))


def recency_score(published: Column, as_of: datetime, cfg: ScoringConfig = ScoringConfig()) -> Column:
    hours = F.greatest(hours_between(F.lit(as_of).cast("timestamp_ntz"), published), F.lit(0.0))
    out = F.when(published.isNull(), F.lit(cfg.recency_missing))
    for limit, score in cfg.recency_buckets:
        out = out.when(hours < limit, F.lit(score))
    return out.otherwise(F.lit(cfg.recency_default))


def source_score(canonical: Column, cfg: ScoringConfig = ScoringConfig()) -> Column:
    return F.coalesce(F.try_element_at(_map(cfg.source_scores), canonical), F.lit(cfg.source_default))


def quality_score(cfg: ScoringConfig = ScoringConfig()) -> Column:
    title, description = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("description", F.lit("")))
    count = F.col("content_words")

    def bonus(cond: Column, points: int) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.lit(points)).otherwise(F.lit(0))

    total = (
        F.lit(cfg.quality_base)
        + bonus(count >= cfg.good_words, cfg.good_words_bonus)
        + bonus(count >= cfg.excellent_words, cfg.excellent_words_bonus)
        + bonus(F.length("image") > 0, cfg.image_bonus)
        + bonus(F.length(description).between(60, 280), cfg.description_bonus)
        + bonus(F.length(title).between(30, 140), cfg.title_bonus)
    )
    return F.least(total, F.lit(cfg.quality_max))


def _split(terms: Sequence[str]) -> tuple[list[str], list[str]]:
    """Single words, found in the token array, and everything else, found in the text."""
    single = [x for x in terms if x and all(ch.isalnum() or ch == "_" for ch in x)]
    return single, [x for x in terms if x and x not in single]


def _any_term(words: Column, tokens: Column, terms: Sequence[str]) -> Column:
    single, rest = _split(_folded(terms))
    hit = F.arrays_overlap(tokens, F.array(*[F.lit(x) for x in single])) if single else F.lit(False)
    for term in rest:
        hit = hit | t.has_term(words, term)
    return hit


def impact_level(words: Column, tokens: Column, cfg: ScoringConfig = ScoringConfig()) -> Column:
    """Name of the highest level with a matching term, NULL if there is none."""
    level = F.lit(None).cast("string")
    for name, _, terms in sorted(cfg.impact_terms, key=lambda x: x[1]):
        level = F.when(_any_term(words, tokens, terms), F.lit(name)).otherwise(level)
    return level


def _matches(words: Column, tokens: Column, terms: Sequence[str]) -> Column:
    """How many list entries match; entries that fold to the same text count each."""
    entries = _expanded(terms)
    single, rest = _split(list(dict.fromkeys(entries)))
    count = F.size(F.array_intersect(tokens, F.array(*[F.lit(x) for x in single]))) if single else F.lit(0)
    for term in rest + [x for n, x in enumerate(entries) if x in entries[:n]]:
        count = count + t.has_term(words, term).cast("int")
    return count


def _expanded(terms: Sequence[str]) -> list[str]:
    return [_folded([x])[0] for x in terms]


def local_score(local: Column, foreign: Column, cfg: ScoringConfig = ScoringConfig()) -> Column:
    return (
        F.when(local >= 2, F.lit(cfg.local_strong)).when(local == 1, F.lit(cfg.local_medium))
        .when(foreign, F.lit(cfg.foreign_only)).otherwise(F.lit(cfg.local_weak))
    )


def corroboration_score(sources: Column, cfg: ScoringConfig = ScoringConfig()) -> Column:
    return (
        F.when(sources >= 3, F.lit(cfg.three_sources)).when(sources == 2, F.lit(cfg.two_sources)).otherwise(F.lit(0))
    )


def confidence_score(confidence: Column, cfg: ScoringConfig = ScoringConfig()) -> Column:
    out = F.when(confidence.isNull(), F.lit(cfg.confidence_missing))
    for minimum, score in cfg.confidence_buckets:
        out = out.when(confidence >= float(minimum), F.lit(score))
    return out.otherwise(F.lit(cfg.confidence_default))


def penalty_flags(cfg: ScoringConfig = ScoringConfig()) -> list[tuple[str, Column, int]]:
    content, description = F.trim(F.coalesce("content", F.lit(""))), F.trim(F.coalesce("description", F.lit("")))
    return [
        ("missing_content", F.length(content) == 0, cfg.missing_content),
        ("short_content", (F.length(content) > 0) & (F.col("content_words") < 60), cfg.short_content),
        ("duplicated_description",
         (F.length(description) > 0) & (F.length(content) > 0) & (t.fold(description) == t.fold(content)),
         cfg.duplicated_description),
        ("missing_date", F.col("published_at").isNull(), cfg.missing_date),
        ("unknown_source", ~F.col("canonical_source").isin(*cfg.source_scores), cfg.unknown_source),
        ("low_category_confidence", F.coalesce(F.col("category_confidence") < 0.4, F.lit(False)), cfg.low_confidence),
        ("foreign_without_local_context", F.col("has_foreign") & (F.col("local_matches") == 0), cfg.foreign_penalty),
    ]


def score_articles(df: DataFrame, as_of: datetime, cfg: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Adds components, penalties, ``score`` and ``score_reasons``.

    Expects ``source_count`` (see corroboration); a missing column counts as one source.
    Narrow transformation only: no shuffle. Components and weights are exact decimals.
    """
    count = F.coalesce(F.col("source_count"), F.lit(1)) if "source_count" in df.columns else F.lit(1)
    base = df.withColumns({
        "canonical_source": canonical_source(F.col("source"), cfg),
        "score_text": t.word_string(article_text(cfg.text_chars)),
        "content_words": t.word_count(F.col("content")),
    })
    base = base.withColumn("score_tokens", F.split("score_text", " "))
    words, tokens = F.col("score_text"), F.col("score_tokens")
    base = base.withColumns({
        "local_matches": _matches(words, tokens, cfg.local_terms),
        "has_foreign": _any_term(words, tokens, cfg.foreign_terms),
        "impact_level": impact_level(words, tokens, cfg),
    })
    flags = penalty_flags(cfg)
    penalty = F.lit(0)
    for _, cond, points in flags:
        penalty = penalty + F.when(cond, F.lit(points)).otherwise(F.lit(0))
    scored = base.withColumns({
        "impact_score": F.coalesce(
            F.try_element_at(_map({name: points for name, points, _ in cfg.impact_terms}), F.col("impact_level")), F.lit(0)),
        "recency_score": recency_score(F.col("published_at"), as_of, cfg),
        "source_score": source_score(F.col("canonical_source"), cfg),
        "quality_score": quality_score(cfg),
        "local_score": local_score(F.col("local_matches"), F.col("has_foreign"), cfg),
        "corroboration_score": corroboration_score(count, cfg),
        "confidence_score": confidence_score(F.col("category_confidence"), cfg),
        "penalties": penalty,
        "penalty_reasons": F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c, _ in flags])),
    })
    parts = {
        "recency": "recency_score", "source": "source_score", "content_quality": "quality_score",
        "impact": "impact_score", "local_relevance": "local_score", "corroboration": "corroboration_score",
        "category_confidence": "confidence_score",
    }
    total = F.lit(0).cast(_SCORE)
    for name, column in parts.items():
        total = total + F.lit(cfg.weights[name]).cast("decimal(8,4)") * F.col(column).cast("decimal(8,2)")
    total = total - F.col("penalties").cast("decimal(8,2)")
    final = F.round(F.least(F.greatest(total, F.lit(0).cast(_SCORE)), F.lit(100).cast(_SCORE)), 2).cast("double")
    reasons = F.array_compact(F.concat(
        F.array(
            F.when(F.col("published_at").isNull(), "no_date"),
            F.when(F.col("canonical_source") == "", "no_source")
            .when(F.col("canonical_source").isin(*cfg.source_scores), F.concat(F.lit("source:"), "canonical_source"))
            .otherwise(F.concat(F.lit("unknown_source:"), "canonical_source")),
            F.when(F.col("impact_level").isNotNull(), F.concat(F.lit("impact:"), "impact_level")).otherwise("impact:none"),
            F.when(count >= 2, F.concat(F.lit("corroborated:"), count.cast("string"))),
        ),
        F.transform("penalty_reasons", lambda r: F.concat(F.lit("penalty:"), r)),
    ))
    return scored.withColumns({"score": final, "score_reasons": reasons}).drop("score_text", "score_tokens", "penalty_reasons")


def rank_articles(df: DataFrame, as_of: datetime, limit: int | None = None, cfg: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Scored rows, best first; ``limit`` becomes a top-k without a full sort."""
    ranked = score_articles(df, as_of, cfg).orderBy(F.col("score").desc(), F.col("id"))
    return ranked.limit(limit) if limit else ranked
