"""Declared schemas of the stored tables. Production reads never infer."""

from __future__ import annotations

TABLES = {
    "news_articles": (
        "id bigint, title string, url string, url_hash string, canonical_key string, content_fingerprint string, "
        "story_cluster_id string, duplicate_of_article_id bigint, duplicate_reason string, similarity_score double, "
        "description string, content string, author string, image_url string, source_id bigint, category_id bigint, "
        "country string, published_at timestamp_ntz, collected_at timestamp_ntz, raw_payload string, score double, "
        "is_active boolean"
    ),
    "news_sources": "id bigint, name string, source_type string, base_url string, is_active boolean",
    "news_categories": "id bigint, name string, display_name string, is_active boolean",
    "news_summaries": (
        "id bigint, article_id bigint, category_id bigint, story_cluster_id string, source_article_count int, title string, "
        "summary string, fact string, llm_provider string, llm_model string, summary_date date, created_at timestamp_ntz"
    ),
    "stories": (
        "id string, canonical_title string, short_summary string, category string, country string, "
        "first_published_at timestamp_ntz, last_updated_at timestamp_ntz, current_status string, article_count int, "
        "source_count int, last_update_note string"
    ),
    "story_articles": "story_id string, article_id bigint, similarity_score double, relationship_type string",
    "story_claims": "id bigint, story_id string, claim string, confidence string, claim_type string, created_at timestamp_ntz",
    "claim_evidence": "claim_id bigint, article_id bigint, source_url string, source_excerpt string, published_at timestamp_ntz",
    "story_corrections": "id bigint, story_id string, reason string, corrected_by string, corrected_at timestamp_ntz",
    "collection_runs": (
        "id bigint, started_at timestamp_ntz, finished_at timestamp_ntz, status string, scraper_count int, inserted_count int, "
        "updated_count int, raw_collected_count int, usable_count int, quality_dropped_count int, deduplicated_count int, "
        "duplicate_dropped_count int, ranked_count int, summary_candidates_count int, summaries_count int, ai_dedup_count int, "
        "used_cached_articles boolean, used_cached_summaries boolean, metrics_payload string"
    ),
    "analytics_events": (
        "id bigint, event_name string, user_id bigint, session_id string, country string, department string, category string, "
        "story_id string, source_id string, device string, metadata_payload string, created_at timestamp_ntz"
    ),
    "economic_indicator_values": (
        "id bigint, source string, indicator_code string, indicator_name string, indicator_group string, value decimal(18,6), "
        "unit string, currency string, asset string, side string, observed_at date, collected_at timestamp_ntz, "
        "snapshot_key string, raw_payload string"
    ),
    "price_alert_state": "indicator_code string, reference_value decimal(18,6), reference_collected_at timestamp_ntz",
    "subscribers": (
        "id bigint, phone string, telegram_id string, email string, channel string, categories array<string>, frequency string, "
        "preferred_hour int, timezone string, is_active boolean, last_notified_at timestamp_ntz"
    ),
}
