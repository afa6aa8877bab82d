"""Exact and fuzzy duplicate removal and application of outside decisions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..session import cut
from .graph import components
from .scan import Blocks, first_per, previous, total
from .similarity import title_edges


def dedup_url(df: DataFrame, order: Sequence[str] = ("collected_at", "id"), url: str = "url") -> DataFrame:
    """First row per URL; rows without a URL all stay."""
    key = F.coalesce(
        F.md5(F.encode(F.nullif(F.col(url), F.lit("")), "UTF-8")), F.concat(F.lit("row-"), F.col("id").cast("string")))
    return first_per(df.withColumn("__key", key), ["__key"], [F.col(c) for c in order]).drop("__key")


_SLOTS = "component string, slot int, node string, id bigint, published bigint"


def dedup_title(
    df: DataFrame, batch: Sequence[str], threshold: float = 0.85, block_rows: int = 50_000
) -> DataFrame:
    """Fuzzy title dedup inside each batch, in input order (collected_at, id).

    Rule: a row joins the first kept slot whose title matches it; a newer row takes the
    slot over. Titles without a similar title in their batch need one aggregation, so
    a title copied into a third of all rows is never gathered. Groups of similar titles
    are walked in order: consecutive rows of one title are merged first (which cannot
    change the outcome), and a group longer than ``block_rows`` is walked in several
    bounded steps that hand the slots on.
    Returns (batch, id) of the surviving rows.
    """
    rows = df.select(
        *batch, "id", "published_at", "collected_at", t.title_key(F.col("title")).alias("title")
    ).withColumn("node", F.md5("title"))
    rows = cut(rows)
    blocks = rows.select("node", *batch).distinct()
    edges = cut(title_edges(rows.select("node", "title").distinct(), blocks, list(batch), threshold))
    batch_key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in batch])
    linked = components(edges.select(
        F.concat_ws("|", batch_key, "new").alias("src"), F.concat_ws("|", batch_key, "old").alias("dst")))
    keyed = rows.withColumn("node_key", F.concat_ws("|", batch_key, "node"))
    keyed = cut(keyed.join(linked.withColumnRenamed("node", "node_key"), "node_key", "left"))

    # newest first, earliest row on ties; no date loses against any date
    preference = F.struct(
        F.coalesce("published_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("p"),
        (-F.unix_micros(F.col("collected_at").cast("timestamp"))).alias("c"), (-F.col("id")).alias("i"))
    alone = keyed.where("component IS NULL").groupBy(*batch, "node").agg(F.max_by("id", preference).alias("id"))

    grouped = keyed.where("component IS NOT NULL")
    order = [F.col("collected_at"), F.col("id")]
    blocks = Blocks(grouped, ["component"], order)
    grouped = blocks.add(grouped, {"prev": previous(F.col("node"))})
    starts = F.when(F.col("prev").isNull() | (F.col("prev") != F.col("node")), F.lit(1)).otherwise(F.lit(0))
    grouped = grouped.withColumn("start", starts)
    grouped = blocks.add(grouped, {"run": total(F.col("start").cast("bigint"))})
    runs = grouped.groupBy(*batch, "component", "run", "node").agg(F.max_by(F.struct("id", "published_at"), preference).alias("best"))
    allowed = edges.groupBy(*batch, F.col("new").alias("node")).agg(F.collect_list("old").alias("allowed"))
    runs = runs.join(allowed, [*batch, "node"], "left").select(
        "component", "run", "node", F.col("best.id").alias("id"),
        F.unix_micros(F.col("best.published_at").cast("timestamp")).alias("published"),
        F.coalesce("allowed", F.array().cast("array<string>")).alias("allowed"),
        F.floor((F.col("run") - 1) / block_rows).cast("int").alias("step"))
    runs = cut(runs)
    last_step = runs.agg(F.max("step")).first()[0]
    survivors = None
    slots = df.sparkSession.createDataFrame([], _SLOTS)
    for step in range((last_step or 0) + 1):
        part = runs.where(F.col("step") == step).drop("step")
        open_slots = slots.join(part.select("component").distinct(), "component", "left_semi")
        slots = cut(part.groupBy("component").cogroup(open_slots.groupBy("component")).applyInPandas(
            _walk, _SLOTS))
        later = runs.where(F.col("step") > step).select("component").distinct()
        finished = slots.join(later, "component", "left_anti").select("id")
        survivors = finished if survivors is None else survivors.unionByName(finished)
    return alone.select("id").unionByName(survivors)


def _walk(runs: pd.DataFrame, slots: pd.DataFrame) -> pd.DataFrame:
    """Leader walk over one bounded step of a group of similar titles."""
    slots = slots.sort_values("slot")
    kept = [[n, int(i), None if pd.isna(p) else int(p)] for n, i, p in zip(slots["node"], slots["id"], slots["published"])]
    led: dict[str, set[int]] = {}
    for number, (node, _, _) in enumerate(kept):
        led.setdefault(node, set()).add(number)
    runs = runs.sort_values("run")
    for node, row_id, published, allowed in zip(runs["node"], runs["id"], runs["published"], runs["allowed"]):
        published = None if pd.isna(published) else int(published)
        candidates = [min(led[n]) for n in [node, *allowed] if led.get(n)]
        if not candidates:
            led.setdefault(node, set()).add(len(kept))
            kept.append([node, int(row_id), published])
            continue
        number = min(candidates)
        old_node, _, old_published = kept[number]
        if published is not None and (old_published is None or published > old_published):
            led[old_node].discard(number)
            led.setdefault(node, set()).add(number)
            kept[number] = [node, int(row_id), published]
    return pd.DataFrame({
        "component": pd.Series([runs["component"].iloc[0]] * len(kept), dtype="object"),
        "slot": pd.Series(range(len(kept)), dtype="int32"),
        "node": pd.Series([k[0] for k in kept], dtype="object"),
        "id": pd.Series([k[1] for k in kept], dtype="int64"),
        "published": pd.Series([k[2] for k in kept], dtype="object"),
    })


def parse_discards(responses: DataFrame) -> DataFrame:
    """(batch_id, idx) from decision texts: a JSON list, else a list inside the text, else any numbers.

    ``responses(batch_id, response, total)``; indices outside the batch are ignored.
    """
    clean = F.trim(F.regexp_replace(F.trim("response"), "^`+|`+$", ""))
    clean = F.trim(F.regexp_replace(clean, "^(?:json|JSON)", ""))
    whole = F.from_json(clean, "array<double>")
    whole = F.when(clean.rlike(r"^\["), whole)
    inner = F.from_json(F.nullif(F.regexp_extract(clean, r"(\[[\d,\s]+\])", 1), F.lit("")), "array<double>")
    loose = F.transform(F.regexp_extract_all(clean, F.lit(r"\b(\d+)\b"), 1), lambda s: s.try_cast("double"))
    numbers = F.coalesce(whole, inner, loose)
    return (
        responses.select("batch_id", "total", F.explode(numbers).alias("v"))
        .select("batch_id", F.col("v").try_cast("int").alias("idx"), "total")
        .where((F.col("idx") >= 0) & (F.col("idx") < F.col("total")))
        .select("batch_id", "idx").distinct()
    )


def apply_discards(items: DataFrame, responses: DataFrame) -> DataFrame:
    """Items ``(batch_id, idx, ...)`` that no decision discards."""
    return items.join(parse_discards(responses), ["batch_id", "idx"], "left_anti")
