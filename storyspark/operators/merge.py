"""Upserts and idempotent writes as set operations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..session import cut
from .graph import components
from .scan import first_per


def insert_if_absent(base: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows whose key is not in the base; keys compare NULL-safe."""
    b = base.select(*[F.col(c).alias(f"b_{c}") for c in key])
    on = F.lit(True)
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    return new.join(b, on, "left_anti").dropDuplicates(list(key))


def upsert_articles(base: DataFrame, batch: DataFrame) -> DataFrame:
    """Merge a batch into stored articles by URL hash; adds ``outcome``.

    The batch counts as if its rows came one after the other by collection time. The last row of a hash sets its
    fields. Date and score come from the last row with a trusted date; without one they stay as stored, or, if
    nothing was stored, come from the first row. Hot hashes are reduced by the aggregation before the join.
    """
    fields = ["title", "url", "description", "content", "category", "source", "collected_at", "id"]
    usable = batch.where((F.length("url") > 0) & (F.length("title") > 0) & F.col("url_hash").isNotNull())
    order = F.struct("collected_at", "id")
    dated = F.struct(F.coalesce("published_at", "collected_at").alias("at"), F.coalesce("score", F.lit(0.0)).alias("score"))
    trusted = (F.coalesce("published_at_from_detail", F.lit(False)) | F.coalesce("published_at_from_listing", F.lit(False))
               | F.coalesce(F.col("source_type") != "scraper", F.lit(False)))
    n = usable.groupBy("url_hash").agg(
        F.max_by(F.struct(*fields), order).alias("n"), F.max_by(dated, F.when(trusted, order)).alias("t"), F.min_by(dated, order).alias("f"))
    b = base.select("url_hash", F.struct(*fields, "published_at", "score").alias("b"))
    joined = b.join(n, "url_hash", "full")
    new, old = F.col("n").isNotNull(), F.col("b").isNotNull()

    def pick(name: str) -> Column:
        return F.when(new, F.col(f"n.{name}")).otherwise(F.col(f"b.{name}")).alias(name)

    def moved(name: str, stored: str) -> Column:
        first = F.when(new & F.col("b.published_at").isNull(), F.col(f"f.{name}")).otherwise(F.col(f"b.{stored}"))
        return F.when(F.col("t").isNotNull(), F.col(f"t.{name}")).otherwise(first).alias(stored)

    return joined.select(
        "url_hash", F.coalesce("b.id", "n.id").alias("id"),
        *[pick(c) for c in ("title", "url", "description", "content", "category", "source")], moved("at", "published_at"), moved("score", "score"),
        F.coalesce("b.collected_at", "n.collected_at").alias("collected_at"),
        F.when(new & old, "updated").when(new, "inserted").otherwise("kept").alias("outcome"))


def dim_upsert(dim: DataFrame, incoming: DataFrame) -> DataFrame:
    """Get-or-create of sources: ``dim(id, name, source_type, base_url, is_active)``.

    ``incoming(name, source_type, base_url, ord)``: the last row of a name sets its type,
    the last given URL its URL. New names get a hash id, equal in every run.
    """
    last = F.struct("ord")
    n = incoming.groupBy("name").agg(
        F.max_by("source_type", last).alias("n_type"),
        F.max_by("base_url", F.when(F.length("base_url") > 0, last)).alias("n_url"))
    seen = F.col("n_type").isNotNull()
    return dim.join(n, "name", "full").select(
        F.coalesce("id", F.xxhash64("name")).alias("id"), "name",
        F.coalesce("n_type", "source_type").alias("source_type"), F.coalesce("n_url", "base_url").alias("base_url"),
        F.when(seen, F.lit(True)).otherwise(F.col("is_active")).alias("is_active"), F.col("id").isNull().alias("created"))


SUBSCRIBER = ("phone string, telegram_id string, email string, channel string, categories array<string>, frequency string, preferred_hour int, "
              "is_active boolean, updated_at timestamp_ntz")


def _grouped(rows: DataFrame, keys: Column, name: str = "unit") -> DataFrame:
    """Rows with the group of rows they are connected with by any of ``keys`` (an array of strings, one at least)."""
    rows = cut(rows.withColumn("_keys", keys).where(F.size("_keys") > 0))
    pairs = rows.where(F.size("_keys") > 1).select(F.get("_keys", F.lit(0)).alias("src"), F.explode(F.slice("_keys", F.lit(2), F.size("_keys"))).alias("dst")).where("src <> dst")
    found = components(pairs.distinct()) if not pairs.isEmpty() else pairs.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return rows.withColumn("_k", F.get("_keys", F.lit(0))).join(found, F.col("_k") == F.col("node"), "left").withColumn(
        name, F.coalesce("component", "_k")).drop("_k", "_keys", "node", "component")


class _Holders:
    """Which records hold a key now; a record holds the keys it was last written with."""

    def __init__(self) -> None:
        self.by_key: dict[Any, set[int]] = {}
        self.keys: dict[int, list] = {}

    def of(self, keys: Iterable) -> set[int]:
        return set().union(*[self.by_key.get(k, ()) for k in keys])

    def put(self, record: int, keys: Iterable) -> None:
        for k in self.keys.get(record, ()):
            self.by_key[k].discard(record)
        self.keys[record] = list(keys)
        for k in self.keys[record]:
            self.by_key.setdefault(k, set()).add(record)


def subscription_state(requests: DataFrame) -> DataFrame:
    """Subscribers after all requests, one record per subscriber.

    ``requests(phone, telegram_id, email, action, at, seq, channel, categories, frequency, preferred_hour)``. A
    subscription finds a record by any identifier it names (the oldest, if several), and overwrites all its fields and
    identifiers, or makes a new one; empty categories keep the stored ones. A removal marks every record that has one of
    its identifiers. Requests are walked in order inside groups connected by identifiers: one person's requests.
    """
    names = ("phone", "telegram_id", "email")
    given = F.array_compact(F.array(*[F.when(F.length(c) > 0, F.concat(F.lit(f"{c}:"), F.col(c))) for c in names]))
    rows = _grouped(requests.select(*names, "action", "at", "seq", "channel", "categories", "frequency", "preferred_hour"), given)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        records: list[dict] = []
        holders = _Holders()
        for r in pdf.sort_values(["at", "seq"]).to_dict("records"):
            own = {c: r[c] for c in names if isinstance(r[c], str) and r[c]}
            hits = holders.of(own.items())
            if r["action"] == "unsubscribe":
                for k in hits:
                    records[k].update(is_active=False, updated_at=r["at"])
                continue
            k = min(hits, default=len(records))
            if k == len(records):
                records.append({"categories": ["general"]})
            x = records[k]
            wanted = sorted(r["categories"]) if r["categories"] is not None and len(r["categories"]) else x["categories"]
            x.update({c: own.get(c) for c in names}, channel=r["channel"], frequency=r["frequency"], preferred_hour=r["preferred_hour"],
                     categories=wanted, is_active=True, updated_at=r["at"])
            holders.put(k, own.items())
        return pd.DataFrame(records, columns=[x.split()[0] for x in SUBSCRIBER.split(", ")])

    return rows.groupBy("unit").applyInPandas(walk, SUBSCRIBER)


def upsert_summaries(base: DataFrame, new: DataFrame) -> DataFrame:
    """Merge summaries one after the other by (category, day, title), else by (article, day); adds ``outcome``.

    ``new`` rows without title or text are dropped; one row per story key is kept, the first. A row that an earlier one
    of the batch changed or added is met as it then is, so both keys stay unique. Only stored rows that share a key
    with the batch are walked, in groups connected by keys; all others are kept as they are. A task walks its groups one after
    the other over sorted keys; the texts stay where they are and are joined to what the walk decides.
    """
    key = t.title_key_raw(F.col("title"))
    story = F.coalesce(F.concat(F.lit("cluster:"), F.nullif("story_cluster_id", F.lit(""))), F.concat(F.lit("title:"), key))
    clean = new.where((F.length(F.trim("title")) > 0) & (F.length(F.trim("summary")) > 0)).withColumn("__story", story)
    clean = first_per(clean, ["category", "summary_date", "__story"], [F.col("id")])
    cols = ["article_id", "category", "story_cluster_id", "title", "summary", "fact"]
    day = F.col("summary_date").cast("string")
    keys = F.array_compact(F.array(F.concat_ws("|", F.lit("t"), day, "category", "title"),
                                   F.when(F.col("article_id").isNotNull(), F.concat_ws("|", F.lit("a"), day, F.col("article_id").cast("string")))))
    clean = cut(clean.select("id", "summary_date", *cols, F.lit(True).alias("new")))
    stored = base.select("id", "summary_date", *cols, F.lit(False).alias("new"))
    asked = clean.select(F.explode(keys).alias("k")).distinct()
    touched = stored.select("id", F.explode(keys).alias("k")).join(asked, "k", "left_semi").select(F.col("id").alias("i")).distinct()
    marked = stored.join(touched, F.col("id") == F.col("i"), "left")
    kept = marked.where("i IS NULL").drop("i", "new").withColumn("outcome", F.lit("kept"))
    rows = cut(clean.unionByName(marked.where("i IS NOT NULL").drop("i")).withColumn("row", F.monotonically_increasing_id()))
    grouped = _grouped(rows.select("id", "summary_date", "category", "title", "article_id", "new", "row"), keys)
    ordered = grouped.repartition("unit").sortWithinPartitions("unit", "new", "id")

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        records, holders, unit = [], _Holders(), None
        for batch in batches:
            done: list[dict] = []
            for r in batch.to_pylist():
                if r["unit"] != unit:
                    done += records
                    records, holders, unit = [], _Holders(), r["unit"]
                title, article = ("t", r["summary_date"], r["category"], r["title"]), ("a", r["summary_date"], r["article_id"])
                own = [title, article] if r["article_id"] is not None else [title]
                k = len(records)
                if r["new"]:
                    k = min(holders.of([title]) or holders.of(own), default=k)
                if k == len(records):
                    records.append({"id": r["id"], "last": r["row"], "outcome": "inserted" if r["new"] else "kept"})
                else:
                    records[k] |= {"last": r["row"], "outcome": "inserted" if records[k]["outcome"] == "inserted" else "updated"}
                holders.put(k, own)
            yield _decided(done)
        yield _decided(records)

    decided = ordered.mapInArrow(walk, "id bigint, last bigint, outcome string")
    merged = decided.join(rows.drop("id", "new"), F.col("last") == F.col("row"))
    return kept.unionByName(merged.select(*kept.columns))


def _decided(records: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(records, pa.schema([("id", pa.int64()), ("last", pa.int64()), ("outcome", pa.string())]))
