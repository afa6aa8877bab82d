"""Upserts that follow the order of their input."""

import random
from datetime import date, datetime, timedelta

import pytest

from storyspark.operators import merge

REQUEST = ("phone string, telegram_id string, email string, action string, at timestamp_ntz, seq bigint, channel string, "
           "categories array<string>, frequency string, preferred_hour int")


def requests(spark, *rows):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(*r[:4], start + timedelta(hours=k), k, r[4], r[5], "diario", 9) for k, r in enumerate(rows)], REQUEST)


def test_one_record_per_subscriber(spark):
    df = requests(
        spark, (None, "7", "a@x.org", "subscribe", "mail", ["deportes"]), (None, "7", None, "unsubscribe", "chat", None),
        ("+1", None, "b@x.org", "subscribe", "mail", None), ("+1", "9", None, "subscribe", "chat", []), (None, None, "b@x.org", "unsubscribe", "mail", None),
        (None, None, "c@x.org", "unsubscribe", "mail", None))
    got = {(r["phone"], r["telegram_id"], r["email"], r["channel"], tuple(r["categories"]), r["is_active"]) for r in merge.subscription_state(df).collect()}
    assert got == {(None, "7", "a@x.org", "mail", ("deportes",), False), ("+1", "9", None, "chat", ("general",), True)}


def walked_requests(rows):
    """The requests one after the other, each searching all records."""
    records = []
    for phone, telegram, mail, action, channel, categories in rows:
        own = {c: v for c, v in (("phone", phone), ("telegram_id", telegram), ("email", mail)) if v}
        hits = [x for x in records if any(x.get(c) == v for c, v in own.items())]
        if not own:
            continue
        if action == "unsubscribe":
            for x in hits:
                x["is_active"] = False
            continue
        if not hits:
            hits = [{"categories": ["general"]}]
            records += hits
        hits[0].update({c: own.get(c) for c in ("phone", "telegram_id", "email")}, channel=channel, is_active=True, categories=sorted(categories) if categories else hits[0]["categories"])
    return sorted((str(x["phone"]), str(x["telegram_id"]), str(x["email"]), x["channel"], tuple(x["categories"]), x["is_active"]) for x in records)


@pytest.mark.parametrize("seed", [1, 2])
def test_identities_taken_over_equal_the_walk(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for k in range(90):  # identifiers wander between few people; one phone is in a third of all requests
        phone = "+0" if rnd.random() < 0.33 else rnd.choice([None, "", f"+{rnd.randrange(1, 9)}"])
        rows.append((phone, rnd.choice([None, None, str(rnd.randrange(9))]), rnd.choice([None, f"{rnd.choice('abcdefgh')}@x.org"]),
                     "unsubscribe" if rnd.random() < 0.15 else "subscribe", f"c{k}", rnd.choice([None, [], ["z", "a"], [f"k{k}"]])))
    got = sorted((str(r["phone"]), str(r["telegram_id"]), str(r["email"]), r["channel"], tuple(r["categories"]), r["is_active"])
                 for r in merge.subscription_state(requests(spark, *rows)).collect())
    assert got == walked_requests(rows)


def test_a_phone_joins_two_mail_records(spark):
    df = requests(spark, (None, None, "a@x.org", "subscribe", "1", None), ("+1", None, "b@x.org", "subscribe", "2", ["b"]), ("+1", None, "a@x.org", "subscribe", "3", None),
                  (None, None, "b@x.org", "subscribe", "4", None), ("+1", None, None, "unsubscribe", "5", None))
    got = sorted((str(r["phone"]), r["email"], r["channel"], list(r["categories"]), r["is_active"]) for r in merge.subscription_state(df).collect())
    # the third request takes the oldest record, so the second keeps its phone until the fourth overwrites it
    assert got == [("+1", "a@x.org", "3", ["general"], False), ("None", "b@x.org", "4", ["b"], True)]


SUMMARY = "id bigint, article_id bigint, category string, story_cluster_id string, title string, summary string, fact string, summary_date date"


def test_summaries_keep_both_keys_unique(spark):
    day = date(2024, 1, 2)
    base = spark.createDataFrame([(1, 10, "a", None, "Uno", "x", "f", day), (2, 11, "a", None, "Dos", "x", "f", day)], SUMMARY)
    new = spark.createDataFrame([
        (100, 20, "a", "c1", "Tres", "s", "f", day), (101, 20, "a", "c2", "Cuatro", "s2", "f", day),
        (102, 30, "b", "c3", "Cinco", "s", "f", day), (103, 31, "b", "c4", "Cinco", "s3", "f", day),
        (104, 10, "a", "c5", "Nuevo", "s", "f", day), (105, 40, "a", "c6", "Uno", "s", "f", day), (106, None, "a", "c7", " ", "s", "f", day)], SUMMARY)
    got = {r["id"]: (r["title"], r["article_id"], r["outcome"]) for r in merge.upsert_summaries(base, new).collect()}
    assert got == {1: ("Nuevo", 10, "updated"), 2: ("Dos", 11, "kept"), 100: ("Cuatro", 20, "inserted"), 102: ("Cinco", 31, "inserted"), 105: ("Uno", 40, "inserted")}


ARTICLE = ("id bigint, url_hash string, title string, url string, description string, content string, category string, source string, source_type string, "
           "published_at timestamp_ntz, published_at_from_detail boolean, published_at_from_listing boolean, collected_at timestamp_ntz, score double")


def test_a_trusted_date_outlives_a_later_untrusted_row(spark):
    at = lambda d: datetime(2024, 1, d)
    row = lambda i, h, d, sure, c: (i, h, f"t{i}", "u", "d", "c", "k", "s", "scraper", at(d), sure, None, at(c), float(i))
    base = spark.createDataFrame([row(1, "h", 1, None, 1)], ARTICLE)
    batch = spark.createDataFrame([row(2, "h", 5, True, 2), row(3, "h", 9, False, 3), row(4, "n", 6, False, 2), row(5, "n", 7, False, 3)], ARTICLE)
    got = {r["url_hash"]: (r["title"], r["published_at"].day, r["score"]) for r in merge.upsert_articles(base, batch).collect()}
    assert got == {"h": ("t3", 5, 2.0), "n": ("t5", 6, 4.0)}


def test_summaries_are_walked_without_their_texts(spark, monkeypatch):
    """Groups that span batches, repeated ids and article ids beyond 2**53; what reaches the walk is keys."""
    seen = []
    grouped = merge._grouped
    monkeypatch.setattr(merge, "_grouped", lambda rows, keys: seen.append(set(rows.columns)) or grouped(rows, keys))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        day, big = date(2024, 1, 2), 2**53
        base = spark.createDataFrame([(k, big + k, "a", None, f"T{k}", "x", "f", day) for k in range(20)], SUMMARY)
        new = spark.createDataFrame([(100 + k, big + k + 1, "a", f"c{k}", f"T{k}", f"s{k}", "f", day) for k in range(0, 20, 2)], SUMMARY)
        got = {r["id"]: (r["title"], r["article_id"], r["summary"], r["outcome"]) for r in merge.upsert_summaries(base, new).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: (f"T{k}", big + k + 1, f"s{k}", "updated") if k % 2 == 0 else (f"T{k}", big + k, "x", "kept") for k in range(20)}
    assert all("summary" not in columns and "fact" not in columns for columns in seen)
