"""Payload feeds and stored details."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import WEATHER_LOCATIONS
from ..functions.urls import public_image

_WEATHER = (
    "struct<current:struct<temperature_2m:double,relative_humidity_2m:double,precipitation:double,weather_code:int,wind_speed_10m:double>,"
    "hourly:struct<uv_index:array<double>,uv_index_clear_sky:array<double>,shortwave_radiation:array<double>,direct_radiation:array<double>>,"
    "daily:struct<temperature_2m_max:array<double>,temperature_2m_min:array<double>,uv_index_max:array<double>,precipitation_sum:array<double>>>"
)


def _place_key(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), " -", "__")


def weather_normalize(payloads: DataFrame, default: str = "la_paz") -> DataFrame:
    """``(request_id, place, payload)`` to one row of current values and today's first values.

    The place is matched by key, name or department; anything else gets the default.
    """
    spark = payloads.sparkSession
    places = spark.createDataFrame(
        [(n, *row) for n, row in enumerate(WEATHER_LOCATIONS)],
        "ord int, location string, name string, department string, country string, latitude double, longitude double")
    alias = places.select("ord", "location", F.explode(F.array(*[_place_key(F.col(c)) for c in ("location", "name", "department")])).alias("alias"))
    alias = alias.groupBy("alias").agg(F.min_by("location", "ord").alias("matched"))
    rows = payloads.withColumn("alias", _place_key(F.coalesce("place", F.lit("")))).join(F.broadcast(alias), "alias", "left")
    rows = rows.withColumn("location", F.coalesce("matched", F.lit(default))).join(F.broadcast(places.drop("ord")), "location")
    p = rows.withColumn("p", F.from_json("payload", _WEATHER))

    def first(path: str) -> Column:
        return F.get(F.col(path), F.lit(0))

    return p.select(
        "request_id", "location", "name", "department", "latitude", "longitude",
        F.col("p.current.temperature_2m").alias("temperature"), F.col("p.current.relative_humidity_2m").alias("humidity"),
        F.col("p.current.wind_speed_10m").alias("wind_speed"), F.col("p.current.weather_code").alias("weather_code"),
        first("p.daily.temperature_2m_max").alias("temperature_max"), first("p.daily.temperature_2m_min").alias("temperature_min"),
        first("p.daily.uv_index_max").alias("uv_index_max"), first("p.daily.precipitation_sum").alias("precipitation_sum"),
        first("p.hourly.uv_index").alias("uv_index"), first("p.hourly.shortwave_radiation").alias("shortwave_radiation"),
        first("p.hourly.direct_radiation").alias("direct_radiation"))


def reuse_known_details(listing: DataFrame, stored: DataFrame, as_of: datetime, since: datetime, refresh_hours: int = 3) -> DataFrame:
    """Listing rows with stored content filled in where it is old enough to be final.

    ``detail_reused`` is false for the rows that must be fetched again.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    known = stored.where((F.col("collected_at") >= F.lit(since).cast("timestamp_ntz")) & F.col("content").isNotNull()).select(
        "url_hash", F.struct("content", "description", public_image(F.col("image")).alias("image"), "published_at").alias("k"))
    age_ok = F.col("k.published_at") <= now - F.make_dt_interval(F.lit(0), F.lit(refresh_hours))
    reused = F.coalesce((F.length("k.content") > 0) & age_ok, F.lit(False))
    joined = listing.join(known, "url_hash", "left").withColumn("detail_reused", reused)
    r = F.col("detail_reused")

    def fill(name: str) -> Column:
        return F.when(r, F.coalesce(F.nullif(name, F.lit("")), F.col(f"k.{name}"))).otherwise(F.col(name))

    return joined.withColumns({
        "description": fill("description"), "image": fill("image"),
        "content": F.when(r, F.col("k.content")),
        "published_at": F.when(r, F.col("k.published_at")).otherwise(F.col("published_at")),
    }).drop("k")
