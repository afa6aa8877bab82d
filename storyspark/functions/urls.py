"""URL functions as Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (
    DECORATION_IMAGE_FRAGMENTS,
    NON_ARTICLE_URL_FRAGMENTS,
    TRACKER_IMAGE_FRAGMENTS,
    TRACKING_KEYS,
    TRACKING_PREFIXES,
)


def _raw(url: Column) -> Column:
    raw = F.trim(F.coalesce(url, F.lit("")))
    return F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("//"), raw))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(_raw(url), r"//([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(_raw(url), r"//[^/?#]*(/[^?#]*)", 1)


def _decode(c: Column) -> Column:
    plus = F.replace(c, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(c), plus)


def _encode(c: Column) -> Column:
    # urlencode of the Java class, with the characters Python quotes differently
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(
    url: Column,
    keys: Sequence[str] = TRACKING_KEYS,
    prefixes: Sequence[str] = TRACKING_PREFIXES,
) -> Column:
    """Identity of an article URL: https, bare host, no tracking, sorted parameters."""
    query = F.regexp_extract(_raw(url), r"^[^?#]*\?([^#]*)", 1)

    def kept(pair: Column) -> Column:
        name = F.lower(pair["k"])
        tracked = name.isin(*keys)
        for prefix in prefixes:
            tracked = tracked | name.startswith(prefix)
        return ~tracked

    def split_pair(part: Column) -> Column:
        key = F.regexp_extract(part, "^([^=]*)", 1)
        value = F.regexp_replace(part, "^[^=]*=?", "")
        return F.struct(_decode(key).alias("k"), _decode(value).alias("v"))

    parts = F.filter(F.split(query, "&"), lambda p: F.length(p) > 0)
    pairs = F.array_sort(F.filter(F.transform(parts, split_pair), kept))
    encoded = F.array_join(
        F.transform(pairs, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&"
    )
    bare_host = F.regexp_replace(host(url), r"^www\.", "")
    bare_path = F.regexp_replace(path(url), "/+$", "")
    base = F.concat(F.lit("https://"), bare_host, bare_path)
    full = F.when(F.length(encoded) > 0, F.concat(base, F.lit("?"), encoded)).otherwise(base)
    return F.when(F.length(F.trim(F.coalesce(url, F.lit("")))) == 0, F.lit("")).otherwise(full)


def url_fingerprint(url: Column) -> Column:
    normal = normalize_url(url)
    return F.when(F.length(normal) > 0, F.sha2(normal, 256)).otherwise(F.lit(""))


def url_hash(url: Column) -> Column:
    return F.md5(F.encode(url, "UTF-8"))


def looks_like_article(url: Column, source_url: Column, blocked: Sequence[str] = NON_ARTICLE_URL_FRAGMENTS) -> Column:
    """Same host, no blocked fragment, a path of more than eight characters."""
    own_path = F.regexp_replace(path(url), "^/+|/+$", "")
    source_path = F.regexp_replace(path(source_url), "^/+|/+$", "")
    bad = F.lit(False)
    for fragment in blocked:
        bad = bad | url.contains(fragment)
    same_page = (F.length(source_path) > 0) & (own_path == source_path)
    return F.coalesce(
        (host(url) == host(source_url)) & ~bad & ~same_page & (F.length(own_path) > 8), F.lit(False)
    )


def absolute_url(href: Column, base: Column) -> Column:
    """Resolve a link against the page it stands on."""
    scheme = F.coalesce(F.nullif(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1), F.lit("")), F.lit("https"))
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(base, r"//([^/?#]*)", 1))
    page = F.regexp_replace(base, "#.*$", "")
    folder = F.concat(root, F.regexp_replace(F.concat(path(base), F.when(path(base) == "", "/").otherwise("")), "[^/]*$", ""))
    href = F.trim(href)
    return (
        F.when(F.length(href) == 0, base)
        .when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#"), F.concat(page, href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(page, r"\?.*$", ""), href))
        .otherwise(F.concat(folder, F.regexp_replace(href, r"^(?:\./)+", "")))
    )


def _contains_any(c: Column, fragments: Sequence[str]) -> Column:
    hit = F.lit(False)
    for fragment in fragments:
        hit = hit | F.contains(c, F.lit(fragment))
    return hit


def public_image(url: Column) -> Column:
    """NULL for trackers and pixels."""
    clean = F.trim(url)
    bad = _contains_any(F.lower(clean), TRACKER_IMAGE_FRAGMENTS)
    return F.when((F.length(url) > 0) & ~bad, clean)


def article_image(url: Column) -> Column:
    """NULL for logos, icons and other decoration."""
    return F.when(~_contains_any(F.lower(url), DECORATION_IMAGE_FRAGMENTS), url)


def date_from_url(url: Column) -> Column:
    """``/YYYYMMDD/`` in the path, else a numeric stamp (two- or one-digit month)."""
    day_digits = F.regexp_extract(url, r"/([0-9]{8})(?:/|$)", 1)
    by_day = F.try_make_timestamp_ntz(
        *[F.substring(day_digits, a, n).try_cast("int") for a, n in ((1, 4), (5, 2), (7, 2))],
        F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"),
    )
    stamp = F.regexp_extract(url, r"(20[0-9]{10,11})(?:[^0-9]|$)", 1)

    def by_stamp(month_digits: int) -> Column:
        day = 5 + month_digits
        second = F.coalesce(F.nullif(F.substring(stamp, day + 6, 2), F.lit("")), F.lit("0"))
        return F.try_make_timestamp_ntz(
            F.substring(stamp, 1, 4).try_cast("int"),
            F.substring(stamp, 5, month_digits).try_cast("int"),
            F.substring(stamp, day, 2).try_cast("int"),
            F.substring(stamp, day + 2, 2).try_cast("int"),
            F.substring(stamp, day + 4, 2).try_cast("int"),
            second.try_cast("decimal(16,6)"),
        )

    return F.when(F.length(day_digits) > 0, by_day).otherwise(F.coalesce(by_stamp(2), by_stamp(1)))
