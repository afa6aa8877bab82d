"""Numbers, dates and timestamps as Spark columns. Bad input gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MONTHS_ES
from .text import squeeze, strip_accents

LOCAL_ZONE = "America/La_Paz"
_MONTH_WORDS = "|".join(MONTHS_ES)


def _month_map() -> Column:
    pairs = []
    for name, number in MONTHS_ES.items():
        pairs += [F.lit(name), F.lit(number)]
    return F.create_map(*pairs)


def parse_decimal(c: Column, precision: int = 18, scale: int = 6) -> Column:
    """``4.269,71`` -> 4269.71; a lone comma is the decimal mark."""
    digits = F.regexp_replace(squeeze(c), r"[^0-9,.\-]", "")
    both = digits.contains(",") & digits.contains(".")
    text = F.when(both, F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(
        F.replace(digits, F.lit(","), F.lit("."))
    )
    return text.try_cast(f"decimal({precision},{scale})")


def parse_spanish_date(c: Column) -> Column:
    """``10 de mayo, 2026`` and ``10 de mayo de 2026``."""
    text = F.lower(squeeze(c))
    pattern = r"([0-9]{1,2})\s+de\s+([a-záéíóúñ]+)(?:,|\s+de)?\s+([0-9]{4})"
    month = F.try_element_at(_month_map(), strip_accents(F.regexp_extract(text, pattern, 2)))
    return F.try_make_timestamp_ntz(
        F.regexp_extract(text, pattern, 3).try_cast("int"),
        month,
        F.regexp_extract(text, pattern, 1).try_cast("int"),
        F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"),
    ).cast("date")


def numeric_timestamp(c: Column, zone: str = LOCAL_ZONE) -> Column:
    """Ten-digit seconds or thirteen-digit milliseconds to local time."""
    text = F.trim(c)
    millis = (
        F.when(text.rlike("^[0-9]{10}$"), text.try_cast("bigint") * 1000)
        .when(text.rlike("^[0-9]{13}$"), text.try_cast("bigint"))
    )
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_millis(millis).cast("timestamp_ntz"))


def spanish_months_to_numbers(c: Column) -> Column:
    """``5 de mayo de 2026 10:30`` and ``mayo 5, 2026`` to ``5/05/2026 10:30``."""
    day_first = rf"([0-9]{{1,2}})\s*(?:de\s+)?({_MONTH_WORDS})\s*(?:de\s+)?([0-9]{{4}})"
    month_first = rf"({_MONTH_WORDS})\s+([0-9]{{1,2}}),?\s*(?:de\s+)?([0-9]{{4}})"
    text = F.regexp_replace(F.regexp_replace(c, day_first, "$1/$2/$3"), month_first, "$2/$1/$3")
    for name, number in MONTHS_ES.items():
        text = F.regexp_replace(text, f"/{name}/", f"/{number:02d}/")
    return text


_DATE_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "d/M/yyyy HH:mm:ss", "d/M/yyyy HH:mm", "d/M/yyyy", "d-M-yyyy", "yyyy/MM/dd",
)


def parse_date_text(c: Column, zone: str = LOCAL_ZONE) -> Column:
    """Listed date forms in priority order; relative words are dropped first.

    ISO text with an offset keeps its wall-clock time, as it is written.
    """
    text = F.lower(squeeze(c))
    text = F.regexp_replace(text, "hace [0-9]+ horas?", "")
    text = F.regexp_replace(text, "hoy", "")
    text = squeeze(spanish_months_to_numbers(text))
    found = F.regexp_extract(
        text,
        r"([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}(?:[t ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{3,6})?)?)?"
        r"|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}(?: [0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)?)",
        1,
    )
    iso = F.upper(found)
    parsed = [F.try_to_timestamp(iso, F.lit(fmt)).cast("timestamp_ntz") for fmt in _DATE_FORMATS]
    return F.coalesce(numeric_timestamp(text, zone), *parsed)


def iso_with_offset(ts: Column, offset: str = "-04:00") -> Column:
    """Naive local timestamp to ISO text with the fixed offset; micros only if present."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit(offset))


def json_safe(*columns: Column) -> Column:
    """A row as JSON text: nested values stay nested, times are ISO texts, decimals keep their digits, nulls are written."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "dateFormat": "yyyy-MM-dd"})


def temporal_proximity(hours: Column, window_hours: float, floor: float = 0.85) -> Column:
    """1.0 for simultaneous rows falling to ``floor`` at the edge of the window."""
    if window_hours <= 0:
        return F.lit(1.0)
    return F.lit(1.0) - F.lit(1.0 - floor) * F.least(F.abs(hours) / F.lit(float(window_hours)), F.lit(1.0))


def hours_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(3_600_000_000.0)


def micros(ts: Column) -> Column:
    """Microseconds of a naive timestamp, as a sort and range key."""
    return F.unix_micros(ts.cast("timestamp"))
