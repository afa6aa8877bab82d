"""The two functions Spark cannot express: Arrow-batched pandas UDFs."""

from __future__ import annotations

import html
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratios(left: pd.Series, right: pd.Series) -> list[float]:
    """Matching-block ratios of pairs of titles."""
    # the matcher keeps the index of its second argument, so equal right-hand titles
    # of a batch are compared in one go
    out = [0.0] * len(left)
    groups: dict[str, list[int]] = {}
    for position, value in enumerate(right):
        groups.setdefault(value or "", []).append(position)
    matcher = SequenceMatcher(None)
    lefts = left.tolist()
    for value, positions in groups.items():
        matcher.set_seq2(value)
        for position in positions:
            matcher.set_seq1(lefts[position] or "")
            out[position] = matcher.ratio()
    return out


@F.pandas_udf(T.DoubleType())
def title_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-block ratio of two titles. Not symmetric: the newer title goes first.

    Used on candidate pairs only.
    """
    return pd.Series(ratios(left, right))


@F.pandas_udf(T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("mixed", T.DoubleType())]))
def story_score(
    left: pd.Series, right: pd.Series, jaccard: pd.Series, title_weight: pd.Series, content_weight: pd.Series
) -> pd.DataFrame:
    """Title ratio, and its mix with the token overlap to four digits of the binary value."""
    found = ratios(left, right)
    mixed = [round(r * tw + j * cw, 4) for r, j, tw, cw in zip(found, jaccard, title_weight, content_weight)]
    return pd.DataFrame({"ratio": found, "mixed": mixed})


# --- fixed values: broken UTF-8 sequences and their meaning ------------------
_BROKEN = {
    "â€œ": '"', "â€\x9d": '"', "â€˜": "'", "â€™": "'",
    "â€“": "-", "â€”": "-", "â€¦": "...", "Â": "",
}
_MARKERS = "ÃÂâ"
_TAG = "</?[a-zA-Z][^>]*>"
#: Characters that a byte of a wrongly decoded sequence can have become, and that byte.
_BYTE = {chr(b): b for b in range(0x80, 0x100)} | {
    bytes([b]).decode("cp1252"): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_RUN = re.compile("[" + "".join(map(re.escape, _BYTE)) + "]{2,}")


def _meant(run: re.Match) -> str:
    """A run of such characters read as UTF-8, as far as it is; the rest stays."""
    raw = bytes(_BYTE[c] for c in run.group())
    out, at = [], 0
    while at < len(raw):
        width = next((n for n in (2, 3, 4) if len(raw[at:at + n].decode("utf-8", "ignore")) == 1), 1)
        out.append(raw[at:at + width].decode("utf-8") if width > 1 else run.group()[at])
        at += width
    return "".join(out)


@F.pandas_udf(T.StringType())
def plain_entities(values: pd.Series) -> pd.Series:
    """Entities replaced, up to three layers deep."""
    return values.map(lambda x: html.unescape(html.unescape(html.unescape(x))), na_action="ignore")


@F.pandas_udf(T.StringType())
def reread_runs(values: pd.Series) -> pd.Series:
    """Runs that were UTF-8 before someone read them byte by byte."""
    return values.str.replace(_RUN, _meant, regex=True)


def repair_text(text: Column) -> Column:
    """Entities, broken UTF-8 and tags of a whole text.

    The broken sequences are replaced only if that leaves fewer of their marks. Null counts as empty.
    """
    def marks(c: Column) -> Column:
        return F.length(c) - F.length(F.translate(c, _MARKERS, ""))

    plain = plain_entities(F.coalesce(text, F.lit("")))
    known = plain
    for bad, good in _BROKEN.items():
        known = F.replace(known, F.lit(bad), F.lit(good))
    tried = reread_runs(F.when(marks(plain) > 0, known).otherwise(plain))
    fixed = F.when((marks(plain) > 0) & (marks(tried) < marks(plain)), tried).otherwise(plain)
    return F.when(fixed.rlike(_TAG), plain_entities(F.regexp_replace(fixed, _TAG, " "))).otherwise(fixed)
