"""Text functions as Spark columns.

Java's ``\\w`` and ``\\s`` are ASCII, so the classes are written out to cover every
letter, number and white-space character.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CORROBORATION_STOPWORDS, LOW_VALUE_PREFIXES, STORY_STOPWORDS

SPACE = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"
WORD = r"[\p{L}\p{N}_]"
# white space that is not already one plain blank: single blanks need no replacement
_LOOSE_SPACE = SPACE + r"{2,}|[\s\p{Z}\x0B\x1C-\x1F\x85&&[^ ]]"
NOT_WORD_OR_SPACE = r"[^\p{L}\p{N}_\s\p{Z}\x0B\x1C-\x1F\x85]"


def _fold_table() -> tuple[str, str]:
    """Characters whose canonical decomposition is one base character plus marks."""
    source, target = [], []
    for code in range(0xA0, 0x10000):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        base = [c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != char:
            source.append(char)
            target.append(base[0])
    return "".join(source), "".join(target)


_FOLD_FROM, _FOLD_TO = _fold_table()


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    """Collapse white space to single blanks and trim."""
    return F.trim(F.regexp_replace(_text(c), _LOOSE_SPACE, " "))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A filter evaluates every mention of an expression; a lambda variable is bound once.
    """
    return F.get(F.transform(F.array(value), lambda bound: use(bound)), F.lit(0))


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(_text(c), _FOLD_FROM, _FOLD_TO), r"\p{Mn}", "")


def fold(c: Column) -> Column:
    """Lower case without accents, single blanks."""
    return squeeze(F.lower(strip_accents(c)))


def match_key(c: Column) -> Column:
    """Folded text with punctuation turned into blanks."""
    return squeeze(F.regexp_replace(F.lower(strip_accents(c)), NOT_WORD_OR_SPACE, " "))


def title_key(c: Column) -> Column:
    """Folded title with punctuation removed."""
    return squeeze(F.regexp_replace(F.lower(strip_accents(c)), NOT_WORD_OR_SPACE, ""))


def title_key_raw(c: Column) -> Column:
    """Storage form of the title key: accents are kept."""
    return squeeze(F.regexp_replace(F.lower(squeeze(c)), NOT_WORD_OR_SPACE, ""))


def story_text(c: Column, prefixes: Sequence[str] = LOW_VALUE_PREFIXES) -> Column:
    """Match key without leading low-value prefixes."""
    pattern = "^(?:(?:" + "|".join(prefixes) + ") )+"
    return F.regexp_replace(match_key(c), pattern, "")


def story_excerpt(*fields: Column, chars: int = 280) -> Column:
    """First non-empty normalised field, cut to ``chars``."""
    cleaned = [F.nullif(story_text(f), F.lit("")) for f in fields]
    return F.left(F.coalesce(*cleaned, F.lit("")), F.lit(chars))


def canonical_key(category: Column, title: Column, excerpt: Column) -> Column:
    """``category | title | excerpt``; blank parts are left out, 500 characters at most.

    ``excerpt`` is already normalised (see :func:`story_excerpt`).
    """
    category = F.when(F.length(_text(category)) > 0, category).otherwise(F.lit("general"))
    parts = [F.nullif(story_text(category), F.lit("")), F.nullif(story_text(title), F.lit("")),
             F.nullif(excerpt, F.lit(""))]
    return F.left(F.concat_ws(" | ", *parts), F.lit(500))


def content_fingerprint(key: Column) -> Column:
    return F.sha2(key, 256)


def words(c: Column) -> Column:
    return F.regexp_extract_all(_text(c), F.lit("(" + WORD + "+)"), 1)


def word_count(c: Column) -> Column:
    return F.regexp_count(_text(c), F.lit(WORD + "+"))


def significant_tokens(c: Column, stopwords: Sequence[str] = STORY_STOPWORDS, min_length: int = 4) -> Column:
    """Distinct words of at least ``min_length`` characters that are no stop words."""
    return F.array_distinct(
        F.filter(words(c), lambda t: (F.length(t) >= min_length) & ~t.isin(*stopwords))
    )


def corroboration_tokens(c: Column) -> Column:
    return significant_tokens(c, CORROBORATION_STOPWORDS)


def jaccard(left: Column, right: Column) -> Column:
    shared = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        shared / (F.size(left) + F.size(right) - shared)
    )


def _quote(term: str) -> str:
    return "".join("\\" + ch if not (ch.isalnum() or ch in " _") else ch for ch in term)


def term_pattern(terms: Sequence[str]) -> str:
    return "(?<!" + WORD + ")(?:" + "|".join(_quote(t) for t in terms) + ")(?!" + WORD + ")"


def contains_term(folded: Column, term: str) -> Column:
    """Whole-word match of an already folded term in folded text."""
    return folded.rlike(term_pattern([term])) if term else F.lit(False)


def word_string(folded: Column) -> Column:
    """Folded text as blank-delimited words, punctuation kept as a bar.

    A term made of words then matches as a plain substring between blanks, which is far
    cheaper than one regular expression per term.
    """
    return F.concat(F.lit(" "), squeeze(F.regexp_replace(folded, r"[^\p{L}\p{N}_ ]+", " | ")), F.lit(" "))


def has_term(word_string: Column, term: str) -> Column:
    """Whole-word match in a :func:`word_string`; terms with punctuation use a pattern."""
    if not all(ch.isalnum() or ch in " _" for ch in term):
        return word_string.rlike(term_pattern([term]))
    return F.contains(word_string, F.lit(f" {term} "))


def cut_words(c: Column, chars: int, suffix: str = "", keep_partial: bool = False) -> Column:
    """At most ``chars`` characters, without a broken last word."""
    c = _text(c)
    head = F.left(c, F.lit(chars))
    cut = F.trim(F.regexp_replace(head, " [^ ]*$", ""))
    if keep_partial:
        cut = F.coalesce(F.nullif(cut, F.lit("")), F.trim(head))
    return F.when(F.length(c) <= chars, c).otherwise(F.concat(cut, F.lit(suffix)))


def truncate_content(c: Column, chars: int = 900) -> Column:
    return cut_words(squeeze(c), chars)


def limit_text(c: Column, chars: int) -> Column:
    return cut_words(c, chars, keep_partial=True)


def excerpt(c: Column, chars: int = 280) -> Column:
    return cut_words(squeeze(c), chars, suffix="...")


def clean_generated(c: Column) -> Column:
    """Drop leading list numbers, single blanks."""
    numbered = "^" + SPACE + r"*(?:[0-9]+[.)]" + SPACE + "*)+"
    return squeeze(F.regexp_replace(_text(c), numbered, ""))


def strip_invisible(c: Column) -> Column:
    """Hard blanks, soft hyphens and zero-width characters."""
    return squeeze(F.regexp_replace(_text(c), r"[\u00AD\u200B-\u200D\uFEFF]", ""))


def slugify(c: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", "_"), "^_+|_+$", ""
    )


def category_text(c: Column) -> Column:
    """Form in which free category names are looked up."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(F.trim(_text(c)))), "[^a-z0-9]+", " "))


def sentences(c: Column) -> Column:
    parts = F.split(_text(c), r"(?<=[.!?])" + SPACE + "+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def summary_with_context(summary: Column, context: Column, min_chars: int = 120, max_chars: int = 360) -> Column:
    """Lengthen a short summary with context sentences it does not contain yet.

    A fold over the sentence array: sentences are added until ``min_chars`` is reached.
    """
    base = clean_generated(summary)

    def step(acc: Column, sentence: Column) -> Column:
        s, a = F.lower(clean_generated(sentence)), F.lower(clean_generated(acc))
        known = (F.length(s) == 0) | F.contains(a, s) | F.contains(s, a)
        glue = F.when(F.right(acc, F.lit(1)).isin(".", "!", "?"), F.lit(" ")).otherwise(F.lit(". "))
        joined = F.when(F.length(acc) == 0, sentence).otherwise(F.concat(acc, glue, sentence))
        return F.when((F.length(acc) >= min_chars) | known, acc).otherwise(joined)

    extended = F.aggregate(sentences(clean_generated(context)), base, step)
    chosen = F.when(F.length(base) >= min_chars, base).otherwise(extended)
    return limit_text(chosen, max_chars)


def is_mobile(user_agent: Column) -> Column:
    return F.when(user_agent.isNull(), F.lit("unknown")).when(
        user_agent.rlike("(?i)mobi|android"), F.lit("mobile")
    ).otherwise(F.lit("desktop"))
