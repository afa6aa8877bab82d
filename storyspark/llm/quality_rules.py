"""Quality rules whose thresholds each language and source set for themselves.

Every document gets whole-number measures. A sketch counts, per (lang, source) and measure, how many
documents fall on each value of a logarithmic grid; sketches merge by adding counts, so a language's or
the corpus' sketch is the sum of its groups'. Fences come from the quartiles of those sketches, and the
documents are joined with the fences of their group. A group with fewer than ``min_group`` documents uses
its language's fences, a language with fewer uses the corpus'. Documents that fail the base rule are not
counted. Counts are summed before the shuffle, so a hot source sends one row per grid value and task.

Cases: a null text has no words and fails the base rule; null lang or source form groups of their own;
repeated rows are measured and kept or rejected each for itself; an empty table gives no rows; other
columns are carried along, and columns named like a made one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import computed_once
from .common import SPACE, materialize

#: Fences, one row per language and source, that may be broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_shout", "n_upper", "n_distinct", "n_lines")
#: rate: (part, whole), per 1,000
RATES = {
    "symbol_rate": ("n_symbols", "n_words"), "shout_rate": ("n_shout", "n_words"), "upper_rate": ("n_upper", "word_chars"),
    "distinct_rate": ("n_distinct", "n_words"), "dup_line_rate": ("n_dup_lines", "n_lines"),
}


@dataclass(frozen=True)
class Fence:
    """Rejects what lies more than ``spread`` quartile distances and ``slack`` outside the quartiles."""

    rate: str
    below: bool
    spread: int
    slack: int


@dataclass(frozen=True)
class RuleConfig:
    min_words: int = 50
    max_repeat_pct: int = 50
    min_group: int = 200
    fences: tuple[Fence, ...] = (
        Fence("symbol_rate", False, 3, 100), Fence("shout_rate", False, 3, 100), Fence("upper_rate", False, 3, 250),
        Fence("distinct_rate", True, 3, 50), Fence("dup_line_rate", False, 3, 500))


def _count(text: str, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(F.col(text), chars, ""))).cast("bigint")


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds ``COUNTS``, ``MORE`` and ``RATES`` to the columns of ``docs`` (or those named); one narrow pass over the whole texts."""
    own = ["_body", "_words", "_lines", "_runs", "_hits"]
    made = {*own, *COUNTS, *MORE, *RATES}
    df = docs.withColumn("_body", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = df.select("_body", *[f"`{c}`" for c in keep or docs.columns if c not in made])
    df = df.withColumn("_words", F.array_remove(F.split("_body", SPACE), ""))
    df = df.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.regexp_replace("_body", SPACE, "")).cast("bigint"),
        "n_symbols": _count("_body", "#*$%&|<>"),
        "n_shout": _count("_body", "!"),
        "n_upper": F.length(F.regexp_replace("_body", r"[^\p{Lu}]+", "")).cast("bigint"),
        "n_distinct": F.size(F.array_distinct("_words")).cast("bigint"),
        "_lines": F.filter(F.split("_body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        # an entry for each window of three words, sorted so that equal windows are neighbours
        "_runs": F.sort_array(F.transform(
            F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))),
            lambda w, i: F.struct(F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")))),
    })
    same = lambda x, k: F.coalesce(F.get("_runs", k)["h"] == x["h"], F.lit(False))
    df = df.withColumns({
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "_hits": F.sort_array(F.transform(F.filter("_runs", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])),
    })
    # words covered by the windows found: three each, less what the next one shares
    df = df.withColumn("n_repeat_words", F.aggregate(
        F.transform("_hits", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_hits", k + 1) - p, F.lit(3)))),
        F.lit(0).cast("bigint"), lambda a, x: a + x))
    rates = {r: F.expr(f"coalesce(1000 * {part} div nullif({whole}, 0), 0)") for r, (part, whole) in RATES.items()}
    return df.withColumns(rates).drop(*own)


def grid(value: Column) -> Column:
    """The sketch's grid: whole numbers below 64, then the six leading bits."""
    cut = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return value - value % F.call_function("shiftleft", F.lit(1).cast("bigint"), cut)


def sketches(measured: DataFrame, rates: list[str], keys: list[str]) -> DataFrame:
    """(keys, rate, at, n): how many documents of a group fall on each grid value."""
    rows = measured.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(r).alias("rate"), grid(F.col(r)).alias("at")) for r in rates])).alias("s"))
    return rows.groupBy(*keys, F.col("s.rate").alias("rate"), F.col("s.at").alias("at")).agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "rate", "at").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, total, q1, q3); a group has as many rows as the grid has values at most."""
    group = Window.partitionBy(*keys, "rate")
    rows = sketch.withColumns({
        "upto": F.sum("n").over(group.orderBy("at")), "total": F.sum("n").over(group)})
    return rows.groupBy(*keys, "rate").agg(
        F.max("total").alias("total"), F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("at"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("at"))).alias("q3"))


def limits(sketch: DataFrame, config: RuleConfig) -> DataFrame:
    """(_lang, _source, a limit per fence), from the group's sketch, its language's or the corpus'."""
    def wide(depth: int, keys: list[str]) -> DataFrame:
        iqr = F.col("q3") - F.col("q1")
        return quartiles(merge(sketch, keys), keys).groupBy(*keys).agg(F.max("total").alias(f"total{depth}"), *[
            F.max(F.when(F.col("rate") == f.rate, F.col("q1") - f.spread * iqr - f.slack if f.below
                         else F.col("q3") + f.spread * iqr + f.slack)).alias(f"{f.rate}{depth}") for f in config.fences])

    groups, langs, corpus = wide(2, ["lang", "source"]), wide(1, ["lang"]).withColumnRenamed("lang", "lang1"), wide(0, [])
    df = groups.join(langs, F.col("lang").eqNullSafe(F.col("lang1")), "left")
    return df.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[
        F.when(F.col("total2") >= config.min_group, F.col(f"{f.rate}2")).when(F.col("total1") >= config.min_group, F.col(f"{f.rate}1"))
        .otherwise(corpus.select(f"{f.rate}0").scalar()).alias(f"_{f.rate}") for f in config.fences])


def judge(measured: DataFrame, config: RuleConfig) -> DataFrame:
    """Adds ``base_failed``, ``kept`` and ``failed`` (names of the fences missed) to measured rows.

    The measures are stored before anything filters on them, so each text is measured once.
    """
    return _judged(*_sketched(materialize(_based(measured, config)), config), config)


def _based(measured: DataFrame, config: RuleConfig) -> DataFrame:
    return measured.withColumn(
        "base_failed", (F.col("n_words") < config.min_words) | (100 * F.col("n_repeat_words") > config.max_repeat_pct * F.col("n_words")))


def _sketched(measured: DataFrame, config: RuleConfig) -> tuple[DataFrame, DataFrame]:
    """The rows and their groups' fences, a row per group; they are broadcast if they are few."""
    rates = [f.rate for f in config.fences]
    fences = materialize(limits(materialize(sketches(measured.where(~F.col("base_failed")), rates, ["lang", "source"])), config))
    return measured, F.broadcast(fences) if fences.count() <= BROADCAST_GROUPS else fences


def _judged(measured: DataFrame, fences: DataFrame, config: RuleConfig) -> DataFrame:
    rates = [f.rate for f in config.fences]
    df = measured.join(fences, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    failed = F.array_compact(F.array(*[
        F.when((F.col(f.rate) < F.col(f"_{f.rate}")) if f.below else (F.col(f.rate) > F.col(f"_{f.rate}")), F.lit(f.rate))
        for f in config.fences]))
    return df.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop(
        "_lang", "_source", *[f"_{r}" for r in rates])


def apply_rules(docs: DataFrame, config: RuleConfig = RuleConfig(), text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, the measures, and what ``judge`` adds."""
    return judge(measure(docs.drop("base_failed", "kept", "failed"), text).drop(text), config)


def keep(docs: DataFrame, config: RuleConfig = RuleConfig(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns, also those named like a measure.

    Texts are neither stored nor shuffled: they are measured once for the sketch and again beside the fences.
    """
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), *[f"`{c}`" for c in sorted({text, "lang", "source"})])
    names = ["base_failed", *[f.rate for f in config.fences]]
    measured = _based(measure(rows, text, ("_row", "lang", "source")), config).select("_row", "lang", "source", F.struct(*names).alias("_m"))
    measured = computed_once(measured, "_m").select("_row", "lang", "source", "_m.*")
    return _judged(*_sketched(measured, config), config).where("kept").select("_row.*")
