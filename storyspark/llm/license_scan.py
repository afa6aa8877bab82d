"""License scan as an exact set-similarity join of text blocks with notice templates.

A block is a run of ``2 * stride`` words starting at a multiple of ``stride``, so every run of up to
``stride + 1`` words lies in one. A block meets a template when it holds at least ``threshold`` of the
template's distinct words. Template words are ordered by how many documents have them, rarest first.
A block that meets a template of m words with k of them required must hold one of the template's first
m - k + 1 words (prefix filter), must hold k template-vocabulary words at all (length filter), and, from
the place of the shared word in both orders on, must have enough words left (positional filter). What
remains is verified on whole blocks. The join misses nothing: each filter is a necessary condition.

Ordered templates (the base phrases) need all words of a phrase, one after the other; they have a prefix of
one word, and each place is found from the one occurrence of its rarest word.

Only template words reach the prefix table, so it is as small as the template list, which is configuration;
it is broadcast, and the texts are never shuffled.

Cases: a null text has no words; repeated rows give a row each; empty tables give no rows; very long texts
are scanned whole, their blocks being rows of one task's stream; columns other than id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float = 1.0
    ordered: bool = False


#: The base phrases.
BASE = (
    Template("mit", "mit license", ordered=True),
    Template("apache", "apache license", ordered=True),
    Template("gpl", "general public license", ordered=True),
)
#: Notices that count when a block holds most of their words.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", 0.9),
    Template("cc-by", "this work is licensed under a creative commons attribution license", 0.8),
    Template("cc-by-nc", "licensed under cc by nc 4 0", 0.9),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", 0.9),
    Template("mit", "released under the mit license", 0.9),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 0.8),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 0.8),
    Template("warranty", "the software is provided as is without warranty of any kind express or implied", 0.8),
)
STRIDE = 24


def words(text: Column) -> Column:
    """Runs of digits, letters a-z (A-Z lowered) and characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(text), GAP), "")


def template_words(t: Template) -> list[str]:
    return list(dict.fromkeys(t.text.split()))


def required(t: Template) -> int:
    """The least number of shared words; whole-number arithmetic on per cents."""
    m, pct = len(template_words(t)), round(t.threshold * 100)
    return max(1, -(-m * pct // 100))


def document_counts(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """Documents that have each template word. The driver gets a row per template word, never more."""
    rows = (docs.select(F.explode(F.array_distinct(F.filter(words(F.col(f"`{text}`")), lambda w: w.isin(vocabulary)))).alias("w"))
            .groupBy("w").agg(F.count("*").alias("n")).collect())
    return {r["w"]: r["n"] for r in rows}


def prefix_table(spark: SparkSession, templates: tuple[Template, ...], rank: dict[str, int]) -> DataFrame:
    """A row per template and prefix word: its place in the template's order, and what verification needs."""
    rows = []
    for k, t in enumerate(templates):
        order = sorted(template_words(t), key=rank.__getitem__)
        need = required(t)
        rows += [(w, k, i, len(order), need, sorted(rank[x] for x in order), t.text.split(), t.text.split().index(w), t.ordered, t.label)
                 for i, w in enumerate(order[:len(order) - need + 1])]
    return spark.createDataFrame(rows, "token string, template int, i int, m int, need int, ranks array<int>, phrase array<string>, "
                                       "back int, ordered boolean, label string")


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, doc_id: str = "doc_id", text: str = "text",
         stride: int = STRIDE) -> DataFrame:
    """A row per document and met (block, template), and one with null template for a document without any.

    Columns: row (a number per input row), doc_id, n_words, template, label, ordered, block, start (of the phrase, for
    ordered templates), overlap, m.
    """
    spark = docs.sparkSession
    longest = max(len(t.text.split()) for t in templates)
    if longest > stride + 1:
        raise ValueError(f"a template has {longest} words; blocks hold any {stride + 1}")
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    n = document_counts(docs, text, vocabulary)
    rank = {w: r for r, w in enumerate(sorted(vocabulary, key=lambda w: (n.get(w, 0), w)))}
    prefix = prefix_table(spark, templates, rank)
    anchors = sorted({w for t in templates for w in sorted(template_words(t), key=rank.__getitem__)[:len(template_words(t)) - required(t) + 1]})
    ranks = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, rank[w])])

    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), words(F.col(f"`{text}`")).alias("ws"))
    df = df.select("row", "doc_id", F.size("ws").cast("bigint").alias("n_words"), "ws", F.filter(
        F.transform("ws", lambda w, p: F.when(w.isin(anchors), p)), lambda p: p.isNotNull()).alias("at"))
    # a word in a prefix, with the two blocks that hold it
    near = df.select("row", "doc_id", "n_words", F.explode_outer(F.transform("at", lambda p: F.struct(
        p.alias("p"), F.get("ws", p).alias("token"),
        F.slice("ws", F.greatest((F.floor(p / stride).cast("int") - 1) * stride, F.lit(0)) + 1, F.lit(3 * stride)).alias("around"),
        F.greatest((F.floor(p / stride).cast("int") - 1) * stride, F.lit(0)).alias("from")))).alias("a"))
    first = F.floor(F.col("a.p") / stride).cast("int")
    pairs = near.select("row", "doc_id", "n_words", F.col("a.p").alias("p"), F.col("a.token").alias("token"), F.explode_outer(F.when(
        F.col("a").isNotNull(), F.transform(F.array_distinct(F.array(F.greatest(first - 1, F.lit(0)), first)), lambda b: F.struct(
            b.alias("block"), F.slice("a.around", b * stride - F.col("a.from") + 1, F.lit(2 * stride)).alias("words"))))).alias("b"))
    ordered_ranks = F.array_sort(F.transform(F.array_distinct(F.filter("b.words", lambda w: w.isin(vocabulary))), lambda w: F.element_at(ranks, w)))
    pairs = pairs.withColumn("own", F.when(F.col("b").isNotNull(), ordered_ranks)).join(F.broadcast(prefix), "token", "left")
    # length filter, then what is left in both orders from the shared word on
    j = F.array_position("own", F.element_at("ranks", F.col("i") + 1)).cast("int") - 1
    possible = (F.size("own") >= F.col("need")) & (F.least(F.col("m") - F.col("i"), F.size("own") - j) >= F.col("need"))
    overlap = F.size(F.array_intersect("own", "ranks"))
    start = F.col("p") - F.col("back")
    at = start - F.col("b.block") * stride
    in_place = (at >= 0) & (F.slice("b.words", F.greatest(at, F.lit(0)) + 1, F.size("phrase")) == F.col("phrase"))
    # a place that two blocks hold counts in the later one, which starts nearest to it
    mine = F.floor(start / stride) == F.col("b.block")
    met = F.col("template").isNotNull() & possible & (overlap >= F.col("need")) & (~F.col("ordered") | (in_place & mine))
    keep = lambda c: F.when(met, c)
    return pairs.select("row", "doc_id", "n_words", keep(F.col("template")).alias("template"), keep(F.col("label")).alias("label"),
                        keep(F.col("ordered")).alias("ordered"), keep(F.col("b.block")).alias("block"),
                        keep(F.when(F.col("ordered"), start)).cast("bigint").alias("start"), keep(overlap).alias("overlap"), keep(F.col("m")).alias("m"))


def per_document(found: DataFrame) -> DataFrame:
    """One row per input row: places, labels of base phrases, all labels, and the best containment as score."""
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = F.when(F.col("ordered"), F.col("label"))
    return found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count(base).alias("n_base"),
        F.min("start").alias("first_word"), F.max("start").alias("last_word"), labels(base).alias("base_labels"),
        labels(F.col("label")).alias("labels"), F.coalesce(F.max(F.col("overlap") / F.col("m")), F.lit(0.0)).alias("score")).drop("row")
