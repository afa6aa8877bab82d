"""The corpus pipeline: quality rules, near-dedup, personal data, mixing and packing, each on what the stage before kept.

All stages take null, empty and very long texts, nulls in any column, repeated rows, empty tables, and more columns whatever
their names and types: a row travels in one struct, and only columns that a stage is about are touched. Each docstring
says what becomes of such rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.llm import mixing, near_dedup, packing, pii, quality_rules
from storyspark.llm.common import drop_step, materialize, table
from storyspark.llm.queries import with_domain

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Weights of the tree; every document is used once at most, since copies were removed on purpose.
MIX = mixing.Mix(weights={"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}, epochs=1, budget_pct=80)


def _carried(docs: DataFrame, *names: str) -> DataFrame:
    """The columns ``names`` beside the whole row in ``_row``, so that nothing an operator adds can meet a column of the row."""
    return docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), *[f"`{c}`" for c in names])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of their language and source.

    Null and empty texts have no words and go; null languages and sources are groups of their own; equal rows are each kept or
    not for themselves; ties do not occur, as limits are compared, not ranked.
    """
    return quality_rules.keep(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Texts without words are copies of nothing and stay, as do rows with a null id; rows with one id are one document, of which
    the first row in the order of its JSON text stays; equal texts are copies.
    """
    return near_dedup.keep_one(docs, near_dedup.JoinConfig(words=5, pct=80))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` follows the text.

    All rows stay, and all but texts with findings as they are; null texts stay null. Overlapping findings are replaced together.
    """
    found = pii.detect(_carried(docs, "text"))
    found = found.withColumn("_masked", pii.mask(F.col("text"), F.col("spans")))
    new = {"text": F.col("_masked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("_masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return found.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken by the target weights of domains, languages and sources.

    Null languages and sources are leaves of their own; texts without words cost nothing and are taken with a leaf that has a budget;
    equal rows are taken one after the other, by id and text.
    """
    return mixing.select(with_domain(_carried(docs, "doc_id", "text", "lang", "source")), MIX).select("_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of at most 1,024 tokens.

    Null and empty texts are a piece with the end id alone; equal rows and null ids are packed like others; long texts are cut.
    """
    return packing.pack(docs, capacity=1024, end_id=2).drop("row")


STAGES: list[tuple[str, Stage]] = [("quality_rules", quality), ("near_dedup", dedup), ("pii", private), ("mixing", mix), ("packing", pack)]

#: Stages use minwise trees, expectation-maximisation and a tokenizer, which SQL cannot express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is stored and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            drop_step(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
