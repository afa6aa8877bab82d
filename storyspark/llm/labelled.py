"""Labelled training rows, bounded and without the held-out ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, y) of at most ``bound`` labelled ids that are not held out, the first in the order of a hash of the id.

    Conflicting labels of one id are averaged, and those of exactly one half are left out; so are null ids, null labels and
    labels without a document. The bound is on labels, so the broadcast side is bounded too; texts stay distributed.
    """
    y = F.avg(F.col(f"`{label}`").cast("double"))
    known = (labels.where(F.col(f"`{doc_id}`").isNotNull() & F.col(f"`{label}`").isNotNull() & ~held_out(F.col(f"`{doc_id}`")))
             .groupBy(F.col(f"`{doc_id}`").alias("_id")).agg(y.alias("y")).where("y <> 0.5")
             .orderBy(F.xxhash64("_id"), "_id").limit(bound))
    return (docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(known), "_id")
            .select("_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("y") > 0.5).cast("double").alias("y")))
