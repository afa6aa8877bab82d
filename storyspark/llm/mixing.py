"""Mixing sources to target weights by budgets over a tree of domain, language and source.

The root's budget of tokens goes down the tree. At a node it is shared by the children's weights; a child that
cannot use its share, since its documents times ``epochs`` hold less, takes what it has, and its siblings share the
rest by their weights. Only what all children together cannot use is seen one level up, where the node's own siblings
take it: shortages go to siblings before ancestors. Shares are whole numbers.

A leaf then reads its documents epoch by epoch, each epoch in the order of a hash seeded by (seed, epoch), and takes
documents as long as their tokens so far stay within its budget: the longest prefix. Whole epochs are taken as they
are; only the epoch in which the budget ends needs an order. There, documents are dealt to slots of the hash; sums
per slot tell which slots are in, and only the one slot in which the budget ends is sorted. So a leaf that holds a third
of all rows is never sorted in one task.

Cases: null keys are a value of their own with the default weight; a null text has no tokens and is taken with its
place in the order; a repeated row is a document of its own (ties in the order go by id and text); a leaf whose
budget or weight is 0 selects nothing, documents without tokens neither; an empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SLOT_DIGITS = 3  # 4,096 slots per leaf


@dataclass(frozen=True)
class Mix:
    """``weights``: per level, whole numbers by key value; a value not listed has ``default_weight``."""

    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    default_weight: int = 1
    epochs: int = 1
    seed: int = 7
    budget_pct: int = 80


def tokens_of(text: Column) -> Column:
    """Words between ASCII white space, the unit of budgets unless a column is given."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def share(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``budget`` to (``parent`` columns, ``key``, ``weight``, ``capacity``, ``given``).

    In the order of capacity per weight, those children are short whose capacity is below their share of what
    the ones before leave. The first one that is not short ends the run; it and all after it share by weight.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("weight") == 0, F.col("ratio"), F.col("key").asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    df = children.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity").cast("decimal(38,0)") / F.col("weight")))
    df = df.withColumns({
        "left": F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0)),
        "wide": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    big = lambda c: F.col(c).cast("decimal(38,0)")
    df = df.withColumn("short", (F.col("weight") > 0) & (F.col("left") >= 0) & (big("capacity") * F.col("wide") <= big("left") * F.col("weight")))
    df = df.withColumns({
        "rest": F.max(F.when(~F.col("short") & (F.col("weight") > 0), F.col("left"))).over(whole),
        "over": F.max(F.when(~F.col("short"), F.col("wide"))).over(whole)})
    return df.withColumn("budget", F.when(F.col("weight") == 0, F.lit(0)).when(F.col("short"), F.col("capacity"))
                         .otherwise(F.expr("cast(rest as decimal(38,0)) * weight div over")).cast("bigint")).drop("ratio", "left", "wide", "short", "rest", "over")


def budgets(leaves: DataFrame, mix: Mix, total: int | Column) -> DataFrame:
    """(levels, size, budget) of each leaf from (levels, size): weights go down the tree, shortages to siblings first."""
    levels = list(mix.levels)

    def weight(level: str) -> Column:
        w = F.lit(mix.default_weight).cast("bigint")
        for value, own in mix.weights.get(level, {}).items():
            w = F.when(F.col(level).eqNullSafe(F.lit(value)), F.lit(own).cast("bigint")).otherwise(w)
        return w

    used = F.array_min(F.array(*[weight(c) for c in levels])) > 0  # what lies under a weight of 0 is no capacity
    leaves = leaves.withColumn("capacity", F.when(used, F.col("size") * mix.epochs).otherwise(0))
    above = leaves.select(F.lit(0).alias("_root"), (total if isinstance(total, Column) else F.lit(total)).cast("bigint").alias("budget")).limit(1)
    for depth, level in enumerate(levels):
        parent, keys = levels[:depth], levels[:depth + 1]
        nodes = leaves.groupBy(*keys).agg(F.sum("size").alias("size"), F.sum("capacity").alias("capacity")).withColumns(
            {"key": F.col(level), "weight": weight(level), "_root": F.lit(0)})
        up = above.select(F.col("_root").alias("__root"), *[F.col(c).alias(f"_{c}") for c in parent], F.col("budget").alias("given"))
        on = [F.col("_root") == F.col("__root"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in parent]]
        above = share(nodes.join(up, on).drop("__root", *[f"_{c}" for c in parent]), parent)
    return above.select(*levels, "size", "budget")


def select(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", tokens: str | None = None) -> DataFrame:
    """The rows of ``docs`` that are taken, one for each epoch, with ``epoch`` (from 0) and ``tokens``."""
    levels = list(mix.levels)
    own = ("_tokens", "_order", "_slot", "_leaf", "_from", "_rest", "_full", "_sum", "_cut", "epoch", "tokens")
    count = tokens_of(F.col(f"`{text}`")) if tokens is None else F.coalesce(F.col(f"`{tokens}`").cast("bigint"), F.lit(0))
    rows = docs.withColumn("_tokens", count).select("_tokens", *[f"`{c}`" for c in docs.columns if c not in own])
    leaf = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in levels]), 256)

    sizes = materialize(rows.groupBy(*levels).agg(F.sum("_tokens").alias("size")))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).select(F.expr(f"n * {mix.budget_pct} div 100")).scalar()
    plan = budgets(sizes, mix, total).where("budget > 0").withColumn("_full", F.expr(f"least(budget div size, {mix.epochs})").cast("int"))
    plan = materialize(plan.select(leaf.alias("_leaf"), "_full", (F.col("budget") - F.col("_full") * F.col("size")).alias("_rest")))

    def dealt(plan: DataFrame) -> DataFrame:
        """Documents of the leaves in the order of the epoch in which the budget ends."""
        order = F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("_full"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).cast("binary"))
        return rows.withColumn("_leaf", leaf).join(plan, "_leaf").withColumn("_order", order).withColumn("_slot", F.left("_order", F.lit(SLOT_DIGITS)))

    # the slot in which the budget ends, and the tokens before it; a leaf has as many slots as there are numbers
    slots = dealt(plan).where(F.col("_full") < mix.epochs).groupBy("_leaf", "_slot", "_rest").agg(F.sum("_tokens").alias("n"))
    slots = slots.withColumn("upto", F.sum("n").over(Window.partitionBy("_leaf").orderBy("_slot"))).where("upto > _rest")
    ends = slots.groupBy("_leaf").agg(F.min(F.struct("_slot", (F.col("upto") - F.col("n")).alias("before"))).alias("e"))
    plan = materialize(plan.join(ends, "_leaf", "left").select(
        "_leaf", "_full", "_rest", F.coalesce("e._slot", F.lit("~")).alias("_cut"), F.col("e.before").alias("_from")))

    every = dealt(plan)
    whole = every.withColumn("epoch", F.explode(F.expr(f"filter(sequence(0, {mix.epochs - 1}), e -> e < _full OR e = _full AND _slot < _cut)")))
    inside = Window.partitionBy("_leaf", "_slot").orderBy("_order", F.col(f"`{doc_id}`"), F.col(f"`{text}`")).rowsBetween(Window.unboundedPreceding, 0)
    part = every.where((F.col("_full") < mix.epochs) & (F.col("_slot") == F.col("_cut"))).withColumn("_sum", F.col("_from") + F.sum("_tokens").over(inside))
    part = part.where("_sum <= _rest").withColumn("epoch", F.col("_full")).drop("_sum")
    return whole.unionByName(part).withColumnRenamed("_tokens", "tokens").drop("_leaf", "_full", "_rest", "_cut", "_from", "_order", "_slot")
