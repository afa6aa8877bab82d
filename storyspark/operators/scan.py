"""Running values over the ordered rows of a key, whatever a key's share of the rows.

A plain window sends every row of a key to one task. That is right for keys of ordinary size, so they
get just that: one shuffle, one sort, all values from the same window. Keys with more than ``block_rows``
rows are counted first. Each of these is cut into blocks of about that many rows by bounds from a sample of its
order columns (which end in a unique column, so rows of one moment can be cut apart too), and the window runs
inside (key, block). One summary row per block holds all that later or earlier blocks need; the summaries are
carried over the blocks of a key and joined back. Only summaries of a key ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BLOCK_ROWS = 200_000
#: Blocks of all hot keys together at most, which bounds what is broadcast; beyond it blocks hold more rows.
MAX_BLOCKS = 100_000
#: Sampled rows per block from which bounds are taken.
SAMPLES = 32

_BLOCK = "__block"


@dataclass(frozen=True)
class Running:
    """A running value: how rows of a block, and then blocks of a key, are combined."""

    kind: str
    value: Column


def previous(value: Column) -> Running:
    """``value`` of the preceding row."""
    return Running("previous", value)


def total(value: Column) -> Running:
    """Sum of ``value`` up to and including the row."""
    return Running("total", value)


def greatest_before(value: Column) -> Running:
    """Greatest ``value`` among the strictly earlier rows."""
    return Running("greatest_before", value)


def nearest_before(value: Column) -> Running:
    """Nearest non-null ``value`` at a strictly smaller position; the order is one BIGINT column."""
    return Running("nearest_before", value)


def nearest_after(value: Column) -> Running:
    """Nearest non-null ``value`` at a strictly greater position; the order is one BIGINT column."""
    return Running("nearest_after", value)


class Blocks:
    """The blocks of ``df`` for running values by ``keys`` in ``order``; counting rows per key is one job."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[Column], block_rows: int | None = None):
        self.keys, self.order = list(keys), list(order)
        rows = block_rows or BLOCK_ROWS
        counts = df.groupBy(*self.keys).agg(F.count("*").alias("__n")).where(F.col("__n") > rows)
        hot = counts.agg(F.count("*").alias("keys"), F.sum("__n").alias("rows")).first()
        self.bounds = self._bounds(df, counts, max(rows, -(-(hot["rows"] or 0) // MAX_BLOCKS))) if hot["keys"] else None

    def _same(self, prefix: str) -> Column:
        on = F.lit(True)
        for k in self.keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
        return on

    def _bounds(self, df: DataFrame, counts: DataFrame, rows: int) -> DataFrame:
        """Ascending bounds per hot key, from the rows that a hash of key and order picks."""
        hot = cut(counts.select(*[F.col(k).alias(f"__h_{k}") for k in self.keys]))
        place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(self.order)])
        every = max(1, rows // SAMPLES)
        picked = df.select(*self.keys, place.alias("__o")).where(F.pmod(F.xxhash64(*self.keys, "__o"), F.lit(every)) == 0)
        picked = picked.join(F.broadcast(hot), self._same("__h_"))
        ranked = picked.withColumn("__r", F.row_number().over(Window.partitionBy(*self.keys).orderBy("__o"))).where(F.col("__r") % SAMPLES == 0)
        return cut(ranked.groupBy(*[F.col(k).alias(f"__h_{k}") for k in self.keys]).agg(F.sort_array(F.collect_set("__o")).alias("__bounds")))

    def add(self, df: DataFrame, wanted: Mapping[str, Running]) -> DataFrame:
        """``df`` with the running values as columns. May be called again for values that build on these."""
        if self.bounds is None:
            return self._windows(df, wanted, self.keys, {})
        place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(self.order)])
        block = F.size(F.filter("__bounds", lambda b: b <= place))
        rows = df.join(F.broadcast(self.bounds), self._same("__h_"), "left").withColumn(_BLOCK, F.when(F.col("__bounds").isNotNull(), block))
        rows = rows.drop("__bounds", *[f"__h_{k}" for k in self.keys])
        carried = self._carried(rows.where(F.col(_BLOCK).isNotNull()), wanted)
        on = self._same("__c_") & F.col(_BLOCK).eqNullSafe(F.col(f"__c_{_BLOCK}"))
        # a row per block, MAX_BLOCKS about
        joined = rows.join(F.broadcast(carried), on, "left").drop(*[f"__c_{k}" for k in (*self.keys, _BLOCK)])
        out = self._windows(joined, wanted, [*self.keys, _BLOCK], {name: F.col(f"__s_{name}") for name in wanted})
        # read once by what follows, which may look at it twice
        return cut(out.drop(_BLOCK, *[f"__s_{name}" for name in wanted]))

    def _carried(self, rows: DataFrame, wanted: Mapping[str, Running]) -> DataFrame:
        place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(self.order)])

        def summary(r: Running) -> Column:
            if r.kind == "previous":
                return F.max_by(F.struct(r.value.alias("v")), place)
            if r.kind == "total":
                return F.sum(r.value)
            if r.kind == "greatest_before":
                return F.max(r.value)
            seen = F.when(r.value.isNotNull(), self.order[0])
            return F.max_by(r.value, seen) if r.kind == "nearest_before" else F.min_by(r.value, seen)

        blocks = rows.groupBy(*self.keys, _BLOCK).agg(*[summary(r).alias(f"__s_{name}") for name, r in wanted.items()])
        order = Window.partitionBy(*self.keys).orderBy(_BLOCK)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy(*self.keys).orderBy(F.desc(_BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
        fold = {"previous": lambda c: F.last(c, ignorenulls=True).over(before)["v"], "total": lambda c: F.sum(c).over(before),
                "greatest_before": lambda c: F.max(c).over(before), "nearest_before": lambda c: F.last(c, ignorenulls=True).over(before),
                "nearest_after": lambda c: F.last(c, ignorenulls=True).over(after)}
        return blocks.select(*[F.col(k).alias(f"__c_{k}") for k in (*self.keys, _BLOCK)],
                             *[fold[r.kind](F.col(f"__s_{name}")).alias(f"__s_{name}") for name, r in wanted.items()])

    def _windows(self, df: DataFrame, wanted: Mapping[str, Running], by: list[str], carried: Mapping[str, Column]) -> DataFrame:
        """All values from one window per (key, block); ``carried`` is what earlier or later blocks add."""
        w = Window.partitionBy(*by).orderBy(*self.order)
        made = {}
        for name, r in wanted.items():
            carry = carried.get(name)
            if r.kind == "previous":
                lag = F.lag(F.struct(r.value.alias("v"))).over(w)
                made[name] = lag["v"] if carry is None else F.when(lag.isNotNull(), lag["v"]).otherwise(carry)
            elif r.kind == "total":
                own = F.sum(r.value).over(w.rowsBetween(Window.unboundedPreceding, 0))
                made[name] = own if carry is None else own + F.coalesce(carry, F.lit(0))
            elif r.kind == "greatest_before":
                own = F.max(r.value).over(w.rowsBetween(Window.unboundedPreceding, -1))
                made[name] = own if carry is None else F.when(own.isNull(), carry).when(carry.isNull(), own).otherwise(F.greatest(own, carry))
            else:
                # seen from the end, what follows is what comes before: a frame that only grows takes linear time
                seen = w if r.kind == "nearest_before" else Window.partitionBy(*by).orderBy(-self.order[0])
                own = F.last(r.value, ignorenulls=True).over(seen.rangeBetween(Window.unboundedPreceding, -1))
                made[name] = own if carry is None else F.coalesce(own, carry)
        return df.withColumns(made)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], wanted: Mapping[str, Running], block_rows: int | None = None) -> DataFrame:
    """``df`` with running values by ``keys`` in ``order``."""
    return Blocks(df, keys, order, block_rows).add(df, wanted)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``. Spark limits each key before the shuffle."""
    return top_per(df, keys, order, 1)


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str | None = None) -> DataFrame:
    """First ``k`` rows per key; ``name`` keeps the position as a column."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = df.withColumn(name or "__rn", rn).where(F.col(name or "__rn") <= k)
    return out if name else out.drop("__rn")


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Columns of a one-row aggregate on every row, as a scalar subquery and not as a join."""
    names = one_row.columns
    value = one_row.select(F.struct(*names).alias("s")).scalar()
    return df.withColumn("__one", value).select(*df.columns, *[F.col(f"__one.{c}").alias(c) for c in names])


def computed_once(df: DataFrame, name: str) -> DataFrame:
    """A costly column behind a generator, which filters are not moved through: else they would compute it again."""
    return df.select(*[c for c in df.columns if c != name], F.inline_outer(F.array(F.struct(name))))
