"""Row numbers, running sums and previous rows over orders too long for one task.

A window without keys, or with a key that holds a third of all rows, runs in
one task. Here the rows are split into ranges of the wanted order first; each
range is numbered on its own and then shifted by what the ranges before it
hold. Ranges are balanced whatever the keys look like.

The ranges are written to the checkpoint folder once. Range bounds come from a
sample, so computing them twice (for the rows and for the range totals) could
give two different splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned

BLOCK = "_block"


def _names(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


class Ordered:
    """Rows pinned in ranges of (`keys`, `order`); `order` must leave no ties.

    `previous` and `following` take ascending orders only.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]):
        self.keys = list(keys)
        self.order = _names(order)
        # Without a fixed number AQE merges neighbouring ranges of small data; order stays.
        ranged = df.repartitionByRange(*[F.col(k) for k in self.keys], *self.order)
        self.rows = pinned(ranged.withColumn(BLOCK, F.spark_partition_id()))

    def _inside(self):
        return Window.partitionBy(*self.keys, BLOCK).orderBy(*self.order)

    def _across(self):
        # One row per key and range: as many rows as keys plus ranges.
        return Window.partitionBy(*self.keys).orderBy(BLOCK)

    def _carried(self, summary: DataFrame) -> None:
        on = [self.rows[k].eqNullSafe(summary[k]) for k in [*self.keys, BLOCK]]
        joined = self.rows.join(summary, on, "left")
        for k in [*self.keys, BLOCK]:
            joined = joined.drop(summary[k])
        self.rows = joined

    def running_sum(self, sums: dict[str, Column]) -> "Ordered":
        """Add inclusive running sums per key."""
        totals = self.rows.groupBy(*self.keys, BLOCK).agg(
            *[F.sum(c).alias(n) for n, c in sums.items()]
        )
        before = self._across().rowsBetween(Window.unboundedPreceding, -1)
        base = totals.select(
            *self.keys, BLOCK, *[F.sum(n).over(before).alias(f"_base_{n}") for n in sums]
        )
        upto = self._inside().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.rows = self.rows.select("*", *[F.sum(c).over(upto).alias(n) for n, c in sums.items()])
        self._carried(base)
        for n in sums:
            self.rows = self.rows.withColumn(
                n, F.col(n) + F.coalesce(F.col(f"_base_{n}"), F.lit(0))
            ).drop(f"_base_{n}")
        return self

    def row_number(self, name: str = "rank") -> "Ordered":
        return self.running_sum({name: F.lit(1).cast("bigint")})

    def max_before(self, name: str, value: Column) -> "Ordered":
        """Add the largest value of all rows before, per key; null for the first row."""
        tops = self.rows.groupBy(*self.keys, BLOCK).agg(F.max(value).alias("_top"))
        before = self._across().rowsBetween(Window.unboundedPreceding, -1)
        base = tops.select(*self.keys, BLOCK, F.max("_top").over(before).alias("_base"))
        inside = self._inside().rowsBetween(Window.unboundedPreceding, -1)
        self.rows = self.rows.select("*", F.max(value).over(inside).alias(name))
        self._carried(base)
        self.rows = self.rows.withColumn(name, F.greatest(F.col(name), F.col("_base"))).drop("_base")
        return self

    def following(self, name: str, value: Column) -> "Ordered":
        """Add the value of the row behind, per key."""
        rank = F.struct(*[c for c in self.order])
        first = self.rows.groupBy(*self.keys, BLOCK).agg(F.min_by(value, rank).alias("_first"))
        base = first.select(*self.keys, BLOCK, F.lead("_first").over(self._across()).alias("_behind"))
        w = self._inside()
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        self.rows = self.rows.select("*", F.lead(value).over(w).alias(name),
                                     (F.row_number().over(w) == F.count("*").over(whole)).alias("_last"))
        self._carried(base)
        self.rows = self.rows.withColumn(
            name, F.when(F.col("_last"), F.col("_behind")).otherwise(F.col(name))).drop("_behind", "_last")
        return self

    def previous(self, name: str, value: Column) -> "Ordered":
        """Add the value of the row before, per key."""
        rank = F.struct(*[c for c in self.order])
        last = self.rows.groupBy(*self.keys, BLOCK).agg(F.max_by(value, rank).alias("_last"))
        base = last.select(*self.keys, BLOCK, F.lag("_last").over(self._across()).alias("_before"))
        w = self._inside()
        self.rows = self.rows.select("*", F.lag(value).over(w).alias(name),
                                     F.row_number().over(w).alias("_first"))
        self._carried(base)
        self.rows = self.rows.withColumn(
            name, F.when(F.col("_first") == 1, F.col("_before")).otherwise(F.col(name))
        ).drop("_before", "_first")
        return self

    def result(self) -> DataFrame:
        return self.rows.drop(BLOCK)
