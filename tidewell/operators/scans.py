"""Ordered scans of series of any length: the last value so far, the next value, running sums and row numbers.

Rows are range-partitioned by (keys, order), so a long series lies in several ranges and a task holds one range of it. Each range is
scanned by itself; what it needs from the ranges before or after comes from a table with one row a key and range, of keys that
lie in more than one range only. A range has at most two such keys, its first and its last, so that table has at most two rows
a range and is broadcast whatever the size of the data. Rows with the same key and order always share a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.stable import stable

#: Rows of one range where the number of ranges is counted.
RANGE_ROWS = 1_000_000


class Scan:
    """``rows`` placed in ranges; ``frame`` holds them with the columns that the methods add."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None):
        ranged = rows.repartitionByRange(*([parts] if parts else []), *keys, *order)
        self.keys, self.order, self.columns = keys, order, rows.columns
        self.placed = stable(ranged.withColumn("_part", F.spark_partition_id()))
        self.frame = self.placed

    def _within(self, down: bool = False) -> WindowSpec:
        order = [F.col(c).desc() if down else F.col(c).asc() for c in self.order]
        return Window.partitionBy("_part", *self.keys).orderBy(*order)

    def _edges(self, *summaries: Column) -> DataFrame:
        """The summaries by key and range, of keys in several ranges."""
        each = self.placed.groupBy(*self.keys, "_part").agg(*summaries)
        return each.withColumn("_ranges", F.count("*").over(Window.partitionBy(*self.keys))).where("_ranges > 1").drop("_ranges")

    def _across(self, down: bool = False) -> WindowSpec:
        """The ranges before a range of the same key, in the direction of the scan."""
        return Window.partitionBy(*self.keys).orderBy(F.col("_part").desc() if down else F.col("_part").asc()).rowsBetween(Window.unboundedPreceding, -1)

    def _with(self, edges: DataFrame, *columns: str) -> DataFrame:
        """``frame`` with columns of ``edges`` by key and range; null keys meet each other."""
        named = edges.select(*(F.col(k).alias(f"_of_{k}") for k in (*self.keys, "_part")), *columns)
        same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in (*self.keys, "_part")]
        return self.frame.join(F.broadcast(named), same, "left").drop(*(f"_of_{k}" for k in (*self.keys, "_part")))

    def carry(self, value: Column, out: str, down: bool = False) -> Scan:
        """``out``: the last value that is not null up to each row, rows of the same order included; with ``down`` from the other end."""
        at = F.struct(*self.order)
        some = F.when(value.isNotNull(), at)
        edge = F.min_by(value, some) if down else F.max_by(value, some)
        before = F.last("_edge", ignorenulls=True).over(self._across(down))
        edges = self._edges(edge.alias("_edge")).withColumn("_before", before)
        frame = self._within(down).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        own = F.last(value, ignorenulls=True).over(frame)
        self.frame = self._with(edges, "_before").withColumn(out, F.coalesce(own, F.col("_before"))).drop("_before")
        return self

    def total(self, value: Column, out: str) -> Scan:
        """``out``: the sum of a column up to each row, rows of the same order included."""
        edges = self._edges(F.sum(value).alias("_sum")).withColumn("_before", F.sum("_sum").over(self._across()))
        frame = self._within().rangeBetween(Window.unboundedPreceding, Window.currentRow)
        self.frame = self._with(edges, "_before").withColumn(out, F.coalesce(F.sum(value).over(frame), F.lit(0)) + F.coalesce(F.col("_before"), F.lit(0))).drop("_before")
        return self

    def whole(self, value: Column, out: str) -> Scan:
        """``out``: the sum of a column over all rows of the key."""
        edges = self._edges(F.sum(value).alias("_sum")).withColumn("_all", F.sum("_sum").over(Window.partitionBy(*self.keys)))
        own = F.sum(value).over(Window.partitionBy("_part", *self.keys))
        self.frame = self._with(edges, "_all").withColumn(out, F.coalesce(F.col("_all"), own)).drop("_all")
        return self

    def number(self, out: str) -> Scan:
        """``out``: the number of each row in its key, from 1."""
        edges = self._edges(F.count("*").alias("_held")).withColumn("_before", F.sum("_held").over(self._across()))
        self.frame = self._with(edges, "_before").withColumn(out, F.row_number().over(self._within()) + F.coalesce(F.col("_before"), F.lit(0))).drop("_before")
        return self

    def trapezoid(self, x: str, y: str, out: str) -> Scan:
        """``out``: the integral of y over x from a key's first row on, by trapezoids between rows that follow each other."""
        point = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
        area = lambda a, b: (b["x"] - a["x"]) * (b["y"] + a["y"]) / 2.0
        within = self._within()
        step = lambda c: F.coalesce(area(F.lag(c).over(within), c), F.lit(0.0))
        at = F.struct(*self.order)
        stepped = self.placed.withColumn("_step", step(point))
        each = stepped.groupBy(*self.keys, "_part").agg(F.min_by(point, at).alias("_first"), F.max_by(point, at).alias("_last"), F.sum("_step").alias("_sum"))
        each = each.withColumn("_ranges", F.count("*").over(Window.partitionBy(*self.keys))).where("_ranges > 1")
        joint = F.coalesce(area(F.lag("_last").over(Window.partitionBy(*self.keys).orderBy("_part")), F.col("_first")), F.lit(0.0))
        edges = each.withColumn("_joint", joint)
        edges = edges.withColumn("_before", F.coalesce(F.sum(F.col("_sum") + F.col("_joint")).over(self._across()), F.lit(0.0)) + F.col("_joint"))
        frame = self._with(edges, "_before").withColumn("_step", step(point))
        running = F.sum("_step").over(within.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        self.frame = frame.withColumn(out, running + F.coalesce(F.col("_before"), F.lit(0.0))).drop("_step", "_before")
        return self

    def result(self) -> DataFrame:
        return self.frame.drop("_part")


def counted_ranges(rows: DataFrame, range_rows: int = RANGE_ROWS) -> int:
    """How many ranges of ``range_rows`` rows hold all of them."""
    return max(1, -(-rows.count() // range_rows))
