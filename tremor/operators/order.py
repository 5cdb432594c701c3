"""Places of rows in an order, without a task that holds all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.storage import written

_ID, _PART, _BEFORE, _FIRST = "_row_id", "_row_part", "_row_before", "_row_first"


class Ordered:
    """Rows dealt into ranges of (by, order) and written, with what lies before each range.

    Ids that Spark gives to the rows of a range rise by one, so a row's place is its id less
    its range's first one of the key, plus the rows of that key in the ranges before: sums over a
    row for each range and key.  No window runs over the rows themselves, and a key that has most
    rows is spread over as many ranges as it needs.
    """

    def __init__(self, df: DataFrame, by: list[str], order: list[str]):
        self.by, self.columns = by, df.columns
        # twice the shuffle's partitions: ranges come from a sample and are not quite equal
        parts = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sorted_ = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
        self.rows = written(sorted_.withColumn(_ID, F.monotonically_increasing_id()), "ordered").withColumn(_PART, F.shiftright(_ID, 33))

    def before(self, **sums: Column) -> DataFrame:
        """A row for each range and key: first id, rows before, and each given sum over the rows before."""
        each = self.rows.groupBy(*self.by, _PART).agg(
            F.min(_ID).alias(_FIRST), F.count(F.lit(1)).alias(_BEFORE), *(F.sum(c).alias(name) for name, c in sums.items())
        )
        ahead = W.partitionBy(*self.by).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
        total = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c)
        return each.select(*self.by, _PART, _FIRST, total(_BEFORE), *(total(name) for name in sums))

    def _with(self, sums: DataFrame, rows: DataFrame) -> DataFrame:
        """rows, each with what sums tells of its range and key; null is a key like others."""
        keys = [*self.by, _PART]
        told = sums.select(*(F.col(c).alias(f"_of_{c}") for c in keys), *(c for c in sums.columns if c not in keys))
        same = F.lit(True)
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        return rows.join(told, same)

    def placed(self, name: str) -> DataFrame:
        """The rows with their place, from 0, among those of their key."""
        place = (F.col(_BEFORE) + F.col(_ID) - F.col(_FIRST)).alias(name)
        return self._with(self.before(), self.rows).select(*self.columns, place)

    def running(self, name: str, **sums: str) -> DataFrame:
        """As `placed`, with the running sums of columns up to and with each row."""
        inside = W.partitionBy(*self.by, _PART).orderBy(_ID).rowsBetween(W.unboundedPreceding, 0)
        ahead = {f"_ahead_{k}": F.col(c) for k, c in sums.items()}
        place = (F.col(_BEFORE) + F.col(_ID) - F.col(_FIRST)).alias(name)
        total = [(F.col(f"_ahead_{k}") + F.sum(c).over(inside)).alias(k) for k, c in sums.items()]
        return self._with(self.before(**ahead), self.rows).select(*self.columns, place, *total)

    def middle(self, value: str) -> DataFrame:
        """The median of the ordered column for each key: the mean of the rows in the middle.

        Counts of the ranges tell which of them hold the middle, at most two a key; only their
        rows are looked at, so no task holds the rows of a key."""
        every = W.partitionBy(*self.by)
        each = self.rows.groupBy(*self.by, _PART).agg(F.min(_ID).alias(_FIRST), F.count(F.lit(1)).alias("_many"))
        before = F.coalesce(F.sum("_many").over(every.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        sums = each.withColumns({_BEFORE: before, "_all": F.sum("_many").over(every)})
        low, high = F.expr("(_all - 1) div 2"), F.expr("_all div 2")
        holds = sums.where((F.col(_BEFORE) <= high) & (F.col(_BEFORE) + F.col("_many") > low)).drop("_many")
        place = F.col(_BEFORE) + F.col(_ID) - F.col(_FIRST)
        rows = self._with(holds, self.rows.select(*self.by, _PART, _ID, value))
        return rows.where(place.between(low, high)).groupBy(*self.by).agg(F.avg(value).alias("median"))
