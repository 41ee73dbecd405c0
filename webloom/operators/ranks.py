"""Places and running sums over a whole order, without a task that has all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.shared import written

#: monotonically_increasing_id() has the partition above these bits and the row's number in it below.
ROW_BITS = 33


def ranked(rows: DataFrame, order: list[Column], place: str = "place", sums: dict[str, Column] | None = None) -> DataFrame:
    """rows with their place (from 1) in the order of columns, and sums up to and with each row.

    Rows are dealt into ranges of the order by Spark's own range partitioning, sorted in each range, numbered there and written
    to the shared folder, so that ranges and counts are the same for all that reads them. A range begins after the rows of those
    before it: their counts are one row a range, of which there are no more than shuffle partitions. Rows that are equal in all of order
    are in one range; give a last column that tells them apart where many may be equal.
    """
    sums = sums or {}
    keys = {f"_k{i}": c for i, c in enumerate(order)}
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = rows.withColumns(keys | {f"_{k}": v for k, v in sums.items()})
    dealt = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(*keys)
    dealt = written(dealt.withColumn("_id", F.monotonically_increasing_id()), "ranked").withColumn("_range", F.shiftright("_id", ROW_BITS))
    totals = dealt.groupBy(F.col("_range").alias("_of")).agg(F.count("*").alias("_n"), *(F.sum(f"_{k}").alias(f"_all_{k}") for k in sums))
    earlier = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_of", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before{c}") for c in totals.columns[1:]))
    upto = Window.partitionBy("_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.withColumns({f"_sum_{k}": F.sum(f"_{k}").over(upto) for k in sums}).join(F.broadcast(starts), F.col("_range") == F.col("_of"))
    local = F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    made = {place: F.col("_before_n") + local + 1} | {k: F.col(f"_before_all_{k}") + F.col(f"_sum_{k}") for k in sums}
    return joined.select(*(F.col(c) for c in rows.columns), *(v.alias(k) for k, v in made.items()))
