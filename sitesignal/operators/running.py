"""Running sums over an order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesignal.sources.scratch import settle


def running_sums(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Add for each ``column: name`` of ``sums`` the sum of the column up to and with the row.

    Sums run within groups of ``by`` in the given order, which must be unique within a
    group. Rows are dealt by ranges of both; a sum is that of the ranges before and
    that within the range, so a group with most of the rows is spread over tasks.
    Only one row per group and range meets in a window over a group. Both shuffles are
    given their number of tasks, or adaptive execution makes one task of a small table.
    """
    keys = [F.col(c) for c in by]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(df.repartitionByRange(ranges, *keys, *order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_of_{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        *by, "_part", *[F.coalesce(F.sum(f"_of_{c}").over(earlier), F.lit(0)).alias(f"_of_{c}") for c in sums]
    )
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = dealt.repartitionByRange(ranges, "_part").withColumns({name: F.sum(c).over(inside) for c, name in sums.items()})
    starts = starts.withColumnsRenamed({"_part": "_at", **{c: f"_by_{c}" for c in by}})
    joined = within.join(starts, _same(by))
    return joined.select(*df.columns, *[(F.col(name) + F.col(f"_of_{c}")).alias(name) for c, name in sums.items()])


def _same(by: list[str]) -> Column:
    on = F.col("_part") == F.col("_at")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return on
