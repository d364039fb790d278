"""Exact quantiles per group, by one plan for groups of any size.

Values are only ever counted: one scan counts each (group, column, value) with
map-side combine.  The counts are dealt by ranges of (group, column, value), so
that a group with a third of all rows, or a whole table as one group, is spread
over tasks like any other; ranks follow from running sums within a range and
the sums of the ranges before it.  Nothing is sampled, no group is gathered,
and there is one formula for all.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesignal.sources.scratch import settle


def given_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are neither null nor NaN; these form no group."""
    kinds = dict(df.dtypes)
    for k in keys:
        given = F.col(k).isNotNull()
        if kinds[k] in ("double", "float"):
            given = given & ~F.isnan(k)
        df = df.filter(given)
    return df


def counted(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, _column, _value, _n): how often each value of each column occurs.

    Null and NaN values are skipped, and so are rows without a key.
    ``_column`` is the name of the column.
    """
    value = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("_column"), v.alias("_value"))
            for c, v in zip(columns, value)
        ]
    )
    rows = given_keys(df, keys).select(*keys, F.inline(pairs))
    return (
        rows.filter(F.col("_value").isNotNull())
        .groupBy(*keys, "_column", "_value")
        .agg(F.count("*").alias("_n"))
    )


def in_ranges(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The cells, dealt by ranges of (keys, column, value); ``_part`` numbers the ranges.

    Any grouping of the cells whose values rise with the ranges can be ranked: that by
    ``keys``, and without ``keys`` one by any further columns.
    """
    dealt = cells.repartitionByRange(*keys, "_column", "_value")
    return settle(dealt.withColumn("_part", F.spark_partition_id()))


def ranked(cells: DataFrame, keys: list[str], probs) -> DataFrame:
    """(keys, _column, _q): linear quantiles, in the order of ``probs``.

    ``cells`` comes from ``in_ranges``.  Between two neighbours a and b the
    quantile is ``(1 - f) * a + f * b``, so minus infinity stays what it is.
    """
    series = [*keys, "_column"]
    sizes = cells.groupBy(*series, "_part").agg(F.sum("_n").alias("_size"))
    by_part = Window.partitionBy(*series).orderBy("_part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    # A few rows per series and range: where each range starts, and which of
    # the wanted ranks lie in it.
    sizes = sizes.select(
        *series,
        "_part",
        "_size",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
        F.sum("_size").over(Window.partitionBy(*series)).alias("_total"),
    )
    position = [(F.col("_total") - 1) * F.lit(float(p)) for p in probs]
    ranks = []
    for i, at in enumerate(position):
        whole = F.floor(at)
        for upper in (0, 1):
            rank = F.least(whole + upper, F.col("_total") - 1)
            ranks.append(
                F.struct(
                    F.lit(i).alias("i"),
                    F.lit(upper).alias("upper"),
                    (at - whole).alias("f"),
                    rank.alias("rank"),
                )
            )
    wanted = F.filter(
        F.array(*ranks),
        lambda r: (r.rank >= F.col("_start")) & (r.rank < F.col("_start") + F.col("_size")),
    )
    sizes = sizes.withColumn("_wanted", wanted).filter(F.size("_wanted") > 0)
    sizes = sizes.select(*series, "_part", "_start", "_wanted")

    inside = Window.partitionBy(*series, "_part").orderBy("_value")
    running = F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    found = (
        cells.join(sizes, [*series, "_part"])
        .withColumn("_end", F.col("_start") + running)
        .withColumn(
            "_wanted",
            F.filter(
                "_wanted",
                lambda r: (r.rank < F.col("_end")) & (r.rank >= F.col("_end") - F.col("_n")),
            ),
        )
        .select(*series, "_value", F.inline("_wanted"))
    )
    picked = []
    for i in range(len(probs)):
        low, high, f = (
            F.max(F.when((F.col("i") == i) & (F.col("upper") == u), x))
            for u, x in ((0, F.col("_value")), (1, F.col("_value")), (0, F.col("f")))
        )
        picked.append(F.when(f > 0, (1 - f) * low + f * high).otherwise(low))
    return found.groupBy(*series).agg(F.array(*picked).alias("_q"))


def described(cells: DataFrame, keys: list[str], percentiles) -> DataFrame:
    """(keys, _column, count, mean, std, min, max, _q) of each series of ``cells`` from ``in_ranges``."""
    series = [*keys, "_column"]
    value, n = F.col("_value"), F.col("_n")
    moments = cells.groupBy(*series).agg(
        F.sum("_n").alias("count"),
        (F.sum(value * n) / F.sum("_n")).alias("mean"),
        F.min("_value").alias("min"),
        F.max("_value").alias("max"),
    )
    apart = (value - F.col("mean")) * (value - F.col("mean")) * n
    spread = (
        cells.join(moments.select(*series, "count", "mean"), series)
        .groupBy(*series, "count")
        .agg(F.sqrt(F.try_divide(F.sum(apart), F.col("count") - 1)).alias("std"))
        .drop("count")
    )
    return moments.join(spread, series).join(ranked(cells, keys, percentiles), series)


def side_by_side(long: DataFrame, keys: list[str], columns: list[str], values) -> DataFrame:
    """One row per group from one per group and column; (name, column) pairs in ``values``."""
    return long.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_column") == c, F.col(value))).alias(f"{name}{c}")
            for c in columns
            for name, value in values
        ]
    )


def grouped_quantiles(
    df: DataFrame, keys: list[str], columns: list[str], probs, aggregates=()
) -> DataFrame:
    """``aggregates`` and exact linear quantiles of ``columns`` per group.

    Adds one array column ``q_<column>`` per column, in the order of
    ``probs``, null for a group without a value.  Null and NaN values are
    skipped; rows without a key belong to no group.  Without ``keys`` the
    whole table is one group.
    """
    whole = not keys
    if whole:
        keys = ["_group"]
        df = df.withColumn("_group", F.lit(0))
    cells = in_ranges(counted(df, keys, columns), keys)
    long = ranked(cells, keys, probs)
    result = side_by_side(long, keys, columns, [("q_", "_q")])
    if aggregates:
        stats = given_keys(df, keys).groupBy(*keys).agg(*aggregates)
        result = stats.join(result, keys, "left")
    return result.drop("_group") if whole else result
