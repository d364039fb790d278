"""The tables behind histograms and box plots."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.functions import label_group, present, strict_double
from sitesignal.operators.quantiles import counted, in_ranges, ranked
from sitesignal.operators.sites import labelled
from sitesignal.schema import CENTRAL_SIGNALS

WHISKER = 1.5
BOX_COLUMNS = ["feature", "label", "n", "low_whisker", "q1", "median", "q3", "high_whisker"]


def _edge(i, bins, lo, hi):
    """Lower edge of bin ``i``; edge number ``bins`` is exactly ``hi``."""
    step = (hi - lo) / F.lit(float(bins))
    return F.when(i == bins, hi).otherwise(lo + i * step)


def _bin(x, bins, lo, hi):
    """Bin of ``x``: lower edge included, upper edge only in the last bin.

    The quotient can miss by one next to an edge, so it is set right by
    comparing with the edges themselves.
    """
    guess = F.least(
        F.greatest(F.floor((x - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1)
    )
    down = F.when(x < _edge(guess, bins, lo, hi), 1).otherwise(0)
    up = F.when(
        (guess < bins - 1) & (x >= _edge(guess + 1, bins, lo, hi)), 1
    ).otherwise(0)
    return (guess - down + up).cast("int")


def _widened(lo, hi):
    """Struct (lo, hi), half a unit wider on each side if both are equal."""
    return F.struct(
        F.when(lo == hi, lo - 0.5).otherwise(lo).alias("lo"),
        F.when(lo == hi, hi + 0.5).otherwise(hi).alias("hi"),
    )


def histogram(
    df: DataFrame, column: str, bins: int, lo=None, hi=None, log: bool = False
) -> DataFrame:
    """(bin, lower, upper, count) with every bin present.

    Equal bins between ``lo`` and ``hi``, or between the smallest and largest
    value; with ``log`` of log10(value), for positive values.  Values outside
    are not counted.
    """
    x = present(column)
    x = F.when(x > 0, F.log10(x)) if log else x
    values = df.select(x.alias("_x")).filter(F.abs("_x") < F.lit(float("inf")))
    if lo is None or hi is None:
        limits = values.agg(_widened(F.min("_x"), F.max("_x"))).scalar()
    else:
        limits = F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
    low, high = F.col("_b.lo"), F.col("_b.hi")
    counts = (
        values.withColumn("_b", limits)
        .filter(F.col("_x").between(low, high))
        .groupBy(_bin(F.col("_x"), bins, low, high).alias("bin"))
        .agg(F.count("*").alias("count"))
    )
    return (
        df.sparkSession.range(bins)
        .select(F.col("id").cast("int").alias("bin"), limits.alias("_b"))
        .join(counts, "bin", "left")
        .select(
            "bin",
            _edge(F.col("bin"), bins, low, high).alias("lower"),
            _edge(F.col("bin") + 1, bins, low, high).alias("upper"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
    )


def density_by_label(
    reads: DataFrame, columns=CENTRAL_SIGNALS, bins: int = 40
) -> DataFrame:
    """(feature, label, bin, lower, upper, count, density).

    Labels share the bins of a feature; each label's density integrates to 1.
    Two passes over the reads, whatever the number of columns: one for the
    bounds, one for the counts.
    """
    rows = labelled(reads).select(
        strict_double("label").alias("label"), *[present(strict_double(c)).alias(c) for c in columns]
    )
    values = rows.select(
        "label",
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("_x")) for c in columns])
        ),
    ).filter(F.abs("_x") < F.lit(float("inf")))
    finite = {c: F.when(F.abs(c) < F.lit(float("inf")), F.col(c)) for c in columns}
    limits = rows.agg(
        F.create_map(
            *[
                part
                for c, x in finite.items()
                for part in (F.lit(c), _widened(F.min(x), F.max(x)))
            ]
        )
    ).scalar()
    low, high = F.col("_b.lo"), F.col("_b.hi")
    counts = (
        values.withColumn("_b", F.try_element_at(limits, F.col("feature")))
        .groupBy("feature", "label", _bin(F.col("_x"), bins, low, high).alias("bin"))
        .agg(F.count("*").alias("count"))
    )
    # At most columns * labels * bins rows from here on.
    groups = counts.groupBy("feature", "label").agg(F.sum("count").alias("_n"))
    every_bin = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    filled = F.coalesce("count", F.lit(0))
    return (
        groups.select("feature", "label", "_n", every_bin)
        .join(counts, ["feature", "label", "bin"], "left")
        .withColumn("_b", F.try_element_at(limits, F.col("feature")))
        .select(
            "feature",
            "label",
            "bin",
            _edge(F.col("bin"), bins, low, high).alias("lower"),
            _edge(F.col("bin") + 1, bins, low, high).alias("upper"),
            filled.alias("count"),
            (filled / (F.col("_n") * ((high - low) / bins))).alias("density"),
        )
    )


def excluded_rows(reads: DataFrame, columns=CENTRAL_SIGNALS) -> DataFrame:
    """(feature, excluded): rows without a label or without a finite value."""
    counts = reads.agg(
        *[
            F.count_if(
                ~F.coalesce(
                    present("label").isNotNull() & (F.abs(present(c)) < F.lit(float("inf"))),
                    F.lit(False),
                )
            ).alias(c)
            for c in columns
        ]
    )
    rows = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("excluded")) for c in columns]
    return counts.select(F.inline(F.array(*rows)))


def box_stats(df: DataFrame, columns=CENTRAL_SIGNALS, labels=(0, 1)) -> DataFrame:
    """(feature, label, n, low_whisker, q1, median, q3, high_whisker).

    ``df`` holds labelled reads or site means.  Whiskers reach the furthest
    value within 1.5 times the interquartile range; values beyond are outliers
    and not listed.  ``labels=None`` takes every label in use, however many.
    Columns that are no numbers fail.  ``df`` is scanned once, to count values.
    """
    cells = in_ranges(counted(box_rows(df, columns, labels), ["label"], list(columns)), ["label"])
    quartiles = ranked(cells, ["label"], [0.25, 0.5, 0.75])
    return boxes(cells, quartiles, ["label"], [0, 1, 2]).withColumnRenamed("_column", "feature").select(*BOX_COLUMNS)


def box_rows(df: DataFrame, columns=CENTRAL_SIGNALS, labels=(0, 1)) -> DataFrame:
    """(label, columns) of the rows that count for a box plot; values that are not finite are null."""
    finite = [F.when(F.abs(present(strict_double(c))) < F.lit(float("inf")), strict_double(c)).alias(c) for c in columns]
    rows = df.select(strict_double("label").alias("label"), *finite)
    return rows if labels is None else rows.filter(F.col("label").isin([float(v) for v in labels]))


def boxes(cells: DataFrame, stats: DataFrame, keys: list[str], at: list[int]) -> DataFrame:
    """Box statistics of each series of ``cells``; its quartiles are at places ``at`` of ``_q`` in ``stats``."""
    series, quartiles = [*keys, "_column"], ["q1", "median", "q3"]
    stats = stats.select(*series, *[F.get("_q", F.lit(i)).alias(q) for i, q in zip(at, quartiles)])
    span = (F.col("q3") - F.col("q1")) * WHISKER
    return (
        cells.join(stats, series)
        .groupBy(*series, *quartiles)
        .agg(
            F.sum("_n").alias("n"),
            F.min(F.when(F.col("_value") >= F.col("q1") - span, F.col("_value"))).alias("_low"),
            F.max(F.when(F.col("_value") <= F.col("q3") + span, F.col("_value"))).alias("_high"),
        )
        .select(
            *series,
            "n",
            F.least("_low", "q1").alias("low_whisker"),
            *quartiles,
            F.greatest("_high", "q3").alias("high_whisker"),
        )
    )


def plot_groups(df: DataFrame, columns=CENTRAL_SIGNALS) -> DataFrame:
    """(site_label "0"/"1", values) of the rows a box plot by label uses."""
    return labelled(df).filter(F.col("label").isin(0, 1)).select(
        label_group().alias("site_label"), *columns
    )
