"""Ranking metrics of scores against labels 0 and 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.operators.running import running_sums


def score_counts(df: DataFrame, by=(), label: str = "label", score: str = "score") -> DataFrame:
    """(by, score, positives, negatives): how often each distinct score has either label.

    Rows without a score (null or NaN) or with a label other than 0 and 1 are passed over.
    """
    value = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*by, F.col(label).cast("double").alias("_label"), value.alias("score"))
    rows = rows.filter(F.col("score").isNotNull() & F.col("_label").isin(0.0, 1.0))
    return rows.groupBy(*by, "score").agg(
        F.count_if(F.col("_label") == 1).alias("positives"),
        F.count_if(F.col("_label") == 0).alias("negatives"),
    )


def score_curve(df: DataFrame, by=(), label: str = "label", score: str = "score") -> DataFrame:
    """Counts at every distinct score, taken as the threshold from which rows count as positive.

    Columns: by, score, positives and negatives of that score, and tp and fp, those of
    that score or a higher one. Rows are first counted by score, so equal scores are one
    step; running counts are carried between ranges of scores, so no task
    sorts a whole table or group.
    """
    cells = score_counts(df, by, label, score)
    return running_sums(cells, list(by), [F.desc("score")], {"positives": "tp", "negatives": "fp"})


def roc_curve(df: DataFrame, by=(), label: str = "label", score: str = "score") -> DataFrame:
    """(by, score, tpr, fpr) at every distinct score; a rate of a class without rows is null."""
    by = list(by)
    curve = score_curve(df, by, label, score)
    sides = curve.groupBy(*by).agg(F.max("tp").alias("_p"), F.max("fp").alias("_n"))
    curve = _with_group(curve, sides, by)
    return curve.select(
        *by, "score", F.try_divide("tp", "_p").alias("tpr"), F.try_divide("fp", "_n").alias("fpr")
    )


def precision_recall_curve(df: DataFrame, by=(), label: str = "label", score: str = "score") -> DataFrame:
    """(by, score, precision, recall) at every distinct score; recall is null without a positive."""
    by = list(by)
    curve = score_curve(df, by, label, score)
    curve = _with_group(curve, curve.groupBy(*by).agg(F.max("tp").alias("_p")), by)
    precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    return curve.select(*by, "score", precision.alias("precision"), F.try_divide("tp", "_p").alias("recall"))


def _with_group(curve: DataFrame, sides: DataFrame, by: list[str]) -> DataFrame:
    if not by:
        return curve.join(F.broadcast(sides))  # one row of totals
    sides = sides.withColumnsRenamed({c: f"_of_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return curve.join(sides, on)


def ranking_metrics(df: DataFrame, by=(), label: str = "label", score: str = "score") -> DataFrame:
    """ROC-AUC, average precision and the area under the precision-recall steps, from one pass over the counts.

    Columns: by, rows, positives, negatives, roc_auc and average_precision. ``roc_auc`` is the
    share of pairs of a positive and a negative in which the positive has the higher
    score, ties as half: the rank sum with mean ranks. ``average_precision`` is the sum
    over descending distinct scores of precision times the recall gained. Pairs are
    counted in whole numbers. A table or group of one class has a null roc_auc, one without positives a null
    average_precision; a table without rows gives one row of counts 0 and nulls, or none with ``by``.
    Null keys form a group of their own.
    """
    curve = score_curve(df, by, label, score)
    whole = "decimal(19,0)"
    # Of each positive here: all negatives below, twice, and those of its score once.
    above = F.col("fp").cast(whole)
    pairs = F.sum(F.col("positives").cast(whole) * (2 * above - F.col("negatives").cast(whole)))
    gained = F.col("positives").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp"))
    sums = curve.groupBy(*by).agg(
        F.coalesce(F.sum("positives"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("negatives"), F.lit(0)).alias("negatives"),
        pairs.alias("_lost"),
        F.sum(gained).alias("_gained"),
    )
    possible = 2 * F.col("positives").cast("double") * F.col("negatives").cast("double")
    return sums.select(
        *by,
        (F.col("positives") + F.col("negatives")).alias("rows"),
        "positives",
        "negatives",
        (1 - F.try_divide(F.col("_lost").cast("double"), possible)).alias("roc_auc"),
        F.try_divide(F.col("_gained"), F.col("positives").cast("double")).alias("average_precision"),
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> float | None:
    """The ROC-AUC of a whole table; None for one class or no rows."""
    return ranking_metrics(df, (), label, score).first()["roc_auc"]


def average_precision(df: DataFrame, label: str = "label", score: str = "score") -> float | None:
    """The average precision of a whole table; None without a positive."""
    return ranking_metrics(df, (), label, score).first()["average_precision"]
