"""How often sequences and motifs occur, by label."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.functions import percent
from sitesignal.operators.sites import labelled

# A table of k-mers by label has at most this many labels.
MAX_LABELS = 10


def label_column(label) -> str:
    """0 -> label_0, 0.25 -> label_0_25; different labels have different names."""
    text = repr(float(label)).removesuffix(".0")
    return "label_" + text.replace(".", "_")


def distinct_labels(sites: DataFrame, limit: int | None = None) -> list[float]:
    """The labels in use; none at all or more than ``limit`` is an error."""
    rows = labelled(sites).select("label").distinct()
    rows = (rows if limit is None else rows.limit(limit + 1)).collect()
    if not rows:
        raise ValueError("No annotated sites available.")
    if limit is not None and len(rows) > limit:
        raise ValueError(f"More than {limit} annotation values.")
    return sorted(r["label"] for r in rows)


def crosstab(sites: DataFrame, key: str, labels=(0, 1)) -> DataFrame:
    """Sites per value of ``key`` and label, 0 where there are none.

    ``labels=None`` looks the labels up first: one column for each in use.
    """
    labels = distinct_labels(sites) if labels is None else labels
    return (
        labelled(sites)
        .filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[F.count_if(F.col("label") == v).alias(label_column(v)) for v in labels])
    )


def column_percentages(counts: DataFrame) -> DataFrame:
    """Each label column as % of its sum over all rows; null if that is 0."""
    key, *columns = counts.columns
    totals = counts.agg(F.struct(*[F.sum(c).alias(c) for c in columns])).scalar()
    return counts.select(key, *[percent(c, totals.getField(c)).alias(c) for c in columns])


def top_keys(counts: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` rows with the largest total over the label columns."""
    key, *columns = counts.columns
    return counts.orderBy(_total(columns).desc(), key).limit(n)


def _total(columns):
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return total


def kmer_by_label(sites: DataFrame, column: str, top_n: int | None = None) -> DataFrame:
    """% of each label's sites per k-mer, for any label set.

    The percentages refer to all sites of the label, also with ``top_n``.  More
    than MAX_LABELS labels are an error.
    """
    counts = crosstab(sites, column, distinct_labels(sites, MAX_LABELS))
    key, *columns = counts.columns
    totals = counts.agg(F.struct(*[F.sum(c).alias(c) for c in columns])).scalar()
    if top_n is not None:
        chosen = top_keys(counts, top_n)
    else:
        chosen = counts
    return chosen.select(key, *[percent(c, totals.getField(c)).alias(c) for c in columns])


def motif_summary(sites: DataFrame) -> DataFrame:
    """Unmodified, modified and total sites and positive fraction per motif.

    Only the labels 0 and 1 count; a motif with other labels alone has total 0
    and no fraction.
    """
    counts = crosstab(sites, "central_5mer").select(
        "central_5mer",
        F.col("label_0").alias("unmodified_sites"),
        F.col("label_1").alias("modified_sites"),
    )
    total = F.col("unmodified_sites") + F.col("modified_sites")
    return (
        counts.withColumn("total_sites", total)
        .withColumn(
            "positive_fraction",
            F.try_divide(F.col("modified_sites").cast("double"), F.col("total_sites")),
        )
        .orderBy(F.desc("total_sites"), "central_5mer")
    )


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """(value, rows), most frequent first; all values or the first ``n``."""
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), column)
    )
    return counts if n is None else counts.limit(n)
