"""Two data sets: which sites they share and how far their labels agree."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.functions import percent
from sitesignal.operators.frequency import label_column
from sitesignal.operators.sites import site_labels
from sitesignal.schema import SITE_KEYS


def site_pairs(a: DataFrame, b: DataFrame, validate: bool = True) -> DataFrame:
    """All sites of either data set: keys, in_a, in_b, label_a, label_b.

    Both sides are combined to one row per site by a shuffle on the site key;
    the full join then reuses that partitioning.
    """
    left = site_labels(a, validate).select(
        *SITE_KEYS, F.col("label").alias("label_a"), F.lit(True).alias("in_a")
    )
    right = site_labels(b, validate).select(
        *SITE_KEYS, F.col("label").alias("label_b"), F.lit(True).alias("in_b")
    )
    return left.join(right, SITE_KEYS, "full").select(
        *SITE_KEYS,
        F.coalesce("in_a", F.lit(False)).alias("in_a"),
        F.coalesce("in_b", F.lit(False)).alias("in_b"),
        "label_a",
        "label_b",
    )


def shared_sites(pairs: DataFrame) -> DataFrame:
    """Sites in both data sets with both labels."""
    return pairs.filter("in_a AND in_b").select(*SITE_KEYS, "label_a", "label_b")


def comparable_sites(pairs: DataFrame) -> DataFrame:
    """Shared sites that are labelled in both data sets."""
    return shared_sites(pairs).filter("label_a IS NOT NULL AND label_b IS NOT NULL")


def overlap_summary(pairs: DataFrame) -> DataFrame:
    """One row: set sizes, shared and exclusive sites, overlaps in %."""
    a, b = F.count_if("in_a"), F.count_if("in_b")
    shared = F.count_if(F.col("in_a") & F.col("in_b"))

    def share(part, whole):
        return F.round(percent(part, whole), 2)

    return pairs.agg(
        a.alias("sites_a"),
        b.alias("sites_b"),
        shared.alias("shared_sites"),
        (a - shared).alias("only_a"),
        (b - shared).alias("only_b"),
        share(shared, a).alias("a_in_b_pct"),
        share(shared, b).alias("b_in_a_pct"),
        share(shared, a + b - shared).alias("jaccard_pct"),
    )


def agreement_summary(pairs: DataFrame) -> DataFrame:
    """One row: comparable sites, agreement, positives in either and in both."""
    both = F.col("label_a").isNotNull() & F.col("label_b").isNotNull()
    equal = F.col("label_a") == F.col("label_b")
    comparable, matching = F.count_if(both), F.count_if(both & equal)
    one = [F.col("label_a") == 1, F.col("label_b") == 1]
    return shared_sites(pairs).agg(
        comparable.alias("comparable_sites"),
        (F.count("*") - comparable).alias("missing_either_label"),
        matching.alias("matching_labels"),
        (comparable - matching).alias("disagreeing_labels"),
        F.round(percent(matching, comparable), 2).alias("agreement_pct"),
        F.count_if(both & (one[0] | one[1])).alias("positive_in_either"),
        F.count_if(both & one[0] & one[1]).alias("positive_in_both"),
    )


def label_crosstab(pairs: DataFrame, labels=(0, 1)) -> DataFrame:
    """Label in A (rows) by label in B (columns); absent pairs are 0."""
    comparable = comparable_sites(pairs)
    counts = comparable.agg(
        *[
            F.count_if((F.col("label_a") == x) & (F.col("label_b") == y)).alias(f"{i}_{j}")
            for i, x in enumerate(labels)
            for j, y in enumerate(labels)
        ]
    )
    rows = [
        F.struct(
            F.lit(float(x)).alias("label_a"),
            *[F.col(f"{i}_{j}").alias(label_column(y)) for j, y in enumerate(labels)],
        )
        for i, x in enumerate(labels)
    ]
    return counts.select(F.inline(F.array(*rows)))


def disagreements(pairs: DataFrame, n: int | None = 10) -> DataFrame:
    """Comparable sites whose labels differ, by key; the first ``n`` or all."""
    rows = (
        comparable_sites(pairs)
        .filter(F.col("label_a") != F.col("label_b"))
        .orderBy(*SITE_KEYS)
    )
    return rows if n is None else rows.limit(n)
