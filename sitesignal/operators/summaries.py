"""Counts and descriptive statistics of one or more data sets."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.functions import percent, present
from sitesignal.operators.quantiles import counted, described, grouped_quantiles, in_ranges
from sitesignal.operators.sites import labelled, site_table
from sitesignal.schema import SITE_KEYS
from sitesignal.sources.scratch import settle

COVERAGE_PERCENTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
COVERAGE_CUTOFFS = [5, 10, 20]


def dataset_summary(reads: DataFrame) -> DataFrame:
    """One row: reads, sites, transcripts, genes, unlabelled sites and reads."""
    label = present("label")
    # One row per site and metadata by hashing, then one per site.
    distinct = reads.groupBy(*SITE_KEYS, "gene_id", label.alias("label")).agg(
        F.count("*").alias("reads")
    )
    per_site = distinct.groupBy(*SITE_KEYS).agg(
        F.sum("reads").alias("reads"),
        F.sum(F.when(F.col("label").isNull(), F.col("reads"))).alias("unlabelled"),
        F.min("gene_id").alias("gene_id"),
        F.min("label").alias("label"),
    )
    return per_site.agg(
        F.coalesce(F.sum("reads"), F.lit(0)).alias("site_read_observations"),
        F.count("*").alias("sites"),
        F.count_distinct("transcript_id").alias("transcripts"),
        F.count_distinct("gene_id").alias("genes_with_metadata"),
        F.count_if(F.col("label").isNull()).alias("sites_without_labels"),
        F.coalesce(F.sum("unlabelled"), F.lit(0)).alias("read_rows_without_labels"),
    )


def missing_values(df: DataFrame) -> DataFrame:
    """(column, missing), most missing first; NaN counts as missing."""

    def absent(name, kind):
        c = F.col(name)
        return c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull()

    counts = df.agg(*[F.count_if(absent(n, k)).alias(n) for n, k in df.dtypes])
    rows = [
        F.struct(F.lit(n).alias("column"), F.col(n).alias("missing")) for n in df.columns
    ]
    return counts.select(F.inline(F.array(*rows))).orderBy(F.desc("missing"), "column")


def class_balance(sites: DataFrame) -> DataFrame:
    """(label, sites, percentage) for labels 0 and 1; an absent class has 0."""
    counts = sites.agg(
        F.count_if(F.col("label") == 0).alias("zero"),
        F.count_if(F.col("label") == 1).alias("one"),
    )
    total = F.col("zero") + F.col("one")
    rows = [
        F.struct(
            F.lit(float(label)).alias("label"),
            F.col(name).alias("sites"),
            percent(name, total).alias("percentage"),
        )
        for label, name in [(0, "zero"), (1, "one")]
    ]
    return counts.select(F.inline(F.array(*rows)))


def label_distribution(sites: DataFrame) -> DataFrame:
    """(label, sites, percentage) for every distinct label, by label."""
    counts = labelled(sites).groupBy("label").agg(F.count("*").alias("sites"))
    total = labelled(sites).agg(F.count("*")).scalar()
    return counts.select("label", "sites", percent("sites", total).alias("percentage")).orderBy(
        "label"
    )


def label_value_counts(df: DataFrame) -> DataFrame:
    """(label, rows) with the missing label as its own row."""
    return (
        df.groupBy(present("label").alias("label"))
        .agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "label")
    )


def label_examples(df: DataFrame, n: int = 10) -> DataFrame:
    """The first distinct labels."""
    return labelled(df).select("label").distinct().orderBy("label").limit(n)


def column_types(df: DataFrame, columns) -> dict[str, str]:
    """Column name -> Spark type name."""
    return {name: kind for name, kind in df.dtypes if name in columns}


def percentile_name(p: float) -> str:
    return f"p{round(100 * p):02d}"


def describe(df: DataFrame, column: str, percentiles=(0.25, 0.5, 0.75), by=None) -> DataFrame:
    """count, mean, std, min, exact percentiles and max, over all or per group.

    Missing values and, with ``by``, missing groups (null or NaN) are left out.
    ``df`` is evaluated once, to count the values; the rest follows from these.
    """
    keys = [by] if by else ["_group"]
    df = df.select(by if by else F.lit(0).alias("_group"), column)
    cells = in_ranges(counted(df, keys, [column]), keys)
    return described_columns(described(cells, keys, percentiles), [by] if by else [], percentiles)


def described_columns(stats: DataFrame, keys: list[str], percentiles, among=None) -> DataFrame:
    """The columns of ``describe`` from ``quantiles.described``, whose percentiles were ``among``."""
    among = list(percentiles if among is None else among)
    return stats.select(
        *keys,
        "count",
        "mean",
        "std",
        "min",
        *[F.get("_q", F.lit(among.index(p))).alias(percentile_name(p)) for p in percentiles],
        "max",
    )


def coverage_below(sites: DataFrame, cutoffs=COVERAGE_CUTOFFS) -> DataFrame:
    """(condition, sites, percentage) of sites with fewer reads than a cutoff."""
    counts = sites.agg(
        F.count("*").alias("all"),
        *[F.count_if(F.col("n_reads") < c).alias(f"below_{c}") for c in cutoffs],
    )
    rows = [
        F.struct(
            F.lit(f"n_reads < {c}").alias("condition"),
            F.col(f"below_{c}").alias("sites"),
            percent(f"below_{c}", "all").alias("percentage"),
        )
        for c in cutoffs
    ]
    return counts.select(F.inline(F.array(*rows)))


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """(key, n_sites), largest first; rows without the key are left out."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("n_sites"))
        .orderBy(F.desc("n_sites"), key)
    )


def size_histogram(sizes: DataFrame) -> DataFrame:
    """Group size -> number of groups of that size, by size."""
    return (
        sizes.groupBy(F.col("n_sites").alias("group_size"))
        .agg(F.count("*").alias("groups"))
        .orderBy("group_size")
    )


def transcript_labels(labels: DataFrame) -> DataFrame:
    """Per transcript: sites, distinct labels, missing labels.

    Grouped by label first, so a transcript with very many sites reaches its
    own task as one row per label.
    """
    label = present("label")
    return (
        labels.filter(F.col("transcript_id").isNotNull())
        .groupBy("transcript_id", label.alias("label"))
        .agg(F.count("*").alias("n"))
        .groupBy("transcript_id")
        .agg(
            F.sum("n").alias("n_sites"),
            F.count("label").alias("n_distinct_values"),
            F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("n"))), F.lit(0)).alias(
                "n_missing_values"
            ),
        )
    )


def complete_transcripts(per_transcript: DataFrame) -> DataFrame:
    """Transcripts with more than one site and no missing label."""
    return per_transcript.filter(
        (F.col("n_sites") > 1) & (F.col("n_missing_values") == 0)
    )


def constant_label_share(labels: DataFrame) -> DataFrame:
    """One row: complete transcripts and the % of them with a single label."""
    eligible = complete_transcripts(transcript_labels(labels))
    return eligible.agg(
        F.count("*").alias("eligible_transcripts"),
        percent(F.count_if(F.col("n_distinct_values") == 1), F.count("*")).alias(
            "constant_label_pct"
        ),
    )


def overview(datasets: dict[str, DataFrame]) -> DataFrame:
    """One row per data set: sizes, positives, median and range of coverage.

    Each data set is scanned once, to its site table.
    """
    rows = []
    for name, reads in datasets.items():
        sites = settle(site_table(reads, read_rows="_reads"))
        aggregates = [
            F.coalesce(F.sum("_reads"), F.lit(0)).alias("reads"),
            F.count("*").alias("sites"),
            F.count_distinct("transcript_id").alias("transcripts"),
            F.count_distinct("gene_id").alias("genes"),
            F.count_if(F.col("label") == 1).alias("positive_sites"),
            percent(
                F.count_if(F.col("label") == 1), F.count(present("label"))
            ).alias("positive_pct"),
            F.min("n_reads").alias("min_reads"),
            F.max("n_reads").alias("max_reads"),
        ]
        sites = sites.withColumn("_coverage", F.col("n_reads").cast("double"))
        row = grouped_quantiles(sites, [], ["_coverage"], [0.5], aggregates)
        rows.append(
            row.select(
                F.lit(name).alias("dataset"),
                "reads",
                "sites",
                "transcripts",
                "genes",
                "positive_sites",
                "positive_pct",
                F.get(F.col("q__coverage"), F.lit(0)).alias("median_reads"),
                "min_reads",
                "max_reads",
            )
        )
    return reduce(DataFrame.unionByName, rows)
