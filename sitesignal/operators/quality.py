"""Data-quality checks on the reads table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.functions import central_kmer
from sitesignal.schema import SITE_KEYS, SITE_METADATA

CHECKS = {
    "metadata_conflicts": "Some sites have inconsistent metadata.",
    "duplicate_reads": "Duplicate read keys found.",
    "kmer_mismatches": "Central 5-mer does not match the sequence.",
    "coverage_mismatches": "Stored n_reads does not match the rows of the site.",
}


def _site_checks(reads):
    """Per site: is its metadata constant, mismatches, stored and real coverage.

    Rows are first counted per site and metadata; a site with more than one
    such row has a conflict, whichever column differs, null included.
    """
    metadata = [c for c in SITE_METADATA if c in reads.columns]
    combinations = reads.groupBy(*SITE_KEYS, *metadata).agg(F.count("*").alias("rows"))
    mismatch = ~F.col("central_5mer").eqNullSafe(central_kmer())
    return combinations.groupBy(*SITE_KEYS).agg(
        (F.count("*") > 1).alias("metadata_conflict"),
        F.coalesce(F.sum(F.when(mismatch, F.col("rows"))), F.lit(0)).alias("kmer_mismatches"),
        F.sum("rows").alias("observed_reads"),
        F.min("n_reads").alias("stored_n_reads"),
    )


def metadata_conflicts(reads: DataFrame) -> DataFrame:
    """Keys of sites whose metadata differs between reads; null is a value."""
    return _site_checks(reads).filter("metadata_conflict").select(*SITE_KEYS)


def duplicate_reads(reads: DataFrame) -> DataFrame:
    """(site keys, read_idx) that occur more than once, with their count."""
    return (
        reads.groupBy(*SITE_KEYS, "read_idx")
        .agg(F.count("*").alias("rows"))
        .filter(F.col("rows") > 1)
    )


def kmer_mismatches(reads: DataFrame) -> DataFrame:
    """Reads whose central 5-mer is not the middle of their sequence."""
    return reads.filter(~F.col("central_5mer").eqNullSafe(central_kmer()))


def coverage_mismatches(reads: DataFrame) -> DataFrame:
    """Sites whose stored coverage is not their number of rows."""
    return (
        _site_checks(reads)
        .filter(~F.col("observed_reads").eqNullSafe(F.col("stored_n_reads")))
        .select(*SITE_KEYS, "observed_reads", "stored_n_reads")
    )


def quality_report(reads: DataFrame) -> DataFrame:
    """(check, failed_rows) for all checks: two passes, one per grouping."""
    per_site = _site_checks(reads).agg(
        F.count_if("metadata_conflict").alias("metadata_conflicts"),
        F.coalesce(F.sum("kmer_mismatches"), F.lit(0)).alias("kmer_mismatches"),
        F.count_if(~F.col("observed_reads").eqNullSafe(F.col("stored_n_reads"))).alias(
            "coverage_mismatches"
        ),
    )
    names = ["metadata_conflicts", "kmer_mismatches", "coverage_mismatches"]
    site_rows = per_site.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("check"), F.col(n).alias("failed_rows"))
                    for n in names
                ]
            )
        )
    )
    read_rows = duplicate_reads(reads).agg(
        F.lit("duplicate_reads").alias("check"), F.count("*").alias("failed_rows")
    )
    return site_rows.unionByName(read_rows)


def assert_quality(reads: DataFrame) -> None:
    """Raise ``ValueError`` naming every check that fails."""
    failed = [r["check"] for r in quality_report(reads).collect() if r["failed_rows"]]
    if failed:
        raise ValueError(" ".join(CHECKS[c] for c in CHECKS if c in failed))
