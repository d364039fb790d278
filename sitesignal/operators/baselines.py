"""Typical central signal per motif, fitted on training reads only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.functions import central_kmer
from sitesignal.operators.quantiles import counted, in_ranges, ranked, side_by_side
from sitesignal.operators.read_features import read_features
from sitesignal.schema import (
    BASELINE_FEATURES,
    FEATURE_INPUT,
    GLOBAL_MOTIF,
    require_columns,
)

# Validated reads have no other motif; there are 4**5 of them.
KNOWN_MOTIF = r"\A[ACGT]{5}\z"


def fit_kmer_baselines(df: DataFrame, features=BASELINE_FEATURES) -> DataFrame:
    """Exact median of each feature per central 5-mer, and over all reads.

    Columns ``central_5mer`` and ``features``; the row ``__global__`` is the
    fallback for motifs that are not in the table.  The reads are scanned once:
    the counts of all reads are sums of those of the motifs.
    """
    require_columns(df, FEATURE_INPUT)
    features = list(features)
    reads = read_features(df, keep=["sequence"]).select(
        central_kmer().alias("central_5mer"), *features
    )
    # Dealt by (column, value) alone, the same ranges rank every motif and the whole.
    cells = in_ranges(counted(reads, ["central_5mer"], features), [])
    overall = cells.groupBy("_part", "_column", "_value").agg(F.sum("_n").alias("_n"))
    overall = ranked(overall.withColumn("central_5mer", F.lit(GLOBAL_MOTIF)), ["central_5mer"], [0.5])
    medians = ranked(cells, ["central_5mer"], [0.5]).unionByName(overall)
    medians = medians.withColumn("_q", F.get("_q", F.lit(0)))
    return side_by_side(medians, ["central_5mer"], features, [("", "_q")])


def add_residuals(reads: DataFrame, kmer_baselines: DataFrame) -> DataFrame:
    """Add ``<feature>_kmer_resid``: the value less its motif's baseline.

    A motif without a baseline (or without a value in it) uses the global
    row.  Of the table only motifs over A/C/G/T and the global row are used,
    so at most 1,025 different rows are looked up.
    """
    require_columns(kmer_baselines, ["central_5mer", *BASELINE_FEATURES])
    wanted = kmer_baselines.select("central_5mer", *BASELINE_FEATURES)
    usable = F.col("central_5mer").rlike(KNOWN_MOTIF) | (F.col("central_5mer") == GLOBAL_MOTIF)
    # One row more than there are motifs shows that one of them is repeated.
    rows = wanted.filter(usable).limit(4**5 + 2).collect()
    if len({r["central_5mer"] for r in rows}) < len(rows):
        raise ValueError("A motif occurs twice in the baseline table.")
    overall = [r for r in rows if r["central_5mer"] == GLOBAL_MOTIF]
    if not overall:
        raise ValueError(f"The baseline table has no {GLOBAL_MOTIF} row.")
    table = reads.sparkSession.createDataFrame(rows, wanted.schema).select(
        F.col("central_5mer").alias("_motif"),
        *[F.col(c).alias(f"_{c}") for c in BASELINE_FEATURES],
    )
    joined = reads.join(
        F.broadcast(table), central_kmer() == F.col("_motif"), "left"
    )
    residuals = [
        (
            F.col(c)
            - F.coalesce(
                F.nanvl(F.col(f"_{c}"), F.lit(None).cast("double")),
                F.lit(overall[0][c]).cast("double"),
            )
        ).alias(f"{c}_kmer_resid")
        for c in BASELINE_FEATURES
    ]
    return joined.select(*reads.columns, *residuals)
