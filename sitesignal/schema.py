"""Column names and table schemas shared by every part of the library.

A *site* is one (transcript_id, transcript_position) pair; a *read* is one
row of nine signal measurements at a site.
"""

from pyspark.sql import types as T

SITE_KEYS = ["transcript_id", "transcript_position"]
SITE_METADATA = ["sequence", "central_5mer", "n_reads", "gene_id", "label"]

# The nine measurements in the order of the signal source.
SIGNALS = [
    "minus1_dwell",
    "minus1_signal_sd",
    "minus1_signal_mean",
    "central_dwell",
    "central_signal_sd",
    "central_signal_mean",
    "plus1_dwell",
    "plus1_signal_sd",
    "plus1_signal_mean",
]
CENTRAL_SIGNALS = [c for c in SIGNALS if c.startswith("central_")]

# The 7-mer window, its central 5-mer and the expected motif.
BASES = ["A", "C", "G", "T"]
SEQUENCE_LENGTH = 7
SEQUENCE_PATTERN = r"\A[ACGT]{7}\z"
DRACH_PATTERN = r"\A[AGT][AG]AC[ACT]\z"
DRACH_MOTIFS = [d + r + "AC" + h for d in "AGT" for r in "AG" for h in "ACT"]

READ_FIELDS = [
    T.StructField("transcript_id", T.StringType()),
    T.StructField("transcript_position", T.LongType()),
    T.StructField("sequence", T.StringType()),
    T.StructField("central_5mer", T.StringType()),
    T.StructField("n_reads", T.LongType()),
    T.StructField("read_idx", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in SIGNALS],
]
LABEL_FIELDS = [
    T.StructField("gene_id", T.StringType()),
    T.StructField("transcript_id", T.StringType()),
    T.StructField("transcript_position", T.LongType()),
    T.StructField("label", T.DoubleType()),
]
READS_SCHEMA = T.StructType(READ_FIELDS)
LABELLED_READS_SCHEMA = T.StructType(
    [*READ_FIELDS, *[f for f in LABEL_FIELDS if f.name in ("gene_id", "label")]]
)
LABELS_SCHEMA = T.StructType(LABEL_FIELDS)

# transcript -> position -> 7-mer -> reads x 9
SIGNAL_JSON = "map<string,map<string,map<string,array<array<double>>>>>"

# Fixed values, as are all column names and their order from here on.
# Per-read features: three log dwells, six signals as they are, six
# centre-to-flank contrasts.
FLANKS = ["minus1", "plus1"]
READ_FEATURES = [
    "minus1_log_dwell",
    "central_log_dwell",
    "plus1_log_dwell",
    "minus1_signal_sd",
    "central_signal_sd",
    "plus1_signal_sd",
    "minus1_signal_mean",
    "central_signal_mean",
    "plus1_signal_mean",
    "dwell_contrast_minus1",
    "dwell_contrast_plus1",
    "sd_contrast_minus1",
    "sd_contrast_plus1",
    "mean_contrast_minus1",
    "mean_contrast_plus1",
]
BASELINE_FEATURES = ["central_log_dwell", "central_signal_sd", "central_signal_mean"]
RESIDUAL_FEATURES = [f"{c}_kmer_resid" for c in BASELINE_FEATURES]
GLOBAL_MOTIF = "__global__"

STATISTICS = ["mean", "sd", "min", "max", "p25", "median", "p75"]
QUANTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def statistic_columns(features):
    """Names of the per-site statistics of ``features``, feature by feature."""
    return [f"{feature}_{stat}" for feature in features for stat in STATISTICS]


SEQUENCE_COLUMNS = [f"seq_pos{p}_{b}" for p in range(SEQUENCE_LENGTH) for b in BASES]
MOTIF_COLUMNS = [f"motif_{m}" for m in [*DRACH_MOTIFS, "other"]]
AGG_COLUMNS = statistic_columns(READ_FEATURES)
RESIDUAL_AGG_COLUMNS = statistic_columns(RESIDUAL_FEATURES)

FEATURE_COLUMNS = ["n_reads", *AGG_COLUMNS, *SEQUENCE_COLUMNS, *MOTIF_COLUMNS]
FEATURE_COLUMNS_WITH_RESIDUALS = [*FEATURE_COLUMNS, *RESIDUAL_AGG_COLUMNS]

FEATURE_INPUT = [*SITE_KEYS, "sequence", "n_reads", *SIGNALS]


def require_columns(df, required):
    """Raise ``ValueError`` unless ``df`` has every column in ``required``."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(
            f"Missing required columns: {missing}. Found: {df.columns}"
        )
