"""The 15 per-read features."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.functions import log_dwell
from sitesignal.schema import FLANKS, READ_FEATURES, SITE_KEYS

SITE_CONTEXT = [*SITE_KEYS, "sequence", "n_reads"]


def read_features(df: DataFrame, keep=SITE_CONTEXT) -> DataFrame:
    """``keep`` plus the 15 per-read features."""
    logs = {p: log_dwell(f"{p}_dwell") for p in ["minus1", "central", "plus1"]}
    named = {f"{p}_log_dwell": c for p, c in logs.items()}
    for f in FLANKS:
        named[f"dwell_contrast_{f}"] = logs["central"] - logs[f]
        for kind in ["sd", "mean"]:
            named[f"{kind}_contrast_{f}"] = F.col(f"central_signal_{kind}") - F.col(
                f"{f}_signal_{kind}"
            )
    return df.select(
        *keep, *[named.get(c, F.col(c)).alias(c) for c in READ_FEATURES]
    )
