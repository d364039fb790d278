"""Column expressions: small functions Column -> Column, all built in."""

from sitesignal.functions.expressions import (
    central_kmer,
    is_blank,
    is_drach,
    is_missing_token,
    label_group,
    log_dwell,
    motif_one_hot,
    percent,
    present,
    sequence_one_hot,
    strict_double,
)

__all__ = [
    "central_kmer",
    "is_blank",
    "is_drach",
    "is_missing_token",
    "label_group",
    "log_dwell",
    "motif_one_hot",
    "percent",
    "present",
    "sequence_one_hot",
    "strict_double",
]
