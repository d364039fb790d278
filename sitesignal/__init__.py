"""Per-site analytics on nanopore direct-RNA signal data, on Spark."""

from sitesignal.operators.baselines import fit_kmer_baselines
from sitesignal.operators.features import build_features
from sitesignal.operators.metrics import average_precision, ranking_metrics, roc_auc
from sitesignal.operators.quality import assert_quality, quality_report
from sitesignal.operators.sites import site_labels, site_means, site_table
from sitesignal.operators.splits import balanced_split, leakage_safe_split, linked_groups
from sitesignal.plans.ingest import ingest
from sitesignal.plans.profile import compare, profile
from sitesignal.schema import FEATURE_COLUMNS, FEATURE_COLUMNS_WITH_RESIDUALS, SITE_KEYS
from sitesignal.sources.labels import read_labels
from sitesignal.sources.predictions import read_predictions, write_predictions
from sitesignal.sources.reads import read_reads, write_reads

__all__ = [
    "FEATURE_COLUMNS",
    "FEATURE_COLUMNS_WITH_RESIDUALS",
    "SITE_KEYS",
    "assert_quality",
    "average_precision",
    "balanced_split",
    "build_features",
    "compare",
    "fit_kmer_baselines",
    "ingest",
    "leakage_safe_split",
    "linked_groups",
    "profile",
    "quality_report",
    "ranking_metrics",
    "read_labels",
    "read_predictions",
    "read_reads",
    "roc_auc",
    "site_labels",
    "site_means",
    "site_table",
    "write_predictions",
    "write_reads",
]
