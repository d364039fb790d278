"""Predictions: one score for every site, written together with the report of their check."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesignal.schema import SITE_KEYS
from sitesignal.sources.storage import Storage

SCHEMA = "transcript_id string, transcript_position bigint, score double"
COLUMNS = [*SITE_KEYS, "score"]
CHECKS = ["missing_sites", "unknown_sites", "repeated_sites", "bad_scores", "null_keys"]
REPORT = "_report.json"  # readers pass over names with an underscore


def prediction_counts(predictions: DataFrame, sites: DataFrame) -> DataFrame:
    """One row: the sites, the predictions, and the failures of each check.

    Keys of both sides meet in one grouping: sites without a prediction,
    predictions without a site, sites predicted more than once; and predictions
    whose score is missing, NaN or outside 0 to 1 or whose key is null, which are
    counted as rows. Sites are distinct keys, however often the table has them.
    """
    fine = F.coalesce(F.col("score").cast("double").between(0.0, 1.0), F.lit(False))
    both = predictions.select(*SITE_KEYS, F.lit(1).alias("_given"), (~fine).cast("int").alias("_bad"), F.lit(0).alias("_wanted"))
    both = both.unionByName(
        sites.select(*SITE_KEYS, F.lit(0).alias("_given"), F.lit(0).alias("_bad"), F.lit(1).alias("_wanted"))
    )
    per_key = both.groupBy(*SITE_KEYS).agg(
        F.sum("_given").alias("given"), F.sum("_bad").alias("bad"), F.max("_wanted").alias("wanted")
    )
    null = F.col(SITE_KEYS[0]).isNull() | F.col(SITE_KEYS[1]).isNull()
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per_key.agg(
        F.count_if(~null & (F.col("wanted") == 1)).alias("sites"),
        count("given").alias("predictions"),
        F.count_if(~null & (F.col("wanted") == 1) & (F.col("given") == 0)).alias("missing_sites"),
        F.count_if(~null & (F.col("wanted") == 0)).alias("unknown_sites"),
        F.count_if(~null & (F.col("given") > 1)).alias("repeated_sites"),
        count("bad").alias("bad_scores"),
        count(F.when(null, F.col("given"))).alias("null_keys"),
    )


def prediction_report(predictions: DataFrame, sites: DataFrame) -> DataFrame:
    """(check, failed_rows) of ``prediction_counts``."""
    counts = prediction_counts(predictions, sites)
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("failed_rows")) for c in CHECKS])))


def write_predictions(predictions: DataFrame, sites: DataFrame, path) -> dict:
    """Write ``transcript_id,transcript_position,score`` as CSV with a header; return the counts of the check.

    The rows are staged next to ``path``, and the staged rows are checked: every site of ``sites``
    has exactly one, no other key occurs, scores lie within 0 and 1. A failed
    check raises ``ValueError`` and leaves nothing at ``path``. Data and report (``_report.json`` inside)
    appear together by one rename of the folder, so there is never one without the
    other. An existing path is never overwritten. What a killed driver leaves behind has a name of its own
    and blocks no later run.
    """
    spark = predictions.sparkSession
    storage, path = Storage(spark), str(path).rstrip("/")
    if storage.exists(path):
        raise FileExistsError(f"{path} already exists, choose a new output.")
    staged = f"{path}.partial-{uuid.uuid4().hex}"
    rows = predictions.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in SCHEMA.split(", ")])
    try:
        rows.write.csv(staged, header=True, nullValue="")
        counts = prediction_counts(read_predictions(spark, staged), sites).first().asDict()
        failed = {c: counts[c] for c in CHECKS if counts[c]}
        if failed:
            raise ValueError("Predictions were refused: " + ", ".join(f"{n} {c}" for c, n in failed.items()))
        storage.write_text(f"{staged}/{REPORT}", json.dumps(counts, indent=2))
        storage.rename(staged, path)
    except BaseException:
        storage.delete(staged)
        raise
    return counts


def read_predictions(spark: SparkSession, path) -> DataFrame:
    """The predictions at ``path``; a field that is no number becomes null."""
    return spark.read.csv(str(path), schema=SCHEMA, header=True, nullValue="", mode="PERMISSIVE")


def read_report(spark: SparkSession, path) -> dict:
    """The report that was written with the predictions."""
    return json.loads(Storage(spark).read_text(f"{str(path).rstrip('/')}/{REPORT}"))
