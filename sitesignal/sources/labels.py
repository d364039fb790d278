"""Label CSV: one row per site, label in [0, 1], gene id optional."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesignal.functions import is_blank, is_missing_token
from sitesignal.schema import LABELS_SCHEMA, SITE_KEYS, require_columns


# Spark also reads ``0.5f`` and ``0.5d`` as numbers.
NUMBER = (
    r"\A(?i)\s*[+-]?((\d+[.]?\d*|[.]\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*\z"
)


def as_number(c):
    """A text as a double, null if it is no plain number."""
    return F.when(F.col(c).rlike(NUMBER), F.col(c).try_cast("double"))


def read_labels(spark: SparkSession, path, validate: bool = True) -> DataFrame:
    """Labels as (gene_id, transcript_id, transcript_position, label).

    With ``validate`` the checks of ``check_labels`` run at once and raise
    ``ValueError``; without, the table is only typed.
    """
    raw = spark.read.csv(path, header=True, escape='"')
    return prepare_labels(raw, validate)


def given_labels(raw: DataFrame) -> DataFrame:
    """The label columns as text, null where a CSV reader takes them as missing."""
    require_columns(raw, [*SITE_KEYS, "label"])
    if "gene_id" not in raw.columns:
        raw = raw.withColumn("gene_id", F.lit(None).cast("string"))
    return raw.select(
        *[
            F.when(~is_missing_token(F.col(c).cast("string")), F.col(c).cast("string")).alias(c)
            for c in LABELS_SCHEMA.names
        ]
    )


def label_position():
    """The position as an integer; ``244.0`` is one, ``244.5`` is not."""
    number = as_number("transcript_position")
    return F.coalesce(
        F.col("transcript_position").try_cast("bigint"),
        F.when(number == F.floor(number), number).try_cast("bigint"),
    )


def prepare_labels(raw: DataFrame, validate: bool = True) -> DataFrame:
    """Type, check and project a table of label texts."""
    if validate:
        check_labels(raw)
    return given_labels(raw).select(
        F.when(~is_blank("gene_id"), F.col("gene_id")).alias("gene_id"),
        "transcript_id",
        label_position().alias("transcript_position"),
        as_number("label").alias("label"),
    )


# Check -> what its failing means, in the order in which checks are reported.
CHECKS = {
    "missing": "Missing transcript id, position or label.",
    "blank": "Blank transcript id.",
    "bad_position": "A transcript position is not an integer.",
    "bad_label": "A label is not a number.",
    "not_finite": "Labels contain non-finite values.",
    "out_of_range": "Expected labels in the range [0, 1].",
    "duplicates": "Duplicate site keys in the labels",
}


def _label_keys(given: DataFrame) -> DataFrame:
    """Per site key: rows, and rows that fail each check on rows."""
    label = as_number("label")
    required = [F.col(c) for c in [*SITE_KEYS, "label"]]
    failures = {
        "missing": required[0].isNull() | required[1].isNull() | required[2].isNull(),
        "blank": is_blank("transcript_id"),
        "bad_position": label_position().isNull(),
        "bad_label": label.isNull(),
        "not_finite": F.isnan(label) | (F.abs(label) == F.lit(float("inf"))),
        "out_of_range": ~label.between(0, 1),
    }
    return given.groupBy("transcript_id", label_position().alias("transcript_position")).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in failures.items()],
    )


def label_report(raw: DataFrame) -> DataFrame:
    """(check, failed_rows) of a table of label texts; of duplicates the site keys are counted.

    Rows are combined per site key before the shuffle, then counted.
    """
    sums = {name: F.coalesce(F.sum(name), F.lit(0)) for name in CHECKS if name != "duplicates"}
    sums["duplicates"] = F.count_if(F.col("n") > 1)
    counts = _label_keys(given_labels(raw)).agg(*[c.alias(name) for name, c in sums.items()])
    rows = [F.struct(F.lit(c).alias("check"), F.col(c).alias("failed_rows")) for c in CHECKS]
    return counts.select(F.inline(F.array(*rows)))


def check_labels(raw: DataFrame) -> None:
    """Raise ``ValueError`` unless keys and labels are given, valid and unique."""
    found = dict(label_report(raw).collect())
    for name, text in CHECKS.items():
        if found[name] and name != "duplicates":
            raise ValueError(text)
    if found["duplicates"]:
        keys = _label_keys(given_labels(raw)).filter(F.col("n") > 1)
        examples = keys.orderBy(*SITE_KEYS).limit(5).select(*SITE_KEYS)
        shown = ", ".join(str(tuple(r)) for r in examples.collect())
        raise ValueError(f"{CHECKS['duplicates']}: {shown}")
