"""Signal JSON lines and optional labels -> reads Parquet and an audit.

The costly parse runs once.  Its result, one row per line, is staged next to
the output, and everything else (the checks, the label join, the audit counts)
reads only the staged columns it needs.  A staged table also survives lost
executors, and counts taken from it are exact where counters would be counted
again by a repeated task.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesignal.functions import central_kmer, is_drach
from sitesignal.operators.joins import attach_labels
from sitesignal.schema import SITE_KEYS
from sitesignal.sources.labels import read_labels
from sitesignal.sources.reads import write_reads
from sitesignal.sources.signals import (
    LINE_ORDER,
    explode_reads,
    good_sites,
    line_number,
    parse_lines,
    read_first_lines,
    read_lines,
    skip_blank_lines,
)
from sitesignal.sources.storage import Storage


# Label rows of about 100 bytes; beyond this many they are joined, not broadcast.
BROADCAST_LABELS = 200_000


def audit_path(output: str) -> str:
    """``x/reads.parquet`` -> ``x/reads.audit.json``."""
    folder, _, name = output.rstrip("/").rpartition("/")
    stem = name.rpartition(".")[0] or name
    return f"{folder}/{stem}.audit.json" if folder else f"{stem}.audit.json"


#: The audit inside the data folder, which makes both one commit; readers pass over it.
INNER_AUDIT = "_audit.json"


def restore_audit(spark: SparkSession, output: str) -> bool:
    """Write the audit beside the data again from the copy inside, if only that is there.

    So ends a run whose driver was killed after it had committed the data. True if it was needed.
    """
    storage, output = Storage(spark), str(output)
    inner, outer = f"{output.rstrip('/')}/{INNER_AUDIT}", audit_path(output)
    if storage.exists(outer) or not storage.exists(inner):
        return False
    _put_text(storage, outer, storage.read_text(inner))
    return True


def _put_text(storage: Storage, path: str, text: str) -> None:
    """A text file that is whole or not there."""
    partial = f"{path}.partial-{uuid.uuid4().hex}"
    try:
        storage.write_text(partial, text)
        storage.rename(partial, path)
    except BaseException:
        storage.delete(partial)
        raise


def key_counts(sites: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row: a repeated site key or null, and how sites and labels match.

    Keys of both sides are counted in one grouping, which answers the
    duplicate check and both set differences with a single shuffle of keys.
    """
    keys = sites.select(*SITE_KEYS, F.lit(1).alias("site"), F.lit(0).alias("label"))
    if labels is not None:
        keys = keys.unionAll(
            labels.select(*SITE_KEYS, F.lit(0).alias("site"), F.lit(1).alias("label"))
        )
    per_key = keys.groupBy(*SITE_KEYS).agg(
        F.sum("site").alias("site"), F.sum("label").alias("label")
    )
    return per_key.agg(
        F.min(F.when(F.col("site") > 1, F.struct(*SITE_KEYS))).alias("repeated"),
        F.coalesce(F.sum("label"), F.lit(0)).alias("label_rows"),
        F.count_if(F.col("label") == 0).alias("sites_without_labels"),
        F.count_if(F.col("site") == 0).alias("labels_without_parsed_sites"),
    )


def ingest(
    spark: SparkSession,
    signals: str,
    output: str,
    labels: str | None = None,
    batch_size: int = 100_000,
    max_sites: int | None = None,
) -> dict:
    """Write the reads table and its audit; return the audit.

    The first bad line, a site on two lines, bad labels or an input without
    sites raise ``ValueError`` and leave no output.  Existing output is never
    overwritten.  ``max_sites`` keeps the first sites in file order and looks
    at no line after them.

    All is staged in a folder of the run's own name, so what a killed driver
    leaves blocks no later run.  Data and audit (a copy inside the data
    folder) appear by one rename; the audit beside the data follows, and where a
    driver was killed in between, the next call for that output (which
    refuses it, as it exists) or ``restore_audit`` writes it.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive.")
    if max_sites is not None and max_sites < 1:
        raise ValueError("max_sites must be positive.")
    signals, output = str(signals), str(output)
    audit_file = audit_path(output)
    partial = f"{output.rstrip('/')}.partial-{uuid.uuid4().hex}"
    storage = Storage(spark)
    restore_audit(spark, output)
    for path in [output, audit_file]:
        if storage.exists(path):
            raise FileExistsError(f"{path} already exists, choose a new output.")
    label_rows = read_labels(spark, str(labels)) if labels is not None else None

    if max_sites is None:
        lines = read_lines(spark, signals)
        wanted = skip_blank_lines(lines)
    else:
        lines, wanted = read_first_lines(spark, signals, max_sites)
    try:
        # What the checks need of the reads is staged beside them.
        parse_lines(wanted).drop("value").withColumns(
            {"n_reads": F.size("reads").cast("bigint"), "central_5mer": central_kmer()}
        ).write.parquet(f"{partial}/lines")
        staged = spark.read.parquet(f"{partial}/lines")
        counts = _checked_counts(staged, lines)
        sites = good_sites(staged)
        matches = key_counts(sites, label_rows).first().asDict()
        _raise_if_repeated(matches.pop("repeated"))
        audit = {
            "signal_path": signals,
            "label_path": str(labels) if labels is not None else None,
            "output_path": output,
            "max_sites_requested": max_sites,
            **counts,
            **(matches if label_rows is not None else dict.fromkeys(matches)),
        }
        if label_rows is not None:
            small = matches["label_rows"] <= BROADCAST_LABELS
            right = F.broadcast(label_rows) if small else label_rows
            sites = attach_labels(sites, right, validate=False)
        write_reads(explode_reads(sites), f"{partial}/reads", batch_size)
        text = json.dumps(audit, indent=2)
        storage.write_text(f"{partial}/reads/{INNER_AUDIT}", text)
        storage.rename(f"{partial}/reads", output)
        _put_text(storage, audit_file, text)
    finally:
        storage.delete(partial)
    return audit


def _raise_if_repeated(key):
    if key is not None:
        raise ValueError(f"Duplicate site in the signals: {tuple(key)}")


def _checked_counts(staged: DataFrame, lines: DataFrame) -> dict:
    """Audit counts of the staged lines; the first bad line raises.

    So does a site that is repeated before that line, which comes first.
    """
    where = F.struct(*LINE_ORDER)
    bad = F.col("reason").isNotNull()
    found = (
        staged.select(
            F.when(bad, where).alias("bad_at"),
            "reason",
            F.when(~bad, F.col("n_reads")).alias("n_reads"),
            F.when(~bad, F.col("central_5mer")).alias("central_5mer"),
        )
        .agg(
            F.min("bad_at").alias("at"),
            F.min_by("reason", "bad_at").alias("reason"),
            F.count("central_5mer").alias("parsed_sites"),
            F.coalesce(F.sum("n_reads"), F.lit(0)).alias("parsed_read_rows"),
            F.count_if(F.col("central_5mer").isNotNull() & ~is_drach("central_5mer")).alias(
                "sites_outside_expected_DRACH_motif"
            ),
        )
        .first()
        .asDict()
    )
    at, reason = found.pop("at"), found.pop("reason")
    if at is not None:
        before = F.struct(*[F.lit(at[c]).alias(c) for c in LINE_ORDER])
        earlier = staged.filter(~bad & (where < before))
        _raise_if_repeated(key_counts(earlier).first()["repeated"])
        number = line_number(lines, at["file"], at["block"], at["line_id"])
        raise ValueError(f"{at['file']}, line {number}: {reason}")
    if not found["parsed_sites"]:
        raise ValueError("No sites were found in the input.")
    return found
