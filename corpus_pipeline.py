"""The corpus pipeline: from raw documents to packed sequences.

Each stage takes what the one before kept. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sitesignal.llm.common import apart, scratch_path, together
from sitesignal.llm.linededup import dedup_lines
from sitesignal.llm.mixing import mix
from sitesignal.llm.neardup import drop_near_duplicates
from sitesignal.llm.packing import pack
from sitesignal.llm.rules import judge
from sitesignal.sources.scratch import scratch_tables

# What the stages look at; all other columns of the documents pass through unchanged,
# whatever their names. A table without rows gives one without rows.
NEEDED = ("doc_id", "text", "lang", "source")


def quality_rules(spark, docs, sf_dir):
    """Documents that pass all quality rules.

    A null or empty text fails, as it has no words; null ids, long texts and repeated rows are judged row by row.
    """
    own, rest = apart(docs, NEEDED)
    return together(judge(own).where("kept"), docs, rest)


def line_dedup(spark, docs, sf_dir):
    """Texts without later repeated runs of lines; what is emptied by that goes.

    A full copy of an earlier document is one repeated run, so it goes here. Null and empty texts
    stay as they are, rows of equal id and text are treated alike; ``n_chars`` is that of the new text.
    """
    own, rest = apart(docs, NEEDED)
    out = dedup_lines(own).where((F.size("removed_lines") == 0) | (F.col("text") != ""))
    out = together(out, docs, rest)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def near_dedup(spark, docs, sf_dir):
    """One document of each class of near-duplicates: that of the smallest id.

    Null texts are copies of empty ones; null ids come last; of equal rows one stays.
    """
    return drop_near_duplicates(docs)


def mixing(spark, docs, sf_dir):
    """Documents sampled so that tempered shares of sources, languages and topics are met.

    A null source or language is a category; null and empty texts have no weight and stay; rows of one id share
    their chance.
    """
    own, rest = apart(docs, NEEDED)
    return together(mix(own).where("sampled"), docs, rest)


def packing(spark, docs, sf_dir):
    """The kept documents, packed into windows: a row for each piece.

    A null or empty text has its end id alone; rows of equal id are packed one by one.
    """
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]
ORACLE_SQL = None  # tokens and near-duplicates are beyond SQL; see tests/llm/test_pipeline.py


def run(spark, sf_dir):
    """Apply the stages to ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_path(spark)
        with scratch_tables(spark):  # what a stage has settled goes when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
