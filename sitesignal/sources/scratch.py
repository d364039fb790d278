"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from sitesignal.sources.storage import Storage

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset in a local session, as in tests, a temporary folder
    stands for it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted at the end of ``scratch_tables``."""
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def scratch_tables(spark: SparkSession):
    """Delete the tables settled inside when it ends: what is built on them must be written by then.

    Outside of it settled tables stay until the folder is cleared after the job.
    """
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        storage = Storage(spark)
        for path in made:
            storage.delete(path)


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it from there.

    Cuts the lineage and survives lost executors; what follows can read it
    more than once, and only the columns that it needs.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
