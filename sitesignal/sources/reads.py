"""The reads table in Parquet."""

from pyspark.sql import DataFrame, SparkSession

from sitesignal.schema import LABELLED_READS_SCHEMA, READS_SCHEMA, SITE_KEYS


def read_reads(spark: SparkSession, path, columns=None) -> DataFrame:
    """The whole table or some columns; only those are read from disk."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def preview(df: DataFrame, n: int = 5, order=None) -> DataFrame:
    """The first rows by site and read; an empty table gives no rows."""
    if order is None:
        order = [c for c in [*SITE_KEYS, "read_idx"] if c in df.columns]
    return df.orderBy(*order).limit(n)


def reads_columns(df: DataFrame) -> DataFrame:
    """The fixed schema; the label columns only if they are there."""
    schema = LABELLED_READS_SCHEMA if "label" in df.columns else READS_SCHEMA
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])


def write_reads(df: DataFrame, path, batch_size: int = 100_000) -> None:
    """Write snappy Parquet; an existing path is an error.

    ``batch_size`` is the largest number of rows per Parquet row group.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive.")
    reads_columns(df).write.mode("errorifexists").option(
        "parquet.block.row.count.limit", batch_size
    ).option("compression", "snappy").parquet(path)
