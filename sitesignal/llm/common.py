"""Helpers shared by the text operators."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesignal.sources.scratch import scratch_path, settle, shared_folder

__all__ = ["apart", "arrow_rows", "folds", "map_batches", "numbered", "scratch_path", "settle", "shared_folder", "slices", "together"]

#: In how many parts the rows of a group are numbered.
NUMBER_SLICES = 1024

ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
}


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Lower the rows of an Arrow batch for jobs whose rows are large; they run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(spark: SparkSession) -> int:
    """In how many parts a key that may be hot is split."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, prepare, columns: list[tuple[str, str]], rows: int = 512) -> DataFrame:
    """Map Arrow batches of at most ``rows`` rows inside tasks.

    ``prepare()`` runs once per task and returns a function from a dict of
    lists, by column name, to a list of lists in the order of ``columns``.
    """
    schema = pa.schema([(name, ARROW[kind]) for name, kind in columns])

    def run(batches):
        step = prepare()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows).to_pydict()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) for v, f in zip(step(part), schema, strict=True)],
                    schema=schema,
                )

    return df.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in columns))


def apart(docs: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, str | None]:
    """The columns that an operator needs and all others as one column, and that column's name.

    So no name that the operator uses inside can clash with a column of the input.
    """
    others = [c for c in docs.columns if c not in needed]
    rest = next(f"rest{i}" for i in range(len(needed) + 1) if f"rest{i}" not in needed) if others else None
    columns = [F.col(f"`{c}`") for c in docs.columns if c in needed]
    packed = [F.struct(*[F.col(f"`{c}`") for c in others]).alias(rest)] if rest else []
    return docs.select(*columns, *packed), rest


def together(out: DataFrame, docs: DataFrame, rest: str | None, results: tuple[str, ...] = (), keep: bool = False) -> DataFrame:
    """The columns of ``docs`` again, and the results of the operator.

    A column of the input that is named like a result is replaced, or with ``keep`` kept
    (and that result left out).
    """
    if keep:
        results = tuple(r for r in results if r not in docs.columns)
    columns = [
        F.col(f"`{c}`") if c in results or c in out.columns and c not in _fields(out, rest) else F.col(f"`{rest}`.`{c}`").alias(c)
        for c in docs.columns
    ]
    return out.select(*columns, *[r for r in results if r not in docs.columns])


def _fields(out: DataFrame, rest: str | None) -> set[str]:
    return set(out.schema[rest].dataType.names) if rest else set()


def folds(column: str, n: int) -> Column:
    """crc32 of the decimal text of an integer column, modulo ``n``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Number the rows of each group from 0, in no set order, without gathering a group.

    Rows are split by a hash into slices, as many whatever the session's settings, so the
    numbers follow from the rows alone; a slice's first number is the sum of
    the sizes of the slices before it.
    """
    from pyspark.sql import Window

    part = F.pmod(F.xxhash64(*order), F.lit(NUMBER_SLICES))
    df = df.withColumn("__slice", part)
    sizes = df.groupBy(*group, "__slice").agg(F.count("*").alias("__size"))
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *group, "__slice", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__first")
    )
    inside = Window.partitionBy(*group, "__slice").orderBy(*order)
    return (
        df.withColumn("__at", F.row_number().over(inside) - 1)
        .join(sizes, [*group, "__slice"])
        .withColumn(name, F.col("__first") + F.col("__at"))
        .drop("__slice", "__first", "__at")
    )
