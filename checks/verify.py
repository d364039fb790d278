"""Compare every registered query with its SQL: ``python -m checks.verify DIR``."""

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=repr)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "tinyint": "TINYINT", "double": "DOUBLE",
    "string": "VARCHAR", "boolean": "BOOLEAN",
}


def compare(df, con, sql):
    """None if equal, else what differs."""
    got = table([tuple(r) for r in df.collect()], df.columns)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = table(result.fetchall(), names)
    if got[0] != want[0]:
        return f"columns {sorted(set(got[0]) ^ set(want[0]))}"
    kinds = {d[0]: str(d[1]) for d in result.description}
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != kinds[name]:
            return f"type of {name}: {kind}, {kinds[name]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])}, {len(want[1])}"
    for g, w in zip(got[1], want[1]):
        if g != w:
            wrong = [(n, a, b) for n, a, b in zip(got[0], g, w) if a != b]
            return f"row {g[-2:]}: {wrong[:4]}"
    return None


def main(sf_dir, names):
    from pyspark.sql import SparkSession

    from checks.oracle import ORACLE
    from checks.queries import QUERIES

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), []
    for name in names or QUERIES:
        start = time.time()
        try:
            problem = compare(QUERIES[name](spark, sf_dir), con, ORACLE[name])
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"\n{name} {time.time() - start:.1f}s {problem or 'ok'}", flush=True)
        failed += [name] if problem else []
    print(f"\n{len(names or QUERIES) - len(failed)} ok, failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
