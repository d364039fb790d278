"""``spark-submit sitesignal/plans/ingest_job.py --signals ... --output ...``"""

import argparse
import json

from pyspark.sql import SparkSession

from sitesignal.plans.ingest import ingest


def main(argv=None):
    options = argparse.ArgumentParser(description="Signal JSON lines to reads Parquet.")
    options.add_argument("--signals", required=True)
    options.add_argument("--output", required=True)
    options.add_argument("--labels")
    options.add_argument("--max-sites", type=int)
    options.add_argument("--batch-size", type=int, default=100_000)
    given = options.parse_args(argv)
    spark = SparkSession.builder.appName("ingest").getOrCreate()
    audit = ingest(
        spark, given.signals, given.output, given.labels, given.batch_size, given.max_sites
    )
    print(json.dumps(audit, indent=2))
    return audit


if __name__ == "__main__":
    main()
