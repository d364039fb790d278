"""Time the headline queries: prints one JSON line.

The reads table is derived and written once, as ``ingest`` would leave it;
each query then reads it from Parquet and is run to the end.
``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores.
"""

import json
import os
import statistics
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from pyspark.sql import SparkSession  # noqa: E402

from checks import fixtures as x  # noqa: E402
from sitesignal.operators import compare as c  # noqa: E402
from sitesignal.operators import distributions as d  # noqa: E402
from sitesignal.operators import frequency as f  # noqa: E402
from sitesignal.operators import quality as q  # noqa: E402
from sitesignal.operators import sites as s  # noqa: E402
from sitesignal.operators import summaries as m  # noqa: E402
from sitesignal.operators.baselines import fit_kmer_baselines  # noqa: E402
from sitesignal.operators.features import build_features  # noqa: E402
from sitesignal.plans.ingest import ingest  # noqa: E402
from sitesignal.plans.profile import profile  # noqa: E402
from sitesignal.sources.reads import read_reads, write_reads  # noqa: E402
from sitesignal.sources.scratch import scratch_tables  # noqa: E402
from sitesignal.sources.storage import Storage  # noqa: E402

REPEATS = 3


def consume(df):
    df.write.format("noop").mode("overwrite").save()


def profiled(spark, reads):
    with scratch_tables(spark):
        for table in profile(reads).values():
            consume(table)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sitesignal-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = x.scratch(spark)
    for name, df in [
        ("reads", x.reads(spark, sf_dir, index=True)),
        ("a", x.dataset_a(spark, sf_dir)),
        ("b", x.dataset_b(spark, sf_dir)),
    ]:
        df.write.parquet(f"{folder}/{name}")
    signals, labels = x.signal_files(spark, sf_dir)
    reads = read_reads(spark, f"{folder}/reads")
    a, b = read_reads(spark, f"{folder}/a"), read_reads(spark, f"{folder}/b")
    baselines = fit_kmer_baselines(a)
    baselines.write.parquet(f"{folder}/baselines")
    baselines = spark.read.parquet(f"{folder}/baselines")
    runs = {
        "ingest": lambda i: ingest(spark, signals, f"{folder}/ingest{i}.parquet", labels),
        "features": lambda i: consume(build_features(reads)),
        "features_with_residuals": lambda i: consume(build_features(reads, baselines)),
        "fit_baselines": lambda i: consume(fit_kmer_baselines(reads)),
        "write_reads": lambda i: write_reads(reads, f"{folder}/copy{i}"),
        "site_means": lambda i: consume(s.site_means(reads)),
        "summary": lambda i: consume(m.dataset_summary(reads)),
        "quality": lambda i: consume(q.quality_report(reads)),
        "coverage": lambda i: consume(
            m.describe(s.site_table(reads), "n_reads", m.COVERAGE_PERCENTILES)
        ),
        "motif_summary": lambda i: consume(f.motif_summary(s.site_table(reads))),
        "read_boxes": lambda i: consume(d.box_stats(s.labelled(reads))),
        "profile": lambda i: profiled(spark, reads),
        "density": lambda i: consume(d.density_by_label(reads)),
        "compare": lambda i: consume(c.agreement_summary(c.site_pairs(a, b))),
    }
    times = {}
    for name, run in runs.items():
        taken = []
        for i in range(REPEATS):
            start = time.perf_counter()
            run(i)
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(name, [round(t, 2) for t in taken], file=sys.stderr, flush=True)
    Storage(spark).delete(folder)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
