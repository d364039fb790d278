"""The tables that the registered queries read."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import fixtures as x
from sitesignal.schema import SITE_KEYS
from sitesignal.sources.signals import skip_blank_lines

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_coverage_is_joined_only_where_it_is_looked_at(spark):
    reads = x.reads(spark, DATA)
    rows = x.reads(spark, DATA, coverage=False)
    assert "Join" in plan(reads) and "Join" not in plan(reads.drop("n_reads"))
    right = rows.withColumn("n_reads", F.count("*").over(Window.partitionBy(*SITE_KEYS)))
    names = [*SITE_KEYS, "n_reads", "central_dwell", "label"]
    assert sorted(map(repr, reads.select(names).collect())) == sorted(map(repr, right.select(names).collect()))


def test_rows_of_usual_sites_are_numbered_without_slices(spark, monkeypatch):
    usual = x.reads(spark, DATA, index=True)
    # No rows are joined with as many starts: one join for the coverage, one with the few starts of deep sites.
    assert plan(usual).count("Join LeftOuter") == 2 and plan(usual).count("Join Inner") == 0
    rows = sorted(map(repr, usual.collect()))
    monkeypatch.setattr(x, "DEEP_SITE", 3)
    assert sorted(map(repr, x.reads(spark, DATA, index=True).collect())) == rows


def test_signal_text_is_made_after_the_sort(spark):
    lines = x.signal_lines(spark, DATA, defects=False, ordered=True).select("value")
    text = plan(lines)
    assert "map(" in text[: text.index("Sort")] and "map(" not in text[text.index("Sort") :]
    own = x.signal_lines(spark, DATA, defects=False).orderBy("line_id").select("value")
    assert lines.collect() == own.collect()


def test_signal_text_is_made_once_below_a_filter_on_it(spark):
    filled = skip_blank_lines(x.signal_lines(spark, DATA))
    assert plan(filled).count("NNNNNNN") == 1  # occurs in the text of one kind of bad line
    assert "RLIKE" in plan(filled)
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    assert filled.count() == orders.filter("o_orderkey % 20 <> 0").count()
