"""A few registered queries against their SQL; checks.verify runs them all."""

import os

import pytest

import __spark_entry__ as driver
from checks.oracle import ORACLE
from checks.queries import QUERIES
from checks.verify import compare, connect

DATA = "/root/testdata/sf0.001"


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLE) <= set(driver.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize(
    "name",
    [
        "par1_line_checks",
        "agg6_kmer_baselines",
        "dq_report",
        "agg24_agreement",
        "dst4_read_boxes",
        "ent1_ingest_reads",
        "ent2_features_with_residuals",
        "ent2_features_deep_sites",
        "agg27_ingest_audit",
        "agg16_close_labels",
        "lab_checks",
        "dst5_many_label_boxes",
        "fil7_complete_transcripts",
    ],
)
def test_query_equals_sql(spark, name):
    problem = compare(driver.queries()[name](spark, DATA), connect(DATA), driver.oracle_sql()[name])
    assert problem is None


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship(spark):
    features = driver.entry(spark)
    assert len(features.columns) == 155 and features.count() == 520
