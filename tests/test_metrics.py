import random

import pytest
from pyspark.sql import functions as F

from sitesignal.operators.metrics import average_precision, precision_recall_curve, ranking_metrics, roc_auc, roc_curve, score_curve
from sitesignal.operators.running import running_sums

SCHEMA = "key string, label double, score double"


def plain_auc(rows):
    """The share of pairs in order, by looking at all pairs."""
    ones, zeros = ([s for y, s in rows if y == k] for k in (1, 0))
    if not ones or not zeros:
        return None
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


def plain_average_precision(rows):
    ones = sum(y == 1 for y, _ in rows)
    if not ones:
        return None
    total, before = 0.0, 0
    for t in sorted({s for _, s in rows}, reverse=True):
        above = [y for y, s in rows if s >= t]
        total += (sum(above) - before) / ones * sum(above) / len(above)
        before = sum(above)
    return total


def table(spark, rows):
    return spark.createDataFrame([(None if len(r) == 2 else r[0], *r[-2:]) for r in rows], SCHEMA)


@pytest.mark.parametrize("levels", [1, 4, 10**6])
def test_equal_plain_loops_with_ties(spark, levels):
    rng = random.Random(levels)
    rows = [(float(rng.random() < 0.3), rng.randrange(levels) / levels) for _ in range(400)]
    got = ranking_metrics(table(spark, rows)).first()
    assert got.rows == 400 and got.positives == sum(y for y, _ in rows)
    assert got.roc_auc == pytest.approx(plain_auc(rows), abs=1e-12)
    assert got.average_precision == pytest.approx(plain_average_precision(rows), abs=1e-12)


def test_one_class_no_rows_and_values_that_do_not_count(spark):
    nan, inf = float("nan"), float("inf")
    assert roc_auc(table(spark, [(1.0, 0.5), (1.0, 0.2)])) is None
    assert average_precision(table(spark, [(1.0, 0.5), (1.0, 0.2)])) == 1.0
    assert average_precision(table(spark, [(0.0, 0.5)])) is None
    empty = table(spark, [(1.0, 0.5)]).filter("false")
    assert tuple(ranking_metrics(empty).first()) == (0, 0, 0, None, None)
    assert ranking_metrics(empty, ["key"]).count() == 0
    rows = [(1.0, inf), (0.0, -inf), (1.0, 0.0), (0.0, -0.0)]
    odd = table(spark, [*rows, (0.5, 0.9), (None, 0.9), (1.0, None), (0.0, nan)])
    got = ranking_metrics(odd).first()
    assert got.rows == 4 and got.roc_auc == plain_auc(rows) == 0.875


def test_groups_with_a_null_key_and_one_with_most_rows(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), float(rng.random() < 0.5), rng.randrange(30) / 30) for _ in range(500)]
    rows += [("one class", 0.0, 0.5)]
    got = {r.key: r for r in ranking_metrics(table(spark, rows), ["key"]).collect()}
    for key in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == key]
        assert got[key].roc_auc == pytest.approx(plain_auc(own)) and got[key].rows == len(own)
        assert got[key].average_precision == pytest.approx(plain_average_precision(own))


def test_curves(spark):
    rows = [(1.0, 0.9), (0.0, 0.9), (1.0, 0.5), (0.0, 0.1)]
    df = table(spark, rows)
    curve = [tuple(r) for r in score_curve(df).orderBy("score").collect()]
    assert curve == [(0.1, 0, 1, 2, 2), (0.5, 1, 0, 2, 1), (0.9, 1, 1, 1, 1)]
    assert [tuple(r) for r in roc_curve(df).orderBy("score").collect()] == [(0.1, 1, 1), (0.5, 1, 0.5), (0.9, 0.5, 0.5)]
    assert [r.precision for r in precision_recall_curve(df).orderBy("score").collect()] == [0.5, pytest.approx(2 / 3), 0.5]
    assert roc_curve(df.filter("label = 1")).first().fpr is None
    assert roc_curve(df, ["key"]).count() == 3


def test_no_task_gets_a_whole_table(spark):
    df = spark.range(20_000).selectExpr("id", "1L as one", "pmod(xxhash64(id), 2) as half")
    summed = running_sums(df, [], [F.desc("id")], {"one": "n"})
    assert summed.filter("n <> 20000 - id").count() == 0
    parts = summed.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 15_000
    by_half = running_sums(df, ["half"], [F.asc("id")], {"one": "n", "id": "s"})
    assert by_half.groupBy("half").agg({"n": "max"}).filter("`max(n)` < 9000").count() == 0
