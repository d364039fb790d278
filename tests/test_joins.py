import pytest

from sitesignal.operators.joins import CARDINALITIES, validated_join

SCHEMA = "transcript_id string, transcript_position bigint, {} string"
ONCE = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")]
TWICE = [*ONCE, ("b", 1, "w")]


def tables(spark, left, right):
    return spark.createDataFrame(left, SCHEMA.format("v")), spark.createDataFrame(right, SCHEMA.format("w"))


@pytest.mark.parametrize("validate", CARDINALITIES)
def test_repeated_keys_raise_where_they_must_be_unique(spark, validate):
    for side, (left, right) in {"left": (TWICE, ONCE), "right": (ONCE, TWICE)}.items():
        a, b = tables(spark, left, right)
        if CARDINALITIES[validate][side == "right"]:
            with pytest.raises(ValueError, match=f"not unique in the {side} table: .'b', 1"):
                validated_join(a, b, validate=validate)
        else:
            assert validated_join(a, b, validate=validate).count() == 4


def test_each_side_is_shuffled_once(spark):
    a, b = tables(spark, ONCE, ONCE)
    from sitesignal.operators.joins import _unique

    keys = ["transcript_id", "transcript_position"]
    plan = _unique(a, keys, "left").hint("merge").join(_unique(b, keys, "right"), keys)
    text = plan._jdf.queryExecution().explainString(plan._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert text.count("Exchange hashpartitioning") == 2


def test_null_keys_and_outer_joins(spark):
    a, b = tables(spark, [*ONCE, (None, 1, "n")], [ONCE[0], (None, 1, "m")])
    assert validated_join(a, b).count() == 1
    assert validated_join(a, b, how="left").filter("w is null").count() == 3
    a, b = tables(spark, [(None, 1, "n"), (None, 1, "m")], ONCE)
    assert validated_join(a, b, how="left").count() == 2
    assert validated_join(a.filter("false"), b).count() == 0
    with pytest.raises(ValueError, match="validate must be"):
        validated_join(a, b, validate="many")
