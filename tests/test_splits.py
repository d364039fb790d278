import random
from collections import Counter, defaultdict

import pytest

from sitesignal.operators.splits import GENE, SITE, TRANSCRIPT, balanced_split, leakage_safe_split, leaks, linked_groups, place, split_summary
from tests.test_components import union_find

SCHEMA = "transcript_id string, transcript_position bigint, gene_id string, label double, dataset string"


def random_sites(n=600, hot=0.0):
    rng = random.Random(n)
    rows = []
    for _ in range(n):
        t = rng.randrange(n // 4)
        gene = "hot" if rng.random() < hot else rng.choice([None, f"G{t % 37}", f"G{rng.randrange(200)}"])
        rows.append((f"T{t}", rng.randrange(9), gene, float(rng.random() < 0.2), rng.choice("ab")))
    return rows


def plain_groups(rows):
    keys = [(("t", r[0]), ("g", r[2])) if r[2] is not None else (("t", r[0]), ("t", r[0])) for r in rows]
    root = union_find(keys)
    return [root[a] for a, _ in keys]


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_groups_equal_union_find_and_no_key_is_on_both_sides(spark, hot):
    rows = random_sites(hot=hot)
    df = spark.createDataFrame(rows, SCHEMA)
    split = leakage_safe_split(df, 0.3)
    got = split.collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(rows)
    expected, found = defaultdict(set), defaultdict(set)
    for row, g in zip(rows, plain_groups(rows), strict=True):
        expected[g].add(row)
    for r in got:
        found[r.group].add(tuple(r)[:5])
    assert sorted(map(sorted_rows, expected.values())) == sorted(map(sorted_rows, found.values()))
    assert [tuple(r) for r in leaks(split).orderBy("kind").collect()] == [("gene_id", 0), ("transcript_id", 0), ("transcript_id+transcript_position", 0)]


def sorted_rows(rows):
    return sorted(map(repr, rows))


def test_each_kind_alone_and_what_it_leaves_open(spark):
    df = spark.createDataFrame(random_sites(), SCHEMA)
    for kinds in ([SITE], [TRANSCRIPT], [GENE], [SITE, GENE]):
        split = leakage_safe_split(df, 0.5, kinds, seed=3)
        assert leaks(split, kinds).filter("leaks > 0").count() == 0
        assert {r.side for r in split.select("side").distinct().collect()} == {"train", "test"}
    by_site = leakage_safe_split(df, 0.5, [SITE])
    assert leaks(by_site, [TRANSCRIPT]).first().leaks > 0
    assert by_site.filter("side = 'test'").count() == pytest.approx(300, abs=90)


def test_odd_rows(spark):
    rows = [("T1", 1, None, None, None), ("T1", 1, None, None, None), (None, 1, "G", 1.0, "a"), (None, None, None, 1.0, "a"), ("T2", None, "G", 0.0, "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.transcript_id, r.gene_id): r.group for r in linked_groups(df).collect()}
    assert got[None, "G"] == got["T2", "G"] and got[None, None] is None and len(set(got.values())) == 3
    assert leakage_safe_split(df).filter("side is null").count() == 0
    assert linked_groups(df.filter("false")).count() == 0
    assert balanced_split(linked_groups(df)).count() == 5 and balanced_split(linked_groups(df.filter("false"))).count() == 0
    assert "side" in balanced_split(linked_groups(df)).columns


@pytest.mark.parametrize("hot", [0, 700])
def test_shares_of_rows_and_positives(spark, hot):
    rng = random.Random(hot)
    rows = [("hot", 1.0 if i % 3 == 0 else 0.0) for i in range(hot)]
    for g in range(800):
        rate = rng.choice([0.0, 0.0, 0.1, 0.5, 1.0])
        rows += [(f"g{g}", float(rng.random() < rate)) for _ in range(rng.randrange(1, 5))]
    shares = {"train": 0.7, "valid": 0.1, "test": 0.2}
    df = spark.createDataFrame(rows, "group string, label double")
    split = balanced_split(df, shares=shares)
    assert Counter((r.group, r.label) for r in split.collect()) == Counter(rows)
    for r in split_summary(split, shares).collect():
        assert r.split_groups == 0
        assert abs(r.row_share - r.wanted_share) < 0.01 and abs(r.positive_share - r.wanted_share) < 0.01
    assert split_summary(split, shares).agg({"rows": "sum"}).first()[0] == len(rows)


def test_a_group_larger_than_any_share_stays_whole(spark):
    rows = [("hot", 1.0)] * 90 + [(f"g{i}", 0.0) for i in range(10)]
    split = balanced_split(spark.createDataFrame(rows, "group string, label double"), shares={"a": 0.5, "b": 0.5})
    sides = {(r.group == "hot", r.side) for r in split.collect()}
    assert len(sides) == 2 and {s for _, s in sides} == {"a", "b"}


def test_place_and_bad_shares(spark):
    assert Counter(place([(1, 0)] * 100, {"a": 0.25, "b": 0.75})) == {"a": 25, "b": 75}
    assert place([], {"a": 1.0}) == []
    df = spark.createDataFrame([("g", 1.0)], "group string, label double")
    for shares in ({"a": -1.0, "b": 2.0}, {"a": 0.0}):
        with pytest.raises(ValueError, match="shares"):
            balanced_split(df, shares=shares)
