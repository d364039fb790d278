import os

import numpy as np
import pytest

from sitesignal.llm import negatives
from sitesignal.llm.negatives import SortedLists, hard_negatives, in_windows, nearest

DATA = "/root/testdata/sf0.01"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute_force(rows, every=100):
    """Plain loops over all pairs; rows of one id are given once."""
    kept = {}
    for r in rows:
        if None in (r.vec_id, r.label, r.embedding) or any(x is None or not np.isfinite(x) for x in r.embedding):
            continue
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        entry = (label, [int(np.floor(256 * float(x))) for x in r.embedding])
        kept[r.vec_id] = min(kept.get(r.vec_id, entry), entry)
    out = []
    for a, (label, x) in kept.items():
        if a % every:
            continue
        score = {b: sum(p * q for p, q in zip(x, y, strict=True)) for b, (_, y) in kept.items() if b != a and len(y) == len(x)}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if kept[b][0] == label][:5]:
            s = score[p]
            hard = [b for b in order if kept[b][0] != label and 30 * s <= 100 * score[b] <= 90 * s]
            out += [(a, p, i + 1, b, s, score[b]) for i, b in enumerate(hard[:10])]
    return sorted(out)


def found(df, **how):
    return sorted(tuple(r[c] for c in COLUMNS) for r in hard_negatives(df, **how).collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_equals_brute_force_on_the_whole_table(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    expected = brute_force(df.collect())
    assert expected and found(df) == expected
    assert found(df, block=37, chunk=2) == expected
    dtypes = dict(hard_negatives(df).dtypes)
    assert dtypes == {c: "int" if c == "rank" else "bigint" for c in COLUMNS}


def test_search_stops_early_and_misses_nothing():
    rng = np.random.default_rng(3)
    rows = rng.integers(-50, 50, (3000, 3))
    rows[:40] += 400
    lists, ids = SortedLists(rows), rng.permutation(3000)
    seen = []
    for i in range(60):
        anchor = rows[i]
        scores = rows @ anchor
        places, got = lists.search(anchor, lambda p, s, t: len(s) >= 10 and t < np.sort(s)[-10])
        seen.append(len(places))
        assert (got == scores[places]).all()
        top_ids, top = nearest(lists, ids, anchor, ids[i], 5)
        order = np.lexsort((ids, -scores))
        order = order[order != i][:5]
        assert top_ids.tolist() == ids[order].tolist() and top.tolist() == scores[order].tolist()
        other = rng.random(3000) < 0.5
        windows = [(int(0.3 * s), int(0.9 * s)) for s in top if s >= 0]
        for (least, most), (its, _) in zip(windows, in_windows(lists, ids, other, anchor, windows, 10), strict=True):
            order = [j for j in np.lexsort((ids, -scores)) if other[j] and least <= scores[j] <= most][:10]
            assert its.tolist() == ids[order].tolist()
    assert min(seen) < 1000


def test_ties_repeats_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, i % 3, [float(i % 4), 1.0]) for i in range(60)]
    rows += [(100, 1, [1.0, 1.0]), (100, 1, [1.0, 1.0]), (200, 2, [0.0, 0.0]), (300, 0, [-1.0, -2.0]), (5, 0, [9.0, 9.0])]
    rows += [(400, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (401, 1, None), (402, 1, [None, 1.0]), (403, 1, [nan, 1.0])]
    rows += [(404, 1, [inf, 1.0]), (500, 1, [1.0, 2.0, 3.0]), (501, 1, [1.0, 2.0, 2.0]), (502, 2, [1.0, 1.0, 1.0])]
    rows += [(600, 1, []), (601, 1, []), (602, 2, []), (700, 4, [1.0, 1.0])]
    schema = "vec_id bigint, label int, embedding array<double>"
    df = spark.createDataFrame(rows, schema)
    expected = brute_force(df.collect())
    assert {r[0] for r in expected} >= {100, 200, 500, 600}
    extra = df.selectExpr("*", "'x' as components", "'x' as block", "'x' as size", "'x' as rank", "'x' as chunk")
    assert found(extra) == expected and found(df, block=7, chunk=1) == expected
    assert found(df.where("false")) == [] and found(df.where("label is null")) == []


def test_large_components_are_exact_and_bounded(spark):
    rows = [(0, 1, [2.0**17, 1.0]), (1, 1, [2.0**17, 0.5]), (2, 2, [2.0**16.5, 3.0]), (3, 2, [1e300, 0.0]), (8, 2, [-1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    bounded = df.selectExpr("vec_id", "label", "transform(embedding, x -> greatest(least(x, 262144D), -262144D)) as embedding")
    assert found(df) == brute_force(bounded.collect()) and found(df)
    assert negatives.window_of(-1) is None and negatives.window_of(0) == (0, 0) and negatives.window_of(7) == (3, 6)


def test_one_label_and_copies_with_most_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, 1 if i % 3 else i % 10, [0.5, 0.25, 0.125] if i % 2 else rng.normal(size=3).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    assert found(df, block=64) == brute_force(df.collect())
