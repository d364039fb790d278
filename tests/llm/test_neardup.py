import os
from itertools import combinations

import numpy as np
import pytest

from sitesignal.llm.bpe import Memory
from sitesignal.llm.neardup import components, drop_near_duplicates, near_duplicates, prob_min_hash, shingles, word_code

DATA = "/root/testdata/sf0.01"


def test_equal_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    x = dict(zip(rng.integers(0, 2**63, 60).tolist(), rng.uniform(0.5, 3, 60).tolist(), strict=True))
    y = {k: v * 1.5 for k, v in list(x.items())[:40]} | {int(k): 1.0 for k in rng.integers(0, 2**63, 20)}
    exact = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in {*x} & {*y})
    pair = [(np.array(list(d), np.uint64), np.array(list(d.values()))) for d in (x, y)]
    a, b = prob_min_hash(pair, 20_000)
    assert abs((a == b).mean() - exact) < 0.02


def classes(docs, threshold=0.8):
    words, sets, ids = Memory(word_code), {}, {}
    for r in docs:
        sets[r.text or ""] = set(shingles(r.text or "", words)[0].tolist())
        ids.setdefault(r.text or "", []).append(r.doc_id)
    of = {s: set() for v in sets.values() for s in v}
    for t, v in sets.items():
        for s in v:
            of[s].add(t)
    root = {t: t for t in sets}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    pairs = {p for ts in of.values() for p in combinations(sorted(ts), 2)}
    for a, b in pairs:
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for t, own in ids.items():
        least[find(t)] = min([least.get(find(t), own[0]), *own])
    return {i: least[find(t)] for t, own in ids.items() for i in own}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_classes_are_those_of_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in found} == classes(docs.collect())
    assert all(r.kept == (r.doc_id == r.class_id) for r in found)


def test_chains_and_large_groups(spark):
    """Copies of copies, of which the ends differ, and one text with many near copies."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(8):
        rows.append((k, " ".join(f"c{k}" if i < 3 * k else w for i, w in enumerate(base))))
    for k in range(60):
        other = [f"v{i}" for i in range(150)]
        other[2 * k % 150] = f"x{k}"
        rows.append((100 + k, " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(docs).collect()} == classes(docs.collect())


def test_texts_that_repeat_shingles_differently(spark):
    """Their set Jaccard is 0.8 or more, their probability Jaccard far lower."""
    rows = []
    for k in range(40):
        line = " ".join(f"r{k}x{i}" for i in range(30)) + " "
        own = " ".join(f"o{k}x{i}" for i in range(70))
        rows += [(10 * k, line * 50 + own), (10 * k + 1, line * 2 + own)]
        base = " ".join(f"b{k}x{i}" for i in range(100))
        extra = " ".join(f"e{k}x{i}" for i in range(16)) + " "
        rows += [(10 * k + 4, base), (10 * k + 5, f"{base} " + extra * 20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = classes(docs.collect())
    assert all(expected[10 * k + 1] == 10 * k and expected[10 * k + 5] == 10 * k + 4 for k in range(40))
    assert {r.doc_id: r.class_id for r in near_duplicates(docs).collect()} == expected


def test_components(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("z", "y")], "a string, b string")
    assert dict(components(links).collect()) == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("xyz", "x")}
    assert components(links.where("false")).count() == 0


def test_odd_documents(odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    of = {r.doc_id: r.class_id for r in rows if r.doc_id in (1, 2, 3, 4, 5)}
    assert of == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    kept = drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.where("doc_id = 1").count() == 1 and kept.where("doc_id in (2, 4)").count() == 0
    assert near_duplicates(no_docs).count() == 0 and drop_near_duplicates(no_docs).count() == 0
