import os
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from sitesignal.llm.simhash import fingerprint, fingerprints, linked, near_links, simhash_components

DATA = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{fingerprint: least of its component} by comparing all pairs."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 3:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in root}


def expected(rows):
    prints = [plain_fingerprint(r.text) for r in rows]
    root = plain_components(set(prints))
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r.doc_id is not None:
            least[root[p]] = min(least.get(root[p], r.doc_id), r.doc_id)
    return sorted(((r.doc_id, f"{p:016x}", least.get(root[p])) for r, p in zip(rows, prints, strict=True)), key=repr)


def test_fingerprints():
    for text in ["", " \t\n", "One", "two WORDS", "a b c d", "Ärger ÄRGER  x \x1cy", "x " * 70_000, "a b c"]:
        assert fingerprint(text.encode()) % (1 << 64) == plain_fingerprint(text)


def test_linked_groups_equal_brute_force():
    rng = np.random.default_rng(5)
    groups = []
    for size in (1, 2, 3, 63, 64, 65, 130, 700):
        prints = set()
        while len(prints) < size:
            p = int(rng.integers(0, 1 << 64, dtype=np.uint64)) if not prints or rng.random() < 0.3 else int(rng.choice(sorted(prints)))
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                p ^= 1 << int(b)
            prints.add(p)
        groups.append(sorted(prints))
    flat = np.array([p for g in groups for p in g], np.uint64)
    starts = np.cumsum([0] + [len(g) for g in groups[:-1]])
    labels = linked(flat, starts)
    for g, start in zip(groups, starts.tolist(), strict=True):
        root = plain_components(g)
        assert [int(flat[k]) for k in labels[start : start + len(g)]] == [root[p] for p in g]
    assert len(linked(np.zeros(0, np.uint64), np.zeros(0, np.int64))) == 0


def test_buckets_larger_than_a_slice(spark):
    """A third of all fingerprints in one bucket, which is dealt into slices."""
    rng = np.random.default_rng(6)
    prints = {(7 << 40) | int(x) for x in rng.integers(0, 1 << 12, 150)} | {int(x) for x in rng.integers(0, 1 << 63, 100)}
    table = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for slice_rows in (16, 4096):
        root.update({p: p for p in prints})
        links = near_links(table, slice_rows=slice_rows).collect()
        assert len(links) < 10 * 11 * len(prints)
        for a, b in links:
            root[max(find(a), find(b))] = min(find(a), find(b))
        assert {p: find(p) for p in prints} == plain_components(prints)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_components_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert sorted(map(tuple, simhash_components(docs).collect()), key=repr) == expected(docs.collect())


def test_a_large_group_of_copies(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join([*words[:k], f"x{k}", *words[k + 1 :]]) for k in range(0, 400, 4)] + [" ".join(words)] * 60 + [None] * 20
    docs = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert sorted(map(tuple, simhash_components(docs).collect()), key=repr) == expected(docs.collect())


def test_odd_documents(odd_docs, no_docs):
    odd = odd_docs.selectExpr("*", "'q' as fp", "'q' as component_id", "'q' as a", "'q' as k")
    assert sorted(map(tuple, simhash_components(odd).collect()), key=repr) == expected(odd_docs.collect())
    assert simhash_components(no_docs).count() == 0 and fingerprints(no_docs).count() == 0
