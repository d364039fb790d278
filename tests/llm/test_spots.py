import hashlib
import os
from itertools import combinations

import pytest

from sitesignal.llm.bpe import Memory
from sitesignal.llm.spots import as_text, edited_fingerprints, fingerprints, likeness, near_pairs, spot_signatures, word_code

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_next_documents_and_edits(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
    found = {r.doc_id: r for r in edited_fingerprints(docs).collect()}
    assert len(found) == len(rows)
    words = Memory(word_code)
    for i, r in enumerate(rows):
        other, third = rows[(i + 1) % len(rows)].text, len(r.text) // 3
        edited = r.text[: len(r.text) - third] + other[:third]
        got, own = found[r.doc_id], spot_signatures(r.text, words)
        assert got.n_chars == len(r.text)
        assert got.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got.fingerprint == as_text(own)
        assert got.near_edited == likeness(own, spot_signatures(edited, words))
        assert got.near_next == likeness(own, spot_signatures(other, words))


def test_odd_documents(odd_docs, no_docs):
    assert edited_fingerprints(odd_docs).count() == odd_docs.count()
    assert edited_fingerprints(no_docs).count() == 0
    one = odd_docs.where("doc_id = 2")
    assert edited_fingerprints(one).first().near_next == 1.0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_near_pairs_are_those_of_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    prints = fingerprints(docs).cache()
    sets = {}
    for r in prints.collect():
        key = r.fingerprint
        sets[key] = min(sets.get(key, r.doc_id), r.doc_id)
    parts = {d: {k[i : i + 8] for i in range(0, len(k), 8)} for k, d in sets.items() if k}
    expected = {
        (min(a, b), max(a, b)) for a, b in combinations(parts, 2) if len(parts[a] & parts[b]) >= 0.8 * len(parts[a] | parts[b])
    }
    assert {(r.doc_a, r.doc_b) for r in near_pairs(prints).collect()} == expected
