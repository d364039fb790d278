import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitesignal.llm.mixing import mix
from sitesignal.llm.neardup import drop_near_duplicates
from sitesignal.llm.rules import judge
from tests.llm.test_linededup import check as check_lines
from tests.llm.test_neardup import classes
from tests.llm.test_rules import measure

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_each_stage_over_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        kept[name] = docs
    names = list(kept)
    assert names == ["quality rules", "line dedup", "near dedup", "mixing", "packing"]
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    assert all(kept[n].columns == source.columns for n in names[:-1])

    passed = kept["quality rules"].collect()
    assert all(not measure(r.text)[5] for r in passed) and 0.7 * source.count() < len(passed) < source.count()

    deduped = kept["line dedup"].collect()
    assert {r.doc_id for r in deduped} <= {r.doc_id for r in passed} and all(r.n_chars == len(r.text) for r in deduped)
    check_lines([r for r in passed if r.doc_id in {d.doc_id for d in deduped}], [_lines(r) for r in deduped])

    found = classes(deduped)
    assert Counter(r.doc_id for r in kept["near dedup"].collect()) == Counter(set(found.values()))

    mixed = mix(kept["near dedup"]).where("sampled")
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in kept["mixing"].collect()}
    packed = kept["packing"].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept["mixing"].collect()}


class _lines:
    def __init__(self, row):
        self.doc_id, self.text, self.n_lines = row.doc_id, row.text, 0


def test_odd_documents(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, None)
            if name != "packing":
                assert out.columns == docs.columns
            assert out.count() <= max(1, docs.count()) * 500


INTERNAL = (
    *("__p", "__r", "__s", "__w", "__source", "__lang", "__topic", "__weight", "__docs", "__rep", "__tid", "__key", "__runs"),
    *("_t", "_b", "_w", "_l", "_h", "_g", "_s", "_p", "rest0", "rest1", "a.b"),
)
RESULTS = ("kept", "n_words", "failed_rules", "n_lines", "removed_lines", "topic", "weight", "p", "sampled", "class_id", "tid")


def with_names(docs, names):
    return docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names])


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "packing"], ids=lambda s: s[0])
def test_columns_of_any_name_keep_their_values(spark, odd_docs, stage):
    names = INTERNAL + RESULTS
    text = " ".join(f"the tale{i} and song{i} of town{i}" for i in range(20))
    good = spark.createDataFrame([(90, text, "en", "s0", len(text))], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    some = odd_docs.select(good.columns).union(good)
    plain, docs = with_names(some, ()), with_names(some, names)
    out = stage[1](spark, docs, None)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[n] == f"{n} of {'-' if r.doc_id is None else r.doc_id}" for r in rows for n in names)
    key = lambda r: repr(tuple(r)[:5])
    assert sorted(map(key, rows)) == sorted(map(key, stage[1](spark, plain, None).collect())) and rows


def test_operators_keep_columns_that_are_named_like_their_own(odd_docs):
    docs = with_names(odd_docs, INTERNAL)
    for out, added in ((mix(docs), 4), (judge(docs), 13), (drop_near_duplicates(docs), 0)):
        assert out.columns[: len(docs.columns)] == docs.columns and len(out.columns) == len(docs.columns) + added
        assert all(r[n] == f"{n} of {'-' if r.doc_id is None else r.doc_id}" for r in out.collect() for n in INTERNAL)
