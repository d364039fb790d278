import os

import pytest

from sitesignal.llm.langid import fit, identify, predict

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = out.selectExpr("sum(int(lang = lang_pred))", "count(*)").first()
    assert n > 150 and right / n > 0.97


def test_odd_documents(odd_docs, no_docs):
    model = fit(odd_docs)
    rows = predict(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.lang_pred in {"en", "fr", "und"}
    by_text = [r for r in rows if r.doc_id in (3, 4, 5)]
    assert {r.lang_pred for r in by_text} == {"und"} and all(r.rejected for r in by_text)
    assert identify(odd_docs).count() == odd_docs.count() and identify(no_docs).count() == 0
    assert {r.lang_pred for r in predict(odd_docs, fit(no_docs)).collect()} == {"und"}
