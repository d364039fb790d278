import os
import re
from collections import Counter

import pytest

from sitesignal.llm.rules import RULES, judge

DATA = "/root/testdata/sf0.001"


def measure(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {k for i, w in enumerate(windows) if n[w] > 1 for k in (i, i + 1, i + 2)}
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), base)


def check(docs):
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = judge(docs).collect()
    for r in rows:
        assert tuple(r[f] for f in fields) == measure(r.text), r.doc_id
        assert r.kept == (not r.failed_rules) and (not r.base_failed or not r.kept)
    return rows


def test_odd_documents(spark, odd_docs, no_docs):
    rows = check(odd_docs)
    assert len(rows) == odd_docs.count() and set(odd_docs.columns) <= set(rows[0].asDict())
    texts = ["a a a a", "a b c a b c", "x\ty\x0bz q\x1c r", "a b\n\na b\n \n", "😀 #é | <x>\r\n", " lead trail ", "f of\x0cfx f", "\x0c\x0b of \x0c", "a b a b a b", "one", "one two"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert judge(no_docs).count() == 0 and judge(odd_docs, RULES[:0]).where("kept").count() == odd_docs.count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    check(docs)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = judge(docs).join(labels, "doc_id").where("quality = 1 and n_words >= 50")
    assert good.where("kept").count() >= 0.97 * good.count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_equals_its_sql(spark):
    from checks.verify import compare, connect
    from sitesignal.llm.queries import LLM_ORACLE, LLM_QUERIES

    for name in LLM_ORACLE:
        assert compare(LLM_QUERIES[name](spark, DATA), connect(DATA), LLM_ORACLE[name]) is None
