import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sitesignal.llm import divergence
from sitesignal.llm.divergence import billionths, merged_stripes, source_divergence, stripes, terms

DATA = "/root/testdata/sf0.001"
COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def plain_terms(text):
    found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in found]


def brute_force(rows):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for r in rows:
        lang, source, found = r.lang or "", r.source or "", plain_terms(r.text)
        groups[lang].add(source)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        sizes = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (sizes[s] + len(kept)) for t in kept} for s in sources}
        whole = sum(sizes.values())
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 1) // (whole + len(kept)) for t in kept}
        for s in sources:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, 200)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def found(docs):
    return sorted(tuple(r[c] for c in COLUMNS) for r in source_divergence(docs).collect())


def test_terms():
    for text in ["", "a1B_c-Dé ÄÖ x y", "don't STOP\t\n", "日本 語A", "@[`{~\x7f\x80"]:
        assert [t.decode() for t in terms(text.encode())] == plain_terms(text)


def test_billionths_are_exact():
    rng = np.random.default_rng(1)
    whole = rng.integers(1, 8 * 10**15, 1000)
    part = np.minimum(whole, rng.integers(0, 8 * 10**15, 1000))
    assert billionths(part, whole).tolist() == [10**9 * int(a) // int(b) for a, b in zip(part, whole, strict=True)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    expected = brute_force(docs.collect())
    assert found(docs) == expected
    assert dict(source_divergence(docs).dtypes) == {c: "bigint" if c == "value" else "int" if c == "rank" else "string" for c in COLUMNS}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_parts_and_blocks_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'de'")
    monkeypatch.setattr(divergence, "TERMS_AT_ONCE", 40)
    before = divergence.divergences_of_part

    def in_small_blocks(stripes, totals):
        divergence.NUMBERS_AT_ONCE = 25
        return before(stripes, totals)

    monkeypatch.setattr(divergence, "divergences_of_part", in_small_blocks)
    assert found(docs) == brute_force(docs.collect())


def test_spills_are_merged(spark):
    rows = [("en", f"s{i % 7}", f"common w{i % 50} x{i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    docs = docs.selectExpr("lang", "source", "cast(text as binary) as text").repartition(3)
    spilled = stripes(docs, cells=30)
    assert spilled.where("term = 'common'").count() > 20
    got = {r.term.decode(): (r.df, dict(zip(r.sources, r.counts, strict=True))) for r in merged_stripes(spilled).collect()}
    assert set(got) == {"common", "w", "x"}
    assert got["common"] == (600, dict(Counter(f"s{i % 7}" for i in range(600))))


def test_a_source_and_a_term_with_most_rows(spark):
    rows = [("en", "hot" if i % 3 else f"s{i % 5}", "the the " + f"{chr(97 + i % 20)}x {chr(97 + i % 7)}é") for i in range(900)]
    rows += [("xx", "only", "no kept terms"), ("yy", "a", None), ("yy", "b", "")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    expected = brute_force(docs.collect())
    assert ("yy", "a", "pair", "b", 0, 1) in expected and not [r for r in expected if r[0] == "xx"]
    assert found(docs) == expected


def test_odd_documents(odd_docs, no_docs):
    odd = odd_docs.selectExpr("*", "'q' as term", "'q' as df", "'q' as value", "'q' as slot", "'q' as v")
    assert found(odd) == brute_force(odd_docs.collect())
    assert found(no_docs) == []
