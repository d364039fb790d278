import os

import duckdb
import pytest

from sitesignal.llm.mixing import DIMENSIONS, TEMPER, mix
from sitesignal.llm.queries import mixing_sql

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_kept_weight_has_the_target_shares(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mix(docs, sweeps=15).collect()
    total, mass = sum(r.weight for r in rows), sum(r.weight * r.p for r in rows)
    assert max(r.p for r in rows) == 1 and len(rows) == docs.count()
    for d in DIMENSIONS:
        seen, kept = {}, {}
        for r in rows:
            seen[r[d]] = seen.get(r[d], 0) + r.weight
            kept[r[d]] = kept.get(r[d], 0) + r.weight * r.p
        norm = sum((w / total) ** TEMPER for w in seen.values())
        for k, w in seen.items():
            assert abs(kept[k] / mass - (w / total) ** TEMPER / norm) < 5e-3
    assert abs(sum(r.weight for r in rows if r.sampled) / mass - 1) < 0.2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_given_targets(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mix(docs, {"lang": {"en": 0.25, "fr": 0.75}}, sweeps=15).collect()
    mass = {k: sum(r.weight * r.p for r in rows if r.lang == k) for k in ("en", "fr", "de")}
    assert mass["de"] == 0 and abs(mass["fr"] / mass["en"] - 3) < 0.05


def raked(rows, targets=None, sweeps=10):
    """p by cell, by plain loops."""
    names = [(r.source or "(none)", r.lang or "(none)", r.topic) for r in rows]
    w = {}
    for c, r in zip(names, rows):
        w[c] = w.get(c, 0) + r.weight
    w = {c: x for c, x in w.items() if x}
    total, want = sum(w.values()), []
    for i, d in enumerate(DIMENSIONS):
        sums = {}
        for c, x in w.items():
            sums[c[i]] = sums.get(c[i], 0) + x
        given = (targets or {}).get(d)
        shares = {k: given.get(k, 0) if given else (x / total) ** TEMPER for k, x in sums.items()}
        want.append({k: x / sum(shares.values()) for k, x in shares.items()})
    r = {c: x / total for c, x in w.items()}
    for _ in range(sweeps):
        for i in range(3):
            sums = {}
            for c, x in r.items():
                sums[c[i]] = sums.get(c[i], 0) + x
            r = {c: x * want[i][c[i]] / sums[c[i]] if sums[c[i]] else 0 for c, x in r.items()}
    f = {c: r[c] / w[c] for c in w}
    return [1 if not x.weight else f[c] / max(f.values()) for c, x in zip(names, rows)]


@pytest.mark.parametrize("few", [10_000, 7])
@pytest.mark.parametrize("targets", [None, {"source": {"s99": 0.5, "s0": 0.25, "(none)": 0.25}, "lang": {"l39": 0.5, "l0": 0.5}}])
def test_many_sources_and_languages(spark, few, targets):
    """More categories than were once kept apart, the lightest of which are named; both ways to rake."""
    rows = [(1000 * k + j, "x" * (4 * (100 - k) + 300 * (j % 3)), f"s{k}", f"l{(k + j) % 40}") for k in range(100) for j in range(6)]
    rows += [(10**6 + j, "y" * (30 + j), None, None if j % 2 else "l0") for j in range(8)]
    rows += [(10**7 + j, "y" * 90, f"s{99 * (j % 2)}", "l39" if j < 4 else "l0") for j in range(8)]
    rows += [(10**8, "", "s3", "l3"), (10**8 + 1, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    out = mix(docs, targets, few=few).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    assert [r.p for r in out] == pytest.approx(raked(out, targets), abs=1e-9)
    assert not targets or any(r.p > 0 and r.source == "s99" and r.weight for r in out)


def test_odd_documents(odd_docs, no_docs):
    out = mix(odd_docs)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and set(odd_docs.columns) <= set(out.columns)
    assert all(0 <= r.p <= 1 and r.p is not None for r in rows)
    assert all(r.sampled and r.p == 1 for r in rows if not r.text)
    assert mix(no_docs).count() == 0


def test_sql_of_null_categories_and_texts(odd_docs):
    columns = ["doc_id", "source", "lang", "topic", "weight", "p", "sampled"]
    documents = odd_docs.select("doc_id", "text", "lang", "source").toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    connection = duckdb.connect()
    connection.register("documents", documents)
    want = connection.sql(f"SELECT {', '.join(columns)} FROM ({mixing_sql()}) AS x").fetchall()
    got = mix(odd_docs).select(*columns).collect()

    def plain(rows):
        return sorted([(*r[:5], round(r[5], 7), r[6]) for r in map(tuple, rows)], key=repr)

    assert plain(got) == plain(want) and len(want) == odd_docs.count()
