import os
import random
from collections import defaultdict

import pytest

from sitesignal.llm.linededup import dedup_lines

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, extra string"


def stretches(text, least=50):
    """All shortest stretches of lines with at least ``least`` words."""
    lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
    for i in range(len(lines)):
        words, j = 0, i
        while j < len(lines) and words < least:
            words += len(lines[j].split())
            j += 1
        if words >= least:
            yield tuple(lines[i:j])


def check(before, after):
    """Nothing of 50 words or more repeats; every removed line stays elsewhere; what did not repeat stays."""
    seen, lines = defaultdict(set), set()
    for r in after:
        lines |= {x.strip() for x in (r.text or "").split("\n")}
    repeated = defaultdict(int)
    for r in before:
        for s in stretches(r.text, 1):
            repeated[s[0]] += 1
    old = {(r.doc_id, i): r for i, r in enumerate(sorted(before, key=lambda r: (r.doc_id, r.text)))}
    new = sorted(after, key=lambda r: (r.doc_id, r.n_lines))
    assert len(old) == len(new)
    for r in before:
        assert all(x.strip() in lines for x in (r.text or "").split("\n") if x.strip())
    for r in after:
        for n, s in enumerate(stretches(r.text)):
            seen[s].add((r.doc_id, n))
    for s, places in seen.items():
        assert len(places) == 1, s


def make(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)


def test_shared_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = lambda n: " ".join(word() for _ in range(n))
    passage = [line(n) for n in (20, 3, 30, 1)]
    long = [line(60)]
    many = [line(2) for _ in range(60)]
    rows = []
    for i in range(40):
        own = [[line(rng.randint(1, 40)) for _ in range(4)] for _ in range(2)]
        shared = [passage, long, many, [], [line(4), "", line(9)]][i % 5]
        rows.append((i, "\n".join(own[0] + shared + own[1])))
    before = make(spark, rows)
    after = dedup_lines(before).collect()
    check(before.collect(), after)
    texts = {r.doc_id: r for r in after}
    for i, text in rows:
        if i < 5 or i % 5 > 2:
            assert texts[i].text == text and texts[i].removed_lines == []
        else:
            n = len([passage, long, many][i % 5])
            assert texts[i].removed_lines == list(range(4, 4 + n))


def test_odd_documents(odd_docs, no_docs):
    out = dedup_lines(odd_docs)
    assert set(odd_docs.columns) <= set(out.columns) and out.count() == odd_docs.count()
    rows = out.where("doc_id = 3 or doc_id is null and n_chars is null").collect()
    assert all(r.text is None and r.n_lines == 0 for r in rows)
    assert all(r.removed_lines == [] for r in out.where("doc_id = 1").collect())
    assert dedup_lines(no_docs).count() == 0


def test_a_copy_becomes_empty(spark):
    text = "\n".join(f"line {i} " + "word " * 12 + str(i * i) for i in range(9))
    out = {r.doc_id: r.text for r in dedup_lines(make(spark, [(2, text), (1, text)])).collect()}
    assert out == {1: text, 2: ""}


def places_before(rows):
    """For each document, for each line, the most words of a run around it that an earlier place has too."""
    docs = [(i, [x.strip() for x in t.split("\n")]) for i, t in sorted(rows)]
    most = {i: [0] * len(lines) for i, lines in docs}
    for m, (i, lines) in enumerate(docs):
        for _, other in docs[: m + 1]:
            for shift in range(-len(lines), len(other)):
                if other is lines and shift >= 0:
                    continue
                at = 0
                while at < len(lines):
                    end = at
                    while end < len(lines) and 0 <= end + shift < len(other) and lines[end] == other[end + shift]:
                        end += 1
                    words = sum(len(x.split()) for x in lines[at:end])
                    for k in range(at, end):
                        most[i][k] = max(most[i][k], words)
                    at = max(end, at + 1)
    return most


def test_runs_go_in_full_whichever_place_has_most_of_them(spark):
    rng = random.Random(8)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows = []
    for case in range(150):
        passage = [line(10) for _ in range(7)]
        for k, part in enumerate([passage[:5], passage, passage]):
            rows.append((3 * case + k, "\n".join([line(5), *part, line(5)])))
    kept = {r.doc_id: r for r in dedup_lines(make(spark, rows)).collect()}
    assert all(kept[i].removed_lines == [[], [1, 2, 3, 4, 5], list(range(1, 8))][i % 3] for i in kept)


def test_equals_brute_force_on_cut_passages(spark):
    """Every line of a run of 50 words that occurred before goes; every line that goes is in one of 25."""
    rng = random.Random(9)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passages = [[line(rng.choice([1, 4, 9, 17])) for _ in range(20)] for _ in range(3)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(1, 3)):
            passage = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(passage) + 1), 2))
            text += [line(rng.randint(1, 9)), *passage[a:b]]
        rows.append((i, "\n".join(text)))
    most = places_before(rows)
    full = 0
    for r in dedup_lines(make(spark, rows)).collect():
        gone = set(r.removed_lines)
        assert {k for k, words in enumerate(most[r.doc_id]) if words >= 50} <= gone
        assert all(most[r.doc_id][k] >= 25 for k in gone)
        full += len(gone)
    assert full > 300


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    check(docs.collect(), dedup_lines(docs).collect())
