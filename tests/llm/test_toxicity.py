import os
from itertools import combinations

import numpy as np
import pytest

from sitesignal.llm.toxicity import FACTORS, Machine, Rows, joint_terms, rate

DATA = "/root/testdata/sf0.01"


def texts(n, toxic, likely_a, likely_b):
    """Texts of 20 of 200 filler words and two words, one of them or none, with a label that only these two decide."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        a, b = rng.random() < likely_a, rng.random() < likely_b
        words = [f"filler{w}" for w in rng.integers(0, 200, 20)] + ["alpha"] * a + ["beta"] * b
        rows.append((i, " ".join(rng.permutation(words)), int(toxic(a, b))))
    return rows


@pytest.mark.parametrize(
    "toxic, likely_a, likely_b",
    [
        (lambda a, b: a != b, 0.5, 0.5),  # neither word says anything alone
        (lambda a, b: a and not b, 0.3, 0.5),
        (lambda a, b: a and b, 0.4, 0.4),
    ],
    ids=["exactly one of two", "insult unless", "insult with mention"],
)
def test_labels_by_two_words(spark, toxic, likely_a, likely_b):
    rows = texts(3000, toxic, likely_a, likely_b)
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    out = rate(table.drop("toxic"), table.drop("text")).join(table, "doc_id").where("held_out").collect()
    flagged, wanted = {r.doc_id for r in out if r.predicted}, {r.doc_id for r in out if r.toxic}
    assert len(wanted) > 100
    assert len(flagged & wanted) > 0.9 * len(wanted) and len(flagged & wanted) > 0.9 * len(flagged)


def random_machine(rng, terms):
    machine = Machine(np.arange(terms) * 3)
    machine.bias, machine.weights[:-1] = -0.3, rng.normal(size=terms)
    machine.factors[:-1] = rng.normal(0, 0.4, (terms, FACTORS))
    return machine


def plain_logit(machine, columns):
    pairs = sum(float(machine.factors[i] @ machine.factors[j]) for i, j in combinations(columns, 2))
    return machine.bias + sum(float(machine.weights[i]) for i in columns) + pairs


def test_scores_and_slopes_of_the_likelihood():
    rng = np.random.default_rng(2)
    machine = random_machine(rng, 7)
    sets = [np.flatnonzero(rng.random(7) < 0.5) for _ in range(30)] + [np.empty(0, np.int64)]
    rows, y = Rows(sets, 7), rng.integers(0, 2, 31).astype(float)
    want = np.array([plain_logit(machine, s) for s in sets])
    assert np.allclose(machine.logits(rows), want)
    assert np.allclose([machine.score(3 * s) for s in sets], 1 / (1 + np.exp(-want)))
    assert np.allclose(machine.loss(rows, y, 0), np.mean(np.log1p(np.exp(want)) - y * want))
    bias, weights, factors = machine.slopes(rows, y, 0.01)

    def change(array, at, step=1e-5):
        kept, losses = array[at], []
        for moved in (kept + step, kept - step):
            array[at] = moved
            losses.append(machine.loss(rows, y, 0.01))
        array[at] = kept
        return (losses[0] - losses[1]) / (2 * step)

    assert all(np.isclose(change(machine.weights, i), weights[i], atol=1e-7) for i in range(7))
    assert all(np.isclose(change(machine.factors, (i, k)), factors[i, k], atol=1e-7) for i in range(7) for k in range(FACTORS))
    assert np.isclose(bias, np.mean(1 / (1 + np.exp(-want)) - y))


def test_terms_that_speak_in_pairs():
    """The same terms as by testing every pair."""
    rng = np.random.default_rng(4)
    x = rng.random((4000, 40)) < 0.3
    y = np.where(x[:, 3] == x[:, 17], 0.1, 0.5) + np.where(x[:, 5] & x[:, 29], 0.4, 0.0)
    y = (rng.random(4000) < y).astype(float)
    chances = np.full(4000, y.mean())
    variance = np.maximum((y - chances) ** 2, chances * (1 - chances))
    want = set()
    for i, j in combinations(range(40), 2):
        both = x[:, i] & x[:, j]
        if abs((y - chances)[both].sum()) >= 5.5 * np.sqrt(variance[both].sum()):
            want |= {i, j}
    got, factors = joint_terms(Rows([np.flatnonzero(r) for r in x], 40), y, chances)
    assert {3, 17, 5, 29} <= want and set(got.tolist()) == want
    assert factors.shape == (40, FACTORS)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    out = rate(docs, labels).join(labels, "doc_id").join(docs, "doc_id").where("held_out and lang = 'en'")
    rows = out.select("toxic", "predicted").collect()
    flagged = [r for r in rows if r.predicted]
    toxic = [r for r in rows if r.toxic]
    assert flagged and sum(r.toxic for r in flagged) / len(flagged) > 0.9
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.6


def test_odd_documents(spark, odd_docs, no_docs):
    schema = "doc_id bigint, toxic int, text string"
    labels = spark.createDataFrame([(1, 1, "a"), (1, 0, "b"), (2, None, None), (None, 1, None), (6, 0, ""), (99, 1, "")], schema)
    rows = rate(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert rate(odd_docs, labels.where("false")).count() == odd_docs.count()
    assert rate(no_docs, labels).count() == 0
