"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.llm.bpe import Memory
from sitesignal.llm.common import folds, map_batches, settle
from sitesignal.llm.spots import SIGNS

BUCKETS = 1 << 18
#: Terms in fewer labelled texts can show nothing beyond chance.
LEAST_DOCS = 10
#: Twice the log-likelihood ratio; chance alone gets there once in 400,000 terms.
LEAST_EVIDENCE = 22.0
SAMPLE_ROWS = 20_000
FACTORS = 6
STEPS = 300
RATE = 0.1
PENALTY = 2e-4
#: So many times dearer are factors: a pair is used for what the terms alone cannot say.
PAIR_PENALTY = 20
#: Evidence of a pair in standard deviations; chance alone gets there once in 25 million pairs.
PAIR_EVIDENCE = 5.5
#: Share of a direction from which the pairs of a term are tested, and turns of the iteration.
STANDS_OUT = 0.005
TURNS = 30
START = 0.5
FLAG_FROM = 0.7


def bucket(word: str) -> int:
    """The hash bucket of a word in lower case without outer signs; -1 for signs alone."""
    bare = word.lower().strip(SIGNS)
    if not bare:
        return -1
    return int.from_bytes(hashlib.blake2b(bare.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % BUCKETS


def text_buckets(text: str, memory: Memory) -> np.ndarray:
    """The distinct buckets of a whole text."""
    words = text.split()
    found = np.unique(np.fromiter(map(memory.__getitem__, words), np.int64, len(words)))
    return found[found >= 0]


class Rows:
    """Sorted distinct columns of each row, end to end; column ``width`` stands for none, so no row is empty."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.width = width
        parts = [np.append(r, width) for r in rows]
        self.at = np.concatenate([*parts, np.empty(0, np.int64)]).astype(np.int64)
        self.ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        self.starts = np.concatenate((np.zeros(1, np.int64), self.ends[:-1])) if len(parts) else self.ends

    def __len__(self) -> int:
        return len(self.ends)

    def take(self, chosen: np.ndarray) -> Rows:
        out = Rows([], self.width)
        sizes = self.ends[chosen] - self.starts[chosen]
        out.ends = np.cumsum(sizes)
        out.starts = out.ends - sizes
        out.at = self.at[np.repeat(self.starts[chosen] - out.starts, sizes) + np.arange(sizes.sum())]
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per row the sum of its columns' values (a row of values for each column, the last one 0)."""
        return np.add.reduceat(values[self.at], self.starts, axis=0)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Per column the sum of the values of the rows that have it."""
        of_row = np.repeat(np.arange(len(self)), self.ends - self.starts)
        out = np.stack([np.bincount(self.at, v[of_row], self.width + 1) for v in values.reshape(len(self), -1).T], axis=1)
        out[-1] = 0
        return out.reshape(self.width + 1, *values.shape[1:])

    def blocks(self, size: int = 2048):
        """The rows in blocks, each with its range."""
        for start in range(0, len(self), size):
            chosen = np.arange(start, min(start + size, len(self)))
            yield chosen, self.take(chosen)


class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of the products of their factors)."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(np.asarray(terms, np.int64))
        self.bias, self.weights = 0.0, np.zeros(len(terms) + 1)
        self.factors = np.zeros((len(terms) + 1, FACTORS))

    def columns(self, found: np.ndarray) -> np.ndarray:
        """Which of the terms are among sorted distinct buckets."""
        found = found[found <= self.terms[-1]] if len(self.terms) else found[:0]
        at = np.searchsorted(self.terms, found)
        return at[self.terms[at] == found]

    def logits(self, rows: Rows) -> np.ndarray:
        squares = rows.sums((self.factors**2).sum(axis=1))
        return self.bias + rows.sums(self.weights) + ((rows.sums(self.factors) ** 2).sum(axis=1) - squares) / 2

    def chances(self, rows: Rows) -> np.ndarray:
        parts = [self.logits(block) for _, block in rows.blocks()]
        return 1 / (1 + np.exp(-np.clip(np.concatenate([*parts, np.empty(0)]), -30, 30)))

    def loss(self, rows: Rows, y: np.ndarray, penalty: float) -> float:
        """The mean logistic loss and the penalties, which ``slopes`` derives."""
        z = self.logits(rows)
        fixed = (self.weights**2).sum() + PAIR_PENALTY * (self.factors**2).sum()
        return float((np.logaddexp(0, z) - y * z).mean() + penalty * fixed / 2)

    def slopes(self, rows: Rows, y: np.ndarray, penalty: float) -> list[np.ndarray]:
        """Derivatives of the loss by bias, weights and factors."""
        error = (1 / (1 + np.exp(-np.clip(self.logits(rows), -30, 30))) - y) / len(y)
        alone = rows.spread(error)
        pairs = rows.spread(error[:, None] * rows.sums(self.factors)) - alone[:, None] * self.factors
        return [error.sum(), alone + penalty * self.weights, pairs + PAIR_PENALTY * penalty * self.factors]

    def fit(
        self, rows: Rows, y: np.ndarray, factors: np.ndarray | None = None, steps: int = STEPS, penalty: float = PENALTY
    ) -> Machine:
        """Minimise the loss by Adam steps over blocks of the bounded sample.

        Factors start from ``factors``; without them, they stay 0 and the machine is linear.
        """
        rng = np.random.default_rng(7)
        self.bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        if not len(self.terms):
            return self
        if factors is not None:
            self.factors[:-1] = factors
        order, size = rng.permutation(len(y)), min(len(y), 2048)
        mean, spread = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
        for t in range(1, steps + 1):
            chosen = np.take(order, range((t - 1) * size, t * size), mode="wrap")
            moved = []
            for k, slope in enumerate(self.slopes(rows.take(chosen), y[chosen], penalty)):
                mean[k] = 0.9 * mean[k] + 0.1 * slope
                spread[k] = 0.99 * spread[k] + 0.01 * slope**2
                moved.append(RATE * (1 - t / (steps + 1)) * mean[k] / (1 - 0.9**t) / (np.sqrt(spread[k] / (1 - 0.99**t)) + 1e-8))
            self.bias -= float(moved[0])
            self.weights -= moved[1]
            if factors is not None:
                self.factors -= moved[2]
        return self

    def score(self, found: np.ndarray) -> float:
        at = self.columns(found)
        v = self.factors[at]
        pairs = ((v.sum(axis=0) ** 2) - (v**2).sum(axis=0)).sum() / 2
        z = self.bias + float(self.weights[at].sum()) + float(pairs)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def joint_terms(rows: Rows, y: np.ndarray, chances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns with a pair that speaks for the label beyond chance, and where all factors start.

    ``chances`` are what a linear machine says of the label ``y``. A pair's evidence is
    the sum of its errors over the rows that have both, over the root of the sum
    of their variances (those expected or those seen, if larger). The pairs are not counted one by one: the leading directions of the
    matrix of all pairs, scaled by the terms' frequencies, come from subspace
    iteration over the sparse rows. Every pair of a term that stands out in a
    direction with any other term is then tested.
    """
    n, width, error = len(rows), rows.width, y - chances
    variance = np.maximum(error**2, chances * (1 - chances))
    seen = rows.spread(np.ones(n))
    scale = 1 / np.sqrt(rows.spread(variance) + LEAST_DOCS * variance.mean() + 1e-12)
    scale[(seen < LEAST_DOCS) | (seen > n - LEAST_DOCS) & (seen < n)] = 0
    scale[-1] = 0
    own = rows.spread(error) * scale**2

    def times(v):
        out = -own[:, None] * v
        for at, block in rows.blocks():
            out += scale[:, None] * block.spread(error[at, None] * block.sums(scale[:, None] * v))
        return out

    rng = np.random.default_rng(11)
    v = np.linalg.qr(rng.normal(size=(width + 1, FACTORS)) * (scale > 0)[:, None])[0]
    shift = 0.0
    for turn in range(TURNS):
        moved = times(v)
        if turn < 5:  # the size of the largest eigenvalue of either sign
            shift = max(shift, float(np.linalg.norm(moved, axis=0).max()))
        v = np.linalg.qr(moved + (shift * v if turn >= 5 else 0))[0]
    strong = np.flatnonzero(((v**2).max(axis=1) >= STANDS_OUT) & (scale > 0))
    of_row = np.repeat(np.arange(n), rows.ends - rows.starts)
    by_column = np.argsort(rows.at, kind="stable")
    first = np.searchsorted(rows.at[by_column], np.arange(width + 2))
    chosen = np.zeros(width + 1, bool)
    for c in strong:
        having = of_row[by_column[first[c] : first[c + 1]]]
        part = rows.take(having)
        sums, expected = part.spread(error[having]), part.spread(variance[having])
        pairs = (np.abs(sums) >= PAIR_EVIDENCE * np.sqrt(expected)) & (expected > 0) & (scale > 0)
        pairs[c] = False
        chosen |= pairs
        chosen[c] |= pairs.any()
    return np.flatnonzero(chosen), v[:-1] / (np.abs(v).max() + 1e-12) * START


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Learn from documents with a non-null ``toxic`` label.

    Equal texts count once, with their mean label. Terms enter the machine that
    speak for or against the label beyond chance, counted over all labelled
    texts, or that do so together with another term, counted in the sample. The machine is fitted on
    at most ``sample_rows`` texts, those with the smallest hashes. With no labelled
    text the score is a constant.
    """
    labels = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # The labels grow with the documents, so they are never broadcast: one plan at every size.
    labelled = docs.select("doc_id", "text").join(labels.hint("merge"), "doc_id").select("text", "toxic")

    def prepare():
        memory = Memory(bucket)

        def step(part):
            texts = [t or "" for t in part["text"]]
            return [
                [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() for t in texts],
                [float(y > 0) for y in part["toxic"]],
                [text_buckets(t, memory) for t in texts],
            ]

        return step

    rows = map_batches(labelled, prepare, [("key", "string"), ("y", "double"), ("found", "array<int>")])
    rows = settle(rows.groupBy("key").agg(F.avg("y").alias("y"), F.min("found").alias("found")))
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not n:
        return Machine(np.array([]))
    seen = rows.select("y", F.explode("found").alias("term")).groupBy("term").agg(
        F.count("*").alias("n"), F.sum("y").alias("y")
    )
    rate = min(max(positive / n, 1e-6), 1 - 1e-6)
    hits, rest = F.col("y"), F.col("n") - F.col("y")
    evidence = 2 * (
        F.when(hits > 0, hits * F.log(hits / (F.col("n") * rate))).otherwise(0.0)
        + F.when(rest > 0, rest * F.log(rest / (F.col("n") * (1 - rate)))).otherwise(0.0)
    )
    seen = seen.where(F.col("n") >= LEAST_DOCS).select("term", (evidence >= LEAST_EVIDENCE).alias("speaks")).orderBy("term")
    seen = seen.toArrow()  # at most one row per bucket
    known, speaks = Machine(seen["term"].to_numpy()), seen["speaks"].to_numpy().astype(bool)

    share = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def keep():
        def step(part):
            found = [known.columns(np.asarray(f, np.int64)).astype("<i4").tobytes() for f in part["found"]]
            return [part["key"], part["y"], found]

        return step

    few = rows.where(share * F.lit(float(n)) < F.lit(float(sample_rows))) if n > sample_rows else rows
    columns = [("key", "string"), ("y", "double"), ("found", "binary")]
    sample = map_batches(few.select("key", "y", "found"), keep, columns).orderBy("key").limit(sample_rows)
    sample = sample.toArrow()  # at most sample_rows texts, 4 bytes for each of their distinct terms
    found = [np.frombuffer(f.as_py(), "<i4") for f in sample["found"]]
    return learn(known.terms, speaks, found, sample["y"].to_numpy())


def learn(terms: np.ndarray, speaks: np.ndarray, found: list[np.ndarray], y: np.ndarray) -> Machine:
    """A machine from the sample: the terms (``found`` has their numbers) that speak alone, then those that do in pairs."""

    def kept(numbers):
        machine, place = Machine(terms[numbers]), np.full(len(terms), -1)
        place[numbers] = np.arange(len(numbers))
        picked = [place[f] for f in found]
        return machine, Rows([p[p >= 0] for p in picked], len(numbers))

    alone, rows = kept(np.flatnonzero(speaks))
    chances = alone.fit(rows, y).chances(rows)
    partners, factors = joint_terms(Rows(found, len(terms)), y, chances)
    numbers = np.union1d(np.flatnonzero(speaks), partners)
    machine, rows = kept(numbers)
    return machine.fit(rows, y, factors[numbers])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and the score (0 to 1) of each whole text, row by row; null and empty texts have no terms."""

    def prepare():
        memory = Memory(bucket)

        def step(part):
            return [part["doc_id"], [machine.score(text_buckets(t or "", memory)) for t in part["text"]]]

        return step

    return map_batches(docs.select("doc_id", "text"), prepare, [("doc_id", "bigint"), ("score", "double")])


def rate(docs: DataFrame, labels: DataFrame, every: int = 3, held: int = 1) -> DataFrame:
    """Learn from labelled rows outside fold ``held``, score all documents.

    Columns: doc_id, held_out, score, predicted (1 from a score of 0.7 on). The
    fold is crc32 of the decimal doc_id modulo ``every``; rows with a null id
    are not learned from and not held out. Repeated rows are scored one by one;
    several labels of one id count as toxic if one is; labels without a
    document are passed over; an empty table gives an empty one.
    """
    learn = docs.select("doc_id", "text").where(folds("doc_id", every) != held)
    out = score(docs, fit(learn, labels))
    held_out = F.coalesce(folds("doc_id", every) == held, F.lit(False))
    return out.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= FLAG_FROM, 1).otherwise(0).alias("predicted"),
    )
