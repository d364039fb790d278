"""Language identification by nearest centroid over n-gram vectors."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesignal.llm.common import folds, map_batches

DIMENSIONS = 8192
SAMPLE_PER_LANGUAGE = 400
CENTROIDS = 4
ROUNDS = 12
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """By code point: is it a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str) -> np.ndarray | None:
    """Hashed counts of letter n-grams (1 to 3, with word edges) of a whole text; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32).astype(np.uint32)
    edge = np.empty(len(codes) + 2, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = ~letter
    padded = np.full(len(codes) + 2, 32, np.uint32)
    padded[1:-1] = codes
    c = padded[~(edge & np.concatenate(([False], edge[:-1])))]  # runs of other signs become one edge
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ np.uint32(0x7F4A7C15)) + c[1:] * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ np.uint32(0x165667B1)) * np.uint32(5) + c[2:] * np.uint32(0xC2B2AE35)
    grams = np.concatenate((one[c != 32], two, three))
    grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.bincount(grams >> np.uint32(32 - 13), minlength=DIMENSIONS)


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return (v / max(float(np.sqrt(v @ v)), 1e-12)).astype(np.float32)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each n-gram bucket occurs, over all rows; and how many texts have a letter."""

    def run(batches):
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                counts = ngram_counts(text.as_py() or "")
                if counts is not None:
                    seen += counts > 0
                    n += 1
        import pyarrow as pa

        buckets = np.append(np.arange(DIMENSIONS), -1)
        yield pa.RecordBatch.from_pydict({"bucket": buckets, "n": np.append(seen, n)})

    rows = (
        docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    ).collect()  # as many as there are buckets
    found = {r["bucket"]: r["n"] for r in rows}
    return np.array([found.get(i, 0) for i in range(DIMENSIONS)], np.float64), found.get(-1, 0)


def cluster(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means with farthest-first starts; unit centroids."""
    centres = [vectors.mean(axis=0)]
    centres[0] /= max(np.linalg.norm(centres[0]), 1e-12)
    while len(centres) < min(k, len(vectors)):
        nearest = (vectors @ np.stack(centres).T).max(axis=1)
        centres.append(vectors[int(nearest.argmin())])
    c = np.stack(centres)
    for _ in range(ROUNDS):
        member = (vectors @ c.T).argmax(axis=1)
        for j in range(len(c)):
            own = vectors[member == j]
            if len(own):
                c[j] = own.mean(axis=0)
                c[j] /= max(np.linalg.norm(c[j]), 1e-12)
    return c


class LanguageModel:
    """Centroids with the language and the rejection limit of each."""

    def __init__(self, idf, centroids, languages, limits):
        self.idf, self.centroids = idf, centroids
        self.languages, self.limits = languages, limits

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = ngram_counts(text) if text else None
        if counts is None or not len(self.languages):
            return UNKNOWN, 0.0, True
        likeness = self.centroids @ vector(counts, self.idf)
        best = int(likeness.argmax())
        score = min(1.0, max(0.0, float(likeness[best])))
        return self.languages[best], score, score < self.limits[best]


def fit(
    docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS
) -> LanguageModel:
    """Learn from the rows with a ``lang``.

    Document frequencies cover all of them. The centroids come from at most
    ``per_language`` texts of each language, those with the smallest hashes of
    their ids; a document is rejected if it is farther from its centroid than
    nearly all (99.5 %) of that centroid's own texts by half of their likeness.
    The model's size follows the number of languages alone.
    """
    docs = docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    frequency, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + frequency)) + 1

    sizes = docs.groupBy("lang").agg(F.count("*").alias("n"))
    chance = (F.xxhash64("doc_id", F.lit(17)).bitwiseAND(F.lit(0xFFFFFFFF))) / F.lit(float(1 << 32))
    few = docs.withColumn("__u", chance).join(F.broadcast(sizes), "lang")
    few = few.where(F.col("__u") * F.col("n") < 2 * per_language)

    def vectors():
        def step(part):
            rows = [
                (lang, u, vector(c, idf).tobytes())
                for lang, u, text in zip(part["lang"], part["__u"], part["text"], strict=True)
                if (c := ngram_counts(text or "")) is not None
            ]
            return [list(column) for column in zip(*rows, strict=True)] or [[], [], []]

        return step

    few = map_batches(
        few.select("lang", "__u", "text"), vectors, [("lang", "string"), ("u", "double"), ("v", "binary")]
    )
    few = few.withColumn("__i", F.row_number().over(Window.partitionBy("lang").orderBy("u", "v")))
    few = few.where(F.col("__i") <= per_language)

    def clusters(rows: pd.DataFrame) -> pd.DataFrame:
        v = np.stack([np.frombuffer(x, np.float32) for x in rows["v"]])
        c = cluster(v, centroids)
        likeness = v @ c.T
        member, nearest = likeness.argmax(axis=1), likeness.max(axis=1)
        limits = [float(np.quantile(nearest[member == j], 0.005)) / 2 if (member == j).any() else 0.0 for j in range(len(c))]
        return pd.DataFrame(
            {"lang": rows["lang"].iloc[0], "v": [x.astype(np.float32).tobytes() for x in c], "limit": limits}
        )

    rows = few.groupBy("lang").applyInPandas(clusters, "lang string, v binary, limit double").collect()
    rows.sort(key=lambda r: (r["lang"], r["v"]))
    matrix = np.stack([np.frombuffer(r["v"], np.float32) for r in rows]) if rows else np.zeros((0, DIMENSIONS))
    return LanguageModel(idf, matrix, [r["lang"] for r in rows], [r["limit"] for r in rows])


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (cosine to the nearest centroid) and rejected, row by row.

    Only the whole text is looked at. A null text, or one without a letter, is
    ``und`` with score 0, and so is every text if nothing was learned. A text far
    from all centroids keeps its nearest language and is marked as rejected.
    """

    def prepare():
        def step(part):
            found = [model.predict(t) for t in part["text"]]
            return [part["doc_id"], *([f[i] for f in found] for i in range(3))]

        return step

    columns = [("doc_id", "bigint"), ("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")]
    return map_batches(docs.select("doc_id", "text"), prepare, columns)


def identify(docs: DataFrame, every: int = 5) -> DataFrame:
    """Learn from the rows whose fold is not 0, predict all; adds held_out.

    The fold is crc32 of the decimal doc_id modulo ``every``; a row with a null
    id is never learned from and not held out.
    """
    docs = docs.select("doc_id", "text", "lang")
    model = fit(docs.where(folds("doc_id", every) != 0))
    out = predict(docs, model)
    held_out = F.coalesce(folds("doc_id", every) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
