"""Document fingerprints by chains of content words behind common words (SpotSigs)."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesignal.llm.bpe import Memory
from sitesignal.llm.common import map_batches, slices

#: Common words of the languages in question; they mark the spots.
ANCHORS = frozenset(
    "a an and are as at be by for from has have in is it of on or that the this to was were with "
    "aber als auf aus das dem den der des die ein eine er es im ist mit nicht sich sie und von zu "
    "au aux avec dans du elle en est et il la le les ne pas pour que qui sur un une "
    "al con del el las lo los no para por se su una y".split()
)
SIGNS = "\"'.,;:!?()[]{}<>|/\\-_*#$%&+=~`^@«»“”‘’…–—"
CHAIN = 3
GAP = 16
BLOCKS = 4096


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def word_code(word: str) -> int:
    """A hash of the word without outer signs, lowest bit set for anchors; 0 for signs alone."""
    bare = word.strip(SIGNS)
    if not bare:
        return 0
    return (_hash(bare.encode("utf-8", "surrogatepass")) & ~1) | (bare in ANCHORS)


def spot_signatures(text: str, words: Memory) -> np.ndarray:
    """The sorted set of a whole text's signatures, as 32-bit hashes.

    A signature is a spot and the ``CHAIN`` content words behind it. A spot is a
    common word or, where none came for 16 words, a word picked by its
    hash. A text without a spot has the one signature of its words, or of its
    signs; an empty text has none.
    """
    split = text.lower().split()
    code = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    code = code[code != 0]
    anchor = (code & np.uint64(1)).astype(bool)
    at = np.arange(len(code))
    last = np.maximum.accumulate(np.where(anchor, at, -GAP)) if len(code) else at
    picked = ~anchor & (at - last >= GAP) & ((code >> np.uint64(7)) % np.uint64(8) == 0)
    spots = np.flatnonzero(anchor | picked)
    if not len(spots):
        whole = code.tobytes() or text.encode("utf-8", "surrogatepass")
        return np.array([zlib.crc32(whole)] if whole else [], np.uint32)
    content = np.concatenate((code[~anchor], np.zeros(CHAIN, np.uint64)))
    behind = np.cumsum(~anchor)[spots]  # content words up to and with the spot
    mixed = code[spots]
    for k in range(CHAIN):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + content[behind + k]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sorted sets; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(signatures: np.ndarray) -> str:
    """Eight hexadecimal digits for each signature, in order."""
    return signatures.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of each whole text (null: empty), row by row."""

    def prepare():
        words = Memory(word_code)

        def step(part):
            return [part["doc_id"], [as_text(spot_signatures(t or "", words)) for t in part["text"]]]

        return step

    return map_batches(
        docs.select("doc_id", "text"), prepare, [("doc_id", "bigint"), ("fingerprint", "string")]
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has its last third (floor of code points) replaced by the
    start of the next document's text, by descending doc_id; after the last
    comes the first. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The order is cut at quantiles of the ids into blocks; each block's first
    document is also sent to the block before, so that every document meets its
    next one in one shuffle of the texts. Null texts are empty. A null doc_id
    comes last; rows of one id follow each other by a hash of their text, of
    which equal rows are interchangeable; a single document is its own next; an
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", text.alias("text"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("at")
    )
    n = min(BLOCKS, slices(spark))
    cuts = rows.agg(F.percentile_approx("at", [i / n for i in range(1, n + 1)], 50 * n), F.max("at")).first()
    bounds = np.array(sorted({*(cuts[0] or []), *([] if cuts[1] is None else [cuts[1]])}), np.int64)
    blocks = max(1, len(bounds))

    @F.pandas_udf("int")
    def block(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, at.to_numpy(), side="left"))

    @F.pandas_udf("boolean")
    def starts(at: pd.Series) -> pd.Series:
        return pd.Series(np.isin(at.to_numpy(), bounds))

    own = F.struct(F.col("block"), F.lit(False).alias("tail"))
    copy = F.struct(((F.col("block") + 1) % blocks).alias("block"), F.lit(True).alias("tail"))
    rows = (
        rows.withColumns({"block": block("at"), "starts": starts("at")})
        .withColumn("to", F.explode(F.when(F.col("starts"), F.array(own, copy)).otherwise(F.array(own))))
        .select("to.block", "to.tail", "at", "doc_id", "text")
        .repartition(blocks, "block")
        .sortWithinPartitions("block", "tail", F.desc("at"), F.xxhash64("text"))
        .select("block", "tail", "doc_id", "text")
    )

    def prepare():
        words = Memory(word_code)
        before = []  # the last document of the block at hand, which still lacks its next

        def step(part):
            out = [[] for _ in range(7)]
            for to, tail, doc_id, text in zip(*(part[c] for c in ("block", "tail", "doc_id", "text")), strict=True):
                signs = spot_signatures(text, words)
                if before and before[0][0] == to:
                    _, its_id, its_text, its = before.pop()
                    third = len(its_text) // 3
                    edited = its_text[: len(its_text) - third] + text[:third]
                    new = spot_signatures(edited, words)
                    row = (
                        its_id,
                        len(its_text),
                        hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                        as_text(its),
                        as_text(new),
                        likeness(its, new),
                        likeness(its, signs),
                    )
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                if not tail:
                    before[:] = [(to, doc_id, text, signs)]
            return out

        return step

    columns = [
        ("doc_id", "bigint"),
        ("n_chars", "bigint"),
        ("edited_sha256", "string"),
        ("fingerprint", "string"),
        ("edited_fingerprint", "string"),
        ("near_edited", "double"),
        ("near_next", "double"),
    ]
    return map_batches(rows, prepare, columns, rows=256)


def near_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of different fingerprints with a Jaccard of at least ``threshold``.

    Takes doc_id and fingerprint; returns doc_a < doc_b, each the smallest id of
    its fingerprint, and likeness. Sets are partitioned by length so that only
    neighbouring partitions can hold a pair; within them only the rarest
    signatures of each set, enough that no pair can miss, are joined, lengths
    prune, and the rest is compared in full. Empty fingerprints have no pair.
    """
    sets = (
        prints.where(F.length("fingerprint") > 0)
        .groupBy("fingerprint")
        .agg(F.min("doc_id").alias("doc"))
        .withColumn("signs", F.expr("transform(sequence(1, length(fingerprint), 8), i -> substring(fingerprint, i, 8))"))
        .select("doc", "signs", F.size("signs").alias("n"))
    )
    signs = sets.select("doc", "n", F.explode("signs").alias("sign"))
    signs = signs.join(signs.groupBy("sign").agg(F.count("*").alias("df")), "sign").where(F.col("df") > 1)
    rarest = Window.partitionBy("doc").orderBy("df", "sign")
    unique = F.col("n") - F.count("*").over(Window.partitionBy("doc"))  # these come first and match nothing
    head = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    signs = signs.withColumn("r", F.row_number().over(rarest) + unique).where(F.col("r") <= head)
    part = F.floor(F.log("n") / F.log(F.lit(1 / threshold))).cast("int")
    left = signs.select(F.col("doc").alias("a"), F.col("n").alias("na"), "sign", F.explode(F.array(part, part + 1)).alias("part"))
    right = signs.select(F.col("doc").alias("b"), F.col("n").alias("nb"), "sign", part.alias("part"))
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = (
        left.join(right, ["part", "sign"])
        .where(ordered & (F.col("na") >= F.lit(threshold) * F.col("nb") - 1e-9))
        .select("a", "b")
        .distinct()
    )
    a, b = (sets.select(F.col("doc").alias(x), F.col("signs").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .withColumn("likeness", both / (F.size("sa") + F.size("sb") - both))
        .where(F.col("likeness") >= threshold)
        .select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "likeness")
    )
