"""Near-duplicates by ProbMinHash, banding and verification."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.llm.bpe import Memory
from sitesignal.llm.common import apart, arrow_rows, map_batches, settle, together
from sitesignal.llm.spots import SIGNS

WIDTH = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 20, 5
REGISTERS = BANDS * BAND_ROWS
PAIRS_AT_ONCE = 256
NO_ID = (1 << 63) - 1

_U = np.uint64


def word_code(word: str) -> int:
    """A hash of the word without outer signs; 0 for signs alone."""
    bare = word.strip(SIGNS)
    if not bare:
        return 0
    return int.from_bytes(hashlib.blake2b(bare.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str, words: Memory) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of a whole text's word shingles, and how often each occurs.

    A text of fewer words has the one shingle of all of them; one without words has none.
    """
    split = text.lower().split()
    code = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    code = code[code != 0]
    if not len(code):
        return code, code
    width = min(WIDTH, len(code))
    h = code[: len(code) - width + 1]
    for k in range(1, width):
        h = mix64(h) + code[k : len(code) - width + 1 + k]
    return np.unique(mix64(h), return_counts=True)


def prob_min_hash(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """Signatures of weighted sets (elements, weights): the share of equal registers estimates probability Jaccard.

    Each element arrives by a Poisson process with its weight as the rate, at a
    register drawn for each arrival; a register holds the element of its first
    arrival. An element is done when its next arrival comes after the last
    register's, so most elements of a large set arrive once.
    """
    sizes = [len(e) for e, _ in sets]
    held = np.zeros(len(sets) * registers, np.uint64)
    times = np.full(len(sets) * registers, np.inf)
    if not sum(sizes):
        return held.reshape(-1, registers)
    owner = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate([e for e, _ in sets]).astype(np.uint64)
    rate = np.concatenate([w for _, w in sets]).astype(np.float64)
    time, state = np.zeros(len(element)), element.copy()
    while len(element):
        state = mix64(state + _U(0x9E3779B97F4A7C15))
        time = time - np.log(((state >> _U(11)).astype(np.float64) + 0.5) / 2.0**53) / rate
        at = owner * registers + (mix64(state ^ _U(0xD6E8FEB86659FD93)) % _U(registers)).astype(np.int64)
        np.minimum.at(times, at, time)
        won = times[at] == time
        held[at[won]] = element[won]
        last = times.reshape(-1, registers).max(axis=1)
        on = time < last[owner]
        owner, element, rate, time, state = owner[on], element[on], rate[on], time[on], state[on]
    return held.reshape(-1, registers)


def weights(counts: np.ndarray) -> np.ndarray:
    """A shingle's weight: 1 and the logarithm of how often it occurs."""
    return 1 + np.log(np.maximum(counts, 1))


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    bands = signatures.reshape(len(signatures), BANDS, BAND_ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2]).copy()
    for k in range(BAND_ROWS):
        key = mix64(key * _U(31) + bands[:, :, k])
    return key.view(np.int64)


def text_bands(sets: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The distinct band keys of each shingle set (elements, counts); none for an empty one.

    A set with a repeated shingle has the bands of its weights and those of equal
    weights, from the same arrivals. Links are decided by plain Jaccard, which equal
    weights estimate; without repeats both are the same, so all texts meet in them.
    """
    keys = [[k] if len(e) else [] for k, (e, _) in zip(band_keys(prob_min_hash([(e, weights(c)) for e, c in sets])), sets, strict=True)]
    repeats = [i for i, (_, c) in enumerate(sets) if (c > 1).any()]
    plain = band_keys(prob_min_hash([(sets[i][0], np.ones(len(sets[i][0]))) for i in repeats]))
    for i, k in zip(repeats, plain, strict=True):
        keys[i].append(k)
    return [np.unique(np.concatenate(k)) if k else np.zeros(0, np.int64) for k in keys]


def text_id(column: str = "text"):
    return F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary"))


def banded_texts(docs: DataFrame) -> DataFrame:
    """One row per different text: tid, rep (its smallest doc_id) and the band keys."""

    def prepare():
        memory = Memory(word_code)

        def step(part):
            sets = [shingles(t or "", memory) for t in part["text"]]
            return [part["rep"], part["tid"], text_bands(sets)]

        return step

    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("rep"), text_id().alias("tid"), "text")
    rows = map_batches(rows, prepare, [("rep", "bigint"), ("tid", "string"), ("bands", "array<bigint>")])
    return rows.groupBy("tid").agg(F.min("rep").alias("rep"), F.min("bands").alias("bands"))


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """tid and the sorted shingle hashes (binary) of the wanted texts (tid, rep)."""

    def prepare():
        memory = Memory(word_code)
        return lambda part: [part["tid"], [shingles(t or "", memory)[0].tobytes() for t in part["text"]]]

    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("rep"), text_id().alias("tid"), "text")
    rows = rows.join(wanted, ["tid", "rep"], "left_semi").select("tid", "text")
    rows = map_batches(rows, prepare, [("tid", "string"), ("shingles", "binary")], rows=128)
    return rows.groupBy("tid").agg(F.min("shingles").alias("shingles"))


def shared_shingles(sets: DataFrame) -> DataFrame:
    """tid, n (its shingles) and shared: how many of them another of the texts has too.

    Two texts have at most the smaller ``shared`` in common.
    """

    def prepare():
        def step(part):
            shingles = [np.frombuffer(s, np.int64) for s in part["shingles"]]
            return [part["tid"], shingles]

        return step

    rows = map_batches(sets, prepare, [("tid", "string"), ("all", "array<bigint>")], rows=128)
    single = rows.select("tid", F.explode("all").alias("shingle")).groupBy("shingle")
    single = single.agg(F.count("*").alias("texts"), F.min("tid").alias("tid")).where(F.col("texts") == 1)
    own = single.groupBy("tid").agg(F.count("*").alias("own"))
    sizes = sets.select("tid", (F.octet_length("shingles") / 8).cast("bigint").alias("n"))
    return sizes.join(own, "tid", "left").select(
        "tid", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared")
    )


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard of at least ``threshold``."""

    def prepare():
        def jaccard(x, y):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                return 0.0
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both / (len(x) + len(y) - both)

        def step(part):
            return [part["a"], part["b"], [jaccard(x, y) for x, y in zip(part["sa"], part["sb"], strict=True)]]

        return step

    a, b = (sets.select(F.col("tid").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    rows = pairs.join(b, "b").join(a, "a").select("a", "b", "sa", "sb")
    rows = map_batches(rows, prepare, [("a", "string"), ("b", "string"), ("jaccard", "double")], rows=128)
    return rows.where(F.col("jaccard") >= threshold)


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of all nodes that have a link (a, b).

    Alternating stars: every node points its larger neighbours, then itself and its
    smaller ones, to the smallest it knows, until nothing changes. Each round is
    written, and a node's neighbours are only ever reduced to their minimum.
    """
    links = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        links = settle(small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select("root", "root").toDF("node", "root").distinct())


def text_classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """See ``_text_classes``; rows with two shingle sets travel in small batches."""
    with arrow_rows(docs.sparkSession, PAIRS_AT_ONCE):
        return _text_classes(docs, threshold)


def _text_classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Classes of different texts: (tid, rep, root) of those in a class of several texts, and all texts.

    Texts that share a band form a bucket. Its pivot is the text with the most
    company in all its buckets; every member is verified against the pivot.
    Only the members that are not in their pivot's class after that are compared
    with the rest of their bucket, as far as it is in other classes, and as far
    as the shingles that each of the two shares with any text there allow the
    threshold. So no link that decides a class is missed, and a large group of
    copies costs about one comparison each.
    """
    texts = settle(banded_texts(docs))
    spread = texts.select("tid", F.explode("bands").alias("band"))
    sizes = spread.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    members = settle(spread.join(sizes, "band"))
    company = members.groupBy("tid").agg(F.sum("n").alias("company"))
    ranked = members.join(company, "tid")
    pivots = ranked.groupBy("band").agg(F.max(F.struct("company", "tid"))["tid"].alias("pivot"))
    members = settle(members.join(pivots, "band").select("band", "tid", "pivot"))
    wanted = members.select("tid").distinct().join(texts.select("tid", "rep"), "tid")
    sets = settle(shingle_sets(docs, wanted))

    first = members.where(F.col("tid") != F.col("pivot")).select(F.col("tid").alias("a"), F.col("pivot").alias("b"))
    links = settle(verified(first.distinct(), sets, threshold).select("a", "b"))
    roots = settle(components(links))

    def with_root(df, column, name):
        found = roots.select(F.col("node").alias(column), F.col("root").alias("__root"))
        return df.join(found, column, "left").withColumn(name, F.coalesce("__root", column)).drop("__root")

    members = settle(with_root(with_root(members, "tid", "root"), "pivot", "pivot_root"))
    rest = members.where(F.col("root") != F.col("pivot_root"))
    open_bands = members.join(rest.select("band").distinct(), "band", "left_semi")
    sizes = settle(shared_shingles(sets.join(open_bands.select("tid").distinct(), "tid", "left_semi")))

    def sized(df, x):
        df = df.join(sizes, "tid").join(texts.select("tid", "bands"), "tid")
        return df.select(
            *(F.col(c).alias(f"{c}_{x}") for c in ("band", "tid", "root", "n", "shared", "bands", "open"))
        )

    # ``open``: the bands in which a text is left over. A pair is looked at once, in
    # the first open bucket that it shares, from the smaller side if both are left over.
    where_left = settle(rest.groupBy("tid").agg(F.collect_set("band").alias("open")))
    others = open_bands.where(F.col("tid") != F.col("pivot")).join(where_left, "tid", "left")
    possible = F.least("shared_a", "shared_b") * (1 + threshold) >= threshold * (F.col("n_a") + F.col("n_b")) - 1e-6
    other_side = F.coalesce(F.arrays_overlap("open_b", "bands_a"), F.lit(False))
    second = sized(rest.join(where_left, "tid"), "a").join(
        sized(others, "b"),
        (F.col("band_a") == F.col("band_b"))
        & (F.col("root_a") != F.col("root_b"))
        & possible
        & ((F.col("tid_a") < F.col("tid_b")) | ~other_side)
        & (F.array_min(F.array_intersect("open_a", "bands_b")) == F.col("band_a")),
    )
    second = second.select(F.least("tid_a", "tid_b").alias("a"), F.greatest("tid_a", "tid_b").alias("b")).distinct()
    more = settle(verified(second, sets, threshold).select("a", "b"))
    if not more.isEmpty():
        roots = settle(components(links.unionByName(more)))
    return roots, texts


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, tid (md5 of the text), class_id (the smallest doc_id of the class) and kept.

    A class holds equal texts and all texts joined by chains of pairs whose sets
    of five-word shingles have a Jaccard of at least ``threshold``. Candidates
    come from 20 bands of 5 ProbMinHash registers, and where a text repeats shingles
    from 20 more with equal weights, so that however often either text repeats them
    a pair of just 0.8 is missed with a probability of at most 0.0004. Words are
    compared in lower case without outer signs.

    ``kept`` marks the one text of the class that is its document of smallest id
    (of equal ids the smallest hash); rows that repeat it are marked alike. Null texts
    are equal to empty ones. Null ids come last; a class of them alone has a null
    class_id. Texts without words are near only to equal texts. An empty table
    gives an empty one.
    """
    roots, texts = text_classes(docs, threshold)
    named = texts.select("tid", "rep").join(roots.withColumnRenamed("node", "tid"), "tid", "left")
    named = settle(named.select("tid", "rep", F.coalesce("root", "tid").alias("root")))
    heads = named.groupBy("root").agg(F.min(F.struct("rep", "tid")).alias("head"))
    named = named.join(heads, "root").select("tid", "head")
    rows = docs.select("doc_id", text_id().alias("tid"))
    return rows.join(named, "tid").select(
        "doc_id",
        "tid",
        F.when(F.col("head.rep") != NO_ID, F.col("head.rep")).alias("class_id"),
        (
            (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("head.rep")) & (F.col("tid") == F.col("head.tid"))
        ).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of which one stays for each class, with their columns, whatever their names; repeated rows once.

    Null ids and texts, empty and long texts, ties and an empty table are as in ``near_duplicates``.
    """
    kept = near_duplicates(docs, threshold).where("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__rep"), F.col("tid").alias("__tid"))
    own, rest = apart(docs, ("doc_id", "text"))
    keyed = own.withColumns({"__rep": F.coalesce("doc_id", F.lit(NO_ID)), "__tid": text_id()})
    once = keyed.join(kept, ["__rep", "__tid"], "left_semi").dropDuplicates(["__rep", "__tid"])
    return together(once, docs, rest)
