"""Near-duplicates by SimHash, with bit-sliced comparison of the fingerprints."""

from __future__ import annotations

from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.llm.common import map_batches, settle
from sitesignal.operators.components import components

WIDTH = 3
SEED = 42
BITS = 64
RADIUS = 3
#: Fingerprints that differ in at most RADIUS bits agree on PIECES - RADIUS of PIECES pieces.
PIECES = 5
#: Members of a bucket that meet in one task; larger buckets are compared in tiles of two slices.
SLICE = 4096
MEMBERS_AT_ONCE = 8192
BLOCKS_AT_ONCE = 1 << 15
HASHES_AT_ONCE = 1 << 16
PLANES_BETWEEN_LOOKS = 8

_U = np.uint64
_FULL = _U(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes) -> int:
    """The SimHash of a whole text (UTF-8) as a signed 64-bit number.

    A bit is set if it is set in over half of the hashes of the three-word
    shingles, repeats included; 0 without words.
    """
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= WIDTH else iter([b" ".join(words)])
    n, ones = 0, np.zeros(BITS, np.int64)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    while len(part := np.fromiter(islice(hashes, HASHES_AT_ONCE), _U)):
        n += len(part)
        ones += bits_of(part).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def bits_of(numbers: np.ndarray) -> np.ndarray:
    """A row of 64 bits for each 64-bit number, the lowest bit first."""
    return np.unpackbits(numbers.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint of each whole text (null: empty) as a signed number, row by row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    prepare = lambda: lambda part: [part["doc_id"], [fingerprint(t) for t in part["text"]]]
    return map_batches(rows, prepare, [("doc_id", "bigint"), ("fp", "bigint")])


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least member known of its component) after linking a with b."""
    while True:
        la, lb = labels[a], labels[b]
        on = la != lb
        if not on.any():
            return labels
        a, b, la, lb = a[on], b[on], la[on], lb[on]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (labels != (after := labels[labels])).any():
            labels = after


def linked(prints: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint the first one of its group that a chain of near ones leads to.

    ``prints`` are distinct within their groups, which begin at ``starts``. Bit
    planes are stored vertically: word w of plane p holds bit p of 64
    fingerprints of a group. A fingerprint is compared with such a word at once:
    the differing lanes of each plane are added to carry-save counters of as
    many bits as the radius has, whose overflow marks lanes beyond it. A block
    (fingerprint and word) of which all lanes are beyond is abandoned.
    """
    counters = radius.bit_length()
    if radius + 1 != 1 << counters:
        raise ValueError("the radius must be 1, 3, 7 or 15")
    n = len(prints)
    sizes = np.diff(np.append(starts, n))
    words = -(-sizes // 64)
    first_word = np.cumsum(words) - words
    group = np.repeat(np.arange(len(sizes)), sizes)
    lane = first_word[group] * 64 + np.arange(n) - starts[group]
    bits = bits_of(prints)
    lanes = np.zeros((int(words.sum()) * 64, BITS + 1), np.uint8)
    lanes[lane, :BITS] = bits
    lanes[lane, BITS] = 1
    planes = np.packbits(np.ascontiguousarray(lanes.T), axis=1, bitorder="little").view(_U)
    member = np.zeros(len(lanes), np.int64)
    member[lane] = np.arange(n)

    labels = np.arange(n)
    own = lane // 64
    blocks = first_word[group] + words[group] - own  # only words from its own on
    ends = np.cumsum(blocks)
    for begin in range(0, int(ends[-1]) if n else 0, BLOCKS_AT_ONCE):
        at = np.arange(begin, min(begin + BLOCKS_AT_ONCE, int(ends[-1])))
        q = np.searchsorted(ends, at, side="right")
        w = own[q] + at - (ends[q] - blocks[q])
        upto = np.where(w == own[q], (_U(2) << (lane[q] % 64).astype(_U)) - _U(1), _U(0))
        beyond = ~planes[BITS, w] | upto
        count = np.zeros((counters, len(q)), _U)
        for p in range(BITS):
            if p % PLANES_BETWEEN_LOOKS == 0:
                on = beyond != _FULL
                if 2 * np.count_nonzero(on) < len(on):
                    q, w, beyond, count = q[on], w[on], beyond[on], count[:, on]
                    if not len(q):
                        break
            carry = planes[p, w] ^ (_U(0) - bits[q, p].astype(_U))
            for c in count:
                both = c & carry
                c ^= carry
                carry = both
            beyond |= carry
        near = np.flatnonzero(beyond != _FULL)
        row, bit = np.nonzero(bits_of(~beyond[near]))
        labels = merged(labels, q[near][row], member[w[near][row] * 64 + bit])
    return labels


def near_links(prints: DataFrame, radius: int = RADIUS, slice_rows: int = SLICE) -> DataFrame:
    """Links (a, b) that connect what chains of distinct fingerprints (fp) within ``radius`` bits connect.

    Five pieces of the bits, any two of which make a bucket: near fingerprints
    share at least one. Members of a bucket are compared with each other in
    blocks; a bucket of more than ``slice_rows`` is dealt by hash into slices, and every
    two slices meet in a task of their own. Of each task come as many links
    as join its members, not all pairs.
    """
    if radius != RADIUS:
        raise ValueError("the pieces are made for a radius of 3")
    edges = [round(BITS * k / PIECES) for k in range(PIECES + 1)]
    piece = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(piece[i] for i in chosen) for chosen in combinations(range(PIECES), PIECES - RADIUS)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("k")) for t, m in enumerate(signed)])
    members = prints.select("fp", F.inline(keys))
    shared = members.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    members = members.join(settle(shared), ["t", "k"])
    slices = F.ceil(F.col("n") / F.lit(slice_rows)).cast("int")
    members = members.select("t", "k", "fp", slices.alias("slices")).withColumn("s", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))
    others = F.when(F.col("slices") > 1, F.filter(F.sequence(F.lit(0), F.col("slices") - 1), lambda j: j != F.col("s"))).otherwise(F.array(F.lit(0)))
    tiles = members.withColumn("o", F.explode(others)).select("t", "k", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), "fp")
    tile = ["t", "k", "i", "j"]
    tiles = tiles.repartition(*tile).sortWithinPartitions(*tile, "fp")

    def run(batches):
        def links(keys, prints):
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            root = linked(prints.view(_U), starts, radius)
            on = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(prints[on]), pa.array(prints[root[on]])], names=["a", "b"])

        held = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            new = np.stack([batch.column(c).to_numpy() for c in tile], axis=1).astype(np.int64)
            held = np.concatenate((held[0], new)), np.concatenate((held[1], batch.column("fp").to_numpy()))
            while len(held[0]) >= 2 * MEMBERS_AT_ONCE:
                # Up to the last group that ends in the first rows, or the whole first one.
                change = 1 + np.flatnonzero((held[0][1:] != held[0][:-1]).any(axis=1))
                if not len(change):
                    break
                cut = change[max(0, np.searchsorted(change, MEMBERS_AT_ONCE, side="right") - 1)]
                yield links(held[0][:cut], held[1][:cut])
                held = held[0][cut:], held[1][cut:]
        if len(held[0]):
            yield links(*held)

    return tiles.mapInArrow(run, "a bigint, b bigint").distinct()


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row.

    Texts are linked if their fingerprints differ in at most 3 bits; component_id
    is the smallest doc_id that links lead to, its own included. Only A-Z are
    lower-cased; words are split at the six ASCII white space characters.

    A null text is empty; texts without words have fingerprint 0 and are linked
    like any other. Null ids are never the smallest: a component of them alone has
    a null component_id. Repeated rows and rows of equal id are answered row by
    row. Texts of any length are hashed whole. Other columns of the input are
    passed over, whatever their names. An empty table gives an empty one.
    """
    prints = settle(fingerprints(docs))
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = settle(components(settle(near_links(nodes.select("fp")))))
    of_linked = roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "least")
    heads = settle(of_linked.groupBy("root").agg(F.min("least").alias("head")))
    heads = roots.join(heads, "root").select(F.col("node").alias("fp"), "head")
    named = settle(nodes.join(heads, "fp", "left").select("fp", F.coalesce("head", "least").alias("component_id")))
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
