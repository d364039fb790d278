"""Packing of token sequences by best-fit decreasing."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.llm.bpe import default_path, ids_coder
from sitesignal.llm.common import map_batches, numbered, settle

WINDOW = 2048


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that finds the tightest fit.

    Windows of one capacity are held as ranges of consecutive numbers.
    """

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, first: int, n: int) -> None:
        self.ranges[capacity].append((first, n))
        node = self.leaves + capacity
        while node and not self.tree[node]:
            self.tree[node] = 1
            node //= 2

    def take(self, capacity: int) -> tuple[int, int]:
        found = self.ranges[capacity].pop()
        node = self.leaves + capacity
        if not self.ranges[capacity]:
            self.tree[node] = 0
            while node := node // 2:
                self.tree[node] = self.tree[2 * node] | self.tree[2 * node + 1]
        return found

    def tightest(self, length: int) -> int | None:
        """The least capacity of at least ``length`` with an open window."""
        node = self.leaves + length
        while not self.tree[node]:
            while node & 1:
                node //= 2
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit(counts: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over a histogram of piece lengths.

    Pieces of a length are interchangeable, so whole ranges of them are placed
    at once; the result is that of placing piece by piece. Returns placements
    (length, first piece, pieces, first window, offset) and the number of
    windows. Size and time depend on ``window`` alone, not on the corpus.
    """
    windows, used, placed = OpenWindows(window), 0, []
    for length in sorted(counts, reverse=True):
        left, done = counts[length], 0
        while left:
            capacity = windows.tightest(length)
            if capacity is None:
                each = window // length
                capacity, first, n = window, used, -(-left // each)
                used += n
            else:
                first, n = windows.take(capacity)
            each = capacity // length
            many = min(n, left // each)
            for k in range(each if many else 0):
                placed.append((length, done, many, first, window - capacity + k * length))
                done += many
            left -= each * many
            if many and capacity > each * length:
                windows.put(capacity - each * length, first, many)
            rest = n - many
            if rest and left:
                for k in range(left):  # fewer than fit into one window
                    placed.append((length, done, 1, first + many, window - capacity + k * length))
                    done += 1
                windows.put(capacity - left * length, first + many, 1)
                rest, left = rest - 1, 0
            if rest:
                windows.put(capacity, first + n - rest, rest)
    return placed, used


def token_pieces(
    docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = 1, keep_ids: bool = False
) -> DataFrame:
    """The ids of each document and ``end_id``, cut into full windows and a rest.

    A null text is empty, so its document is the end id alone.
    """
    path = tokenizer or default_path()

    def prepare():
        code, end = ids_coder(path), end_id.to_bytes(4, "little")

        def step(part):
            out = [[] for _ in range(5 + keep_ids)]
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                ids = code(text or "") + end
                for start in range(0, len(ids), 4 * window):
                    piece = ids[start : start + 4 * window]
                    row = (doc_id, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)
                    for column, value in zip(out, (*row, piece), strict=False):
                        column.append(value)
            return out

        return step

    columns = [(c, "bigint") for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    if keep_ids:
        columns.append(("ids", "binary"))
    return map_batches(docs.select("doc_id", "text"), prepare, columns)


def pack(
    docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = 1, keep_ids: bool = False
) -> DataFrame:
    """Pack documents into sequences of at most ``window`` tokens.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and, with ``keep_ids``, the piece's ids. Overlong documents are first cut
    into full windows; rests are placed by best-fit decreasing over the
    histogram of their lengths, which has at most ``window`` entries whatever
    the corpus, so the packing is that of all documents together. Pieces of a
    length are numbered without gathering them and meet their placement by
    that number.

    Each row is packed, also repeated ones and those with a null doc_id; a null
    or empty text has only the end id; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    pieces = settle(token_pieces(docs, tokenizer, window, end_id, keep_ids))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    placed, _ = best_fit(counts, window)
    placements = spark.createDataFrame(
        placed, "length bigint, __from bigint, __n bigint, __window bigint, offset bigint"
    )
    order = [F.col("doc_id"), F.col("start"), F.col("ids_crc32")]
    ranked = numbered(pieces, ["length"], order, "__rank")
    inside = (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__from") + F.col("__n"))
    placements = placements.withColumnRenamed("length", "__length")
    return (
        ranked.join(F.broadcast(placements), (F.col("length") == F.col("__length")) & inside)
        .withColumn("sequence_id", F.col("__window") + F.col("__rank") - F.col("__from"))
        .select(*pieces.columns[:5], "sequence_id", "offset", *pieces.columns[5:])
    )
