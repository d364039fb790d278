"""Hard negatives by the threshold algorithm over per-dimension sorted lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesignal.llm.common import settle

POSITIVES = 5
NEGATIVES = 10
LABELS = 10
#: A negative's score lies between these hundredths of the positive's.
LEAST_HUNDREDTHS, MOST_HUNDREDTHS = 30, 90
SCALE = 256
#: Scaled components beyond this count as this, so that scores stay within 64 bits.
LARGEST = 1 << 26
#: Rows and anchors that meet in one task.
BLOCK = 2048
CHUNK = 1024
FIRST_DEPTH = 16
EXACT = 1 << 53


class SortedLists:
    """For each dimension the rows by component, ascending and descending."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.most = float(np.abs(rows).max(initial=0))
        self.exact = rows.astype(np.float64)  # whole numbers; a product of floats is exact below 2**53
        up = np.argsort(rows, axis=0, kind="stable").T.astype(np.int32)
        self.places = np.stack([up, up[:, ::-1]])

    def search(self, anchor: np.ndarray, enough) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the rows seen until ``enough(places, scores, threshold)``.

        Lists are read from the end where the anchor's sign makes components
        count most, to the same depth in each. Rows that appear are
        scored from their own components. The threshold is the score of
        the components last read: no unseen row has more.
        """
        n, used = len(self.rows), np.flatnonzero(anchor)
        if not len(used):
            return np.arange(n), np.zeros(n, np.int64)
        side = (anchor[used] > 0).astype(np.intp)
        floats = self.most * float(np.abs(anchor).sum()) < EXACT
        rows, of = (self.exact, anchor.astype(np.float64)) if floats else (self.rows, anchor)
        seen, depth = np.zeros(n, bool), 0
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while depth < n:
            to = min(n, max(FIRST_DEPTH, 2 * depth))
            met = np.zeros(n, bool)
            met[self.places[side, used, depth:to]] = True
            fresh = np.flatnonzero(met & ~seen)
            seen |= met
            places = np.concatenate((places, fresh))
            scores = np.concatenate((scores, (rows[fresh] @ of).astype(np.int64)))
            threshold = int(self.rows[self.places[side, used, to - 1], used] @ anchor[used])
            depth = to
            if len(places) == n or enough(places, scores, threshold):
                break
        return places, scores


def first_rows(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The k places of highest score, ties by smaller id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def nearest(lists: SortedLists, ids: np.ndarray, anchor: np.ndarray, own: int, k: int):
    """ids and scores of the first k rows but the one of id ``own``."""

    def enough(places, scores, threshold):
        scores = scores[ids[places] != own]
        return len(scores) >= k and threshold < np.partition(scores, len(scores) - k)[len(scores) - k]

    places, scores = lists.search(anchor, enough)
    on = ids[places] != own
    places, scores = places[on], scores[on]
    at = first_rows(ids[places], scores, k)
    return ids[places[at]], scores[at]


def in_windows(lists: SortedLists, ids: np.ndarray, other: np.ndarray, anchor: np.ndarray, windows, k: int):
    """For each window (least, most) ids and scores of the first k ``other`` rows within."""

    def enough(places, scores, threshold):
        ordered = np.sort(scores[other[places]])
        for least, most in windows:
            a, b = np.searchsorted(ordered, least), np.searchsorted(ordered, most, side="right")
            if threshold >= (ordered[b - k] if b - a >= k else least):
                return False
        return True

    places, scores = lists.search(anchor, enough)
    places, scores = places[other[places]], scores[other[places]]
    for least, most in windows:
        within = np.flatnonzero((scores >= least) & (scores <= most))
        at = within[first_rows(ids[places[within]], scores[within], k)]
        yield ids[places[at]], scores[at]


def window_of(score: int) -> tuple[int, int] | None:
    """The least and the most score of a negative of a positive with this score, None if there is none."""
    least, most = -(-LEAST_HUNDREDTHS * score // 100), MOST_HUNDREDTHS * score // 100
    return (least, most) if least <= most else None


def vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels, components and places of a tile's rows; of one id the first by label and components."""
    table = table.combine_chunks()
    ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
    lists = table.column("components").combine_chunks()
    flat = (lists.flatten() if isinstance(lists, pa.ListArray) else pa.concat_arrays([c.flatten() for c in lists.chunks])).to_numpy()
    rows = flat.astype(np.int64).reshape(len(ids), -1)
    order = np.lexsort((*rows.T[::-1], labels, ids))
    order = order[np.append(True, ids[order][1:] != ids[order][:-1])] if len(order) else order
    return ids[order], labels[order], rows[order], order


def positives_of_tile(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """The first positives of each anchor among the tile's rows, from lists of its label's rows."""
    out = [[], [], []]
    if rows.num_rows and anchors.num_rows:
        ids, labels, components, _ = vectors(rows)
        anchor_ids, anchor_labels, anchor_components, _ = vectors(anchors)
        for label in np.unique(anchor_labels):
            same = np.flatnonzero(labels == label)
            if not len(same):
                continue
            lists = SortedLists(components[same])
            for i in np.flatnonzero(anchor_labels == label):
                found, scores = nearest(lists, ids[same], anchor_components[i], anchor_ids[i], POSITIVES)
                for column, value in zip(out, (np.full(len(found), anchor_ids[i]), found, scores), strict=True):
                    column.append(value)
    columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
    return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score"), columns, strict=True)))


def negatives_of_tile(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """The first negatives within the windows of each anchor among the tile's rows."""
    out = [[] for _ in range(5)]
    if rows.num_rows and anchors.num_rows:
        ids, labels, components, _ = vectors(rows)
        anchor_ids, anchor_labels, anchor_components, kept = vectors(anchors)
        positives = anchors.column("positives").take(pa.array(kept)).to_pylist()
        lists = SortedLists(components)
        for i in range(len(anchor_ids)):
            wanted = [(p["positive_id"], p["positive_score"], w) for p in positives[i] if (w := window_of(p["positive_score"]))]
            other = labels != anchor_labels[i]
            if not wanted or not other.any():
                continue
            found = in_windows(lists, ids, other, anchor_components[i], [w for *_, w in wanted], NEGATIVES)
            for (positive, score, _), (negatives, scores) in zip(wanted, found, strict=True):
                given = (np.full(len(negatives), x) for x in (anchor_ids[i], positive, score))
                for column, value in zip(out, (*given, negatives, scores), strict=True):
                    column.append(value)
    columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
    names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
    return pa.table(dict(zip(names, columns, strict=True)))


def scaled(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and whole-number components of the rows that take part; see ``hard_negatives``."""
    x = lambda v: v.cast("double")
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(x(v)) | (F.abs(x(v)) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    bounded = lambda v: F.greatest(F.least(x(v) * SCALE, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))
    return embeddings.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad
    ).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        label.cast("bigint").alias("label"),
        F.transform("embedding", lambda v: F.floor(bounded(v)).cast("int")).alias("components"),
    )


def hard_negatives(embeddings: DataFrame, every: int = 100, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """For each anchor and positive the hardest negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Takes vec_id, label and embedding (an array of numbers); see the module for
    the numbers. Anchors are the rows whose id is divisible by ``every``; they
    meet all rows in tiles of hash blocks of rows and hash chunks of anchors. A tile
    sorts its rows by each dimension and runs the threshold algorithm for
    each anchor: first for its positives, then, these known from all tiles,
    for all its windows at once. Of every tile and window come at most as many rows as
    are asked for; a window of ranks takes the first of them.

    Rows with a null id, label, vector or component or one that is not finite take no part.
    Components beyond 2**26 when scaled count as 2**26. Vectors of another length than the anchor's are not
    compared with it; one without components scores 0. Of rows with one id the
    first by label and components stands for all, so repeated rows count once. Equal
    scores come by smaller id. A positive with a negative score has no negatives,
    an anchor without positives no rows; an empty table gives an empty one.
    Other columns are passed over, whatever their names.
    """
    rows = settle(scaled(embeddings).withColumn("size", F.size("components")))
    is_anchor = F.col("vec_id") % every == 0
    n, n_anchors = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
    blocks, chunks = max(1, -(-n // block)), max(1, -(-n_anchors // chunk))
    at = lambda k: F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int")
    all_of = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    tile = ["size", "block", "chunk"]
    tiled = rows.withColumn("block", at(blocks)).withColumn("chunk", all_of(chunks)).groupBy(*tile)
    anchors = rows.where(is_anchor).withColumn("chunk", at(chunks))

    def meet(anchors, step, columns):
        dealt = anchors.withColumn("block", all_of(blocks)).groupBy(*tile)
        return tiled.cogroup(dealt).applyInArrow(step, ", ".join(f"{c} bigint" for c in columns))

    names = ["anchor_id", "positive_id", "positive_score"]
    near = meet(anchors, positives_of_tile, names)
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("at", F.row_number().over(first)).where(F.col("at") <= POSITIVES)
    positives = near.groupBy("anchor_id").agg(F.collect_list(F.struct(*names[1:])).alias("positives"))
    anchors = settle(anchors.join(positives, anchors["vec_id"] == positives["anchor_id"]).drop("anchor_id"))

    hard = meet(anchors, negatives_of_tile, [*names, "negative_id", "negative_score"])
    ranks = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (
        hard.withColumn("rank", F.row_number().over(ranks))
        .where(F.col("rank") <= NEGATIVES)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
