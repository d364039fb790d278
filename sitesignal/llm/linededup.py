"""Removal of repeated runs of lines by winnowing."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.llm.common import map_batches, settle

NOISE_WORDS = 25
RUN_WORDS = 50


def line_hash(line: str) -> int:
    digest = hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def winnow(text: str, noise: int = NOISE_WORDS, run: int = RUN_WORDS):
    """Fingerprints of a text: (hash, lines before, lines from the gram on), lines as (number, hash).

    Blank lines are passed over. A gram is the shortest stretch of lines from a
    line on with at least ``noise`` words. Each shortest stretch with at least
    ``run`` words is a window; of the grams inside it the one with the least
    hash, the last of equals, is selected. So texts that share a stretch of ``run`` words
    share a fingerprint, and no match is shorter than ``noise`` words. The
    lines around a gram reach to the next ``run`` words on either side; farther
    on the shared stretch has a fingerprint of its own.
    """
    lines = [
        (i, line_hash(bare), len(bare.split()))
        for i, line in enumerate(text.split("\n"))
        if (bare := line.strip())
    ]
    words = [0]
    for _, _, n in lines:
        words.append(words[-1] + n)
    n, total = len(lines), words[-1]

    def stretch_end(i: int, end: int, least: int) -> int:
        """The first end after which lines i.. have ``least`` words, sought from ``end`` on."""
        while words[end] - words[i] < least:
            end += 1
        return end

    grams, chosen = [], set()
    end = 0
    for i in range(n):
        if total - words[i] < noise:
            break
        end = stretch_end(i, end, noise)
        digest = b"".join(h.to_bytes(8, "little", signed=True) for _, h, _ in lines[i:end])
        grams.append((int.from_bytes(hashlib.blake2b(digest, digest_size=8).digest(), "little", signed=True), end))
    end, best = 0, -1
    for i in range(len(grams)):
        if total - words[i] < run:
            break
        new_end = stretch_end(i, end, run)
        if best < i:
            best, seen = i, i
        while seen + 1 < len(grams) and grams[seen + 1][1] <= new_end:
            seen += 1
            if grams[seen][0] <= grams[best][0]:
                best = seen
        end = new_end
        chosen.add(best)
        if best == i:  # it leaves the next window, whose grams are looked at again
            best = -1
    for k in sorted(chosen):
        first, last = k, grams[k][1]
        while first and words[k] - words[first] < run:
            first -= 1
        while last < n and words[last] - words[grams[k][1]] < run:
            last += 1
        yield grams[k][0], [x[:2] for x in lines[first:k][::-1]], [x[:2] for x in lines[k:last]]


def fingerprint_rows(docs: DataFrame, noise: int, run: int) -> DataFrame:
    """One row per selected gram of each document (doc_id, key, text)."""

    def prepare():
        def step(part):
            out = [[] for _ in range(7)]
            for doc_id, key, text in zip(part["doc_id"], part["__key"], part["text"], strict=True):
                for gram, back, ahead in winnow(text or "", noise, run):
                    row = (
                        gram,
                        doc_id,
                        key,
                        [i for i, _ in back],
                        [h for _, h in back],
                        [i for i, _ in ahead],
                        [h for _, h in ahead],
                    )
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            return out

        return step

    columns = [
        ("gram", "bigint"),
        ("doc_id", "bigint"),
        ("key", "string"),
        ("back_at", "array<int>"),
        ("back", "array<bigint>"),
        ("ahead_at", "array<int>"),
        ("ahead", "array<bigint>"),
    ]
    return map_batches(docs.select("doc_id", "__key", "text"), prepare, columns)


def agreeing(a: str, b: str):
    """How many leading elements of two arrays are equal."""
    first = f"array_position(zip_with({a}, {b}, (x, y) -> coalesce(x = y, false)), false)"
    return F.expr(f"cast(if({first} = 0, size({a}), {first} - 1) as int)")


def farther_runs(later: DataFrame) -> DataFrame:
    """key and run where an earlier place of a gram shares more of a side than the gram's first place.

    Such a place has left the first one at the same line, so it is itself among the places whose match
    ended early. These are grouped by every longer stretch from the gram on (one row for each line of it);
    the first place of a stretch keeps it, the others have it again. The longest counts.
    """
    open_sides = later.select("gram", "doc_id", "key", "line", F.inline("open_sides"))
    stretch = F.explode(
        F.expr("transform(sequence(agreed + 1, size(at)), k -> struct(at[k - 1] as end, xxhash64(side, slice(lines, 1, k)) as stretch))")
    )
    ends = open_sides.select("gram", "doc_id", "key", "line", "side", stretch.alias("e")).select("gram", "doc_id", "key", "line", "side", "e.*")
    place = F.struct("doc_id", "key", "line")
    firsts = ends.groupBy("gram", "stretch").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    again = ends.join(firsts.where("first != last").drop("last"), ["gram", "stretch"])
    again = again.where((F.col("key") != F.col("first.key")) | (F.col("line") != F.col("first.line")))
    farthest = again.groupBy("key", "line", "side").agg(F.min("end").alias("least"), F.max("end").alias("most"))
    ends = F.struct(F.least("least", "line").alias("first"), F.greatest("most", "line").alias("last"))
    return farthest.select("key", ends.alias("run"))


def repeated_runs(docs: DataFrame, noise: int = NOISE_WORDS, run: int = RUN_WORDS) -> DataFrame:
    """The line ranges to delete: key and runs, an array of (first, last) line numbers.

    Each fingerprint's first place, by doc_id and line, is its source. Every
    later place is joined to it, and the match is extended both ways while
    lines agree; where it ends early, ``farther_runs`` looks at the other places. Places are never
    paired with each other, and a fingerprint in
    a third of all documents is found by a partial minimum and joined to one row.
    """
    rows = settle(fingerprint_rows(docs, noise, run)).withColumn("line", F.element_at("ahead_at", 1))
    place = F.struct("doc_id", "key", "line", "back", "ahead")
    sources = rows.groupBy("gram").agg(F.min(place).alias("source"), F.count("*").alias("source_places"))
    later = rows.join(sources.where(F.col("source_places") > 1), "gram").where(
        (F.col("key") != F.col("source.key")) | (F.col("line") != F.col("source.line"))
    )
    later = later.withColumn("up", agreeing("back", "source.back")).withColumn(
        "down", agreeing("ahead", "source.ahead")
    )
    first = F.expr("if(up > 0, back_at[up - 1], line)")
    last = F.expr("ahead_at[down - 1]")
    sides = [
        F.struct(F.lit(side).alias("side"), F.col(at).alias("at"), F.col(lines).alias("lines"), F.col(agreed).alias("agreed"))
        for side, (at, lines, agreed) in enumerate([("back_at", "back", "up"), ("ahead_at", "ahead", "down")])
    ]
    ended = F.filter(F.array(*sides), lambda s: (s["agreed"] < F.size(s["at"])) & (F.col("source_places") > 2))
    run_found = F.struct(first.alias("first"), last.alias("last")).alias("run")
    later = settle(later.select("gram", "doc_id", "key", "line", run_found, ended.alias("open_sides")))
    runs = later.select("key", "run")
    return runs.unionByName(farther_runs(later)).groupBy("key").agg(F.collect_set("run").alias("runs"))


def dedup_lines(docs: DataFrame, noise: int = NOISE_WORDS, run: int = RUN_WORDS) -> DataFrame:
    """All rows and columns, ``text`` without later repeated runs; adds n_lines and removed_lines.

    A run of lines with ``run`` or more words that occurred before, in a
    document with a smaller id or further up in the same one, is deleted in full, whichever
    of its earlier places has most of it. Of runs with ``noise`` to ``run`` words some are deleted; shorter ones never.
    Only whole lines count: of a passage that begins or ends inside a line its whole
    lines are seen, and one inside a single line is not seen at all.
    Of every deleted line an equal one stays elsewhere. ``removed_lines`` are
    the deleted line numbers from 0; a text of which only blank lines would stay becomes
    empty.

    A null text stays null. A null doc_id comes before all others. Rows of equal
    id and text count as one document, and all are treated alike. Columns of the
    input other than doc_id and text may have any name but ``__key`` and
    ``__runs``; ``n_lines`` and ``removed_lines`` are replaced. An empty table gives
    an empty one.
    """
    hashed = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    docs = docs.withColumn("__key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), hashed))
    runs = repeated_runs(docs, noise, run).withColumnRenamed("key", "__key").withColumnRenamed("runs", "__runs")
    lines = F.split(F.col("text"), "\n", -1)
    numbers = F.expr(
        "array_sort(array_distinct(flatten(transform(__runs, r -> sequence(r.first, r.last)))))"
    )
    kept = F.expr(
        "array_join(filter(split(text, '\\n', -1),"
        " (x, i) -> not exists(__runs, r -> i between r.first and r.last)), '\\n')"
    )
    kept = F.when(kept.rlike(r"\S"), kept).otherwise("")
    return (
        docs.join(runs, "__key", "left")
        .withColumns(
            {
                "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("bigint"),
                "removed_lines": F.coalesce(numbers, F.array().cast("array<int>")),
                "text": F.when(F.col("__runs").isNull(), F.col("text")).otherwise(kept),
            }
        )
        .drop("__key", "__runs")
    )
