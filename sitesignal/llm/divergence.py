"""Divergence of sources within a language, from in-mapper stripes of term counts."""

from __future__ import annotations

from collections import Counter
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesignal.llm.common import settle

LEAST_DOCS = 3
UNIT = 1_000_000_000
TERM_RANKS = 200
#: Held by a task before it spills: a stripe counts as three cells, each of its sources as one.
CELLS = 2_000_000
ROWS_AT_ONCE = 20_000
#: Kept terms of a language that meet in one task, and numbers of an intermediate table there.
TERMS_AT_ONCE = 16_384
NUMBERS_AT_ONCE = 2_000_000

#: Terms are runs of letters a-z and of bytes of code points from 128 on; all else separates.
TO_TERMS = bytes(b if b > 127 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
STRIPE = pa.schema(
    [
        ("lang", pa.string()),
        ("term", pa.binary()),
        ("df", pa.int64()),
        ("sources", pa.list_(pa.string())),
        ("counts", pa.list_(pa.int64())),
    ]
)
STRIPE_DDL = "lang string, term binary, df bigint, sources array<string>, counts array<bigint>"


def terms(text: bytes) -> list[bytes]:
    """The terms of a whole text (UTF-8), A-Z in lower case."""
    return text.translate(TO_TERMS).split()


def _table(langs, terms, df, lengths, sources, counts) -> pa.RecordBatch:
    """Stripes, of which the first ``lengths[0]`` sources and counts belong to the first, and so on."""
    offsets = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (sources, counts)]
    return pa.RecordBatch.from_arrays([langs, terms, pa.array(df, pa.int64()), *lists], schema=STRIPE)


def _spilled(held: dict[str, dict[bytes, dict]]):
    """Record batches of the stripes {None: df, source: count, ...} by language and term."""
    for lang, of in held.items():
        items = iter(of.items())
        while some := list(islice(items, ROWS_AT_ONCE)):
            df = [stripe.pop(None) for _, stripe in some]
            sources = pa.array(list(chain.from_iterable(x for _, x in some)), pa.string())
            counts = pa.array(list(chain.from_iterable(x.values() for _, x in some)), pa.int64())
            names = pa.array([t for t, _ in some], pa.binary())
            yield _table(pa.array([lang] * len(some), pa.string()), names, df, [len(x) for _, x in some], sources, counts)


def folded(stripes: pa.Table) -> pa.RecordBatch:
    """Neighbours of one key as one stripe; ``stripes`` has rows and is sorted by key."""
    lang, term, df, sources, counts = (stripes.column(f.name).combine_chunks() for f in STRIPE)
    change = pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(lang[1:], lang[:-1]))
    starts = np.flatnonzero(np.append(True, change.to_numpy(zero_copy_only=False)))
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(term))))
    codes = sources.flatten().dictionary_encode()
    width = max(1, len(codes.dictionary))
    cell = np.repeat(run, sources.value_lengths().to_numpy()) * width + codes.indices.to_numpy()
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    sums = np.add.reduceat(counts.flatten().to_numpy()[order], first) if len(first) else np.zeros(0, np.int64)
    lengths = np.bincount(cell[first] // width, minlength=len(starts))
    at = pa.array(starts)
    names = codes.dictionary.take(pa.array(cell[first] % width))
    return _table(lang.take(at), term.take(at), np.add.reduceat(df.to_numpy(), starts), lengths, names, pa.array(sums))


def stripes(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """Stripes (lang, term, df, sources, counts) of whole documents, folded inside the tasks.

    A task holds one hash table of stripes per language and spills them, as rows, when they have
    ``cells`` cells, so a key comes at most once of each spill.
    """

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                of = held.setdefault(lang, {})
                for term, n in Counter(terms(text)).items():
                    stripe = of.get(term)
                    if stripe is None:
                        of[term] = {None: 1, source: n}
                        size += 4
                    else:
                        stripe[None] += 1
                        if source in stripe:
                            stripe[source] += n
                        else:
                            stripe[source] = n
                            size += 1
                if size >= cells:
                    yield from _spilled(held)
                    held, size = {}, 0
        yield from _spilled(held)

    return docs.mapInArrow(run, STRIPE_DDL)


def merged_stripes(spills: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """One stripe for each language and term, of those in at least ``least`` of the language's documents.

    Spills are sorted by key and merged batch by batch as they pass.
    """

    def run(batches):
        last = []  # the stripe of the last key so far, which may go on
        for batch in batches:
            stripes = folded(pa.Table.from_batches([*last, batch.cast(STRIPE)])) if batch.num_rows else None
            if stripes is not None:
                last = [stripes.slice(stripes.num_rows - 1)]
                stripes = stripes.slice(0, stripes.num_rows - 1)
                yield stripes.filter(pc.greater_equal(stripes.column("df"), least))
        for stripe in last:
            yield stripe.filter(pc.greater_equal(stripe.column("df"), least))

    dealt = spills.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(run, STRIPE_DDL)


def billionths(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """floor(10**9 * part / whole) for part <= whole < 9 * 10**15, three digits at a time."""
    out = np.zeros(np.broadcast(part, whole).shape, np.int64)
    rest = part
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out


def divergences_of_part(stripes: pa.Table, totals: pa.Table) -> pa.Table:
    """Of some kept terms of one language: sums for all pairs of its sources, and the first terms of each source."""
    out = [[] for _ in range(5)]
    sources = totals.column("source").to_pylist()
    order = np.argsort(np.array([s.encode() for s in sources], object), kind="stable")
    sources = [sources[i] for i in order]
    sums, v = totals.column("n").to_numpy()[order], int(totals.column("v")[0].as_py())
    lang, k = totals.column("lang")[0].as_py(), len(sources)
    place = {s: i for i, s in enumerate(sources)}
    names = stripes.column("term").to_pylist()
    by_term = sorted(range(len(names)), key=names.__getitem__)
    held, numbers = stripes.column("sources").to_pylist(), stripes.column("counts").to_pylist()
    at_once = max(1, NUMBERS_AT_ONCE // k)

    def counts(first):
        """Counts by term and source of the terms from ``first`` on."""
        some = by_term[first : first + at_once]
        table = np.zeros((len(some), k), np.int64)
        for row, i in enumerate(some):
            table[row, [place[s] for s in held[i]]] = numbers[i]
        return [names[i] for i in some], table

    firsts = range(0, len(by_term), at_once)
    whole = sums + v
    best = [[] for _ in sources]  # (-value, term)
    for g in range(0, k, at_once):
        rows = min(at_once, k - g)
        pairs = np.zeros((rows, k), np.int64)
        for first in firsts:
            some, table = counts(first)
            p = 1 + billionths(table + 1, whole)
            for r in range(rows):
                pairs[r] += ((p[:, g + r, None] - p) ** 2 // p).sum(axis=0)
            q = 1 + billionths(table.sum(axis=1) + 1, np.int64(sums.sum() + v))
            for r in range(g, g + rows):
                on = np.flatnonzero((table[:, r] > 0) & (p[:, r] > q))
                f = (p[on, r] - q[on]) ** 2 // q[on]
                on, f = (x[np.argsort(-f, kind="stable")[:TERM_RANKS]] for x in (on, f))
                best[r] = sorted(best[r] + [(-int(n), some[i]) for n, i in zip(f, on, strict=True)])[:TERM_RANKS]
        for r in range(rows):
            for h in range(k):
                if h != g + r:
                    for column, value in zip(out, (lang, sources[g + r], "pair", sources[h], int(pairs[r, h])), strict=True):
                        column.append(value)
    for source, rows in zip(sources, best, strict=True):
        for n, term in rows:
            for column, value in zip(out, (lang, source, "term", term.decode("utf-8", "replace"), -n), strict=True):
                column.append(value)
    kinds = [pa.string()] * 4 + [pa.int64()]
    columns = ("lang", "source", "part", "item", "value")
    return pa.table({c: pa.array(x, t) for c, x, t in zip(columns, out, kinds, strict=True)})


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value and rank: how far sources of a language are from each other and from it.

    Null text, lang and source are empty texts. Terms are runs of ASCII letters and other
    code points from 128 on, only A-Z lower-cased. A language keeps the V
    terms that at least ``least`` of its documents have. A group (language and source), or the
    language, gives a kept term with ``count`` occurrences among N p = 1 + floor(10**9 (count + 1) / (N + V)).
    The divergence of p from q is floor((p - q)**2 / q), exactly. Part ``pair``: for
    each other source of the language, the sum over all kept terms, its q
    against the group's p. Part ``term``: the 200 first kept terms that the group has and uses more than
    the language. Ranks from 1 by value descending, then item by UTF-8.

    Documents are folded into stripes inside tasks; stripes meet by term, and kept ones
    by language and a hash of the term, where each part gives sums for all pairs of sources; so neither a
    source nor a frequent term is gathered. Every group that occurs has its pairs, also without terms;
    a language of one source has none. Repeated rows and rows of equal id count
    one by one; doc_id is not looked at, nor are other columns, whatever
    their names. An empty table gives an empty one.
    """
    read = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = settle(merged_stripes(stripes(read.withColumn("text", F.col("text").cast("binary"))), least))
    cells = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("cell"))
    sums = cells.groupBy("lang", F.col("cell.sources").alias("source")).agg(F.sum("cell.counts").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = read.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = settle(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n", "v"))))

    parts = max(1, -(-kept.count() // TERMS_AT_ONCE))
    left = kept.withColumn("slot", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")).groupBy("lang", "slot")
    right = groups.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("lang", "slot")
    found = left.cogroup(right).applyInArrow(divergences_of_part, "lang string, source string, part string, item string, value bigint")
    found = settle(found)
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    own = found.where("part = 'term'")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    pairs, own = (df.withColumn("rank", rank) for df in (pairs, own))
    return pairs.unionByName(own.where(F.col("rank") <= TERM_RANKS))
