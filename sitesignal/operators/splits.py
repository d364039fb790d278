"""Splits for evaluation that keep together what belongs together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.operators.components import components
from sitesignal.schema import SITE_KEYS
from sitesignal.sources.scratch import settle

#: Kinds of keys that may not be on two sides: same site, transcript, gene.
SITE, TRANSCRIPT, GENE = tuple(SITE_KEYS), ("transcript_id",), ("gene_id",)
#: Groups with at least one so manieth of all rows are placed one by one.
LARGE_PARTS = 5_000
LABEL_SHARES = 10
CHUNKS = 256


def _key(kind) -> F.Column:
    """The key as text, named by its columns; null if one of them is."""
    parts = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in kind]
    text = parts[0]
    for p in parts[1:]:
        text = F.concat(text, F.lit("|"), p)
    return text


def linked_groups(sites: DataFrame, keys=(SITE, TRANSCRIPT, GENE)) -> DataFrame:
    """The rows with ``group``: rows that share a key of any kind, directly or by way of others, have the same.

    ``keys`` are kinds of keys, each a tuple of columns. Keys are the nodes of a
    graph and a row links its own; a group is named after the smallest of its keys. Sites of
    several data sets are given as one table, so a shared site links them.
    A kind that another kind implies (a site its transcript) adds no link. Only
    distinct pairs of keys are shuffled, and a key with a third of all rows is one
    node of them. A null key links nothing; a row whose keys are all null has a
    null group. Repeated rows are kept; an empty table gives an empty one.
    """
    kinds = [tuple(k) for k in keys]
    # A row with a site key has a transcript key too, so the site adds nothing.
    needed = [k for k in kinds if not any(set(other) < set(k) for other in kinds)]
    names = [f"_key{i}" for i in range(len(needed))]
    rows = sites.withColumns({n: _key(k) for n, k in zip(names, needed, strict=True)})
    rows = rows.withColumn("_first", F.coalesce(*names))
    if len(needed) == 1:
        return rows.withColumn("group", F.col("_first")).drop(*names, "_first")
    pairs = F.array(*[F.struct(F.col("_first").alias("a"), F.col(n).alias("b")) for n in names])
    links = settle(rows.select(F.inline(pairs)).filter("b is not null").distinct())
    roots = settle(components(links)).select(F.col("node").alias("_first"), F.col("root").alias("group"))
    return rows.join(roots, "_first", "left").drop(*names, "_first")


def chance(column: str, seed: int = 0) -> F.Column:
    """A number from 0 to 1 that depends on the text of a column and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(column)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def leakage_safe_split(sites: DataFrame, test_share: float = 0.2, keys=(SITE, TRANSCRIPT, GENE), seed: int = 0) -> DataFrame:
    """The rows with ``group`` and ``side`` (``train`` or ``test``): no key of any kind is on both sides.

    Groups are those of ``linked_groups``; a hash of the group decides, so a
    row keeps its side when others come, as long as its group keeps its smallest key. Shares are met only on
    average over groups; ``balanced_split`` meets them. Rows with a null group are train.
    """
    grouped = linked_groups(sites, keys)
    side = F.when(chance("group", seed) < test_share, "test").otherwise("train")
    return grouped.withColumn("side", side)


def leaks(split: DataFrame, keys=(SITE, TRANSCRIPT, GENE)) -> DataFrame:
    """(kind, leaks): of each kind how many keys are on more than one ``side``; all 0 for a safe split."""
    out = None
    for kind in keys:
        own = split.select(_key(kind).alias("_key"), "side").filter("_key is not null")
        both = own.groupBy("_key").agg((F.min("side") != F.max("side")).alias("_both"))
        row = both.agg(F.lit("+".join(kind)).alias("kind"), F.count_if("_both").alias("leaks"))
        out = row if out is None else out.unionByName(row)
    return out


def place(items, shares: dict[str, float]) -> list[str]:
    """A side for each item (rows, positives), largest first to the side that it brings closest to all shares.

    What is minimised is the sum of the squared distances of the rows and of the positives of each side
    from their share, both as parts of the whole.
    """
    total = [max(1.0, float(sum(x[k] for x in items))) for k in (0, 1)]
    missing = {s: [share, share] for s, share in shares.items()}
    sides = [""] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], -items[i][1], i)):
        part = [items[i][k] / total[k] for k in (0, 1)]
        # (m - p)**2 - m**2 is least where most is missing in the direction of the item.
        best = min(missing, key=lambda s: sum(p * p - 2 * m * p for m, p in zip(missing[s], part, strict=True)))
        missing[best] = [m - p for m, p in zip(missing[best], part, strict=True)]
        sides[i] = best
    return sides


def balanced_split(
    rows: DataFrame, group: str = "group", label: str = "label", shares: dict[str, float] | None = None
) -> DataFrame:
    """The rows with ``side``: groups stay whole, sides have their shares of rows and of positives.

    ``shares`` gives each side's share (by default train 0.8, test 0.2); a positive is a row with label 1. Groups
    are counted once. Those with at least a 5,000th of all rows are placed one by
    one; the others are dealt by their share of positives (eleven steps) and a
    hash into at most 2,816 chunks, of which only the counts are looked at. Large groups and chunks are placed
    largest first, so whatever the number of groups at most 7,816 items meet on the
    driver. A side's rows differ from their share by no more than the largest item or a hundredth of all
    rows, where the rest of the rows allows it; so do its positives.

    Rows with a null group are groups of their own by all their columns; an empty table
    gives an empty one.
    """
    shares = shares or {"train": 0.8, "test": 0.2}
    if any(s < 0 for s in shares.values()) or not sum(shares.values()) > 0:
        raise ValueError("shares must not be negative and not all 0")
    shares = {side: s / sum(shares.values()) for side, s in shares.items()}
    spark = rows.sparkSession
    own = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("null:"), F.md5(F.to_json(F.struct(*rows.columns)).cast("binary"))))
    keyed = rows.withColumn("_group", own)
    positive = F.coalesce((F.col(label) == 1).cast("long"), F.lit(0))
    groups = settle(keyed.groupBy("_group").agg(F.count("*").alias("n"), F.sum(positive).alias("p")))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = F.col("n") * LARGE_PARTS >= F.lit(total)
    small = groups.filter(~large).select(
        "_group",
        F.round(F.col("p") * LABEL_SHARES / F.col("n")).cast("int").alias("_share"),
        F.pmod(F.xxhash64("_group"), F.lit(CHUNKS)).cast("int").alias("_chunk"),
        "n",
        "p",
    )
    big = groups.filter(large).orderBy("_group").collect()
    chunks = small.groupBy("_share", "_chunk").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).orderBy("_share", "_chunk").collect()
    sides = place([(r["n"], r["p"]) for r in [*big, *chunks]], shares)
    of_big = spark.createDataFrame([(r["_group"], s) for r, s in zip(big, sides, strict=False)], "_group string, _big string")
    of_chunks = [(r["_share"], r["_chunk"], s) for r, s in zip(chunks, sides[len(big) :], strict=True)]
    of_chunks = spark.createDataFrame(of_chunks, "_share int, _chunk int, _small string")
    # Rows of large groups meet their side without a shuffle; no other group is hot.
    of_small = settle(small.join(F.broadcast(of_chunks), ["_share", "_chunk"]).select("_group", "_small"))
    out = keyed.join(F.broadcast(of_big), "_group", "left")
    found = out.filter("_big is not null").withColumn("side", F.col("_big"))
    rest = out.filter("_big is null").join(of_small, "_group").withColumn("side", F.col("_small")).drop("_small")
    return found.unionByName(rest).select(*rows.columns, "side")


def split_summary(split: DataFrame, shares: dict[str, float], group: str = "group", label: str = "label") -> DataFrame:
    """One row per side: groups, rows, positives and their shares, and how many groups are on several sides."""
    per = split.groupBy(group).agg((F.min("side") != F.max("side")).alias("_both"))
    broken = per.agg(F.count_if("_both").alias("split_groups"))
    wanted = split.sparkSession.createDataFrame([(s, float(v)) for s, v in shares.items()], "side string, wanted_share double")
    sides = split.groupBy("side").agg(
        F.count_distinct(group).alias("groups"), F.count("*").alias("rows"), F.count_if(F.col(label) == 1).alias("positives")
    )
    whole = sides.agg(F.sum("rows").alias("_rows"), F.sum("positives").alias("_positives"))
    return (
        F.broadcast(wanted)
        .join(sides, "side", "left")
        .join(F.broadcast(whole))
        .join(F.broadcast(broken))
        .select(
            "side",
            "wanted_share",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("groups", "rows", "positives")],
            F.try_divide(F.coalesce("rows", F.lit(0)), "_rows").alias("row_share"),
            F.try_divide(F.coalesce("positives", F.lit(0)), "_positives").alias("positive_share"),
            "split_groups",
        )
    )
