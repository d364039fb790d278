"""Connected components of links, without gathering a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.sources.scratch import settle

#: In how many parts the links of a node are dealt; a hub is thus no single key.
SPREAD = 64


def _with_least(links: DataFrame) -> DataFrame:
    """The links (u, v), each with m, the least v of its u.

    The links of a node are dealt by (u, part of v). The minimum of a node meets
    them in the parts that it has, so a node with most of the links is spread.
    """
    part = F.pmod(F.xxhash64("v"), F.lit(SPREAD)).cast("int")
    links = links.withColumn("part", part)
    parts = links.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("part").alias("part"))
    least = least.select("u", F.explode("part").alias("part"), "m")
    return links.join(settle(least), ["u", "part"]).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of all nodes that have a link (a, b).

    Alternating stars: every node points its larger neighbours, then itself and
    its smaller ones, to the smallest it knows, until nothing changes. Rounds
    grow with the logarithm of the longest chain. Links of a node with itself
    and repeated links change nothing, but for the node being listed; links with
    a null end are passed over; no links give no rows.
    """
    given = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    given = given.where(links["a"].isNotNull() & links["b"].isNotNull()).distinct()
    given = settle(given)
    links, before = given.where(F.col("u") != F.col("v")), None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _with_least(settle(large))
        own = small.select("u", F.col("m").alias("v"))
        rest = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = settle(own.unionByName(rest).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    found = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = found.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")))
    alone = given.where(F.col("u") == F.col("v")).select(F.col("u").alias("node"), F.col("v").alias("root"))
    alone = alone.join(found.select("node"), "node", "left_anti")
    return found.unionByName(alone).distinct()
