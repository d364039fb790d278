"""Mixing of sources to target weights by iterative proportional fitting, natively."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesignal.llm.common import apart, settle, together

SWEEPS = 10
SETTLED_EVERY = 5
TEMPER = 0.9
#: Counted cells or categories up to which a table is broadcast and the cells sit in one partition.
FEW = 10_000
DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"

#: About one token for four bytes.
WEIGHT = "cast(ceil(octet_length(coalesce(text, '')) / 4.0D) as bigint)"
#: The documents carry no topic; this coarse genre stands for one.
TOPIC = (
    "case when length(coalesce(text, '')) < 500 then 'note' when instr(text, ' | ') > 0 then 'table'"
    " when length(text) < 2000 then 'article' when length(text) < 8000 then 'report' else 'book' end"
)
#: A number from 0 to 1 that depends on the id alone (on the text where it is null).
CHANCE = (
    "cast(conv(substring(md5(cast(coalesce(cast(doc_id as string), text, '') as binary)), 1, 8), 16, 10)"
    " as double) / 4294967296D"
)


def _named(name: str) -> str:
    return f"__{name}"


def wanted_shares(cells: DataFrame, key: str, given: dict[str, float] | None, total: float, temper: float) -> tuple[DataFrame, int]:
    """The target share of each observed category, as a column named ``key``_want, and how many there are."""
    sums = cells.groupBy(key).agg(F.sum("__w").alias("__sum"))
    if given:
        named = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{key} string, __given double")
        sums = sums.join(named, key, "left").withColumn("__want", F.coalesce("__given", F.lit(0.0)))
    else:
        sums = sums.withColumn("__want", F.pow(F.col("__sum") / F.lit(total), F.lit(temper)))
    sums = settle(sums.select(key, "__want"))
    n, norm = sums.agg(F.count("*"), F.sum("__want")).first()
    return sums.select(key, (F.col("__want") / F.lit(norm or 1.0)).alias(f"{key}_want")), n


def raked_cells(
    sums: DataFrame, targets: dict[str, dict[str, float]] | None, sweeps: int, temper: float, few: int = FEW
) -> tuple[DataFrame, int]:
    """Cells (one per combination of categories) with the factor p and __docs, and how many there are.

    Up to ``few`` counted cells sit in one partition, in which each step of a sweep
    is a window sum. With more, each step groups the cells by category and
    joins the sums back, broadcast where the counted categories are few.
    """
    keys = [_named(d) for d in DIMENSIONS]
    cells = sums.withColumn("__w", F.col("__weight").cast("double")).where(F.col("__w") > 0)
    n, total = cells.agg(F.count("*"), F.coalesce(F.sum("__w"), F.lit(1.0))).first()
    one, categories = n <= few, {}
    observed = cells
    for name, key in zip(DIMENSIONS, keys, strict=True):
        wanted, categories[key] = wanted_shares(observed, key, (targets or {}).get(name), total, temper)
        cells = cells.join(F.broadcast(wanted) if categories[key] <= few else wanted, key)
    cells = cells.withColumn("__r", F.col("__w") / F.lit(total))
    for sweep in range(sweeps):
        if not one or sweep % SETTLED_EVERY == 0:  # keeps the plan short
            cells = settle(cells)
            cells = cells.coalesce(1) if one else cells
        for key in keys:
            if one:
                cells = cells.withColumn("__s", F.sum("__r").over(Window.partitionBy(key)))
            else:
                now = settle(cells.groupBy(key).agg(F.sum("__r").alias("__s")))
                cells = cells.drop("__s").join(F.broadcast(now) if categories[key] <= few else now, key)
            scaled = F.col("__r") * F.col(f"{key}_want") / F.col("__s")
            cells = cells.withColumn("__r", F.when(F.col("__s") > 0, scaled).otherwise(0.0))
    cells = settle(cells.select(*keys, "__docs", (F.col("__r") * F.lit(total) / F.col("__w")).alias("__f")))
    largest = cells.agg(F.max("__f")).first()[0] or 1.0
    return cells.select(*keys, "__docs", (F.col("__f") / F.lit(largest)).alias("__p")), n


def mix(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    sweeps: int = SWEEPS,
    temper: float = TEMPER,
    topic: str = TOPIC,
    weight: str = WEIGHT,
    few: int = FEW,
) -> DataFrame:
    """All rows and columns; adds topic, weight, p and sampled.

    Token weights are summed by source, language and topic and raked to the
    target shares of each of the three; a cell's raked over its observed weight,
    over the largest such factor, is the probability p with which its
    documents are kept, so that kept tokens have the target shares in expectation
    and no document is repeated. ``targets`` gives shares by category (those not named get none);
    without it the observed shares are tempered (share to the power ``temper``,
    scaled to 1), which lifts what is rare. ``sampled`` is decided by a hash of the id.

    All observed cells are raked. Only tables counted or cut at ``few`` rows are
    broadcast: with up to that many cells the documents are not shuffled; with more, those
    of the ``few`` cells of most documents are not, and the others are joined to
    their cells. A null source or language is a category (``(none)``) of its
    own; a null or empty text has no weight and is kept (p is 1); rows of one
    id share its chance; a null id takes its text's; columns named like a
    result are replaced, others keep their values whatever their names. ``topic`` and ``weight`` are SQL
    over doc_id, text, source and lang. An empty table gives an empty one.
    """
    own, rest = apart(docs, ("doc_id", "text", "source", "lang"))
    rows = own.withColumns({"topic": F.expr(topic), "weight": F.expr(weight)})
    slim = settle(
        rows.groupBy(
            F.coalesce("source", F.lit(NONE)).alias("__source"),
            F.coalesce("lang", F.lit(NONE)).alias("__lang"),
            F.col("topic").alias("__topic"),
        ).agg(F.sum("weight").alias("__weight"), F.count("*").alias("__docs"))
    )

    cells, n = raked_cells(slim, targets, sweeps, temper, few)
    cells = settle(cells)

    rows = rows.withColumns(
        {
            "__source": F.coalesce("source", F.lit(NONE)),
            "__lang": F.coalesce("lang", F.lit(NONE)),
            "__topic": F.col("topic"),
        }
    )
    keys = [_named(d) for d in DIMENSIONS]
    if n <= few:
        rows = rows.join(F.broadcast(cells.drop("__docs")), keys, "left")
    else:
        first = settle(cells.orderBy(F.desc("__docs"), *keys).limit(few))
        others = cells.join(F.broadcast(first), keys, "left_anti").drop("__docs")
        rows = rows.join(F.broadcast(first.drop("__docs")), keys, "left")
        found = F.col("__p").isNotNull() | (F.col("weight") == 0)
        rows = rows.where(found).unionByName(rows.where(~found).drop("__p").join(others, keys, "left"))
    p = F.when(F.col("weight") == 0, 1.0).otherwise(F.coalesce("__p", F.lit(0.0)))
    rows = rows.withColumn("p", p).withColumn("sampled", F.expr(CHANCE) < F.col("p"))
    return together(rows, docs, rest, ("topic", "weight", "p", "sampled"))
