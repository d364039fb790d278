"""Equi-joins on the site key with a checked cardinality."""

import json
import re
from functools import reduce
from operator import and_

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesignal.schema import SITE_KEYS
from sitesignal.sources.scratch import settle

REPEATED = "repeated key in the table"

CARDINALITIES = {
    "one_to_one": (True, True),
    "one_to_many": (True, False),
    "many_to_one": (False, True),
}


def _unique(df: DataFrame, keys, side: str) -> DataFrame:
    """The rows, of which a repeated key ends the job: counted where the join has its rows anyway."""
    n = F.count("*").over(Window.partitionBy(*keys))
    message = F.concat(F.lit(f"{REPEATED} {side} "), F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), F.lit(" ;"))
    whole = reduce(and_, [F.col(k).isNotNull() for k in keys])
    return df.withColumn("_n", n).filter(F.when(whole & (F.col("_n") > 1), F.raise_error(message).cast("boolean")).otherwise(True)).drop("_n")


def validated_join(
    left: DataFrame, right: DataFrame, on=SITE_KEYS, how="inner", validate="one_to_one"
) -> DataFrame:
    """Join; keys must be unique where ``validate`` says so, else ``ValueError`` names a repeated one.

    Each side is shuffled once: rows of a key are counted in the join's own
    partitions, and the joined rows are written to the shared folder as they are checked. A null
    key matches nothing and is never a repeated one.
    """
    if validate not in CARDINALITIES:
        raise ValueError(f"validate must be one of {sorted(CARDINALITIES)}.")
    on = list(on)
    left_unique, right_unique = CARDINALITIES[validate]
    left = _unique(left, on, "left") if left_unique else left
    right = _unique(right, on, "right") if right_unique else right
    try:
        return settle(left.join(right, on, how))
    except PySparkException as error:
        found = re.search(rf"{REPEATED} (left|right) (\{{.*?\}}) ;", str(error))
        if not found:
            raise
        key = tuple(json.loads(found[2]).values())
        raise ValueError(f"Keys are not unique in the {found[1]} table: {key}") from None


def attach_labels(sites: DataFrame, labels: DataFrame, validate: bool = True) -> DataFrame:
    """Sites (or reads) with gene_id and label, null where there is none.

    Join sites before their reads are exploded: the table is then as small as
    it gets.  Labels are broadcast only if Spark knows them to be small.
    """
    right = labels.select(*SITE_KEYS, "gene_id", "label")
    if validate:
        return validated_join(sites, right, how="left", validate="many_to_one")
    return sites.join(right, SITE_KEYS, "left")


def unlabelled_sites(sites: DataFrame, labels: DataFrame) -> DataFrame:
    """Keys of signal sites that have no label row."""
    return sites.select(*SITE_KEYS).join(labels.select(*SITE_KEYS), SITE_KEYS, "left_anti")


def orphan_labels(labels: DataFrame, sites: DataFrame) -> DataFrame:
    """Keys of label rows that have no signal site (set difference)."""
    return labels.select(*SITE_KEYS).join(sites.select(*SITE_KEYS), SITE_KEYS, "left_anti")
