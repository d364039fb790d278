"""From reads to sites."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.functions import is_drach, present
from sitesignal.operators.joins import validated_join
from sitesignal.schema import CENTRAL_SIGNALS, SITE_KEYS, SITE_METADATA


def site_table(reads: DataFrame, read_rows: str | None = None) -> DataFrame:
    """One row per site with its metadata.

    Metadata is constant within a site (``quality.metadata_conflicts``); if it
    is not, the smallest combination is used.  Reads are first counted per
    site and metadata by hashing, so that the aggregate over texts, for which
    Spark sorts, sees about one row per site and not one per read.  With
    ``read_rows`` a column of that name holds the rows counted per site.
    """
    metadata = [c for c in SITE_METADATA if c in reads.columns]
    combinations = reads.groupBy(*SITE_KEYS, *metadata).agg(F.count("*").alias("_rows"))
    return (
        combinations.groupBy(*SITE_KEYS)
        .agg(F.min(F.struct(*metadata, "_rows")).alias("_site"), F.sum("_rows").alias("_all"))
        .select(
            *SITE_KEYS,
            *[F.col(f"_site.{c}") for c in metadata],
            *([F.col("_all").alias(read_rows)] if read_rows else []),
        )
    )


def labelled(df: DataFrame) -> DataFrame:
    """Rows that have a label."""
    return df.filter(F.col("label").isNotNull() & ~F.isnan("label"))


def with_gene(df: DataFrame) -> DataFrame:
    """Rows that have a gene id."""
    return df.filter(F.col("gene_id").isNotNull())


def unexpected_labels(df: DataFrame) -> DataFrame:
    """Rows whose label is given but is neither 0 nor 1."""
    return labelled(df).filter(~F.col("label").isin(0, 1))


def site_labels(reads: DataFrame, validate: bool = True) -> DataFrame:
    """(site keys, label), one row per site.

    With ``validate``, sites with more than one label and null keys raise
    ``ValueError`` at once.
    """
    label = present("label")
    per_site = reads.groupBy(*SITE_KEYS).agg(
        F.min(label).alias("label"),
        F.max(label).alias("_max"),
        F.count(label).alias("_given"),
        F.count("*").alias("_rows"),
    )
    if validate:
        conflict = (F.col("label") != F.col("_max")) | (
            (F.col("_given") > 0) & (F.col("_given") < F.col("_rows"))
        )
        no_key = F.col(SITE_KEYS[0]).isNull() | F.col(SITE_KEYS[1]).isNull()
        found = per_site.agg(
            F.count_if(F.coalesce(conflict, F.lit(False))).alias("conflicts"),
            F.count_if(no_key).alias("no_key"),
        ).first()
        if found["conflicts"]:
            raise ValueError(f"{found['conflicts']} sites have conflicting labels.")
        if found["no_key"]:
            raise ValueError("Missing site identifiers.")
    return per_site.select(*SITE_KEYS, "label")


def site_means(
    reads: DataFrame, labels: DataFrame | None = None, columns=CENTRAL_SIGNALS
) -> DataFrame:
    """Mean of ``columns`` over the reads of each site, and the site's label.

    Without ``labels`` only labelled reads count and the label is the site's
    own: one aggregate instead of an aggregate and a join.  With a label table
    all reads count and its label is attached, null where it has none.
    """
    means = [F.avg(present(c)).alias(c) for c in columns]
    if labels is None:
        return (
            labelled(reads).groupBy(*SITE_KEYS).agg(*means, F.min("label").alias("label"))
        )
    return validated_join(
        reads.groupBy(*SITE_KEYS).agg(*means),
        labels.select(*SITE_KEYS, "label"),
        how="left",
        validate="many_to_one",  # the left side was just grouped by the keys
    )


def unexpected_motifs(sites: DataFrame) -> DataFrame:
    """Sites whose central 5-mer is no DRACH motif (or is missing)."""
    return sites.filter(~is_drach("central_5mer")).select(
        *SITE_KEYS, "sequence", "central_5mer"
    )
