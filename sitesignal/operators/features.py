"""One feature row per site from the per-read table."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitesignal.functions import (
    central_kmer,
    motif_one_hot,
    present,
    sequence_one_hot,
)
from sitesignal.operators.baselines import add_residuals
from sitesignal.operators.quantiles import given_keys, grouped_quantiles
from sitesignal.operators.read_features import SITE_CONTEXT, read_features
from sitesignal.schema import (
    FEATURE_COLUMNS,
    FEATURE_COLUMNS_WITH_RESIDUALS,
    FEATURE_INPUT,
    QUANTILES,
    READ_FEATURES,
    RESIDUAL_FEATURES,
    SEQUENCE_PATTERN,
    SITE_KEYS,
    STATISTICS,
    require_columns,
    statistic_columns,
)
from sitesignal.sources.scratch import settle

# A task holds at most this many values of one site: all features of its reads,
# or where these are more, one feature after the other.  The quantiles of sites
# with more reads than this come from counts, by the same formula.
SITE_VALUE_LIMIT = 600_000
# Values of one feature travel in lists of at most this length.
PIECE = 64
# Up to this many large sites their keys are broadcast, beyond it joined.
BROADCAST_SITES = 10_000


def is_bad_sequence():
    return ~F.coalesce(F.col("sequence").rlike(SEQUENCE_PATTERN), F.lit(False))


def site_sizes(df: DataFrame) -> DataFrame:
    """(site keys, n, bad): rows of each site and rows with a bad sequence.

    Sequences are tested once per site, after rows have been counted.
    """
    counts = df.groupBy(*SITE_KEYS, "sequence").agg(F.count("*").alias("n"))
    return counts.groupBy(*SITE_KEYS).agg(
        F.sum("n").alias("n"), F.sum(F.when(is_bad_sequence(), F.col("n"))).alias("bad")
    )


def split_sites(reads: DataFrame, sizes: DataFrame, max_rows: int, n: int):
    """(reads of sites with at most ``max_rows`` rows, reads of the ``n`` larger ones)."""
    large = sizes.filter(F.col("n") > max_rows).select(*SITE_KEYS)
    if n <= BROADCAST_SITES:
        large = F.broadcast(reads.sparkSession.createDataFrame(large.collect(), large.schema))
    else:
        large = settle(large)
    return reads.join(large, SITE_KEYS, "left_anti"), reads.join(large, SITE_KEYS, "left_semi")


def site_statistics(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean, sd, min, max and quartiles of ``features`` per site.

    ``df`` is the output of ``read_features`` over rows that are partitioned and
    sorted by site, with no site too large for one task.  Each Arrow batch is
    reduced with array operations, so a task holds one batch and one
    unfinished site at a time.
    """
    schema = T.StructType(
        [df.schema[c] for c in SITE_CONTEXT]
        + [T.StructField(c, T.DoubleType()) for c in statistic_columns(features)]
    )

    def reduce_batches(batches):
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if held is not None:
                batch = _join_batches(held, batch)
            starts = _site_starts(batch)
            held = batch.slice(starts[-1])
            if starts[-1] > 0:
                yield _reduce(batch.slice(0, starts[-1]), starts[:-1], features)
        if held is not None:
            yield _reduce(held, np.zeros(1, dtype=np.int64), features)

    return df.mapInArrow(reduce_batches, schema)


def _join_batches(first, second):
    table = pa.Table.from_batches([first, second]).combine_chunks()
    return table.to_batches()[0]


def _site_starts(batch):
    """Row numbers at which a new site begins; rows are sorted by site."""
    names = batch.column("transcript_id").dictionary_encode().indices.to_numpy()
    positions = batch.column("transcript_position").to_numpy()
    new = np.ones(batch.num_rows, dtype=bool)
    new[1:] = (names[1:] != names[:-1]) | (positions[1:] != positions[:-1])
    return np.flatnonzero(new)


def _reduce(batch, starts, features):
    rows_per_site = np.diff(np.append(starts, batch.num_rows))
    site = np.repeat(np.arange(len(starts)), rows_per_site)
    first = pa.array(starts)
    coverage = batch.column("n_reads").to_numpy(zero_copy_only=False).astype(float)
    columns = {c: batch.column(c).take(first) for c in SITE_CONTEXT[:-1]}
    columns["n_reads"] = pa.array(np.fmin.reduceat(coverage, starts)).cast(
        pa.int64(), safe=False
    )
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        for feature in features:
            values = batch.column(feature).to_numpy(zero_copy_only=False)
            stats = _segment_statistics(values, site, starts)
            columns.update({f"{feature}_{s}": pa.array(v) for s, v in stats.items()})
    return pa.RecordBatch.from_pydict(columns)


def _segment_statistics(values, site, starts):
    """Statistics of each run of ``values``; NaN is missing, undefined is 0."""
    given = ~np.isnan(values)
    n = np.add.reduceat(given, starts, dtype=np.int64)
    mean = np.add.reduceat(np.where(given, values, 0.0), starts) / n
    spread = np.where(given, values - mean[site], 0.0)
    variance = np.add.reduceat(spread * spread, starts) / (n - 1)
    ordered = values[np.lexsort((values, site))]
    last = starts + np.maximum(n - 1, 0)
    stats = {
        "mean": mean,
        "sd": np.sqrt(np.where(n > 1, variance, np.nan)),
        "min": ordered[starts],
        "max": ordered[last],
    }
    for name, p in QUANTILES.items():
        position = np.maximum(n - 1, 0) * p
        whole = np.floor(position).astype(np.int64)
        part = position - whole
        low = ordered[starts + whole]
        high = ordered[np.minimum(starts + whole + 1, last)]
        stats[name] = np.where(part > 0, (1 - part) * low + part * high, low)
    return {s: np.nan_to_num(stats[s], nan=0.0, posinf=np.inf, neginf=-np.inf) for s in STATISTICS}


def deep_site_statistics(df: DataFrame, features: list[str], max_rows: int) -> DataFrame:
    """The same statistics where sites of more than ``max_rows`` rows are reduced feature by feature.

    ``df`` as for ``site_statistics``, in whose way other sites are reduced.  The
    values of the larger ones are turned from rows to lists by feature, which
    Spark sorts in their partition; no row is sent again.  A task holds one batch
    and one unfinished feature of one site.
    """
    context = [df.schema[c] for c in SITE_CONTEXT]
    values = T.StructField("_values", T.ArrayType(T.DoubleType()))
    sent = T.StructType([*context, T.StructField("_feature", T.IntegerType()), values])
    schema = T.StructType([*context, *[T.StructField(c, T.DoubleType()) for c in statistic_columns(features)]])
    width = len(features)

    def turn(batches):
        held = deep = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if held is not None:
                batch = _join_batches(held, batch)
            starts = _site_starts(batch)
            sizes = np.diff(np.append(starts, batch.num_rows))
            large = sizes > max_rows
            large[0] |= _site_at(batch, 0) == deep
            held = deep = None
            ready = ~large
            if large[-1]:
                deep = _site_at(batch, starts[-1])
            else:
                held, ready[-1] = batch.slice(starts[-1]), False
            if ready.any():
                yield _finished(_sites_of(batch, ready, sizes), sizes[ready], features)
            if large.any():
                yield from _turned(_sites_of(batch, large, sizes), sizes[large], features)
        if held is not None:
            yield _finished(held, np.array([held.num_rows]), features)

    def merge(batches):
        held = waiting = None
        for batch in batches:
            alone = batch.column("_feature").to_numpy() < 0
            if alone.any():
                yield _side_by_side(batch.filter(pa.array(alone)), 1, features)
            batch = batch.filter(pa.array(~alone))
            if batch.num_rows == 0:
                continue
            if held is not None:
                batch = _join_batches(held, batch)
            ends = np.flatnonzero(np.diff(batch.column("_feature").to_numpy())) + 1
            starts = np.union1d(_site_starts(batch), ends)
            held = batch.slice(starts[-1])
            if starts[-1] > 0:
                done = _merged(batch.slice(0, starts[-1]), starts[:-1])
                waiting = done if waiting is None else _join_batches(waiting, done)
                whole = waiting.num_rows // width * width
                if whole:
                    yield _side_by_side(waiting.slice(0, whole), width, features)
                    waiting = waiting.slice(whole) if whole < waiting.num_rows else None
        if held is not None:
            done = _merged(held, np.zeros(1, dtype=np.int64))
            yield _side_by_side(done if waiting is None else _join_batches(waiting, done), width, features)

    turned = df.mapInArrow(turn, sent).sortWithinPartitions(*SITE_KEYS, "_feature", "sequence")
    return turned.mapInArrow(merge, schema)


def _site_at(batch, row):
    return tuple(batch.column(k)[int(row)].as_py() for k in SITE_KEYS)


def _sites_of(batch, chosen, sizes):
    return batch.filter(pa.array(np.repeat(chosen, sizes)))


def _lists(values, starts):
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values))


def _smallest(batch, starts):
    """Smallest ``n_reads`` of each run, null where none is given."""
    given = batch.column("n_reads").to_numpy(zero_copy_only=False).astype(float)
    return pa.array(np.fmin.reduceat(given, starts), from_pandas=True).cast(pa.int64(), safe=False)


def _finished(batch, sizes, features):
    """One row per site with all of its statistics in one list."""
    sites = _reduce(batch, np.cumsum(sizes) - sizes, features)
    stats = np.column_stack([sites.column(c).to_numpy() for c in statistic_columns(features)])
    return pa.RecordBatch.from_pydict(
        {c: sites.column(c) for c in SITE_CONTEXT}
        | {
            "_feature": pa.array(np.full(len(stats), -1, dtype=np.int32)),
            "_values": _lists(stats.ravel(), np.arange(len(stats)) * stats.shape[1]),
        }
    )


def _turned(batch, sizes, features):
    """The values of each feature in lists of one site each."""
    row = np.arange(batch.num_rows) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    starts = np.flatnonzero(row % PIECE == 0)
    context = {c: batch.column(c).take(pa.array(starts)) for c in SITE_CONTEXT[:-1]}
    context["n_reads"] = _smallest(batch, starts)
    for i, feature in enumerate(features):
        values = batch.column(feature).to_numpy(zero_copy_only=False).astype(float)
        yield pa.RecordBatch.from_pydict(
            context
            | {
                "_feature": pa.array(np.full(len(starts), i, dtype=np.int32)),
                "_values": _lists(values, starts),
            }
        )


def _merged(batch, starts):
    """The statistics of each run of lists, which is one feature of one site, in one list."""
    lists = batch.column("_values")
    values = lists.flatten().to_numpy()
    begins = np.cumsum(lengths := lists.value_lengths().to_numpy()) - lengths
    begins = begins[starts].astype(np.int64)
    site = np.repeat(np.arange(len(starts)), np.diff(np.append(begins, len(values))))
    stats = np.column_stack([*_segment_statistics(values, site, begins).values()])
    columns = {c: batch.column(c).take(pa.array(starts)) for c in SITE_CONTEXT[:-1]}
    columns["n_reads"] = _smallest(batch, starts)
    columns["_values"] = _lists(stats.ravel(), np.arange(len(stats)) * stats.shape[1])
    return pa.RecordBatch.from_pydict(columns)


def _side_by_side(batch, rows, features):
    """One row per site from lists of statistics, of which each site has ``rows`` in order."""
    first = pa.array(np.arange(0, batch.num_rows, rows))
    stats = batch.column("_values").flatten().to_numpy().reshape(len(first), -1)
    columns = {c: batch.column(c).take(first) for c in SITE_CONTEXT}
    columns |= {c: pa.array(s.copy()) for c, s in zip(statistic_columns(features), stats.T)}
    return pa.RecordBatch.from_pydict(columns)


def large_site_statistics(df: DataFrame, features: list[str]) -> DataFrame:
    """The same statistics for sites that no single task should hold.

    Mean, sd, min and max are combined before the shuffle; the quantiles come
    from counting (see ``quantiles``).
    """
    clean = df.select(
        *SITE_CONTEXT, *[present(c).alias(c) for c in features]
    )
    simple = [F.min("n_reads").alias("n_reads")]
    for c in features:
        simple += [
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_samp(c).alias(f"{c}_sd"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    sequences = (
        clean.groupBy(*SITE_KEYS, "sequence")
        .agg(F.count("*").alias("_rows"))
        .groupBy(*SITE_KEYS)
        .agg(F.min(F.struct("sequence", "_rows")).getField("sequence").alias("sequence"))
    )
    joined = grouped_quantiles(
        clean.drop("sequence"),
        SITE_KEYS,
        features,
        list(QUANTILES.values()),
        simple,
    ).join(sequences, SITE_KEYS)
    named = {c: F.col(c) for c in statistic_columns(features) if c in joined.columns}
    for c in features:
        for i, q in enumerate(QUANTILES):
            named[f"{c}_{q}"] = F.get(F.col(f"q_{c}"), F.lit(i))
    return joined.select(
        *SITE_CONTEXT,
        *[
            F.coalesce(F.nanvl(named[c], F.lit(0.0)), F.lit(0.0)).alias(c)
            for c in statistic_columns(features)
        ],
    )


def build_features(
    df: DataFrame, kmer_baselines: DataFrame | None = None,
    validate: bool = True, value_limit: int = SITE_VALUE_LIMIT,
) -> DataFrame:
    """One row per site: the site keys, then 153 feature columns.

    With ``kmer_baselines`` (see ``fit_kmer_baselines``) 21 residual columns
    follow.  Needs the columns ``FEATURE_INPUT``; others are ignored.  One
    small job over the keys and sequences runs at once, to reject bad input
    (``validate``) and to find sites that are too large for one task; the
    result itself is lazy.  ``n_reads`` is the stored coverage, not a recount.
    ``sequence`` and ``n_reads`` are taken as constant within a site (see
    ``quality.metadata_conflicts``); if they are not, the smallest is used.
    """
    require_columns(df, FEATURE_INPUT)
    features = [*READ_FEATURES, *(RESIDUAL_FEATURES if kmer_baselines is not None else [])]
    max_rows = max(1, value_limit // len(features))
    sizes = site_sizes(df)
    given = F.col(SITE_KEYS[0]).isNotNull() & F.col(SITE_KEYS[1]).isNotNull()
    found = sizes.agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_sequences"),
        F.count_if(given & (F.col("n") > max_rows) & (F.col("n") <= value_limit)).alias("deep_sites"),
        F.count_if(given & (F.col("n") > value_limit)).alias("large_sites"),
    ).first()
    if validate and not found["rows"]:
        raise ValueError("The input has no rows.")
    if validate and found["bad_sequences"]:
        example = df.filter(is_bad_sequence()).select("sequence").first()
        raise ValueError(
            f"Expected 7-base sequences over A/C/G/T; got {example['sequence']!r}."
        )
    reads = given_keys(df.select(*FEATURE_INPUT), SITE_KEYS)

    def with_features(rows):
        rows = read_features(rows)
        if kmer_baselines is not None:
            rows = add_residuals(rows, kmer_baselines)
        return rows

    # The raw columns are what is shuffled and sorted, the features follow.
    def statistics(rows):
        order = [*SITE_KEYS, "sequence"]
        rows = rows.repartition(*SITE_KEYS)
        if kmer_baselines is None:
            rows = with_features(rows.sortWithinPartitions(*order))
        else:
            # Spark drops a sort below the join with the baselines.
            rows = with_features(rows).sortWithinPartitions(*order)
        if found["deep_sites"]:
            return deep_site_statistics(rows, features, max_rows)
        return site_statistics(rows, features)

    if found["large_sites"]:
        sizes = given_keys(sizes, SITE_KEYS)
        small, large = split_sites(reads, sizes, max(1, value_limit), found["large_sites"])
        sites = statistics(small).unionByName(
            large_site_statistics(with_features(large), features)
        )
    else:
        sites = statistics(reads)

    wanted = FEATURE_COLUMNS if kmer_baselines is None else FEATURE_COLUMNS_WITH_RESIDUALS
    made = {
        name: column
        for name, column in zip(
            FEATURE_COLUMNS[-47:],
            [*sequence_one_hot("sequence"), *motif_one_hot(central_kmer())],
        )
    }
    return sites.select(*SITE_KEYS, *[made.get(c, F.col(c)) for c in wanted])
