"""Signal JSON lines: read, check line by line, flatten to reads.

One line describes one site: transcript -> position -> 7-mer -> reads x 9.
Nothing here fails on a bad line; ``parse_lines`` gives every line a
``reason``, null for a good one, and the caller decides.
"""

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitesignal.functions import central_kmer, is_blank
from sitesignal.schema import (
    READS_SCHEMA,
    SEQUENCE_PATTERN,
    SIGNAL_JSON,
    SIGNALS,
    SITE_KEYS,
)

# Where a line stands: file, split of the file, running number in the split.
LINE_ORDER = ["file", "block", "line_id"]

# A line that is one object in an object in an object and nothing else.  JSON
# parsers stop after the first value, so text behind it needs its own check.
_KEY = r'\s*"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:\s*'
_WHOLE_LINE = (
    r"\A\s*\{" + _KEY + r"\{" + _KEY + r"\{" + _KEY + r'\[[^{}"]*+'
    r"\}\s*\}\s*\}\s*\z"
)


def read_lines(spark: SparkSession, path) -> DataFrame:
    """(file, block, line_id, value) of every line; .gz by its extension.

    ``line_id`` grows with the line within one split of a file and splits are
    ordered by where they start, so LINE_ORDER is the order in the file.
    """
    source = spark.read.text(path)
    names = source.inputFiles()
    packed = [n for n in names if n.lower().endswith(".gz")]
    if not packed or len(packed) >= spark.sparkContext.defaultParallelism:
        return _lines_of(source)
    # A gzip file is one task.  Only unpacking happens there: if there are few,
    # their lines (and no others) are spread by number before the costly parse.
    plain = [unquote(n) for n in names if n not in set(packed)]
    lines = _lines_of(spark.read.text([unquote(n) for n in packed])).repartition("line_id")
    return _lines_of(spark.read.text(plain)).unionAll(lines) if plain else lines


def _lines_of(source: DataFrame) -> DataFrame:
    return source.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"),
        "value",
    )


def skip_blank_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(~is_blank("value"))


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of these lines in file order, however many there are.

    Lines are counted per split, which shows in which split the n-th one
    stands; in that split the lines are ranked.  Two jobs, whatever the input.
    """
    splits = lines.groupBy("file", "block").agg(
        F.count("*").alias("size"), F.min("line_id").alias("first_id")
    )
    # One small row per split of the input, never per line.
    order = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("size").over(order)
    last = (
        splits.withColumn("before", end - F.col("size"))
        .filter((F.col("before") < n) & (F.col("before") + F.col("size") >= n))
        .first()
    )
    if last is None:
        return lines
    inside = (F.col("file") == last["file"]) & (F.col("block") == last["block"])
    head = lines.filter(inside).select("line_id").orderBy("line_id").limit(n - last["before"])
    cut = head.agg(F.max("line_id")).first()[0]
    earlier = (F.col("file") < last["file"]) | (
        (F.col("file") == last["file"]) & (F.col("block") < last["block"])
    )
    return lines.filter(earlier | (inside & (F.col("line_id") <= cut)))


def read_first_lines(spark: SparkSession, path, n: int):
    """(the lines read, of which the first ``n`` that are not blank).

    Files are opened in order and only until they hold enough lines.
    """
    files = sorted(spark.read.text(path).inputFiles())
    used = 1
    while True:
        lines = read_lines(spark, [unquote(f) for f in files[:used]])
        filled = skip_blank_lines(lines)
        if used >= len(files) or filled.count() >= n:
            return lines, first_lines(filled, n)
        used *= 2


def line_number(lines: DataFrame, file: str, block: int, line_id: int) -> int:
    """1-based number of one line in its file, blank lines included."""
    row = (
        lines.filter(F.col("file") == file)
        .agg(
            F.count_if(F.col("block") < block).alias("before"),
            F.count_if((F.col("block") == block) & (F.col("line_id") <= line_id)).alias(
                "within"
            ),
        )
        .first()
    )
    return row["before"] + row["within"]


def parse_lines(lines: DataFrame) -> DataFrame:
    """Decode and check each line.

    Adds transcript_id, transcript_position, sequence, reads
    (array<array<double>>) and ``reason``, null for a good line.
    """
    # A filter on the result would be pushed below this projection with a copy
    # of the decoder for every place it is used in.  Spark moves no filter past
    # an expression that depends on the partition, so each line is decoded once.
    decoded = lines.withColumn(
        "_json",
        F.when(
            F.spark_partition_id() >= 0,
            F.from_json("value", SIGNAL_JSON, {"allowSingleQuotes": "false"}),
        ),
    )

    def entry(column):
        return F.get(F.map_entries(column), F.lit(0))

    decoded = decoded.withColumn("_transcript", entry("_json"))
    decoded = decoded.withColumn("_position", entry("_transcript.value"))
    decoded = decoded.withColumn("_site", entry("_position.value"))

    def single(column):
        return F.coalesce(F.size(column) == 1, F.lit(False))

    reads = F.col("_site.value")
    width = len(SIGNALS)
    shaped = (F.size(reads) > 0) & F.forall(
        reads, lambda r: F.coalesce(F.size(r) == width, F.lit(False))
    )
    finite = F.forall(
        reads,
        lambda r: F.forall(
            r,
            lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
        ),
    )
    position = F.col("_position.key").try_cast("bigint")
    checks = [
        (F.col("_json").isNotNull(), "not valid JSON of a site"),
        (single("_json"), "expected exactly one transcript"),
        (~is_blank("_transcript.key"), "blank transcript id"),
        (single("_transcript.value"), "expected exactly one position"),
        (position.isNotNull(), "position is not an integer"),
        (single("_position.value"), "expected exactly one sequence"),
        (
            F.col("_site.key").rlike(SEQUENCE_PATTERN),
            "expected a 7-mer over A/C/G/T",
        ),
        (shaped, "expected a non-empty list of reads with 9 values each"),
        (finite, "missing or non-finite value"),
        (F.col("value").rlike(_WHOLE_LINE), "text after the JSON value"),
    ]
    reason = F.lit(None).cast("string")
    for passed, text in reversed(checks):
        reason = F.when(~F.coalesce(passed, F.lit(False)), F.lit(text)).otherwise(reason)
    return decoded.select(
        *lines.columns,
        F.col("_transcript.key").alias("transcript_id"),
        position.alias("transcript_position"),
        F.col("_site.key").alias("sequence"),
        reads.alias("reads"),
        reason.alias("reason"),
    )


def rejected_lines(parsed: DataFrame) -> DataFrame:
    """Quarantine: the bad lines with their reason and their text."""
    where = [c for c in LINE_ORDER if c in parsed.columns]
    return parsed.filter(F.col("reason").isNotNull()).select(*where, "reason", "value")


def good_sites(parsed: DataFrame) -> DataFrame:
    """Checked sites: keys, sequence, central 5-mer, coverage, reads."""
    return parsed.filter(F.col("reason").isNull()).select(
        *SITE_KEYS,
        "sequence",
        central_kmer().alias("central_5mer"),
        F.size("reads").cast("bigint").alias("n_reads"),
        "reads",
    )


def duplicate_sites(sites: DataFrame) -> DataFrame:
    """Site keys that occur on more than one line, with their count."""
    return sites.groupBy(*SITE_KEYS).count().filter(F.col("count") > 1)


def explode_reads(sites: DataFrame) -> DataFrame:
    """One row per read, in the order of the list, with a 0-based index.

    Site columns that are no part of the reads schema (gene_id, label) come
    last.
    """
    extra = [c for c in sites.columns if c not in [*READS_SCHEMA.names, "reads"]]
    flat = sites.select("*", F.posexplode("reads").alias("read_idx", "_values"))
    return flat.select(
        *READS_SCHEMA.names[:5],
        F.col("read_idx").cast("bigint").alias("read_idx"),
        *[F.get(F.col("_values"), F.lit(i)).alias(c) for i, c in enumerate(SIGNALS)],
        *extra,
    )


def lookup_site(
    lines: DataFrame, labels: DataFrame, transcript_id=None, transcript_position=None
) -> DataFrame:
    """One checked site with its label row, which must exist exactly once.

    ``lines`` are lines of text, or parsed ones.  Without a key the first line in
    file order that is not blank is taken, and of texts only that one is parsed.
    """
    parsed = "reason" in lines.columns
    if transcript_id is None:
        lines = first_lines(lines if parsed else skip_blank_lines(lines), 1)
    sites = lines if parsed else parse_lines(lines)
    if transcript_id is not None:
        sites = sites.filter(
            (F.col("transcript_id") == transcript_id)
            & (F.col("transcript_position") == transcript_position)
        )
        sites = sites.orderBy(*LINE_ORDER).limit(1)
    row = sites.select(*SITE_KEYS, "reason").first()  # the reads stay where they are
    if row is None:
        raise ValueError("No such site.")
    if row["reason"] is not None:
        raise ValueError(f"The site is not valid: {row['reason']}.")
    site = sites.drop(*LINE_ORDER, "value", "reason")
    match = labels.filter(
        (F.col("transcript_id") == row["transcript_id"])
        & (F.col("transcript_position") == row["transcript_position"])
    ).limit(2)
    found = match.collect()
    if len(found) != 1:
        raise ValueError(f"Expected one matching label, found {len(found)} or more.")
    label = labels.sparkSession.createDataFrame(found, labels.schema)
    return site.join(F.broadcast(label), SITE_KEYS).withColumn(
        "n_reads", F.size("reads").cast("bigint")
    )
