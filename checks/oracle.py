"""DuckDB SQL for the registered queries, written apart from the library."""

SIGNALS = [
    "minus1_dwell", "minus1_signal_sd", "minus1_signal_mean",
    "central_dwell", "central_signal_sd", "central_signal_mean",
    "plus1_dwell", "plus1_signal_sd", "plus1_signal_mean",
]
CENTRAL = ["central_dwell", "central_signal_sd", "central_signal_mean"]
KEYS = "transcript_id, transcript_position"

SEQUENCE = """concat(
    substr('ACGT', CAST(code % 4 + 1 AS INT), 1), substr('AGT', CAST(code % 3 + 1 AS INT), 1),
    substr('AG', CAST(code % 2 + 1 AS INT), 1), CASE WHEN code % 40 = 0 THEN 'CC' ELSE 'AC' END,
    substr('ACT', CAST(code % 11 % 3 + 1 AS INT), 1), substr('ACGT', CAST(code % 7 % 4 + 1 AS INT), 1))"""

READS = f"""
base AS (
  SELECT *, CASE WHEN l_partkey % 100 = 0 THEN 1000 + l_partkey ELSE l_partkey % 50 END AS pos
  FROM lineitem),
coded AS (SELECT *, l_suppkey * 31 + pos AS code FROM base),
full_reads AS (
  SELECT concat('T', CAST(l_suppkey AS VARCHAR)) AS transcript_id, pos AS transcript_position,
    {SEQUENCE} AS sequence, substr({SEQUENCE}, 2, 5) AS central_5mer,
    count(*) OVER (PARTITION BY l_suppkey, pos) AS n_reads,
    row_number() OVER (PARTITION BY l_suppkey, pos ORDER BY l_orderkey, l_linenumber, l_partkey,
      l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 AS read_idx,
    l_quantity / 4000.0::DOUBLE AS minus1_dwell,
    1.0::DOUBLE + l_discount * 40.0::DOUBLE AS minus1_signal_sd,
    80.0::DOUBLE + l_tax * 500.0::DOUBLE AS minus1_signal_mean,
    l_extendedprice / 5000000.0::DOUBLE AS central_dwell,
    1.0::DOUBLE + l_linenumber::DOUBLE * 0.9::DOUBLE AS central_signal_sd,
    90.0::DOUBLE + l_extendedprice / 2500.0::DOUBLE AS central_signal_mean,
    (l_orderkey % 97 + 1)::DOUBLE / 4000.0::DOUBLE AS plus1_dwell,
    1.0::DOUBLE + (l_orderkey % 53)::DOUBLE * 0.2::DOUBLE AS plus1_signal_sd,
    70.0::DOUBLE + (l_partkey % 61)::DOUBLE AS plus1_signal_mean,
    CASE WHEN l_suppkey % 11 <> 0 THEN concat('G', CAST(l_suppkey % 37 AS VARCHAR)) END AS gene_id,
    CASE WHEN code % 17 <> 0 THEN CASE WHEN code % 13 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS label,
    code, l_partkey, l_linenumber
  FROM coded),
reads AS (SELECT * EXCLUDE (code, l_partkey, l_linenumber) FROM full_reads),
graded AS (
  SELECT * EXCLUDE (label), ([0.0, 0.25, 0.5, 0.7, 0.75, 0.95, 1.0]::DOUBLE[])[code % 7 + 1] AS label
  FROM full_reads),
broken AS (
  SELECT * REPLACE (CASE WHEN l_partkey % 29 <> 0 THEN gene_id END AS gene_id,
    CASE WHEN l_partkey % 31 = 0 THEN 'XXXXX' ELSE central_5mer END AS central_5mer,
    n_reads + (code % 37 = 0)::BIGINT AS n_reads, l_linenumber::BIGINT AS read_idx)
  FROM full_reads),
a AS (SELECT * FROM full_reads WHERE code % 5 <> 0),
b AS (SELECT * REPLACE (CASE WHEN code % 19 = 0 THEN 1.0 - label ELSE label END AS label)
  FROM full_reads WHERE code % 7 <> 0),
sites AS (SELECT DISTINCT {KEYS}, sequence, central_5mer, n_reads, gene_id, label FROM reads),
graded_sites AS (SELECT DISTINCT {KEYS}, sequence, central_5mer, n_reads, gene_id, label FROM graded),
pairs AS (
  SELECT {KEYS}, in_a IS NOT NULL AS in_a, in_b IS NOT NULL AS in_b, label_a, label_b
  FROM (SELECT DISTINCT {KEYS}, label AS label_a, true AS in_a FROM a)
  FULL JOIN (SELECT DISTINCT {KEYS}, label AS label_b, true AS in_b FROM b) USING ({KEYS})),
comparable AS (SELECT * FROM pairs WHERE in_a AND in_b AND label_a IS NOT NULL AND label_b IS NOT NULL)"""

ORDERS = f"""
o AS (SELECT *, o_custkey * 31 + o_orderkey AS code FROM orders),
lines AS (
  SELECT o_orderkey AS line_id, concat('T', CAST(o_custkey AS VARCHAR)) AS transcript_id,
    o_orderkey AS transcript_position, {SEQUENCE} AS sequence, o_orderkey % 7 + 1 AS n_reads,
    o_totalprice,
    CASE o_orderkey % 20
      WHEN 1 THEN 'expected exactly one transcript'
      WHEN 2 THEN 'blank transcript id'
      WHEN 3 THEN 'position is not an integer'
      WHEN 4 THEN 'expected a 7-mer over A/C/G/T'
      WHEN 5 THEN 'expected a non-empty list of reads with 9 values each'
      WHEN 6 THEN 'expected a non-empty list of reads with 9 values each'
      WHEN 7 THEN 'missing or non-finite value'
      WHEN 8 THEN 'text after the JSON value'
      WHEN 9 THEN 'not valid JSON of a site'
      WHEN 10 THEN 'expected exactly one position'
      WHEN 11 THEN 'expected exactly one sequence' END AS reason
  FROM o),
good AS (SELECT * FROM lines WHERE line_id % 20 >= 12),
labels_table AS (
  SELECT CASE WHEN o_orderkey % 10 NOT IN (1, 2) THEN concat('G', CAST(o_custkey % 37 AS VARCHAR)) END AS gene_id,
    concat('T', CAST(o_custkey AS VARCHAR)) AS transcript_id,
    CASE WHEN o_orderkey % 50 = 1 THEN o_orderkey + 10000000000 ELSE o_orderkey END AS transcript_position,
    CASE o_orderkey % 8 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS label
  FROM orders WHERE o_orderkey % 3 <> 0)"""


def r(expression, name=None):
    """Round to 6 digits; the shift keeps means of decimal values off ties."""
    alias = f" AS {name}" if name else ""
    return f"round(({expression}) + 1.23e-8, 6){alias}"


def rounded(names):
    return ", ".join(r(n, n) for n in names)


def on_reads(sql, extra=""):
    return f"WITH {READS}{extra} {sql}"


def on_orders(sql, extra=""):
    return f"WITH {ORDERS}{extra} {sql}"


def exploded(table):
    """Reads of the order lines, without JSON."""
    values = [
        "(line_id % 97 + 1)::DOUBLE / 4000.0::DOUBLE",
        "1.0::DOUBLE + i::DOUBLE * 0.5::DOUBLE",
        "80.0::DOUBLE + (line_id % 31)::DOUBLE",
        "o_totalprice / 5000000.0::DOUBLE",
        "1.0::DOUBLE + (line_id % 53)::DOUBLE * 0.2::DOUBLE",
        "90.0::DOUBLE + i::DOUBLE",
        "(i::DOUBLE + 1.0::DOUBLE) / 1000.0::DOUBLE",
        "2.0::DOUBLE + (line_id % 7)::DOUBLE",
        "70.0::DOUBLE + o_totalprice / 10000.0::DOUBLE",
    ]
    named = ", ".join(r(v, n) for v, n in zip(values, SIGNALS))
    return f"""SELECT {KEYS}, sequence, substr(sequence, 2, 5) AS central_5mer, n_reads, i AS read_idx, {named}
      FROM (SELECT *, unnest(range(n_reads)) AS i FROM {table})"""


LOGS = {p: f"ln({p}_dwell)" for p in ["minus1", "central", "plus1"]}
READ_FEATURES = {
    **{f"{p}_log_dwell": LOGS[p] for p in LOGS},
    **{f"{p}_signal_{k}": f"{p}_signal_{k}" for k in ["sd", "mean"] for p in LOGS},
    **{f"dwell_contrast_{p}": f"{LOGS['central']} - {LOGS[p]}" for p in ["minus1", "plus1"]},
    **{
        f"{k}_contrast_{p}": f"central_signal_{k} - {p}_signal_{k}"
        for k in ["sd", "mean"]
        for p in ["minus1", "plus1"]
    },
}
BASELINE_FEATURES = ["central_log_dwell", "central_signal_sd", "central_signal_mean"]
DRACH = [
    "AAACA", "AAACC", "AAACT", "AGACA", "AGACC", "AGACT", "GAACA", "GAACC", "GAACT",
    "GGACA", "GGACC", "GGACT", "TAACA", "TAACC", "TAACT", "TGACA", "TGACC", "TGACT",
]
STATISTICS = {
    "mean": "avg({0})",
    "sd": "coalesce(stddev_samp({0}), 0)",
    "min": "min({0})",
    "max": "max({0})",
    "p25": "quantile_cont({0}, 0.25)",
    "median": "quantile_cont({0}, 0.5)",
    "p75": "quantile_cont({0}, 0.75)",
}


def derived(table="reads"):
    listed = ", ".join(f"{e} AS f_{n}" for n, e in READ_FEATURES.items())
    return f"(SELECT *, {listed} FROM {table})"


def statistics(features, names):
    return ", ".join(
        r(STATISTICS[s].format(f"f_{n}"), f"{n}_{s}") for n in features for s in names
    )


SEQUENCE_HOT = ", ".join(
    f"(substr(sequence, {p + 1}, 1) = '{b}')::TINYINT AS seq_pos{p}_{b}"
    for p in range(7)
    for b in "ACGT"
)
MOTIF_HOT = ", ".join(
    [f"(central_5mer = '{m}')::TINYINT AS motif_{m}" for m in DRACH]
    + [
        "(central_5mer NOT IN (" + ", ".join(f"'{m}'" for m in DRACH) + "))::TINYINT AS motif_other"
    ]
)

BASELINES = f""", fitted AS (
  SELECT CASE WHEN grouping(central_5mer) = 1 THEN '__global__' ELSE central_5mer END AS motif,
    {", ".join(f"median(f_{n}) AS b_{n}" for n in BASELINE_FEATURES)}
  FROM {derived("a")} GROUP BY GROUPING SETS ((central_5mer), ())),
residuals AS (
  SELECT d.*, {", ".join(
      f"f_{n} - coalesce(m.b_{n}, g.b_{n}) AS f_{n}_kmer_resid" for n in BASELINE_FEATURES)}
  FROM {derived()} d LEFT JOIN fitted m ON d.central_5mer = m.motif
  JOIN fitted g ON g.motif = '__global__')"""
RESIDUALS = [f"{n}_kmer_resid" for n in BASELINE_FEATURES]


def describe(column, percentiles):
    parts = [
        f"count({column}) AS count",
        r(f"avg({column})", "mean"),
        r(f"stddev_samp({column})", "std"),
        r(f"min({column})::DOUBLE", "min"),
        *[r(f"quantile_cont({column}::DOUBLE, {p / 100})", f"p{p:02d}") for p in percentiles],
        r(f"max({column})::DOUBLE", "max"),
    ]
    return ", ".join(parts)


def label_counts(labels):
    names = ["label_" + f"{v:g}".replace(".", "_") for v in labels]
    return names, ", ".join(
        f"count(*) FILTER (label = {v}) AS {n}" for v, n in zip(labels, names)
    )


GRADES = [0.0, 0.25, 0.5, 0.7, 0.75, 0.95, 1.0]
GRADE_NAMES, GRADE_COUNTS = label_counts(GRADES)
_, BINARY_COUNTS = label_counts([0, 1])
BOTH_MISSING = "label IS NOT NULL"


def percentages(names, table):
    return ", ".join(
        r(f"100.0 * {n}::DOUBLE / nullif((SELECT sum({n}) FROM {table}), 0)", n) for n in names
    )


def histogram(source, bins, lo=None, hi=None):
    """``source`` yields x; upper edges belong to the next bin, the last is closed."""
    if lo is None:
        bounds = """SELECT min(x) - CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END AS lo,
          max(x) + CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END AS hi FROM v"""
    else:
        bounds = f"SELECT {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi"
    return f""", v AS ({source}),
edges AS (
  SELECT k::INT AS bin, lo + k * ((hi - lo) / {bins}::DOUBLE) AS lower_edge,
    CASE WHEN k = {bins - 1} THEN hi ELSE lo + (k + 1) * ((hi - lo) / {bins}::DOUBLE) END AS upper_edge
  FROM ({bounds}), range({bins}) AS t(k))
SELECT bin, {r("lower_edge", "lower")}, {r("upper_edge", "upper")},
  (SELECT count(*) FROM v WHERE x >= lower_edge AND (x < upper_edge OR (bin = {bins - 1} AND x <= upper_edge))) AS count
FROM edges"""


def density():
    parts = []
    for c in CENTRAL:
        parts.append(f"""
SELECT '{c}' AS feature, g.label, e.bin, {r("e.lower_edge", "lower")}, {r("e.upper_edge", "upper")},
  coalesce(h.n, 0) AS count, {r("coalesce(h.n, 0) / (g.n * ((e.hi - e.lo) / 40))", "density")}
FROM (SELECT label, count(*) AS n FROM graded GROUP BY label) g,
  (SELECT k::INT AS bin, lo, hi, lo + k * ((hi - lo) / 40::DOUBLE) AS lower_edge,
     CASE WHEN k = 39 THEN hi ELSE lo + (k + 1) * ((hi - lo) / 40::DOUBLE) END AS upper_edge
   FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM graded), range(40) AS t(k)) e
LEFT JOIN (
  SELECT label, bin, count(*) AS n FROM (
    SELECT label, (SELECT count(*) FROM (
        SELECT k FROM range(1, 40) AS t(k), (SELECT min({c}) AS lo, max({c}) AS hi FROM graded)
        WHERE u.x >= lo + k * ((hi - lo) / 40::DOUBLE)))::INT AS bin
    FROM (SELECT label, {c} AS x FROM graded) u) GROUP BY label, bin) h
  ON h.label = g.label AND h.bin = e.bin""")
    return " UNION ALL ".join(parts)


def boxes(source):
    parts = []
    for c in CENTRAL:
        parts.append(f"""
SELECT '{c}' AS feature, label, count(*) AS n, {r("least(min(x) FILTER (x >= q1 - 1.5 * (q3 - q1)), any_value(q1))", "low_whisker")},
  {r("any_value(q1)", "q1")}, {r("any_value(q2)", "median")}, {r("any_value(q3)", "q3")},
  {r("greatest(max(x) FILTER (x <= q3 + 1.5 * (q3 - q1)), any_value(q3))", "high_whisker")}
FROM (SELECT label, {c} AS x, quantile_cont({c}, 0.25) OVER w AS q1, quantile_cont({c}, 0.5) OVER w AS q2,
        quantile_cont({c}, 0.75) OVER w AS q3 FROM {source} WHERE label IS NOT NULL WINDOW w AS (PARTITION BY label))
GROUP BY label""")
    return " UNION ALL ".join(parts)


MEANS = ", ".join(f"avg({c}) AS {c}" for c in CENTRAL)
MEAN_SITES = f", means AS (SELECT {KEYS}, {MEANS}, min(label) AS label FROM reads WHERE label IS NOT NULL GROUP BY {KEYS})"
GRADED_MEANS = f", means AS (SELECT {KEYS}, {MEANS}, min(label) AS label FROM graded GROUP BY {KEYS})"

BROKEN_SITES = f""", broken_sites AS (
  SELECT {KEYS}, count(DISTINCT gene_id) + max((gene_id IS NULL)::INT) > 1
      OR count(DISTINCT central_5mer) > 1 AS conflict,
    count(*) AS observed_reads, min(n_reads) AS stored_n_reads
  FROM broken GROUP BY {KEYS})"""
DUPLICATES = f"(SELECT {KEYS}, read_idx, count(*) AS rows FROM broken GROUP BY {KEYS}, read_idx HAVING count(*) > 1)"

READ_COLUMNS = f"{KEYS}, sequence, central_5mer, n_reads, read_idx, {rounded(SIGNALS)}"
ALL_READ_COLUMNS = ["transcript_id", "transcript_position", "sequence", "central_5mer", "n_reads", *SIGNALS, "gene_id", "label"]


def overview(name):
    return f"""SELECT '{name}' AS dataset, (SELECT count(*) FROM {name}) AS reads, count(*) AS sites,
  count(DISTINCT transcript_id) AS transcripts, count(DISTINCT gene_id) AS genes,
  count(*) FILTER (label = 1) AS positive_sites,
  {r("100.0 * count(*) FILTER (label = 1) / count(label)", "positive_pct")},
  {r("median(n_reads)", "median_reads")}, min(n_reads) AS min_reads, max(n_reads) AS max_reads
FROM (SELECT DISTINCT {KEYS}, n_reads, gene_id, label FROM {name})"""


TRANSCRIPT_LABELS = """(SELECT transcript_id, CASE WHEN s % 3 = 0 THEN (s % 2)::DOUBLE WHEN s % 3 = 1 THEN (transcript_position % 2)::DOUBLE WHEN transcript_position % 2 = 0 THEN 1.0::DOUBLE END AS label FROM (SELECT *, substr(transcript_id, 2)::BIGINT AS s FROM sites))"""


def build():
    ingested = f"""SELECT e.*, l.gene_id, l.label FROM ({exploded("lines")}) e
      LEFT JOIN labels_table l USING ({KEYS})"""
    top = "coalesce(label_0, 0) + coalesce(label_1, 0) DESC, sequence LIMIT 20"
    counts = f", counts AS (SELECT sequence, {BINARY_COUNTS} FROM sites WHERE label IS NOT NULL GROUP BY sequence)"
    graded_counts = ", counts AS (SELECT {0}, " + GRADE_COUNTS + " FROM graded_sites GROUP BY {0})"
    return {
        "src1_signal_text": on_orders(f"SELECT {KEYS}, sequence, n_reads, NULL::VARCHAR AS reason FROM lines"),
        "src2_nonblank_lines": on_orders("SELECT line_id FROM lines WHERE line_id % 20 <> 0"),
        "src3_label_csv": on_orders("SELECT * FROM labels_table"),
        "src4_raw_label_csv": on_orders("SELECT * FROM labels_table"),
        "src5_reads_columns": on_reads(f"SELECT {KEYS}, label FROM reads"),
        "src6_preview": on_reads(f"SELECT {READ_COLUMNS}, gene_id, label FROM reads ORDER BY {KEYS}, read_idx LIMIT 5".replace(f"ORDER BY {KEYS}", "ORDER BY transcript_id, transcript_position")),
        "snk5_first_sites": on_orders(f"SELECT * FROM ({ingested}) WHERE transcript_position IN (SELECT line_id FROM lines ORDER BY line_id LIMIT 100)"),
        "ent1_ingest_reads": on_orders(ingested),
        "par1_line_checks": on_orders("SELECT line_id, reason FROM lines WHERE line_id % 20 <> 0"),
        "par10_rejected_lines": on_orders("SELECT reason, count(*) AS lines, min(line_id) AS first_line FROM lines WHERE reason IS NOT NULL GROUP BY reason"),
        "par11_duplicate_sites": on_reads(f"SELECT {KEYS}, count(*) AS count FROM reads GROUP BY {KEYS} HAVING count(*) > 1"),
        "par13_reads_from_json": on_orders(exploded("good")),
        "par14_site_coverage": on_orders(f"SELECT {KEYS}, n_reads FROM good"),
        "par15_central_5mer": on_orders(f"SELECT {KEYS}, sequence, substr(sequence, 2, 5) AS central_5mer FROM good"),
        "par16_site_lookup": on_orders(f"SELECT {KEYS}, sequence, n_reads, gene_id, label FROM lines JOIN labels_table USING ({KEYS}) WHERE line_id % 3 = 2 ORDER BY line_id LIMIT 1"),
        "lab7_checked_labels": on_orders("SELECT * FROM labels_table"),
        "prj1_read_features": on_reads(f"SELECT {KEYS}, {', '.join(r(e, n) for n, e in READ_FEATURES.items())} FROM reads"),
        "prj3_seq_onehot": on_reads(f"SELECT {KEYS}, {SEQUENCE_HOT} FROM sites"),
        "prj4_motif_onehot": on_reads(f"SELECT {KEYS}, {MOTIF_HOT} FROM sites"),
        "prj6_unexpected_motifs": on_reads(f"SELECT {KEYS}, sequence, central_5mer FROM sites WHERE NOT regexp_full_match(central_5mer, '[AGT][AG]AC[ACT]')"),
        "prj8_kmer_residuals": on_reads(f"SELECT {KEYS}, {', '.join(r('f_' + n, n) for n in [*BASELINE_FEATURES, *RESIDUALS])} FROM residuals", BASELINES),
        "prj10_plot_groups": on_reads("SELECT label::INT::VARCHAR AS site_label, count(*) AS rows FROM reads WHERE label IN (0, 1) GROUP BY 1"),
        "fil1_labelled_sites": on_reads("SELECT * FROM sites WHERE label IS NOT NULL"),
        "fil2_excluded_rows": on_reads(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER (label IS NULL) AS excluded FROM reads" for c in CENTRAL)),
        "fil3_coverage_below": on_reads(" UNION ALL ".join(f"SELECT 'n_reads < {n}' AS condition, count(*) FILTER (n_reads < {n}) AS sites, {r(f'100.0 * count(*) FILTER (n_reads < {n}) / count(*)', 'percentage')} FROM sites" for n in [5, 10, 20])),
        "fil4_unexpected_labels": on_reads(f"SELECT {KEYS}, label FROM graded_sites WHERE label NOT IN (0, 1)"),
        "fil5_sites_with_gene": on_reads(f"SELECT {KEYS}, gene_id FROM sites WHERE gene_id IS NOT NULL"),
        "fil6_disagreements": on_reads(f"SELECT {KEYS}, label_a, label_b FROM comparable WHERE label_a <> label_b ORDER BY transcript_id, transcript_position LIMIT 10"),
        "fil6_all_disagreements": on_reads(f"SELECT {KEYS}, label_a, label_b FROM comparable WHERE label_a <> label_b"),
        "fil7_complete_transcripts": on_reads("SELECT transcript_id, count(*) AS n_sites, count(DISTINCT label) AS n_distinct_values, count(*) - count(label) AS n_missing_values FROM " + TRANSCRIPT_LABELS + " GROUP BY transcript_id HAVING count(*) > 1 AND count(*) = count(label)"),
        "joi1_sites_with_labels": on_orders(f"SELECT {KEYS}, sequence, substr(sequence, 2, 5) AS central_5mer, n_reads, gene_id, label FROM good LEFT JOIN labels_table USING ({KEYS})"),
        "joi2_shared_sites": on_reads(f"SELECT {KEYS}, label_a, label_b FROM pairs WHERE in_a AND in_b"),
        "joi3_site_means_with_labels": on_reads(f"SELECT {KEYS}, {rounded(CENTRAL)}, label FROM (SELECT {KEYS}, {MEANS} FROM reads GROUP BY {KEYS}) LEFT JOIN (SELECT DISTINCT {KEYS}, label FROM a) USING ({KEYS})"),
        "joi5_unlabelled_sites": on_orders(f"SELECT {KEYS} FROM good ANTI JOIN labels_table USING ({KEYS})"),
        "joi6_orphan_labels": on_orders(f"SELECT {KEYS} FROM labels_table ANTI JOIN good USING ({KEYS})"),
        "agg1_site_stats": on_reads(f"SELECT {KEYS}, {statistics(READ_FEATURES, ['mean', 'sd', 'min', 'max'])} FROM {derived()} GROUP BY {KEYS}"),
        "agg2_site_quantiles": on_reads(f"SELECT {KEYS}, {statistics(READ_FEATURES, ['p25', 'median', 'p75'])} FROM {derived()} GROUP BY {KEYS}"),
        "agg6_kmer_baselines": on_reads(f"SELECT CASE WHEN grouping(central_5mer) = 1 THEN '__global__' ELSE central_5mer END AS central_5mer, {', '.join(r(f'median(f_{n})', n) for n in BASELINE_FEATURES)} FROM {derived()} GROUP BY GROUPING SETS ((central_5mer), ())"),
        "agg7_dataset_summary": on_reads("SELECT (SELECT count(*) FROM reads) AS site_read_observations, count(*) AS sites, count(DISTINCT transcript_id) AS transcripts, count(DISTINCT gene_id) AS genes_with_metadata, count(*) - count(label) AS sites_without_labels, (SELECT count(*) - count(label) FROM reads) AS read_rows_without_labels FROM sites"),
        "agg8_missing_values": on_reads(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM reads" for c in ALL_READ_COLUMNS)),
        "agg9_class_balance": on_reads(" UNION ALL ".join(f"SELECT {v}::DOUBLE AS label, count(*) FILTER (label = {v}) AS sites, {r(f'100.0 * count(*) FILTER (label = {v}) / count(*) FILTER (label IN (0, 1))', 'percentage')} FROM sites" for v in [0, 1])),
        "agg10_label_distribution": on_reads(f"SELECT label, count(*) AS sites, {r('100.0 * count(*) / (SELECT count(label) FROM graded_sites)', 'percentage')} FROM graded_sites GROUP BY label"),
        "agg11_coverage_describe": on_reads(f"SELECT {describe('n_reads', [1, 5, 25, 50, 75, 95, 99])} FROM sites"),
        "agg12_coverage_by_label": on_reads(f"SELECT label, {describe('n_reads', [25, 50, 75])} FROM sites WHERE label IS NOT NULL GROUP BY label"),
        "agg13_sites_per_gene": on_reads("SELECT gene_id, count(*) AS n_sites FROM sites WHERE gene_id IS NOT NULL GROUP BY gene_id"),
        "agg13_sites_per_transcript": on_reads("SELECT transcript_id, count(*) AS n_sites FROM sites GROUP BY transcript_id"),
        "agg14_size_histogram": on_reads("SELECT n AS group_size, count(*) AS groups FROM (SELECT count(*) AS n FROM sites GROUP BY transcript_id) GROUP BY n"),
        "agg15_transcript_labels": on_reads("SELECT transcript_id, count(*) AS n_sites, count(DISTINCT label) AS n_distinct_values, count(*) - count(label) AS n_missing_values FROM graded_sites GROUP BY transcript_id"),
        "agg15_constant_label_share": on_reads(f"SELECT count(*) AS eligible_transcripts, {r('100.0 * count(*) FILTER (k = 1) / nullif(count(*), 0)', 'constant_label_pct')} FROM (SELECT count(DISTINCT label) AS k FROM {TRANSCRIPT_LABELS} GROUP BY transcript_id HAVING count(*) > 1 AND count(*) = count(label))"),
        "agg16_kmer_crosstab": on_reads("SELECT * FROM counts", counts),
        "agg16_open_crosstab": on_reads("SELECT * FROM counts", graded_counts.format("central_5mer")),
        "agg16_close_labels": on_reads("SELECT central_5mer, count(*) FILTER (transcript_position % 2 = 0) AS label_0_1234567, count(*) FILTER (transcript_position % 2 = 1) AS label_0_1234568 FROM sites GROUP BY central_5mer"),
        "agg16_label_crosstab": on_reads(" UNION ALL ".join(f"SELECT {v}::DOUBLE AS label_a, count(*) FILTER (label_a = {v} AND label_b = 0) AS label_0, count(*) FILTER (label_a = {v} AND label_b = 1) AS label_1 FROM comparable" for v in [0, 1])),
        "agg17_column_percentages": on_reads(f"SELECT sequence, {percentages(['label_0', 'label_1'], 'counts')} FROM counts", counts),
        "agg18_motif_summary": on_reads(f"SELECT central_5mer, count(*) FILTER (label = 0) AS unmodified_sites, count(*) FILTER (label = 1) AS modified_sites, count(*) FILTER (label IN (0, 1)) AS total_sites, {r('count(*) FILTER (label = 1)::DOUBLE / nullif(count(*) FILTER (label IN (0, 1)), 0)', 'positive_fraction')} FROM graded_sites GROUP BY central_5mer"),
        "agg19_top_sequences": on_reads("SELECT sequence, count(*) AS rows FROM sites GROUP BY sequence ORDER BY rows DESC, sequence LIMIT 20"),
        "agg19_motif_counts": on_reads("SELECT central_5mer, count(*) AS rows FROM sites GROUP BY central_5mer"),
        "agg20_site_means": on_reads(f"SELECT {KEYS}, {rounded(CENTRAL)}, label FROM means", MEAN_SITES),
        "agg21_sites_by_label": on_reads("SELECT label, count(*) AS rows FROM means GROUP BY label", MEAN_SITES),
        "agg22_read_label_counts": on_reads("SELECT label, count(*) AS rows FROM reads GROUP BY label"),
        "agg22_label_examples": on_reads("SELECT DISTINCT label FROM graded ORDER BY label LIMIT 10"),
        "agg23_overlap": on_reads("SELECT count(*) FILTER (in_a) AS sites_a, count(*) FILTER (in_b) AS sites_b, count(*) FILTER (in_a AND in_b) AS shared_sites, count(*) FILTER (in_a AND NOT in_b) AS only_a, count(*) FILTER (in_b AND NOT in_a) AS only_b, round(100.0 * count(*) FILTER (in_a AND in_b) / count(*) FILTER (in_a), 2) AS a_in_b_pct, round(100.0 * count(*) FILTER (in_a AND in_b) / count(*) FILTER (in_b), 2) AS b_in_a_pct, round(100.0 * count(*) FILTER (in_a AND in_b) / count(*), 2) AS jaccard_pct FROM pairs"),
        "agg24_agreement": on_reads("SELECT count(*) AS comparable_sites, (SELECT count(*) FROM pairs WHERE in_a AND in_b) - count(*) AS missing_either_label, count(*) FILTER (label_a = label_b) AS matching_labels, count(*) FILTER (label_a <> label_b) AS disagreeing_labels, round(100.0 * count(*) FILTER (label_a = label_b) / count(*), 2) AS agreement_pct, count(*) FILTER (label_a = 1 OR label_b = 1) AS positive_in_either, count(*) FILTER (label_a = 1 AND label_b = 1) AS positive_in_both FROM comparable"),
        "agg26_overview": on_reads(f"{overview('a')} UNION ALL {overview('b')}"),
        "agg27_ingest_audit": on_orders(f"""SELECT 'parsed_sites' AS metric, count(*) AS value FROM lines
          UNION ALL SELECT 'parsed_read_rows', sum(n_reads)::BIGINT FROM lines
          UNION ALL SELECT 'sites_outside_expected_DRACH_motif', count(*) FROM lines
            WHERE NOT regexp_full_match(substr(sequence, 2, 5), '[AGT][AG]AC[ACT]')
          UNION ALL SELECT 'label_rows', count(*) FROM labels_table
          UNION ALL SELECT 'sites_without_labels', count(*) FROM lines ANTI JOIN labels_table USING ({KEYS})
          UNION ALL SELECT 'labels_without_parsed_sites', count(*) FROM labels_table ANTI JOIN lines USING ({KEYS})"""),
        "dq1_metadata_conflicts": on_reads(f"SELECT {KEYS} FROM broken_sites WHERE conflict", BROKEN_SITES),
        "dq2_duplicate_reads": on_reads(f"SELECT * FROM {DUPLICATES}"),
        "dq3_kmer_mismatches": on_reads(f"SELECT {KEYS}, read_idx, sequence, central_5mer FROM broken WHERE central_5mer <> substr(sequence, 2, 5)"),
        "dq4_coverage_mismatches": on_reads(f"SELECT {KEYS}, observed_reads, stored_n_reads FROM broken_sites WHERE observed_reads <> stored_n_reads", BROKEN_SITES),
        "dq5_bad_sequences": on_reads(f"SELECT {KEYS}, count(*) AS n, count(*) AS bad FROM reads WHERE transcript_position % 10 = 3 GROUP BY {KEYS}"),
        "dq7_site_labels": on_reads(f"SELECT DISTINCT {KEYS}, label FROM b"),
        "dq_report": on_reads(f"SELECT 'metadata_conflicts' AS \"check\", count(*) FILTER (conflict) AS failed_rows FROM broken_sites UNION ALL SELECT 'coverage_mismatches', count(*) FILTER (observed_reads <> stored_n_reads) FROM broken_sites UNION ALL SELECT 'kmer_mismatches', count(*) FILTER (central_5mer <> substr(sequence, 2, 5)) FROM broken UNION ALL SELECT 'duplicate_reads', count(*) FROM {DUPLICATES}", BROKEN_SITES),
        "dq_report_clean": "SELECT unnest(['metadata_conflicts', 'coverage_mismatches', 'kmer_mismatches', 'duplicate_reads']) AS \"check\", 0::BIGINT AS failed_rows",
        "top1_kmers": on_reads(f"SELECT * FROM counts ORDER BY {top}", counts),
        "lim1_sites_head": on_reads("SELECT * FROM sites ORDER BY transcript_id, transcript_position LIMIT 5"),
        "set1_site_table": on_reads("SELECT * FROM sites"),
        "dst1_coverage_histogram": on_reads("", histogram("SELECT log10(n_reads) AS x FROM sites", 50)),
        "dst1_gene_histogram": on_reads("", histogram("SELECT log10(count(*)) AS x FROM sites WHERE gene_id IS NOT NULL GROUP BY gene_id", 50)),
        "dst2_label_histogram": on_reads("", histogram("SELECT label AS x FROM graded_sites", 20, 0, 1)),
        "dst3_density_by_label": on_reads(density()),
        "dst4_read_boxes": on_reads(boxes("reads")),
        "dst5_site_mean_boxes": on_reads(boxes("means"), MEAN_SITES),
        "dst5_graded_boxes": on_reads(boxes("means"), GRADED_MEANS),
        "dst5_many_label_boxes": on_reads(boxes("means"), f", means AS (SELECT {KEYS}, {MEANS}, transcript_position % 12 / 16::DOUBLE AS label FROM reads GROUP BY {KEYS})"),
        "ent2_features": on_reads(f"SELECT {KEYS}, any_value(n_reads) AS n_reads, {statistics(READ_FEATURES, STATISTICS)}, {SEQUENCE_HOT}, {MOTIF_HOT} FROM {derived()} GROUP BY {KEYS}, sequence, central_5mer"),
        "ent2_features_with_residuals": on_reads(f"SELECT {KEYS}, any_value(n_reads) AS n_reads, {statistics([*READ_FEATURES, *RESIDUALS], STATISTICS)}, {SEQUENCE_HOT}, {MOTIF_HOT} FROM residuals GROUP BY {KEYS}, sequence, central_5mer", BASELINES),
        "ent6_kmer_by_label": on_reads(f"SELECT central_5mer, {percentages(GRADE_NAMES, 'counts')} FROM counts", graded_counts.format("central_5mer")),
        "ent6_top_kmer_by_label": on_reads(f"SELECT sequence, {percentages(GRADE_NAMES, 'counts')} FROM counts ORDER BY {' + '.join('counts.' + n for n in GRADE_NAMES)} DESC, sequence LIMIT 20", graded_counts.format("sequence")),
    }


LABEL_CHECKS = """
WITH given AS (
  SELECT CASE WHEN k = 7 THEN '  ' ELSE concat('T', l_suppkey) END AS transcript_id,
    CASE WHEN k = 8 THEN NULL ELSE l_orderkey END AS transcript_position, k
  FROM (SELECT *, l_orderkey % 40 AS k FROM lineitem WHERE l_linenumber = 1))
SELECT unnest(['missing', 'blank', 'bad_position', 'bad_label', 'not_finite', 'out_of_range', 'duplicates']) AS "check",
  unnest([count(*) FILTER (k = 4), count(*) FILTER (k = 7), count(*) FILTER (k = 8), count(*) FILTER (k IN (1, 4, 6)),
    count(*) FILTER (k = 2), count(*) FILTER (k IN (2, 3, 5)),
    (SELECT count(*) FROM (SELECT 1 FROM given GROUP BY transcript_id, transcript_position HAVING count(*) > 1))]) AS failed_rows
FROM given"""

ORACLE = build()
ORACLE["lab_checks"] = LABEL_CHECKS
ORACLE["ent2_features_deep_sites"] = ORACLE["ent2_features"]

SCORED = f""", scored AS (
  SELECT *, ((transcript_position * 7919 + substr(transcript_id, 2)::BIGINT * 17) % 50)::DOUBLE / 64
    + coalesce(label, 0) * 0.125::DOUBLE AS score
  FROM (SELECT DISTINCT {KEYS}, label FROM reads)),
judged AS (SELECT * FROM scored WHERE label IN (0, 1))"""


def ranking(source, by=""):
    """Mean ranks for the ROC-AUC, precision at each positive for the average precision."""
    part = f"PARTITION BY {by}" if by else ""
    tied = f"PARTITION BY {by + ', ' if by else ''}score"
    listed = f"{by}, " if by else ""
    return f"""SELECT {listed}count(*) AS rows, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives,
      {r('''(sum(mean_rank) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2::DOUBLE)
        / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0)''', 'roc_auc')},
      {r('avg(tp / above::DOUBLE) FILTER (label = 1)', 'average_precision')}
    FROM (SELECT *, rank() OVER ({part} ORDER BY score) + (count(*) OVER ({tied}) - 1) / 2::DOUBLE AS mean_rank,
        count(*) OVER ({part} ORDER BY score DESC) AS above,
        count(*) FILTER (label = 1) OVER ({part} ORDER BY score DESC) AS tp FROM {source})
    {'GROUP BY ' + by if by else ''}"""


CURVE = """(SELECT *, sum(positives) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(negatives) OVER (ORDER BY score DESC)::BIGINT AS fp
  FROM (SELECT score, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM judged GROUP BY score))"""

FAMILIES = f""", family AS (
  SELECT {KEYS}, label, CASE WHEN transcript_position % 2 = 1 THEN concat('H', s // 2) WHEN s % 11 <> 0 THEN concat('G', s % 50) END AS gene_id
  FROM (SELECT DISTINCT {KEYS}, label, substr(transcript_id, 2)::BIGINT AS s FROM reads))"""
REACHED = FAMILIES + f""", links AS (
  SELECT DISTINCT concat('transcript_id=', transcript_id) AS a, concat('gene_id=', gene_id) AS b FROM family WHERE gene_id IS NOT NULL),
steps AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (
  SELECT DISTINCT concat('transcript_id=', transcript_id) AS a, concat('transcript_id=', transcript_id) AS b FROM family
  UNION SELECT reached.a, steps.b FROM reached JOIN steps ON steps.a = reached.b),
grouped AS (
  SELECT family.*, g AS "group" FROM family JOIN (SELECT a, min(b) AS g FROM reached GROUP BY a) AS x
  ON x.a = concat('transcript_id=', transcript_id))"""


def side(group, share):
    return f"CASE WHEN ('0x' || substr(md5(concat('0:', {group})), 1, 8))::BIGINT / 4294967296::DOUBLE < {share} THEN 'test' ELSE 'train' END"


def recursive(sql, extra):
    return on_reads(sql, extra).replace("WITH", "WITH RECURSIVE", 1)


def leaking(kind, key):
    return f"""SELECT '{kind}' AS kind, (SELECT count(*) FROM (SELECT 1 FROM sided WHERE {key} IS NOT NULL
      GROUP BY {key} HAVING count(DISTINCT side) > 1)) AS leaks"""


SITE_KIND = "transcript_id+transcript_position"
BY_SITE = FAMILIES + f", sided AS (SELECT *, {side(chr(34) + 'k' + chr(34), 0.3)} AS side FROM (SELECT *, concat('transcript_id=', transcript_id, '|transcript_position=', transcript_position) AS k FROM family))"
REST = "transcript_position % 10"

ORACLE |= {
    "snk2_refused_outputs": on_orders("""SELECT * FROM (VALUES
      ('audit exists', 'already exists, choose a new output.'), ('batch size', 'batch_size must be positive.'),
      ('rows per group', 'batch_size must be positive.'), ('max sites', 'max_sites must be positive.'),
      ('no sites', 'No sites were found in the input.'), ('left behind', ''),
      ('audit file', 'label_path, label_rows, labels_without_parsed_sites, max_sites_requested, output_path, parsed_read_rows, parsed_sites, signal_path, sites_outside_expected_DRACH_motif, sites_without_labels')) AS t("case", message)
      UNION ALL SELECT 'rows', sum(n_reads)::VARCHAR FROM (SELECT n_reads FROM lines ORDER BY line_id LIMIT 20)"""),
    "lab1_refused_tables": """SELECT * FROM (VALUES
      ('label columns', 'Missing required columns: [''label'']. Found: [''gene_id'', ''transcript_id'', ''transcript_position'', ''comment'']'),
      ('baseline columns', 'Missing required columns: [''central_dwell'']. Found: [''transcript_id'', ''transcript_position'', ''sequence'', ''central_5mer'', ''n_reads'', ''minus1_dwell'', ''minus1_signal_sd'', ''minus1_signal_mean'', ''central_signal_sd'', ''central_signal_mean'', ''plus1_dwell'', ''plus1_signal_sd'', ''plus1_signal_mean'', ''gene_id'', ''label'']'),
      ('label values', 'More than 10 annotation values.'), ('no labels', 'No annotated sites available.')) AS t("case", message)""",
    "auc1_ranking_metrics": on_reads(ranking("judged"), SCORED),
    "auc1_metrics_by_transcript": on_reads(ranking("judged", "transcript_id"), SCORED),
    "auc1_metrics_of_reads": f"WITH {READS.replace('code, l_partkey, l_linenumber' + chr(10) + '  FROM coded', 'code, l_partkey, l_linenumber, l_orderkey' + chr(10) + '  FROM coded').replace('EXCLUDE (code, l_partkey, l_linenumber)', 'EXCLUDE (code, l_partkey, l_linenumber, l_orderkey)')}"
    + ", judged AS (SELECT label, (l_orderkey * 7919 % 65536)::DOUBLE / 65536 AS score FROM full_reads WHERE label IN (0, 1)) "
    + ranking("judged"),
    "auc2_score_curve": on_reads(f"SELECT {r('score', 'score')}, positives, negatives, tp, fp FROM {CURVE}", SCORED),
    "auc2_roc_curve": on_reads(f"SELECT {r('score', 'score')}, {r('tp::DOUBLE / max(tp) OVER ()', 'tpr')}, {r('fp::DOUBLE / max(fp) OVER ()', 'fpr')} FROM {CURVE}", SCORED),
    "auc2_precision_recall": on_reads(f"SELECT {r('score', 'score')}, {r('tp::DOUBLE / (tp + fp)', 'precision')}, {r('tp::DOUBLE / max(tp) OVER ()', 'recall')} FROM {CURVE}", SCORED),
    "spl1_leakage_safe_split": recursive(f"""SELECT {KEYS}, gene_id, "group", {side('"group"', 0.3)} AS side FROM grouped""", REACHED),
    "spl1_leaks": f"SELECT unnest(['{SITE_KIND}', 'transcript_id', 'gene_id']) AS kind, 0::BIGINT AS leaks",
    "spl1_leaks_by_site": on_reads(" UNION ALL ".join([leaking(SITE_KIND, "k"), leaking("transcript_id", "transcript_id"), leaking("gene_id", "gene_id")]), BY_SITE),
    "spl2_balanced_split": on_reads("SELECT side, wanted_share, 0::BIGINT AS split_groups, true AS rows_within, true AS positives_within, (SELECT count(*) FROM family) AS all_rows FROM (VALUES ('train', 0.7::DOUBLE), ('valid', 0.1::DOUBLE), ('test', 0.2::DOUBLE)) AS t(side, wanted_share)", FAMILIES),
    "prd1_prediction_report": on_reads(f"""SELECT unnest(['missing_sites', 'unknown_sites', 'repeated_sites', 'bad_scores', 'null_keys']) AS "check",
      unnest([count(*) FILTER ({REST} = 1), count(*) FILTER ({REST} = 2), count(*) FILTER ({REST} = 3), count(*) FILTER ({REST} IN (4, 5)), 0]) AS failed_rows FROM scored""", SCORED),
    "prd2_written_predictions": on_reads(f"SELECT {KEYS}, score, (SELECT count(*) FROM scored) AS sites FROM scored", SCORED),
}

MOTIF_COUNTS = f", counts AS (SELECT central_5mer, {BINARY_COUNTS} FROM sites WHERE label IS NOT NULL GROUP BY central_5mer)"
SIZES = "(SELECT count(*) AS n_sites FROM sites WHERE {0} IS NOT NULL GROUP BY {0})"
ORACLE |= {
    "ent4_coverage": ORACLE["agg11_coverage_describe"],
    "ent4_coverage_by_label": ORACLE["agg12_coverage_by_label"],
    "ent4_read_boxes": ORACLE["dst4_read_boxes"],
    "ent4_site_mean_boxes": ORACLE["dst5_site_mean_boxes"],
    "ent4_sites_per_gene_described": on_reads(f"SELECT {describe('n_sites', [25, 50, 75])} FROM {SIZES.format('gene_id')}"),
    "ent4_sites_per_transcript_described": on_reads(f"SELECT {describe('n_sites', [25, 50, 75])} FROM {SIZES.format('transcript_id')}"),
    "ent4_sites_per_gene_histogram": ORACLE["dst1_gene_histogram"],
    "ent4_label_histogram": on_reads("", histogram("SELECT label AS x FROM sites WHERE label IS NOT NULL", 20, 0, 1)),
    "ent4_transcript_sizes": ORACLE["agg14_size_histogram"],
    "ent4_excluded_reads": on_reads(" UNION ALL ".join(f"SELECT '{c}' AS feature, 0::BIGINT AS excluded" for c in CENTRAL)),
    "ent4_central_5mer_percentages": on_reads(f"SELECT central_5mer, {percentages(['label_0', 'label_1'], 'counts')} FROM counts", MOTIF_COUNTS),
    "ent4_central_5mer_top20": on_reads("SELECT * FROM counts ORDER BY label_0 + label_1 DESC, central_5mer LIMIT 20", MOTIF_COUNTS),
}
