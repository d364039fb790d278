import math
import random

import pytest
from pyspark.sql import functions as F

from sitesignal.operators import compare as c
from sitesignal.operators import distributions as d
from sitesignal.operators import frequency as f
from sitesignal.operators import quality as q
from sitesignal.operators import sites as s
from sitesignal.operators import summaries as m
from sitesignal.operators.quantiles import grouped_quantiles
from sitesignal.plans.profile import compare, profile
from sitesignal.schema import LABELLED_READS_SCHEMA, SIGNALS, SITE_KEYS
from sitesignal.sources.scratch import scratch_tables
from tests.test_features import linear_quantile


def make_reads(spark, sites, seed=0):
    """sites: (transcript, position, sequence, reads, gene, label)."""
    rng = random.Random(seed)
    rows = [
        (t, p, seq, seq[1:6], n, i, *[rng.uniform(0.01, 5) for _ in SIGNALS], gene, label)
        for t, p, seq, n, gene, label in sites
        for i in range(n)
    ]
    return spark.createDataFrame(rows, LABELLED_READS_SCHEMA)


SITES = [
    ("T1", 1, "AAGACCA", 5, "G1", 1.0),
    ("T1", 2, "AAGACCA", 12, "G1", 0.0),
    ("T2", 1, "CGGACTT", 3, "G2", 0.0),
    ("T2", 2, "ACCCCCA", 25, "G2", None),
    ("T3", 9, "CGGACTT", 1, None, 0.0),
]


@pytest.fixture(scope="module")
def reads(spark):
    return make_reads(spark, SITES).persist()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sites(spark, reads):
    sites = s.site_table(reads)
    assert {(r.transcript_id, r.transcript_position, r.n_reads, r.label) for r in sites.collect()} == {
        (t, p, n, label) for t, p, _, n, _, label in SITES
    }
    assert s.labelled(sites).count() == 4 and s.with_gene(sites).count() == 4
    assert rows(s.unexpected_motifs(sites)) == [("T2", 2, "ACCCCCA", "CCCCC")]
    nan = sites.withColumn("label", F.lit(float("nan")))
    assert s.labelled(nan).count() == 0
    graded = sites.withColumn("label", F.col("label") * 0.5)
    assert s.unexpected_labels(graded).count() == 1


def test_site_labels_are_checked(reads):
    assert len(rows(s.site_labels(reads))) == 5
    conflict = reads.withColumn("label", (F.col("read_idx") == 0).cast("double"))
    with pytest.raises(ValueError, match="conflicting labels"):
        s.site_labels(conflict)
    partly = reads.withColumn("label", F.when(F.col("read_idx") == 0, 1.0))
    with pytest.raises(ValueError, match="conflicting labels"):
        s.site_labels(partly)
    with pytest.raises(ValueError, match="site identifiers"):
        s.site_labels(
            reads.filter("label = 0").withColumn("transcript_id", F.lit(None).cast("string"))
        )


def test_quality_passes_and_each_check_fails(reads):
    assert {r.failed_rows for r in q.quality_report(reads).collect()} == {0}
    q.assert_quality(reads)
    first = (F.col("transcript_id") == "T1") & (F.col("transcript_position") == 2) & (F.col("read_idx") == 0)

    def broken(column, value):
        return reads.withColumn(column, F.when(first, value).otherwise(F.col(column)))

    defects = {
        "metadata": broken("gene_id", F.lit(None).cast("string")),
        "Duplicate": broken("read_idx", F.lit(1)),
        "5-mer": broken("central_5mer", F.lit("AAAAA")),
        "n_reads": reads.withColumn("n_reads", F.col("n_reads") + 1),
    }
    for part, df in defects.items():
        with pytest.raises(ValueError, match=part):
            q.assert_quality(df)
    assert rows(q.metadata_conflicts(defects["metadata"])) == [("T1", 2)]
    assert rows(q.duplicate_reads(defects["Duplicate"])) == [("T1", 2, 1, 2)]
    assert q.kmer_mismatches(defects["5-mer"]).count() == 1
    assert q.coverage_mismatches(defects["n_reads"]).count() == 5
    fewer = reads.filter("NOT (transcript_id = 'T1' AND transcript_position = 1 AND read_idx = 4)")
    assert rows(q.coverage_mismatches(fewer)) == [("T1", 1, 4, 5)]


def test_summaries(reads):
    sites = s.site_table(reads)
    assert tuple(m.dataset_summary(reads).first()) == (46, 5, 3, 2, 1, 25)
    missing = m.missing_values(reads).collect()
    assert [tuple(r) for r in missing[:2]] == [("label", 25), ("gene_id", 1)]
    assert rows(m.class_balance(s.labelled(sites))) == [(0.0, 3, 75.0), (1.0, 1, 25.0)]
    assert rows(m.class_balance(sites.filter("label > 5"))) == [(0.0, 0, None), (1.0, 0, None)]
    assert rows(m.label_distribution(sites)) == [(0.0, 3, 75.0), (1.0, 1, 25.0)]
    assert [tuple(r) for r in m.label_value_counts(reads).collect()] == [(None, 25), (0.0, 16), (1.0, 5)]
    assert rows(m.coverage_below(sites)) == [
        ("n_reads < 10", 3, 60.0), ("n_reads < 20", 4, 80.0), ("n_reads < 5", 2, 40.0)
    ]
    sizes = m.group_sizes(sites, "transcript_id")
    assert [tuple(r) for r in sizes.collect()] == [("T1", 2), ("T2", 2), ("T3", 1)]
    assert rows(m.size_histogram(sizes)) == [(1, 1), (2, 2)]
    assert rows(m.transcript_labels(sites)) == [("T1", 2, 2, 0), ("T2", 2, 1, 1), ("T3", 1, 1, 0)]
    assert tuple(m.constant_label_share(sites).first()) == (1, 0.0)
    assert tuple(m.constant_label_share(sites.filter("n_reads < 2")).first()) == (0, None)
    assert m.column_types(reads, ["label", "n_reads"]) == {"n_reads": "bigint", "label": "double"}
    assert [r.label for r in m.label_examples(reads).collect()] == [0.0, 1.0]
    table = m.overview({"x": reads})
    assert tuple(table.first()) == ("x", 46, 5, 3, 2, 1, 25.0, 5.0, 1, 25)


def test_describe(reads):
    sites = s.site_table(reads)
    row = m.describe(sites, "n_reads", m.COVERAGE_PERCENTILES).first()
    values = [5, 12, 3, 25, 1]
    assert (row["count"], row["mean"], row["min"], row["max"]) == (5, 9.2, 1.0, 25.0)
    for p in m.COVERAGE_PERCENTILES:
        assert row[m.percentile_name(p)] == pytest.approx(linear_quantile(values, p))
    grouped = {r.label: r for r in m.describe(sites, "n_reads", by="label").collect()}
    assert set(grouped) == {0.0, 1.0}
    assert grouped[0.0]["p50"] == 3 and grouped[1.0]["std"] is None


def test_quantiles_of_awkward_values(spark):
    rng = random.Random(1)
    groups = {
        "ties": [1.0] * 500 + [2.0] * 3,
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-20, 20) for _ in range(100)],
        "huge": [-1.7e308, 1.7e308, 0.0, 1.0, 2.0] * 9,
        "tiny": [5e-324, 1e-323, 0.0, 1.5e-323] * 9,
        "infinite": [float("-inf"), float("inf"), 1.0, 2.0, 3.0, 4.0, 5.0] * 5,
        "one": [7.0],
        "small": [3.0, 1.0, 2.0],
    }
    data = [(k, v) for k, vs in groups.items() for v in vs] + [("small", None), ("small", float("nan")), (None, 1.0)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 1.0]
    got = {r.k: r["q_v"] for r in grouped_quantiles(df, ["k"], ["v"], probs).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        for p, value in zip(probs, got[k]):
            want = linear_quantile(values, p)
            assert (math.isnan(want) and math.isnan(value)) or value == pytest.approx(want, rel=1e-12), (k, p)
    whole = grouped_quantiles(df.filter("k = 'ties'"), [], ["v"], [0.5]).first()
    assert list(whole["q_v"]) == [1.0]


def test_many_groups_and_any_aggregate_name(spark):
    df = spark.range(300).select((F.col("id") % 8).alias("k"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    counts = [F.count("*").alias("_n_rows")]
    got = {r.k: r for r in grouped_quantiles(df, ["k"], ["v"], [0.25, 0.5], counts).collect()}
    for k in range(8):
        values = [i * 37 % 101 for i in range(300) if i % 8 == k]
        assert got[k]["_n_rows"] == len(values)
        assert list(got[k]["q_v"]) == pytest.approx([linear_quantile(values, 0.25), linear_quantile(values, 0.5)])


def test_missing_groups_and_text_values(spark):
    df = spark.createDataFrame([(0.0, 1.0), (float("nan"), 2.0), (None, 3.0)], "label double, x double")
    assert [r.label for r in m.describe(df, "x", by="label").collect()] == [0.0]
    text = spark.createDataFrame([(0.0, "1.5"), (0.0, "many")], "label double, x string")
    for table in (d.box_stats, lambda df, columns: d.density_by_label(df, columns)):
        with pytest.raises(Exception, match="not a number"):
            table(text, ["x"]).collect()


def test_labels_that_agree_in_six_digits(spark):
    rows = [("k", 0.1234567), ("k", 0.1234568), ("k", 1.0), ("k", 0.25)]
    df = spark.createDataFrame(rows, "central_5mer string, label double")
    want = ["central_5mer", "label_0_1234567", "label_0_1234568", "label_0_25", "label_1"]
    assert f.crosstab(df, "central_5mer", None).columns == want
    assert f.kmer_by_label(df, "central_5mer").first()["label_0_1234568"] == 100.0
    many = spark.range(12).select((F.col("id") / 16).alias("label"), F.col("id").cast("double").alias("x"))
    assert d.box_stats(many, ["x"], None).count() == 12


def test_density_integrates_to_one(reads):
    got = d.density_by_label(reads, bins=40).collect()
    assert len(got) == 3 * 2 * 40
    total = {}
    for r in got:
        key = (r.feature, r.label)
        total[key] = total.get(key, 0) + r.density * (r.upper - r.lower)
    assert all(v == pytest.approx(1) for v in total.values())


def test_box_stats(spark):
    values = {0.0: [1.0, 2.0, 3.0, 4.0, 100.0, float("nan")], 1.0: [5.0, -90.0, 5.5, 6.0, 6.5, 7.0, float("inf")]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [(None, 3.0), (0.5, 3.0)], "label double, x double")
    got = {r.label: r for r in d.box_stats(df, ["x"]).collect()}
    assert set(got) == {0.0, 1.0}
    for label, vs in values.items():
        vs = [v for v in vs if math.isfinite(v)]
        q1, q2, q3 = [linear_quantile(vs, p) for p in (0.25, 0.5, 0.75)]
        low = min(v for v in vs if v >= q1 - 1.5 * (q3 - q1))
        high = max(v for v in vs if v <= q3 + 1.5 * (q3 - q1))
        r = got[label]
        assert (r.n, r.q1, r["median"], r.q3) == (len(vs), q1, q2, q3)
        assert (r.low_whisker, r.high_whisker) == (min(low, q1), max(high, q3))
    assert {r.label for r in d.box_stats(df, ["x"], None).collect()} == {0.0, 0.5, 1.0}
    assert rows(d.excluded_rows(df, ["x"])) == [("x", 3)]


def test_site_means(spark, reads):
    means = s.site_means(reads)
    assert means.count() == 4
    labels = spark.createDataFrame([("T1", 1, 1.0)], "transcript_id string, transcript_position long, label double")
    joined = s.site_means(reads, labels)
    assert joined.count() == 5 and s.labelled(joined).count() == 1
    with pytest.raises(ValueError, match="not unique"):
        s.site_means(reads, labels.union(labels))


def test_compare(spark, reads):
    other = make_reads(
        spark,
        [
            ("T1", 1, "AAGACCA", 2, None, 1.0),
            ("T1", 2, "AAGACCA", 1, None, 1.0),
            ("T2", 2, "ACCCCCA", 1, None, 0.0),
            ("T9", 1, "AAGACCA", 1, None, 0.0),
        ],
    )
    tables = compare(reads, other)
    assert tuple(tables["overlap"].first()) == (5, 4, 3, 2, 1, 60.0, 75.0, 50.0)
    assert tuple(tables["agreement"].first()) == (2, 1, 1, 1, 50.0, 2, 1)
    assert rows(tables["label_crosstab"]) == [(0.0, 0, 1), (1.0, 0, 1)]
    assert rows(tables["disagreements"]) == [("T1", 2, 0.0, 1.0)]
    empty = reads.limit(0)
    assert c.overlap_summary(c.site_pairs(empty, empty)).first()["jaccard_pct"] is None
    assert c.agreement_summary(c.site_pairs(empty, empty)).first()["agreement_pct"] is None
    assert c.disagreements(tables["pairs"], None).count() == 1


def test_profile_tables_equal_those_of_the_single_operators(reads):
    with scratch_tables(reads.sparkSession):
        tables = profile(reads)
        assert not tables._built and len(tables) == 36
        sites = s.site_table(reads)
        means = s.site_means(reads)
        alone = {
            "coverage": m.describe(sites, "n_reads", m.COVERAGE_PERCENTILES),
            "coverage_by_label": m.describe(s.labelled(sites), "n_reads", by="label"),
            "sites_per_gene_described": m.describe(m.group_sizes(sites, "gene_id"), "n_sites"),
            "sites_per_transcript_described": m.describe(m.group_sizes(sites, "transcript_id"), "n_sites"),
            "read_boxes": d.box_stats(s.labelled(reads)),
            "site_mean_boxes": d.box_stats(means),
            "site_means": means,
        }
        for name, table in alone.items():
            assert tables[name].columns == table.columns, name
            assert sorted(map(tuple, tables[name].collect())) == sorted(map(tuple, table.collect())), name
        none = profile(reads.filter("false"))
        assert none["coverage"].count() == m.describe(sites.filter("false"), "n_reads").count() == 0


def test_profile_runs_few_jobs_and_none_before_a_table_is_asked_for(spark, reads):
    tracker, group = spark.sparkContext.statusTracker(), "profile"
    spark.sparkContext.setJobGroup(group, "")
    tables = profile(reads)
    assert len(tracker.getJobIdsForGroup(group)) == 0
    before = [tables[n] for n in ("coverage", "coverage_by_label", "read_boxes", "site_mean_boxes", "sites_per_gene_described")]
    built = len(tracker.getJobIdsForGroup(group))
    assert len(before) == 5 and built <= 40
    tables["sites_per_transcript_described"], tables["coverage"]
    assert len(tracker.getJobIdsForGroup(group)) == built
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_profile_gives_every_table(reads):
    tables = profile(reads)
    assert tables["sites"].count() == 5
    for name, table in tables.items():
        assert table.columns and table.count() >= 0, name
    assert tables["read_boxes"].count() == 6
    labels = s.site_table(reads).select(*SITE_KEYS, "label").filter("label IS NOT NULL")
    graded = profile(reads, labels, binary=False)
    assert graded["sites_per_transcript"].count() == 3
    assert graded["site_means"].count() == 5


def test_a_text_that_is_no_number_fails_in_either_mode(spark):
    from sitesignal.functions import strict_double

    df = spark.createDataFrame([("1.5",), (None,), ("x",)], "v string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for mode in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", mode)
            with pytest.raises(Exception, match="not a number: x"):
                df.select(strict_double("v").alias("v")).collect()
            good = df.filter("v is null or v <> 'x'").select(strict_double("v").alias("v")).collect()
            assert [r.v for r in good] == [1.5, None]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_tables_over_sites_do_not_count_the_values_of_all_reads(spark, reads):
    broken = reads.withColumn("central_dwell", F.lit("not a number"))
    with scratch_tables(spark):
        tables = profile(broken)
        assert tables["coverage"].first()["count"] == 5
        assert tables["sites_per_gene_described"].first()["count"] == 2
        with pytest.raises(Exception, match="not a number"):
            tables["read_boxes"].collect()
