"""One registered query per operator that yields a table."""

import json

from pyspark.sql import functions as F

from checks import fixtures as x
from sitesignal.functions import motif_one_hot, sequence_one_hot
from sitesignal.operators import compare as c
from sitesignal.operators import distributions as d
from sitesignal.operators import frequency as f
from sitesignal.operators import joins as j
from sitesignal.operators import metrics as me
from sitesignal.operators import quality as q
from sitesignal.operators import sites as s
from sitesignal.operators import splits as sp
from sitesignal.operators import summaries as m
from sitesignal.operators.baselines import add_residuals, fit_kmer_baselines
from sitesignal.operators.features import build_features, site_sizes
from sitesignal.operators.read_features import read_features
from sitesignal.plans.ingest import ingest
from sitesignal.plans.profile import profile
from sitesignal.schema import (
    AGG_COLUMNS,
    BASELINE_FEATURES,
    RESIDUAL_FEATURES,
    SITE_KEYS,
)
from sitesignal.sources import labels as sl
from sitesignal.sources import predictions as pr
from sitesignal.sources import reads as sr
from sitesignal.sources import signals as ss
from sitesignal.sources.storage import Storage


def rounded(df, digits=6):
    """Doubles to 6 digits; the small shift keeps means of decimals off ties."""

    def value(name, kind):
        column = F.col(f"`{name}`")
        return F.round(column + 1.23e-8, digits).alias(name) if kind == "double" else column

    return df.select(*[value(n, k) for n, k in df.dtypes])


def _sites(spark, sf):
    return s.site_table(x.reads(spark, sf))


def _graded_sites(spark, sf):
    return s.site_table(x.graded_reads(spark, sf))


def _pairs(spark, sf):
    return c.site_pairs(x.dataset_a(spark, sf), x.dataset_b(spark, sf))


def _order_labels(spark, sf):
    return sl.prepare_labels(x.label_texts(spark, sf))


def _order_sites(spark, sf):
    return ss.good_sites(
        ss.parse_lines(ss.skip_blank_lines(x.signal_lines(spark, sf)))
    )


def _statistics(spark, sf, suffixes):
    features = build_features(x.reads(spark, sf))
    names = [n for n in AGG_COLUMNS if n.rpartition("_")[2] in suffixes]
    return rounded(features.select(*SITE_KEYS, *names))


def _ingested(spark, sf, max_sites=None):
    signals, labels = x.signal_files(spark, sf)
    output = f"{x.scratch(spark)}/reads.parquet"
    audit = ingest(spark, signals, output, labels, max_sites=max_sites)
    return sr.read_reads(spark, output), audit


def _ingest_audit(spark, sf):
    _, audit = _ingested(spark, sf)
    counts = [(name, value) for name, value in audit.items() if isinstance(value, int)]
    return spark.createDataFrame(counts, "metric string, value bigint")


def _first_line_with_label(spark, sf):
    """Lines in an order in which the first one has a label row."""
    lines = x.signal_lines(spark, sf, defects=False)
    late = F.when(F.col("line_id") % 3 == 2, 0).otherwise(10**12)
    return lines.withColumn("line_id", F.col("line_id") + late)


def _relabelled_sites(spark, sf, label):
    return _sites(spark, sf).withColumn("label", F.expr(label))


def _many_label_means(spark, sf):
    reads = x.reads(spark, sf, coverage=False)
    return s.site_means(reads.withColumn("label", F.expr("transcript_position % 12 / 16D")))


def _bad_sequence_sites(spark, sf):
    reads = x.reads(spark, sf, coverage=False)
    bad = F.when(F.col("transcript_position") % 10 == 3, "NNNNNNN").otherwise(F.col("sequence"))
    return site_sizes(reads.withColumn("sequence", bad)).filter("bad > 0")


def _text_signals(spark, sf):
    signals, _ = x.signal_files(spark, sf)
    lines = ss.read_lines(spark, signals)
    return ss.parse_lines(ss.skip_blank_lines(lines)).select(
        *SITE_KEYS, "sequence", F.size("reads").cast("long").alias("n_reads"), "reason"
    )


def _csv_labels(spark, sf, validate):
    _, labels = x.signal_files(spark, sf)
    return sl.read_labels(spark, labels, validate)


def _parquet_columns(spark, sf):
    path = f"{x.scratch(spark)}/reads.parquet"
    sr.write_reads(x.reads(spark, sf, index=True), path)
    return sr.read_reads(spark, path, [*SITE_KEYS, "label"])


def _residuals(spark, sf):
    reads = x.reads(spark, sf)
    table = fit_kmer_baselines(x.dataset_a(spark, sf))
    kept = read_features(reads, keep=[*SITE_KEYS, "sequence"])
    return rounded(
        add_residuals(kept, table).select(*SITE_KEYS, *BASELINE_FEATURES, *RESIDUAL_FEATURES)
    )


def _features_with_residuals(spark, sf):
    table = fit_kmer_baselines(x.dataset_a(spark, sf))
    return rounded(build_features(x.reads(spark, sf), kmer_baselines=table))


def _one_hot(spark, sf, columns):
    return _sites(spark, sf).select(*SITE_KEYS, *columns)


def _labelled_reads(spark, sf):
    return s.labelled(x.reads(spark, sf, coverage=False))


def _refusal(case, call):
    """(case, message) of a call that must be refused."""
    try:
        call()
    except (ValueError, FileExistsError) as error:
        return case, " ".join(word for word in str(error).split() if "/" not in word)
    return case, None


def _refused(spark, cases):
    return spark.createDataFrame([_refusal(*c) for c in cases.items()], "case string, message string")


def _sink_refusals(spark, sf):
    signals, labels = x.signal_files(spark, sf)
    folder = x.scratch(spark)
    output = f"{folder}/reads.parquet"
    audit = ingest(spark, signals, output, max_sites=20)
    blank = f"{folder}/blank"
    sr.read_reads(spark, output).selectExpr("repeat(' ', cast(n_reads as int)) as value").write.text(blank)
    stored = Storage(spark).read_text(f"{folder}/reads.audit.json")
    Storage(spark).rename(output, f"{folder}/moved.parquet")
    reads = sr.read_reads(spark, f"{folder}/moved.parquet")
    named = ", ".join(sorted(audit)) if stored == json.dumps(audit, indent=2) else "another audit"
    table = _refused(
        spark,
        {
            "audit exists": lambda: ingest(spark, signals, output),
            "batch size": lambda: ingest(spark, signals, f"{folder}/b.parquet", batch_size=0),
            "rows per group": lambda: sr.write_reads(reads, f"{folder}/c.parquet", batch_size=0),
            "max sites": lambda: ingest(spark, signals, f"{folder}/d.parquet", max_sites=0),
            "no sites": lambda: ingest(spark, blank, f"{folder}/e.parquet"),
        },
    )
    left = [n for n in "bcde" if Storage(spark).exists(f"{folder}/{n}.parquet")]
    more = [("audit file", named), ("left behind", "".join(left)), ("rows", str(reads.count()))]
    return table.unionByName(spark.createDataFrame(more, table.schema))


def _table_refusals(spark, sf):
    texts, reads = x.label_texts(spark, sf), x.reads(spark, sf)
    many = _sites(spark, sf).withColumn("label", F.expr("transcript_position % 12 / 16D"))
    return _refused(
        spark,
        {
            "label columns": lambda: sl.prepare_labels(texts.drop("label")),
            "baseline columns": lambda: fit_kmer_baselines(reads.drop("central_dwell")),
            "label values": lambda: f.kmer_by_label(many, "central_5mer"),
            "no labels": lambda: f.kmer_by_label(many.filter("label < 0"), "central_5mer"),
        },
    )


def _curve_rows(spark, sf):
    return rounded(me.score_curve(x.scored_sites(spark, sf)))


def _fine_scores(spark, sf):
    """Reads, not sites, with about as many scores as orders."""
    reads = x.reads(spark, sf, coverage=False, extra=["l_orderkey"])
    return reads.withColumn("score", (F.col("l_orderkey") * 7919 % 65536).cast("double") / 65536.0)


SHARES = {"train": 0.7, "valid": 0.1, "test": 0.2}


def _balanced(spark, sf):
    """Whether the law of the split holds: whole groups, and shares within a hundredth or one group."""
    split = sp.balanced_split(sp.linked_groups(x.family_sites(spark, sf)), shares=SHARES)
    largest = split.groupBy("group").count().agg(F.max("count").alias("_most"))
    summary = sp.split_summary(split, SHARES).join(F.broadcast(largest))
    summary = summary.join(F.broadcast(split.agg(F.count("*").alias("_all"))))
    allowed = 0.01 + F.col("_most") / F.col("_all")
    return summary.select(
        "side",
        "wanted_share",
        "split_groups",
        (F.abs(F.col("row_share") - F.col("wanted_share")) <= allowed).alias("rows_within"),
        (F.abs(F.col("positive_share") - F.col("wanted_share")) <= allowed).alias("positives_within"),
        F.col("_all").alias("all_rows"),
    )


def _written_predictions(spark, sf):
    scored = x.scored_sites(spark, sf)
    path = f"{x.scratch(spark)}/predictions"
    counts = pr.write_predictions(scored, scored, path)
    written = pr.read_predictions(spark, path)
    assert counts == pr.read_report(spark, path)
    return written.withColumn("sites", F.lit(counts["sites"]).cast("bigint"))


PROFILE_TABLES = [
    "coverage",
    "coverage_by_label",
    "read_boxes",
    "site_mean_boxes",
    "sites_per_gene_described",
    "sites_per_transcript_described",
    "sites_per_gene_histogram",
    "label_histogram",
    "transcript_sizes",
    "excluded_reads",
    "central_5mer_percentages",
    "central_5mer_top20",
]

QUERIES = {
    # sources and sinks
    "src1_signal_text": _text_signals,
    "src2_nonblank_lines": lambda k, p: ss.skip_blank_lines(x.signal_lines(k, p)).select("line_id"),
    "src3_label_csv": lambda k, p: _csv_labels(k, p, True),
    "src4_raw_label_csv": lambda k, p: _csv_labels(k, p, False),
    "src5_reads_columns": _parquet_columns,
    "src6_preview": lambda k, p: rounded(sr.preview(x.reads(k, p, index=True))),
    "snk5_first_sites": lambda k, p: rounded(_ingested(k, p, max_sites=100)[0]),
    "ent1_ingest_reads": lambda k, p: rounded(_ingested(k, p)[0]),
    # parsing
    "par1_line_checks": lambda k, p: ss.parse_lines(
        ss.skip_blank_lines(x.signal_lines(k, p))
    ).select("line_id", "reason"),
    "par10_rejected_lines": lambda k, p: ss.rejected_lines(
        ss.parse_lines(ss.skip_blank_lines(x.signal_lines(k, p)))
    ).groupBy("reason").agg(F.count("*").alias("lines"), F.min("line_id").alias("first_line")),
    "par11_duplicate_sites": lambda k, p: ss.duplicate_sites(
        x.reads(k, p, coverage=False)
    ),
    "par13_reads_from_json": lambda k, p: rounded(ss.explode_reads(_order_sites(k, p))),
    "par14_site_coverage": lambda k, p: _order_sites(k, p).select(*SITE_KEYS, "n_reads"),
    "par15_central_5mer": lambda k, p: _order_sites(k, p).select(
        *SITE_KEYS, "sequence", "central_5mer"
    ),
    "par16_site_lookup": lambda k, p: ss.lookup_site(
        _first_line_with_label(k, p), _order_labels(k, p)
    ).select(*SITE_KEYS, "sequence", "n_reads", "gene_id", "label"),
    # labels
    "lab_checks": lambda k, p: sl.label_report(x.broken_label_texts(k, p)),
    "lab7_checked_labels": _order_labels,
    # projections
    "prj1_read_features": lambda k, p: rounded(
        read_features(x.reads(k, p, coverage=False), keep=SITE_KEYS)
    ),
    "prj3_seq_onehot": lambda k, p: _one_hot(k, p, sequence_one_hot("sequence")),
    "prj4_motif_onehot": lambda k, p: _one_hot(k, p, motif_one_hot("central_5mer")),
    "prj6_unexpected_motifs": lambda k, p: s.unexpected_motifs(_sites(k, p)),
    "prj8_kmer_residuals": _residuals,
    "prj10_plot_groups": lambda k, p: d.plot_groups(_labelled_reads(k, p))
    .groupBy("site_label")
    .agg(F.count("*").alias("rows")),
    # filters
    "fil1_labelled_sites": lambda k, p: s.labelled(_sites(k, p)),
    "fil2_excluded_rows": lambda k, p: d.excluded_rows(x.reads(k, p, coverage=False)),
    "fil3_coverage_below": lambda k, p: rounded(m.coverage_below(_sites(k, p))),
    "fil4_unexpected_labels": lambda k, p: s.unexpected_labels(_graded_sites(k, p)).select(
        *SITE_KEYS, "label"
    ),
    "fil5_sites_with_gene": lambda k, p: s.with_gene(_sites(k, p)).select(*SITE_KEYS, "gene_id"),
    "fil6_disagreements": lambda k, p: c.disagreements(_pairs(k, p)),
    "fil6_all_disagreements": lambda k, p: c.disagreements(_pairs(k, p), None),
    "fil7_complete_transcripts": lambda k, p: m.complete_transcripts(
        m.transcript_labels(x.transcript_labels(k, p))
    ),
    # joins
    "joi1_sites_with_labels": lambda k, p: j.attach_labels(
        _order_sites(k, p).drop("reads"), _order_labels(k, p)
    ),
    "joi2_shared_sites": lambda k, p: c.shared_sites(_pairs(k, p)),
    "joi3_site_means_with_labels": lambda k, p: rounded(
        s.site_means(
            x.reads(k, p, coverage=False), s.site_labels(x.dataset_a(k, p))
        )
    ),
    "joi5_unlabelled_sites": lambda k, p: j.unlabelled_sites(
        _order_sites(k, p), _order_labels(k, p)
    ),
    "joi6_orphan_labels": lambda k, p: j.orphan_labels(_order_labels(k, p), _order_sites(k, p)),
    # aggregates
    "agg1_site_stats": lambda k, p: _statistics(k, p, ["mean", "sd", "min", "max"]),
    "agg2_site_quantiles": lambda k, p: _statistics(k, p, ["p25", "median", "p75"]),
    "agg6_kmer_baselines": lambda k, p: rounded(
        fit_kmer_baselines(x.reads(k, p))
    ),
    "agg7_dataset_summary": lambda k, p: m.dataset_summary(x.reads(k, p, coverage=False)),
    "agg8_missing_values": lambda k, p: m.missing_values(x.reads(k, p)),
    "agg9_class_balance": lambda k, p: rounded(m.class_balance(s.labelled(_sites(k, p)))),
    "agg10_label_distribution": lambda k, p: rounded(m.label_distribution(_graded_sites(k, p))),
    "agg11_coverage_describe": lambda k, p: rounded(
        m.describe(_sites(k, p), "n_reads", m.COVERAGE_PERCENTILES)
    ),
    "agg12_coverage_by_label": lambda k, p: rounded(
        m.describe(_sites(k, p), "n_reads", by="label")
    ),
    "agg13_sites_per_gene": lambda k, p: m.group_sizes(_sites(k, p), "gene_id"),
    "agg13_sites_per_transcript": lambda k, p: m.group_sizes(_sites(k, p), "transcript_id"),
    "agg14_size_histogram": lambda k, p: m.size_histogram(
        m.group_sizes(_sites(k, p), "transcript_id")
    ),
    "agg15_transcript_labels": lambda k, p: m.transcript_labels(_graded_sites(k, p)),
    "agg15_constant_label_share": lambda k, p: rounded(
        m.constant_label_share(x.transcript_labels(k, p))
    ),
    "agg16_kmer_crosstab": lambda k, p: f.crosstab(_sites(k, p), "sequence"),
    "agg16_open_crosstab": lambda k, p: f.crosstab(_graded_sites(k, p), "central_5mer", None),
    "agg16_close_labels": lambda k, p: f.crosstab(
        _relabelled_sites(k, p, "if(transcript_position % 2 = 0, 0.1234567D, 0.1234568D)"),
        "central_5mer",
        None,
    ),
    "agg16_label_crosstab": lambda k, p: c.label_crosstab(_pairs(k, p)),
    "agg17_column_percentages": lambda k, p: rounded(
        f.column_percentages(f.crosstab(_sites(k, p), "sequence"))
    ),
    "agg18_motif_summary": lambda k, p: rounded(f.motif_summary(_graded_sites(k, p))),
    "agg19_top_sequences": lambda k, p: f.value_counts(_sites(k, p), "sequence", 20),
    "agg19_motif_counts": lambda k, p: f.value_counts(_sites(k, p), "central_5mer"),
    "agg20_site_means": lambda k, p: rounded(s.site_means(x.reads(k, p, coverage=False))),
    "agg21_sites_by_label": lambda k, p: m.label_value_counts(
        s.site_means(x.reads(k, p, coverage=False))
    ),
    "agg22_read_label_counts": lambda k, p: m.label_value_counts(x.reads(k, p, coverage=False)),
    "agg22_label_examples": lambda k, p: m.label_examples(x.graded_reads(k, p)),
    "agg23_overlap": lambda k, p: c.overlap_summary(_pairs(k, p)),
    "agg24_agreement": lambda k, p: c.agreement_summary(_pairs(k, p)),
    "agg26_overview": lambda k, p: rounded(
        m.overview({"a": x.dataset_a(k, p), "b": x.dataset_b(k, p)})
    ),
    "agg27_ingest_audit": _ingest_audit,
    # quality
    "dq1_metadata_conflicts": lambda k, p: q.metadata_conflicts(x.broken_reads(k, p)),
    "dq2_duplicate_reads": lambda k, p: q.duplicate_reads(x.broken_reads(k, p)),
    "dq3_kmer_mismatches": lambda k, p: q.kmer_mismatches(x.broken_reads(k, p)).select(
        *SITE_KEYS, "read_idx", "sequence", "central_5mer"
    ),
    "dq4_coverage_mismatches": lambda k, p: q.coverage_mismatches(x.broken_reads(k, p)),
    "dq5_bad_sequences": _bad_sequence_sites,
    "dq7_site_labels": lambda k, p: s.site_labels(x.dataset_b(k, p)),
    "dq_report": lambda k, p: q.quality_report(x.broken_reads(k, p)),
    "dq_report_clean": lambda k, p: q.quality_report(x.reads(k, p, index=True)),
    # top-k, limits, sets
    "top1_kmers": lambda k, p: f.top_keys(f.crosstab(_sites(k, p), "sequence")),
    "lim1_sites_head": lambda k, p: sr.preview(_sites(k, p), 5),
    "set1_site_table": _sites,
    # distributions
    "dst1_coverage_histogram": lambda k, p: rounded(
        d.histogram(_sites(k, p), "n_reads", 50, log=True)
    ),
    "dst1_gene_histogram": lambda k, p: rounded(
        d.histogram(m.group_sizes(_sites(k, p), "gene_id"), "n_sites", 50, log=True)
    ),
    "dst2_label_histogram": lambda k, p: rounded(
        d.histogram(_graded_sites(k, p), "label", 20, 0, 1)
    ),
    "dst3_density_by_label": lambda k, p: rounded(d.density_by_label(x.graded_reads(k, p))),
    "dst4_read_boxes": lambda k, p: rounded(d.box_stats(_labelled_reads(k, p))),
    "dst5_site_mean_boxes": lambda k, p: rounded(
        d.box_stats(s.site_means(x.reads(k, p, coverage=False)))
    ),
    "dst5_graded_boxes": lambda k, p: rounded(
        d.box_stats(s.site_means(x.graded_reads(k, p)), labels=None)
    ),
    "dst5_many_label_boxes": lambda k, p: rounded(
        d.box_stats(_many_label_means(k, p), labels=None)
    ),
    # tables of a whole profile, which share one table of counts
    **{
        f"ent4_{name}": lambda k, p, name=name: rounded(profile(x.reads(k, p))[name])
        for name in PROFILE_TABLES
    },
    # refused inputs
    "snk2_refused_outputs": _sink_refusals,
    "lab1_refused_tables": _table_refusals,
    # evaluation
    "auc1_ranking_metrics": lambda k, p: rounded(me.ranking_metrics(x.scored_sites(k, p))),
    "auc1_metrics_by_transcript": lambda k, p: rounded(me.ranking_metrics(x.scored_sites(k, p), ["transcript_id"])),
    "auc1_metrics_of_reads": lambda k, p: rounded(me.ranking_metrics(_fine_scores(k, p))),
    "auc2_score_curve": _curve_rows,
    "auc2_roc_curve": lambda k, p: rounded(me.roc_curve(x.scored_sites(k, p))),
    "auc2_precision_recall": lambda k, p: rounded(me.precision_recall_curve(x.scored_sites(k, p))),
    "spl1_leakage_safe_split": lambda k, p: sp.leakage_safe_split(x.family_sites(k, p), 0.3).select(
        *SITE_KEYS, "gene_id", "group", "side"
    ),
    "spl1_leaks": lambda k, p: sp.leaks(sp.leakage_safe_split(x.family_sites(k, p), 0.3)),
    "spl1_leaks_by_site": lambda k, p: sp.leaks(
        sp.leakage_safe_split(x.family_sites(k, p), 0.3, [sp.SITE])
    ),
    "spl2_balanced_split": _balanced,
    "prd1_prediction_report": lambda k, p: pr.prediction_report(
        x.defective_predictions(k, p), x.scored_sites(k, p)
    ),
    "prd2_written_predictions": _written_predictions,
    # whole entry points
    "ent2_features_deep_sites": lambda k, p: rounded(
        build_features(x.reads(k, p), value_limit=150)
    ),
    "ent2_features": lambda k, p: rounded(build_features(x.reads(k, p))),
    "ent2_features_with_residuals": _features_with_residuals,
    "ent6_kmer_by_label": lambda k, p: rounded(f.kmer_by_label(_graded_sites(k, p), "central_5mer")),
    "ent6_top_kmer_by_label": lambda k, p: rounded(
        f.kmer_by_label(_graded_sites(k, p), "sequence", 20)
    ),
}

