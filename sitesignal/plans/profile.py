"""Profile one data set, compare two: every table of the analysis by name."""

from collections.abc import Mapping
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.operators import compare as c
from sitesignal.operators import distributions as d
from sitesignal.operators import frequency as f
from sitesignal.operators import quality as q
from sitesignal.operators import sites as s
from sitesignal.operators import summaries as m
from sitesignal.operators.quantiles import counted, described, in_ranges
from sitesignal.sources.scratch import settle

PLAIN = (0.25, 0.5, 0.75)
PERCENTILES = tuple(m.COVERAGE_PERCENTILES)  # they include the quartiles
SERIES = ["_table", "label"]


class Profile(Mapping):
    """Tables that describe one data set, by name; each is built when it is first asked for.

    What several tables need is computed once and written to the shared folder: the
    site table, the site means, and one table of value counts over the sites, dealt
    by ranges, from which all percentiles and moments are taken. Boxes count values of
    their own, so a table over sites never waits for the values of all reads. Use it
    inside ``scratch.scratch_tables`` to have these deleted at the end.
    """

    def __init__(self, reads: DataFrame, labels: DataFrame | None = None, binary: bool = True):
        self.reads, self.raw_labels, self.wanted = reads, labels, (0, 1) if binary else None
        self._built: dict[str, DataFrame] = {}
        known = lambda: s.labelled(self.sites)
        self._builders = {
            "quality": lambda: q.quality_report(reads),
            "sites": lambda: self.sites,
            "summary": lambda: m.dataset_summary(reads),
            "missing_values": lambda: m.missing_values(reads),
            "class_balance": lambda: m.class_balance(known()),
            "label_values": lambda: m.label_value_counts(reads),
            "label_distribution": lambda: m.label_distribution(self.label_rows),
            "label_histogram": lambda: d.histogram(self.label_rows, "label", 20, 0, 1),
            "transcript_labels": lambda: m.transcript_labels(self.label_rows),
            "constant_label_share": lambda: m.constant_label_share(self.label_rows),
            "coverage": lambda: self._described("coverage", PERCENTILES),
            "coverage_by_label": lambda: self._described("coverage_by_label", PLAIN, ["label"]),
            "coverage_histogram": lambda: d.histogram(self.sites, "n_reads", 50, log=True),
            "coverage_below": lambda: m.coverage_below(self.sites),
            "sites_per_gene": lambda: self.by_gene,
            "sites_per_gene_described": lambda: self._described("sites_per_gene", PLAIN),
            "sites_per_gene_histogram": lambda: d.histogram(self.by_gene, "n_sites", 50, log=True),
            "sites_per_transcript": lambda: self.by_transcript,
            "sites_per_transcript_described": lambda: self._described("sites_per_transcript", PLAIN),
            "transcript_sizes": lambda: m.size_histogram(self.by_transcript),
            "motif_summary": lambda: f.motif_summary(self.sites),
            "unexpected_motifs": lambda: s.unexpected_motifs(self.sites),
            "site_means": lambda: self.means,
            "sites_by_label": lambda: m.label_value_counts(self.means),
            "excluded_reads": lambda: d.excluded_rows(s.labelled(reads)),
            "read_boxes": lambda: self._boxes(s.labelled(reads)),
            "site_mean_boxes": lambda: self._boxes(self.means),
            "signal_density": lambda: d.density_by_label(reads),
        }
        for column in ["sequence", "central_5mer"]:
            self._builders |= {
                f"{column}_counts": lambda column=column: f.value_counts(self.sites, column),
                f"{column}_by_label": lambda column=column: f.crosstab(self.sites, column, self.wanted),
                f"{column}_top20": lambda column=column: f.top_keys(self[f"{column}_by_label"]),
                f"{column}_percentages": lambda column=column: f.column_percentages(self[f"{column}_by_label"]),
            }

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)

    @cached_property
    def sites(self) -> DataFrame:
        return settle(s.site_table(self.reads))

    @cached_property
    def means(self) -> DataFrame:
        return settle(s.site_means(self.reads, self.raw_labels))

    @property
    def label_rows(self) -> DataFrame:
        return self.sites if self.raw_labels is None else self.raw_labels

    @cached_property
    def by_gene(self) -> DataFrame:
        return m.group_sizes(self.sites, "gene_id")

    @cached_property
    def by_transcript(self) -> DataFrame:
        return m.group_sizes(self.label_rows, "transcript_id")

    @cached_property
    def _site_cells(self) -> DataFrame:
        """How often each value occurs, of the tables over sites, which are small; a table without labels has label 0."""
        whole = lambda df, column: df.select(F.lit(0.0).alias("label"), column)
        known = s.labelled(self.sites).select(F.col("label").cast("double").alias("label"), "n_reads")
        sources = {
            "coverage": (whole(self.sites, "n_reads"), ["n_reads"]),
            "coverage_by_label": (known, ["n_reads"]),
            "sites_per_gene": (whole(self.by_gene, "n_sites"), ["n_sites"]),
            "sites_per_transcript": (whole(self.by_transcript, "n_sites"), ["n_sites"]),
        }
        cells = [
            counted(df, ["label"], list(columns)).withColumn("_table", F.lit(name))
            for name, (df, columns) in sources.items()
        ]
        return in_ranges(reduce(DataFrame.unionByName, cells), SERIES)

    @cached_property
    def _stats(self) -> DataFrame:
        """A row for each series of the counts over sites; small."""
        return settle(described(self._site_cells, SERIES, PERCENTILES))

    def _described(self, name: str, percentiles, keys=()) -> DataFrame:
        stats = self._stats.filter(F.col("_table") == name)
        return m.described_columns(stats, list(keys), percentiles, PERCENTILES)

    def _boxes(self, rows: DataFrame) -> DataFrame:
        """Boxes of all reads or site means, which no other table needs to wait for."""
        return d.box_stats(rows, labels=self.wanted)


def profile(reads: DataFrame, labels: DataFrame | None = None, binary: bool = True) -> Profile:
    """Tables that describe one data set, by name; nothing is drawn, and nothing runs before a table is asked for.

    ``labels`` is the raw label table, if label statistics should refer to it
    rather than to the sites with reads.  ``binary=False`` takes every label in
    use where the default looks at 0 and 1.
    """
    return Profile(reads, labels, binary)


def compare(a: DataFrame, b: DataFrame, validate: bool = True) -> dict[str, DataFrame]:
    """Tables that compare the sites and labels of two data sets, by name."""
    pairs = c.site_pairs(a, b, validate)
    return {
        "pairs": pairs,
        "overlap": c.overlap_summary(pairs),
        "agreement": c.agreement_summary(pairs),
        "label_crosstab": c.label_crosstab(pairs),
        "disagreements": c.disagreements(pairs),
    }
