import gzip
import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sitesignal.operators.joins import attach_labels, orphan_labels, unlabelled_sites, validated_join
from sitesignal.plans.ingest import audit_path, ingest, restore_audit
from sitesignal.plans.ingest_job import main
from sitesignal.schema import LABELLED_READS_SCHEMA, READS_SCHEMA
from sitesignal.sources.labels import prepare_labels, read_labels
from sitesignal.sources.reads import preview, read_reads
from sitesignal.sources.signals import (
    duplicate_sites,
    explode_reads,
    good_sites,
    lookup_site,
    parse_lines,
    read_lines,
    rejected_lines,
    skip_blank_lines,
)
from sitesignal.sources.storage import Storage

READ = [0.00299, 2.06, 125.0, 0.0177, 10.4, 122.0, 0.0093, 10.9, 84.1]


def line(transcript="T1", position="244", sequence="AAGACCA", reads=(READ,)):
    return json.dumps({transcript: {position: {sequence: list(reads)}}})


GOOD = {
    "plain": line(),
    "integers": line(position="1", reads=[[1, 2, 3, 4, 5, 6, 7, 8, 9], READ]),
    "not DRACH": line(position="2", sequence="ACCCCCA"),
    "spaces": "  " + line(position=" 3 ").replace(":", " : ") + " \t",
    "brace in id": line(transcript='a{}"\\b', position="+4"),
    "padded id": line(transcript=" T ", position="5"),
}
BAD = {
    "two transcripts": ('{"A":{"1":{"AAGACCA":[%s]}},"B":{"1":{"AAGACCA":[%s]}}}' % (READ, READ), "transcript"),
    "two positions": ('{"A":{"1":{"AAGACCA":[%s]},"2":{"AAGACCA":[%s]}}}' % (READ, READ), "position"),
    "two sequences": ('{"A":{"1":{"AAGACCA":[%s],"AAGACCC":[%s]}}}' % (READ, READ), "sequence"),
    "empty object": ("{}", "transcript"),
    "no position": ('{"A":{}}', "position"),
    "no sequence": ('{"A":{"1":{}}}', "sequence"),
    "a list": ("[1, 2]", "JSON"),
    "a number": ("12", "JSON"),
    "blank id": (line(transcript="  "), "blank"),
    "decimal position": (line(position="244.0"), "integer"),
    "text position": (line(position="x"), "integer"),
    "unknown bases": (line(sequence="NNNNNNN"), "7-mer"),
    "short": (line(sequence="AAGACC"), "7-mer"),
    "lower case": (line(sequence="aagacca"), "7-mer"),
    "newline in 7-mer": (line(sequence="AAGACCA\n"), "7-mer"),
    "no reads": (line(reads=[]), "reads"),
    "flat reads": (line(reads=READ), None),
    "8 wide": (line(reads=[READ[:8]]), "reads"),
    "ragged": (line(reads=[READ, READ[:8]]), "reads"),
    "null read": (line(reads=[READ, None]), "reads"),
    "null value": (line(reads=[[None, *READ[1:]]]), "finite"),
    "NaN": (line(reads=[[float("nan"), *READ[1:]]]), "finite"),
    "Infinity": (line(reads=[[*READ[:8], float("inf")]]), "finite"),
    "-Infinity": (line(reads=[[*READ[:8], float("-inf")]]), "finite"),
    "text value": (line(reads=[["x", *READ[1:]]]), None),
    "truncated": (line()[:-3], "JSON"),
    "trailing text": (line() + " x", None),
    "trailing brace": (line() + "}", None),
    "two objects": (line() + line(position="9"), None),
    "single quotes": (line().replace('"', "'"), "JSON"),
    "no JSON": ("hello", "JSON"),
}


def as_lines(spark, texts):
    rows = [("f", 0, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "file string, block long, line_id long, value string")


def write(path, texts, zipped=False):
    data = "".join(t + "\n" for t in texts)
    if zipped:
        with gzip.open(path, "wt", encoding="utf-8") as f:
            f.write(data)
    else:
        path.write_text(data, encoding="utf-8")
    return str(path)


def test_good_lines_pass(spark):
    rows = parse_lines(as_lines(spark, GOOD.values())).orderBy("line_id").collect()
    assert [r.reason for r in rows] == [None] * len(GOOD)
    assert [r.transcript_position for r in rows] == [244, 1, 2, 3, 4, 5]
    assert rows[1].reads == [[1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0], READ]
    assert rows[4].transcript_id == 'a{}"\\b' and rows[5].transcript_id == " T "


def test_every_bad_line_is_rejected_with_its_reason(spark):
    parsed = parse_lines(as_lines(spark, [b[0] for b in BAD.values()]))
    rows = rejected_lines(parsed).orderBy("line_id").collect()
    assert len(rows) == len(BAD)
    for (name, (text, part)), row in zip(BAD.items(), rows):
        assert row.value == text
        assert part is None or part in row.reason, (name, row.reason)
    assert good_sites(parsed).count() == 0


def test_blank_lines_are_skipped(spark):
    lines = as_lines(spark, ["", "  ", "\t", "  ", line()])
    assert skip_blank_lines(lines).count() == 1


def test_explode_names_values_in_order(spark):
    sites = good_sites(parse_lines(as_lines(spark, [line(reads=[READ, READ[::-1]])])))
    rows = explode_reads(sites).orderBy("read_idx").collect()
    assert explode_reads(sites).schema.simpleString() == READS_SCHEMA.simpleString()
    assert [list(r[6:]) for r in rows] == [READ, READ[::-1]]
    assert [(r.n_reads, r.read_idx, r.central_5mer) for r in rows] == [(2, 0, "AGACC"), (2, 1, "AGACC")]
    assert rows[0].asDict()["minus1_signal_sd"] == 2.06


def many(n, start=0):
    return [line(f"T{i % 3}", str(i), reads=[READ] * (1 + i % 3)) for i in range(start, start + n)]


LABELS = "gene_id,transcript_id,transcript_position,label\n"


def visible(folder):
    return sorted(name for name in os.listdir(folder) if not name.startswith("."))


class Killed(BaseException):
    """Stands for the end of the driver: nothing after it runs, also no cleaning."""


@pytest.mark.parametrize("at", ["reads", "inner audit", "commit", "audit"])
def test_a_killed_driver_leaves_all_or_nothing_and_blocks_no_later_run(spark, tmp_path, monkeypatch, at):
    signals, output = write(tmp_path / "s.json", many(5)), str(tmp_path / "out" / "reads.parquet")
    steps = {"reads": ("write_text", 1), "inner audit": ("rename", 1), "commit": ("write_text", 2), "audit": ("rename", 2)}
    name, call = steps[at]
    calls, real = [], getattr(Storage, name)

    def dies(self, *args):
        calls.append(args)
        if len(calls) == call:
            raise Killed
        return real(self, *args)

    with monkeypatch.context() as patch:
        patch.setattr(Storage, name, dies)
        patch.setattr(Storage, "delete", lambda self, path: None)
        with pytest.raises(Killed):
            ingest(spark, signals, output)
    committed = os.path.exists(output)
    assert committed == (at in ("commit", "audit")) and not os.path.exists(audit_path(output))
    if committed:  # data and a copy of the audit inside; the next call restores the audit beside it
        assert read_reads(spark, output).count() == 9
        with pytest.raises(FileExistsError):
            ingest(spark, signals, output)
        assert json.load(open(audit_path(output)))["parsed_read_rows"] == 9
        assert not restore_audit(spark, output)
    else:
        audit = ingest(spark, signals, output)
        assert json.load(open(audit_path(output))) == audit and read_reads(spark, output).count() == 9


@pytest.mark.parametrize("zipped", [False, True])
def test_ingest_end_to_end(spark, tmp_path, zipped):
    signals = write(tmp_path / ("s.json.gz" if zipped else "s.json"), ["", *many(7), " "], zipped)
    labels = tmp_path / "data.info"
    labels.write_text(LABELS + "G1,T0,0,1\n,T1,1,0\n  ,T2,2,0.5\nG1,T0,99,0\n")
    output = str(tmp_path / "new" / "reads.parquet")
    audit = ingest(spark, signals, output, str(labels), batch_size=4)
    assert audit == {
        "signal_path": signals,
        "label_path": str(labels),
        "output_path": output,
        "max_sites_requested": None,
        "parsed_sites": 7,
        "parsed_read_rows": 13,
        "sites_outside_expected_DRACH_motif": 0,
        "label_rows": 4,
        "sites_without_labels": 4,
        "labels_without_parsed_sites": 1,
    }
    assert json.load(open(tmp_path / "new" / "reads.audit.json")) == audit
    assert visible(tmp_path / "new") == ["reads.audit.json", "reads.parquet"]
    df = read_reads(spark, output)
    assert df.schema.simpleString() == LABELLED_READS_SCHEMA.simpleString()
    got = {
        (r.transcript_id, r.transcript_position): (r.gene_id, r.label)
        for r in df.collect()
    }
    assert got[("T0", 0)] == ("G1", 1.0)
    assert got[("T1", 1)] == (None, 0.0) and got[("T2", 2)] == (None, 0.5)
    assert got[("T0", 3)] == (None, None)
    for file in (tmp_path / "new" / "reads.parquet").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        assert all(meta.row_group(i).num_rows <= 4 for i in range(meta.num_row_groups))
        assert meta.row_group(0).column(0).compression == "SNAPPY"
    assert preview(df).count() == 5
    for path in [output, audit_path(output)]:
        with pytest.raises(FileExistsError):
            ingest(spark, signals, output)
        if path == output:
            os.rename(output, output + ".moved")
    assert read_reads(spark, output + ".moved", ["label"]).columns == ["label"]


def test_ingest_without_labels(spark, tmp_path):
    signals = write(tmp_path / "s.json", [*many(3), GOOD["not DRACH"]])
    output = str(tmp_path / "r.parquet")
    audit = main(["--signals", signals, "--output", output])
    assert audit["label_rows"] is None and audit["labels_without_parsed_sites"] is None
    assert audit["sites_outside_expected_DRACH_motif"] == 1
    assert read_reads(spark, output).schema.simpleString() == READS_SCHEMA.simpleString()


@pytest.mark.parametrize("zipped", [False, True])
def test_first_bad_line_fails_with_its_number(spark, tmp_path, zipped):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        texts = [*many(30), "", "", "bad", *many(10, 100), "{}"]
        signals = write(tmp_path / ("s.json.gz" if zipped else "s.json"), texts, zipped)
        output = str(tmp_path / "r.parquet")
        with pytest.raises(ValueError, match="line 33: not valid JSON"):
            ingest(spark, signals, output)
        assert sorted(os.listdir(tmp_path)) == [os.path.basename(signals)]
        audit = ingest(spark, signals, output, max_sites=30)
        assert audit["parsed_sites"] == 30
        kept = read_reads(spark, output).select("transcript_position").distinct()
        assert {r[0] for r in kept.collect()} == set(range(30))
        with pytest.raises(ValueError, match="line 33"):
            ingest(spark, signals, str(tmp_path / "q.parquet"), max_sites=31)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_first_sites_over_several_files(spark, tmp_path):
    write(tmp_path / "a.json", many(3))
    write(tmp_path / "b.json", ["", *many(3, 3)])
    write(tmp_path / "c.json", ["bad"])
    output = str(tmp_path / "out" / "r.parquet")
    ingest(spark, str(tmp_path / "*.json"), output, max_sites=5)
    got = read_reads(spark, output).select("transcript_position").distinct().collect()
    assert {r[0] for r in got} == {0, 1, 2, 3, 4}


def test_duplicates_and_empty_inputs_fail(spark, tmp_path):
    output = str(tmp_path / "r.parquet")
    repeated = write(tmp_path / "d.json", [line(), *many(2), line(sequence="ACCCCCA")])
    with pytest.raises(ValueError, match="Duplicate site.*T1.*244"):
        ingest(spark, repeated, output)
    with pytest.raises(ValueError, match="Duplicate"):
        ingest(spark, write(tmp_path / "e.json", [line(), line(), "bad"]), output)
    with pytest.raises(ValueError, match="line 2"):
        ingest(spark, write(tmp_path / "f.json", [line(), "bad", line()]), output)
    with pytest.raises(ValueError, match="No sites"):
        ingest(spark, write(tmp_path / "g.json", ["", " "]), output)
    for options in [{"batch_size": 0}, {"max_sites": 0}]:
        with pytest.raises(ValueError, match="positive"):
            ingest(spark, repeated, output, **options)
    assert not [name for name in os.listdir(tmp_path) if "r.parquet" in name]
    sites = good_sites(parse_lines(read_lines(spark, repeated)))
    assert [tuple(r) for r in duplicate_sites(sites).collect()] == [("T1", 244, 2)]


def labels_file(tmp_path, text):
    path = tmp_path / "labels.csv"
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize(
    "text, message",
    [
        ("transcript_id,label\nT1,0\n", "Missing required columns.*transcript_position"),
        (LABELS + "G,,1,0\n", "Missing transcript"),
        (LABELS + "G,NA,1,0\n", "Missing transcript"),
        (LABELS + "G,T1,1,\n", "Missing transcript"),
        (LABELS + "G,T1,nan,0\n", "Missing transcript"),
        (LABELS + "G,  ,1,0\n", "Blank"),
        (LABELS + "G,T1,1.5,0\n", "integer"),
        (LABELS + "G,T1,1,yes\n", "number"),
        (LABELS + "G,T1,1,inf\n", "non-finite"),
        (LABELS + "G,T1,1,1.2\n", "range"),
        (LABELS + "G,T1,1,-0.1\n", "range"),
        (LABELS + "G,T1,1,0\nG,T1,1,1\n", "Duplicate.*T1"),
    ],
)
def test_bad_labels_are_refused(spark, tmp_path, text, message):
    with pytest.raises(ValueError, match=message):
        read_labels(spark, labels_file(tmp_path, text))


def test_good_labels(spark, tmp_path):
    path = labels_file(
        tmp_path, "label,transcript_position,transcript_id,extra\n0,1,T1,x\n1.0,2,T1,y\n0.5,1,T2,z\n"
    )
    rows = read_labels(spark, path)
    assert rows.columns == ["gene_id", "transcript_id", "transcript_position", "label"]
    assert rows.dtypes[0][1] == "string"
    assert {tuple(r) for r in rows.collect()} == {
        (None, "T1", 1, 0.0), (None, "T1", 2, 1.0), (None, "T2", 1, 0.5)
    }
    raw = read_labels(spark, labels_file(tmp_path, LABELS + "G,T1,1,\nG,T1,1,7\n"), validate=False)
    assert raw.count() == 2


def test_joins(spark):
    sites = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1)], "transcript_id string, transcript_position long")
    labels = spark.createDataFrame(
        [("g", "A", 1, 1.0), ("g", "C", 1, 0.0)],
        "gene_id string, transcript_id string, transcript_position long, label double",
    )
    joined = attach_labels(sites, labels)
    assert joined.count() == 3 and joined.filter(F.col("label").isNull()).count() == 2
    assert {tuple(r) for r in unlabelled_sites(sites, labels).collect()} == {("A", 2), ("B", 1)}
    assert [tuple(r) for r in orphan_labels(labels, sites).collect()] == [("C", 1)]
    with pytest.raises(ValueError, match="not unique in the right"):
        validated_join(sites, labels.union(labels), validate="many_to_one")
    with pytest.raises(ValueError, match="not unique in the left"):
        validated_join(sites.union(sites), labels)
    assert validated_join(sites, labels.union(labels), validate="one_to_many").count() == 2
    with pytest.raises(ValueError, match="validate"):
        validated_join(sites, labels, validate="x")


def test_lookup_of_one_site(spark):
    parsed = parse_lines(as_lines(spark, [line("T2", "7", reads=[READ] * 3), line(), line("T3", "1", reads=[])]))
    labels = spark.createDataFrame(
        [("g", "T2", 7, 1.0), ("g", "T3", 1, 0.0)],
        "gene_id string, transcript_id string, transcript_position long, label double",
    )
    row = lookup_site(parsed, labels).first()
    assert (row.transcript_id, row.transcript_position, row.n_reads, row.label) == ("T2", 7, 3, 1.0)
    assert row.reads[0] == READ
    with pytest.raises(ValueError, match="one matching label"):
        lookup_site(parsed, labels, "T1", 244)
    with pytest.raises(ValueError, match="not valid"):
        lookup_site(parsed, labels, "T3", 1)
    with pytest.raises(ValueError, match="No such site"):
        lookup_site(parsed, labels, "T9", 1)
    with pytest.raises(ValueError, match="one matching label"):
        lookup_site(parsed, labels.union(labels))


def test_first_lines_take_two_jobs_whatever_the_blanks(spark, tmp_path):
    from sitesignal.sources.signals import first_lines, read_lines, skip_blank_lines

    jobs = []
    for blanks in (1, 40):
        path = tmp_path / f"lines{blanks}.txt"
        path.write_text("a\nb\nc\n" + "\n" * blanks + "d\n" + "\n" * blanks + "e\n")
        group = f"first-lines-{blanks}"
        spark.sparkContext.setJobGroup(group, "first lines")
        found = first_lines(skip_blank_lines(read_lines(spark, str(path))), 4)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        spark.sparkContext.setJobGroup("rest", "rest")
        assert [r.value for r in found.collect()] == ["a", "b", "c", "d"]
    assert jobs[0] == jobs[1]


def test_plain_text_is_not_shuffled_beside_a_gz_file(spark, tmp_path):
    import gzip

    from sitesignal.sources.signals import read_lines

    (tmp_path / "a.txt").write_text("x\ny\n")
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write("z\n")
    lines = read_lines(spark, str(tmp_path))
    assert sorted(r.value for r in lines.collect()) == ["x", "y", "z"]
    assert sorted(r.value for r in read_lines(spark, str(tmp_path / "a.txt")).collect()) == ["x", "y"]


@pytest.mark.parametrize("text, good", [("0.5", True), ("5e-1", True), (" .5", True), ("0.5f", False), ("0.5d", False), ("0x1", False), ("inf", False)])
def test_label_texts_that_are_numbers(spark, text, good):
    raw = spark.createDataFrame([("T1", "1", text)], "transcript_id string, transcript_position string, label string")
    if good:
        assert prepare_labels(raw).first().label == 0.5
    else:
        with pytest.raises(ValueError):
            prepare_labels(raw)
