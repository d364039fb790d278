import os

import pytest

from sitesignal.sources.predictions import prediction_report, read_predictions, read_report, write_predictions
from sitesignal.sources.storage import Storage

SCHEMA = "transcript_id string, transcript_position bigint, score double"
SITES = [("T1", 1), ("T1", 2), ("T2", 1), ("T1", 1)]  # reads repeat their site
GOOD = [("T1", 1, 0.0), ("T1", 2, 1.0), ("T2", 1, 0.1234567890123456)]


@pytest.fixture
def sites(spark):
    return spark.createDataFrame(SITES, "transcript_id string, transcript_position bigint")


def report(spark, sites, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.check: r.failed_rows for r in prediction_report(df, sites).collect() if r.failed_rows}


def test_good_predictions_and_their_report_are_written_together(spark, sites, tmp_path):
    path = str(tmp_path / "new" / "p.csv")
    counts = write_predictions(spark.createDataFrame(GOOD, SCHEMA), sites, path)
    assert counts["sites"] == counts["predictions"] == 3
    assert sorted(map(tuple, read_predictions(spark, path).collect())) == GOOD
    assert read_report(spark, path) == counts
    text = "".join(f.read_text() for f in (tmp_path / "new" / "p.csv").glob("*.csv"))
    assert text.startswith("transcript_id,transcript_position,score\n") and "0.1234567890123456" in text
    with pytest.raises(FileExistsError):
        write_predictions(spark.createDataFrame(GOOD, SCHEMA), sites, path)


NAN, INF = float("nan"), float("inf")
BAD = {
    "missing": (GOOD[:2], {"missing_sites": 1}),
    "none": ([(None, None, None)], {"missing_sites": 3, "bad_scores": 1, "null_keys": 1}),
    "unknown": ([*GOOD, ("T9", 1, 0.5), ("T9", 1, 0.5)], {"unknown_sites": 1, "repeated_sites": 1}),
    "repeated": ([*GOOD, GOOD[0]], {"repeated_sites": 1}),
    "scores": ([(t, p, s) for (t, p, _), s in zip(GOOD, [-0.1, 1.1, NAN], strict=True)], {"bad_scores": 3}),
    "no scores": ([(t, p, s) for (t, p, _), s in zip(GOOD, [None, INF, 0.5], strict=True)], {"bad_scores": 2}),
    "null key": ([*GOOD, (None, 1, 0.5)], {"null_keys": 1}),
}


@pytest.mark.parametrize("case", BAD)
def test_refused_input_leaves_no_file(spark, sites, tmp_path, case):
    rows, failed = BAD[case]
    assert report(spark, sites, rows) == failed
    with pytest.raises(ValueError) as error:
        write_predictions(spark.createDataFrame(rows, SCHEMA), sites, tmp_path / "p.csv")
    assert all(f"{n} {check}" in str(error.value) for check, n in failed.items())
    assert os.listdir(tmp_path) == []


def test_a_kill_before_the_commit_leaves_nothing_at_the_path(spark, sites, tmp_path, monkeypatch):
    path, df = str(tmp_path / "p.csv"), spark.createDataFrame(GOOD, SCHEMA)

    class Killed(BaseException):
        pass

    def dies(*_):
        raise Killed

    with monkeypatch.context() as patch:
        patch.setattr(Storage, "rename", dies)
        patch.setattr(Storage, "delete", lambda self, path: None)
        with pytest.raises(Killed):
            write_predictions(df, sites, path)
    assert not os.path.exists(path)
    write_predictions(df, sites, path)
    assert read_predictions(spark, path).count() == 3 and read_report(spark, path)["predictions"] == 3


def test_no_sites_and_no_predictions(spark, sites, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert report(spark, sites.filter("false"), []) == {}
    assert write_predictions(none, sites.filter("false"), tmp_path / "p.csv")["predictions"] == 0
