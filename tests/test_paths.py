"""Scan times, paths, truth links, reasons and output forms."""

import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from wavelake import cli, paths
from wavelake.operators import naming, projects, textmine

TIMES = [
    "2024-01-01", "20240101", "2024-W01", "2024-W01-5", "2024W015", "2020-W53-7", "2024-01-01T10", "2024-01-01T10:00", "2024-01-01 10:00:59", "20240101T000000", "20240101T1030", "2024-01-01T10:00:00.123456",
    "2024-01-01T10:00Z", "2024-01-01T10:00:00Z", "20240101T100000Z", "2024-01-01T10:00:00+02:00", "2024-01-01T10:00:00-0530", "2024-01-01T23:30-02", "2024-02-29T00:00:00+00:00:30", " 2024-01-01T10:00 ", "2024-01-01x10:00", "0001-01-02T00:00",
]
BAD = ["", "  ", "x", "2024-13-01", "2023-02-29", "2024-0101", "2024-01-01T25:00", "2024-01-01T10:60", "2024-01-01T", "2023-W53-1", "2024-W00-1", "2024-W01-8", "2024-01-01T10:00+25:00", "2024-01-01T10:0", None]


def test_scan_times_are_those_of_iso_8601(spark):
    rows = spark.createDataFrame([(t,) for t in TIMES], "t string").select("t", naming.scan_time(F.col("t")).alias("out")).collect()
    for r in rows:
        want = dt.datetime.fromisoformat(r.t.strip())
        want = want.replace(tzinfo=want.tzinfo or dt.timezone.utc).astimezone(dt.timezone.utc)
        assert r.out == f"{want.year:04d}" + want.strftime("-%m-%dT%H:%M:%SZ"), r.t


@pytest.mark.parametrize("text", BAD)
def test_what_is_no_scan_time_raises(spark, text):
    if text:
        with pytest.raises(ValueError):
            dt.datetime.fromisoformat(text.strip())
    with pytest.raises(Exception, match="Timestamp must not be empty|Invalid timestamp"):
        spark.createDataFrame([(text,)], "t string").select(naming.scan_time(F.col("t"))).collect()


def test_scan_roots(tmp_path, monkeypatch):
    top, root = tmp_path / "projects", tmp_path / "projects" / "tool"
    root.mkdir(parents=True)
    (root / "pyproject.toml").write_text("[project]\nname='x'\n")
    monkeypatch.chdir(root)
    assert paths.is_placeholder("/path/to/github-projects") and not paths.is_placeholder("/mnt/github-projects")
    for path in (None, "/path/to/modules"):
        with pytest.raises(ValueError, match="inferred|example"):
            paths.scan_root(path)
    (top / "gr-one").mkdir()
    assert paths.scan_root(None) == paths.scan_root("/path/to/modules") == paths.scan_root("..") == paths.inferred() == str(top)
    monkeypatch.setenv("WHERE", str(top))
    monkeypatch.setenv("HOME", str(top))
    assert paths.scan_root("$WHERE") == paths.scan_root("~") == str(top) and paths.scan_root("~/tool") == paths.scan_root("tool") == str(root)
    assert paths.scan_root("hdfs://x/y") == "hdfs://x/y"
    with pytest.raises(ValueError, match="does not exist"):
        paths.scan_root("/nonexistent/xyz")
    other = tmp_path / "other"
    (other / "gr-two").mkdir(parents=True)
    (root / paths.OPTIONS).write_text(f'[scan]\nroot = "{other}"\n')
    assert paths.scan_root(None) == str(other)


def test_truth_links_best_first_with_a_default(spark):
    pages = [
        (1, "http://h/a/page.html", '<a href="/x/signal_record.txt">t</a><a class="q" href="f/2018R2_metadata.txt?x=1">m</a><a href="/x/signal_record.txt">again</a><a href="z.txt">the <b>metadata</b></a><a href="signal_record.zip">no</a><a href="readme.txt">no</a>'),
        (2, "http://h/b/", "<p>nothing</p>"), (3, "http://h/c/", None),
    ]
    out = textmine.truth_links(spark.createDataFrame(pages, "id long, url string, html string"), "id", "url", "html").orderBy("id", "priority", "url").collect()
    assert [(r.id, r.priority, r.url, r.name) for r in out] == [
        (1, 0, "http://h/a/f/2018R2_metadata.txt?x=1", "2018R2_metadata.txt"), (1, 2, "http://h/x/signal_record.txt", "signal_record.txt"), (1, 3, "http://h/a/z.txt", "z.txt"),
        (2, 0, "http://h/b/signal_record_C_2023.txt", "signal_record_C_2023.txt"), (3, 0, "http://h/c/signal_record_C_2023.txt", "signal_record_C_2023.txt"),
    ]


def test_reasons_of_modes(spark):
    rows = spark.createDataFrame([("DSSS",), ("gdss",), ("LDPC",), ("FM",)], "m string").select("m", projects.exclusion_reason(F.col("m")).alias("r")).collect()
    said = {r.m: r.r for r in rows}
    assert "noise" in said["DSSS"] and "noise" in said["gdss"] and "correction" in said["LDPC"] and said["FM"] is None


def test_output_forms(spark, tmp_path, capsys):
    frame = spark.createDataFrame([(1, "a|b"), (2, None)], "n long, t string").coalesce(1)
    cli.show(frame, form="markdown")
    assert capsys.readouterr().out.splitlines() == ["| n | t |", "|---|---|", "| 1 | a\\|b |", "| 2 |  |"]
    cli.show(frame, form="csv")
    assert capsys.readouterr().out.splitlines() == ["n,t", "1,a|b", "2,"]
    for form, read in (("json", spark.read.json), ("csv", lambda p: spark.read.csv(p, header=True))):
        cli.show(frame, f"{tmp_path}/{form}", form)
        assert sorted(int(r.n) for r in read(f"{tmp_path}/{form}").collect()) == [1, 2]
    a = cli.parser().parse_args(["validate", "x", "--threshold", "0.5", "--format", "csv", "--output", "y"])
    assert (a.threshold, a.format, a.output) == (0.5, "csv", "y")


def test_cases_of_a_family_model(spark):
    windows = [("radioml", "QAM16", 10, 1, "AM", 0.9), ("radioml", "QAM16", 10, 0, "QAM", 0.8), ("radioml", "GFSK", 10, 0, "FSK", 0.5), ("radioml", "CPFSK", 8, 0, "FSK", 0.9), ("synthetic", "WBFM", 10, 0, "FM", 0.6), ("synthetic", "BPSK", 10, 0, "FM", 0.9)]
    schema = "source string, class string, snr_db int, number long, predicted_family string, family_confidence double"
    out = {r.label: r for r in projects.checkpoint_cases(spark.createDataFrame(windows, schema)).collect()}
    assert len(out) == 12 and {k for k, r in out.items() if r.ok} == {"radioml:QAM16@10dB", "synthetic:WBFM", "radioml:WBFM (left out)", "radioml:BPSK (left out)", "radioml:QPSK (left out)"}
    assert "no windows" in out["radioml:CPFSK@10dB"].note and out["radioml:GFSK@10dB"].predicted_family == "FSK" and out["radioml:GFSK@10dB"].note is None
    only = projects.checkpoint_cases(spark.createDataFrame(windows[4:], schema)).collect()
    assert [r.label for r in only] == ["synthetic:WBFM", "synthetic:BPSK", "synthetic:QPSK", "synthetic:NBFM_25"]


def test_audio_bandwidth(spark):
    from wavelake.operators import captures

    tone = lambda *hz: [float(sum(math.sin(2 * math.pi * h * k / 8000) for h in hz)) for k in range(800)]
    rows = [(0, tone(1000)), (1, tone(500, 2500)), (2, []), (3, None)]
    got = {r.k: r.b for r in spark.createDataFrame(rows, "k int, x array<double>").select("k", captures.audio_bandwidth(8000.0)("x").alias("b")).collect()}
    # Bins are counted at half their width, as rate / (2 n).
    assert got == {0: 0.0, 1: 1000.0, 2: None, 3: None}


def test_checksums_of_one_name_in_two_folders_and_of_no_file(spark, tmp_path):
    from wavelake.operators import datasets

    for folder, text in (("a", b"one"), ("b", b"two"), ("c", b"one")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.onnx").write_bytes(text)
    (tmp_path / "c" / "y.onnx").write_bytes(b"y")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = spark.createDataFrame([("x.onnx", sha(b"one")), ("y.onnx", sha(b"y")), ("z.onnx", sha(b"z"))], "name string, sha string")
    got = lambda at: {r.name: r.status for r in datasets.verify_checksums(projects.listing(spark, at), want).collect()}
    assert got(str(tmp_path)) == {"x.onnx": "mismatch", "y.onnx": "ok", "z.onnx": "missing"}
    assert got(str(tmp_path / "c")) == {"x.onnx": "ok", "y.onnx": "ok", "z.onnx": "missing"}
    with pytest.warns(UserWarning, match="nothing is verified"):
        assert datasets.read_checksums(spark, f"{tmp_path}/none", on_missing="warn").count() == 0
    with pytest.raises(Exception, match="exist"):
        datasets.read_checksums(spark, f"{tmp_path}/none")
