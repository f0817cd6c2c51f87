"""Store, data sets, checksum files, names, scan run and command line."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake import cli
from wavelake.facade import Engine
from wavelake.functions import waveforms
from wavelake.operators import datasets, naming, plugins, projects
from wavelake.store import AuditStore


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("text,want", [("2026-05-31T15:00:00Z", "2026-05-31T15:00:00Z"), ("2026-05-31T15:00:00", "2026-05-31T15:00:00Z"), (" 2026-05-31T15:00:00+02:00", "2026-05-31T13:00:00Z"), ("2026-05-31", "2026-05-31T00:00:00Z")])
def test_scan_time(spark, text, want):
    assert one(spark, naming.scan_time(F.lit(text))) == want


@pytest.mark.parametrize("text,said", [("", "must not be empty"), ("soon", "Invalid timestamp"), ("12", "Invalid timestamp")])
def test_scan_time_of_no_time(spark, text, said):
    with pytest.raises(Exception, match=said):
        one(spark, naming.scan_time(F.lit(text)))


def test_small_names(spark):
    assert one(spark, naming.name_list(F.lit(" a, b ,,a"))) == ["a", "b"] and one(spark, naming.name_list(F.lit(" , "))) is None
    assert one(spark, naming.merged_notes(F.lit("x"), F.lit(""))) == "x" and one(spark, naming.merged_notes(F.lit(None).cast("string"), F.lit("y"))) == "y"
    assert one(spark, naming.half_even(F.lit(0.125), 2)) == 0.12
    assert one(spark, naming.tiled(F.array(), 4)) == []


def test_parameters_and_keys():
    for bad in ({"tau": -1e-6}, {"tau": 75e-6}, {"deviation": 8000.0, "nominal": 2500.0}):
        with pytest.raises(ValueError):
            datasets.check_parameters(**bad)
    datasets.check_parameters(tau=50e-6, deviation=7000.0, nominal=2500.0)
    assert datasets.class_of_key("gmsk-bt05") == "GMSK_BT05" and datasets.class_of_key("NBFM25") == "NBFM_25"
    with pytest.raises(ValueError, match="known"):
        datasets.class_of_key("nothing")
    got = datasets.options('[scan]\nscan_root = "/x"\nexclude_projects = ["a", 1]\ninclude_projects = "no list"\n')
    assert got["root"] == "/x" and got["excludes"] == ["a", "1"] and got["includes"] == [] and datasets.options("")["iq_output"] == ".scan_iq"


def test_checksum_files(spark, tmp_path):
    models = tmp_path / "models"
    models.mkdir()
    for n in ("b.onnx", "a.onnx", "notes.txt"):
        (models / n).write_bytes(n.encode())
    files = projects.listing(spark, str(models))
    assert datasets.update_checksums(files, f"{tmp_path}/sums") == 2
    sums = datasets.read_checksums(spark, f"{tmp_path}/sums")
    assert datasets.verified_names(files, sums) == ["a.onnx", "b.onnx"]
    text = "".join(p.read_text() for p in (tmp_path / "sums").glob("part-*"))
    assert text.startswith("# ") and text.index("a.onnx") < text.index("b.onnx")
    (models / "a.onnx").write_bytes(b"changed")
    with pytest.raises(ValueError, match="a.onnx .mismatch"):
        datasets.verified_names(projects.listing(spark, str(models)), sums)
    with pytest.raises(FileNotFoundError):
        datasets.update_checksums(files.filter("false"), f"{tmp_path}/none")
    assert datasets.model_names(files, "a", True) == "a.onnx"


def test_data_sets(spark, tmp_path):
    def put(name, data=b"x"):
        p = tmp_path / "data" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)

    put("radioml/RML2016.10a.tar.gz")
    put("radioml/other.pkl")
    put("cspb/signal_1.tim")
    put("cspb/Batch_Dir_2/signal_2.tim")
    put("cspb/deep/er/signal_3.tim")
    files = lambda: projects.listing(spark, str(tmp_path / "data"))
    state = lambda: {r.dataset: r.status for r in datasets.status(files()).collect()}
    assert state() == {"radioml": "present", "hisarmod": "missing", "cspb": "present (no truth file)"}
    assert {r.dataset: r.path.split("/")[-1] for r in datasets.present(files()).collect()}["radioml"] == "other.pkl"
    assert sorted(r.name for r in datasets.signal_files(files()).collect()) == ["signal_1.tim", "signal_2.tim"]
    assert datasets.truth_file(files()).isEmpty()
    put("cspb/Batch_Dir_2/signal_record.txt")
    put("cspb/metadata.txt")
    assert datasets.truth_file(files()).first().path.endswith("cspb/metadata.txt") and state()["cspb"] == "present"
    put("cspb/CSPB.ML.2018.zip")
    assert state()["cspb"].startswith("warning")
    none = spark.createDataFrame([("gone.bin", "0" * 64)], "name string, sha string")
    found = {r.dataset: r.failure for r in datasets.verification(files(), none).collect()}
    assert found == {"radioml": False, "hisarmod": False, "cspb": True, "gone.bin": True}


def test_store(spark, tmp_path):
    store = AuditStore(spark, f"file://{tmp_path}/audit")
    at = lambda d: dt.datetime(2026, 1, d)
    assert store.read("issues").count() == 0 and store.count_issues() == 0 and not store.resolve(1)
    store.upsert_projects(spark.createDataFrame([("/a", "a", "3", at(1)), ("/b", "b", "4", None)], "path string, project_name string, version string, last_scanned timestamp_ntz"))
    store.upsert_projects(spark.createDataFrame([("/a", "a", "both", at(2))], "path string, project_name string, version string, last_scanned timestamp_ntz"))
    rows = {r.path: r for r in store.list_projects().collect()}
    assert list(rows) == ["/a", "/b"] and rows["/a"].version == "both" and {r.project_id for r in rows.values()} == {1, 2}
    store.upsert_blocks(spark.createDataFrame([(1, "mod_x")], "project_id long, block_name string"))
    for d in (3, 4):
        store.append("validations", spark.createDataFrame([(1, at(d), True)], "block_id long, run_at timestamp_ntz, hard_fail boolean"))
        store.append("issues", spark.createDataFrame([(1, 1, at(d), "warning", f"d{d}", False)], "project_id long, block_id long, detected_at timestamp_ntz, severity string, description string, resolved boolean"))
    assert [r.description for r in store.list_issues().collect()] == ["d4", "d3"] and len({r.issue_id for r in store.read("issues").collect()}) == 2
    assert store.purge(dry_run=True) == {"validations": 1, "issues": 1} and store.read("issues").count() == 2
    assert store.purge() == {"validations": 1, "issues": 1} and [r.description for r in store.read("issues").collect()] == ["d4"]
    last = store.read("issues").first().issue_id
    assert store.resolve(last, "seen") and store.read("issues").first().description == "d4 | seen" and store.count_issues() == 0 and store.count_issues(open_only=False) == 1
    assert store.status().first().projects == 2


def test_discovery_and_scan_run(spark, tmp_path):
    def put(name, text):
        p = tmp_path / "src" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())

    put("dist/gr-one/CMakeLists.txt", "find_package(Gnuradio)")
    put("dist/gr-one/README.md", b"Supports DMR, NBFM and M17 \xff\xfe")
    put("gr-two/CMakeLists.txt", "project(x) # names gnuradio only")
    put("gr-three/include/gnuradio-4.0/three/x.hpp", "#pragma once")
    put("gr-three/README.md", "for GNU Radio 3.10 too")
    put("gr-four/CMakeLists.txt", "gr_register_component(x)")
    put("gr-four/.git/HEAD", "ref: refs/heads/gnuradio4")
    put("gr-five/grc/five.block.yml", "id: five")
    put("gr-six/CMakeLists.txt", "include(gr_modtool)")
    put("build/gr-seven/CMakeLists.txt", "find_package(gnuradio)")
    root = str(tmp_path / "src")
    got = {r.project: r.version for r in projects.discover(projects.listing(spark, root), root).collect()}
    assert got == {"gr-one": "3", "gr-three": "both", "gr-four": "both", "gr-five": "3", "gr-six": "3"}

    store = AuditStore(spark, f"file://{tmp_path}/audit")
    engine = Engine(spark)
    for n in (1, 2):
        out = {r.project: r.report for r in engine.scan_run(root, store, f"2026-01-0{n}T00:00:00Z", None).collect()}
        assert set(out) == {"gr-one"} and "mod_dmr" in out["gr-one"] and "Overall: HARD FAIL" in out["gr-one"]
    assert store.read("projects").count() == 5 and store.read("projects").filter("last_scanned >= '2026-01-02'").count() == 5
    assert store.read("blocks").count() >= 2 and store.read("validations").count() >= 2
    issues = store.read("issues")
    assert issues.filter("not resolved and detected_at < '2026-01-02'").isEmpty() and not issues.filter("not resolved").isEmpty()


def test_generator_checks_ask_for_tones():
    plain = waveforms.fm(np.sin(2 * np.pi * 100 * np.arange(8192) / 48000), 2500.0, 48000.0)
    assert "tones" in waveforms.check("BELL202", plain, 48000.0)
    assert all("tone" not in waveforms.check(n, waveforms.clean(n, waveforms.generator(42, n, 0, 0)), 48000.0) for n in ("NFM_CTCSS", "NFM_DCS"))


def test_a_wide_carrier_fails_the_plugin():
    rng = np.random.default_rng(3)
    x = waveforms.eight_carriers(64 * 1024, rng)
    got = plugins.EightCarriers().validate(x, 48000.0, {})
    wide = plugins.EightCarriers().validate(waveforms.eight_carriers(64 * 1024, rng, baud=300.0), 48000.0, {})
    assert len(got["carrier_widths"]) == got["carrier_count"] and not wide["pass_overall"] and "width out of bounds" in wide["notes"]


def test_commands(capsys):
    assert cli.main(["dataset-download"]) == 2 and "not part" in capsys.readouterr().err
    known = cli.parser()._subparsers._group_actions[0].choices
    assert len(known) >= 27 and cli.parser().parse_args(["scan-resolve", "3", "--note", "x"]).note == "x"
