"""Operators on small inputs: votes, store, signals, captures, plugin, generators, scan."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake import cli, vocab
from wavelake.facade import Engine
from wavelake.functions import dsp, waveforms
from wavelake.operators import audit, judging, plugins, projects, scoring, textmine, training
from wavelake.sources import archives, iq


def test_vote_takes_the_label_seen_first(spark):
    rows = [("a", 0, "QPSK", 0.9), ("a", 1, "AM", 0.2), ("a", 2, "AM", 0.4), ("a", 3, "QPSK", 0.5), ("b", 0, "FM", 1.0)]
    got = judging.majority_vote(spark.createDataFrame(rows, "f string, k int, l string, c double"), ["f"], "l", "c", "k").collect()
    by = {r.f: r for r in got}
    assert by["a"].l == "QPSK" and by["a"].c == pytest.approx(0.7) and by["a"].n_chunks == 4 and by["b"].votes == 1


def test_vote_does_not_depend_on_partitions(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("f"), F.col("id").alias("k"), F.concat(F.lit("l"), (F.col("id") * 13 % 5).cast("string")).alias("l"), (F.col("id") % 10 / 10).alias("c"))
    one, many = (judging.majority_vote(rows.repartition(n), ["f"], "l", "c", "k").orderBy("f").select("f", "l", "votes").collect() for n in (1, 8))
    assert one == many


@pytest.mark.parametrize("expected,predicted,ok", [("GMSK", "NXDN", True), ("NXDN", "GMSK", False), ("CPFSK", "GFSK", True), ("QPSK", "qpsk", False), ("QPSK", "QPSK", True)])
def test_order_aliases(spark, expected, predicted, ok):
    assert judging.order_match(spark.createDataFrame([(expected, predicted)], "e string, p string"), "e", "p", "ok").first().ok is ok


@pytest.mark.parametrize("order,predicted,ok", [("AM-SSB", "qam", True), ("AM-SSB", "PSK", False), ("AM-DSB", "AM", True), ("AM-DSB", "FM", False)])
def test_families_of_single_sideband(spark, order, predicted, ok):
    assert spark.range(1).select(judging.family_match(F.lit(" am"), F.lit(order), F.lit(predicted))).first()[0] is ok


def test_run_of_nothing_is_a_failure(spark):
    none = spark.createDataFrame([], "family_pass boolean, order_pass boolean, hard_fail boolean")
    assert judging.run_code(none).first().code == 1 and judging.summary(none).first().pass_rate == 0.0


def test_purge_keeps_ties_and_projects_without_scans(spark):
    ts = lambda x: F.col(x).cast("timestamp_ntz")
    v = spark.createDataFrame([(1, 1, "2026-01-01"), (2, 1, "2026-01-05"), (3, 1, "2026-01-05"), (4, 2, "2026-01-03"), (5, None, "2026-01-02")], "validation_id int, block_id long, run_at string").withColumn("run_at", ts("run_at"))
    assert {r.validation_id for r in audit.purged_validations(v).collect()} == {2, 3, 4}
    blocks = spark.createDataFrame([(1, 10), (2, 10)], "block_id long, project_id long")
    projects_ = spark.createDataFrame([(10, "2026-02-01"), (11, "2026-01-04"), (12, None)], "project_id long, last_scanned string").withColumn("last_scanned", ts("last_scanned"))
    i = spark.createDataFrame([(1, 10, "2026-01-02"), (2, 10, "2026-01-04"), (3, 11, "2026-01-03"), (4, 12, "2026-01-01"), (5, None, "2020-01-01")], "issue_id int, project_id long, detected_at string").withColumn("detected_at", ts("detected_at"))
    assert {r.issue_id for r in audit.purged_issues(i, v, blocks, projects_).filter("stale").collect()} == {1, 3}


def test_upsert_keeps_ids_and_names(spark):
    old = spark.createDataFrame([(1, "a", "A", "x"), (2, "b", "B", "y")], "id long, path string, name string, v string")
    new = spark.createDataFrame([("b", "other", "z"), ("c", "C", "w")], "path string, name string, v string")
    assert sorted(map(tuple, audit.upserted(old, new, ["path"], "id", ["name"]).collect())) == [(1, "a", "A", "x"), (2, "b", "B", "z"), (3, "c", "C", "w")]


def test_split_by_blocks_equals_one_sort(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("s"))
    a, b = (training.stratified_split(rows, ["s"], "k", block=n).orderBy("k").select("k", "part").collect() for n in (7, 1 << 20))
    assert a == b
    n = training.stratified_split(rows.filter("s = 0"), ["s"], "k", block=50).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in n} == {"train": 233, "val": 50, "test": 51}


def test_snr_edges(spark):
    got = spark.createDataFrame([(x,) for x in (-20.5, -20.0, 0.0, 19.9, 20.0)], "x double").select(training.snr_bin(F.col("x"))).collect()
    assert [r[0] for r in got] == [0, 1, 3, 4, 5]


def test_modes_in_text(spark):
    text = "Supports NBFM, D Star and fx.25; I am here. 8 x carrier"
    assert spark.createDataFrame([(text,)], "t string").select(textmine.modes(F.col("t"))).first()[0] == ["AM", "D-Star", "FX.25", "NBFM", "sleipnir_8qpsk"]


def test_halves_of_a_size_go_to_the_even_digit(spark, tmp_path):
    import duckdb

    from wavelake.plans import texts  # noqa: F401
    from wavelake.plans.base import ORACLES, QUERIES

    rows = [(955, 3328), (3876, 1280), (8755, 8448), (6, 1792), (12, 1023), (18, None), (None, 5), (24, 2**52 + 3), (30, round(4100.35 * 2**40)), (36, 2**62 + 12345), (42, 0)]
    spark.createDataFrame(rows, "doc_id long, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r["size"]) for r in QUERIES["size_format"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.execute(ORACLES["size_format"]).fetchall()) and {(955, "120.2 KB"), (3876, "1.2 KB"), (6, "1.8 KB")} < got


def test_digits_by_the_exact_value(spark):
    r = np.random.default_rng(7)
    xs = [k / 1000 for k in range(1000)] + (r.integers(0, 10**6, 500) / 1000).tolist() + (r.normal(size=200) * 1e9).tolist() + [0.125, 0.375, -0.125]
    for digits in (1, 2):
        got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", F.format_string(f"%.{digits}f", textmine.to_digits(F.col("x"), digits)).alias("s")).collect()
        assert [(r.x, r.s) for r in got] == [(x, f"{x:.{digits}f}") for x in xs]
    verdict = spark.createDataFrame([("AM", "AM-DSB", "AM", "AM-DSB", 0.285), ("AM", "AM-DSB", "AM", "AM-DSB", 0.125)], "expected_family string, expected_order string, predicted_family string, predicted_order string, family_confidence double")
    assert {r.reason for r in judging.verdicts(verdict).collect()} == {f"Family confidence {x:.2f} below hard-fail threshold 0.4" for x in (0.285, 0.125)}


def test_exact_key_class_differs_from_substring(spark):
    d = spark.createDataFrame([("32FSK",)], "k string")
    assert d.select(textmine.key_class(F.col("k"))).first()[0] == "2FSK" and d.select(textmine.key_class(F.col("k"), True)).first()[0] == "32FSK"


def test_filters_and_resampling():
    t = np.arange(4096) / 48_000
    tone = lambda f: np.sin(2 * np.pi * f * t)[None]
    band = dsp.butterworth(4, 300.0, 3000.0, 48_000.0)
    gain = lambda f: np.abs(dsp.sections(band, tone(f))[0, 2048:]).max()
    assert gain(1000) == pytest.approx(1.0, abs=0.02) and gain(50) < 0.01 and gain(12_000) < 0.01
    low = dsp.butterworth(6, None, 3000.0, 48_000.0)
    assert np.abs(dsp.sections(low, tone(500))[0, 2048:]).max() == pytest.approx(1.0, abs=0.02)
    x = np.cos(2 * np.pi * 3 * np.arange(128) / 128)[None]
    assert np.allclose(dsp.fourier_resample(x, 1024)[0], np.cos(2 * np.pi * 3 * np.arange(1024) / 1024))
    up = dsp.polyphase_up(np.sin(2 * np.pi * 5 * np.arange(256) / 256)[None], 6)[0]
    assert np.allclose(up[300:1200], np.sin(2 * np.pi * 5 * np.arange(1536) / 1536)[300:1200], atol=0.02)
    assert np.allclose(np.imag(dsp.analytic(x))[0], np.sin(2 * np.pi * 3 * np.arange(128) / 128), atol=1e-9)
    assert dsp.nrzi(np.array([1, 0, 0, 1, 0])).tolist() == [0, 1, 0, 0, 1]


def test_generators_pass_their_own_checks(spark):
    assert all(not r.failed for r in waveforms.verify(spark).collect())


def test_windows_depend_on_the_seed_alone(spark):
    one, many = (waveforms.grid(spark, ["DMR", "WBFM"], 3, [0, 30]).repartition(n).mapInPandas(waveforms._windows(7), waveforms.SCHEMA).orderBy("class", "snr_db", "number").collect() for n in (1, 5))
    assert one == many and len(one) == 12 and len(one[0].i) == 1024


def test_plugin_tells_eight_carriers_from_one(spark):
    from wavelake.plans import extra

    got = {r.path: r for r in extra.eight_carrier_plugin(spark, None).collect()}
    assert got["capture0"].carrier_count == 8 and got["capture0"].confidence > 0.65 and got["capture1"].carrier_count == 1 and not got["capture1"].pass_overall


def write(path, x):
    flat = np.empty(2 * len(x), "<f4")
    flat[0::2], flat[1::2] = x.real, x.imag
    path.write_bytes(flat.tobytes())


def test_validate_a_folder(spark, tmp_path):
    rng = np.random.default_rng(1)
    car = {"source": "r", "block_name": "b", "expected_family": "AM", "expected_order": "AM-DSB", "sample_rate_hz": 48000}
    write(tmp_path / "good.iq", rng.standard_normal(3072) + 1j * rng.standard_normal(3072))
    (tmp_path / "good.json").write_text(json.dumps(car))
    write(tmp_path / "short.iq", np.ones(1000) * 1j)
    write(tmp_path / "empty.iq", np.zeros(0, complex))
    (tmp_path / "empty.json").write_text(json.dumps(car))
    write(tmp_path / "alone.iq", np.ones(1024) * 1j)
    (tmp_path / "bad.json").write_text(json.dumps({k: v for k, v in car.items() if k != "source"}))
    write(tmp_path / "eight.iq", waveforms.eight_carriers(24 * 1024, rng))
    (tmp_path / "eight.json").write_text(json.dumps(car | {"expected_family": "custom", "expected_order": "sleipnir_8qpsk"}))
    e = Engine(spark)
    rows = {(r.path or "").rpartition("/")[2]: r for r in e.validate(f"file://{tmp_path}").collect()}
    assert rows["good.iq"].family_pass and rows["good.iq"].hard_fail and "below" in rows["good.iq"].reason
    assert rows["short.iq"].error.startswith("1000") and rows["empty"].error == "no chunks" and rows["bad"].error == "missing field source"
    assert "alone.iq" not in rows and rows["eight.iq"].predicted_order == "sleipnir_8qpsk"
    assert e.exit_code(e.validate(f"file://{tmp_path}")) == 2
    assert iq.read_captures(spark, f"file://{tmp_path}", max_bytes=100).filter("error = 'file too large'").count() == 4


def test_sigmf_type_decides_on_odd_values(spark, tmp_path):
    (tmp_path / "x.sigmf-data").write_bytes(np.ones(2049, "<f4").tobytes())
    read = lambda: iq.read_captures(spark, f"file://{tmp_path}", "*.sigmf-data").collect()
    (tmp_path / "x.sigmf-meta").write_text(json.dumps({"global": {"core:datatype": "ri16"}}))
    assert read()[0].error is not None
    (tmp_path / "x.sigmf-meta").write_text(json.dumps({"global": {"core:datatype": "cf32_le"}}))
    assert len(read()) == 1 and read()[0].error is None


def test_archives(spark, tmp_path):
    import pickle

    rng = np.random.default_rng(0)
    data = {("BPSK", 0): rng.standard_normal((3, 2, 128)), ("WBFM", 10): rng.standard_normal((2, 2, 128))}
    (tmp_path / "a.pkl").write_bytes(pickle.dumps(data))
    archives.register(spark)
    rows = spark.read.format("pickled").option("trust", "true").load(f"{tmp_path}/a.pkl").collect()
    assert len(rows) == 5 and all(len(r.i) == 1024 for r in rows)
    assert np.mean(np.square(rows[0].i) + np.square(rows[0].q)) == pytest.approx(1.0, abs=1e-4)
    with pytest.raises(Exception, match="trust"):
        spark.read.format("pickled").load(f"{tmp_path}/a.pkl").collect()
    np.savez(tmp_path / "b.npz", samples=rng.standard_normal((4, 2, 1024)).astype("f4"), labels=np.array([0, 1, 1, 0]), snr_db=np.array([0, 1, 2, 3], "f4"), class_names=np.array(["x", "y"]))
    got = spark.read.format("npz").load(f"{tmp_path}/b.npz").collect()
    assert sorted((r["class"], r.snr_db) for r in got) == [("x", 0.0), ("x", 3.0), ("y", 1.0), ("y", 2.0)]


def test_scan_finds_the_shallowest_project(spark, tmp_path):
    for p, text in {"gr-one/CMakeLists.txt": "find_package(Gnuradio)", "gr-one/README.md": "NBFM, DSSS and 8xQPSK", "gr-one/sub/CMakeLists.txt": "find_package(Gnuradio)", "gr-one/build/CMakeLists.txt": "gnuradio", "other/CMakeLists.txt": "project(x)", "gr-opus/grc/a.block.yml": "id: a"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    found = projects.discover(projects.listing(spark, f"file://{tmp_path}"), str(tmp_path)).collect()
    assert [r.project for r in found] == ["gr-one"]
    rows = {r["mode"]: r for r in projects.plan(projects.discover(projects.listing(spark, f"file://{tmp_path}"), str(tmp_path))).collect()}
    assert rows["DSSS"].skip_reason and rows["NBFM"].snr_db == 20.0 and rows["sleipnir_8qpsk"].snr_db == 15.0


def test_scorers(spark):
    rows = spark.createDataFrame([([0.1, 3.0, 0.0, 0.0, 0.0, 0.0], [1.0, 0.0])], "family_logits array<double>, order_logits array<double>")
    r = scoring.from_columns(orders=["a", "b"])(rows).first()
    assert r.predicted_family == "FM" and r.predicted_order == "a" and 0.7 < r.family_confidence < 1
    assert scoring.constant(rows).first().predicted_family == "AM"


def test_ml_scorer_learns_synthetic_classes(spark):
    names = ["AM_AIR_25K", "BPSK", "NBFM_50"]
    x = waveforms.generate(spark, names, 12, [20, 24]).cache()
    rows = scoring.fit_ml(x, "class", names)(x, "pred", "conf").select("class", "pred").collect()
    assert np.mean([r["class"] == r.pred for r in rows]) > 0.9


def test_train_command_keeps_a_model(spark, tmp_path, capsys):
    x = waveforms.generate(spark, ["AM_AIR_25K", "BPSK", "NBFM_50"], 12, [20, 24])
    x.withColumn("source", F.lit("synthetic")).write.parquet(f"{tmp_path}/w")
    assert cli.main(["train", f"{tmp_path}/w", f"{tmp_path}/m"]) == 0
    parts = {r["part"]: r for r in map(json.loads, capsys.readouterr().out.splitlines())}
    assert set(parts) == {"train", "val", "test"} and parts["train"]["accuracy"] > 0.9 and sum(r["windows"] for r in parts.values()) == 72
    again = scoring.load_ml(f"{tmp_path}/m")
    assert again.names == ["AM", "FM", "PSK"] and again(x, "pred", "conf").filter("pred in ('AM', 'FM', 'PSK') and conf > 0.3").count() == 72


def test_plugin_registry():
    assert plugins.registered() == ["sleipnir_8qpsk"] and plugins.get("x") is None


def test_vocabulary_sizes():
    assert len(vocab.ORDERS) == 50 and len(vocab.MODES) == 35 and len(vocab.HISARMOD_ORDER) == 26


def test_roundtrip_of_labels_above_the_file_limit(spark, tmp_path, monkeypatch):
    from functools import partial

    from wavelake.plans import extra

    rows = [(i, [1.0] * 64, i % 5 // 4) for i in range(500)] + [(-1, [1.0] * 64, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(extra, "CAPTURE_VECS", 64, raising=False)
    monkeypatch.setattr(extra.iq, "read_captures", partial(extra.iq.read_captures, max_bytes=64 * 256))
    got = {tuple(r) for r in extra.iq_file_roundtrip(spark, str(tmp_path)).collect()}
    assert got == {("label0", 400, 1.0, None), ("label1", 100, 1.0, None), ("None", 1, 1.0, None)}
