"""The audit store's log: what a change writes, snapshots, writers at one time, compaction; the report."""

import datetime as dt
import threading

from pyspark.sql import functions as F

from wavelake import cli, store as store_module
from wavelake.store import AuditStore, Entry

ISSUES = "project_id long, block_id long, detected_at timestamp_ntz, severity string, description string, resolved boolean"


def at(day):
    return dt.datetime(2026, 1, day)


def issues(spark, *names):
    return spark.createDataFrame([(1, k, at(3), "warning", n, False) for k, n in enumerate(names)], ISSUES)


def folders(tmp_path, name="issues"):
    return {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in (tmp_path / "audit" / name / "data").iterdir()}


def test_a_change_writes_its_own_rows_only(spark, tmp_path):
    store = AuditStore(spark, f"file://{tmp_path}/audit")
    for n in range(3):
        store.append("issues", issues(spark, f"a{n}", f"b{n}"))
    before = folders(tmp_path)
    assert len(before) == 3 and [e.rows for e in store.snapshot("issues")[1]] == [2, 2, 2]
    ids = [r.issue_id for r in store.read("issues").collect()]
    assert sorted(ids) == [1, 2, 3, 4, 5, 6]
    assert store.resolve(3, "seen") and not store.resolve(99)
    after = folders(tmp_path)
    assert {k: after[k] for k in before} == before and store.snapshot("issues")[1][-1].rows == 1
    rows = {r.issue_id: r for r in store.read("issues").collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6] and rows[3].resolved and rows[3].description.endswith(" | seen") and sum(r.resolved for r in rows.values()) == 1
    store.resolve(3, "twice")
    assert store.read("issues").filter("issue_id = 3").first().description.endswith(" | seen | twice")
    store.append("issues", issues(spark).limit(0))
    assert len(store.snapshot("issues")[1]) == 5  # an empty append leaves no entry


def test_a_snapshot_stays_as_it_was(spark, tmp_path):
    store = AuditStore(spark, f"file://{tmp_path}/audit")
    store.append("issues", issues(spark, "a", "b"))
    held = store.snapshot("issues")
    store.append("issues", issues(spark, "c"))
    store.resolve(1)
    assert store.read("issues", held).count() == 2 and store.read("issues", held).filter("resolved").isEmpty()


def test_writers_at_one_time_lose_nothing(spark, tmp_path):
    store = AuditStore(spark, f"file://{tmp_path}/audit")
    store.append("issues", issues(spark, *"abcd"))
    work = [lambda n=n: store.append("issues", issues(spark, f"new{n}")) for n in range(3)] + [lambda n=n: store.resolve(n, f"by{n}") for n in (1, 2)] + [lambda: store.compact("issues")]
    threads = [threading.Thread(target=f) for f in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = {r.issue_id: r for r in store.read("issues").collect()}
    assert sorted(r.description for r in rows.values() if r.issue_id > 4) == ["new0", "new1", "new2"] and len(rows) == 7
    assert rows[1].description == "a | by1" and rows[2].description == "b | by2" and store.count_issues() == 5


def test_a_change_is_computed_anew_after_another(spark, tmp_path):
    store, other = (AuditStore(spark, f"file://{tmp_path}/audit") for _ in range(2))
    store.append("issues", issues(spark, "a"))
    seen = []

    def note(rows):
        seen.append(rows.first().description)
        if len(seen) == 1:
            other.resolve(1, "first")
        return rows.withColumn("description", F.concat("description", F.lit(" | second")))

    store.change("issues", note)
    assert seen == ["a", "a | first"] and store.read("issues").first().description == "a | first | second"


def test_compaction_and_vacuum(spark, tmp_path):
    store = AuditStore(spark, f"file://{tmp_path}/audit")
    store.compact("issues")
    assert store.vacuum("issues") == 0 and store.read("issues").count() == 0
    store.append("issues", issues(spark, *"abc"))
    store.resolve(2, "x")
    store.change("issues", lambda rows: rows.filter("issue_id = 3").withColumn("_gone", F.lit(True)))
    want = sorted(map(tuple, store.read("issues").collect()))
    store.compact("issues")
    assert sorted(map(tuple, store.read("issues").collect())) == want and [e.kind for e in store.snapshot("issues")[1]] == ["base"]
    assert store.vacuum("issues") == 3 and sorted(map(tuple, store.read("issues").collect())) == want
    store.append("issues", issues(spark, "d"))  # ids go on after those that were deleted
    assert sorted(r.issue_id for r in store.read("issues").collect()) == [1, 2, 4]


def test_an_entry_without_content_is_passed_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "WAIT", 0.1)
    store = AuditStore(spark, f"file://{tmp_path}/audit")
    store.append("issues", issues(spark, "a"))
    (tmp_path / "audit/issues/log/000000000002").write_text("")
    store.append("issues", issues(spark, "b"))
    assert sorted(r.description for r in store.read("issues").collect()) == ["a", "b"] and store.snapshot("issues")[0] == 3
    assert not store._claim("issues", 3, Entry("x", "insert"))


def test_upserts_write_what_is_new(spark, tmp_path):
    store = AuditStore(spark, f"file://{tmp_path}/audit")
    schema = "path string, project_name string, version string"
    store.upsert_projects(spark.createDataFrame([(f"/{x}", x, "3") for x in "abc"], schema))
    store.upsert_projects(spark.createDataFrame([("/b", "b", None), ("/d", "d", "4")], schema))
    assert store.snapshot("projects")[1][-1].rows == 2
    rows = {r.path: r for r in store.read("projects").collect()}
    assert len(rows) == 4 and len({r.project_id for r in rows.values()}) == 4 and rows["/b"].version == "3" and rows["/d"].version == "4"


def test_report_reads_the_newest_and_changes_nothing(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/audit"
    store = AuditStore(spark, root)
    store.upsert_projects(spark.createDataFrame([("/a", "gr-a"), ("/b", "gr-b")], "path string, project_name string"))
    ids = {r.project_name: r.project_id for r in store.read("projects").collect()}
    store.upsert_blocks(spark.createDataFrame([(ids["gr-a"], "mod_y", "FM", "NBFM"), (ids["gr-a"], "mod_x", "PSK", "QPSK"), (ids["gr-b"], "mod_x", "AM", "AM-DSB")], "project_id long, block_name string, expected_family string, expected_order string"))
    blocks = {(r.project_id, r.block_name): r.block_id for r in store.read("blocks").collect()}
    v = [(blocks[ids[p], b], at(d), f, True) for p, b, d, f in (("gr-a", "mod_x", 1, "AM"), ("gr-a", "mod_x", 2, "PSK"), ("gr-a", "mod_y", 1, "FM"), ("gr-b", "mod_x", 9, "AM"))]
    store.append("validations", spark.createDataFrame(v, "block_id long, run_at timestamp_ntz, predicted_family string, family_pass boolean"))
    assert [(r.block_name, r.predicted_family) for r in store.report("gr-a").collect()] == [("mod_x", "PSK"), ("mod_y", "FM")]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "audit").rglob("*")}
    assert cli.main(["--store", root, "scan-report", "gr-a"]) == 0 and '"predicted_family":"PSK"' in capsys.readouterr().out
    assert cli.main(["--store", root, "scan-report", "none"]) == 1 and "not in the store" in capsys.readouterr().err
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "audit").rglob("*")} == before
