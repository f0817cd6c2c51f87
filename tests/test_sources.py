"""Manifest, archives by rows and rejected files."""

import hashlib
import io
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake import cli
from wavelake.facade import Engine
from wavelake.operators import projects
from wavelake.sources import archives, iq
from wavelake.sources.manifest import Manifest


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_manifest_opens_changed_files_only(spark, tmp_path):
    data = tmp_path / "data"
    for name, text in (("radioml/a.pkl", b"one"), ("cspb/Batch_Dir_1/signal_1.tim", b"two"), ("cspb/signal_record.txt", b"t"), ("cspb/readme.md", b"no")):
        put(data / name, text)
    held = Manifest(spark, f"file://{tmp_path}/manifest")
    files = lambda: projects.listing(spark, str(data)).drop("content")
    assert held.refresh(files()) == 3 and held.refresh(files()) == 0
    first = {r.name: r for r in held.read().collect()}
    assert {(r.dataset, r.name) for r in first.values()} == {("radioml", "a.pkl"), ("cspb", "signal_1.tim"), ("cspb", "signal_record.txt")}
    # Other bytes of the same length and time: a refresh that read the file would see them.
    pkl, stat = data / "radioml/a.pkl", (data / "radioml/a.pkl").stat()
    pkl.write_bytes(b"six")
    os.utime(pkl, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    put(data / "cspb/Batch_Dir_1/signal_1.tim", b"longer")
    (data / "cspb/signal_record.txt").unlink()
    put(data / "hisarmod/x.h5", b"h")
    assert held.refresh(files(), "hisarmod") == 1 and held.read().count() == 4
    assert held.refresh(files()) == 2
    now = {r.name: r for r in held.read().collect()}
    assert set(now) == {"a.pkl", "signal_1.tim", "x.h5"} and now["a.pkl"].sha == first["a.pkl"].sha
    assert now["signal_1.tim"].sha != first["signal_1.tim"].sha and now["signal_1.tim"].file_id == first["signal_1.tim"].file_id
    pkl.unlink()  # status and expected digests need no file
    (data / "cspb/Batch_Dir_1/signal_1.tim").unlink()
    primary = spark.createDataFrame([("radioml", "a.pkl")], "dataset string, name string")
    got = {r.dataset: (r.files, r.batches, r.checksum) for r in held.status(primary).collect()}
    assert got["radioml"] == (1, 0, now["a.pkl"].sha[:16]) and got["cspb"][:2] == (1, 1)
    releases = spark.createDataFrame([("radioml", "a.pkl", "a" * 64), ("radioml", "b.tar.bz2", "B" * 64), ("cspb", "z.zip", "UNVERIFIED")], "dataset string, name string, sha string")
    want = {(r.dataset, r.name): r.sha for r in held.expected(releases).collect()}
    assert want["radioml", "a.pkl"] == now["a.pkl"].sha and want["radioml", "b.tar.bz2"] == "b" * 64 and ("cspb", "z.zip") not in want


def windows(n):
    rng = np.random.default_rng(1)
    return {"samples": rng.standard_normal((n, 2, 1024)).astype("f4"), "labels": rng.integers(0, 3, n).astype("i4"), "snr_db": np.arange(n).astype("f4"), "class_names": np.array(["x", "y", "z"])}


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
@pytest.mark.parametrize("n", [0, 1, 50])
def test_archives_are_read_by_rows(spark, tmp_path, save, n):
    archives.register(spark)
    data = windows(n)
    save(tmp_path / "a.npz", **data)
    frame = spark.read.format("npz").option("bytesPerPartition", str(20 * 8192)).load(f"{tmp_path}/a.npz")
    got = sorted(frame.collect(), key=lambda r: r.chunk_idx)
    assert [r.chunk_idx for r in got] == list(range(n)) and [r["class"] for r in got] == [str(data["class_names"][k]) for k in data["labels"]]
    assert [r.snr_db for r in got] == data["snr_db"].tolist()
    for r, x in zip(got, data["samples"], strict=True):
        power = np.sqrt(np.mean((x.astype(float) ** 2).sum(axis=0)))
        np.testing.assert_allclose(np.stack([r.i, r.q]), x / power, rtol=1e-5)
    if n == 50:
        assert frame.select(F.spark_partition_id()).distinct().count() == (3 if save is np.savez else 1)


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_a_task_reads_the_bytes_of_its_rows(tmp_path, monkeypatch):
    np.savez(tmp_path / "a.npz", **windows(400))
    raw = (tmp_path / "a.npz").read_bytes()
    opened = []
    monkeypatch.setattr(archives, "_open", lambda path: opened.append(Counted(raw)) or opened[-1])
    reader = archives.NpzReader({"path": "a.npz", "bytesPerPartition": str(40 * 8192)})
    parts = reader.partitions()
    planned = opened[-1].taken
    rows = sum(b.num_rows for b in reader.read(parts[3]))
    assert len(parts) == 10 and rows == 40 and planned < 20_000 and opened[-1].taken < 40 * 8192 + 20_000 < len(raw) / 5


def test_archives_whose_arrays_do_not_fit(tmp_path):
    np.savez(tmp_path / "a.npz", **{**windows(4), "labels": np.zeros(3, "i4")})
    with pytest.raises(ValueError, match="differ in length"):
        archives.NpzReader({"path": f"{tmp_path}/a.npz"}).partitions()
    with zipfile.ZipFile(tmp_path / "b.npz", "w") as z:
        z.writestr("labels.npy", b"")
    with pytest.raises(KeyError):
        archives.NpzReader({"path": f"{tmp_path}/b.npz"}).partitions()


def test_rejected_files_are_kept_with_reasons(spark, tmp_path):
    good = np.random.default_rng(1).standard_normal(2 * 1024 * 6).astype("<f4").tobytes()
    for name, data in (("signal_1.tim", good), ("signal_2.tim", b"\0" * 40), ("Batch_Dir_1/signal_3.tim", good), ("signal_x.tim", good), ("signal_9.tim", good)):
        put(tmp_path / "cspb" / name, data)
    put(tmp_path / "cspb/signal_record.txt", b"1 bpsk 2 0 0 0 0 0 0 0.0\n2 qpsk 2 0 0 0 0 0 0 0.0\n3 qpsk 2 0 0 0 0 0 0 0.0\n")
    kept, rejected = Engine(spark).signals(str(tmp_path / "cspb"), f"file://{tmp_path}/out")
    assert {(r.idx, r.n) for r in kept.groupBy("idx").agg(F.count("*").alias("n")).collect()} == {(1, 4), (3, 4)} and "rejected" not in kept.columns
    assert {r.path.rsplit("/", 1)[1]: r.error for r in rejected.collect()} == {"signal_2.tim": "no chunks", "signal_x.tim": "no number in the name", "signal_9.tim": "no entry in the truth file"}
    assert {r.reason: r.files for r in iq.rejections(rejected).collect()} == {"no chunks": 1, "no number in the name": 1, "no entry in the truth file": 1}
    assert iq.read_signals(spark, str(tmp_path / "cspb"), str(tmp_path / "cspb/signal_record.txt")).count() == 8
    with pytest.raises(FileNotFoundError, match="truth"):
        Engine(spark).signals(str(tmp_path / "out"), f"file://{tmp_path}/out2")


def test_status_shows_digests_of_the_manifest(spark, tmp_path, capsys):
    root = tmp_path / "data"
    put(root / "radioml/RML2016.10a_dict.pkl", b"one")
    put(root / "radioml/a.pkl", b"two")
    assert cli.main(["dataset-status", str(root)]) == 0 and '"checksum":"UNVERIFIED"' in capsys.readouterr().out
    assert cli.main(["dataset-checksum-update", str(root), f"file://{tmp_path}/sums"]) == 0 and "changed=2" in capsys.readouterr().out
    assert cli.main(["dataset-status", str(root)]) == 0 and hashlib.sha256(b"one").hexdigest()[:16] in capsys.readouterr().out
