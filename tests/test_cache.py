"""The shard cache: names, cleaning, round trip, checks and rebuilds."""

import pytest

from wavelake import cli
from wavelake.sources import cache

SCHEMA = "label int, i array<float>, snr float"
V = "abc12345"


def rows(spark, *keys, n=3):
    return spark.createDataFrame([("radioml", k, j, [float(j)], 1.5) for k in keys for j in range(n)], f"source string, key string, {SCHEMA}")


def shards(spark, *keys):
    return spark.createDataFrame([("radioml", k) for k in keys], cache.SHARD)


def content(frame):
    return sorted((r.key, r.label, tuple(r.i), r.snr) for r in frame.collect())


def put(path, text=b"x" * 20):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text)


def test_names_have_the_version():
    path = cache.shard_path("/c", "radioml2016", "set a/1", V)
    assert path == f"/c/radioml2016/set_a_1_{V}.shard" and cache.is_current(path, V) and not cache.is_current(path, "00000000")
    assert cache.is_current(f"x_{V}.npy.npz", V) and not cache.is_current("shard_old.npy.npz", V) and not cache.is_current("x_.shard", "")
    assert cache.version_of(put) != cache.version_of(rows) and len(cache.VERSION) == 8


def test_clean_touches_shards_of_other_versions_only(spark, tmp_path, capsys):
    foreign = [tmp_path / p for p in ("notes.txt", "sub/capture.iq", ".git/HEAD", ".git/objects/x.npz", "empty.bin", "odd.shard")]
    for p in foreign:
        put(p, b"")
    old = [tmp_path / p for p in ("radioml/old.npy.npz", "radioml/legacy.npy", "other/x_0badc0de.shard/part-0.parquet")]
    new = [tmp_path / p for p in (f"radioml/new_{V}.npy.npz", f"radioml/k_{V}.shard/part-0.parquet")]
    for p in old + new:
        put(p)
    assert cache.clean(spark, str(tmp_path), V, dry_run=True) == (3, 2) and all(p.exists() for p in old + new + foreign)
    assert cli.main(["cache-clean", str(tmp_path), "--version", V, "--dry-run"]) == 0 and "removed=3 kept=2" in capsys.readouterr().out
    assert cache.clean(spark, str(tmp_path), V) == (3, 2) and not any(p.exists() for p in old) and all(p.exists() for p in new + foreign)
    assert cache.clean(spark, str(tmp_path), V) == (0, 2) and cache.clean(spark, f"{tmp_path}/none", V) == (0, 0)
    with pytest.raises(ValueError, match="version"):
        cache.clean(spark, str(tmp_path), "")


def test_load_builds_what_is_missing_once(spark, tmp_path):
    held, built = cache.ShardCache(spark, f"file://{tmp_path}/c", SCHEMA, V), []

    def build(todo):
        keys = sorted(r.key for r in todo.collect())
        built.append(keys)
        return rows(spark, *[k for k in keys if k != "none"])

    want = content(rows(spark, "a", "b/1"))
    assert content(held.load(shards(spark, "a", "b/1", "none"), build)) == want
    assert content(held.load(shards(spark, "a", "b/1", "none"), build)) == want and built == [["a", "b/1", "none"]]
    assert content(held.load(shards(spark, "a", "c"), build)) == content(rows(spark, "a", "c")) and built[1:] == [["c"]]
    newer = cache.ShardCache(spark, f"file://{tmp_path}/c", SCHEMA, "0badc0de")
    assert {r.state for r in newer.state(shards(spark, "a", "c")).collect()} == {"missing"}
    assert held.load(shards(spark, "a").limit(0), build).count() == 0


@pytest.mark.parametrize("harm", ["garbage", "gone", "other rows"])
def test_a_broken_shard_is_rebuilt_alone(spark, tmp_path, harm):
    held, built = cache.ShardCache(spark, f"file://{tmp_path}/c", SCHEMA, V), []

    def build(todo):
        built.append(sorted(r.key for r in todo.collect()))
        return rows(spark, *built[-1])

    held.load(shards(spark, "a", "b"), build)
    shard = tmp_path / "c" / "radioml" / f"a_{V}.shard"
    for f in shard.glob("*.parquet"):
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
        if harm == "garbage":
            f.write_bytes(b"not parquet at all")
        else:
            f.unlink()
    if harm == "other rows":
        rows(spark, "a", n=2).coalesce(1).write.mode("append").parquet(f"file://{shard}")
    spark.catalog.refreshByPath(f"file://{tmp_path}/c")
    assert {r.key: r.state for r in held.state(shards(spark, "a", "b")).collect()} == {"a": "missing" if harm != "other rows" else "corrupt", "b": "current"} or harm == "garbage"
    assert content(held.load(shards(spark, "a", "b"), build)) == content(rows(spark, "a", "b")) and built == [["a", "b"], ["a"]]
