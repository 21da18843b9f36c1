"""Tables that change together: a stop after each step shows the old version or the new one."""

import pytest
from concordat.sources.snapshots import Conflict, Snapshots
from pyspark.sql import functions as F


def both(store, version=None):
    """What a reader sees: the two tables' markers."""
    kept = store.manifest(version)
    return tuple(sorted({r.v for r in store.read(n, kept["version"]).collect()}) if n in kept["tables"] else None for n in ("scores", "evidence"))


def tables(spark, v, n=3):
    one = lambda k: spark.range(n).withColumn("v", F.lit(v)).withColumn("name", F.lit(k))
    return {k: one(k) for k in ("scores", "evidence")}


def test_versions(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/s")
    assert store.latest() == 0 and both(store) == (None, None)
    assert store.commit(tables(spark, 1), command="first") == 1 and store.manifest()["metadata"] == {"command": "first"}
    pinned = store.read("scores")
    assert store.commit({"scores": tables(spark, 2)["scores"]}) == 2
    assert both(store) == ([2], [1]) and both(store, 1) == ([1], [1]) and {r.v for r in pinned.collect()} == {1}
    assert store.commit({"evidence": None}) == 3 and both(store) == ([2], None)
    assert store.read("scores").dtypes == tables(spark, 1)["scores"].dtypes
    empty = store.commit({"scores": tables(spark, 5)["scores"].limit(0)})
    assert store.read("scores", empty).count() == 0 and store.versions() == [1, 2, 3, 4]
    assert len(store.vacuum(keep=2)) == 2 and store.versions() == [3, 4] and both(store, 3) == ([2], None)


@pytest.mark.parametrize("step", ["write", "second write", "draft", "rename"])
def test_a_stop_at_any_step_leaves_the_old_version(spark, tmp_path, step, monkeypatch):
    store = Snapshots(spark, str(tmp_path / "s"))
    store.commit(tables(spark, 1))
    new = tables(spark, 2)

    class Stop(Exception):
        pass

    def stop(*_, **__):
        raise Stop

    writer = type(new["scores"].write)
    real, calls = writer.parquet, []
    with monkeypatch.context() as m:
        if step == "write":
            m.setattr(writer, "parquet", stop)
        elif step == "second write":
            m.setattr(writer, "parquet", lambda self, path, *a, **b: stop() if calls else (calls.append(path), real(self, path, *a, **b))[1])
        elif step == "draft":
            m.setattr(store, "publish", stop)
        else:
            m.setattr(store, "_jvm", type("Jvm", (), {"__getattr__": lambda self, name: stop()})())
        with pytest.raises(Stop):
            store.commit(new)
    again = Snapshots(spark, str(tmp_path / "s"))
    assert both(again) == ([1], [1]) and again.latest() == 1
    assert again.commit(new) == 2 and both(again) == ([2], [2])
    again.vacuum()
    assert both(again) == ([2], [2])


def test_two_writers(spark, tmp_path):
    first, second = (Snapshots(spark, str(tmp_path / "s")) for _ in range(2))
    first.commit(tables(spark, 1))
    base = second.latest()
    staged = second.stage(tables(spark, 3))
    first.commit(tables(spark, 2))
    with pytest.raises(Conflict):
        second.publish(staged, base)
    assert both(second) == ([2], [2]) and second.publish(staged, second.latest()) == 3 and both(first) == ([3], [3])
