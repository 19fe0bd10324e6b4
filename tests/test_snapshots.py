"""Snapshots: readers keep their version, a dead writer leaves nothing, two writers never mix, batches count once."""

import pytest
from pyspark.sql import functions as F

from threadspark.sources import snapshots

SCHEMA = "k int, v string, at int"


def put(spark, path, *rows, **more):
    return snapshots.upsert_table(spark, path, spark.createDataFrame(list(rows), SCHEMA), ["k"], F.col("at"), buckets=4, **more)


def values(df):
    return {row["k"]: row["v"] for row in df.collect()}


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        snapshots.read_table(spark, path)
    assert put(spark, path, (1, "a", 1), (2, "b", 1)) == 1
    old = snapshots.read_table(spark, path)
    assert put(spark, path, (2, "c", 2), (3, "d", 1), (1, "older", 0)) == 2
    assert values(old) == {1: "a", 2: "b"} == values(snapshots.read_table(spark, path, 1))
    assert values(snapshots.read_table(spark, path)) == {1: "a", 2: "c", 3: "d"}
    assert put(spark, path) == 3 and values(snapshots.read_table(spark, path)) == {1: "a", 2: "c", 3: "d"}


def test_a_dead_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    put(spark, path, (1, "a", 1))
    with monkeypatch.context() as patch:
        patch.setattr(snapshots._Files, "publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            put(spark, path, (1, "lost", 9))
    assert snapshots.versions(spark, path) == [1] and values(snapshots.read_table(spark, path)) == {1: "a"}
    put(spark, path, (1, "kept", 2))
    assert values(snapshots.read_table(spark, path)) == {1: "kept"}
    snapshots.vacuum(spark, path, keep=1)
    assert snapshots.versions(spark, path) == [2] and values(snapshots.read_table(spark, path)) == {1: "kept"}
    assert len(snapshots._Files(spark, path).names("data")) == 1


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    path, publish, met = str(tmp_path / "table"), snapshots._Files.publish, []
    put(spark, path, (1, "a", 1))

    def late(self, text, folder, name):
        if not met:  # another writer commits the same version first
            met.append(name)
            with monkeypatch.context() as patch:
                patch.setattr(snapshots._Files, "publish", publish)
                put(spark, path, (2, "other", 1))
        publish(self, text, folder, name)

    monkeypatch.setattr(snapshots._Files, "publish", late)
    assert put(spark, path, (3, "mine", 1)) == 3 and met == ["000000000002.json"]
    assert values(snapshots.read_table(spark, path)) == {1: "a", 2: "other", 3: "mine"}
    with pytest.raises(snapshots.Conflict):
        snapshots._Files(spark, path).publish("{}", "manifest", "000000000003.json")


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "table")
    assert put(spark, path, (1, "a", 1), batch=("s", 0)) == 1
    assert put(spark, path, (1, "again", 1), batch=("s", 0)) == 1
    assert values(snapshots.read_table(spark, path)) == {1: "a"}
    assert put(spark, path, (1, "b", 1), batch=("s", 1)) == 2 and put(spark, path, (2, "c", 1), batch=("other", 0)) == 3
    assert values(snapshots.read_table(spark, path)) == {1: "b", 2: "c"}
