"""Durable tables with snapshots: readers see one version, writers add the next one in a single step.

A table is a folder.  ``data`` holds Parquet files that never change once they are written; ``manifest`` holds one small
file per version that names the folders of every bucket.  An upsert writes the touched buckets to a new folder and then
moves the next manifest to its place; a move never replaces a file, so of two writers one has to start again, and a
writer that dies before the move leaves only files that no version names.  A reader keeps the version that it has read.
Batches of a stream carry their number: one that was committed before is left out.

The move must be atomic, as on HDFS and local disks.  A manifest is bounded by the number of buckets.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from threadspark.operators.ordinals import first_per_key


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


class _Files:
    """The few file operations of the driver, on whatever store the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.root = spark._jvm, spark.sparkContext._gateway, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path(self.root).getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def at(self, *names: str) -> str:
        return "/".join([self.root, *names])

    def names(self, folder: str) -> list[str]:
        where = self._path(self.at(folder) if folder else self.root)
        return [status.getPath().getName() for status in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def read(self, *names: str) -> str:
        stream = self.fs.open(self._path(self.at(*names)))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, text: str, folder: str, name: str) -> None:
        """Writes ``text`` aside and moves it to its name, which must not exist."""
        aside, target = self._path(self.at(folder, f".{name}-{uuid.uuid4().hex}")), self._path(self.at(folder, name))
        stream = self.fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(aside, target, options)
        except Exception as error:
            self.fs.delete(aside, False)
            if self.fs.exists(target):
                raise Conflict(name) from error
            raise

    def delete(self, *names: str) -> None:
        self.fs.delete(self._path(self.at(*names)), True)


def _number(name: str) -> int | None:
    head, _, tail = name.partition(".")
    return int(head) if tail == "json" and head.isdigit() else None


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(number for name in _Files(spark, path).names("manifest") if (number := _number(name)) is not None)


def _manifest(files: _Files, version: int) -> dict:
    return json.loads(files.read("manifest", f"{version:012d}.json"))


def _folders(spark: SparkSession, files: _Files, manifest: dict, buckets: list[str]) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    folders = [files.at(manifest["buckets"][bucket]) for bucket in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of ``version``; later commits do not change what has been read here."""
    files, known = _Files(spark, path), versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"{path} has no version {'' if version is None else version}".rstrip())
    manifest = _manifest(files, known[-1] if version is None else version)
    return _folders(spark, files, manifest, sorted(manifest["buckets"]))


def is_folder(spark: SparkSession, path: str) -> bool:
    return bool(_Files(spark, path).names(""))


def has_batch(spark: SparkSession, path: str, batch: tuple[str, int]) -> bool:
    """Whether the table holds this batch of a writer already."""
    known = versions(spark, path)
    return bool(known) and _manifest(_Files(spark, path), known[-1])["batches"].get(batch[0], -1) >= batch[1]


def upsert_table(
    spark: SparkSession, path: str, changes: DataFrame, keys: list[str], order: Column, buckets: int = 64, batch: tuple[str, int] | None = None, tries: int = 5
) -> int:
    """Merges ``changes`` by ``keys``, the largest ``order`` wins and ties go to the change; gives the version.

    ``batch``: the writer's name and its batch number, which only grows; a number seen before changes nothing.
    """
    for left in range(tries - 1, -1, -1):
        try:
            return _upsert(spark, path, changes, keys, order, buckets, batch)
        except Conflict:
            if not left:
                raise
    raise ValueError("tries must be positive")


def _upsert(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], order: Column, buckets: int, batch: tuple[str, int] | None) -> int:
    files, known = _Files(spark, path), versions(spark, path)
    current = _manifest(files, known[-1]) if known else {"version": 0, "buckets": {}, "batches": {}, "schema": changes.schema.jsonValue(), "count": buckets}
    if batch and current["batches"].get(batch[0], -1) >= batch[1]:
        return current["version"]
    bucket = F.pmod(F.hash(*keys), F.lit(current["count"]))
    marked = changes.select(*StructType.fromJson(current["schema"]).names).withColumn("_source", F.lit(1))
    # at most one row per bucket comes to the driver
    touched = [str(row[0]) for row in changes.select(bucket.alias("b")).distinct().toLocalIterator()]
    before = _folders(spark, files, current, [b for b in touched if b in current["buckets"]]).withColumn("_source", F.lit(0))
    merged = first_per_key(before.unionByName(marked), keys, F.struct(order, F.col("_source")), latest=True).drop("_source")
    folder = f"data/{uuid.uuid4().hex}"
    if touched:
        merged.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(files.at(folder))
    after = {**current["buckets"], **{b: f"{folder}/_bucket={b}" for b in touched}}
    version = current["version"] + 1
    batches = {**current["batches"], **({batch[0]: batch[1]} if batch else {})}
    text = json.dumps({**current, "version": version, "buckets": after, "batches": batches})
    files.publish(text, "manifest", f"{version:012d}.json")
    return version


def vacuum(spark: SparkSession, path: str, keep: int = 10) -> None:
    """Drops all but the newest ``keep`` versions and the data that none of these names; readers of older ones must be done.

    Folders of upserts that are under way are unnamed, too: run it while no upsert does.
    """
    files, known = _Files(spark, path), versions(spark, path)
    kept = known[-keep:]
    named = {place.split("/")[1] for version in kept for place in _manifest(files, version)["buckets"].values()}
    for version in known[:-keep]:
        files.delete("manifest", f"{version:012d}.json")
    for folder in files.names("data"):
        if folder not in named:
            files.delete("data", folder)
