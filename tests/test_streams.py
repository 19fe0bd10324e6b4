"""Live claims, expiry and change events over several batches."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from threadspark.streaming import jobs


@pytest.fixture
def feed(spark, tmp_path):
    """A stream over batches of rows: one file is one batch."""
    def build(schema, *batches):
        folder = str(tmp_path / "in")
        for n, rows in enumerate(batches):
            frame = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_millis("at"))
            frame.coalesce(1).write.mode("append").parquet(folder)
            # files are read in the order of their times
            for file in (tmp_path / "in").glob("*.parquet"):
                if not (tmp_path / f"seen-{file.name}").exists():
                    (tmp_path / f"seen-{file.name}").touch()
                    os.utime(file, (1_000_000 + n * 100, 1_000_000 + n * 100))
        return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return build


def test_claims_follow_their_holder_over_batches(spark, feed, tmp_path):
    schema = "snapshot_id string, attempt_id string, kind string, status string, force boolean, at bigint"
    first = [("s", "b", "claim", None, False, 2), ("s", "a", "claim", None, False, 1), ("z", "q", "claim", None, True, 1), ("s", "b", "status", "failed_before_send", None, 3)]
    second = [("s", "c", "claim", None, False, 5), ("s", "a", "status", "failed_before_send", None, 6), ("s", "d", "claim", None, False, 7), ("s", "e", "claim", None, True, 8)]
    third = [("s", "f", "claim", None, False, 9), ("z", "r", "claim", None, False, 9)]
    path = str(tmp_path / "out")
    jobs.stream_claims(feed(schema, first, second, third), path, str(tmp_path / "check")).awaitTermination()
    got = {row["attempt_id"]: (row["granted"], row["holder"]) for row in jobs.read_batches(spark, path, jobs.CLAIM_OUTPUT).collect()}
    assert got == {
        "a": (True, None), "b": (False, "a"), "q": (True, None), "c": (False, "a"), "d": (True, None), "e": (True, None), "f": (False, "e"), "r": (False, "q"),
    }


def test_claims_run_no_code_per_snapshot(spark):
    events = spark.range(10).select(
        F.col("id").cast("string").alias("snapshot_id"), F.lit("a").alias("attempt_id"), F.lit("claim").alias("kind"), F.lit("x").alias("status"),
        F.lit(False).alias("force"), F.lit(None).cast("timestamp").alias("at"),
    )
    plan = jobs.grant_claims(events, events.limit(0))._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "State" not in plan and "FlatMapGroups" not in plan


def test_attempts_expire_in_event_time_whatever_the_batches(spark, feed, tmp_path):
    minute = 60_000
    schema = "attempt_id string, status string, mode string, at bigint"
    rows = [
        ("sent", "preparing", "fast", 0), ("sent", "running", "fast", minute), ("done", "running", "fast", 0), ("done", "success", "fast", 2 * minute),
        ("late", "preparing", "fast", 0), ("late", "success", "fast", 5 * minute), ("deep", "running", "deep", 0), ("deep", "running", "fast", minute),
        ("deep", "success", "fast", 5 * minute), ("edge", "running", "fast", 0), ("edge", "success", "fast", 3 * minute), ("tie", "success", "fast", minute), ("tie", "running", "fast", minute),
    ]
    want = {
        ("sent", "unknown_after_disconnect", 4 * minute), ("late", "cancelled_before_send", 3 * minute),
        ("deep", "unknown_after_disconnect", 4 * minute), ("edge", "unknown_after_disconnect", 3 * minute),
    }
    end = [("end", "success", "fast", 60 * minute)]
    found = jobs.start_available(jobs.stream_expiry(feed(schema, rows + end)), str(tmp_path / "out"), str(tmp_path / "check"))
    assert {tuple(row) for row in found.collect()} == want


def test_change_events_tell_real_changes_only(spark, feed, tmp_path):
    schema = "thread_id string, id string, content string, at bigint"
    batches = [
        [("t", "1", "a", 0), ("t", "2", "b", 100), ("u", "1", "a", 2_000)],
        [("t", "1", "a", 3_000), ("u", "2", "x", 3_100), ("w", "1", "a", 9_000)],  # t says nothing new, u does
        [("u", "2", "y", 10_000), ("w", "9", "z", 20_000)],  # an item replaced
    ]
    path = str(tmp_path / "out")
    jobs.stream_change_events(feed(schema, *batches), path, str(tmp_path / "check")).awaitTermination()
    rows = sorted((row["thread_id"], row["emitted_ms"], row["signature"]) for row in jobs.read_batches(spark, path, jobs.CHANGE_OUTPUT).collect())
    assert [row[:2] for row in rows] == [("t", 850), ("u", 3_850), ("u", 10_750)]

    def signature(*items):
        digests = [hashlib.md5(f"{i}\x00{c}".encode()).hexdigest() for i, c in items]
        return "-".join(str(sum(int(d[k:k + 15], 16) for d in digests) % (1 << 60)) for k in (0, 15))

    assert [row[2] for row in rows] == [signature("1a", "2b"), signature("1a", "2x"), signature("1a", "2y")]
