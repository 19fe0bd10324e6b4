"""Structured Streaming forms: live merges, change events, claims, expiry, bursts and usage."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadspark import fixed_values as fv
from threadspark.operators.merges import merge_key
from threadspark.session import cut_lineage
from threadspark.sources.snapshots import has_batch, is_folder, read_table, upsert_table, versions

CLAIM_OUTPUT = "snapshot_id string, attempt_id string, granted boolean, holder string"
PARTS = 1 << 60  # each half of a multiset hash
CHANGE_OUTPUT = "thread_id string, signature string, emitted_ms bigint"
THREAD_STATE = "thread_id string, high bigint, low bigint, newest bigint, due bigint, told string"
ITEM_STATE = "thread_id string, id string, high bigint, low bigint"


def start_available(rows: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs a stream over everything available into a Parquet folder and waits for it."""
    query = (
        rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return rows.sparkSession.read.parquet(path)


def start_updates(rows: DataFrame, keys: list[str], version: str, path: str, checkpoint: str) -> DataFrame:
    """Runs a windowed stream over everything available into a table of its latest results and waits for it.

    Windows that are still open have their row from the first batch on, so none is lost when a stream ends;
    ``version`` is a column that only grows while a window fills, so a retried batch changes nothing.
    """
    def apply(batch: DataFrame, number: int) -> None:
        upsert_table(batch.sparkSession, path, batch, keys, F.col(version), batch=(checkpoint, number))

    query = rows.writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return read_table(rows.sparkSession, path).select(*rows.columns)


# --- merged replies --------------------------------------------------------------------------


def stream_merge_captures(capture_rows: DataFrame, path: str, checkpoint: str):
    """Upserts live capture rows by thread, document instance and reply key; the latest capture wins.

    Replies that leave the page stay.  A batch that was committed before is left out when it is retried.
    """
    keys = ["thread_id", "instance", "merge_key"]

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch.withColumns(
            {
                "merge_key": merge_key(F.col("id"), F.col("site_reply_id"), F.col("is_nested")),
                "instance": F.coalesce("document_instance_id", F.col("capture_id").cast("string")),
            }
        )
        upsert_table(batch.sparkSession, path, rows, keys, F.struct("captured_at", "pos"), batch=(checkpoint, number))

    return (
        capture_rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_replies(spark: SparkSession, path: str) -> DataFrame:
    """Merged replies of each thread's newest document instance; a new instance resets the thread."""
    table = read_table(spark, path)
    newest = table.groupBy("thread_id").agg(F.max_by("instance", "captured_at").alias("instance"))
    return table.join(newest, ["thread_id", "instance"])


# --- keyed state -----------------------------------------------------------------------------


def _grants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decides claims row by row; rows come snapshot by snapshot, the stored holder first.  A holder row ends each snapshot."""
    key, begun, held, status = None, False, None, None
    for batch in batches:
        out = []
        for snapshot, attempt, kind, told, force in zip(*(batch[c].tolist() for c in ("snapshot_id", "attempt_id", "kind", "status", "force")), strict=True):
            if not begun or snapshot != key:
                if held is not None:
                    out.append((key, held, None, None, status))
                key, begun, held, status = snapshot, True, None, None
            if kind == "held":
                held, status = attempt, told
            elif kind == "status":
                status = told if attempt == held else status
            else:
                granted = bool(force) or held is None or status == "failed_before_send"
                out.append((snapshot, attempt, granted, None if granted else held, None))
                if granted:
                    held, status = attempt, "preparing"
        yield pd.DataFrame(out, columns=["snapshot_id", "attempt_id", "granted", "holder", "status"])
    if held is not None:
        yield pd.DataFrame([(key, held, None, None, status)], columns=["snapshot_id", "attempt_id", "granted", "holder", "status"])


def grant_claims(events: DataFrame, holders: DataFrame) -> DataFrame:
    """``CLAIM_OUTPUT`` and ``status``: a row per claim, and one without ``granted`` for the holder that each snapshot has at the end.

    One billing holder per snapshot: the first claim wins unless forced or the holder never sent.  Spark sorts the rows, so a
    task holds one snapshot's holder at a time, however many claims a snapshot has.
    """
    columns = ["snapshot_id", "attempt_id", "kind", "status", "force"]
    stored = holders.select("snapshot_id", "attempt_id", F.lit("held").alias("kind"), "status", F.lit(True).alias("force"), F.lit(0).alias("_turn"), F.lit(None).cast("timestamp").alias("at"))
    rows = events.select(*columns, F.lit(1).alias("_turn"), F.col("at").cast("timestamp").alias("at")).unionByName(stored)
    # of equal times a claim comes before the status of its attempt
    ordered = rows.repartition("snapshot_id").sortWithinPartitions("snapshot_id", "_turn", "at", "attempt_id", "kind")
    return ordered.select(*columns).mapInPandas(_grants, f"{CLAIM_OUTPUT}, status string")


def stream_claims(events: DataFrame, path: str, checkpoint: str):
    """Starts a stream of ``snapshot_id, attempt_id, kind (claim/status), status, force, at`` that grants or refuses claims.

    ``path`` gets the claims batch by batch (``read_batches``) and a table of the holders.
    """
    def apply(batch: DataFrame, number: int) -> None:
        spark, holders = batch.sparkSession, f"{path}/holders"
        if has_batch(spark, holders, (checkpoint, number)):
            return
        decided = cut_lineage(grant_claims(batch, _stored(spark, holders, "snapshot_id string, attempt_id string, status string")))
        decided.filter("granted IS NOT NULL").drop("status").write.mode("overwrite").parquet(_batch_folder(path, number))
        current = decided.filter("granted IS NULL").select("snapshot_id", "attempt_id", "status")
        upsert_table(spark, holders, current, ["snapshot_id"], F.lit(0), batch=(checkpoint, number))

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batch_folder(path: str, number: int) -> str:
    return f"{path}/out/batch={number}"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_table(spark, path) if versions(spark, path) else spark.createDataFrame([], schema)


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a stream has told so far; a batch that is done again replaces its own rows."""
    if not is_folder(spark, f"{path}/out"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{path}/out").drop("batch")


def stream_expiry(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """``attempt_id, status, mode, at`` → attempts whose deadline passed in event time.

    An attempt that is still open at its deadline becomes unknown, or cancelled if never sent.  Any other event of the
    attempt before the deadline takes the place of the open one; of equal times one that ends the attempt counts.
    Events that reach each other in this way are one session, so the state ends with it and no task runs Python.
    """
    timeout = F.when(F.col("mode") == "deep", fv.TIMEOUT_MS["deep"]).otherwise(fv.TIMEOUT_MS["fast"])
    is_open = F.coalesce(F.col("status").isin("preparing", "running"), F.lit(False))
    event = F.struct(F.unix_millis("at").alias("ms"), (~is_open).alias("ended"), "status", (F.unix_millis("at") + timeout).alias("deadline_ms"))
    gap = F.when(is_open, F.concat(timeout.cast("string"), F.lit(" milliseconds"))).otherwise("1 millisecond")
    sessions = (
        events.withWatermark("at", delay).groupBy("attempt_id", F.session_window("at", gap).alias("session")).agg(F.collect_list(event).alias("events"))
    )

    def passed(e, place):
        following = F.get("events", place + 1)
        return ~e["ended"] & (following.isNull() | (following["ms"] >= e["deadline_ms"]))

    ordered = sessions.withColumn("events", F.array_sort("events"))
    late = ordered.select("attempt_id", F.explode(F.filter("events", passed)).alias("e"))
    status = F.when(F.col("e.status") == "running", "unknown_after_disconnect").otherwise("cancelled_before_send")
    return late.select("attempt_id", status.alias("status"), "e.deadline_ms")


def item_parts(item: Column, content: Column) -> list[Column]:
    """Two 60-bit numbers of one item of a multiset."""
    digest = F.md5(F.concat(F.coalesce(item, F.lit("")), F.lit("\x00"), F.coalesce(content, F.lit(""))))
    return [F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint").alias(name) for start, name in ((1, "high"), (16, "low"))]


def _changed_threads(items: DataFrame, known: DataFrame, threads: DataFrame, quiet_ms: int) -> DataFrame:
    """All threads with the new items counted in: a new item is added, one that it replaces is taken off."""
    old = known.select(F.col("thread_id").alias("_thread"), F.col("id").alias("_id"), F.col("high").alias("_high"), F.col("low").alias("_low"))
    same = F.col("thread_id").eqNullSafe(F.col("_thread")) & F.col("id").eqNullSafe(F.col("_id"))
    parts = items.join(old, same, "left")
    # a sum of 60-bit numbers may pass 64 bits
    added = [F.sum((F.col(c) - F.coalesce(f"_{c}", F.lit(0))).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]
    delta = parts.groupBy("thread_id").agg(*added, F.max("ms").alias("newest")).withColumn("due", F.col("newest") + quiet_ms)
    before = threads.select("thread_id", *[F.col(c).cast("decimal(30,0)").alias(c) for c in ("high", "low")], "newest", "due", "told")
    both = before.unionByName(delta.select("thread_id", *[F.col(c).cast("decimal(30,0)").alias(c) for c in ("high", "low")], "newest", "due", F.lit(None).cast("string").alias("told")))
    return both.groupBy("thread_id").agg(
        *[F.pmod(F.sum(c), F.lit(PARTS).cast("decimal(30,0)")).cast("bigint").alias(c) for c in ("high", "low")],
        F.max("newest").alias("newest"), F.max("due").alias("due"), F.max("told").alias("told"),
    )


def stream_change_events(posts: DataFrame, path: str, checkpoint: str, quiet_ms: int = 750, delay_ms: int = 0):
    """Starts a stream of ``thread_id, id, content, at`` that tells one event per settled burst that really changed something.

    After a quiet time in event time a thread is told if its content signature differs from the last one told.  The signature is
    a multiset hash that is kept up to date, so a batch looks only at the items that it brings and those that they replace.
    Of one batch the latest row of an item counts.  ``path`` gets the events batch by batch (``read_batches``) and the state's tables.
    """
    def apply(batch: DataFrame, number: int) -> None:
        spark, mark = batch.sparkSession, (checkpoint, number)
        threads, known = f"{path}/threads", f"{path}/items"
        if has_batch(spark, known, mark):
            return
        timed = batch.select("thread_id", "id", "content", F.unix_millis("at").alias("ms"), "at")
        latest = timed.groupBy("thread_id", "id").agg(F.max_by("content", F.struct("at", "content")).alias("content"), F.max("ms").alias("ms"))
        items = cut_lineage(latest.select("thread_id", "id", *item_parts(F.col("id"), F.col("content")), "ms"))
        if not has_batch(spark, threads, mark):
            stored = _stored(spark, threads, THREAD_STATE)
            changed = cut_lineage(_changed_threads(items, _stored(spark, known, ITEM_STATE), stored, quiet_ms))
            seen = changed.agg(F.max("newest").alias("seen"), F.lit(delay_ms).alias("delay"))
            settled = F.coalesce(F.col("due") <= F.col("seen") - F.col("delay"), F.lit(False))
            signature = F.concat_ws("-", "high", "low")
            judged = cut_lineage(changed.crossJoin(F.broadcast(seen)).select("*", settled.alias("settled"), signature.alias("signature")))
            news = judged.filter(F.col("settled") & ~F.col("signature").eqNullSafe(F.col("told")))
            news.select("thread_id", "signature", F.col("due").alias("emitted_ms")).write.mode("overwrite").parquet(_batch_folder(path, number))
            after = judged.select(
                "thread_id", "high", "low", "newest", F.when(~F.col("settled"), F.col("due")).alias("due"),
                F.when(F.col("settled"), F.col("signature")).otherwise(F.col("told")).alias("told"),
            )
            upsert_table(spark, threads, after, ["thread_id"], F.lit(0), batch=mark)
        upsert_table(spark, known, items.drop("ms"), ["thread_id", "id"], F.lit(0), batch=mark)

    return posts.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- windows ---------------------------------------------------------------------------------


def stream_bursts(posts: DataFrame, group: list[str], width: str, slide: str, min_count: int, min_risk: int = 0, delay: str = "1 hour") -> DataFrame:
    """Sliding windows with enough posts and risk: ``group…, start_ms, n``."""
    counted = (
        posts.withWatermark("at", delay)
        .groupBy(*group, F.window("at", width, slide).alias("w"))
        .agg(F.count("*").alias("n"), F.sum("risk").alias("risk"))
    )
    return counted.filter((F.col("n") >= min_count) & (F.col("risk") >= min_risk)).select(*group, F.unix_millis("w.start").alias("start_ms"), "n")


def stream_usage(calls: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily token totals of calls, each attempt counted once; months are sums of days (``usage_by_month``)."""
    once = calls.withWatermark("called_at", delay).dropDuplicatesWithinWatermark(["attempt_id"])
    return (
        once.groupBy(F.window("called_at", "1 day").alias("w"))
        .agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
        .select(F.col("w.start").alias("day"), "calls", "input_tokens", "output_tokens")
    )


def usage_by_month(days: DataFrame) -> DataFrame:
    return days.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(
        *[F.sum(c).alias(c) for c in ["calls", "input_tokens", "output_tokens"]]
    )
