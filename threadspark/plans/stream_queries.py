"""Streaming jobs run over the given tables until everything available is read."""

import uuid

from pyspark.sql import functions as F

from threadspark.plans.registry import query
from threadspark.session import shared_folder
from threadspark.streaming import jobs


def _stream(t, name):
    path = f"{t.folder}/{name}.parquet"
    # A glob, so that a table may be one file or a folder of files.
    source = f"{t.folder}/{name}.[p]arquet"
    rows = t.spark.readStream.schema(t.spark.read.parquet(path).schema).parquet(source)
    zoneless = [c for c, kind in rows.dtypes if kind == "timestamp_ntz"]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def _keyed_state(t):
    t.spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def _folders(t):
    base = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


@query("stream_bursts", """WITH b AS (SELECT user_id, event_type, epoch_us(ts) // 1000 AS ms, CAST(trunc(value) AS INTEGER) AS risk FROM events),
   w AS (SELECT user_id, (ms // 3600000 - k) * 3600000 AS start_ms, risk FROM b, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k))
   SELECT user_id, start_ms, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 3 AND sum(risk) >= 35""")
def stream_bursts(t):
    posts = _stream(t, "events").select("user_id", F.col("ts").alias("at"), F.col("value").cast("int").alias("risk"))
    found = jobs.stream_bursts(posts, ["user_id"], "6 hours", "1 hour", 3, 35)
    return jobs.start_updates(found, ["user_id", "start_ms"], "n", *_folders(t))


@query("stream_usage", """WITH d AS (SELECT date_trunc('day', l_shipdate) AS day, count(*) AS calls, sum(CAST(l_quantity AS BIGINT)) AS i, sum(l_partkey % 100) AS o FROM lineitem GROUP BY 1)
   SELECT strftime(day, '%Y-%m') AS month, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens FROM d GROUP BY 1""")
def stream_usage(t):
    calls = _stream(t, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("attempt_id"), F.col("l_shipdate").alias("called_at"),
        F.col("l_quantity").cast("bigint").alias("input_tokens"), (F.col("l_partkey") % 100).alias("output_tokens"),
    )
    return jobs.usage_by_month(jobs.start_updates(jobs.stream_usage(calls), ["day"], "calls", *_folders(t)))


@query("stream_merge_captures", """SELECT CAST(user_id AS VARCHAR) AS thread_id, concat('site:main:', event_id % 9) AS merge_key, arg_max(event_id, epoch_us(ts)) AS capture_id FROM events GROUP BY 1, 2""")
def stream_merge_captures(t):
    number = F.col("event_id") % 9
    rows = _stream(t, "events").select(
        F.col("user_id").cast("string").alias("thread_id"), F.col("event_id").alias("capture_id"), F.lit("doc").alias("document_instance_id"),
        F.unix_micros("ts").alias("captured_at"), number.alias("pos"), number.cast("string").alias("id"), number.cast("string").alias("site_reply_id"),
        F.lit(False).alias("is_nested"),
    )
    path, checkpoint = _folders(t)
    jobs.stream_merge_captures(rows, path, checkpoint).awaitTermination()
    return jobs.current_replies(t.spark, path).select("thread_id", "merge_key", "capture_id")


@query("stream_claims", """WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS snapshot_id, CAST(o_orderkey AS VARCHAR) AS attempt_id, o_orderdate AS placed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) = 1 OR o_orderkey % 11 = 0 AS granted FROM orders)
   SELECT snapshot_id, attempt_id, granted, CASE WHEN NOT granted THEN last_value(CASE WHEN granted THEN attempt_id END IGNORE NULLS) OVER (PARTITION BY snapshot_id ORDER BY placed, attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS holder FROM c""")
def stream_claims(t):
    events = _stream(t, "orders").select(
        F.col("o_custkey").cast("string").alias("snapshot_id"), F.col("o_orderkey").cast("string").alias("attempt_id"), F.lit("claim").alias("kind"),
        F.lit("preparing").alias("status"), (F.col("o_orderkey") % 11 == 0).alias("force"), F.col("o_orderdate").alias("at"),
    )
    path, checkpoint = _folders(t)
    jobs.stream_claims(events, path, checkpoint).awaitTermination()
    return jobs.read_batches(t.spark, path, jobs.CLAIM_OUTPUT).select("snapshot_id", "attempt_id", "granted", "holder")


@query("stream_expiry", """WITH a AS (SELECT CAST(o_orderkey AS VARCHAR) AS attempt_id, o_orderstatus, epoch_us(o_orderdate) // 1000 AS placed,
     epoch_us(o_orderdate) // 1000 + CASE WHEN o_orderpriority = '1-URGENT' THEN 600000 ELSE 180000 END AS deadline_ms FROM orders)
   SELECT attempt_id, CASE o_orderstatus WHEN 'O' THEN 'unknown_after_disconnect' ELSE 'cancelled_before_send' END AS status, deadline_ms FROM a
   WHERE o_orderstatus IN ('O', 'P') AND deadline_ms <= (SELECT max(placed) FROM a)""")
def stream_expiry(t):
    _keyed_state(t)
    events = _stream(t, "orders").select(
        F.col("o_orderkey").cast("string").alias("attempt_id"),
        F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "preparing").otherwise("success").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "deep").otherwise("fast").alias("mode"), F.col("o_orderdate").alias("at"),
    )
    return jobs.start_available(jobs.stream_expiry(events), *_folders(t))


@query("stream_change_events", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS thread_id, epoch_us(ts) // 1000 AS ms, md5(concat(event_id, chr(0), event_type, '|', event_id % 97)) AS h FROM events)
   SELECT thread_id, max(ms) + 750 AS emitted_ms, concat(sum(CAST(concat('0x', substr(h, 1, 15)) AS HUGEINT)) % 1152921504606846976, '-', sum(CAST(concat('0x', substr(h, 16, 15)) AS HUGEINT)) % 1152921504606846976) AS signature
   FROM e GROUP BY 1 HAVING max(ms) + 750 <= (SELECT max(ms) FROM e)""")
def stream_change_events(t):
    posts = _stream(t, "events").select(
        F.col("user_id").cast("string").alias("thread_id"), F.col("event_id").cast("string").alias("id"),
        F.concat_ws("|", "event_type", F.col("event_id") % 97).alias("content"), F.col("ts").alias("at"),
    )
    path, checkpoint = _folders(t)
    jobs.stream_change_events(posts, path, checkpoint).awaitTermination()
    return jobs.read_batches(t.spark, path, jobs.CHANGE_OUTPUT).select("thread_id", "emitted_ms", "signature")
