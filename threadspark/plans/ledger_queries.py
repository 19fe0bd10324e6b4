"""Queries over captures, identities, attempts, receipts, usage, decisions and history."""

from pyspark.sql import functions as F

from threadspark import fixed_values as fv
from threadspark.operators import ledger, merges
from threadspark.plans.registry import DISCUSSION, query, sql_trim
from threadspark.rule_library import RULE_LIBRARY
from threadspark.sources.rules import categories_table, rules_table

HOST = "forum.example.org"


# --- captures: events as page captures of one thread per user --------------------------------


def _captures(t):
    kind = F.col("event_type")
    return t.events.select(
        F.col("event_id").alias("capture_id"),
        F.col("user_id").cast("string").alias("thread_id"),
        F.when((kind == "error") & (F.col("user_id") % 3 == 0), "api")
        .when(kind.isin("view", "click") & (F.col("user_id") % 2 == 0), "spa")
        .otherwise("legacy").alias("parser_variant"),
        F.when(F.col("event_id") % 13 > 0, F.floor(F.dayofyear("ts") / 20).cast("string")).alias("document_instance_id"),
        (F.col("event_id") % 5 + 1).cast("int").alias("page_number"),
        F.unix_millis("ts").alias("captured_at"),
    )


def _capture_replies(t):
    k = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos")
    rows = t.events.select("event_id", F.col("user_id").cast("string").alias("thread_id"), k)
    number = (F.col("event_id") * 3 + F.col("pos")) % 11
    return rows.select(
        "thread_id", F.col("event_id").alias("capture_id"), "pos", number.cast("string").alias("id"),
        F.when(number % 4 > 0, number.cast("string")).alias("site_reply_id"), (number % 3 == 1).alias("is_nested"),
        F.concat(F.lit("text "), "event_id", F.lit(" "), "pos").alias("content"),
        (F.col("event_id") % 3).cast("int").alias("image_count"), (number % 2).cast("int").alias("unexpanded_nested_count"),
    )


_CAPTURES = """captures AS (SELECT event_id AS capture_id, CAST(user_id AS VARCHAR) AS thread_id,
   CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'api' WHEN event_type IN ('view', 'click') AND user_id % 2 = 0 THEN 'spa' ELSE 'legacy' END AS v,
   CASE WHEN event_id % 13 > 0 THEN CAST(dayofyear(ts) // 20 AS VARCHAR) END AS inst, event_id % 5 + 1 AS page,
   row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS s FROM events),
 facts AS (SELECT thread_id, max(s) FILTER (v = 'api') AS api, arg_max(v, s) AS lv, arg_max(coalesce(inst, '-'), s) AS li, max(s) AS ls FROM captures GROUP BY 1),
 breaks AS (SELECT thread_id, coalesce(max(s) FILTER (v <> lv OR (lv = 'spa' AND coalesce(inst, '-') <> li)), 0) AS b FROM captures JOIN facts USING (thread_id) GROUP BY 1),
 alive AS (SELECT thread_id, capture_id, v, page, s FROM captures JOIN facts USING (thread_id) JOIN breaks USING (thread_id)
   WHERE CASE WHEN api IS NOT NULL THEN s = api WHEN lv = 'spa' AND li = '-' THEN s = ls ELSE s > b END
   QUALIFY v <> 'legacy' OR row_number() OVER (PARTITION BY thread_id, v, page ORDER BY s DESC) = 1),
 rows AS (SELECT CAST(user_id AS VARCHAR) AS thread_id, event_id AS capture_id, pos, (event_id * 3 + pos) % 11 AS number,
   concat('text ', event_id, ' ', pos) AS content, event_id % 3 AS image_count FROM events, (SELECT unnest([0, 1, 2, 3]) AS pos)),
 merged AS (SELECT *, CASE WHEN number % 4 > 0 THEN concat('site:', CASE WHEN number % 3 = 1 THEN 'nested' ELSE 'main' END, ':', number) ELSE concat('session:', number) END AS merge_key
   FROM rows JOIN alive USING (thread_id, capture_id)
   QUALIFY row_number() OVER (PARTITION BY thread_id, merge_key ORDER BY CASE WHEN v = 'legacy' THEN page ELSE 0 END DESC, s DESC, pos DESC) = 1)"""


@query("surviving_captures", f"WITH {_CAPTURES} SELECT thread_id, capture_id, v AS parser_variant FROM alive")
def surviving_captures(t):
    return merges.surviving_captures(_captures(t)).select("thread_id", "capture_id", "parser_variant")


@query("merge_captures", f"WITH {_CAPTURES} SELECT thread_id, merge_key, content FROM merged")
def merge_captures(t):
    return merges.merge_captures(_captures(t), _capture_replies(t)).select("thread_id", "merge_key", "content")


_COVERAGE = f"""WITH {_CAPTURES}, pages AS (SELECT thread_id, arg_max(v, s) AS v, string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY CAST(page AS VARCHAR)) AS pages,
    bool_or(page = 5) AS any_end, arg_max(page = 5, page * 1000000 + s) AS last_end, bool_and(page <> 4) AS all_complete,
    arg_max(page <> 4, page * 1000000 + s) AS last_complete, bool_or(page = 2) AS any_rest,
    arg_max(CASE WHEN page <> 3 THEN capture_id END, page * 1000000 + s) FILTER (page <> 3) AS declared FROM alive GROUP BY 1),
  counts AS (SELECT thread_id, count(*) AS visible, count(*) FILTER (number % 3 = 1) AS nested, sum(image_count) AS images,
    sum(CASE WHEN number % 3 <> 1 THEN number % 2 ELSE 0 END) AS unexpanded, count(*) FILTER (number % 4 = 0) AS unstable,
    count(*) FILTER (number % 4 = 0 AND number % 3 = 1) AS unstable_nested FROM merged GROUP BY 1)"""


def _coverage(t):
    alive = merges.surviving_captures(_captures(t)).select(
        "thread_id", "parser_variant", "page_number", "seq", (F.col("page_number") == 5).alias("reached_end"),
        (F.col("page_number") == 2).alias("may_remain"), (F.col("page_number") != 4).alias("is_complete"),
        F.when(F.col("page_number") != 3, F.col("capture_id")).alias("declared_count"),
    )
    return merges.thread_coverage(merges.merge_captures(_captures(t), _capture_replies(t)), alive)


@query("thread_coverage", f"""{_COVERAGE} SELECT thread_id, CASE v WHEN 'spa' THEN 'dynamic' WHEN 'api' THEN 'api' ELSE 'paginated' END AS capture_mode,
   visible AS visible_reply_count, visible - nested AS main_reply_count, nested AS nested_reply_count, CAST(images AS BIGINT) AS image_count,
   CAST(unexpanded AS BIGINT) AS unexpanded_nested_count, pages AS page_numbers, images > 0 AS has_unanalyzed_images, declared AS declared_reply_count,
   CASE WHEN v = 'spa' THEN NOT last_end ELSE any_rest END AS dynamic_content_may_remain, CASE WHEN v IN ('spa', 'api') THEN last_end ELSE any_end END AS reached_reply_list_end,
   CASE WHEN v = 'api' THEN unstable ELSE unstable_nested END AS unstable_reply_id_count,
   CASE v WHEN 'spa' THEN false WHEN 'api' THEN last_complete ELSE all_complete END AS is_complete FROM counts JOIN pages USING (thread_id)""")
def thread_coverage(t):
    return _coverage(t).withColumn("page_numbers", F.array_join("page_numbers", ","))


@query("capture_warnings", f"""{_COVERAGE}, w AS (SELECT thread_id, unnest(['unexpanded_nested', 'unread_images', 'unstable_ids']) AS code,
    unnest([CAST(unexpanded AS BIGINT), CAST(images AS BIGINT), CASE WHEN v = 'api' THEN unstable ELSE unstable_nested END]) AS count FROM counts JOIN pages USING (thread_id))
  SELECT * FROM w WHERE count > 0""")
def capture_warnings(t):
    return merges.capture_warnings(_coverage(t))


@query("latest_declared_count", """SELECT CAST(l_suppkey AS VARCHAR) AS thread_id, CAST(arg_max(l_partkey, l_orderkey * 10 + l_linenumber) FILTER (l_partkey % 3 > 0) AS BIGINT) AS declared FROM lineitem GROUP BY 1""")
def latest_declared_count(t):
    captures = t.lineitem.select(
        F.col("l_suppkey").cast("string").alias("thread_id"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey")).alias("declared_count"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    return merges.latest_declared_count(captures, F.col("seq")).withColumnRenamed("declared_reply_count", "declared")


# --- identities ------------------------------------------------------------------------------


_LINE = sql_trim("regexp_replace(x, '[\\t\\f\\x{0B} ]+', ' ', 'g')")
_CANONICAL = sql_trim(
    "array_to_string(list_transform(string_split(regexp_replace(nfc_normalize(content), '\\r\\n?', chr(10), 'g'), chr(10)), "
    f"lambda x: {_LINE}), chr(10))"
)


@query("snapshot_id", f"""WITH {DISCUSSION}, r AS (SELECT thread_id, pos, sha256(CAST(to_json({{'id': id, 'parent_reply_id': parent_reply_id, 'floor': floor, 'author': author_name,
     'timestamp_ms': timestamp_ms, 'content': {_CANONICAL}, 'image_count': image_count, 'is_nested': is_nested, 'unexpanded_nested_count': 0}}) AS VARCHAR)) AS digest FROM discussion),
   b AS (SELECT thread_id, sha256(sha256(sha256(sha256(string_agg(digest, ',' ORDER BY pos))))) AS digest FROM r GROUP BY thread_id)
   SELECT thread_id, sha256(CAST(to_json({{'title': thread_id, 'digest': digest}}) AS VARCHAR)) AS snapshot_id FROM b""")
def snapshot_id(t):
    rows = t.discussion.withColumns({"site_reply_id": F.col("id"), "unexpanded_nested_count": F.lit(0)})
    titles = rows.select("thread_id").distinct().withColumn("title", F.col("thread_id"))
    return ledger.snapshot_ids(rows, titles)


@query("analysis_key", """SELECT o_orderkey, sha256(concat('["', o_custkey, '","alibaba","https://api.example.com/v1","model-', o_orderkey % 3, '","',
   CASE WHEN o_orderpriority = '1-URGENT' THEN 'deep' ELSE 'fast' END, '","3.0.0","2026.07","sidepanel-v3"]')) AS analysis_key FROM orders""")
def analysis_key(t):
    mode = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("deep")).otherwise(F.lit("other"))
    key = ledger.analysis_key(
        F.col("o_custkey").cast("string"), F.lit("alibaba"), F.lit(" HTTPS://API.example.com/v1/#top"),
        F.concat(F.lit(" model-"), F.col("o_orderkey") % 3), mode, F.lit("3.0.0"), F.lit("2026.07"), F.lit("sidepanel-v3"),
    )
    return t.orders.select("o_orderkey", key.alias("analysis_key"))


# --- attempts: orders as analysis attempts, one snapshot per customer ------------------------


def _attempts(t):
    key, placed = F.col("o_orderkey"), F.col("o_orderdate")
    status = (
        F.when(F.col("o_orderstatus") == "F", F.when(key % 4 == 0, "failed_before_send").otherwise("success"))
        .when(F.col("o_orderstatus") == "O", F.when(key % 5 == 0, "pending").otherwise("failed_after_send"))
        .otherwise("preparing")
    )
    unsent = status.isin("preparing", "failed_before_send", "pending")
    failed = status.isin("failed_before_send", "failed_after_send")
    return t.orders.select(
        key.cast("string").alias("attempt_id"), F.col("o_custkey").cast("string").alias("snapshot_id"),
        F.concat(F.lit("k"), F.col("o_custkey") * 3 + key % 3).alias("analysis_key"), status.alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "deep").otherwise("fast").alias("mode"),
        placed.alias("started_at"), placed.alias("updated_at"),
        F.when(~unsent | (key % 17 == 0), placed).alias("sent_at"), F.when(~unsent, placed).alias("deadline_at"),
        F.when(failed | (status == "success"), placed).alias("completed_at"),
        F.when(failed & (key % 7 > 0), "network").alias("error_category"),
        F.when(failed, F.when(key % 3 == 0, "history_deleted").otherwise("E1")).alias("error_code"),
        (status == "success").alias("has_result"),
    )


_ATTEMPTS = """attempts AS (SELECT *, status IN ('preparing', 'failed_before_send', 'pending') AS unsent, status IN ('failed_before_send', 'failed_after_send') AS failed FROM (
   SELECT CAST(o_orderkey AS VARCHAR) AS attempt_id, CAST(o_custkey AS VARCHAR) AS snapshot_id, concat('k', o_custkey * 3 + o_orderkey % 3) AS analysis_key, o_orderkey AS k,
   epoch_us(o_orderdate) // 1000 AS started, CASE WHEN o_orderpriority = '1-URGENT' THEN 'deep' ELSE 'fast' END AS mode,
   CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'failed_before_send' ELSE 'success' END
     WHEN 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'pending' ELSE 'failed_after_send' END ELSE 'preparing' END AS status FROM orders))"""
_SENT = "(NOT unsent OR k % 17 = 0)"


@query("validate_attempts", f"""WITH {_ATTEMPTS} SELECT attempt_id, concat(CASE WHEN status = 'pending' THEN 'status|' ELSE '' END,
   CASE WHEN status IN ('preparing', 'failed_before_send') AND k % 17 = 0 THEN 'sent_before_send|' ELSE '' END,
   CASE WHEN status = 'pending' THEN 'sent_missing|completed_missing|error_missing|' ELSE '' END,
   CASE WHEN failed AND k % 7 = 0 THEN 'error_missing|' ELSE '' END) AS violations FROM attempts""")
def validate_attempts(t):
    rows = ledger.attempt_violations(_attempts(t))
    return rows.select("attempt_id", F.array_join(F.transform("violations", lambda v: F.concat(v, F.lit("|"))), "").alias("violations"))


_RECEIPT = "CASE WHEN status = 'preparing' THEN 'preparing' WHEN status = 'failed_before_send' THEN 'failed_before_send' WHEN status = 'success' THEN 'success' WHEN failed AND k % 3 = 0 THEN 'history_deleted' ELSE 'sent' END"


@query("receipts_from_attempts", f"""WITH {_ATTEMPTS} SELECT attempt_id, r AS receipt_status, CASE WHEN r NOT IN ('preparing', 'failed_before_send') AND {_SENT} THEN started END AS sent_ms,
   r <> 'failed_before_send' AS blocks, {_SENT} AS needs_confirmation FROM (SELECT *, {_RECEIPT} AS r FROM attempts)""")
def receipts_from_attempts(t):
    confirm = _attempts(t).select("attempt_id", ledger.needs_paid_confirmation(F.col("sent_at")).alias("needs_confirmation"))
    rows = ledger.receipts_from_attempts(_attempts(t)).join(confirm, "attempt_id")
    return rows.select(
        "attempt_id", "receipt_status", F.unix_millis("sent_at").alias("sent_ms"),
        ledger.blocks_new_request(F.col("receipt_status")).alias("blocks"), "needs_confirmation",
    )


@query("claim_attempts", f"""WITH {_ATTEMPTS}, held AS (SELECT snapshot_id, min(attempt_id) AS holder FROM attempts WHERE k % 23 = 0 AND {_RECEIPT} <> 'failed_before_send' GROUP BY 1),
   claims AS (SELECT a.*, h.holder AS held, k % 11 = 0 AS force, row_number() OVER (PARTITION BY snapshot_id ORDER BY started, attempt_id) AS n FROM attempts a LEFT JOIN held h USING (snapshot_id)),
   marked AS (SELECT *, force OR (n = 1 AND held IS NULL) AS granted FROM claims)
   SELECT snapshot_id, attempt_id, granted, CASE WHEN NOT granted THEN coalesce(last_value(CASE WHEN granted THEN attempt_id END IGNORE NULLS)
     OVER (PARTITION BY snapshot_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), held) END AS holder FROM marked""")
def claim_attempts(t):
    rows = _attempts(t)
    receipts = ledger.receipts_from_attempts(rows.filter(F.col("attempt_id").cast("bigint") % 23 == 0))
    blocking = receipts.filter(ledger.blocks_new_request(F.col("receipt_status"))).groupBy("snapshot_id").agg(F.min("attempt_id").alias("attempt_id"))
    claims = rows.select("snapshot_id", "attempt_id", F.col("started_at").alias("claimed_at"), (F.col("attempt_id").cast("bigint") % 11 == 0).alias("force"))
    return ledger.claim_attempts(claims, blocking.withColumn("receipt_status", F.lit("sent"))).select("snapshot_id", "attempt_id", "granted", "holder")


@query("latest_attempt_for_snapshot", f"""WITH {_ATTEMPTS} SELECT snapshot_id, attempt_id, status FROM attempts WHERE status IN ('preparing', 'success') OR {_SENT}
   QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY started DESC, attempt_id) = 1""")
def latest_attempt_for_snapshot(t):
    return ledger.latest_attempt_for_snapshot(_attempts(t)).select("snapshot_id", "attempt_id", "status")


@query("expire_attempts", f"""WITH {_ATTEMPTS} SELECT attempt_id, CASE WHEN status = 'pending' THEN 'unknown_after_disconnect' ELSE status END AS status,
   CASE WHEN status = 'pending' THEN started + CASE WHEN mode = 'deep' THEN 600000 ELSE 180000 END WHEN NOT unsent THEN started END AS deadline_ms FROM attempts""")
def expire_attempts(t):
    rows = ledger.expire_attempts(_attempts(t), F.lit("2030-01-01").cast("timestamp"))
    return rows.select("attempt_id", "status", F.unix_millis("deadline_at").alias("deadline_ms"))


@query("reuse_result", f"""WITH {_ATTEMPTS}, h AS (SELECT * FROM attempts WHERE status = 'success'),
   e AS (SELECT analysis_key, attempt_id FROM h QUALIFY row_number() OVER (PARTITION BY analysis_key ORDER BY started DESC, attempt_id DESC) = 1),
   s AS (SELECT snapshot_id, attempt_id FROM h QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY started DESC, attempt_id DESC) = 1)
   SELECT a.attempt_id AS wanted, coalesce(e.attempt_id, s.attempt_id) AS attempt_id, CASE WHEN e.attempt_id IS NOT NULL THEN 'exact' WHEN s.attempt_id IS NOT NULL THEN 'snapshot' ELSE 'none' END AS match
   FROM attempts a LEFT JOIN e USING (analysis_key) LEFT JOIN s ON s.snapshot_id = a.snapshot_id""")
def reuse_result(t):
    rows = _attempts(t)
    wanted = rows.select("snapshot_id", "analysis_key", F.col("attempt_id").alias("wanted"))
    return ledger.reuse_result(wanted, rows.filter("status = 'success'")).select("wanted", "attempt_id", "match")


@query("current_snapshot_only", """SELECT CAST(o_orderkey AS VARCHAR) AS attempt_id, o_orderkey % 4 = 0 AS applicable FROM orders""")
def current_snapshot_only(t):
    rows = t.orders.select(F.col("o_orderkey").cast("string").alias("attempt_id"), F.col("o_custkey").alias("thread_id"), (F.col("o_orderkey") % 4).alias("version"))
    current = t.customer.select(F.col("c_custkey").alias("thread_id"), F.lit(0).cast("bigint").alias("version"))
    good, stale = ledger.current_snapshot_only(rows, current)
    return good.select("attempt_id", F.lit(True).alias("applicable")).unionByName(stale.select("attempt_id", F.lit(False).alias("applicable")))


@query("merge_history", f"""WITH {_ATTEMPTS}, pairs AS (SELECT snapshot_id AS attempt_id, attempt_id AS body, CASE WHEN snapshot_id LIKE '%7' THEN analysis_key ELSE 'same' END AS ident, started, (k % 2) AS src FROM attempts),
   bad AS (SELECT attempt_id FROM pairs GROUP BY 1 HAVING count(DISTINCT ident) > 1)
   SELECT attempt_id, body, false AS refused FROM pairs WHERE attempt_id NOT IN (SELECT * FROM bad) QUALIFY row_number() OVER (PARTITION BY attempt_id ORDER BY started DESC, src DESC, body DESC) = 1
   UNION ALL SELECT attempt_id, body, true FROM pairs WHERE attempt_id IN (SELECT * FROM bad)""")
def merge_history(t):
    rows = _attempts(t).select(
        F.col("snapshot_id").alias("attempt_id"), F.col("attempt_id").alias("body"), F.lit("x").alias("snapshot_id"),
        F.when(F.col("snapshot_id").endswith("7"), F.col("analysis_key")).otherwise("same").alias("analysis_key"),
        *[F.lit(None).cast("string").alias(c) for c in ["thread_id", "thread_url", "provider", "model", "mode", "analyzer_version", "rules_version", "transport_version", "started_at"]],
        F.struct("started_at", F.col("attempt_id").cast("bigint") % 2, "attempt_id").alias("completed_at"),
    )
    odd = F.col("body").cast("bigint") % 2 == 1
    merged, refused = merges.merge_history(rows.filter(~odd), rows.filter(odd))
    return merged.select("attempt_id", "body", F.lit(False).alias("refused")).unionByName(
        refused.select("attempt_id", "body", F.lit(True).alias("refused"))
    )


@query("merge_review_records", """SELECT id, body, tags FROM (SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(o_orderkey AS VARCHAR) AS body, o_orderstatus AS tags,
   row_number() OVER (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate) // 1000 DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def merge_review_records(t):
    rows = t.orders.select(
        F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").cast("string").alias("body"),
        F.struct(F.unix_millis("o_orderdate"), "o_orderkey").alias("reviewed_at"),
        F.array("o_orderkey").cast("array<string>").alias("reply_ids"), F.array("o_orderstatus", "o_orderstatus").alias("internal_tags"),
    )
    odd = F.col("body").cast("bigint") % 2 == 1
    merged = merges.merge_review_records(rows.filter(odd), rows.filter(~odd))
    return merged.select("id", "body", F.array_join("internal_tags", ",").alias("tags"))


# --- usage: line items as model calls --------------------------------------------------------


def _usage(t):
    n_in, n_out = F.col("l_quantity").cast("bigint"), F.col("l_partkey") % 100
    return t.lineitem.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("attempt_id"), F.col("l_shipdate").alias("called_at"),
        n_in.alias("input_tokens"), n_out.alias("output_tokens"),
        F.when(F.col("l_linenumber") % 5 == 0, n_in + n_out + 1).otherwise(n_in + n_out).alias("total_tokens"),
    )


@query("reported_usage", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 NOT IN (0, 4) THEN CAST(l_quantity AS BIGINT) END AS input_tokens,
   CASE WHEN l_linenumber % 5 NOT IN (0, 4) THEN l_partkey % 100 END AS output_tokens FROM lineitem""")
def reported_usage(t):
    line, n_in, n_out = F.col("l_linenumber"), F.col("l_quantity").cast("bigint"), F.col("l_partkey") % 100
    first = F.to_json(F.struct(n_in.alias("prompt_tokens"), n_out.alias("completion_tokens"), (n_in + n_out).alias("total_tokens")))
    second = F.to_json(F.struct(n_in.alias("input_tokens"), n_out.alias("output_tokens")))
    wrong = F.to_json(F.struct(n_in.alias("input_tokens"), n_out.alias("output_tokens"), (n_in + n_out + 1).alias("total_tokens")))
    texts = F.to_json(F.struct(n_in.cast("string").alias("prompt_tokens"), n_out.alias("completion_tokens")))
    body = F.when(line % 5 == 0, wrong).when(line % 5 == 4, texts).when(line % 2 == 0, first).otherwise(second)
    used = ledger.reported_usage(F.col("body"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", body.alias("body")).withColumn("u", used)
    return rows.select("l_orderkey", "l_linenumber", F.col("u.input_tokens").alias("input_tokens"), F.col("u.output_tokens").alias("output_tokens"))


@query("monthly_usage", """SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS calls, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS input_tokens,
   CAST(sum(l_partkey % 100) AS BIGINT) AS output_tokens, CAST(sum(CAST(l_quantity AS BIGINT) + l_partkey % 100) AS BIGINT) AS total_tokens
   FROM lineitem WHERE l_linenumber % 5 <> 0 GROUP BY 1""")
def monthly_usage(t):
    return ledger.monthly_usage(_usage(t))


@query("newest_usage", """SELECT concat_ws(':', l_orderkey, l_linenumber) AS attempt_id, epoch_us(max(l_shipdate)) // 1000 AS called_ms FROM lineitem
   WHERE l_linenumber % 5 <> 0 GROUP BY 1 ORDER BY max(l_shipdate) DESC, 1 LIMIT 500""")
def newest_usage(t):
    return ledger.newest_usage(_usage(t), fv.MAX_USAGE_ENTRIES).select("attempt_id", F.unix_millis("called_at").alias("called_ms"))


# --- decisions and history -------------------------------------------------------------------


@query("link_decisions", """SELECT o_orderkey, o_orderkey % 3 > 0 AND o_orderkey % 4 < 3 AND o_orderkey % 5 IN (0, 1, 2) AS linked FROM orders""")
def link_decisions(t):
    key = F.col("o_orderkey")
    decisions = t.orders.select(
        key, F.when(key % 3 > 0, F.col("o_custkey").cast("string")).otherwise(F.lit("gone")).alias("analysis_attempt_id"),
        F.when(key % 4 < 3, F.lit("s1")).otherwise(F.lit("s2")).alias("snapshot_id"), F.lit("t").alias("thread_id"),
        F.when(key % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("f"), key % 5)).alias("finding_id"),
    )
    history = t.customer.select(
        F.col("c_custkey").cast("string").alias("attempt_id"), F.lit("s1").alias("snapshot_id"), F.lit("t").alias("thread_id"),
        F.array(F.lit("f1"), F.lit("f2")).alias("finding_ids"),
    )
    return ledger.link_decisions(decisions, history).select("o_orderkey", "linked")


@query("decision_rules", """SELECT o_orderkey, concat(CASE WHEN o_orderkey % 5 = 3 THEN 'undecided|' ELSE '' END, CASE WHEN o_orderkey % 5 = 4 THEN 'decision|' ELSE '' END,
   CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'finding_required|' ELSE '' END, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 = 0 THEN 'rule_required|' ELSE '' END) AS violations,
   CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 > 0 THEN 'R01.01' END AS primary_reason_id FROM orders""")
def decision_rules(t):
    key = F.col("o_orderkey")
    pick = F.element_at(F.array(*[F.lit(d) for d in ["delete", "keep", "watch", "undecided", "burn"]]), (key % 5 + 1).cast("int"))
    rows = t.orders.select(
        key, pick.alias("decision"), (1 - key % 2).alias("finding_count"), F.when(key % 3 > 0, F.lit("f")).alias("finding_id"),
        F.when(key % 7 > 0, F.lit("R01.01")).alias("reason_id"), F.lit("spam").alias("risk_type"), F.lit("low").alias("severity"),
    )
    out = ledger.decision_violations(rows)
    return out.select("o_orderkey", F.array_join(F.transform("violations", lambda v: F.concat(v, F.lit("|"))), "").alias("violations"), "primary_reason_id")


@query("validate_records", """SELECT o_orderkey, concat(CASE WHEN o_orderkey % 4 = 1 THEN 'id|' ELSE '' END, CASE WHEN o_orderkey % 3 = 1 THEN 'thread_mismatch|' ELSE '' END,
   CASE WHEN o_orderkey % 5 = 1 THEN 'reply_ids|' ELSE '' END, CASE WHEN o_orderkey % 6 = 1 THEN 'primary_reason_id|' ELSE '' END,
   CASE WHEN o_orderkey % 7 = 1 THEN 'internal_tags|' ELSE '' END) AS violations FROM orders""")
def validate_records(t):
    key = F.col("o_orderkey")

    def bad(n, wrong, right):
        return F.when(key % n == 1, F.lit(wrong)).otherwise(right if not isinstance(right, str) else F.lit(right))

    uuid = F.concat(F.lpad(key.cast("string"), 8, "0"), F.lit("-0000-4000-8000-000000000000"))
    rows = t.orders.select(
        key, F.lit("1.0").alias("schema_version"), bad(4, "no-uuid", uuid).alias("id"), bad(3, "99x", key.cast("string")).alias("t"),
        F.concat(F.lit(f"https://{HOST}/p/"), key).alias("thread_url"),
        F.array(F.lit("thread-page-1-floor-2"), bad(5, "kr-x", "12-nested-3")).alias("reply_ids"), F.lit("keep").alias("decision"),
        bad(6, "R99.01", "R16.06").alias("primary_reason_id"), F.array(F.lit("spam"), bad(7, "rude", "high")).alias("internal_tags"),
        F.col("o_orderdate").alias("reviewed_at"), F.lit("a:1").alias("analysis_attempt_id"), F.sha2(key.cast("string"), 256).alias("snapshot_id"), F.lit(None).cast("string").alias("finding_id"),
    ).withColumn("thread_id", F.when(F.col("t") == "99x", F.concat(F.lit("9"), key)).otherwise(F.col("t")))
    out = ledger.record_violations(rows, rules_table(t.spark), HOST, max_reply_ids=10_000, max_tags=16)
    return out.select("o_orderkey", F.array_join(F.transform("violations", lambda v: F.concat(v, F.lit("|"))), "").alias("violations"))


@query("validate_history", """SELECT o_orderkey, concat(CASE WHEN o_orderkey % 4 = 1 THEN 'thread_url|' ELSE '' END, CASE WHEN o_orderkey % 5 = 1 THEN 'completed_before_start|' ELSE '' END,
   CASE WHEN o_custkey > o_orderkey THEN 'analyzed_count|' ELSE '' END, CASE WHEN o_orderkey % 6 = 1 THEN 'usage|' ELSE '' END) AS violations FROM orders""")
def validate_history(t):
    key = F.col("o_orderkey")
    rows = t.orders.select(
        key, key.cast("string").alias("attempt_id"), F.sha2(key.cast("string"), 256).alias("snapshot_id"), F.sha2(F.lit("k"), 256).alias("analysis_key"),
        key.cast("string").alias("thread_id"), F.concat(F.lit(f"https://{HOST}/p/"), key, F.when(key % 4 == 1, "?pn=2").otherwise("")).alias("thread_url"),
        F.lit("title").alias("thread_title"), F.lit("m").alias("model"), F.lit("deep").alias("mode"), F.lit("2026.07").alias("rules_version"),
        F.col("o_orderdate").alias("started_at"), F.when(key % 5 == 1, F.col("o_orderdate") - F.expr("INTERVAL 1 SECOND")).otherwise(F.col("o_orderdate")).alias("completed_at"),
        F.col("o_custkey").alias("analyzed_reply_count"), key.alias("visible_reply_count"), F.lit(3).alias("input_tokens"), F.lit(4).alias("output_tokens"),
        F.when(key % 6 == 1, 8).otherwise(7).alias("total_tokens"),
    )
    out = ledger.history_violations(rows, HOST)
    return out.select("o_orderkey", F.array_join(F.transform("violations", lambda v: F.concat(v, F.lit("|"))), "").alias("violations"))


@query("storage_budget", """SELECT CAST(o_custkey AS VARCHAR) AS ledger_id, count(*) AS entries, CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + length(o_orderpriority)) AS BIGINT) AS bytes,
   CAST(max(length(o_orderpriority)) AS BIGINT) AS largest, count(*) <= 12 AND sum(length(CAST(o_orderkey AS VARCHAR)) + length(o_orderpriority)) <= 200 AS accepted FROM orders GROUP BY 1""")
def storage_budget(t):
    rows = t.orders.select(F.col("o_custkey").cast("string").alias("ledger_id"), F.col("o_orderkey").cast("string").alias("k"), "o_orderpriority")
    return ledger.storage_budget(rows, F.col("k"), F.col("o_orderpriority"), max_bytes=200, max_entries=12)


@query("id_sets", """SELECT thread_id, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS missing, array_to_string(list_sort(list_filter(a, lambda x: list_contains(b, x))), ',') AS shared FROM (
   SELECT user_id AS thread_id, list(DISTINCT CAST(event_id AS VARCHAR)) AS a, list(DISTINCT CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) ELSE 'x' END) AS b FROM events GROUP BY 1)""")
def id_sets(t):
    e = F.col("event_id").cast("string")
    rows = t.events.groupBy(F.col("user_id").alias("thread_id")).agg(
        F.collect_set(e).alias("a"), F.collect_set(F.when(F.col("event_id") % 3 == 0, e).otherwise(F.lit("x"))).alias("b")
    )
    return rows.select(
        "thread_id", F.array_join(F.array_sort(merges.missing_ids(F.col("a"), F.col("b"))), ",").alias("missing"),
        F.array_join(F.array_sort(merges.shared_ids(F.col("a"), F.col("b"))), ",").alias("shared"),
    )


@query("id_set_rows", """WITH a AS (SELECT DISTINCT user_id AS thread_id, CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id IS NOT NULL),
   b AS (SELECT DISTINCT user_id AS thread_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) ELSE 'x' END AS id FROM events)
   SELECT a.thread_id, a.id, CASE WHEN b.id IS NULL THEN 'missing' ELSE 'shared' END AS kind FROM a LEFT JOIN b ON a.thread_id IS NOT DISTINCT FROM b.thread_id AND a.id = b.id""")
def id_set_rows(t):
    rows = t.events.select(F.col("user_id").alias("thread_id"), F.col("event_id").cast("string").alias("id"), "event_id")
    return merges.id_rows(rows, rows.withColumn("id", F.when(F.col("event_id") % 3 == 0, F.col("id")).otherwise(F.lit("x"))))


_RULE_SQL = ", ".join(f"('{key}', '{title}', {len(texts)})" for key, (title, texts) in RULE_LIBRARY.items())


@query("rules_of_decisions", f"""WITH c(category_id, title, n) AS (VALUES {_RULE_SQL}), d AS (SELECT concat('R', lpad(CAST(o_custkey % 20 + 1 AS VARCHAR), 2, '0')) AS category_id, o_orderkey % 9 + 1 AS item FROM orders)
   SELECT c.category_id, c.title, CAST(c.n AS BIGINT) AS rules, CAST(count(d.item) FILTER (d.item <= c.n) AS BIGINT) AS decisions FROM c LEFT JOIN d USING (category_id) GROUP BY ALL""")
def rules_of_decisions(t):
    """Decisions per category of the rule library; both tables of the library are read."""
    used = t.orders.select(F.concat(F.lit("R"), F.lpad((F.col("o_custkey") % 20 + 1).cast("string"), 2, "0"), F.lit("."), F.lpad((F.col("o_orderkey") % 9 + 1).cast("string"), 2, "0")).alias("rule_id"))
    rules = rules_table(t.spark)
    counted = used.groupBy("rule_id").agg(F.count("*").alias("n"))
    sizes = rules.join(counted, "rule_id", "left").groupBy("category_id").agg(F.count("*").alias("rules"), F.sum(F.coalesce("n", F.lit(0))).alias("decisions"))
    return categories_table(t.spark).select("category_id", "title").join(sizes, "category_id")
