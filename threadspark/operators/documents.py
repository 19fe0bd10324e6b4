"""Stored documents read strictly from their JSON: decisions and history entries, and the making of new ones.

Shapes tell most faults; what compares fields with each other, with the rule library or with an address is checked here.
Faults come as ``path(kind)``; a document without any has an empty list.
"""

from pyspark.sql import Column, DataFrame, functions as F

from threadspark import fixed_values as fv
from threadspark.functions.text import trim
from threadspark.functions.urls import canonical_thread_url, thread_id_from_url
from threadspark.operators.shapes import gathered_issues, shape_issues
from threadspark.shape_library import HISTORY_LEGACY, HISTORY_V3, RECORD

RECORD_FIELDS = (
    "schemaVersion string, id string, threadId string, threadUrl string, replyIds array<string>, decision string, primaryReasonId string,"
    "internalTags array<string>, reviewedAt string, analysisAttemptId string, snapshotId string, findingId string,"
    "analyzerVersions struct<local:string,cloud:string,rules:string>"
)
HISTORY_FIELDS = (
    "attemptId string, snapshotId string, analysisKey string, threadId string, threadUrl string, threadTitle string, provider string, model string,"
    "mode string, analyzerVersion string, rulesVersion string, transportVersion string, startedAt string, completedAt string,"
    "coverage struct<visibleReplyCount:bigint,imageCount:bigint,unavailableReplyCount:bigint>,"
    "usage struct<inputTokens:bigint,outputTokens:bigint,totalTokens:bigint>,"
    "result struct<analyzedReplyCount:bigint,usage:struct<inputTokens:bigint,outputTokens:bigint,totalTokens:bigint>>"
)


def _judged(documents: DataFrame, keys: list[str], issues: DataFrame, own: list[tuple[Column, str]]) -> DataFrame:
    """Adds ``violations``; what the shape already tells of a path is not told again."""
    known = gathered_issues(issues, keys, "_shape")
    none = F.array().cast("array<string>")
    rows = documents.join(known, keys, "left").withColumn("_shape", F.coalesce("_shape", none))
    bad = F.transform("_shape", lambda one: F.regexp_extract(one, r"^(.*)\(", 1))
    found = [
        F.when(F.coalesce(test, F.lit(False)) & ~F.array_contains(bad, F.lit(fault.split("(")[0])), F.lit(fault)) for test, fault in own
    ]
    unread = F.when(F.try_parse_json("json").isNull(), F.array(F.lit("(not_json)")))
    return rows.withColumn("violations", F.coalesce(unread, F.concat("_shape", F.array_compact(F.array(*found))))).drop("_shape")


def read_records(documents: DataFrame, keys: list[str], rules: DataFrame, host: str) -> DataFrame:
    """Decisions from ``keys…, json``: adds ``record`` (its typed fields, addresses in canonical form) and ``violations``."""
    issues = shape_issues(documents, keys, F.try_parse_json("json"), RECORD)
    known = F.broadcast(rules.select(F.col("rule_id").alias("_rule")))  # the rule library has a fixed size
    rows = documents.withColumn("record", F.from_json("json", RECORD_FIELDS))
    rows = rows.join(known, trim(F.col("record.primaryReasonId")) == F.col("_rule"), "left")
    url_thread = thread_id_from_url(trim(F.col("record.threadUrl")), host)
    checks = [
        (F.col("record.primaryReasonId").isNotNull() & F.col("_rule").isNull(), "primaryReasonId(rule)"),
        (F.col("record").isNotNull() & url_thread.isNull(), "threadUrl(address)"),
        (F.col("record.threadId") != url_thread, "threadId(mismatch)"),
        (F.col("record.reviewedAt").isNotNull() & F.col("record.reviewedAt").try_cast("timestamp").isNull(), "reviewedAt(date)"),
    ]
    judged = _judged(rows, keys, issues, checks)
    fixed = F.col("record").withField("threadUrl", canonical_thread_url(trim(F.col("record.threadUrl")), host))
    fixed = fixed.withField("replyIds", F.array_distinct(F.transform("record.replyIds", trim))).withField("internalTags", F.array_distinct("record.internalTags"))
    return judged.withColumn("record", F.when(F.size("violations") == 0, fixed)).drop("_rule")


def _bad_usage(usage: str) -> Column:
    return F.col(usage).isNotNull() & (F.col(f"{usage}.inputTokens") + F.col(f"{usage}.outputTokens") != F.col(f"{usage}.totalTokens"))


def read_history(documents: DataFrame, keys: list[str], host: str) -> DataFrame:
    """History entries of either protocol from ``keys…, json``: adds ``entry`` (its header) and ``violations`` (header and body)."""
    value = F.try_parse_json("json")
    current = F.coalesce(F.try_variant_get(value, "$.result.protocolVersion", "int") == fv.PROTOCOL_VERSION, F.lit(False))
    parts = [shape_issues(documents.filter(test), keys, value, shape) for test, shape in ((current, HISTORY_V3), (~current, HISTORY_LEGACY))]
    rows = documents.withColumn("entry", F.from_json("json", HISTORY_FIELDS))
    url, thread = F.col("entry.threadUrl"), F.col("entry.threadId")
    own_thread = thread_id_from_url(url, host)
    mismatch = ~F.coalesce(own_thread == thread, F.lit(False))
    started, completed = F.col("entry.startedAt").try_cast("timestamp"), F.col("entry.completedAt").try_cast("timestamp")
    checks = [
        (F.col("entry").isNotNull() & mismatch, "threadUrl(mismatch)"),
        (~mismatch & (url != canonical_thread_url(url, host)), "threadUrl(canonical)"),
        (completed < started, "completedAt(before start)"),
        (F.col("entry.result.analyzedReplyCount") > F.col("entry.coverage.visibleReplyCount"), "result.analyzedReplyCount(count)"),
        (_bad_usage("entry.usage"), "usage.totalTokens(sum)"),
        (_bad_usage("entry.result.usage"), "result.usage.totalTokens(sum)"),
    ]
    judged = _judged(rows, keys, parts[0].unionByName(parts[1]), checks)
    return judged.withColumn("entry", F.when(F.size("violations") == 0, F.col("entry")))


def create_records(inputs: DataFrame, host: str, now: Column) -> DataFrame:
    """New decisions from ``thread_id, thread_url, reply_ids, decision, primary_reason_id, internal_tags, analyzer_versions`` and,
    where they have them, ``id`` and ``reviewed_at``: as typed rows and, in ``json``, as the stored text.

    A missing id comes from a digest of the row, so a task that runs again gives the same one; a missing time is ``now``.
    """
    optional = [name for name in ("analysis_attempt_id", "snapshot_id", "finding_id") if name in inputs.columns]
    digest = F.sha2(F.to_json(F.struct(*inputs.columns, now.cast("string").alias("_now"))), 256)
    name = F.concat_ws("-", digest.substr(1, 8), digest.substr(9, 4), F.concat(F.lit("5"), digest.substr(14, 3)), F.concat(F.lit("8"), digest.substr(18, 3)), digest.substr(21, 12))
    given_id = F.col("id") if "id" in inputs.columns else F.lit(None).cast("string")
    given_time = F.col("reviewed_at") if "reviewed_at" in inputs.columns else F.lit(None).cast("timestamp")
    rows = inputs.withColumns({
        "_id": F.coalesce(given_id, name), "_at": F.date_format(F.to_utc_timestamp(F.coalesce(given_time, now), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        "_url": canonical_thread_url(F.col("thread_url"), host),
    })
    fields = {
        "schemaVersion": F.lit(fv.SCHEMA_VERSION), "id": F.col("_id"), "threadId": F.col("thread_id"), "threadUrl": F.col("_url"),
        "replyIds": F.array_distinct("reply_ids"), "decision": F.col("decision"), "primaryReasonId": F.col("primary_reason_id"),
        "internalTags": F.array_distinct("internal_tags"), "reviewedAt": F.col("_at"),
        "analyzerVersions": F.col("analyzer_versions"),
    } | {target: F.col(source) for source, target in (("analysis_attempt_id", "analysisAttemptId"), ("snapshot_id", "snapshotId"), ("finding_id", "findingId")) if source in optional}
    # null must be written where the key is required
    stored = F.to_json(F.struct(*[value.alias(key) for key, value in fields.items()]), {"ignoreNullFields": "false"})
    return rows.select(*[value.alias(key) for key, value in fields.items()], stored.alias("json"))


def history_with_refs(history: DataFrame, refs: DataFrame) -> DataFrame:
    """History rows (``attempt_id, thread_id, …``) with ``reply_refs``: the places of the replies their result cites.

    An entry cites at most what its result names, so its list is bounded by the result.
    """
    one = F.struct(F.col("id"), "floor", F.col("parent_reply_id").alias("parentReplyId"), F.col("is_nested").alias("isNested"), F.col("source_page").alias("sourcePage"))
    gathered = refs.groupBy("attempt_id", "thread_id").agg(F.array_sort(F.collect_set(one)).alias("reply_refs"))
    rows = history.join(gathered, ["attempt_id", "thread_id"], "left")
    return rows.withColumn("reply_refs", F.coalesce("reply_refs", F.array().cast(gathered.schema["reply_refs"].dataType)))
