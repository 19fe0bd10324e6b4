"""Identities, attempts, billing receipts, usage and human decisions."""

from pyspark.sql import Column, DataFrame, functions as F

from threadspark import fixed_values as fv
from threadspark.functions.text import canonical_text, normalize_mode, trim
from threadspark.functions.urls import canonical_thread_url, normalize_endpoint, thread_id_from_url
from threadspark.operators.ordinals import first_per_key, ordered_number, previous_value

DIGEST_WIDTH = 1024
DIGEST_LEVELS = 4


def snapshot_ids(replies: DataFrame, titles: DataFrame) -> DataFrame:
    """``thread_id, snapshot_id``: content digest of the title and the ordered replies.

    Row digests are combined in blocks of 1024 by position, level by level, so no thread is gathered
    into one row.  Equal content in equal order gives equal ids.
    """
    row = F.struct(
        F.coalesce("site_reply_id", "id").alias("id"), "parent_reply_id", "floor",
        canonical_text(F.col("author_name")).alias("author"), "timestamp_ms",
        canonical_text(F.col("content")).alias("content"), "image_count", "is_nested", "unexpanded_nested_count",
    )
    level = replies.select(
        "thread_id", F.col("pos").alias("n"),
        F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256).alias("digest"),
    )
    for _ in range(DIGEST_LEVELS):
        level = (
            level.groupBy("thread_id", F.floor(F.col("n") / DIGEST_WIDTH).alias("n"))
            .agg(F.array_sort(F.collect_list(F.struct("n", "digest"))).alias("items"))
            .select("thread_id", "n", F.sha2(F.array_join(F.transform("items", lambda i: i["digest"]), ","), 256).alias("digest"))
        )
    title = F.coalesce(canonical_text(F.col("title")), F.lit(""))
    return level.join(titles, "thread_id", "left").select(
        "thread_id", F.sha2(F.to_json(F.struct(title.alias("title"), "digest")), 256).alias("snapshot_id")
    )


def analysis_key(snapshot_id, provider, endpoint, model, mode, analyzer, rules, transport) -> Column:
    parts = [snapshot_id, provider, normalize_endpoint(endpoint), trim(model), normalize_mode(mode), analyzer, rules, transport]
    return F.sha2(F.to_json(F.array(*parts)), 256)


def attempt_violations(attempts: DataFrame) -> DataFrame:
    """Adds ``violations``: broken invariants of the attempt state machine."""
    status = F.col("status")
    unsent = status.isin(fv.UNSENT_STATUSES)
    open_ = status.isin("preparing", "running")
    ok = status == "success"
    has_error = F.col("error_category").isNotNull()
    valid_error = F.col("error_category").isin(fv.ERROR_CATEGORIES) & F.length("error_code").between(1, 80)
    checks = [
        (~status.isin(fv.ATTEMPT_STATUSES) | status.isNull(), "status"),
        (~F.coalesce(F.col("attempt_id").rlike(fv.ATTEMPT_ID), F.lit(False)), "attempt_id"),
        (F.col("started_at").isNull() | F.col("updated_at").isNull(), "times"),
        (unsent & (F.col("sent_at").isNotNull() | F.col("deadline_at").isNotNull()), "sent_before_send"),
        (~unsent & (F.col("sent_at").isNull() | F.col("deadline_at").isNull()), "sent_missing"),
        (open_ & (F.col("completed_at").isNotNull()), "completed_while_open"),
        (~open_ & F.col("completed_at").isNull(), "completed_missing"),
        ((open_ | ok) & has_error, "unexpected_error"),
        (~open_ & ~ok & ~F.coalesce(valid_error, F.lit(False)), "error_missing"),
        (ok & ~F.col("has_result"), "result_missing"),
        (~ok & F.col("has_result"), "unexpected_result"),
    ]
    return attempts.withColumn(
        "violations", F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in checks]))
    )


def receipt_status(status: Column, error_code: Column) -> Column:
    return (
        F.when(status == "preparing", F.lit("preparing"))
        .when(status.isin("failed_before_send", "cancelled_before_send"), F.lit("failed_before_send"))
        .when(status == "success", F.lit("success"))
        .when(error_code == "history_deleted", F.lit("history_deleted"))
        .otherwise(F.lit("sent"))
    )


def receipts_from_attempts(attempts: DataFrame) -> DataFrame:
    state = receipt_status(F.col("status"), F.col("error_code"))
    sent = F.when(~state.isin("preparing", "failed_before_send"), F.col("sent_at"))
    return attempts.select(
        "snapshot_id", "attempt_id", "analysis_key", state.alias("receipt_status"), "started_at", "updated_at", sent.alias("sent_at")
    )


def blocks_new_request(receipt_state: Column) -> Column:
    return F.coalesce(receipt_state != "failed_before_send", F.lit(False))


def needs_paid_confirmation(sent_at: Column) -> Column:
    return sent_at.isNotNull()


def claim_attempts(claims: DataFrame, receipts: DataFrame) -> DataFrame:
    """Which claims are granted: ``granted`` and the ``holder`` that blocks the others.

    ``claims`` holds ``snapshot_id, attempt_id, claimed_at, force``.  A forced claim always wins and
    replaces the holder; the first other claim wins when no receipt blocks.  Claims of one snapshot are
    settled by an as-of look-back over blocks of their claim order, so a hot snapshot is split.
    """
    blocking = receipts.filter(blocks_new_request(F.col("receipt_status"))).select(
        "snapshot_id", F.col("attempt_id").alias("receipt_holder")
    )
    order = [F.col("claimed_at").asc(), F.col("attempt_id").asc()]
    numbered = ordered_number(claims, ["snapshot_id"], order, "claim_no").join(blocking, "snapshot_id", "left")
    first_or_forced = F.col("force") | ((F.col("claim_no") == 1) & F.col("receipt_holder").isNull())
    settled = previous_value(
        numbered, ["snapshot_id"], "claim_no", F.when(first_or_forced, F.col("attempt_id")), "earlier"
    )
    return settled.select(
        "snapshot_id", "attempt_id", "claimed_at", "force",
        first_or_forced.alias("granted"),
        F.when(~first_or_forced, F.coalesce("earlier", "receipt_holder")).alias("holder"),
    )


def latest_attempt_for_snapshot(attempts: DataFrame) -> DataFrame:
    live = attempts.filter(F.col("status").isin("preparing", "success") | F.col("sent_at").isNotNull())
    newest = live.groupBy("snapshot_id").agg(F.max("updated_at").alias("updated_at"))
    return first_per_key(live.join(newest, ["snapshot_id", "updated_at"]), ["snapshot_id"], F.col("attempt_id"))


def expire_attempts(attempts: DataFrame, now: Column) -> DataFrame:
    """Legacy pending attempts become unknown; the deadline follows from the start and the mode."""
    pending = F.col("status") == "pending"
    timeout = F.when(normalize_mode(F.col("mode")) == "deep", fv.TIMEOUT_MS["deep"]).otherwise(fv.TIMEOUT_MS["fast"])
    deadline = F.timestamp_millis(F.unix_millis("started_at") + timeout)
    changes = {
        "sent_at": F.when(pending, F.col("started_at")).otherwise(F.col("sent_at")),
        "deadline_at": F.when(pending, deadline).otherwise(F.col("deadline_at")),
        "completed_at": F.when(pending, now).otherwise(F.col("completed_at")),
        "updated_at": F.when(pending, now).otherwise(F.col("updated_at")),
        "error_category": F.when(pending, F.lit("disconnect")).otherwise(F.col("error_category")),
        "error_code": F.when(pending, F.lit("legacy_pending_unknown")).otherwise(F.col("error_code")),
        "status": F.when(pending, F.lit("unknown_after_disconnect")).otherwise(F.col("status")),
    }
    return attempts.withColumns(changes)


def reuse_result(wanted: DataFrame, history: DataFrame) -> DataFrame:
    """For every wanted ``(snapshot_id, analysis_key)``: the exact result, else the snapshot's newest."""
    columns = F.struct("completed_at", "attempt_id")
    exact = history.groupBy("analysis_key").agg(F.max(columns)["attempt_id"].alias("exact_attempt"))
    broad = history.groupBy("snapshot_id").agg(F.max(columns)["attempt_id"].alias("snapshot_attempt"))
    return (
        wanted.join(exact, "analysis_key", "left")
        .join(broad, "snapshot_id", "left")
        .withColumn("attempt_id", F.coalesce("exact_attempt", "snapshot_attempt"))
        .withColumn(
            "match",
            F.when(F.col("exact_attempt").isNotNull(), "exact").when(F.col("snapshot_attempt").isNotNull(), "snapshot").otherwise("none"),
        )
        .drop("exact_attempt", "snapshot_attempt")
    )


def current_snapshot_only(operations: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applicable, stale) operations by thread and snapshot version."""
    keys = ["thread_id", "version"]
    known = current.select(*keys)
    return operations.join(known, keys, "left_semi"), operations.join(known, keys, "left_anti")


def valid_usage(input_tokens: Column, output_tokens: Column, total_tokens: Column) -> Column:
    """True for whole counts in range whose sum is the reported total, or no total reported."""
    def count(value):
        number = value.try_cast("bigint")
        return F.when(number.between(0, fv.MAX_REPORTED_TOKENS), number)

    total = count(input_tokens) + count(output_tokens)
    reported = total_tokens.isNull() | F.coalesce(count(total_tokens) == total, F.lit(False))
    return F.coalesce((total <= fv.MAX_REPORTED_TOKENS) & reported, F.lit(False))


def reported_usage(usage_json: Column) -> Column:
    """Token counts of a provider's usage object under either set of field names; null unless they are whole and add up."""
    def count(*names):
        found = F.coalesce(*[F.try_variant_get(F.try_parse_json(usage_json), f"$.{name}", "variant") for name in names])
        whole = F.schema_of_variant(found) == "BIGINT"
        return F.when(whole, F.try_variant_get(found, "$", "bigint"))

    def given(name):
        return F.get_json_object(usage_json, f"$.{name}")

    sent, received = count("prompt_tokens", "input_tokens"), count("completion_tokens", "output_tokens")
    total = F.when(given("total_tokens").isNotNull(), F.coalesce(count("total_tokens"), F.lit(-1)))
    counts = F.struct(sent.alias("input_tokens"), received.alias("output_tokens"), (sent + received).alias("total_tokens"))
    return F.when(valid_usage(sent, received, total), counts)


def monthly_usage(usage: DataFrame) -> DataFrame:
    ok = valid_usage(F.col("input_tokens"), F.col("output_tokens"), F.col("total_tokens"))
    return (
        usage.filter(ok)
        .groupBy(F.date_format("called_at", "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"),
             F.sum("output_tokens").alias("output_tokens"), F.sum("total_tokens").alias("total_tokens"))
    )


def newest_usage(usage: DataFrame, limit: int | None = None) -> DataFrame:
    """Calls without repeated attempts, newest first; ``limit`` keeps the newest so many."""
    ok = valid_usage(F.col("input_tokens"), F.col("output_tokens"), F.col("total_tokens"))
    latest = first_per_key(usage.filter(ok), ["attempt_id"], F.col("called_at"), latest=True)
    ordered = latest.orderBy(F.desc("called_at"), "attempt_id")
    return ordered if limit is None else ordered.limit(limit)


# --- decisions and history -------------------------------------------------------------------


def link_decisions(decisions: DataFrame, history: DataFrame) -> DataFrame:
    """Adds ``linked``: the decision names an attempt, its snapshot and thread, and one of its findings.

    ``history`` holds ``attempt_id, snapshot_id, thread_id, finding_ids``.
    """
    known = history.select(
        F.col("attempt_id").alias("analysis_attempt_id"), F.col("snapshot_id").alias("_snapshot"),
        F.col("thread_id").alias("_thread"), F.col("finding_ids").alias("_findings"),
    )
    names_finding = F.col("finding_id").isNull() | (F.col("finding_id") == "") | F.array_contains("_findings", F.col("finding_id"))
    linked = (
        F.col("snapshot_id").eqNullSafe(F.col("_snapshot")) & F.col("thread_id").eqNullSafe(F.col("_thread")) & names_finding
    )
    joined = decisions.join(known, "analysis_attempt_id", "left")
    return joined.withColumn("linked", F.coalesce(linked & F.col("_thread").isNotNull(), F.lit(False))).drop("_snapshot", "_thread", "_findings")


def decision_violations(decisions: DataFrame) -> DataFrame:
    """Adds ``violations`` of the rules for storing a decision."""
    checks = [
        (F.col("decision") == "undecided", "undecided"),
        (~F.col("decision").isin(fv.DECISIONS), "decision"),
        ((F.col("finding_count") > 0) & F.col("finding_id").isNull(), "finding_required"),
        ((F.col("decision") == "delete") & F.col("reason_id").isNull(), "rule_required"),
    ]
    return decisions.withColumns(
        {
            "violations": F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in checks])),
            "primary_reason_id": F.when(F.col("decision") == "delete", F.col("reason_id")),
            "internal_tags": F.when(F.col("finding_id").isNotNull(), F.array("risk_type", "severity")).otherwise(F.array().cast("array<string>")),
        }
    )


def _longer(column: str, bound: int | None) -> Column:
    return F.lit(False) if bound is None else F.size(column) > bound


def record_violations(
    records: DataFrame, rules: DataFrame, host: str, max_reply_ids: int | None = None, max_tags: int | None = None
) -> DataFrame:
    """Adds ``violations`` of a stored decision's shape; rule ids are checked against the library.

    Longer lists than the given bounds are violations; without bounds any length is fine.
    """
    known = rules.select(F.col("rule_id").alias("primary_reason_id"), F.lit(True).alias("_known"))
    # The library is small whatever the records are; most records may name one rule, which must not become one task.
    rows = records.join(F.broadcast(known), "primary_reason_id", "left")
    url_thread = thread_id_from_url(F.col("thread_url"), host)

    def missing(column, pattern):
        return F.col(column).isNotNull() & ~trim(F.col(column)).rlike(pattern)

    tags = fv.ALL_RISK_TYPES + fv.SEVERITIES
    checks = [
        (F.col("schema_version") != fv.SCHEMA_VERSION, "schema_version"),
        (~trim(F.col("id")).rlike(fv.RECORD_ID), "id"),
        (missing("thread_id", "^[0-9]{1,30}$"), "thread_id"),
        (url_thread.isNull(), "thread_url"),
        (F.col("thread_id") != url_thread, "thread_mismatch"),
        (F.exists("reply_ids", lambda r: ~trim(r).rlike(fv.REPLY_ID)) | _longer("reply_ids", max_reply_ids), "reply_ids"),
        (~F.col("decision").isin(fv.DECISIONS), "decision"),
        (F.col("primary_reason_id").isNotNull() & F.col("_known").isNull(), "primary_reason_id"),
        (F.exists("internal_tags", lambda t: ~t.isin(tags)) | _longer("internal_tags", max_tags), "internal_tags"),
        (F.col("reviewed_at").isNull(), "reviewed_at"),
        (missing("analysis_attempt_id", fv.ATTEMPT_ID), "analysis_attempt_id"),
        (missing("snapshot_id", fv.DIGEST), "snapshot_id"),
        (missing("finding_id", fv.FINDING_ID), "finding_id"),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in checks]))
    return rows.withColumn("violations", found).drop("_known")


def history_violations(history: DataFrame, host: str) -> DataFrame:
    """Adds ``violations`` of a history row's header fields."""
    control = r"[\x00-\x1F\x7F]"
    checks = [
        (~F.col("attempt_id").rlike(fv.ATTEMPT_ID), "attempt_id"),
        (~F.col("snapshot_id").rlike(fv.DIGEST), "snapshot_id"),
        (~F.col("analysis_key").rlike(fv.DIGEST), "analysis_key"),
        (~F.coalesce(thread_id_from_url(F.col("thread_url"), host) == F.col("thread_id"), F.lit(False)), "thread_mismatch"),
        (F.col("thread_url") != canonical_thread_url(F.col("thread_url"), host), "thread_url"),
        (~F.length(trim(F.col("thread_title"))).between(1, 300) | F.col("thread_title").rlike(control), "thread_title"),
        (~F.length(trim(F.col("model"))).between(1, 160) | F.col("model").rlike(control), "model"),
        (~F.col("mode").isin("fast", "deep"), "mode"),
        (~F.col("rules_version").rlike(fv.VERSION_TAG), "rules_version"),
        (F.col("completed_at") < F.col("started_at"), "completed_before_start"),
        (F.col("analyzed_reply_count") > F.col("visible_reply_count"), "analyzed_count"),
        (~valid_usage(F.col("input_tokens"), F.col("output_tokens"), F.col("total_tokens")), "usage"),
    ]
    return history.withColumn(
        "violations", F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in checks]))
    )


def storage_budget(entries: DataFrame, key: Column, body: Column, max_bytes: int | None = None,
                   max_entries: int | None = None) -> DataFrame:
    """Bytes and entries per ledger (``ledger_id``) and whether the batch fits the given budget."""
    within = F.lit(True)
    if max_entries is not None:
        within &= F.col("entries") <= max_entries
    if max_bytes is not None:
        within &= (F.col("bytes") <= max_bytes) & (F.col("largest") <= max_bytes)
    size = F.octet_length(key) + F.octet_length(body)
    return entries.groupBy("ledger_id").agg(
        F.count("*").alias("entries"), F.sum(size).alias("bytes"), F.max(F.octet_length(body)).cast("bigint").alias("largest")
    ).withColumn("accepted", within)
