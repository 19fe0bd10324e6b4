"""Redacted request payloads: aliases, wire ids, name removal, leak check and size gate."""

import json

from pyspark.sql import Column, DataFrame, functions as F

from threadspark import fixed_values as fv
from threadspark.functions.privacy import contains_sensitive, redact_sensitive, redact_unknown_names
from threadspark.functions.text import blank_to_null, estimate_tokens, squeeze
from threadspark.operators.ordinals import dense_number
from threadspark.operators.relations import context_replies, reply_edges
from threadspark.operators.skew import skew_join
from threadspark.session import cut_lineage
from threadspark.rule_library import RULE_LIBRARY, RULES_VERSION

MARK = "\x00"


def wire_ids(replies: DataFrame) -> DataFrame:
    """Adds ``wire_no``, ``wire_id`` (``P1`` …) and the parent's wire id, null outside the set."""
    numbered = dense_number(replies, ["thread_id"], "pos", "wire_no")
    numbered = numbered.withColumn("wire_id", F.concat(F.lit("P"), "wire_no"))
    parents = numbered.select(
        "thread_id", F.col("id").alias("parent_reply_id"), F.col("wire_id").alias("parent_wire_id")
    )
    # Main replies have no parent: they share no join key, so they stay out of the join.
    has_parent = F.col("parent_reply_id").isNotNull()
    answers = numbered.filter(has_parent).join(parents, ["thread_id", "parent_reply_id"], "left")
    return answers.unionByName(numbered.filter(~has_parent), allowMissingColumns=True)


def minute_offset(replies: DataFrame) -> DataFrame:
    first = replies.groupBy("thread_id").agg(F.min("timestamp_ms").alias("_first"))
    minutes = F.round((F.col("timestamp_ms") - F.col("_first")) / 60_000).cast("bigint")
    return (
        skew_join(replies, first, ["thread_id"], ["id"])
        .withColumn("minute_offset", F.when(minutes.isNotNull(), F.greatest(F.lit(0), minutes)))
        .drop("_first")
    )


def author_aliases(replies: DataFrame) -> DataFrame:
    """``thread_id, name, alias``: ``U1``, ``U2`` … by first appearance."""
    first = (
        replies.select("thread_id", blank_to_null(F.col("author_name")).alias("name"), "pos")
        .filter(F.col("name").isNotNull())
        .groupBy("thread_id", "name")
        .agg(F.min("pos").alias("first_pos"))
    )
    numbered = dense_number(first, ["thread_id"], "first_pos", "alias_no")
    return numbered.select("thread_id", "name", F.concat(F.lit("U"), "alias_no").alias("alias"))


# --- names inside texts ----------------------------------------------------------------------


def mark_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``marked`` (each known name replaced by NUL) and ``aliases`` (one per NUL, in order).

    ``texts`` holds ``thread_id, id, text`` and more; ``names`` holds ``thread_id, name, alias``.  A place in a
    text is a candidate where the first character and the length of some name of the thread fit; candidates
    meet the names in an equi-join, for any number of names.  Hits of one text are taken left to right,
    longest first, skipping overlaps.
    """
    head = F.substring("name", 1, 1)
    heads = names.filter(F.length("name") > 0).groupBy("thread_id", head.alias("head")).agg(F.collect_set(F.length("name")).alias("lengths"))
    # At most one entry per character of the thread's names.
    heads = heads.groupBy("thread_id").agg(F.map_from_entries(F.collect_list(F.struct("head", "lengths"))).alias("heads"))
    letters = F.split("text", "")
    places = skew_join(texts.select("thread_id", "id", "text").filter(F.length("text") > 0), heads, ["thread_id"], ["id"]).withColumn("letters", letters)
    starts = F.filter(F.sequence(F.lit(1), F.size("letters")), lambda k: F.map_contains_key("heads", F.element_at("letters", k)))
    started = places.select("thread_id", "id", "letters", "heads", F.explode(starts).alias("start"))
    sized = started.select("thread_id", "id", "letters", "start", F.explode(F.element_at("heads", F.element_at("letters", F.col("start")))).alias("size"))
    candidates = sized.filter(F.col("start") + F.col("size") - 1 <= F.size("letters")).select(
        "thread_id", "id", "start", "size", F.array_join(F.slice("letters", F.col("start"), F.col("size")), "").alias("name")
    )
    candidates = cut_lineage(candidates)  # written once: the join looks at its heavy keys first
    found = (
        skew_join(candidates, names, ["thread_id", "name"], ["id", "start"])
        .groupBy("thread_id", "id")
        .agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("size")).alias("order"), "size", "alias"))).alias("hits"))
    )
    rows = texts.join(found, ["thread_id", "id"], "left")
    state = F.struct(F.lit(1).alias("next"), F.lit("").alias("marked"), F.array().cast("array<string>").alias("aliases"))

    def take(acc, hit):
        between = F.substring(F.col("text"), acc["next"], hit["start"] - acc["next"])
        taken = F.struct(
            (hit["start"] + hit["size"]).alias("next"),
            F.concat(acc["marked"], between, F.lit(MARK)).alias("marked"),
            F.concat(acc["aliases"], F.array(hit["alias"])).alias("aliases"),
        )
        return F.when(hit["start"] >= acc["next"], taken).otherwise(acc)

    walked = F.aggregate(F.coalesce("hits", F.array().cast(found.schema["hits"].dataType)), state, take)
    rest = F.substring("text", F.col("walked.next"), F.length("text"))
    return rows.withColumn("walked", walked).select(
        *texts.columns, F.concat("walked.marked", rest).alias("marked"), F.col("walked.aliases").alias("aliases")
    )


def _restore(marked: Column, aliases: Column) -> Column:
    pieces = F.split(marked, r"\x00", -1)
    return F.array_join(F.zip_with(pieces, aliases, lambda p, a: F.concat(p, F.coalesce(a, F.lit("")))), "")


def redact_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``redacted``: personal data, known names and unknown mentions removed from ``text``."""
    safe = F.replace(redact_sensitive(F.col("text")), F.lit(MARK), F.lit(""))
    marked = mark_names(texts.withColumn("text", safe), names)
    restored = _restore(redact_unknown_names(F.col("marked")), F.col("aliases"))
    return marked.withColumn("redacted", redact_sensitive(restored)).drop("marked", "aliases", "text")


def leak_guard(redacted: DataFrame, names: DataFrame) -> DataFrame:
    """``thread_id, leaking`` : replies whose redacted text still holds personal data or a name (≥ 2)."""
    worth = names.filter(F.length("name") >= 2).select("thread_id", "name", F.lit("x").alias("alias"))
    checked = mark_names(
        redacted.select("thread_id", "id", F.col("redacted").alias("text")), worth
    )
    bad = contains_sensitive(F.col("text")) | (F.size("aliases") > 0)
    return checked.groupBy("thread_id").agg(F.count_if(bad).alias("leaking"))


def redacted_replies(replies: DataFrame) -> DataFrame:
    """Replies with ``author_alias`` and ``redacted`` content."""
    names = author_aliases(replies)
    texts = replies.select("thread_id", "id", F.col("content").alias("text"))
    content = redact_names(texts, names)
    alias = names.select("thread_id", F.col("name").alias("_name"), F.col("alias").alias("_alias"))
    with_alias = (
        replies.withColumn("_name", blank_to_null(F.col("author_name")))
        .join(alias, ["thread_id", "_name"], "left")
        .withColumn("author_alias", F.coalesce("_alias", F.lit("U0")))
        .drop("_name", "_alias")
    )
    return with_alias.join(content, ["thread_id", "id"])


# --- payloads --------------------------------------------------------------------------------


def rules_json() -> str:
    return json.dumps(
        [
            {"id": f"{key}.{i:02d}", "category": title, "text": text}
            for key, (title, texts) in RULE_LIBRARY.items()
            for i, text in enumerate(texts, 1)
        ],
        ensure_ascii=False,
        separators=(",", ":"),
    )


def _json_text(value: Column) -> Column:
    return F.substring(F.to_json(F.struct(value.alias("v"))), 6, 2_000_000_000)


def build_thread_payloads(
    replies: DataFrame, titles: DataFrame, max_bytes: int = fv.MAX_PAYLOAD_BYTES, max_tokens: int = fv.MAX_PAYLOAD_TOKENS
) -> DataFrame:
    """One payload per thread: ``thread_id, status, reply_count, payload, bytes, tokens``.

    ``titles`` holds ``thread_id, title``.  Threads that leak or exceed the size limit are reported
    with a status and no payload; nothing is ever cut.  Replies are gathered into one row only for
    threads whose contents already passed the byte limit, so that row is bounded by the limit.
    """
    # Redacted replies are read five times below and are worth keeping: written once.
    names = cut_lineage(author_aliases(replies))
    clean = cut_lineage(redacted_replies(replies))
    heading = redact_names(titles.select("thread_id", F.lit("title").alias("id"), F.col("title").alias("text")), names)
    leaks = leak_guard(
        clean.select("thread_id", "id", "redacted").unionByName(heading.select("thread_id", "id", "redacted")), names
    )
    sizes = clean.groupBy("thread_id").agg(
        F.count("*").alias("reply_count"),
        F.sum("image_count").alias("images"),
        # Every reply costs at least its text and the fixed field names around it.
        F.sum(F.octet_length("redacted") + 120).alias("least_bytes"),
    )
    gate = sizes.join(leaks, "thread_id", "left").select(
        "thread_id", "reply_count", "images",
        F.when(F.col("leaking") > 0, F.lit("privacy_guard"))
        .when(F.col("least_bytes") > max_bytes, F.lit("payload_too_large"))
        .otherwise(F.lit("ok"))
        .alias("gate"),
    )
    gate = cut_lineage(gate)
    passed = gate.filter(F.col("gate") == "ok").select("thread_id")
    wired = minute_offset(wire_ids(clean)).join(passed, "thread_id", "left_semi")
    numbers = wired.select("thread_id", F.col("id").alias("dst"), "wire_no")
    related = (
        reply_edges(replies)
        .join(passed, "thread_id", "left_semi")
        .join(numbers, ["thread_id", "dst"])
        .groupBy("thread_id", F.col("src").alias("id"))
        .agg(F.transform(F.array_sort(F.collect_set("wire_no")), lambda n: F.concat(F.lit("P"), n)).alias("related"))
    )
    body = F.to_json(
        F.struct(
            F.col("wire_id").alias("id"), "floor", F.col("parent_wire_id").alias("parentReplyId"),
            F.coalesce("related", F.array().cast("array<string>")).alias("relatedReplyIds"),
            F.col("author_alias").alias("authorAlias"), F.col("minute_offset").alias("minuteOffset"),
            F.col("redacted").alias("content"), F.col("is_nested").alias("isNested"),
        ),
        {"ignoreNullFields": "false"},
    )
    bodies = (
        wired.join(related, ["thread_id", "id"], "left")
        .select("thread_id", F.struct("wire_no", body.alias("body")).alias("item"))
        .groupBy("thread_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda i: i["body"]), ",").alias("bodies"))
    )
    notes = F.concat_ws(
        ",",
        *[F.lit(json.dumps(text, ensure_ascii=False)) for text in fv.LIMITATIONS],
        F.when(F.col("images") > 0, F.concat(F.lit('"共 '), "images", F.lit(' 张图片未发送且未识别。"'))),
    )
    payload = F.concat(
        F.lit(f'{{"schemaVersion":"{fv.SCHEMA_VERSION}","analyzerVersion":"{fv.CLOUD_ANALYZER_VERSION}","rulesVersion":"{RULES_VERSION}","threadTitle":'),
        F.rtrim(F.regexp_replace(_json_text(F.coalesce("title_redacted", F.lit(""))), r"\}$", "")),
        F.lit(',"replies":['), "bodies", F.lit('],"rules":'), F.lit(rules_json()), F.lit(',"limitations":['), notes, F.lit("]}"),
    )
    built = (
        gate.join(bodies, "thread_id", "left")
        .join(heading.select("thread_id", F.col("redacted").alias("title_redacted")), "thread_id", "left")
        .withColumn("payload", F.when(F.col("gate") == "ok", payload))
        .withColumn("bytes", F.octet_length("payload").cast("bigint"))
        .withColumn("tokens", estimate_tokens(F.col("payload")))
    )
    too_large = (F.col("bytes") > max_bytes) | (F.col("tokens") > max_tokens)
    status = F.when(too_large, F.lit("payload_too_large")).otherwise(F.col("gate"))
    return built.select(
        "thread_id", status.alias("status"), "reply_count",
        F.when(status == "ok", F.col("payload")).alias("payload"), "bytes", "tokens",
    )


def allowed_reasons(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidate reasons (``selection_id, reason_id, rank``) that exist in the library, first one kept."""
    first = candidates.groupBy("selection_id", "reason_id").agg(F.min("rank").alias("rank"))
    known = rules.select(F.col("rule_id").alias("reason_id"), F.col("text").alias("reason_text"))
    return first.join(known, "reason_id")


def finding_requests(payload_rows: DataFrame, reasons: DataFrame) -> DataFrame:
    """One row per selected finding: its reply count and its allowed reasons, best first.

    ``reasons`` comes from ``allowed_reasons``; a finding has as many as its own candidates.
    """
    listed = reasons.groupBy("selection_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("reason_id").alias("id"), F.col("reason_text").alias("text")))).alias("allowed_reasons")
    )
    sizes = payload_rows.groupBy("selection_id", "thread_id").agg(F.count("*").alias("reply_count"))
    none = F.array().cast(listed.schema["allowed_reasons"].dataType)
    return sizes.join(listed, "selection_id", "left").withColumn("allowed_reasons", F.coalesce("allowed_reasons", none))


def build_finding_payloads(replies: DataFrame, selection: DataFrame, radius: int = 1, max_replies: int | None = None) -> DataFrame:
    """Redacted replies sent for one selected finding: the selection and its bounded context.

    Aliases count authors inside the payload; names seen elsewhere in the thread are removed as well.
    """
    chosen = context_replies(replies, selection, radius, max_replies)
    rows = chosen.join(replies, ["thread_id", "id"])
    scoped = rows.withColumn("_scope", F.col("thread_id")).withColumn("thread_id", F.concat_ws("/", "selection_id", "thread_id"))
    own = author_aliases(scoped)
    # Names stay keyed by thread; each selection only brings the aliases of its own authors.
    known = replies.select("thread_id", blank_to_null(F.col("author_name")).alias("name")).filter(F.col("name").isNotNull()).distinct()
    safe = F.replace(redact_sensitive(F.col("content")), F.lit(MARK), F.lit(""))
    texts = scoped.select(F.col("_scope").alias("thread_id"), F.struct(F.col("thread_id").alias("scope"), "id").alias("id"), safe.alias("text"))
    marked = mark_names(texts, known.withColumn("alias", F.col("name")))
    mapped = own.groupBy("thread_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "alias"))).alias("by_name"))
    marked = marked.select(F.col("id.scope").alias("thread_id"), F.col("id.id").alias("id"), "marked", "aliases").join(mapped, "thread_id", "left")
    aliases = F.transform("aliases", lambda name: F.coalesce(F.try_element_at("by_name", name), F.lit(fv.NAME_PLACEHOLDER)))
    restored = _restore(redact_unknown_names(F.col("marked")), aliases)
    content = marked.select("thread_id", "id", redact_sensitive(restored).alias("redacted"))
    alias = own.select("thread_id", F.col("name").alias("_name"), F.col("alias").alias("_alias"))
    return (
        scoped.withColumn("_name", blank_to_null(F.col("author_name")))
        .join(alias, ["thread_id", "_name"], "left")
        .join(content, ["thread_id", "id"])
        .select(
            "selection_id", F.col("_scope").alias("thread_id"), "id", "pos", "is_selected", "floor", "parent_reply_id",
            F.coalesce("_alias", F.lit("U0")).alias("author_alias"), "image_count", "redacted",
        )
    )


def preflight_summary(payload_rows: DataFrame, endpoint: Column) -> DataFrame:
    """Counts behind each finding payload, with the endpoint's host."""
    return payload_rows.groupBy("selection_id", "thread_id").agg(
        F.count("*").alias("reply_count"),
        F.count_if("is_selected").alias("selected_reply_count"),
        F.sum("image_count").alias("omitted_image_count"),
        F.first(F.try_parse_url(endpoint, F.lit("HOST"))).alias("hostname"),
    )


def history_title(title: Column, thread_id: Column) -> Column:
    text = F.substring(squeeze(title), 1, 300)
    return F.when(text == "", F.concat(F.lit("帖子 "), thread_id)).otherwise(text)
