"""Merging captures, decisions and history; order-preserving sets; coverage of a merged thread."""

from pyspark.sql import Column, DataFrame, functions as F

from threadspark import fixed_values as fv
from threadspark.operators.ordinals import dealt, first_per_key


def merge_key(reply_id: Column, site_reply_id: Column, is_nested: Column) -> Column:
    kind = F.when(is_nested, F.lit("nested")).otherwise(F.lit("main"))
    return F.when(site_reply_id.isNotNull(), F.concat_ws(":", F.lit("site"), kind, site_reply_id)).otherwise(
        F.concat(F.lit("session:"), reply_id)
    )


def surviving_captures(captures: DataFrame) -> DataFrame:
    """Captures that still count for their thread, with ``seq`` (capture order) and merged variant.

    The latest api capture replaces everything.  Without one, the layout of the latest capture wins:
    a dynamic layout keeps the last unbroken run of its document instance, a paginated layout keeps
    the latest capture per page since the layout last changed.  All of it is decided by aggregates.
    """
    seq = F.struct("captured_at", "capture_id")
    rows = captures.withColumn("seq", seq)
    is_api = F.col("parser_variant") == "api"
    facts = rows.groupBy("thread_id").agg(
        F.max(F.when(is_api, F.col("seq"))).alias("last_api"),
        F.max("seq").alias("last_seq"),
        F.max_by("parser_variant", "seq").alias("last_variant"),
        F.max_by("document_instance_id", "seq").alias("last_instance"),
    )
    rows = rows.join(facts, "thread_id")
    spa = F.col("last_variant") == "spa"
    breaks_run = (F.col("parser_variant") != F.col("last_variant")) | (
        spa & ~(F.col("document_instance_id") == F.col("last_instance")).eqNullSafe(F.lit(True))
    )
    breaks = rows.filter(breaks_run).groupBy("thread_id").agg(F.max("seq").alias("last_break"))
    rows = rows.join(breaks, "thread_id", "left")
    after_break = F.col("last_break").isNull() | (F.col("seq") > F.col("last_break"))
    unnamed = spa & F.col("last_instance").isNull()
    keep = F.when(F.col("last_api").isNotNull(), F.col("seq") == F.col("last_api")).when(
        unnamed, F.col("seq") == F.col("last_seq")
    ).otherwise(after_break)
    kept = rows.filter(keep).drop("last_api", "last_seq", "last_instance", "last_break")
    paged = (F.col("parser_variant") == "legacy").cast("int") * F.col("page_number")
    slot = F.when(F.col("parser_variant") == "spa", F.concat(F.lit("spa"), "capture_id")).otherwise(paged.cast("string"))
    return first_per_key(kept.withColumn("slot", slot), ["thread_id", "slot"], F.col("seq"), latest=True)


def merge_captures(captures: DataFrame, capture_replies: DataFrame) -> DataFrame:
    """Reply table of every thread: surviving captures in page and time order, latest reply per key."""
    alive = surviving_captures(captures).select("thread_id", "capture_id", "parser_variant", "page_number", "seq")
    rows = capture_replies.join(alive, ["thread_id", "capture_id"])
    key = merge_key(F.col("id"), F.col("site_reply_id"), F.col("is_nested"))
    page = F.when(F.col("parser_variant") == "legacy", F.col("page_number")).otherwise(F.lit(0))
    order = F.struct(page, F.col("seq"), F.col("pos"))
    merged = first_per_key(rows.withColumn("merge_key", key), ["thread_id", "merge_key"], order, latest=True)
    return merged.drop("parser_variant", "page_number", "seq")


def latest_declared_count(captures: DataFrame, order: Column) -> DataFrame:
    """``thread_id, declared_reply_count``: what the latest capture that tells a count has told."""
    told = F.when(F.col("declared_count").isNotNull(), order)
    return captures.groupBy("thread_id").agg(F.max_by("declared_count", told).alias("declared_reply_count"))


def thread_coverage(replies: DataFrame, captures: DataFrame) -> DataFrame:
    """Counts and completeness of every thread from its merged replies and surviving captures.

    ``captures`` holds ``thread_id, parser_variant, page_number, seq, reached_end, may_remain,
    is_complete, declared_count``.
    """
    nested = F.col("is_nested")
    unstable = F.col("site_reply_id").isNull()
    counts = replies.groupBy("thread_id").agg(
        F.count("*").alias("visible_reply_count"),
        F.count_if(~nested).alias("main_reply_count"),
        F.count_if(nested).alias("nested_reply_count"),
        F.sum("image_count").alias("image_count"),
        F.sum(F.when(~nested, F.col("unexpanded_nested_count")).otherwise(0)).alias("unexpanded_nested_count"),
        F.count_if(unstable).alias("unstable_all"),
        F.count_if(unstable & nested).alias("unstable_nested"),
    )
    declared = F.col("declared_count").isNotNull()
    order = F.struct("page_number", "seq")
    pages = captures.groupBy("thread_id").agg(
        F.max_by("parser_variant", "seq").alias("variant"),
        F.array_sort(F.collect_set("page_number")).alias("page_numbers"),
        F.bool_or("reached_end").alias("any_end"),
        F.max_by("reached_end", order).alias("last_end"),
        F.bool_or("may_remain").alias("any_remaining"),
        F.bool_and("is_complete").alias("all_complete"),
        F.max_by("is_complete", order).alias("last_complete"),
        F.max_by("declared_count", F.when(declared, order)).alias("declared_reply_count"),
    )
    spa, api = F.col("variant") == "spa", F.col("variant") == "api"
    end = F.when(spa | api, F.col("last_end")).otherwise(F.col("any_end"))
    return counts.join(pages, "thread_id").select(
        "thread_id",
        F.when(spa, "dynamic").when(api, "api").otherwise("paginated").alias("capture_mode"),
        "visible_reply_count", "main_reply_count", "nested_reply_count", "image_count", "unexpanded_nested_count",
        "page_numbers", (F.col("image_count") > 0).alias("has_unanalyzed_images"), "declared_reply_count",
        F.when(spa, ~end).otherwise(F.col("any_remaining")).alias("dynamic_content_may_remain"),
        end.alias("reached_reply_list_end"),
        F.when(api, F.col("unstable_all")).otherwise(F.col("unstable_nested")).alias("unstable_reply_id_count"),
        F.when(spa, F.lit(False)).when(api, F.col("last_complete")).otherwise(F.col("all_complete")).alias("is_complete"),
    )


def capture_warnings(coverage: DataFrame) -> DataFrame:
    """Aggregate warnings as rows ``thread_id, code, count``; recomputed, never accumulated."""
    items = F.array(
        F.struct(F.lit("unexpanded_nested").alias("code"), F.col("unexpanded_nested_count").cast("bigint").alias("n")),
        F.struct(F.lit("unread_images").alias("code"), F.col("image_count").cast("bigint").alias("n")),
        F.struct(F.lit("unstable_ids").alias("code"), F.col("unstable_reply_id_count").cast("bigint").alias("n")),
    )
    rows = coverage.select("thread_id", F.explode(items).alias("i"))
    return rows.filter(F.col("i.n") > 0).select("thread_id", "i.code", F.col("i.n").alias("count"))


# --- ledgers merged by key -------------------------------------------------------------------


def merge_review_records(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Latest decision per id; equal times take the incoming one; repeated ids and tags removed."""
    both = existing.withColumn("_source", F.lit(0)).unionByName(incoming.withColumn("_source", F.lit(1)))
    merged = first_per_key(both, ["id"], F.struct("reviewed_at", "_source"), latest=True).drop("_source")
    return merged.withColumns(
        {"reply_ids": F.array_distinct("reply_ids"), "internal_tags": F.array_distinct("internal_tags")}
    )


def merge_history(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, refused): attempts whose identity columns disagree are refused as a whole."""
    both = existing.withColumn("_source", F.lit(0)).unionByName(incoming.withColumn("_source", F.lit(1)))
    # A null is a value here, so it is told apart from every text before hashing.
    identity = F.sha2(F.to_json(F.struct(*fv.HISTORY_IDENTITY), {"ignoreNullFields": "false"}), 256)
    # Two numbers of 60 bits, which an aggregate holds in place, so nothing is sorted for it; one exchange serves all steps.
    halves = [F.conv(F.substring(identity, start, 15), 16, 10).cast("bigint").alias(f"_half{start}") for start in (1, 16)]
    rows = dealt(both.select("*", *halves), ["attempt_id"])
    conflicts = rows.groupBy("attempt_id").agg(F.expr("min(_half1) != max(_half1) OR min(_half16) != max(_half16)").alias("conflict"))
    conflicts = conflicts.filter("conflict").select("attempt_id")
    sound = rows.join(conflicts, "attempt_id", "left_anti").drop("_half1", "_half16")
    merged = first_per_key(sound, ["attempt_id"], F.struct("completed_at", "_source"), latest=True)
    return merged.drop("_source"), rows.join(conflicts, "attempt_id", "left_semi").drop("_source", "_half1", "_half16")


def latest_per(df: DataFrame, key: str, order: Column) -> DataFrame:
    return first_per_key(df, [key], order, latest=True)


def newest(df: DataFrame, order: list[Column], limit: int | None = None) -> DataFrame:
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def id_rows(requested: DataFrame, accepted: DataFrame) -> DataFrame:
    """Each distinct id of ``requested`` (thread_id, id) as a row with kind ``shared`` or ``missing``: the sets for any number of ids.

    Dealt by thread and id, so a large thread is no single task. Null ids are left out.
    """
    mine = requested.where(F.col("id").isNotNull()).select("thread_id", "id").distinct()
    other = accepted.where(F.col("id").isNotNull()).select(F.col("thread_id").alias("_thread"), F.col("id").alias("_id")).distinct()
    found = mine.join(other, F.col("thread_id").eqNullSafe(F.col("_thread")) & (F.col("id") == F.col("_id")), "left")
    return found.select("thread_id", "id", F.when(F.col("_id").isNull(), "missing").otherwise("shared").alias("kind"))


def missing_ids(requested: Column, accepted: Column) -> Column:
    return F.array_except(requested, accepted)


def shared_ids(requested: Column, accepted: Column) -> Column:
    return F.array_intersect(requested, accepted)
