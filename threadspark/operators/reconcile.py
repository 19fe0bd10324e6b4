"""Completeness of a captured thread: page frontier, nested page reconciliation and the verdict.

Page and parent rows are summaries; reply ids take part only in counts by (parent, id).
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadspark import fixed_values as fv
from threadspark.operators.ordinals import previous_value

PARENT = ["thread_id", "parent_id"]


def page_frontier(pages: DataFrame, limit: int = fv.READ_LIMITS["main_pages"]) -> DataFrame:
    """``thread_id, pages_fetched, pages_total, truncated`` over every fetched page."""
    reach = F.greatest("total_pages", F.col("current_page") + F.col("has_more").cast("int"))
    return pages.groupBy("thread_id").agg(
        F.count_distinct("page").alias("pages_fetched"), F.max(reach).alias("pages_total")
    ).withColumn("truncated", F.col("pages_total") > limit)


def page_gaps(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """``thread_id, first_page, last_page``: runs of pages that the frontier expects but nobody fetched.

    A gap is one row, whatever number of pages a page claims; ``limit`` leaves out pages past it.
    """
    fetched = pages.select("thread_id", F.col("page").cast("bigint").alias("page")).filter("page >= 1").distinct()
    looked = previous_value(fetched, ["thread_id"], "page", F.col("page"), "before")
    inner = looked.select("thread_id", (F.coalesce("before", F.lit(0)) + 1).alias("first_page"), (F.col("page") - 1).alias("last_page"))
    reached = fetched.groupBy("thread_id").agg(F.max("page").alias("reached"))
    tail = page_frontier(pages).join(reached, "thread_id", "left").select(
        "thread_id", (F.coalesce("reached", F.lit(0)) + 1).alias("first_page"), F.col("pages_total").cast("bigint").alias("last_page")
    )
    total = page_frontier(pages).select("thread_id", F.col("pages_total").cast("bigint").alias("pages_total"))
    # pages past the frontier are fetched, so a gap before them may end past it
    gaps = inner.filter("first_page <= last_page").join(total, "thread_id").withColumn("last_page", F.least("last_page", "pages_total")).drop("pages_total").unionByName(tail)
    if limit is not None:
        gaps = gaps.withColumn("last_page", F.least("last_page", F.lit(limit)))
    return gaps.filter("first_page <= last_page")


def missing_pages(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """``thread_id, page``: the pages of the gaps, one row each."""
    numbers = F.explode(F.sequence(F.col("first_page").cast("int"), F.col("last_page").cast("int")))
    return page_gaps(pages, limit).select("thread_id", numbers.alias("page"))


def page_diagnostics(pages: DataFrame, page_replies: DataFrame) -> DataFrame:
    """Summed counters per thread, broken counter identities and ids repeated across pages."""
    returned = page_replies.groupBy("thread_id", "page").agg(F.count("*").alias("returned"))
    checked = pages.join(returned, ["thread_id", "page"], "left").withColumn("returned", F.coalesce("returned", F.lit(0)))
    mismatch = (F.col("raw_count") != F.col("stable_count") + F.col("unparsed_count")) | (
        F.col("stable_count") != F.col("returned") + F.col("duplicate_count")
    )
    sums = checked.groupBy("thread_id").agg(
        F.sum("raw_count").alias("raw_count"), F.sum("stable_count").alias("stable_count"),
        F.sum("duplicate_count").alias("duplicate_count"), F.sum("unparsed_count").alias("unparsed_count"),
        F.count_if(mismatch).alias("mismatch_pages"), F.count_if(F.col("declared_count").isNull()).alias("undeclared_pages"),
        F.max("declared_count").alias("declared_count"),
    )
    across = (
        page_replies.groupBy("thread_id", "id").agg(F.count("*").alias("times"))
        .groupBy("thread_id").agg(F.sum(F.col("times") - 1).alias("cross_page_duplicates"))
    )
    rows = sums.join(across, "thread_id", "left").withColumn("cross_page_duplicates", F.coalesce("cross_page_duplicates", F.lit(0)))
    return rows.withColumn(
        "main_diagnostic_count",
        F.greatest(
            "unparsed_count", F.col("duplicate_count") + F.col("cross_page_duplicates"), "mismatch_pages", "undeclared_pages",
            F.abs(F.col("raw_count") - F.col("stable_count") - F.col("unparsed_count")),
        ),
    )


def merge_parents(parents: DataFrame) -> DataFrame:
    """One row per parent over all pages: highest declared count and the latest known floor."""
    return parents.groupBy(*PARENT).agg(
        F.max("declared_count").alias("declared_count"),
        F.max_by("parent_floor", F.when(F.col("parent_floor").isNotNull(), F.col("page"))).alias("parent_floor"),
    )


def preview_ids(page_replies: DataFrame) -> DataFrame:
    return page_replies.filter("is_nested").select("thread_id", F.col("parent_reply_id").alias("parent_id"), "id").distinct()


def preview_satisfied(parents: DataFrame, previews: DataFrame) -> DataFrame:
    """Adds ``preview_count`` and ``satisfied``: the previews already cover the declared count."""
    counts = previews.groupBy(*PARENT).agg(F.count("*").alias("preview_count"))
    return (
        parents.join(counts, PARENT, "left")
        .withColumn("preview_count", F.coalesce("preview_count", F.lit(0)))
        .withColumn("satisfied", F.col("preview_count") >= F.col("declared_count"))
    )


def nested_reconcile(
    parents: DataFrame, nested_pages: DataFrame, nested_replies: DataFrame, failed: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """State of every parent after its nested pages (``parents`` from ``preview_satisfied``).

    Pages count while they are consecutive from 1 and up to the first known end.  With a ``limit``, page
    rows past it are not read and mark the parent truncated; without one every page counts.
    """
    probes = nested_pages.filter("is_probe").select(*PARENT, F.col("page").alias("probe_page"), "is_empty_sentinel")
    ordered = Window.partitionBy(*PARENT).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*PARENT).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*PARENT).orderBy("page").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known_end = ~F.col("has_more") & (F.col("current_page") >= F.col("total_pages"))
    read = nested_pages.filter(~F.col("is_probe") & (F.col("page") >= 1) & (F.lit(True) if limit is None else F.col("page") <= limit)).withColumn("known_end", known_end)
    trusted_facts = F.when(F.col("has_trusted_pager"), F.struct("total_num", "total_pages"))
    read = (
        read.withColumn("place", F.count("*").over(ordered))
        .withColumn("ended_before", F.coalesce(F.bool_or("known_end").over(before), F.lit(False)))
        .filter((F.col("place") == F.col("page")) & ~F.col("ended_before"))
        .withColumn("first_flag", F.first("has_trusted_pager", ignorenulls=True).over(whole))
        .withColumn("first_facts", F.first(trusted_facts, ignorenulls=True).over(whole))
    )
    drift = (F.col("has_trusted_pager") != F.col("first_flag")) | (
        F.col("has_trusted_pager") & (F.struct("total_num", "total_pages") != F.col("first_facts"))
    )
    counters = ["raw_count", "stable_count", "duplicate_count", "unparsed_count", "unknown_count"]
    usable = nested_replies.join(read.select(*PARENT, "page"), [*PARENT, "page"], "left_semi")
    returned = usable.groupBy(*PARENT, "page").agg(F.count_distinct("id").alias("returned"), F.count("*").alias("listed"))
    read = read.join(returned, [*PARENT, "page"], "left").withColumns(
        {"returned": F.coalesce("returned", F.lit(0)), "listed": F.coalesce("listed", F.lit(0))}
    )
    broken = (
        F.col("total_num").isNull() | F.col("total_pages").isNull() | (F.col("current_page") != F.col("page"))
        | (F.col("current_page") > F.col("total_pages")) | F.col("has_trusted_pager").isNull()
        | (F.col("raw_count") != F.col("stable_count") + F.col("unparsed_count"))
        | (F.col("stable_count") != F.col("returned") + F.col("duplicate_count"))
    )
    per_parent = read.groupBy(*PARENT).agg(
        F.count("*").alias("pages_fetched"), F.max("total_num").alias("available_count"), F.max("total_pages").alias("pages_expected"),
        F.bool_or("known_end").alias("reached_end"), F.max_by("has_trusted_pager", "page").alias("last_trusted"),
        F.max_by("total_pages", "page").alias("last_total_pages"),
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counters],
        F.sum(F.col("listed") - F.col("returned")).alias("listed_twice"),
        F.count_if(F.coalesce(drift, F.lit(False))).alias("drift_count"),
        F.count_if(F.coalesce(broken, F.lit(True))).alias("mismatch_count"),
    )
    per_id = usable.groupBy(*PARENT, "id").agg(F.count_distinct("page").alias("pages"))
    distinct = per_id.groupBy(*PARENT).agg(F.count("*").alias("distinct_count"), F.sum(F.col("pages") - 1).alias("cross_duplicates"))
    state = parents.join(per_parent, PARENT, "left").join(distinct, PARENT, "left").join(probes, PARENT, "left")
    numbers = [*counters, "listed_twice", "drift_count", "mismatch_count", "distinct_count", "cross_duplicates", "pages_fetched"]
    state = state.withColumns({c: F.when(F.col("satisfied"), F.lit(0)).otherwise(F.coalesce(c, F.lit(0))) for c in numbers})
    if failed is not None:
        state = state.join(failed.select(*PARENT).distinct().withColumn("failed", F.lit(True)), PARENT, "left")
    else:
        state = state.withColumn("failed", F.lit(False))
    sat = F.col("satisfied")
    state = (
        state.withColumn("failed", ~sat & F.coalesce("failed", F.lit(False)))
        .withColumn("duplicate_count", F.col("duplicate_count") + F.col("listed_twice") + F.col("cross_duplicates"))
        .withColumn("distinct_count", F.when(sat, F.col("preview_count")).otherwise(F.col("distinct_count")))
        .withColumn("reached_end", sat | F.coalesce("reached_end", F.lit(False)))
        .withColumn("available_count", F.when(sat, F.col("declared_count")).otherwise(F.col("available_count")))
    )
    gap = F.greatest(F.lit(0), F.coalesce("available_count", F.lit(0)) - F.col("distinct_count"))
    clean = (
        F.col("last_trusted") & (F.col("unparsed_count") == 0) & (F.col("duplicate_count") == 0) & (F.col("unknown_count") == 0)
        & (F.col("drift_count") == 0) & (F.col("mismatch_count") == 0) & (F.col("stable_count") == F.col("distinct_count"))
    )
    verified = (
        F.col("reached_end") & (gap > 0) & clean & F.coalesce("is_empty_sentinel", F.lit(False))
        & (F.col("probe_page") == F.col("last_total_pages") + 1)
    )
    # Totals over all pages must add up too; checked after the end so that it cannot hide a gap test.
    uneven = ~sat & (F.col("stable_count") - F.col("duplicate_count") != F.col("distinct_count"))
    return (
        state.withColumn("terminal_gap", F.when(F.col("reached_end"), gap).otherwise(0))
        .withColumn("gap_verified", F.coalesce(verified, F.lit(False)))
        .withColumn("mismatch_count", F.col("mismatch_count") + uneven.cast("int"))
        .withColumn("truncated", ~sat & ((~F.col("reached_end") & ~F.col("failed")) | (F.lit(False) if limit is None else F.coalesce(F.col("pages_expected") > limit, F.lit(False)))))
        .select(
            *PARENT, "declared_count", "parent_floor", "preview_count", "satisfied", "pages_fetched", "available_count", "distinct_count",
            "unparsed_count", "unknown_count", "duplicate_count", "drift_count", "mismatch_count", "reached_end", "failed", "truncated",
            "terminal_gap", "gap_verified",
        )
    )


def drop_stale_previews(page_replies: DataFrame, states: DataFrame, nested_replies: DataFrame) -> DataFrame:
    """Page replies without previews that a complete nested read no longer returns."""
    settled = states.filter(~F.col("satisfied") & F.col("reached_end") & ~F.col("failed") & ~F.col("truncated"))
    settled = settled.select("thread_id", F.col("parent_id").alias("parent_reply_id"))
    current = nested_replies.select("thread_id", F.col("parent_id").alias("parent_reply_id"), "id")
    stale = (
        page_replies.filter("is_nested").select("thread_id", "parent_reply_id", "id").distinct()
        .join(settled, ["thread_id", "parent_reply_id"], "left_semi")
        .join(current, ["thread_id", "parent_reply_id", "id"], "left_anti")
        .withColumn("is_nested", F.lit(True))
    )
    return page_replies.join(stale, ["thread_id", "parent_reply_id", "id", "is_nested"], "left_anti")


def diagnostic_count() -> Column:
    unverified = F.when(~F.col("gap_verified"), F.col("terminal_gap")).otherwise(0)
    return F.greatest(
        F.col("unparsed_count") + F.col("unknown_count"),
        F.col("duplicate_count") + F.col("drift_count") + F.col("mismatch_count"), unverified,
    )


def parent_unresolved(states: DataFrame, fetched: DataFrame) -> DataFrame:
    """Adds ``fetched``, ``shortfall``, ``stable_terminal`` and ``unresolved`` per parent.

    ``fetched`` holds ``thread_id, parent_id, fetched``: nested replies finally kept.
    """
    rows = states.join(fetched, PARENT, "left").withColumn("fetched", F.coalesce("fetched", F.lit(0)))
    declared = F.greatest("declared_count", F.coalesce("available_count", F.lit(0)))
    rows = rows.withColumn("shortfall", F.greatest(F.lit(0), declared - F.col("fetched"))).withColumn("diagnostics", diagnostic_count())
    stable = F.col("reached_end") & ~F.col("failed") & ~F.col("truncated") & (F.col("diagnostics") == 0)
    rows = rows.withColumn("stable_terminal", stable)
    return rows.withColumn("unresolved", F.when(F.col("stable_terminal"), 0).otherwise(F.greatest("shortfall", "diagnostics")))


def completeness(frontier: DataFrame, diagnostics: DataFrame, parents: DataFrame, replies: DataFrame, failures: DataFrame) -> DataFrame:
    """The verdict per thread.  Shortfalls are summed per parent, so a surplus cannot hide a gap.

    ``failures`` holds ``thread_id, failed_requests``; ``replies`` are the rows finally kept.
    """
    got = replies.groupBy("thread_id").agg(F.count("*").alias("reply_count"), F.sum("image_count").alias("image_count"))
    nested = parents.groupBy("thread_id").agg(
        F.sum("unresolved").alias("unresolved"), F.sum("shortfall").alias("declared_shortfall"),
        F.count("*").alias("parents_total"), F.count_if((F.col("pages_fetched") > 0) | F.col("satisfied")).alias("parents_fetched"),
        F.bool_and(F.col("reached_end") & ~F.col("failed") & ~F.col("truncated")).alias("nested_complete"),
        *[F.sum(c).alias(f"nested_{c}") for c in ["unparsed_count", "unknown_count", "duplicate_count", "drift_count", "mismatch_count"]],
        F.count_if(~F.col("gap_verified") & (F.col("terminal_gap") > 0)).alias("unverified_gaps"),
        F.sum(F.when(F.col("stable_terminal") & ~F.col("satisfied") & F.col("gap_verified"), F.greatest(F.lit(0), F.coalesce("available_count", "fetched") - F.col("fetched"))).otherwise(0)).alias("endpoint_shortfall"),
        F.sum(F.when(F.col("stable_terminal"), F.greatest(F.lit(0), F.col("declared_count") - F.greatest(F.coalesce("available_count", "fetched"), F.col("fetched")))).otherwise(0)).alias("stale_shortfall"),
    )
    rows = (
        frontier.join(diagnostics, "thread_id", "left").join(nested, "thread_id", "left").join(got, "thread_id", "left").join(failures, "thread_id", "left")
    )
    counts = [c for c, kind in rows.dtypes if kind in ("bigint", "int") and c not in ("declared_count",)]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    rows = rows.withColumn("nested_complete", F.coalesce("nested_complete", F.lit(True)))
    readable = (
        ~F.col("truncated") & (F.col("pages_fetched") == F.col("pages_total")) & F.col("nested_complete") & (F.col("failed_requests") == 0)
        & (F.col("main_diagnostic_count") == 0) & (F.col("unresolved") == 0)
    )
    shortfall = F.greatest("unresolved", "declared_shortfall")
    unavailable = F.greatest(shortfall, F.coalesce(F.col("declared_count") + 1 - F.col("reply_count"), F.lit(0)))
    return (
        rows.withColumn("readable_text_complete", readable)
        .withColumn("nested_shortfall", shortfall)
        .withColumn("unavailable", unavailable)
        .withColumn("is_complete", F.col("readable_text_complete") & (F.col("unavailable") == 0) & (F.col("image_count") == 0))
    )


def capture_issues(verdict: DataFrame) -> DataFrame:
    """Warnings as rows ``thread_id, code, count``."""
    structural = F.greatest(
        F.col("nested_unparsed_count") + F.col("nested_unknown_count"),
        F.col("nested_duplicate_count") + F.col("nested_drift_count") + F.col("nested_mismatch_count"),
    )
    issues = {
        "undeclared_pages": F.col("undeclared_pages"), "main_unparsed": F.col("unparsed_count"), "main_duplicates": F.col("duplicate_count"),
        "cross_page_duplicates": F.col("cross_page_duplicates"), "main_mismatch_pages": F.col("mismatch_pages"),
        "endpoint_shortfall": F.col("endpoint_shortfall"), "stale_shortfall": F.col("stale_shortfall"),
        "unresolved_nested": F.greatest(F.lit(0), F.col("unresolved") - structural), "nested_unparsed": F.col("nested_unparsed_count"),
        "nested_duplicates": F.col("nested_duplicate_count"), "nested_unknown": F.col("nested_unknown_count"),
        "nested_drift": F.col("nested_drift_count"), "nested_mismatch": F.col("nested_mismatch_count"), "unverified_gaps": F.col("unverified_gaps"),
        "unavailable": F.when(F.col("unavailable") > F.col("nested_shortfall"), F.col("unavailable")).otherwise(0), "images": F.col("image_count"),
    }
    rows = F.array(*[F.struct(F.lit(code).alias("code"), n.cast("bigint").alias("n")) for code, n in issues.items()])
    return verdict.select("thread_id", F.explode(rows).alias("i")).filter(F.col("i.n") > 0).select("thread_id", "i.code", F.col("i.n").alias("count"))


def capture_diagnosis(verdict: DataFrame) -> DataFrame:
    """Blocking reason (first that applies), its title, the number of nodes that could not be read for sure, and the scope of
    every thread: its label, and what a complete text leaves out (``scope_note``, null if nothing)."""
    structure = (
        F.col("unparsed_count") + F.col("duplicate_count") + F.col("cross_page_duplicates") + F.col("mismatch_pages")
        + F.col("nested_unparsed_count") + F.col("nested_duplicate_count") + F.col("nested_unknown_count")
        + F.col("nested_drift_count") + F.col("nested_mismatch_count") + F.col("unverified_gaps")
    )
    done = F.col("readable_text_complete")
    reason = (
        F.when(done, F.lit(None).cast("string"))
        .when(F.col("truncated"), "limit_reached")
        .when(F.col("pages_total") > F.col("pages_fetched"), "missing_pages")
        .when(F.col("failed_requests") > 0, "failed_requests")
        .when(F.col("parents_total") > F.col("parents_fetched"), "missing_parents")
        .when(structure > 0, "structure")
        .otherwise("unverified")
    )
    scope = F.when(F.col("is_complete"), "complete").when(done, "text_complete").otherwise("partial")
    def told(template: str, count: Column) -> Column:
        head, tail = template.split("%d")
        return F.concat(F.lit(head), count.cast("string"), F.lit(tail))

    counts = {
        "missing_pages": F.col("pages_total") - F.col("pages_fetched"), "failed_requests": F.col("failed_requests"),
        "missing_parents": F.col("parents_total") - F.col("parents_fetched"), "structure": structure,
    }
    title = F.lit(fv.DIAGNOSIS_TITLES["done"])
    for code, text in fv.DIAGNOSIS_TITLES.items():
        title = F.when(reason == code, told(text, counts[code]) if code in counts else F.lit(text)).otherwise(title)
    exclusions = F.array_compact(F.array(*[F.when(F.col(name) > 0, told(text, F.col(name))) for name, text in fv.SCOPE_EXCLUSIONS.items()]))
    head, tail = fv.SCOPE_NOTE.split("%s")
    note = F.when(done & (F.size(exclusions) > 0), F.concat(F.lit(head), F.array_join(exclusions, "，"), F.lit(tail)))
    return verdict.select(
        "thread_id", (~done).alias("blocking"), reason.alias("reason"), title.alias("title"), F.when(~done, structure).cast("bigint").alias("structure_count"),
        scope.alias("scope"), note.alias("scope_note"), "unavailable", "image_count",
    )
