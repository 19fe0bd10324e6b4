"""Captured JSON pages: one row per page body in, reply rows, parents, counters and rejects out."""

from pyspark.sql import Column, DataFrame, functions as F

from threadspark import fixed_values as fv
from threadspark.functions.text import (
    blank_to_null, clean_text, epoch_ms, flatten_content, iso_time, safe_count, safe_int, trim, valid_reply_id,
)
from threadspark.operators.ordinals import first_per_key
from threadspark.session import cut_lineage

AUTHOR = "struct<id:string,name:string,name_show:string,show_name:string>"
# Content and preview lists come in more than one shape, so they are kept as JSON text first.
POST = (
    "struct<id:string,spid:string,tid:string,title:string,author_id:string,author:" + AUTHOR
    + ",floor:string,post_no:string,time:string,content:string,sub_post_number:string,sub_post_list:string>"
)
PAGE = (
    "error_code string, no string, thread struct<id:string,tid:string,title:string,reply_num:string>,"
    "forum struct<id:string>, display_forum struct<id:string>,"
    "page struct<current_page:string,total_page:string,has_more:string>,"
    f"first_floor {POST}, post_list array<{POST}>, user_list array<{AUTHOR}>"
)
PARTS = "array<struct<type:string,text:string,c:string,origin_src:string,cdn_src:string>>"
KEY = ["thread_id", "page"]


def _first_text(*values: Column) -> Column:
    return F.coalesce(*[blank_to_null(v) for v in values])


def _positive(value: Column, fallback: Column) -> Column:
    return F.coalesce(safe_int(value), fallback.cast("bigint"))


def parse_bodies(raw_pages: DataFrame) -> DataFrame:
    """Parses ``thread_id, page, body`` and adds page facts and ``error_code`` (null when usable)."""
    doc = F.from_json("body", PAGE)
    rows = raw_pages.withColumn("doc", doc).withColumn("is_json", F.try_parse_json("body").isNotNull())
    first = F.when(F.col("doc.first_floor.id").isNotNull() | F.col("doc.first_floor.spid").isNotNull() | F.col("doc.first_floor.content").isNotNull(), F.col("doc.first_floor"))
    rows = rows.withColumns(
        {
            "response_thread": _first_text(F.col("doc.thread.id"), F.col("doc.thread.tid"), F.col("doc.first_floor.tid")),
            "forum_id": blank_to_null(F.coalesce("doc.forum.id", "doc.display_forum.id")),
            "current_page": _positive(F.col("doc.page.current_page"), F.col("page")),
            "declared_count": F.when(safe_int(F.col("doc.thread.reply_num")) >= 0, safe_int(F.col("doc.thread.reply_num"))),
            "title": clean_text(F.coalesce("doc.thread.title", "doc.first_floor.title")),
            "remote_code": F.coalesce("doc.error_code", "doc.no"),
        }
    )
    rows = rows.withColumn("total_pages", _positive(F.col("doc.page.total_page"), F.col("current_page")))
    posts = F.coalesce("doc.post_list", F.array().cast(f"array<{POST}>"))
    rows = rows.withColumn(
        "mains", F.when((F.col("current_page") == 1) & first.isNotNull(), F.concat(F.array(first), posts)).otherwise(posts)
    )
    more = F.lower(trim(F.col("doc.page.has_more")))
    has_more = (
        F.when(more.isin("true", "false"), more == "true")
        .when(safe_int(more).isNotNull(), safe_int(more) != 0)
        .otherwise(F.col("current_page") < F.col("total_pages"))
    )

    def bad_id(value):
        return ~F.coalesce(value.rlike("^[0-9]{1,32}$"), F.lit(False))

    in_range = F.col("current_page").between(1, fv.MAX_PAGE_NUMBER) & F.col("total_pages").between(1, fv.MAX_PAGE_NUMBER)
    error = (
        F.when(F.coalesce(trim(F.col("body")), F.lit("")) == "", "empty_body")
        .when(~F.col("is_json"), "not_json")
        .when(~F.coalesce(F.col("remote_code").isin("0", "None"), F.lit(True)), "remote_error")
        .when(bad_id(F.col("response_thread")), "no_thread_id")
        .when(F.col("response_thread") != F.col("thread_id"), "thread_mismatch")
        .when(bad_id(F.col("forum_id")), "no_forum_id")
        .when(~in_range, "page_out_of_range")
        .when(F.col("total_pages") < F.col("current_page"), "page_contradiction")
        .when(F.col("current_page") != F.col("page"), "page_mismatch")
        .when(~F.exists("mains", lambda m: valid_reply_id(F.coalesce(m["id"], m["spid"])).isNotNull()), "no_replies")
    )
    return rows.withColumn("has_more", has_more).withColumn("error_code", error).drop("is_json", "response_thread", "remote_code")


def split_bad_pages(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable pages, rejected pages with their error code).  Bodies are parsed once and written."""
    parsed = cut_lineage(parsed)
    bad = parsed.filter(F.col("error_code").isNotNull()).select(*KEY, "error_code", "body")
    return parsed.filter(F.col("error_code").isNull()), bad


def page_nodes(good: DataFrame) -> DataFrame:
    """Every main reply and nested preview of a page as one row, in page order."""
    mains = good.select(*KEY, F.col("doc.user_list").alias("users"), F.posexplode("mains").alias("main_no", "main"))
    listed = F.col("main.sub_post_list")
    previews = F.when(listed.startswith("["), F.from_json(listed, f"array<{POST}>")).when(
        listed.startswith("{"), F.from_json(listed, f"sub_post_list array<{POST}>")["sub_post_list"]
    )
    rows = mains.withColumn("main_id", valid_reply_id(F.coalesce("main.id", "main.spid"))).withColumn("previews", previews)
    nodes = F.concat(F.array("main"), F.coalesce("previews", F.array().cast(f"array<{POST}>")))
    rows = rows.select(
        *KEY, "users", "main_no", "main_id", safe_int(F.coalesce("main.floor", "main.post_no")).alias("main_floor"),
        safe_count(F.col("main.sub_post_number")).alias("declared"), F.posexplode(nodes).alias("sub_no", "node"),
    )
    nested = F.col("sub_no") > 0
    content = F.col("node.content")
    text, images = flatten_content(F.from_json(F.when(content.startswith("["), content), PARTS))
    user = F.try_element_at(F.filter("users", lambda u: u["id"] == F.col("node.author_id")), F.lit(-1))
    stamp = epoch_ms(F.col("node.time"))
    return rows.select(
        *KEY, "main_no", "sub_no", "declared", "main_id", nested.alias("is_nested"),
        valid_reply_id(F.coalesce("node.id", "node.spid")).alias("id"),
        F.when(nested, F.col("main_id")).alias("parent_reply_id"),
        F.when(F.col("main_floor") > 0, F.col("main_floor")).cast("int").alias("floor"),
        _first_text(user["name_show"], user["show_name"], user["name"], F.col("node.author.name_show"), F.col("node.author.show_name"), F.col("node.author.name")).alias("author_name"),
        F.when(stamp.isNotNull(), iso_time(stamp)).otherwise(blank_to_null(F.col("node.time"))).alias("time"),
        stamp.alias("timestamp_ms"),
        F.when(content.startswith("["), text).otherwise(clean_text(content)).alias("content"),
        F.when(content.startswith("["), images).otherwise(0).alias("image_count"),
    )


def read_thread_pages(good: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(replies, nested parents, page rows with the four diagnostic counters).

    A main without a valid id makes itself and its previews unparsed; so do previews under a main
    whose id was already taken by a preview.  Repeated ids of a page are returned once.
    """
    # Parsed once and written: replies, parents and counters all read these rows.
    nodes = cut_lineage(page_nodes(good))
    usable = nodes.filter(F.col("id").isNotNull() & F.col("main_id").isNotNull())
    place = F.struct("main_no", "sub_no")
    taken = usable.groupBy(*KEY, F.col("id").alias("main_id")).agg(F.min_by("is_nested", place).alias("main_id_taken"))
    usable = usable.join(taken, [*KEY, "main_id"], "left")
    stable = usable.filter(~(F.col("is_nested") & F.coalesce("main_id_taken", F.lit(False)))).drop("main_id_taken")
    replies = first_per_key(stable, [*KEY, "id"], place)
    raw = nodes.groupBy(*KEY).agg(F.count("*").alias("raw_count"))
    # One (page, id) group is a single id, so the distinct count needs no expand step.
    per_id = stable.groupBy(*KEY, "id").agg(F.count("*").alias("times"))
    counted = per_id.groupBy(*KEY).agg(F.sum("times").alias("stable_count"), F.sum(F.col("times") - 1).alias("duplicate_count"))
    pages = (
        good.select(*KEY, "current_page", "total_pages", "has_more", "declared_count", "title", "forum_id")
        .join(raw, KEY, "left")
        .join(counted, KEY, "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ["raw_count", "stable_count", "duplicate_count"]})
        .withColumn("unparsed_count", F.col("raw_count") - F.col("stable_count"))
    )
    shown = replies.filter("is_nested").groupBy(*KEY, F.col("parent_reply_id").alias("parent_id")).agg(F.count("*").alias("preview_count"))
    mains = stable.filter(~F.col("is_nested")).groupBy(*KEY, F.col("id").alias("parent_id")).agg(
        F.max("declared").alias("declared"), F.first("floor", ignorenulls=True).alias("parent_floor")
    )
    parents = (
        mains.join(shown, [*KEY, "parent_id"], "left")
        .withColumn("preview_count", F.coalesce("preview_count", F.lit(0)))
        .withColumn("declared_count", F.greatest("declared", "preview_count"))
        .filter(F.col("declared_count") > 0)
        .drop("declared")
    )
    unexpanded = parents.select(*KEY, F.col("parent_id").alias("id"), (F.col("declared_count") - F.col("preview_count")).cast("int").alias("unexpanded_nested_count"))
    replies = replies.join(unexpanded, [*KEY, "id"], "left").withColumn(
        "unexpanded_nested_count", F.when(F.col("is_nested"), 0).otherwise(F.coalesce("unexpanded_nested_count", F.lit(0)))
    )
    return replies.drop("main_id", "declared"), parents, pages
