"""Captured HTML pages: a small parsing step emits flat element rows; all semantics are DataFrame code."""

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadspark.functions.text import blank_to_null, clean_text, declared_count, extract_time_text, removal_notice, safe_int, unexpanded_estimate
from threadspark.operators.ordinals import dense_number, first_per_key

# Class names of the captured layouts.
MAIN_CLASSES = ["l_post", "pb-comment-item", "image-text", "score-thread", "recruit-thread"]
NESTED_CLASSES = ["lzl_single_post", "pb-lzl-item"]
FIRST_FLOOR_CLASSES = ["image-text", "score-thread", "recruit-thread"]
CONTENT_CLASSES = ["d_post_content", "j_d_post_content", "lzl_content_main", "j_lzl_content", "lzl_content", "pb-rich-text"]
AUTHOR_CLASSES = ["p_author_name", "j_user_card", "d_name", "head-name", "user-name"]
TIME_CLASSES = ["lzl_time", "tail-info", "comment-desc-left"]
MORE_CLASSES = ["lzl_more", "j_lzl_more", "j_lzl_m_w", "lzl_link_unfold", "show-more-lzl"]
PAGER_CLASSES = ["l_pager", "pager", "pb_list_pager"]
TITLE_CLASSES = ["core_title_txt", "pc-pb-title"]
REPLY_TOP_CLASSES = ["pc-pb-reply-top"]
NESTED_PAGER_CLASS = "lzl_li_pager"
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ELEMENTS = (
    "page_id string, node_no int, tag string, element_id string, classes array<string>, attributes map<string,string>,"
    " text string, main_no int, reply_no int"
)

# Elements, and characters of their pages, of one frame.
FRAME_ROWS, FRAME_CHARS = 4_096, 4_000_000

COLUMNS = ["page_id", "node_no", "tag", "element_id", "classes", "attributes", "text", "main_no", "reply_no"]


# What a text can be part of, by class or tag of the element around it.
FIELD_KINDS = {
    "main": set(MAIN_CLASSES), "nested": set(NESTED_CLASSES), "content": {*CONTENT_CLASSES, "lzl_content_main", "j_lzl_content", "lzl_content"},
    "author": set(AUTHOR_CLASSES), "time": {*TIME_CLASSES, "time"}, "more": set(MORE_CLASSES), "title": {*TITLE_CLASSES, "h1", "title"},
    "pager": set(PAGER_CLASSES), "top": set(REPLY_TOP_CLASSES),
}


class _Elements(HTMLParser):
    """Elements in document order with their text and the reply containers around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open = [], []

    def handle_starttag(self, tag, attrs):
        attributes = {k: v or "" for k, v in attrs}
        classes = attributes.get("class", "").split()
        main, reply = (self.open[-1]["main_no"], self.open[-1]["reply_no"]) if self.open else (None, None)
        number = len(self.rows)
        if any(c in classes for c in MAIN_CLASSES):
            main = reply = number
        elif any(c in classes for c in NESTED_CLASSES):
            reply = number
        row = {
            "node_no": number, "tag": tag, "element_id": attributes.get("id"), "classes": classes,
            "attributes": attributes, "text": [], "main_no": main, "reply_no": reply,
            "kinds": {kind for kind, names in FIELD_KINDS.items() if tag in names or any(c in names for c in classes)},
        }
        if (attributes.get("id") or "").startswith("post_content_"):
            row["kinds"].add("content")
        self.rows.append(row)
        if tag not in VOID_TAGS:
            self.open.append(row)

    def handle_endtag(self, tag):
        if any(row["tag"] == tag for row in self.open):
            while self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        if self.open and self.open[-1]["tag"] in ("script", "style"):
            return
        # Only elements that a field can be read from keep their text: for each kind of field the innermost
        # open one, so what a page yields grows with the page however deep its elements are nested.
        told = set()
        for row in reversed(self.open):
            if new := row["kinds"] - told:
                told |= new
                row["text"].append(data)


def _element_frame(rows):
    frame = pd.DataFrame(rows, columns=COLUMNS)
    for name in ("main_no", "reply_no"):
        frame[name] = frame[name].astype("Int32")
    return frame


def _parse_batches(batches):
    """Elements go out in frames of bounded size: a batch holds as many pages as Spark likes, each with thousands of elements."""
    for batch in batches:
        out, chars = [], 0
        for page_id, html in zip(batch["page_id"], batch["html"]):
            parser = _Elements()
            parser.feed(html or "")
            parser.close()
            # Every page has a row, even one without any marked element.
            out.append((str(page_id), -1, "#page", None, [], {}, "", None, None))
            for row in parser.rows:
                if row["classes"] or row["attributes"] or row["tag"] in ("title", "h1", "html"):
                    out.append((str(page_id), row["node_no"], row["tag"], row["element_id"], row["classes"], row["attributes"], "".join(row["text"]), row["main_no"], row["reply_no"]))
            chars += len(html or "")
            if len(out) >= FRAME_ROWS or chars >= FRAME_CHARS:
                yield _element_frame(out)
                out, chars = [], 0
        if out:
            yield _element_frame(out)


def element_rows(pages: DataFrame) -> DataFrame:
    """``pages`` holds ``page_id, html`` and may hold more; one row per element with class, attribute or title."""
    return pages.select(F.col("page_id").cast("string").alias("page_id"), "html").mapInPandas(_parse_batches, ELEMENTS)


def _has(*classes: str) -> Column:
    return F.arrays_overlap("classes", F.array(*[F.lit(c) for c in classes]))


def _first(value: Column, test: Column) -> Column:
    """Earliest non-empty value among the elements that pass a test."""
    text = F.when(test, F.nullif(clean_text(value), F.lit("")))
    return F.min_by(text, F.when(text.isNotNull(), F.col("node_no")))


def page_facts(elements: DataFrame, title_suffix: str | None = None) -> DataFrame:
    """One row per page: title, layout markers, declared count, pager links and declared pages."""
    is_main = _has("l_post")
    explicit = F.when(F.col("attributes").getItem("data-total-page").rlike("^[0-9]{1,9}$"), F.col("attributes").getItem("data-total-page").try_cast("int"))
    facts = elements.groupBy("page_id").agg(
        F.coalesce(
            _first(F.coalesce("attributes.title", F.lit("")), _has(*TITLE_CLASSES) | (F.col("tag") == "h1")),
            _first(F.col("text"), _has(*TITLE_CLASSES) | (F.col("tag") == "h1")),
        ).alias("explicit_title"),
        _first(F.col("text"), F.col("tag") == "title").alias("document_title"),
        F.count_if(is_main).alias("paginated_posts"),
        F.count_if(_has("pb-comment-item") & F.col("attributes").getItem("data-id").isNotNull()).alias("dynamic_posts"),
        F.count_if(_has(*FIRST_FLOOR_CLASSES)).alias("first_floors"),
        F.count_if(_has(*REPLY_TOP_CLASSES)).alias("reply_tops"),
        F.max(F.when(_has(*REPLY_TOP_CLASSES), declared_count(F.col("text")))).alias("declared_count"),
        F.max(explicit).alias("explicit_pages"),
        _first(F.col("text"), _has(*PAGER_CLASSES)).alias("pager_text"),
        # Links of one page; their number is bounded by the page itself.
        F.collect_set(F.when(F.col("tag") == "a", F.col("attributes").getItem("href"))).alias("links"),
    )
    return facts.withColumn("title", extract_title(F.col("explicit_title"), F.col("document_title"), title_suffix))


def extract_title(explicit: Column, document_title: Column, suffix: str | None = None) -> Column:
    """The explicit heading, else the document title without the site's suffix (a pattern)."""
    whole = F.coalesce(document_title, F.lit(""))
    if suffix is not None:
        whole = F.regexp_replace(whole, rf"[_-]?(?:{suffix})\s*$", "")
    return F.coalesce(explicit, F.trim(whole))


def classify_page(facts: DataFrame) -> DataFrame:
    """Adds ``status`` and ``layout``: ready pages, pages still loading, and others."""
    paginated = F.col("paginated_posts") > 0
    dynamic = (F.col("first_floors") > 0) | (F.col("dynamic_posts") > 0)
    return facts.withColumns(
        {
            "layout": F.when(paginated, "legacy").when(dynamic, "spa"),
            "status": F.when(paginated | dynamic, "ready").when(F.col("reply_tops") > 0, "not_ready").otherwise("unsupported"),
        }
    )


def _json_text(*paths: str) -> Column:
    field = F.col("data_field")
    return F.coalesce(*[blank_to_null(F.get_json_object(field, path)) for path in paths])


def extract_html_threads(elements: DataFrame) -> DataFrame:
    """Reply rows of both layouts, main and nested, one per reply container."""
    nested = _has(*NESTED_CLASSES)
    own = F.col("node_no") == F.col("reply_no")
    attribute = lambda name: blank_to_null(F.col("attributes").getItem(name))
    inside = elements.filter(F.col("reply_no").isNotNull()).repartition("page_id", "main_no")

    def at(value):
        return F.max(F.when(own, value))

    fields = inside.groupBy("page_id", "main_no", "reply_no").agg(
        F.bool_or(own & nested).alias("is_nested"),
        F.bool_or(own & _has(*FIRST_FLOOR_CLASSES)).alias("is_first_floor"),
        F.bool_or(own & _has("l_post", "lzl_single_post")).alias("is_paginated"),
        at(attribute("data-field")).alias("data_field"),
        at(F.coalesce(attribute("data-pid"), attribute("data-post-id"), attribute("data-spid"), attribute("data-id"))).alias("attribute_id"),
        at(attribute("data-floor")).alias("attribute_floor"),
        at(F.coalesce(attribute("data-reply-to"), attribute("data-parent-id"))).alias("attribute_parent"),
        at(F.col("text")).alias("all_text"),
        _first(F.col("text"), _has(*CONTENT_CLASSES) | F.col("element_id").startswith("post_content_")).alias("shown"),
        F.min(F.when(F.col("element_id").startswith("post_content_"), F.regexp_extract("element_id", "([0-9]+)", 1))).alias("content_id"),
        _first(F.coalesce("attributes.username", "attributes.data-name", "text"), _has(*AUTHOR_CLASSES)).alias("shown_author"),
        _first(F.col("text"), _has(*TIME_CLASSES) | (F.col("tag") == "time")).alias("time_area"),
        F.count_if(F.col("tag") == "img").alias("image_count"),
        F.collect_list(F.when(_has(*MORE_CLASSES), F.col("text"))).alias("controls"),
    )
    site_id = F.coalesce(_json_text("$.content.post_id", "$.post_id", "$.spid", "$.comment_id", "$.id"), F.col("attribute_id"), F.col("content_id"))
    shown_floor = F.regexp_extract(F.coalesce("time_area", F.lit("")), r"([0-9]+)\s*楼", 1)
    floor = F.coalesce(safe_int(_json_text("$.content.post_no", "$.content.floor", "$.post_no")), safe_int(F.col("attribute_floor")), safe_int(shown_floor))
    author = F.coalesce(
        _json_text("$.author.user_name", "$.author.user_nickname", "$.author.name", "$.user_name", "$.user_nickname", "$.showname"), F.col("shown_author")
    )
    rows = fields.withColumns({"site_reply_id": site_id, "own_floor": F.when(F.col("is_first_floor"), F.coalesce(floor, F.lit(1))).otherwise(floor), "author_name": author})
    is_nested = F.col("is_nested")
    # A main reply and the replies under it come from one page and one parse.
    around = Window.partitionBy("page_id", "main_no")
    joined = rows.withColumns({
        "main_site_id": F.max(F.when(~is_nested, F.col("site_reply_id"))).over(around), "main_floor": F.max(F.when(~is_nested, F.col("own_floor"))).over(around),
        "visible_nested": F.count_if(is_nested).over(around),
    })
    declared = safe_int(_json_text("$.content.comment_num", "$.content.comment_count", "$.comment_num"))
    hidden = unexpanded_estimate(declared, F.coalesce("visible_nested", F.lit(0)), F.filter("controls", lambda c: c.isNotNull()))
    named_parent = F.coalesce(_json_text("$.reply_to_id", "$.reply_id", "$.parent_id"), F.col("attribute_parent"))
    return joined.select(
        "page_id", "reply_no", F.when(F.col("is_paginated"), "legacy").otherwise("spa").alias("layout"), is_nested.alias("is_nested"), "site_reply_id",
        F.when(is_nested, F.when(named_parent != F.col("site_reply_id"), named_parent).otherwise(F.col("main_site_id"))).alias("parent_reply_id"),
        F.when(is_nested, F.col("main_floor")).otherwise(F.col("own_floor")).cast("int").alias("floor"), "author_name",
        F.coalesce(extract_time_text(F.col("time_area")), F.nullif(extract_time_text(_json_text("$.date", "$.time", "$.now_time")), F.lit(""))).alias("time"),
        F.coalesce("shown", F.nullif(clean_text(_json_text("$.content.content", "$.content")), F.lit("")), removal_notice(F.col("all_text"))).alias("content"),
        "image_count", F.when(is_nested, 0).otherwise(hidden).alias("unexpanded_nested_count"),
    )


def fallback_reply_ids(replies: DataFrame, page_number: Column) -> DataFrame:
    """Adds ``id``: the site id, else one from page and floor, or from the parent and the place under it."""
    main_id = F.coalesce(
        "site_reply_id", F.concat(F.lit("thread-page-"), page_number, F.lit("-floor-"), F.coalesce("floor", F.col("reply_no") + 1))
    )
    under = Window.partitionBy("page_id", "parent_reply_id").orderBy("reply_no")
    nested_id = F.coalesce("site_reply_id", F.concat("parent_reply_id", F.lit("-nested-"), F.row_number().over(under)))
    return replies.withColumn("id", F.when(F.col("is_nested"), nested_id).otherwise(main_id))


def fingerprint_ids(replies: DataFrame) -> DataFrame:
    """Adds ``runtime_id`` for replies without a site id: content digest plus the place among equals."""
    parts = [clean_text(F.col(c)) for c in ["parent_reply_id", "author_name", "time", "content"]]
    marked = replies.withColumn("_print", F.sha2(F.concat_ws("\x1f", *parts), 256))
    numbered = dense_number(marked, ["page_id", "_print"], "reply_no", "_place")
    return numbered.withColumn("runtime_id", F.concat_ws("-", "_print", F.col("_place") - 1)).drop("_print", "_place")


def read_nested_pages(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page rows, replies) of nested fragments: pager totals, counters and the empty sentinel flag.

    Every id source of a node must agree and a content container must exist, else it is unparsed.
    """
    node = _has("lzl_single_post")
    own = F.col("node_no") == F.col("reply_no")
    inside = elements.filter(F.col("reply_no").isNotNull())
    ids = F.array_compact(
        F.array(
            *[blank_to_null(F.get_json_object(F.col("attributes").getItem("data-field"), path)) for path in ("$.spid", "$.comment_id", "$.id")],
            *[blank_to_null(F.col("attributes").getItem(a)) for a in ("data-spid", "data-id")],
        )
    )
    nodes = inside.groupBy("page_id", "reply_no").agg(
        F.bool_or(own & node).alias("is_reply"), F.flatten(F.collect_list(F.when(own, F.array_distinct(ids)))).alias("ids"),
        F.bool_or(_has("lzl_content_main", "j_lzl_content", "lzl_content")).alias("has_content"),
        _first(F.col("text"), _has("lzl_content_main", "j_lzl_content", "lzl_content")).alias("content"),
    ).filter("is_reply")
    good_id = F.element_at("ids", 1)
    sound = (F.size("ids") == 1) & F.col("has_content") & F.try_element_at("ids", F.lit(1)).rlike("^[0-9]{1,32}$")
    nodes = nodes.withColumn("id", F.when(sound, good_id))
    replies = first_per_key(nodes.filter(F.col("id").isNotNull()).select("page_id", "reply_no", "id", "content"), ["page_id", "id"], F.col("reply_no"))
    per_id = nodes.filter(F.col("id").isNotNull()).groupBy("page_id", "id").agg(F.count("*").alias("times"))
    stable = per_id.groupBy("page_id").agg(F.sum("times").alias("stable_count"), F.sum(F.col("times") - 1).alias("duplicate_count"))
    raw = nodes.groupBy("page_id").agg(F.count("*").alias("raw_count"))
    pager_field = F.col("attributes").getItem("data-field")
    pager = elements.groupBy("page_id").agg(
        F.count_if(_has(NESTED_PAGER_CLASS)).alias("pagers"),
        F.max(F.when(_has(NESTED_PAGER_CLASS), safe_int(F.get_json_object(pager_field, "$.total_num")))).alias("total_num"),
        F.max(F.when(_has(NESTED_PAGER_CLASS), safe_int(F.get_json_object(pager_field, "$.total_page")))).alias("total_pages"),
        F.count_if((F.col("tag") == "li") & ~_has("lzl_single_post", NESTED_PAGER_CLASS)).alias("unknown_count"),
        F.max(F.when(_has(NESTED_PAGER_CLASS), pager_field)).alias("pager_field"),
    )
    rows = pager.join(raw, "page_id", "left").join(stable, "page_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ["raw_count", "stable_count", "duplicate_count"]})
    # Past the last page the endpoint answers with nothing but {"total_num": null, "total_page": 0}.
    only_totals = F.array_sort(F.json_object_keys("pager_field")) == F.array(F.lit("total_num"), F.lit("total_page"))
    is_empty = (
        (F.col("pagers") == 1) & F.coalesce(only_totals, F.lit(False)) & F.col("total_num").isNull()
        & (F.coalesce("total_pages", F.lit(-1)) == 0) & (F.col("raw_count") == 0) & (F.col("unknown_count") == 0)
    )
    return rows.select(
        "page_id", "total_num", "total_pages", ((F.col("pagers") == 1) & F.col("total_num").isNotNull() & F.col("total_pages").isNotNull()).alias("has_trusted_pager"),
        "raw_count", "stable_count", "duplicate_count", (F.col("raw_count") - F.col("stable_count")).alias("unparsed_count"), "unknown_count",
        is_empty.alias("is_empty_sentinel"),
    ), replies
