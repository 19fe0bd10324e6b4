"""Queries over HTML pages: the given ``pages``, and thread pages that Spark builds from ``conversations``."""

from pyspark.sql import functions as F

from threadspark.plans.registry import query, sql_clean
from threadspark.sources import page_html


def _given(t):
    return page_html.page_facts(page_html.element_rows(t.pages))


@query("extract_title", "SELECT CAST(page_id AS VARCHAR) AS page_id, " + sql_clean("replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&amp;', '&')") + " AS title FROM pages")
def extract_title(t):
    return _given(t).select("page_id", "title")


@query("classify_page", "SELECT CAST(page_id AS VARCHAR) AS page_id, 'unsupported' AS status FROM pages")
def classify_page(t):
    return page_html.classify_page(_given(t)).select("page_id", "status")


def thread_pages(t):
    """One page per conversation: paginated layout for even ones, dynamic layout for odd ones."""
    turn, conv = F.col("turn"), F.col("conv_id")
    text = F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;")
    image = F.when(turn % 4 == 1, "<img src='x'>").otherwise("")
    number = conv * 1000 + turn
    field = F.to_json(F.struct(F.struct(F.col("role").alias("user_name")).alias("author"), F.struct(number.alias("post_id"), (turn + 1).alias("post_no")).alias("content")))
    nested_field = F.to_json(F.struct(number.alias("spid"), F.col("role").alias("user_name")))
    escaped = lambda c: F.regexp_replace(c, '"', "&quot;")
    legacy_main = F.concat(F.lit('<div class="l_post" data-field="'), escaped(field), F.lit('"><div class="d_post_content">'), text, image, F.lit('</div><span class="tail-info">2024-01-02 03:04</span><span class="lzl_more">还有 '), turn, F.lit(" 条</span>"))
    legacy_nested = F.concat(F.lit('<li class="lzl_single_post" data-field="'), escaped(nested_field), F.lit('"><span class="lzl_content_main">'), text, image, F.lit('</span><span class="lzl_time">3小时前</span></li>'))
    spa_main = F.concat(F.lit('<div class="pb-comment-item" data-id="'), number, F.lit('"><b class="head-name">'), "role", F.lit('</b><p class="pb-rich-text">'), text, image, F.lit('</p><i class="comment-desc-left">第 '), turn + 1, F.lit("楼 2024-01-02</i>"))
    spa_nested = F.concat(F.lit('<div class="lzl-wrapper"><div class="pb-lzl-item" data-spid="'), number, F.lit('"><b class="head-name">'), "role", F.lit('</b><p class="pb-rich-text">'), text, image, F.lit('</p><i class="comment-desc-left">3小时前</i></div></div>'))
    nested = turn % 3 == 2
    closing = F.when((turn % 3 == 1) & ~F.col("last"), "").otherwise("</div>")
    block = F.when(conv % 2 == 0, F.when(nested, legacy_nested).otherwise(legacy_main)).otherwise(F.when(nested, spa_nested).otherwise(spa_main))
    sizes = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("max_turn"))
    rows = t.conversations.join(sizes, "conv_id").withColumn("last", F.col("turn") == F.col("max_turn"))
    return (
        rows.select("conv_id", "turn", F.concat(block, closing).alias("block"))
        .groupBy(F.col("conv_id").alias("page_id"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda b: b["block"]), "\n").alias("html"))
    )


_SHOWN = sql_clean("text")


@query("extract_html_threads", f"""SELECT CAST(conv_id AS VARCHAR) AS page_id, CASE WHEN conv_id % 2 = 0 THEN 'legacy' ELSE 'spa' END AS layout, turn % 3 = 2 AS is_nested, CAST(conv_id * 1000 + turn AS VARCHAR) AS site_reply_id,
   CASE WHEN turn % 3 = 2 THEN CAST(conv_id * 1000 + turn - 1 AS VARCHAR) END AS parent_reply_id, CAST(CASE WHEN turn % 3 = 2 THEN turn ELSE turn + 1 END AS INTEGER) AS floor, role AS author_name,
   CASE WHEN turn % 3 = 2 THEN '3小时前' WHEN conv_id % 2 = 0 THEN '2024-01-02 03:04' ELSE '2024-01-02' END AS time, md5({_SHOWN}) AS content_md5, image_count,
   CASE WHEN turn % 3 = 2 OR conv_id % 2 = 1 THEN 0 ELSE turn END AS unexpanded FROM (SELECT *, CASE WHEN turn % 4 = 1 THEN 1 ELSE 0 END
     + CASE WHEN turn % 3 = 1 AND (turn + 1) % 4 = 1 AND FALSE THEN 1 ELSE 0 END AS image_count FROM conversations)""")
def extract_html_threads(t):
    rows = page_html.extract_html_threads(page_html.element_rows(thread_pages(t)))
    return rows.select(
        "page_id", "layout", "is_nested", "site_reply_id", "parent_reply_id", "floor", "author_name", "time", F.md5("content").alias("content_md5"),
        "image_count", F.col("unexpanded_nested_count").alias("unexpanded"),
    )


@query("fallback_reply_id", """SELECT CAST(conv_id AS VARCHAR) AS page_id, concat('thread-page-1-floor-', turn + 1) AS id FROM conversations WHERE turn % 3 < 2
   UNION ALL SELECT CAST(conv_id AS VARCHAR), concat(conv_id * 1000 + turn - 1, '-nested-1') FROM conversations WHERE turn % 3 = 2""")
def fallback_reply_id(t):
    rows = page_html.extract_html_threads(page_html.element_rows(thread_pages(t)))
    bare = rows.withColumn("site_reply_id", F.lit(None).cast("string"))
    return page_html.fallback_reply_ids(bare, F.lit(1)).select("page_id", "id")


@query("fingerprint_reply_id", """SELECT page_id, reply_no, row_number() OVER (PARTITION BY page_id, f ORDER BY reply_no) - 1 AS place FROM (
   SELECT lang AS page_id, doc_id AS reply_no, concat(source, '|', """ + sql_clean("text") + """) AS f FROM documents)""")
def fingerprint_reply_id(t):
    rows = t.documents.select(
        F.col("lang").alias("page_id"), F.col("doc_id").alias("reply_no"), F.lit(None).cast("string").alias("parent_reply_id"),
        F.col("source").alias("author_name"), F.lit(None).cast("string").alias("time"), F.col("text").alias("content"),
    )
    return page_html.fingerprint_ids(rows).select("page_id", "reply_no", F.substring_index("runtime_id", "-", -1).cast("bigint").alias("place"))


def _fragments(t):
    conv = F.col("conv_id")
    text = F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;")
    other = F.when(F.col("turn") % 5 == 4, F.lit(' data-id="7"')).otherwise("")
    item = F.concat(F.lit("<li class='lzl_single_post' data-field='{\"spid\":\""), F.col("turn") % 6 + 1, F.lit("\"}'"), other, F.lit("><span class='lzl_content_main'>"), text, F.lit("</span></li>"))
    rows = t.conversations.groupBy(F.col("conv_id").alias("page_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))), lambda b: b["item"]), "").alias("items"), F.count("*").alias("n")
    )
    pager = F.concat(F.lit("<li class='lzl_li_pager' data-field='{\"total_num\":"), "n", F.lit(",\"total_page\":1}'></li>"))
    return rows.select("page_id", F.concat("items", pager).alias("html"))


@query("read_nested_pages", """SELECT CAST(conv_id AS VARCHAR) AS page_id, count(*) AS total_num, true AS has_trusted_pager, count(*) AS raw_count, CAST(count(*) FILTER (ok) AS BIGINT) AS stable_count,
   CAST(count(*) FILTER (ok) - count(DISTINCT CASE WHEN ok THEN turn % 6 END) AS BIGINT) AS duplicate_count, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS unparsed_count, false AS is_empty_sentinel
   FROM (SELECT *, turn % 5 <> 4 OR turn % 6 = 6 AS ok FROM conversations) GROUP BY conv_id""")
def read_nested_pages(t):
    return page_html.read_nested_pages(page_html.element_rows(_fragments(t)))[0].drop("total_pages", "unknown_count")
