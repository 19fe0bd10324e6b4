"""Queries over captured JSON pages and their reconciliation.

Page bodies are built by Spark from ``conversations``: three turns per page, the third one a nested
preview under the second.  Some pages are damaged, repeated or incomplete on purpose.
"""

from pyspark.sql import functions as F

from threadspark.operators import reconcile
from threadspark.plans.registry import query, sql_clean
from threadspark.session import cut_lineage
from threadspark.sources import page_json



def raw_pages(t):
    turn, conv = F.col("turn"), F.col("conv_id")
    turns = t.conversations.withColumns(
        {
            "page": F.floor(turn / 3) + 1,
            "post_id": F.when(F.col("role") == "system", F.lit("x")).otherwise((conv * 1000 + turn).cast("string")),
        }
    )

    def content():
        return F.array(
            F.struct(F.lit("0").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("origin_src")),
            F.struct(F.lit("3").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("http://i").alias("origin_src")),
        )

    body_parts = F.when(turn % 4 == 1, content()).otherwise(F.slice(content(), 1, 1))
    stamp = (F.lit(1_700_000_000) + conv * 1000 + turn).cast("string")
    author = F.concat(F.lit("a"), F.col("role"))
    base = [F.col("post_id").alias("id"), author.alias("author_id"), stamp.alias("time"), body_parts.alias("content")]
    nested = turns.filter(turn % 3 == 2).select("conv_id", "page", F.array(F.struct(*base)).alias("sub_post_list"))
    mains = turns.filter(turn % 3 < 2).join(nested, ["conv_id", "page"], "left")
    previews = F.when(turn % 3 == 1, F.col("sub_post_list"))
    declared = F.when(turn % 3 == 1, F.coalesce(F.size("sub_post_list"), F.lit(0)).cast("int"))
    declared = F.when(F.col("sub_post_list").isNull(), F.lit(0)).otherwise(declared) + F.when((conv % 5 == 0) & (turn % 3 == 1), 2).otherwise(0)
    post = F.struct(
        *base, (turn + 1).cast("string").alias("floor"), declared.cast("string").alias("sub_post_number"), previews.alias("sub_post_list")
    )
    repeated = post.withField("sub_post_list", F.lit(None).cast("array<struct<id:string,author_id:string,time:string,content:array<struct<type:string,text:string,origin_src:string>>>>"))
    copies = F.when((conv % 6 == 1) & (turn % 3 == 1), F.array(post, repeated)).otherwise(F.array(post))
    pages = mains.groupBy("conv_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("turn", copies.alias("posts")))).alias("items"),
    )
    sizes = t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max(F.floor(turn / 3) + 1).alias("total"))
    rows = pages.join(sizes, "conv_id")
    posts = F.flatten(F.transform("items", lambda i: i["posts"]))
    first = F.when(F.col("page") == 1, F.element_at(posts, 1))
    rest = F.when(F.col("page") == 1, F.slice(posts, F.lit(2), F.size(posts))).otherwise(posts)
    users = F.array(*[F.struct(F.lit("a" + r).alias("id"), F.lit(r).alias("name"), F.lit(f" {r}! ").alias("name_show")) for r in ["user", "assistant"]])
    good = F.to_json(
        F.struct(
            F.when((conv % 7 == 3) & (F.col("page") == 2), "4").otherwise("0").alias("error_code"),
            F.struct((conv + F.when(conv % 17 == 4, 1).otherwise(0)).cast("string").alias("id"), F.lit(" A  title ").alias("title"), (F.col("turns") - 1).cast("string").alias("reply_num")).alias("thread"),
            F.struct(F.lit("77").alias("id")).alias("forum"),
            F.struct(F.col("page").cast("string").alias("current_page"), F.col("total").cast("string").alias("total_page"), (F.col("page") < F.col("total")).cast("int").cast("string").alias("has_more")).alias("page"),
            first.alias("first_floor"), rest.alias("post_list"), users.alias("user_list"),
        )
    )
    body = F.when((conv % 11 == 5) & (F.col("page") == 1), F.lit("  ")).when((conv % 13 == 6) & (F.col("page") == 1), F.lit("<html>")).otherwise(good)
    return rows.select(conv.cast("string").alias("thread_id"), F.col("page").cast("bigint").alias("page"), body.alias("body"))


_BASE = """base AS (SELECT *, turn // 3 + 1 AS page, conv_id * 1000 + turn AS pid FROM conversations),
 pg AS (SELECT conv_id, page, CASE WHEN conv_id % 11 = 5 AND page = 1 THEN 'empty_body' WHEN conv_id % 13 = 6 AND page = 1 THEN 'not_json' WHEN conv_id % 7 = 3 AND page = 2 THEN 'remote_error'
   WHEN conv_id % 17 = 4 THEN 'thread_mismatch' WHEN count(*) FILTER (turn % 3 < 2 AND role <> 'system') = 0 THEN 'no_replies' END AS error FROM base GROUP BY conv_id, page HAVING count(*) FILTER (turn % 3 < 2) > 0),
 total AS (SELECT conv_id, max(page) AS total, count(*) AS turns FROM base GROUP BY 1),
 ok AS (SELECT b.*, t.total, t.turns FROM base b JOIN pg USING (conv_id, page) JOIN total t USING (conv_id) WHERE error IS NULL),
 par AS (SELECT m.conv_id, m.page, m.pid AS parent_id, m.turn + 1 AS floor, count(n.pid) AS previews, count(n.pid) + CASE WHEN m.conv_id % 5 = 0 THEN 2 ELSE 0 END AS declared
   FROM ok m LEFT JOIN ok n ON n.conv_id = m.conv_id AND n.turn = m.turn + 1 WHERE m.turn % 3 = 1 GROUP BY m.conv_id, m.page, m.pid, m.turn),
 parents AS (SELECT * FROM par WHERE declared > 0)"""


@query("split_bad_pages", f"WITH {_BASE} SELECT CAST(conv_id AS VARCHAR) AS thread_id, page, error AS error_code FROM pg WHERE error IS NOT NULL")
def split_bad_pages(t):
    return page_json.split_bad_pages(page_json.parse_bodies(raw_pages(t)))[1].drop("body")


def _read(t):
    return page_json.read_thread_pages(page_json.split_bad_pages(page_json.parse_bodies(raw_pages(t)))[0])


@query("read_thread_pages", f"""WITH {_BASE} SELECT CAST(conv_id AS VARCHAR) AS thread_id, page, CAST(pid AS VARCHAR) AS id, CASE WHEN turn % 3 = 2 THEN CAST(pid - 1 AS VARCHAR) END AS parent_reply_id,
   CASE WHEN turn % 3 = 2 THEN turn ELSE turn + 1 END AS floor, concat(role, '!') AS author_name, (1700000000 + pid) * 1000 AS timestamp_ms, md5({sql_clean('text')}) AS content_md5,
   CASE WHEN turn % 4 = 1 THEN 1 ELSE 0 END AS image_count, turn % 3 = 2 AS is_nested, CASE WHEN turn % 3 = 1 AND conv_id % 5 = 0 THEN 2 ELSE 0 END AS unexpanded FROM ok WHERE role <> 'system'""")
def read_thread_pages(t):
    replies, _, _ = _read(t)
    return replies.select(
        "thread_id", "page", "id", "parent_reply_id", "floor", "author_name", "timestamp_ms", F.md5("content").alias("content_md5"),
        "image_count", "is_nested", F.col("unexpanded_nested_count").alias("unexpanded"),
    )


@query("page_counters", f"""WITH {_BASE} SELECT CAST(conv_id AS VARCHAR) AS thread_id, page, any_value(total) AS total_pages, any_value(turns) - 1 AS declared_count, page < any_value(total) AS has_more, 'A title' AS title,
   count(*) + d AS raw_count, count(*) FILTER (role <> 'system') + d AS stable_count, CAST(d AS BIGINT) AS duplicate_count, count(*) FILTER (role = 'system') AS unparsed_count
   FROM (SELECT *, CASE WHEN conv_id % 6 = 1 THEN count(*) FILTER (turn % 3 = 1) OVER (PARTITION BY conv_id, page) ELSE 0 END AS d FROM ok) GROUP BY conv_id, page, d""")
def page_counters(t):
    return _read(t)[2].drop("current_page", "forum_id")


@query("nested_parents", f"WITH {_BASE} SELECT CAST(conv_id AS VARCHAR) AS thread_id, page, CAST(parent_id AS VARCHAR) AS parent_id, floor AS parent_floor, previews AS preview_count, declared AS declared_count FROM parents")
def nested_parents(t):
    return _read(t)[1]


@query("page_frontier", f"WITH {_BASE} SELECT CAST(conv_id AS VARCHAR) AS thread_id, count(DISTINCT page) AS pages_fetched, max(total) AS pages_total, max(total) > 500 AS truncated FROM ok GROUP BY 1")
def page_frontier(t):
    return reconcile.page_frontier(_read(t)[2])


@query("missing_pages", f"WITH {_BASE}, f AS (SELECT conv_id, max(total) AS total FROM ok GROUP BY 1) SELECT CAST(conv_id AS VARCHAR) AS thread_id, CAST(p AS INTEGER) AS page FROM (SELECT conv_id, unnest(range(1, total + 1)) AS p FROM f) WHERE (conv_id, p) NOT IN (SELECT (conv_id, page) FROM ok)")
def missing_pages(t):
    return reconcile.missing_pages(_read(t)[2])


@query("page_gaps", f"""WITH {_BASE}, f AS (SELECT conv_id, max(total) AS total FROM ok GROUP BY 1), m AS (SELECT conv_id, unnest(range(1, total + 1)) AS p FROM f), g AS (SELECT * FROM m WHERE (conv_id, p) NOT IN (SELECT (conv_id, page) FROM ok)),
   i AS (SELECT conv_id, p, p - row_number() OVER (PARTITION BY conv_id ORDER BY p) AS island FROM g) SELECT CAST(conv_id AS VARCHAR) AS thread_id, min(p) AS first_page, max(p) AS last_page FROM i GROUP BY conv_id, island""")
def page_gaps(t):
    return reconcile.page_gaps(_read(t)[2])


@query("page_diagnostics", f"""WITH {_BASE}, d AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'system') AS bad, CASE WHEN conv_id % 6 = 1 THEN count(*) FILTER (turn % 3 = 1) ELSE 0 END AS dup, max(turns) - 1 AS declared FROM ok GROUP BY conv_id)
   SELECT CAST(conv_id AS VARCHAR) AS thread_id, n + dup AS raw_count, n + dup - bad AS stable_count, CAST(dup AS BIGINT) AS duplicate_count, bad AS unparsed_count, 0 AS mismatch_pages, 0 AS undeclared_pages, declared AS declared_count,
   0 AS cross_page_duplicates, greatest(bad, dup) AS main_diagnostic_count FROM d""")
def page_diagnostics(t):
    replies, _, pages = _read(t)
    return reconcile.page_diagnostics(pages, replies)


@query("merge_parents", f"WITH {_BASE} SELECT CAST(conv_id AS VARCHAR) AS thread_id, CAST(parent_id AS VARCHAR) AS parent_id, declared AS declared_count, floor AS parent_floor, previews AS preview_count, previews >= declared AS satisfied FROM parents")
def merge_parents(t):
    replies, parents, _ = _read(t)
    return reconcile.preview_satisfied(reconcile.merge_parents(parents), reconcile.preview_ids(replies))


def _nested(t, parents):
    """Nested pages of every unsatisfied parent: one full page, or one short page with or without a probe."""
    conv = F.col("thread_id").cast("bigint")
    short = conv % 10 == 5
    rows = parents.filter(~F.col("satisfied"))
    n = F.col("declared_count") - short.cast("int")
    page = rows.select(
        "thread_id", "parent_id", F.lit(1).alias("page"), F.col("declared_count").alias("total_num"), F.lit(1).alias("total_pages"), F.lit(1).alias("current_page"),
        F.lit(False).alias("has_more"), F.lit(True).alias("has_trusted_pager"), n.alias("raw_count"), n.alias("stable_count"), F.lit(0).alias("duplicate_count"),
        F.lit(0).alias("unparsed_count"), F.lit(0).alias("unknown_count"), F.lit(False).alias("is_probe"), F.lit(False).alias("is_empty_sentinel"),
    )
    probe = page.filter(conv % 20 == 5).withColumns({"page": F.lit(2), "is_probe": F.lit(True), "is_empty_sentinel": F.lit(True)})
    # The preview under a main has the next id; further replies get ids of their own.
    ids = F.concat(
        F.when(F.col("preview_count") > 0, F.array((F.col("parent_id").cast("bigint") + 1).cast("string"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.sequence(F.lit(1), (n - F.col("preview_count")).cast("int")), lambda k: F.concat(F.col("parent_id"), F.lit("900"), k)),
    )
    replies = rows.select("thread_id", "parent_id", F.lit(1).alias("page"), F.explode(ids).alias("id"))
    return page.unionByName(probe), replies


def _states(t):
    replies, parents, pages = _read(t)
    known = cut_lineage(reconcile.preview_satisfied(reconcile.merge_parents(parents), reconcile.preview_ids(replies)))
    nested_pages, nested_replies = _nested(t, known)
    states = cut_lineage(reconcile.nested_reconcile(known, nested_pages, nested_replies))
    return replies, pages, states, nested_replies


@query("nested_reconcile", f"""WITH {_BASE} SELECT CAST(conv_id AS VARCHAR) AS thread_id, CAST(parent_id AS VARCHAR) AS parent_id, previews >= declared AS satisfied, declared AS available_count,
   declared - CASE WHEN conv_id % 10 = 5 THEN 1 ELSE 0 END AS distinct_count, true AS reached_end, false AS truncated, CASE WHEN conv_id % 10 = 5 THEN 1 ELSE 0 END AS terminal_gap, conv_id % 20 = 5 AS gap_verified, 0 AS drift_count, 0 AS mismatch_count FROM parents""")
def nested_reconcile(t):
    return _states(t)[2].select("thread_id", "parent_id", "satisfied", "available_count", "distinct_count", "reached_end", "truncated", "terminal_gap", "gap_verified", "drift_count", "mismatch_count")


def _verdict(t):
    replies, pages, states, nested = _states(t)
    kept = reconcile.drop_stale_previews(replies, states, nested)
    listed = kept.select("thread_id", "id", "is_nested", F.col("parent_reply_id").alias("parent_id"), "image_count")
    extra = nested.select("thread_id", "id", F.lit(True).alias("is_nested"), "parent_id", F.lit(0).alias("image_count"))
    every = listed.unionByName(extra).groupBy("thread_id", "id", "is_nested", "parent_id").agg(F.max("image_count").alias("image_count"))
    fetched = every.filter("is_nested").groupBy("thread_id", "parent_id").agg(F.count("*").alias("fetched"))
    resolved = cut_lineage(reconcile.parent_unresolved(states, fetched))
    failures = t.conversations.select(F.col("conv_id").cast("string").alias("thread_id")).distinct().withColumn("failed_requests", F.lit(0))
    return reconcile.completeness(
        reconcile.page_frontier(pages), reconcile.page_diagnostics(pages, replies), resolved, every, failures
    ), resolved


@query("parent_unresolved", f"""WITH {_BASE} SELECT CAST(conv_id AS VARCHAR) AS thread_id, CAST(parent_id AS VARCHAR) AS parent_id, declared - CASE WHEN conv_id % 10 = 5 THEN 1 ELSE 0 END AS fetched,
   CASE WHEN conv_id % 10 = 5 THEN 1 ELSE 0 END AS shortfall, CASE WHEN conv_id % 20 = 15 THEN 1 ELSE 0 END AS unresolved, conv_id % 20 <> 15 AS stable_terminal FROM parents""")
def parent_unresolved(t):
    return _verdict(t)[1].select("thread_id", "parent_id", "fetched", "shortfall", "unresolved", "stable_terminal")


_VERDICT = f"""WITH {_BASE}, p AS (SELECT conv_id, sum(CASE WHEN conv_id % 20 = 15 THEN 1 ELSE 0 END) AS unresolved, sum(CASE WHEN conv_id % 10 = 5 THEN 1 ELSE 0 END) AS short,
    sum(declared - previews - CASE WHEN conv_id % 10 = 5 THEN 1 ELSE 0 END) AS extra FROM parents GROUP BY conv_id),
  v AS (SELECT o.conv_id, count(DISTINCT page) AS fetched, max(total) AS total, max(turns) AS turns, count(*) FILTER (role <> 'system') + coalesce(max(extra), 0) AS replies,
    greatest(count(*) FILTER (role = 'system'), CASE WHEN o.conv_id % 6 = 1 THEN count(*) FILTER (turn % 3 = 1) ELSE 0 END) AS diag, coalesce(max(unresolved), 0) AS unresolved, coalesce(max(short), 0) AS short,
    count(*) FILTER (role <> 'system' AND turn % 4 = 1) AS images FROM ok o LEFT JOIN p USING (conv_id) GROUP BY o.conv_id),
  f AS (SELECT *, fetched = total AND diag = 0 AND unresolved = 0 AS readable, greatest(unresolved, short, turns - replies, 0) AS unavailable FROM v)"""


@query("completeness", f"""{_VERDICT} SELECT CAST(conv_id AS VARCHAR) AS thread_id, fetched AS pages_fetched, total AS pages_total, replies AS reply_count, CAST(unresolved AS BIGINT) AS unresolved, readable AS readable_text_complete,
   CAST(unavailable AS BIGINT) AS unavailable, readable AND unavailable = 0 AND images = 0 AS is_complete FROM f""")
def completeness(t):
    return _verdict(t)[0].select("thread_id", "pages_fetched", "pages_total", "reply_count", "unresolved", "readable_text_complete", "unavailable", "is_complete")


@query("capture_issues", f"""{_VERDICT}, d AS (SELECT f.*, (SELECT count(*) FROM ok o WHERE o.conv_id = f.conv_id AND role = 'system') AS bad,
    CASE WHEN conv_id % 6 = 1 THEN (SELECT count(*) FROM ok o WHERE o.conv_id = f.conv_id AND turn % 3 = 1) ELSE 0 END AS dup FROM f),
  i AS (SELECT conv_id, unnest(['main_unparsed', 'main_duplicates', 'endpoint_shortfall', 'unresolved_nested', 'unverified_gaps', 'unavailable', 'images']) AS code,
    unnest([bad, dup, CASE WHEN conv_id % 20 = 5 THEN short ELSE 0 END, unresolved, unresolved, CASE WHEN unavailable > greatest(unresolved, short) THEN unavailable ELSE 0 END, images]) AS n FROM d)
  SELECT CAST(conv_id AS VARCHAR) AS thread_id, code, CAST(n AS BIGINT) AS count FROM i WHERE n > 0""")
def capture_issues(t):
    return reconcile.capture_issues(_verdict(t)[0])


@query("capture_diagnosis", f"""{_VERDICT} SELECT CAST(conv_id AS VARCHAR) AS thread_id, NOT readable AS blocking, CASE WHEN readable THEN NULL WHEN total > fetched THEN 'missing_pages' ELSE 'structure' END AS reason,
   CASE WHEN readable AND unavailable = 0 AND images = 0 THEN 'complete' WHEN readable THEN 'text_complete' ELSE 'partial' END AS scope FROM f""")
def capture_diagnosis(t):
    return reconcile.capture_diagnosis(_verdict(t)[0]).select("thread_id", "blocking", "reason", "scope")


@query("capture_scope", f"""{_VERDICT}, d AS (SELECT f.*, (SELECT count(*) FROM ok o WHERE o.conv_id = f.conv_id AND role = 'system')
    + CASE WHEN conv_id % 6 = 1 THEN (SELECT count(*) FROM ok o WHERE o.conv_id = f.conv_id AND turn % 3 = 1) ELSE 0 END + unresolved AS n FROM f)
  SELECT CAST(conv_id AS VARCHAR) AS thread_id, CASE WHEN readable THEN '接口可见文字已读完' WHEN total > fetched THEN concat('主回复仍缺 ', total - fetched, ' 页') ELSE concat('有 ', n, ' 个接口回复节点无法可靠解析') END AS title,
    CASE WHEN NOT readable THEN CAST(n AS BIGINT) END AS structure_count, CASE WHEN readable AND (unavailable > 0 OR images > 0) THEN concat('本次 AI 只分析已读取的文字；',
      concat_ws('，', CASE WHEN unavailable > 0 THEN concat('不会把 ', unavailable, ' 条站点统计差额当作已读取内容') END, CASE WHEN images > 0 THEN concat('不包含 ', images, ' 张图片中的文字') END), '。') END AS scope_note FROM d""")
def capture_scope(t):
    return reconcile.capture_diagnosis(_verdict(t)[0]).select("thread_id", "title", "structure_count", "scope_note")
