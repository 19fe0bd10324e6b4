"""Queries over displayed results."""

from pyspark.sql import functions as F

from threadspark.operators import graph, payloads, relations, reports, results
from threadspark.plans.registry import DISCUSSION, query
from threadspark.plans.result_queries import _CHAIN, _steps
from threadspark.plans.thread_queries import _COMPONENTS, _EDGES, _NAMES, _UNDIRECTED
from threadspark.session import cut_lineage

HOST = "forum.example.org"
_PLACE = "CASE WHEN is_nested THEN concat('第 ', floor, ' 楼的楼中楼') ELSE concat('第 ', floor, ' 楼') END"


def _located(t):
    alias = payloads.author_aliases(t.discussion).select("thread_id", F.col("name").alias("author_name"), F.col("alias").alias("author_alias"))
    return t.discussion.join(alias, ["thread_id", "author_name"])


_AUTHORS = f"""authors AS (SELECT thread_id, author_name, concat('U', row_number() OVER (PARTITION BY thread_id ORDER BY min(pos))) AS alias,
   concat('用户“', author_name, '”（出现于', array_to_string(list_slice(list({_PLACE} ORDER BY pos), 1, 2), '、'), '）') AS label FROM discussion GROUP BY thread_id, author_name)"""


@query("author_occurrences", f"WITH {DISCUSSION}, {_AUTHORS} SELECT thread_id, alias, label FROM authors")
def author_occurrences(t):
    return reports.author_occurrences(_located(t))


@query("resolve_refs", f"""WITH RECURSIVE {DISCUSSION}, {_NAMES}, {_EDGES}, {_UNDIRECTED}, {_COMPONENTS}, {_AUTHORS},
   here AS (SELECT d.*, k.component, concat({_PLACE}, '（用户“', author_name, '”）') AS shown FROM discussion d JOIN components k USING (thread_id, pos)),
   one AS (SELECT * FROM here WHERE pos = 1)
   SELECT o.thread_id, concat('看 ', o.shown, '，', CASE WHEN p.id IS NULL OR p.component <> o.component THEN '已移除的无关引用' ELSE p.shown END, ' 与 ', u.label, ' 在 ',
     CASE WHEN f.id IS NULL THEN '无法定位的楼层' WHEN f.component <> o.component THEN '已移除的无关引用' ELSE f.shown END, '，CPU31') AS shown,
     concat_ws(',', o.id, CASE WHEN p.component = o.component THEN p.id END, CASE WHEN f.component = o.component AND f.id <> o.id THEN f.id END) AS reply_ids
   FROM one o LEFT JOIN here p ON p.thread_id = o.thread_id AND p.pos = 4 LEFT JOIN here f ON f.thread_id = o.thread_id AND f.pos = 2 AND NOT f.is_nested
   JOIN authors u ON u.thread_id = o.thread_id AND u.alias = 'U1'""")
def resolve_refs(t):
    found = graph.reply_components(t.discussion, relations.reply_edges(t.discussion)).drop("pos")
    rows = cut_lineage(payloads.wire_ids(_located(t)).join(found, ["thread_id", "id"]))
    labels = reports.reference_labels(rows, reports.author_occurrences(rows))
    own = rows.select("thread_id", F.col("author_alias").alias("alias"), "component")
    texts = rows.filter("pos = 1").select(
        F.col("id").alias("text_id"), "thread_id", F.lit("看 Ｐ１，P 4 与 u1 在 第 2 楼，CPU31").alias("text"), F.col("component").alias("allowed")
    )
    shown = reports.resolve_refs(texts, labels, own)
    return shown.select("thread_id", "shown", F.array_join("reply_ids", ",").alias("reply_ids"))


@query("normalize_narrative", """SELECT conv_id, turn, concat('文字', turn, '|相关对象：P1、U2；主题：理由；细节', CASE WHEN turn % 2 = 0 THEN '|有3条格式异常说明已忽略。' ELSE '|有2条格式异常说明已忽略。' END) AS shown FROM conversations""")
def normalize_narrative(t):
    body = F.concat(
        F.lit('["文字'), "turn", F.lit('", {"topic":"主题","reason":"理由","details":"细节","replyId":"P1","relatedReplyIds":["U2","P1"],"offendingReplyIds":["P9"]}, [1], {"note":"x","replyId":"bad"}'),
        F.when(F.col("turn") % 2 == 0, ', "  "]').otherwise("]"),
    )
    shown = reports.normalize_narrative(body, 4000, 100, ["label", "topic"])
    return t.conversations.select("conv_id", "turn", F.array_join(shown, "|").alias("shown"))


@query("parse_finding_results", """SELECT CAST(o_orderkey AS VARCHAR) AS selection_id, CASE WHEN o_orderkey % 5 = 0 THEN 'not_json' WHEN o_orderkey % 5 = 1 THEN 'schema' END AS reject_code,
   CASE WHEN o_orderkey % 5 > 1 THEN 1 ELSE 0 END AS ids, CASE WHEN o_orderkey % 5 > 1 THEN 1 ELSE 0 END AS reasons FROM orders""")
def parse_finding_results(t):
    key = F.col("o_orderkey")
    body = F.to_json(
        F.struct(
            F.lit("s").alias("summary"), F.lit("spam").alias("type"), F.when(key % 5 == 1, 101).otherwise(50).alias("score"), F.array(F.lit("in"), F.lit("out"), F.lit("in")).alias("replyIds"),
            F.array(F.struct(F.lit("in").alias("replyId"), F.lit("e").alias("explanation"))).alias("evidence"),
            F.array(*[F.struct(F.lit(r).alias("reasonId"), F.lit(0.9).alias("confidence"), F.lit("x").alias("rationale")) for r in ["R01.01", "R99.01"]]).alias("reasonCandidates"),
            F.array(F.lit("u")).alias("uncertainties"),
        )
    )
    rows = t.orders.select(key.cast("string").alias("selection_id"), F.when(key % 5 == 0, "```").otherwise(body).alias("content"))
    selected = rows.select("selection_id", F.lit("in").alias("id"))
    allowed = rows.select("selection_id", F.lit("R01.01").alias("reason_id"))
    answers, ids, reasons, _ = reports.parse_finding_results(rows, selected, allowed)
    n_ids = ids.groupBy("selection_id").agg(F.count("*").alias("ids"))
    n_reasons = reasons.groupBy("selection_id").agg(F.count("*").alias("reasons"))
    out = answers.select("selection_id", "reject_code").join(n_ids, "selection_id", "left").join(n_reasons, "selection_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ["ids", "reasons"]})


@query("review_overview", f"""{_CHAIN}, n AS (SELECT attempt_id, count(DISTINCT (candidate_no, group_no)) AS n, max(candidate_no) AS top FROM groups GROUP BY 1),
   s AS (SELECT thread_id, count(*) AS reply_count, CAST(sum(image_count) AS BIGINT) AS image_gap FROM discussion GROUP BY 1)
   SELECT a.attempt_id, coalesce(n.n, 0) AS finding_count, CASE WHEN a.k = 7 THEN 0 ELSE 2 END AS pending, s.reply_count, s.image_gap, CASE WHEN n.top = 1 THEN 'spam' WHEN n.top = 0 THEN 'personal_attack' END AS lead_type,
     CASE WHEN n.top = 1 THEN 'low' WHEN n.top = 0 THEN 'high' END AS lead_severity FROM answers a LEFT JOIN n USING (attempt_id) JOIN s USING (thread_id)""")
def review_overview(t):
    parsed, wires, cands, _, members = _steps(t)
    found = results.thread_findings(cands, members, results.related_context(cands, members, wires))
    return reports.review_overview(parsed, found, t.discussion)


@query("sanitize_result", f"""{_CHAIN}, n AS (SELECT DISTINCT attempt_id, candidate_no, group_no FROM groups) SELECT attempt_id, count(*) AS findings, CAST(0 AS BIGINT) AS leaking FROM n GROUP BY 1""")
def sanitize_result(t):
    _, wires, cands, _, members = _steps(t)
    found = results.thread_findings(cands, members, results.related_context(cands, members, wires))
    planted = F.lit(" user0 assistant1")
    named = found.withColumns({
        "summary": F.concat("summary", planted), "rationale": F.concat(F.lit("user1"), "rationale"),
        "uncertainties": F.transform("uncertainties", lambda u: F.concat(u, planted)),
    })
    names = payloads.author_aliases(t.discussion)
    clean = results.sanitize_result(named, names)
    leak = clean.join(names.select("thread_id", "name"), "thread_id").filter(F.contains(F.concat_ws(" ", "summary", "rationale", "uncertainties"), F.col("name"))).groupBy("attempt_id").agg(F.count("*").alias("leaking"))
    return clean.groupBy("attempt_id").agg(F.count("*").alias("findings")).join(leak, "attempt_id", "left").withColumn("leaking", F.coalesce("leaking", F.lit(0)))


@query("group_references", f"""WITH {DISCUSSION} SELECT thread_id, CASE WHEN is_nested THEN concat(parent_reply_id, '|', author_name) ELSE id END AS group_key, count(*) AS n FROM discussion GROUP BY ALL""")
def group_references(t):
    return results.group_references(t.discussion).groupBy("thread_id", "group_key").agg(F.count("*").alias("n"))


@query("hydrate_evidence", f"""{_CHAIN}, e AS (SELECT *, candidate_no = 0 AND pos IN (1, 3) AS given FROM groups), f AS (SELECT *, bool_or(given) OVER (PARTITION BY attempt_id, candidate_no, group_no) AS any_given,
    row_number() OVER (PARTITION BY attempt_id, candidate_no, group_no ORDER BY place) AS n FROM e)
   SELECT f.attempt_id, f.id, d.author_name, d.floor, d.timestamp_ms FROM f JOIN discussion d USING (thread_id, id) WHERE given OR (NOT any_given AND n = 1)""")
def hydrate_evidence(t):
    _, wires, cands, _, members = _steps(t)
    rows = results.hydrate_evidence(results.finding_evidence(cands, members, wires), t.discussion)
    return rows.select("attempt_id", "id", "author_name", "floor", "timestamp_ms")


@query("create_history", """SELECT page_id, CASE WHEN page_id % 3 = 1 THEN NULL ELSE concat('https://forum.example.org/p/', page_id) END AS thread_url,
   CASE WHEN page_id % 5 = 0 THEN concat('帖子 ', page_id) ELSE concat('a b ', page_id) END AS thread_title FROM pages""")
def create_history(t):
    page = F.col("page_id")
    rows = t.pages.select(
        page, F.when(page % 3 == 1, "1x").otherwise(page.cast("string")).alias("thread_id"), F.concat(F.lit(f"https://{HOST}/p/"), page, F.lit("?pn=3")).alias("thread_url"),
        F.when(page % 5 == 0, "  ").otherwise(F.concat(F.lit(" a \n b "), page)).alias("thread_title"),
    )
    return reports.create_history(rows, HOST).select("page_id", "thread_url", "thread_title")


@query("history_for_thread", "SELECT page_id FROM pages WHERE page_id % 3 <> 1 AND page_id % 2 = 0")
def history_for_thread(t):
    page = F.col("page_id")
    history = t.pages.select(page, page.cast("string").alias("thread_id"), F.concat(F.lit(f"https://{HOST}/p/"), page, F.when(page % 3 == 1, "?pn=1").otherwise("")).alias("thread_url"))
    threads = t.pages.filter(page % 2 == 0).select(page.cast("string").alias("thread_id"), F.concat(F.lit(f"https://{HOST}/p/"), page, F.lit("?pn=2")).alias("thread_url"))
    return reports.history_for_thread(history, threads, HOST).select("page_id")
