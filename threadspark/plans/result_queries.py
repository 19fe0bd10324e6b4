"""Queries over model answers.  Each thread gets one answer that Spark builds from its replies."""

from pyspark.sql import functions as F

from threadspark.operators import graph, payloads, relations, reports, results
from threadspark.plans.registry import DISCUSSION, query
from threadspark.plans.thread_queries import _COMPONENTS, _EDGES, _NAMES, _UNDIRECTED
from threadspark.session import cut_lineage
from threadspark.sources.rules import rules_table


def _answers(t):
    conv = F.col("thread_id").cast("bigint")

    def finding(kind, level, score, sure, reason, offending, context, evidence):
        return F.struct(
            F.lit(kind).alias("type"), F.lit(level).alias("severity"), F.lit(score).alias("score"), F.lit("P1 在吵架。").alias("summary"),
            F.array(*[F.lit(x) for x in offending]).alias("offendingReplyIds"), F.array(*[F.lit(x) for x in context]).cast("array<string>").alias("contextReplyIds"),
            F.array(*[F.struct(F.lit(e).alias("replyId"), F.lit("证据").alias("explanation")) for e in evidence]).alias("evidence"),
            reason.alias("primaryReasonId"), F.lit(sure).alias("confidence"), F.lit("理由").alias("rationale"), F.array(F.lit("不确定")).alias("uncertainties"),
        )

    findings = F.array(
        finding("Insult", "High", "80", "90%", F.lit("R03.01"), ["P1", "P3", "P2"], ["P4", "P5"], ["P3", "P1"]),
        finding("flooding", "低", "30", "0.95", F.lit("R06.05"), ["P2", "P9999"], [], ["P4"]),
        finding("other", "medium", "50", "0.5", F.when(conv % 3 == 0, "R99.01").otherwise("R16.06"), ["P1", "P4"], [], ["P4"]),
    )
    note = F.struct(F.lit("needs_human_check").alias("kind"), F.lit("看").alias("title"), F.lit("看 P2").alias("summary"), F.array(F.lit("P2"), F.lit("p3")).alias("replyIds"))
    stages = [
        F.struct(F.lit(f"阶段{n}").alias("title"), F.lit(f"P{n} 发言").alias("summary"), F.array(*[F.lit(x) for x in ids]).alias("replyIds"))
        for n, ids in ((1, ["P2", "P1", "P2"]), (2, ["P9999", "p1"]), (3, ["P3"]))
    ]
    body = F.to_json(
        F.struct(
            F.lit("第一句。第二句。第三句。").alias("summary"), findings.alias("findings"),
            F.struct(
                F.concat(F.lit("概览 P"), "thread_id", F.lit("。第二句。第三句。")).alias("overview"), F.array(*stages).alias("stages"),
                F.array(stages[0].withField("title", F.concat(F.lit("互动"), "thread_id"))).alias("interactions"), F.array(note, note).alias("notes"),
            ).alias("report"),
        )
    )
    content = (
        F.when(conv % 10 == 7, F.lit("sorry, no"))
        .when(conv % 10 == 8, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(conv % 20 == 19, F.replace(body, F.lit('"type":"flooding"'), F.lit('"type":"banana"')))
        .when(conv % 10 == 9, F.regexp_replace(body, '"score":"80"', '"score":"800"'))
        .otherwise(body)
    )
    return t.discussion.select("thread_id").distinct().select(
        F.concat(F.lit("a"), "thread_id").alias("attempt_id"), "thread_id", content.alias("content"),
        F.when(conv % 10 == 6, "length").otherwise("stop").alias("finish_reason"),
    )


def _wires(t, *more):
    found = graph.reply_components(t.discussion, relations.reply_edges(t.discussion)).drop("pos")
    alias = payloads.author_aliases(t.discussion).select("thread_id", F.col("name").alias("author_name"), F.col("alias").alias("author_alias"))
    rows = payloads.wire_ids(t.discussion).join(found, ["thread_id", "id"]).join(alias, ["thread_id", "author_name"], "left")
    return cut_lineage(rows.select("thread_id", "wire_id", "id", "pos", "component", "author_alias", "content", *more))


def _offending(t, answers=None, wires=None):
    parsed = cut_lineage(results.parse_results(_answers(t) if answers is None else answers))
    wires = _wires(t) if wires is None else wires
    cands = results.candidates(parsed, rules_table(t.spark))
    return parsed, wires, cands, cut_lineage(results.offending_rows(cands, wires))


def _steps(t, answers=None, wires=None):
    parsed, wires, cands, offending = _offending(t, answers, wires)
    members = cut_lineage(results.split_offending(results.claim_replies(offending), wires))
    return parsed, wires, cands, offending, members


_ANSWERS = """answers AS (SELECT DISTINCT thread_id, concat('a', thread_id) AS attempt_id, CAST(thread_id AS BIGINT) % 10 AS k, CAST(thread_id AS BIGINT) % 3 AS m FROM discussion),
 good AS (SELECT * FROM answers WHERE k NOT IN (6, 7, 9)),
 off AS (SELECT g.attempt_id, g.thread_id, c.candidate_no, c.conf, c.place, d.id, d.pos FROM good g
   JOIN (VALUES (0, 0.9, 0, 1), (0, 0.9, 1, 3), (0, 0.9, 2, 2), (1, 0.95, 0, 2), (2, 0.5, 0, 1), (2, 0.5, 1, 4)) c(candidate_no, conf, place, p) ON NOT (c.candidate_no = 2 AND g.m = 0)
   JOIN discussion d ON d.thread_id = g.thread_id AND d.pos = c.p),
 claimed AS (SELECT * FROM off WHERE conf >= 0.7 QUALIFY row_number() OVER (PARTITION BY attempt_id, id ORDER BY conf DESC, candidate_no) = 1),
 chained AS (SELECT c.*, k.component FROM claimed c JOIN components k USING (thread_id, pos)),
 groups AS (SELECT *, dense_rank() OVER (PARTITION BY attempt_id, candidate_no ORDER BY head) AS group_no FROM (SELECT *, min(place) OVER (PARTITION BY attempt_id, candidate_no, component) AS head FROM chained))"""
_CHAIN = f"WITH RECURSIVE {DISCUSSION}, {_NAMES}, {_EDGES}, {_UNDIRECTED}, {_COMPONENTS}, {_ANSWERS}"


@query("parse_results", f"""WITH {DISCUSSION}, {_ANSWERS.split(', off AS')[0].split(' off AS')[0].rstrip().rstrip(',')} SELECT attempt_id, CASE k WHEN 6 THEN 'truncated_output' WHEN 7 THEN 'not_json' WHEN 9 THEN 'schema' END AS reject_code,
   CASE WHEN CAST(thread_id AS BIGINT) % 20 = 19 THEN 'findings[1].type(enum)' WHEN k = 9 THEN 'findings[0].score(number)' ELSE CASE WHEN k = 7 THEN 'summary(missing)|findings(type)' ELSE '' END END AS issues, CASE WHEN k = 7 THEN 2 ELSE 3 END AS protocol FROM answers""")
def parse_results(t):
    return results.parse_results(_answers(t)).select("attempt_id", "reject_code", F.array_join("issues", "|").alias("issues"), "protocol")


@query("claim_replies", f"{_CHAIN} SELECT attempt_id, id, candidate_no FROM claimed")
def claim_replies(t):
    offending = _offending(t)[3]
    return results.claim_replies(offending).select("attempt_id", "id", "candidate_no")


@query("split_offending", f"{_CHAIN} SELECT attempt_id, candidate_no, id, group_no FROM groups")
def split_offending(t):
    return _steps(t)[4].select("attempt_id", "candidate_no", "id", "group_no")


@query("related_context", f"""{_CHAIN} SELECT DISTINCT g.attempt_id, g.candidate_no, g.group_no, d.id FROM groups g JOIN discussion d ON d.thread_id = g.thread_id AND d.pos IN (4, 5)
   JOIN components k ON k.thread_id = d.thread_id AND k.pos = d.pos AND k.component = g.component WHERE g.candidate_no = 0""")
def related_context(t):
    _, wires, cands, _, members = _steps(t)
    return results.related_context(cands, members, wires).select("attempt_id", "candidate_no", "group_no", "id")


@query("thread_findings", f"""{_CHAIN}, n AS (SELECT attempt_id, candidate_no, max(group_no) AS groups FROM groups GROUP BY ALL)
   SELECT attempt_id, concat_ws('-', 'AI', candidate_no + 1, group_no, CASE candidate_no WHEN 0 THEN 'personal_attack' ELSE 'spam' END, arg_min(id, place)) AS finding_id,
   string_agg(id, ',' ORDER BY place) AS reply_ids, groups > 1 AS was_split, CASE candidate_no WHEN 0 THEN 'high' ELSE 'low' END AS severity FROM groups JOIN n USING (attempt_id, candidate_no) GROUP BY attempt_id, candidate_no, group_no, groups""")
def thread_findings(t):
    _, wires, cands, _, members = _steps(t)
    rows = results.thread_findings(cands, members, results.related_context(cands, members, wires))
    return rows.select("attempt_id", "finding_id", F.array_join("reply_ids", ",").alias("reply_ids"), (F.size("uncertainties") > 1).alias("was_split"), "severity")


@query("finding_evidence", f"""{_CHAIN}, e AS (SELECT *, candidate_no = 0 AND pos IN (1, 3) AS given FROM groups), f AS (SELECT *, bool_or(given) OVER (PARTITION BY attempt_id, candidate_no, group_no) AS any_given,
    row_number() OVER (PARTITION BY attempt_id, candidate_no, group_no ORDER BY place) AS n FROM e)
   SELECT attempt_id, candidate_no, group_no, id, CASE WHEN given THEN 'AI：证据' ELSE 'AI：模型标记该回复，需结合前后文人工复核' END AS signal FROM f WHERE given OR (NOT any_given AND n = 1)""")
def finding_evidence(t):
    _, wires, cands, _, members = _steps(t)
    return results.finding_evidence(cands, members, wires).select("attempt_id", "candidate_no", "group_no", "id", "signal")


@query("demote_low_confidence", f"""{_CHAIN} SELECT o.attempt_id, '相关回复 在吵架。；不确定' AS summary, string_agg(o.id, ',' ORDER BY place) AS reply_ids FROM off o
   WHERE conf < 0.7 AND (o.attempt_id, o.id) NOT IN (SELECT (attempt_id, id) FROM claimed) GROUP BY o.attempt_id""")
def demote_low_confidence(t):
    _, _, cands, offending, members = _steps(t)
    rows = results.demote_low_confidence(cands, offending, members)
    return rows.select("attempt_id", "summary", F.array_join("reply_ids", ",").alias("reply_ids"))


@query("report_notes", f"""WITH {DISCUSSION}, {_ANSWERS} SELECT g.attempt_id, n AS item_no, 'needs_human_check' AS kind, '看 相关回复' AS summary, coalesce(d.id, '') AS reply_ids
   FROM good g CROSS JOIN (VALUES (0), (1)) v(n) LEFT JOIN discussion d ON d.thread_id = g.thread_id AND d.pos = 2""".replace(_ANSWERS, _ANSWERS.split(" off AS")[0].rstrip().rstrip(",")))
def report_notes(t):
    parsed = cut_lineage(results.parse_results(_answers(t)))
    rows = results.report_notes(parsed, _wires(t))
    return rows.select("attempt_id", "item_no", "kind", "summary", F.array_join("reply_ids", ",").alias("reply_ids"))


@query("report_overview", f"""WITH {DISCUSSION}, {_ANSWERS.split(" off AS")[0].rstrip().rstrip(",")} SELECT attempt_id, '概览 相关回复。第二句。第三句。' AS overview FROM good""")
def report_overview(t):
    return results.report_overview(results.parse_results(_answers(t)))


@query("report_items", f"""WITH {DISCUSSION}, {_ANSWERS.split(" off AS")[0].rstrip().rstrip(",")}, v(section, item_no, title, ids) AS (VALUES ('stages', 0, '阶段1', [2, 1]), ('stages', 1, '阶段2', []::INT[]), ('interactions', 0, NULL, [2, 1])),
   u AS (SELECT g.attempt_id, g.thread_id, v.section, v.item_no, coalesce(v.title, concat('互动', g.thread_id)) AS title, unnest(v.ids) AS p, unnest(range(1, len(v.ids) + 1)) AS k FROM good g CROSS JOIN v)
   SELECT g.attempt_id, v.section, v.item_no, coalesce(v.title, concat('互动', g.thread_id)) AS title, '相关回复 发言' AS summary,
     coalesce((SELECT string_agg(d.id, ',' ORDER BY u.k) FROM u JOIN discussion d ON d.thread_id = u.thread_id AND d.pos = u.p WHERE u.attempt_id = g.attempt_id AND u.section = v.section AND u.item_no = v.item_no), '') AS reply_ids
   FROM good g CROSS JOIN v""")
def report_items(t):
    parsed = cut_lineage(results.parse_results(_answers(t)))
    rows = results.report_items(parsed, _wires(t), max_items={"stages": 2, "interactions": 5}, max_ids=50)
    return rows.withColumn("reply_ids", F.array_join("reply_ids", ","))


@query("projected_uncertainties", f"""{_CHAIN}, low AS (SELECT o.attempt_id, string_agg(o.id, ',' ORDER BY place) AS reply_ids FROM off o WHERE conf < 0.7 AND (o.attempt_id, o.id) NOT IN (SELECT (attempt_id, id) FROM claimed) GROUP BY 1)
   SELECT g.attempt_id, CAST(n + 1 AS INTEGER) AS note_no, '看 相关回复' AS text, coalesce(d.id, '') AS reply_ids FROM good g CROSS JOIN (VALUES (0), (1)) v(n) LEFT JOIN discussion d ON d.thread_id = g.thread_id AND d.pos = 2
   UNION ALL SELECT attempt_id, 3, '相关回复 在吵架。；不确定', reply_ids FROM low""")
def projected_uncertainties(t):
    parsed, wires, cands, offending, members = _steps(t)
    notes = results.merged_notes(results.report_notes(parsed, wires, 5, 3, 50), results.demote_low_confidence(cands, offending, members), max_checks=5)
    return results.projected_uncertainties(notes).withColumn("reply_ids", F.array_join("reply_ids", ","))


@query("override_summary", f"""{_CHAIN}, n AS (SELECT attempt_id, count(DISTINCT (candidate_no, group_no)) AS kept FROM groups GROUP BY 1)
   SELECT g.attempt_id, CASE WHEN kept > 0 THEN concat('模型候选经回复关系与协议校验后整理为 ', kept, ' 组，以下方线索卡和原文复核为准。') ELSE '模型候选经回复关系与协议校验后，未保留达到门槛的违规线索；以审阅报告和人工复核为准。' END AS summary FROM good g LEFT JOIN n USING (attempt_id)""")
def override_summary(t):
    parsed, wires, cands, offending, members = _steps(t)
    context = results.related_context(cands, members, wires)
    return results.override_summary(parsed, results.structure_changed(cands, offending, members, context, wires))


def _citing_answers(wires):
    """An answer for every twenty replies of a thread, which cites each of them in the part that its position tells.

    A third have findings, context, evidence, stages, interactions and notes; a third no finding, so that the summary stays the
    model's own and tells floors; a third are in the older protocol and name replies in prose.
    """
    block, part = F.floor((F.col("pos") - 1) / 20), F.col("pos") % 8
    one = F.struct("pos", part.alias("part"), "wire_id", "floor")
    rows = wires.select("thread_id", block.alias("block"), one.alias("one")).groupBy("thread_id", "block").agg(F.array_sort(F.collect_list("one")).alias("all"))

    def listed(*parts, field="wire_id"):
        return F.transform(F.filter("all", lambda r: r["part"].isin(*parts)), lambda r: r[field])

    def told(*parts):
        return F.concat(F.lit("见 "), F.array_join(listed(*parts), "、"))

    def finding(kind, sure, reason, offending, context=None, evidence=None, summary=None, rationale=None, doubts=None):
        none = F.array().cast("array<string>")
        return F.struct(
            F.lit(kind).alias("type"), F.lit("high").alias("severity"), F.lit(80).alias("score"), (F.lit("概要") if summary is None else summary).alias("summary"),
            listed(*offending).alias("offendingReplyIds"), (none if context is None else context).alias("contextReplyIds"),
            F.transform(none if evidence is None else listed(*offending), lambda e: F.struct(e.alias("replyId"), (F.lit("证据") if evidence is None else evidence).alias("explanation"))).alias("evidence"),
            F.lit(reason).alias("primaryReasonId"), F.lit(sure).alias("confidence"), (F.lit("理由") if rationale is None else rationale).alias("rationale"),
            F.array(F.lit("不确定") if doubts is None else doubts).alias("uncertainties"),
        )

    def held(*findings):
        return F.filter(F.array(*findings), lambda f: F.size(f["offendingReplyIds"]) > 0)

    def report(stages, interactions, notes):
        def item(ids):
            # an id of no reply and one of another case cite nothing
            return F.struct(F.lit("题").alias("title"), F.lit("述").alias("summary"), F.concat(F.array(F.lit("P0"), F.lit("p1")), ids).alias("replyIds"))

        return F.struct(
            F.lit("概览").alias("overview"), F.array(item(listed(*stages))).alias("stages"), F.array(item(listed(*interactions))).alias("interactions"),
            F.array(item(listed(*notes)).withField("kind", F.lit("needs_human_check"))).alias("notes"),
        )

    floors = F.concat(F.lit("见"), F.array_join(F.transform(listed(1, 2, field="floor"), lambda f: F.concat(F.lit("第 "), f, F.lit(" 楼"))), "、"))
    heated = F.to_json(F.struct(
        F.lit("概要").alias("summary"),
        held(
            finding("insult", "90%", "R03.01", (1, 2), context=listed(4), evidence=F.lit("证据")), finding("flooding", "0.95", "R06.05", (3,)),
            finding("other", "0.5", "R16.06", (5,)),
        ).alias("findings"),
        report((6,), (7,), (0,)).alias("report"),
    ))
    calm = F.to_json(F.struct(floors.alias("summary"), F.filter(held(finding("insult", "0.9", "R03.01", (1,))), lambda f: F.lit(False)).alias("findings"), report((3, 6), (4, 7), (5, 0)).alias("report")))
    older = F.to_json(F.struct(
        told(6).alias("summary"), held(finding("insult", "0.9", "R03.01", (1,), evidence=told(5), summary=told(2), rationale=told(3), doubts=told(4))).alias("findings"),
        F.struct(told(7).alias("discussionOverview"), F.array(F.struct(F.lit("理由").alias("reason"), listed(0).alias("replyIds"))).alias("discussionMap")).alias("report"),
    ))
    kind = (F.col("thread_id").cast("bigint") + F.col("block")) % 3
    return rows.select(
        F.concat_ws("-", "thread_id", "block").alias("attempt_id"), "thread_id", F.when(kind == 0, heated).when(kind == 1, calm).otherwise(older).alias("content"),
        F.lit("stop").alias("finish_reason"),
    )


@query("reply_refs", f"""WITH RECURSIVE {DISCUSSION}, {_NAMES}, {_EDGES}, {_UNDIRECTED}, {_COMPONENTS},
   placed AS (SELECT d.*, k.component, (pos - 1) // 20 AS block, (CAST(thread_id AS BIGINT) + (pos - 1) // 20) % 3 AS kind, pos % 8 AS part FROM discussion d JOIN components k USING (thread_id, pos)),
   held AS (SELECT DISTINCT thread_id, block, component, true AS related FROM placed WHERE part = 1 OR (kind = 0 AND part = 2)),
   parts AS (SELECT thread_id, block, count(*) AS n FROM held GROUP BY ALL)
   SELECT concat_ws('-', thread_id, block) AS attempt_id, id, floor, is_nested, source_page FROM placed LEFT JOIN held USING (thread_id, block, component) LEFT JOIN parts USING (thread_id, block)
   WHERE CASE kind WHEN 0 THEN part <> 4 OR related WHEN 1 THEN part NOT IN (1, 2) OR NOT is_nested
     ELSE CASE WHEN part IN (2, 3) THEN related AND n = 1 WHEN part IN (4, 5) THEN related WHEN part = 6 THEN coalesce(n, 0) <= 1 ELSE true END END""")
def reply_refs(t):
    wires = _wires(t, "floor", "is_nested", "source_page", "author_name")
    parsed, wires, cands, offending, members = _steps(t, _citing_answers(wires), wires)
    context = cut_lineage(results.related_context(cands, members, wires))
    # stored part by part: all of them in one plan are more than a small driver holds
    notes = [cut_lineage(rows.select("attempt_id", "reply_ids")) for rows in (results.report_notes(parsed, wires), results.demote_low_confidence(cands, offending, members))]
    items = cut_lineage(results.report_items(parsed, wires).select("attempt_id", "reply_ids"))
    summaries = cut_lineage(results.override_summary(parsed, results.structure_changed(cands, offending, members, context, wires)))
    prose = cut_lineage(results.prose_references(parsed, cands, offending, members, summaries, reports.reference_labels(wires), wires))
    found = cut_lineage(results.thread_findings(cands, members, context).select("attempt_id", "thread_id", "reply_ids", "context_reply_ids"))
    evidence = results.finding_evidence(cands, members, wires)
    rows = results.reply_refs(parsed, found, evidence, [*notes, items, prose], t.discussion)
    return rows.select("attempt_id", "id", "floor", "is_nested", "source_page")
