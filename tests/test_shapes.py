"""Strict shapes: every kind of fault, both protocols of answers, decisions and history entries."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from threadspark.operators import documents, reports, results
from threadspark.operators.shapes import gathered_issues, listed, number, record, shape_issues, text
from threadspark.sources.rules import rules_table

HOST = "tieba.example.com"


def issues_of(spark, values, shape):
    rows = spark.createDataFrame([(k, json.dumps(v) if not isinstance(v, str) else v) for k, v in enumerate(values)], "k int, j string")
    found = gathered_issues(shape_issues(rows, ["k"], F.try_parse_json("j"), shape), ["k"]).collect()
    return {row["k"]: row["issues"] for row in found}


def test_every_kind_of_fault(spark):
    shape = record({
        "a": text(3, 1), "b": listed(number(0, 5, whole=True), 2, 1), "c": record({"d": text(choices=("x",))}, optional=("d",)), "e": text(pattern="^z+$").or_null(),
    }, optional=("e",))
    fine = {"a": " abc ", "b": [1, 2.0], "c": {}, "e": None}
    cases = [
        (fine, None), ({**fine, "a": "    "}, ["a(length)"]), ({**fine, "a": "abcd"}, ["a(length)"]), ({**fine, "a": 5}, ["a(type)"]),
        ({**fine, "b": []}, ["b(length)"]), ({**fine, "b": [1, 1.5]}, ["b[1](type)"]), ({**fine, "b": [6, -1]}, ["b[0](range)", "b[1](range)"]),
        ({**fine, "b": [True]}, ["b[0](type)"]), ({**fine, "c": {"d": "y"}}, ["c.d(choice)"]), ({**fine, "c": {"secret": 1}}, ["c(unknown)"]),
        ({**fine, "e": "zzy"}, ["e(pattern)"]), ({"a": "x", "b": [1]}, ["(missing)"]), ({**fine, "new": {"deep": [1]}}, ["(unknown)"]),
        ([], ["(type)"]), (7, ["(type)"]), ({**fine, "a": None}, ["a(type)"]),
    ]
    found = issues_of(spark, [value for value, _ in cases], shape)
    assert {k: found.get(k) for k in range(len(cases))} == {k: want for k, (_, want) in enumerate(cases)}
    assert issues_of(spark, ["not json"], shape) == {}


def finding(**more):
    return {
        "type": "spam", "severity": "low", "score": 10, "summary": "s", "offendingReplyIds": ["P1"], "primaryReasonId": "R01.01",
        "confidence": 0.9, "rationale": "r", **more,
    }


def answer(*findings, **more):
    return {"summary": "概要", "findings": list(findings), "report": {"overview": "o", "stages": [], "interactions": [], "notes": []}, **more}


def parsed(spark, bodies):
    rows = [(f"a{k}", "t", json.dumps(body), "stop") for k, body in enumerate(bodies)]
    return results.parse_results(spark.createDataFrame(rows, "attempt_id string, thread_id string, content string, finish_reason string"))


def test_answers_of_both_protocols(spark):
    old = {"summary": "s", "findings": [finding()]}
    bodies = [
        (answer(finding(extra=1)), []), (answer(finding(contextReplyIds=[f"P{k}" for k in range(150)])), ["findings[0].contextReplyIds(length)"]),
        (answer(finding(evidence=[{"replyId": "P1", "explanation": "e"}] * 101)), ["findings[0].evidence(length)"]),
        (answer(finding(evidence=[{"replyId": "P1"}])), ["findings[0].evidence[0](missing)"]),
        (answer(finding(evidence=None, contextReplyIds=None)), []), (answer(finding(offendingReplyIds=[1])), ["findings[0].offendingReplyIds[0](type)"]),
        (answer(finding(summary="长" * 5_000)), []), (answer(protocolVersion=2), ["protocolVersion(range)"]), (answer(protocolVersion=3), []),
        (old, []), ({**old, "findings": [finding(summary="长" * 1_501)]}, ["findings[0].summary(length)"]),
        ({**old, "findings": [finding(rationale="长" * 801)]}, ["findings[0].rationale(length)"]), ({**old, "summary": 5}, ["summary(type)"]),
        ({**old, "findings": [finding(score="50", confidence="90%")]}, []),
    ]
    found = {row["attempt_id"]: row for row in parsed(spark, [body for body, _ in bodies]).collect()}
    for k, (_, want) in enumerate(bodies):
        assert found[f"a{k}"]["issues"] == want, k
        assert found[f"a{k}"]["reject_code"] == ("schema" if want else None)


def test_answers_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(results, "ANSWERS", 5)
    rows = [(f"a{k}", "t", json.dumps(answer(finding())), "stop") for k in range(40)]
    one = spark.createDataFrame(rows, "attempt_id string, thread_id string, content string, finish_reason string").coalesce(1)
    found = results.parse_results(one).select("attempt_id", "reject_code", F.spark_partition_id().alias("task")).collect()
    assert sorted(row["attempt_id"] for row in found) == sorted(f"a{k}" for k in range(40)) and {row["reject_code"] for row in found} == {None}
    assert len({row["task"] for row in found}) > 4


def test_uncertainties_are_cleaned_or_read_as_narrative(spark):
    new = answer(finding(uncertainties=["P1 vs U2", 5, " ", "长" * 200, "R01.01", "four", "five"]))
    old = {"summary": "s", "findings": [finding(uncertainties=["plain P1", {"note": "n", "replyId": "P2"}, 7])]}
    cands = results.candidates(parsed(spark, [new, old]), rules_table(spark)).collect()
    found = {row["attempt_id"]: row["uncertainties"] for row in cands}
    assert found["a0"] == ["相关回复 vs 相关用户", "长" * 159 + "…", "所选规范"]
    assert found["a1"] == ["plain P1", "相关对象：P2；n", "有1条格式异常说明已忽略。"]


def test_overview_keeps_all_sentences(spark):
    body = answer()
    body["report"]["overview"] = "一。二。三。" + "长" * 300
    got = results.report_overview(parsed(spark, [body])).first()["overview"]
    assert got.startswith("一。二。三。长") and len(got) == 240 and got.endswith("…")


def test_legacy_reports(spark):
    base = {"summary": "s", "findings": []}
    bodies = [
        {**base, "report": "只有概览 P1"},
        {**base, "report": {"discussionOverview": {"overview": "对象概览"}, "discussionMap": ["a", {"label": "L", "text": "x", "replyIds": ["P1", "P2"]}, 5], "coverageNotes": "not a list"}},
        {**base, "report": [1]}, {**base}, {**base, "report": {"discussionOverview": "  ", "reviewPriorities": []}},
    ]
    rows = results.legacy_report(parsed(spark, bodies)).collect()
    found = {(row["attempt_id"], row["section"], row["item_no"]): row["text"] for row in rows}
    assert found == {
        ("a0", "discussionOverview", 0): "只有概览 P1", ("a1", "discussionOverview", 0): "对象概览",
        ("a1", "discussionMap", 0): "a", ("a1", "discussionMap", 1): "相关对象：P1、P2；L：x", ("a1", "discussionMap", 2): "有1条格式异常说明已忽略。",
        ("a1", "coverageNotes", 0): "有1条格式异常说明已忽略。",
    }
    labels = spark.createDataFrame([("t", "P1", "第 1 楼", "r1", 1)], "thread_id string, key string, label string, id string, component long")
    local = results.localized_narrative(results.legacy_report(parsed(spark, bodies[:1])), ["attempt_id", "section", "item_no"], labels).first()
    assert local["text"] == "只有概览 第 1 楼" and local["reply_ids"] == ["r1"]


def test_legacy_notes_of_low_confidence(spark):
    low = [finding(summary="低一", confidence=0.3, uncertainties=["共同"]), finding(summary="低二", confidence=0.5, offendingReplyIds=["P2"], uncertainties=["共同", "二"])]
    rows = parsed(spark, [{"summary": "s", "findings": low, "uncertainties": ["自己的", "二"]}])
    cands = results.candidates(rows, rules_table(spark))
    wires = spark.createDataFrame([("t", "P1", "r1", 1, 1, "U1", "x"), ("t", "P2", "r2", 2, 1, "U1", "x")], "thread_id string, wire_id string, id string, pos int, component long, author_alias string, content string")
    offending = results.offending_rows(cands, wires)
    notes = results.legacy_uncertainties(rows, cands, offending, results.claim_replies(offending)).orderBy("note_no").collect()
    assert [row["text"] for row in notes] == ["自己的", "二", "低置信线索（未列为违规）：低二", "共同", "低置信线索（未列为违规）：低一"]


def test_finding_answers_are_strict(spark):
    fine = {"summary": "s", "type": "spam", "score": 50, "replyIds": ["in", "out"], "evidence": [{"replyId": "in", "explanation": " e "}, {"replyId": "out", "explanation": "e"}],
            "reasonCandidates": [{"reasonId": "R01.01", "confidence": 0.5, "rationale": "x"}], "uncertainties": []}
    bad = [{**fine, "more": 1}, {**fine, "score": "50"}, {**fine, "reasonCandidates": fine["reasonCandidates"] * 11}, {**fine, "type": "Spam"},
           {**fine, "evidence": [{"replyId": "in", "explanation": "e", "x": 1}]}, {**fine, "uncertainties": [" "]}, {k: v for k, v in fine.items() if k != "evidence"}]
    rows = [(str(k), json.dumps(body)) for k, body in enumerate([fine, *bad])] + [("x", "{")]
    answers = spark.createDataFrame(rows, "selection_id string, content string")
    selected, allowed = answers.select("selection_id", F.lit("in").alias("id")), answers.select("selection_id", F.lit("R01.01").alias("reason_id"))
    judged, ids, reasons, evidence = reports.parse_finding_results(answers, selected, allowed)
    codes = {row["selection_id"]: row["reject_code"] for row in judged.collect()}
    assert codes == {"0": None, "x": "not_json"} | {str(k): "schema" for k in range(1, len(bad) + 1)}
    assert [tuple(row) for row in ids.collect()] == [("0", "in")] and reasons.count() == 1
    assert [(row["id"], row["explanation"]) for row in evidence.collect()] == [("in", "e")]


def decision(**more):
    return {
        "schemaVersion": "1.0", "id": "00000000-0000-4000-8000-000000000000", "threadId": "12", "threadUrl": f"https://{HOST}/p/12?pn=2", "replyIds": ["1", "1"],
        "decision": "keep", "primaryReasonId": None, "internalTags": ["spam", "spam"], "reviewedAt": "2026-01-02T03:04:05.006Z",
        "analyzerVersions": {"local": "disabled", "cloud": None, "rules": "2026.07"}, **more,
    }


def test_decisions(spark):
    cases = [
        (decision(), []), (decision(content="text of a reply"), ["(unknown)"]), (decision(threadId="13"), ["threadId(mismatch)"]), (decision(threadUrl="https://x.y/p/12"), ["threadUrl(address)"]),
        (decision(primaryReasonId="R99.01"), ["primaryReasonId(rule)"]), (decision(reviewedAt="2026-02-30T00:00:00Z"), ["reviewedAt(date)"]), (decision(reviewedAt="yesterday"), ["reviewedAt(pattern)"]),
        (decision(analyzerVersions={"local": "1.2", "cloud": "x", "rules": "1.0"}), ["analyzerVersions.cloud(pattern)"]), (decision(internalTags=["rude"]), ["internalTags[0](choice)"]),
        (decision(findingId="f:1", snapshotId="z"), ["snapshotId(pattern)"]), (decision(threadId=None), []), ("{", ["(not_json)"]),
    ]
    rows = spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, (v, _) in enumerate(cases)], "k int, json string")
    found = {row["k"]: row for row in documents.read_records(rows, ["k"], rules_table(spark), HOST).collect()}
    assert {k: row["violations"] for k, row in found.items()} == {k: want for k, (_, want) in enumerate(cases)}
    assert found[0]["record"]["threadUrl"] == f"https://{HOST}/p/12" and found[0]["record"]["replyIds"] == ["1"] and found[1]["record"] is None


def test_created_decisions_read_back(spark):
    schema = "thread_id string, thread_url string, reply_ids array<string>, decision string, primary_reason_id string, internal_tags array<string>, analyzer_versions struct<local:string,cloud:string,rules:string>, finding_id string"
    rows = [("12", f"https://{HOST}/p/12?see_lz=1", ["3", "3"], "keep", None, ["spam", "high", "spam"], ("disabled", None, "2026.07"), None), ("13", f"https://{HOST}/p/13", [], "delete", "R01.01", [], ("1.0", "3.0", "2026.07"), "f:1")]
    made = documents.create_records(spark.createDataFrame(rows, schema), HOST, F.lit(datetime(2026, 5, 6, 7, 8, 9)))
    first, again = made.collect(), made.collect()
    assert first == again and len({row["id"] for row in first}) == 2
    read = documents.read_records(made.select(F.col("id").alias("k"), "json"), ["k"], rules_table(spark), HOST).collect()
    assert all(row["violations"] == [] for row in read)
    assert {row["record"]["threadUrl"] for row in read} == {f"https://{HOST}/p/12", f"https://{HOST}/p/13"}


def entry(result=None, **more):
    digest = "a" * 64
    body = {
        "protocolVersion": 3, "summary": "s", "findings": [], "uncertainties": [], "analyzedReplyCount": 3, "ruleCount": 1, "omittedImageCount": 0,
        "report": {"overview": "", "stages": [], "interactions": [], "notes": []},
    }
    return {
        "schemaVersion": 1, "attemptId": "a:1", "snapshotId": digest, "analysisKey": digest, "threadId": "12", "threadUrl": f"https://{HOST}/p/12", "threadTitle": "标题", "provider": "deepseek",
        "model": "m", "mode": "deep", "analyzerVersion": "1", "rulesVersion": "1", "transportVersion": "1", "startedAt": "2026-01-01T00:00:00Z", "completedAt": "2026-01-01T00:00:01+00:00",
        "coverage": {"visibleReplyCount": 3, "imageCount": 0, "unavailableReplyCount": 0}, "result": {**body, **(result or {})},
        "replyRefs": [{"id": "1", "floor": None, "parentReplyId": None, "isNested": False, "sourcePage": 1}], **more,
    }


def test_history_entries(spark):
    one = {"id": "f", "type": "spam", "severity": "low", "score": 5, "summary": "s", "replyIds": ["1"], "participantNames": [], "evidence": [{"replyId": "1", "excerpt": "", "signals": ["x"], "score": 5}], "reasonCandidates": [], "uncertainties": []}
    old = {"protocolVersion": 2, "report": {"discussionOverview": "o"} | {name: [] for name in ("discussionMap", "participantDynamics", "borderlineCases", "normalHeatedDiscussion", "coverageNotes", "reviewPriorities")}}
    cases = [
        (entry(), []), (entry({"findings": [one]}), []), (entry({"findings": [{**one, "evidence": [{**one["evidence"][0], "excerpt": "text"}]}]}), ["result.findings[0].evidence[0].excerpt(choice)"]),
        (entry({"findings": [{**one, "participantNames": ["name"]}]}), ["result.findings[0].participantNames(length)"]), (entry(old), []), (entry({**old, "report": {**old["report"], "extra": 1}}), ["result.report(unknown)"]),
        (entry(threadUrl=f"https://{HOST}/p/12?pn=2"), ["threadUrl(canonical)"]), (entry(threadId="13"), ["threadUrl(mismatch)"]), (entry(completedAt="2025-12-31T00:00:00Z"), ["completedAt(before start)"]),
        (entry({"analyzedReplyCount": 4}), ["result.analyzedReplyCount(count)"]), (entry(usage={"inputTokens": 1, "outputTokens": 1, "totalTokens": 3}), ["usage.totalTokens(sum)"]),
        (entry(provider="other"), ["provider(choice)"]), (entry(threadTitle="a\u0001b"), ["threadTitle(pattern)"]), (entry(replyRefs=[{"id": "1", "floor": 0, "parentReplyId": None, "isNested": False, "sourcePage": 1}]), ["replyRefs[0].floor(range)"]),
        (entry(apiKey="secret"), ["(unknown)"]), (entry({"report": {"overview": "x" * 241, "stages": [], "interactions": [], "notes": []}}), ["result.report.overview(length)"]),
    ]
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, (v, _) in enumerate(cases)], "k int, json string")
    found = {row["k"]: row for row in documents.read_history(rows, ["k"], HOST).collect()}
    assert {k: row["violations"] for k, row in found.items()} == {k: want for k, (_, want) in enumerate(cases)}
    assert found[0]["entry"]["model"] == "m"


@pytest.mark.parametrize("summary", ["user0\x01 said", None, ""])
def test_stored_results_hide_names_in_every_column(spark, summary):
    schema = "thread_id string, attempt_id string, finding_id string, summary string, rationale string, uncertainties array<string>, score int"
    rows = [("t", "a", "f1", summary, "by user0", ["user0", None, "x user0 y"], 1), ("t", "a", "f2", "plain", None, None, 2), ("t", "a", "f3", "p", "q", [], 3)]
    names = spark.createDataFrame([("t", "user0")], "thread_id string, name string")
    found = {row["finding_id"]: row for row in results.sanitize_result(spark.createDataFrame(rows, schema), names).collect()}
    from threadspark import fixed_values as fv

    hidden = fv.HIDDEN_NAME
    assert found["f1"]["summary"] == (summary and summary.replace("user0", hidden)) and found["f1"]["rationale"] == f"by {hidden}"
    assert found["f1"]["uncertainties"] == [hidden, None, f"x {hidden} y"]
    assert (found["f2"]["summary"], found["f2"]["rationale"], found["f2"]["uncertainties"]) == ("plain", None, [])
    assert found["f3"]["uncertainties"] == []


def test_a_document_is_walked_once(spark):
    from threadspark.operators import shapes as sh

    deep = sh.record({"a": sh.listed(sh.record({"b": sh.listed(sh.text(2)), "c": sh.number().or_null()}, optional=("c",)))})
    rows = spark.range(1).select("id", F.lit('{"a":[{"b":["xxx",1],"c":null},{"z":1},null]}').alias("json"))
    found = sh.shape_issues(rows, ["id"], F.try_parse_json("json"), deep)
    assert sorted((r["path"], r["kind"]) for r in found.collect()) == [
        ("a[0].b[0]", "length"), ("a[0].b[1]", "type"), ("a[1]", "missing"), ("a[1]", "unknown"), ("a[2]", "type"),
    ]
    assert found._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
