"""What a result cites: every part of it, whichever reply of a thread, with findings or without."""

import json

from threadspark.operators import results
from threadspark.plans import catalog


def test_every_part_of_a_result_cites(spark, tmp_path):
    rows = [(conv, turn, ("user", "assistant")[turn % 2], f"text {turn}") for conv in (3, 4, 5) for turn in range(24)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {}
    for row in catalog.all_queries()["reply_refs"](spark, str(tmp_path)).collect():
        assert row["floor"] == int(row["id"].split("-")[1]) + 1 and row["is_nested"] == (row["floor"] % 3 == 0)
        found.setdefault(row["attempt_id"], set()).add(row["floor"])
    first, last = set(range(1, 21)), set(range(21, 25))
    # with findings: all but context that is not related to them
    assert found["3-0"] >= {p for p in first if p % 8 != 4} and found["5-1"] >= last
    # without: stages, interactions, notes, and main replies whose floors the summary tells
    assert found["4-0"] == {p for p in first if p % 8 not in (1, 2) or p % 3} and found["3-1"] == last
    # older: overview and list of the report, at least
    assert found["5-0"] >= {p for p in first if p % 8 in (7, 0)} and found["4-1"] >= {p for p in last if p % 8 in (7, 0)}


def test_prose_of_a_finding_cites_its_own_component(spark):
    finding = {
        "type": "insult", "severity": "low", "score": 10, "summary": "P3 和 P4", "offendingReplyIds": ["P1", "P2"], "primaryReasonId": "R01.01", "confidence": 0.9,
        "rationale": "r", "uncertainties": ["P5"], "evidence": [{"replyId": "P2", "explanation": "P3 与 P6"}, {"replyId": "P2", "explanation": "P7"}],
    }
    body = {"summary": "P8", "findings": [finding], "uncertainties": ["P9"], "report": {"discussionMap": [{"text": "x", "replyIds": ["P10"]}]}}
    replies = [(k, f"r{k}", 2 if k in (2, 6, 7) else 11 if k == 4 else 1) for k in range(1, 12)]

    def cited(components):
        wires = spark.createDataFrame(
            [("t", f"P{k}", name, k, components.get(k, of), "U1", f"text {k}") for k, name, of in replies],
            "thread_id string, wire_id string, id string, pos int, component long, author_alias string, content string",
        )
        labels = wires.selectExpr("thread_id", "wire_id as key", "id as label", "id", "component")
        parsed = results.parse_results(spark.createDataFrame([("a", "t", json.dumps(body), "stop")], "attempt_id string, thread_id string, content string, finish_reason string"))
        cands = results.candidates(parsed, spark.createDataFrame([("R01.01",)], "rule_id string"))
        offending = results.offending_rows(cands, wires)
        members = results.split_offending(results.claim_replies(offending), wires)
        summaries = parsed.selectExpr("attempt_id", "'看 P8' as summary")
        rows = results.prose_references(parsed, cands, offending, members, summaries, labels, wires).collect()
        return {one for row in rows for one in row["reply_ids"]}

    whole = {"r8", "r9", "r10"}
    # split: its prose is replaced, but uncertainties and evidence stay; evidence cites the group of its reply only
    assert cited({}) == whole | {"r5", "r6"}
    # one group: prose, too; of other components nothing
    assert cited({2: 1, 6: 1, 7: 1}) == whole | {"r3", "r5", "r6"}
