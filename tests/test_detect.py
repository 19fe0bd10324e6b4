from pyspark.sql import functions as F

from threadspark.operators import detect
from threadspark.sources.rules import rules_table

MINUTE = 60_000


def _findings(spark, replies):
    """Largest finding per risk type."""
    rows = detect.analyze_replies(replies, rules_table(spark)).collect()
    return {row["risk_type"]: row for row in sorted(rows, key=lambda r: r["reply_count"])}


def test_repeated_text_is_spam(spark, make_replies):
    found = _findings(spark, make_replies(*[("甲", "买号加我！")] * 3))
    assert set(found) == {"spam"}
    assert found["spam"]["reply_count"] == 3 and found["spam"]["score"] >= 48
    assert found["spam"]["reason_candidates"][0]["reason_id"] == "R06.05"


def test_mutual_burst_raises_provocation(spark, make_replies):
    rows = [
        {"author": "甲" if n % 2 else "乙", "content": "急了吧", "parent_reply_id": f"r{n - 1}" if n > 1 else None, "timestamp_ms": n * MINUTE}
        for n in range(1, 6)
    ]
    found = _findings(spark, make_replies(*rows))
    labels = {label for e in found["provocation"]["evidence"] for label in e["labels"]}
    assert any(label.startswith("双方连续互回") for label in labels)
    assert any(label.startswith("10分钟内密集互回") for label in labels)


def test_calm_exchange_has_no_finding(spark, make_replies):
    rows = [{"author": "甲" if n % 2 else "乙", "content": f"第{n}点看法", "timestamp_ms": n * MINUTE} for n in range(1, 6)]
    assert _findings(spark, make_replies(*rows)) == {}


def test_burst_equals_brute_force(spark):
    import random

    rng = random.Random(7)
    events = [(rng.choice("ab"), rng.randrange(0, 4000), rng.randrange(0, 3)) for _ in range(400)]
    frame = spark.createDataFrame(events, "g string, timestamp_ms bigint, risk int")
    got = {r["g"]: (r["start_ms"], r["n"]) for r in detect.earliest_burst(frame, ["g"], 50, 9, 8).collect()}
    want = {}
    for g in "ab":
        for start in sorted(t for k, t, _ in events if k == g):
            inside = [(t, r) for k, t, r in events if k == g and start <= t <= start + 50]
            if len(inside) >= 9 and sum(r for _, r in inside) >= 8:
                want[g] = (start, len(inside))
                break
    assert got == want


def test_lexical_scores_clamp(spark, make_replies):
    rows = make_replies(("甲", "@乙 傻逼 死妈 废物 你有病 滚"))
    score = detect.lexical_scores(rows).select("score_personal_attack").first()[0]
    assert score == 100


def test_reason_candidates_rank(spark):
    rows = detect.reason_candidates(rules_table(spark)).filter(F.col("risk_type") == "harassment").orderBy("rank").collect()
    assert [r["rule_id"] for r in rows] == ["R04.07", "R05.01", "R01.04"]
    assert [round(r["confidence"], 2) for r in rows] == [0.94, 0.82, 0.7]
