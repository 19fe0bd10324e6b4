from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from threadspark.functions import privacy
from threadspark.operators import payloads


def _redact(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(privacy.redact_sensitive(F.col("t"))).first()[0]


def test_all_kinds(spark):
    text = "电话13812345678，邮箱 a.b@example.com，证件11010519491231002X，QQ：12345678，微信号 abc_def123，座机 010-12345678"
    shown = _redact(spark, text)
    for mark in ["[手机号]", "[邮箱]", "[身份证]", "[QQ号]", "[微信号]", "[电话]"]:
        assert mark in shown
    assert "138" not in shown and "example" not in shown


def test_long_number_is_not_a_phone(spark):
    assert _redact(spark, "9138123456781") == "9138123456781"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["13912345678", "a@b.co", "qq 99999", "vx abcdef1", " ", "中", "x", "0571-1234567", "\n"]), max_size=8))
def test_redaction_leaves_no_match(spark, parts):
    frame = spark.createDataFrame([("".join(parts),)], "t string").select(privacy.redact_sensitive(F.col("t")).alias("r"))
    assert frame.select(privacy.contains_sensitive(F.col("r"))).first()[0] is False


def test_names(make_replies):
    rows = make_replies(
        ("小明", "我是小明"), ("小明明", "小明明和小明 @U1 @路人 回复 阿三：好"), ("a.b", "a.b 与 axb"), (" ", "mail x@小明.com"),
    )
    out = {r["id"]: (r["author_alias"], r["redacted"]) for r in payloads.redacted_replies(rows).collect()}
    assert out["r1"] == ("U1", "我是U1")
    assert out["r2"] == ("U2", "U2和U1 @[用户名] @[用户名] 回复 [用户名]：好")
    assert out["r3"] == ("U3", "U3 与 axb")
    assert out["r4"][0] == "U0"


def test_leaking_thread_is_blocked(make_replies, spark):
    rows = make_replies(("U1", "hello"), ("bob", "x"))
    titles = spark.createDataFrame([("t", "标题 bob")], "thread_id string, title string")
    built = payloads.build_thread_payloads(rows.withColumn("content", F.lit("bob 说 hi")), titles).first()
    assert built["status"] == "ok" and "bob" not in built["payload"]
    leaking = make_replies(("U2", "hello"), ("bob", "bob 说"))
    blocked = payloads.build_thread_payloads(leaking, titles).first()
    assert blocked["status"] == "privacy_guard" and blocked["payload"] is None
