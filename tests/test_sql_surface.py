"""SQL text gives what the DataFrame functions give."""

from pyspark.sql import functions as F

from threadspark.functions import sql_surface
from threadspark.functions.privacy import NEEDS, contains_sensitive, redact_sensitive
from threadspark.functions.text import estimate_tokens

TEXTS = ["", "plain", "call 13800138000 now", "mail a.b@example.com 'x' \\d", "微信：abc_12345", "QQ 123456789", "11010519491231002X", "日本語 😀 text", "\n\t\x00", None]


def test_functions_equal_the_columns(spark):
    assert sql_surface.register_functions(spark) == ["redact_sensitive", "contains_sensitive", "estimate_tokens"]
    spark.createDataFrame([(k, text) for k, text in enumerate(TEXTS)], "k int, body string").createOrReplaceTempView("sql_texts")
    found = spark.sql("SELECT k, redact_sensitive(body) AS r, contains_sensitive(body) AS c, estimate_tokens(body) AS t FROM sql_texts")
    value = F.col("body")
    plain = spark.table("sql_texts").select("k", redact_sensitive(value).alias("r"), contains_sensitive(value).alias("c"), estimate_tokens(value).alias("t"))
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == sorted(map(tuple, plain.collect()), key=lambda r: r[0])
    assert found.filter("c").count() >= 3


def test_costly_patterns_run_only_where_they_can_match(spark):
    bodies = sql_surface.function_bodies()
    for name in ("redact_sensitive", "contains_sensitive"):
        assert [need for need in NEEDS if f"RLIKE {sql_surface._literal(need)}" not in bodies[name][1]] == []
    sql_surface.register_functions(spark)
    texts = ["词" * 5_000 + "😀" * 3 + "a" * 4, "a" * 20_000, "微信号：ABC_12345 a@b.cc QQ：12345", "+86 0571-1234567 v x abcdef", "110105194912310021 13800138000"]
    spark.createDataFrame([(k, text) for k, text in enumerate(texts)], "k int, body string").createOrReplaceTempView("sql_long_texts")
    found = spark.sql("SELECT k, redact_sensitive(body) AS r, contains_sensitive(body) AS c, estimate_tokens(body) AS t FROM sql_long_texts ORDER BY k").collect()
    assert [row["r"] for row in found] == [*texts[:2], "[微信号] [邮箱] [QQ号]", "[电话] [微信号]", "[身份证] [手机号]"]
    assert [(row["c"], row["t"]) for row in found[:2]] == [(False, 5_008), (False, 6_667)]


def test_view_of_redacted_replies(spark, make_replies):
    sql_surface.register_redacted(make_replies(("小明", "@小红 电话 13800138000"), ("小红", "小明说过")), "redacted_test")
    rows = {row["id"]: row for row in spark.sql("SELECT id, author_alias, redacted FROM redacted_test").collect()}
    assert rows["r1"]["author_alias"] == "U1" and "小红" not in rows["r1"]["redacted"] and "13800138000" not in rows["r1"]["redacted"]
