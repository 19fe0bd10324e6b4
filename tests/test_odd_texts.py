"""Texts that are blank, missing or end in a line end that is no space."""

from pyspark.sql import functions as F

from threadspark.functions.text import trim, truncate_safe
from threadspark.plans import catalog


def test_blank_and_missing_texts_in_finding_answers(spark, tmp_path):
    texts = ["", " ", "\u3000\n", None, "x" * 1500, "x" * 1501, " " * 701, "x" * 1499 + " \x85", "\x85"]
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {row["doc_id"]: row["faults"] for row in catalog.all_queries()["finding_answer_shapes"](spark, str(tmp_path)).collect()}
    long = "summary(length)"
    assert found == {1: long, 2: long, 3: f"evidence[0].explanation(type)|{long}", 4: "", 5: "", 6: long, 7: f"(unknown)|{long}", 8: long, 9: ""}


def test_trim_stops_at_other_line_ends(spark):
    rows = spark.createDataFrame([(" a \x85",), (" a \n\u2028 ",), (" \x85 ",)], "t string")
    assert [row[0] for row in rows.select(trim(F.col("t"))).collect()] == ["a \x85", "a", "\x85"]


def test_a_token_before_a_line_end_is_not_cut(spark):
    rows = spark.createDataFrame([("甲甲甲甲 u\nx甲甲",), ("甲甲甲甲\n P12345",), ("甲甲甲甲甲 upon",)], "t string")
    assert [row[0] for row in rows.select(truncate_safe(F.col("t"), 8)).collect()] == ["甲甲甲甲 u\n…", "甲甲甲甲…", "甲甲甲甲甲…"]
