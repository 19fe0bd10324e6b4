"""Searching the rule library and showing its rules inside prose.

The library is fixed (112 rules), so it travels as one array literal inside each row.
"""

from pyspark.sql import Column, DataFrame, functions as F

from threadspark import fixed_values as fv
from threadspark.functions.text import trim
from threadspark.rule_library import RULE_LIBRARY


def rule_array() -> Column:
    rows = [
        F.struct(
            F.lit(f"{key}.{i:02d}").alias("rule_id"), F.lit(key).alias("category_id"), F.lit(title).alias("title"), F.lit(text).alias("text"),
            F.lit(len(texts)).alias("total"),
        )
        for key, (title, texts) in RULE_LIBRARY.items()
        for i, text in enumerate(texts, 1)
    ]
    return F.array(*rows)


def search_rules(queries: DataFrame) -> DataFrame:
    """Matches of every ``query_id, query, category`` in library order: ``match_no, rule_id, category_id``.

    The category filter applies only to an empty query; ``all`` or null means every category.
    """
    text = F.lower(trim(F.coalesce("query", F.lit(""))))

    def matches(rule):
        found = F.lower(rule["rule_id"]).contains(text) | F.lower(rule["title"]).contains(text) | F.lower(rule["text"]).contains(text)
        in_category = F.col("category").isNull() | (F.col("category") == "all") | (rule["category_id"] == F.col("category"))
        return F.when(text == "", in_category).otherwise(found)

    rows = queries.select("query_id", F.posexplode(F.filter(rule_array(), matches)).alias("n", "r"))
    return rows.select("query_id", (F.col("n") + 1).alias("match_no"), "r.rule_id", "r.category_id", "r.total")


def rule_counts(matches: DataFrame, visible: int) -> DataFrame:
    """Per query and category shown on the first page of ``visible`` rules: shown, matched and total rules."""
    return (
        matches.groupBy("query_id", "category_id")
        .agg(F.count_if(F.col("match_no") <= visible).alias("shown"), F.count("*").alias("matched"), F.first("total").cast("bigint").alias("total"))
        .filter("shown > 0")
    )


def reply_mentions_rule(value: Column) -> Column:
    """Rule codes in prose become the rule's wording; unknown codes become a fixed phrase."""
    pattern = r"(?i)(?<![A-Za-z0-9_])R[0-9]{2}\.[0-9]{2}(?![A-Za-z0-9_])"
    entries = [
        item
        for key, (_, texts) in RULE_LIBRARY.items()
        for i, text in enumerate(texts, 1)
        for item in (F.lit(f"{key}.{i:02d}"), F.lit(f"“{text.rstrip('。！？；')}”这一规范"))
    ]
    wording = F.create_map(*entries)
    shown = F.transform(
        F.regexp_extract_all(value, F.lit(pattern), F.lit(0)),
        lambda code: F.coalesce(F.try_element_at(wording, F.upper(code)), F.lit(fv.UNKNOWN_RULE_TEXT)),
    )
    pieces = F.split(value, pattern, -1)
    return F.array_join(F.zip_with(pieces, shown, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
