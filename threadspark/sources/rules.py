"""The rule library as tables.  Its size is fixed, so joins to it may broadcast."""

from pyspark.sql import DataFrame, SparkSession

from threadspark.rule_library import RULE_LIBRARY, RULES_VERSION


def categories_table(spark: SparkSession) -> DataFrame:
    rows = [(key, i + 1, title, RULES_VERSION) for i, (key, (title, _)) in enumerate(RULE_LIBRARY.items())]
    return spark.createDataFrame(rows, "category_id string, ordinal int, title string, version string")


def rules_table(spark: SparkSession) -> DataFrame:
    rows = [
        (f"{key}.{item:02d}", key, title, item, text, RULES_VERSION)
        for key, (title, texts) in RULE_LIBRARY.items()
        for item, text in enumerate(texts, 1)
    ]
    return spark.createDataFrame(
        rows, "rule_id string, category_id string, category_title string, item int, text string, version string"
    )
