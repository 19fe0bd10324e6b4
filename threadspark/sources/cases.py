"""Labelled corpora: reading and checking."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadspark.functions.text import parse_forum_time

CORPUS = (
    "schemaVersion string, cases array<struct<id:string,label:string,replies:array<struct<id:string,author:string,content:string,"
    "parentId:string,time:string,floor:int>>>>"
)


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, replies) of corpus files."""
    return explode_cases(spark.read.schema(CORPUS).option("multiLine", True).json(path))


def explode_cases(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    cases = corpus.select("schemaVersion", F.explode("cases").alias("c")).select(
        F.col("schemaVersion").alias("schema_version"), F.col("c.id").alias("thread_id"), F.col("c.label").alias("label"),
        F.coalesce(F.size("c.replies"), F.lit(0)).alias("reply_count"), F.col("c.replies").alias("items"),
    )
    replies = cases.select("thread_id", F.posexplode("items").alias("i", "r")).select(
        "thread_id", (F.col("i") + 1).cast("bigint").alias("pos"), F.col("r.id").alias("id"),
        F.coalesce("r.floor", F.col("i") + 1).alias("floor"), F.col("r.parentId").alias("parent_reply_id"), F.col("r.author").alias("author_name"),
        F.col("r.time").alias("time"), parse_forum_time(F.col("r.time")).alias("timestamp_ms"), F.col("r.content").alias("content"),
        F.col("r.parentId").isNotNull().alias("is_nested"), F.lit(0).alias("image_count"), F.lit(1).alias("source_page"),
    )
    return cases.drop("items"), replies


def case_violations(cases: DataFrame, replies: DataFrame) -> DataFrame:
    """``thread_id, code, count`` of everything wrong in a corpus."""
    def blank(name):
        return F.coalesce(F.col(name), F.lit("")) == ""

    repeated = cases.groupBy("thread_id").agg(F.count("*").alias("count")).filter("count > 1").select("thread_id", F.lit("repeated_id").alias("code"), "count")
    checks = F.array_compact(
        F.array(
            F.when(F.col("schema_version") != "1.0", F.lit("schema_version")), F.when(blank("thread_id"), F.lit("missing_id")),
            F.when(~F.coalesce(F.col("label").isin("severe_conflict", "normal_discussion"), F.lit(False)), F.lit("label")),
            F.when(F.col("reply_count") == 0, F.lit("no_replies")),
        )
    )
    shape = cases.select("thread_id", F.explode(checks).alias("code")).groupBy("thread_id", "code").agg(F.count("*").alias("count"))
    fields = replies.filter(blank("id") | blank("author_name") | F.col("content").isNull()).groupBy("thread_id").agg(
        F.lit("reply_fields").alias("code"), F.count("*").alias("count")
    )
    return shape.unionByName(repeated).unionByName(fields)
