"""The given tables, and the reply tables derived from them."""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

FIRST_POST_MS = 1_704_067_200_000


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        # Times in the tables carry no zone; they are read as UTC whatever the session was set to.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def read(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        zoneless = [c for c, kind in table.dtypes if kind == "timestamp_ntz"]
        return table.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def replies(self) -> DataFrame:
        """``conversations`` as reply rows: one thread per conversation, one author per role."""
        nested = F.col("turn") % 3 == 2
        return self.read("conversations").select(
            F.col("conv_id").cast("string").alias("thread_id"),
            (F.col("turn") + 1).alias("pos"),
            F.concat("conv_id", F.lit("-"), "turn").alias("id"),
            (F.col("turn") + 1).cast("int").alias("floor"),
            F.when(nested, F.concat("conv_id", F.lit("-"), F.col("turn") - 1)).alias("parent_reply_id"),
            F.col("role").alias("author_name"),
            F.lit(None).cast("string").alias("time"),
            F.lit(None).cast("bigint").alias("timestamp_ms"),
            F.col("text").alias("content"),
            nested.alias("is_nested"),
            (F.col("turn") % 4).cast("int").alias("image_count"),
            (F.floor(F.col("turn") / 5) + 1).cast("int").alias("source_page"),
        )

    @cached_property
    def discussion(self) -> DataFrame:
        """The replies with more authors, post times, and references between posts in the text."""
        turn = F.col("pos") - 1
        conv = F.col("thread_id").cast("bigint")
        marks = [
            (turn % 7 == 3, F.concat(F.lit(" 回复 @user"), turn % 2, F.lit("：收到"))),
            (turn % 5 == 4, F.concat(F.lit(" 见第"), turn - 2, F.lit("楼"))),
            (turn % 6 == 5, F.lit(" 楼上说得对")),
            (turn % 4 == 1, F.lit(" @user0 你好")),
            (turn % 8 == 6, F.lit(" assistant1说过")),
            ((conv + turn) % 4 == 0, F.lit(" 破防了，典中典")),
            ((conv + turn) % 9 == 1, F.lit(" 你有病吧")),
            (conv % 10 == 3, F.lit(" 开盒警告")),
        ]
        extra = F.concat(*[F.when(test, text).otherwise(F.lit("")) for test, text in marks])
        repeated = (conv % 6 == 2) & (turn % 2 == 0)
        return self.replies.select(
            "thread_id",
            "pos",
            "id",
            "floor",
            "parent_reply_id",
            F.concat("author_name", (turn % 2).cast("string")).alias("author_name"),
            "time",
            F.when(turn % 11 != 10, FIRST_POST_MS + conv * 86_400_000 + turn * 90_000).alias("timestamp_ms"),
            F.when(repeated, F.lit("同样的内容 再发一次！"))
            .otherwise(F.concat("content", extra))
            .alias("content"),
            "is_nested",
            "image_count",
            "source_page",
        )

    @cached_property
    def event_replies(self) -> DataFrame:
        """``events`` as timed posts: one thread per event type, one author per user."""
        return self.read("events").select(
            F.col("event_type").alias("thread_id"),
            F.col("user_id").cast("string").alias("author_name"),
            F.col("event_id").cast("string").alias("id"),
            F.col("event_id").alias("pos"),
            F.unix_millis("ts").alias("timestamp_ms"),
            F.col("value").cast("int").alias("risk"),
        )
