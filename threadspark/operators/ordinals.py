"""Numbering and look-back over a thread without putting a whole thread into one task.

A thread may hold a third of all rows, so a window over ``thread_id`` alone would be one task.
Positions are therefore cut into blocks: each block is handled on its own, and a table with one row
per block carries what earlier blocks contribute.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadspark.session import cut_lineage

BLOCK = 65_536


def _earlier(total: str, group: list[str], block: str) -> Column:
    window = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(total).over(window), F.lit(0))


def dense_number(df: DataFrame, group: list[str], pos: str, out: str, block: int = BLOCK) -> DataFrame:
    """1, 2, 3 … per group in the order of the integer column ``pos``, unique inside the group."""
    keyed = df.withColumn("_block", F.floor(F.col(pos) / block))
    sizes = keyed.groupBy(*group, "_block").agg(F.count("*").alias("_size"))
    offsets = sizes.select(*group, "_block", _earlier("_size", group, "_block").alias("_before"))
    local = F.row_number().over(Window.partitionBy(*group, "_block").orderBy(pos))
    return (
        keyed.withColumn("_local", local)
        .join(offsets, [*group, "_block"])
        .withColumn(out, F.col("_local") + F.col("_before"))
        .drop("_block", "_local", "_before")
    )


def ordered_number(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """Row number per group for any total order: range partitions, each numbered on its own.

    The range bounds are sampled, so each row's partition and its number in there are stored in a table before use.
    """
    ranged = df.repartitionByRange(*[F.col(name) for name in group], *order)
    local = F.row_number().over(Window.partitionBy(*group, "_block").orderBy(*order))
    ranged = cut_lineage(ranged.withColumn("_block", F.spark_partition_id()).withColumn("_local", local))
    sizes = ranged.groupBy(*group, "_block").agg(F.count("*").alias("_size"))
    offsets = sizes.select(*group, "_block", _earlier("_size", group, "_block").alias("_before"))
    return (
        ranged.join(offsets, [*group, "_block"])
        .withColumn(out, F.col("_local") + F.col("_before"))
        .drop("_block", "_local", "_before")
    )


def previous_value(
    df: DataFrame, group: list[str], pos: str, value: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Last non-null ``value`` of the group at a strictly smaller ``pos``."""
    keyed = df.withColumn("_block", F.floor(F.col(pos) / block)).withColumn("_value", value)
    last = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(pos)))
    per_block = keyed.groupBy(*group, "_block").agg(last.alias("_last"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        *group, "_block", F.last("_last", ignorenulls=True).over(before).alias("_carried")
    )
    inside = Window.partitionBy(*group, "_block").orderBy(pos).rangeBetween(Window.unboundedPreceding, -1)
    return (
        keyed.withColumn("_near", F.last("_value", ignorenulls=True).over(inside))
        .join(carried, [*group, "_block"])
        .withColumn(out, F.coalesce("_near", "_carried"))
        .drop("_block", "_value", "_near", "_carried")
    )


def dealt(df: DataFrame, keys: list[str], rows: int = 250_000) -> DataFrame:
    """Rows dealt out by ``keys`` so that a task gets about ``rows`` of them.

    Spark sizes tasks by compressed bytes, and rows with few distinct values compress so well that millions would be
    sorted in one task.  Equal keys stay together.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    return df.repartition(parts, *keys)


def first_per_key(df: DataFrame, keys: list[str], order: Column, latest: bool = False) -> DataFrame:
    """One row per key, by smallest (or largest) ``order``; partial aggregation, no window."""
    pick = F.max_by if latest else F.min_by
    row = F.struct(*[F.col(name) for name in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(pick(row, order).alias("_row")).select("_row.*")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, out: str) -> DataFrame:
    """First ``n`` rows per group; Spark limits each map partition to ``n`` before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(out, rank).filter(F.col(out) <= n)


def session_order(replies: DataFrame) -> DataFrame:
    """Adds ``place`` in the order of a capture session: floor, time, main before nested, id."""
    order = [F.asc_nulls_last("floor"), F.asc_nulls_last("timestamp_ms"), F.col("is_nested").asc(), F.col("id").asc()]
    return ordered_number(replies, ["thread_id"], order, "place")


def reconciled_order(replies: DataFrame) -> DataFrame:
    """Adds ``place`` in the order of a reconciled thread: own floor, else the parent's, else last; main first; time; id."""
    floors = replies.select("thread_id", F.col("id").alias("parent_reply_id"), F.col("floor").alias("parent_floor"))
    # Only replies that need a parent's floor are joined, so main replies share no key.
    lacking = F.col("floor").isNull() & F.col("parent_reply_id").isNotNull()
    lent = replies.filter(lacking).join(floors, ["thread_id", "parent_reply_id"], "left").withColumn("order_floor", F.col("parent_floor"))
    own = replies.filter(~lacking).withColumn("order_floor", F.col("floor"))
    rows = own.unionByName(lent.select(*own.columns))
    order = [F.asc_nulls_last("order_floor"), F.col("is_nested").asc(), F.asc_nulls_last("timestamp_ms"), F.col("id").asc()]
    return ordered_number(rows, ["thread_id"], order, "place").drop("order_floor")
