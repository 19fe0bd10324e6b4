"""Heavy keys in joins and components: right results, and no task with most of the rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadspark.operators.graph import connected_components
from threadspark.operators.skew import HEAVY, heavy_keys, skew_join


def rows(spark, n=30_000):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 700))
    return spark.range(n).select("id", key.alias("key"))


def test_heavy_keys_are_few_and_found(spark):
    found = heavy_keys(rows(spark), ["key"]).collect()
    hot = {row[0]: row[1] for row in found}
    key = spark.range(1).select(F.xxhash64(F.lit("hot"))).first()[0]
    assert 60 <= hot[key] <= 70 and len(found) <= HEAVY
    assert heavy_keys(rows(spark).limit(0), ["key"]).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_the_plain_join(spark, how):
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k5", 3), (None, 4), ("other", 5)], "key string, v int")
    big = rows(spark, 3_000)
    found, plain = skew_join(big, small, ["key"], ["id"], how), big.join(small, "key", how)
    assert found.columns == plain.columns
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, plain.collect()))


def test_rows_of_a_heavy_key_are_dealt_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        small = rows(spark, 30_000).filter("key is not null").select("key").distinct().withColumn("v", F.lit(1))
        joined = skew_join(rows(spark), small.hint("merge"), ["key"], ["id"]).repartition
        found = skew_join(rows(spark), small.hint("merge"), ["key"], ["id"])
        sizes = [row["count"] for row in found.groupBy(F.spark_partition_id()).count().collect()]
        assert joined and max(sizes) < 2 * sum(sizes) / len(sizes) and len(sizes) >= 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def graphs():
    pick = random.Random(4)
    yield "chain", 300, [(k, k + 1) for k in range(299)]
    yield "star", 400, [(399, k) for k in range(399)]
    giant = [(pick.randrange(k), k) for k in range(1, 300)]
    yield "giant", 900, giant + [(k, k + 1) for k in range(300, 899, 2)]
    order = list(range(200))
    pick.shuffle(order)
    yield "shuffled chain", 200, list(zip(order, order[1:], strict=False))
    yield "none", 5, []


@pytest.mark.parametrize("name,n,edges", list(graphs()))
def test_components_equal_union_find(spark, name, n, edges):
    nodes = spark.range(n).select(F.lit("s").alias("scope"), F.col("id").alias("node"))
    both = [("s", a, b) for a, b in edges] + [("s", b, a) for a, b in edges]
    found = connected_components(nodes, spark.createDataFrame(both, "scope string, src long, dst long"), ["scope"])
    assert {row["node"]: row["component"] for row in found.collect()} == union_find(range(n), edges)


def joins_of(df):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]


def test_texts_are_never_joined_on_their_thread_alone(spark, make_replies):
    from threadspark.operators import payloads
    from threadspark.operators.names import TARGET_ANCHORS, name_lengths, thread_names

    rows = make_replies(("甲", "@乙 你好"), ("乙", "回复 甲：好"), ("甲", "x"))
    names = thread_names(rows)
    texts = rows.select("thread_id", "id", F.col("content").alias("text"))
    for found in (payloads.minute_offset(rows), skew_join(texts, name_lengths(names), ["thread_id"], ["id"])):
        own = [line for line in joins_of(found) if "thread_id" in line]
        assert own and all("_skew_salt" in line for line in own)
    from threadspark.operators.names import named_authors

    assert {(row["id"], row["name"]) for row in named_authors(rows, names, TARGET_ANCHORS).collect()} == {("r1", "乙"), ("r2", "甲")}


def test_detection_in_a_hot_thread_equals_the_plain_count(spark):
    from threadspark.operators import detect

    hot = spark.range(3_000).select(
        F.when(F.col("id") < 2_000, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("thread_id"), F.col("id").cast("string").alias("id"),
        F.concat(F.lit("u"), F.col("id") % 3).alias("author_key"), (F.col("id") * 1_000).alias("timestamp_ms"), F.lit(0).alias("risk"),
    )
    group = ["thread_id", "author_key"]
    bursts = detect.earliest_burst(hot, group, 120_000, 5)
    inside = F.col("timestamp_ms").between(F.col("start_ms"), F.col("start_ms") + 120_000)
    plain = hot.join(bursts, group).filter(inside).select("thread_id", "id").collect()
    found = detect.in_burst(hot, bursts, group, 120_000).select("thread_id", "id").collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, plain)) and len(found) > 100
