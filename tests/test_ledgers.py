import itertools

from pyspark.sql import functions as F

from threadspark.operators import ledger, merges
from threadspark.operators.ordinals import dealt
from threadspark.sources import durable, snapshots

ROW = "thread_id string, pos bigint, id string, site_reply_id string, parent_reply_id string, floor int, author_name string, timestamp_ms bigint, content string, image_count int, is_nested boolean, unexpanded_nested_count int"


def _snapshot(spark, contents, title="标题"):
    rows = [("t", i + 1, f"r{i}", None, None, i, "甲", None, c, 0, False, 0) for i, c in enumerate(contents)]
    titles = spark.createDataFrame([("t", title)], "thread_id string, title string")
    return ledger.snapshot_ids(spark.createDataFrame(rows, ROW), titles).first()["snapshot_id"]


def test_snapshot_ignores_harmless_differences_only(spark):
    base = _snapshot(spark, ["a b", "é"])
    assert base == _snapshot(spark, [" a  b \r\n", "é"], "标题 ")
    assert base != _snapshot(spark, ["é", "a b"]) and base != _snapshot(spark, ["a b", "e"]) and base != _snapshot(spark, ["a b", "é"], "x")


def test_snapshot_blocks(spark):
    many = [str(n) for n in range(2100)]
    first = _snapshot(spark, many)
    many[1500] = "changed"
    assert first == _snapshot(spark, [str(n) for n in range(2100)]) != _snapshot(spark, many)


def test_upsert_table(spark, tmp_path):
    path = str(tmp_path / "table")

    def put(*rows):
        snapshots.upsert_table(spark, path, spark.createDataFrame(list(rows), "k int, v string, at int"), ["k"], F.col("at"), buckets=4)

    put((1, "a", 1), (2, "b", 1), (1, "z", 0))
    put((2, "c", 2), (3, "d", 1), (1, "old", 0))
    assert {r["k"]: r["v"] for r in snapshots.read_table(spark, path).collect()} == {1: "a", 2: "c", 3: "d"}


def test_export_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    durable.write_export(spark.createDataFrame([("x", 1), ("y", 2)], "id string, n int"), path, "2026-01-01T00:00:00Z")
    rows, bad = durable.read_export(spark, path, "id string, n int")
    assert {(r["id"], r["n"]) for r in rows.collect()} == {("x", 1), ("y", 2)} and bad.count() == 0
    _, bad = durable.read_export(spark, path, "id string")
    assert bad.count() == 2


def test_merge_is_commutative_without_ties(spark):
    schema = "id string, reviewed_at int, reply_ids array<string>, internal_tags array<string>"
    a = spark.createDataFrame([("1", 5, ["a", "a"], []), ("2", 1, [], [])], schema)
    b = spark.createDataFrame([("1", 4, ["b"], []), ("3", 1, [], [])], schema)
    one = sorted(map(str, merges.merge_review_records(a, b).collect()))
    assert one == sorted(map(str, merges.merge_review_records(b, a).collect()))
    assert "['a']" in one[0]


def test_claims_equal_sequential_loop(spark):
    flags = list(itertools.product([False, True], repeat=4))
    claims = [(f"s{i}", f"a{n}", n, force) for i, row in enumerate(flags) for n, force in enumerate(row)]
    receipts = [(f"s{i}", "held", "sent") for i in range(0, len(flags), 2)]
    out = ledger.claim_attempts(
        spark.createDataFrame(claims, "snapshot_id string, attempt_id string, claimed_at int, force boolean"),
        spark.createDataFrame(receipts, "snapshot_id string, attempt_id string, receipt_status string"),
    )
    got = {(r["snapshot_id"], r["attempt_id"]): (r["granted"], r["holder"]) for r in out.collect()}
    for i, row in enumerate(flags):
        holder = "held" if i % 2 == 0 else None
        for n, force in enumerate(row):
            granted = force or holder is None
            assert got[(f"s{i}", f"a{n}")] == (granted, None if granted else holder)
            holder = f"a{n}" if granted else holder


def test_rows_that_compress_well_are_dealt_by_their_number(spark):
    rows = spark.range(0, 5_000, 1, 2).select(F.lit("same").alias("text"), F.pmod("id", F.lit(1_000)).alias("key"))
    parts = dealt(rows, ["key"], rows=250).select("key", F.spark_partition_id().alias("part"))
    sizes = [row["count"] for row in parts.groupBy("part").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 1_000
    assert parts.distinct().count() == 1_000


def test_merged_history_is_dealt_once(spark):
    from threadspark import fixed_values as fv

    columns = ", ".join(f"{c} string" for c in dict.fromkeys(["attempt_id", *fv.HISTORY_IDENTITY, "completed_at"]))
    names = [c.split()[0] for c in columns.split(", ")]

    def row(attempt, at, **other):
        return tuple({"attempt_id": attempt, "completed_at": at, **other}.get(name) for name in names)

    other = next(c for c in fv.HISTORY_IDENTITY if c != "attempt_id")
    old = spark.createDataFrame([row("a", "1"), row("b", "1"), row("c", "1", **{other: "x"})], columns)
    new = spark.createDataFrame([row("a", "2"), row("b", "1", **{other: "null"}), row("c", "0", **{other: "x"})], columns)
    merged, refused = merges.merge_history(old, new)
    assert sorted((r["attempt_id"], r["completed_at"]) for r in merged.collect()) == [("a", "2"), ("c", "1")]
    assert [r["attempt_id"] for r in refused.collect()] == ["b", "b"]
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "partial_min(_identity" not in plan and "REPARTITION_BY_NUM" in plan


def test_records_are_not_dealt_by_their_rule(spark):
    from threadspark.sources.rules import rules_table

    rows = spark.range(6).select(
        "id", F.lit("1.0").alias("schema_version"), F.lit("https://x.y/p/1").alias("thread_url"), F.lit("1").alias("thread_id"), F.array(F.lit("r")).alias("reply_ids"),
        F.lit("keep").alias("decision"), F.when(F.col("id") > 0, "R01.01").alias("primary_reason_id"), F.array(F.lit("spam")).alias("internal_tags"),
        *[F.lit(None).cast("string").alias(c) for c in ["reviewed_at", "analysis_attempt_id", "snapshot_id", "finding_id"]],
    ).withColumn("id", F.col("id").cast("string"))
    judged = ledger.record_violations(rows, rules_table(spark), "x.y")
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(primary_reason_id" not in plan
    assert judged.filter(F.array_contains("violations", "primary_reason_id")).count() == 0
