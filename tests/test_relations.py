import random

import pytest

from threadspark.operators import graph, names, ordinals, relations


def _edges(df):
    return {(r["src"], r["dst"]) for r in df.collect()}


def test_relation_scenario(make_replies):
    rows = make_replies(
        ("甲", "开头"), ("乙", "看法"), ("丙", "回第1楼"), ("丁", "@乙 不同意"), ("戊", "楼上说得对"),
        {"author": "己", "content": "嗯", "is_nested": True, "parent_reply_id": "r1", "floor": 1},
    )
    want = {("r1", "r3"), ("r1", "r6"), ("r2", "r4"), ("r4", "r5")}
    assert _edges(relations.reply_edges(rows)) == want | {(b, a) for a, b in want}


def test_ambiguous_floor_gives_no_edge(make_replies):
    rows = make_replies({"floor": 5, "content": "a"}, {"floor": 5, "content": "b"}, {"content": "第5楼错了"})
    assert _edges(relations.floor_edges(rows)) == set()


@pytest.mark.parametrize("text,found", [("小明：你好", True), ("a小明：你好", False), ("小明说过", True), ("回复 @小明", True), ("小明明", False)])
def test_naming_places(make_replies, text, found):
    rows = make_replies(("小明", "先来"), ("甲", text))
    named = names.named_authors(rows, names.thread_names(rows), names.NAMING_ANCHORS).filter("id = 'r2' and name = '小明'")
    assert (named.count() > 0) == found


def test_mention_takes_latest_earlier_reply_over_blocks(spark):
    rows = [(p, "v" if p % 3 else None) for p in range(1, 60)]
    df = spark.createDataFrame([("g", p, v and f"{v}{p}") for p, v in rows], "g string, pos bigint, v string")
    got = {r["pos"]: r["out"] for r in ordinals.previous_value(df, ["g"], "pos", df["v"], "out", block=7).collect()}
    last = None
    for p, v in rows:
        assert got[p] == last
        last = f"{v}{p}" if v else last


def test_dense_and_ordered_number(spark):
    rng = random.Random(3)
    values = rng.sample(range(10_000), 300)
    df = spark.createDataFrame([(v % 2, v) for v in values], "g int, pos bigint")
    for out in (ordinals.dense_number(df, ["g"], "pos", "n", block=97), ordinals.ordered_number(df, ["g"], [df["pos"].asc()], "n")):
        for g in (0, 1):
            want = {v: i for i, v in enumerate(sorted(v for v in values if v % 2 == g), 1)}
            assert {r["pos"]: r["n"] for r in out.filter(f"g = {g}").collect()} == want


def test_components_equal_union_find(spark):
    rng = random.Random(11)
    nodes = list(range(120))
    pairs = [(n, n + 1) for n in range(40)] + [(rng.randrange(40, 120), rng.randrange(40, 120)) for _ in range(45)]
    parent = list(nodes)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    both = [("s", a, b) for a, b in pairs if a != b] + [("s", b, a) for a, b in pairs if a != b]
    found = graph.connected_components(
        spark.createDataFrame([("s", n) for n in nodes], "s string, node bigint"), spark.createDataFrame(both, "s string, src bigint, dst bigint"), ["s"]
    )
    assert {r["node"]: r["component"] for r in found.collect()} == {n: find(n) for n in nodes}


def test_context_never_drops_selected(spark, make_replies):
    rows = make_replies(*[("甲", f"x{n}") for n in range(8)])
    chosen = spark.createDataFrame([("s", "t", f"r{n}", n) for n in (2, 3, 6)], "selection_id string, thread_id string, id string, ordinal bigint")
    out = relations.context_replies(rows, chosen, radius=1, max_replies=4).collect()
    assert {r["id"] for r in out if r["is_selected"]} == {"r2", "r3", "r6"}
    assert {r["id"] for r in out if not r["is_selected"]} == {"r1"}


def test_no_cartesian_plan(make_replies):
    rows = make_replies(("甲", "@乙 好"), ("乙", "第1楼"))
    plan = relations.reply_edges(rows)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
