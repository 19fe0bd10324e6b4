"""Connected components of the reply relation.

Label hooking with pointer jumping: in every round a component's root takes the smallest
grandparent label seen from its members, so the number of rounds grows with the logarithm of the
number of nodes, even on long chains.  Minima are aggregated before they move.  A hub's edges and a
giant component's members, which all ask for one root, are heavy keys: their rows are dealt over
copies of the one row they ask for, so no round puts them into one task.
"""

from pyspark.sql import DataFrame, functions as F

from threadspark.operators.ordinals import dense_number
from threadspark.operators.skew import heavy_keys, skew_join
from threadspark.session import cut_lineage


def connected_components(nodes: DataFrame, edges: DataFrame, scope: list[str]) -> DataFrame:
    """``scope…, node, component`` with the smallest ``node`` of each component as its label.

    ``edges`` holds ``scope…, src, dst`` in both directions.
    """
    edges = cut_lineage(edges.select(*scope, "src", "dst"))
    hubs = cut_lineage(heavy_keys(edges, [*scope, "dst"]))
    state = cut_lineage(
        nodes.select(*scope, "node", F.col("node").alias("parent"), F.col("node").alias("grand"))
    )
    while True:
        seen = (
            skew_join(edges, state.select(*scope, F.col("node").alias("dst"), "grand"), [*scope, "dst"], ["src"], heavy=hubs)
            .groupBy(*scope, F.col("src").alias("node"))
            .agg(F.min("grand").alias("near"))
        )
        known = state.join(seen, [*scope, "node"], "left")
        offers = known.select(
            *scope,
            F.explode(
                F.array(
                    F.struct(F.col("node").alias("to"), F.least("parent", "grand", F.coalesce("near", "grand")).alias("label")),
                    F.struct(F.col("parent").alias("to"), F.coalesce("near", "grand").alias("label")),
                )
            ).alias("offer"),
        )
        hooked = offers.groupBy(*scope, F.col("offer.to").alias("node")).agg(F.min("offer.label").alias("parent"))
        hooked = cut_lineage(hooked)
        above = hooked.select(*scope, F.col("node").alias("parent"), F.col("parent").alias("grand"))
        before = state.select(*scope, "node", F.col("grand").alias("old"))
        stepped = cut_lineage(skew_join(hooked, above, [*scope, "parent"], ["node"]).join(before, [*scope, "node"]))
        changed = stepped.filter(F.col("grand") != F.col("old")).limit(1).count()
        state = stepped.select(*scope, "node", "parent", "grand")
        if changed == 0:
            return state.select(*scope, "node", F.col("grand").alias("component"))


def reply_components(replies: DataFrame, edges: DataFrame) -> DataFrame:
    """``thread_id, id, component``; the label is the first reply of the component by position."""
    numbered = replies.select("thread_id", "id", "pos")
    src = numbered.select("thread_id", F.col("id").alias("src"), F.col("pos").alias("src_pos"))
    dst = numbered.select("thread_id", F.col("id").alias("dst"), F.col("pos").alias("dst_pos"))
    by_pos = edges.join(src, ["thread_id", "src"]).join(dst, ["thread_id", "dst"])
    found = connected_components(
        numbered.select("thread_id", F.col("pos").alias("node")),
        by_pos.select("thread_id", F.col("src_pos").alias("src"), F.col("dst_pos").alias("dst")),
        ["thread_id"],
    )
    return numbered.join(found.withColumnRenamed("node", "pos"), ["thread_id", "pos"])


def component_ordinal(components: DataFrame) -> DataFrame:
    """Components numbered 1, 2, … per thread by their first reply."""
    heads = components.select("thread_id", "component").distinct()
    numbered = dense_number(heads, ["thread_id"], "component", "component_no")
    return components.join(numbered, ["thread_id", "component"])
