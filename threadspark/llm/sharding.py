"""Hierarchical weighted hash tree: rows descend region, rack and shard levels by weighted hash draws.

At each node every child draws ``-ln(u) / weight`` where ``u`` hashes the row's key and the child, and the smallest
draw wins. A child's share is its share of the node's weight, and a changed weight moves rows only into or out of that
child's subtree: the draws of the others stay as they are. A new shard that gets a subtree of its own therefore takes
rows only into itself.

Nulls: a null key is one more key. Repeated keys go to one shard, each row with a slot of its own. Null text has size
8 and checksum 0. Empty input gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threadspark.llm.common import stored, table

ROOT = "root"


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def standard_tree(shards: int, base: int = 24, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """The first ``base`` shards fill racks and regions; each later shard is a region of its own until a new base is set.

    So for every count from ``base`` on, one more shard takes rows only into itself.
    """
    leaves = []
    for shard in range(shards):
        if shard < base:
            leaves.append(Leaf(f"region{shard // (per_rack * racks)}", f"rack{shard // per_rack % racks}", shard))
        else:
            leaves.append(Leaf(f"added{shard}", "rack0", shard))
    return leaves


def _children(tree: list[Leaf]) -> dict[str, dict[str, float]]:
    """Weights of the children of each node; a node weighs what its leaves weigh, and weightless ones draw nothing."""
    nodes: dict[str, dict[str, float]] = {}
    for leaf in tree:
        if not 0 <= leaf.weight < float("inf"):
            raise ValueError(f"weight of shard {leaf.shard}: {leaf.weight}")
        if leaf.weight:
            rack = f"{leaf.region}/{leaf.rack}"
            for above, below in ((ROOT, leaf.region), (leaf.region, rack), (rack, str(leaf.shard))):
                level = nodes.setdefault(above, {})
                level[below] = level.get(below, 0.0) + leaf.weight
    if not nodes:
        raise ValueError("the tree has no weight")
    return nodes


def place(key: Column, tree: list[Leaf]) -> Column:
    """Shard of a key: one weighted draw at the root, one in the region, one in the rack."""
    pairs = []
    for node, below in _children(tree).items():
        drawn = [F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight")) for name, weight in below.items()]
        pairs += [F.lit(node), F.array(*drawn)]
    children = F.create_map(*pairs)

    def draw(child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, child["name"]), 11)
        uniform = (bits.cast("double") + 0.5) / F.lit(float(2**53))
        return F.struct((-F.log(uniform) / child["weight"]).alias("drawn"), child["name"].alias("name"))

    node: Column = F.lit(ROOT)
    for _ in range(3):
        node = F.array_min(F.transform(children[node], draw))["name"]
    return node.cast("int")


def shard_rows(rows: DataFrame, key: str, text: str, tree: list[Leaf], grown: list[Leaf]) -> DataFrame:
    """Key, size, checksum, shard and slot of every row, and its shard in the grown tree.

    Slots are gapless per shard without gathering a shard in one task: rows are numbered inside (shard, block), where a
    block is an input partition fixed by writing the slim rows, and the counts of earlier blocks are added.
    """
    slim = rows.select(
        F.col(key).alias(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        place(F.col(key), tree).alias("shard"),
        place(F.col(key), grown).alias("grown_shard"),
        F.spark_partition_id().alias("block"),
    )
    slim = stored(slim, "shards")
    earlier = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        slim.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    )
    inside = F.row_number().over(W.partitionBy("shard", "block").orderBy(key, "text_crc32", "size"))
    return slim.withColumn("inside", inside).join(offsets, ["shard", "block"]).select(
        key, "size", "text_crc32", "shard", (F.col("offset") + F.col("inside") - 1).alias("slot"), "grown_shard"
    )


def op1_shard_documents(spark: SparkSession, folder: str) -> DataFrame:
    placed = shard_rows(table(spark, folder, "documents"), "doc_id", "text", standard_tree(24), standard_tree(25))
    return placed.withColumn("law", F.lit("key"))
