"""SimHash near-duplicate detection over a Gray-order hierarchical index.

1. A text's fingerprint has a bit set if more than half of its shingles' 64-bit hashes have it. Equal fingerprints collapse
   to the smallest doc_id before anything is compared.
2. Fingerprints are sorted by Gray rank, the order in which neighbours share bits, in range partitions, and cut into blocks
   of ``BLOCK``. A block's pattern is the bits that all of its fingerprints share, as a mask and their values; nodes above,
   ``FAN`` neighbours each, share less. A pattern that a node has is factored out of the nodes below: only the bits that are
   new on a level are compared there.
3. Pairs of nodes descend from the root level by level, as joins on the parents. A pair carries the bits compared so far and
   the differences found in them; once these pass the distance, the whole group below is pruned. The number of surviving
   pairs per block grows with the square of the logarithm of the number of blocks, not with the number.
4. Inside a pair of blocks that is left, each fingerprint meets the patterns of runs of ``RUN`` and then the fingerprints of
   the runs that stay. A pair of blocks gives out links that join what it has not joined yet, so a dense group of near
   copies gives no more links than twice its fingerprints.
5. Components of the links; heavy keys are dealt over copies.

Null or blank text has fingerprint zero and links like any other. Fewer words than a shingle are one shingle. doc_id names
one document. Rows without doc_id have a fingerprint, no component and part in no link. Repeated rows are repeated in the
result. Empty input gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadspark.llm.common import packed, stored, table, texts_of
from threadspark.operators.graph import connected_components
from threadspark.operators.skew import skew_join

WORDS, DISTANCE, SEED = 3, 2, 42
BLOCK, RUN, FAN_BITS, LEAF_BITS = 512, 32, 4, 12
_SHINGLES = 65_536


def fingerprint(text: bytes, size: int = WORDS) -> int:
    """64 bits, each set if it is in more than half of the shingles' hashes; texts are hashed in parts of bounded size."""
    words = text.lower().split()
    if not words:
        return 0
    width = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    total, counts = len(words) - width + 1, np.zeros(64, dtype=np.int64)
    for k in range(0, total, _SHINGLES):
        spans = zip(starts[k : min(total, k + _SHINGLES)].tolist(), (ends[width - 1 + k :] - 1).tolist(), strict=False)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text, size) for text in texts_of(batch)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def gray_order(fp: Column) -> Column:
    """A number that orders fingerprints by Gray rank: the running parity of the bits from the top, unsigned."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp.bitwiseXOR(F.lit(-(2**63)))


def leaf_blocks(found: DataFrame, block: int) -> DataFrame:
    """A row per block of neighbours in Gray order: number (in that order), bits in all, bits in any, and the fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = np.zeros(0, np.int64), TaskContext.get().partitionId() << LEAF_BITS
        for batch in batches:
            held = np.concatenate([held, batch.column("fp").to_numpy()])
            if len(held) >= block:
                whole = len(held) // block * block
                yield _rows(held[:whole], number, block)
                held, number = held[whole:], number + whole // block
        if len(held):
            yield _rows(held, number, block)

    partitions = max(1, -(-found.count() // (16 * block)))
    ordered = found.select("fp", gray_order(F.col("fp")).alias("rank")).repartitionByRange(partitions, "rank").sortWithinPartitions("rank")
    return stored(ordered.mapInArrow(run, "node long, all_and long, all_or long, fps binary"), "gray-blocks")


def _rows(fps: np.ndarray, first: int, block: int) -> pa.RecordBatch:
    parts = [fps[k : k + block] for k in range(0, len(fps), block)]
    columns = (
        np.arange(first, first + len(parts)),
        np.array([np.bitwise_and.reduce(part) for part in parts]), np.array([np.bitwise_or.reduce(part) for part in parts]),
    )
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([packed(part, "<i8") for part in parts], pa.binary())], ["node", "all_and", "all_or", "fps"])


def near_blocks(leaves: DataFrame, distance: int) -> DataFrame:
    """(a, b), a <= b: pairs of blocks whose shared patterns differ in at most ``distance`` bits."""
    spark = leaves.sparkSession
    outline = leaves.select("node", "all_and", "all_or")
    last = outline.agg(F.max("node")).first()[0] or 0
    shift = -(-last.bit_length() // FAN_BITS) * FAN_BITS
    pairs = spark.createDataFrame([(0, 0, 0, 0)], "a long, b long, seen long, apart int")
    while shift > 0:
        shift -= FAN_BITS
        own = F.shiftright("node", shift)
        nodes = outline.groupBy(own.alias("node")).agg(F.bit_and("all_and").alias("value"), F.bit_or("all_or").alias("any"))
        # the bits that all below share are those in which "in all" and "in any" agree
        nodes = nodes.select("node", F.shiftright("node", FAN_BITS).alias("parent"), "value", F.bitwise_not(F.col("value").bitwiseXOR(F.col("any"))).alias("mask"))
        left, right = (nodes.select(*[F.col(c).alias(f"{side}_{c}") for c in nodes.columns]) for side in ("a", "b"))
        below = pairs.join(left, F.col("a") == F.col("a_parent")).join(right, (F.col("b") == F.col("b_parent")) & (F.col("a_node") <= F.col("b_node")))
        common = F.col("a_mask").bitwiseAND(F.col("b_mask"))
        new = common.bitwiseAND(F.bitwise_not(F.col("seen")))
        differ = F.bit_count(F.col("a_value").bitwiseXOR(F.col("b_value")).bitwiseAND(new))
        below = below.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), common.alias("seen"), (F.col("apart") + differ).cast("int").alias("apart"))
        pairs = stored(below.where(F.col("apart") <= distance), "gray-pairs")
    return pairs.select("a", "b")


def close_pairs(left: np.ndarray, right: np.ndarray, distance: int, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of fingerprints at most ``distance`` bits apart; ``right`` is met in runs that share a pattern."""
    left, right = left.view(np.uint64), right.view(np.uint64)  # bits of signed numbers are counted without the sign
    pad = -len(right) % run
    runs = np.concatenate([right, np.repeat(right[-1:], pad)]).reshape(-1, run)
    value = np.bitwise_and.reduce(runs, axis=1)
    mask = ~(value ^ np.bitwise_or.reduce(runs, axis=1))
    i, k = np.nonzero(np.bitwise_count((left[:, None] ^ value[None, :]) & mask[None, :]) <= distance)
    found_i, found_j = [], []
    for first in range(0, len(i), 100_000):
        rows, groups = i[first : first + 100_000], k[first : first + 100_000]
        at, j = np.nonzero(np.bitwise_count(left[rows][:, None] ^ runs[groups]) <= distance)
        found_i.append(rows[at])
        found_j.append(groups[at] * run + j)
    i, j = (np.concatenate(found) if found else np.zeros(0, np.int64) for found in (found_i, found_j))
    return i[j < len(right)], j[j < len(right)]


def spanning(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links that join what the links before them do not."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        if (p := root(a)) != (q := root(b)):
            parent[p] = q
            out.append((a, b))
    return out


def block_links(pairs: DataFrame, leaves: DataFrame, distance: int) -> DataFrame:
    """Links (x, y) of fingerprints; a pair of blocks is a row with both, and met where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, b in zip(batch.column("left"), batch.column("right"), strict=True):
                left, right = (np.frombuffer(raw.as_py(), "<i8") for raw in (a, b))
                i, j = close_pairs(left, right, distance)
                x, y = left[i], right[j]
                out += spanning(x[x != y], y[x != y])
            columns = list(zip(*out, strict=True)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in columns], ["x", "y"])

    left, right = leaves.select(F.col("node").alias("a"), F.col("fps").alias("left")), leaves.select(F.col("node").alias("b"), F.col("fps").alias("right"))
    met = pairs.join(left, "a").join(right, "b").select("left", "right")
    return met.mapInArrow(run, "x long, y long")


def simhash_components(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs``."""
    marked = stored(fingerprints(docs, words), "fingerprints")
    classes = stored(marked.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-classes")
    leaves = leaf_blocks(classes, block)
    links = stored(block_links(near_blocks(leaves, distance), leaves, distance), "fingerprint-links")
    # a fingerprint has a bounded number of others within the distance, so no end of a link is a hot key
    x, y = (classes.select(F.col("fp").alias(side), F.col("rep").alias(to)) for side, to in (("x", "src"), ("y", "dst")))
    named = stored(links.distinct().join(x, "x").join(y, "y").select("src", "dst"), "document-links")
    both = named.unionByName(named.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    labels = connected_components(both.select(F.col("src").alias("node")).distinct(), both, [])
    found = classes.join(labels, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    met = skew_join(marked, found, ["fp"], ["doc_id"], "left")
    return met.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def op12_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_components(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
