"""MinHash near-duplicate detection by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Every text becomes its set of three-word shingles (64-bit hashes) and a signature of ``COORDINATES`` minima; equal sets
   collapse to one class, named by its smallest doc_id, before anything is joined.
2. Classes are posted under their (coordinate, value) pairs. Two classes with at least m equal coordinates share one of
   their rarest ``COORDINATES - m + 1`` pairs, in the order of global frequency, so only this prefix is posted; pairs that
   one class alone has are posted nowhere. m follows from the threshold, so that a link right at it is missed with a chance
   of at most ``MISSED`` (and one clearly above it hardly ever).
3. The members of a posting list form no pairs. Each list names a leader, the member whose pairs are most frequent, and the
   stars of one leader are gathered. Jaccard distance is a metric, so two members can only be linked if their distances to
   the leader differ by at most 1 - threshold: members are dealt into rings of that width, members that are linked to the
   leader are together already, and the others meet their own and the next inner ring in blocks. Blocks count collisions,
   keep pairs with enough of them, confirm these on the full sets, and give out only links that join what was apart.
4. Components of the links by alternating large and small stars.

A hot leader or ring is cut in blocks of bounded size, and texts of classes that no list joins are not moved.

Null or blank text has the empty set and is linked with nothing. Fewer than three words are one shingle. doc_id names one
document: rows repeated under one doc_id are equal. Rows without doc_id take no part: component_id is null and kept true.
Empty input gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadspark.llm.common import mixed, packed, stored, table, texts_of

WORDS, THRESHOLD, COORDINATES, MISSED = 3, 85, 48, 1e-4
STAR, LEFT, RIGHT, GROUP = 512, 256, 1_024, 500
FILTER_BITS = 2**23  # of the bitmap that tells which texts are needed: 1 MB
_CELLS = 32_000_000


def shingles(text: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; of the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total = mixed(total + hashed[k : len(words) - width + 1 + k], k)
    return np.unique(total)


def _factors(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.arange(coordinates, dtype=np.uint64)
    return mixed(numbers, 101) | np.uint64(1), mixed(numbers, 202)


def signature(hashes: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """(coordinate, 32-bit minimum) pairs as 64-bit numbers; the set must not be empty."""
    a, b = _factors(coordinates)
    least = np.full(coordinates, 2**64 - 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(hashes), 4_096):
            least = np.minimum(least, (a[:, None] * hashes[None, k : k + 4_096] + b[:, None]).min(axis=1))
    return (np.arange(coordinates, dtype=np.int64) << 32) | (least >> np.uint64(32)).astype(np.int64)


def least_matches(coordinates: int, threshold: int, missed: float = MISSED) -> int:
    """The largest match threshold that a pair of ``threshold`` percent similarity misses with at most this chance."""
    share, below = threshold / 100, 0.0
    for m in range(coordinates):
        below += math.comb(coordinates, m) * share**m * (1 - share) ** (coordinates - m)
        if below > missed:
            return max(1, m)
    return coordinates


def signatures(docs: DataFrame, words: int, coordinates: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, and its coordinate-value pairs (null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, pairs = [], [], []
            for text in texts_of(batch):
                hashes = shingles(text, words)
                sizes.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                pairs.append(signature(hashes, coordinates) if len(hashes) else None)
            arrays = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(pairs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "digest", "pairs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, pairs array<long>")


def prefix_postings(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(pair, rep, weight): each class under its rarest pairs; weight: how frequent all its pairs are."""
    posted = classes.select("rep", F.explode("pairs").alias("pair")).repartition("pair")
    frequency = posted.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    shared = posted.join(frequency, "pair").groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("n", "pair"))).alias("found"), F.sum("n").alias("weight")
    )
    # pairs of one class only come first in the order of rarity, so what the prefix has left is cut from the others
    left = F.size("found") - (matches - 1)
    return shared.where(left > 0).select("rep", "weight", F.explode(F.slice("found.pair", F.lit(1), left)).alias("pair"))


def stars(postings: DataFrame) -> DataFrame:
    """Distinct (leader, member) over all posting lists."""
    dealt = postings.repartition("pair")
    leaders = dealt.groupBy("pair").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"))).alias("top"))
    met = dealt.join(leaders, "pair").select((-F.col("top.rep")).alias("leader"), F.col("rep").alias("member"))
    return met.where(F.col("leader") != F.col("member")).distinct()


def member_filter(members: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """A bitmap of hashed ids of at most ``bits`` bits, whatever the number of members; it passes too much, never too little."""
    value = F.pmod(F.xxhash64("rep"), F.lit(bits)) + 1
    maps = members.groupBy(F.bitmap_bucket_number(value).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("map"))
    whole = bytearray(bits // 8)
    for k, part in maps.toLocalIterator():  # one row per 32,768 bits
        whole[(k - 1) * 4_096 : k * 4_096] = part
    return bytes(whole)


def full_sets(docs: DataFrame, members: DataFrame, words: int, coordinates: int) -> DataFrame:
    """Shingle set and signature of the documents in ``members`` (column rep). Texts stay where they are read."""
    sent = docs.sparkSession.sparkContext.broadcast(member_filter(members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.unpackbits(np.frombuffer(sent.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(passes[batch.column("place").to_numpy()]))
            sets = [shingles(text, words) for text in texts_of(batch)]
            marks = [packed(signature(s, coordinates), "<u4") if len(s) else b"" for s in sets]
            arrays = [batch.column("rep"), pa.array([packed(s, "<u8") for s in sets], pa.binary()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["rep", "hashes", "marks"])

    read = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("rep"), "text")
    read = read.withColumn("place", F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS)))
    made = read.mapInArrow(run, "rep long, hashes binary, marks binary")
    return made.join(members, "rep", "left_semi").dropDuplicates(["rep"])


def _rows(frame: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    ids = frame["rep"].to_numpy(np.int64)
    sets = [np.frombuffer(raw, "<u8") for raw in frame["hashes"]]
    marks = np.stack([np.frombuffer(raw, "<u4") for raw in frame["marks"]]) if len(frame) else np.zeros((0, 1), np.uint32)
    return ids, sets, marks


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Sizes of intersections: for parts (from, to) of ``left``, a matrix of right x part; memory is bounded."""
    first = 0
    while first < len(left):
        last, cells = first, 0
        while last < len(left) and (last == first or (cells + len(left[last])) * (last + 1 - first) <= _CELLS):
            cells += len(left[last])
            last += 1
        known = np.unique(np.concatenate(left[first:last])) if cells else np.zeros(0, np.uint64)
        has = np.zeros((len(known), last - first), dtype=np.uint8)
        for k in range(first, last):
            has[np.searchsorted(known, left[k]), k - first] = 1
        counts = np.zeros((len(right), last - first), dtype=np.int64)
        for k, hashes in enumerate(right):
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                counts[k] = has[at[known[at] == hashes]].sum(axis=0, dtype=np.int64)
        yield first, last, counts
        first = last


def _fold(column: str, total: str, size: int):
    return F.pmod(F.xxhash64(column), F.ceil(F.col(total) / size))


def star_distances(pairs: DataFrame, sets: DataFrame, threshold: int, matches: int, groups: int) -> DataFrame:
    """leader, member, distance and linked of every star pair; many small stars share a task, large ones are cut."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        members, out = rows[rows["leader"].notna()], []
        heads, head_sets, head_marks = _rows(rows[rows["leader"].isna()])
        known = {head: k for k, head in enumerate(heads.tolist())}
        ids, sets, marks = _rows(members)
        owners = members["leader"].to_numpy(np.int64)
        for head in np.unique(owners).tolist():
            own, k = np.flatnonzero(owners == head), known[head]
            for _, _, counts in shared_counts([head_sets[k]], [sets[i] for i in own]):
                both = counts[:, 0]
                union = np.array([len(sets[i]) for i in own]) + len(head_sets[k]) - both
                enough = (marks[own] == head_marks[k]).sum(axis=1) >= matches
                out.append(pd.DataFrame({"leader": head, "member": ids[own], "distance": 1.0 - both / union, "linked": enough & (100 * both >= threshold * union)}))
        return pd.concat(out) if out else pd.DataFrame({"leader": [], "member": [], "distance": [], "linked": []}).astype({"leader": "int64", "member": "int64", "linked": bool})

    sized = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    dealt = pairs.join(sized, "leader").withColumn("fold", _fold("member", "n", STAR))
    dealt = dealt.select("leader", "member", F.pmod(F.xxhash64("leader", "fold"), F.lit(groups)).alias("bucket"))
    heads = dealt.select("bucket", F.lit(None).cast("long").alias("leader"), F.col("leader").alias("rep")).distinct()
    placed = dealt.select("bucket", "leader", F.col("member").alias("rep")).unionByName(heads).join(sets, "rep")
    return placed.groupBy("bucket").applyInPandas(run, "leader long, member long, distance double, linked boolean")


def ring_links(star: DataFrame, sets: DataFrame, threshold: int, matches: int, groups: int) -> DataFrame:
    """Links between members of one star that the leader does not join."""
    width = (100 - threshold) / 100 + 1e-4

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, rows in bucket.groupby("block"):
            xs, left, left_marks = _rows(rows[rows["outer"]])
            ys, right, right_marks = _rows(rows[~rows["outer"]])
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            left_size, right_size = np.array([len(s) for s in left]), np.array([len(s) for s in right])
            for first, last, both in shared_counts(left, right):
                union = right_size[:, None] + left_size[None, first:last] - both
                for j, k in np.argwhere(100 * both >= threshold * union).tolist():
                    x, y = int(xs[first + k]), int(ys[j])
                    if x != y and (a := root(x)) != (b := root(y)) and int((left_marks[first + k] == right_marks[j]).sum()) >= matches:
                        parent[a] = b
                        out.append((x, y))
        return pd.DataFrame(out, columns=["leader", "member"], dtype=np.int64)

    ringed = star.withColumn("ring", F.floor(F.col("distance") / width).cast("int"))
    outer = ringed.where(~F.col("linked")).select("leader", "ring", "member")
    inner = ringed.select("leader", "member", F.explode(F.array("ring", F.col("ring") + 1)).alias("ring"))
    size = outer.groupBy("leader", "ring").agg(F.count(F.lit(1)).alias("n_outer"))
    size = size.join(inner.groupBy("leader", "ring").agg(F.count(F.lit(1)).alias("n_inner")), ["leader", "ring"])
    size = size.where(F.col("n_inner") > 1).select(
        "leader", "ring", F.ceil(F.col("n_outer") / LEFT).alias("lefts"), F.ceil(F.col("n_inner") / RIGHT).alias("rights")
    )

    def blocks(side: DataFrame, own: str, other: str) -> DataFrame:
        i, j = F.pmod(F.xxhash64("member"), own), F.explode(F.sequence(F.lit(0), F.col(other).cast("int") - 1))
        dealt = side.join(size, ["leader", "ring"]).select("leader", "ring", "member", i.alias("own"), j.alias("other"))
        at = ("own", "other") if own == "lefts" else ("other", "own")
        block = F.concat_ws("/", "leader", "ring", *at)
        bucket = F.pmod(F.xxhash64(block), F.lit(groups))
        return dealt.select(bucket.alias("bucket"), block.alias("block"), F.lit(own == "lefts").alias("outer"), F.col("member").alias("rep"))

    placed = blocks(outer, "lefts", "rights").unionByName(blocks(inner, "rights", "lefts")).join(sets, "rep")
    return placed.groupBy("bucket").applyInPandas(run, "leader long, member long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component, for every node that has a link.

    Large-star and small-star rounds; each takes a map-side combined minimum per node and joins it back.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("top"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("top").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("top"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("top").alias("b")).unionByName(small.select("a", F.col("top").alias("b"))).where("a <> b").distinct()
        after = stored(small, "edges")
        same = edges.exceptAll(after).isEmpty() and edges.count() == after.count()
        edges = after
        if same:
            labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
            return labels.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``; linked at a similarity of ``threshold`` percent."""
    matches = least_matches(coordinates, threshold)
    signed = stored(signatures(docs, words, coordinates), "signatures")
    compared = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = compared.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("pairs").alias("pairs"))
    classes = stored(classes, "classes")
    pairs = stored(stars(prefix_postings(classes, coordinates, matches)), "stars")
    groups = max(1, math.ceil(pairs.count() / GROUP))
    members = pairs.select(F.col("leader").alias("rep")).union(pairs.select("member")).distinct()
    sets = stored(full_sets(docs, members, words, coordinates), "sets")
    star = stored(star_distances(pairs, sets, threshold, matches, groups), "distances")
    rings = ring_links(star, sets, threshold, matches, groups)
    links = star.where("linked").select("leader", "member").unionByName(rings)
    labels = components(links.select(F.col("leader").alias("a"), F.col("member").alias("b")))
    named = classes.select("digest", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("label", "rep").alias("component"))
    filled = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    found = signed.join(named, "digest", "left").select("doc_id", "n_shingles", filled.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
