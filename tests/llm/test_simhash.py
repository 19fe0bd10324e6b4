"""SimHash groups against all pairs of fingerprints."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from threadspark.llm import simhash

SCHEMA = "doc_id long, text string, lang string, fp string, component string, node long, rank int"


def make(spark, texts, first=0):
    return spark.createDataFrame([(k + first, text, "en", "a", "b", 1, 2) for k, text in enumerate(texts)], SCHEMA)


def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + width]), 42) for k in range(len(words) - width + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=2):
    """Smallest reachable id; fps: id -> fingerprint."""
    parent = {k: k for k in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    values = np.array([fps[k] for k in ids], dtype=np.uint64)
    for n, a in enumerate(ids):
        for m in np.flatnonzero(np.bitwise_count(values[n + 1 :] ^ values[n]) <= distance):
            x, y = root(a), root(ids[n + 1 + m])
            parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in ids}


def texts():
    pick = random.Random(8)
    words = ["alpha", "Beta", "gamma", "delta", "été", "日本", "x", "y"]
    base = [" ".join(pick.choices(words, k=pick.randint(1, 60))) for _ in range(120)]
    near = []
    for text in base[:40]:
        for _ in range(4):
            changed = text.split()
            changed[pick.randrange(len(changed))] = pick.choice(words)
            near.append("\t".join(changed) + "\n")
    return [None, "", " \n ", "a", "A", "a b", *base, *base[:30], *near, " ".join(pick.choices(words, k=70_000))]


def test_groups_equal_all_pairs(spark):
    rows = texts()
    found = simhash.simhash_components(make(spark, rows).repartition(5), block=16).collect()
    fps = {k: plain_fingerprint(text) for k, text in enumerate(rows)}
    assert {row["doc_id"]: row["fp"] % 2**64 for row in found} == fps
    expected = plain_components(fps)
    assert {row["doc_id"]: row["component_id"] for row in found} == expected and len(found) == len(rows)
    assert 2 < len(set(expected.values())) < len(rows) - 40


def test_repeated_rows_rows_without_id_and_empty_input(spark):
    docs = make(spark, ["a b c d", "a b c d", "z"], 5)
    docs = docs.unionByName(docs.limit(1)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    found = sorted((row["doc_id"] or -1, row["component_id"]) for row in simhash.simhash_components(docs).collect())
    assert found == [(-1, None), (5, 5), (5, 5), (6, 5), (7, 7)]
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_links_of_dense_fingerprints(spark):
    # chains, stars and a crowd of fingerprints around a few centres, over many blocks and levels
    pick = random.Random(3)
    centres = [pick.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1, 2**63]
    fps = set(centres)
    for centre in centres:
        at = centre
        for _ in range(pick.choice([0, 3, 40])):
            at ^= (1 << pick.randrange(64)) | (1 << pick.randrange(64))
            fps.add(at)
            fps.add(centre ^ (1 << pick.randrange(64)))
    fps |= {pick.getrandbits(64) for _ in range(1_500)}
    fps = sorted(fps)
    classes = spark.createDataFrame([(k, fp - 2**64 if fp >= 2**63 else fp) for k, fp in enumerate(fps)], "rep long, fp long")
    leaves = simhash.leaf_blocks(classes, 8)
    pairs = simhash.near_blocks(leaves, 2)
    n = leaves.count()
    assert pairs.count() < 0.5 * n * (n + 1) / 2  # whole groups are pruned
    number = {fp: k for k, fp in enumerate(fps)}
    links = [(number[row["x"] % 2**64], number[row["y"] % 2**64]) for row in simhash.block_links(pairs, leaves, 2).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in links)
    parent = {k: k for k in range(len(fps))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert {k: root(k) for k in parent} == plain_components(dict(enumerate(fps)))


def test_gray_order_follows_the_reflected_code(spark):
    codes = [k ^ (k >> 1) for k in range(256)]  # the Gray code of 0, 1, 2, …
    for shift in (0, 56):
        rows = [(k, (c << shift) - 2**64 if (c << shift) >= 2**63 else c << shift) for k, c in enumerate(codes)]
        found = spark.createDataFrame(rows, "k long, fp long").orderBy(simhash.gray_order(F.col("fp"))).select("k").collect()
        assert [row["k"] for row in found] == list(range(256))


@pytest.mark.parametrize("size", [1, 31, 32, 33, 200])
def test_close_pairs_are_all_pairs(size):
    pick = np.random.default_rng(size)
    values = pick.integers(-(2**63), 2**63, 40)
    near = np.concatenate([values ^ (1 << k) for k in range(5)])
    left, right = pick.choice(near, size), np.sort(pick.choice(near, size))
    i, j = simhash.close_pairs(left, right, 2)
    apart = np.bitwise_count(left.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :])
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(apart <= 2)), strict=True))
