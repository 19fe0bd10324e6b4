"""Exact top-k search by inner product over a pivot-distance index.

Vectors become integers, floor(scale * x). With M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) give
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the largest products are the nearest points and the triangle inequality holds. Each
vector is keyed by its nearest pivot and its distance to it; per pivot the keys are cut into sorted annuli of bounded
size, and an annulus with too many equal keys into several blocks. Queries are packed in blocks by nearest pivot.

A query block first meets the annuli of its own pivot that its distance is nearest to. The k-th best distance found so far
then bounds the search: an annulus [lo, hi] of pivot p is visited only if max(0, lo - d(q, p), d(q, p) - hi) is not above
it. The bound is checked for blocks when pairs are formed and for each query when they are met. Pivots are a bounded
sample and steer the work only: every vector is indexed and results are exact.

Vectors that are null, or hold a null, a non-finite component or one beyond 64-bit integers, and rows without vec_id take
no part. Shorter vectors count as padded with zeros. Repeated rows each take part; a query meets no row with its own id.
Ties go to the smaller id. Without queries or candidates the result is empty. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from threadspark.llm.common import packed, stored, table

PIVOTS, BINS, BLOCK_ROWS, QUERY_ROWS, FIRST = 32, 256, 1_024, 256, 2


def integer_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, vector (packed 64-bit integers) and squared norm of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, norms = [], [], []
            for name, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if name is None or vector is None or any(x is None for x in vector):
                    continue
                whole = np.floor(scale * np.array(vector, dtype=np.float64))
                if not np.isfinite(whole).all() or (np.abs(whole) >= 2.0**63).any():
                    continue
                ids.append(name)
                vectors.append(packed(whole.astype(np.int64), "<i8"))
                norms.append(float(whole @ whole))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary()), pa.array(norms, pa.float64())], ["vec_id", "vector", "norm"])

    cast = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return cast.mapInArrow(run, "vec_id long, vector binary, norm double")


def matrix(vectors: list[bytes], size: int) -> np.ndarray:
    full = np.zeros((len(vectors), size), dtype=np.int64)
    for k, raw in enumerate(vectors):
        found = np.frombuffer(raw, "<i8")
        full[k, : len(found)] = found
    return full


def lifted(whole: np.ndarray, top: float, query: bool) -> np.ndarray:
    """The vectors with the coordinate that makes products distances."""
    points = whole.astype(np.float64)
    extra = np.zeros(len(points)) if query else np.sqrt(np.maximum(0.0, top - (points * points).sum(axis=1)))
    return np.column_stack([points, extra])


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((points[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2)) if len(points) else np.zeros((0, len(pivots)))


def top_of(scores: np.ndarray, ids: np.ndarray, k: int, least: int | None) -> np.ndarray:
    """Places of the k best, by score and then smaller id; none under ``least``."""
    places = np.arange(len(scores)) if least is None else np.flatnonzero(scores >= least)
    if len(places) > k:
        edge = np.partition(scores[places], len(places) - k)[len(places) - k]
        places = places[scores[places] >= edge]
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def products(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Integer inner products; by floats where these are exact."""
    if not queries.size or not block.size:
        return np.zeros((len(queries), len(block)), dtype=np.int64)
    size = float(np.abs(queries).max()) * float(np.abs(block).max()) * queries.shape[1]
    if size < 2.0**53:
        return (queries.astype(np.float64) @ block.astype(np.float64).T).astype(np.int64)
    return queries @ block.T


def _keyed(vectors: DataFrame, pivots: list[bytes], size: int, top: float, query: bool) -> DataFrame:
    """Adds the nearest pivot and the distance to it."""
    sent = vectors.sparkSession.sparkContext.broadcast(lifted(matrix(pivots, size), top, False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(k, BLOCK_ROWS)
                away = distances(lifted(matrix(part.column("vector").to_pylist(), size), top, query), sent.value)
                near = away.argmin(axis=1).astype(np.int32)
                arrays = [part.column("vec_id"), part.column("vector"), pa.array(near), pa.array(away[np.arange(len(near)), near])]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "vector", "pivot", "distance"])

    return vectors.select("vec_id", "vector").mapInArrow(run, "vec_id long, vector binary, pivot int, distance double")


def _blocked(keyed: DataFrame, top_distance: float, rows: int) -> DataFrame:
    """Adds ``block``: neighbouring distance bins of a pivot with about ``rows`` rows; a fuller bin is split by hash."""
    bin_of = F.least(F.floor(F.col("distance") * (BINS / top_distance if top_distance else 0.0)), F.lit(BINS - 1)).cast("int")
    binned = keyed.withColumn("bin", bin_of)
    per_bin = binned.groupBy("pivot", "bin").agg(F.count(F.lit(1)).alias("n"))  # at most PIVOTS * BINS rows
    before = W.partitionBy("pivot").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    rings = per_bin.select(
        "pivot", "bin", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / rows).alias("ring"),
        F.ceil(F.col("n") / rows).alias("splits"),
    )
    split = F.pmod(F.xxhash64("vec_id", "vector"), "splits")
    ring = F.when(F.col("splits") > 1, F.concat_ws("/", "bin", split)).otherwise("")
    return binned.join(rings, ["pivot", "bin"]).withColumn("block", F.concat_ws("/", "pivot", "ring", ring))


def build_index(vectors: DataFrame, pivots: list[bytes], size: int, top: float) -> DataFrame:
    """A row per annulus block: block, pivot, lo, hi, and its ids and vectors in order of distance."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["distance", "vec_id"])
        far = rows["distance"].to_numpy()
        values = (key[0], int(rows["pivot"].iloc[0]), far[0], far[-1], packed(rows["vec_id"].to_numpy(), "<i8"), packed(matrix(rows["vector"].tolist(), size), "<i8"))
        return pd.DataFrame([values], columns=["block", "pivot", "lo", "hi", "ids", "vectors"])

    keyed = stored(_keyed(vectors, pivots, size, top, False), "vector-keys")
    reach = keyed.agg(F.max("distance")).first()[0] or 0.0
    packs = _blocked(keyed, reach, BLOCK_ROWS).groupBy("block").applyInPandas(
        pack, "block string, pivot int, lo double, hi double, ids binary, vectors binary"
    )
    return stored(packs, "annuli")


def pack_queries(queries: DataFrame, pivots: list[bytes], size: int, top: float) -> DataFrame:
    """A row per query block: group, pivot, ids, vectors, distances to all pivots, and their least and largest."""
    sent = queries.sparkSession.sparkContext.broadcast(lifted(matrix(pivots, size), top, False))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = matrix(rows["vector"].tolist(), size)
        away = distances(lifted(whole, top, True), sent.value)
        values = (key[0], int(rows["pivot"].iloc[0]), packed(rows["vec_id"].to_numpy(), "<i8"), packed(whole, "<i8"), packed(away, "<f8"), away.min(axis=0).tolist(), away.max(axis=0).tolist())
        return pd.DataFrame([values], columns=["group", "near", "query_ids", "queries", "away", "least", "most"])

    keyed = _keyed(queries, pivots, size, top, True)
    number = keyed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).alias("splits"))
    grouped = keyed.join(number, "pivot").withColumn("group", F.concat_ws("/", "pivot", F.pmod(F.xxhash64("vec_id", "vector"), "splits")))
    packs = grouped.groupBy("group").applyInPandas(
        pack, "group string, near int, query_ids binary, queries binary, away binary, least array<double>, most array<double>"
    )
    return stored(packs, "queries")


def _meet(pairs: DataFrame, queries: DataFrame, index: DataFrame, size: int, top: float, k: int, limits: DataFrame | None) -> DataFrame:
    """Best candidates of each query in each of its blocks; ``limits``: the k-th best score per query found before."""
    met = pairs.select("group", "block").join(queries.select("group", "query_ids", "queries", "away"), "group").join(index, "block")
    met = met.withColumn("limits", F.lit(None).cast("array<long>")) if limits is None else met.join(limits, "group", "left")
    schema = T.StructType([T.StructField("group", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("query_id", T.LongType())])
    schema = schema.add("ids", T.ArrayType(T.LongType())).add("scores", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, ids = np.frombuffer(row["query_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                wanted, block = (np.frombuffer(row[x], "<i8").reshape(n, size) for x, n in (("queries", len(names)), ("vectors", len(ids))))
                away = np.frombuffer(row["away"], "<f8").reshape(len(names), -1)[:, row["pivot"]]
                bound = np.maximum(0.0, np.maximum(row["lo"] - away, away - row["hi"]))
                least: list[int | None] = row["limits"] or [None] * len(names)
                norms = (wanted.astype(np.float64) ** 2).sum(axis=1)
                reach = np.array([np.inf if s is None else math.sqrt(max(0.0, n + top - 2.0 * s)) for s, n in zip(least, norms, strict=True)])
                chosen = np.flatnonzero(bound <= reach + 1e-6 * (1.0 + reach))
                scores = products(wanted[chosen], block)
                out: list[tuple] = []
                for place, line in zip(chosen.tolist(), scores, strict=True):
                    others = ids != names[place]
                    best = top_of(line[others], ids[others], k, least[place])
                    if len(best):
                        out.append((place, int(names[place]), ids[others][best], line[others][best]))
                columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
                arrays = [pa.array([row["group"]] * len(out), pa.string()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64())]
                arrays += [pa.array([c.tolist() for c in columns[j]], pa.list_(pa.int64())) for j in (2, 3)]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return met.select("group", "query_ids", "queries", "away", "pivot", "lo", "hi", "ids", "vectors", "limits").mapInArrow(run, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of all candidates of each query, as an array of (score, vec_id) in order."""
    one: Column = F.explode(F.arrays_zip("scores", "ids"))
    rows = found.select("group", "place", "query_id", one.alias("one")).select("group", "place", "query_id", "one.*")
    order = W.partitionBy("group", "place").orderBy(F.desc("scores"), "ids")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_topk(rows: DataFrame, is_query: Column, k: int, scale: int = 64, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best rows for every row where ``is_query`` holds."""
    vectors = stored(integer_vectors(rows, scale), "vectors")
    top, size = vectors.agg(F.max("norm"), F.max(F.octet_length("vector"))).first()
    top, size = top or 0.0, max(1, (size or 0) // 8)
    chosen = [row["vector"] for row in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("vector").toLocalIterator()] or [b""]
    index = build_index(vectors, chosen, size, top)
    queries = pack_queries(vectors.where(is_query), chosen, size, top)
    one = F.col("pivot") + 1
    bound = F.greatest(F.lit(0.0), F.col("lo") - F.element_at("most", one), F.element_at("least", one) - F.col("hi"))
    outlines = queries.select("group", "near", "least", "most")
    # one row per query block and annulus block: bounds only, no vectors
    pairs = outlines.crossJoin(index.select("block", "pivot", "lo", "hi")).select("group", "block", "near", "pivot", bound.alias("bound"))
    order = W.partitionBy("group").orderBy((F.col("near") != F.col("pivot")).cast("int"), "bound", "block")
    first = stored(pairs.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= FIRST), "first-annuli")
    found = stored(_meet(first, queries, index, size, top, k, None), "first-found")
    edge = _best(found, k).where(F.col("rank") == k).select("group", "place", F.col("scores").alias("edge"))
    places = queries.select("group", F.posexplode(F.sequence(F.lit(1), F.floor(F.octet_length("query_ids") / 8).cast("int"))).alias("place", "one"))
    limits = (
        places.join(edge, ["group", "place"], "left").groupBy("group")
        .agg(F.array_sort(F.collect_list(F.struct("place", "edge"))).alias("all")).select("group", F.col("all.edge").alias("limits"))
    )
    limits = stored(limits, "limits")
    farthest = queries.join(limits, "group").select("group", "limits", F.exists("limits", lambda x: x.isNull()).alias("open"), F.array_min("limits").alias("edge"), "queries")
    # the norm of a query is at most the largest norm, so this is at least the distance of every query's k-th best
    reach = F.when(F.col("open"), F.lit(float("inf"))).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.lit(float(2 * top)) - 2 * F.col("edge"))))
    rest = (
        pairs.join(first.select("group", "block"), ["group", "block"], "left_anti")
        .join(farthest.select("group", reach.alias("reach")), "group").where(F.col("bound") <= F.col("reach") * (1 + 1e-6) + 1e-6)
    )
    whole = found.unionByName(_meet(rest, queries, index, size, top, k, limits))
    return _best(whole, k).select("query_id", F.col("rank").cast("int"), F.col("ids").alias("vec_id"), F.col("scores").alias("score"))


def op6_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return exact_topk(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""
