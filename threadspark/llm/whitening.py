"""Embedding whitening by blockwise QR and a bidiagonal qd solver.

1. Components become integers, floor(scale * c) + offset, and each task sums them exactly: n and S.
2. Rows are centred before anything is multiplied, n * x - S in integers, then divided. Each task folds its blocks of rows
   into one triangle R by QR; triangles meet ``FAN`` at a time, level by level, until one is left. R^T R is n times the covariance,
   which is never formed.
3. ``qd_svd`` finds the squared singular values and right singular vectors of R: Householder bidiagonal, dqds, twisted
   factorisations. R has the size of a vector, whatever the number of rows.
4. Rows are projected on the components. The covariance of the whitened rows is measured over all of them, from means and
   centred products that are merged pairwise along the same tree.

Vectors that are null, or hold a null, a non-finite component or one beyond 64-bit integers, take no part and are not
returned; rows without vec_id and repeated rows are rows like any other. Shorter vectors count as padded with components of
zero, the empty vector too. A component without variance (fewer rows than dimensions, equal vectors) cannot be whitened: its
``whitened`` is null, and the identity is measured over the others; without any of them the error is 0. Equal eigenvalues
are numbered in any order, the same for all rows. Deviations beyond 38 digits are null. Empty input gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadspark.llm import qd_svd
from threadspark.llm.common import packed, stored, table

SCALE, OFFSET, TOP, FAN = 64, 1_000_000, 32, 16
#: Entries of a block of rows.
CELLS = 1_000_000


@dataclass(frozen=True)
class Whitening:
    """A fitted model: exact sums, components as columns by falling eigenvalue, and the covariance's trace."""

    scale: int
    offset: int
    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def kept(self, top: int | None) -> int:
        return len(self.sums) if top is None else min(top, len(self.sums))

    def explained(self, top: int | None) -> list[float]:
        return [float(e) / self.trace if self.trace > 0 else 0.0 for e in self.eigenvalues[: self.kept(top)]]

    def directions(self, top: int | None) -> np.ndarray:
        """Components over the root of their eigenvalue; NaN where there is no variance."""
        e = self.eigenvalues[: self.kept(top)]
        with_variance = e > (len(self.sums) * qd_svd.EPS) ** 2 * max(float(e.max(initial=0.0)), 0.0)
        return self.components[:, : len(e)] / np.sqrt(np.where(with_variance, e, np.nan))


def whole_rows(batch: pa.RecordBatch, scale: int, offset: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, components as integers one after the other, and lengths, of the rows that take part."""
    lists = batch.column("embedding")
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        floors = np.floor(scale * values)
    bad = ~(np.abs(floors) < 2.0**63 - 2.0**24 - abs(offset))
    before = np.concatenate([[0], np.cumsum(bad)])
    ends = np.cumsum(lengths)
    fine = (before[ends] == before[ends - lengths]) & lists.is_valid().to_numpy(zero_copy_only=False)
    flat = np.where(bad, 0.0, floors).astype(np.int64) + offset
    return batch.column("vec_id").filter(pa.array(fine)), flat[np.repeat(fine, lengths)], lengths[fine]


def matrix(flat: np.ndarray, lengths: np.ndarray, size: int, offset: int) -> np.ndarray:
    if (lengths == size).all():
        return flat.reshape(len(lengths), size)
    full = np.full((len(lengths), size), offset, dtype=np.int64)
    full[np.arange(size) < lengths[:, None]] = flat
    return full


def _read(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def exact_sums(rows: DataFrame, scale: int, offset: int) -> tuple[int, tuple[int, ...]]:
    """n and S: a task sends one row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, n = np.zeros(0, dtype=object), np.zeros(0, dtype=np.int64), 0
        for batch in batches:
            _, flat, lengths = whole_rows(batch, scale, offset)
            size = int(lengths.max(initial=0))
            if size > len(total):
                total = np.concatenate([total, np.zeros(size - len(total), dtype=object)])
                seen = np.concatenate([seen, np.zeros(size - len(seen), dtype=np.int64)])
            n += len(lengths)
            places = np.concatenate([np.arange(k) for k in lengths]) if (lengths != size).any() else np.tile(np.arange(size), len(lengths))
            if float(np.abs(flat).max(initial=0)) * len(lengths) < 2.0**62:
                found = np.zeros(size, dtype=np.int64)
                np.add.at(found, places, flat)
            else:
                found = np.zeros(size, dtype=object)
                np.add.at(found, places, flat.astype(object))
            total[:size] += found.astype(object)
            seen[:size] += np.bincount(places, minlength=size)[:size] if size else 0
        if n:
            dims = list(range(-1, len(total)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(dims, pa.int32()), pa.array([n, *seen.tolist()], pa.int64()), pa.array([Decimal(0), *map(Decimal, total.tolist())], pa.decimal128(38, 0))],
                ["dim", "n", "total"],
            )

    found = _read(rows).mapInArrow(run, "dim int, n long, total decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    by_dim = {row["dim"]: row for row in found.toLocalIterator()}  # a row per dimension
    n = by_dim.pop(-1)["n"] if by_dim else 0
    return n, tuple(int(by_dim[k]["total"]) + offset * (n - by_dim[k]["n"]) for k in range(len(by_dim)))


def scaled_centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exact: 64-bit integers where these suffice, else Python's."""
    most = float(np.abs(x).max(initial=0)) * n + float(max(map(abs, sums), default=0))
    if most < 2.0**62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return scaled_centred(x, n, sums).astype(np.float64) / n


def _slices(batches: Iterator[pa.RecordBatch], model_size: int, scale: int, offset: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    step = max(1, CELLS // max(1, model_size))
    for batch in batches:
        for k in range(0, batch.num_rows, step):
            ids, flat, lengths = whole_rows(batch.slice(k, step), scale, offset)
            if len(lengths):
                yield ids, matrix(flat, lengths, model_size, offset)


def tree(parts: DataFrame, name: str, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One part out of the parts of all tasks (node, part), ``FAN`` at a time; they all have the same bounded size."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"node": [int(rows["node"].iloc[0]) // FAN], "part": [merge(rows.sort_values("node")["part"].tolist())]})

    parts = stored(parts, name)
    while (left := parts.count()) > 1:
        parts = stored(parts.groupBy(F.floor(F.col("node") / FAN)).applyInPandas(run, "node long, part binary"), name)
    return parts.first()["part"] if left else None


def triangle(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(blocks), mode="r")


def fit(rows: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> Whitening:
    n, sums = exact_sums(rows, scale, offset)
    size = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((0, size))
        for _, x in _slices(batches, size, scale, offset):
            found = triangle([found, centred(x, n, sums)])
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([packed(found, "<f8")], pa.binary())], ["node", "part"])

    def merge(parts: list[bytes]) -> bytes:
        return packed(triangle([np.frombuffer(part, "<f8").reshape(-1, size) for part in parts]), "<f8")

    raw = tree(_read(rows).mapInArrow(run, "node long, part binary"), "triangles", merge) if size else None
    square = np.zeros((size, size))
    if raw is not None:
        found = np.frombuffer(raw, "<f8").reshape(-1, size)
        square[: len(found)] = found
    values, vectors = qd_svd.right_vectors(square)
    return Whitening(scale, offset, n, sums, vectors, values / max(n, 1), float((square * square).sum()) / max(n, 1))


def _moments(whitened: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = whitened.mean(axis=0)
    away = whitened - mean
    return len(whitened), mean, away.T @ away


def _joined(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    n, away = a[0] + b[0], b[1] - a[1]
    return n, a[1] + away * (b[0] / n), a[2] + b[2] + np.outer(away, away) * (a[0] * (b[0] / n))


def identity_error(rows: DataFrame, model: Whitening, top: int | None = TOP) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components with variance."""
    directions = model.directions(top)
    directions = directions[:, np.isfinite(directions).all(axis=0)] if len(model.sums) else directions
    k, size, n, sums, scale, offset = directions.shape[1], len(model.sums), model.n, model.sums, model.scale, model.offset
    if not k or not n:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for _, x in _slices(batches, size, scale, offset):
            own = _moments(centred(x, n, sums) @ directions)
            found = own if found is None else _joined(found, own)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_written(found)], pa.binary())], ["node", "part"])

    def _written(found: tuple[int, np.ndarray, np.ndarray]) -> bytes:
        return packed(np.concatenate([[found[0]], found[1], found[2].ravel()]), "<f8")

    def _parsed(part: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        numbers = np.frombuffer(part, "<f8")
        return int(numbers[0]), numbers[1 : k + 1], numbers[k + 1 :].reshape(k, k)

    def merge(parts: list[bytes]) -> bytes:
        found = _parsed(parts[0])
        for part in parts[1:]:
            found = _joined(found, _parsed(part))
        return _written(found)

    raw = tree(_read(rows).mapInArrow(run, "node long, part binary"), "moments", merge)
    total, _, products = _parsed(raw)
    return float(np.abs(products / total - np.eye(k)).max())


def deviations(scaled: np.ndarray) -> pa.Array:
    """Sums of squares of integers, exact."""
    if scaled.dtype != object and float(np.abs(scaled).max(initial=0)) ** 2 * max(1, scaled.shape[1]) < 2.0**62:
        return pa.array((scaled * scaled).sum(axis=1)).cast(pa.decimal128(38, 0))
    whole = scaled.astype(object)
    found = (whole * whole).sum(axis=1).tolist() if whole.shape[1] else [0] * len(whole)
    return pa.array([Decimal(v) if v < 10**38 else None for v in found], pa.decimal128(38, 0))


def whiten(rows: DataFrame, model: Whitening, top: int | None = TOP) -> DataFrame:
    """vec_id, deviation and the list ``whitened`` of every row that takes part; one pass, nothing moves."""
    directions = model.directions(top)
    without = ~np.isfinite(directions).all(axis=0) if directions.size else np.zeros(directions.shape[1], bool)
    filled = np.where(without, 0.0, directions)
    size, n, sums, scale, offset = len(model.sums), model.n, model.sums, model.scale, model.offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _slices(batches, size, scale, offset):
            scaled = scaled_centred(x, n, sums)
            found = (scaled.astype(np.float64) / n) @ filled
            values = pa.array(found.ravel(), mask=np.tile(without, len(found)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * filled.shape[1]), values)
            yield pa.RecordBatch.from_arrays([ids, deviations(scaled), lists], ["vec_id", "deviation", "whitened"])

    return _read(rows).mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def whitened_components(rows: DataFrame, top: int | None = TOP) -> DataFrame:
    """A row per vector and component: fits on ``rows`` and whitens them."""
    model = fit(rows)
    error = identity_error(rows, model, top)
    shares = F.array(*[F.lit(share) for share in model.explained(top)]).cast("array<double>")
    found = whiten(rows, model, top).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return found.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op11_whiten_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return whitened_components(table(spark, folder, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
