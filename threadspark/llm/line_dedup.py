"""Line dedup by a sharded minimal perfect hash over line hashes.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` and lower-cased in A-Z. Keys are hashed to 128 bits. The hashes
of keys that enough documents hold are cut into shards; each shard gets a minimal perfect hash (bit levels: a key
takes the first level where it is alone at its place, and its slot is the rank of that bit) that indexes an array of 64-bit
fingerprints, one of document counts and one of the last document. Documents send their line hashes, packed by shard, to
the arrays and get back the lines they lose; lines are never joined with lines. A probe for another line answers no by its
fingerprint (wrong with a chance of 2^-64).

A shard is copied to several folds and probes are dealt over the folds, so a line that a third of all documents hold is
no hot spot. Numbers of shards and of folds are not bounds on the data: shards grow with the keys.

Null text is one empty line. A row without doc_id is not a document: its lines do not count and stay. Rows with one
doc_id are one document. Empty input gives an empty result. Extra columns of the input are passed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadspark.llm.common import mixed, packed, stored, table

BLANKS = b" \t\n\v\f\r"
MIN_CHARS, MIN_DOCS = 20, 3
KEYS_PER_SHARD, LEAST_SHARDS, FOLDS = 200_000, 128, 8


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key, or None if it has too few code points."""
    key = line.strip(BLANKS).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return key


def line_hashes(text: str | None, min_chars: int) -> tuple[list[bytes], list[bytes]]:
    """Lines of a text, and a 16-byte hash of each (empty: the line has no key)."""
    lines = (text or "").encode().split(b"\n")
    keys = (line_key(line, min_chars) for line in lines)
    return lines, [b"" if key is None else xxhash.xxh3_128_digest(key) for key in keys]


def halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


class MinimalHash:
    """Slots 0..n-1 of n distinct 128-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = [np.cumsum(bits, dtype=np.int64) for bits in levels]
        self.before = np.concatenate(([0], np.cumsum([int(rank[-1]) for rank in self.ranks]))) if levels else np.zeros(1, np.int64)

    @staticmethod
    def _place(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mix = mixed(first.view(np.uint64) + mixed(second.view(np.uint64), 2 * level + 1), 2 * level)
        return (mix % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray) -> MinimalHash:
        levels: list[np.ndarray] = []
        while len(first):
            size = max(8, len(first) * 5 // 4)
            places = cls._place(first, second, len(levels), size)
            alone = np.bincount(places, minlength=size) == 1
            levels.append(alone)
            rest = ~alone[places]
            first, second = np.ascontiguousarray(first[rest]), np.ascontiguousarray(second[rest])
        return cls(levels)

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level holds it. Keys that were not built in may get any slot."""
        found, rest = np.full(len(first), -1, dtype=np.int64), np.arange(len(first))
        for level, bits in enumerate(self.levels):
            if not len(rest):
                break
            places = self._place(np.ascontiguousarray(first[rest]), np.ascontiguousarray(second[rest]), level, len(bits))
            here = bits[places]
            found[rest[here]] = self.before[level] + self.ranks[level][places[here]] - 1
            rest = rest[~here]
        return found

    def dumps(self) -> tuple[list[int], bytes]:
        return [len(bits) for bits in self.levels], b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def loads(cls, sizes, raw: bytes) -> MinimalHash:
        levels, at = [], 0
        for size in sizes:
            n = (int(size) + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, n, at), count=int(size)).astype(bool))
            at += n
        return cls(levels)


_INDEX = "shard int, sizes array<long>, bits binary, fingerprints binary, counts binary, last binary"


def build_index(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keys_per_shard: int = KEYS_PER_SHARD) -> tuple[DataFrame, int]:
    """The index table, a row per shard, and the number of shards it was cut for."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owners = [], []
            for owner, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = set(line_hashes(text, min_chars)[1]) - {b""}
                found += own
                owners += [owner] * len(own)
            first, second = halves(found)
            yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(owners, pa.int64())], ["first", "second", "doc_id"])

    held = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    lines = held.mapInArrow(hashes, "first long, second long, doc_id long")
    counted = lines.groupBy("first", "second").agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("last"))
    repeated = stored(counted.where(F.col("docs") >= min_docs), "lines")
    shards = max(LEAST_SHARDS, math.ceil(repeated.count() / keys_per_shard))

    def build(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first, second = rows["first"].to_numpy(np.int64), rows["second"].to_numpy(np.int64)
        hashed = MinimalHash.build(first, second)
        order = np.argsort(hashed.slots(first, second))
        sizes, bits = hashed.dumps()
        arrays = (packed(second[order], "<i8"), packed(rows["docs"].to_numpy()[order], "<i8"), packed(rows["last"].to_numpy()[order], "<i8"))
        return pd.DataFrame([(shard[0], sizes, bits, *arrays)], columns=["shard", "sizes", "bits", "fingerprints", "counts", "last"])

    sharded = repeated.withColumn("shard", F.pmod("first", F.lit(shards)).cast("int"))
    return stored(sharded.groupBy("shard").applyInPandas(build, _INDEX), "line-index"), shards


def probe(docs: DataFrame, index: DataFrame, shards: int, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, folds: int = FOLDS) -> DataFrame:
    """doc_id and line hash (first, second) of the lines that documents lose."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            found, owners = [], []
            for owner, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = set(line_hashes(text, min_chars)[1]) - {b""}
                found += own
                owners += [owner] * len(own)
            first, second = halves(found)
            shard = first % shards  # floor modulo, as pmod
            order = np.argsort(shard, kind="stable")
            names, cuts = np.unique(shard[order], return_index=True)
            fold = (TaskContext.get().partitionId() + number) % folds
            columns = [np.split(values[order], cuts[1:]) if len(names) else [] for values in (np.array(owners, np.int64), first, second)]
            binaries = [pa.array([packed(part, "<i8") for part in column], pa.binary()) for column in columns]
            keys = [pa.array(names.astype(np.int32)), pa.array(np.full(len(names), fold, np.int32))]
            yield pa.RecordBatch.from_arrays([*keys, *binaries], ["shard", "fold", "owners", "firsts", "seconds"])

    def look_up(probes: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        if not len(arrays) or not len(probes):
            return pd.DataFrame({"doc_id": [], "first": [], "second": []}, dtype=np.int64)
        row = arrays.iloc[0]
        hashed = MinimalHash.loads(row["sizes"], row["bits"])
        prints, counts, last = (np.frombuffer(row[name], "<i8") for name in ("fingerprints", "counts", "last"))
        owners, first, second = (np.frombuffer(b"".join(probes[name]), "<i8") for name in ("owners", "firsts", "seconds"))
        slots = hashed.slots(first, second)
        lost = (slots >= 0) & (prints[slots] == second) & (counts[slots] >= min_docs) & (last[slots] != owners)
        return pd.DataFrame({"doc_id": owners[lost], "first": first[lost], "second": second[lost]})

    held = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    probes = held.mapInArrow(pack, "shard int, fold int, owners binary, firsts binary, seconds binary")
    copies = index.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return probes.groupBy("shard", "fold").cogroup(copies.groupBy("shard", "fold")).applyInPandas(
        look_up, "doc_id long, first long, second long"
    )


def drop_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, names: tuple[str, str] = ("n_lines", "n_dropped")
) -> DataFrame:
    """``docs`` with text rid of repeated lines, plus the numbers of lines before and dropped; null text becomes one empty line.

    The numbers stand under ``names`` and replace own columns of these names.
    """
    index, shards = build_index(docs, min_docs, min_chars)
    lost = probe(docs, index, shards, min_docs, min_chars).groupBy("doc_id").agg(F.collect_set(F.struct("first", "second")).alias("lost"))
    lost = lost.select(F.col("doc_id").alias("lost_doc"), "lost.first", "lost.second")
    kept = [field for field in docs.schema.fields if field.name not in names]
    joined = docs.join(lost, docs["doc_id"] == lost["lost_doc"], "left").select(
        *(docs[f"`{field.name}`"] for field in kept), lost["first"].alias("lost_first"), lost["second"].alias("lost_second")
    )
    schema = T.StructType([*kept, *(T.StructField(name, T.LongType()) for name in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            whole = batch.column("text").to_pylist()
            for text, first, second in zip(whole, batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist(), strict=True):
                if first:
                    lines, keys = line_hashes(text, min_chars)
                    gone = {a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True) for a, b in zip(first, second, strict=True)}
                    stay = [line for line, key in zip(lines, keys, strict=True) if key not in gone]
                    texts.append(b"\n".join(stay).decode())
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                else:
                    texts.append(text or "")
                    n_lines.append((text or "").count("\n") + 1)
                    n_dropped.append(0)
            arrays = [pa.array(texts, pa.string()) if f.name == "text" else batch.column(k) for k, f in enumerate(kept)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], schema.names)

    return joined.mapInArrow(run, schema)


def op5_drop_repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    kept = drop_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
r AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, l.i, l.line, r.k IS NOT NULL AND r.last <> l.doc_id AS gone FROM l LEFT JOIN r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
