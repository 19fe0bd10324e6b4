"""Benchmark decontamination over a distributed positional inverted index.

Words are runs of digits, letters and characters beyond ASCII after lower-casing A-Z. Every shard of the index holds the
word postings of some whole documents: for each term its sorted positions in the shard, documents being apart so far that
no phrase spans two. A term that no test window has is never looked up, so its postings are not stored. A window (ten
consecutive words of an item; all words of a shorter item) is searched from its rarest term in the whole corpus on: the
offset-adjusted positions of that term are intersected with those of the next rarest one, and so on. With ``slop`` above 0
a term may stand that many words off its place relative to the rarest term, in any order: a proximity match.

Shards are bounded by words and are never shuffled. Windows are a query set that meets all shards in blocks of at most
about ``block`` windows; more windows make more passes and never a larger broadcast.

Null or wordless text has no words and no hits; repeated rows each give a row. A null item_id is the item ``null``; rows
with one item_id are texts of one item; items without words have no windows. Empty tables give no matches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadspark.llm.common import stored, table, texts_of

_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
WIDTH, SHARD_WORDS, BLOCK = 10, 2_000_000, 200_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def test_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct (item, window) of the test items; a window is its words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, windows = [], []
            for name, text in zip(batch.column("item").to_pylist(), texts_of(batch), strict=True):
                words = words_of(text)
                for k in range(max(1, len(words) - width + 1) if words else 0):
                    names.append(name)
                    windows.append(b" ".join(words[k : k + width]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(windows, pa.string())], ["item", "window"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    return named.mapInArrow(run, "item string, window string").distinct()


def build_index(docs: DataFrame, vocabulary: list[bytes], gap: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per shard: its documents (id, text digest, first position, words) and the postings of ``vocabulary``."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType
    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("digests", T.ArrayType(T.BinaryType()))])
    for name, of in (("starts", longs), ("n_words", longs), ("terms", ints), ("counts", longs), ("positions", longs)):
        schema = schema.add(name, of)

    def row(batch, first, last, digests, starts, lengths, found, places) -> pa.RecordBatch:
        found, places = np.concatenate(found), np.concatenate(places)
        order = np.argsort(found, kind="stable")
        terms, counts = np.unique(found, return_counts=True)
        ids = batch.column("doc_id").slice(first, last - first)
        lists = [pa.array([digests], pa.list_(pa.binary())), *(pa.array([np.asarray(x)], pa.list_(t)) for x, t in (
            (starts, pa.int64()), (lengths, pa.int64()), (terms, pa.int32()), (counts, pa.int64()), (places[order], pa.int64())))]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *lists], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {word: k for k, word in enumerate(sent.value)}
        for batch in batches:
            first, at, digests, starts, lengths, found, places = 0, 0, [], [], [], [], []
            for k, text in enumerate(texts_of(batch)):
                words = words_of(text)
                terms = np.fromiter((known.get(word, -1) for word in words), np.int32, len(words))
                here = np.flatnonzero(terms >= 0)
                digests.append(xxhash.xxh3_128_digest(text))
                starts.append(at)
                lengths.append(len(words))
                found.append(terms[here])
                places.append(here + at)
                at += len(words) + gap
                if at >= shard_words or k == batch.num_rows - 1:
                    yield row(batch, first, k + 1, digests, starts, lengths, found, places)
                    first, at, digests, starts, lengths, found, places = k + 1, 0, [], [], [], [], []

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def intersect(postings: dict[int, np.ndarray], order: list[tuple[int, int]], slop: int) -> np.ndarray:
    """Starts of a window in a shard; ``order``: its (term, offset), rarest first."""
    term, offset = order[0]
    starts = postings[term] - offset
    for term, offset in order[1:]:
        if not len(starts):
            break
        places, aim = postings[term], starts + offset
        low = np.searchsorted(places, aim - slop, side="left")
        starts = starts[np.searchsorted(places, aim + slop, side="right") > low]
    return starts


def search(index: DataFrame, windows: list[tuple[list[str], list[int]]], frequency: dict[int, int], slop: int) -> DataFrame:
    """Per document: doc_id, digest, n_words, and its matches as (item, start, end) of window occurrences, in words.

    ``windows``: items that have it, terms. The matches of one document are bounded by its words and the query block.
    """
    plans = []
    for items, terms in windows:
        if all(term in frequency for term in terms):
            plans.append((items, sorted(((t, k) for k, t in enumerate(terms)), key=lambda x: (frequency[x[0]], x[1]))))
    sent = index.sparkSession.sparkContext.broadcast(plans)
    kind = index.schema["doc_ids"].dataType.elementType
    match = T.StructType([T.StructField("item", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("digest", T.BinaryType()), T.StructField("n_words", T.LongType()),
        T.StructField("matches", T.ArrayType(match)),
    ])
    arrow_match = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                starts, lengths, terms, counts, places = (
                    batch.column(name)[k].values.to_numpy() for name in ("starts", "n_words", "terms", "counts", "positions")
                )
                cuts = np.cumsum(counts)[:-1]
                postings = dict(zip(terms.tolist(), np.split(places, cuts), strict=True)) if len(terms) else {}
                found: list[list[dict]] = [[] for _ in range(len(starts))]
                for items, order in plans:
                    if not all(term in postings for term, _ in order):
                        continue
                    for at in intersect(postings, order, slop).tolist():
                        doc = int(np.searchsorted(starts, max(at, 0), side="right")) - 1
                        if at < starts[doc] and doc + 1 < len(starts) and at + slop >= starts[doc + 1]:
                            doc += 1
                        begin, end = max(0, at - int(starts[doc])), min(int(lengths[doc]), at - int(starts[doc]) + len(order))
                        found[doc] += [{"item": item, "start": begin, "end": end} for item in items]
                ids, digests = batch.column("doc_ids")[k].values, batch.column("digests")[k].values
                yield pa.RecordBatch.from_arrays([ids, digests, pa.array(lengths, pa.int64()), pa.array(found, arrow_match)], schema.names)

    return index.mapInArrow(run, schema)


def find_matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = 0, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words and matches array<struct<item, start, end>> of every row of ``docs``."""
    windows = stored(test_windows(items, width), "windows")
    blocks = max(1, math.ceil(windows.count() / block))
    parts = []
    for k in range(blocks):
        one = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
        having: dict[str, list[str]] = {}
        for item, window in one.toLocalIterator():
            having.setdefault(window, []).append(item)
        vocabulary = sorted({word.encode() for window in having for word in window.split(" ")})
        number = {word: n for n, word in enumerate(vocabulary)}
        coded = [(sorted(found), [number[w.encode()] for w in window.split(" ")]) for window, found in sorted(having.items())]
        index = stored(build_index(docs, vocabulary, width + 2 * slop + 1), "postings")
        lists = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("one"))
        frequency = {term: n for term, n in lists.groupBy("one.terms").agg(F.sum("one.counts")).toLocalIterator()}
        parts.append(search(index, coded, frequency, slop))
    if blocks == 1:
        return parts[0].drop("digest")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return (
        whole.groupBy("doc_id", "digest", "n_words")
        .agg(F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"), (F.count(F.lit(1)) / blocks).cast("int").alias("rows"))
        .select("doc_id", "n_words", "matches", F.explode(F.sequence(F.lit(1), "rows"))).drop("col")
    )


def with_hits(found: DataFrame) -> DataFrame:
    """Adds n_hit (words inside any match) and items (distinct, sorted as strings)."""
    spans = F.array_sort(F.array_distinct(F.transform("matches", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    covered = F.aggregate(
        spans, zero,
        lambda done, span: F.struct(
            (done["n"] + F.greatest(F.lit(0), span["end"] - F.greatest(span["start"], done["upto"]))).alias("n"),
            F.greatest(done["upto"], span["end"]).alias("upto"),
        ),
    )
    return found.select(
        "doc_id", "n_words", covered["n"].alias("n_hit"), F.array_sort(F.array_distinct(F.col("matches.item"))).alias("items")
    )


def op4_benchmark_hits(spark: SparkSession, folder: str) -> DataFrame:
    hits = with_hits(find_matches(table(spark, folder, "documents"), table(spark, folder, "benchmark")))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS g, least(10, len(w)) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
occ AS (SELECT g.doc_id, g.i, g.n, win.item FROM g JOIN win ON g.g = win.g AND g.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id"""
