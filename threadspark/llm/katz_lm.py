"""Katz backoff scoring: Good-Turing discounted bigrams over unigrams, with exactly normalised backoff weights.

Tokens are the white-space runs of a text, lower-cased in A-Z, then one end. The first one follows a start mark. With
training counts c, c* is Good-Turing's discounted count up to ``TOP`` (half a count less above it, or where the formula
leaves (0, 1)), and N is the number of training tokens:

    p(w)     = c*(w) / N; all unknown words together have the mass that is left
    p(w | h) = c*(h, w) / c(h) if the pair was seen, else a(h) p(w)
    a(h)     = (1 - sum of p(w | h) over seen w) / (1 - sum of p(w) over seen w); 1 for an unseen context

so the probabilities after every context add up to 1. The score of a text is the sum of its tokens' log10 probabilities.

How the work is spread. A batch of documents becomes its distinct (word, context) pairs, packed by word shard, and one row
that stays its own: the documents of each occurrence. A word shard counts pairs and words over all batches and answers each
batch with c(h, w) and c(w) of the batch's own pairs, so no shard holds or sends anything for a document. Discounts depend on
the counts of counts of the whole corpus, so contexts get sums per count class of their seen words, packed by context
shard. Unseen pairs are sent to their context's shard, too, where a(h) is made once and answered to the batches. Each batch
then adds up its own documents. One table of these facts is stored; neither c(h, w) nor a(h) is kept for later texts.
Shards follow the bytes of the input; a pair or context that is frequent comes once per batch. Nothing but counts of counts
reaches the driver.

Null text is empty and has the end token only. Words are known by 64-bit hashes. A null doc_id has the fold of ''. Repeated
rows each count and each give a row. Without training rows every token is unknown and has probability 1. Empty input gives
an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadspark.llm.common import packed, salt_of, stored, table, texts_of

TOP, SHARD_BYTES, LEAST_SHARDS, PIECES, BATCH_BYTES, GROUP_BYTES = 5, 16_000_000, 24, 8, 8_000_000, 4_000_000
END, START = xxhash.xxh3_64_intdigest(b""), xxhash.xxh3_64_intdigest(b" ")  # no token is empty or blank


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards in order of the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def starts_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """Places where a run of equal keys begins."""
    if not len(sorted_keys[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(len(sorted_keys[0]), dtype=bool)
    new[0] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows with about ``BATCH_BYTES`` of text, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    part = sizes // BATCH_BYTES
    cuts = [*np.flatnonzero(np.diff(part, prepend=-1)), len(part)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


def narrowed(values: np.ndarray) -> bytes:
    """Counts in the narrowest width that holds them all, which the first byte names."""
    most = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + packed(values, f"<u{width}")


def widened(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


_PAIRS = "shard long, batch long, first long, words binary, spans binary, contexts binary, trained binary, uses binary, places binary, ids binary"


def packed_pairs(docs: DataFrame, shards: int) -> DataFrame:
    """Distinct pairs of each batch by word shard, and under a shard of its own (-1 - batch) the documents of their occurrences.

    ``docs``: doc_id, text, train. A batch has about ``BATCH_BYTES`` of text. ``first`` numbers a row's pairs within the batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(part for whole in batches for part in _cut(whole)):
            ids = batch.column("doc_id")
            name = (TaskContext.get().partitionId() << 32) + number
            parts, lengths = [], []
            for text in texts_of(batch):
                words = text.lower().split()
                parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
                lengths.append(len(words) + 1)
            total = sum(lengths)
            ends = np.cumsum(lengths)
            word = np.empty(total, dtype=np.uint64)
            inner = np.ones(total, dtype=bool)
            inner[ends - 1] = False
            word[inner] = np.concatenate(parts)
            word[~inner] = END
            context = np.empty(total, dtype=np.uint64)
            context[1:] = word[:-1]
            context[np.concatenate(([0], ends[:-1]))] = START
            order = np.lexsort((context, word))
            word, context, place = word[order], context[order], np.repeat(np.arange(len(lengths)), lengths)[order]
            pair = starts_of(word, context)
            uses = np.diff(np.append(pair, total))
            word, context = word[pair], context[pair]
            flags = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            trained = np.add.reduceat(flags[place].astype(np.int64), pair) if total else np.zeros(0, np.int64)
            runs = starts_of(word)
            spans = np.diff(np.append(runs, len(word)))
            sizes = packed(np.array([ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(False), lengths]), "<i8")
            rows = [(-1 - name, name, 0, packed(word[runs] == np.uint64(END), "u1"), narrowed(spans), None, None, narrowed(uses), narrowed(place), sizes)]
            edges = np.searchsorted(shard_of(word, shards), np.arange(shards + 1))
            inside = np.searchsorted(runs, edges)
            for k in range(shards):
                a, b = edges[k], edges[k + 1]
                if a < b:
                    here = slice(inside[k], inside[k + 1])
                    rows.append((k, name, int(a), packed(word[runs[here]], "<u8"), narrowed(spans[here]), packed(context[a:b], "<u8"), narrowed(trained[a:b]), None, None, None))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 3 + [pa.binary()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in _PAIRS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text", "train").mapInArrow(run, _PAIRS)


# home: places of a batch's own documents; counts: c(w) and c(h, w) of its pairs in one shard; ask and weight: its unseen pairs
_FACTS = "kind string, target long, batch long, keys binary, numbers binary, sums binary, ids binary"
_COLUMNS = [x.split()[0] for x in _FACTS.split(", ")]


def _classes(counts: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How often each owner has each count from 1 to TOP."""
    low = (counts >= 1) & (counts <= TOP)
    return np.bincount(owner[low] * TOP + counts[low] - 1, minlength=n * TOP).reshape(n, TOP)


def _histogram(counts: np.ndarray) -> list[int]:
    """Types seen 1..TOP+1 times, all seen types, their tokens, types above TOP, their tokens."""
    seen = counts[counts > 0]
    return [*np.bincount(np.minimum(seen, TOP + 2), minlength=TOP + 3)[1 : TOP + 2].tolist(), len(seen), int(seen.sum()), int((seen > TOP).sum()), int(seen[seen > TOP].sum())]


def _by_width(keys: np.ndarray, facts: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
    """Contexts with the narrowest numbers that hold their facts; nearly all fit in one byte each."""
    most = facts.max(axis=1) if len(facts) else np.zeros(0, np.uint64)
    for low, high, kind in ((0, 2**8, "<u1"), (2**8, 2**32, "<u4"), (2**32, 2**64 - 1, "<u8")):
        some = (most >= low) & (most < high) if low else most < high
        if some.any():
            yield packed(keys[some], "<u8"), packed(facts[some].T, kind)


class _Shard:
    """What one word shard sums up; its words are taken in ``PIECES`` ranges of the hash, so little is unpacked at a time."""

    def __init__(self, rows: pd.DataFrame):
        read = lambda name: [np.frombuffer(raw, "<u8") for raw in rows[name]]
        self.words, self.contexts = read("words"), read("contexts")
        self.spans, self.trained = ([widened(raw) for raw in rows[name]] for name in ("spans", "trained"))
        self.first = rows["first"].to_numpy()
        self.of_words, self.of_pairs = [np.zeros(len(x), np.int64) for x in self.words], [np.zeros(len(x), np.int64) for x in self.contexts]
        self.numbers = np.zeros((2, TOP + 6), np.int64)
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []

    def take(self, low: int, high: int | None) -> None:
        """Count the pairs in a range of word hashes over all batches and write the sums to each batch's own pairs."""
        parts: list[list[np.ndarray]] = [[], [], []]
        where = []
        for words, spans, contexts, trained in zip(self.words, self.spans, self.contexts, self.trained, strict=True):
            a, b = np.searchsorted(words, np.uint64(low)), len(words) if high is None else np.searchsorted(words, np.uint64(high))
            skip = int(spans[:a].sum())
            pairs = slice(skip, skip + int(spans[a:b].sum()))
            where.append((slice(a, b), pairs))
            for part, values in zip(parts, (np.repeat(words[a:b], spans[a:b]), contexts[pairs], trained[pairs]), strict=True):
                part.append(values)
        word, context, trained = (np.concatenate(part) for part in parts)
        if not len(word):
            return
        order = np.lexsort((context, word))
        word_runs, pair_runs = starts_of(word[order]), starts_of(word[order], context[order])
        pair_no = np.repeat(np.arange(len(pair_runs)), np.diff(np.append(pair_runs, len(order))))
        word_no = np.repeat(np.arange(len(word_runs)), np.diff(np.append(word_runs, len(order))))
        pair_sum, word_sum = np.add.reduceat(trained[order], pair_runs), np.add.reduceat(trained[order], word_runs)
        of_pair, of_word = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        of_pair[order], of_word[order] = pair_sum[pair_no], word_sum[word_no]
        ends = word_sum[word[order][word_runs] == np.uint64(END)].sum()
        self.numbers += np.array([[*_histogram(pair_sum), 0], [*_histogram(word_sum), int(ends)]])
        # contexts of the seen pairs: tokens, pairs by class, twice the discounted larger counts; the same of their words
        seen = pair_sum > 0
        keys, owner = np.unique(context[order[pair_runs]][seen], return_inverse=True)
        c, u, n = pair_sum[seen], word_sum[word_no[pair_runs]][seen], len(keys)
        whole = lambda values: np.bincount(owner, weights=values, minlength=n).astype(np.int64)
        if n:
            facts = (whole(c), _classes(c, owner, n), whole(np.where(c > TOP, 2 * c - 1, 0)), _classes(u, owner, n), whole(np.where(u > TOP, 2 * u - 1, 0)))
            self.seen.append((keys, np.column_stack(facts).astype(np.uint32 if max(int(x.max()) for x in facts) < 2**32 else np.uint64)))
        at = 0
        for k, (words, pairs) in enumerate(where):
            size = pairs.stop - pairs.start
            self.of_pairs[k][pairs] = of_pair[at : at + size]
            self.of_words[k][words] = of_word[at : at + size][np.cumsum(self.spans[k][words]) - self.spans[k][words]]
            at += size

    def asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts of the unseen pairs in order, with the row of the batch and the pair's number within the batch."""
        parts = [(contexts[new], np.full(len(new), k), first + new) for k, (contexts, counts, first) in enumerate(zip(self.contexts, self.of_pairs, self.first, strict=True)) if len(new := np.flatnonzero(counts == 0))]
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        contexts, rows, pairs = (np.concatenate(part) for part in zip(*parts, strict=True))
        order = np.argsort(contexts, kind="stable")
        return contexts[order], rows[order], pairs[order]

    def context_facts(self) -> tuple[np.ndarray, np.ndarray]:
        """Contexts and their numbers over all pieces."""
        if not self.seen:
            return np.zeros(0, np.uint64), np.zeros((0, 2 * TOP + 3), np.uint64)
        names = np.concatenate([keys for keys, _ in self.seen])
        order = np.argsort(names, kind="stable")
        runs = starts_of(names[order])
        numbers = np.concatenate([facts for _, facts in self.seen])[order]
        return names[order][runs], np.add.reduceat(numbers, runs, axis=0, dtype=np.uint64)


def count_shards(pairs: DataFrame, shards: int) -> DataFrame:
    """Facts of every word shard: counts of each batch's pairs, contexts' sums, unseen pairs, counts of counts; home rows as they are."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, number = [], int(rows["shard"].iloc[0])
        if number < 0:
            out = [("home", 0, row.batch, row.spans, row.uses, row.places, row.words + row.ids) for row in rows.itertuples()]
            return pd.DataFrame(out, columns=_COLUMNS)
        rows = rows.sort_values("batch", ignore_index=True)
        names = rows["batch"].to_numpy()
        shard = _Shard(rows)
        low, high = (-(-(k << 32) // shards) << 32 for k in (number, number + 1))
        edges = [low + (high - low) * k // PIECES for k in range(PIECES)]
        for a, b in zip(edges, [*edges[1:], None], strict=True):
            shard.take(a, b)
        out.append(("hist", 0, number, None, packed(shard.numbers, "<i8"), None, None))
        keys, facts = shard.context_facts()
        cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            out += [("context", k, number, *row, None, None) for row in _by_width(keys[a:b], facts[a:b])]
        del keys, facts
        shard.seen.clear()
        out += [("counts", number, int(name), narrowed(of_words), narrowed(of_pairs), None, None) for name, of_words, of_pairs in zip(names, shard.of_words, shard.of_pairs, strict=True)]
        asked, batch, pair = shard.asked()
        cuts = np.searchsorted(shard_of(asked, shards), np.arange(shards + 1))
        out += [
            ("ask", k, number, packed(asked[a:b], "<u8"), packed(names[batch[a:b]], "<i8"), narrowed(pair[a:b]), None)
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b
        ]
        return pd.DataFrame(out, columns=_COLUMNS)

    return pairs.groupBy("shard").applyInPandas(run, _FACTS)


def discounted(counts_of_counts: list[int]) -> np.ndarray:
    """Discounted counts of 1..TOP from the numbers of types seen 1..TOP+1 times."""
    n = [0, *counts_of_counts]
    out = []
    large = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    for r in range(1, TOP + 1):
        turing = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        share = (turing - large) / (1.0 - large) if large != 1.0 else 0.0
        out.append(r * share if 0.0 < share < 1.0 else r - 0.5)
    return np.array(out)


class Discounts:
    """What the counts of counts of the corpus decide."""

    def __init__(self, pairs: list[int], words: list[int]):
        self.pairs, self.words = discounted(pairs[: TOP + 1]), discounted(words[: TOP + 1])
        self.types, self.tokens, self.texts = words[TOP + 1], words[TOP + 2], words[TOP + 5]
        kept = float(np.dot(self.words, words[:TOP])) + words[TOP + 4] - 0.5 * words[TOP + 3]
        self.unknown = 1.0 - kept / self.tokens if self.tokens else 1.0


def backoff(facts: DataFrame, discounts: Discounts) -> DataFrame:
    """Per batch, log(c(h) a(h)) of its unseen pairs, made in the context shards."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asks, known = rows[rows["kind"] == "ask"], rows[rows["kind"] == "context"]
        if not len(asks):
            return pd.DataFrame([], columns=_COLUMNS)
        asked = np.concatenate([np.frombuffer(raw, "<u8") for raw in asks["keys"]])
        batch = np.concatenate([np.frombuffer(raw, "<i8") for raw in asks["numbers"]])
        pair = np.concatenate([widened(raw) for raw in asks["sums"]])
        keys, of = np.unique(asked, return_inverse=True)
        total = np.zeros((len(keys), 2 * TOP + 3))
        for raw, numbers in zip(known["keys"], known["numbers"], strict=True):
            mine = np.frombuffer(raw, "<u8")
            values = np.frombuffer(numbers, f"<u{len(numbers) // (2 * TOP + 3) // len(mine)}").reshape(2 * TOP + 3, -1)
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            hit = keys[at] == mine
            total[at[hit]] += values[:, hit].T
        tokens = total[:, 0]
        kept = total[:, 1 : TOP + 1] @ discounts.pairs + total[:, TOP + 1] / 2
        below = (total[:, TOP + 2 : 2 * TOP + 2] @ discounts.words + total[:, 2 * TOP + 2] / 2) / max(1, discounts.tokens)
        weight = np.where(tokens > 0, np.log(np.maximum(tokens - kept, 1e-300)) - np.log(np.maximum(1.0 - below, 1e-300)), 0.0)[of]
        order = np.argsort(batch, kind="stable")
        edges = np.append(starts_of(batch[order]), len(order))
        some = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        out = [("weight", 0, int(batch[rows[0]]), narrowed(pair[rows]), None, packed(weight[rows], "<f8"), None) for rows in some]
        return pd.DataFrame(out, columns=_COLUMNS)

    return facts.where(F.col("kind").isin("ask", "context")).groupBy("target").applyInPandas(run, _FACTS)


def _finish(facts: DataFrame, discounts: Discounts) -> DataFrame:
    """Each batch adds up the logarithms of its own occurrences per document."""
    columns = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def log_of(counts: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Logarithms of discounted counts; those of no count are not read."""
        return np.where(counts > TOP, np.log(np.maximum(counts - 0.5, 0.5)), np.log(low)[np.clip(counts - 1, 0, TOP - 1)])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        home = rows[rows["kind"] == "home"].iloc[0]
        spans, uses, places = (widened(home[name]) for name in ("keys", "numbers", "sums"))
        ends = np.frombuffer(home["ids"], "u1", count=len(spans)).astype(bool)
        ids, valid, tokens = np.frombuffer(home["ids"][len(spans) :], "<i8").reshape(3, -1)
        counts = rows[rows["kind"] == "counts"].sort_values("target")  # shards are in order of the hash, as the pairs at home are
        c1, c2 = (np.concatenate([widened(raw) for raw in counts[name]]) for name in ("keys", "numbers"))
        known, unseen = np.repeat(c1 > 0, spans), c2 == 0
        single = np.where(c1 > 0, log_of(c1, discounts.words) - math.log(max(1, discounts.tokens)), math.log(discounts.unknown))
        value = np.where(unseen, np.repeat(single, spans), log_of(c2, discounts.pairs))
        weights = rows[rows["kind"] == "weight"]
        for pair, weight in zip(weights["keys"], weights["sums"], strict=True):
            value[widened(pair)] += np.frombuffer(weight, "<f8")
        # each token but the end is the context of the next one, whose probability has its count below
        value -= np.repeat(np.where((c1 > 0) & ~ends, np.log(np.maximum(c1, 1)), 0.0), spans)
        base = np.repeat(np.log(c1 + 0.5), spans)
        sums = lambda values: np.bincount(places, weights=np.repeat(values, uses), minlength=len(ids))
        total = sums(value) - math.log(max(1, discounts.texts))
        based = sums(base) - tokens * math.log(discounts.tokens + 0.5 * (discounts.types + 1))
        values = (pd.array(ids, "Int64"), tokens, sums(known).astype(np.int64), discounts.tokens, based / math.log(10), total / math.log(10))
        found = pd.DataFrame(dict(zip(columns, values, strict=True)))
        found.loc[valid == 0, "doc_id"] = pd.NA
        return found

    return facts.groupBy("batch").applyInPandas(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, in_training, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row; ``in_training``: a column of flags."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, math.ceil(size / shard_bytes))
    numbered = docs.select("doc_id", "text", in_training.alias("train"))
    named = stored(count_shards(packed_pairs(numbered, shards), shards), "ngram-facts", GROUP_BYTES)
    sums = np.zeros((2, TOP + 6), dtype=np.int64)
    for row in named.where(F.col("kind") == "hist").select("numbers").toLocalIterator():
        sums += np.frombuffer(row["numbers"], "<i8").reshape(sums.shape)
    discounts = Discounts(*sums.tolist())
    facts = named.where(F.col("kind").isin("home", "counts")).unionByName(backoff(named, discounts))
    return _finish(facts, discounts)


def op9_katz_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = score_documents(docs, salt_of("doc_id", 5, 1, inside=False))
    return scored.withColumn("held_out", salt_of("doc_id", 5, 1, inside=True))
