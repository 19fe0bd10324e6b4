"""Phrase mining against a plain count, and its summaries against their guarantee."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from threadspark.llm import collocations

SCHEMA = "doc_id long, text string, lang string, source string, phrase string, f long, words int, n long"


def make(spark, rows):
    return spark.createDataFrame([(k, text, lang, "s", "x", 1, 2, 3) for k, (text, lang) in enumerate(rows)], SCHEMA)


def plain(rows, threshold=10, longest=3, share=50):
    """All phrases that stay, straight from the definition."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    found = {}
    for (lang, *words), a in f.items():
        if len(words) > 1 and a >= threshold:
            cuts = []
            for k in range(1, len(words)):
                left, right = f[(lang, *words[:k])], f[(lang, *words[k:])]
                cuts.append((1_000_000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            found[lang, tuple(words)] = (a, left, right, n[lang], score)

    def inside(short, long):
        return len(short) < len(long) and any(long[i : i + len(short)] == short for i in range(len(long)))

    kept = {}
    for (lang, words), values in found.items():
        if not any(one == lang and inside(words, longer) and 100 * other[0] >= share * values[0] for (one, longer), other in found.items()):
            kept[lang, " ".join(words)] = values
    return kept


def rows_of(frame):
    return {(row["lang"], row["phrase"]): (row["a"], row["l"], row["r"], row["n"], row["score"]) for row in frame.collect()}


def sample(seed, docs, words):
    pick = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "city", "été", "日本", "a", "b", "c"] + [f"w{k}" for k in range(60)]
    weights = [12, 4, 9, 5, 5, 3, 2, 2, 3, 3, 3] + [0.4] * 60
    rows = []
    for _ in range(docs):
        text = ""
        for word in pick.choices(vocabulary, weights, k=pick.randint(0, words)):
            text += word + pick.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\r", "\x0c", ": "])
            if word == "new":
                text += "york city "
        rows.append((text, pick.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), (" \n\t.,", "fr"), ("one two", "es"), ("the of " * 30, None)]


def test_phrases_equal_a_plain_count(spark):
    rows = sample(1, 300, 60)
    found = rows_of(collocations.collocations(make(spark, rows).repartition(5)))
    assert found == plain(rows) and len(found) > 40


def test_longer_phrases_and_other_thresholds(spark):
    rows = sample(2, 150, 50)
    assert rows_of(collocations.collocations(make(spark, rows), threshold=4, longest=5, share=80)) == plain(rows, 4, 5, 80)
    assert rows_of(collocations.collocations(make(spark, rows), threshold=3, longest=2)) == plain(rows, 3, 2)


def test_partitions_beyond_the_fanout_and_split_pieces(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_PIECE_BYTES", 40)
    rows = sample(3, 120, 80) + [("new york city the of a b c " * 200, "en")]
    found = collocations.collocations(make(spark, rows).repartition(3), fanout=3, part_bytes=1_500)
    assert rows_of(found) == plain(rows)


def test_ranks_and_empty_input(spark):
    rows = sample(4, 100, 40)
    phrases = plain(rows)
    found = collocations.best(collocations.collocations(make(spark, rows)), 7).collect()
    for lang in {lang for lang, _ in phrases}:
        order = sorted((-v[4], -v[0], phrase.encode()) for (one, phrase), v in phrases.items() if one == lang)[:7]
        own = sorted((row["rank"], row["phrase"].encode()) for row in found if row["lang"] == lang)
        assert own == [(k, phrase) for k, (_, _, phrase) in enumerate(order, 1)]
    assert collocations.best(collocations.collocations(make(spark, []).limit(0))).count() == 0


def test_chunks_neither_lose_nor_repeat_ngrams(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 7)
    monkeypatch.setattr(collocations, "_PIECE_BYTES", 10)
    import pyarrow as pa

    rows = [(text or "", lang or "und") for text, lang in sample(5, 30, 40)]
    batch = pa.RecordBatch.from_pydict({"text": [t for t, _ in rows], "lang": [g for _, g in rows]})
    found = Counter()
    for chunk, final in collocations.chunks(iter([batch]), 3):
        names, lang = list(chunk.names), chunk.langs()
        _, orders, at = chunk.keys(final)
        found.update((names[lang[i]], *chunk.words[i : i + m]) for i, m in zip(at.tolist(), orders.tolist(), strict=True))
    expected = Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = [w.lower() for w in piece.encode().split()]
            for m in (1, 2, 3):
                expected.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    assert found == expected


def test_ngrams_that_share_a_hash_are_told_apart():
    chunk = collocations.Chunk(2)
    chunk.add([b"a", b"b", b"a", b"b", b"c"], chunk.lang("en"), 1)
    keys, orders, at = chunk.keys(True)
    first, sizes, counts = chunk.counted(np.zeros(len(keys), np.uint64), orders, at)
    found = {(*chunk.words[i : i + m],): n for i, m, n in zip(first.tolist(), sizes.tolist(), counts.tolist(), strict=True)}
    assert found == {(b"a",): 2, (b"b",): 2, (b"c",): 1, (b"a", b"b"): 2, (b"b", b"a"): 1, (b"b", b"c"): 1}


@pytest.mark.parametrize("seed", range(6))
def test_summaries_keep_all_that_is_frequent(seed):
    pick = np.random.default_rng(seed)
    keys = (pick.zipf(1.2, 40_000) % 20_000).astype(np.uint64)
    summary = collocations.MisraGries(len(keys), 10, slack=1 + seed % 3)
    for part in np.array_split(keys, 37):
        own, counts = np.unique(part, return_counts=True)
        summary.add(own, counts)
        summary.merge()
        assert len(summary.keys) <= summary.capacity
    own, counts = np.unique(keys, return_counts=True)
    frequent, kept = set(own[counts >= 10].tolist()), set(summary.survivors().tolist())
    assert frequent <= kept and summary.taken * (summary.capacity + 1) <= len(keys) and len(kept) < len(own)
