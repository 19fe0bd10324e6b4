"""Language identification by segmentation-marginalised unigrams.

The pieces are the tokens of a fixed public vocabulary of up to eight bytes; every byte is one, so every word has a
segmentation. Each language has a probability for each piece. The likelihood of a word (white-space run, A-Z lower-cased,
with a leading space) is the sum over all its segmentations of the product of its pieces' probabilities, by a forward pass;
a text's is the product over its words. Probabilities start from counts of piece occurrences and are refined by
expectation-maximisation: forward and backward sums give the expected uses of each piece.

Learning takes labelled rows from the training side: all of them, or if they are more than ``sample``, of each
language all rows up to its even share of ``sample``, or else about that many by hash of the id, as a documented bound of
the classifier. A language without a word in these rows is not in the model. Sums of a round are at most pieces times languages. Prediction covers
every row and whole texts.

A text that is null or has no letter is ``und`` with score 0; so is every text if no labelled row exists. The score is the
posterior of the predicted language under equal priors. Ties go to the first language in order of name. Repeated rows give
repeated results; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadspark.llm.byte_bpe import VOCABULARY, read_ranks
from threadspark.llm.common import give_back, packed, salt_of, stored, table

LONGEST, SAMPLE, ROUNDS, SMOOTHING, PARTS = 8, 20_000, 2, 0.1, 16
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_CHUNK, _MEMO, _BLOCK, _RATE, _ROWS = 4_096, 150_000, 1_024, 1_000_000_000, 500
_SUMS = "lang string, block long, uses binary"


class Pieces:
    """Numbers of the vocabulary's pieces of at most eight bytes, looked up by sorted keys per length."""

    def __init__(self, ranks: dict[bytes, int]):
        short = sorted(token for token in ranks if 0 < len(token) <= LONGEST)
        missing = [bytes([b]) for b in range(256) if bytes([b]) not in ranks]
        self.names = short + missing
        self.size = len(self.names)
        self.keys, self.numbers = [], []
        for n in range(1, LONGEST + 1):
            some = sorted((int.from_bytes(token, "little"), k) for k, token in enumerate(self.names) if len(token) == n)
            self.keys.append(np.array([key for key, _ in some], dtype=np.uint64))
            self.numbers.append(np.array([k for _, k in some], dtype=np.int64))

    def inside(self, words: np.ndarray) -> list[np.ndarray]:
        """For words of one length (n x m bytes): per piece length, piece numbers at each place (``size``: none)."""
        found, key = [], None
        for n in range(1, min(LONGEST, words.shape[1]) + 1):
            step = words[:, n - 1 :].astype(np.uint64) << np.uint64(8 * (n - 1))
            key = step if key is None else key[:, :-1] | step
            keys, numbers = self.keys[n - 1], self.numbers[n - 1]
            if not len(keys):
                found.append(np.full(key.shape, self.size))
                continue
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            found.append(np.where(keys[at] == key, numbers[at], self.size))
        return found


def grouped(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the list and byte matrix of words of one length, at most a bounded number at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        size = int(lengths[part[0]]) if len(part) else 0
        step = max(1, min(_CHUNK, _CHUNK * 32 // max(1, size)))
        for k in range(0, len(part), step):
            some = part[k : k + step]
            yield some, np.frombuffer(b"".join(words[i] for i in some), np.uint8).reshape(len(some), size)


def forward(found: list[np.ndarray], chance: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Log likelihoods (n x languages), the scaled forward sums, and the log scale of each place per word."""
    n, m = found[0].shape
    sums = [np.ones((n, chance.shape[1]))]
    scales = np.zeros((m + 1, n))
    for j in range(1, m + 1):
        total = np.zeros_like(sums[0])
        for size in range(1, min(j, len(found)) + 1):
            total += sums[j - size] * chance[found[size - 1][:, j - size]]
        sums.append(total)
        scales[j] = scales[j - 1]
        if j % 16 == 0:
            top = total.max(axis=1)
            top[top <= 0] = 1.0
            for back in range(max(0, j - LONGEST), j + 1):
                sums[back] = sums[back] / top[:, None]
            scales[j] += np.log(top)
    return np.log(np.maximum(sums[-1], 1e-300)) + scales[-1][:, None], sums, scales


def expected(found: list[np.ndarray], chance: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Expected uses of each piece in weighted words of any length under one language (chance: pieces + 1).

    Forward and backward sums are rescaled every ``LONGEST`` places; each place keeps the log scale of its sums.
    """
    n, m = found[0].shape

    def rescale(sums: np.ndarray, scales: np.ndarray, window: slice, j: int) -> None:
        top = np.where(sums[j] > 0, sums[j], 1.0)
        sums[window] /= top
        scales[window] += np.log(top)

    ahead, ahead_log = np.zeros((m + 1, n)), np.zeros((m + 1, n))
    ahead[0] = 1.0
    for j in range(1, m + 1):
        for k in range(1, min(j, len(found)) + 1):
            ahead[j] += ahead[j - k] * chance[found[k - 1][:, j - k]]
        ahead_log[j] = ahead_log[j - 1]
        if j % LONGEST == 0:
            rescale(ahead, ahead_log, slice(j - LONGEST, j + 1), j)
    behind, behind_log = np.zeros((m + 1, n)), np.zeros((m + 1, n))
    behind[m] = 1.0
    uses = np.zeros(size + 1)
    whole = weight / np.where(ahead[m] > 0, ahead[m], 1.0)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []  # few words use few pieces at a place, so many places are counted at once
    for j in range(m - 1, -1, -1):
        share = whole * ahead[j] * np.exp(ahead_log[j] + behind_log[j + 1] - ahead_log[m])
        for k in range(1, min(m - j, len(found)) + 1):
            ids = found[k - 1][:, j]
            part = chance[ids] * behind[j + k]
            waiting.append((ids, share * part))
            behind[j] += part
        behind_log[j] = behind_log[j + 1]
        if (m - j) % LONGEST == 0:
            rescale(behind, behind_log, slice(j, j + LONGEST + 1), j)
        if len(waiting) * n > _CHUNK * LONGEST or j == 0:
            ids, values = (np.concatenate(part) for part in zip(*waiting, strict=True))
            uses += np.bincount(ids, weights=values, minlength=size + 1)
            waiting.clear()
    uses[size] = 0.0
    return uses


class Model(NamedTuple):
    pieces: Pieces
    languages: list[str]
    chance: np.ndarray  # (pieces + 1) x languages; the last row is zero


def words_of(text: str) -> list[bytes]:
    return [b" " + word for word in text.encode().lower().split()]


def _chances(pieces: Pieces, languages: list[str], sums: DataFrame) -> np.ndarray:
    counts = np.zeros((pieces.size + 1, len(languages)))
    place = {name: k for k, name in enumerate(languages)}

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(raw, "<f8") for raw in rows["uses"]], axis=0)
        return pd.DataFrame([(*key, packed(total, "<f8"))], columns=["lang", "block", "uses"])

    for lang, block, raw in sums.groupBy("lang", "block").applyInPandas(add, _SUMS).toLocalIterator():
        values = np.frombuffer(raw, "<f8")
        counts[block * _BLOCK : block * _BLOCK + len(values), place[lang]] += values
    counts[:-1] += SMOOTHING
    counts[-1] = 0.0
    return counts / counts.sum(axis=0)


def fit(rows: DataFrame, ranks: dict[bytes, int], sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Learn from columns doc_id, text and lang; rows with null lang or text are left out."""
    pieces = Pieces(ranks)
    context = rows.sparkSession.sparkContext
    labelled = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    per_language = labelled.groupBy("lang").count().toLocalIterator()
    size = {lang: n for lang, n in per_language}
    if sum(size.values()) > sample:
        kept = [(lang, int(_RATE * min(1.0, sample / len(size) / n))) for lang, n in size.items()]
        rate = F.create_map(*(F.lit(x) for pair in kept for x in pair))
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(_RATE)) < rate[F.col("lang")])

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, bytes], int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word in words_of(text):
                    counts[lang, word] = counts.get((lang, word), 0) + 1
            langs, words = ([key[k] for key in counts] for k in (0, 1))
            arrays = [pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "word", "n"])
        give_back()

    counted = labelled.select("lang", "text").mapInArrow(count_words, "lang string, word binary, n long")
    # The sample bounds this table, so it is read in a few parts, each of which gives one vector per language.
    words = stored(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words").coalesce(PARTS)
    languages = sorted(row["lang"] for row in words.select("lang").distinct().toLocalIterator())
    sent_pieces = context.broadcast(pieces)

    def uses(chance) -> DataFrame:
        place = {name: k for k, name in enumerate(languages)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, known, sums = sent_pieces.value, None if chance is None else chance.value, {}
            for batch in batches:
                langs = np.array(batch.column("lang").to_pylist(), dtype=object)
                texts, weights = batch.column("word").to_pylist(), batch.column("n").to_numpy().astype(float)
                for lang in dict.fromkeys(langs.tolist()):
                    mine = np.flatnonzero(langs == lang)
                    total = sums.setdefault(lang, np.zeros(pieces.size + 1))
                    for places, matrix in grouped([texts[k] for k in mine]):
                        found, weight = pieces.inside(matrix), weights[mine[places]]
                        if known is not None:
                            total += expected(found, known[:, place[lang]], weight, pieces.size)
                        else:
                            for ids in found:
                                total += np.bincount(ids.ravel(), weights=np.repeat(weight, ids.shape[1]), minlength=pieces.size + 1)
            for lang, total in sums.items():
                blocks = [packed(total[k : k + _BLOCK], "<f8") for k in range(0, pieces.size, _BLOCK)]
                arrays = [pa.array([lang] * len(blocks), pa.string()), pa.array(range(len(blocks)), pa.int64()), pa.array(blocks, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "block", "uses"])
            give_back()

        return words.mapInArrow(run, _SUMS)

    chance = _chances(pieces, languages, uses(None)) if languages else np.zeros((pieces.size + 1, 0))
    for _ in range(rounds if languages else 0):
        chance = _chances(pieces, languages, uses(context.broadcast(chance)))
    return Model(pieces, languages, chance)


class Scorer:
    """Log likelihoods of texts; word likelihoods are memoised up to a bound, which changes no result."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[bytes, int] = {}
        self.known = np.zeros((0, len(model.languages)))

    def _learn(self, texts: list[list[bytes]]) -> None:
        wanted = set().union(*texts)
        if len(self.rows) + len(wanted) > _MEMO:
            self.rows, self.known = {}, np.zeros((0, len(self.model.languages)))
        new = [word for word in wanted if word not in self.rows]
        values = np.zeros((len(new), len(self.model.languages)))
        for places, matrix in grouped(new):
            values[places] = forward(self.model.pieces.inside(matrix), self.model.chance)[0]
        self.rows |= {word: len(self.known) + k for k, word in enumerate(new)}
        self.known = np.concatenate([self.known, values])

    def score(self, texts: list[str]) -> np.ndarray:
        split = [words_of(text) for text in texts]
        self._learn(split)
        look = self.rows.__getitem__
        return np.array([self.known[np.fromiter(map(look, words), np.int64, len(words))].sum(axis=0) for words in split])


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and score under ``names``; own columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [field for field in docs.schema.fields if field.name not in names]
    schema = T.StructType([*kept, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        languages = scorer.model.languages
        for batch in (whole.slice(k, _ROWS) for whole in batches for k in range(0, whole.num_rows, _ROWS)):
            texts = batch.column("text").to_pylist()
            found, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [k for k, text in enumerate(texts) if languages and text and _LETTER.search(text)]
            for k, values in zip(known, scorer.score([texts[k] for k in known]) if known else (), strict=True):
                best = int(np.argmax(values))
                found[k], scores[k] = languages[best], 1.0 / np.exp(values - values[best]).sum()
            arrays = [*(batch.column(k) for k in range(len(kept))), pa.array(found, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)
        del scorer
        give_back()

    return docs.select(*(F.col(f"`{field.name}`") for field in kept)).mapInArrow(run, schema)


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit(docs.where(salt_of("doc_id", 4, 2, inside=False)), read_ranks(public_tokenizers.path(VOCABULARY)))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", salt_of("doc_id", 4, 2, inside=True).alias("held_out"), "lang_pred", "score")
