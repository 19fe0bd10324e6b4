"""Byte-level BPE encoding and decoding by backtracking from longest matches.

Bytes are read as Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds the longest token at a
place. A piece is walked left to right with the longest token; a token may follow another only if BPE would keep the two
apart, which is decided on the two merge trees and memoised. Where no token fits, the walk steps back and the place is
marked as dead, so each place is left at most once and the work is linear. The result equals the merges.

A text is cut before every space that has a non-space after it: each match of the splitting pattern begins anew there, so
the parts are independent and their ids can be memoised. The memo is bounded and holds no state that decides a result.
This holds for the public pattern, the only one that is taken.

Null and empty text have no ids and decode to nothing. A text has one encoding, so there are no ties; texts of any length
are encoded whole. Rows stay as they are, repeated ones too; own columns named like an added one are replaced. Empty input
gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadspark.llm.common import give_back, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_PART, _UNEVEN = re.compile(r"(?= \S)"), re.compile(r" (?:\s|\Z)")
MEMO, MEMO_LENGTH = 350_000, 32


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file of fixed size, read on the driver and sent to the tasks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder of one vocabulary; built once per task from its ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
        if pattern != public_tokenizers.PATTERN:
            raise ValueError("texts are cut at spaces and letters as this pattern does; another one needs cuts of its own")
        self.pattern, self.size = regex.compile(pattern), memo
        self.ids = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.automaton = ahocorasick.Automaton()
        self.longest = max(map(len, ranks), default=1)
        for token, rank in sorted(self.ids.items(), key=lambda item: item[1]):
            halves = self._last_merge(token, rank)
            if len(token) > 1 and halves is None:
                continue  # no merges lead to it: only a piece that equals it can be this token
            self.halves[rank] = halves
            if halves:
                self.pairs[halves] = rank
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.shorter = {rank: self._shorter(self.bytes[rank].decode("latin-1")) for rank in self.halves}
        self.length = {rank: len(token) for rank, token in self.bytes.items()}
        self.kept: dict[tuple[int, int], bool] = {}
        self.memo: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def _last_merge(self, token: str, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``, after all merges of lower rank."""
        parts = list(token)
        while len(parts) > 2:
            best, at = rank, -1
            for k in range(len(parts) - 1):
                found = self.ids.get(parts[k] + parts[k + 1], rank)
                if found < best:
                    best, at = found, k
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) < 2 or any(part not in self.ids for part in parts):
            return None
        return self.ids[parts[0]], self.ids[parts[1]]

    def _shorter(self, token: str) -> int | None:
        for n in range(len(token) - 1, 0, -1):
            rank = self.ids.get(token[:n])
            if rank in self.halves:
                return rank
        return None

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether BPE keeps two neighbouring tokens as they are: no merge across their edge comes before their own."""
        known = self.kept.get((left, right))
        if known is not None:
            return known
        a, b, answer = left, right, None
        before = float("inf")  # the merge that made the edge's present neighbours happens at this rank
        while answer is None:
            crossing = self.pairs.get((a, b))
            if crossing is not None and crossing < before:
                answer = False
            elif self.halves[a] is None and self.halves[b] is None:
                answer = True
            elif self.halves[b] is None or (self.halves[a] is not None and a > b):
                before, a = a, self.halves[a][1]
            else:
                before, b = b + 1, self.halves[b][0]
        if len(self.kept) >= self.size:
            self.kept.clear()
        self.kept[left, right] = answer
        return answer

    def _longest_at(self, piece: str, at: int) -> int:
        return next(self.automaton.iter_long(piece[at : at + self.longest]))[1]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one match of the pattern, given as Latin-1 characters."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        dead, ids, at, n = bytearray(len(piece) + 1), [], 0, len(piece)
        token: int | None = self._longest_at(piece, 0)
        while at < n:
            end = at + self.length[token]
            if not dead[end] and (not ids or self.stays_apart(ids[-1], token)):
                ids.append(token)
                at = end
                token = self._longest_at(piece, at) if at < n else None
                continue
            token = self.shorter[token]
            if token is None:
                dead[at] = 1
                token = ids.pop()
                at -= self.length[token]
        return ids

    def _missed(self, part: str, spaced: bool) -> bytes:
        """Ids of a part (its leading space is left out if ``spaced``); parts of several matches use the memo for each."""
        whole = f" {part}" if spaced else part
        pieces = [whole] if part.isalpha() else self.pattern.findall(whole)
        if len(pieces) == 1:
            made = np.array(self.encode_piece(whole.encode().decode("latin-1")), dtype="<u4").tobytes()
        else:
            made = b"".join(
                self.memo[1].get(piece[1:]) or self._missed(piece[1:], True)
                if piece[0] == " " and len(piece) > 1
                else self.memo[0].get(piece) or self._missed(piece, False)
                for piece in pieces
            )
        memo = self.memo[spaced]
        if len(part) <= MEMO_LENGTH:
            if len(memo) >= self.size:
                memo.clear()
            memo[part] = made
        return made

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        heads, spaced = self.memo
        if _UNEVEN.search(text):
            found = []
            for part in _PART.split(text):
                if part[:1] == " ":
                    found.append(spaced.get(part[1:]) or self._missed(part[1:], True))
                elif part:
                    found.append(heads.get(part) or self._missed(part, False))
            return b"".join(found)
        first, *rest = text.split(" ")
        found = [spaced.get(part) or self._missed(part, True) for part in rest]
        return ((heads.get(first) or self._missed(first, False)) if first else b"") + b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``docs`` with ``ids``: little-endian unsigned 32-bit integers of the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    kept = [field for field in docs.schema.fields if field.name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*sent.value)
        for batch in batches:
            ids = pa.array([codec.encode(text or "") for text in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), ids], [*(f.name for f in kept), "ids"])

    return docs.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, T.StructType([*kept, T.StructField("ids", T.BinaryType())]))


def decode_documents(rows: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``rows`` with ``decoded``: the bytes of column ``ids``; null ids give null."""
    sent = rows.sparkSession.sparkContext.broadcast(list(ranks.items()))
    kept = [field for field in rows.schema.fields if field.name != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {rank: token for token, rank in sent.value}
        for batch in batches:
            found = [
                None if ids is None else b"".join(map(names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
                for ids in batch.column("ids").to_pylist()
            ]
            arrays = [*(batch.column(f.name) for f in kept), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*(f.name for f in kept), "decoded"])

    return rows.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, T.StructType([*kept, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, memo: int = MEMO, whole: bool = True) -> DataFrame:
    """``docs`` without text, with ``ids`` and what these decode to, in one pass: ``decoded``, the bytes, or if not
    ``whole`` only ``round_trip``, whether they are the text's. No text leaves the task."""
    sent = docs.sparkSession.sparkContext.broadcast((ranks, pattern, memo))
    last = T.StructField("decoded", T.BinaryType()) if whole else T.StructField("round_trip", T.BooleanType())
    kept = [field for field in docs.schema.fields if field.name not in ("text", "ids", last.name)]
    names = [*(field.name for field in kept), "ids", last.name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*sent.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 1_000):
                part = batch.slice(k, 1_000)
                texts = [text or "" for text in part.column("text").to_pylist()]
                ids = list(map(codec.encode, texts))
                read = map(codec.decode, ids)
                found = pa.array(list(read), pa.binary()) if whole else pa.array([raw == text.encode() for raw, text in zip(read, texts, strict=True)])
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(ids, pa.binary()), found], names)
        del codec
        give_back()

    read = docs.select(*(F.col(f"`{f.name}`") for f in kept), "text")
    return read.mapInArrow(run, T.StructType([*kept, T.StructField("ids", T.BinaryType()), last]))


def op10_encode_documents(spark: SparkSession, folder: str) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path(VOCABULARY))
    found = round_trip(table(spark, folder, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return found.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
