"""Token counts per section from one encoding of the whole document.

A document is encoded once. Byte lengths of its tokens give byte spans, and these give code-point spans; a token covers
every code point of which it holds a byte. Token spans and section spans, both sorted, are joined as intervals inside the
task that holds the document, so neither tokens nor sections are shuffled. A token that lies in one section counts there.
A token that crosses an edge counts once, by the rule:

``start``  the first section it overlaps;
``end``    the last section it overlaps;
``most``   the section with most of its code points, the earlier of equals.

A token that overlaps no section counts in section -1, shown only if it has tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadspark.llm.byte_bpe import VOCABULARY, read_ranks
from threadspark.llm.common import table

RULES = ("start", "end", "most")


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines with their line feed, as code-point spans; an empty text is one empty line."""
    marks = np.frombuffer(text.encode("utf-32-le"), dtype="<u4") == 10
    ends = np.flatnonzero(marks) + 1
    if not len(ends) or ends[-1] != len(text):
        ends = np.append(ends, len(text))
    return np.concatenate(([0], ends[:-1])), ends


def token_spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code-point spans of tokens with these byte lengths."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    point = np.cumsum((raw & 0xC0) != 0x80) - 1
    return point[starts], point[ends - 1] + 1


def allocate(token_start, token_end, starts, ends, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none), and whether it crosses an edge. Sections are sorted and apart."""
    first = np.searchsorted(ends, token_start, side="right")
    last = np.searchsorted(starts, token_end, side="left") - 1
    chosen = np.where(first > last, -1, last if rule == "end" else first)
    crossing = last > first
    if rule == "most":
        for k in np.flatnonzero(crossing):
            here = slice(first[k], last[k] + 1)
            shared = np.minimum(ends[here], token_end[k]) - np.maximum(starts[here], token_start[k])
            chosen[k] = first[k] + int(np.argmax(shared))
    return chosen, crossing


def section_tokens(docs: DataFrame, ranks: dict[bytes, int], pattern: str, rule: str = "start", sections: str | None = None) -> DataFrame:
    """doc_id, section, start, end, n_tokens, n_crossing of every section of every row of ``docs``.

    ``sections`` names a column of sorted, non-overlapping spans array<struct<start int, end int>> in code points;
    without it (or where it is null) sections are lines. Null text is empty; an empty text has one empty section.
    Repeated rows each give their own rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    sent = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    given = F.col(sections) if sections else F.lit(None).cast("array<struct<start:int,end:int>>")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(name, T.IntegerType()) for name in ("section", "start", "end"))])
    schema = schema.add("n_tokens", T.LongType()).add("n_crossing", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, pattern = sent.value
        encoding = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        for batch in batches:
            row_of, columns = [], [[] for _ in range(5)]
            spans_of = batch.column("sections").to_pylist() if sections else [None] * batch.num_rows
            for k, (text, spans) in enumerate(zip(batch.column("text").to_pylist(), spans_of, strict=True)):
                text = text or ""
                if spans is None:
                    starts, ends = line_spans(text)
                else:
                    starts, ends = (np.array([s[name] for s in spans], dtype=np.int64) for name in ("start", "end"))
                ids = np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), dtype=np.int64)
                found, crossing = allocate(*token_spans(text, size[ids]), starts, ends, rule)
                names, counts = np.arange(len(starts)), np.bincount(found + 1, minlength=len(starts) + 1)
                crossed = np.bincount(found[crossing] + 1, minlength=len(starts) + 1)
                if counts[0]:
                    names, starts, ends = np.append(-1, names), np.append(0, starts), np.append(len(text), ends)
                else:
                    counts, crossed = counts[1:], crossed[1:]
                row_of.append(np.full(len(names), k))
                for column, values in zip(columns, (names, starts, ends, counts, crossed), strict=True):
                    column.append(values)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            arrays = [pa.array(np.concatenate(c), kind) for c, kind in zip(columns, kinds, strict=True)] if row_of else [pa.array([], kind) for kind in kinds]
            ids = batch.column("doc_id").take(pa.array(np.concatenate(row_of) if row_of else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *arrays], schema.names)

    return docs.select("doc_id", "text", given.alias("sections")).mapInArrow(run, schema)


def op3_line_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path(VOCABULARY))
    return section_tokens(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
