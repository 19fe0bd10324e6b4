"""The pipeline against a plain version of its five stages, on rows with every odd case."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import ODD, edited, plain_hits, prose
from threadspark.llm import byte_bpe, line_dedup
from threadspark.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, n_lines int, place string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base, leak = prose(31, 120), prose(32, 30)
    shared = "this line is shared by three documents"
    texts = [
        *ODD, base, *(edited(base, k, s) for k in range(6) for s in (0.01, 0.03, 0.2)), f"{prose(33, 40)} {leak[5:]} {prose(34, 9)}", leak.upper(),
        *(f"{prose(40 + k, 30)}\n{shared.upper()}\n{prose(60 + k, 12)}" for k in range(4)), *(prose(80 + k, 25) for k in range(20)), prose(85, 25),
    ]
    rows = [(k, t, ["en", "fr", None][k % 3], "s", len(t or ""), "x", "y", k, "z") for k, t in enumerate(texts)]
    rows += [rows[9], (None, prose(99, 30), "en", None, None, None, None, None, None)]
    random.Random(4).shuffle(rows)
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, leak


def plain(rows, leak):
    docs = [list(r) for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    key, holders = lambda raw: line_dedup.line_key(raw.encode(), 20), {}
    for r in docs:
        for raw in r[1].split("\n"):
            if key(raw) and r[0] is not None:
                holders.setdefault(key(raw), set()).add(r[0])
    for r in docs:
        gone = lambda x: key(x) and r[0] is not None and len(holders[key(x)]) >= 3 and r[0] != max(holders[key(x)])  # noqa: E731, B023
        r[1] = "\n".join(x for x in r[1].split("\n") if not gone(x))
        r[4] = len(r[1])
    near, _ = brute.near_components({r[0]: r[1] for r in docs if r[0] is not None}, 80, 5)
    docs = [r for r in docs if r[0] is None or near[r[0]] == r[0]]
    return [r for r in docs if not plain_hits([r[1]], [(1, leak)])[0][1]]


def test_pipeline_equals_the_plain_version(spark, folder):
    path, rows, leak = folder
    wanted = sorted(((r[0], r[1], r[4]) for r in plain(rows, leak)), key=lambda r: (r[0] is None, r[0]))
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = sorted(corpus_pipeline.run(spark, path).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert [(r["doc_id"], r["n_chars"]) for r in found] == [(k, n) for k, _, n in wanted]
    assert 20 < len(found) < len(rows) - 10
    for row, (_, text, _) in zip(found, wanted, strict=True):
        assert np.frombuffer(row["ids"], "<u4").tolist() == encoding.encode_ordinary(text)
        assert row["n_tokens"] == len(row["ids"]) // 4 and row["round_trip"]


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    path, _, _ = folder
    docs = table(spark, path, "documents")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, path).schema.simpleString() == docs.schema.simpleString(), name
        assert stage(spark, empty, path).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, path).count() == 0
    kept = corpus_pipeline.STAGES[0][1](spark, docs, path)
    assert kept.where("score = 'y' and place = 'z'").count() == kept.where(F.col("doc_id").isNotNull()).count()


def test_every_operator_has_its_query():
    names = set(entry.queries())
    for n in range(1, 11):
        assert any(re.match(rf"op{n}_", name) for name in names), n
    assert "pipeline" in names and set(entry.oracle_sql()) <= names
