"""Each operator on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm import brute
from threadspark.llm import (
    byte_bpe, chat_format, decontaminate, exact_topk, katz_lm, language_id, line_dedup, near_dedup, sharding, token_counts,
)
from threadspark.llm.common import salt_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, shard string, score string, first string"
SYLLABLES = ["the", "an", "ing", "er", "tion", "lo", "ra", "mi", "so", "été", "über"]


def make_docs(spark, texts, first=0):
    rows = [(k + first, t, "en", "s", len(t or ""), "x", "y", "z", "w") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice(SYLLABLES) for _ in range(pick.randint(1, 3))) for _ in range(n))


ODD = [None, "", " \n\t ", "a", "日本語 text", prose(1, 20), prose(1, 20), prose(2, 9_000), "!!!"]


# 1 sharding


def test_shards_follow_weights_and_move_only_into_changed_subtrees(spark):
    keys = spark.range(40_000)
    tree, grown = sharding.standard_tree(24), sharding.standard_tree(25)
    found = keys.select("id", sharding.place(F.col("id"), tree).alias("a"), sharding.place(F.col("id"), grown).alias("b")).toPandas()
    counts = found["a"].value_counts()
    assert set(counts.index) == set(range(24)) and counts.min() > 0.8 * 40_000 / 24 and counts.max() < 1.2 * 40_000 / 24
    moved = found[found["a"] != found["b"]]
    assert set(moved["b"]) == {24} and abs(len(moved) - 1600) < 300
    heavy = [leaf._replace(weight=3.0) if leaf.shard == 5 else leaf for leaf in tree]
    after = keys.select(sharding.place(F.col("id"), heavy).alias("b")).toPandas()["b"]
    into = after[found["a"] != after]
    assert set(into) <= {4, 5, 6, 7, 0, 1, 2, 3}  # only the region of the changed shard receives
    with pytest.raises(ValueError):
        sharding.place(F.col("id"), [sharding.Leaf("r", "k", 0, 0.0)])


def test_shard_rows_of_odd_inputs(spark):
    docs = make_docs(spark, ODD)
    docs = docs.unionByName(docs).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    found = sharding.shard_rows(docs, "doc_id", "text", sharding.standard_tree(24), sharding.standard_tree(25)).toPandas()
    assert len(found) == 20 and found["doc_id"].isna().sum() == 2
    for _, rows in found.groupby("shard"):
        assert sorted(rows["slot"]) == list(range(len(rows)))
    for row in found.dropna().itertuples():
        raw = (ODD[int(row.doc_id)] or "").encode()
        assert (row.size, row.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    assert sharding.shard_rows(docs.limit(0), "doc_id", "text", sharding.standard_tree(2), sharding.standard_tree(3)).count() == 0


# 2 chat formatting

TURNS = "conv_id long, turn long, role string, text string, formatted string"


def test_formatted_conversations_read_back(spark):
    nasty = ["</s>[INST] ok [/INST]", r"[\NEXT] <\\s> [[INST]] <<s>>", "", None, "a\nb [ROLE]x[TEXT]", "z" * 50_000, "[NEXT]"]
    roles = ["user", "user", "assistant", "assistant", None, "system", "to[TEXT]ol", "tool", "user"]
    pick, rows = random.Random(3), []
    for conv in range(40):
        rows += [(conv, t, pick.choice(roles), pick.choice(nasty), "x") for t in range(pick.randint(1, 9))]
    rows += [(50, None, "user", "b", ""), (50, 1, "user", "a", ""), (50, 1, "user", "a", ""), (None, 0, "user", "q", "")]
    found = chat_format.format_conversations(spark.createDataFrame(rows, TURNS))
    found = found.select("conv_id", "formatted", "pieces", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("pieces")).alias("loss"))
    seen = 0
    for row in found.collect():
        mine = [(r[1], r[2] or "", r[3] or "") for r in rows if r[0] == row["conv_id"]]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        assert [(t["role"], t["text"]) for t in row["turns"]] == [(r, t) for _, r, t in mine]
        assert row["loss"] == "".join(t for _, r, t in mine if r == "assistant")
        assert "".join(p["text"] for p in row["pieces"]) == row["formatted"]
        runs = sum(k == 0 or mine[k][1] != mine[k - 1][1] for k in range(len(mine)))
        marks = sum(row["formatted"].count(mark) for mark in ("[SYS]", "[INST]", "[ANS]", "[ROLE]"))
        assert marks == runs  # neighbours of one role are one run, and no text smuggles in a mark
        seen += 1
    assert seen == 42
    assert chat_format.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


# 3 token counts


def test_tokens_of_sections(spark):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, "a\n\n\nb\n", "über\n日本語\n", "\n", "end without feed\nlast"]
    docs = make_docs(spark, texts)
    for rule in token_counts.RULES:
        found = token_counts.section_tokens(docs, ranks, public_tokenizers.PATTERN, rule).toPandas()
        for doc, rows in found.groupby("doc_id"):
            text = texts[doc] or ""
            lines = text.splitlines(keepends=True) if "\r" not in text else None
            lines = [x + "\n" for x in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if text.split("\n")[-1] or not text else [])
            assert len(rows) == len(lines)
            want, edges = [0] * len(lines), np.cumsum([0, *map(len, lines)])
            raw = text.encode()
            at = 0
            for token in encoding.encode_ordinary(text):
                size = len(encoding.decode_single_token_bytes(token))
                start = len(raw[: at + 1].decode(errors="ignore")) - (1 if (raw[at] & 0xC0) != 0x80 else 0) if raw[at] < 0x80 else len(raw[:at].decode(errors="ignore"))
                last = len(raw[: at + size - 1].decode(errors="ignore"))
                at += size
                over = [max(0, min(edges[k + 1], last + 1) - max(edges[k], start)) for k in range(len(lines))]
                hit = [k for k, n in enumerate(over) if n]
                want[hit[0] if rule == "start" else hit[-1] if rule == "end" else over.index(max(over))] += 1
            assert rows.sort_values("section")["n_tokens"].tolist() == want, (doc, rule)
    spans = docs.where("doc_id = 5").withColumn("s", F.expr("array(named_struct('start', 3, 'end', 9))"))
    found = token_counts.section_tokens(spans, ranks, public_tokenizers.PATTERN, sections="s").toPandas()
    assert set(found["section"]) == {-1, 0}
    assert found["n_tokens"].sum() == len(encoding.encode_ordinary(ODD[5]))
    assert token_counts.section_tokens(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_tokens(docs, ranks, public_tokenizers.PATTERN, "middle")


# 4 benchmark decontamination


def plain_hits(texts, items, width=10):
    words = lambda t: decontaminate.words_of((t or "").encode())
    windows = set()
    for name, text in items:
        w = words(text)
        windows |= {(str(name) if name is not None else "null", tuple(w[k : k + width])) for k in range(max(1, len(w) - width + 1)) if w}
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for name, window in windows:
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found.add(name)
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_benchmark_hits_equal_brute_force(spark):
    items = [(1, prose(7, 25)), (2, prose(8, 4)), (3, None), (4, ""), (10, prose(7, 25)), (None, "Ünique lone phrase"), (2, prose(8, 4))]
    text = items[0][1]
    near = text.split()
    near[3], near[4] = near[4], near[3]
    texts = [*ODD, f"{prose(9, 50)} {text.upper()} {prose(10, 5)}", text[10:], items[1][1], "the ünique lone phrase Ünique, lone; phrase!", " ".join(near[:10])]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs(spark, texts)
    for block in (decontaminate.BLOCK, 7):  # one pass, and several
        found = decontaminate.with_hits(decontaminate.find_matches(docs.unionByName(docs), table, block=block)).collect()
        assert len(found) == 2 * len(texts)
        for row in found:
            assert (row["n_words"], row["n_hit"], row["items"]) == plain_hits([texts[row["doc_id"]]], items)[0]
    loose = decontaminate.find_matches(docs, table, slop=1).where(f"doc_id = {len(texts) - 1}").first()["matches"]
    exact = decontaminate.find_matches(docs, table).where(f"doc_id = {len(texts) - 1}").first()["matches"]
    assert {m["item"] for m in loose} >= {"1", "10"} and not exact
    assert decontaminate.find_matches(docs, table.limit(0)).where(F.size("matches") > 0).count() == 0
    assert decontaminate.find_matches(docs.limit(0), table).count() == 0


# 5 line dedup


def test_minimal_hash_is_minimal_and_perfect():
    pick = np.random.default_rng(5)
    for n in (0, 1, 2, 1_000, 20_000):
        first, second = (pick.integers(-(2**63), 2**63 - 1, n, dtype=np.int64) for _ in range(2))
        first[: n // 10] = first[0] if n else 0  # equal halves
        hashed = line_dedup.MinimalHash.loads(*line_dedup.MinimalHash.build(first, second).dumps())
        assert sorted(hashed.slots(first, second)) == list(range(n))


def test_lines_equal_brute_force(spark):
    line = lambda n: f"this is the line number {n:04d}"
    texts = [
        *ODD, f"{line(1)}\n{line(2)}", f"  {line(1).upper()}\t\nshort\n{line(1)}", f"{line(1)}\n\nshort", "short", "short",
        "é" * 19, "é" * 19, "é" * 19, "é" * 20, "\n" + "é" * 20, "é" * 20 + "\v", f"{line(2)}\n{line(3)}",
    ]
    docs = make_docs(spark, texts)
    found = {r["doc_id"]: r for r in line_dedup.drop_lines(docs.unionByName(docs)).distinct().collect()}
    holders = {}
    key = lambda raw: line_dedup.line_key(raw.encode(), 20)
    for k, text in enumerate(texts):
        for raw in (text or "").split("\n"):
            if key(raw):
                holders.setdefault(key(raw), set()).add(k)
    for k, text in enumerate(texts):
        lines = (text or "").split("\n")
        stay = [x for x in lines if not key(x) or len(holders[key(x)]) < 3 or k == max(holders[key(x)])]
        row = found[k]
        assert (row["text"], row["n_lines"], row["n_dropped"]) == ("\n".join(stay), len(lines), len(lines) - len(stay))
        assert row["first"] == "w" and row["lang"] == "en"
    assert found[10]["text"] == "short" and found[11]["n_dropped"] == 0
    nameless = make_docs(spark, [line(9)] * 5).withColumn("doc_id", F.lit(None).cast("long"))
    assert line_dedup.drop_lines(nameless).where("n_dropped = 0").count() == 5
    assert line_dedup.drop_lines(docs.limit(0)).count() == 0


# 6 exact top-k


def test_topk_equals_brute_force(spark):
    pick = np.random.default_rng(6)
    vectors = [(k, pick.normal(0, 0.3, 6).tolist()) for k in range(300)]
    vectors += [(300 + k, vectors[7][1]) for k in range(60)]  # ties
    vectors += [(400, None), (401, [float("nan")] * 6), (402, [None, 1.0]), (403, []), (404, [1.0]), (405, [float("inf")]), (None, [1.0] * 6), (20, vectors[20][1])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    found = exact_topk.exact_topk(frame, F.col("vec_id") % 20 == 0, 20, pivots=5).toPandas()
    whole = [(k, [math.floor(64 * x) for x in v]) for k, v in vectors if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for query, rows in found.groupby("query_id"):
        own = next(v for k, v in whole if k == query)
        best = sorted((-sum(a * b for a, b in zip(own, v)), k) for k, v in whole if k != query)[:20]
        rows = rows.drop_duplicates("rank").sort_values("rank") if query == 20 else rows.sort_values("rank")
        assert list(zip(-rows["score"], rows["vec_id"])) == best, query
    assert set(found["query_id"]) == {k for k, _ in whole if k % 20 == 0}
    few = exact_topk.exact_topk(frame.where("vec_id < 4"), F.col("vec_id") % 20 == 0, 20)
    assert few.count() == 3
    assert exact_topk.exact_topk(frame.limit(0), F.lit(True), 20).count() == 0


# 7 near duplicates


def edited(text, seed, share):
    pick = random.Random(seed)
    return " ".join(prose(pick.random(), 1) if pick.random() < share else w for w in text.split(" "))


def test_near_duplicates_equal_brute_force(spark):
    base, other = prose(11, 150), prose(12, 60)
    texts = [*ODD, base, base.upper(), *(edited(base, k, share) for k in range(25) for share in (0.01, 0.03, 0.08)), other, other + " tail", "one two", "One TWO", "one two three"]
    docs = make_docs(spark, texts)
    wanted, sizes = brute.near_components(dict(enumerate(texts)))
    found = near_dedup.near_duplicates(docs.unionByName(docs)).distinct().collect()
    assert len(found) == len(texts)
    for row in found:
        k = row["doc_id"]
        assert (row["component_id"], row["n_shingles"], row["kept"]) == (wanted[k], sizes[k], wanted[k] == k), k
    assert len(set(wanted.values())) < len(texts) - 20
    nameless = near_dedup.near_duplicates(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert all(r["component_id"] is None and r["kept"] for r in nameless)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    chain = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1000), (2000, 2000)]
    random.Random(1).shuffle(chain)
    labels = dict(near_dedup.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert labels == {**{k: 0 for k in range(301)}, 1000: 1000, 1001: 1000}


def test_match_threshold_bounds_the_chance_of_a_miss():
    for threshold in (80, 85):
        m = near_dedup.least_matches(48, threshold)
        chance = lambda m: sum(math.comb(48, k) * (threshold / 100) ** k * (1 - threshold / 100) ** (48 - k) for k in range(m))
        assert chance(m) <= near_dedup.MISSED < chance(m + 1)


# 8 language


def tongue(lang, seed, n):
    pick = random.Random(seed)
    parts = {"en": ["th", "ing", "er", "and", "wh"], "de": ["sch", "ung", "ein", "ö", "ich"], "fr": ["eau", "ou", "é", "tion", "lle"]}[lang]
    return " ".join("".join(pick.choice(parts) for _ in range(pick.randint(1, 4))) for _ in range(n))


def test_language_of_held_out_texts(spark):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    rows = [(k, tongue(lang, k, 30), lang) for k, lang in enumerate(["en", "de", "fr"] * 60)]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "fr"), (1003, "x" * 30_000, None), (1004, tongue("de", 5, 40), None)]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = language_id.fit(frame.where(salt_of("doc_id", 4, 2, inside=False)), ranks)
    found = {r["doc_id"]: r for r in language_id.predict(frame, model).collect()}
    held = [k for k, _, _ in rows if brute.fold(k, 4) == 2]
    assert held and all(found[k]["lang_pred"] == rows[k][2] for k in held)
    assert [found[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3 and found[1004]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found[1003]["lang_pred"] in model.languages
    assert np.allclose(model.chance.sum(axis=0), 1)
    blank = language_id.fit(frame.limit(0), ranks)
    assert {r["lang_pred"] for r in language_id.predict(frame, blank).collect()} == {"und"}
    assert language_id.predict(frame.limit(0), model).count() == 0


def test_forward_sums_all_segmentations():
    pieces = language_id.Pieces({b"a": 0, b"b": 1, b"ab": 2, b"bab": 3})
    pick = np.random.default_rng(1)
    chance = np.zeros((pieces.size + 1, 2))
    chance[:-1] = pick.random((pieces.size, 2)) / 300

    def total(word, lang):
        if not word:
            return 1.0
        return sum(chance[k, lang] * total(word[len(p) :], lang) for k, p in enumerate(pieces.names) if word.startswith(p))

    for word in (b"a", b"abab", b"babbab", b"ab" * 9):
        matrix = np.frombuffer(word, np.uint8).reshape(1, -1)
        got = language_id.forward(pieces.inside(matrix), chance)[0][0]
        assert np.allclose(got, [math.log(total(word, k)) for k in (0, 1)])
    long = np.frombuffer(b"ab" * 3_000, np.uint8).reshape(1, -1)
    assert np.isfinite(language_id.forward(pieces.inside(long), chance)[0]).all()


def test_words_of_any_length_are_learnt_in_every_round(spark):
    pieces = language_id.Pieces({b"a": 0, b"b": 1, b"ab": 2, b"bab": 3})
    chance = np.zeros(pieces.size + 1)
    chance[:-1] = np.random.default_rng(2).random(pieces.size) / 300
    lengths = np.array([len(name) for name in pieces.names])

    def splits(word):
        if not word:
            yield ()
        for k, name in enumerate(pieces.names):
            if word.startswith(name):
                yield from ((k, *rest) for rest in splits(word[len(name) :]))

    for word in (b"a", b"babbab", b"ab" * 9, b"ab" * 3_000):
        uses = language_id.expected(pieces.inside(np.frombuffer(word * 2, np.uint8).reshape(2, -1)), chance, np.array([1.0, 2.0]), pieces.size)
        assert math.isclose(uses[:-1] @ lengths, 3 * len(word), rel_tol=1e-9)  # every segmentation covers the word
        if len(word) < 20:
            ways = [(np.bincount(way, minlength=pieces.size + 1), np.prod(chance[list(way)])) for way in splits(word)]
            assert np.allclose(uses, 3 * sum(count * p for count, p in ways) / sum(p for _, p in ways))
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    pick = random.Random(3)
    unbroken = lambda letters: "".join(pick.choice(letters) for _ in range(40))
    rows = [(k, unbroken(letters), lang) for k, (lang, letters) in enumerate([("ja", "のにはをたがで"), ("zh", "的一是不了人我")] * 40)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ranks)
    covered = model.chance[:-1].max(axis=0)
    assert (covered > 0.01).all()  # not the flat distribution of smoothing alone


def test_rare_languages_keep_their_rows_when_sampled(spark):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    rows = [(k, tongue("en", k, 5), "en") for k in range(400)] + [(1_000 + k, tongue("fr", k, 5), "rare") for k in range(10)]
    frame = spark.createDataFrame([*rows, (2_000, "  ", "blank")], "doc_id long, text string, lang string")
    model = language_id.fit(frame, ranks, sample=60)
    alone = language_id.fit(frame.where("lang = 'rare'"), ranks)
    assert model.languages == ["en", "rare"] and np.allclose(model.chance[:, 1], alone.chance[:, 0])


# 9 language model


def test_katz_scores_equal_the_definition(spark):
    texts = [*ODD, *(prose(k, 60) for k in range(20, 60)), "unseen words only here", "the the the"]
    docs = make_docs(spark, texts)
    model = brute.Katz([t for k, t in enumerate(texts) if brute.fold(k, 5) != 1])
    found = katz_lm.score_documents(docs, salt_of("doc_id", 5, 1, inside=False)).toPandas().set_index("doc_id")
    assert len(found) == len(texts) and set(found["train_tokens"]) == {model.n}
    for k, text in enumerate(texts):
        tokens = model.tokens(text)
        assert (found.n_tokens[k], found.n_known[k]) == (len(tokens), sum(t in model.words for t in tokens))
        assert math.isclose(found.score[k], model.score(text), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(found.base_score[k], model.base(text), rel_tol=1e-9, abs_tol=1e-9)
    for before in list(model.after)[:20]:
        assert math.isclose(sum(model.chance(w, before) for w in model.words) + model.chance("?", before), 1, rel_tol=1e-9)
    nothing = katz_lm.score_documents(docs, F.lit(False)).toPandas()
    assert (nothing["score"] == 0).all() and (nothing["train_tokens"] == 0).all()
    assert katz_lm.score_documents(docs.limit(0), F.lit(True)).count() == 0


def test_katz_shards_hold_nothing_per_document(spark, monkeypatch):
    monkeypatch.setattr(katz_lm, "BATCH_BYTES", 2_000)

    def sizes(n):  # bytes of the facts that a word shard gives out; each document shares one word with all others
        docs = make_docs(spark, [f"shared own{k}" for k in range(n)]).select("doc_id", "text", F.lit(True).alias("train"))
        facts = katz_lm.count_shards(katz_lm.packed_pairs(docs, 200), 200).where("kind not in ('hist', 'home', 'size')")
        size = sum(F.coalesce(F.octet_length(name), F.lit(0)) for name in ("keys", "numbers", "sums"))
        return facts.agg(F.sum(size)).first()[0]

    assert sizes(2_000) < 2_000 * 200  # dense counters: 200 shards x 68 bytes of each document


# 10 byte-level BPE


def test_ids_equal_the_library_and_decode(spark):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pick = random.Random(10)
    bits = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "​", "a", "the", "ing", "é", "1", "½", "!", "'s", "'", "日本", "😀", "́", "\r\n", "\0"]
    texts = [*ODD, "ab" * 20_000, *("".join(pick.choice(bits) for _ in range(pick.randint(0, 15))) for _ in range(3_000))]
    docs = make_docs(spark, texts)
    encoded = byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)
    found = byte_bpe.decode_documents(encoded, ranks, public_tokenizers.PATTERN).collect()
    assert len(found) == len(texts)
    for row in found:
        text = texts[row["doc_id"]] or ""
        assert np.frombuffer(row["ids"], "<u4").tolist() == encoding.encode_ordinary(text)
        assert bytes(row["decoded"]) == text.encode() and row["shard"] == "y"
    assert byte_bpe.encode_documents(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
    assert hashlib.sha256(b"").hexdigest() == byte_bpe.encode_documents(docs.limit(1), ranks, public_tokenizers.PATTERN).select(F.sha2("ids", 256)).first()[0]


def test_round_trip_equals_two_passes_and_refuses_other_patterns(spark):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    docs = make_docs(spark, ODD)
    two = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    expected = {row["doc_id"]: (row["ids"], row["decoded"]) for row in two.collect()}
    for memo in (3, 1_000):
        found = byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, memo)
        assert "text" not in found.columns and {row["doc_id"]: (row["ids"], row["decoded"]) for row in found.collect()} == expected
    checked = byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, whole=False)
    assert all(row["round_trip"] for row in checked.collect()) and byte_bpe.round_trip(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.Codec(ranks, r"\p{L}|\s|.")
