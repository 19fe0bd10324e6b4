"""Phrase collocation mining: mergeable Misra-Gries summaries find frequent n-grams, a second pass counts them exactly.

1. Each task hashes the n-grams (one to ``longest`` words, with their language) of a chunk of words. The chunk's counts are a
   summary without error; they are cut by ranges of the hash, the hash partitions, and travel packed. With more partitions than
   ``FANOUT`` they travel twice, so that rows never number chunks times partitions.
2. Per hash partition the summaries are merged: counts of equal hashes add up, and when more than ``capacity`` are left, the
   next largest count is taken off all and what is not positive goes. The partition's mass, known from headers that come
   first, gives the capacity: ``SLACK`` * mass / threshold + 1. So less than threshold / SLACK is taken off in all, and every
   n-gram of at least ``threshold`` occurrences survives; one whose count plus all that was taken off is below goes.
3. Survivors fill a bitmap of fixed size. The second pass counts, as texts, the n-grams that the bitmap lets pass; what it lets
   pass too much is counted exactly and goes. Beyond some hundred millions of survivors the bitmap lets nearly everything
   pass: the pass then moves the counts of all n-grams, still in proportion to the input.
4. Candidates ask for the counts of their parts in one join; scores are exact in decimals of 38 digits.

Null text is empty, null language ``und``. Texts without words count nothing. Ties: score, count, then phrase in byte order.
Repeated rows count again. Empty input gives an empty result. Extra columns are not read. A text of any length is cut in
chunks inside a piece without losing or repeating an n-gram.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threadspark.llm.common import mixed, packed, stored, table

THRESHOLD, LONGEST, TOP, SHARE = 10, 3, 2_000, 50
SLACK, PART_BYTES, FANOUT, CHUNK_WORDS = 2, 32 * 2**20, 512, 400_000
FILTER_BITS = 2**27  # 16 MB, whatever the number of survivors
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_WORD = re.compile(rb"[^ \t]+")
_PIECE_BYTES = 2**20


class Chunk:
    """Words of neighbouring texts, with their pieces and languages."""

    def __init__(self, longest: int):
        self.longest, self.words, self.pieces, self.names = longest, [], [], {}

    def lang(self, name: str) -> int:
        return self.names.setdefault(name, len(self.names))

    def add(self, words: list[bytes], lang: int, piece: int) -> None:
        self.words += words
        self.pieces.append((piece, lang, len(words)))

    def keys(self, final: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, order and first word of the n-grams that start in this chunk; its last words start in the next one unless ``final``."""
        piece = np.repeat([p for p, _, _ in self.pieces], [n for _, _, n in self.pieces])
        lang, ids, known = self.langs(), *self.ids()
        seeds = np.array([xxhash.xxh3_64_intdigest(name.encode(), 7) for name in self.names], dtype=np.uint64)
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[ids]
        starts = len(self.words) if final else self.done()
        total, out = mixed(seeds[lang[:starts]], 1), []
        for order in range(1, self.longest + 1):
            reach = np.arange(order - 1, min(starts + order - 1, len(self.words)))
            total = total[: len(reach)]
            with np.errstate(over="ignore"):
                total = mixed(total + hashed[reach], order)
            whole = np.flatnonzero(piece[reach] == piece[reach - (order - 1)])
            out.append((total[whole], np.full(len(whole), order, np.int8), whole))
        return tuple(np.concatenate(found) for found in zip(*out, strict=True))

    def langs(self) -> np.ndarray:
        return np.repeat([k for _, k, _ in self.pieces], [n for _, _, n in self.pieces])

    def ids(self) -> tuple[np.ndarray, list[bytes]]:
        """A number per word, and the distinct words by number."""
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(word, len(known)) for word in self.words), np.int64, len(self.words))
        return ids, list(known)

    def counted(self, keys: np.ndarray, orders: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place, order and count of each distinct n-gram of those given; should two share a hash, words decide."""
        _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        ids, lang, heads = self.ids()[0], self.langs(), first[inverse]
        same = (orders == orders[heads]) & (lang[at] == lang[at[heads]])
        for k in range(self.longest):
            rows = np.flatnonzero(same & (orders > k))
            same[rows] = ids[at[rows] + k] == ids[at[heads[rows]] + k]
        if same.all():
            return at[first], orders[first], counts
        found: dict[tuple, list[int]] = {}
        for i, m in zip(at.tolist(), orders.tolist(), strict=True):
            found.setdefault((int(lang[i]), *ids[i : i + m].tolist()), [i, m, 0])[2] += 1
        return tuple(np.array(column) for column in zip(*found.values(), strict=True))

    def done(self) -> int:
        return max(0, len(self.words) - (self.longest - 1))

    def rest(self) -> Chunk:
        """The last words with their pieces, to go on with."""
        after, left = Chunk(self.longest), self.longest - 1
        after.names = dict(self.names)
        kept = []
        for piece, lang, n in reversed(self.pieces):
            if left > 0:
                kept.append((piece, lang, min(n, left)))
                left -= min(n, left)
        after.words, after.pieces = self.words[self.done() :], kept[::-1]
        return after


def chunks(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[Chunk, bool]]:
    """Chunks of bounded size over whole texts; a piece may go on in the next chunk. The last one is marked."""
    chunk, piece = Chunk(longest), 0
    for batch in batches:
        for text, name in zip(batch.column("text"), batch.column("lang"), strict=True):
            lang = name.as_py()
            for part in text.as_py().encode().lower().translate(_ENDS).split(b"\n"):
                piece += 1
                if len(part) <= _PIECE_BYTES:
                    if words := part.split():
                        chunk.add(words, chunk.lang(lang), piece)
                else:
                    found = []
                    for match in _WORD.finditer(part):
                        found.append(match[0])
                        if len(found) == CHUNK_WORDS:
                            chunk.add(found, chunk.lang(lang), piece)
                            yield chunk, False
                            chunk, found = chunk.rest(), []
                    if found:
                        chunk.add(found, chunk.lang(lang), piece)
                if len(chunk.words) >= CHUNK_WORDS:
                    yield chunk, False
                    chunk = chunk.rest()
    if chunk.words:
        yield chunk, True


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The hash partition: parts are ranges of the hash, so sorted keys stay together."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _blocks(keys: np.ndarray, counts: np.ndarray, parts: int, salt: int) -> pa.RecordBatch:
    """A header with the mass and a block of sorted keys with their counts for each part that occurs."""
    part = part_of(keys, parts)
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(part))
    mass = np.add.reduceat(counts, cuts) if len(cuts) else np.zeros(0, np.int64)
    blocks = [packed(keys[a:b], "<u8") + packed(counts[a:b], "<u4") for a, b in zip(cuts, ends, strict=True)]
    n, own = len(cuts), part[cuts]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([own, own])), pa.array(np.full(2 * n, salt)), pa.array(np.repeat([False, True], n)),
            pa.array(np.concatenate([mass, np.zeros(n, np.int64)])), pa.array([None] * n + blocks, pa.binary()),
        ],
        ["part", "salt", "body", "mass", "block"],
    )


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(block) // 12
    return np.frombuffer(block, "<u8", n), np.frombuffer(block, "<u4", n, 8 * n).astype(np.int64)


_BLOCK_SCHEMA = "part long, salt long, body boolean, mass long, block binary"


def chunk_summaries(docs: DataFrame, longest: int, parts: int, salts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (chunk, final) in enumerate(chunks(batches, longest)):
            keys, counts = np.unique(chunk.keys(final)[0], return_counts=True)
            yield _blocks(keys, counts.astype(np.int64), parts, (number * 7919 + int(keys[0] % np.uint64(7919)) if len(keys) else 0) % salts)

    return docs.mapInArrow(run, _BLOCK_SCHEMA)


def dealt_again(summaries: DataFrame, parts: int, tasks: int) -> DataFrame:
    """Summaries of coarse ranges, met in tasks of a range each, cut into the final partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for batch in batches:
            for block in batch.column("block"):
                held.append(_unpacked(block.as_py()))
                size += len(held[-1][0])
                if size >= 8 * CHUNK_WORDS:
                    yield _blocks(*added(*map(np.concatenate, zip(*held, strict=True))), parts, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield _blocks(*added(*map(np.concatenate, zip(*held, strict=True))), parts, number)

    blocks = summaries.where("body").repartition(tasks, "part", "salt").sortWithinPartitions("part")
    return blocks.mapInArrow(run, _BLOCK_SCHEMA)


class MisraGries:
    """Counters for one hash partition; at most ``capacity`` of them after every merge."""

    def __init__(self, mass: int, threshold: int, slack: int = SLACK):
        self.capacity, self.threshold, self.taken = slack * mass // threshold + 1, threshold, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((keys, counts))
        self.size += len(keys)
        if self.size >= max(self.capacity, 100_000):
            self.merge()

    def merge(self) -> None:
        held, self.held, self.size = [(self.keys, self.counts), *self.held], [], 0
        keys, counts = added(*map(np.concatenate, zip(*held, strict=True)))
        if len(keys) > self.capacity:
            place = len(keys) - self.capacity - 1
            cut = int(np.partition(counts, place)[place])
            self.taken += cut
            keys, counts = keys[counts > cut], counts[counts > cut] - cut
        self.keys, self.counts = keys, counts

    def survivors(self) -> np.ndarray:
        self.merge()
        return self.keys[self.counts + self.taken >= self.threshold]


def survivors(summaries: DataFrame, parts: int, threshold: int) -> DataFrame:
    """Column key: hashes of all n-grams of at least ``threshold`` occurrences, and of some others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, mass, summary = None, 0, None

        def out() -> pa.RecordBatch:
            found = summary.survivors() if summary else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["key"])

        for batch in batches:
            columns = (batch.column(name) for name in ("part", "mass", "block"))
            for part, own, block in zip(*(column.to_pylist() for column in columns), strict=True):
                if part != current:
                    if current is not None:
                        yield out()
                    current, mass, summary = part, 0, None
                if block is None:
                    mass += own
                else:
                    summary = summary or MisraGries(mass, threshold)
                    summary.add(*_unpacked(block))
        if current is not None:
            yield out()

    dealt = summaries.select("part", "body", "mass", "block").repartition(parts, "part").sortWithinPartitions("part", "body")
    return dealt.select("part", "mass", "block").mapInArrow(run, "key long")


def survivor_filter(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap over the highest bits of the hash; a row per 32,768 bits comes to the driver."""
    value = F.shiftrightunsigned("key", 64 - (bits.bit_length() - 1)) + 1
    maps = keys.groupBy(F.bitmap_bucket_number(value).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("map"))
    whole = bytearray(bits // 8)
    for k, part in maps.toLocalIterator():
        whole[(k - 1) * 4_096 : k * 4_096] = part
    return np.frombuffer(bytes(whole), np.uint8)


def exact_counts(docs: DataFrame, longest: int, threshold: int, bitmap: np.ndarray) -> DataFrame:
    """lang, words (0: all words of the language), phrase and f of the n-grams that occur at least ``threshold`` times."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        shift = np.uint64(64 - (len(bitmap) * 8).bit_length() + 1)
        for chunk, final in chunks(batches, longest):
            keys, orders, at = chunk.keys(final)
            names, lang, words = list(chunk.names), chunk.langs(), chunk.words
            place = keys >> shift
            passes = (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            first, sizes, counts = chunk.counted(keys[passes], orders[passes], at[passes])
            phrases = [b" ".join(words[i : i + m]) for i, m in zip(first.tolist(), sizes.tolist(), strict=True)]
            totals = np.bincount(lang[at[orders == 1]], minlength=len(names))
            langs = [names[k] for k in lang[first]] + names
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(langs, pa.string()), pa.array([*sizes.tolist(), *[0] * len(names)], pa.int32()),
                    pa.array([*phrases, *[b""] * len(names)], pa.binary()).cast(pa.string()), pa.array(np.concatenate([counts, totals])),
                ],
                ["lang", "words", "phrase", "f"],
            )

    found = docs.mapInArrow(run, "lang string, words int, phrase string, f long")
    counted = found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return counted.where((F.col("f") >= threshold) | (F.col("words") == 0))


def _run(words, start: int, length):
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame, longest: int) -> DataFrame:
    """Candidates with their lowest-scoring cut: lang, words, phrase, a, l, r, score."""
    parts = F.split("phrase", " ")
    sides = [F.struct(F.lit(k).alias("k"), F.lit(left).alias("left"), (_run(parts, 1, k) if left else _run(parts, k + 1, longest)).alias("part")) for k in range(1, longest) for left in (True, False)]
    asked = counts.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.array(*sides)).alias("cut"))
    asked = asked.where(F.col("cut.k") < F.col("words")).select("lang", "words", "phrase", "a", "cut.*")
    known = counts.where("words > 0").select("lang", F.col("phrase").alias("part"), "f")
    met = asked.join(known, ["lang", "part"])

    def count_of(k: int, left: bool):
        return F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("f"))).alias(f"{'l' if left else 'r'}{k}")

    sums = met.groupBy("lang", "words", "phrase", "a").agg(*[count_of(k, left) for k in range(1, longest) for left in (True, False)])
    # a is at most l and r, so the score is at most a million; products stay below 38 digits for counts below 10^15
    score = "(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l{k} as decimal(15,0)) * cast(r{k} as decimal(15,0)))"
    cuts = F.array(*[
        F.when(F.col("words") > k, F.struct(F.expr(score.format(k=k)).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        for k in range(1, longest)
    ])
    lowest = F.array_min(F.filter(cuts, lambda cut: cut.isNotNull()))
    return sums.select("lang", "words", "phrase", "a", lowest.alias("cut")).select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def without_contained(candidates: DataFrame, longest: int, share: int) -> DataFrame:
    """Drops candidates inside a longer one that has at least ``share`` percent of their occurrences."""
    parts = F.split("phrase", " ")
    inner = [
        F.struct(F.lit(start + size).alias("end"), _run(parts, start, size).alias("part"))
        for size in range(2, longest) for start in range(1, longest - size + 2)
    ]
    if not inner:
        return candidates
    longer = candidates.where("words > 2").select("lang", "words", F.col("a").alias("f"), F.explode(F.array(*inner)).alias("inner"))
    # a part ends inside the phrase and is shorter than it
    inside = longer.where((F.col("inner.end") <= F.col("words") + 1) & (F.size(F.split("inner.part", " ")) < F.col("words")))
    most = inside.groupBy("lang", F.col("inner.part").alias("phrase")).agg(F.max("f").alias("longer"))
    met = candidates.join(most, ["lang", "phrase"], "left")
    return met.where(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * share)).drop("longer")


def collocations(
    docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, share: int = SHARE, fanout: int = FANOUT, part_bytes: int = PART_BYTES
) -> DataFrame:
    """All phrases that stay, with n: lang, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    read = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    size = read.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    rounds = [min(parts, fanout)]
    while rounds[-1] < parts:  # each round cuts a range into at most ``fanout``
        rounds.append(min(-(-parts // rounds[-1]), fanout) * rounds[-1])
    salts = -(-rounds[-1] // rounds[0])
    summaries = chunk_summaries(read, longest, rounds[0], salts)
    for number in rounds[1:]:
        summaries = dealt_again(summaries, number, rounds[-1])
    kept = stored(survivors(summaries, rounds[-1], threshold), "survivors")
    counts = stored(exact_counts(read, longest, threshold, survivor_filter(kept)), "phrases")
    candidates = stored(scored(counts, longest), "candidates")
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return without_contained(candidates, longest, share).join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def best(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """Adds ``rank`` to the first ``top`` phrases of each language."""
    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()
    ranked = phrases.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_mine_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return best(collocations(table(spark, folder, "documents")))


OP13_SQL = """
with pieces as (
  select coalesce(lang, 'und') lang, row_number() over () piece, part
  from (select lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) part from documents)
), words as (
  select lang, list_filter(string_split_regex(part, '[ \\t]+'), lambda w: w <> '') ws from pieces
), grams as (
  select lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i : i + m - 1], ' '))) phrase
  from words, (select unnest([1, 2, 3]) m) where len(ws) >= m
), f as (
  select lang, m, phrase, count(*) f from grams group by all having count(*) >= 10
), n as (
  select lang, sum(len(ws))::bigint n from words group by lang
), cuts as (
  select c.lang, c.m, c.phrase, c.f a, k, array_to_string(string_split(c.phrase, ' ')[:k], ' ') lp, array_to_string(string_split(c.phrase, ' ')[k + 1 :], ' ') rp
  from f c, (select unnest([1, 2]) k) where m > 1 and k < m
), costs as (
  select c.*, l.f l, r.f r, ((1000000::hugeint * a * a) // (l.f::hugeint * r.f))::bigint score
  from cuts c join f l on l.lang = c.lang and l.phrase = lp join f r on r.lang = c.lang and r.phrase = rp
), lowest as (
  select * from costs qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inner_parts as (
  select lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) phrase from lowest where m = 3
), longer as (
  select lang, phrase, max(a) top from inner_parts group by all
), kept as (
  select c.* from lowest c left join longer g on g.lang = c.lang and g.phrase = c.phrase and c.m = 2
  where g.top is null or 100 * g.top < 50 * c.a
)
select k.lang, row_number() over (partition by k.lang order by score desc, a desc, phrase) rank, phrase, a, l, r, n.n, score
from kept k join n on n.lang = k.lang
qualify rank <= 2000
"""
