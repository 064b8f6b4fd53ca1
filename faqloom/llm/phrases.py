"""Phrase collocations by SON partitioning.

Documents are dealt by digest into a few shards.  Each shard is mined completely at the support lowered in proportion
(``ceil(support / shards)``): a phrase below that in every shard stays below the support in all of them together.  A shard
is no task: tasks count the word pairs of their parts of the shards as hashes, and a shuffle of packed arrays of distinct
hashes adds them up; a second look does the same for longer phrases, at places where every inner pair is frequent in the
shard, and for the words there.  What is frequent in some shard is a candidate.  A last look counts all candidates over the
whole corpus, as text and exactly.

Hashes only choose what is counted: a collision can add a candidate, never lose one, and counts come from the texts' own
words.  What the tasks of the next look have to know is sent as a bit filter of bounded size (``FILTER_BITS``); when it
fills up, more rows are counted than needed, and the result stays the same.

For a candidate cut after its first k words, the score is ``floor(1000 * a * n / (l * r))``; the lowest cut counts.

Defined cases: a null language is ``und``, null and empty texts have no words; repeated rows count each time; a text may be
of any length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faqloom.llm.common import ASCII_UPPER
from faqloom.operators.lookup import lookup
from faqloom.session import bucket_count, materialize

SHARDS = 5
#: Words that a task takes together before it hands on their counts.
BLOCK_WORDS = 1 << 20
#: Keys are shuffled in packs by their highest bits; a partition gets the packs of about so many bytes of text.
BUCKET_BITS = 10
BUCKETS = 1 << BUCKET_BITS
PART_BYTES = 1 << 25
HELD_KEYS = 1 << 22
#: A long text is cut into words in steps of about so many bytes.
STEP_BYTES = 1 << 22
FILTER_BITS = 27
PROBES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
SEGMENTS = 256
ROWS = 1 << 16
# What separates pieces, and what separates the words of a piece.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: One sign for all piece ends, which no word can hold; everything else between words becomes a blank.
END = b"."
_TABLE = bytes.maketrans(
    ASCII_UPPER.encode() + PIECE_ENDS + BLANKS, ASCII_UPPER.lower().encode() + END * len(PIECE_ENDS) + b" " * len(BLANKS)
)


def words_of(text: str) -> Iterator[list[bytes]]:
    """Lower-cased words in order, ``END`` between pieces, a long text in steps."""
    raw = text.encode().translate(_TABLE)
    at = 0
    while at < len(raw):
        stop = len(raw) if len(raw) - at <= STEP_BYTES else raw.find(b" ", at + STEP_BYTES)
        stop = len(raw) if stop < 0 else stop
        yield raw[at:stop].replace(END, b" . ").split()
        at = stop


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a phrase from the hash of all but its last word and that of its last word."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class Block:
    """The words of some documents as numbers, a language's apart from another's, with the shard of each place."""

    def __init__(self):
        self.numbers, self.next, self.parts, self.dealt, self.size = {}, count(1), [], [], 0

    def add(self, lang: str, shard: int, text: str) -> None:
        known = self.numbers.get(lang)
        if known is None:
            known = self.numbers[lang] = defaultdict(self.next.__next__, {END: 0})
        size = self.size
        for words in words_of(text):
            self.parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            self.size += len(words)
        self.parts.append(np.zeros(1, np.int32))
        self.size += 1
        self.dealt.append((shard, self.size - size))

    def close(self) -> None:
        self.ids = np.concatenate([*self.parts, np.zeros(8, np.int32)])
        self.shard = np.repeat(*np.array(self.dealt, np.uint64).T.astype(np.int64)).astype(np.uint64)
        total = next(self.next)
        self.words: list[bytes] = [b""] * total
        self.lang, self.hash = [""] * total, np.zeros(total, np.uint64)
        for lang, known in self.numbers.items():
            seed = xxhash.xxh64_intdigest(lang.encode())
            places, hashes = array("q"), array("Q")
            for word, i in known.items():
                if i:
                    self.words[i], self.lang[i] = word, lang
                    places.append(i)
                    hashes.append(xxhash.xxh64_intdigest(word, seed))
            self.hash[np.frombuffer(places, np.int64)] = np.frombuffer(hashes, np.uint64)
        self.numbers, self.parts = {}, []

    def levels(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per length: the hash of the phrase that starts at each place, and whether one does (it lies in one piece)."""
        n = len(self.ids) - 8
        word = self.hash[self.ids]
        inside = self.ids != 0
        h, starts = word[:n], inside[:n]
        yield 1, h, starts
        for size in range(2, longest + 1):
            starts = starts & inside[size - 1 : n + size - 1]
            h = mixed(h, word[size - 1 : n + size - 1])
            yield size, h, starts

    def keys(self, h: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Hashes at some places with the shard in the lowest byte."""
        return (h[places] & ~np.uint64(255)) | self.shard[places]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    block = Block()
    for batch in batches:
        for lang, shard, text in zip(batch.column("lang"), batch.column("shard"), batch.column("text")):
            block.add(lang.as_py(), shard.as_py(), text.as_py())
            if block.size >= BLOCK_WORDS:
                block.close()
                yield block
                block = Block()
    if block.parts:
        block.close()
        yield block


# Bit filters


def filter_places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((keys * np.uint64(p)) ^ (keys >> np.uint64(31))) >> np.uint64(64 - bits) for p in PROBES]


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = int(bitmap.size * 8).bit_length() - 1
    ok = np.ones(len(keys), bool)
    for place in filter_places(keys, bits):
        ok &= (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
    return ok


def bit_filter(keys: DataFrame) -> np.ndarray:
    """A bit filter of a written table of 64-bit ``key``; its size follows the rows up to ``FILTER_BITS``."""
    rows = keys.count()
    bits = min(FILTER_BITS, max(16, math.ceil(math.log2(24 * max(rows, 1)))))
    each = 1 << (bits - 3 - 8)  # bytes of a segment

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(filter_places(batch.column(0).to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array((at // np.uint64(8 * each)).astype(np.int32)), pa.array((at % np.uint64(8 * each)).astype(np.int32))],
                ["segment", "place"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            segment, place = (batch.column(c).to_numpy() for c in (0, 1))
            for s in np.unique(segment).tolist():
                part = held.setdefault(s, np.zeros(8 * each, bool))
                part[place[segment == s]] = True
        for s, part in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int32()), pa.array([np.packbits(part, bitorder="little").tobytes()])], ["segment", "bits"])

    spread = keys.select("key").mapInArrow(places, "segment int, place int").distinct()
    spread = spread.repartition(min(SEGMENTS, bucket_count(keys.sparkSession)), "segment")
    out = np.zeros(SEGMENTS * each, np.uint8)
    for s, part in spread.mapInArrow(fill, "segment int, bits binary").collect():  # SEGMENTS rows
        out[s * each : (s + 1) * each] = np.frombuffer(part, np.uint8)
    return out


# The three looks


def summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, with the sums of their numbers (1 each by default)."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(first, append=len(keys)) if n is None else np.add.reduceat(n.astype(np.int64), first)


def counted_keys(docs: DataFrame, shortest: int, longest: int, known: np.ndarray | None) -> DataFrame:
    """bucket, keys, n: a block's distinct phrases of ``shortest`` to ``longest`` words as 64-bit keys (hash, and the shard in the lowest byte)
    with their numbers, packed by bucket of their highest bits.  With ``known``, a phrase counts only where all its pairs are
    in that filter, and words count as the ones of such pairs."""
    sent = None if known is None else docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            pair = open_ = None
            for size, h, starts in block.levels(longest):
                if sent is not None and size == 2:
                    places = np.flatnonzero(starts)
                    pair = np.zeros(len(h) + longest, bool)
                    pair[places] = passes(sent.value, block.keys(h, places))
                    open_ = pair[: len(h)].copy()
                    word = pair[: len(h)].copy()
                    word[1:] |= pair[: len(h) - 1]
                    yield from packed(*summed(block.keys(block.hash[block.ids], np.flatnonzero(word))))
                elif sent is not None and size > 2:
                    open_ &= pair[size - 2 : size - 2 + len(h)]
                    starts = starts & open_
                if size >= shortest:
                    yield from packed(*summed(block.keys(h, np.flatnonzero(starts))))

    def packed(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        borders = np.searchsorted(keys, np.arange(1, BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS))
        some = [(i, k.tobytes(), m.astype(np.uint32).tobytes())
                for i, (k, m) in enumerate(zip(np.split(keys, borders), np.split(n, borders))) if len(k)]
        if some:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*some), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "keys", "n"])

    return docs.mapInArrow(run, "bucket int, keys binary, n binary")


def locally_frequent(counts: DataFrame, least: int, support: int | None) -> DataFrame:
    """hash, shard of what reaches the lowered support in the shard.  Where the counts are complete, ``support`` also asks
    for the sum over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one task has all numbers of a key; what came so far is summed up whenever enough has come
        keys, n, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            for k, m in zip(batch.column("keys"), batch.column("n")):
                keys.append(np.frombuffer(k.as_buffer(), np.uint64).copy())
                n.append(np.frombuffer(m.as_buffer(), np.uint32).copy())
                size += len(keys[-1])
                if size > HELD_KEYS:
                    k, m = summed(np.concatenate(keys), np.concatenate(n))
                    keys, n, size = [k], [m], len(k) // 2  # half of what is distinct: each sum is worth its time
        k, m = summed(np.concatenate(keys), np.concatenate(n))
        del keys, n
        ok = m >= least
        if support is not None and len(k):
            h = k & ~np.uint64(255)
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            total = np.add.reduceat(m, first)
            ok &= np.repeat(total, np.diff(first, append=len(h))) >= support
        k = k[ok]
        for at in range(0, len(k), ROWS):
            part = k[at : at + ROWS]
            yield pa.RecordBatch.from_arrays(
                [pa.array((part & ~np.uint64(255)).view(np.int64)), pa.array((part & np.uint64(255)).astype(np.int16))],
                ["hash", "shard"])

    return counts.mapInArrow(run, "hash bigint, shard smallint")


def dealt_by_bucket(counts: DataFrame, size: int) -> DataFrame:
    """The shuffle that brings a bucket's keys together; so many partitions that each has a bounded share of ``size`` bytes
    of text."""
    parts = max(bucket_count(counts.sparkSession), size // PART_BYTES)
    return counts.repartition(min(parts, BUCKETS), "bucket")


def counted_phrases(docs: DataFrame, candidates: np.ndarray, longest: int) -> DataFrame:
    """bucket, keys, n: a block's candidates as text, packed by bucket.  A key is language, line end and phrase; the empty
    phrase counts a language's words."""
    sent = docs.sparkSession.sparkContext.broadcast(candidates)

    def rows(block: Block, size: int, places: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, str, int]]:
        places = places[np.argsort(h[places], kind="stable")]
        if not len(places):
            return
        words = np.stack([block.ids[places + j] for j in range(size)])
        # equal hashes lie together; what differs in a word is another phrase all the same
        first = np.flatnonzero(np.concatenate([[True], (words[:, 1:] != words[:, :-1]).any(axis=0)]))
        bucket = (h[places[first]] >> np.uint64(64 - BUCKET_BITS)).tolist()
        n = np.diff(first, append=len(places)).tolist()
        for at, ids, many in zip(bucket, words[:, first].T.tolist(), n):
            yield at, f"{block.lang[ids[0]]}\n{b' '.join([block.words[i] for i in ids]).decode()}", many

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            packs: dict[int, tuple[list[str], list[int]]] = defaultdict(lambda: ([], []))
            uses = np.bincount(block.ids[: len(block.ids) - 8], minlength=len(block.words))
            total: dict[str, int] = defaultdict(int)
            for lang, n in zip(block.lang[1:], uses[1:].tolist()):
                total[lang] += n
            found = [(xxhash.xxh64_intdigest(lang.encode()) >> (64 - BUCKET_BITS), f"{lang}\n", n) for lang, n in total.items()]
            pair = open_ = None
            for size, h, starts in block.levels(longest):
                if size > 2:
                    open_ &= pair[size - 2 : size - 2 + len(h)]
                    starts = starts & open_  # every pair inside a frequent phrase is a candidate too
                places = np.flatnonzero(starts)
                places = places[passes(sent.value, h[places] & ~np.uint64(255))]
                if size == 2:
                    pair = np.zeros(len(h) + longest, bool)
                    pair[places] = True
                    open_ = pair[: len(h)].copy()
                for bucket, key, n in chain(found, rows(block, size, places, h)):
                    keys, numbers = packs[bucket]
                    keys.append(key)
                    numbers.append(n)
                found = []
            some = [(bucket, keys, n) for bucket, (keys, n) in packs.items()]
            for at in range(0, len(some), 64):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*some[at : at + 64]), (pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())))],
                    ["bucket", "keys", "n"])

    return docs.mapInArrow(run, "bucket int, keys array<string>, n array<bigint>")


def globally_frequent(counts: DataFrame, support: int) -> DataFrame:
    """lang, size, phrase, n of all candidates with the support, and with size 0 each language's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = defaultdict(int)  # the distinct candidates of a partition
        for batch in batches:
            for keys, n in zip(batch.column("keys"), batch.column("n")):
                for key, many in zip(keys.as_py(), n.as_py()):
                    total[key] += many
        kept = [(*key.rsplit("\n", 1), n) for key, n in total.items() if n >= support or key[-1] == "\n"]
        for at in range(0, len(kept), ROWS):
            lang, phrase, n = zip(*kept[at : at + ROWS])
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array([p.count(" ") + 1 if p else 0 for p in phrase], pa.int32()),
                 pa.array(phrase, pa.string()), pa.array(n, pa.int64())], ["lang", "size", "phrase", "n"])

    return counts.mapInArrow(run, "lang string, size int, phrase string, n bigint")


def frequent_phrases(
    docs: DataFrame, support: int, longest: int, shards: int = SHARDS, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """lang, size, phrase, n of every phrase of 2 to ``longest`` words with n >= ``support`` and of the words in them; size 0
    has the number of all words."""
    if not 1 <= shards <= 255 or longest < 2 or longest > 8 or support < 1:
        raise ValueError("1 to 255 shards, phrases of 2 to 8 words, a support of at least 1")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    whole = rows.select("lang", "text", F.lit(0).alias("shard"))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("lang", "text"), F.lit(shards)).cast("int"))
    least = -(-support // shards)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    short = dealt_by_bucket(counted_keys(dealt, 2, 2, None), size)
    short = materialize(locally_frequent(short, least, support), "phrases-pairs")
    pairs = bit_filter(short.select(F.col("hash").bitwiseOR(F.col("shard").cast("bigint")).alias("key")))
    longer = dealt_by_bucket(counted_keys(dealt, 3, longest, pairs), size)
    found = short.unionByName(materialize(locally_frequent(longer, least, None), "phrases-longer"))
    candidates = bit_filter(materialize(found.select(F.col("hash").alias("key")).distinct(), "phrases-candidates"))
    counts = dealt_by_bucket(counted_phrases(whole, candidates, longest), size)
    return materialize(globally_frequent(counts, support), "phrases-frequent")


def quotient(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (l * r)) with 38 digits between."""
    wide = [c.cast("decimal(19,0)") for c in (a, n, left, right)]
    above = (F.lit(1000).cast("decimal(4,0)") * wide[0]).cast("decimal(22,0)") * wide[1]
    return F.call_function("div", above, wide[2] * wide[3])


def collocations(
    docs: DataFrame, support: int = 100, longest: int = 5, top: int = 2000, covered: int = 100, shards: int = SHARDS,
    lang: str = "lang", text: str = "text",
) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.  A phrase goes if a longer candidate that
    holds it has at least ``covered`` hundredths of its number."""
    counts = frequent_phrases(docs, support, longest, shards, lang, text)
    # no phrase holds a line end, so the last one of a key tells language and phrase apart
    counts = counts.withColumn("key", F.concat("lang", F.lit("\n"), "phrase"))
    phrases = counts.filter("size >= 2").withColumn("words", F.split("phrase", " "))
    parts = counts.filter("size >= 1").select("key", "n")

    def joined(start, size):
        return F.concat(F.col("lang"), F.lit("\n"), F.array_join(F.slice("words", start, size), " "))

    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), "size", "words",
                          F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"),
                       joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    left = parts.select(F.col("key").alias("left"), F.col("n").alias("l"))
    right = parts.select(F.col("key").alias("right"), F.col("n").alias("r"))
    cuts = lookup(lookup(cuts, left, "left", ["l"], "l"), right, "right", ["r"], "r")
    words = counts.filter("size = 0").select("lang", F.col("n").alias("all"))
    scored = lookup(cuts, words, "lang", ["all"], "all").withColumn("score", quotient(F.col("a"), F.col("all"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "phrase", "a", "all").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = phrases.filter("size >= 3").select("lang", "n", "size", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("w"))
    inner = inner.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("w") + 1)).alias("i"))
    inner = inner.select(joined(F.col("i"), F.col("w")).alias("key"), "n").groupBy("key").agg(F.max("n").alias("longer"))
    keyed = lowest.withColumn("key", F.concat("lang", F.lit("\n"), "phrase")).join(inner, "key", "left")
    kept = keyed.filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(covered) * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r",
                         F.col("all").alias("n"), "cut.score")


ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, '{ASCII_UPPER}', '{ASCII_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\\x20\\x09]+') IF x <> ''] AS w FROM pieces),
g AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM w, (SELECT unnest(range(1, 6)) AS size) WHERE len(w) >= size)),
c AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
p AS (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS w FROM c WHERE size >= 2),
k AS (SELECT *, unnest(range(1, size)) AS k FROM p),
s AS (
  SELECT k.lang, k.phrase, k.f AS a, a.f AS l, b.f AS r, n.n, k,
    ((1000::HUGEINT * k.f * n.n) // (a.f::HUGEINT * b.f))::BIGINT AS score
  FROM k JOIN c a ON a.lang = k.lang AND a.phrase = array_to_string(k.w[1 : k], ' ')
  JOIN c b ON b.lang = k.lang AND b.phrase = array_to_string(k.w[k + 1 : k.size], ' ')
  JOIN n ON n.lang = k.lang),
lowest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, f, array_to_string(w[i : i + z - 1], ' ') AS phrase
  FROM (SELECT lang, f, w, size, z, unnest(range(1, size - z + 2)) AS i
        FROM (SELECT *, unnest(range(2, size)) AS z FROM p WHERE size >= 3))),
longer AS (SELECT lang, phrase, max(f) AS f FROM inner_ GROUP BY ALL),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN longer ON longer.lang = lowest.lang AND longer.phrase = lowest.phrase
  WHERE longer.f IS NULL OR 100 * longer.f < 100 * lowest.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
