"""Byte-level BPE encoding and decoding of whole texts by overlapping chunks.

A long text is cut into chunks that overlap.  Tasks pre-tokenise the chunks on their own, each from its first character
on, which may lie inside a pre-token.  A scan's way from a border between pre-tokens on depends only on what follows, so
two scans that share a border agree from there on: the first border that a chunk shares with the chunk ahead of it, inside
their overlap, is where the text may be cut.  Neighbours are compared by an equi-join of the few borders inside the
overlaps; then every chunk encodes the pieces from its own cut up to the next chunk's.  Where two neighbours share no
border (a pre-token longer than the overlap), the rest of that text is scanned in order by one task, which keeps only the
open pre-token.  A text of one chunk is encoded where it lies and never moves.

A pre-token is merged from its bytes, the lowest rank first, the leftmost of equals (a pre-token by itself is a pre-token
again, so the library may be asked for it alone); decoding puts the ids' bytes after
each other.  The pattern's character classes are those of the library the ranks are for, asked for once in each task,
since Unicode versions differ.

Defined cases: null and empty texts have one part without ids; null and repeated ids and repeated rows stay rows of their
own; copies of a long text are encoded once; an empty table gives an empty result; other columns are ignored.  Ids that
the ranks lack are an error in decoding.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faqloom.llm.common import join_counts
from faqloom.session import materialize

#: Characters of a chunk without its overlap; texts up to this length are one chunk.
CHUNK = 1 << 15
OVERLAP = 1 << 8
#: A match this far ahead of a chunk's end cannot turn out otherwise in a longer text: contractions have three characters.
MARGIN = 3
#: Merged pre-tokens a task remembers; beyond it the memory starts anew.
REMEMBERED = 1 << 17
#: Ids and bytes of texts a task hands on at once.
BATCH_CHARS = 1 << 21
LONG_PIECE = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes, blank, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def splitter(pattern: str) -> re.Pattern:
    """``pattern`` with its classes spelt out as the ranks' library has them."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    spelt = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        asked = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        points = np.frombuffer(bytes(asked.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)
        starts = points[np.flatnonzero(np.diff(points, prepend=points[0] - 2) != 1)]
        ends = points[np.flatnonzero(np.diff(points, append=points[-1] + 2) != 1)]
        spelt[name] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts.tolist(), ends.tolist()))

    out, inside = [], False
    for token in re.findall(r"\\p\{[LN]\}|\\[sS]|\\.|.", pattern, re.S):
        if token in spelt:
            out.append(spelt[token] if inside else f"[{spelt[token]}]")
        elif token == r"\S":
            out.append(f"[^{spelt[chr(92) + 's']}]")
        else:
            inside = token == "[" or inside and token != "]"
            out.append(token)
    return re.compile("".join(out))


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token of any length: neighbours in linked lists, candidates in a heap."""
    if piece in ranks:
        return [ranks[piece]]
    size = len(piece)
    end = list(range(1, size + 1))  # where the part that starts here ends; 0 when it went into another
    ahead = list(range(-1, size - 1))
    heap = [(rank, i, i + 2) for i in range(size - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(a: int, b: int) -> None:
        rank = ranks.get(piece[a : end[b]]) if b < size else None
        if rank is not None:
            heapq.heappush(heap, (rank, a, end[b]))

    while heap:
        _, a, stop = heapq.heappop(heap)
        b = end[a]
        if not b or b >= size or end[b] != stop:
            continue  # one of the two has changed since
        end[a], end[b] = stop, 0
        if stop < size:
            ahead[stop] = a
            offer(a, stop)
        if ahead[a] >= 0:
            offer(ahead[a], a)
    ids, at = [], 0
    while at < size:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


class Seen(dict):
    """Pre-token -> its ids as 32-bit numbers in bytes; asks the encoder for what it lacks."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        return self.encoder.learn(piece)


class Encoder:
    """Merges what it has not seen lately: short pre-tokens by the ranks' library, one at a time, long ones in time that does
    not grow with the square of their length.  It remembers two generations of ``REMEMBERED`` pre-tokens; when the younger one
    is full, it becomes the older one, which goes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.ranks, self.split = ranks, splitter(pattern)
        self.library = tiktoken.Encoding("pre-tokens", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.young, self.older = Seen(self), {}

    def learn(self, piece: str) -> bytes:
        ids = self.young.get(piece) or self.older.get(piece)
        if ids is None:
            long_ = len(piece) > LONG_PIECE
            ids = merge_long(piece.encode(), self.ranks) if long_ else self.library.encode_ordinary(piece)
            ids = array("i", ids).tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self.young) >= REMEMBERED:
                self.older, self.young = self.young, Seen(self)
            self.young[piece] = ids
        return ids

    def of(self, pieces: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.young.__getitem__, pieces)), np.int32)

    def ids(self, text: str) -> np.ndarray:
        return self.of(self.split.findall(text))


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(sent, pattern: str) -> Encoder:
    """The encoder of a worker process: the tasks it runs one after the other share what it remembers."""
    held = _ENCODERS.get(pattern)
    if held is None or held.ranks is not sent.value and held.ranks != sent.value:
        held = _ENCODERS[pattern] = Encoder(sent.value, pattern)
    return held


def list_array(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def bounded(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about ``BATCH_CHARS`` bytes of one column."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > BATCH_CHARS:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def chunks(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """(text_key, text) -> text_key, chunk, first (place of its first character), text, last (whether it is the last),
    ends (whether it holds the text's end)."""
    schema = pa.schema([("text_key", pa.string()), ("chunk", pa.int32()), ("first", pa.int64()), ("text", pa.string()),
                        ("last", pa.bool_()), ("ends", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("text_key"), batch.column("text")):
                key, text = key.as_py(), text.as_py()
                starts = range(0, max(len(text), 1), size)
                for some in range(0, len(starts), 32):
                    rows = [(key, some + i, at, text[at : at + size + overlap], at + size >= len(text),
                             at + size + overlap >= len(text))
                            for i, at in enumerate(starts[some : some + 32])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return texts.mapInArrow(run, "text_key string, chunk int, first bigint, text string, last boolean, ends boolean")


def scanned_borders(cut: DataFrame, pattern: str, size: int, overlap: int) -> DataFrame:
    """text_key, chunk, head and tail: the borders a scan of the chunk meets in its overlap with the chunk ahead of it and
    with the one that follows, as places in the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        for batch in batches:
            head, tail = [], []
            for first, text, whole in zip(batch.column("first"), batch.column("text"), batch.column("ends")):
                first, text = first.as_py(), text.as_py()
                ends = np.cumsum([0, *map(len, split.findall(text))])
                sure = ends if whole.as_py() else ends[ends + MARGIN <= len(text)]
                head.append(first + sure[sure <= overlap])
                tail.append(first + sure[sure >= size])
            lists = [pa.array([x.tolist() for x in side], pa.list_(pa.int64())) for side in (head, tail)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_key"), batch.column("chunk"), *lists], ["text_key", "chunk", "head", "tail"])

    return cut.mapInArrow(run, "text_key string, chunk int, head array<bigint>, tail array<bigint>")


def stitched(borders: DataFrame) -> DataFrame:
    """text_key, chunk, start, stop, streamed: the chunk's pieces lie from ``start`` up to ``stop`` (null: to the end).

    The first chunk's scan is right from the start.  Any other is right from the first border it shares with the scan
    ahead of it, as long as that one is right.  Where two neighbours share none, ``streamed`` is the chunk ahead of the
    gap: from there on the text is scanned in one go.
    """
    ahead = borders.select("text_key", (F.col("chunk") + 1).alias("chunk"), F.col("tail").alias("ahead"))
    shared = F.array_min(F.array_intersect("ahead", "head"))
    starts = borders.join(ahead, ["text_key", "chunk"], "left").select(
        "text_key", "chunk", F.when(F.col("chunk") == 0, F.lit(0).cast("bigint")).otherwise(shared).alias("start"))
    follows = starts.select("text_key", (F.col("chunk") - 1).alias("chunk"), F.col("start").alias("stop"))
    gaps = starts.filter(F.col("start").isNull()).groupBy("text_key").agg((F.min("chunk") - 1).alias("streamed"))
    return starts.join(follows, ["text_key", "chunk"], "left").join(gaps, "text_key", "left")


class Stream:
    """Encodes a text that comes in pieces; keeps only what a longer text could still change."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.rest, self.tried = encoder, "", 0

    def add(self, text: str, last: bool) -> np.ndarray:
        self.rest += text
        if not last and len(self.rest) < 2 * self.tried:
            return np.zeros(0, np.int32)  # an open pre-token is looked at again when twice as much is there
        pieces = self.encoder.split.findall(self.rest)
        ends = np.cumsum([0, *map(len, pieces)])
        sure = len(pieces) if last else int(np.searchsorted(ends, len(self.rest) - MARGIN, "right")) - 1
        sure = max(sure, 0)
        self.rest = self.rest[int(ends[sure]) :]
        self.tried = 0 if sure else len(self.rest)
        return self.encoder.of(pieces[:sure])


def encode_chunked(texts: DataFrame, ranks: dict[bytes, int], pattern: str, size: int, overlap: int) -> DataFrame:
    """(text_key, text), keys unique -> text_key, part, ids; the parts in order are the text's ids."""
    spark = texts.sparkSession
    if not 0 < overlap <= size:
        raise ValueError("the overlap is at least one character and at most a chunk")
    # the chunks of a text that is longer than others go to many tasks
    dealt = chunks(texts, size, overlap).repartition(spark.sparkContext.defaultParallelism * 2, "text_key", "chunk")
    cut = materialize(dealt, "bpe-chunks")
    plan = materialize(stitched(scanned_borders(cut, pattern, size, overlap)), "bpe-borders")
    pieces = cut.join(plan, ["text_key", "chunk"])
    sent = spark.sparkContext.broadcast(ranks)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(sent, pattern)
        for batch in bounded(batches, "text"):
            out = []
            for text, first, start, stop in zip(*(batch.column(c).to_pylist() for c in ("text", "first", "start", "stop"))):
                out.append(encoder.ids(text[start - first : None if stop is None else stop - first]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_key"), batch.column("chunk"), list_array(out)], ["text_key", "part", "ids"])

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stream, key = encoder_of(sent, pattern), None, None
        for batch in bounded(batches, "text"):
            out = []
            names = ("text_key", "text", "first", "start", "last", "chunk", "streamed")
            for k, text, first, start, last, chunk, streamed in zip(*(batch.column(c).to_pylist() for c in names)):
                if k != key:
                    key, stream = k, Stream(encoder)
                new = text if last else text[:size]
                out.append(stream.add(new[start - first :] if chunk == streamed else new, last))
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_key"), batch.column("chunk"), list_array(out)], ["text_key", "part", "ids"])

    shape = "text_key string, part int, ids array<int>"
    late = F.coalesce(F.col("chunk") >= F.col("streamed"), F.lit(False))
    lone = pieces.filter(~late).select("text_key", "chunk", "text", "first", "start", "stop").mapInArrow(alone, shape)
    rest = pieces.filter(late).repartition("text_key").sortWithinPartitions("text_key", "chunk")
    return lone.unionByName(rest.mapInArrow(in_order, shape))


def encode_whole(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, text) of one chunk each -> doc_id, ids, where they lie."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(sent, pattern)
        for batch in bounded(batches, "text"):
            ids = [encoder.ids(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), list_array(ids)], ["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id bigint, ids array<int>")


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, size: int = CHUNK, overlap: int = OVERLAP,
    doc_id: str = "doc_id", text: str = "text",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: (doc_id, ids) of texts of one chunk; (doc_id, text_key) of longer ones; (text_key, part, ids) of the
    distinct longer texts, whose parts in order are the text's ids."""
    whole = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    long_ = F.length("text") > size
    short = encode_whole(whole.filter(~long_), ranks, pattern)
    keyed = whole.filter(long_).withColumn("text_key", F.sha2("text", 256))
    distinct = keyed.groupBy("text_key").agg(F.first("text").alias("text"))
    return short, keyed.select("doc_id", "text_key"), encode_chunked(distinct, ranks, pattern, size, overlap)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", name: str = "bytes") -> DataFrame:
    """Adds the raw bytes of each row's ids, one token's after the other's."""
    ordered = sorted((rank, token) for token, rank in ranks.items())
    places = np.full(ordered[-1][0] + 1, -1, np.int32)
    places[[rank for rank, _ in ordered]] = np.arange(len(ordered))
    sent = encoded.sparkSession.sparkContext.broadcast((places, [token for _, token in ordered]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, tokens = sent.value
        table = pa.array(tokens, pa.binary())
        for batch in batches:
            column = batch.column(ids)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            if flat.size and (flat.min() < 0 or flat.max() >= len(places) or places[flat].min() < 0):
                raise ValueError("an id that the ranks do not have")
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
            taken = table.take(pa.array(places[flat]))
            ends = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, taken.offset * 4) if len(taken) else np.zeros(1, np.int32)
            starts = ends[offsets]  # where each row's bytes begin among the bytes of all tokens
            data = taken.buffers()[2] if len(taken) else pa.py_buffer(b"")
            raw = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(starts.astype(np.int32).tobytes()), data])
            yield pa.RecordBatch.from_arrays([*batch.columns, raw], [*batch.schema.names, name])

    shape = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{shape}, `{name}` binary")


def id_text(ids: str = "ids"):
    return F.concat_ws(" ", F.col(ids).cast("array<string>"))


def part_digests(parts: DataFrame) -> DataFrame:
    """(text_key, part, ids, bytes) -> text_key, n_tokens, ids_sha256, decoded_sha256.  The parts of a text come to a task in
    order and one at a time; only the state of the digests is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        names = ["text_key", "n_tokens", "ids_sha256", "decoded_sha256"]

        def row(key, state):
            return pa.RecordBatch.from_pylist([dict(zip(names, (key, state[0], state[1].hexdigest(), state[2].hexdigest())))])

        for batch in batches:
            for k, ids, raw in zip(*(batch.column(c) for c in ("text_key", "id_text", "bytes"))):
                k, ids, raw = k.as_py(), ids.as_py(), raw.as_py()
                if k != key:
                    if key is not None:
                        yield row(key, state)
                    key, state = k, [0, hashlib.sha256(), hashlib.sha256()]
                if ids:
                    state[1].update(((" " if state[0] else "") + ids).encode())
                    state[0] += ids.count(" ") + 1
                state[2].update(raw)
        if key is not None:
            yield row(key, state)

    ordered = parts.select("text_key", "part", id_text().alias("id_text"), "bytes")
    ordered = ordered.repartition("text_key").sortWithinPartitions("text_key", "part")
    return ordered.mapInArrow(run, "text_key string, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (decimal ids, one blank between), decoded_sha256 (decoded bytes)."""
    short, long_, parts = encode(docs, ranks, pattern, size, overlap)
    out = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    near = decode(short, ranks).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(id_text(), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))
    long_ = materialize(long_, "bpe-long")
    rows = long_.groupBy("text_key").agg(F.count("*").alias("rows"))
    far = materialize(part_digests(decode(parts, ranks)).join(rows, "text_key"), "bpe-digests")
    return near.unionByName(join_counts(long_, far, "text_key", "rows", out[1:]).select(*out))
