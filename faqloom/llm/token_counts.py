"""Token counts behind a digest cache.

A text's digest (SHA-256 of its UTF-8 bytes) and the tokenizer's version (SHA-256 of its file) name a stored count.  Texts
whose pair the cache lacks are brought down to one row per digest before they move, encoded once, and appended to the
cache; then every document takes its count from there.  The text is not changed for the digest: the tokenizer sees every
byte, so texts that differ anywhere may differ in tokens.  Special strings inside a text are handled as the library does
by default, no token is added, nothing is truncated or padded.

Defined cases: a null text is the empty text with 0 bytes and 0 tokens; null and repeated ids and repeated rows stay rows
of their own; an empty table gives an empty result and appends nothing; other columns are ignored.

A cache is a folder of Parquet files.  Appending twice after a lost job may store a pair twice; pairs are read once each.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faqloom.llm.common import join_counts
from faqloom.session import materialize

CACHE_SCHEMA = "digest string, version string, n_tokens bigint"
#: Longer texts are cut where the tokenizer's own word rule always cuts, so that the encoder's memory is bounded.
PIECE_CHARS = 1 << 18
#: A blank between two letters starts a new word under the byte-level rule, whatever stands around.
CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_LOADED: dict[str, object] = {}


def version_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _tokenizer(name: str):
    if name not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(SparkFiles.get(name))
        loaded.no_truncation()
        loaded.no_padding()
        _LOADED[name] = loaded
    return _LOADED[name]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about ``size`` characters whose token counts add up to the whole text's."""
    start = 0
    while len(text) - start > size:
        cut = CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def count_tokens(texts: list[str], tokenizer, whole: bool) -> list[int]:
    parts = [[t] if whole or len(t) <= PIECE_CHARS else list(pieces(t)) for t in texts]
    flat = tokenizer.encode_batch_fast([p for ps in parts for p in ps], add_special_tokens=False)
    sizes = iter(len(e) for e in flat)
    return [sum(next(sizes) for _ in ps) for ps in parts]


def encode_misses(misses: DataFrame, tokenizer_path: str) -> DataFrame:
    """(digest, text) -> (digest, n_tokens).  The vocabulary file goes to the executors with the job."""
    name = os.path.basename(tokenizer_path)
    misses.sparkSession.sparkContext.addFile(tokenizer_path)
    with open(tokenizer_path, encoding="utf-8") as f:
        whole = not re.search(r'"pre_tokenizer":\s*\{\s*"type":\s*"ByteLevel"', f.read())  # another rule: no cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(name)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                counts = count_tokens(part.column("text").to_pylist(), tokenizer, whole)
                yield pa.RecordBatch.from_arrays(
                    [part.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"]
                )

    return misses.mapInArrow(run, "digest string, n_tokens bigint")


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The stored counts of a tokenizer version: digest, n_tokens."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return stored.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame, tokenizer_path: str, cache: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    version = version_of(tokenizer_path)
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = whole.withColumn("digest", F.sha2("text", 256))
    narrow = materialize(
        keyed.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")), "token-digests"
    )
    rows = narrow.groupBy("digest").agg(F.count("*").alias("rows"))
    known = read_cache(spark, cache, version)
    missing = materialize(rows.join(known, "digest", "left_anti"), "token-misses")
    if missing.take(1):
        # of a text's copies in a task one moves on, so a text that fills a third of the table is no hot key
        texts = keyed.join(known.select("digest"), "digest", "left_anti") if known.take(1) else keyed
        distinct = texts.groupBy("digest").agg(F.first("text").alias("text"))
        new = encode_misses(distinct, tokenizer_path).withColumn("version", F.lit(version))
        new.select("digest", "version", "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache, version).join(rows, "digest")
    counts = materialize(counts, "token-counts")
    out = join_counts(narrow, counts, "digest", "rows", ["n_tokens"])
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
