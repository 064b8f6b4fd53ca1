"""Benchmark decontamination: a hash set of benchmark word windows meets every word window of the documents.

DataFrame functions only.  Words are runs of digits, letters and whatever lies beyond ASCII, with A-Z lower-cased.  A
window is ``size`` consecutive words of an item; an item with fewer words is one window of all its words.  Document
words are hashed once, a window's key is the hash of its word hashes, and a key that meets the set is verified word by
word.  The set is broadcast if its rows and bytes were found to be small, else joined by a shuffle.

Defined cases: null and empty texts have no words and are never contaminated; null and repeated ids stay rows of their
own; an item without an id marks words but is not listed; items of equal id count once; without items nothing is hit;
other columns are ignored, and kept by :func:`clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faqloom.llm.common import ascii_lower, is_small
from faqloom.session import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def window_key(hashes: Column, start: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(hashes, start + i) for i in range(length)])


def keys_by_length(hashes: Column, start: Column, length: Column, lengths: list[int]) -> Column:
    out = F.lit(None).cast("bigint")
    for n in lengths:
        out = F.when(length == n, window_key(hashes, start, n)).otherwise(out)
    return out


def span_text(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def benchmark_windows(benchmark: DataFrame, size: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: length, key, window (its words) and the items that hold it."""
    words = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
    n = F.size("words")
    starts = words.filter(n > 0).select(
        "item", "words", F.least(n, F.lit(size)).alias("length"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.explode(F.sequence(F.lit(0), n - F.least(n, F.lit(size)))).alias("start"),
    )
    keyed = starts.select(
        "item",
        "length",
        keys_by_length(F.col("hashes"), F.col("start"), F.col("length"), list(range(1, size + 1))).alias("key"),
        span_text(F.col("words"), F.col("start"), F.col("length")).alias("window"),
    )
    return keyed.groupBy("length", "key", "window").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, windows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per distinct (doc_id, text): ``copies`` of the row, n_words, and ``found``: the verified windows as
    (start, length, items).  ``windows`` is a written table."""
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most the window size
    lengths = lengths[::-1] or [1]
    hashed = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.col(text), F.length(text)).alias("text_key"),
        words_of(F.col(text)).alias("words"),
    ).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    n, length = F.size("words"), F.col("length")
    # a row at -1 stands for the document itself, so that one pass gives counts and hits
    if len(lengths) == 1:
        sized = hashed.withColumn("length", F.lit(lengths[0]))
        starts = F.sequence(F.lit(-1), F.greatest(n - length, F.lit(-1)))
    else:
        sized = hashed.withColumn("length", F.explode(F.array(*[F.lit(x) for x in lengths])))
        starts = F.when(length == lengths[0], F.sequence(F.lit(-1), F.greatest(n - length, F.lit(-1)))).when(
            n >= length, F.sequence(F.lit(0), F.greatest(n - length, F.lit(0)))
        ).otherwise(F.array().cast("array<int>"))
    spans = sized.select("doc_id", "text_key", "words", "hashes", "length", F.explode(starts).alias("start"))
    start = F.col("start")
    spans = spans.withColumn(
        "key", F.when(start >= 0, keys_by_length(F.col("hashes"), start, length, lengths)).otherwise(F.col("text_key"))
    ).withColumn("key_length", F.when(start >= 0, length).otherwise(-1))  # documents' own rows meet nothing
    known = windows.select(F.col("key").alias("_key"), F.col("length").alias("_length"), "window", "items")
    same = (F.col("key") == F.col("_key")) & (F.col("key_length") == F.col("_length"))
    own = start < 0
    spans = spans.withColumn("n_words", F.when(own, n))
    if is_small(known):
        # the check of the words stands after the join: only what met the set gets there
        met = spans.join(F.broadcast(known), same, "left")
        return _gathered(met.filter(own | (F.col("window") == span_text(F.col("words"), start, length))), "items")
    # a set too large to send round: keys are shuffled without the texts, and hits meet their text once per document
    narrow = spans.select("doc_id", "text_key", "start", "length", "key", "key_length", "n_words")
    met = narrow.join(known.hint("merge"), same, "left").filter(own | F.col("window").isNotNull())
    per = materialize(_gathered(met, "items", "window"), "benchmark-met")
    texts = hashed.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text"), "words")
    mine = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_text"))
    some = per.filter(F.size("found") > 0)
    texts = texts.join(some.select("doc_id", "text_key").hint("merge"), mine, "left_semi").dropDuplicates(["_doc", "_text"])
    verified = F.filter("found", lambda f: f["window"] == span_text(F.col("words"), f["start"], f["length"]))
    checked = some.join(texts.hint("merge"), mine).withColumn("found", verified)
    return checked.select(*per.columns).unionByName(per.filter(F.size("found") == 0))


def _gathered(met: DataFrame, *fields: str) -> DataFrame:
    own = F.col("start") < 0
    return met.groupBy("doc_id", "text_key").agg(
        F.sum(own.cast("bigint")).alias("copies"),
        F.max("n_words").cast("bigint").alias("n_words"),
        F.collect_set(F.when(~own, F.struct("start", "length", *fields))).alias("found"),
    )


def report(docs: DataFrame, benchmark: DataFrame, size: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the ids in ``items``."""
    windows = materialize(benchmark_windows(benchmark, size), "benchmark-windows")
    per = hits(docs, windows, doc_id, text).withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    hit = F.array_distinct(
        F.flatten(F.transform("found", lambda f: F.sequence(f["start"], f["start"] + f["length"] - 1)))
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda f: f["items"]))))
    out = per.select("doc_id", "n_words", F.size(hit).cast("bigint").alias("n_hit"), items.alias("items"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "items",
    )


def clean(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, remove: str = "documents", doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The documents without contaminated ones, or (``remove="spans"``) with the hit words cut out of their texts.

    Hits are few against documents, yet not bounded, so they are joined by (id, text) and broadcast only if small.  Cut
    words go with the signs up to the next word; a text that lost words is otherwise as it was.
    """
    windows = materialize(benchmark_windows(benchmark, size), "benchmark-windows")
    found = materialize(hits(docs, windows, doc_id, text).filter(F.size("found") > 0), "benchmark-hits")
    found = found.select(F.col("doc_id").alias("_id"), "text_key", "found")
    found = F.broadcast(found) if is_small(found.drop("found")) and remove == "documents" else found.hint("merge")
    packed = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.col(doc_id).alias("_doc"),
        F.col(text).alias("_text"),
        F.xxhash64(F.col(text), F.length(text)).alias("_text_key"),
    )
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("text_key"))
    if remove == "documents":
        return packed.join(found, same, "left_anti").select("_row.*")
    joined = packed.join(found, same, "left")
    hit = F.array_distinct(
        F.flatten(F.transform("found", lambda f: F.sequence(f["start"], f["start"] + f["length"] - 1)))
    )
    parts = joined.select(
        "_row",
        hit.alias("hit"),
        F.regexp_extract_all("_text", F.lit(WORD_ANY), F.lit(0)).alias("words"),
        F.split("_text", WORD_ANY).alias("gaps"),
    )
    kept = F.transform(
        F.col("words"),
        lambda w, i: F.when(F.array_contains("hit", i), F.lit("")).otherwise(F.concat(w, F.get("gaps", i + 1))),
    )
    whole = F.concat(F.get("gaps", F.lit(0)), F.array_join(kept, ""))
    new = F.when(F.col("hit").isNull(), F.col(f"_row.`{text}`")).otherwise(whole)
    return parts.select(*[new.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


#: The words as they stand in a text that is not lower-cased.
WORD_ANY = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(words), 10) AS n,
    unnest([list_slice(words, i + 1, i + least(len(words), 10)) FOR i IN range(0, len(words) - least(len(words), 10) + 1)]) AS win
  FROM b WHERE len(words) > 0),
dw AS (
  SELECT rid, n, i, list_slice(words, i + 1, i + n) AS win
  FROM (SELECT rid, words, n, unnest(range(0, len(words) - n + 1)) AS i
        FROM w, (SELECT DISTINCT n FROM bw) WHERE len(words) >= n)),
h AS (SELECT rid, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
t AS (
  SELECT rid, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
