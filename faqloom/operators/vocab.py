"""Vocabularies: counting, building, reading, encoding and decoding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from faqloom.operators.lookup import lookup
from faqloom.operators.ordering import quantile_buckets, running_total
from faqloom.session import task_width

EXACT_COUNTS = 64
#: Tokens that a task counts before it hands on the counts; the larger a part, the fewer rows it has for each token.
PART_TOKENS = 1 << 22


def token_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def counts_with_first_place(tokens: DataFrame, place: Sequence[str]) -> DataFrame:
    """Token counts with the place each token was first seen at (ties in the ranking go by it)."""
    return tokens.groupBy("token").agg(
        F.count("*").alias("cnt"), F.min(F.struct(*place)).alias("first")
    )


def counts_of_lists(lists: DataFrame, place: Sequence[str], column: str = "tokens") -> DataFrame:
    """The counts of :func:`counts_with_first_place` for lists of tokens (``place``, ``column``), with ``pos`` as the last field.

    Tasks count some four million tokens at a time, so that only a token's sum and first place in each such part is shuffled, once
    and to as many tasks as the lists ask for, and never a row per token.
    """
    place = list(place)
    parts = lists.select(*place, column).mapInArrow(
        lambda batches: _counted(batches, place, column),
        StructType([lists.schema[c] for c in place]).add("pos", IntegerType()).add("token", StringType()).add("n", LongType()))
    first = F.min(F.struct(*place, "pos")).alias("first")
    return parts.repartition(task_width(lists), "token").groupBy("token").agg(F.sum("n").alias("cnt"), first)


def _counted(batches: Iterator[pa.RecordBatch], place: list[str], column: str) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.list_value_length(batch.column(column))).as_py() or 0
        if size >= PART_TOKENS:
            yield from _part_counts(pa.Table.from_batches(held), place, column).to_batches()
            held, size = [], 0
    if size:
        yield from _part_counts(pa.Table.from_batches(held), place, column).to_batches()


def _part_counts(rows: pa.Table, place: list[str], column: str) -> pa.Table:
    """place, pos, token, n: each token of the lists with its first place and its number."""
    order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in place], null_placement="at_start").to_numpy()
    lists = rows.column(column).combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    words = lists.flatten().dictionary_encode()
    codes, n = words.indices.to_numpy(zero_copy_only=False), len(words.dictionary)
    # words stay where they are, only their numbers are put in the order of the places
    ordered = sizes[order]
    ends, starts = np.cumsum(ordered, dtype=np.int64), (np.cumsum(sizes, dtype=np.int64) - sizes)[order]
    codes = codes[np.arange(len(codes)) + np.repeat(starts - ends + ordered, ordered)]
    first = np.empty(n, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]  # of equal codes the last one written is the first one
    row = np.searchsorted(ends, first, side="right")
    pos = first - (ends - ordered)[row]
    out = rows.select(place).take(pa.array(order[row])).append_column("pos", pa.array(pos.astype(np.int32)))
    return out.append_column("token", words.dictionary).append_column("n", pa.array(np.bincount(codes, minlength=n).astype(np.int64)))


def build_vocab(
    counted: DataFrame, specials: Sequence[str] = (), max_size: int | None = None, min_freq: int = 0
) -> DataFrame:
    """Specials first, then the most common tokens: token, id, cnt.

    The cut at ``max_size`` comes before specials are taken out of the ranking, the cut at ``min_freq`` after it.
    Ranks are worked out per bucket of (count, first document), because half of a natural vocabulary has a count of one.
    """
    specials = list(dict.fromkeys(specials))
    spark = counted.sparkSession
    order = [F.desc("cnt"), F.asc("first")]
    kept = (F.col("cnt") >= min_freq) & ~F.col("token").isin(specials)
    rest = counted if max_size is not None else counted.filter(kept)
    rest = rest.withColumn("_first", F.col("first").getField(counted.schema["first"].dataType.names[0]))
    rest = quantile_buckets(rest, "_first", "_doc")
    rare = F.col("cnt") <= EXACT_COUNTS
    rest = rest.withColumns({
        "_size": -F.when(rare, F.col("cnt")).otherwise(EXACT_COUNTS + F.floor(F.log2("cnt"))),
        "_doc": F.when(rare, F.col("_doc")).otherwise(0),
    })
    ranked = running_total(rest, F.lit(1), order, ["_size", "_doc"], "_rank")
    if max_size is not None:
        inside = ranked.filter(F.col("_rank") < max_size).drop("_rank")
        ranked = running_total(inside, kept.cast("int"), order, ["_size", "_doc"], "_rank").filter(kept)
    ranked = ranked.withColumn("id", (F.col("_rank") + len(specials)).cast("int"))
    words = ranked.select("token", "id", "cnt")
    if not specials:
        return words
    head = spark.createDataFrame([(t, i) for i, t in enumerate(specials)], "token string, id int")
    known = counted.filter(F.col("token").isin(specials)).select("token", "cnt")
    head = head.join(known, "token", "left").select("token", "id", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    return head.unionByName(words)


def vocab_from_lines(numbered: DataFrame) -> DataFrame:
    """Token per line, id = line number; of a repeated token the last line counts."""
    stripped = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    return numbered.groupBy(stripped.alias("token")).agg(F.max("line_no").cast("int").alias("id"))


def vocab_from_first_field(numbered: DataFrame) -> DataFrame:
    """First field per line, dense ids by first appearance; there must be an unknown token, and no empty line."""
    field = F.get(F.split(F.regexp_replace("line", r"(?U)^\s+|\s+$", ""), r"(?U)\s+"), F.lit(0))
    token = F.when(field != "", field).otherwise(F.raise_error(F.lit("vocabulary line without a token")))
    first = numbered.groupBy(token.alias("token")).agg(F.min("line_no").alias("_line"))
    cut = quantile_buckets(first, "_line", "_b")
    ranked = running_total(cut, F.lit(1), ["_line"], ["_b"], "_rank")
    return ranked.select("token", F.col("_rank").cast("int").alias("id"))


def require_unknown(vocab: DataFrame, names: Sequence[str] = ("<UNK>", "<unk>")) -> str:
    """The unknown token of a vocabulary (the first of ``names`` it holds); an error if there is none."""
    held = {r[0] for r in vocab.filter(F.col("token").isin(*names)).select("token").distinct().limit(len(names)).collect()}
    for name in names:
        if name in held:
            return name
    raise ValueError("no unknown token in the vocabulary")


def append_specials(vocab: DataFrame, specials: Sequence[str]) -> DataFrame:
    """Byte-pair style: special tokens get the ids that follow the vocabulary, in their own order."""
    size = vocab.count()
    tail = vocab.sparkSession.createDataFrame([(t, size + i) for i, t in enumerate(specials)], "token string, id int")
    return vocab.select("token", "id").unionByName(tail)


def bpe_merges(merge_lines: DataFrame) -> DataFrame:
    """Merge table from numbered lines: the header line and the piece behind the last line end are dropped,
    the rank is the order: left, right, rank."""
    parts = F.split("line", r"\s+")
    return merge_lines.filter((F.col("line_no") > 0) & (F.col("line") != "")).select(
        parts[0].alias("left"), parts[1].alias("right"), (F.col("line_no") - 1).cast("int").alias("rank")
    )


def encode(
    tokens: DataFrame, vocab: DataFrame, unknown: str = "error", weight: str = "cnt", unknown_id: int | None = None
) -> DataFrame:
    """Token rows with their ``id``.

    Out-of-vocabulary rule: ``error``; ``zero`` (id 0); or ``token`` (the id of the unknown token, ``unknown_id``).
    """
    entries = vocab if weight in vocab.columns else vocab.withColumn(weight, -F.col("id"))
    coded = lookup(tokens, entries, "token", ["id"], weight)
    if unknown == "zero":
        return coded.withColumn("id", F.coalesce("id", F.lit(0)))
    if unknown == "token":
        if unknown_id is None:
            raise ValueError("no unknown token in the vocabulary")
        return coded.withColumn("id", F.coalesce("id", F.lit(unknown_id)))
    missing = F.raise_error(F.concat(F.lit("token not in the vocabulary: "), F.col("token"))).cast("int")
    return coded.withColumn("id", F.when(F.col("id").isNotNull(), F.col("id")).otherwise(missing))


def id_of(vocab: DataFrame, token: str) -> int:
    row = vocab.filter(F.col("token") == token).select("id").first()
    if row is None:
        raise ValueError(f"{token} is not in the vocabulary")
    return row[0]


def decode(coded: DataFrame, vocab: DataFrame, weight: str = "cnt") -> DataFrame:
    """Id rows with their ``token``; an id outside the vocabulary is an error."""
    entries = vocab if weight in vocab.columns else vocab.withColumn(weight, -F.col("id"))
    named = entries.select(F.col("id").cast("string").alias("_key"), "token", weight)
    out = lookup(coded.withColumn("_key", F.col("id").cast("string")), named, "_key", ["token"], weight)
    missing = F.raise_error(F.concat(F.lit("id out of vocabulary range: "), F.col("_key")))
    return out.withColumn("token", F.when(F.col("token").isNotNull(), F.col("token")).otherwise(missing)).drop("_key")


def gather(rows: DataFrame, value: str, key: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Collect the values of one line (or text) in order; a group is never longer than the text it came from."""
    packed = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return rows.groupBy(*key).agg(packed.alias("_p")).select(
        *key, F.transform("_p", lambda s: s["_v"]).alias(name)
    )


def with_length_limit(df: DataFrame, ids: str, max_len: int) -> DataFrame:
    """Sequences over the model's length are an error."""
    note = F.concat(F.lit("sequence too long: "), F.size(ids).cast("string"), F.lit(f" > {max_len}"))
    checked = F.when(F.size(ids) <= max_len, F.col(ids)).otherwise(F.raise_error(note).cast("array<int>"))
    return df.withColumn(ids, checked)


# Tidy-up replacements after byte-pair decoding, in this order.
TIDY_STEPS = [
    ("<unk>", ""), (" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ,", ","), (" n't", "n't"), (" 'm", "'m"),
    (" 're", "'re"), (" do not", " don't"), (" 's", "'s"), (" t ", "'t "), (" s ", "'s "), (" m ", "'m "),
    (" 've", "'ve"),
]


def words_to_text(tokens):
    return F.array_join(tokens, " ")


def pieces_to_text(tokens, tidy: bool = False):
    text = F.btrim(F.replace(F.array_join(tokens, ""), F.lit("</w>"), F.lit(" ")))
    if tidy:
        for old, new in TIDY_STEPS:
            text = F.replace(text, F.lit(old), F.lit(new))
    return text


def vocab_summary(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Vocabulary size next to the number of distinct tokens it was built from."""
    size = vocab.select(F.lit(1).alias("v"), F.lit(0).alias("d"))
    seen = token_counts(tokens).select(F.lit(0).alias("v"), F.lit(1).alias("d"))
    return size.unionByName(seen).agg(F.sum("v").alias("vocab_size"), F.sum("d").alias("n_distinct"))


def vocab_bands(vocab: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    """Frequency bands ``[l, r)`` of ids: how many vocabulary entries and running tokens each holds, and its share."""
    borders = [0, *cutoffs]
    band = F.lit(len(borders) - 1)
    for i in reversed(range(len(borders) - 1)):
        band = F.when(F.col("id") < borders[i + 1], F.lit(i)).otherwise(band)
    per_band = vocab.groupBy(band.alias("band")).agg(
        F.count("*").alias("n_ids"), F.sum("cnt").alias("n_tokens"), F.min("id").alias("first_id")
    )
    whole = Window.partitionBy()
    return per_band.withColumn("share", F.round(F.col("n_tokens") / F.sum("n_tokens").over(whole), 6))


