"""Examples and padded model features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faqloom.functions.text import basic_token_array
from faqloom.operators.lookup import lookup
from faqloom.operators.tokens import distinct_words, wordpiece_dictionary
from faqloom.operators.vocab import id_of
from faqloom.session import materialize

PAD_ID = 0


def label_list(literal: Column) -> Column:
    """``"[3, 17]"`` to an array of label numbers."""
    return F.from_json(literal, "array<int>")


def examples(rows: DataFrame, labels_available: bool = True) -> DataFrame:
    """Labelled question rows (guid, class literal, question) to guid, text_a, labels."""
    labels = label_list(F.col("class")) if labels_available else F.array().cast("array<int>")
    return rows.select("guid", F.col("question").alias("text_a"), labels.alias("labels"))


def multi_hot(labels: Column, width: int) -> Column:
    """0/1 vector of the set labels; a repeated label counts once."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.array_contains(labels, i).cast("int"))


def drop_stop_words(tokens: DataFrame, stop_words: Sequence[str], column: str = "token") -> DataFrame:
    return tokens.filter(~F.col(column).isin(list(stop_words)))


def truncate_single(tokens: Column, max_len: int) -> Column:
    """Room for the two markers."""
    return F.slice(tokens, 1, max_len - 2)


def pair_lengths(la: Column, lb: Column, room: int) -> tuple[Column, Column]:
    """Kept lengths when tokens are popped off the longer list (off the second on a tie) until both fit."""
    keep_a = F.least(la, F.greatest(F.lit((room + 1) // 2), F.lit(room) - lb))
    keep_b = F.least(lb, F.greatest(F.lit(room // 2), F.lit(room) - la))
    return keep_a, keep_b


def side_tokens(texts: DataFrame, key: str, tokenizer=basic_token_array) -> DataFrame:
    """Token rows of both sides of each text pair; a text without tokens keeps one empty row."""
    sides = texts.select(
        key,
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("text_a").alias("text")),
                F.struct(F.lit(1).alias("side"), F.col("text_b").alias("text")),
            )
        ),
    )
    return sides.select(key, "side", F.posexplode_outer(tokenizer(F.col("text"))).alias("pos", "token"))


def piece_id_lists(
    texts: DataFrame,
    vocab: DataFrame,
    longest_piece: int,
    key: str = "guid",
    stop_words: Sequence[str] = (),
    tokenizer=basic_token_array,
) -> DataFrame:
    """Piece ids of both sides: key, ids_a, ids_b.  Stop words are dropped piece by piece, on the first side only."""
    tokens = side_tokens(texts, key, tokenizer)
    words = wordpiece_dictionary(distinct_words(tokens.filter("token IS NOT NULL")), vocab, longest_piece)
    kept = F.filter(
        F.arrays_zip("pieces", "ids"), lambda p: ~p["pieces"].isin(list(stop_words)) if stop_words else F.lit(True)
    )
    words = words.select(F.col("word").alias("token"), "n", "ids", F.transform(kept, lambda p: p["ids"]).alias("kept"))
    pieced = lookup(tokens, materialize(words, "pieces"), "token", ["ids", "kept"], "n")

    def side(number: int, ids: str) -> Column:
        mine = F.when((F.col("side") == number) & F.col(ids).isNotNull(), F.struct("pos", F.col(ids).alias("ids")))
        return F.flatten(F.transform(F.sort_array(F.collect_list(mine)), lambda s: s["ids"]))

    return pieced.groupBy(key).agg(side(0, "kept").alias("ids_a"), side(1, "ids").alias("ids_b"))


def bert_features(
    texts: DataFrame,
    vocab: DataFrame,
    longest_piece: int,
    max_len: int,
    stop_words: Sequence[str] = (),
    truncate: bool = True,
    on_overflow: str = "error",
    key: str = "guid",
    tokenizer=basic_token_array,
) -> DataFrame:
    """``[CLS] a [SEP] (b [SEP])`` as equal-length id, mask and segment arrays.

    ``texts`` holds the key, ``text_a`` and ``text_b`` (null or empty for single texts).  Without truncation a row that
    does not fit is an error, or with ``on_overflow='reject'`` a row with ``too_long`` set and null arrays.
    """
    start, end = id_of(vocab, "[CLS]"), id_of(vocab, "[SEP]")
    lists = piece_id_lists(texts, vocab, longest_piece, key, stop_words, tokenizer)
    is_pair = F.coalesce(F.length("text_b"), F.lit(0)) > 0
    rows = texts.select(key, is_pair.alias("is_pair")).join(lists, key)
    if truncate:
        keep_a, keep_b = pair_lengths(F.size("ids_a"), F.size("ids_b"), max_len - 3)
        rows = rows.withColumns({
            "ids_a": F.when(F.col("is_pair"), F.slice("ids_a", F.lit(1), keep_a)).otherwise(
                truncate_single(F.col("ids_a"), max_len)),
            "ids_b": F.slice("ids_b", F.lit(1), keep_b),
        })
    has_b = F.size("ids_b") > 0
    rows = rows.select(
        key,
        F.concat(
            F.array(F.lit(start)), "ids_a", F.array(F.lit(end)),
            F.when(has_b, F.concat("ids_b", F.array(F.lit(end)))).otherwise(F.array().cast("array<int>")),
        ).alias("ids"),
        (F.size("ids_a") + 2).alias("n_a"),
    )
    rows = rows.withColumn("n", F.size("ids")).withColumn("too_long", F.col("n") > max_len)
    unknown = F.exists("ids", lambda i: i.isNull())
    ids = F.when(unknown, F.raise_error(F.lit("no unknown token in the vocabulary")).cast("array<int>")).otherwise(
        F.col("ids"))
    if on_overflow == "error":
        note = F.concat(F.lit("sequence too long: "), F.col("n").cast("string"), F.lit(f" > {max_len}"))
        ids = F.when(F.col("too_long"), F.raise_error(note).cast("array<int>")).otherwise(ids)

    def ones(count: Column) -> Column:
        return F.array_repeat(F.lit(1), count)

    def zeros(count: Column) -> Column:
        return F.array_repeat(F.lit(PAD_ID), count)

    pad = zeros(F.greatest(F.lit(max_len) - F.col("n"), F.lit(0)))
    fits = ~F.col("too_long")
    return rows.select(
        key,
        F.when(fits | F.lit(on_overflow == "error"), F.concat(ids, pad)).alias("input_ids"),
        F.when(fits, F.concat(ones(F.col("n")), pad)).alias("input_mask"),
        F.when(fits, F.concat(zeros(F.col("n_a")), ones(F.col("n") - F.col("n_a")), pad)).alias("segment_ids"),
        "too_long",
    )


def with_labels(features: DataFrame, labelled: DataFrame, width: int, key: str = "guid") -> DataFrame:
    """Join the float label vector to the features."""
    vector = multi_hot(F.col("labels"), width).cast("array<float>")
    return features.join(labelled.select(key, vector.alias("label_ids")), key)
