"""Token tables: basic and word-level tokens, sub-word pieces, byte-pair pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faqloom.functions.repair import repair_text
from faqloom.functions.segment import segment_words
from faqloom.functions.text import basic_token_array, standardize_text, word_token_array
from faqloom.functions.unicode_rules import bind
from faqloom.operators.lookup import fits_broadcast, lookup, lookup_lists, small_side
from faqloom.session import bucket_count, materialize

#: A match is coded with ten bits for its end.
LONGEST_CODED = 1023
MAX_WORD_CHARS = 100
UNKNOWN_PIECE = "[UNK]"
END_OF_WORD = "</w>"
#: No piece holds it.
PIECE_MARK = "\x01"


def token_rows(df: DataFrame, tokens: Column, *keep: str) -> DataFrame:
    """One row per token: ``keep``, ``pos`` from 0, ``token``."""
    return df.select(*keep, F.posexplode(tokens).alias("pos", "token"))


def basic_tokens(df: DataFrame, *keep: str, text: str = "line", lower: bool = True) -> DataFrame:
    return token_rows(df, basic_token_array(F.col(text), lower), *keep)


def word_tokens(df: DataFrame, *keep: str, text: str = "line", **options) -> DataFrame:
    return token_rows(df, word_token_array(F.col(text), **options), *keep)


def bpe_texts(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Lower-cased words of repaired, standardised and segmented text, ready for byte-pair splitting: ``keep``, ``words``."""
    words = segment_words(standardize_text(repair_text(F.col(text))))
    return df.select(*keep, F.transform(words, F.lower).alias("words"))


def bpe_words(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The words of :func:`bpe_texts`, one row each."""
    return token_rows(bpe_texts(df, *keep, text=text), F.col("words"), *keep)


def distinct_words(tokens: DataFrame, word: str = "token") -> DataFrame:
    """Each distinct word once, with its count: the unit of work of the sub-word tokenizers.

    The counted words are small next to the work that follows on each, so they are spread by a fixed number of
    partitions, which run-time coalescing leaves alone; later groupings by word reuse that partitioning.
    """
    counted = tokens.groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n"))
    return counted.repartition(bucket_count(tokens.sparkSession), "word")


def wordpiece_dictionary(
    words: DataFrame, vocab: DataFrame, longest_piece: int, max_chars: int = MAX_WORD_CHARS
) -> DataFrame:
    """Greedy longest-match pieces of distinct words: word, n, pieces, ids.

    Every substring that could be a piece is looked up in the vocabulary by one equi-join; a word's matches, sorted by
    start and then longest first, are walked once: a match that starts where the last piece ended is taken.  A word
    that cannot be covered, or is too long, becomes one unknown piece.
    """
    if max_chars > LONGEST_CODED:
        raise ValueError(f"words of more than {LONGEST_CODED} characters cannot be split to pieces")
    n = F.length("word")
    # start -1 asks for the unknown piece itself, so its id comes out of the same join
    ask = F.array(F.lit(-1))
    starts = words.withColumn(
        "start", F.explode(F.when(n > max_chars, ask).otherwise(F.concat(ask, F.sequence(F.lit(1), n))))
    )
    ends = F.sequence(F.col("start"), F.least(n, F.col("start") + longest_piece - 1))
    spans = starts.withColumn("end", F.explode(F.when(F.col("start") < 0, ask).otherwise(ends)))
    spans = spans.withColumn(
        "piece",
        F.when(F.col("start") < 0, F.lit(UNKNOWN_PIECE)).otherwise(
            F.concat(
                F.when(F.col("start") > 1, F.lit("##")).otherwise(F.lit("")),
                F.expr("substring(word, start, end - start + 1)"),
            )
        ),
    )
    # a vocabulary without the unknown piece still gives every word its row
    spare = vocab.sparkSession.createDataFrame([(UNKNOWN_PIECE, None)], "piece string, id int")
    entries = vocab.select(F.col("token").alias("piece"), F.col("id").cast("int").alias("id")).unionByName(spare)
    hits = spans.join(small_side(entries.groupBy("piece").agg(F.max("id").alias("id"))), "piece")
    # a match as one number that sorts by start, then longest first: start, 1023 - end, id
    code = F.expr(
        "shiftleft(CAST(greatest(start, 0) AS BIGINT), 42) + shiftleft(CAST(1023 - greatest(end, 0) AS BIGINT), 32)"
        " + coalesce(id, 4294967295)"
    )
    per_word = hits.groupBy("word", "n").agg(F.sort_array(F.collect_list(code)).alias("matches"))
    walked = F.expr("""
        aggregate(filter(matches, m -> m >= shiftleft(1L, 42)), named_struct('at', 1, 'taken', cast(array() AS array<bigint>)),
          (s, m) -> CASE WHEN s.at = shiftright(m, 42)
            THEN named_struct('at', CAST(1024 - (shiftright(m, 32) & 1023) AS INT), 'taken', concat(s.taken, array(m)))
            ELSE s END)""")
    id_in = "CAST(nullif({} & 4294967295, 4294967295) AS INT)"
    done = per_word.withColumn("walk", walked).withColumn("whole", F.expr("walk.at = length(word) + 1"))
    pieces = F.expr("""transform(walk.taken, m -> concat(CASE WHEN shiftright(m, 42) > 1 THEN '##' ELSE '' END,
        substring(word, CAST(shiftright(m, 42) AS INT), CAST(1024 - (shiftright(m, 32) & 1023) - shiftright(m, 42) AS INT))))""")
    return done.select(
        "word",
        "n",
        F.when(F.col("whole"), pieces).otherwise(F.array(F.lit(UNKNOWN_PIECE))).alias("pieces"),
        F.when(F.col("whole"), F.expr(f"transform(walk.taken, m -> {id_in.format('m')})"))
        .otherwise(F.array(F.expr(id_in.format("matches[0]")))).alias("ids"),
    )


def counted_words(counted: DataFrame, word: str = "token", n: str = "n") -> DataFrame:
    """The distinct words of a written count table, spread like those of :func:`distinct_words`."""
    words = counted.select(F.col(word).alias("word"), F.col(n).alias("n"))
    return words.repartition(bucket_count(counted.sparkSession), "word")


def piece_table(words: DataFrame, vocab: DataFrame, longest_piece: int) -> DataFrame:
    """The pieces of distinct words (word, n), written once: token, n, pieces, ids."""
    return materialize(wordpiece_dictionary(words, vocab, longest_piece).withColumnRenamed("word", "token"), "pieces", "zstd")


def wordpieces(tokens: DataFrame, vocab: DataFrame, longest_piece: int, words: DataFrame | None = None) -> DataFrame:
    """Replace the ``token`` of each row by its ``pieces`` and ``ids`` arrays.
    ``words`` are the distinct words of the tokens where they are counted already."""
    words = piece_table(distinct_words(tokens) if words is None else words, vocab, longest_piece)
    return lookup(tokens, words, "token", ["pieces", "ids"], "n")


def wordpieces_of_lists(lists: DataFrame, pieces: DataFrame, *keep: str) -> DataFrame:
    """``keep``, ``pos``, ``pieces`` of every token of the lists (``keep``, tokens), from a table of :func:`piece_table`.

    A table that was found to be small is sent to the token rows.  Beyond that whole lists meet it, so that no token row
    crosses the network, and only then become rows.
    """
    slim = pieces.select("token", "pieces", "n")
    if fits_broadcast(slim):
        return lookup(token_rows(lists, F.col("tokens"), *keep), slim, "token", ["pieces"], "n").select(*keep, "pos", "pieces")
    joined = slim.select("token", F.array_join("pieces", PIECE_MARK).alias("joined"))
    met = lookup_lists(lists.select(*keep, "tokens").filter(F.size("tokens") > 0), "tokens", joined, "token", "joined", "met")
    return met.select(*keep, F.posexplode("met").alias("pos", "m")).select(*keep, "pos", F.split("m", PIECE_MARK).alias("pieces"))


def piece_rows(pieced: DataFrame, *keep: str) -> DataFrame:
    """Piece table: ``keep``, ``pos`` of the word, ``piece_no`` inside it, ``token``."""
    return pieced.select(*keep, "pos", F.posexplode("pieces").alias("piece_no", "token"))


def adjacent_pairs(words: DataFrame) -> DataFrame:
    """How many words hold each adjacent symbol pair (a pair counts once per word), weighted by word frequency."""
    symbols = words.select("n", word_symbols(F.col("word")).alias("s")).filter(F.size("s") > 1)
    pairs = F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.size("s") - 1),
            lambda i: F.struct(
                F.element_at("s", i).alias("left"), F.element_at("s", i + 1).alias("right")
            ),
        )
    )
    return (
        symbols.select("n", F.explode(pairs).alias("p"))
        .groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right"))
        .agg(F.sum("n").alias("n"))
    )


def word_symbols(word: Column) -> Column:
    """The characters of a word, the last one marked as the end of the word."""
    chars = F.filter(F.split(word, ""), lambda c: c != "")
    last = F.concat(F.element_at(chars, -1), F.lit(END_OF_WORD))
    return F.when(F.size(chars) > 1, F.concat(F.slice(chars, F.lit(1), F.size(chars) - 1), F.array(last))).otherwise(
        F.array(last)
    )


def symbol_runs(words: DataFrame, longest: int) -> DataFrame:
    """Every run of 2 to ``longest`` symbols of each word, cut ahead of its last symbol: the word's columns, left, right."""
    runs = words.filter(F.length("word") > 1).withColumn("start", F.explode(F.expr("sequence(1, length(word) - 1)")))
    ends = F.expr(f"sequence(start + 1, least(length(word), start + {longest} - 1))")
    runs = runs.withColumn("end", F.explode(ends))
    last = F.expr("substring(word, end, 1)")
    right = F.when(F.col("end") == F.length("word"), F.concat(last, F.lit(END_OF_WORD))).otherwise(last)
    return runs.select(*words.columns, F.expr("substring(word, start, end - start)").alias("left"), right.alias("right"))


def bpe_dictionary(words: DataFrame, merges: DataFrame, longest_merge: int) -> DataFrame:
    """Byte-pair pieces of distinct words: word, n, pieces.

    A merge can only ever apply to a word that holds its joined text, so one equi-join of the words' symbol runs with
    the merge table (left, right, rank) brings each word the few merges that matter to it.  The merge loop then runs
    inside the word, on its symbols written as one string with marks around each: the best-ranked pair that occurs is
    replaced at all its places, left to right, until none occurs.
    ``longest_merge`` is the longest merged symbol, counted in symbols.
    """
    runs = symbol_runs(words, longest_merge).select("word", F.concat("left", "right").alias("joined"))
    table = merges.select(
        F.concat("left", "right").alias("joined"),
        F.struct(
            "rank",
            F.concat(F.lit("\x01"), "left", F.lit("\x02\x01"), "right", F.lit("\x02")).alias("pair"),
            F.concat(F.lit("\x01"), "left", "right", F.lit("\x02")).alias("one"),
        ).alias("merge"),
    )
    per_word = runs.join(small_side(table), "joined").groupBy("word").agg(F.sort_array(F.collect_list("merge")).alias("merges"))
    merged = words.withColumn("s", word_symbols(F.col("word"))).join(per_word, "word", "left")
    wrapped = F.array_join(F.transform("s", lambda c: F.concat(F.lit("\x01"), c, F.lit("\x02"))), "")

    def step(text: Column, _) -> Column:
        best = F.get(F.filter("merges", lambda m: F.contains(text, m["pair"])), F.lit(0))
        return bind(best, lambda m: F.when(m.isNull(), text).otherwise(F.replace(text, m["pair"], m["one"])))

    done = F.aggregate(F.sequence(F.lit(1), F.size("s")), wrapped, step)
    pieces = F.regexp_extract_all(done, F.lit("[^\x01\x02]+"), F.lit(0))
    return merged.select("word", "n", F.when(F.col("merges").isNull(), F.col("s")).otherwise(pieces).alias("pieces"))
