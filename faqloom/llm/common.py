"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is broadcast up to this many rows and bytes of row data, both counted beforehand.
SMALL_ROWS = 100_000
SMALL_BYTES = 8 << 20
SALTS = 64
HOT_KEYS = 1000

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def word_count(text: Column) -> Column:
    """Runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def is_small(df: DataFrame) -> bool:
    """Whether a written table may be broadcast; every task adds up its own rows."""
    rows, size = df.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()
    return rows <= SMALL_ROWS and (size or 0) <= SMALL_BYTES


def join_dimension(facts: DataFrame, dims: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with a written table of unique keys: broadcast if it was found to be small, else by a salted shuffle, so that
    a key with a third of all facts is spread over ``SALTS`` tasks."""
    if is_small(dims):
        return facts.join(F.broadcast(dims), keys, how)
    spread = F.xxhash64(*[F.col(c) for c in facts.columns])  # from the row itself: a repeated task deals out alike
    salted = facts.withColumn("_salt", F.pmod(spread, F.lit(SALTS)).cast("int"))
    copies = dims.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def join_counts(facts: DataFrame, entries: DataFrame, key: str, rows: str, values: list[str]) -> DataFrame:
    """Left join of a large table with a large one of unique keys.  ``rows`` of an entry tells how many facts have its
    key: the ``HOT_KEYS`` heaviest entries, a fixed number, are broadcast; any other key has less than a thousandth of
    the facts and goes through a plain shuffle."""
    slim = entries.select(key, *values)
    if is_small(slim):
        return facts.join(F.broadcast(slim), key, "left")
    hot = entries.filter(F.col(rows) > 1).orderBy(F.desc(rows), key).limit(HOT_KEYS)
    hot = hot.select(key, F.struct(*values).alias("_hot"))
    marked = facts.join(F.broadcast(hot), key, "left")
    plain = marked.filter(F.col("_hot").isNull()).drop("_hot").join(slim.hint("merge"), key, "left")
    done = marked.filter(F.col("_hot").isNotNull()).select(*facts.columns, *[F.col("_hot")[v].alias(v) for v in values])
    return plain.select(*facts.columns, *values).unionByName(done)
