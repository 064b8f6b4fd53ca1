"""Sampling, shuffling, splitting and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faqloom.functions.draws import unit_draw
from faqloom.operators.ordering import first_n_by_hash, hash_order, random_rank

# Shares of the train, dev and test parts end at these points.
SPLIT_ENDS = (("train", 0.6), ("dev", 0.8), ("test", 1.0))


def sample_n(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement; an error if the table is smaller."""
    return first_n_by_hash(df, keys, seed, n)


def shuffle_rows(df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Rows in random order: range-partitioned by hash, sorted inside each partition."""
    ordered = hash_order(df, keys, seed)
    return ordered.repartitionByRange("_h", *keys).sortWithinPartitions("_h", *keys).drop("_h", "_b")


def shuffle_position(df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """The place of each row in the random order, as a column."""
    return random_rank(df, keys, seed, "position")


def split_exact(df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Random split with exact boundaries ``int(share * n)``: disjoint and complete."""
    ranked = random_rank(df, keys, seed, "_at", total="_n")
    label = F.lit(SPLIT_ENDS[-1][0])
    for name, end in reversed(SPLIT_ENDS[:-1]):
        label = F.when(F.col("_at") < F.floor(F.col("_n") * end), F.lit(name)).otherwise(label)
    return ranked.withColumn("split", label).drop("_at", "_n")


def split_hash(df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Random split by row: shares are approximate, and a row stays in its part when others come in."""
    u = unit_draw(seed, *[F.col(k) for k in keys])
    label = F.lit(SPLIT_ENDS[-1][0])
    for name, end in reversed(SPLIT_ENDS[:-1]):
        label = F.when(u < end, F.lit(name)).otherwise(label)
    return df.withColumn("split", label)


def line_set(lines: DataFrame, line: str = "line") -> DataFrame:
    """Distinct lines without trailing white space."""
    return lines.select(F.regexp_replace(line, r"(?U)\s+$", "").alias(line)).distinct()


def union_files(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
