"""Global order without a global window.

Ranks and running totals over a whole table work in two phases: rows fall into buckets whose order agrees with the
order of the rows, a small table of bucket totals is summed up, and each bucket is ordered on its own.  Bucket borders
are literals in the plan or come from the rows themselves, so a retried task puts every row where it was before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faqloom.functions.draws import digest, hex_int
from faqloom.session import bucket_count


def quantile_buckets(df: DataFrame, column: str, name: str = "bucket", n: int | None = None) -> DataFrame:
    """Add a bucket number that grows with a numeric column; borders are approximate quantiles.
    Any borders give right results, good ones give even buckets."""
    n = n or bucket_count(df.sparkSession)
    shares = [i / n for i in range(1, n)]
    borders = df.agg(F.percentile_approx(F.col(column).cast("double"), shares, 100 * n)).first()[0]
    borders = sorted(set(borders or []))
    if not borders:
        return df.withColumn(name, F.lit(0))
    cut = Bucketizer(
        splits=[float("-inf"), *borders, float("inf")], inputCol="_cut", outputCol="_bucket", handleInvalid="keep"
    )
    out = cut.transform(df.withColumn("_cut", F.col(column).cast("double")))
    return out.withColumn(name, F.col("_bucket").cast("int")).drop("_cut", "_bucket")


def bucket_offsets(
    df: DataFrame, value: Column, bucket: Sequence[str], group: Sequence[str] = (), typ: str = "bigint"
) -> DataFrame:
    """Per (group, bucket): ``before`` = sum of the buckets ahead of it in its group, ``in_group`` = whole group."""
    totals = df.groupBy(*group, *bucket).agg(F.sum(value).cast(typ).alias("_in_bucket"))
    ahead = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    return totals.select(
        *group,
        *bucket,
        "_in_bucket",
        F.coalesce(F.sum("_in_bucket").over(ahead), F.lit(0)).cast(typ).alias("_before"),
        F.sum("_in_bucket").over(whole).cast(typ).alias("_in_group"),
    )


def running_total(
    df: DataFrame,
    value: Column,
    order: Sequence[str | Column],
    bucket: Sequence[str],
    name: str,
    group: Sequence[str] = (),
    group_total: str | None = None,
    typ: str = "bigint",
    few_buckets: bool = True,
    width: int | None = None,
) -> DataFrame:
    """Add ``name`` = sum of ``value`` over the rows strictly ahead in the group, optionally the group total.  ``width`` sets the
    number of tasks that order the buckets where there is no group; else the session does."""
    dealt = bool(width) and few_buckets and not group
    if dealt:
        df = df.withColumn("_value", value)  # ahead of the shuffle, so that lists it is the size of need not follow
        value = F.col("_value")
    offsets = bucket_offsets(df, value, bucket, group, typ)
    if few_buckets and not group:
        offsets = F.broadcast(offsets)  # one row per bucket, and the number of buckets is a setting
    local = (
        Window.partitionBy(*group, *bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = df.repartition(width, *bucket) if dealt else df
    out = rows.join(offsets, [*group, *bucket]).withColumn(
        name, (F.col("_before") + F.coalesce(F.sum(value).over(local), F.lit(0))).cast(typ)
    )
    if group_total:
        out = out.withColumn(group_total, F.col("_in_group"))
    return out.drop("_in_bucket", "_before", "_in_group", *["_value"] * dealt)


def hash_order(df: DataFrame, keys: Sequence[str], seed: int, digits: int = 3) -> DataFrame:
    """Add a random but repeatable order: ``_h`` the digest of the keys, ``_b`` its leading hex digits as a bucket."""
    h = digest(seed, *[F.col(k) for k in keys])
    return df.withColumn("_h", h).withColumn("_b", hex_int(F.substring("_h", 1, digits)))


def random_rank(
    df: DataFrame, keys: Sequence[str], seed: int, name: str = "position", total: str | None = None, digits: int = 3
) -> DataFrame:
    """Rank 0..n-1 of every row in the hash order; ``digits`` sets 16**digits even buckets."""
    ordered = hash_order(df, keys, seed, digits)
    ranked = running_total(
        ordered, F.lit(1), ["_h", *keys], ["_b"], name, group_total=total
    )
    return ranked.drop("_h", "_b")


def first_n_by_hash(df: DataFrame, keys: Sequence[str], seed: int, n: int, digits: int = 3) -> DataFrame:
    """Exactly the ``n`` first rows of the hash order (an error if there are fewer).

    Only the bucket that holds the n-th row is ordered; the buckets ahead of it pass whole, those behind never move.
    """
    if n and df.isEmpty():
        raise ValueError(f"cannot draw {n} rows from a smaller table")
    ordered = hash_order(df, keys, seed, digits)
    offsets = bucket_offsets(ordered, F.lit(1), ["_b"])
    offsets = offsets.withColumn(
        "_ok",
        F.when(F.col("_in_group") < n, F.raise_error(F.lit(f"cannot draw {n} rows from a smaller table")).cast("int"))
        .otherwise(1),
    ).filter((F.col("_before") < n) & (F.col("_ok") == 1))
    kept = ordered.join(F.broadcast(offsets), "_b")
    # a whole bucket needs no order: its rows get a rank of 0 without entering the window
    border = kept.filter(F.col("_before") + F.col("_in_bucket") > n)
    whole = kept.filter(F.col("_before") + F.col("_in_bucket") <= n)
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *keys))
    border = border.withColumn("_r", rank).filter(F.col("_before") + F.col("_r") <= n).drop("_r")
    return whole.unionByName(border).select(*df.columns)
