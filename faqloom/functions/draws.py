"""Seeded draws from hashes: the same rows get the same draws on every run, retry and cluster size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hex_int(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


def unit_draw(seed: int, *keys: Column) -> Column:
    """Uniform in [0, 1) from the first 32 bits of the digest."""
    return hex_int(F.substring(digest(seed, *keys), 1, 8)) / F.lit(4294967296.0)


def index_draw(n: Column, seed: int, *keys: Column) -> Column:
    """Uniform integer in [0, n)."""
    return F.floor(unit_draw(seed, *keys) * n).cast("bigint")
