"""URL keys and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cache_key(url: Column, etag: Column | None = None) -> Column:
    """Hex digest of the URL, with a dot and the digest of the entity tag where there is one."""
    key = F.sha2(url, 256)
    if etag is None:
        return key
    return F.when(F.length(etag) > 0, F.concat(key, F.lit("."), F.sha2(etag, 256))).otherwise(key)


def url_index(pages: DataFrame, version: str) -> DataFrame:
    """One row per key (url, etag): the newest version of the page."""
    keyed = pages.withColumn("cache_key", cache_key(F.col("url"), F.col("etag")))
    newest = F.max(F.struct(version, "url", "etag")).alias("w")
    return keyed.groupBy("cache_key").agg(newest).select("cache_key", "w.*")


def resolve_keys(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Reverse lookup; a key that is not in the index is an error."""
    found = keys.join(index, "cache_key", "left")
    missing = F.raise_error(F.concat(F.lit("no entry for "), F.col("cache_key")))
    return found.withColumn("url", F.when(F.col("url").isNotNull(), F.col("url")).otherwise(missing))


def bucket_and_path(url: Column) -> tuple[Column, Column]:
    """Host part and path without its first slash; either one empty is an error."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    bad = F.raise_error(F.concat(F.lit("bad path "), url))
    whole = (host != "") & (path != "")
    return F.when(whole, host).otherwise(bad), F.when(whole, F.regexp_replace(path, "^/", "")).otherwise(bad)


def file_extension(path: Column, dot: bool = True, lower: bool = True) -> Column:
    """Extension of the last path segment; leading dots of a name do not start one."""
    ext = F.regexp_extract(path, r"(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$", 1)
    if not dot:
        ext = F.regexp_replace(ext, r"^\.", "")
    return F.lower(ext) if lower else ext


def url_profile(pages: DataFrame) -> DataFrame:
    """Pages per host and extension: host, ext, n."""
    host, path = bucket_and_path(F.col("url"))
    return pages.groupBy(host.alias("host"), file_extension(path).alias("ext")).agg(F.count("*").alias("n"))
