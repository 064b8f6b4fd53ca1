"""The given Parquet tables and the row shapes the operators start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faqloom.session import task_width


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def input_files(df: DataFrame) -> str:
    """A digest of the files a table is read from: paths, lengths and times.  Tasks fold their own files; a row each moves."""
    seen = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    each = F.md5(F.concat_ws("|", "file_path", "file_size", F.unix_micros("file_modification_time")))
    parts = [F.sum(F.conv(F.substring(each, i, 15), 16, 10).cast("decimal(20,0)")) for i in (1, 16)]
    return "-".join(map(str, seen.agg(F.count("*"), *parts).first()))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread rows by key when the scan has fewer splits than the cluster has slots (one small file, say).
    A large input has more splits than slots and is left as it is: no shuffle."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, key) if df.rdd.getNumPartitions() < slots else df


def documents(spark: SparkSession, root: str, *columns: str, regroup: bool = False) -> DataFrame:
    """Document texts, spread for the string work that follows.

    With ``regroup`` the texts are dealt out by document at any size: what is exploded from them and grouped again by
    document or line then stays where it is, so the shuffle carries each text once and no token rows.
    """
    texts = table(spark, root, "documents").select("doc_id", "text", *columns)
    if regroup:
        return texts.repartition(task_width(texts), "doc_id")
    return spread(texts, "doc_id")


def lines(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """One row per line of each text: ``keep``, ``line_no`` from 0, ``line``."""
    return df.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def turn_id() -> Column:
    """One name per turn, however long a conversation is."""
    return F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))


def faq_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Each user turn with the assistant turn that follows it: faq_id, conv_id, turn, question, answer.

    The next turn is found by its number, so a conversation of any length needs no window over all its turns.
    """
    turns = table(spark, root, "conversations")
    users = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replies = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return users.join(replies, ["conv_id", "turn"]).select(
        turn_id().alias("faq_id"), "conv_id", "turn", "question", "answer"
    )
