"""Streaming jobs: questions answered as they arrive, token counters, running losses.

Each micro-batch writes its own ``batch=`` folder and overwrites it when the batch is replayed, so a restart from the
checkpoint gives the same result once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faqloom.functions.text import basic_token_array
from faqloom.operators.scoring import TOP_K, answer_regions, label_lookup, rank_answers
from faqloom.session import materialize

STATE_STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one Parquet file or a folder of part files; the schema comes from what is there.
    A pattern in the path makes a single file a listing of one, and the files of a folder are listed one by one."""
    path = f"{root}/{name}.parque[t]"
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(path)


def _run(stream: DataFrame, mode: str, each: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    def write(batch: DataFrame, batch_id: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}", compression="zstd")

    # state of any size: on disk with changelogs in the checkpoint, not in the executors' memory; a query keeps the
    # setting it was started with, so the session gets its own back
    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE_KEY, None)
    conf.set(STATE_STORE_KEY, STATE_STORE)
    try:
        query = (
            stream.writeStream.outputMode(mode).foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        conf.unset(STATE_STORE_KEY) if before is None else conf.set(STATE_STORE_KEY, before)
    query.awaitTermination()


def answer_questions(questions: DataFrame, index: DataFrame, answers: DataFrame, out: str, checkpoint: str, k: int = TOP_K) -> None:
    """Ranked answers for a stream of (question_id, question), against a static answer index, dealt into regions once."""
    regions = answer_regions(index)

    def rank(batch: DataFrame) -> DataFrame:
        kept = materialize(batch, "stream-batch", "zstd")  # read once from the source, then counted and scored
        return label_lookup(rank_answers(kept, index, k, regions), answers, "label", ["answer"])

    _run(questions, "append", rank, out, checkpoint)


def count_tokens(texts: DataFrame, out: str, checkpoint: str, text: str = "text") -> None:
    """Token counter over a stream of texts; every batch puts out the counts that changed."""
    tokens = texts.select(F.explode(basic_token_array(F.col(text))).alias("token"))
    _run(tokens.groupBy("token").agg(F.count("*").alias("n")), "update", lambda b: b, out, checkpoint)


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """Counts only grow, so the latest count of a token is its largest."""
    return spark.read.parquet(out).groupBy("token").agg(F.max("n").alias("n"))


def running_loss(losses: DataFrame, out: str, checkpoint: str) -> None:
    """Loss sum and steps per epoch over a stream of (epoch, loss)."""
    sums = losses.groupBy("epoch").agg(F.sum("loss").alias("loss_sum"), F.count("*").alias("steps"))
    _run(sums, "update", lambda b: b, out, checkpoint)


def latest_loss(spark: SparkSession, out: str) -> DataFrame:
    latest = spark.read.parquet(out).groupBy("epoch").agg(F.max(F.struct("steps", "loss_sum")).alias("m"))
    return latest.select("epoch", "m.steps", (F.col("m.loss_sum") / F.col("m.steps")).alias("loss_mean"))
