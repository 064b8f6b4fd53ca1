"""Streaming queries, run to the end of the available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from faqloom.plans import scoring
from faqloom.plans import sql as S
from faqloom.plans.registry import query
from faqloom.session import scratch_path
from faqloom.sources.tables import turn_id
from faqloom.streaming import jobs as J


@query("stream_rank_answers", f"""WITH {scoring.RANKED_SQL}
SELECT question_id, rank, label, score, answer FROM best JOIN answers USING (label) WHERE rank <= 5""")
def stream_rank_answers(spark, root):
    questions = J.table_stream(spark, root, "conversations").filter("role = 'user'").select(
        turn_id().alias("question_id"), F.col("text").alias("question"))
    out = scratch_path(spark, "answered")
    J.answer_questions(
        questions, scoring.index(spark, root), scoring.numbered_answers(spark, root), out, scratch_path(spark, "state"))
    return spark.read.parquet(out).select("question_id", "rank", "label", "score", "answer")


@query("stream_token_counts", f"WITH {S.BASIC} SELECT token, count(*) AS n FROM toks GROUP BY token")
def stream_token_counts(spark, root):
    out = scratch_path(spark, "counts")
    texts = J.table_stream(spark, root, "documents").select("doc_id", "text")
    texts = texts.repartition(spark.sparkContext.defaultParallelism, "doc_id")  # one small file is one split
    J.count_tokens(texts, out, scratch_path(spark, "state"))
    return J.latest_counts(spark, out)


@query("stream_running_loss", """
SELECT event_type AS epoch, count(*) AS steps, round(sum(value) / count(*), 6) AS loss_mean FROM events GROUP BY event_type""")
def stream_running_loss(spark, root):
    out = scratch_path(spark, "losses")
    losses = J.table_stream(spark, root, "events").select(F.col("event_type").alias("epoch"), F.col("value").alias("loss"))
    J.running_loss(losses, out, scratch_path(spark, "state"))
    return J.latest_loss(spark, out).withColumn("loss_mean", F.round("loss_mean", 6))
