"""Label scores, ranked answers and fitted label vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from faqloom.functions.vectors import doubles
from faqloom.operators import scoring as R
from faqloom.operators.ordering import quantile_buckets, running_total
from faqloom.plans import sql as S
from faqloom.plans.registry import query
from faqloom.plans.text import made_once
from faqloom.sources.tables import faq_pairs, spread, table, turn_id


def vectors(spark, root):
    return table(spark, root, "embeddings").select("vec_id", "label", doubles(F.col("embedding")).alias("x"))


def fitted(spark, root):
    return made_once(spark, root, "label-vectors", lambda: R.fit_label_vectors(vectors(spark, root)))


def scores(spark, root):
    return R.linear_scores(vectors(spark, root), R.label_matrix(fitted(spark, root)))


_FIT = """
cells AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
w AS (SELECT label, CAST(dim AS INTEGER) AS dim, avg(v) AS weight FROM cells GROUP BY label, dim),
bias AS (SELECT label, -0.5 * sum(weight * weight) AS b FROM w GROUP BY label),
logit AS (
  SELECT c.vec_id, w.label, sum(c.v * w.weight) + any_value(b) AS x
  FROM cells c JOIN w ON w.dim = c.dim JOIN bias ON bias.label = w.label GROUP BY c.vec_id, w.label),
ranked AS (
  SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, label) AS INTEGER) AS rank, label, x,
         exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS soft, 1 / (1 + exp(-x)) AS sig FROM logit)"""


def best(spark, root, link=None):
    return R.best_labels(vectors(spark, root), R.label_matrix(fitted(spark, root)), link=link)


@query("fit_label_vectors", f"""WITH {_FIT}
SELECT label, dim, round(weight, 6) AS weight FROM w UNION ALL SELECT label, -1, round(b, 6) FROM bias""")
def fit_label_vectors(spark, root):
    return R.fit_label_vectors(vectors(spark, root)).withColumn("weight", F.round("weight", 6))


@query("linear_scores", f"WITH {_FIT} SELECT vec_id, label, round(x, 6) AS logit FROM logit")
def linear_scores(spark, root):
    rows = scores(spark, root).select("vec_id", F.posexplode("logits").alias("label", "x"))
    return rows.select("vec_id", "label", F.round("x", 6).alias("logit"))


@query("topk_labels", f"WITH {_FIT} SELECT vec_id, rank, label, round(x, 6) AS score FROM ranked WHERE rank <= 5")
def topk_labels(spark, root):
    return best(spark, root).withColumn("score", F.round("score", 6))


@query("topk_labels_sigmoid", f"WITH {_FIT} SELECT vec_id, rank, label, round(sig, 6) AS score FROM ranked WHERE rank <= 5")
def topk_labels_sigmoid(spark, root):
    return best(spark, root, "sigmoid").withColumn("score", F.round("score", 6))


@query("topk_labels_softmax", f"WITH {_FIT} SELECT vec_id, rank, label, round(soft, 6) AS score FROM ranked WHERE rank <= 5")
def topk_labels_softmax(spark, root):
    return best(spark, root, "softmax").withColumn("score", F.round("score", 6))


@query("accept_answers", f"""WITH {_FIT}
SELECT vec_id, rank, label, round(soft, 6) AS score FROM ranked WHERE rank <= 5 AND soft > {1 / 9.9}""")
def accept_answers(spark, root):
    ranked = R.accept(best(spark, root, "softmax"), 1 / 9.9)
    return ranked.withColumn("score", F.round("score", 6))


@query("topk_hit_rate", f"""WITH {_FIT}
SELECT CAST(k AS INTEGER) AS k, count(*) AS n, CAST(sum(CASE WHEN place <= k THEN 1 ELSE 0 END) AS BIGINT) AS hits
FROM (SELECT e.vec_id, min(r.rank) AS place FROM embeddings e JOIN ranked r ON r.vec_id = e.vec_id AND r.label = e.label
      GROUP BY e.vec_id), (VALUES (1), (3), (5)) v(k) GROUP BY k""")
def topk_hit_rate(spark, root):
    truth = vectors(spark, root).select("vec_id", F.col("label").alias("own"))
    return R.hit_rate(best(spark, root), truth, "vec_id", "label")


# ---------------------------------------------------------------- questions and answers

def numbered_answers(spark, root):
    """Answers with dense label numbers in the order of their questions."""

    def build():
        pairs = quantile_buckets(faq_pairs(spark, root), "conv_id", "_b")
        return running_total(pairs, F.lit(1), ["conv_id", "turn"], ["_b"], "label").select("label", "faq_id", "question", "answer")

    return made_once(spark, root, "answers", build)


def index(spark, root):
    return made_once(
        spark, root, "answer-index",
        lambda: R.answer_index(spread(numbered_answers(spark, root).select("label", "answer"), "label")))


def user_questions(spark, root):
    turns = table(spark, root, "conversations").filter("role = 'user'")
    return spread(turns.select(
        turn_id().alias("question_id"), F.col("text").alias("question")), "question_id")


RANKED_SQL = f"""{S.PAIRS},
answers AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS label, faq_id, question, answer FROM faq),
atok AS (SELECT label, unnest({S.basic_list(S.normalized('answer'))}) AS token FROM answers),
tf AS (SELECT label, token, count(*) AS tf FROM atok GROUP BY label, token),
idf AS (
  SELECT token, CAST(round({R.IDF_SCALE} * ln(((SELECT count(*) FROM answers) + 1) / (count(*) + 1))) AS BIGINT) AS idf
  FROM tf GROUP BY token),
qt AS (
  SELECT conv_id || ':' || turn AS question_id, unnest({S.basic_list(S.normalized('text'))}) AS token
  FROM conversations WHERE role = 'user'),
qtf AS (SELECT question_id, token, count(*) AS q FROM qt GROUP BY question_id, token),
scored AS (
  SELECT question_id, label, CAST(sum(q * tf * idf * idf) AS BIGINT) AS score
  FROM qtf JOIN idf USING (token) JOIN tf USING (token) WHERE idf > 0 GROUP BY question_id, label),
best AS (
  SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, label) AS INTEGER) AS rank,
         label, score FROM scored)"""


@query("rank_answers", f"""WITH {RANKED_SQL}
SELECT question_id, rank, label, score, answer, question AS source_question
FROM best JOIN answers USING (label) WHERE rank <= {R.TOP_K}""")
def rank_answers(spark, root):
    """Flagship: every question, normalised and tokenised, against all answers; the five best with their texts."""
    ranked = R.rank_answers(user_questions(spark, root), index(spark, root))
    answers = numbered_answers(spark, root).withColumnRenamed("question", "source_question")
    return R.label_lookup(ranked, answers, "label", ["answer", "source_question"])


@query("label_lookup", f"""WITH {RANKED_SQL}
SELECT question_id, label, answer FROM best JOIN answers USING (label) WHERE rank = 1""")
def label_lookup(spark, root):
    ranked = R.rank_answers(user_questions(spark, root), index(spark, root), 1)
    return R.label_lookup(ranked, numbered_answers(spark, root), "label", ["answer"]).select("question_id", "label", "answer")


@query("answer_json", f"""WITH {RANKED_SQL}
SELECT question_id, CAST(json_object('text', answer) AS VARCHAR) AS json FROM best JOIN answers USING (label) WHERE rank = 1""")
def answer_json(spark, root):
    ranked = R.rank_answers(user_questions(spark, root), index(spark, root), 1)
    return R.answer_json(R.label_lookup(ranked, numbered_answers(spark, root), "label", ["answer"]))


@query("faq_hit_rate", f"""WITH {RANKED_SQL},
own AS (SELECT faq_id AS question_id, label AS own FROM answers),
place AS (
  SELECT own.question_id, min(CASE WHEN label = own THEN rank END) AS place
  FROM own LEFT JOIN best ON best.question_id = own.question_id AND rank <= 5 GROUP BY own.question_id)
SELECT CAST(k AS INTEGER) AS k, count(*) AS n, CAST(sum(CASE WHEN place <= k THEN 1 ELSE 0 END) AS BIGINT) AS hits
FROM place, (VALUES (1), (3), (5)) v(k) GROUP BY k""")
def faq_hit_rate(spark, root):
    """Share of questions whose own answer is found."""
    ranked = R.rank_answers(user_questions(spark, root), index(spark, root))
    truth = numbered_answers(spark, root).select(F.col("faq_id").alias("question_id"), F.col("label").alias("own"))
    return R.hit_rate(ranked, truth, "question_id", "label")
