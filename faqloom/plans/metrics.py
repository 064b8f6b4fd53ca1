"""Loss, accuracy and ROC queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from faqloom.functions.vectors import argmax, banded_nll, bce, doubles, total
from faqloom.operators import metrics as M
from faqloom.plans import scoring
from faqloom.plans.registry import query
from faqloom.session import scratch_path
from faqloom.sources.sinks import append_metrics
from faqloom.sources.tables import table


def cells(spark, root):
    """One row per labelled document and label with a score from the text: doc_id, label, y, logit."""
    docs = table(spark, root, "documents").select("doc_id", "n_chars", F.size(F.split("text", " ")).alias("n_words"))
    rows = table(spark, root, "labels").join(docs, "doc_id")
    long = (F.col("n_chars") - 2000) / 1000.0
    words = F.col("n_chars") / F.col("n_words") - 6.0
    cell = F.inline(F.array(
        F.struct(F.lit("quality").alias("label"), F.col("quality").alias("y"), long.alias("logit")),
        F.struct(F.lit("toxic").alias("label"), F.col("toxic").alias("y"), words.alias("logit"))))
    return rows.select("doc_id", cell)


_CELLS = """
scored AS (
  SELECT l.doc_id, quality, toxic, (n_chars - 2000) / 1000.0::DOUBLE AS lq,
         n_chars / len(string_split(text, ' ')) - 6.0::DOUBLE AS lt
  FROM labels l JOIN documents d USING (doc_id)),
cells AS (
  SELECT doc_id, 'quality' AS label, quality AS y, CAST(lq AS DOUBLE) AS logit FROM scored
  UNION ALL SELECT doc_id, 'toxic', toxic, CAST(lt AS DOUBLE) FROM scored),
losses AS (SELECT *, greatest(logit, 0) - logit * y + ln(1 + exp(-abs(logit))) AS loss FROM cells)"""


def rounded(df):
    return df.withColumn("value", F.round("value", 6))


@query("bce_loss", f"WITH {_CELLS} SELECT round(avg(loss), 6) AS value, count(*) AS n FROM losses")
def bce_loss(spark, root):
    return rounded(M.bce_loss(cells(spark, root)))


@query("batch_mean_loss", f"""WITH {_CELLS},
per_row AS (SELECT doc_id, avg(loss) AS loss FROM losses GROUP BY doc_id),
b AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS b, loss FROM per_row)
SELECT round(avg(m), 6) AS value, count(*) AS n FROM (SELECT avg(loss) AS m FROM b GROUP BY b)""")
def batch_mean_loss(spark, root):
    return rounded(M.batch_mean_loss(cells(spark, root), "doc_id", 8, bce(F.col("logit"), F.col("y"))))


@query("threshold_accuracy", f"""WITH {_CELLS}
SELECT round(avg(share), 6) AS value, count(*) AS n FROM (
  SELECT doc_id, avg(CASE WHEN (1 / (1 + exp(-logit)) > 0.5) = (y = 1) THEN 1 ELSE 0 END) AS share FROM cells GROUP BY doc_id)""")
def threshold_accuracy(spark, root):
    return rounded(M.threshold_accuracy(cells(spark, root), "doc_id"))


def _auc_sql(group: str) -> str:
    g = f"{group}, " if group else ""
    p = f"PARTITION BY {group}" if group else ""
    return f"""WITH {_CELLS},
hist AS (SELECT {g} logit, sum(y) AS pos, sum(1 - y) AS neg FROM cells GROUP BY {g} logit),
run AS (SELECT *, sum(neg) OVER ({p} ORDER BY logit) - neg AS below FROM hist)
SELECT {g} round(CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / (2.0 * sum(pos) * sum(neg)), 6) AS value,
       CAST(sum(pos + neg) AS BIGINT) AS n FROM run {"GROUP BY " + group if group else ""}"""


@query("auc_per_label", _auc_sql("label"))
def auc_per_label(spark, root):
    return rounded(M.roc_auc(cells(spark, root), ["label"]))


@query("auc_micro", _auc_sql(""))
def auc_micro(spark, root):
    return rounded(M.roc_auc(cells(spark, root)))


def _points_sql(group: str) -> str:
    g, p = (f"{group}, ", f"PARTITION BY {group}") if group else ("", "")
    reached = f"OVER ({p} ORDER BY logit DESC)"
    return f"""WITH {_CELLS},
hist AS (SELECT {g} logit, sum(y) AS pos, sum(1 - y) AS neg FROM cells GROUP BY {g} logit)
SELECT {g} round(logit, 6) AS threshold, round(sum(neg) {reached} / sum(neg) OVER ({p}), 9) AS fpr,
       round(sum(pos) {reached} / sum(pos) OVER ({p}), 9) AS tpr FROM hist"""


def rounded_points(df):
    return df.withColumns({"threshold": F.round("threshold", 6), "fpr": F.round("fpr", 9), "tpr": F.round("tpr", 9)})


@query("roc_points_per_label", _points_sql("label"))
def roc_points_per_label(spark, root):
    """False and true positive rates of every label at every score."""
    return rounded_points(M.roc_points(cells(spark, root), ["label"]))


@query("roc_points_micro", _points_sql(""))
def roc_points_micro(spark, root):
    """The same over the cells of all labels together."""
    return rounded_points(M.roc_points(cells(spark, root)))


def vectors(spark, root):
    return table(spark, root, "embeddings").select("vec_id", "label", doubles(F.col("embedding")).alias("x"))


def _nll_sql(xs: str, label: str) -> str:
    return f"(ln(list_sum(list_transform({xs}, lambda v: exp(v)))) - ({xs})[CAST({label} AS INTEGER) + 1])"


_X = "vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def scored_rows(spark, root):
    """Every vector with its ten label scores from the fitted classifier: vec_id, label, x, logits."""
    logits = scoring.scores(spark, root).select("vec_id", "logits")
    return vectors(spark, root).join(logits, "vec_id")


_SCORED = f"""{scoring._FIT},
own AS (
  SELECT e.vec_id, e.label, e.embedding[11] > 0 AS active, ln(sum(exp(l.x))) - sum(CASE WHEN l.label = e.label THEN l.x END) AS loss,
         arg_min(l.label, (-l.x, l.label)) AS best,
         ln(sum(CASE WHEN l.label < 2 THEN exp(l.x) END)) - sum(CASE WHEN l.label = e.label % 2 THEN l.x END) AS next_loss
  FROM logit l JOIN embeddings e ON e.vec_id = l.vec_id GROUP BY e.vec_id, e.label, e.embedding[11])"""


def masked_label():
    """Positions without a target carry label -1 and do not count."""
    return F.when(F.get("x", F.lit(10)) > 0, F.col("label")).otherwise(M.IGNORED_LABEL)


@query("cross_entropy", f"WITH {_SCORED} SELECT round(avg(loss), 6) AS value, count(*) AS n FROM own")
def cross_entropy(spark, root):
    """Labels go in as 0/1 vectors and come back as their first maximum."""
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("double"))
    return rounded(M.cross_entropy(scored_rows(spark, root), F.col("logits"), argmax(hot)))


@query("cross_entropy_ignore", f"WITH {_SCORED} SELECT round(avg(loss), 6) AS value, count(*) AS n FROM own WHERE active")
def cross_entropy_ignore(spark, root):
    return rounded(M.cross_entropy(scored_rows(spark, root), F.col("logits"), masked_label()))


@query("argmax_accuracy", f"""WITH {_SCORED}
SELECT CAST(sum(CASE WHEN best = label THEN 1 ELSE 0 END) AS BIGINT) AS value, count(*) AS n FROM own""")
def argmax_accuracy(spark, root):
    return M.argmax_accuracy(scored_rows(spark, root), F.col("logits"), F.col("label"))


@query("choice_loss", f"""WITH {_X},
c AS (SELECT vec_id // 4 AS q, list(x[label + 1] ORDER BY vec_id) AS xs, arg_min(label, vec_id) % 4 AS y FROM vecs GROUP BY 1)
SELECT round(avg({_nll_sql('xs', 'y')}), 6) AS value, count(*) AS n FROM c""")
def choice_loss(spark, root):
    """Four choices per question; the logit of a choice is gathered at its own index."""
    rows = vectors(spark, root).select(
        F.expr("vec_id div 4").alias("q"), "vec_id", F.get("x", F.col("label")).alias("logit"), (F.col("label") % 4).alias("y"))
    return rounded(M.choice_loss(rows, "q", "vec_id", "logit", "y", 4))


@query("span_loss", f"""WITH {_X},
s AS (SELECT avg({_nll_sql('x[1:32]', 'label')}) AS v, count(*) AS n FROM vecs WHERE label < 32),
e AS (SELECT avg({_nll_sql('x[33:64]', 'label * 4')}) AS v, count(*) AS n FROM vecs WHERE label * 4 < 32)
SELECT round((s.v + e.v) / 2, 6) AS value, s.n + e.n AS n FROM s, e""")
def span_loss(spark, root):
    return rounded(M.span_loss(
        vectors(spark, root), F.slice("x", 1, 32), F.slice("x", 33, 32), F.col("label"), F.col("label") * 4))


@query("token_label_loss", f"""WITH {_X},
p AS (SELECT unnest(range(16)) AS i, x, label FROM vecs),
a AS (SELECT [x[i * 4 + 1], x[i * 4 + 2], x[i * 4 + 3], x[i * 4 + 4]] AS xs, (label + i) % 4 AS y FROM p WHERE i <= label)
SELECT round(avg({_nll_sql('xs', 'y')}), 6) AS value, count(*) AS n FROM a""")
def token_label_loss(spark, root):
    """Each vector as a sequence of 16 positions with four class scores; the first label + 1 positions are active."""
    at = F.sequence(F.lit(0), F.lit(15))
    rows = vectors(spark, root).select(
        "vec_id",
        F.transform(at, lambda i: (i <= F.col("label")).cast("int")).alias("mask"),
        F.transform(at, lambda i: F.slice("x", i * 4 + 1, F.lit(4))).alias("logits"),
        F.transform(at, lambda i: (F.col("label") + i) % 4).alias("labels"))
    active = M.active_positions(rows, "mask", "logits", "labels")
    return rounded(M.cross_entropy(active, F.col("logits"), F.col("labels")))


@query("summed_losses", f"""WITH {_SCORED},
lm AS (SELECT avg(loss) AS v, count(*) AS n FROM own WHERE active), nx AS (SELECT avg(next_loss) AS v, count(*) AS n FROM own)
SELECT 'masked_lm' AS metric, round(v, 6) AS value, n FROM lm
UNION ALL SELECT 'next_sentence', round(v, 6), n FROM nx
UNION ALL SELECT 'total', round(lm.v + nx.v, 6), lm.n + nx.n FROM lm, nx""")
def summed_losses(spark, root):
    rows = scored_rows(spark, root)
    return rounded(M.summed_losses({
        "masked_lm": M.cross_entropy(rows, F.col("logits"), masked_label()),
        "next_sentence": M.cross_entropy(rows, F.slice("logits", 1, 2), F.col("label") % 2)}))


@query("metrics_append", f"""WITH {_CELLS}, v AS (SELECT round(avg(loss), 6) AS value FROM losses)
SELECT run_id, 'eval_loss' AS metric, value FROM v, (VALUES ('run-1'), ('run-2')) r(run_id)""")
def metrics_append(spark, root):
    """Two runs appended to one metrics log."""
    path = scratch_path(spark, "metrics")
    for run in ("run-1", "run-2"):
        loss = rounded(M.bce_loss(cells(spark, root))).select(F.lit("eval_loss").alias("metric"), "value")
        append_metrics(loss, path, run)
    return spark.read.parquet(path).select(F.col("run_id").cast("string").alias("run_id"), "metric", "value")




BORDERS = [4, 7, 10]


@query("banded_nll", f"""WITH {scoring._FIT},
band AS (
  SELECT vec_id, label, x, CASE WHEN label < {BORDERS[0]} THEN -1 WHEN label < {BORDERS[1]} THEN 0 ELSE 1 END AS band FROM logit),
cluster AS (SELECT vec_id, band, avg(x) AS c, ln(sum(exp(x))) AS norm FROM band WHERE band >= 0 GROUP BY vec_id, band),
head AS (
  SELECT vec_id, ln(sum(e)) AS norm FROM (
    SELECT vec_id, exp(x) AS e FROM band WHERE band = -1 UNION ALL SELECT vec_id, exp(c) FROM cluster) GROUP BY vec_id)
SELECT e.vec_id, round(h.norm - CASE WHEN b.band = -1 THEN b.x ELSE c.c - c.norm + b.x END, 6) AS loss
FROM embeddings e JOIN band b ON b.vec_id = e.vec_id AND b.label = e.label JOIN head h ON h.vec_id = e.vec_id
LEFT JOIN cluster c ON c.vec_id = e.vec_id AND c.band = b.band""")
def banded_nll_query(spark, root):
    """Losses over the fitted scores with a head of four labels and two bands behind it, each scored by its mean; a row stays
    a row."""
    rows = scored_rows(spark, root)
    means = F.array(*[total(F.slice("logits", a + 1, b - a)) / (b - a) for a, b in zip(BORDERS, BORDERS[1:])])
    loss = banded_nll(F.col("logits"), F.col("label"), BORDERS, means)
    return rows.select("vec_id", F.round(loss, 6).alias("loss"))
