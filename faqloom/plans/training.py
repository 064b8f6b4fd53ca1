"""One classifier for all labels of the documents, trained jointly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from faqloom.functions.text import basic_token_array
from faqloom.operators import training as T
from faqloom.operators.lookup import lookup
from faqloom.plans import sql as S
from faqloom.plans.registry import query
from faqloom.plans.text import kept_once, made_once
from faqloom.sources.tables import documents, table

FEATURES = 1000


def label_names(rows):
    """What holds of a labelled document, besides its text."""
    kinds = [F.when(F.col(c) == 1, c) for c in ("quality", "toxic")] + [F.concat(F.lit(f"{c}="), F.col(c)) for c in ("lang", "source")]
    return F.array_compact(F.array(*kinds))


def trained(spark, root):
    """Examples of all documents, the vocabulary, the numbered labels and the fitted weights."""
    docs = documents(spark, root, "lang", "source", regroup=True)
    tokens = made_once(spark, root, "training-tokens", lambda: docs.select(
        F.col("doc_id").alias("example"), basic_token_array(F.col("text")).alias("tokens"), "lang", "source"))
    marked = table(spark, root, "labels").withColumnRenamed("doc_id", "example")
    learned = made_once(spark, root, "training-labels", lambda: tokens.join(marked, "example").select(
        "example", "tokens", label_names(tokens).alias("names")))
    words = made_once(spark, root, "training-words", lambda: T.vocabulary(learned, FEATURES))
    examples = made_once(spark, root, "training-examples", lambda: T.sparse_examples(tokens, words))
    order = F.row_number().over(Window.orderBy("name")) - 1  # of the labels, not of their rows
    labels = made_once(spark, root, "training-names", lambda: learned.select(F.explode("names").alias("name")).distinct().select(
        "name", order.alias("label")))

    def targets():
        cells = lookup(learned.select("example", F.explode("names").alias("name")), labels, "name", ["label"])
        held = cells.groupBy("example").agg(F.sort_array(F.collect_list("label")).alias("y"))
        mine = examples.join(learned.select("example"), "example").join(held, "example", "left")
        return mine.select("example", "f", "x", F.coalesce("y", F.array().cast("array<int>")).alias("y"))

    rows = made_once(spark, root, "training-rows", targets)
    weights = kept_once(spark, root, "training-weights", lambda: T.fit_labels(rows, FEATURES + 1, labels.count()))
    return examples, words, labels, weights


def _div(a: str, b: str) -> str:
    """Division to the next whole number below."""
    return f"(({a} - (({a} % {b} + {b}) % {b})) // {b})"


def _step(k: int) -> str:
    return f"""
z{k} AS MATERIALIZED (SELECT example, label, {_div('sum(x * w)::BIGINT', T.UNIT)} AS z FROM xt JOIN w{k - 1} USING (feature) GROUP BY example, label),
e{k} AS MATERIALIZED (
  SELECT z{k}.example, z{k}.label,
         CAST(floor({T.ONE} / (1 + exp(-(z::DOUBLE / {T.ONE})))) AS BIGINT) - CASE WHEN y.label IS NULL THEN 0 ELSE {T.ONE} END AS e
  FROM z{k} LEFT JOIN y ON y.example = z{k}.example AND y.label = z{k}.label),
g{k} AS (SELECT feature, label, ({T.RATE[0]} * sum(x * e))::BIGINT AS g FROM xt JOIN e{k} USING (example) GROUP BY feature, label),
w{k} AS MATERIALIZED (
  SELECT feature, label, w - coalesce({_div('g', f'(SELECT {T.RATE[1] * T.UNIT} * count(*) FROM tr)')}, 0) AS w
  FROM w{k - 1} LEFT JOIN g{k} USING (feature, label))"""


_TRAINED = f"""WITH toks AS MATERIALIZED (
  SELECT doc_id AS example, {S.basic_list('text')} AS ts, lang, source FROM documents),
cells AS MATERIALIZED (SELECT DISTINCT example, unnest(ts) AS token FROM toks),
tr AS MATERIALIZED (SELECT example, quality, toxic, lang, source FROM toks JOIN labels ON labels.doc_id = example),
names AS (
  SELECT example, 'quality' AS name FROM tr WHERE quality = 1 UNION ALL SELECT example, 'toxic' FROM tr WHERE toxic = 1
  UNION ALL SELECT example, 'lang=' || lang FROM tr WHERE lang IS NOT NULL
  UNION ALL SELECT example, 'source=' || source FROM tr WHERE source IS NOT NULL),
lab AS MATERIALIZED (SELECT name, row_number() OVER (ORDER BY name) - 1 AS label FROM (SELECT DISTINCT name FROM names)),
y AS MATERIALIZED (SELECT example, label FROM names JOIN lab USING (name)),
df AS (SELECT token, count(*) AS df FROM cells JOIN tr USING (example) GROUP BY token),
voc AS MATERIALIZED (
  SELECT token, row_number() OVER (ORDER BY df DESC, token) AS feature,
         CAST(round({T.UNIT} * ln(((SELECT count(*) FROM tr) + 1) / (df + 1))) AS BIGINT) AS x
  FROM df ORDER BY df DESC, token LIMIT {FEATURES}),
xa AS MATERIALIZED (
  SELECT example, feature, x FROM cells JOIN voc USING (token) UNION ALL SELECT example, 0, {T.UNIT} FROM toks),
xt AS MATERIALIZED (SELECT xa.* FROM xa JOIN tr USING (example)),
w0 AS MATERIALIZED (SELECT feature, label, 0::BIGINT AS w FROM (SELECT unnest(range(0, {FEATURES + 1})) AS feature), lab),
{",".join(_step(k) for k in range(1, T.STEPS + 1))}"""


@query("fit_joint_labels", f"""{_TRAINED}
SELECT coalesce(token, '') AS token, name AS label, w AS weight
FROM w{T.STEPS} JOIN lab USING (label) LEFT JOIN voc USING (feature) WHERE feature <= (SELECT count(*) FROM voc)""")
def fit_joint_labels(spark, root):
    """The weights of every token for every label after ten steps, in millionths; the empty token is the bias."""
    _, words, labels, weights = trained(spark, root)
    cells = T.weight_table(weights).join(F.broadcast(labels), "label").select("feature", "name", "weight")
    bias = cells.filter("feature = 0").select(F.lit("").alias("token"), F.col("name").alias("label"), "weight")
    named = cells.join(F.broadcast(words.select("feature", "token")), "feature")  # FEATURES words
    return bias.unionByName(named.select("token", F.col("name").alias("label"), "weight"))


@query("fit_multilabel", f"""{_TRAINED},
zs AS (SELECT example, label, {_div('sum(x * w)::BIGINT', T.UNIT)} AS z FROM xa JOIN w{T.STEPS} USING (feature) GROUP BY example, label)
SELECT example AS doc_id, name AS label, floor({T.ONE} / (1 + exp(-(z::DOUBLE / {T.ONE})))) / {T.ONE} AS probability
FROM zs JOIN lab USING (label)""")
def fit_multilabel(spark, root):
    """Independent probabilities of every label for every document, by the jointly trained classifier."""
    examples, _, labels, weights = trained(spark, root)
    rows = T.predict_labels(examples, weights).join(F.broadcast(labels), "label")
    return rows.select(F.col("example").alias("doc_id"), F.col("name").alias("label"), (F.col("p") / T.ONE).alias("probability"))
