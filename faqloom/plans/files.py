"""Source and sink round trips: the tables written in each file form and read back by its rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from faqloom.operators import vocab as V
from faqloom.operators.splits import union_files
from faqloom.plans import features
from faqloom.plans import sql as S
from faqloom.plans.corpora import _SPLIT, split_column
from faqloom.plans.registry import ORACLE, query
from faqloom.plans.text import WORD_VOCAB_SQL, document_lines, document_tokens, word_vocab
from faqloom.session import bucket_count, scratch_path
from faqloom.sources import files as R
from faqloom.sources import sinks as W
from faqloom.sources.tables import faq_pairs, input_files, table

PLACE = ["doc_id", "line_no"]


def _flat(column):
    return F.translate(column, "\n\t\r", "   ")


@query("answer_lines", f"""WITH {S.LINES}
SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS label_id, line AS answer FROM lines WHERE regexp_matches(line, '\\S')""")
def answer_lines(spark, root):
    path = scratch_path(spark, "answers")
    W.write_lines(document_lines(spark, root), path, "line", PLACE)
    return R.answer_lines(spark, path)


@query("faq_json", f"WITH {S.PAIRS} SELECT CAST(faq_id AS VARCHAR) AS faq_id, question, answer FROM faq")
def faq_json(spark, root):
    """Several files, each with one object in its first line and something else behind it."""
    path = scratch_path(spark, "faq")
    pairs = faq_pairs(spark, root)
    n = bucket_count(spark) + pairs.count() // 1000
    entry = F.struct(F.col("faq_id").cast("string").alias("k"), F.struct("question", "answer").alias("v"))
    objects = pairs.groupBy(F.pmod(F.xxhash64("faq_id"), F.lit(n)).alias("part")).agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    objects.select("part", F.concat("value", F.lit("\nnot read")).alias("value")).write.partitionBy("part").text(path)
    return R.faq_json(spark, f"{path}/*")


@query("tsv_scan", f"""WITH {S.PAIRS}
SELECT faq_id AS row_no, translate(question, chr(10) || chr(9) || chr(13), '   ') AS question,
       translate(answer, chr(10) || chr(9) || chr(13), '   ') AS answer FROM faq""")
def tsv_scan(spark, root):
    path = scratch_path(spark, "tsv")
    W.write_tsv(faq_pairs(spark, root).select("faq_id", _flat("question"), _flat("answer")), path)
    return R.tsv(spark, path, "row_no string, question string, answer string")


@query("csv_sink", f"WITH {S.PAIRS} SELECT faq_id AS row_no, question, answer FROM faq")
def csv_sink(spark, root):
    path = scratch_path(spark, "csv")
    W.write_csv(faq_pairs(spark, root).select("faq_id", "question", "answer"), path)
    return spark.read.csv(path, schema="row_no string, question string, answer string", escape='"', multiLine=True)


def concat_by_row(left, right):
    """Glue two numbered files side by side; the shorter side is null."""
    return left.withColumnRenamed("line", "question").join(right.withColumnRenamed("line", "answer"), "line_no", "full_outer")


@query("concat_columns", """
WITH q AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS n, replace(text, chr(10), ' ') AS t FROM conversations WHERE role = 'user'),
a AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS n, replace(text, chr(10), ' ') AS t FROM conversations WHERE role = 'assistant')
SELECT coalesce(q.n, a.n) AS row_no, q.t AS question, a.t AS answer FROM q FULL JOIN a ON a.n = q.n""")
def concat_columns(spark, root):
    turns = table(spark, root, "conversations")
    sides = []
    for role in ("user", "assistant"):
        path = scratch_path(spark, role)
        rows = turns.filter(F.col("role") == role).withColumn("line", F.replace("text", F.lit("\n"), F.lit(" ")))
        W.write_lines(rows, path, "line", ["conv_id", "turn"])
        sides.append(R.numbered_lines(spark, path))
    return concat_by_row(*sides).select(F.col("line_no").alias("row_no"), "question", "answer")


@query("vocab_lines", f"""WITH {S.BASIC},
n AS (SELECT token, row_number() OVER (ORDER BY doc_id, line_no, pos) - 1 AS i FROM toks)
SELECT token, CAST(max(i) AS INTEGER) AS id FROM n GROUP BY token""")
def vocab_lines(spark, root):
    path = scratch_path(spark, "vocab")
    W.write_lines(document_tokens(spark, root), path, "token", [*PLACE, "pos"])
    return V.vocab_from_lines(R.numbered_lines(spark, path))


@query("vocab_from_file", f"""WITH {S.LINES},
f AS (
  SELECT '<unk>' AS token, -1 AS doc_id, 0 AS line_no
  UNION ALL SELECT regexp_extract(line, '\\S+'), doc_id, line_no FROM lines WHERE regexp_matches(line, '\\S')),
m AS (SELECT token, min(doc_id * 1000000 + line_no) AS first FROM f GROUP BY token)
SELECT token, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS id FROM m""")
def vocab_from_file(spark, root):
    path = scratch_path(spark, "vocab")
    rows = document_lines(spark, root).filter(F.col("line").rlike(r"\S"))
    head = spark.createDataFrame([(-1, 0, "<unk> 1")], "doc_id bigint, line_no int, line string")
    W.write_lines(head.unionByName(rows), path, "line", PLACE)
    vocab = V.vocab_from_first_field(R.numbered_lines(spark, path))
    V.require_unknown(vocab)
    return vocab


@query("vocab_json", f"WITH {WORD_VOCAB_SQL} SELECT token, id FROM vocab")
def vocab_json(spark, root):
    """Vocabulary as one JSON object (a vocabulary is small by its size limit)."""
    path = scratch_path(spark, "vocab-json")
    entries = F.map_from_entries(F.collect_list(F.struct("token", "id")))
    word_vocab(spark, root).agg(F.to_json(entries).alias("value")).write.text(path)
    return R.json_vocab(spark, path)


@query("corpus_scan", f"""WITH {S.LINES}
SELECT {_SPLIT} AS split, row_number() OVER (PARTITION BY {_SPLIT} ORDER BY doc_id, line_no) - 1 AS line_no, line FROM lines""")
def corpus_scan(spark, root):
    """One folder of text files per split, read back with line numbers."""
    rows = document_lines(spark, root, "source").withColumn("split", split_column())
    parts = []
    for split in ("train", "valid", "test"):
        path = scratch_path(spark, split)
        W.write_lines(rows.filter(F.col("split") == split), path, "line", PLACE)
        parts.append(R.numbered_lines(spark, path).withColumn("split", F.lit(split)))
    return union_files(parts).select("split", "line_no", "line")


@query("feature_cache", ORACLE["bert_features"])
def feature_cache(spark, root):
    """Padded features, written under a digest of what they depend on: the input's files, the vocabulary and the lengths.
    The second call reads what the first one wrote."""
    store = scratch_path(spark, "cache")
    vocab = features.piece_vocab(spark, root)
    digest = vocab.agg(F.sum(F.xxhash64("token", "id").cast("decimal(38,0)")), F.count("*")).first()
    params = {"table": "bert-features", "input": input_files(table(spark, root, "conversations")), "vocabulary": [str(digest[0]), digest[1]],
              "max_len": features.TRAIN_LEN, "stop_words": sorted(features.ENGLISH_STOP_WORDS)}
    W.cached_table(spark, store, params, lambda: features.bert_features(spark, root))

    def again():
        raise AssertionError("the cached table was not found")

    return W.cached_table(spark, store, params, again)
