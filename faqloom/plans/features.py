"""Example and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from faqloom.functions.wordlists import ENGLISH_STOP_WORDS
from faqloom.operators import features as X
from faqloom.plans import sql as S
from faqloom.plans.registry import query
from faqloom.plans.text import _PIECE_VOCAB, longest_piece, piece_vocab, walk_sql
from faqloom.session import scratch_path
from faqloom.sources.files import labelled_csv
from faqloom.sources.tables import faq_pairs, spread, table, turn_id

TRAIN_LEN, SERVE_LEN = 340, 512


def spaced(column):
    return F.array_join(column, " ")


def pair_texts(spark, root):
    """User turn and the assistant turn behind it as a text pair; the last user turn of a conversation stands alone."""
    turns = spread(table(spark, root, "conversations"), "conv_id")
    users = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("text_a"))
    replies = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_b"))
    return users.join(replies, ["conv_id", "turn"], "left").select(
        turn_id().alias("guid"), "conv_id", "text_a", "text_b")


_PAIR_TEXTS = """
pair_texts AS (
  SELECT u.conv_id || ':' || u.turn AS guid, u.conv_id, u.text AS text_a, a.text AS text_b
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""


def piece_lists(stop: bool) -> str:
    """Piece lists of both sides in SQL, from the same vocabulary."""
    keep = f"lambda p: p NOT IN ({S.STOP})" if stop else "lambda p: true"
    return f"""{_PIECE_VOCAB}, {_PAIR_TEXTS},
sides AS (
  SELECT guid, 0 AS side, {S.basic_list('text_a')} AS ts FROM pair_texts
  UNION ALL SELECT guid, 1, {S.basic_list('text_b')} FROM pair_texts WHERE text_b IS NOT NULL),
st AS (SELECT guid, side, generate_subscripts(ts, 1) AS pos, unnest(ts) AS token FROM sides),
words AS (SELECT DISTINCT token AS word FROM st), {walk_sql('words')},
joined AS (
  SELECT guid, side, flatten(list(w.pieces ORDER BY pos)) AS pieces
  FROM st JOIN split_words w ON w.word = st.token GROUP BY guid, side),
lists AS (
  SELECT p.guid, p.text_b IS NOT NULL AND p.text_b <> '' AS is_pair,
         coalesce(list_filter(a.pieces, {keep}), []) AS pa, coalesce(b.pieces, []) AS pb
  FROM pair_texts p LEFT JOIN joined a ON a.guid = p.guid AND a.side = 0
  LEFT JOIN joined b ON b.guid = p.guid AND b.side = 1)"""


def feature_rows(source: str, max_len: int) -> str:
    return f"""
full_rows AS (
  SELECT guid, ['[CLS]'] || pa || ['[SEP]'] || (CASE WHEN len(pb) > 0 THEN pb || ['[SEP]'] ELSE [] END) AS ps,
         len(pa) + 2 AS na FROM {source}),
ids AS (
  SELECT f.guid, any_value(f.na) AS na, list(p.id ORDER BY f.i) AS xs, count(*) AS n FROM (
    SELECT guid, na, generate_subscripts(ps, 1) AS i, unnest(ps) AS piece FROM full_rows) f
  JOIN pieces p ON p.token = f.piece GROUP BY f.guid),
fitted AS (
  SELECT guid, xs || list_transform(range(greatest({max_len} - n, 0)), lambda i: 0) AS input_ids,
         list_transform(range({max_len}), lambda i: CASE WHEN i < n THEN 1 ELSE 0 END) AS input_mask,
         list_transform(range({max_len}), lambda i: CASE WHEN i >= na AND i < n THEN 1 ELSE 0 END) AS segment_ids, n
  FROM ids)"""


# the pair truncation of the check pops token by token, on running counts
_TRUNCATED = """
popped(guid, la, lb) AS (
  SELECT guid, len(pa), len(pb) FROM lists WHERE is_pair
  UNION ALL
  SELECT guid, CASE WHEN la > lb THEN la - 1 ELSE la END, CASE WHEN la > lb THEN lb ELSE lb - 1 END
  FROM popped WHERE la + lb > {room}),
kept AS (SELECT guid, min(la) AS la, min(lb) AS lb FROM popped GROUP BY guid)"""


@query("bert_features", f"""
WITH RECURSIVE {piece_lists(True)}, {_TRUNCATED.format(room=TRAIN_LEN - 3)},
cut AS (
  SELECT l.guid, CASE WHEN is_pair THEN list_slice(pa, 1, k.la) ELSE list_slice(pa, 1, {TRAIN_LEN - 2}) END AS pa,
         CASE WHEN is_pair THEN list_slice(pb, 1, k.lb) ELSE [] END AS pb
  FROM lists l LEFT JOIN kept k ON k.guid = l.guid), {feature_rows('cut', TRAIN_LEN)}
SELECT guid, array_to_string(input_ids, ' ') AS input_ids, array_to_string(input_mask, ' ') AS input_mask,
       array_to_string(segment_ids, ' ') AS segment_ids,
       CASE WHEN CAST(split_part(guid, ':', 1) AS BIGINT) % 2 = 0 THEN '1.0 0.0' ELSE '0.0 1.0' END AS label_ids FROM fitted""")
def bert_features(spark, root):
    texts = pair_texts(spark, root)
    rows = X.bert_features(
        texts, piece_vocab(spark, root), longest_piece(spark, root), TRAIN_LEN, ENGLISH_STOP_WORDS)
    labels = texts.select("guid", F.array(F.expr("CAST(conv_id % 2 AS INT)")).alias("labels"))
    rows = X.with_labels(rows, labels, 2)
    return rows.select("guid", *[spaced(F.col(c)).alias(c) for c in ("input_ids", "input_mask", "segment_ids")],
                       spaced(F.col("label_ids").cast("array<string>")).alias("label_ids"))


@query("serve_features", f"""
WITH RECURSIVE {piece_lists(False)}, {feature_rows('lists', SERVE_LEN)}
SELECT guid, CASE WHEN n <= {SERVE_LEN} THEN array_to_string(input_ids, ' ') END AS input_ids,
       CASE WHEN n <= {SERVE_LEN} THEN array_to_string(input_mask, ' ') END AS input_mask,
       CASE WHEN n <= {SERVE_LEN} THEN array_to_string(segment_ids, ' ') END AS segment_ids,
       n > {SERVE_LEN} AS too_long FROM fitted""")
def serve_features(spark, root):
    """No stop filter, no cut; a row that does not fit is marked instead of failing the whole table."""
    rows = X.bert_features(
        pair_texts(spark, root), piece_vocab(spark, root), longest_piece(spark, root), SERVE_LEN,
        truncate=False, on_overflow="reject")
    return rows.select(
        "guid", *[spaced(F.col(c)).alias(c) for c in ("input_ids", "input_mask", "segment_ids")], "too_long")


@query("truncate_pair", f"""
WITH RECURSIVE {piece_lists(True)}, {_TRUNCATED.format(room=97)}
SELECT guid, CAST(la AS INTEGER) AS la, CAST(lb AS INTEGER) AS lb FROM kept""")
def truncate_pair(spark, root):
    """Kept lengths of each pair when 100 positions are there for both."""
    texts = pair_texts(spark, root)
    lists = X.piece_id_lists(texts, piece_vocab(spark, root), longest_piece(spark, root), stop_words=ENGLISH_STOP_WORDS)
    pairs = texts.filter("length(text_b) > 0").select("guid").join(lists, "guid")
    la, lb = X.pair_lengths(F.size("ids_a"), F.size("ids_b"), 97)
    return pairs.select("guid", la.cast("int").alias("la"), lb.cast("int").alias("lb"))


@query("truncate_single", f"""
SELECT conv_id, turn, array_to_string(list_slice({S.basic_list('text')}, 1, 30), ' ') AS tokens FROM conversations""")
def truncate_single(spark, root):
    from faqloom.functions.text import basic_token_array

    rows = spread(table(spark, root, "conversations"), "conv_id")
    return rows.select("conv_id", "turn", spaced(X.truncate_single(basic_token_array(F.col("text")), 32)).alias("tokens"))


@query("pairs_next_turn", f"WITH {_PAIR_TEXTS} SELECT guid, text_a, text_b FROM pair_texts")
def pairs_next_turn(spark, root):
    return pair_texts(spark, root).drop("conv_id")


def _labelled_rows(spark, root):
    """Labelled documents in the written form: guid, class literal, question."""
    rows = table(spark, root, "labels").join(table(spark, root, "documents").select("doc_id", "text"), "doc_id")
    labels = F.filter(F.array(F.when(F.col("quality") == 1, 0), F.when(F.col("toxic") == 1, 1)), lambda x: x.isNotNull())
    return rows.select(
        F.col("doc_id").alias("guid"), F.concat(F.lit("["), F.array_join(labels.cast("array<string>"), ", "), F.lit("]")).alias("class"),
        F.col("text").alias("question"))


_LABELLED = """
labelled AS (
  SELECT l.doc_id AS guid, list_filter([CASE WHEN quality = 1 THEN 0 END, CASE WHEN toxic = 1 THEN 1 END],
         lambda x: x IS NOT NULL) AS labels, d.text AS question
  FROM labels l JOIN documents d USING (doc_id))"""


@query("examples", f"WITH {_LABELLED} SELECT guid, question AS text_a, array_to_string(labels, ' ') AS labels FROM labelled")
def examples(spark, root):
    return X.examples(_labelled_rows(spark, root)).withColumn("labels", spaced(F.col("labels")))


@query("labelled_csv", f"WITH {_LABELLED} SELECT guid, array_to_string(labels, ' ') AS labels, question AS text_a FROM labelled")
def labelled_csv_query(spark, root):
    path = scratch_path(spark, "labelled")
    _labelled_rows(spark, root).write.csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return labelled_csv(spark, path).select("guid", spaced(F.col("labels")).alias("labels"), F.col("question").alias("text_a"))


@query("multi_hot", "SELECT doc_id, CASE WHEN quality = 1 THEN '1 ' ELSE '0 ' END || CASE WHEN toxic = 1 THEN '1 0 0' ELSE '0 0 0' END AS vector FROM labels")
def multi_hot(spark, root):
    labels = table(spark, root, "labels")
    found = F.filter(F.array(
        F.when(F.col("quality") == 1, 0), F.when(F.col("toxic") == 1, 1), F.when(F.col("quality") == 1, 0)),
        lambda x: x.isNotNull())
    return labels.select("doc_id", spaced(X.multi_hot(found, 4)).alias("vector"))


@query("faq_pairs", f"WITH {S.PAIRS} SELECT faq_id, question, answer FROM faq")
def faq_pairs_query(spark, root):
    return faq_pairs(spark, root).select("faq_id", "question", "answer")
