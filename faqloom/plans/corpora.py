"""Encoded corpora and language-model batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from faqloom.operators import corpora as C
from faqloom.operators import vocab as V
from faqloom.operators.lookup import lookup
from faqloom.operators.negatives import negative_samples
from faqloom.operators.ordering import random_rank
from faqloom.plans import sql as S
from faqloom.plans.features import spaced
from faqloom.plans.registry import query
from faqloom.plans.text import (
    _IDS, PLACE, WORD_VOCAB_SQL, document_lines, encoded_lines, line_tokens, made_once, marked_lines, repeated, word_vocab,
)
from faqloom.session import materialize, scratch_path
from faqloom.sources.files import numbered_lines
from faqloom.sources.sinks import read_corpus, write_corpus, write_lines

KEY = ["source", "doc_id", "line_no"]
BSZ, BPTT, EXT = 8, 32, 16
SEED = 42


def split_column(source="source"):
    """Corpus split by source: sources 16 and 17 for validation, 18 and 19 for the test, all others for training."""
    return F.when(F.col(source).isin("src16", "src17"), "valid").when(
        F.col(source).isin("src18", "src19"), "test").otherwise("train")


_SPLIT = "CASE WHEN source IN ('src16', 'src17') THEN 'valid' WHEN source IN ('src18', 'src19') THEN 'test' ELSE 'train' END"


def encoded(spark, root, name, **markers):
    """Encoded lines of all documents, written once."""

    return made_once(spark, root, name, lambda: encoded_lines(spark, root, word_vocab(spark, root), KEY, **markers))


@query("encode_corpus", f"""{_IDS}
SELECT doc_id, line_no, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM coded GROUP BY doc_id, line_no""")
def encode_corpus(spark, root):
    rows = encoded_lines(spark, root, word_vocab(spark, root), ["doc_id", "line_no"], add_eos=True)
    return rows.select("doc_id", "line_no", spaced(F.col("ids")).alias("ids"))


@query("flat_corpus", f"""{_IDS}
SELECT doc_id, line_no, CAST(sum(n) OVER (ORDER BY doc_id, line_no) - n AS BIGINT) AS at FROM (
  SELECT doc_id, line_no, count(*) AS n FROM coded GROUP BY doc_id, line_no)""")
def flat_corpus(spark, root):
    """Place of each line in the flat corpus."""
    return C.place_lines(encoded(spark, root, "with-eos", add_eos=True)).select("doc_id", "line_no", "at")


_FLAT = f"""{_IDS},
flat AS (SELECT id, row_number() OVER (ORDER BY doc_id, line_no, pos) - 1 AS p, count(*) OVER () // {BSZ} AS n_step FROM coded),
steps AS (
  SELECT id, p // n_step AS lane, p % n_step AS s, n_step, lead(id) OVER (PARTITION BY p // n_step ORDER BY p) AS nxt
  FROM flat WHERE p < n_step * {BSZ})"""


def batch_output(df, *keep):
    return df.select(*keep, "batch", "lane", spaced(F.col("input")).alias("input"), spaced(F.col("target")).alias("target"))


@query("lm_ordered_batches", f"""{_FLAT},
ctx AS (
  SELECT lane, s // {BPTT} AS batch, s, id, nxt, true AS fresh FROM steps WHERE s < n_step - 1
  UNION ALL SELECT lane, s // {BPTT} + 1, s, id, nxt, false FROM steps
  WHERE s % {BPTT} >= {BPTT - EXT} AND (s // {BPTT} + 1) * {BPTT} < n_step - 1)
SELECT batch, CAST(lane AS INTEGER) AS lane, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY s) AS input,
       string_agg(CAST(nxt AS VARCHAR), ' ' ORDER BY s) FILTER (fresh) AS target FROM ctx GROUP BY batch, lane""")
def lm_ordered_batches(spark, root):
    placed = C.place_lines(encoded(spark, root, "with-eos", add_eos=True))
    return batch_output(C.ordered_batches(placed, BSZ, BPTT, EXT))


@query("lm_varlen_batches", f"""{_FLAT},
draws AS (
  SELECT k, CAST(least({BPTT + 15}, greatest(5, CAST(trunc(base + 5 * sqrt(-2.0 * ln(1.0 - u1)) * cos(2.0 * 3.141592653589793 * u2))
         AS BIGINT))) AS BIGINT) AS len FROM (
    SELECT k, CASE WHEN {S.u(SEED, 'k', '0')} < 0.95 THEN {BPTT}.0 ELSE {BPTT / 2} END AS base,
           {S.u(SEED, 'k', '1')} AS u1, {S.u(SEED, 'k', '2')} AS u2
    FROM range((SELECT max(n_step) FROM steps) // 5 + 2) r(k))),
windows AS (SELECT k, len, sum(len) OVER (ORDER BY k) - len AS start FROM draws),
ns AS (SELECT max(n_step) AS n_step FROM steps),
used AS (
  SELECT k, start, least(len, n_step - 1 - start) AS len FROM windows, ns WHERE k = 0 OR start < n_step - 2)
SELECT k AS batch, CAST(lane AS INTEGER) AS lane, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY s) AS input,
       string_agg(CAST(nxt AS VARCHAR), ' ' ORDER BY s) AS target
FROM used JOIN steps ON s >= start AND s < start + len GROUP BY k, lane""")
def lm_varlen_batches(spark, root):
    placed = materialize(C.place_lines(encoded(spark, root, "with-eos", add_eos=True)), "placed")
    return batch_output(C.varlen_batches(placed, BSZ, BPTT, SEED))


def _packed_sql(bsz: int, group: str = "", order: str = "doc_id, line_no", where: str = "true", ext: int = 0) -> str:
    """Packed batches in SQL, one row per pair, from double-marked sentences."""
    g = f"{group}, " if group else ""
    p = f"PARTITION BY {group}" if group else ""
    return f"""
sent AS (
  SELECT {g} doc_id, line_no, count(*) - 1 AS n, list(id ORDER BY pos) AS xs FROM dcoded WHERE {where}
  GROUP BY {g} doc_id, line_no HAVING count(*) > 1),
placed AS (
  SELECT *, sum(n) OVER ({p} ORDER BY {order}) - n AS ahead, sum(n) OVER ({p}) // {bsz * BPTT} * {BPTT} AS len FROM sent),
pairs AS (SELECT {g} len, ahead + unnest(range(n)) AS q, unnest(xs[1:-2]) AS x, unnest(xs[2:]) AS y FROM placed WHERE len > 0),
laned AS (SELECT {g} len, CAST(q // len AS INTEGER) AS lane, CAST(q % len AS BIGINT) AS p, x, y FROM pairs WHERE q < len * {bsz}),
inner_rows AS (
  SELECT {g} lane, p // {BPTT} AS batch, p, x, y, true AS fresh FROM laned
  UNION ALL SELECT {g} lane, p // {BPTT} + 1, p, x, y, false FROM laned
  WHERE p % {BPTT} >= {BPTT - ext} AND (p // {BPTT} + 1) * {BPTT} < len)
SELECT {g} batch, lane, string_agg(CAST(x AS VARCHAR), ' ' ORDER BY p) AS input,
       string_agg(CAST(y AS VARCHAR), ' ' ORDER BY p) FILTER (fresh) AS target
FROM inner_rows GROUP BY {g} batch, lane"""


_SRC = "source, doc_id, line_no"
_DOUBLE = f"""WITH {WORD_VOCAB_SQL},
{S.token_cte('dt', "['<S>'] || " + S.word_list('line', True) + " || ['<S>']", keep=_SRC)},
dcoded AS (
  SELECT source, doc_id, line_no, pos, coalesce(v.id, (SELECT id FROM vocab WHERE token = '<unk>')) AS id
  FROM dt LEFT JOIN vocab v ON v.token = dt.token)"""


def double_marked(spark, root):
    return encoded(spark, root, "double-marked", add_double_eos=True)


@query("lm_packed_batches", f"{_DOUBLE}, {_packed_sql(4, ext=EXT)}")
def lm_packed_batches(spark, root):
    return batch_output(C.packed_batches(double_marked(spark, root), 4, BPTT, EXT))


@query("lm_packed_one_lane", f"{_DOUBLE}, {_packed_sql(1)}")
def lm_packed_one_lane(spark, root):
    return batch_output(C.packed_batches(double_marked(spark, root), 1, BPTT))


@query("lm_multifile_batches", f"""{_DOUBLE},
files AS (
  SELECT source, row_number() OVER (ORDER BY {S.h(SEED, 'source')}, source) - 1 AS file_no
  FROM (SELECT DISTINCT source FROM documents)),
packed AS ({'WITH ' + _packed_sql(2, 'source', S.h(SEED, 'doc_id', 'line_no')).strip()})
SELECT file_no, source, batch, lane, input, target FROM packed JOIN files USING (source)""")
def lm_multifile_batches(spark, root):
    """Files in random order, each packed on its own: batches follow by (file_no, batch)."""
    rows = double_marked(spark, root)
    batches = C.packed_batches(rows, 2, BPTT, 0, ["source"], SEED)
    files = random_rank(rows.select("source").distinct(), ["source"], SEED, "file_no")
    return batch_output(lookup(batches, materialize(files, "file-order"), "source", ["file_no"]), "file_no", "source")


SPLITS = ("train", "valid", "test")
#: A family whose vocabulary is counted on the training split alone meets words it lacks; they get this token.
UNKNOWN = "<unk>"


def _family_rows(spark, root, rules):
    return line_tokens(spark, root, rules.lower).withColumn("split", split_column())


def _family_specials(rules):
    return rules.specials if set(SPLITS) <= set(rules.counted) else (*rules.specials, UNKNOWN)


def _family_sql(name):
    """Batches of a family in one stream per split, from its record."""
    rules = C.FAMILIES[name]
    specials = _family_specials(rules)
    marks = f"UNION ALL SELECT source, doc_id, line_no, 1000000, '{specials[0]}' FROM lines" if rules.markers else ""
    head = "".join(f"SELECT '{t}' AS token, {i} AS id UNION ALL " for i, t in enumerate(specials))
    taken = f"token NOT IN ({S.quoted(specials)}) AND" if specials else ""
    return f"""WITH {S.LINES},
cw AS (
  SELECT doc_id, line_no, CAST(generate_subscripts(ts, 1) - 1 AS INTEGER) AS pos, unnest(ts) AS token, source FROM (
    SELECT doc_id, line_no, source, {S.word_list('line', rules.lower)} AS ts FROM lines)),
cv AS (
  {head} SELECT token, row_number() OVER (ORDER BY cnt DESC, d, l, p) + {len(specials) - 1} AS id FROM (
    SELECT token, count(*) AS cnt, min((doc_id, line_no, pos)) AS f, f[1] AS d, f[2] AS l, f[3] AS p FROM cw
    WHERE {taken} {_SPLIT} IN ({S.quoted(rules.counted)}) GROUP BY token)),
ce AS (
  SELECT {_SPLIT} AS split, doc_id, line_no, pos, coalesce(cv.id, (SELECT u.id FROM cv u WHERE u.token = '{UNKNOWN}')) AS id FROM (
    SELECT source, doc_id, line_no, pos, token FROM cw {marks}) t LEFT JOIN cv USING (token)),
flat AS (
  SELECT split, id, row_number() OVER (PARTITION BY split ORDER BY doc_id, line_no, pos) - 1 AS p,
         count(*) OVER (PARTITION BY split) // {BSZ} AS n_step FROM ce),
steps AS (
  SELECT split, id, p // n_step AS lane, p % n_step AS s, n_step,
         lead(id) OVER (PARTITION BY split, p // n_step ORDER BY p) AS nxt FROM flat WHERE p < n_step * {BSZ})
SELECT split, s // {BPTT} AS batch, CAST(lane AS INTEGER) AS lane, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY s) AS input,
       string_agg(CAST(nxt AS VARCHAR), ' ' ORDER BY s) AS target
FROM steps WHERE s < n_step - 1 GROUP BY split, s // {BPTT}, lane"""


def family_corpus(spark, root, name):
    """Count, build the vocabulary, encode and batch all splits of a corpus family, as its record says."""
    rules = C.FAMILIES[name]
    rows, specials = _family_rows(spark, root, rules), _family_specials(rules)
    vocab = materialize(V.build_vocab(materialize(
        V.counts_of_lists(rows.filter(F.col("split").isin(*rules.counted)), PLACE[:2]), "counted"), specials), "vocab")
    unknown = {"unknown": "token", "unknown_id": V.id_of(vocab, UNKNOWN)} if UNKNOWN in specials else {}
    coded = C.encode_lists(marked_lines(rows, **rules.markers), vocab, **unknown)
    if repeated(spark, root):
        coded = C.merge_lists(coded, "ids", ["split", *KEY])
    coded = materialize(coded, "corpus")
    out = None
    for split in SPLITS:
        part = batch_output(C.family_batches(name, coded, split, BSZ, BPTT)).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def _register(name, key):
    @query(key, _family_sql(name))
    def family(spark, root):
        return family_corpus(spark, root, name)


for _name in ("wt2", "ptb", "wt103", "enwik8", "text8"):
    _register(_name, "corpus_batches" if _name == "wt2" else f"corpus_batches_{_name}")

_MARK = "<S>"
_FILE = f"""WITH {S.LINES},
cw AS (
  SELECT source, doc_id, line_no, CAST(generate_subscripts(ts, 1) - 1 AS INTEGER) AS pos, unnest(ts) AS token FROM (
    SELECT source, doc_id, line_no, ['{_MARK}'] || {S.word_list('line')} || ['{_MARK}'] AS ts FROM lines)),
fv AS (
  SELECT token, CAST(row_number() OVER (ORDER BY token NOT IN ('{UNKNOWN}', '{_MARK}'), token <> '{UNKNOWN}', token) - 1 AS INTEGER) AS id
  FROM (SELECT token FROM cw WHERE {_SPLIT} = 'train' UNION SELECT '{UNKNOWN}')),
dcoded AS (
  SELECT source, doc_id, line_no, pos, coalesce(fv.id, 0) AS id FROM cw LEFT JOIN fv USING (token))"""


@query("corpus_batches_packed", f"""{_FILE},
train AS ({'WITH ' + _packed_sql(2, 'source', S.h(SEED, 'doc_id', 'line_no'), f"{_SPLIT} = 'train'").strip()}),
valid AS ({'WITH ' + _packed_sql(2, where=f"{_SPLIT} = 'valid'").strip()}),
test AS ({'WITH ' + _packed_sql(2, where=f"{_SPLIT} = 'test'").strip()})
SELECT 'train' AS split, source, batch, lane, input, target FROM train
UNION ALL SELECT 'valid', NULL, batch, lane, input, target FROM valid
UNION ALL SELECT 'test', NULL, batch, lane, input, target FROM test""")
def corpus_batches_packed(spark, root):
    """The sentence-packed family: its vocabulary comes from a file (here one with the words of the training split, the
    unknown token and the sentence mark first), training goes file by file in random order, the other splits in one stream."""
    rules = C.FAMILIES["lm1b"]
    rows = _family_rows(spark, root, rules)
    words = rows.filter("split = 'train'").select(F.explode("tokens").alias("token")).distinct()
    head = spark.createDataFrame([(UNKNOWN, 0), (_MARK, 1)], "token string, head int")
    known = head.unionByName(words.filter(~F.col("token").isin(UNKNOWN, _MARK)).withColumn("head", F.lit(2)))
    path = scratch_path(spark, "vocab-file")
    write_lines(known, path, "token", ["head", "token"])
    vocab = materialize(V.vocab_from_first_field(numbered_lines(spark, path)), "vocab")
    unknown = V.id_of(vocab, V.require_unknown(vocab))
    coded = C.encode_lists(marked_lines(rows, **rules.markers), vocab, "token", unknown)
    if repeated(spark, root):
        coded = C.merge_lists(coded, "ids", ["split", *KEY])
    coded = materialize(coded, "corpus")
    out = None
    for split in SPLITS:
        part = C.family_batches("lm1b", coded, split, 2, BPTT, shuffle_seed=SEED).withColumn("split", F.lit(split))
        part = part if "source" in part.columns else part.withColumn("source", F.lit(None).cast("string"))
        part = batch_output(part, "split", "source")
        out = part if out is None else out.unionByName(part)
    return out


@query("corpus_tables_sink", f"""WITH {WORD_VOCAB_SQL}, {S.token_cte('et', S.word_list('line', True) + " || ['<eos>']", keep=_SRC)}
SELECT {_SPLIT} AS split, doc_id, line_no, string_agg(token, ' ' ORDER BY pos) AS text FROM (
  SELECT source, doc_id, line_no, pos, coalesce(v.token, '<unk>') AS token FROM et LEFT JOIN vocab v ON v.token = et.token)
GROUP BY source, doc_id, line_no""")
def corpus_tables_sink(spark, root):
    """Write vocabulary and encoded corpus apart, read both and decode."""
    path = scratch_path(spark, "corpus")
    rows = encoded(spark, root, "with-eos", add_eos=True).withColumn("split", split_column())
    write_corpus(word_vocab(spark, root), rows, path)
    vocab, stored = read_corpus(spark, path)
    named = C.decode_lists(stored.select("split", "doc_id", "line_no", "ids"), vocab)
    return named.select("split", "doc_id", "line_no", V.words_to_text(F.col("tokens")).alias("text"))


_N_SAMPLE, _LABELS = 10, 64


@query("negative_samples", f"""WITH {WORD_VOCAB_SQL},
r AS (SELECT count(*) AS n FROM vocab),
drawn AS (
  SELECT DISTINCT batch, CAST(floor(exp({S.u(SEED, 'batch', 'j')} * ln(n + 1.0))) - 1 AS INTEGER) AS negative
  FROM (SELECT DISTINCT id // {_LABELS} AS batch FROM vocab), r, range({2 * _N_SAMPLE}) k(j)),
q AS (
  SELECT id AS c, ln(1 - pow(1 - (ln(id + 2.0) - ln(id + 1.0)) / ln(n + 1.0), {2 * _N_SAMPLE})) AS lp FROM vocab, r)
SELECT CAST(v.id // {_LABELS} AS BIGINT) AS batch, v.id AS label, negative, round(t.lp, 6) AS true_log_prob, round(s.lp, 6) AS samp_log_prob,
       negative = v.id AS hit
FROM vocab v JOIN drawn ON drawn.batch = v.id // {_LABELS} JOIN q t ON t.c = v.id JOIN q s ON s.c = negative""")
def negatives(spark, root):
    """Log-uniform negatives from the vocabulary, one set for every batch of labels."""
    words = word_vocab(spark, root)
    labels = words.select(F.expr(f"id div {_LABELS}").alias("batch"), F.col("id").alias("label"))
    rows = negative_samples(labels, words.count(), _N_SAMPLE, SEED)
    return rows.select(
        "batch", "label", "negative", F.round("true_log_prob", 6).alias("true_log_prob"),
        F.round("samp_log_prob", 6).alias("samp_log_prob"), "hit")
