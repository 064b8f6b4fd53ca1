"""Text, token and vocabulary queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faqloom.functions import text as T
from faqloom.functions.repair import repair_text as repaired
from faqloom.functions.segment import segment_words as segmented
from faqloom.functions.wordlists import ENGLISH_STOP_WORDS
from faqloom.operators import tokens as K
from faqloom.operators import vocab as V
from faqloom.operators.corpora import decode_lists, encode_lists, merge_lists
from faqloom.operators.features import drop_stop_words
from faqloom.operators.lookup import fits_broadcast, lookup, lookup_lists
from faqloom.operators.urls import url_index, url_profile
from faqloom.plans import sql as S
from faqloom.plans.registry import query
from faqloom.session import materialize
from faqloom.sources.tables import documents, lines, spread, table

PLACE = ["doc_id", "line_no", "pos"]
LINE = ["doc_id", "line_no"]
SPECIAL_PIECES = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
WORD_PIECES, SUFFIX_PIECES, LONGEST_SUFFIX = 3000, 1000, 4
MERGES, LONGEST_MERGE = 500, 4
WORD_VOCAB, WORD_SPECIALS = 5000, ("<eos>", "<unk>")
BANDS = (200, 1000, 4000)

_made: dict[tuple, object] = {}


def _stamp(spark: SparkSession, root: str) -> tuple:
    """What is under a path: bytes, files and the times of its entries.  Other data under the same path give another stamp."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    held = system.getContentSummary(path)
    times = sorted(entry.getModificationTime() for entry in system.listStatus(path))
    return held.getLength(), held.getFileCount(), tuple(times)


def kept_once(spark: SparkSession, root: str, name: str, build):
    """What ``build`` gives, once per session, input and state of the input."""
    key = (spark.sparkContext.applicationId, root, name)
    stamp = _stamp(spark, root)
    if key not in _made or _made[key][0] != stamp:
        _made[key] = stamp, build()  # in place of what an older state gave
    return _made[key][1]


def made_once(spark: SparkSession, root: str, name: str, build) -> DataFrame:
    """Tables many queries start from (vocabularies and the like) are written once per session and input."""
    return kept_once(spark, root, name, lambda: materialize(build(), name, "zstd"))


def document_lines(spark, root, *columns, regroup=False) -> DataFrame:
    return lines(documents(spark, root, *columns, regroup=regroup), "doc_id", *columns)


def document_tokens(spark, root) -> DataFrame:
    return K.basic_tokens(document_lines(spark, root), *LINE)


def document_words(spark, root, regroup=False, **options) -> DataFrame:
    return K.word_tokens(document_lines(spark, root, regroup=regroup), *LINE, lower=True, **options)


def line_tokens(spark, root, lower=True) -> DataFrame:
    """The word-level tokens of every line, worked out and written once: doc_id, line_no, source (if there is one), tokens.

    They cost more than a shuffle of the texts, and a file of few row groups is read by few tasks whatever its number of
    splits: so texts are dealt out by document at any size.
    """
    keep = [c for c in table(spark, root, "documents").columns if c == "source"]
    lines = lambda: document_lines(spark, root, *keep, regroup=True)
    return made_once(spark, root, f"line-tokens-{lower}", lambda: lines().select(
        *LINE, *keep, T.word_token_array(F.col("line"), lower).alias("tokens")))


def marked_lines(listed: DataFrame, add_eos=False, add_double_eos=False) -> DataFrame:
    """Lines with the markers of the word tokenizer around their tokens."""
    mark = F.array(F.lit("<S>" if add_double_eos else "<eos>"))
    if add_double_eos:
        return listed.withColumn("tokens", F.concat(mark, "tokens", mark))
    return listed.withColumn("tokens", F.concat("tokens", mark)) if add_eos else listed


def repeated(spark, root) -> bool:
    """Whether any document number occurs twice: lines of equal number are merged."""
    return kept_once(spark, root, "repeated", lambda: not table(spark, root, "documents").groupBy("doc_id").count().filter(
        "count > 1").isEmpty())


def encoded_lines(spark, root, vocab, key, unknown="token", **markers) -> DataFrame:
    """The ids of every line: ``key``, ``ids``."""
    unknown_id = V.id_of(vocab, V.require_unknown(vocab)) if unknown == "token" else None
    listed = marked_lines(line_tokens(spark, root), **markers).select(*key, "tokens")
    coded = encode_lists(listed, vocab, unknown, unknown_id)
    return merge_lists(coded, "ids", key) if repeated(spark, root) else coded


def token_table(spark, root) -> DataFrame:
    """Counted basic tokens, written once: the WordPiece vocabulary and the words to split both read them."""
    return made_once(spark, root, "token-counts", lambda: V.token_counts(document_tokens(spark, root)))


def bpe_texts(spark, root) -> DataFrame:
    """The byte-pair words of every document, worked out and written once: doc_id, words.

    The rules cost far more than a shuffle of the texts, and a file of few row groups is read by few tasks whatever its
    number of splits: so texts are dealt out by document at any size.
    """
    return made_once(spark, root, "bpe-texts", lambda: K.bpe_texts(documents(spark, root, regroup=True), "doc_id"))


def bpe_rows(texts: DataFrame, width: int, lists: str, *head: Column) -> DataFrame:
    """What ``lists`` holds for each byte-pair word of all documents, dealt out by document: doc_id, pos, token.  ``head``
    comes ahead of every document's words, at negative places."""
    kind = texts.schema[lists].dataType
    words = F.concat(F.array(*head).cast(kind), F.coalesce(lists, F.array().cast(kind)))
    rows = texts.repartition(width, "doc_id").select("doc_id", F.posexplode(words).alias("pos", "token"))
    return rows.withColumn("pos", F.col("pos") - len(head))


def bpe_word_table(spark, root) -> DataFrame:
    """Counted byte-pair words, written once."""
    words = lambda: bpe_texts(spark, root).select(F.explode("words").alias("token"))
    return made_once(spark, root, "bpe-words", lambda: K.distinct_words(words()))


def piece_vocab(spark, root) -> DataFrame:
    """WordPiece vocabulary of the documents: specials, frequent words, characters, frequent endings."""

    def build():
        counted = token_table(spark, root).filter(~F.col("token").isin(*SPECIAL_PIECES))
        long = counted.filter(F.length("token") > 1)
        words = long.orderBy(F.desc("n"), "token").limit(WORD_PIECES).select(F.lit(1).alias("kind"), "token", "n")
        chars = counted.select(F.explode(F.filter(F.split("token", ""), lambda c: c != "")).alias("token"), "n")
        chars = chars.groupBy("token").agg(F.sum("n").alias("n"))
        endings = long.select(
            F.explode(F.sequence(F.lit(2), F.lit(LONGEST_SUFFIX))).alias("k"), "token", "n"
        ).filter("length(token) > k").select(F.expr("right(token, k)").alias("token"), "n")
        endings = endings.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(SUFFIX_PIECES)
        ranked = (
            words.unionByName(chars.select(F.lit(2).alias("kind"), "token", "n"))
            .unionByName(chars.select(F.lit(3).alias("kind"), F.concat(F.lit("##"), "token").alias("token"), "n"))
            .unionByName(endings.select(F.lit(4).alias("kind"), F.concat(F.lit("##"), "token").alias("token"), "n"))
        )
        # a few thousand rows by construction, so one ordered list is fine
        number = F.row_number().over(Window.orderBy("kind", F.desc("n"), "token")) + len(SPECIAL_PIECES) - 1
        head = spark.createDataFrame(
            [(t, i, 0) for i, t in enumerate(SPECIAL_PIECES)], "token string, id int, cnt bigint")
        return head.unionByName(ranked.select("token", number.cast("int").alias("id"), F.col("n").alias("cnt")))

    return made_once(spark, root, "piece-vocab", build)


def longest_piece(spark, root) -> int:
    return piece_vocab(spark, root).agg(F.max(F.length("token"))).first()[0]


def word_counts(spark, root) -> DataFrame:
    """Counted words with their first place, written once: ranks, specials and order buckets all read them."""
    return made_once(spark, root, "word-counts", lambda: V.counts_of_lists(line_tokens(spark, root), LINE))


def word_vocab(spark, root) -> DataFrame:
    def build():
        return V.build_vocab(word_counts(spark, root), WORD_SPECIALS, WORD_VOCAB, 2)

    return made_once(spark, root, "word-vocab", build)


def merge_table(spark, root) -> DataFrame:
    """Byte-pair merges of the documents: frequent symbol runs, the last symbol joined to the run ahead of it."""

    def build():
        words = K.counted_words(bpe_word_table(spark, root), "word")
        counted = K.symbol_runs(words, LONGEST_MERGE).groupBy("left", "right").agg(F.sum("n").alias("n"))
        order = [F.desc("n"), F.asc("left"), F.asc("right")]
        top = counted.orderBy(*order).limit(MERGES)
        return top.select("left", "right", (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))

    return made_once(spark, root, "merges", build)


# ---------------------------------------------------------------- normalisation and tokens

@query("normalize_faq", f"""
SELECT conv_id, turn, {S.normalized('text')} AS text_norm, {S.normalized('text', True)} AS text_lower
FROM conversations""")
def normalize_faq(spark, root):
    rows = spread(table(spark, root, "conversations"), "conv_id")
    return rows.select(
        "conv_id", "turn", T.normalize_question(F.col("text")).alias("text_norm"),
        T.normalize_question(F.col("text"), lower=True).alias("text_lower"))


@query("basic_tokens", f"WITH {S.BASIC} SELECT doc_id, line_no, pos, token FROM toks")
def basic_tokens(spark, root):
    return document_tokens(spark, root)


@query("word_tokens", f"""
WITH {S.LINES}, {S.token_cte('toks', "['<S>'] || " + S.word_list('line') + " || ['<S>']")}
SELECT doc_id, line_no, pos, token FROM toks""")
def word_tokens(spark, root):
    return K.word_tokens(document_lines(spark, root), *LINE, add_eos=True, add_double_eos=True)


@query("char_tokens", f"""
WITH chars AS (SELECT unnest(string_split(trim({S.clean('text')}), '')) AS token FROM conversations)
SELECT token, count(*) AS n FROM chars WHERE token <> '' GROUP BY token""")
def char_tokens(spark, root):
    """Word-level tokenizer with an empty delimiter: characters."""
    rows = spread(table(spark, root, "conversations"), "conv_id")
    return V.token_counts(K.word_tokens(rows, text="text", delimiter=""))


_PIECE_VOCAB = S.BASIC + f""",
counted AS (SELECT token, count(*) AS n FROM toks WHERE token NOT IN ({S.quoted(SPECIAL_PIECES)}) GROUP BY token),
chars AS (SELECT c AS token, sum(n) AS n FROM (SELECT unnest(string_split(token, '')) AS c, n FROM counted) GROUP BY c),
endings AS (
  SELECT right(token, k) AS token, sum(n) AS n FROM counted, range(2, {LONGEST_SUFFIX + 1}) r(k)
  WHERE length(token) > k GROUP BY 1 ORDER BY n DESC, token LIMIT {SUFFIX_PIECES}),
ranked AS (
  SELECT * FROM (SELECT 1 AS kind, token, n FROM counted WHERE length(token) > 1 ORDER BY n DESC, token LIMIT {WORD_PIECES})
  UNION ALL SELECT 2, token, n FROM chars
  UNION ALL SELECT 3, '##' || token, n FROM chars
  UNION ALL SELECT 4, '##' || token, n FROM endings),
pieces AS (
  SELECT token, CAST(id AS INTEGER) AS id, CAST(cnt AS BIGINT) AS cnt FROM (
    SELECT unnest([{S.quoted(SPECIAL_PIECES)}]) AS token, unnest(range({len(SPECIAL_PIECES)})) AS id, 0 AS cnt
    UNION ALL
    SELECT token, row_number() OVER (ORDER BY kind, n DESC, token) + {len(SPECIAL_PIECES) - 1}, n FROM ranked))"""


def walk_sql(words: str) -> str:
    """Greedy longest match, one piece per step, from a table of distinct words."""
    return f"""
walk(word, nxt, parts) AS (
  SELECT word, 1, CAST([] AS VARCHAR[]) FROM {words} WHERE length(word) <= 100
  UNION ALL
  SELECT word, any_value(nxt) + max(len), list_append(any_value(parts), arg_max(piece, len)) FROM (
    SELECT word, nxt, parts, len, (CASE WHEN nxt > 1 THEN '##' ELSE '' END) || substr(word, nxt, CAST(len AS INTEGER)) AS piece
    FROM walk, range(1, 101) r(len) WHERE nxt + len - 1 <= length(word)) c
  JOIN pieces ON piece = token GROUP BY word),
split_words AS (
  SELECT w.word, coalesce(f.parts, ['[UNK]']) AS pieces FROM {words} w
  LEFT JOIN (SELECT word, parts FROM walk WHERE nxt = length(word) + 1) f ON f.word = w.word)"""


WORDPIECE = f"{_PIECE_VOCAB}, words AS (SELECT DISTINCT token AS word FROM toks), {walk_sql('words')}"
_PIECES = f"""WITH RECURSIVE {WORDPIECE},
rows AS (
  SELECT doc_id, line_no, pos, unnest(pieces) AS token, CAST(generate_subscripts(pieces, 1) - 1 AS INTEGER) AS piece_no
  FROM toks JOIN split_words ON token = word)"""


def document_pieces(spark, root):
    def build():
        return K.piece_table(K.counted_words(token_table(spark, root)), piece_vocab(spark, root), longest_piece(spark, root))

    pieces = kept_once(spark, root, "word-pieces", build)
    listed = document_lines(spark, root).select(*LINE, T.basic_token_array(F.col("line")).alias("tokens"))
    return K.piece_rows(K.wordpieces_of_lists(listed, pieces, *LINE), *LINE)


@query("wordpiece", f"{_PIECES} SELECT doc_id, line_no, pos, piece_no, token FROM rows")
def wordpiece(spark, root):
    return document_pieces(spark, root)


@query("drop_stopwords", f"{_PIECES} SELECT doc_id, line_no, pos, piece_no, token FROM rows WHERE token NOT IN ({S.STOP})")
def drop_stopwords(spark, root):
    return drop_stop_words(document_pieces(spark, root), ENGLISH_STOP_WORDS)


# The same characters and patterns as in the standardiser.
_STANDARD = (
    "regexp_replace(regexp_replace(regexp_replace(replace(translate(text, '—–―´', '---'''), '…', '...'), "
    "'(-+|~+|!+|\"+|;+|\\?+|\\++|,+|\\)+|\\(+|\\\\+|/+|\\*+|\\[+|\\]+|\\}+|\\{+|\\|+|_+)', ' \\1 ', 'g'), "
    "'\\s*\\n\\s*', ' ' || chr(10) || ' ', 'g'), '[^\\S\\n]+', ' ', 'g')"
)


@query("standardize_corpus", f"""
SELECT doc_id, trim({_STANDARD}, ' ' || chr(10)) AS text_std FROM documents""")
def standardize_corpus(spark, root):
    return documents(spark, root).select("doc_id", T.standardize_text(F.col("text")).alias("text_std"))


_SEGMENTS = f"{S.repaired_cte('SELECT doc_id, text AS t FROM documents')}, {S.segments_cte(f'r{S.R.ROUNDS}', _STANDARD.replace('(text,', '(t,'))}"


@query("segment_words", f"""WITH {_SEGMENTS}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ci, ti) - 1 AS INTEGER) AS pos, token
FROM (SELECT doc_id, ci, generate_subscripts(tokens, 1) AS ti, unnest(tokens) AS token FROM segs)""")
def segment_words(spark, root):
    """The words of every repaired and standardised document, by the rules for prefixes, suffixes, infixes and exceptions."""
    words = segmented(T.standardize_text(repaired(F.col("text"))))
    return documents(spark, root).select("doc_id", F.posexplode(words).alias("pos", "token"))


@query("repair_text", f"""WITH {S.repaired_cte('SELECT doc_id, text AS t FROM documents')}
SELECT doc_id, t AS text, t AS damaged_once, t AS damaged_twice FROM r{S.R.ROUNDS}""")
def repair_text(spark, root):
    """Every document repaired as it is, and after its bytes were read wrongly once and twice: each time the same text."""

    def damaged(text):
        return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")

    once = damaged(F.col("text"))
    return documents(spark, root).select(
        "doc_id", repaired(F.col("text")).alias("text"), repaired(once).alias("damaged_once"), repaired(damaged(once)).alias("damaged_twice"))


_BPE_WORDS = f"""{_SEGMENTS},
bw AS MATERIALIZED (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ci, ti) - 1 AS INTEGER) AS pos, lower(token) AS word
  FROM (SELECT doc_id, ci, generate_subscripts(tokens, 1) AS ti, unnest(tokens) AS token FROM segs)),
dw AS (SELECT word, count(*) AS n FROM bw GROUP BY word),
sym AS (
  SELECT word, n, list_append(list_slice(cs, 1, len(cs) - 1), cs[-1] || '</w>') AS s
  FROM (SELECT word, n, string_split(word, '') AS cs FROM dw))"""


@query("adjacent_pairs", f"""
WITH {_BPE_WORDS}
SELECT p[1] AS "left", p[2] AS "right", CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT n, unnest(list_distinct(list_transform(range(1, len(s)), lambda i: [s[i], s[i + 1]]))) AS p FROM sym WHERE len(s) > 1)
GROUP BY 1, 2""")
def adjacent_pairs(spark, root):
    return K.adjacent_pairs(K.counted_words(bpe_word_table(spark, root), "word"))


_MERGES = f"""{_BPE_WORDS},
merges AS (
  SELECT l, r, CAST(row_number() OVER (ORDER BY c DESC, l, r) - 1 AS INTEGER) AS rank FROM (
    SELECT array_to_string(s[i:i + k - 2], '') AS l, s[i + k - 1] AS r, sum(n) AS c
    FROM (SELECT s, n, unnest(range(1, len(s))) AS i FROM sym), range(2, {LONGEST_MERGE + 1}) q(k)
    WHERE i + k - 1 <= len(s) GROUP BY 1, 2 ORDER BY c DESC, l, r LIMIT {MERGES}))"""


@query("bpe_tables", f'WITH {_MERGES} SELECT l AS "left", r AS "right", rank FROM merges')
def bpe_tables(spark, root):
    """Merge file round trip: header line, one merge per line, rank by line."""
    from faqloom.session import scratch_path
    from faqloom.sources.files import merge_file
    from faqloom.sources.sinks import write_lines

    head = spark.createDataFrame([(-1, "#version: 1")], "rank int, line string")
    body = merge_table(spark, root).select("rank", F.concat_ws(" ", "left", "right").alias("line"))
    path = scratch_path(spark, "merge-file")
    write_lines(head.unionByName(body), path, "line", ["rank"])
    return merge_file(spark, path)


_BPE_DONE = f"""
WITH RECURSIVE {_MERGES},
ranks AS (SELECT map(list(l || chr(1) || r), list(rank)) AS m FROM merges),
steps(word, s, best) AS (
  SELECT word, s, list_min(list_transform(range(1, len(s)), lambda i: coalesce(m[s[i] || chr(1) || s[i + 1]], 1000000)))
  FROM sym, ranks
  UNION ALL
  SELECT word, t, list_min(list_transform(range(1, len(t)), lambda i: coalesce(m[t[i] || chr(1) || t[i + 1]], 1000000)))
  FROM (
    SELECT word, list_filter(string_split(replace(replace(
        chr(2) || array_to_string(s, chr(2) || chr(2)) || chr(2),
        chr(2) || l || chr(2) || chr(2) || r || chr(2), chr(2) || l || r || chr(2)), chr(2) || chr(2), chr(2)), chr(2)),
        lambda v: v <> '') AS t
    FROM steps JOIN merges ON rank = best) z, ranks),
done AS (SELECT word, s FROM steps WHERE best IS NULL OR best = 1000000)"""


@query("bpe", f"""{_BPE_DONE}
SELECT doc_id, pos, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS piece_no, unnest(s) AS token
FROM bw JOIN done USING (word)""")
def bpe(spark, root):
    return bpe_pieces(spark, root)


def bpe_word_pieces(spark, root) -> DataFrame:
    """The byte-pair pieces of every distinct word, written once: token, n, pieces."""

    def build():
        words = K.counted_words(bpe_word_table(spark, root), "word")
        return K.bpe_dictionary(words, merge_table(spark, root), LONGEST_MERGE).withColumnRenamed("word", "token")

    return made_once(spark, root, "bpe-pieces", build)


def bpe_piece_lists(spark, root) -> DataFrame:
    """The byte-pair pieces of each document as one list: doc_id, tokens.  A document without words is left out.

    Whole documents meet the dictionary, so that no row per piece is sorted back into texts.  Documents of equal number are
    one, their pieces merged by place (word, piece in the word), then by value.
    """
    joined = bpe_word_pieces(spark, root).select("token", F.array_join("pieces", K.PIECE_MARK).alias("joined"))
    listed = lookup_lists(bpe_texts(spark, root).filter(F.size("words") > 0), "words", joined, "token", "joined", "lists")
    tokens = F.split(F.array_join("lists", K.PIECE_MARK), K.PIECE_MARK)
    if not repeated(spark, root):
        return listed.select("doc_id", tokens.alias("tokens"))

    def placed(words: Column) -> Column:
        return F.flatten(F.transform(words, lambda w, pos: F.transform(
            F.split(w, K.PIECE_MARK), lambda v, i: F.struct(pos.alias("pos"), i.alias("i"), v.alias("v")))))

    merged = F.transform(F.sort_array(F.flatten(F.transform("_l", placed))), lambda c: c["v"])
    whole = listed.groupBy("doc_id").agg(F.collect_list("lists").alias("_l")).withColumn("lists", F.get("_l", F.lit(0)))
    return whole.select("doc_id", F.when(F.size("_l") == 1, tokens).otherwise(merged).alias("tokens"))


def bpe_pieces(spark, root, *head: str) -> DataFrame:
    """Byte-pair pieces of all documents, with the tokens of ``head`` as they are ahead of every document."""
    pieces = bpe_word_pieces(spark, root)
    texts = bpe_texts(spark, root)
    width = max(spark.sparkContext.defaultParallelism, texts.rdd.getNumPartitions())
    if fits_broadcast(pieces.select("token", "pieces")):
        pieced = lookup(bpe_rows(texts, width, "words", *[F.lit(t) for t in head]), pieces, "token", ["pieces"], "n")
        if head:
            pieced = pieced.withColumn("pieces", F.when(F.col("pos") < 0, F.array("token")).otherwise(F.col("pieces")))
    else:
        joined = pieces.select("token", F.array_join("pieces", K.PIECE_MARK).alias("joined"))
        listed = lookup_lists(texts, "words", joined, "token", "joined", "lists")
        rows = bpe_rows(listed, width, "lists", *[F.lit(t) for t in head])
        pieced = rows.select("doc_id", "pos", F.split("token", K.PIECE_MARK).alias("pieces"))
    return K.piece_rows(pieced, "doc_id")


# ---------------------------------------------------------------- vocabularies

@query("token_counts", f"WITH {S.BASIC} SELECT token, count(*) AS n FROM toks GROUP BY token")
def token_counts(spark, root):
    return V.token_counts(document_tokens(spark, root))


_WORDS = S.LINES + "," + S.token_cte("wt", S.word_list("line", True))
WORD_VOCAB_SQL = f"""{_WORDS},
counted AS (
  SELECT token, count(*) AS cnt, min(doc_id * 10000000000 + line_no * 1000000 + pos) AS first FROM wt GROUP BY token),
top AS (SELECT * FROM counted ORDER BY cnt DESC, first LIMIT {WORD_VOCAB}),
vocab AS (
  SELECT s.token, CAST(s.id AS INTEGER) AS id, coalesce(c.cnt, 0) AS cnt
  FROM (SELECT unnest([{S.quoted(WORD_SPECIALS)}]) AS token, unnest(range({len(WORD_SPECIALS)})) AS id) s
  LEFT JOIN counted c ON c.token = s.token
  UNION ALL
  SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, first) + {len(WORD_SPECIALS) - 1} AS INTEGER), cnt
  FROM top WHERE cnt >= 2 AND token NOT IN ({S.quoted(WORD_SPECIALS)}))"""


@query("build_vocab", f"WITH {WORD_VOCAB_SQL} SELECT token, id, cnt FROM vocab")
def build_vocab(spark, root):
    return V.build_vocab(word_counts(spark, root), WORD_SPECIALS, WORD_VOCAB, 2)


@query("build_vocab_whole", f"""
WITH {_WORDS},
counted AS (
  SELECT token, count(*) AS cnt, min(doc_id * 10000000000 + line_no * 1000000 + pos) AS first FROM wt GROUP BY token)
SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, first) - 1 AS INTEGER) AS id, cnt FROM counted""")
def build_vocab_whole(spark, root):
    """No size limit: every distinct token gets its rank."""
    return V.build_vocab(word_counts(spark, root))


@query("vocab_summary", f"""
WITH {WORD_VOCAB_SQL}
SELECT (SELECT count(*) FROM vocab) AS vocab_size, (SELECT count(*) FROM counted) AS n_distinct""")
def vocab_summary(spark, root):
    return V.vocab_summary(document_words(spark, root), word_vocab(spark, root))


@query("vocab_bands", f"""
WITH {WORD_VOCAB_SQL},
b AS (SELECT CAST(CASE WHEN id < {BANDS[0]} THEN 0 WHEN id < {BANDS[1]} THEN 1 WHEN id < {BANDS[2]} THEN 2 ELSE 3 END
      AS INTEGER) AS band, id, cnt FROM vocab)
SELECT band, count(*) AS n_ids, CAST(sum(cnt) AS BIGINT) AS n_tokens, min(id) AS first_id,
       round(sum(cnt) / (SELECT sum(cnt) FROM vocab), 6) AS share FROM b GROUP BY band""")
def vocab_bands(spark, root):
    return V.vocab_bands(word_vocab(spark, root), BANDS)


@query("specials_union", f"""
WITH {WORD_VOCAB_SQL}
SELECT token, id FROM vocab
UNION ALL SELECT '__start__', CAST((SELECT count(*) FROM vocab) AS INTEGER)
UNION ALL SELECT '__classify__', CAST((SELECT count(*) FROM vocab) + 1 AS INTEGER)""")
def specials_union(spark, root):
    return V.append_specials(word_vocab(spark, root), ["__start__", "__classify__"])


_IDS = f"""WITH {WORD_VOCAB_SQL}, {S.token_cte('et', S.word_list('line', True) + " || ['<eos>']")},
coded AS (
  SELECT doc_id, line_no, pos, coalesce(v.id, (SELECT id FROM vocab WHERE token = '<unk>')) AS id
  FROM et LEFT JOIN vocab v ON v.token = et.token)"""


def encoded_tokens(spark, root):
    vocab = word_vocab(spark, root)
    unknown = V.id_of(vocab, V.require_unknown(vocab))
    return V.encode(document_words(spark, root, regroup=True, add_eos=True), vocab, "token", unknown_id=unknown)


@query("encode_ids", f"{_IDS} SELECT doc_id, line_no, pos, id FROM coded")
def encode_ids(spark, root):
    return encoded_tokens(spark, root).select(*PLACE, "id")


@query("decode_ids", f"{_IDS} SELECT doc_id, line_no, pos, token FROM coded JOIN vocab USING (id)")
def decode_ids(spark, root):
    coded = encoded_tokens(spark, root).select(*PLACE, "id")
    return V.decode(coded, word_vocab(spark, root)).select(*PLACE, "token")


@query("decode_text", f"""{_IDS}
SELECT doc_id, line_no, string_agg(token, ' ' ORDER BY pos) AS text
FROM coded JOIN vocab USING (id) WHERE token <> '<eos>' GROUP BY doc_id, line_no""")
def decode_text(spark, root):
    vocab = word_vocab(spark, root)
    coded = encode_lists(marked_lines(line_tokens(spark, root), add_eos=True).select(*LINE, "tokens"), vocab, "token",
                         V.id_of(vocab, V.require_unknown(vocab)))
    named = decode_lists(coded, vocab)
    if repeated(spark, root):
        named = merge_lists(named, "tokens", LINE)
    kept = F.filter("tokens", lambda t: t != "<eos>")
    return named.select(*LINE, kept.alias("tokens")).filter(F.size("tokens") > 0).select(
        *LINE, V.words_to_text(F.col("tokens")).alias("text"))


@query("decode_text_pieces", f"""
WITH {_BPE_WORDS}, t AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM bw GROUP BY doc_id)
SELECT doc_id, """ + "".join("replace(" for _ in V.TIDY_STEPS) + "text" + "".join(
    f", '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in V.TIDY_STEPS) + " AS text FROM t")
def decode_text_pieces(spark, root):
    """Byte-pair pieces back to text, with the tidy-up replacements."""
    rows = bpe_piece_lists(spark, root)
    return rows.select("doc_id", V.pieces_to_text(F.col("tokens"), tidy=True).alias("text"))


BPE_UNKNOWN, BPE_SPECIALS = "<unk>", ("<s>", "</s>")


def bpe_vocab(spark, root):
    """Byte-pair vocabulary with dense ids: 0 for what is unknown, every symbol by falling number, merged symbols by rank,
    specials behind them.  There are at most two symbols for each character of Unicode, whatever the number of texts."""

    def build():
        words = K.counted_words(bpe_word_table(spark, root), "word")
        symbols = words.select(F.explode(K.word_symbols(F.col("word"))).alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))
        merged = merge_table(spark, root).groupBy(F.concat("left", "right").alias("token")).agg(F.min("rank").cast("bigint").alias("n"))
        unknown = spark.range(1).select(F.lit(BPE_UNKNOWN).alias("token"), F.lit(0).cast("bigint").alias("n"))
        kinds = [df.select("token", F.lit(i).alias("kind"), F.col("n") * sign)
                 for i, (df, sign) in enumerate(((unknown, 1), (symbols, -1), (merged, 1)))]
        kinds = [df.toDF("token", "kind", "place") for df in kinds]
        both = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
        order = F.row_number().over(Window.orderBy("kind", "place", "token")) - 1  # characters and merges
        return V.append_specials(materialize(both.select("token", order.cast("int").alias("id")), "bpe-dense"), BPE_SPECIALS)

    return made_once(spark, root, "bpe-vocab", build)


_BPE_IDS = f"""{_BPE_DONE},
bv AS (
  SELECT token, CAST(row_number() OVER (ORDER BY kind, place, token) - 1 AS INTEGER) AS id FROM (
    SELECT '{BPE_UNKNOWN}' AS token, 0 AS kind, 0 AS place
    UNION ALL SELECT token, 1, -sum(n) FROM (SELECT unnest(s) AS token, n FROM sym) GROUP BY token
    UNION ALL SELECT l || r, 2, min(rank) FROM merges GROUP BY l || r)),
bids AS (
  SELECT p.doc_id, p.pos, p.piece_no, coalesce(bv.id, 0) AS id FROM (
    SELECT doc_id, pos, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS piece_no, unnest(s) AS token
    FROM bw JOIN done USING (word)) p LEFT JOIN bv ON bv.token = p.token
  UNION ALL SELECT doc_id, -1, 0, CAST((SELECT count(*) FROM bv) AS INTEGER) FROM documents)"""


def bpe_ids(spark, root):
    """Pieces as ids, unknown ones 0, with the start mark ahead of every document."""
    rows = bpe_pieces(spark, root, BPE_SPECIALS[0]).select("doc_id", "pos", "piece_no", "token")
    return V.encode(rows, bpe_vocab(spark, root), "zero").select("doc_id", "pos", "piece_no", "id")


def bpe_id_lists(spark, root) -> DataFrame:
    """The ids of :func:`bpe_ids` as one list for each document, without the start mark: doc_id, ids.

    The pieces of a distinct word are encoded once, and whole documents meet the ids of their words.
    """
    vocab = bpe_vocab(spark, root)
    if repeated(spark, root):  # pieces are merged by value, ahead of their ids
        return encode_lists(bpe_piece_lists(spark, root), vocab, "zero")
    words = bpe_word_pieces(spark, root).select("token", F.col("pieces").alias("tokens"))
    coded = made_once(spark, root, "bpe-word-ids", lambda: encode_lists(words, vocab, "zero"))
    listed = lookup_lists(bpe_texts(spark, root).filter(F.size("words") > 0), "words", coded, "token", "ids", "lists")
    return listed.select("doc_id", F.flatten("lists").alias("ids"))


@query("bpe_encode_ids", f"{_BPE_IDS} SELECT doc_id, pos, piece_no, id FROM bids")
def bpe_encode_ids(spark, root):
    return bpe_ids(spark, root)


@query("bpe_decode", f"""{_BPE_IDS},
txt AS (
  SELECT doc_id, trim(replace(string_agg(token, '' ORDER BY pos, piece_no), '</w>', ' ')) AS text
  FROM bids JOIN bv USING (id) GROUP BY doc_id)
SELECT doc_id, """ + "".join("replace(" for _ in V.TIDY_STEPS) + "text" + "".join(
    f", '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in V.TIDY_STEPS) + " AS text FROM txt")
def bpe_decode(spark, root):
    """Ids back to text without special tokens, tidied up."""
    vocab = bpe_vocab(spark, root)
    start = F.lit(V.id_of(vocab, BPE_SPECIALS[0]))
    coded = bpe_id_lists(spark, root)
    named = decode_lists(coded.withColumn("ids", F.concat(F.array(start), "ids")), vocab)
    kept = F.filter("tokens", lambda t: ~t.isin(*BPE_SPECIALS))
    rows = named.select("doc_id", kept.alias("tokens")).filter(F.size("tokens") > 0)
    return rows.select("doc_id", V.pieces_to_text(F.col("tokens"), tidy=True).alias("text"))


LINE_LIMIT = 100_000


@query("encode_strict", f"""WITH {_WORDS},
counted AS (
  SELECT token, count(*) AS cnt, min(doc_id * 10000000000 + line_no * 1000000 + pos) AS first FROM wt GROUP BY token),
wv AS (SELECT token, row_number() OVER (ORDER BY cnt DESC, first) - 1 AS id FROM counted)
SELECT doc_id, line_no, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM wt JOIN wv USING (token)
GROUP BY doc_id, line_no""")
def encode_strict(spark, root):
    """Every word has to be in the vocabulary, and no line may be longer than the limit."""
    vocab = materialize(V.build_vocab(word_counts(spark, root)), "strict-vocab")
    rows = encoded_lines(spark, root, vocab, LINE, "error")
    rows = V.with_length_limit(rows, "ids", LINE_LIMIT)
    return rows.select(*LINE, F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


# ---------------------------------------------------------------- pages

@query("url_cache_index", """
SELECT sha256(url) || '.' || sha256(etag) AS cache_key, max(page_id) AS page_id, any_value(url) AS url, any_value(etag) AS etag
FROM (SELECT page_id, url, md5(html) AS etag FROM pages) GROUP BY url, etag""")
def url_cache_index(spark, root):
    pages = table(spark, root, "pages").select("page_id", "url", F.md5("html").alias("etag"))
    return url_index(pages, "page_id")


@query("url_resolve", """
SELECT page_id, sha256(url) AS cache_key, url FROM pages""")
def url_resolve(spark, root):
    """Keys back to their URLs."""
    from faqloom.operators.urls import cache_key, resolve_keys

    pages = table(spark, root, "pages").select("page_id", "url", F.lit(None).cast("string").alias("etag"))
    keys = pages.select("page_id", cache_key(F.col("url"), F.col("etag")).alias("cache_key"))
    index = url_index(pages, "page_id").select("cache_key", "url")
    return resolve_keys(keys, index).select("page_id", "cache_key", "url")


@query("url_profile", r"""
WITH p AS (
  SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host,
         string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')[-1] AS leaf FROM pages)
SELECT host, lower(CASE WHEN position('.' IN ltrim(leaf, '.')) > 0 THEN '.' || string_split(leaf, '.')[-1] ELSE '' END) AS ext,
       count(*) AS n FROM p GROUP BY 1, 2""")
def url_profile_query(spark, root):
    return url_profile(table(spark, root, "pages").select("url"))
