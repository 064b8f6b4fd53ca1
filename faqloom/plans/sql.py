"""Pieces of the checking SQL."""

from faqloom.functions import repair as R
from faqloom.functions import segment as W
from faqloom.functions.text import CJK_CLASS, PUNCT, SUBWORD_PROTECTED, WORD_PROTECTED
from faqloom.functions.wordlists import ENGLISH_STOP_WORDS


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


STOP = quoted(ENGLISH_STOP_WORDS)
LINE_SPLIT = "[ \\x{2028}\\x{2029}]+"


def clean(x: str) -> str:
    spaced = f"regexp_replace({x}, '[\\t\\n\\r\\p{{Zs}}]', ' ', 'g')"
    return f"regexp_replace({spaced}, '[\\x{{FFFD}}\\p{{C}}]', '', 'g')"


def _tokens(words: str, protected, lower: bool) -> str:
    folded = "strip_accents(lower(w))" if lower else "w"
    return (
        f"flatten(list_transform(list_filter({words}, lambda v: v <> ''), lambda w: "
        f"CASE WHEN w IN ({quoted(protected)}) THEN [w] "
        f"ELSE regexp_extract_all({folded}, '[{PUNCT}]|[^ {PUNCT}]+') END))"
    )


def basic_list(x: str, lower: bool = True) -> str:
    cjk = f"regexp_replace({clean(x)}, '([{CJK_CLASS}])', ' \\1 ', 'g')"
    return _tokens(f"string_split_regex({cjk}, '{LINE_SPLIT}')", SUBWORD_PROTECTED, lower)


def word_list(x: str, lower: bool = False) -> str:
    return _tokens(f"string_split_regex({clean(x)}, '{LINE_SPLIT}')", WORD_PROTECTED, lower)


def normalized(x: str, lower: bool = False) -> str:
    t = f"lower(nfc_normalize({x}))" if lower else f"nfc_normalize({x})"
    t = f"regexp_replace({t}, '([.!?])', ' \\1', 'g')"
    return f"regexp_replace({t}, '[^a-zA-Z0-9.!?]+', ' ', 'g')"


LINES = """
lines AS (
  SELECT doc_id, source, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no, unnest(ls) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents))"""


def token_cte(name: str, tokens: str, source: str = "lines", keep: str = "doc_id, line_no") -> str:
    return f"""
{name} AS (
  SELECT {keep}, CAST(generate_subscripts(ts, 1) - 1 AS INTEGER) AS pos, unnest(ts) AS token
  FROM (SELECT {keep}, {tokens} AS ts FROM {source}))"""


BASIC = LINES + "," + token_cte("toks", basic_list("line"))


def u(seed: int, *keys: str) -> str:
    text = ", ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {text})), 1, 8)) AS BIGINT) / 4294967296.0)"


def h(seed: int, *keys: str) -> str:
    text = ", ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"md5(concat_ws('|', {text}))"


PAIRS = """
faq AS (
  SELECT u.conv_id || ':' || u.turn AS faq_id, u.conv_id, u.turn, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def text_of(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def count_of(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {text_of(pattern)}))"


def repaired_cte(source: str) -> str:
    """r0 .. rn from a table (doc_id, t): the rounds of text repair."""
    code = f"translate(run, '{R.CP1252}', '{R.CP1252_BYTES}')"
    candidate = f"decode(unhex(array_to_string(list_transform(string_split({code}, ''), lambda c: printf('%02x', unicode(c))), '')))"
    out = [f"r0 AS ({source})"]
    for i in range(1, R.ROUNDS + 1):
        out.append(f"""
x{i} AS (
  SELECT doc_id, t, string_split_regex(t, {text_of(R.RUN)}) AS between, regexp_extract_all(t, {text_of(R.RUN)}) AS runs FROM r{i - 1}),
u{i} AS (SELECT DISTINCT run, {candidate} AS c FROM (SELECT unnest(runs) AS run FROM x{i})),
m{i} AS (SELECT map(list(run), list(
  CASE WHEN {count_of('c', R.RARE)} < {count_of('run', R.SEQUENCE)} - {count_of('run', R.AT_HOME)} THEN c ELSE run END)) AS m FROM u{i}),
r{i} AS (
  SELECT doc_id, CASE WHEN len(runs) = 0 THEN t ELSE array_to_string(
    list_transform(list_zip(between, list_append(list_transform(runs, lambda v: m[v]), '')), lambda v: v[1] || v[2]), '') END AS t
  FROM x{i}, m{i})""")
    return ",".join(out)


def segments_cte(source: str, standard: str) -> str:
    """segs (doc_id, ci, c, tokens) from a table (doc_id, t): the tokens of each piece between blanks."""
    core = "k"
    for pattern, by in W.SPLITS:
        core = f"regexp_replace({core}, {text_of(pattern)}, '{by.replace('$', chr(92))}', 'g')"
    return f"""
ch AS (
  SELECT doc_id, generate_subscripts(cs, 1) AS ci, unnest(cs) AS c FROM (
    SELECT doc_id, list_filter(string_split_regex({standard}, '[\\s\\x{{2028}}\\x{{2029}}]+'), lambda v: v <> '') AS cs FROM {source})),
fr AS (
  SELECT *, regexp_extract(c, {text_of('^' + W.PREFIX + '+')}) AS p, regexp_replace(c, {text_of('^' + W.PREFIX + '+')}, '') AS r FROM ch),
en AS (
  SELECT *, regexp_extract(r, {text_of(W.SUFFIX + '+' + chr(92) + 'z')}) AS e, regexp_replace(r, {text_of(W.SUFFIX + '+' + chr(92) + 'z')}, '') AS k
  FROM fr),
segs AS (
  SELECT doc_id, ci, CASE
    WHEN regexp_matches(c, {text_of(W.PLAIN)}) AND lower(c) NOT IN ({quoted(W.JOINED)}) THEN [c]
    ELSE list_concat(regexp_extract_all(p, '(?s:.)'), CASE WHEN regexp_matches(r, {text_of(W.EXCEPTION)}) THEN [r] ELSE list_concat(
      CASE WHEN k = '' THEN [] WHEN regexp_matches(k, {text_of(W.WHOLE)}) THEN [k]
      ELSE list_filter(string_split_regex({core}, ' +'), lambda v: v <> '') END,
      regexp_extract_all(e, {text_of(W.SUFFIX_PARTS)})) END) END AS tokens
  FROM en)"""
