"""Secret scan: wide candidate search, then a random forest that removes false positives.

Candidates are values assigned to a name that speaks of a credential, long runs of letters and digits, private key blocks
and passwords in URLs, of any length.  A candidate's features are its length, the transitions between its kinds of
characters, how much of it dictionary words cover, the path it stands in and the words next to it and their case.  The
dictionary is a short list and the commonest words of the documents.  The forest learns from labelled findings: a table of
(value, before, after, path, label).  :func:`made_findings` makes a bounded one from the public shapes of
credentials and of what is taken for one; labelled findings of one's own may be given instead.

Defined cases: null and empty texts have no candidates; a null path has no path features; null and repeated ids stay rows
of their own; candidates of one span count once, those that overlap are judged each, and an accepted one inside another
accepted one is no finding of its own; :func:`redact` puts one mark in place of accepted ones that overlap; an empty table
gives an empty result; other columns are ignored, and kept by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faqloom.llm.common import is_small
from faqloom.llm.simhash import text_key
from faqloom.session import materialize

ROWS, TREES, DEPTH, SEED = 6_000, 40, 11, 11
KINDS = ("assigned", "run", "block", "url")
#: A name with what stands between it and its value; only the ones that speak of a credential count.
NAME = re.compile(r"(?<![\w.-])([\w.-]++)[\"']?[ \t]*+[:=]{1,2}>?[ \t]*+([\"']?)")
CREDENTIAL = re.compile(
    r"(?i)pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?"
)
#: Words that say how a value is to be used and are none.
SCHEME = re.compile(r"(?i)(?:bearer|basic|digest|token|apikey)[ \t]++")
VALUE = re.compile(r"[^\s\"'<>,;]+")
QUOTED = {q: re.compile(f"[^{q}\n]*+{q}") for q in "\"'"}
PARAMETER = re.compile(r"&[\w.-]+=")
RUN = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
#: A run of lower-case letters alone counts from this length on.
LOWER_RUN = 24
PART = re.compile(r"[^=]+=*\Z|[^=]+")
BORDER = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]++)-----")
KEY_LINE = re.compile(r"[ \t]*+(?:([A-Za-z0-9+/=]{16,}+)|[A-Za-z-]++:[^\n]*+|[A-Za-z0-9+/=]*+)[ \t\r]*+(?:\n|\Z)")
IN_URL = re.compile(r"://[^\s:/@]++:([^\s/@]{3,}+)@")
NEAR = 60
#: Words that coverage is measured with, besides the commonest of the documents (:func:`common_words`).
DICTIONARY = tuple(
    "the and for with that this from have not are was you your his her they will all one out about which when there what "
    "into than then them some would other more time only new could these first any over also after most where der die das "
    "und ein eine nicht mit von den auf ist les des une dans pour pas que est par sur avec los las una por con para como "
    "example sample test dummy fake change changeme placeholder password passwd secret token key value none null true false "
    "user admin default local host name file data index version release build note image page article http https www com org "
    "net html json xml here insert enter foo bar baz lorem ipsum abc xyz".split()
)
#: Words next to a finding, and in its path, that the forest may look at; lists, not rules.
HINTS = ("password passwd pwd secret token key apikey bearer authorization credential private access login aws connect "
         "example placeholder sample dummy commit sha md5 checksum hash digest version uuid id isbn mailto build revision "
         "etag order ticket").split()
PLACES = ("test", "tests", "example", "examples", "docs", "fixtures", "mock", "vendor", "config", "env")
#: Words taken from the documents, and in how many of them each has to stand.
COMMON, COMMON_LEAST = 20_000, 3
VOWELS = frozenset("aeiouyAEIOUY")
LETTERS = re.compile(r"[^\W\d_]{3,}")
WORD = re.compile(r"[A-Za-z]+")
LAST_WORDS, FIRST_WORDS = 4, 2


class Model(NamedTuple):
    """A fitted forest and the words it measures coverage with."""

    forest: RandomForestClassificationModel
    words: frozenset[str]


def common_words(docs: DataFrame, text: str = "text", most: int = COMMON, least: int = COMMON_LEAST) -> frozenset[str]:
    """The commonest words of 3 to 11 letters by the documents they stand in, ``least`` or more, counted over all of them: as
    many as there are at most ``most`` of.  Words as common as the first one too many stay out."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))).alias("word"))
    counts = words.filter(F.length("word").between(3, 11)).groupBy("word").count().filter(F.col("count") >= least)
    counts = materialize(counts, "secret-words")
    total, border = 0, least
    for row in counts.groupBy("count").agg(F.count("*").alias("words")).orderBy(F.desc("count")).toLocalIterator():
        total += row["words"]
        if total > most:
            border = row["count"] + 1
            break
    return frozenset(r[0] for r in counts.filter(F.col("count") >= border).select("word").collect())


def classes(value: str) -> list[int]:
    """Vowel, other lower-case letter, other upper-case letter, digit, anything else."""
    return [0 if c in VOWELS else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 for c in value]


def coverage(value: str, words=DICTIONARY) -> float:
    """The share of the letters that dictionary words of three and more letters cover, longest first."""
    low = value.lower()
    letters = sum(c.isalpha() for c in low)
    if not letters:
        return 0.0
    known, covered = words if isinstance(words, frozenset) else frozenset(words), 0
    for run in LETTERS.findall(low):
        at = 0
        while at + 3 <= len(run):
            size = next((n for n in range(min(11, len(run) - at), 2, -1) if run[at : at + n] in known), 0)
            covered += size
            at += size or 1
    return covered / letters


def longest(kinds: list[int], of: tuple[int, ...]) -> int:
    """The longest run of characters of some kinds."""
    best = size = 0
    for k in kinds:
        size = size + 1 if k in of else 0
        best = max(best, size)
    return best


def features(value: str, before: str, after: str, path: str | None, kind: str, words=DICTIONARY) -> list[float]:
    kinds = classes(value)
    n = max(1, len(kinds))
    moves = [0.0] * 25
    for a, b in zip(kinds, kinds[1:]):
        moves[5 * a + b] += 1 / n
    shares = [kinds.count(k) / n for k in range(5)]
    distinct = len(set(value)) / min(n, 64)
    repeats = sum(a == b for a, b in zip(value, value[1:])) / n
    near = {w.lower() for w in WORD.findall(before)[-LAST_WORDS:] + WORD.findall(after)[:FIRST_WORDS]}
    letters = [c for c in before + after if c.isalpha()]
    vowels = sum(c in VOWELS for c in value) / max(1, sum(c.isalpha() for c in value))
    place = set(re.split(r"[^a-z0-9]+", (path or "").lower()))
    return [
        float(min(len(value), 512)), *shares, distinct, repeats, *moves, coverage(value, words),
        *(float(kind == k) for k in KINDS), float(before[-1:] in ("'", '"')),
        vowels, min(longest(kinds, (1, 2)), 32) / 32, min(longest(kinds, (0, 1, 2)), 64) / 64, value.count(" ") / n,
        sum(map(str.isupper, letters)) / max(1, len(letters)),
        *(float(h in near) for h in HINTS), float(path is not None), *(float(p in place) for p in PLACES),
    ]


def key_blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """From every BEGIN line of a private key to the next END line; without one, to the last line that looks like a key."""
    begin = None
    for m in BORDER.finditer(text):
        if "PRIVATE KEY" not in m.group(2):
            continue
        if begin is not None:
            yield from ((begin.start(), m.end(), "block"),) if m.group(1) == "END" else open_block(text, begin)
        begin = m if m.group(1) == "BEGIN" else None
    if begin is not None:
        yield from open_block(text, begin)


def open_block(text: str, begin: re.Match) -> Iterator[tuple[int, int, str]]:
    at, end = text.find("\n", begin.end()) + 1, 0
    while 0 < at < len(text) and (line := KEY_LINE.match(text, at)):
        end = line.end(1) if line.group(1) else end
        at = line.end()
    if end:
        yield begin.start(), end, "block"


def assigned(text: str) -> Iterator[tuple[int, int, str]]:
    """Values of names that speak of a credential: up to the closing quote, or to the first blank or sign that ends one.
    An unquoted value with such names in it counts as a whole, and each up to the next."""
    names = [(m.start(), m.end(), m.group(2)) for m in NAME.finditer(text) if CREDENTIAL.search(m.group(1))]
    end = -1
    for i, (name, at, quote) in enumerate(names):
        if at >= end:
            if scheme := SCHEME.match(text, at):
                at = scheme.end()
            if quote and (closed := QUOTED[quote].match(text, at)):
                end = closed.end() - 1
                if end > at:
                    yield at, end, "assigned"
                continue
            value = VALUE.match(text, at)
            if not value:
                continue
            end = value.end()
            if text[at - 1] == "=" and name and text[name - 1] in "?&":  # of a URL: the value ends at the next parameter
                more = text.find("&", at, end)
                end = end if more < 0 else more
            yield at, end, "assigned"
        stop = min(end, names[i + 1][0]) if i + 1 < len(names) else end
        if parameter := PARAMETER.search(text, at, stop):
            yield at, parameter.start(), "assigned"
        yield at, at + len(text[at:stop].rstrip("&?")) if stop < end else end, "assigned"


def runs(text: str) -> Iterator[tuple[int, int, str]]:
    """Long runs of letters and digits; one with a '=' in it counts by its parts, '=' at its end as padding.  A run of
    letters alone counts if its case changes inside it, if all of it is upper case, or if it is longer still."""
    for m in RUN.finditer(text):
        for part in PART.finditer(m.group()):
            value = part.group()
            name = not part.start() and part.end() < len(m.group())  # what stands ahead of a '=' is rarely a value
            if len(value) < 16 or not any(map(str.isalpha, value)):
                continue
            digits, inner = any(map(str.isdigit, value)), value[1:]
            if digits or not name and (inner.lower() != inner or len(value) >= LOWER_RUN):
                yield m.start() + part.start() + len(value) - len(value.lstrip("-/+_")), m.start() + part.end(), "run"


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every candidate, in order, one for each span."""
    text = text or ""
    found = list(key_blocks(text)) if "-----BEGIN" in text else []
    if "://" in text:
        found += [(*m.span(1), "url") for m in IN_URL.finditer(text)]
    found += [*assigned(text), *runs(text)]
    spans: dict[tuple[int, int], str] = {}
    for start, end, kind in sorted((f for f in found if f[1] > f[0]), key=lambda f: (f[0], -f[1], KINDS.index(f[2]))):
        spans.setdefault((start, end), kind)
    return [(*span, kind) for span, kind in spans.items()]


def made_findings(rows: int = ROWS, seed: int = SEED, words=()) -> list[tuple[str, str, str, str | None, str, int]]:
    """(value, before, after, path, kind, label): credentials in their public shapes, and what looks like them, between
    common words."""
    r = random.Random(seed)
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    names = ("password", "passwd", "secret", "token", "api_key", "access_key", "auth_token", "client_secret")
    plain = [w for w in DICTIONARY if len(w) > 3]
    common = sorted(words) or plain

    def pick(chars, low, high=None):
        return "".join(r.choice(chars) for _ in range(r.randint(low, high or low)))

    def prose(n):
        made = (r.choice(common) if r.random() < 0.6 else "".join(pick("bcdfghlmnprstv", 1) + pick("aeiou", 1) for _ in range(r.randint(1, 4)))
                for _ in range(n))
        return " ".join(made)

    def word():  # pronounceable, in no dictionary
        return "".join(pick("bcdfghklmnprstv", 1) + pick("aeiou", 1) + pick("lnrst", 0, 1) for _ in range(r.randint(2, 3)))

    def assigned(value):
        quote = r.choice(["", '"'])
        return value, f"{prose(3)} {r.choice(names)}{r.choice(['=', ' = ', ': '])}{quote}", quote + " " + prose(3), "assigned"

    def run(value, word=""):
        return value, f"{prose(3)} {word}{' ' if word else ''}", " " + prose(3), "run"

    def shouted(value):  # upper case among upper case, or alone
        before, after = prose(3), prose(3)
        return value, (before.upper() if r.random() < 0.5 else before) + " ", " " + (after.upper() if r.random() < 0.5 else after), "run"

    def compound(low):  # common words and endings run together
        out = ""
        while len(out) < low:
            out += r.choice(common) if r.random() < 0.6 else "".join(pick("bcdfghklmnprstvwz", 1, 2) + pick("aeiou", 1, 2) + pick("chlnrstz", 0, 2) for _ in range(2))
        return out

    def mixed():  # letters alone, of both cases
        return "".join(r.choice((str.upper, str.lower))(c) for c in pick(string.ascii_lowercase, 20, 48))

    true = [
        lambda: run("AKIA" + pick(string.ascii_uppercase + string.digits, 16)),
        lambda: run(r.choice(["ghp_", "gho_", "ghs_"]) + pick(alnum, 36), r.choice(["", "token"])),
        lambda: run(r.choice(["sk_live_", "rk_live_", "sk-"]) + pick(alnum, 24, 48), r.choice(["", "key"])),
        lambda: run("AIza" + pick(alnum + "-_", 35)),
        lambda: run(f"xox{r.choice('abp')}-{pick(string.digits, 11)}-{pick(alnum, 24)}"),
        lambda: run(pick(alnum + "+/", 40), r.choice(["secret", "key", "aws"])),
        lambda: run("eyJ" + pick(alnum + "-_", 60, 160), r.choice(["bearer", "token", ""])),
        lambda: assigned(pick(hexa, 16, 24)), lambda: assigned(pick(hexa, 32, 64)), lambda: assigned(pick(alnum, 12, 48)),
        lambda: assigned(pick(alnum + "!#%&*@^_-", 10, 24)), lambda: assigned(pick(alnum + "+/", 40) + "="),
        lambda: assigned(pick(alnum, 3, 6) + pick(string.digits, 1, 2)),
        lambda: assigned(mixed()), lambda: run(mixed(), r.choice(["bearer", "token", "key"])), lambda: assigned(pick(string.ascii_letters, 16, 40)),
        lambda: assigned(" ".join(word() for _ in range(r.randint(2, 3))) + " " + pick(string.digits, 1, 3) + pick(string.ascii_uppercase, 1, 2)),
        lambda: assigned(" ".join(r.choice(plain) for _ in range(r.randint(2, 4))) + " " + pick(string.digits, 1, 2) + pick(string.ascii_uppercase, 1, 2)),
        lambda: (pick(alnum, 30, 300), f"{prose(2)} mysql://{r.choice(plain)}:", f"@{r.choice(plain)}.net", "url"),
        lambda: assigned(word() + pick(string.digits, 1, 4)), lambda: assigned(word() + pick(string.digits, 1, 2)),
        lambda: (pick(alnum, 8, 20), f"{prose(2)} postgres://{r.choice(plain)}:", f"@{r.choice(plain)}.net", "url"),
        lambda: ("-----BEGIN RSA PRIVATE KEY-----\n" + r.choice(["", "", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + pick(hexa, 32) + "\n\n"])
                 + pick(alnum + "+/", 200, 900) + "\n-----END RSA PRIVATE KEY-----",
                 prose(2) + "\n", "\n", "block"),
    ]
    false = [
        lambda: assigned(r.choice(["changeme", "your_token_here", "example-secret", "xxxxxxxx", "<password>", "password1",
                                   "REPLACE_ME_1", "********", "${PASSWORD}", "os.environ", "none-given", "test1234"])),
        lambda: assigned("".join(r.choice(plain) for _ in range(2)) + pick(string.digits, 0, 2)),
        lambda: assigned("_".join(r.choice(plain) for _ in range(3))),
        lambda: assigned(f"get_{r.choice(plain)}_{r.choice(plain)}()"),
        lambda: assigned(r.choice(["none", "null", "true", "false", "yes", "no", "1", "0", "the", "is", "not", "a", "{", "***", "...", "$1", "%s"])),
        lambda: assigned(prose(1)), lambda: assigned(prose(r.randint(2, 6))), lambda: assigned(compound(12)),
        lambda: shouted(compound(16).upper()), lambda: shouted(compound(16).upper()), lambda: run(compound(16).upper() + pick(string.digits, 0, 1)),
        lambda: run(compound(24)), lambda: run(compound(LOWER_RUN).title()), lambda: run("".join(r.choice(common).title() for _ in range(5))),
        lambda: run("-".join(r.choice(common) for _ in range(5))), lambda: run("/".join(r.choice(common) for _ in range(5))),
        lambda: ("-----BEGIN PRIVATE KEY-----" + r.choice([" ", "\n", " ... ", "\n...\n"]) + prose(r.randint(0, 60)) + " -----END PRIVATE KEY-----",
                 prose(2) + " ", " ", "block"),
        lambda: run("-".join(r.choice(plain) for _ in range(3)) + "-" + pick(string.digits, 1, 4)),
        lambda: run("_".join(r.choice(plain) if r.random() < 0.5 else word() for _ in range(3)).upper() + pick(string.digits, 1, 2)),
        lambda: run("".join(w.title() for w in (r.choice(plain) for _ in range(4))) + pick(string.digits, 1, 2)),
        lambda: run(f"{pick(hexa, 8)}-{pick(hexa, 4)}-4{pick(hexa, 3)}-{pick(hexa, 4)}-{pick(hexa, 12)}", r.choice(["uuid", "id", ""])),
        lambda: run(pick(hexa, 40), r.choice(["commit", "sha", "revision", "build"])),
        lambda: run(pick(hexa, 32), r.choice(["md5", "checksum", "hash", "etag", "digest"])),
        lambda: run("sha256-" + pick(hexa, 64), r.choice(["digest", "checksum", "hash"])),
        lambda: run(f"{pick(string.digits, 4)}-{pick(string.digits, 2)}-{pick(string.digits, 2)}T{pick(string.digits, 6)}Z"),
        lambda: run(f"/{r.choice(plain)}/{r.choice(plain)}/{r.choice(plain)}{pick(string.digits, 1, 4)}"),
        lambda: run("abcdefghijklmnop0123456789"[: r.randint(16, 26)] + "1"), lambda: run("a1" * r.randint(8, 14)),
        lambda: run("".join(pick("bcdfghlmnprstv", 1) + pick("aeiou", 1) for _ in range(r.randint(8, 14))) + pick(string.digits, 1)),
        lambda: run("ISBN" + pick(string.digits, 13), r.choice(["isbn", "order", "ticket"])),
        lambda: (r.choice(["password", "pass", "secret", "example", "xxxx"]), f"{prose(2)} http://{r.choice(plain)}:", "@example.com", "url"),
    ]
    paths = (None, "lib/main/app.py", "config/prod.env", "deploy/values.yaml", "tests/fixtures/a.json", "docs/example.md")
    out = []
    for i in range(rows):
        label = i % 2
        value, before, after, kind = r.choice(true if label else false)()
        path = r.choice(paths[:4]) if label and r.random() < 0.6 else r.choice(paths)
        out.append((value, before[-NEAR:], after[:NEAR], path, kind, label))
    return out


def fit(spark: SparkSession, findings: list[tuple] | None = None, words: frozenset[str] = frozenset()) -> Model:
    """A forest from labelled findings: (value, before, after, path, kind, label), ``ROWS`` made ones by default.  ``words``
    are common words, besides ``DICTIONARY``."""
    known = frozenset(DICTIONARY) | words
    rows = [(features(*f[:5], known), float(f[5])) for f in (made_findings(words=words) if findings is None else findings)]
    data = spark.createDataFrame(rows, "x array<double>, label double").coalesce(1)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt")
    return Model(forest.fit(data.select(array_to_vector("x").alias("features"), "label")), known)


def fit_for(docs: DataFrame) -> Model:
    """The forest of made findings among the commonest words of the documents."""
    return fit(docs.sparkSession, words=common_words(docs))


FOUND = "array<struct<start:int,end:int,kind:string,value_sha256:string,cluster:int,x:array<double>>>"


FOUND_ARROW = pa.list_(pa.struct([
    ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value_sha256", pa.string()), ("cluster", pa.int32()),
    ("x", pa.list_(pa.float64()))
]))


def found_column(text: Column, path: Column, words) -> Column:
    """All candidates of a text with their features; those that overlap, one after another, are a cluster.  ``words`` is a
    broadcast."""

    @F.arrow_udf(FOUND)
    def found(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = words.value
        for texts, paths in batches:
            out = []
            for text, path in zip(texts.to_pylist(), paths.to_pylist()):
                row, cluster, last = [], 0, -1
                for start, end, kind in candidates(text):
                    cluster, last = (start, end) if start >= last else (cluster, max(end, last))
                    value = text[start:end]
                    x = features(value, text[max(0, start - NEAR) : start], text[end : end + NEAR], path, kind, known)
                    sha = hashlib.sha256(value.encode()).hexdigest()
                    row.append({"start": start, "end": end, "kind": kind, "value_sha256": sha, "cluster": cluster, "x": x})
                out.append(row)
            yield pa.array(out, FOUND_ARROW)

    return found(text, path)


def scan(
    docs: DataFrame, model: Model, threshold: float = 0.5, path: str = "source"
) -> DataFrame:
    """Per candidate: doc_id, text_key, start, end (characters), kind, value_sha256, score, secret.

    Rows whose span lies inside that of another secret of their text are left out if they are secrets themselves.
    """
    where = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    words = docs.sparkSession.sparkContext.broadcast(model.words)
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), where.alias("where"),
                       F.explode(found_column(F.col("text"), where, words)).alias("f"))
    flat = rows.select("doc_id", "text_key", "where", *[f"f.{c}" for c in ("start", "end", "kind", "value_sha256", "cluster")],
                       array_to_vector("f.x").alias("features"))
    judged = model.forest.transform(flat).withColumn("score", vector_to_array("probability")[1])
    columns = ("doc_id", "text_key", "start", "end", "kind", "value_sha256", "score")
    own = judged.select(*columns, (F.col("score") >= threshold).alias("secret"), "where", "cluster")
    # copies of a row, with the id and the text repeated, are one row while overlaps are looked at
    counted = own.groupBy(*own.columns).agg(F.count(F.lit(1)).alias("_copies"))
    ahead = Window.partitionBy("doc_id", "text_key", "where", "cluster").orderBy("start", F.desc("end")).rowsBetween(
        Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max(F.when(F.col("secret"), F.col("end"))).over(ahead), F.lit(-1))
    kept = counted.withColumn("_covered", covered).filter(~F.col("secret") | (F.col("end") > F.col("_covered")))
    return kept.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).select(*columns, "secret")


def cut_column(text: Column, spans: Column, mark: str) -> Column:
    """The text with ``mark`` in place of its spans; spans that overlap are one."""

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            out = []
            for text, cuts in zip(texts.to_pylist(), spans.to_pylist()):
                parts, end = [], 0
                for at in sorted(cuts, key=lambda c: c["start"]):
                    if not parts or at["start"] >= end:
                        parts += [text[end : at["start"]], mark]
                    end = max(end, at["end"])
                out.append("".join(parts) + text[end:])
            yield pa.array(out, pa.string())

    return cut(text, spans)


def redact(docs: DataFrame, model: Model, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced by ``mark``; ``n_chars``, if there, follows the text."""
    found = scan(docs, model, threshold).filter("secret").groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("start", "end")).alias("spans")
    )
    found = materialize(found.toDF("_id", "_key", "_spans"), "secret-spans")
    side = F.broadcast(found) if is_small(found) else found.hint("merge")
    packed = docs.select(
        F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_doc"), text_key(F.col("text")).alias("_text_key")
    )
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))
    joined = packed.join(side, same, "left").select("_row", "_spans")
    hit = joined.filter(F.col("_spans").isNotNull()).withColumn("_text", cut_column(F.col("_row.text"), F.col("_spans"), mark))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("bigint")}
    changed = hit.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
    return joined.filter(F.col("_spans").isNull()).select("_row.*").unionByName(changed)
