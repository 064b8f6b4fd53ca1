import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from faqloom.llm import phrases as P
from tests.llm import cases


def plain(rows, support, longest, top, covered=100):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in found.items():
            held = any(100 * b >= covered * a for q, b in found.items() if len(q) > len(p)
                       and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not held:
                score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                     for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def texts(seed=1, n=80):
    r = random.Random(seed)
    words = ["the", "of", "New", "York", "city", "a", "été", "中文", "x-y", "42", " ", "it's"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", ";", "\x0b"]
    out = []
    for i in range(n):
        t = "".join(r.choice(words) + r.choice(ends) for _ in range(r.randint(0, 60)))
        out.append((r.choice(["en", "en", "de", None, "a\nb"]), t if i % 5 else t + " the New York city of a " * 3))
    return out + [("en", None), (None, ""), ("en", "   "), ("en", "new york " * 400), ("und", "New York, new york"), (None, "new york")] * 2


@pytest.mark.parametrize("support, longest, shards, top", [(3, 5, 5, 2000), (7, 4, 3, 6), (10, 2, 1, 5), (2, 3, 8, 40)])
def test_against_brute_force(spark, support, longest, shards, top):
    rows = texts()
    docs = spark.createDataFrame([(t, lang, 1, "x", 7) for lang, t in rows], "text string, lang string, n int, key string, size int")
    got = P.collocations(docs.repartition(4), support, longest, top, 100, shards)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, support, longest, top)


def test_looser_cover(spark):
    docs = spark.createDataFrame(texts(4), "lang string, text string")
    got = P.collocations(docs, 4, 5, 100, covered=70)
    assert sorted(map(tuple, got.collect())) == plain(texts(4), 4, 5, 100, 70)


def test_awkward_table_in_small_steps(spark, monkeypatch):
    monkeypatch.setattr(P, "STEP_BYTES", 50)
    rows = cases.rows()
    text = rows[0][1]
    assert [w for part in P.words_of(text) for w in part] == re.findall(rb"[^ ]+", text.encode())
    got = P.collocations(spark.createDataFrame(rows, cases.DOCS).repartition(3), support=6)
    want = plain([(r[2], r[1]) for r in rows], 6, 5, 2000)
    assert want and sorted(map(tuple, got.collect())) == want


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(P, "bit_filter", lambda keys: np.full(32, 255, np.uint8))
    docs = spark.createDataFrame(texts(), "lang string, text string")
    assert sorted(map(tuple, P.collocations(docs, 5).collect())) == plain(texts(), 5, 5, 2000)


def test_filter_holds_its_keys(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    table = spark.createDataFrame([(int(k),) for k in keys[:10_000]], "key long")
    bitmap = P.bit_filter(table)
    hit = P.passes(bitmap, keys.view(np.uint64))
    assert hit[:10_000].all() and hit[10_000:].mean() < 0.02


def test_products_beyond_64_bits(spark):
    rows = [(10**12 + 7, 10**15 + 9, 10**13 + 1, 10**12 + 7), (3, 10, 7, 4), (10**16, 10**17, 10**16, 10**16), (99, 10**12, 100, 99)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select(P.quotient(*map(F.col, "anlr")).alias("q"))
    assert sorted(r.q for r in got.collect()) == sorted(1000 * a * n // (l * r) for a, n, l, r in rows)


def test_nothing(spark):
    assert P.collocations(cases.none(spark)).count() == 0
