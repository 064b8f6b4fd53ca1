import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from faqloom.llm import lexical as L
from tests.llm import cases


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def plain(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms(text))
            if score > 0:
                found.append((-score, d is None, d))
        best = sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k]
        out += [(item, rank, d, -score) for rank, (score, _, d) in enumerate(best, 1)]
    return sorted(out, key=str)


def items_of(rows, seed=2):
    r = random.Random(seed)
    texts = [t for _, t, *_ in rows if t]
    out = [(i, " ".join(r.choice(texts).split()[:r.randint(1, 30)])) for i in range(12)]
    return out + [(None, texts[0]), (5, "tie tie TIE"), (77, None), (78, ""), (79, "..."), (80, "nowhere_to_be 12345"), (81, "中文 ÉTÉ two Two words")]


@pytest.mark.parametrize("k, slice_terms, most", [(10, 4096, 8192), (3, 40, 16), (200, 100, 50)])
def test_against_brute_force(spark, monkeypatch, k, slice_terms, most):
    monkeypatch.setattr(L, "SLICE_TERMS", slice_terms)
    monkeypatch.setattr(L, "MOST_DOCS", most)
    rows = cases.rows()
    items = items_of(rows)
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id int, score string")
    got = L.rank_documents(spark.createDataFrame(rows, cases.DOCS).repartition(3), asked, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain([r[:2] for r in rows], items, k)


def test_tree_bounds_and_pruning():
    r = np.random.default_rng(4)
    tf = (r.random((600, 40)) < np.linspace(0.9, 0.02, 40)).astype(np.int32) * r.integers(1, 5, (600, 40), dtype=np.int32)
    tf[100:140] = tf[7]
    m = r.integers(30, 300, 600)
    tree = L.Tree(tf, m)
    seen = []

    def walk(node):  # every document once; a node's bounds are those of the documents below it
        rows = []
        for c in tree.children[node]:
            rows += [-1 - c] if c < 0 else walk(c)
        assert (tree.most[node] == tf[rows].max(axis=0)).all() and tree.least[node] == m[rows].min()
        seen.append(node)
        return rows

    assert sorted(walk(tree.root)) == list(range(600)) and len(seen) == len(tree.children) < 600
    weights = np.arange(100, 140)
    items = L.Items([np.array([1, 5, 30, 35]), np.array([39])], [np.array([1, 2, 1, 1]), np.array([3])], weights)
    found = L.Found(2, 5)
    looked = L.search(tree, list(range(600)), items, found)
    for item, (cols, times) in enumerate((([1, 5, 30, 35], [1, 2, 1, 1]), ([39], [3]))):
        score = ((10**9 * tf[:, cols].astype(np.int64)) // (1000 * tf[:, cols].astype(np.int64) + 8 * m[:, None]) * weights[cols] * times).sum(axis=1)
        want = sorted(((-s, d) for d, s in enumerate(score.tolist()) if s > 0))[:5]
        assert sorted((-s, d) for i, d, s in found.rows() if i == item) == want
    assert looked < 600  # documents and nodes together: whole branches were left out


def test_long_texts_in_steps(monkeypatch):
    monkeypatch.setattr(L, "STEP_BYTES", 30)
    text = "One TWO-three Über 4x\x1c5 [six] ñ{7}" * 50
    assert [w.decode() for part in L.terms_of(text) for w in part] == terms(text)


def test_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert L.rank_documents(cases.none(spark), items).count() == 0
    assert L.rank_documents(cases.docs(spark), items.limit(0)).count() == 0
