import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from faqloom.llm import simhash
from faqloom.llm.components import components
from tests.llm import cases


def plain_fingerprint(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in low).split(" ") if w]
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def classes(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def close(fps, distance):
    fps = sorted(fps)
    return [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= distance]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randint(200, 300), r.randint(200, 300)) for _ in range(60)]
    edges += [(-5, 7000), (7000, -9), (8, 8)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    linked = [(a, b) for a, b in edges if a != b]
    assert got == classes({x for e in linked for x in e}, linked)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("crowd", [64, 2])
def test_links_lose_nothing(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    r = random.Random(crowd)
    fps = {r.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1, 1 << 63}
    for base in list(fps)[:25]:
        for _ in range(6):
            fps.add(base ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))))
    for distance in (0, 1, 2):
        got = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp bigint"), distance).collect()
        mask = (1 << 64) - 1
        pairs = {tuple(sorted((a & mask, b & mask))) for a, b in got}
        assert all((a ^ b).bit_count() <= distance for a, b in pairs)
        assert classes(fps, pairs) == classes(fps, close(fps, distance))


def test_groups(spark):
    rows = cases.rows()
    got = simhash.groups(cases.docs(spark)).select("doc_id", "text_key", "fingerprint", "component_id").collect()
    prints = [(d, plain_fingerprint(t)) for d, t, *_ in rows]
    roots = classes({f for _, f in prints}, close({f for _, f in prints}, 2))
    ids = defaultdict(set)
    for d, f in prints:
        ids[roots[f]].add(d)
    want = sorted((str(d), f"{f:016x}", str(min((x for x in ids[roots[f]] if x is not None), default=None))) for d, f in prints)
    assert sorted((str(g.doc_id), g.fingerprint, str(g.component_id)) for g in got) == want
    assert simhash.groups(cases.none(spark)).count() == 0


def test_long_texts_in_chunks(monkeypatch):
    text = " ".join(str(x) for x in np.random.default_rng(1).integers(0, 500, 5000))
    whole = simhash.fingerprint(text.encode(), 3)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text.encode(), 3) == whole == signed(plain_fingerprint(text))


def test_deduplicate(spark):
    docs = cases.docs(spark)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    groups = simhash.groups(docs).select("doc_id", "root", "component_id").collect()
    want = {g.root: g.component_id for g in groups}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, want.values()))
    assert simhash.deduplicate(cases.none(spark)).count() == 0
