from collections import defaultdict

import re

from faqloom.llm import mixing
from tests.llm import cases


def plain_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if w[s] * level >= 2 * sizes[s]]
        if not full:
            target |= {s: w[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= 2 * sizes[s]
            open_.remove(s)
    return target


def check(rows, got):
    sizes, largest = defaultdict(int), defaultdict(int)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for d, t, _, s, *_ in rows:
        sizes[s] += count(t)
        largest[s] = max(largest[s], count(t))
    target = plain_targets(sizes)
    taken = defaultdict(int)
    by = {(d, count(t)): s for d, t, _, s, *_ in rows}
    for g in got:
        s = by[g.doc_id, g["size"]]
        assert g.source_size == sizes[s] and abs(g.target - target[s]) < 1e-6
        assert g.taken in (0, g["size"], 2 * g["size"])
        taken[s] += g.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s], (s, taken[s], target[s])


def test_targets_and_thresholds(spark):
    rows = cases.rows()
    first = mixing.mix(cases.docs(spark)).collect()
    assert len(first) == len(rows)
    check(rows, first)
    again = mixing.mix(cases.docs(spark, parts=7)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_small_sources_are_full(spark):
    rows = [(i, "w " * (i % 7 + 1), None, "big", 0) for i in range(400)] + [(1000 + i, "a b", None, f"s{i}", 0) for i in range(9)]
    rows += [(2000, "", None, "void", 0), (2001, None, None, "void", 0)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()
    check(rows, got)
    assert all(g.taken == 0 for g in got if g["size"] == 0)


def test_rows_and_nothing(spark):
    docs = cases.docs(spark)
    got = mixing.mixed_rows(docs)
    assert set(docs.columns) <= set(got.columns)
    rows = got.collect()
    assert all(r.copies in (1, 2) and r.taken == r.copies * r["size"] for r in rows)
    assert sum(r.taken for r in rows) == sum(r.taken for r in mixing.mix(docs).collect())
    assert mixing.mix(cases.none(spark)).count() == 0


def test_equal_rows_come_near_the_target(spark):
    """A source of 1,000 equal rows, and one of equal rows beside others."""
    rows = [(1, "ten words are in this text and they all count", "a")] * 1000 + [(i, f"word{i} and more of it", "b") for i in range(400)]
    rows += [(7, "five words of one row", "b")] * 300 + [(i, "x " * (i % 9), "c") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = sorted(map(tuple, mixing.mix(docs.repartition(4)).collect()))
    assert first == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect())) and len(first) == len(rows)
    for source_size in {r[2] for r in first}:
        target = next(r[3] for r in first if r[2] == source_size)
        taken = sum(r[4] for r in first if r[2] == source_size)
        assert abs(taken - target) <= 10, (source_size, taken, target)
    kept = mixing.mixed_rows(docs).collect()
    assert sum(r.taken for r in kept) == sum(r[4] for r in first)
