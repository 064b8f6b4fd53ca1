import random

import pytest
from pyspark.sql import functions as F

from faqloom.operators import corpora as C
from tests import plain


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, line_no int, ids array<int>")


def batches(df):
    out = {}
    for r in df.collect():
        out[(r.batch, r.lane)] = (r.input, r.target)
    return out


def want_ordered(flat, bsz, windows, ext):
    n = len(flat) // bsz
    lanes = [flat[i * n : (i + 1) * n] for i in range(bsz)]
    return {
        (k, i): (lane[max(0, s - ext) : s + ln], lane[s + 1 : s + 1 + ln])
        for k, (s, ln) in enumerate(windows(n))
        for i, lane in enumerate(lanes)
    }


def some_lines(seed, n, longest):
    rnd = random.Random(seed)
    rows, token = [], 0
    for d in range(n):
        for line in range(rnd.randint(0, 3)):
            k = rnd.randint(0, longest)
            rows.append((d * 3, line, list(range(token, token + k))))
            token += k
    return rows


def test_ordered_golden(spark):
    got = batches(C.ordered_batches(C.place_lines(corpus(spark, [(0, 0, list(range(7))), (1, 0, [7, 8, 9])])), 2, 2))
    assert got == {
        (0, 0): ([0, 1], [1, 2]), (0, 1): ([5, 6], [6, 7]),
        (1, 0): ([2, 3], [3, 4]), (1, 1): ([7, 8], [8, 9]),
    }


@pytest.mark.parametrize("bsz,bptt,ext,longest", [(1, 3, 0, 5), (3, 4, 2, 40), (7, 2, 5, 9)])
def test_ordered_like_plain_walk(spark, bsz, bptt, ext, longest):
    rows = some_lines(bsz, 40, longest)
    flat = [t for *_, ids in rows for t in ids]
    windows = lambda n: [(s, min(bptt, n - 1 - s)) for s in range(0, n - 1, bptt)]
    got = batches(C.ordered_batches(C.place_lines(corpus(spark, rows)), bsz, bptt, ext))
    assert got == want_ordered(flat, bsz, windows, ext)


def test_varlen_windows_cover_the_lane(spark):
    rows = some_lines(9, 60, 30)
    flat = [t for *_, ids in rows for t in ids]
    placed = C.place_lines(corpus(spark, rows))
    n = len(flat) // 3
    ws = [(r.start, r.seq_len) for r in C.window_lengths(spark, n, 12, 42).orderBy("batch").collect()]
    assert ws[0][0] == 0 and all(a + ln == b for (a, ln), (b, _) in zip(ws, ws[1:]))
    assert sum(ln for _, ln in ws) in (n - 1, n - 2) and all(5 <= ln <= 27 for _, ln in ws[:-1])
    assert batches(C.varlen_batches(placed, 3, 12, 42, ext_len=3)) == want_ordered(flat, 3, lambda _: ws, 3)


def test_packed_golden_and_one_lane(spark):
    got = batches(C.packed_batches(corpus(spark, [(0, 0, [1, 2, 3]), (1, 0, [4, 5, 6, 7])]), 1, 3))
    assert got == {(0, 0): ([1, 2, 4], [2, 3, 5])}
    rows = some_lines(4, 60, 6)
    want = plain.pack([ids for *_, ids in rows], 4)
    got = batches(C.packed_batches(corpus(spark, rows), 1, 4))
    assert got == {(i, 0): ([a for a, _ in p], [b for _, b in p]) for i, p in enumerate(want)}


def test_packed_lanes_context_and_files(spark):
    rows = some_lines(5, 90, 8)
    df = corpus(spark, rows).withColumn("source", F.when(F.col("doc_id") % 9 == 0, "x").otherwise("y"))
    got = {(r.source, r.batch, r.lane): (r.input, r.target) for r in C.packed_batches(df, 2, 5, 3, ["source"]).collect()}
    want = {}
    for name in "xy":
        sents = [ids for d, _, ids in rows if len(ids) > 1 and (d % 9 == 0) == (name == "x")]
        pairs = [(a, b) for s in sents for a, b in zip(s, s[1:])]
        size = len(pairs) // 10 * 5
        for i in range(2):
            p = pairs[i * size : (i + 1) * size]
            for k in range(size // 5):
                want[(name, k, i)] = ([a for a, _ in p[max(0, k * 5 - 3) : k * 5 + 5]], [b for _, b in p[k * 5 : k * 5 + 5]])
    assert got == want


@pytest.mark.parametrize("bsz", [1, 2, 4, 8])
def test_packed_loses_less_than_a_batch(spark, bsz):
    rows = some_lines(6, 120, 9)
    df = corpus(spark, rows)
    pairs = sum(max(0, len(ids) - 1) for *_, ids in rows)
    windows = C.packed_batches(df, bsz, 4).count()
    assert windows % bsz == 0 and 0 <= pairs - 4 * windows < 4 * bsz


def test_packed_files_keep_pairs_in_sentences(spark):
    df = corpus(spark, some_lines(5, 90, 8)).withColumn("source", F.when(F.col("doc_id") % 9 == 0, "x").otherwise("y"))
    shuffled = C.packed_batches(df, 2, 5, 0, ["source"], shuffle_seed=1).collect()
    assert all(b == a + 1 for r in shuffled for a, b in zip(r.input, r.target))


def test_texts_and_not_tokens_are_shuffled(spark, tmp_path):
    """One plan for a small file and for a table of many splits: a single exchange, below the explode."""
    from faqloom.plans import corpora as plans
    from faqloom.plans.text import word_vocab

    root = "/root/testdata/sf0.001"
    spark.read.parquet(f"{root}/documents.parquet").repartition(24).write.parquet(f"{tmp_path}/documents.parquet")
    for where in (root, str(tmp_path)):
        vocab = word_vocab(spark, where)
        rows = plans.document_lines(spark, where, "source", regroup=True)
        plan = C.encode_lines(rows, vocab, plans.KEY, "zero", lower=True)._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert len(exchanges) == 1 and "doc_id" in exchanges[0] and "line_no" not in exchanges[0], plan


def test_places_need_no_lists(spark):
    placed = C.place_lines(corpus(spark, [(0, 0, [1, 2, 3]), (1, 0, [4])])).select("doc_id", "line_no", "at")
    plan = placed._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = next(i for i, line in enumerate(plan) if "RepartitionByExpression" in line)
    assert " AS _value" in plan[dealt + 1] and ", ids#" not in plan[dealt + 1]
    assert sorted(map(tuple, placed.collect())) == [(0, 0, 0), (1, 0, 3)]
