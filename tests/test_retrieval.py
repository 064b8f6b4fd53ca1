import random
from collections import Counter

import numpy as np
import pytest

from faqloom.operators import scoring as R


def corpus(seed, n_answers, n_questions):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    freq = [1 / (i + 1) for i in range(60)]
    index = []
    for label in range(n_answers):
        tokens = sorted(set(r.choices(words, freq, k=r.randint(1, 12) * (10 if label % 50 == 0 else 1))))
        index.append((label, tokens, [r.randint(1, 9) * (1 + int(t[1:])) for t in tokens]))
    questions = [(f"q{i}", " ".join(r.choices(words, freq, k=r.randint(0, 9)))) for i in range(n_questions)]
    return index, questions


def plain(index, questions, k):
    out = []
    for qid, text in questions:
        q = Counter(text.split())
        scores = [(-sum(q[t] * w for t, w in zip(tokens, weights)), label) for label, tokens, weights in index]
        out += [(qid, rank, label, -s) for rank, (s, label) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("rows, regions, block, slices, cells", [(64, 512, 4096, 20_000, 4_000_000), (7, 512, 5, 9, 50), (10, 3, 20, 4, 300)])
def test_best_answers_through_pruned_regions(spark, monkeypatch, rows, regions, block, slices, cells):
    for name, value in (("REGION_ROWS", rows), ("REGIONS", regions), ("LABELS_PER_BLOCK", block), ("ROWS_PER_SLICE", slices), ("STEP_CELLS", cells)):
        monkeypatch.setattr(R, name, value)
    index, questions = corpus(3, 300, 40)
    table = spark.createDataFrame(index, "label long, tokens array<string>, weights array<long>").repartition(3)
    asked = spark.createDataFrame(questions, "question_id string, question string")
    got = sorted(map(tuple, R.rank_answers(asked, table, 4).collect()))
    assert got == plain(index, questions, 4)


def test_regions_that_cannot_matter_are_left_out(spark, monkeypatch):
    """Few answers weigh much: a question that finds them goes nowhere else."""
    monkeypatch.setattr(R, "REGION_ROWS", 10)
    index = [(i, ["a", f"x{i}"], [1000 if i < 20 else 1, 1]) for i in range(200)]
    table = spark.createDataFrame(index, "label long, tokens array<string>, weights array<long>")
    asked = spark.createDataFrame([(i, "a x150" if i % 2 else "a") for i in range(10)], "question_id long, question string")
    routed = []
    whole = R._score_routes
    monkeypatch.setattr(R, "_score_routes", lambda routes, *rest: routed.append(routes.count()) or whole(routes, *rest))
    got = R.rank_answers(asked, table, 5).collect()
    assert {r.label for r in got} <= set(range(20)) | {150} and len(got) == 50
    regions = R.answer_regions(table)[0].select("region").distinct().count()
    assert regions >= 10 and routed[0] == 10 and routed[1] <= 10 * 3  # of 10 * regions


def test_a_question_is_routed_in_one_row_however_many_regions_are_open(spark, monkeypatch):
    """Nothing can be left out: texts still move once, and not once per region or block of answers."""
    monkeypatch.setattr(R, "REGION_ROWS", 10)
    monkeypatch.setattr(R, "STEP_CELLS", 8)
    index = [(i, ["a", f"x{i}"], [5, 5]) for i in range(200)]
    table = spark.createDataFrame(index, "label long, tokens array<string>, weights array<long>")
    questions = [(str(i), f"a x{i} x{i + 90}") for i in range(10)]
    asked = spark.createDataFrame(questions, "question_id string, question string")
    routed = []
    whole = R._score_routes
    monkeypatch.setattr(R, "_score_routes", lambda routes, *rest: routed.append(routes.count()) or whole(routes, *rest))
    got = sorted(map(tuple, R.rank_answers(asked, table, 5).collect()))
    assert got == plain(index, questions, 5) and routed[0] == 10 and routed[1] <= 10


def test_answers_of_one_label_are_one_answer(spark):
    rows = [(1, "b a a"), (1, "a c"), (2, ""), (2, None), (3, "c d"), (4, "d d")]
    index = R.answer_index(spark.createDataFrame(rows, "label long, answer string")).collect()
    idf = {t: round(R.IDF_SCALE * float(np.log(7 / (n + 1)))) for t, n in {"a": 1, "b": 1, "c": 2, "d": 2}.items()}
    want = {1: {"a": 3, "b": 1, "c": 1}, 3: {"c": 1, "d": 1}, 4: {"d": 2}}
    assert {r.label: dict(zip(r.tokens, r.weights)) for r in index} == {
        n: {t: tf * idf[t] ** 2 for t, tf in terms.items()} for n, terms in want.items()}


def test_nothing_to_rank(spark):
    index, questions = corpus(1, 5, 5)
    table = spark.createDataFrame(index, "label long, tokens array<string>, weights array<long>")
    asked = spark.createDataFrame(questions, "question_id string, question string")
    assert R.rank_answers(asked.limit(0), table).count() == 0
    assert R.rank_answers(asked, table.limit(0)).count() == 0


@pytest.mark.parametrize("block, together, rows", [(4096, 64, 20_000), (5, 2, 7), (1, 3, 50)])
def test_best_labels_without_dense_vectors(spark, monkeypatch, block, together, rows):
    monkeypatch.setattr(R, "LABELS_PER_BLOCK", block)
    monkeypatch.setattr(R, "BLOCKS_TOGETHER", together)
    monkeypatch.setattr(R, "ROWS_PER_SLICE", rows)
    r = np.random.default_rng(2)
    x, w, b = r.integers(-3, 4, (30, 4)).astype(float), r.integers(-2, 3, (23, 4)).astype(float), r.integers(-1, 2, 23).astype(float)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<double>")
    labels = spark.createDataFrame([(i, v.tolist(), float(c)) for i, (v, c) in enumerate(zip(w, b))], "label int, weights array<double>, bias double")
    z = x @ w.T + b  # whole numbers: many ties
    for link in (None, "sigmoid", "softmax"):
        got = {(g.vec_id, g["rank"]): (g.label, round(g.score, 9)) for g in R.best_labels(vectors, labels, 4, link).collect()}
        for i, row in enumerate(z):
            value = {"sigmoid": 1 / (1 + np.exp(-row)), "softmax": np.exp(row) / np.exp(row).sum()}.get(link, row)
            for rank, n in enumerate(sorted(range(23), key=lambda n: (-row[n], n))[:4], 1):
                assert got.pop((i, rank)) == (n, round(float(value[n]), 9))
        assert not got


def test_banded_loss(spark):
    from pyspark.sql import functions as F

    from faqloom.functions.vectors import banded_nll

    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=9).tolist(), r.normal(size=2).tolist(), i % 9) for i in range(40)]
    table = spark.createDataFrame(rows, "i int, z array<double>, c array<double>, y int")
    got = dict(table.select("i", banded_nll(F.col("z"), F.col("y"), [3, 5, 9], F.col("c"))).collect())
    for i, z, c, y in rows:
        z, head = np.array(z), np.array([*z[:3], *c])
        norm = np.log(np.exp(head).sum())
        band = None if y < 3 else slice(3, 5) if y < 5 else slice(5, 9)
        want = norm - z[y] if band is None else norm - c[band.start > 3] + np.log(np.exp(z[band]).sum()) - z[y]
        assert abs(got[i] - want) < 1e-9
    # all probabilities together are one
    z, c = np.zeros(9), [0.3, -0.2]
    whole = spark.createDataFrame([(k, z.tolist(), c) for k in range(9)], "y int, z array<double>, c array<double>")
    assert abs(sum(np.exp(-x[0]) for x in whole.select(banded_nll(F.col("z"), F.col("y"), [3, 5, 9], F.col("c"))).collect()) - 1) < 1e-9


def test_a_question_has_few_regions_however_many_answers(spark):
    from pyspark.sql import functions as F

    answers = spark.range(40_000).select(
        F.col("id").alias("label"), F.array(F.lit("a"), F.concat(F.lit("x"), F.col("id") % 900)).alias("tokens"),
        F.array(F.col("id") % 7 + 1, F.col("id") % 5000 + 1).alias("weights"))
    assert R.answer_regions(answers)[0].agg(F.max("region")).first()[0] < 32
