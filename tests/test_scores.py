import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faqloom.operators import features as X
from faqloom.operators import metrics as M
from faqloom.operators import negatives as N
from faqloom.operators import scoring as R
from tests import plain


def one(df):
    return df.first()["value"]


def test_auc(spark):
    def area(scores, labels):
        rows = [(float(s), y) for s, y in zip(scores, labels)]
        return one(M.roc_auc(spark.createDataFrame(rows, "logit double, y int")))

    assert area([1, 2, 2, 3], [0, 0, 1, 1]) == 0.875
    assert area([1, 2], [1, 1]) is None
    rnd = random.Random(3)
    scores, labels = [rnd.randint(0, 30) for _ in range(300)], [rnd.randint(0, 1) for _ in range(300)]
    assert area(scores, labels) == pytest.approx(plain.auc(scores, labels))
    assert area([-s for s in scores], labels) == pytest.approx(1 - plain.auc(scores, labels))


def test_losses(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 0.5, 0.0], 1, 9)], "x array<double>, y int, far int")
    want = np.log(np.exp([1.0, 2.0, 0.5, 0.0]).sum()) - 2.0
    assert one(M.cross_entropy(rows, F.col("x"), F.col("y"))) == pytest.approx(want)
    clamped = M.span_loss(rows, F.col("x"), F.col("x"), F.col("y"), F.col("y")).first()
    assert (clamped["value"], clamped["n"]) == (pytest.approx(want), 2)
    assert M.span_loss(rows, F.col("x"), F.col("x"), F.col("y"), F.col("far")).first()["n"] == 1
    cells = spark.createDataFrame([(0, 800.0, 1), (1, -800.0, 1), (2, 0.0, 0)], "k long, logit double, y int")
    assert one(M.bce_loss(cells)) == pytest.approx((0 + 800 + np.log(2)) / 3)
    assert one(M.batch_mean_loss(cells, "k", 2, F.col("logit"))) == pytest.approx((0 + 0) / 2)
    mask = spark.createDataFrame([([1, 1, 1], [31, 51, 99]), ([1, 1, 0], [15, 5, 0])], "mask array<int>, ids array<int>")
    assert M.active_positions(mask, "mask", "ids").count() == 5
    with pytest.raises(Exception, match="choices"):
        one(M.choice_loss(cells.withColumn("q", F.lit(0)), "q", "k", "logit", "y", 2))


def test_choices_need_not_fill_the_last_question(spark):
    rows = [(i // 4, i, float(i % 3), 1) for i in range(10)] + [(3, 12, 5.0, 2), (3, 13, 1.0, 0)]
    cells = spark.createDataFrame(rows, "q long, k long, logit double, y int")
    got = M.choice_loss(cells, "q", "k", "logit", "y", 4).first()
    sides = [[0.0, 1.0, 2.0, 0.0], [1.0, 2.0, 0.0, 1.0], [2.0, 0.0]]  # the fourth has no choice 2: counted, without a loss
    assert got["n"] == 4 and got["value"] == pytest.approx(np.mean([np.log(np.exp(x).sum()) - x[1] for x in sides]))


def test_blocked_scores_match_dense(spark, monkeypatch):
    monkeypatch.setattr(R, "LABELS_PER_BLOCK", 3)
    monkeypatch.setattr(R, "ROWS_PER_SLICE", 7)
    rng = np.random.default_rng(0)
    x, w, b = rng.normal(size=(30, 4)), rng.normal(size=(8, 4)), rng.normal(size=8)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, x array<double>")
    m = spark.createDataFrame([(i, r.tolist(), float(b[i])) for i, r in enumerate(w)], "label int, weights array<double>, bias double")
    got = {r.vec_id: r.logits for r in R.linear_scores(v, m).collect()}
    assert np.allclose([got[i] for i in range(30)], x @ w.T + b)
    top = {(r.vec_id, r["rank"]): r.label for r in R.top_labels(R.linear_scores(v, m), 3).collect()}
    assert all(top[(i, k + 1)] == int(np.argsort(-(x @ w.T + b)[i], kind="stable")[k]) for i in range(30) for k in range(3))


def test_ranked_answers_in_blocks(spark, monkeypatch):
    rnd = random.Random(2)
    text = lambda: " ".join(rnd.choice("the a pay tax card visa lost home".split()) for _ in range(rnd.randint(0, 9)))
    answers, questions = [text() for _ in range(40)], [text() for _ in range(50)]
    a = spark.createDataFrame(list(enumerate(answers)), "label long, answer string")
    q = spark.createDataFrame(list(enumerate(questions)), "question_id long, question string")
    df = {}
    for t in answers:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    idf = {w: round(R.IDF_SCALE * float(np.log(41 / (n + 1)))) for w, n in df.items()}
    want = {}
    for i, t in enumerate(questions):
        s = [(sum(t.split().count(w) * u.split().count(w) * idf[w] ** 2 for w in set(t.split()) & set(u.split())), -j) for j, u in enumerate(answers)]
        for k, (score, j) in enumerate(sorted([p for p in s if p[0] > 0], reverse=True)[:5]):
            want[(i, k + 1)] = (-j, score)
    index = R.answer_index(a)
    for block, rows in ((4096, 20000), (7, 9)):
        monkeypatch.setattr(R, "LABELS_PER_BLOCK", block)
        monkeypatch.setattr(R, "ROWS_PER_SLICE", rows)
        got = {(r.question_id, r["rank"]): (r.label, r.score) for r in R.rank_answers(q, index).collect()}
        assert got == want


def test_pair_lengths_like_popping(spark):
    cases = [(a, b, m) for a in range(9) for b in range(9) for m in range(12)]
    for m in range(12):
        df = spark.createDataFrame([(a, b) for a, b, k in cases if k == m], "a int, b int")
        ka, kb = X.pair_lengths(F.col("a"), F.col("b"), m)
        assert all((r.ka, r.kb) == plain.truncate(r.a, r.b, m) for r in df.select("a", "b", ka.alias("ka"), kb.alias("kb")).collect())


def test_feature_layout(spark):
    words = "[PAD] [UNK] [CLS] [SEP] [MASK] is this jack ##son ##ville ? no it not . dog hairy the".split()
    vocab = spark.createDataFrame([(w, i, 1) for i, w in enumerate(words)], "token string, id int, cnt bigint")
    texts = spark.createDataFrame(
        [(1, "is this jacksonville ?", "no it is not ."), (2, "dog hairy .", None), (3, "", "")],
        "guid long, text_a string, text_b string")
    rows = {r.guid: r for r in X.bert_features(texts, vocab, 7, 16).collect()}
    names = lambda ids: [words[i] for i in ids]
    assert names(rows[1].input_ids) == "[CLS] is this jack ##son ##ville ? [SEP] no it is not . [SEP]".split() + ["[PAD]"] * 2
    assert rows[1].segment_ids == [0] * 8 + [1] * 6 + [0] * 2 and rows[1].input_mask == [1] * 14 + [0] * 2
    assert names(rows[2].input_ids)[:5] == "[CLS] dog hairy . [SEP]".split() and sum(rows[2].input_mask) == 5
    assert sum(rows[3].input_mask) == 2
    stop = {r.guid: r for r in X.bert_features(texts, vocab, 7, 16, stop_words=["is", "no", "it"]).collect()}
    assert names(stop[1].input_ids)[:13] == "[CLS] this jack ##son ##ville ? [SEP] no it is not . [SEP]".split()
    cut = {r.guid: r for r in X.bert_features(texts, vocab, 7, 10).collect()}
    assert names(cut[1].input_ids) == "[CLS] is this jack ##son [SEP] no it is [SEP]".split()
    with pytest.raises(Exception, match="too long"):
        X.bert_features(texts, vocab, 7, 10, truncate=False).collect()
    kept = {r.guid: r.too_long for r in X.bert_features(texts, vocab, 7, 10, truncate=False, on_overflow="reject").collect()}
    assert kept == {1: True, 2: False, 3: False}
    labels = spark.createDataFrame([([0, 2, 2],)], "labels array<int>")
    assert labels.select(X.multi_hot(F.col("labels"), 4)).first()[0] == [1, 0, 1, 0]


def test_negative_samples(spark):
    labels = spark.range(50).select(F.expr("id div 25").alias("batch"), F.col("id").cast("int").alias("label"))
    rows = N.negative_samples(labels, 100, 8).collect()
    sets = {b: {tuple(sorted(r.negative for r in rows if r.label == i)) for i in range(25 * b, 25 * b + 25)} for b in (0, 1)}
    assert all(len(s) == 1 for s in sets.values()) and sets[0] != sets[1]  # one set for all labels of a batch
    p = lambda c: np.log((c + 2) / (c + 1)) / np.log(101)
    assert len({(r.label, r.negative) for r in rows}) == len(rows)
    for r in rows:
        assert r.hit == (r.label == r.negative) and 0 <= r.negative < 100
        assert r.samp_log_prob == pytest.approx(np.log(-np.expm1(16 * np.log1p(-p(r.negative)))))


def test_labels_out_of_range_are_an_error(spark):
    rows = spark.createDataFrame([([1.0, 2.0], 0), ([1.0, 2.0], -1)], "x array<double>, y int")
    assert M.cross_entropy(rows, F.col("x"), F.col("y")).first().n == 1
    bad = rows.union(spark.createDataFrame([([1.0, 2.0], 2)], rows.schema))
    with pytest.raises(Exception, match="label out of range"):
        M.cross_entropy(bad, F.col("x"), F.col("y")).collect()


def test_empty_draws_and_long_words_are_errors(spark):
    from faqloom.operators import splits as P
    from faqloom.operators import tokens as K
    from faqloom.operators import vocab as V

    with pytest.raises(ValueError, match="cannot draw"):
        P.sample_n(spark.range(0), ["id"], 1)
    words = spark.createDataFrame([("a" * 1200, 1)], "word string, n long")
    vocab = spark.createDataFrame([("aa", 0)], "token string, id int")
    with pytest.raises(ValueError):
        K.wordpiece_dictionary(words, vocab, 2, max_chars=2000)
    coded = spark.createDataFrame([([1, 2, 3],)], "ids array<int>")
    assert V.with_length_limit(coded, "ids", 3).count() == 1
    with pytest.raises(Exception, match="too long"):
        V.with_length_limit(coded, "ids", 2).collect()
    tokens = spark.createDataFrame([("zz",)], "token string")
    with pytest.raises(Exception, match="not in the vocabulary"):
        V.encode(tokens, vocab).collect()
    assert V.encode(tokens, vocab, "zero").first().id == 0
