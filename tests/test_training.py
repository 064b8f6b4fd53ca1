import numpy as np
import pytest

from faqloom.operators import training as T
from faqloom.plans.text import made_once


def examples(n=300, width=30, labels=7, seed=3):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        f = [0, *sorted(r.choice(np.arange(1, width), r.integers(0, 8), replace=False).tolist())]
        x = [T.UNIT, *r.integers(0, 400, len(f) - 1).tolist()]
        y = sorted({k % labels for k in f if k % 3 == 1} | ({0} if i % 4 == 0 else set()))
        rows.append((i, f, x, y))
    return rows


def plain(rows, width, labels, steps):
    """The same descent on dense whole numbers."""
    X = np.zeros((len(rows), width), object)
    Y = np.zeros((len(rows), labels), object)
    for i, (_, f, x, y) in enumerate(rows):
        X[i, f], Y[i, y] = x, T.ONE
    w = np.zeros((width, labels), object)
    for _ in range(steps):
        z = (X @ w) // T.UNIT
        e = T.probabilities(z.astype(np.int64)).astype(object) - Y
        w = w - (T.RATE[0] * (X.T @ e)) // (T.RATE[1] * len(rows) * T.UNIT)
    return w, (X @ w) // T.UNIT


@pytest.mark.parametrize("group, block, tasks", [(64 << 20, 1 << 16, 32), (30 * 8 * 3, 12, 1), (30 * 8, 7, 2)])
def test_steps_are_exact(spark, monkeypatch, group, block, tasks):
    """Whatever the groups of labels, the blocks and the tasks summed together, the weights are the same."""
    monkeypatch.setattr(T, "GROUP_BYTES", group)
    monkeypatch.setattr(T, "BLOCK_CELLS", block)
    monkeypatch.setattr(T, "TASKS", tasks)
    rows = examples()
    df = spark.createDataFrame(rows, "example long, f array<int>, x array<long>, y array<int>").repartition(5)
    weights = T.fit_labels(df, 30, 7, steps=4)
    want, z = plain(rows, 30, 7, 4)
    got = {(r.feature, r.label): r.weight for r in T.weight_table(weights).collect()}
    assert got == {(f, k): int(want[f, k]) for f in range(30) for k in range(7)}
    p = {(r.example, r.label): r.p for r in T.predict_labels(df, weights).collect()}
    assert p == {(i, k): int(T.probabilities(np.array([int(z[i, k])]))[0]) for i in range(len(rows)) for k in range(7)}


def test_loss_falls(spark):
    rows = examples(600)
    df = spark.createDataFrame(rows, "example long, f array<int>, x array<long>, y array<int>")
    losses = []
    for steps in (1, 10, 40):
        p = {(r.example, r.label): r.p / T.ONE for r in T.predict_labels(df, T.fit_labels(df, 30, 7, steps)).collect()}
        losses.append(-np.mean([np.log(max(p[i, k] if k in y else 1 - p[i, k], 1e-9)) for i, _, _, y in rows for k in range(7)]))
    assert losses[0] > losses[1] > losses[2]


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "example long, f array<int>, x array<long>, y array<int>")
    weights = T.fit_labels(none, 3, 2)
    assert T.weight_table(weights).count() == 0
    one = spark.createDataFrame([(1, [0, 2], [100, 50])], "example long, f array<int>, x array<long>")
    assert sorted(map(tuple, T.predict_labels(one, weights).collect())) == [(1, 0, T.ONE // 2), (1, 1, T.ONE // 2)]


def test_tables_follow_their_data(spark, tmp_path):
    """What was made from a path is made anew once the path holds other data."""
    root = str(tmp_path)

    def read():
        return made_once(spark, root, "follows", lambda: spark.read.parquet(f"{root}/t.parquet")).count()

    spark.range(5).write.parquet(f"{root}/t.parquet")
    assert read() == read() == 5
    spark.range(9).write.mode("overwrite").parquet(f"{root}/t.parquet")
    assert read() == 9
