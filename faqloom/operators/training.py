"""One linear classifier for all labels at once: gradient descent on whole numbers.

Weights, errors and gradients are fixed-point integers, so that sums do not depend on the order in which tasks add them up
and every run, on any cluster, ends with the same weights.  Examples are sparse rows that stay where they are; a step sends
the weights to them, in groups of labels whose bytes are bounded, and no loop runs over labels.  A task adds up the gradient
of its examples before it hands on blocks of (features x labels); these are summed in two levels, first among some tasks,
then over all, and the block's new weights are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faqloom.operators.lookup import lookup
from faqloom.session import materialize

#: A weight of 1 and a feature value of 1.
ONE, UNIT = 1_000_000, 100
#: Step size as a fraction, and the number of steps.
RATE, STEPS = (1, 10), 10
#: Weights that go to the examples at once, in bytes; cells of a block that is summed up; tasks summed at the first level.
GROUP_BYTES, BLOCK_CELLS, TASKS = 64 << 20, 1 << 16, 32
ROWS = 512
BLOCK = "start int, labels int, block int, values binary"


def vocabulary(tokens: DataFrame, size: int) -> DataFrame:
    """The ``size`` tokens in most examples, by falling number, then by token: feature (from 1; 0 is the bias), token, x, the
    token's inverse document frequency.  ``tokens``: example, tokens."""
    n = tokens.count()
    df = tokens.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    first = df.orderBy(F.desc("df"), "token").limit(size)
    place = F.row_number().over(Window.orderBy(F.desc("df"), "token"))  # of ``size`` rows
    x = F.round(UNIT * F.ln((n + 1) / (F.col("df") + 1))).cast("bigint")
    return first.select(place.alias("feature"), "token", x.alias("x"), "df")


def sparse_examples(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(example, tokens) -> example, f, x: the features an example holds, in order, the bias first."""
    cells = tokens.select("example", F.explode(F.array_distinct("tokens")).alias("token"))
    found = lookup(cells, words, "token", ["feature", "x"], "df").filter(F.col("feature").isNotNull())
    held = found.groupBy("example").agg(F.sort_array(F.collect_list(F.struct("feature", "x"))).alias("c"))
    rows = tokens.select("example").join(held, "example", "left")
    bias = F.array(F.struct(F.lit(0).alias("feature"), F.lit(UNIT).cast("bigint").alias("x")))
    cells = F.concat(bias, F.coalesce("c", F.array().cast("array<struct<feature:int,x:bigint>>")))
    return rows.select("example", cells["feature"].alias("f"), cells["x"].alias("x"))


def probabilities(z: np.ndarray) -> np.ndarray:
    """Fixed-point sigmoid of fixed-point scores."""
    return np.floor(ONE / (1 + np.exp(-(z / ONE)))).astype(np.int64)


def _product(batch: pa.RecordBatch, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores of a batch's examples for some labels, and the batch's cells: row, feature, value."""
    sizes = batch.column("f").value_lengths().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    f, x = (batch.column(c).flatten().to_numpy() for c in ("f", "x"))
    z = np.add.reduceat(weights[f] * x[:, None], starts, axis=0) // UNIT  # every example has the bias
    return z, np.repeat(np.arange(len(sizes)), sizes), f, x


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _packed(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
    start, labels, block, values = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(start, pa.int32()), pa.array(labels, pa.int32()), pa.array(block, pa.int32()),
         pa.array([v.tobytes() for v in values], pa.binary())], ["start", "labels", "block", "values"])


class Weights:
    """Weights in the shared folder, in blocks of whole features of a group of labels."""

    def __init__(self, spark, features: int, labels: int):
        self.spark, self.features, self.labels = spark, features, labels
        self.group = max(1, min(labels, GROUP_BYTES // (8 * features)))
        self.starts = range(0, labels, self.group)
        self.parts: dict[int, DataFrame | None] = {start: None for start in self.starts}

    def size(self, start: int) -> int:
        return min(self.group, self.labels - start)

    def rows_of_block(self, start: int) -> int:
        return max(1, BLOCK_CELLS // self.size(start))

    def get(self, start: int) -> np.ndarray:
        """A group's weights: features x labels, at most ``GROUP_BYTES``."""
        out = np.zeros((self.features, self.size(start)), np.int64)
        if self.parts[start] is not None:
            step = self.rows_of_block(start)
            for row in self.parts[start].toLocalIterator():
                at = row["block"] * step
                values = np.frombuffer(row["values"], np.int64).reshape(-1, self.size(start))
                out[at : at + len(values)] = values
        return out


def _gradient(examples: DataFrame, weights: np.ndarray, start: int, step: int) -> DataFrame:
    """A block's sums of feature value times error, per task: part (tasks that are summed together), and the block."""
    sent = examples.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        total = np.zeros_like(w)
        for batch in _slices(batches):
            z, row, f, x = _product(batch, w)
            error = probabilities(z)
            sizes = batch.column("y").value_lengths().to_numpy(zero_copy_only=False)
            y = batch.column("y").flatten().to_numpy()
            held = np.repeat(np.arange(len(sizes)), sizes)
            mine = (y >= start) & (y < start + w.shape[1])
            error[held[mine], y[mine] - start] -= ONE
            order = np.argsort(f, kind="stable")
            own = f[order]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            total[own[first]] += np.add.reduceat(error[row[order]] * x[order][:, None], first, axis=0)
        out = _packed([(start, w.shape[1], b, total[at : at + step]) for b, at in enumerate(range(0, len(w), step))])
        part = pa.array([TaskContext.get().partitionId() // TASKS] * out.num_rows, pa.int32())
        yield out.append_column("part", part)

    return examples.select("f", "x", "y").mapInArrow(run, BLOCK + ", part int")


def _summed(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of equal keys added up; they come to a task one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys), row
                values = np.frombuffer(row["values"], np.int64)
                if key is not None and key[0] == own[0]:
                    total = total + values
                    continue
                if key is not None:
                    yield _packed([(key[1]["start"], key[1]["labels"], key[1]["block"], total)])
                key, total = own, values
        if key is not None:
            yield _packed([(key[1]["start"], key[1]["labels"], key[1]["block"], total)])

    dealt = blocks.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, BLOCK)


def fit_labels(examples: DataFrame, features: int, labels: int, steps: int = STEPS, rate: tuple[int, int] = RATE) -> Weights:
    """Weights of ``labels`` independent labels (binary cross-entropy) after some steps from zero.

    ``examples``: f, x (features with values, the bias 0 in every row) and y, the numbers of the labels that hold.  They are
    read once per step and group of labels.  Sums stay exact up to 2**63: ONE times the values of a feature in all examples.
    """
    spark = examples.sparkSession
    n = examples.count()
    weights = Weights(spark, features, labels)
    if not n:
        return weights
    above, below = rate[0], rate[1] * n * UNIT
    for _ in range(steps):
        for start in weights.starts:
            old, step = weights.get(start), weights.rows_of_block(start)
            sent = spark.sparkContext.broadcast(old)

            def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for row in batch.to_pylist():
                        at, width = row["block"] * step, row["labels"]
                        g = np.frombuffer(row["values"], np.int64).reshape(-1, width)
                        yield _packed([(row["start"], width, row["block"], sent.value[at : at + len(g)] - above * g // below)])

            near = _summed(_gradient(examples, old, start, step), ["start", "block", "part"])
            whole = _summed(near, ["start", "block"])
            weights.parts[start] = materialize(whole.mapInArrow(descend, BLOCK), "training-weights")
    return weights


def weight_table(weights: Weights) -> DataFrame:
    """feature, label, weight (fixed-point)."""
    out = None
    for start in weights.starts:
        step = weights.rows_of_block(start)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    w = np.frombuffer(row["values"], np.int64).reshape(-1, row["labels"])
                    f, label = np.indices(w.shape)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((row["block"] * step + f).ravel().astype(np.int32)), pa.array((start + label).ravel().astype(np.int32)),
                         pa.array(w.ravel())], ["feature", "label", "weight"])

        if weights.parts[start] is not None:
            part = weights.parts[start].mapInArrow(run, "feature int, label int, weight bigint")
            out = part if out is None else out.unionByName(part)
    return weights.spark.createDataFrame([], "feature int, label int, weight bigint") if out is None else out


def predict_labels(examples: DataFrame, weights: Weights) -> DataFrame:
    """example, label, p (fixed-point probability) for every example and label."""
    kind = examples.schema["example"].dataType.simpleString()
    out = None
    for start in weights.starts:
        sent = weights.spark.sparkContext.broadcast(weights.get(start))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                p = probabilities(_product(batch, sent.value)[0])
                row, label = np.indices(p.shape)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("example").take(pa.array(row.ravel())), pa.array((start + label).ravel().astype(np.int32)),
                     pa.array(p.ravel())], ["example", "label", "p"])

        part = examples.select("example", "f", "x").mapInArrow(run, f"example {kind}, label int, p bigint")
        out = part if out is None else out.unionByName(part)
    return out
