"""Exact top-k inner products: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz residual bounds.

Vectors become whole numbers, ``floor(scale * x)``.  They are dealt into ranges of descending length, and a range into
blocks of bounded size.  A first look at a bounded head of the longest vectors gives each query a k-th best score to
beat; ranges whose longest vector cannot reach it are never sent to the query.  In a block, candidates come longest
first.  All vectors are turned into the axes of the singular value decomposition (the leading ones if they are very wide),
so the first coordinates carry most of a product, and the rest is bounded by the product of the residual lengths.  Candidates whose bound falls short are
dropped; the others get their exact whole-number product, and the score to beat rises.

Every query meets every block it can gain from (the query set is stated, and blocks bound what a task holds); a block
hands on k rows per query.

Defined cases: vectors that are null, hold null or non-finite components, or have no id take no part; shorter vectors
count as if filled up with zeros; rows that repeat an id are candidates of their own, and queries of their own; ties go
to the smaller id; scores beyond 64 bits stop at the largest number; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faqloom.session import materialize

HEAD = 4096
RANGES = 256
BLOCK = 32_768
SLICE = 4_096
CHUNK = 1_024
#: Components of the vectors that a task holds of a block, of queries, or of the head.
CELLS = 1 << 24
#: Numbers of the matrix that the axes are found with.  Vectors of up to its root of components are turned into all axes,
#: wider ones into as many leading axes as it has room for.
AXES_CELLS, LEAST_AXES, PIECE = 1 << 20, 8, 1 << 16
#: Bounds are floating point; a score that they miss by less than this share of the lengths' product is worked out.
SLACK = 1e-9
OUT = "row bigint, query_id bigint, vec_id bigint, score bigint, at bigint"


def whole_vectors(df: DataFrame, scale: float, vec_id: str, embedding: str) -> DataFrame:
    """row (a number of its own), vec_id, v (whole numbers), norm."""
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    v = F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = df.filter(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & sound)
    return rows.select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v")
    ).withColumn("norm", norm)


def matrix(vectors, width: int, kind=np.int64) -> np.ndarray:
    out = np.zeros((len(vectors), width), kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(float) @ c.T.astype(float)).astype(np.int64)  # every partial sum is exact
    if most < 2**62:
        return q @ c.T
    exact = q.astype(object) @ c.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def summed_products(vectors: DataFrame, width: int, by: np.ndarray | None) -> np.ndarray:
    """The sum of v v' over all vectors, times ``by``: added up in tasks, then in pieces of bounded size."""
    sent = vectors.sparkSession.sparkContext.broadcast(by)
    columns = width if by is None else by.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, columns))
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, CELLS // (8 * width))):
                m = matrix(batch.slice(at, max(1, CELLS // (8 * width))).column("v").to_pylist(), width, float)
                total += m.T @ (m if sent.value is None else m @ sent.value)
        flat = total.ravel()
        for at in range(0, flat.size, PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([flat[at : at + PIECE].tobytes()], pa.binary())], ["at", "x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, x in zip(batch.column("at").to_pylist(), batch.column("x").to_pylist()):
                held[at] = held.get(at, 0) + np.frombuffer(x)
        for at, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([x.tobytes()], pa.binary())], ["at", "x"])

    pieces = vectors.select("v").mapInArrow(run, "at bigint, x binary").repartition("at").mapInArrow(add, "at bigint, x binary")
    flat = np.zeros(width * columns)
    for at, x in pieces.collect():  # AXES_CELLS numbers
        flat[at : at + len(x) // 8] = np.frombuffer(x)
    return np.nan_to_num(flat.reshape(width, columns))


def axes(vectors: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all vectors, strongest first: all of them from the summed matrix of products, or of wide
    vectors the leading ones, by products with a random matrix (randomised range finder)."""
    if not width:
        return np.eye(0)
    if width * width <= AXES_CELLS:
        gram = summed_products(vectors, width, None)
        return np.linalg.eigh(gram / (np.abs(gram).max(initial=0) or 1.0))[1][:, ::-1]
    leading = min(width, max(LEAST_AXES, AXES_CELLS // width))
    start = np.linalg.qr(np.random.default_rng(7).standard_normal((width, leading)))[0]
    reach = summed_products(vectors, width, start)
    span = np.linalg.qr(reach / (np.abs(reach).max(initial=0) or 1.0))[0]
    image = span.T @ summed_products(vectors, width, span)
    image = (image + image.T) / 2
    return span @ np.linalg.eigh(image / (np.abs(image).max(initial=0) or 1.0))[1][:, ::-1]


def residuals(whole: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The lengths of vectors outside the leading axes, no less than they are."""
    square = np.square(whole.astype(float)).sum(axis=1)
    return np.sqrt(np.maximum(square - np.square(lead).sum(axis=1), 0) + 1e-12 * square)


class Best:
    """The best rows of each query so far, and the score that a newcomer has to reach."""

    def __init__(self, tau: np.ndarray, k: int):
        self.k, self.tau = k, tau.astype(float)
        self.found = tuple(np.zeros(0, np.int64) for _ in range(4))  # query, score, vec_id, row

    def add(self, query, score, vec_id, row):
        query, score, vec_id, row = (np.concatenate(p) for p in zip(self.found, (query, score, vec_id, row)))
        order = np.lexsort((row, vec_id, -score.astype(float) if score.size and score.min() == -(2**63) else -score, query))
        query = query[order]
        start = np.searchsorted(query, query)
        place = np.arange(len(query)) - start
        keep = place < self.k
        last = place == self.k - 1
        self.tau[query[last]] = np.maximum(self.tau[query[last]], score[order][last])
        self.found = (query[keep], score[order][keep], vec_id[order][keep], row[order][keep])


def search(q: pd.DataFrame, c: pd.DataFrame, k: int, turn: np.ndarray) -> Best:
    """The best k candidates for each query, none below the query's tau."""
    width = len(turn)
    # a quarter of the axes leads if all are known, else those that are
    turn = turn[:, : max(1, width // 4)] if turn.shape[1] == width else turn
    c = c.iloc[np.argsort(-c["norm"].to_numpy(), kind="stable")]
    qv, cv = matrix(q["v"], width), matrix(c["v"], width)
    qr, qn, cn = qv @ turn, q["norm"].to_numpy(), c["norm"].to_numpy()
    q_rest = residuals(qv, qr)
    q_rows, c_ids, c_rows = q["row"].to_numpy(), c["vec_id"].to_numpy(np.int64), c["row"].to_numpy(np.int64)
    best = Best(q["tau"].to_numpy(), k)
    for at in range(0, len(cv), CHUNK):
        part = slice(at, at + CHUNK)
        slack = SLACK * qn * cn[at] + SLACK
        open_ = np.flatnonzero(qn * cn[at] + slack >= best.tau)  # the longest of the chunk could still do
        if not len(open_):
            break  # and so for all that follow, which are shorter
        cr = cv[part] @ turn
        bound = qr[open_] @ cr.T + np.outer(q_rest[open_], residuals(cv[part], cr)) + slack[open_, None]
        may = (bound >= best.tau[open_, None]) & (q_rows[open_, None] != c_rows[None, part])
        some = np.flatnonzero(may.any(axis=1))
        if not len(some):
            continue
        exact = products(qv[open_[some]], cv[part])
        i, j = np.nonzero(may[some] & (exact >= best.tau[open_[some], None]))
        best.add(open_[some][i], exact[i, j], c_ids[part][j], c_rows[part][j])
    return best


def top_k(
    df: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """Per query row (where ``queries`` holds on vec_id) its k best other rows: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    vectors = materialize(whole_vectors(df, scale, vec_id, embedding), "topk-vectors")
    n, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    result = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not n:
        return spark.createDataFrame([], result)
    turn = axes(vectors, width)
    # ranges of descending length: approximate borders do, each range then says how long its longest is
    cuts = max(1, min(RANGES, n // CHUNK))
    shares = [i / cuts for i in range(1, cuts)]
    borders = sorted(set(vectors.agg(F.percentile_approx("norm", shares, 10_000)).first()[0] if shares else []))
    above = F.lit(0)
    for b in borders:
        above = above + (F.col("norm") <= F.lit(b)).cast("int")
    ranged = vectors.withColumn("range", above)
    seen = {r["range"]: (r["rows"], r["longest"]) for r in
            ranged.groupBy("range").agg(F.count("*").alias("rows"), F.max("norm").alias("longest")).collect()}
    held = max(1, CELLS // max(width, 1))  # rows that fit a task
    size = min(BLOCK, held, max(CHUNK, math.ceil(n / (4 * spark.sparkContext.defaultParallelism))))
    # short ranges share a block, a long one is dealt into several
    number, block_of, rows_in = 0, {}, 0
    for r in sorted(seen):
        rows = seen[r][0]
        if rows_in and rows_in + rows > size:
            number, rows_in = number + 1, 0
        several = math.ceil(rows / size)
        block_of[r] = (number, several)
        number, rows_in = (number + several, 0) if several > 1 else (number, rows_in + rows)
    blocks = number + (1 if rows_in else 0)
    longest = np.zeros(blocks)
    for r, (first, several) in block_of.items():
        longest[first : first + several] = np.maximum(longest[first : first + several], seen[r][1])
    deal = F.create_map(*[F.lit(x) for r, (first, several) in block_of.items() for x in (r, first)])
    many = F.create_map(*[F.lit(x) for r, (first, several) in block_of.items() for x in (r, several)])
    share = F.pmod(F.xxhash64("row"), many[F.col("range")].cast("bigint")).cast("int")
    blocked = materialize(ranged.withColumn("block", deal[F.col("range")] + share).drop("range"), "topk-blocks")
    head = blocked.orderBy(F.desc("norm"), "row").limit(min(HEAD, held)).toPandas()  # HEAD rows and CELLS numbers at most
    sent = spark.sparkContext.broadcast((head, turn, longest))

    def first_look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, turn, longest = sent.value
        for q in batches:
            q = q.assign(tau=-math.inf)
            tau = search(q, head, k, turn).tau
            # the last block worth a visit: blocks come by descending length
            reach = longest[None, :] * q["norm"].to_numpy()[:, None] * (1 + SLACK) + SLACK >= tau[:, None]
            last = np.where(reach.any(axis=1), longest.size - 1 - np.argmax(reach[:, ::-1], axis=1), -1)
            yield q.assign(tau=tau, last=last)

    asked = blocked.filter(queries).select("row", "vec_id", "v", "norm")
    asked = asked.repartition(spark.sparkContext.defaultParallelism, "row")
    looked = asked.mapInPandas(first_look, "row bigint, vec_id bigint, v array<bigint>, norm double, tau double, last int")
    looked = materialize(looked, "topk-queries")
    # queries of like reach share a slice, slices by rising reach: a block goes only to slices that reach it
    few, number, first, several, reached = min(SLICE, held), 0, {}, {}, []
    open_rows = 0
    for last, rows in sorted((r["last"], r["count"]) for r in looked.filter("last >= 0").groupBy("last").count().collect()):
        if open_rows and open_rows + rows > few:
            number, open_rows = number + 1, 0
        first[last], several[last] = number, math.ceil(rows / few)
        reached += [last] * (number + several[last] - len(reached))
        reached[number:] = [last] * (len(reached) - number)
        number, open_rows = (number + several[last], 0) if several[last] > 1 else (number, open_rows + rows)
    if not reached:
        return spark.createDataFrame([], result)
    at, starts = 0, []  # of a block: the first slice that reaches it
    for b in range(reached[-1] + 1):
        while reached[at] < b:
            at += 1
        starts.append((b, at))
    starts = F.broadcast(spark.createDataFrame(starts, "block int, _from int"))  # a row per block
    dealt = F.broadcast(spark.createDataFrame([(x, first[x], several[x]) for x in first], "last int, _first int, _several int"))
    mine = looked.join(dealt, "last").withColumn("slice", F.col("_first") + F.pmod(F.xxhash64("row"), F.col("_several")).cast("int"))
    mine = mine.drop("_first", "_several").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last"))))
    theirs = blocked.join(starts, "block").withColumn("slice", F.explode(F.sequence(F.col("_from"), F.lit(len(reached) - 1)))).drop("_from")

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({x.split()[0]: pd.Series([], dtype="int64") for x in OUT.split(", ")})
        query, score, ids, rows = search(q, c, k, sent.value[1]).found
        return pd.DataFrame({"row": q["row"].to_numpy()[query], "query_id": q["vec_id"].to_numpy()[query],
                             "vec_id": ids, "score": score, "at": rows})

    pairs = mine.groupBy("block", "slice").cogroup(theirs.groupBy("block", "slice")).applyInPandas(meet, OUT)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "at")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
