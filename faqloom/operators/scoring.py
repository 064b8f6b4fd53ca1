"""Label scores and ranked answers.

Scoring every example against every label is a blocked product: labels come in blocks, examples in slices, and each
(block, slice) pair meets in one bounded task.  A task hands on its ``k`` best labels per example (or the block's part
of the dense score vector), never one row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faqloom.functions.text import basic_token_array, normalize_question
from faqloom.functions.vectors import sigmoid, softmax
from faqloom.operators.lookup import lookup, lookup_lists
from faqloom.operators.ordering import quantile_buckets
from faqloom.operators.parts import part_name, parts_folder, read_part, write_part
from faqloom.operators.vocab import counts_of_lists
from faqloom.session import materialize

LABELS_PER_BLOCK = 4096
ROWS_PER_SLICE = 20_000
TOP_K = 5
ACCEPT_THRESHOLD = 1 / 294
IDF_SCALE = 100


def _pair_up(rows: DataFrame, key: str, labels: DataFrame, score, schema: str) -> DataFrame:
    """Run ``score(rows, labels)`` on every (slice of rows, block of labels)."""
    spark = rows.sparkSession
    n_rows, last = rows.count(), labels.agg(F.max("label")).first()[0]
    n_blocks = (last or 0) // LABELS_PER_BLOCK + 1
    n_slices = max(n_rows // ROWS_PER_SLICE + 1, min(spark.sparkContext.defaultParallelism, n_rows // 500 + 1))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = rows.withColumn("slice", F.pmod(F.xxhash64(key), F.lit(n_slices)).cast("int")).withColumn("block", every(n_blocks))
    right = labels.withColumn("block", F.expr(f"CAST(label div {LABELS_PER_BLOCK} AS INT)")).withColumn("slice", every(n_slices))
    both = left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block"))
    return both.applyInPandas(score, schema)


def linear_scores(vectors: DataFrame, labels: DataFrame, key: str = "vec_id") -> DataFrame:
    """Dense scores: ``key``, ``logits`` (one per label, by label number).

    ``vectors``: key, x array<double>; ``labels``: label (0..n-1), weights array<double>, bias.
    """

    def score(v: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if v.empty or m.empty:
            return pd.DataFrame({key: [], "block": [], "part": []})
        m = m.sort_values("label")
        product = np.stack(v["x"]) @ np.stack(m["weights"]).T + m["bias"].to_numpy()
        return pd.DataFrame({key: v[key], "block": v["block"], "part": list(product)})

    parts = _pair_up(
        vectors.select(key, "x"), key, labels, score, f"{key} bigint, block int, part array<double>"
    )
    joined = F.sort_array(F.collect_list(F.struct("block", "part")))
    return parts.groupBy(key).agg(F.flatten(F.transform(joined, lambda p: p["part"])).alias("logits"))


def top_labels(logits: DataFrame, k: int = TOP_K, link: str | None = None, key: str = "vec_id") -> DataFrame:
    """The ``k`` best labels of each score vector: key, rank, label, score.  Ties go to the smaller label.
    ``link`` turns the kept scores into probabilities: ``sigmoid`` (independent) or ``softmax`` (over all labels)."""
    values = softmax(F.col("logits")) if link == "softmax" else F.col("logits")
    scored = F.transform(values, lambda x, i: F.struct((-x).alias("neg"), i.alias("label")))
    best = F.slice(F.array_sort(scored), 1, k)
    rows = logits.select(key, F.posexplode(best).alias("rank0", "b"))
    score = -F.col("b.neg")
    return rows.select(
        key, (F.col("rank0") + 1).alias("rank"), F.col("b.label").alias("label"),
        (sigmoid(score) if link == "sigmoid" else score).alias("score"),
    )


#: Blocks of labels whose best are merged at the first level.
BLOCKS_TOGETHER = 64


def best_labels(
    vectors: DataFrame, labels: DataFrame, k: int = TOP_K, link: str | None = None, key: str = "vec_id"
) -> DataFrame:
    """The ``k`` best labels of each vector without its score vector: key, rank, label, score.

    Every (slice of vectors, block of labels) hands on the block's ``k`` best labels of a vector and, for the softmax, the
    largest score of the block with the sum of the exponentials below it.  Both are merged in two levels, so that no task
    and no row ever holds more than ``BLOCKS_TOGETHER`` blocks' worth of a vector.  Ties go to the smaller label.
    """

    def score(v: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if v.empty or m.empty:
            return v[[key]].iloc[:0].assign(block=np.zeros(0, np.int32), best=[], top=np.zeros(0), mass=np.zeros(0))
        m = m.sort_values("label")
        numbers = m["label"].to_numpy(np.int64)
        found = []
        for at in range(0, len(v), 1024):
            part = v.iloc[at : at + 1024]
            z = np.stack(part["x"]) @ np.stack(m["weights"]).T + m["bias"].to_numpy()
            top = z.max(axis=1)
            kth = -np.partition(-z, min(k, z.shape[1]) - 1, axis=1)[:, min(k, z.shape[1]) - 1]
            row, col = np.nonzero(z >= kth[:, None])  # with all that tie with the k-th
            order = np.lexsort((col, -z[row, col], row))
            row, col = row[order], col[order]
            near = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col = row[near], col[near]
            cells = [{"neg": -x, "label": n} for x, n in zip(z[row, col].tolist(), numbers[col].tolist())]
            ends = np.searchsorted(row, np.arange(len(part) + 1))
            found.append(pd.DataFrame({
                key: part[key].to_numpy(), "block": part["block"].to_numpy(),
                "best": [cells[a:b] for a, b in zip(ends[:-1], ends[1:])], "top": top,
                "mass": np.exp(z - top[:, None]).sum(axis=1)}))
        return pd.concat(found)

    kind = vectors.schema[key].dataType.simpleString()
    best = f"array<struct<neg:double,label:{labels.schema['label'].dataType.simpleString()}>>"
    rows = _pair_up(vectors.select(key, "x"), key, labels, score, f"{key} {kind}, block int, best {best}, top double, mass double")

    def merged(rows: DataFrame, *keys: str) -> DataFrame:
        parts = rows.groupBy(*keys).agg(
            F.flatten(F.collect_list("best")).alias("best"), F.max("top").alias("top"),
            F.collect_list(F.struct("top", "mass")).alias("parts"))
        mass = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["mass"] * F.exp(p["top"] - F.col("top")))
        return parts.select(*keys, F.slice(F.array_sort("best"), 1, k).alias("best"), "top", mass.alias("mass"))

    near = merged(rows.withColumn("block", F.expr(f"CAST(block div {BLOCKS_TOGETHER} AS INT)")), key, "block")
    ranked = merged(near, key).select(key, F.posexplode("best").alias("rank0", "b"), "top", "mass")
    z = -F.col("b.neg")
    value = {"sigmoid": sigmoid(z), "softmax": F.exp(z - F.col("top")) / F.col("mass")}.get(link, z)
    return ranked.select(key, (F.col("rank0") + 1).alias("rank"), F.col("b.label").alias("label"), value.alias("score"))


def accept(ranked: DataFrame, threshold: float = ACCEPT_THRESHOLD) -> DataFrame:
    return ranked.filter(F.col("score") > threshold)


def label_lookup(ranked: DataFrame, answers: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Attach the answer (and what else is asked for) of each ranked label; popular labels cannot skew it."""
    return lookup(ranked, answers, label, columns)


def fit_label_vectors(vectors: DataFrame) -> DataFrame:
    """Nearest-centroid classifier from labelled vectors (label, x): label, dim, weight; the bias under dim -1."""
    cells = vectors.select("label", F.posexplode("x").alias("dim", "v"))
    weights = cells.groupBy("label", "dim").agg(F.avg("v").alias("weight"))
    bias = weights.groupBy("label").agg((-0.5 * F.sum(F.col("weight") * F.col("weight"))).alias("weight"))
    return weights.unionByName(bias.select("label", F.lit(-1).alias("dim"), "weight"))


def label_matrix(fitted: DataFrame) -> DataFrame:
    """Long weights to one row per label: label, weights, bias."""
    cells = F.sort_array(F.collect_list(F.when(F.col("dim") >= 0, F.struct("dim", "weight"))))
    return fitted.groupBy("label").agg(
        F.transform(cells, lambda c: c["weight"]).alias("weights"),
        F.max(F.when(F.col("dim") == -1, F.col("weight"))).alias("bias"),
    )


def answer_index(answers: DataFrame) -> DataFrame:
    """Answers (label, answer) as weighted terms: label, tokens, weights.

    Weights are whole numbers, ``tf * idf * idf`` with a scaled inverse document frequency, so that sums are exact.  Terms stay
    in the lists of their answers: counts and frequencies are worked out list by list, and no row per term is shuffled.
    """
    n_answers = answers.count()
    listed = answers.select("label", text_tokens(F.col("answer")).alias("tokens"))
    if not answers.groupBy("label").count().filter("count > 1").isEmpty():
        listed = listed.groupBy("label").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    kind = answers.schema["label"].dataType.simpleString()
    tf = listed.filter(F.size("tokens") > 0).mapInArrow(_term_counts, f"label {kind}, tokens array<string>, tf array<bigint>")
    tf = materialize(tf, "answer-terms", "zstd")
    idf = F.round(IDF_SCALE * F.ln((n_answers + 1) / (F.col("cnt") + 1))).cast("bigint").alias("idf")
    df = materialize(counts_of_lists(tf, ["label"]).select("token", idf).filter("idf > 0"), "answer-idf")
    known = df.select("token", F.struct("token", "idf").alias("term"))  # lists keep no column that they were looked up by
    met = lookup_lists(tf, "tokens", known, "token", "term", "terms")
    cells = F.zip_with("terms", "tf", lambda t, n: F.struct(t["token"].alias("token"), (n * t["idf"] * t["idf"]).alias("w")))
    kept = met.select("label", F.filter(cells, lambda c: c["w"].isNotNull()).alias("t")).filter(F.size("t") > 0)
    return kept.select("label", F.col("t.token").alias("tokens"), F.col("t.w").alias("weights"))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, tokens -> label, tokens, tf: each token of a list once, with its number."""
    for batch in batches:
        lists = batch.column("tokens")
        coded = lists.flatten().dictionary_encode()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        n = max(1, len(coded.dictionary))
        cells, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        row, code = np.divmod(cells, n)
        ends = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(code))),
             pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64)))], ["label", "tokens", "tf"])


def text_tokens(text: Column) -> Column:
    """Question and answer texts are normalised, then split to basic tokens."""
    return basic_token_array(normalize_question(text))


#: Postings, and answers, that one block may hold: what a task keeps in memory of the answers.
STEP_CELLS, BLOCK_ANSWERS = 4_000_000, 1 << 16
#: Answers come in at most so many regions, each of about so many answers at least.  A question has a bound for every region:
#: their number is a setting, so bounds grow with the questions alone.
REGIONS, REGION_ROWS = 32, 1 << 14


def answer_regions(index: DataFrame) -> tuple[DataFrame, str]:
    """The blocks of the index, one row each: region, block, part (a file), answers, cells; and the folder they are in.

    Answers of like total weight share a region, so that regions differ in what their answers can score; a region is dealt
    into blocks that a task can hold.  A block's postings are put in the order of its terms once and written to the shared
    folder, from where tasks read one block at a time: answers cross the network once and are never copied for the questions.
    """
    n = max(1, min(REGIONS, index.count() // REGION_ROWS))
    weight = F.aggregate("weights", F.lit(0).cast("bigint"), lambda a, w: a + w)
    apart = F.pmod(F.xxhash64("label"), F.lit(1 << 20)) / (1 << 20)  # answers of one total weight may fill several regions
    placed = quantile_buckets(index.withColumn("_total", weight + apart), "_total", "region", n).drop("_total")
    counts = placed.groupBy("region").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_ANSWERS), F.ceil(F.sum(F.size("tokens")) / STEP_CELLS)).cast("int").alias("blocks"))
    dealt = placed.join(F.broadcast(counts), "region")  # a row per region, REGIONS at most
    block = F.pmod(F.xxhash64("label", F.col("tokens")), F.col("blocks")).cast("int")
    folder = parts_folder(index.sparkSession, "answer-blocks")

    def write(key: tuple[pa.Scalar, ...], answers: pa.Table) -> pa.Table:
        part = part_name()
        _write_block(folder, part, answers)
        return pa.table({"region": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()),
                         "part": [part], "answers": [len(answers)],
                         "cells": [pc.sum(pc.list_value_length(answers.column("tokens"))).as_py() or 0]})

    rows = dealt.select("region", block.alias("block"), "label", "tokens", "weights").groupBy("region", "block")
    made = rows.applyInArrow(write, "region int, block int, part string, answers bigint, cells bigint")
    return materialize(made, "answer-regions"), folder


def _write_block(folder: str, part: str, answers: pa.Table) -> None:
    """Two files: the terms of a block with their largest weights; its labels in order, and its postings (row, weight) by term."""
    answers = answers.take(pc.sort_indices(answers, sort_keys=[("label", "ascending")]))
    tokens, weights = (pa.concat_arrays(answers.column(c).chunks) for c in ("tokens", "weights"))
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    coded = tokens.flatten().dictionary_encode()
    term = coded.indices.to_numpy(zero_copy_only=False)
    by_term = np.argsort(term, kind="stable")
    rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[by_term]
    weights = weights.flatten().to_numpy(zero_copy_only=False)[by_term]
    ends = np.searchsorted(term[by_term], np.arange(len(coded.dictionary) + 1))
    top = np.maximum.reduceat(weights, ends[:-1]) if len(weights) else weights
    for name, held in (("terms", {"terms": coded.dictionary, "top": top}),
                       ("cells", {"labels": answers.column("label").combine_chunks(), "ends": ends, "rows": rows, "weights": weights})):
        arrays = {c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in held.items()}
        write_part(folder, f"{part}.{name}", pa.table({c: pa.array([v], pa.large_list(v.type)) for c, v in arrays.items()}))


def _read_block(folder: str, part: str, name: str) -> list[pa.Array]:
    return [c.chunk(0).flatten() for c in read_part(folder, f"{part}.{name}").columns]


def question_routes(rows: DataFrame, regions: tuple[DataFrame, str]) -> DataFrame:
    """Questions (question_id, tokens) with ``routes``, (bound, region) falling by bound: what an answer of the region can score
    at most, for regions that share a token.  The bound of a region is the largest of its blocks."""
    placed, folder = regions
    parts = [tuple(r) for r in placed.select("region", "part").orderBy("region", "part").collect()]  # a row per block

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked in _slices(batches):
            terms = _Terms(asked.column("tokens"))
            best: dict[int, np.ndarray] = {}
            for region, part in parts:
                names, top = _read_block(folder, part, "terms")
                bound = terms.bounds(names, top.to_numpy())
                best[region] = np.maximum(best.get(region, 0), bound)
            found = np.stack([best[r] for r in sorted(best)], axis=1) if best else np.zeros((len(asked), 0), np.int64)
            order = np.argsort(-found, axis=1, kind="stable")
            sorted_ = np.take_along_axis(found, order, axis=1)
            kept = sorted_ > 0
            numbers = np.array(sorted(best), np.int32)[order] if best else order.astype(np.int32)
            cells = pa.StructArray.from_arrays([pa.array(sorted_[kept]), pa.array(numbers[kept])], ["bound", "region"])
            ends = pa.array(np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype(np.int32))
            yield from asked.append_column("routes", pa.ListArray.from_arrays(ends, cells)).to_batches()

    kind = dict(rows.dtypes)["question_id"]
    return rows.select("question_id", "tokens").mapInArrow(
        bounded, f"question_id {kind}, tokens array<string>, routes array<struct<bound:bigint,region:int>>")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of so many rows at least, and what is left."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= ROWS_PER_SLICE:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


class _Terms:
    """The distinct terms of a slice of questions: ``question``, ``code`` (into ``names``), ``times``."""

    def __init__(self, tokens: pa.ChunkedArray):
        lists = tokens.chunk(0)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        self.names, n = coded.dictionary, max(1, len(coded.dictionary))
        self.rows = len(sizes)
        cells, self.times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        self.question, self.code = np.divmod(cells, n)

    def met(self, names: pa.Array) -> np.ndarray:
        """The place of each question's terms in ``names``, -1 where it is not there."""
        places = pc.fill_null(pc.index_in(self.names, value_set=names), -1).to_numpy(zero_copy_only=False)
        return places[self.code] if len(places) else np.zeros(0, np.int32)

    def bounds(self, names: pa.Array, top: np.ndarray) -> np.ndarray:
        place = self.met(names)
        held = place >= 0
        out = np.zeros(self.rows, np.int64)
        np.add.at(out, self.question[held], self.times[held] * top[place[held]])
        return out


def _score_block(terms: _Terms, asked: np.ndarray, tau: np.ndarray, folder: str, part: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(question, scores, labels) of the answers of one block that reach the ``tau`` of an ``asked`` question.

    A sparse product with one score per answer of the block: a question adds up the postings of its terms.  Its terms of low
    impact, whose largest weights together stay below tau, cannot lift an answer by themselves: answers come from the
    postings of the other terms, and the low ones are looked up for those that can still reach tau, the weightiest first.
    """
    names, top = _read_block(folder, part, "terms")
    place = terms.met(names)
    held = (place >= 0) & asked[terms.question]
    question, term, times = terms.question[held], place[held], terms.times[held]
    impact = times * top.to_numpy()[term]
    order = np.lexsort((impact, question))
    question, term, times, impact = question[order], term[order], times[order], impact[order]
    edges = np.searchsorted(question, np.arange(terms.rows + 1))
    upto = np.concatenate([[0], np.cumsum(impact)])
    upto = upto[1:] - upto[edges[question]]  # with all of the question's terms of less impact
    high = upto >= tau[question]
    low_terms = np.concatenate([[0], np.cumsum(~high)])
    mains = edges[:-1] + low_terms[edges[1:]] - low_terms[edges[:-1]]
    open_ = np.flatnonzero(mains < edges[1:])
    if not len(open_):
        return
    labels, ends, rows, weights = (c.to_numpy() for c in _read_block(folder, part, "cells"))
    rows = rows.astype(np.int64)  # sums are added up without a cast
    begins, ends, times, uptos, term = ends[term].tolist(), ends[term + 1].tolist(), times.tolist(), upto.tolist(), term.tolist()
    score = np.zeros(len(labels), np.int64)
    common: dict[int, np.ndarray] = {}  # of terms that half of the answers hold: the weight in every answer
    for q in open_.tolist():
        start, main, end, least = int(edges[q]), int(mains[q]), int(edges[q + 1]), int(tau[q])
        for i in range(main, end):
            a, b = begins[i], ends[i]
            np.add.at(score, rows[a:b], weights[a:b] if times[i] == 1 else weights[a:b] * times[i])
        near = np.flatnonzero(score >= max(least - (uptos[main - 1] if main > start else 0), 1))
        for i in range(main - 1, start - 1, -1):
            if not len(near):
                break
            a, b = begins[i], ends[i]
            if 2 * (b - a) >= len(labels):
                if term[i] not in common:
                    common[term[i]] = np.zeros_like(score)
                    common[term[i]][rows[a:b]] = weights[a:b]  # an answer holds a term once
                score[near] += common[term[i]][near] * times[i]
            elif b - a < 8 * len(near):
                np.add.at(score, rows[a:b], weights[a:b] if times[i] == 1 else weights[a:b] * times[i])
            else:
                place = np.minimum(np.searchsorted(rows[a:b], near), b - a - 1) + a
                score[near] += np.where(rows[place] == near, weights[place] * times[i], 0)
            near = near[score[near] >= least - (uptos[i - 1] if i > start else 0)]
        if len(near):
            yield q, score[near], labels[near]
        score.fill(0)


def _score_slice(asked: pa.Table, parts: list[tuple[int, str]], folder: str, k: int) -> pa.Table:
    """question_id, label, score of the ``k`` best answers of each question in its ``regions`` that reach its ``tau``."""
    lists = asked.column("regions").chunk(0)
    region = lists.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(asked)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    terms, tau = _Terms(asked.column("tokens")), asked.column("tau").to_numpy().copy()
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for number, part in parts:
        routed = np.zeros(len(asked), bool)
        routed[owner[region == number]] = True
        if not routed.any():
            continue
        for q, score, label in _score_block(terms, routed, tau, folder, part):
            if q in found:
                score, label = np.concatenate([found[q][0], score]), np.concatenate([found[q][1], label])
            if len(score) > k:
                kept = score >= -np.partition(-score, k - 1)[k - 1]  # with all that tie with the k-th
                score, label = score[kept], label[kept]
            order = np.lexsort((label, -score))[:k]
            found[q] = score[order], label[order]
            if len(order) == k:
                tau[q] = max(tau[q], score[order[-1]])  # the blocks to come have to reach it
    sizes = [len(s) for s, _ in found.values()]
    question = pa.array(np.repeat(np.array(list(found), np.int64), sizes))
    score, label = (np.concatenate([np.zeros(0, np.int64), *[x[i] for x in found.values()]]) for i in (0, 1))
    return pa.table({"question_id": asked.column("question_id").take(question), "label": label, "score": score})


def _score_routes(routes: DataFrame, regions: tuple[DataFrame, str], k: int) -> DataFrame:
    """routes (question_id, tokens, regions, tau) -> question_id, label, score: the ``k`` best answers of each question in the
    regions it is routed to.

    Questions are dealt into slices, each once; a task reads the blocks of the regions that its slice is routed to, the weightiest
    first, one at a time, and the best answers found so far are the threshold for the blocks to come.
    """
    placed, folder = regions
    parts = [tuple(r) for r in placed.select("region", "part").orderBy(F.desc("region"), "part").collect()]  # a row per block
    n = routes.count()
    width = max(n // ROWS_PER_SLICE + 1, min(routes.sparkSession.sparkContext.defaultParallelism, n // 500 + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked in _slices(batches):
            yield from _score_slice(asked, parts, folder, k).to_batches()

    kind = dict(routes.dtypes)["question_id"]
    dealt = routes.select("question_id", "tokens", "regions", "tau").repartition(width, F.xxhash64("question_id"))
    return dealt.mapInArrow(score, f"question_id {kind}, label bigint, score bigint")


def best_ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "label")  # at most k rows per question and call
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_answers(questions: DataFrame, index: DataFrame, k: int = TOP_K, regions: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Best answers of each question (question_id, question): question_id, rank, label, score.

    The score of an answer is the sum over shared tokens of both term frequencies and the squared inverse document
    frequency; an answer that shares nothing is not ranked.

    A question is first scored where its bound is largest.  The k-th best score found there is the threshold that every
    other region's bound has to reach; the question goes to no region that falls short.  Question ids are unique.
    """
    regions = answer_regions(index) if regions is None else regions
    rows = questions.select("question_id", text_tokens(F.col("question")).alias("tokens")).filter("question_id IS NOT NULL")
    bounds = materialize(question_routes(rows, regions).filter(F.size("routes") > 0), "question-bounds", "zstd")
    least = F.lit(1).cast("bigint")
    first = F.transform(F.slice("routes", 1, 1), lambda r: r["region"])
    near = materialize(_score_routes(bounds.select("question_id", "tokens", first.alias("regions"), least.alias("tau")), regions, k), "answers-near")
    last = best_ranked(near, k).filter(F.col("rank") == k).select("question_id", F.col("score").alias("reached"))
    open_ = bounds.join(last, "question_id", "left").withColumn("tau", F.coalesce("reached", least))
    others = F.filter(F.slice("routes", 2, REGIONS), lambda r: r["bound"] >= F.col("tau"))
    open_ = open_.select("question_id", "tokens", F.transform(others, lambda r: r["region"]).alias("regions"), "tau")
    far = _score_routes(materialize(open_.filter(F.size("regions") > 0), "question-routes", "zstd"), regions, k)
    return materialize(best_ranked(near.unionByName(far), k).select("question_id", "rank", "label", "score"), "answers-ranked")


def answer_json(ranked: DataFrame, text: str = "answer") -> DataFrame:
    """Top answer of each question as a JSON object."""
    top = ranked.filter("rank = 1")
    return top.select("question_id", F.to_json(F.struct(F.col(text).alias("text"))).alias("json"))


def hit_rate(ranked: DataFrame, truth: DataFrame, key: str, label: str, ks=(1, 3, 5)) -> DataFrame:
    """How many examples have their own label among the first k: k, n, hits.  ``truth``: key, own."""
    place = truth.join(ranked, key, "left").groupBy(key).agg(F.min(F.when(F.col(label) == F.col("own"), F.col("rank"))).alias("place"))
    counts = place.select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "place")
    hit = F.coalesce(F.col("place") <= F.col("k"), F.lit(False))
    return counts.groupBy("k").agg(F.count("*").alias("n"), F.sum(hit.cast("bigint")).alias("hits"))
