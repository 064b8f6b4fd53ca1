"""Ranked lexical search by branch and bound over document FP-trees.

A document is reduced to the items' terms it holds, with their numbers of occurrences, in the order of falling document
frequency.  Tasks take these vectors in blocks.  A block's vectors, sorted, share their first terms as paths of a trie;
chains without a branch are one node.  A node knows, over the documents below it, the largest number of occurrences of each
term and the smallest length measure m, which bound from above what an item can score there, since a score grows with
occurrences and falls with m.  The search goes down depth first, the best bound first, for all items that can still gain: an
item leaves a node whose bound is below its k-th best score so far.  That score goes on from block to block of a task.

Items come in slices of a bounded number of terms, each sent to all tasks and met by all documents; a task hands on k rows
per item, which are ranked in two steps.

Defined cases: null and empty texts hold no terms, neither count nor match; null item ids and repeated items are items of
their own; of equal scores the smaller doc_id comes first, a null doc_id last; repeated rows rank one by one; empty tables
give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faqloom.llm.common import ascii_lower
from faqloom.session import materialize

# Fixed value: the bytes of a term. All of a longer UTF-8 sequence are beyond 0x7F.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
#: Distinct terms of the items that one pass over the documents serves.
SLICE_TERMS = 4_096
#: A block's documents times terms.
CELLS = 1 << 23
MOST_DOCS = 8_192
#: A long text is cut into terms in steps of about so many bytes.
STEP_BYTES = 1 << 22
CHILDREN = 256
SALTS = 64
OUT = "item int, doc_id bigint, score bigint"


def terms_of(text: str) -> Iterator[list[bytes]]:
    """Lower-cased terms in order, a long text in steps."""
    raw = text.encode().translate(_TABLE)
    at = 0
    while at < len(raw):
        stop = len(raw) if len(raw) - at <= STEP_BYTES else raw.find(b" ", at + STEP_BYTES)
        stop = len(raw) if stop < 0 else stop
        yield raw[at:stop].split()
        at = stop


def restricted(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, text) -> doc_id, n, terms (places in ``terms``, ascending), tfs; documents without any term go."""
    sent = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in batches:
            ids, n, held, tfs = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                size, seen = 0, Counter()
                for words in terms_of(text.as_py()):
                    size += len(words)
                    seen.update(map(number.get, words))
                if size:
                    seen.pop(None, None)
                    order = sorted(seen)
                    ids.append(doc_id.as_py())
                    n.append(size)
                    held.append(order)
                    tfs.append([seen[t] for t in order])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(held, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


class Tree:
    """The FP-tree of some documents: rows of ``tf`` (documents and terms, terms by falling document frequency)."""

    def __init__(self, tf: np.ndarray, m: np.ndarray):
        # a path is the list of a document's terms; sorted, equal beginnings lie together
        paths = [np.flatnonzero(row).astype(">u4") for row in tf]
        order = sorted(range(len(paths)), key=lambda i: paths[i].tobytes())
        self.order, self.tf, self.m = order, tf, m
        self.children: list[list[int]] = []  # of a node: nodes as numbers from 0, documents as -1 - row
        self._most: list[np.ndarray] = []
        self._least: list[int] = []
        stack: list[tuple[int, list[int]]] = [(0, [])]  # open nodes: depth, children
        for place, row in enumerate(order):
            shared = 0
            if place:
                a, b = paths[order[place - 1]], paths[row]
                size = min(len(a), len(b))
                differ = np.flatnonzero(a[:size] != b[:size])
                shared = int(differ[0]) if len(differ) else size
            last = None
            while stack[-1][0] > shared:
                depth, below = stack.pop()
                node = self._close(below)
                if stack[-1][0] < shared:
                    last = node
                    break
                stack[-1][1].append(node)
            if stack[-1][0] < shared:  # a branch inside what was one chain: the last child goes below the new node
                if last is None:
                    last = stack[-1][1].pop()
                stack.append((shared, [last]))
            elif last is not None:
                stack[-1][1].append(last)
            stack[-1][1].append(-1 - row)
        while len(stack) > 1:
            node = self._close(stack.pop()[1])
            stack[-1][1].append(node)
        self.root = self._close(stack[0][1])
        self.most = np.stack(self._most) if self._most else np.zeros((0, tf.shape[1]), tf.dtype)
        self.least = np.array(self._least, np.int64)

    def _close(self, below: list[int]) -> int:
        rows = [-1 - c for c in below if c < 0]
        nodes = [c for c in below if c >= 0]
        most = np.zeros(self.tf.shape[1], self.tf.dtype)
        least = []
        if rows:
            most = self.tf[rows].max(axis=0)
            least.append(int(self.m[rows].min()))
        for c in nodes:
            most = np.maximum(most, self._most[c])
            least.append(self._least[c])
        self.children.append(below)
        self._most.append(most)
        self._least.append(min(least, default=0))
        return len(self.children) - 1

    def below(self, node: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A node's children with the tf maxima and m minima below each."""
        children = np.array(self.children[node], np.int64)
        rows = children < 0
        most = np.empty((len(children), self.tf.shape[1]), self.tf.dtype)
        least = np.empty(len(children), np.int64)
        most[rows], least[rows] = self.tf[-1 - children[rows]], self.m[-1 - children[rows]]
        most[~rows], least[~rows] = self.most[children[~rows]], self.least[children[~rows]]
        return children, most, least


class Items:
    """Items as lists of terms with weight times repeats."""

    def __init__(self, terms: list[np.ndarray], repeats: list[np.ndarray], weights: np.ndarray):
        self.terms, self.count = terms, len(terms)
        self.factors = [weights[t] * r for t, r in zip(terms, repeats)]

    def scores(self, active: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The score of each active item for each row of occurrences and m: documents' own, or a bound of those below."""
        columns = np.concatenate([self.terms[i] for i in active])
        factors = np.concatenate([self.factors[i] for i in active])
        starts = np.cumsum([0, *(len(self.terms[i]) for i in active[:-1])])
        used, place = np.unique(columns, return_inverse=True)
        tf = most[:, used].astype(np.int64)
        part = (1_000_000_000 * tf) // np.maximum(1_000 * tf + 8 * least[:, None], 1)
        return np.add.reduceat(part[:, place] * factors, starts, axis=1)


class Found:
    """The k best documents of each item: score down, doc_id up, null last."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps, self.tau = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def add(self, item: int, score: int, doc_id: int | None) -> None:
        heap = self.heaps[item]
        row = (score, doc_id is not None, 0 if doc_id is None else -doc_id)
        if len(heap) < self.k:
            heapq.heappush(heap, row)
        elif row > heap[0]:
            heapq.heapreplace(heap, row)
        if len(heap) == self.k:
            self.tau[item] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for item, heap in enumerate(self.heaps):
            for score, known, minus in heap:
                yield item, -minus if known else None, score


def search(tree: Tree, ids: list[int | None], items: Items, found: Found) -> int:
    """Adds the tree's best documents to ``found``; the number of nodes and documents whose bounds were worked out."""
    looked = 0
    stack = [(tree.root, np.arange(items.count), None)] if items.count else []
    while stack:
        node, active, bound = stack.pop()
        if bound is not None:
            active = active[bound >= found.tau[active]]  # it has risen since
            if not len(active):
                continue
        children, most, least = tree.below(node)
        nexts = []
        for at in range(0, len(children), CHILDREN):
            part = slice(at, at + CHILDREN)
            scores = items.scores(active, most[part], least[part])
            looked += len(scores)
            may = scores >= found.tau[active][None, :]
            for i in np.flatnonzero(may.any(axis=1)).tolist():
                child, own = int(children[at + i]), np.flatnonzero(may[i])
                if child < 0:
                    for a in own.tolist():
                        if scores[i, a] >= found.tau[active[a]]:
                            found.add(int(active[a]), int(scores[i, a]), ids[-1 - child])
                else:
                    nexts.append((scores[i].max(), child, active[own], scores[i, own]))
        nexts.sort(key=lambda x: x[0])  # the best bound is taken from the stack first
        stack += [(child, own, bounds) for _, child, own, bounds in nexts]
    return looked


def best_documents(vectors: DataFrame, items: Items, total: int, documents: int, rank: np.ndarray, k: int) -> DataFrame:
    """(doc_id, n, terms, tfs) -> the k best documents of each item within each task: part, item, doc_id, score."""
    context = vectors.sparkSession.sparkContext
    width = len(rank)
    size = max(16, min(MOST_DOCS, CELLS // max(width, 1)))
    sent = context.broadcast((items, rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, rank = sent.value
        found = Found(items.count, k)
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                sizes = part.column("terms").value_lengths().to_numpy(zero_copy_only=False)
                rows = np.repeat(np.arange(part.num_rows), sizes)
                times = part.column("tfs").flatten().to_numpy()
                tf = np.zeros((part.num_rows, width), np.int32 if times.max(initial=0) < 2**31 else np.int64)
                tf[rows, rank[part.column("terms").flatten().to_numpy()]] = times
                n = part.column("n").to_pylist()
                m = np.array([25 + 75 * x * documents // total for x in n], np.int64)
                search(Tree(tf, m), part.column("doc_id").to_pylist(), items, found)
        rows = list(found.rows())
        task = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays(
            [pa.array([task] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()),
             pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
            ["part", "item", "doc_id", "score"])

    return vectors.mapInArrow(run, f"part int, {OUT}")


def ranked(rows: DataFrame, group: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Per item its k best documents: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"),
                         F.regexp_extract_all(ascii_lower(F.coalesce(F.col(item_text).cast("string"), F.lit(""))), F.lit(TERM), 0).alias("words"))
    asked = materialize(asked.filter(F.size("words") > 0), "lexical-items")
    id_type = dict(asked.dtypes)["item_id"]
    result = f"item_id {id_type}, rank int, doc_id bigint, score bigint"
    words = asked.agg(F.sum(F.size(F.array_distinct("words")))).first()[0]
    if not words:
        return spark.createDataFrame([], result)
    whole = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # every item goes to one slice; a slice's terms are a bounded number but for a single item with more
    slices = math.ceil(words / SLICE_TERMS)
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("item_id", "words"), F.lit(slices)))
    out = None
    for number in range(slices):
        mine = asked.filter(F.col("slice") == number).collect()
        if not mine:
            continue
        terms = sorted({w for row in mine for w in row["words"]})
        vectors = materialize(restricted(whole, terms), "lexical-vectors")
        documents, total = vectors.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            return spark.createDataFrame([], result)
        df = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row per term
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(terms))], np.int64)
        # frequency order: the commonest term first
        falling = sorted(range(len(terms)), key=lambda t: (-df.get(t, 0), t))
        rank = np.empty(len(terms), np.int64)
        rank[falling] = np.arange(len(terms))
        place = {w: int(rank[t]) for t, w in enumerate(terms)}
        by_item = [Counter(place[w] for w in row["words"]) for row in mine]
        query = Items([np.array(list(c), np.int64) for c in by_item], [np.array(list(c.values()), np.int64) for c in by_item],
                      weights[falling])
        near = best_documents(vectors, query, total, documents, rank, k)
        best = ranked(ranked(near, ["part", "item"], k).drop("rank"), ["item"], k)
        names = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(mine)], f"item int, item_id {id_type}")
        named = materialize(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "lexical-best")
        out = named if out is None else out.unionByName(named)
    return out


ORACLE = f"""
WITH t AS (
  SELECT doc_id, d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
  FROM (SELECT *, row_number() OVER () AS d FROM documents)),
q AS (
  SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
  FROM (SELECT *, row_number() OVER () AS i FROM benchmark)),
tf AS (SELECT d, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT d, sum(tf)::BIGINT AS n FROM tf GROUP BY d),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, s),
m AS (SELECT d, 100 - 75 + ((75 * n * docs) // total) AS m FROM n, s),
score AS (
  SELECT i, item_id, doc_id, d, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (d) GROUP BY ALL),
r AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
