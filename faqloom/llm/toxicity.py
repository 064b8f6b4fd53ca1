"""Toxicity by a counterfactually regularised classifier.

A text's features are the words it holds, their beginnings and their ends: presence only, so a text's length does not
count.  Features are chosen and weighted on a bounded sample of labelled texts; those of the identity terms are always
among them, whatever their evidence.  For each sentence of the sampled texts a counterfactual is made by swapping the
identity terms in it for others of the same group; a sentence that mentions no one gets a mention at its end, before it is
swapped.  Training minimises the class-balanced log loss, a ridge penalty, and ``swap_penalty`` times the mean squared
change of the score between a sentence and its counterfactual, so that a group's name weighs as much as any other's and a
neutral mention does not raise a score.  Sentences that change alike are counted together.  The label, language, source and
id of a document are no features.

Defined cases: null and empty texts have no features and get the score of the bias alone; null labels and ids are not
learned from; an id with several labels counts as toxic if one says so; texts that repeat in the sample count once, as
toxic if one copy is; without labelled texts of both classes every score is 0; other columns are ignored, and kept by
:func:`keep_clean`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faqloom.session import materialize

#: Identity terms by group; a term is swapped for another of its group.  A parameter, not a finished list.
IDENTITY_TERMS = (
    ("woman", "man", "girl", "boy", "frau", "mann", "femme", "homme", "mujer", "hombre"),
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "muslimisch", "christlich", "jüdisch",
     "musulman", "chrétien", "juif", "musulmán", "cristiano", "judío"),
    ("black", "white", "asian", "african", "european", "latino", "schwarz", "weiß", "noir", "blanc", "negro", "blanco"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "schwul", "lesbisch", "homosexuel", "homosexual"),
    ("old", "young", "disabled", "blind", "deaf", "alt", "jung", "vieux", "jeune", "viejo", "joven"),
    ("german", "french", "spanish", "turkish", "polish", "deutsch", "français", "alemán", "francés", "español"),
)
WORDS = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.!?\n\u3002]+")
#: Labelled texts of each class in the sample, the features kept, and how many sampled texts a feature must be in.
FIT_ROWS, FEATURES, LEAST = 6_000, 8_000, 3
#: A feature is chosen if its share among toxic texts exceeds that among others by so many standard errors.
EVIDENCE = 3.0
RIDGE, SWAP_PENALTY, STEPS = 5e-5, 1.0, 300
CACHE = 200_000


def word_features(word: str) -> list[str]:
    """A word, its beginnings and its ends; what is no word of letters and digits has none."""
    out = [f"={word}"]
    n = len(word)
    out += [f"^{word[:i]}" for i in (4, 5, 6) if i < n]
    out += [f"{word[-i:]}$" for i in (4, 5) if i < n]
    return out


def words_in(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


def features_of(words: set[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


def swapped(words: set[str], terms=IDENTITY_TERMS) -> tuple[set[str], set[str]]:
    """A text's words, with a mention added if it mentions no one, and the same with every mention swapped."""
    place = {t: (g, i) for g, group in enumerate(terms) for i, t in enumerate(group)}
    mentions = sorted(w for w in words if w in place)
    at = sum(map(len, words)) if words else 0  # any number that the text alone decides
    if not mentions and terms:
        group = terms[at % len(terms)]
        mentions = [group[at // len(terms) % len(group)]]
        words = words | set(mentions)
    others = {}
    for m in mentions:
        g, i = place[m]
        others[m] = terms[g][(i + 1 + at % (len(terms[g]) - 1)) % len(terms[g])] if len(terms[g]) > 1 else m
    return words, {others.get(w, w) for w in words}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """(text, y): at most ``rows`` labelled texts of each class, those of the smallest digests of their ids."""
    marked = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
    marked = marked.filter(F.col("_id").isNotNull() & F.col("_y").isNotNull())
    marked = marked.groupBy("_id").agg(F.max("_y").alias("_y"))
    marked = marked.filter(learn).withColumn("_order", F.md5(F.col("_id").cast("string")))
    chosen = [marked.filter(F.col("_y") == y).orderBy("_order", "_id").limit(rows) for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1]).select("_id", "_y")  # 2 * rows at most
    met = docs.select(F.col("doc_id").alias("_doc"), "text").join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    met = met.filter(F.col("text").isNotNull())
    return met.groupBy(F.md5("text").alias("digest")).agg(F.first("text").alias("text"), F.max("_y").alias("y"))


def _feature_counts(sample: DataFrame) -> DataFrame:
    """feature -> toxic, clean: the sampled texts of either class that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(counts):
            keys = list(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()),
                 pa.array([counts[k] for k in keys], pa.int64())], ["feature", "y", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                counts.update((f, y) for f in features_of(words_in(text)))
                if len(counts) > 500_000:
                    yield packed(counts)
                    counts = Counter()
        if counts:
            yield packed(counts)

    rows = sample.select("text", "y").mapInArrow(run, "feature string, y int, n bigint")
    side = [F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(n) for y, n in ((1, "toxic"), (0, "clean"))]
    return rows.groupBy("feature").agg(*side)


def _sparse(sample: DataFrame, index: dict[str, int]) -> tuple:
    """Labels, and the features of the sampled texts as (text, feature) number pairs.  It comes as Arrow columns: a few bytes
    per pair."""
    sent = sample.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            cells = [sorted({known[f] for f in features_of(words_in(text)) if f in known}) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(cells, pa.list_(pa.int32()))], ["y", "x"])

    table = sample.select("text", "y").mapInArrow(run, "y int, x array<int>").toArrow()
    return table.column("y").to_numpy(), _pairs(table.column("x").combine_chunks())


def changes_of(text: str, index: dict[str, int], terms, cached: dict[str, tuple[str, ...]]) -> Iterator[tuple[tuple, tuple]]:
    """Per sentence: the known features that only it has, and those that only its counterfactual has."""

    def known(words: set[str]) -> set[int]:
        out: set[int] = set()
        for w in words:
            if w not in cached:
                if len(cached) >= CACHE:
                    cached.clear()
                cached[w] = tuple(index[f] for f in word_features(w) if f in index)
            out.update(cached[w])
        return out

    for sentence in SENTENCE_END.split(text):
        if words := words_in(sentence):
            own, other = map(known, swapped(words, terms))
            yield tuple(sorted(own - other)), tuple(sorted(other - own))


def _swaps(sample: DataFrame, index: dict[str, int], terms) -> tuple:
    """What swaps change in the sampled sentences: their numbers, and as (kind, feature) pairs what goes and what comes."""
    sent = sample.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        cached: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(changes_of(text, sent.value, terms, cached))
        kinds = list(counts)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array([k[i] for k in kinds], pa.list_(pa.int32())) for i in (0, 1)], pa.array(list(counts.values()), pa.int64())],
            ["a", "b", "n"])

    rows = sample.select("text").mapInArrow(run, "a array<int>, b array<int>, n bigint")
    table = rows.groupBy("a", "b").agg(F.sum("n").alias("n")).orderBy("a", "b").toArrow()
    return table.column("n").to_numpy(), *(_pairs(table.column(c).combine_chunks()) for c in ("a", "b"))


def _pairs(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()


def swap_gap(w: np.ndarray, often, a, b) -> float:
    """The mean squared change of the score when a sentence's identity terms are swapped."""
    change = np.bincount(a[0], w[a[1]], len(often)) - np.bincount(b[0], w[b[1]], len(often))
    return float(np.sum(often * change**2) / max(1, np.sum(often)))


def fit_weights(y, x, often, a, b, width: int, ridge=RIDGE, swap_penalty=SWAP_PENALTY, steps=STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias for presence features: Adam on the whole sample.  ``x``: (text, feature) pairs; ``often``, ``a`` and
    ``b``: kinds of swaps with what goes and what comes."""
    y = np.asarray(y, float)
    n, kinds = len(y), len(often)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    share = np.asarray(often, float) / max(1, np.sum(often))
    (xr, xc), (ar, ac), (br, bc) = x, a, b
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(xr, w[xc], n) + w[-1], -60, 60)))
        change = np.bincount(ar, w[ac], kinds) - np.bincount(br, w[bc], kinds)
        miss = weight * (p - y)
        g = np.bincount(xc, miss[xr], width + 1) + 2 * ridge * np.append(w[:-1], 0)
        drift = 2 * swap_penalty * change * share
        g += np.bincount(ac, drift[ar], width + 1) - np.bincount(bc, drift[br], width + 1)
        g[-1] = miss.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "toxic", rows: int = FIT_ROWS,
    terms=IDENTITY_TERMS, swap_penalty: float = SWAP_PENALTY,
) -> tuple[dict[str, float], float] | None:
    """Weights by feature, and the bias, learned from at most ``rows`` texts of each class; None without both classes.

    ``learn`` says which labels may be learned from, by the column ``_id``."""
    sample = materialize(labelled_sample(docs, labels, label, F.lit(True) if learn is None else learn, rows), "toxic-sample")
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return None
    one, none = F.lit(float(sizes[1])), F.lit(float(sizes[0]))
    share, rest = F.col("toxic") / one, F.col("clean") / none
    both = (F.col("toxic") + F.col("clean")) / (one + none)
    z = (share - rest) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-12)) * (1 / one + 1 / none))
    counts = _feature_counts(sample).withColumn("z", z).filter((F.col("toxic") + F.col("clean") >= LEAST) & (F.col("z") >= EVIDENCE))
    chosen = [r["feature"] for r in counts.orderBy(F.desc("z"), "feature").limit(FEATURES).collect()]
    chosen += sorted({f for group in terms for t in group for f in word_features(t)} - set(chosen))
    index = {f: i for i, f in enumerate(chosen)}
    weights, bias = fit_weights(*_sparse(sample, index), *_swaps(sample, index, terms), len(chosen), swap_penalty=swap_penalty)
    return dict(zip(chosen, weights.tolist())), bias


def score_column(docs: DataFrame, model: tuple[dict[str, float], float] | None, text: str = "text") -> Column:
    """The score of a text: 0 to 1."""
    if model is None:
        return F.lit(0.0)
    names = list(model[0])
    sent = docs.sparkSession.sparkContext.broadcast(
        ({f: i for i, f in enumerate(names)}, [model[0][f] for f in names], model[1])
    )

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index, weights, bias = sent.value
        seen: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                held: set[int] = set()
                for w in words_in(text):
                    found = seen.get(w)
                    if found is None:
                        if len(seen) >= CACHE:
                            seen.clear()
                        found = seen[w] = tuple(index[f] for f in word_features(w) if f in index)
                    if found:
                        held.update(found)
                out.append(bias + sum(weights[i] for i in sorted(held)))
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(out, float), -60, 60))))

    return score(F.col(text))


def scored(docs: DataFrame, labels: DataFrame, learn: Column | None = None, threshold: float = 0.7, **options) -> DataFrame:
    """Per document: doc_id, score, predicted."""
    model = fit(docs, labels, learn, **options)
    out = docs.select("doc_id", score_column(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, learn: Column | None = None, threshold: float = 0.7, **options) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    model = fit(docs, labels, learn, **options)
    packed = docs.select(F.struct(*docs.columns).alias("_row"), score_column(docs, model).alias("_score"))
    return packed.filter(F.col("_score") < threshold).select("_row.*")
