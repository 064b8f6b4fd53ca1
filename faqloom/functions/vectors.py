"""Score-vector expressions over ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def log_sum_exp(v: Column) -> Column:
    top = F.array_max(v)
    return top + F.ln(total(F.transform(v, lambda x: F.exp(x - top))))


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    exps = F.transform(v, lambda x: F.exp(x - top))
    mass = total(exps)
    return F.transform(exps, lambda x: x / mass)


def argmax(v: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def bce(logit: Column, y: Column) -> Column:
    """Binary cross-entropy of one logit, in the form that cannot overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit)))


def nll(logits: Column, label: Column) -> Column:
    return log_sum_exp(logits) - F.get(logits, label)


def banded_nll(logits: Column, label: Column, borders: list[int], clusters: Column) -> Column:
    """Negative log-likelihood with a normaliser in two steps: a head of the labels ahead of the first border and one cluster
    score per band behind it, then the labels of the label's own band.

    ``borders`` are the first labels of the bands, then the number of labels; ``clusters`` holds a score per band.
    """
    head = F.concat(F.slice(logits, 1, borders[0]), clusters)
    norm = log_sum_exp(head)
    loss = norm - F.get(logits, label)
    for band, (start, stop) in enumerate(zip(borders, borders[1:])):
        own = log_sum_exp(F.slice(logits, start + 1, stop - start)) - F.get(logits, label)
        loss = F.when((label >= start) & (label < stop), norm - F.get(clusters, F.lit(band)) + own).otherwise(loss)
    return loss
