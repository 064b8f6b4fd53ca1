"""Log-uniform negative samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faqloom.functions.draws import unit_draw


def class_probability(c: Column, range_max: int) -> Column:
    return (F.ln(c + 2.0) - F.ln(c + 1.0)) / F.ln(F.lit(range_max + 1.0))


def expected_log_probability(c: Column, range_max: int, n_sample: int) -> Column:
    """Log of the chance that a class is among ``2 * n_sample`` draws."""
    return F.ln(-F.expm1(2 * n_sample * F.log1p(-class_probability(c, range_max))))


def negative_samples(labels: DataFrame, range_max: int, n_sample: int, seed: int = 42) -> DataFrame:
    """Distinct negatives of each label (batch, label): batch, label, negative, true_log_prob, samp_log_prob, hit.

    Twice ``n_sample`` draws per batch by inverse distribution, one set for all its labels, duplicates folded in the row.
    ``hit`` marks a negative that is the label itself and is to be masked.  ``range_max`` is the size of the vocabulary.
    """
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(2 * n_sample - 1)),
        lambda j: (F.floor(F.exp(unit_draw(seed, F.col("batch"), j) * F.ln(F.lit(range_max + 1.0)))) - 1).cast("int"),
    )
    rows = labels.select("batch", "label", F.explode(F.array_distinct(draws)).alias("negative"))
    return rows.select(
        "batch", "label", "negative",
        expected_log_probability(F.col("label"), range_max, n_sample).alias("true_log_prob"),
        expected_log_probability(F.col("negative"), range_max, n_sample).alias("samp_log_prob"),
        (F.col("negative") == F.col("label")).alias("hit"),
    )
