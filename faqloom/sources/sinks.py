"""Sinks: CSV, cached feature tables, run metrics, corpus tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """Plain CSV without header and index; quotes are doubled, blanks are kept."""
    df.write.csv(path, header=False, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", quote="", escape="", header=False, ignoreLeadingWhiteSpace=False,
                 ignoreTrailingWhiteSpace=False)


def write_lines(df: DataFrame, path: str, column: str, order: list[str]) -> None:
    """Text lines in table order: files by name, lines inside them."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(column).write.text(path)


def cached_table(spark: SparkSession, root: str, params: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """Compute a table once per parameter set; later calls read it.  ``params`` must name the input as well.

    Only a table whose job committed, as its ``_SUCCESS`` mark says, is read; a missing or unfinished one is written again.
    Any other failure to read is the caller's to see.
    """
    name = hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()[:16]
    path = f"{root}/features-{name}"
    if not _committed(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _committed(spark: SparkSession, path: str) -> bool:
    """Whether the folder holds the ``_SUCCESS`` mark of a committed job (readers skip names that begin with ``_``)."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def append_metrics(metrics: DataFrame, path: str, run_id: str) -> None:
    """Add the metrics of one run to the log of all runs."""
    metrics.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def write_corpus(vocab: DataFrame, encoded: DataFrame, path: str) -> None:
    """Vocabulary and encoded lines as two tables, the lines by split."""
    vocab.write.parquet(f"{path}/vocab")
    encoded.write.partitionBy("split").parquet(f"{path}/encoded")


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/encoded")
