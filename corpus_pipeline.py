"""A training corpus from ``documents`` in five stages; each stage is written and read again before the next.

1. toxicity: documents that the classifier rejects go
2. near-duplicates: of each group of linked SimHash fingerprints the document with the smallest id stays
3. benchmark decontamination: documents that hold a word window of a benchmark item go
4. secrets: found credentials are replaced in the text, and ``n_chars`` follows
5. mixing: every document that the mix takes, with the number of its copies
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faqloom.llm import decontaminate, mixing, secrets_scan, simhash, toxicity
from faqloom.llm.queries import held_out
from faqloom.session import materialize
from faqloom.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), learn=~held_out(F.col("_id")), threshold=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs, shingle=3, distance=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), size=10, remove="documents")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets_scan.redact(docs, secrets_scan.fit_for(docs), threshold=0.5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, weights=(3, 1, 2), share=(3, 2), most=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: Classifiers and the XXH64 fingerprints have no counterpart in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
