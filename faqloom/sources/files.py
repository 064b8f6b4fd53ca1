"""Text, CSV and JSON sources with the reading rules of the pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faqloom.operators.features import label_list
from faqloom.operators.ordering import running_total
from faqloom.operators.vocab import bpe_merges

FAQ_SCHEMA = "map<string, struct<question: string, answer: string>>"
#: Fixed value: the name of augmentation logs ahead of their number.
LOG_NAME = "output_success"
LABELLED_SCHEMA = "guid bigint, class string, question string"


def _scan(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines with the file split they came from and their order in the scan."""
    return spark.read.text(paths, lineSep="\n").select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"),
    )


def _number(rows: DataFrame, name: str, by_file: bool) -> DataFrame:
    """Number lines by (split, place in the split): a split is bounded, so a file of any size is numbered in parallel."""
    group, bucket = (["file"], ["_start"]) if by_file else ([], ["file", "_start"])
    return running_total(rows, F.lit(1), ["_seq"], bucket, name, group=group, few_buckets=False).drop("_start", "_seq")


def file_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of many files with their line number in the file: file, line_no, line."""
    return _number(_scan(spark, paths), "line_no", True).select("file", "line_no", "line")


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of all files in one numbering, files by name: line_no, line."""
    return _number(_scan(spark, paths), "line_no", False).select("line_no", "line")


def log_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Augmentation logs, numbered by their names (``output_success_7.txt``, ``output_success=7/...``): file, line_no, line."""
    number = F.regexp_extract("file", rf"{LOG_NAME}[_=](\d+)", 1).cast("bigint")
    return file_lines(spark, paths).select(number.alias("file"), "line_no", "line")


def answer_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One answer per line that is not blank; the position is the label: label_id, answer."""
    rows = _scan(spark, paths).filter(F.col("line").rlike(r"\S"))
    return _number(rows, "label_id", False).select("label_id", F.col("line").alias("answer"))


def faq_json(spark: SparkSession, path: str) -> DataFrame:
    """First line of each file is an object id -> {question, answer}: faq_id, question, answer.

    Lines behind the first are not read as data.
    """
    first = file_lines(spark, path).filter("line_no = 0")
    return first.select(F.explode(F.from_json("line", FAQ_SCHEMA)).alias("faq_id", "v")).select(
        "faq_id", "v.question", "v.answer")


def labelled_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Index, class list literal and question by position: guid, labels, question."""
    raw = spark.read.csv(path, schema=LABELLED_SCHEMA, header=header, escape='"', multiLine=True)
    return raw.select("guid", label_list(F.col("class")).alias("labels"), "question", "class")


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headerless tab-separated files."""
    return spark.read.csv(path, schema=schema, sep="\t", quote="", escape="")


def json_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary as one JSON object: token, id."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "id"))


def merge_file(spark: SparkSession, path: str) -> DataFrame:
    return bpe_merges(numbered_lines(spark, path))

