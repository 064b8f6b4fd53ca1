"""Registered queries of this subpackage and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faqloom.llm import (
    byte_pairs, decontaminate, html_text, lexical, licenses, mixing, phrases, secrets_scan, simhash, token_counts, topk,
    toxicity, warc,
)
from faqloom.session import scratch_path
from faqloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def held_out(doc_id):
    """Documents whose labels are not learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


@query("op1_toxicity")
def toxicity_scores(spark, root):
    out = toxicity.scored(
        table(spark, root, "documents"), table(spark, root, "labels"), learn=~held_out(F.col("_id")), threshold=0.7
    )
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op2_html_text")
def main_texts(spark, root):
    return html_text.extract(table(spark, root, "pages"))


@query("op3_secrets")
def secrets(spark, root):
    docs = table(spark, root, "documents")
    return secrets_scan.scan(docs, secrets_scan.fit_for(docs), threshold=0.5).drop("text_key")


@query("op4_licenses", licenses.ORACLE)
def license_notices(spark, root):
    return licenses.scan(table(spark, root, "documents"), licenses.known_texts(spark))


@query("op5_mix_sources", mixing.ORACLE)
def mix_sources(spark, root):
    return mixing.mix(table(spark, root, "documents"), weights=(3, 1, 2), share=(3, 2), most=2)


@query("op6_simhash")
def near_duplicates(spark, root):
    out = simhash.groups(table(spark, root, "documents"), shingle=3, distance=2)
    return out.select("doc_id", "fingerprint", "component_id")


@query("op7_decontaminate", decontaminate.ORACLE)
def contamination(spark, root):
    return decontaminate.report(table(spark, root, "documents"), table(spark, root, "benchmark"), size=10).drop("items")


@query("op10_token_counts")
def tokens(spark, root):
    cache = scratch_path(spark, "token-cache")  # a new cache: every distinct text is a miss
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(table(spark, root, "documents"), path, cache, limit=512)


@query("op8_warc", warc.ORACLE)
def archives(spark, root):
    return warc.round_trip(table(spark, root, "pages"), least=0)


@query("op9_top_inner_products", topk.ORACLE)
def top_inner_products(spark, root):
    return topk.top_k(table(spark, root, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


@query("op11_byte_pairs")
def byte_pair_ids(spark, root):
    ranks = byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_pairs.digests(table(spark, root, "documents"), ranks, public_tokenizers.PATTERN)


@query("op12_phrases", phrases.ORACLE)
def collocations(spark, root):
    return phrases.collocations(table(spark, root, "documents"), support=100, longest=5, top=2000, covered=100)


@query("op13_lexical_search", lexical.ORACLE)
def lexical_search(spark, root):
    return lexical.rank_documents(table(spark, root, "documents"), table(spark, root, "benchmark"), k=10)
