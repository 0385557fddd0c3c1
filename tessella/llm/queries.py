"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import table, word_count


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on this machine; executors have it at the same place."""
    return importlib.import_module("public_tokenizers").path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import url_filter as op

    weights = op.train(op.labelled_urls(spark))
    return op.url_filter(table(spark, sf_dir, "pages", "page_id", "url"), weights).select("page_id", "host", "path", "rule", "verdict", "p_unwanted")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import personal_data as op

    found = op.find(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import jaccard_join as op

    return op.jaccard_join(table(spark, sf_dir, "documents", "doc_id", "text"), words=3, percent=90)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import piece_bpe as op

    return op.token_digests(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("piece_bpe_32k.model"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import language_id as op

    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = op.predict(documents, op.train(documents))
    return found.select("doc_id", (op.fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import nearest as op

    return op.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import mixing as op

    sized = op.sized_documents(table(spark, sf_dir, "documents", "doc_id", "text", "source"), word_count(F.col("text")))
    return op.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import token_files as op

    return op.token_files(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("word_bpe_49k.json"), end_id=1)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import fingerprint as op

    return op.compare_with_next(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import toxicity as op

    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    model = op.train(documents, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = op.score(documents, model)
    return scored.select("doc_id", (op.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", op.predicted(F.col("score")).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_personal_data": op2_personal_data,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_language_id": op5_language_id,
    "op6_nearest": op6_nearest,
    "op7_mixing": op7_mixing,
    "op8_token_files": op8_token_files,
    "op9_fingerprints": op9_fingerprints,
    "op10_toxicity": op10_toxicity,
}
