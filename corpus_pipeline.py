"""A training corpus from `documents`: five operators of tessella.llm, one after the other.

Each stage takes what its predecessor kept, as read back from Parquet. ORACLE_SQL is None: classifier, join and tokenizer
cannot be said in SQL; tests/llm/test_pipeline.py holds every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import jaccard_join, mixing, personal_data, piece_bpe, toxicity
from tessella.llm.common import sized_broadcast, stash, table, word_count
from tessella.llm.queries import vocabulary

#: Near-duplicates: five words and a similarity of 0.8.
WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model, name="_toxic").where(toxicity.predicted(F.col("_toxic")) == 0).drop("_toxic")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the row with the smallest id, null ids last; of rows that repeat it one. Texts without words stay."""
    rows = stash(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.monotonically_increasing_id().alias("row")), "rows")
    found = jaccard_join.jaccard_join(rows.select("row", "whole.text"), WORDS, PERCENT, doc_id="row")
    linked = stash(found.where("n_links > 0").select(F.col("doc_id").alias("row"), "component_id"), "linked")
    n = linked.count()
    named = rows.select("row", "whole.doc_id").join(sized_broadcast(linked, n), "row")
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("best")).select("component_id", F.col("best.row").alias("kept"))
    dropped = stash(linked.join(sized_broadcast(best, n), "component_id").where("row <> kept").select("row"), "dropped")
    return rows.join(sized_broadcast(dropped, n), "row", "left_anti").select("whole.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows."""
    clean = personal_data.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixing.mixed_documents(docs, word_count(F.col("text")))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens and whether decoding gives the text back."""
    return piece_bpe.token_ids(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
