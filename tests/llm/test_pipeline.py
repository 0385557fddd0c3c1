"""The pipeline's stages, each against a plain version of itself."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline as P
from tessella.llm import mixing, toxicity
from tests.llm.test_llm_operators import brute_components


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "jaccard_join", "personal_data", "mixing", "sentencepiece"]
    clean = P.drop_toxic(spark, docs, sf_dir).cache()
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect() if model.score(r.text) < 0.5}
    one = P.drop_near_copies(spark, clean, sf_dir).cache()
    found = brute_components({r.doc_id: r.text for r in clean.collect()}, 5, 80)
    assert {r.doc_id for r in one.collect()} == {i for i, (_, c) in found.items() if i == c}
    hidden = P.redact_personal_data(spark, one, sf_dir).cache()
    assert hidden.columns == docs.columns and hidden.count() == one.count()
    assert hidden.where(F.col("text").contains("@mail")).count() == 0 and hidden.where("n_chars <> length(text)").count() == 0
    mixed = P.mix_sources(spark, hidden, sf_dir).cache()
    assert mixed.columns == docs.columns
    plan = {r.doc_id: (r.size, r.taken) for r in mixing.mix(mixing.sized_documents(hidden, F.size(F.split(F.trim("text"), r"\s+")).cast("long"))).collect()}
    taken = collections.Counter(r.doc_id for r in mixed.collect())
    assert all(taken[i] * size == t for i, (size, t) in plan.items())
    out = P.encode_pieces(spark, mixed, sf_dir)
    assert out.count() == mixed.count() and out.where("not round_trip").count() == 0


def test_one_row_of_each_group_stays(spark, sf_dir):
    base = [f"w{i}" for i in range(100)]
    near = " ".join([*base[:50], "changed", *base[51:]])
    rows = [(None, " ".join(base)), (3, near), (3, near), (None, near), (4, "another text"), (4, "yet another text of this id"), (None, None), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row int")
    kept = P.drop_near_copies(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or -1, r.text) for r in kept.collect()), key=str) == sorted([(3, near), (4, "another text"), (4, "yet another text of this id"), (-1, None), (-1, None), (8, "")], key=str)


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
