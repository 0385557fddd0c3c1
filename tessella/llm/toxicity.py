"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents labelled toxic; the unlabelled set is a sample of all text, toxic or not. A linear numpy classifier is
trained with the class-prior-corrected risk  pi R+(positive) + max(0, R-(unlabelled) - pi R-(positive)); while the
second part is negative, its gradient is turned round. Features are how often, in a hundred words, a whole word
or a word's first four or five letters occur. The fit takes at most MAX_POSITIVE positive and about MAX_UNLABELLED unlabelled rows,
chosen by a hash of the id, and keeps at most MAX_FEATURES features that are more frequent among positives; scoring reads every whole
text once, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import discard, release, slices, stash, texts_of

MAX_POSITIVE = 2000
MAX_UNLABELLED = 6000
MAX_FEATURES = 1024
LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5)
STEPS = 300
RATE = 0.1
DECAY = 1e-4
SCALE = 100.0
MOST_SHARE = 5.0
LIFT = 0.4
EVIDENCE = 10.0
#: Tokens that a worker remembers at a time.
TOKENS_KEPT = 100_000


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def word_features(token: str) -> list[int]:
    """Numbers of the features of one lower-cased token between white space."""
    out = []
    for word in LETTERS.findall(token):
        out.append(zlib.crc32(f"w {word}".encode("utf-8", "surrogatepass")))
        out += [zlib.crc32(f"{n} {word[:n]}".encode("utf-8", "surrogatepass")) for n in PREFIXES if len(word) >= n]
    return out


@dataclass
class Model:
    """Weights by feature number; the score is the logistic of bias plus the mean weight of a text's tokens, times SCALE."""

    bias: float
    weights: dict[int, float]
    _known: dict[str, float] = field(default_factory=dict, repr=False)

    def score(self, text: str | None) -> float:
        """Of one whole text; null and empty texts, and texts without known words, get the bias alone."""
        tokens, known = (text or "").lower().split(), self._known
        if len(known) > TOKENS_KEPT:
            known.clear()
        fresh = [t for t in set(tokens) if t not in known]
        for token in fresh:
            known[token] = float(sum(self.weights.get(f, 0.0) for f in word_features(token)))
        total = sum(map(known.__getitem__, tokens))
        for token in fresh:
            if len(token) > 64:
                del known[token]
        return float(1 / (1 + np.exp(-np.clip(self.bias + SCALE * total / max(1, len(tokens)), -30, 30))))


def gradient(w: np.ndarray, b: float, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """Risk on positives, risk of the rest (unlabelled less positive, as negatives), and the step's gradient by weights and bias.

    Sigmoid loss: l(s) = sigmoid(-s), bounded, so that a share of toxic text off the prior moves the risk little. While the
    rest is negative, the gradient is that of the rest turned round.
    """
    now = w.astype(xp.dtype)  # one type throughout, else each step would copy the matrices
    sp, su = (1 / (1 + np.exp(-np.clip((x @ now).astype(np.float64) + b, -30, 30))) for x in (xp, xu))
    rest = float(su.mean() - prior * sp.mean())
    slope_p, slope_u = sp * (1 - sp) / len(sp) * prior, su * (1 - su) / len(su)
    gp, gu = (-2 * slope_p, slope_u) if rest >= 0 else (slope_p, -slope_u)
    return float(prior * (1 - sp).mean()), rest, np.append(gp.astype(xp.dtype) @ xp + gu.astype(xp.dtype) @ xu, gp.sum() + gu.sum())


def fit(keys: Sequence[int], x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """nnPU. keys: feature numbers of the columns of x, which holds occurrences a hundred words.

    positive and unlabelled: for each row, whether it is in that set; a row may be in both.
    """
    bias = prior_bias(prior)
    if not positive.any() or not unlabelled.any() or not len(keys):
        return Model(bias if positive.any() else -30.0, {})
    x = np.minimum(x, MOST_SHARE)
    xp, xu = x[positive], x[unlabelled]
    w, b = np.zeros(len(keys)), bias
    m, v = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    for t in range(1, STEPS + 1):
        g = gradient(w, b, xp, xu, prior)[2] + DECAY * np.append(w, b)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return Model(b, {k: c for k, c in zip(keys, w.tolist(), strict=True) if abs(c) > 1e-3})


def prior_bias(prior: float) -> float:
    return float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))


def chosen_features(counted: DataFrame, n_p: int, n_u: int, prior: float) -> list[int]:
    """At most MAX_FEATURES features of a table (feature, p, u) of the positive and unlabelled rows that have them.

    A feature is kept if its count among positives is far above what the unlabelled text lets expect (log likelihood ratio
    of Poisson counts), and its lift is a good part of 1 / prior, the most that a feature of toxic text alone can have.
    """
    expected = (F.col("u") + 1) / F.lit(n_u + 1) * n_p
    ratio = F.col("p") * F.log(F.col("p") / expected) - (F.col("p") - expected)
    good = (F.col("p") >= 3) & (F.col("p") > expected * max(1.5, LIFT / max(prior, 1e-3))) & (ratio > EVIDENCE)
    return sorted(r.feature for r in counted.where(good).orderBy(ratio.desc(), "feature").limit(MAX_FEATURES).collect())


def train(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: int = 5) -> Model:
    """Fit from documents and labels (doc_id, toxic), never from rows whose fold is 0. No positive rows: a constant model.

    Several labels of one document count as toxic if one of them is. What reaches the driver is bounded: ids of positives, the chosen features, and the
    sampled rows' shares of these. The bound on unlabelled rows makes the estimate of the risk coarser, by about one part in the root of their number.
    """
    spark = documents.sparkSession
    known = labels.where(fold(F.col("doc_id"), held_out) != 0).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    ids = [r.doc_id for r in known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_POSITIVE).collect()]
    if not ids:
        return Model(-30.0, {})
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(fold(F.col("doc_id"), held_out) != 0)
    share = min(1.0, MAX_UNLABELLED / max(1, rows.count()))
    bound = int(share * 2**31)
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in ids], "pid long"))  # at most MAX_POSITIVE ids
    sampled = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(2**31)) < bound, F.lit(False))
    picked = rows.join(chosen, F.col("doc_id") == F.col("pid"), "left").select(F.col("pid").isNotNull().alias("positive"), sampled.alias("unlabelled"), "text").where("positive or unlabelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                if len(known) > TOKENS_KEPT:
                    known.clear()
                found, shares = [], []
                for t in texts_of(part):
                    tokens = t.lower().split()
                    for token in (x for x in set(tokens) if x not in known):
                        known[token] = word_features(token)
                    f, n = np.unique(np.array([f for token in tokens for f in known[token]], dtype=np.int64), return_counts=True)
                    found.append(f)
                    shares.append((n * SCALE / len(tokens)).astype(np.float32) if tokens else n.astype(np.float32))
                yield pa.RecordBatch.from_arrays([part.column("positive"), part.column("unlabelled"), pa.array(found, pa.list_(pa.int64())), pa.array(shares, pa.list_(pa.float32()))], ["positive", "unlabelled", "features", "shares"])
        known.clear()
        release()

    # The sample is bounded, whatever the number of tasks that look for it: a few files hold it.
    sample = stash(picked.mapInArrow(run, "positive boolean, unlabelled boolean, features array<long>, shares array<float>").repartition(8), "sample")
    n_p, n_u = sample.agg(F.count_if("positive"), F.count_if("unlabelled")).first()
    prior = float(toxic) / n
    if not n_p or not n_u:
        return Model(prior_bias(prior) if n_p else -30.0, {})
    each = sample.select(F.explode("features").alias("feature"), F.col("positive").cast("int").alias("p"), F.col("unlabelled").cast("int").alias("u"))
    keys = chosen_features(each.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")), n_p, n_u, prior)
    column = np.array(keys, dtype=np.int64)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, shares = [], []
            for f, s in zip(batch.column("features"), batch.column("shares"), strict=True):
                f, s = np.asarray(f.values, dtype=np.int64), np.asarray(s.values, dtype=np.float32)
                place = np.minimum(np.searchsorted(column, f), max(len(column) - 1, 0))
                mine = column[place] == f if len(column) else np.zeros(len(f), dtype=bool)
                at.append(place[mine].astype(np.int32))
                shares.append(s[mine])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(at, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["positive", "unlabelled", "places", "shares"])

    got = sample.mapInArrow(narrow, "positive boolean, unlabelled boolean, places array<int>, shares array<float>").toArrow()
    discard(sample)
    positive, unlabelled = (np.array(got.column(c).to_pylist(), dtype=bool) for c in ("positive", "unlabelled"))
    x = np.zeros((got.num_rows, len(keys)), dtype=np.float32)
    for row, (places, shares) in enumerate(zip(got.column("places").to_pylist(), got.column("shares").to_pylist(), strict=True)):
        x[row, places] = shares
    return fit(keys, x, positive, unlabelled, prior)


def score(documents: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add the score (0 to 1) of every row's whole text; null and empty texts get the bias alone. A column of that name is replaced."""
    kept = documents.drop(name) if name != text else documents
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = [model.score(t) for t in texts_of(part, text)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], [*part.schema.names, name])
        model._known.clear()
        release()

    return kept.mapInArrow(run, schema)


def predicted(score_: Column) -> Column:
    return F.when(score_ >= 0.5, 1).otherwise(0)
