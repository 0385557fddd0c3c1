"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams (n = 1, 2, 3) that both have, presence only, hashed to
DIMENSIONS bits and normalised: k(x, y) = |x & y| / sqrt(|x| |y|). Nystroem landmarks L give the feature
map k(x, L) W^(-1/2) with W = k(L, L); one-versus-rest kernel ridge regression is solved on it from a
sample of at most PER_LANGUAGE rows a language. Scoring multiplies a batch's presence matrix with the folded landmark matrix, which is
the same product, regrouped: k(x, L) B = x (L' diag(|l|^-1/2) B) / sqrt(|x|).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import slices, texts_of

#: n -> number of bits for its n-grams.
SPECTRUM = {1: 512, 2: 2048, 3: 8192}
DIMENSIONS = sum(SPECTRUM.values())
PER_LANGUAGE = 400
LANDMARKS = 48
RIDGE = 1e-3
LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"
BATCH_CHARS = 1 << 20


def presence(texts: list[str]) -> np.ndarray:
    """bool[texts, DIMENSIONS]: which hashed n-grams a text has, case folded to lower case."""
    lowered = [t.lower() for t in texts]
    lengths = np.array([len(t) for t in lowered], dtype=np.int64)
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    out = np.zeros((len(texts), DIMENSIONS), dtype=bool)
    flat, row = out.reshape(-1), np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    mixed, start = np.zeros(len(chars), dtype=np.uint32), 0
    for n, bits in SPECTRUM.items():
        if len(chars) < n:
            break
        head = len(chars) - n + 1
        mixed = (mixed[:head] * np.uint32(0x01000193)) ^ (chars[n - 1 :] * np.uint32(0x9E3779B1))
        same = row[:head] == row[n - 1 :]
        code = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)
        at = row[:head] * DIMENSIONS + (code >> np.uint32(32 - bits.bit_length() + 1)).astype(np.int64) + start
        flat[at[same]] = True
        start += bits
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # float32[landmarks, DIMENSIONS]
    coefficients: np.ndarray  # float32[landmarks, languages], W^(-1/2) times the ridge solution

    def folded(self) -> np.ndarray:
        norm = np.sqrt(np.maximum(self.landmarks.sum(1), 1))
        return (self.landmarks.T @ (self.coefficients / norm[:, None])).astype(np.float32)


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x.astype(np.float32), y.astype(np.float32)
    return (x @ y.T) / np.sqrt(np.maximum(x.sum(1), 1)[:, None] * np.maximum(y.sum(1), 1)[None, :])


def fit(rows: np.ndarray, labels: list[str]) -> Model:
    """rows: bool presence; labels: language of each. Landmarks are dealt out evenly over the languages, in row order."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.zeros((0, 0), np.float32))
    of = np.array([languages.index(x) for x in labels])
    each = max(1, LANDMARKS // len(languages))
    marks = rows[np.concatenate([np.flatnonzero(of == k)[:each] for k in range(len(languages))])].astype(np.float32)
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    phi = kernel(rows, marks).astype(np.float64) @ root
    target = (of[:, None] == np.arange(len(languages))[None, :]).astype(np.float64)
    weight = 1 / np.bincount(of, minlength=len(languages))[of]  # each language counts the same
    gram = phi.T @ (phi * weight[:, None])
    solved = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), phi.T @ (target * weight[:, None]))
    return Model(languages, marks, (root @ solved).astype(np.float32))


def fold(doc_id: Column, n: int = 4) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def train(documents: DataFrame, held_out: int = 2) -> Model:
    """Fit from text and non-null lang of documents outside the held-out fold; texts without a letter teach nothing.

    Rows are chosen by a hash of the id below a bound for each language, so the sample is bounded without a sort; only
    presence bits and languages reach the driver.
    """
    rows = documents.where((fold(F.col("doc_id")) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return fit(np.zeros((0, DIMENSIONS), bool), [])
    bound = F.lit(0)
    for lang, n in counts.items():
        bound = F.when(F.col("lang") == lang, F.lit(int(min(1.0, PER_LANGUAGE / n) * 2**31))).otherwise(bound)
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_CHARS):
                texts = texts_of(part)
                bits = np.packbits(presence(texts), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array([b.tobytes() if LETTER.search(t) else None for b, t in zip(bits, texts, strict=True)], pa.binary())], ["doc_id", "lang", "bits"])

    got = picked.mapInArrow(run, "doc_id long, lang string, bits binary").where("bits is not null").orderBy("doc_id").collect()
    x = np.unpackbits(np.array([np.frombuffer(r.bits, np.uint8) for r in got]).reshape(len(got), -1), axis=1)[:, :DIMENSIONS].astype(bool) if got else np.zeros((0, DIMENSIONS), bool)
    return fit(x, [r.lang for r in got])


def predict(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row. Null texts, texts without a letter and an empty model give `und` with score 0."""
    weights, names = model.folded(), np.array([*model.languages, UNDETERMINED], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, BATCH_CHARS):
                texts = texts_of(part, text)
                said, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
                for low in range(0, len(texts), 256):
                    some = [low + i for i, t in enumerate(texts[low : low + 256]) if LETTER.search(t)]
                    if some and model.languages:
                        x = presence([texts[i] for i in some]).astype(np.float32)
                        s = (x @ weights) / np.sqrt(np.maximum(x.sum(1), 1))[:, None]
                        said[some], score[some] = s.argmax(1), np.clip(s.max(1), 0, 1)
                yield pa.RecordBatch.from_arrays([part.column(doc_id), pa.array(names[said].tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
