"""Document fingerprints: canonical exact digests.

A text is made canonical (Unicode normal form C, case folded, runs of white space as one space, none at the
ends) and hashed to 128 bits with xxhash. Inside buckets of equal hashes the canonical bytes themselves are compared; should two
different texts share a hash, all but the first in byte order get a number behind their digest. Likeness of
two exact fingerprints is 1 or 0.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import discard, ordered_buckets, sized_broadcast, slices, stash, texts_of


def canonical(text: str) -> str:
    """NFC, case folded, NFC again, white space folded. Null is to be passed as an empty text."""
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFC", text).casefold()
    return " ".join((folded if unicodedata.is_normalized("NFC", folded) else unicodedata.normalize("NFC", folded)).split())


def canonical_bytes(text: str) -> bytes:
    return canonical(text).encode("utf-8", "surrogatepass")


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def digests(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and digest of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(canonical_bytes(t)) for part in slices(batch, text) for t in texts_of(part, text)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.string())], [key, "digest"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, digest string")


def collisions(documents: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """digest, canon, number: of the different canonical texts of each digest that several have, all but the first in byte order, numbered from 1.

    Only buckets of two rows or more are opened. The comparison is a grouping by the canonical bytes, which first takes
    place within each task, so that copies of one text are one row before the shuffle. The result is empty
    unless 128 bits collide.
    """
    shared = stash(found.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "digests")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                canon = [canonical_bytes(t) for t in texts_of(part, text)]
                yield pa.RecordBatch.from_pydict({"digest": [digest(c) for c in canon], "canon": canon}, schema=pa.schema([("digest", pa.string()), ("canon", pa.binary())]))

    canon = documents.select(text).mapInArrow(run, "digest string, canon binary")
    opened = canon.join(sized_broadcast(shared, shared.count()), "digest", "left_semi").groupBy("digest", "canon").agg(F.lit(1).alias("one"))
    several = opened.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    out = opened.join(several, "digest", "left_semi")
    numbered = stash(out.select("digest", "canon", (F.row_number().over(Window.partitionBy("digest").orderBy("canon")) - 1).alias("number")).where("number > 0"), "collisions")
    discard(shared)
    return numbered


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint of every row: equal exactly where the canonical texts are equal.

    Null text is an empty text; null keys and repeated rows keep their rows; extra columns play no part; an empty table
    gives no rows.
    """
    found = digests(documents, key, text)
    numbers = collisions(documents, found, text)
    if numbers.isEmpty():
        return found.select(key, F.col("digest").alias("fingerprint"))
    return _numbered(documents, numbers, key, text)


def _marked(rows: DataFrame, numbers: DataFrame, name: str, canon: str) -> DataFrame:
    """The rows with the number of their text behind the digest in column name, where it has one; canon is dropped."""
    n = numbers.select(F.col("digest").alias("_digest"), F.col("canon").alias("_canon"), "number")
    joined = rows.join(n, (F.col(name) == F.col("_digest")) & (F.col(canon) == F.col("_canon")), "left")
    mark: Column = F.concat_ws("-", name, F.col("number").cast("string"))
    return joined.withColumn(name, mark).drop("_digest", "_canon", "number", canon)


def _numbered(documents: DataFrame, numbers: DataFrame, key: str, text: str) -> DataFrame:
    """Fingerprints where some digests have several texts: told apart by a join on digest and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            canon = [canonical_bytes(t) for part in slices(batch, text) for t in texts_of(part, text)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([digest(c) for c in canon], pa.string()), pa.array(canon, pa.binary())], [key, "fingerprint", "_text"])

    kind = documents.schema[key].dataType.simpleString()
    return _marked(documents.select(key, text).mapInArrow(run, f"{key} {kind}, fingerprint string, _text binary"), numbers, "fingerprint", "_text")


def likeness(a: bytes, b: bytes) -> float:
    """Of two exact fingerprints, by the canonical bytes: 1 if they are equal, else 0."""
    return 1.0 if a == b else 0.0


RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
RESULT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
BYTES = [pa.field("_text", pa.binary()), pa.field("_edited", pa.binary())]


def compare_with_next(documents: DataFrame) -> DataFrame:
    """Fingerprint of every document, of its edited text, and their likeness to each other and to the next document.

    The next document is the one with the next larger doc_id, after the last the first; rows of one doc_id follow each
    other by text, null ids come last, by hash and text. One shuffle deals the texts to ascending ranges; the first document of each range
    is dealt to the range before it as well, so each task meets every pair of neighbours it needs. Should digests collide, texts
    of the table that share one are told apart by a join on their bytes.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    numbers = collisions(rows, digests(rows))
    several = not numbers.isEmpty()
    dealt, n, heads = ordered_buckets(rows, "doc_id", "text")
    if len(heads) > 1:
        # One head for each bucket that has rows: its first document is copied to the bucket before; the first of all to the last.
        head, before = [None] * n, [0] * n
        for (bucket, at), (last, _) in zip(heads, [heads[-1], *heads[:-1]], strict=True):
            head[bucket], before[bucket] = at, last
        of = lambda values, kind: F.element_at(F.lit(values).cast(f"array<{kind}>") if None not in values else F.from_json(F.lit(str(values).replace("None", "null")), f"array<{kind}>"), F.col("_bucket") + 1)
        own = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("copy"))
        to = F.when(F.col("_at") == of(head, "bigint"), F.array(own, F.struct(of(before, "int").alias("b"), F.lit(True).alias("copy")))).otherwise(F.array(own))
        dealt = dealt.withColumn("_to", F.explode(to)).select("doc_id", "text", "_at", F.col("_to.b").alias("_bucket"), F.col("_to.copy").alias("_copy"))
    else:
        dealt = dealt.withColumn("_copy", F.lit(False))
    alone = len(heads) < 2
    schema = pa.schema([*RESULT, *BYTES]) if several else RESULT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = first = None
        out: list[tuple] = []

        def pair(this: tuple, after: tuple) -> None:
            key, text, canon, mark = this
            cut = len(text) // 4
            edited = (text[: len(text) - cut] if cut else text) + after[1][:cut]
            other = canon if edited == text else canonical_bytes(edited)
            found = (key, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, mark if other == canon else digest(other), likeness(canon, other), likeness(canon, after[2]))
            out.append((*found, canon, other) if several else found)

        def rows_out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*out, strict=True)) if out else [[] for _ in schema.names], strict=True)), schema=schema)
            out.clear()
            return found

        for batch in batches:
            for part in slices(batch, "text"):
                for key, text, copy in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("_copy").to_pylist(), strict=True):
                    canon = canonical_bytes(text)
                    now = (key, text, canon, digest(canon))
                    if held is not None:
                        pair(held, now)
                        held = None if copy else now
                    elif not copy:
                        held = now
                    first = first or now
                yield rows_out()
        if held is not None and alone:  # the only bucket: the first follows the last
            pair(held, first)
            yield rows_out()

    # Rows of one place are copied together; the first of them by text comes first.
    found = dealt.repartitionById(n, F.col("_bucket")).sortWithinPartitions("_bucket", "_copy", "_at", "text").mapInArrow(run, RESULT_DDL + (", _text binary, _edited binary" if several else ""))
    if several:
        found = _marked(_marked(found, numbers, "fingerprint", "_text"), numbers, "edited_fingerprint", "_edited")
    return found.select(*RESULT.names)
