"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level k holds the k-th chunk of every id that has one, as
plain bytes; a bitmap per level marks the ids that continue in the next level, and a rank directory holds the number of
set bits before every block of BLOCK bits. The chunk of level k + 1 that belongs to position i of level k is at rank(i), so any token is
reached by one step per level, without decoding a block.

Layout (little-endian): magic `TDAC0001`, then int64: documents, tokens, levels; then doc ids int64[documents],
id-is-null uint8[documents], offsets int64[documents + 1]; then for each level: count int64, chunks uint8[count], and unless it is the last:
bitmap uint8[ceil(count / 8)] (bit order little), rank directory int64[count // BLOCK + 1].
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import fresh_dir, ordered_buckets

MAGIC = b"TDAC0001"
BLOCK = 512
ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)


def pack(doc_ids: Sequence[int | None], offsets: np.ndarray, ids: np.ndarray) -> bytes:
    """One file's bytes. ids: uint32, those of document i at offsets[i] to offsets[i + 1]."""
    levels: list[bytes] = []
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    while True:
        more = rest > 255
        last = not more.any()
        part = [np.int64(len(rest)).tobytes(), (rest & 255).astype(np.uint8).tobytes()]
        if not last:
            bits = np.packbits(more, bitorder="little")
            ones = np.concatenate([[0], np.cumsum(ONES[bits])])
            part += [bits.tobytes(), ones[(np.arange(len(rest) // BLOCK + 1) * (BLOCK // 8))].astype(np.int64).tobytes()]
        levels.append(b"".join(part))
        if last:
            break
        rest = rest[more] >> 8
    keys = np.array([0 if i is None else i for i in doc_ids], dtype=np.int64)
    nulls = np.array([i is None for i in doc_ids], dtype=np.uint8)
    head = np.array([len(keys), len(ids), len(levels)], dtype=np.int64)
    return b"".join([MAGIC, head.tobytes(), keys.tobytes(), nulls.tobytes(), np.asarray(offsets, dtype=np.int64).tobytes(), *levels])


class TokenFile:
    """Reads one file's bytes; token(i) and tokens(low, high) touch only what they need."""

    def __init__(self, data: bytes | memoryview):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        at = 8

        def take(kind: type, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        documents, self.n_tokens, depth = (int(x) for x in take(np.int64, 3))
        keys, nulls = take(np.int64, documents), take(np.uint8, documents)
        self.doc_ids = [None if null else int(k) for k, null in zip(keys, nulls, strict=True)]
        self.offsets = take(np.int64, documents + 1)
        self.levels = []
        for k in range(depth):
            n = int(take(np.int64, 1)[0])
            chunks = take(np.uint8, n)
            self.levels.append((chunks, *((take(np.uint8, -(-n // 8)), take(np.int64, n // BLOCK + 1)) if k + 1 < depth else (None, None))))

    def rank(self, level: int, i: int) -> int:
        """Set bits of the level's bitmap before position i."""
        _, bits, ranks = self.levels[level]
        block = i // BLOCK
        whole = bits[block * (BLOCK // 8) : i // 8]
        return int(ranks[block] + ONES[whole].sum() + (bin(int(bits[i // 8]) & ((1 << i % 8) - 1)).count("1") if i % 8 else 0))

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if bits is None or not bits[i // 8] >> i % 8 & 1:
                break
            i = self.rank(k, i)
        return value

    def tokens(self, low: int = 0, high: int | None = None) -> np.ndarray:
        """The ids from low to high as uint32: of each level only the range that the ids reach."""
        high = self.n_tokens if high is None else high
        out = np.zeros(high - low, dtype=np.uint32)
        at, a, b = np.arange(high - low), low, high
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * k)
            if bits is None or a == b:
                break
            more = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            at, a = at[more], self.rank(k, a)
            b = a + len(at)
        return out


@lru_cache(maxsize=2)
def words_encoder(tokenizer_file: str, most: int = 800_000) -> Callable[[str], bytes]:
    """text -> ids as little-endian uint32, equal to the tokenizers library's encode(text, add_special_tokens=False).

    Special strings inside a text get their own ids, as in the library; texts that may hold one go through its encode whole.
    The vocabulary splits at white space and between runs of letters, digits and signs, so the library's BPE model is asked
    once per distinct piece and its answers are kept, most of each kind. Texts with characters whose case, width
    or white space need the library's own normaliser go through its encode as they are. A worker process keeps the encoder
    for its later tasks.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(tokenizer_file)
    model, to_bytes = tok.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    byte_signs = {c: to_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xA1, 0x180)}
    specials = [t.content.lower() for t in tok.get_added_tokens_decoder().values()]
    mark = os.path.commonprefix(specials)  # what every one of them begins with, looked for first
    # Letters, digits and white space below U+0180 are the same for Python and the library.
    # Number signs other than 0-9 and the two letter signs among them are left to the library as well.
    odd = re.compile("[^\t\n\r\x20-\x7e¡-©«-±´-¸»¿-įĲ-ſ]")
    pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[^\S\r\n]|[0-9]|(?:[^\s\w]|_)+")
    of_piece: dict[str, bytes] = {}
    of_word: dict[str, bytes] = {}

    def piece(text: str) -> bytes:
        found = of_piece.get(text)
        if found is None:
            found = b"".join([t.id.to_bytes(4, "little") for t in model.tokenize(text if text.isascii() else text.translate(byte_signs))])
            if len(of_piece) >= most:
                of_piece.clear()
            of_piece[text] = found
        return found

    def word(text: str) -> bytes:
        if text.isalpha():
            return piece(text)
        if text[-1] in ".," and text[:-1].isalpha():
            found = piece(text[:-1]) + piece(text[-1])
        else:
            found = b"".join([piece(p) for p in pieces.findall(text)])
        if len(of_word) >= most:
            of_word.clear()
        if len(text) <= 64:
            of_word[text] = found
        return found

    def encode(text: str) -> bytes:
        if not odd.search(text) and not (specials and mark in (low := text.lower()) and any(s in low for s in specials)):
            get, get_piece = of_word.get, of_piece.get
            text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
            return b"".join([get_piece(w) or get(w) or word(w) for w in text.split()])
        return np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    return encode


def write_files(documents: DataFrame, encoder: Callable[[], Callable[[str], bytes]], path: str, end_id: int | None = 1, key: str = "doc_id", text: str = "text", bucket_bytes: int = 8 << 20, file_bytes: int = 16 << 20) -> DataFrame:
    """Write one file or more per bucket of ascending keys under path; return file, bucket, documents and tokens of each.

    encoder() is called once in each task and gives text -> uint32 bytes. A task holds one file's ids at a time: about file_bytes, or one
    longer document. A null text is an empty one; null keys come last, by hash and text; rows of one key keep all, in the order of their text.
    A file is written under another name and then renamed, so that a task that runs again leaves the same files. Extra columns play no part. Empty input: no files.
    """
    dealt, n, _ = ordered_buckets(documents.select(key, text), key, text, bucket_bytes)
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
    kind = pa.schema([("file", pa.string()), ("bucket", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64())])

    def save(bucket: int, number: int, keys: list[int | None], parts: list[bytes]) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int64)
        data = pack(keys, offsets, np.frombuffer(b"".join(parts), dtype="<u4"))
        name = f"{bucket:08d}-{number:06d}.tdac"
        fs, at = pafs.FileSystem.from_uri(f"{path}/{name}" if "://" in path else f"file://{path}/{name}")
        folder = at.rsplit("/", 1)[0]
        fs.create_dir(folder, recursive=True)
        own = f"{folder}/_{name}.{np.random.default_rng().integers(1 << 62):x}"
        with fs.open_output_stream(own) as out:
            out.write(data)
        fs.move(own, at)
        return pa.RecordBatch.from_pydict({"file": [name], "bucket": [bucket], "documents": [len(keys)], "tokens": [int(offsets[-1])]}, schema=kind)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        keys: list[int | None] = []
        parts: list[bytes] = []
        held, number, bucket = 0, 0, None
        for batch in batches:
            for b, k, t in zip(*(batch.column(c).to_pylist() for c in ("_bucket", key, text)), strict=True):
                if keys and (b != bucket or held >= file_bytes):
                    yield save(bucket, number, keys, parts)
                    keys, parts, held, number = [], [], 0, number + 1 if b == bucket else 0
                bucket = b
                keys.append(k)
                parts.append(encode(t or "") + end)
                held += len(parts[-1])
        if keys:
            yield save(bucket, number, keys, parts)

    ordered = dealt.repartitionById(n, F.col("_bucket")).sortWithinPartitions("_bucket", "_at", text)
    made = ordered.mapInArrow(put, "file string, bucket int, documents long, tokens long").collect()
    # Sorted here: to order the frame would run the encoding twice, once to sample the ranges.
    return documents.sparkSession.createDataFrame(sorted(made, key=lambda r: r.file), "file string, bucket int, documents long, tokens long")


def read_files(spark, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files that manifest names."""
    starts, total = [], 0
    for r in manifest.orderBy("file").collect():
        starts.append((r.file, total))
        total += r.tokens
    if not starts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    base = spark.createDataFrame(starts, "file string, base long")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path"), batch.column("content"), strict=True):
                found = TokenFile(memoryview(data.as_buffer()))
                ids, cuts = found.tokens().astype("<u4"), found.offsets.tolist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "file": [name.as_py().rsplit("/", 1)[-1]] * len(found.doc_ids), "doc_id": found.doc_ids, "at": cuts[:-1], "n_tokens": np.diff(found.offsets),
                        "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
                    },
                    schema=pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]),
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tdac").load(path).select("path", "content")
    rows = files.mapInArrow(get, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    # One row per file of the manifest, which the driver has just summed.
    joined = rows.join(F.broadcast(base), "file")
    return joined.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(documents: DataFrame, tokenizer_file: str, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, from files written and read again; nulls, empty texts and repeats as in write_files."""
    spark = documents.sparkSession
    path = fresh_dir(spark, "tokens")
    manifest = write_files(documents, lambda: words_encoder(tokenizer_file), path, end_id)
    return read_files(spark, path, manifest)
