"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

A text is cut into units that no merge can cross (a run of spaces with the word behind it, line breaks by themselves), and the distinct
units of a batch are encoded together: one flat numpy array of symbols with the unit of each. In a round every unit
finds the smallest rank among its neighbouring pairs (a segmented minimum), merges that pair's occurrences from left to right, and
the array is compacted; units without a pair leave. Where a merged piece could itself take part in a better
merge, or where ranks are tied, a round merges occurrences from the left only up to the first that does make such a pair, which keeps the order of the
sequential algorithm. Characters outside the vocabulary become their UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import release, slices, texts_of

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Units that a worker remembers at a time.
UNITS_KEPT = 120_000
BATCH_BYTES = 2 << 20


class PieceModel:
    """Vocabulary of a BPE model with identity normalisation, dummy prefix and byte fallback."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        sp = self.library = SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        self.end_id = sp.eos_id()
        self.byte_ids = {int(n[3:5], 16): i for i, n in enumerate(names) if sp.is_byte(i)}
        normal = {n: i for i, n in enumerate(names) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        scores = np.array([sp.get_score(i) for i in range(size)], dtype=np.float64)
        rank_of = np.unique(-scores, return_inverse=True)[1].astype(np.int32)  # ties share a rank
        # Symbols: the pieces, then characters that occur inside pieces only, then any other character of a text.
        self.char = {n: i for n, i in normal.items() if len(n) == 1}
        self.extra: list[str] = []
        for n in normal:
            for c in n:
                if c not in self.char:
                    self.char[c] = size + len(self.extra)
                    self.extra.append(c)
        self.size, self.n_symbols = size, size + len(self.extra) + 1
        symbol = dict(self.char) | normal
        pairs = sorted((symbol[n[:k]] * self.n_symbols + symbol[n[k:]], i) for n, i in normal.items() for k in range(1, len(n)) if n[:k] in symbol and n[k:] in symbol)
        self.pair_keys = np.array([k for k, _ in pairs] or [-1], dtype=np.int64)
        self.pair_piece = np.array([p for _, p in pairs] or [0], dtype=np.int32)
        self.pair_rank = rank_of[self.pair_piece]
        self._fill_table()
        # Pieces that a better or equally good merge can follow: merged one at a time.
        self.careful = np.zeros(self.n_symbols, dtype=bool)
        for side in (self.pair_keys // self.n_symbols, self.pair_keys % self.n_symbols):
            piece = side < size
            worse = np.zeros(len(side), dtype=bool)
            worse[piece] = rank_of[side[piece]] >= self.pair_rank[piece]
            self.careful[side[worse]] = True
        for rank, n in zip(*np.unique(rank_of[list(normal.values())], return_counts=True), strict=True):
            if n > 1:
                self.careful[: self.size][rank_of == rank] = True
        self.crossing = any(SPACE in n.lstrip(SPACE) or "\n" in n for n in normal)
        if self.crossing:
            raise ValueError("a piece of this model crosses a space or a line break; units cannot be cut there")
        surfaces = [b"" if sp.is_control(i) else bytes([int(n[3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.surface = np.frombuffer(b"".join(surfaces), dtype=np.uint8)
        self.surface_len = np.array([len(s) for s in surfaces], dtype=np.int64)
        self.surface_at = np.concatenate([[0], np.cumsum(self.surface_len)])[:-1]
        numbers = [b" %d" % i for i in range(size)]
        self.decimal = np.frombuffer(b"".join(numbers), dtype=np.uint8)
        self.decimal_len = np.array([len(n) for n in numbers], dtype=np.int64)
        self.decimal_at = np.concatenate([[0], np.cumsum(self.decimal_len)])[:-1]
        self._ids: dict[str, bytes] = {}

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.table_bits)).astype(np.int64)

    def _fill_table(self) -> None:
        """Pairs in an open table, a quarter full, so that a pair is found at its slot or a few behind it."""
        self.table_bits = max(4, (4 * len(self.pair_keys) - 1).bit_length())
        self.table = np.full(1 << self.table_bits, -1, dtype=np.int64)
        self.table_rank, self.table_piece = np.full(len(self.table), NONE, np.int32), np.zeros(len(self.table), np.int32)
        left = np.flatnonzero(self.pair_keys >= 0)
        at = self._slots(self.pair_keys[left])
        while len(left):
            free = self.table[at] < 0
            self.table[at[free]] = self.pair_keys[left[free]]  # of several for one slot the last one stays
            done = self.table[at] == self.pair_keys[left]
            self.table_rank[at[done]], self.table_piece[at[done]] = self.pair_rank[left[done]], self.pair_piece[left[done]]
            left, at = left[~done], (at[~done] + 1) & (len(self.table) - 1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of neighbouring symbols; rank NONE where they do not merge."""
        key = left.astype(np.int64) * self.n_symbols + right
        at = self._slots(key)
        found = self.table[at]
        missed = np.flatnonzero((found != key) & (found >= 0))
        while len(missed):
            at[missed] = (at[missed] + 1) & (len(self.table) - 1)
            found[missed] = now = self.table[at[missed]]
            missed = missed[(now != key[missed]) & (now >= 0)]
        # An empty slot has rank NONE.
        return self.table_rank[at], self.table_piece[at]

    def tempting(self, symbol: np.ndarray, unit: np.ndarray, rank: np.ndarray, piece: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """For each merge, those to its left being done: whether the merged piece makes a pair as good or better with a neighbour."""
        n = len(symbol)
        merged = np.zeros(n + 2, dtype=bool)
        merged[hit] = True
        left = np.where(merged[hit - 2], piece[np.maximum(hit - 2, 0)], symbol[hit - 1])
        has_left = (hit > 0) & (unit[hit - 1] == unit[hit])
        at = np.minimum(hit + 2, n - 1)
        has_right = (hit + 2 < n) & (unit[at] == unit[hit])
        best = np.minimum(np.where(has_left, self.ranks(left, piece[hit])[0], NONE), np.where(has_right, self.ranks(piece[hit], symbol[at])[0], NONE))
        return best <= rank[hit]

    def merge(self, units: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols when no pair is left, unit after unit, and the number of symbols of each unit."""
        done: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
        other = self.n_symbols - 1
        lengths = np.array([len(u) for u in units], dtype=np.int64)
        chars, where = np.unique(np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4"), return_inverse=True)
        symbol = np.array([self.char.get(chr(c), other) for c in chars], dtype=np.int32)[where] if len(chars) else np.zeros(0, np.int32)
        unit = np.repeat(np.arange(len(units)), lengths)
        rank, piece = np.full(len(symbol), NONE, np.int32), np.zeros(len(symbol), np.int32)

        def refresh(at: np.ndarray) -> None:
            inside = at[(at >= 0) & (at < len(symbol))]
            joined = inside[(inside + 1 < len(symbol))]
            joined = joined[unit[joined] == unit[joined + 1]]
            rank[inside] = NONE
            rank[joined], piece[joined] = self.ranks(symbol[joined], symbol[joined + 1])

        refresh(np.arange(len(symbol)))
        while len(symbol):
            start = np.flatnonzero(np.diff(unit, prepend=-1))
            low = np.minimum.reduceat(rank, start)
            size = np.diff(start, append=len(symbol))
            if (low == NONE).any():
                keep = np.repeat(low != NONE, size)
                done.append((unit[~keep], symbol[~keep]))
                symbol, unit, rank, piece = symbol[keep], unit[keep], rank[keep], piece[keep]
                low, size = low[low != NONE], size[low != NONE]
                if not len(symbol):
                    break
                start = np.concatenate([[0], np.cumsum(size)])[:-1]
            hit = np.flatnonzero(rank == np.repeat(low, size))
            # Of overlapping occurrences (runs of neighbouring hits) every second one, from the left.
            run = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            first = np.flatnonzero(np.diff(unit[hit], prepend=-1))
            if self.careful[piece[hit]].any():
                # From the left, up to the first merge that makes a pair as good or better: that one has its turn before the others.
                fresh = self.tempting(symbol, unit, rank, piece, hit) & self.careful[piece[hit]]
                before = np.cumsum(fresh) - fresh
                hit = hit[before == np.repeat(before[first], np.diff(first, append=len(hit)))]
            symbol[hit] = piece[hit]
            keep = np.ones(len(symbol), dtype=bool)
            keep[hit + 1] = False
            now = hit - np.arange(len(hit))  # places after the compaction
            symbol, unit, rank, piece = symbol[keep], unit[keep], rank[keep], piece[keep]
            refresh(np.concatenate([now - 1, now]))
        of, symbols = (np.concatenate(c) for c in zip(*done, strict=True))
        return symbols[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(units))

    def unit_ids(self, unit: str, symbols: np.ndarray) -> list[int]:
        out: list[int] = []
        at = 0
        names = self.library.id_to_piece
        for s in symbols.tolist():
            if s < self.size:
                out.append(s)
                at += len(names(s)) if s not in self._lengths else self._lengths[s]
            else:  # a character that is no piece
                out += [self.byte_ids[b] for b in unit[at].encode("utf-8", "surrogatepass")]
                at += 1
        return out

    @property
    def _lengths(self) -> dict[int, int]:
        if not hasattr(self, "_length_of"):
            self._length_of = {i: len(self.library.id_to_piece(i)) for i in range(self.size)}
        return self._length_of

    def learn(self, units: Sequence[str]) -> None:
        """Encode units that are not known yet and keep their ids, as uint32 bytes."""
        symbols, n = self.merge(units)
        ends = np.cumsum(n)
        data, cut = symbols.astype("<u4").tobytes(), (4 * ends).tolist()
        self._ids.update(zip(units, map(data.__getitem__, map(slice, [0, *cut[:-1]], cut)), strict=True))
        # Units with a character that is no piece.
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(symbols >= self.size), side="right")).tolist():
            self._ids[units[k]] = np.array(self.unit_ids(units[k], symbols[ends[k] - n[k] : ends[k]]), dtype="<u4").tobytes()

    def units(self, text: str) -> list[str]:
        """Cut at spaces and line breaks; the first unit has the dummy prefix."""
        if SPACE in text or "  " in text or text.startswith(" "):
            return re.findall(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+", SPACE + text.replace(" ", SPACE)) if text else []
        # The same cut without a regular expression; empty strings between line breaks encode to nothing.
        return (SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n ")).split(" ") if text else []

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """For each text its ids, as little-endian uint32, without an end id."""
        cut = [self.units(t) for t in texts]
        if len(self._ids) > UNITS_KEPT:
            self._ids.clear()
        new = [u for u in set().union(*cut) if u not in self._ids]
        if new:
            self.learn(new)
        ids = self._ids.__getitem__
        return [np.frombuffer(b"".join(map(ids, units)), dtype="<u4") for units in cut]

    def as_decimal(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers, a space between them."""
        return _gather(self.decimal, self.decimal_at, self.decimal_len, ids)[1:]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: surfaces side by side, control pieces empty, one dummy space dropped at the front."""
        data = _gather(self.surface, self.surface_at, self.surface_len, ids)
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:  # byte pieces that are no text: the library's own replacement rule
            return self.library.decode([int(i) for i in ids])
        return text[1:] if text.startswith(" ") and self._dummy(ids) else text

    def _dummy(self, ids: np.ndarray) -> bool:
        """Whether the first piece that has a surface is a normal one, as the dropped space must come from it."""
        shown = ids[self.surface_len[ids] > 0]
        return bool(len(shown)) and int(shown[0]) not in self._byte_set

    @property
    def _byte_set(self) -> set[int]:
        return set(self.byte_ids.values())


def _gather(data: np.ndarray, at: np.ndarray, length: np.ndarray, ids: np.ndarray) -> bytes:
    """The byte strings of ids side by side, from a table of all strings, where each begins, and its length."""
    n = length[ids]
    ends = np.cumsum(n)
    return data[np.repeat(at[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()


@lru_cache(maxsize=2)
def load(model_file: str) -> PieceModel:
    """A worker process keeps the model for its later tasks."""
    return PieceModel(model_file)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_batch(model: PieceModel, texts: list[str], end: bool = True) -> list[np.ndarray]:
    tail = np.array([model.end_id] if end else [], dtype="<u4")
    return [np.concatenate([ids, tail]) for ids in model.encode(texts)]


def token_digests(documents: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """n_tokens (with the end id), sha256 of the ids and of the decoded text of every row. Null text is empty: the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_file)
        for batch in batches:
            for part in slices(batch, text, BATCH_BYTES):
                every = encode_batch(model, texts_of(part, text))
                n = [len(ids) for ids in every]
                ids_sha = [hashlib.sha256(model.as_decimal(ids)).hexdigest() for ids in every]
                text_sha = [hashlib.sha256(model.decode(ids).encode("utf-8", "surrogatepass")).hexdigest() for ids in every]
                yield pa.RecordBatch.from_arrays([part.column(doc_id).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], schema=RESULT)
        release()

    return documents.select(doc_id, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(documents: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, token_ids (with the end id), n_tokens and round_trip (decoding gives the text again, space marks as spaces) of every row.

    Null text is empty. Extra columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_file)
        for batch in batches:
            for part in slices(batch, text, BATCH_BYTES):
                texts = texts_of(part, text)
                ids = encode_batch(model, texts)
                same = [model.decode(i) == t.replace(SPACE, " ") for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(doc_id), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "token_ids", "n_tokens", "round_trip"])
        release()

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, token_ids array<int>, n_tokens long, round_trip boolean")


def decoded(tokens: DataFrame, model_file: str, ids: str = "token_ids", name: str = "text") -> DataFrame:
    """Add the decoded text of an array of ids; null ids decode to null. A column of that name is replaced."""
    from pyspark.sql import types as T

    kept = tokens.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_file)
        for batch in batches:
            found = [None if i is None else model.decode(np.array(i, dtype=np.int64)) for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, name])

    return kept.mapInArrow(run, schema)
