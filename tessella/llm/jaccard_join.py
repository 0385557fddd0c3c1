"""N-gram Jaccard join with a token-group matrix.

Exact for every pair of different texts. (1) Texts with the same shingle set are one class. (2) All sets follow one order of shingles (by
hash, those that a sample shows in several documents last). Of each set only a prefix is a key: so long that two linked sets of n
shingles have 1 + n / SPARE of their keys in common. Keys that one class alone has are dropped (each task first settles what its own
texts share, and sends two classes of a key at most), and with them each class that has too few left to be linked with anything. Of the rest, each class leaves out its most frequent keys, so
many that a linked set still shares one. (3) The classes left are partitioned into groups of similar sets, by a common key, one round
of moving each class to where most of its keys are, and size. The token-group matrix holds each group's union of keys. (4) Groups are looked up in
the matrix by a join on the key: the number of keys that two unions share bounds the overlap of each member of one group with each of the
other, and only pairs of groups that reach it, with sizes that fit, are opened. (5) In an opened pair a finer matrix, over all
shingles and subgroups of SUBGROUP sets, bounds each query again, and what it opens is compared.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, release, sized_broadcast, slices, stash
from tessella.llm.components import connected_components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
GAP = np.isin(np.arange(256), [32, *range(9, 14)])
VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
#: Documents looked at for common shingles, and in how many of them a common one is. Any choice gives the same result.
COMMON_SAMPLE = 8000
COMMON_IN = 3
#: Two linked sets of n shingles or more share 1 + n // SPARE keys at least. Any choice gives the same result.
SPARE = 8
#: Sets of a group: so many, or for large families ROOT times the root of their number, as long as their shingles are no more than GROUP_SHINGLES.
GROUP_DOCS = 512
ROOT = 4
GROUP_SHINGLES = 1 << 19
SIZE_STEP = 1.25
SUBGROUP = 16
SLICE_BYTES = 1 << 19
#: Bytes of text whose keys one task compares.
BUCKET_BYTES = 32 << 20
MEMBER = ("node", "rep", "copies")
LINKS_DDL = "u long, v long, node long, linked long"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


#: Bytes hashed at a time, so that a text of any length takes the same room.
PART_BYTES = 1 << 19
UP, DOWN = _powers(PART_BYTES)


def word_hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, places start to end of the buffer."""
    total = np.zeros(len(start), np.uint64)
    for low in range(0, len(buffer), PART_BYTES):
        part = buffer[low : low + PART_BYTES]
        i, j = np.searchsorted(end, low, side="right"), np.searchsorted(start, low + len(part))
        if i == j:
            continue
        sums = np.concatenate([[np.uint64(0)], np.cumsum(VALUES[part] * UP[: len(part)], dtype=np.uint64)])
        s, e = np.maximum(start[i:j], low) - low, np.minimum(end[i:j], low + len(part)) - low
        own = (sums[e] - sums[s]) * DOWN[s]
        if start[i] < low:  # the word goes on from the part before
            own[:1] *= np.uint64(pow(int(BASE), int(low - start[i]), 1 << 64))
        total[i:j] += own
    return mix(total + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; fewer words than asked are one shingle, no words none."""
    data = [t.encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    begins = np.cumsum([0, *(len(d) + 1 for d in data)])
    buffer = np.frombuffer(b" ".join([*data, b""]), dtype=np.uint8)
    gap = GAP[buffer]
    edge = np.flatnonzero(np.diff(gap.astype(np.int8), prepend=1, append=1))
    start, end = edge[0::2], edge[1::2]
    word = word_hashes(buffer, start, end)
    cut = np.searchsorted(start, begins)

    def joined(n: int, at: np.ndarray) -> np.ndarray:
        h = np.full(len(at), np.uint64(n), np.uint64)
        for i in range(n):
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + word[at + i])
        return h

    every = joined(words, np.arange(max(0, len(word) - words + 1)))
    out = []
    for low, high in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if high - low >= words:
            found = np.sort(every[low : high - words + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        else:
            out.append(joined(high - low, np.array([low])) if high > low else np.zeros(0, np.uint64))
    return out


def least_shared(n: int) -> int:
    """How many keys two linked sets share, if the smaller has n shingles."""
    return 1 + n // SPARE


def keys_of(tokens: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set in the order of all sets: rare ones by hash, then common ones by hash.

    A set shares percent of its n shingles with each linked set, so n - ceil(n * percent / 100) of them at most are missing there.
    The first k shared ones are therefore among the first n - ceil(n * percent / 100) + k of either set.
    """
    n = len(tokens)
    if len(common) and n:
        shared = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens
        tokens = np.concatenate([tokens[~shared], tokens[shared]])
    return tokens[: n - -(-n * percent // 100) + least_shared(n)].copy()


def common_shingles(documents: DataFrame, words: int, doc_id: str, text: str) -> np.ndarray:
    """Sorted shingle hashes that COMMON_IN documents or more of a sample of about COMMON_SAMPLE have.

    The sample bounds their number. They only sharpen the candidate groups; results do not depend on them.
    """
    n = documents.count()
    bound = int(min(1.0, COMMON_SAMPLE / max(n, 1)) * 2**31)
    sampled = documents.where(F.pmod(F.xxhash64(doc_id, F.lit("common")), F.lit(2**31)) < bound).select(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                sets = shingle_sets([t or "" for t in part.column(text).to_pylist()], words)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).astype(np.int64))], ["s"])

    counted = sampled.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON_IN).select("s")
    return np.sort(np.asarray(counted.toArrow().column("s"), dtype=np.int64).astype(np.uint64))


def group_links(sets: list[np.ndarray], percent: int, copies: np.ndarray, split: int | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links among sets, and how many rows each set is linked with; with split, of those between sets before and after that place.

    copies: the number of rows that a set stands for. Every pair that may be linked is compared; the forest serves components only.

    The token-group matrix: sets are ordered so that similar ones stand together (by smallest token, then size) and cut into subgroups; a
    sparse matrix holds which subgroup's union has which token.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    linked = np.zeros(n, dtype=np.int64)
    if n < 2 or not size.sum():
        return [], linked
    tokens = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(n), size)
    ends = np.cumsum(size)
    rows = [tokens[e - k : e] for e, k in zip(ends.tolist(), size.tolist(), strict=True)]
    members = np.arange(n if split is None else split)
    smallest = np.array([s[0] if len(s) else 0 for s in sets], dtype=np.uint64)
    members = members[np.lexsort((size[members], smallest[members]))]
    group_of = np.full(n, -1)
    group_of[members] = np.arange(len(members)) // SUBGROUP
    n_groups = -(-len(members) // SUBGROUP)
    place = np.empty(n, dtype=np.int64)
    place[members] = np.arange(len(members))
    # Matrix in token order: for each token, the subgroups whose union has it.
    inside = group_of[owner] >= 0
    cells = np.unique(tokens[inside] * n_groups + group_of[owner[inside]])
    cell_group = cells % n_groups
    cell_at = np.searchsorted(cells // n_groups, np.arange(int(tokens.max()) + 2))
    smallest_size = np.minimum.reduceat(size[members], np.arange(0, len(members), SUBGROUP))
    largest_size = np.maximum.reduceat(size[members], np.arange(0, len(members), SUBGROUP))
    flat = np.concatenate([rows[m] for m in members])
    stop = np.cumsum(size[members])
    begin = stop - size[members]
    tree, links = np.arange(n), []
    queries = members.tolist() if split is None else list(range(split, n))
    marked = np.zeros(int(tokens.max()) + 1, dtype=bool)
    for q in queries:
        mine, k = rows[q], int(size[q])
        if not k:
            continue
        a, b = cell_at[mine], cell_at[mine + 1]
        width = b - a
        at = np.repeat(a - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        bound = np.bincount(cell_group[at], minlength=n_groups)
        opened = np.flatnonzero((bound * 100 >= percent * k) & (largest_size * 100 >= percent * k) & (smallest_size * percent <= 100 * k))
        last = len(members) if split is not None else int(place[q])
        marked[mine] = True
        for run in np.split(opened, np.flatnonzero(np.diff(opened) > 1) + 1) if len(opened) else []:
            low, high = int(run[0]) * SUBGROUP, min((int(run[-1]) + 1) * SUBGROUP, last)
            if low >= high:
                continue
            sums = np.concatenate([[0], np.cumsum(marked[flat[begin[low] : stop[high - 1]]])])
            both = sums[stop[low:high] - begin[low]] - sums[begin[low:high] - begin[low]]
            others = size[members[low:high]]
            hit = members[low:high][(others > 0) & (both * 100 >= percent * (k + others - both))]
            linked[q] += copies[hit].sum()
            linked[hit] += copies[q]
            trees, some = np.unique(tree[hit], return_index=True)
            for of, x in zip(trees.tolist(), hit[some].tolist(), strict=True):
                if of != tree[q]:
                    links.append((x, q))
                    tree[tree == of] = tree[q]
        marked[mine] = False
    return links, linked


def digests(tokens: np.ndarray) -> tuple[int | None, int | None]:
    """d1 and d2, the two halves of a set's digest; an empty set has none."""
    if not len(tokens):
        return None, None
    first = mix(tokens + np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64).astype(np.int64)
    second = mix(mix(tokens) ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64).astype(np.int64)
    return int(first), int(second)


def scan(documents: DataFrame, words: int, percent: int, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """Written once: a row of doc_id, n (size of the set), d1 and d2 (digest of the set, null if empty) for every document; and, with a
    bucket, rows that hold keys and the d1 of their classes side by side, bucket -1 those of which a task knows already that several classes have them.
    The number of buckets comes second.
    """
    common = common_shingles(documents, words, doc_id, text)
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    kind = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bucket", pa.int32()), ("cells", pa.binary())])

    def packed(keys: list[np.ndarray], classes: list[int]) -> pa.RecordBatch:
        own = np.repeat(np.array(classes, dtype=np.int64), [len(k) for k in keys])
        key, own = distinct_cells(np.concatenate(keys) if keys else np.zeros(0, np.uint64), own)
        place, count = places(key)
        several, sent = count > 1, place < 2
        rows = [(-1, key[several], own[several])]
        key, own = key[sent], own[sent]
        at = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(at, prepend=-1, append=-1)).tolist()
        rows += [(int(at[i]), key[i:j], own[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        none = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].tobytes() + r[2].tobytes() for r in rows], pa.binary())], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, classes = [], []
            for part in slices(batch, text, SLICE_BYTES):
                sets = shingle_sets([t or "" for t in part.column(text).to_pylist()], words)
                marks = [digests(s) for s in sets]
                ids = part.column(doc_id).cast(pa.int64())
                for s, (d1, _), known in zip(sets, marks, ids.is_valid().to_pylist(), strict=True):
                    if len(s) and known:
                        keys.append(keys_of(s, percent, common))
                        classes.append(d1)
                none = [pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())]
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([d for d, _ in marks], pa.int64()), pa.array([d for _, d in marks], pa.int64()), *none], schema=kind)
            yield packed(keys, classes)
        release()

    return stash(documents.select(doc_id, text).mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bucket int, cells binary"), "shingles"), buckets


def distinct_cells(key: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their classes sorted by both, repeats removed."""
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    return key[new], own[new]


def places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of sorted keys, its place among its equals, and how many these are."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    size = np.diff(first, append=len(key))
    return np.arange(len(key)) - np.repeat(first, size), np.repeat(size, size)


def shared_cells(scanned: DataFrame, buckets: int) -> DataFrame:
    """key and d1 of the classes that have a key with another class; repeats are possible."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for cells in batch.column("cells"):
                both = np.frombuffer(cells.as_buffer(), dtype=np.int64)
                yield both[: len(both) // 2].view(np.uint64), both[len(both) // 2 :]

    def rows(key: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(key), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(key[low : low + (1 << 18)].view(np.int64)), pa.array(own[low : low + (1 << 18)])], ["key", "d1"])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own in opened(batches):
            yield from rows(key, own)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(opened(batches))
        if held:
            key, own = distinct_cells(np.concatenate([k for k, _ in held]), np.concatenate([o for _, o in held]))
            several = places(key)[1] > 1
            yield from rows(key[several], own[several])

    cells = scanned.where("bucket is not null").select("bucket", "cells")
    sent = cells.where("bucket >= 0").repartitionById(buckets, F.col("bucket"))
    return cells.where("bucket < 0").mapInArrow(known, "key long, d1 long").union(sent.mapInArrow(compared, "key long, d1 long"))


def grouped_classes(scanned: DataFrame, buckets: int, classes: DataFrame, percent: int) -> DataFrame:
    """node, n, gid, keys (those that other classes have too) and rare (the keys to look up) of the classes that can be linked with any other.

    classes: d1, node and n of each class.
    """
    held = stash(shared_cells(scanned, buckets).groupBy("d1").agg(F.collect_set("key").alias("keys")), "held")
    need = (1 + F.floor(F.ceil(F.col("n") * percent / 100) / SPARE)).cast("int")
    often = held.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("often"))
    enough = stash(held.join(classes.select("d1", "node", "n"), "d1").where(F.size("keys") >= need).select("node", "n", "keys"), "enough")
    few = int(enough.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0])
    # Two linked sets share `need` keys; so they share one that is not among the need - 1 most frequent of either.
    ranked = enough.select("node", "n", F.explode("keys").alias("key")).join(often, "key").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("often", "key")), asc=False).alias("k"))
    rare = ranked.select("node", F.transform(F.slice("k", need, F.size("k")), lambda x: x["key"]).alias("rare"))
    live = stash(enough.join(rare, "node").withColumn("label", F.array_min("rare")), "live", few)
    # Each key names the label that most of its classes have; each class takes the label that most of its keys name.
    open_ = live.select("node", "label", F.explode("rare").alias("key"))
    hubs = open_.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("best")).select("key", F.col("best.label").alias("hub"))
    hubs = stash(hubs, "hubs", few)
    votes = open_.join(hubs, "key").groupBy("node", "hub").agg(F.count("*").alias("c"))
    placed = live.drop("label").join(votes.groupBy("node").agg(F.max(F.struct("c", "hub")).alias("best")), "node").select("node", "n", "keys", "rare", F.col("best.hub").alias("label"))
    placed = labelled = stash(placed, "labels", few)
    # Sets of one group are about as large as each other, so that its smallest one says much about what a link to it needs.
    placed = placed.withColumn("size", F.floor(F.log("n") / F.log(F.lit(SIZE_STEP))).cast("int"))
    sums = placed.groupBy("label", "size").agg(F.count("*").alias("docs"), F.sum("n").alias("weight"))
    most = F.greatest(F.lit(GROUP_DOCS), ROOT * F.sqrt("docs"))
    sums = sums.select("label", "size", F.greatest(F.ceil(F.col("docs") / most), F.ceil(F.col("weight") / GROUP_SHINGLES)).alias("parts"))
    gid = F.xxhash64("label", "size", F.pmod(F.xxhash64("node"), F.col("parts")))
    out = stash(placed.join(sums, ["label", "size"]).select("node", "n", gid.alias("gid"), "keys", "rare"), "groups", few)
    discard(held, enough, live, hubs, labelled)
    return out


def qualifying_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """ga < gb: pairs of groups of which some members may be linked, by the token-group matrix; and ga = gb for groups of two members or more.

    Groups meet under the keys that their members look up; how many keys their unions have in common bounds what any two members share.
    """
    few = int(placed.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0])
    union = F.array_distinct(F.flatten(F.collect_list("keys")))  # of a group, whose size is bounded
    groups = stash(placed.groupBy("gid").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("docs"), union.alias("keys")), "sizes", few)
    matrix = stash(placed.select("gid", F.explode("rare").alias("key")).distinct(), "matrix", few)
    wide = matrix.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    matrix = matrix.join(wide, "key")
    met = matrix.select("key", F.col("gid").alias("ga")).join(matrix.select("key", F.col("gid").alias("gb")), "key").where("ga < gb").select("ga", "gb").distinct()
    a, b = (groups.select(F.col("gid").alias(f"g{x}"), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}"), F.col("keys").alias(f"keys_{x}")) for x in "ab")
    c = F.size(F.array_intersect("keys_a", "keys_b"))
    # Of two linked sets the smaller one is at least percent of the larger one.
    smaller = F.greatest(F.least("lo_a", "lo_b"), F.ceil(F.greatest("lo_a", "lo_b") * percent / 100))
    fits = (c >= 1 + F.floor(smaller / SPARE)) & (F.col("hi_a") * 100 >= F.col("lo_b") * percent) & (F.col("hi_b") * 100 >= F.col("lo_a") * percent)
    return stash(met.join(a, "ga").join(b, "gb").where(fits).select("ga", "gb").union(groups.where("docs > 1").select("gid", "gid")), "pairs", few)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def task_count(spark, shingles: int) -> int:
    """Tasks for work on so many shingles: a megabyte or more of them each, some more for the sake of spread."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), shingles // (1 << 17) + 16))


def packed_groups(documents: DataFrame, members: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """One row per group: node, rep and copies of its members, the sizes of their sets, and the sets side by side. members: gid, node, n, rep, copies, d1, d2."""
    tasks = task_count(documents.sparkSession, int(members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    chosen = documents.select(F.col(doc_id).alias("rep"), F.col(text).alias("text")).join(sized_broadcast(members, members.count()), "rep")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                sets = shingle_sets([t or "" for t in part.column("text").to_pylist()], words)
                # An id may have other texts, which belong to other classes.
                own = [digests(s) == d for s, d in zip(sets, zip(part.column("d1").to_pylist(), part.column("d2").to_pylist(), strict=True), strict=True)]
                kept = pa.RecordBatch.from_arrays([*(part.column(c) for c in ("gid", *MEMBER)), pa.array([s.tobytes() for s in sets], pa.binary())], ["gid", *MEMBER, "tokens"])
                yield kept.filter(pa.array(own, pa.bool_()))
        release()

    kind = pa.schema([("gid", pa.int64()), *((c, pa.list_(pa.int64())) for c in MEMBER), ("sizes", pa.list_(pa.int32())), ("tokens", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gid, rows in itertools.groupby(rows_of(batches, "gid", *MEMBER, "tokens"), key=lambda r: r[0]):
            held = list({r[1]: r[1:] for r in rows}.values())  # rows that repeat an id and its text are one member
            lists = {c: [[h[i] for h in held]] for i, c in enumerate(MEMBER)}
            yield pa.RecordBatch.from_pydict({"gid": [gid], **lists, "sizes": [[len(h[3]) // 8 for h in held]], "tokens": [b"".join([h[3] for h in held])]}, schema=kind)

    cut = chosen.select("gid", *MEMBER, "d1", "d2", "text").mapInArrow(tokens, f"gid long, {', '.join(f'{c} long' for c in MEMBER)}, tokens binary")
    block_ddl = f"gid long, {', '.join(f'{c} array<long>' for c in MEMBER)}, sizes array<int>, tokens binary"
    return stash(cut.repartitionById(tasks, F.pmod(F.col("gid"), F.lit(tasks)).cast("int")).sortWithinPartitions("gid").mapInArrow(pack, block_ddl), "packed")


def opened_links(packed: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """u, v: reps of linked classes, a forest of each opened pair; and, where u is null, node, linked: with how many rows of a pair a class is linked."""
    weight = pairs.select(F.explode(F.array("ga", "gb")).alias("gid")).join(packed.select("gid", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n).alias("w")), "gid")
    tasks = task_count(packed.sparkSession, int(weight.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (a, b), rows in itertools.groupby(rows_of(batches, "ga", "gb", *MEMBER, "sizes", "tokens"), key=lambda r: r[:2]):
            held = [r[2:] for r in rows]
            members = [m for h in held for m in zip(*h[:3], strict=True)]
            cut = [np.split(np.frombuffer(h[4], np.uint64), np.cumsum(h[3])[:-1]) for h in held]
            links, linked = group_links([s for c in cut for s in c], percent, np.array([m[2] for m in members], dtype=np.int64), None if a == b else len(cut[0]))
            some = np.flatnonzero(linked).tolist()
            found = [(members[x][1], members[y][1], None, None) for x, y in links] + [(None, None, members[i][0], int(linked[i])) for i in some]
            yield pa.RecordBatch.from_pydict({c: [r[i] for r in found] for i, c in enumerate(("u", "v", "node", "linked"))}, schema=pa.schema([(c, pa.int64()) for c in ("u", "v", "node", "linked")]))
        release()

    sides = pairs.select("ga", "gb", F.explode(F.array_distinct(F.array("ga", "gb"))).alias("gid"))
    # The smaller side is the pairs; groups are bounded in size, so a row of either is too.
    units = packed.join(sized_broadcast(sides, sides.count()), "gid").select("ga", "gb", "gid", *MEMBER, "sizes", "tokens")
    deal = F.pmod(F.xxhash64("ga", "gb"), F.lit(tasks)).cast("int")
    return stash(units.repartitionById(tasks, deal).sortWithinPartitions("ga", "gb", "gid").mapInArrow(run, LINKS_DDL), "links")


def jaccard_join(documents: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row: documents linked by sets of word shingles that are alike by percent or more.

    Words are lower-cased (A-Z) and cut at white space; a text with fewer words than a shingle is one shingle; texts without words, and null
    texts, are linked with nothing. component_id is the smallest doc_id reachable by links; n_links is the number of other rows (not null in doc_id)
    that the row is linked with. Rows of one doc_id are one node, whatever their texts; a null doc_id has a null component and links nothing. Extra columns
    play no part; an empty table gives no rows.
    """
    written, buckets = scan(documents, words, percent, doc_id, text)
    scanned = written.where("bucket is null").select("doc_id", "n", "d1", "d2")
    full = scanned.where("n > 0 and doc_id is not null")
    classes = stash(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()), "classes")
    placed = grouped_classes(written, buckets, classes, percent)
    pairs = qualifying_pairs(placed, percent)
    members = stash(placed.select("node", "gid").join(classes, "node").select("gid", "n", *MEMBER, "d1", "d2"), "members", placed.count())
    packed = packed_groups(documents, members, words, doc_id, text)
    found = opened_links(packed, pairs, percent)
    discard(placed, pairs, members, packed)
    linked = found.where("u is null").groupBy("node").agg(F.sum("linked").alias("linked"))
    # The classes of an id that has several texts are one node.
    rows = full.select("doc_id", "d1", "d2")
    mixed = rows.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("a"), F.max(F.struct("d1", "d2")).alias("b")).where("a <> b").select("doc_id")
    tied = rows.join(mixed, "doc_id").join(classes, ["d1", "d2"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    ends = connected_components(found.where("u is not null").select("u", "v").union(tied))
    named = classes.join(ends.select(F.col("node").alias("rep"), "component"), "rep", "left").join(linked, "node", "left")
    named = named.select("d1", "d2", F.coalesce("component", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    named = stash(named, "named")
    discard(found, classes)
    # As many classes as there are different texts: Spark picks the join by their size, and splits the rows of a class with many copies.
    out = scanned.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"), F.coalesce(F.when(known, F.col("n_links")), F.lit(0)).cast("long").alias("n_links"))
