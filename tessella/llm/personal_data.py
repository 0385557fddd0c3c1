"""Personal data: base patterns, and bootstrapped contextual extraction on top of them.

Base matches of email, ip, card and phone are the seed entities. Their neighbouring words induce lexical patterns;
every identifier-like token (one with a digit or @, or neighbouring groups of digits) in the same contexts is an instance of those patterns. Spark scores the graph of
patterns and instances in ROUNDS rounds: a pattern's score for a kind is the weight of its distinct instances known as
that kind, over that of all its instances, of which unknown ones count UNKNOWN_WEIGHT; an instance's confidence is the noisy-or of its accepted patterns. The unknown
instances of accepted patterns are the new spans. Texts are read once; all else runs on the compact table of occurrences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.llm.common import discard, release, sized_broadcast, slices, stash, texts_of, unused

KINDS = ("email", "ip", "card", "phone")
MIN_SCORE = 0.8
MIN_KNOWN = 5
UNKNOWN_WEIGHT = 0.25
#: The base patterns of the contract, each in a form that looks at a character a bounded number of times. Fixed values.
#: email is `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`, cut at its @: what stands before it, and after it.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: ip is `[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`; a match never begins inside a run of digits.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Groups of digits with single spaces between them, else one token with a digit or @.
TOKEN = re.compile(r"(?<!\S)(?:[(+]?[0-9][0-9().-]*+(?: [(]?[0-9][0-9().-]*+)++(?!\S)|[^\s0-9@]*+[0-9@]\S*+)")
EDGE = "\"'([{<>}])*&%$#!?.,;:|"
AROUND = 96
#: Patterns, of 200 characters at most, and spans up to which a side of a join is broadcast.
MOST_PATTERNS = 50_000
MOST_SPANS = 200_000


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Places of the email pattern: from each @ that has a domain behind it, back over what may stand before."""
    done, at = 0, text.find("@")
    while at >= 0:
        if at > done and text[at - 1] in LOCAL and (found := DOMAIN.match(text, at + 1)):
            start = at - 1
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            done = found.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: leftmost non-overlapping matches of each kind; failing matches are dropped."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", *span) for span in emails(text)]
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a place: the two words before it, and one word on either side. Digits count as 0."""
    left = text[max(0, start - AROUND) : start]
    before = re.sub(r"[0-9]", "0", left.lower()).split()[-2:]
    if start > AROUND and before and len(before) < 2 and not left[0].isspace():
        before = []  # one word longer than the window says nothing
    after = re.sub(r"[0-9]", "0", text[end : end + AROUND].lower()).split()[:1]
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before:
        out.append(f"{before[-1]} _ {after[0] if after else '$'}")
    return out


def occurrences(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str | None, int, int, int, list[str]]]:
    """(kind or None, start, end, hash of the surface, patterns): the base spans, and identifier-like tokens that touch none of them."""
    out = []
    places: list[tuple[str | None, int, int]] = list(base)
    if base or DIGIT.search(text) or "@" in text:
        taken = sorted((a, b) for _, a, b in base)
        i = 0
        for m in TOKEN.finditer(text):
            a, b = m.span()
            area_code = m[0][0] == "(" and m[0].find(")") > 1
            a, b = a + (0 if area_code else len(m[0]) - len(m[0].lstrip(EDGE))), b - len(m[0]) + len(m[0].rstrip(EDGE))
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if a < b and not any(x < b and a < y for x, y in taken[i : i + 4]):
                places.append((None, a, b))
    for kind, a, b in places:
        if found := contexts(text, a, b):
            surface = text[a:b].lower().encode("utf-8", "surrogatepass")
            out.append((kind, a, b, xxhash.xxh64_intdigest(surface) - (1 << 63), found))
    return out


OCCURRENCE = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))])
FOUND_DDL = "doc_id {}, n_email long, n_ip long, n_card long, n_phone long, base string, places array<struct<kind:string,start:int,end:int,instance:long,patterns:array<string>>>"


def scan(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """One row per document: counts and text of the base spans, and the occurrences with their patterns; written once, with a row number.

    whole: the document itself comes along, all its columns as one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if whole:
                rows = batch.column(0)
                batch = pa.RecordBatch.from_arrays([rows.field(doc_id), rows.field(text), rows], [doc_id, text, "whole"])
            for part in slices(batch, text):
                counts: list[list[int]] = [[] for _ in KINDS]
                base, places = [], []
                for t in texts_of(part, text):
                    spans = base_spans(t)
                    for k, kind in enumerate(KINDS):
                        counts[k].append(sum(s[0] == kind for s in spans))
                    base.append(spans_text(spans))
                    places.append([dict(zip(("kind", "start", "end", "instance", "patterns"), o, strict=True)) for o in occurrences(t, spans)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(doc_id), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(places, pa.list_(OCCURRENCE)), *part.columns[2:]],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "places", *part.schema.names[2:]],
                )
        release()

    kind = documents.schema[doc_id].dataType.simpleString()
    schema = StructType.fromDDL(FOUND_DDL.format(kind))
    if whole:
        found = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("whole")).mapInArrow(run, schema.add("whole", documents.schema))
    else:
        found = documents.select(doc_id, text).mapInArrow(run, schema)
    return stash(found.withColumn("row", F.monotonically_increasing_id()), "personal")


def score_patterns(edges: DataFrame, min_score: float = MIN_SCORE, min_known: int = MIN_KNOWN) -> DataFrame:
    """pattern, kind and score of the accepted patterns, from edges (pattern, instance, kind or null), repeats allowed.

    An edge is counted once for each distinct instance. An instance that is a seed of a kind anywhere is known as that kind. No seeds: no patterns.
    Rounds end when one accepts no further pattern; as accepted ones stay, there is an end.
    """
    links = stash(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("own")), "links")
    few = links.count()
    seeds = links.where("own is not null").groupBy("instance").agg(F.max("own").alias("kind"), F.lit(1.0).alias("trust"))
    known, accepted, n = seeds, None, 0
    while True:
        trusted = links.join(known, "instance", "left")
        sums = trusted.groupBy("pattern").agg(
            F.count("*").alias("n"), *(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("trust"))), F.lit(0.0)).alias(k) for k in KINDS)
        )
        best = F.greatest(*(F.struct(F.col(k).alias("known"), F.lit(k).alias("kind")) for k in KINDS))
        every = sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0]))
        weight = every + UNKNOWN_WEIGHT * F.greatest(F.col("n") - every, F.lit(0.0))
        scored = sums.select("pattern", weight.alias("weight"), best.alias("best")).select("pattern", F.col("best.kind").alias("kind"), F.try_divide(F.col("best.known"), F.col("weight")).alias("score"), F.col("best.known").alias("known"))
        now = scored.where((F.col("score") >= min_score) & (F.col("known") >= min_known)).select("pattern", "kind", "score")
        if accepted is not None:
            now = accepted.unionByName(now.join(accepted.select("pattern"), "pattern", "left_anti"))
        accepted = stash(now, "patterns", few)
        before, n = n, accepted.count()
        if n == before:
            discard(links)
            return accepted
        votes = links.join(sized_broadcast(accepted, n, MOST_PATTERNS), "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))).alias("trust"))
        both = seeds.select("instance", "kind", "trust").union(votes.select("instance", "kind", "trust"))
        known = both.groupBy("instance").agg(F.max(F.struct("trust", "kind")).alias("b")).select("instance", F.col("b.kind").alias("kind"), F.col("b.trust").alias("trust"))


def new_spans(scanned: DataFrame) -> tuple[DataFrame, int]:
    """row and added (kind, start, end) of the documents in which accepted patterns find unseen identifiers; and how many spans these are."""
    places = scanned.select("row", F.explode("places").alias("p")).select("row", "p.*")
    edges = places.select("kind", "instance", F.explode("patterns").alias("pattern"))
    accepted = score_patterns(edges)
    n = accepted.count()
    unknown = places.where("kind is null").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    hits = unknown.join(sized_broadcast(accepted, n, MOST_PATTERNS), "pattern").groupBy("row", "start", "end").agg(F.max(F.struct("score", "kind")).alias("best"))
    # A document's own spans only: their number is bounded by its length.
    per_row = stash(hits.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("best.kind").alias("kind"), "start", "end"))).alias("added")), "added")
    return per_row, per_row.agg(F.coalesce(F.sum(F.size("added")), F.lit(0))).first()[0]


def joined_spans(base: Column, added: Column) -> Column:
    """Base and added spans as one text, by kind as listed, then start."""
    split = F.transform(F.filter(F.split(base, ","), lambda s: s != ""), lambda s: F.split(s, ":"))
    of_base = F.transform(split, lambda p: F.struct(F.array_position(F.lit(list(KINDS)), p[0]).alias("k"), p[1].cast("int").alias("start"), p[2].cast("int").alias("end")))
    of_new = F.transform(F.coalesce(added, F.array().cast("array<struct<kind:string,start:int,end:int>>")), lambda s: F.struct(F.array_position(F.lit(list(KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end")))
    every = F.sort_array(F.concat(of_base, of_new))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.element_at(F.lit(list(KINDS)), s["k"].cast("int")), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of base spans, base (text), spans (all, text) and n_added of every row.

    Null text is empty; repeated rows and null ids keep their rows; extra columns play no part; an empty table gives no rows.
    """
    scanned = scan(documents, doc_id, text)
    added, n = new_spans(scanned)
    both = scanned.drop("places").join(sized_broadcast(added, n, MOST_SPANS), "row", "left")
    return both.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", joined_spans(F.col("base"), F.col("added")).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"))


def redact(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, each span of personal data in the text replaced by its kind in brackets. Repeated rows and null ids keep their rows; null texts stay null."""
    scanned = scan(documents, doc_id, text, whole=True)
    added, n = new_spans(scanned)
    # By row number: each text is covered at its own places, whatever its id.
    (marked,) = unused(documents, "_spans")
    both = scanned.select("row", "base", "whole").join(sized_broadcast(added, n, MOST_SPANS), "row", "left").select("whole.*", joined_spans(F.col("base"), F.col("added")).alias(marked))

    def cover(value: str, spans: str) -> str:
        out, at = [], 0
        for a, b, k in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(","))):
            if b <= at:
                continue
            out.append(value[at : max(at, a)] + ("" if a < at else f"[{k.upper()}]"))
            at = b
        return "".join(out) + value[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text)
            for part in slices(batch, text):
                marks = part.column(marked).to_pylist()
                if any(marks):
                    values = [cover(t, s) if s and t is not None else t for t, s in zip(part.column(i).to_pylist(), marks, strict=True)]
                    part = part.set_column(i, part.schema.field(i).with_type(pa.string()), pa.array(values, pa.string()))
                yield part.drop_columns([marked])
        release()

    return both.mapInArrow(run, documents.schema)
