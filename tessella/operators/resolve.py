"""Names in phrases: a batch of phrases against a catalog of tables, by exact matching tiers. Structure is read, never values.

Names meet phrases by joins on keys that any match must share (a token, a squashed name, a word, three letters of a beginning), so that no phrase is held against every name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators.durable import durable

#: Distinct forms of row keys up to which a table's keys are also found by a prefix; in larger tables a prefix alone finds nothing, as a rule of the engine.
PREFIX_FORMS = 2000
NO_WORD = "\x00"  # stands for a name without letters or digits


def _words(low: Column) -> Column:
    """Runs of letters and digits of a lower-case text."""
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")


def _tag(kind: str, items: Column) -> Column:
    return F.transform(items, lambda t: F.concat(F.lit(kind), t))


def _beginnings(items: Column) -> Column:
    return F.transform(F.filter(items, lambda t: F.length(t) >= X.MIN_PREFIX), lambda t: F.substring(t, F.lit(1), F.lit(X.MIN_PREFIX)))


def _first_word(low: Column) -> Column:
    return F.coalesce(F.try_element_at(_words(low), F.lit(1)), F.lit(NO_WORD))


def _name_keys(name: Column) -> Column:
    """Keys of a name, one of which is among the keys of every phrase that the name has a tier with."""
    low, short = F.lower(name), X.squash(name)
    first = F.slice(X.tokens(name), 1, 1)
    return F.array_distinct(F.concat(_tag("t", F.concat(first, F.filter(F.array(short), lambda t: t != ""))), F.array(F.concat(F.lit("w"), _first_word(low))), _tag("p", _beginnings(F.array(short)))))


def _phrase_keys(low: Column, words: Column) -> Column:
    return F.array_distinct(F.concat(_tag("t", words), _tag("w", F.concat(_words(low), F.array(F.lit(NO_WORD)))), _tag("p", _beginnings(words))))


@dataclass(frozen=True)
class NameIndex:
    """A catalog made ready for phrases. columns: table_id, tpos, cpos, column_name, k. rows: table_id, rpos, row_key and forms. forms: table_id, rpos, t.
    rare: as forms, each row under its rarest token, its squashed and its lower form only. keys: table_id, rpos, kind, k."""

    columns: DataFrame
    rows: DataFrame
    forms: DataFrame
    rare: DataFrame
    keys: DataFrame


def name_index(columns: DataFrame, rows: DataFrame) -> NameIndex:
    """columns: table_id, tpos, cpos, column_name; rows: table_id, tpos, rpos, row_key. Written once, for any number of batches of phrases."""
    cols = durable(columns.select("table_id", "tpos", "cpos", "column_name", F.explode(_name_keys(F.col("column_name"))).alias("k")), "column-names")
    known = durable(
        rows.select("table_id", "rpos", "row_key", X.token_set(F.col("row_key")).alias("rtoks"), X.squash(F.col("row_key")).alias("rsq"), F.lower("row_key").alias("rlow")), "row-names"
    )
    forms = durable(known.select("table_id", "rpos", F.explode(F.array_distinct(F.concat("rtoks", F.array("rsq", "rlow")))).alias("t")).where("t <> ''").distinct(), "forms")
    often = forms.groupBy("table_id", "t").agg(F.count("*").alias("_c"))
    rarest = known.select("table_id", "rpos", F.explode("rtoks").alias("t")).join(often, ["table_id", "t"]).groupBy("table_id", "rpos").agg(F.min_by("t", F.struct("_c", "t")).alias("t"))
    whole = known.select("table_id", "rpos", F.explode(F.array("rsq", "rlow")).alias("t")).where("t <> ''")
    rare = durable(rarest.union(whole).distinct(), "rare-forms")
    signed = known.where(F.col("rlow").rlike("[^a-z0-9]")).select("table_id", "rpos", F.explode(F.when(F.size(_words(F.col("rlow"))) > 0, F.array_distinct(_words(F.col("rlow")))).otherwise(F.array(F.lit(NO_WORD)))).alias("k"))
    common = signed.groupBy("table_id", "k").agg(F.count("*").alias("_c"))
    signs = signed.join(common, ["table_id", "k"]).groupBy("table_id", "rpos").agg(F.min_by("k", F.struct("_c", "k")).alias("k")).select("table_id", "rpos", F.lit("sign").alias("kind"), "k")
    small = known.groupBy("table_id").agg(F.countDistinct("rsq").alias("_f")).where(F.col("_f") <= PREFIX_FORMS).select("table_id")
    short = known.join(small, "table_id", "left_semi").where(F.length("rsq") >= X.MIN_PREFIX).select("table_id", "rpos", F.lit("begin").alias("kind"), F.substring("rsq", 1, X.MIN_PREFIX).alias("k"))
    return NameIndex(cols, known, forms, rare, durable(signs.union(short), "row-keys"))


@dataclass
class IndexCache:
    """Name indexes by what their catalog holds, so that an unchanged catalog is read once."""

    made: dict[tuple, NameIndex] = field(default_factory=dict)

    def get(self, columns: DataFrame, rows: DataFrame) -> NameIndex:
        key = tuple(columns.agg(F.count("*"), F.sum(F.xxhash64(*columns.columns).cast("decimal(38,0)"))).first()) + tuple(rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first())
        if key not in self.made:
            self.made[key] = name_index(columns, rows)
        return self.made[key]


def resolve(phrases: DataFrame, columns: DataFrame | None = None, rows: DataFrame | None = None, index: NameIndex | None = None) -> DataFrame:
    """pid, table_id, row_key, column_name of each phrase that names a column and a row of one table.

    phrases: pid, phrase; the catalog as an index, or as its frames. The best column of a table by tier, length,
    tokens, place; its tokens are taken out once; the best row of the rest likewise; the best table by the sums of tiers and
    lengths, then its place. Rows are candidates only by a shared token or squashed form, by a name with signs that stands in the rest, or, in tables of few
    distinct forms, by a prefix.
    """
    index = index or name_index(columns, rows)
    p = phrases.select("pid", F.lower("phrase").alias("pl"), X.tokens(F.col("phrase")).alias("words")).where(F.size("words") > 0)
    p = durable(p, "phrases")
    asked = p.select("pid", F.explode(_phrase_keys(F.col("pl"), F.col("words"))).alias("k"))
    met = asked.join(index.columns, "k").select("pid", "table_id", "tpos", "cpos", "column_name").distinct().join(p, "pid")
    tier = X.match_tier(F.col("column_name"), F.col("pl"), F.array_distinct("words"))
    rank = F.struct("ctier", F.length("column_name").alias("l"), F.size(X.token_set(F.col("column_name"))).alias("n"), (-F.col("cpos")).alias("c"), "column_name")
    best = met.withColumn("ctier", tier).where("ctier > 0").groupBy("pid", "table_id", "tpos").agg(F.max(rank).alias("best")).join(p, "pid")
    name = F.col("best.column_name")
    consumed = F.array_distinct(F.concat(X.token_set(name), F.array(X.squash(name))))
    rest = best.select("pid", "table_id", "tpos", name.alias("column_name"), F.col("best.ctier").alias("ctier"), X.without(F.col("pl"), name).alias("rl"), X.residual(F.col("words"), consumed).alias("rset"))
    rest = durable(rest, "rest")
    signs = rest.where(F.col("rl").rlike("[^a-z ]")).select("pid", "table_id", F.lit("sign").alias("kind"), F.explode(F.array_distinct(F.concat(_words(F.col("rl")), F.array(F.lit(NO_WORD))))).alias("k"))
    other = durable(signs.join(index.keys, ["table_id", "kind", "k"]).select("pid", "table_id", "rpos").distinct(), "signed")
    small = index.keys.where("kind = 'begin'").select("table_id").distinct().withColumn("_small", F.lit(True))

    def best_rows(asked: DataFrame, candidates: DataFrame) -> DataFrame:
        """The best row of each phrase and table among candidates (pid, table_id, rpos) that the rules admit."""
        found = candidates.join(asked, ["pid", "table_id"]).join(index.rows, ["table_id", "rpos"]).join(small, "table_id", "left")
        by_form = F.arrays_overlap("rtoks", "rset") | F.array_contains("rset", F.col("rsq")) | F.array_contains("rset", F.col("rlow"))
        by_sign = F.col("rl").rlike("[^a-z ]") & F.col("rlow").rlike("[^a-z0-9]") & F.regexp_like("rl", X.bounded(F.col("rlow")))
        near = F.exists("rset", lambda w: (F.length(w) >= X.MIN_PREFIX) & (F.length("rsq") >= X.MIN_PREFIX) & (w.startswith(F.col("rsq")) | F.col("rsq").startswith(w)))
        scored = found.where(by_form | by_sign | (F.coalesce("_small", F.lit(False)) & near)).withColumn("rtier", X.match_tier(F.col("row_key"), F.col("rl"), F.col("rset"))).where("rtier > 0")
        rank = F.struct("rtier", F.length("row_key").alias("l"), F.size("rtoks").alias("n"), (-F.col("rpos")).alias("r"), "row_key")
        return scored.groupBy("pid", "table_id", "tpos", "column_name", "ctier").agg(F.max(rank).alias("best"))

    # A row that is named in full is met under its rarest token; only phrases that name none in full look at every row that shares a token or a beginning.
    said = rest.select("pid", "table_id", F.explode(F.array_distinct(F.concat("rset", _words(F.col("rl"))))).alias("t")).join(index.rare, ["table_id", "t"]).select("pid", "table_id", "rpos")
    full = durable(best_rows(rest, said.union(other).distinct()).where("best.rtier >= 2"), "named")
    open_ = durable(rest.join(full.select("pid", "table_id"), ["pid", "table_id"], "left_anti"), "open")
    begun = open_.select("pid", "table_id", F.lit("begin").alias("kind"), F.explode(F.array_distinct(_beginnings(F.col("rset")))).alias("k")).join(index.keys, ["table_id", "kind", "k"]).select("pid", "table_id", "rpos")
    shared = open_.select("pid", "table_id", F.explode("rset").alias("t")).join(index.forms, ["table_id", "t"]).select("pid", "table_id", "rpos").union(begun)
    one = full.union(best_rows(open_, shared.union(other.join(open_.select("pid", "table_id"), ["pid", "table_id"], "left_semi")).distinct()))
    rank = F.struct((F.col("ctier") + F.col("best.rtier")).alias("tier"), (F.length("column_name") + F.col("best.l")).alias("l"), (-F.col("tpos")).alias("t"), "table_id", F.col("best.row_key").alias("row_key"), "column_name")
    return one.groupBy("pid").agg(F.max(rank).alias("top")).select("pid", "top.table_id", "top.row_key", "top.column_name")


def answers(phrases: DataFrame, columns: DataFrame | None, rows: DataFrame | None, values: DataFrame, index: NameIndex | None = None) -> DataFrame:
    """pid and value of every phrase; null where nothing was resolved. values: table_id, row_key, column_name, value."""
    found = resolve(phrases, columns, rows, index).join(values, ["table_id", "row_key", "column_name"], "left")
    return phrases.select("pid").join(found.select("pid", "value"), "pid", "left")
