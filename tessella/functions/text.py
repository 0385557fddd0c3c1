"""Names and texts: tokens, squashed names, match tiers, raw literals, JSON in prose, categories of findings."""

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.cells import text_number

#: Where a name is cut before a capital: after a small letter or digit, and between an acronym and a word. Fixed value.
CAMEL = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
MIN_PREFIX = 3


def tokens(text: Column) -> Column:
    """Lower-case words in order, repeats kept: cut before capitals, then at anything but letters and digits."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, CAMEL, " ")), "[^a-z0-9]+"), lambda t: t != "")


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def squash(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def quoted(text: Column) -> Column:
    """The text as a literal of a regular expression."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def bounded(name: Column) -> Column:
    """Pattern of a name that is not part of a longer word."""
    return F.concat(F.lit("(?<![a-z0-9])"), quoted(F.lower(name)), F.lit("(?![a-z0-9])"))


def match_tier(name: Column, phrase: Column, words: Column) -> Column:
    """3: the name stands in the phrase word for word; 2: all its tokens, or its squashed form, do; 1: a prefix either way of
    three characters at least; 0: none. phrase is lower case, words are its tokens."""
    short, own = squash(name), token_set(name)
    all_tokens = (F.size(own) > 0) & (F.size(F.array_except(own, words)) == 0)
    prefix = (F.length(short) >= MIN_PREFIX) & F.exists(words, lambda w: (F.length(w) >= MIN_PREFIX) & (w.startswith(short) | short.startswith(w)))
    return (
        F.when(F.length(F.trim(name)) == 0, 0).when(F.regexp_like(phrase, bounded(name)), 3).when(all_tokens | ((short != "") & F.array_contains(words, short)), 2).when(prefix, 1).otherwise(0)
    )


def without(phrase: Column, name: Column) -> Column:
    """The phrase with the first bounded occurrence of the name blanked."""
    at = F.regexp_instr(phrase, bounded(name))
    cut = F.concat(F.substring(phrase, F.lit(1), at - 1), F.lit(" "), F.substring(phrase, at + F.length(name), F.length(phrase)))
    return F.when(at > 0, cut).otherwise(phrase)


def residual(words: Column, consumed: Column) -> Column:
    """Distinct words that are left when each consumed token takes away one occurrence."""
    return F.filter(F.array_distinct(words), lambda t: F.size(F.filter(words, lambda w: w == t)) - F.when(F.array_contains(consumed, t), 1).otherwise(0) > 0)


def parse_raw(text: Column) -> Column:
    """number and text of a literal like '124,500 (a)' or '(3000)': footnote dropped, parentheses negative, commas ignored.

    Where no number is found, number is null and text is the literal as it was; else text is null.
    """
    bare = F.regexp_replace(F.trim(text), r"\s*\([a-z]\)\s*$", "")
    negative = bare.startswith("(") & bare.endswith(")")
    digits = F.regexp_replace(F.when(negative, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare), ",", "")
    value = text_number(digits)
    number = F.when(negative, -value).otherwise(value)
    return F.struct(number.alias("number"), F.when(number.isNull(), text).alias("text"))


def general(value: Column) -> Column:
    """A number in six significant digits, without zeros at its end: 1234.5, 1e+06, 0.0001, 1e-05. Halves go up, on the shortest decimal form."""
    shown = F.format_string("%.5e", value.cast("double"))
    power = F.substring_index(shown, "e", -1).cast("int")
    strip = lambda t: F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)
    fixed = F.lit(None).cast("string")
    for e in range(-4, 6):
        fixed = F.when(power == e, strip(F.format_string(f"%.{5 - e}f", value.cast("double")))).otherwise(fixed)
    sign = F.when(power < 0, "-").otherwise("+")
    far = F.concat(strip(F.substring_index(shown, "e", 1)), F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when(value == 0, "0").otherwise(F.coalesce(fixed, far))


def format_raw(value: Column, thousands: bool = False, parens: bool = False, footnote: str | None = None) -> Column:
    """Text of a number: with thousands marks, negatives in parentheses and a footnote if wanted.

    Whole numbers with thousands marks are written in full, others with as many decimals as they have.
    A number in parentheses has no footnote. Without any of the three, the number alone, in six significant digits.
    """
    size, kind = F.abs(value), "bigint"
    whole = F.format_number(size.cast(kind), 0)
    decimals = F.regexp_extract(size.cast("string"), r"\.(\d*[1-9])0*$", 1)
    marked = F.when(decimals == "", whole).otherwise(F.concat(F.format_number(F.floor(size).cast(kind), 0), F.lit("."), decimals))
    digits = marked if thousands else general(size)
    signed = F.when(value < 0, F.concat(F.lit("-"), digits)).otherwise(digits)
    noted = F.concat(signed, F.lit(f" ({footnote})")) if footnote else signed
    return F.when(value < 0, F.concat(F.lit("("), digits, F.lit(")"))).otherwise(noted) if parens else noted


#: Blocks that are tried before an object is looked for in prose.
FENCES = (re.compile(r"```json\s*\n(.*?)\n```", re.DOTALL), re.compile(r"```\s*\n(.*?)\n```", re.DOTALL))


def find_json(text: str) -> str | None:
    """JSON in a text, as it stands there: the whole text, else a block fenced as json, else any fenced block, else the first object that parses."""
    for part in (text.strip(), *(m[1] for f in FENCES if (m := f.search(text)))):
        try:
            json.loads(part)
            return part
        except ValueError:
            pass
    at = text.find("{")
    while at >= 0:
        try:
            # A decoder stops behind the object's closing brace, whatever follows.
            return text[at : json.JSONDecoder().raw_decode(text, at)[1]]
        except ValueError:
            at = text.find("{", at + 1)
    return None


def extract_json(text: Column) -> Column:
    """find_json as a Column; null if there is none. Python sees, in Arrow batches, only texts that have a brace."""
    found = F.pandas_udf(lambda texts: texts.map(find_json, na_action="ignore"), "string")
    return found(F.when(text.contains("{"), text))


#: Prefix of a gate message, and the category of the finding; the first that fits counts. Fixed values.
CATEGORIES = (
    ("coverage gap", "coverage-gap"), ("column-name", "column-name"), ("column-integrity", "column-integrity"), ("column-coverage", "column-coverage"),
    ("row-integrity", "row-integrity"), ("row-key collision", "row-key-collision"), ("blank row key", "blank-row-key"), ("empty index", "empty-index"),
    ("round-trip", "round-trip"), ("dtype-mismatch", "dtype-mismatch"), ("computed", "computed"),
)


def category(message: Column) -> Column:
    out = F.lit("other")
    for prefix, name in reversed(CATEGORIES):
        out = F.when(message.startswith(prefix), name).otherwise(out)
    return out


def phrase_for(table: Column, row: Column, col: Column, unit: Column, alone: Column, seed: Column) -> Column:
    """A question for a cell: one of several wordings, picked by a number; where the cell's labels are not alone in the workbook, the table is named."""
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    named = [say("What is the ", col, " for ", row, " in ", table, "?"), say("Look up ", col, " of ", row, " in the ", table, " table.")]
    short = [say("What is the ", col, " of ", row, "?"), say(row, " ", col), say("How much ", col, " does ", row, " have?"), say("Show ", row, "'s ", col, ".")]
    pick = lambda options: F.element_at(F.array(*options), (F.pmod(seed, F.lit(len(options))) + 1).cast("int"))
    unit_said = F.when((unit == "%") & (F.pmod(seed, F.lit(5)) == 0), say("What is the ", col, " percentage of ", row, "?")).when((unit == "USD") & (F.pmod(seed, F.lit(5)) == 0), say("What is ", row, "'s ", col, " in dollars?"))
    return F.when(alone, F.coalesce(unit_said, pick(named + short))).otherwise(pick(named))
