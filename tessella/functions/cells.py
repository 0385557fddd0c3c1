"""Tagged cells: one struct type for the mixed values of a sheet, and the predicates that the engine needs on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = T.StructType(
    [
        T.StructField("kind", T.StringType()),  # num, int, str, bool, ts or null
        T.StructField("num", T.DoubleType()),
        T.StructField("int", T.LongType()),
        T.StructField("str", T.StringType()),
        T.StructField("bool", T.BooleanType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("formula", T.StringType()),
    ]
)
GRID = T.StructType([T.StructField("sheet", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("cells", T.ArrayType(CELL))])
#: Text that a float parser takes: underscores between digits, exponents, infinity, not-a-number. Fixed value.
NUMBER_TEXT = r"(?i)^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)\s*$"
#: Text that looks like a value: currency, thousands, percent, parentheses.
VALUE_LIKE = r"^\s*\(?\s*[-+]?[$€£¥]?\s*\d[\d,]*(\.\d+)?\s*%?\s*\)?\s*$"


def cell(value: Column, kind: str, formula: Column | None = None) -> Column:
    """A cell of the given kind; null values become cells without a kind."""
    parts = {"num": "double", "int": "bigint", "str": "string", "bool": "boolean", "ts": "timestamp_ntz"}
    fields = [F.when(value.isNotNull(), F.lit(kind)).alias("kind")]
    fields += [(value if name == kind else F.lit(None)).cast(t).alias(name) for name, t in parts.items()]
    return F.struct(*fields, (F.lit(None) if formula is None else formula).cast("string").alias("formula"))


def kind_of(data_type: T.DataType) -> str:
    """Kind of a column's cells. Decimals are numbers; dates are timestamps; nested columns must be turned to text first."""
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "num"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "ts"
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        raise TypeError("a nested column cannot be a sheet column; turn it to text, for example with to_json")
    return "str"


def empty(c: Column) -> Column:
    """Null, or the empty text; white space, 0 and false are values."""
    return c.isNull() | c["kind"].isNull() | ((c["kind"] == "str") & (c["str"] == ""))


def number_text(text: Column) -> Column:
    return F.coalesce(text.rlike(NUMBER_TEXT), F.lit(False))


def text_number(text: Column) -> Column:
    """The double that a number text stands for, else null."""
    return F.when(number_text(text), F.regexp_replace(F.trim(text), "_", "").try_cast("double"))


def numeric(c: Column) -> Column:
    """A number for the inference of types: numbers, and number texts without thousands marks; never a boolean."""
    return c["kind"].isin("num", "int") | ((c["kind"] == "str") & number_text(c["str"]))


def conforms(c: Column, dtype: Column) -> Column:
    """Whether a cell fits a declared type; here, unlike in inference, commas in number texts are ignored."""
    as_number = c["kind"].isin("num", "int") | ((c["kind"] == "str") & number_text(F.regexp_replace(c["str"], ",", "")))
    return F.when(dtype == "number", as_number).when(dtype == "boolean", c["kind"] == "bool").when(dtype == "date", c["kind"] == "ts").otherwise(F.lit(True))


def canonical_key(c: Column) -> Column:
    """Text under which keys are equal: 1, 1.0 and true are one key, null and the empty text are two."""
    number = F.when(c["kind"] == "bool", c["bool"].cast("double")).when(c["kind"] == "int", c["int"].cast("double")).otherwise(c["num"])
    return F.when(empty(c) & (c.isNull() | c["kind"].isNull()), F.lit("0")).when(c["kind"] == "str", F.concat(F.lit("s"), c["str"])).when(
        c["kind"] == "ts", F.concat(F.lit("t"), c["ts"].cast("string"))
    ).otherwise(F.concat(F.lit("n"), number.cast("string")))


def cell_text(c: Column) -> Column:
    """The cell as a person would type it."""
    return F.when(c["kind"] == "str", c["str"]).when(c["kind"] == "int", c["int"].cast("string")).when(c["kind"] == "num", c["num"].cast("string")).when(
        c["kind"] == "bool", F.when(c["bool"], "True").otherwise("False")
    ).when(c["kind"] == "ts", c["ts"].cast("string"))


def cell_number(c: Column) -> Column:
    return F.when(c["kind"] == "int", c["int"].cast("double")).when(c["kind"] == "num", c["num"]).when(c["kind"] == "str", text_number(c["str"]))


def values_match(expected: Column, got: Column, tolerance: float = 1e-9) -> Column:
    """Numbers within a tolerance relative to max(|expected|, 1); null never matches."""
    return F.coalesce(F.abs(expected - got) <= F.lit(tolerance) * F.greatest(F.abs(expected), F.lit(1.0)), F.lit(False))
