"""A1 references: bijective base-26 column letters, cells and ranges, on the driver and as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL_REF = re.compile(r"\$?([A-Z]{1,3})\$?([0-9]+)")


def column_letters(index: int) -> str:
    out = ""
    while index > 0:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def column_index(letters: str) -> int:
    total = 0
    for c in letters.upper():
        total = total * 26 + ord(c) - 64
    return total


def parse_cell(ref: str) -> tuple[int, int]:
    """(row, column) of a cell like B3."""
    found = CELL_REF.fullmatch(ref.strip().upper())
    if not found:
        raise ValueError(f"not a cell reference: {ref!r}")
    return int(found[2]), column_index(found[1])


def parse_range(ref: str) -> tuple[int, int, int, int]:
    """(min row, min column, max row, max column) of B3:F14, or of a single cell."""
    first, _, second = ref.partition(":")
    a, b = parse_cell(first), parse_cell(second or first)
    return min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1])


def range_text(min_row: int, min_col: int, max_row: int, max_col: int) -> str:
    return f"{column_letters(min_col)}{min_row}:{column_letters(max_col)}{max_row}"


def letters_column(index: Column) -> Column:
    """Letters of a column number 1 to 18278, as an expression."""
    letter = lambda n: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n.cast("int") + 1, F.lit(1))
    one = letter((index - 1) % 26)
    two = letter(F.floor((index - 27) / 26) % 26)
    three = letter(F.floor((index - 703) / 676) % 26)
    return F.when(index <= 26, one).when(index <= 702, F.concat(two, one)).otherwise(F.concat(three, two, one))


def index_column(letters: Column) -> Column:
    chars = F.filter(F.split(F.upper(letters), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64)


def cell_text(row: Column, col: Column) -> Column:
    return F.concat(letters_column(col), row.cast("string"))
