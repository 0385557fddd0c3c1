"""Workbook files as grids, with the standard library alone: a parser that runs on the executors, and a small writer.

Files are read by Spark's binary reader, so any store that Spark reaches will do; each workbook is one task's work, since the format
cannot be split. A formula and its stored value come from the same pass.
"""

from __future__ import annotations

import datetime as dt
import io
import os
import re
import zipfile
from collections.abc import Iterable, Iterator, Mapping, Sequence
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.functions.a1 import column_letters, parse_cell

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Built-in number formats that show dates or times. Fixed values.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
EPOCH = dt.datetime(1899, 12, 30)
GRID_DDL = "workbook string, sheet string, row int, cells array<struct<kind:string,num:double,int:bigint,str:string,bool:boolean,ts:timestamp_ntz,formula:string>>, sheet_idx int"
CELL_ARROW = pa.struct([("kind", pa.string()), ("num", pa.float64()), ("int", pa.int64()), ("str", pa.string()), ("bool", pa.bool_()), ("ts", pa.timestamp("us")), ("formula", pa.string())])
GRID_ARROW = pa.schema([("workbook", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.list_(CELL_ARROW)), ("sheet_idx", pa.int32())])


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{MAIN}numFmt") if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower()))}
    formats = root.find(f"{MAIN}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def _shift(formula: str, rows: int, cols: int) -> str:
    """A shared formula as it reads in another cell: relative references move along."""

    def move(m: re.Match) -> str:
        from tessella.functions.a1 import column_index

        letters = m[2] if m[1] else column_letters(column_index(m[2]) + cols)
        return f"{m[1]}{letters}{m[3]}{m[4] if m[3] else int(m[4]) + rows}"

    return re.sub(r"(?<![A-Za-z0-9_])(\$?)([A-Z]{1,3})(\$?)([0-9]+)(?![A-Za-z0-9_(])", move, formula)


def parse(data: bytes, only: frozenset[str] | None = None) -> Iterator[tuple[str, int, list[dict | None], int]]:
    """(sheet, row, cells, place of the sheet) of a workbook, sheets in their order, or of the named sheets only; a file that is no workbook raises ValueError."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ValueError("not a workbook") from e
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
    dates = _date_styles(book)
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for place, sheet in enumerate(ET.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")):
        if only is not None and sheet.get("name") not in only:
            continue
        target = targets[sheet.get(f"{LINK}id")].removeprefix("/")
        masters: dict[str, tuple[str, int, int]] = {}
        with book.open(target if target.startswith("xl/") else f"xl/{target}") as stream:
            for _, line in ET.iterparse(stream):
                if line.tag != f"{MAIN}row":
                    continue
                cells: list[dict | None] = []
                number = int(line.get("r", 0))
                for c in line.iter(f"{MAIN}c"):
                    row, col = parse_cell(c.get("r")) if c.get("r") else (number, len(cells) + 1)
                    cells += [None] * (col - 1 - len(cells))
                    cells.append(_cell(c, row, col, shared, dates, masters))
                yield sheet.get("name"), number, cells, place
                line.clear()


def _cell(c: ET.Element, row: int, col: int, shared: list[str], dates: set[int], masters: dict[str, tuple[str, int, int]]) -> dict | None:
    value, kind, f = c.findtext(f"{MAIN}v"), c.get("t", "n"), c.find(f"{MAIN}f")
    formula = None
    if f is not None:
        if f.get("t") == "shared" and f.text:
            masters[f.get("si")] = (f.text, row, col)
        if f.text:
            formula = "=" + f.text
        elif f.get("si") in masters:
            text, r, k = masters[f.get("si")]
            formula = "=" + _shift(text, row - r, col - k)
    out: dict | None = None
    if kind == "inlineStr":
        out = {"kind": "str", "str": "".join(t.text or "" for t in c.iter(f"{MAIN}t"))}
    elif value is None:
        out = None
    elif kind == "s":
        out = {"kind": "str", "str": shared[int(value)]}
    elif kind in ("str", "e"):
        out = {"kind": "str", "str": value}
    elif kind == "b":
        out = {"kind": "bool", "bool": value == "1"}
    elif kind == "d":
        out = {"kind": "ts", "ts": dt.datetime.fromisoformat(value)}
    elif int(c.get("s", 0)) in dates:
        out = {"kind": "ts", "ts": EPOCH + dt.timedelta(days=float(value))}
    elif re.fullmatch(r"-?\d{1,18}", value):
        out = {"kind": "int", "int": int(value)}
    else:
        out = {"kind": "num", "num": float(value)}
    if formula is not None:
        out = (out or {"kind": None}) | {"formula": formula}
    return out


def parse_files(files: DataFrame) -> DataFrame:
    """workbook, sheet, row, cells from (path, content), in batch or streaming. A file that cannot be read gives one row without a sheet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield from _batches(name, data)

    return files.select("path", "content").mapInArrow(run, GRID_DDL)


def read_workbooks(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """Every workbook under a path, as rows of a grid."""
    return parse_files(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path))


def _batches(name: str, data: bytes, only: frozenset[str] | None = None) -> Iterator[pa.RecordBatch]:
    try:
        rows = [(name, *r) for r in parse(data, only)]
    except (ValueError, KeyError, ET.ParseError):
        rows = [(name, None, None, None, None)]
    for low in range(0, len(rows), 5000):
        yield pa.RecordBatch.from_pydict(dict(zip(GRID_ARROW.names, map(list, zip(*rows[low : low + 5000], strict=True)), strict=True)), schema=GRID_ARROW)


class WorkbookGrid(DataSource):
    """spark.read.format("workbookgrid").load(path): the grid of one workbook, or of all under a folder, a task for each file.

    Register it once by register(spark). Options: suffix of the files (.xlsx); sheet, to read the sheet of that name only.
    """

    @classmethod
    def name(cls) -> str:
        return "workbookgrid"

    def schema(self) -> str:
        return GRID_DDL

    def reader(self, schema) -> DataSourceReader:
        return _GridReader(self.options.get("path", ""), self.options.get("suffix", ".xlsx"), self.options.get("sheet"))


class _GridReader(DataSourceReader):
    def __init__(self, path: str, suffix: str, sheet: str | None):
        self.path, self.suffix, self.only = path, suffix, None if sheet is None else frozenset([sheet])

    def partitions(self) -> list[InputPartition]:
        fs, at = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{os.path.abspath(self.path)}")
        found = fs.get_file_info(at)
        files = [found] if found.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
        return [InputPartition(f.path) for f in sorted(files, key=lambda f: f.path) if f.type == pafs.FileType.File and f.path.endswith(self.suffix)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{os.path.abspath(self.path)}")
        with fs.open_input_stream(partition.value) as stream:
            yield from _batches(partition.value, stream.read(), self.only)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookGrid)


def workbook_bytes(sheets: dict[str, list[list]], formulas: dict[tuple[str, int, int], str] | None = None, merged: dict[str, list[str]] | None = None) -> bytes:
    """A workbook of plain cells: None is empty; formulas by (sheet, row, column) are stored with the cell's value; merged: A1 ranges of each sheet that show as one cell."""
    out = io.BytesIO()
    stream_workbook(out, sheets, formulas, merged)
    return out.getvalue()


def stream_workbook(out, sheets: Mapping[str, Iterable[Sequence]], formulas: dict[tuple[str, int, int], str] | None = None, merged: dict[str, list[str]] | None = None) -> None:
    """Write a workbook to a binary stream row by row; rows may come from any iterator, such as toLocalIterator of an ordered DataFrame."""
    package, relations = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-package.relationships+xml"
    sheet_type = "application/vnd.openxmlformats-officedocument.spreadsheetml.{}+xml"
    names = list(sheets)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = [("/xl/workbook.xml", "sheet.main"), *((f"/xl/worksheets/sheet{i}.xml", "worksheet") for i in range(1, len(names) + 1))]
        kinds = "".join(f'<Override PartName="{at}" ContentType="{sheet_type.format(kind)}"/>' for at, kind in parts)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="{relations}"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{LINK[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="s{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINK[1:-1]}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="s{i}" Type="{LINK[1:-1]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN[1:-1]}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        for i, name in enumerate(names, 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as part:
                part.write(f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
                for r, line in enumerate(sheets[name], 1):
                    cells = "".join(_cell_xml(v, f"{column_letters(c)}{r}", (formulas or {}).get((name, r, c))) for c, v in enumerate(line, 1))
                    part.write(f'<row r="{r}">{cells}</row>'.encode())
                ranges = (merged or {}).get(name, [])
                joined = f'<mergeCells count="{len(ranges)}">{"".join(f"<mergeCell ref={chr(34)}{m}{chr(34)}/>" for m in ranges)}</mergeCells>' if ranges else ""
                part.write(f"</sheetData>{joined}</worksheet>".encode())


def _cell_xml(value, ref: str, formula: str | None) -> str:
    f = f"<f>{escape(formula.removeprefix('='))}</f>" if formula else ""
    if value is None:
        return f'<c r="{ref}">{f}</c>' if f else ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b">{f}<v>{int(value)}</v></c>'
    if isinstance(value, dt.datetime):
        return f'<c r="{ref}" s="1">{f}<v>{(value - EPOCH) / dt.timedelta(days=1)!r}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}">{f}<v>{value!r}</v></c>'
    if f:
        return f'<c r="{ref}" t="str">{f}<v>{escape(value)}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
