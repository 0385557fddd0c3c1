"""Labels in, score cards out: label files, JSON and HTML summaries, a log of repair passes."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL = (
    "workbook string, rel_path string, difficulty string, domain string, traps array<string>, sheets array<string>, business_logic string, "
    "tables array<struct<table_id:string,name:string,sheet:string,region:string,header_region:string,data_region:string,orientation:string,columns:array<struct<label:string,col_index:int,col_letter:string,dtype:string,unit:string>>,"
    "row_keys:array<struct<label:string,row_index:int>>,cells:array<struct<row_label:string,col_label:string,cell_ref:string,value:string,raw:string,is_formula:boolean>>,traps:array<string>,is_duplicate_of:string>>, "
    "measures array<struct<semantic_name:string,aliases:array<string>,table_id:string,row_label:string,col_label:string,unit:string,value:string>>, "
    "samples array<struct<id:string,type:string,sheet:string,table_id:string,table_name:string,table:string,query:string,row_label:string,col_label:string,dtype:string,tolerance:double,min_iou:double,expected_value:string,expected_region:string,"
    "expected_cell_ref:string,expected_table_id:string,expected_row_label:string,expected_col_label:string,description:string,expression:string,operands:map<string,string>,inputs:map<string,double>>>"
)


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label files, one workbook each; values of mixed type stay text."""
    return spark.read.schema(LABEL).option("multiLine", True).json(folder)


def write_log(frame: DataFrame, path: str) -> None:
    """Append records, such as those of repair passes, as JSON lines."""
    frame.write.mode("append").json(path)


def card_json(card: DataFrame) -> str:
    """A score card, which has a row per group, as JSON."""
    return json.dumps([r.asDict(recursive=True) for r in card.collect()], default=str)


def bar(share: float, width: int = 20) -> str:
    full = round(width * max(0.0, min(1.0, share)))
    return "#" * full + "." * (width - full)


def card_text(card: DataFrame, title: str, rate: str = "rate", failing: DataFrame | None = None, most: int = 20) -> str:
    """A score card for a console: a bar for each group, then the first failing samples."""
    names = [c for c in card.columns if c != rate]
    lines = [title, "=" * len(title)]
    for r in card.orderBy(*(F.col(c).asc_nulls_first() for c in names)).collect():
        share = float(r[rate] if r[rate] is not None else 1.0)
        lines.append("  ".join([bar(share), f"{share:7.1%}", *("all" if r[c] is None else str(r[c]) for c in names)]))
    if failing is not None:
        lines += ["", "failing:"] + [f"  {r.sample_id}: expected {r.expected}, got {r.got} ({r.detail})" for r in failing.where("not passed").orderBy("sample_id").limit(most).collect()]
    return "\n".join(lines)


def failing_html(scored: DataFrame, most: int = 200) -> str:
    """The failing samples, one block for each workbook."""
    out, at = [], None
    for r in scored.where("not passed").orderBy("workbook", "sample_id").limit(most).collect():
        if r.workbook != at:
            at = r.workbook
            out.append(f"<h2>{html.escape(str(at))}</h2>")
        out.append(f"<p>{html.escape(str(r.sample_id))}: expected <b>{html.escape(str(r.expected))}</b>, got <b>{html.escape(str(r.got))}</b> {html.escape(str(r.detail))}</p>")
    return "".join(out)


def card_html(card: DataFrame, title: str, rate: str = "rate", width: int = 200) -> str:
    """A score card as a table with a bar for each rate."""
    names = [c for c in card.columns if c != rate]
    rows = []
    for r in card.orderBy(*(F.col(c).asc_nulls_first() for c in names)).collect():
        cells = "".join(f"<td>{html.escape('all' if r[c] is None else str(r[c]))}</td>" for c in names)
        share = float(r[rate] or 0)
        rows.append(f'<tr>{cells}<td><div style="background:#4a7;height:1em;width:{round(width * share)}px"></div>{share:.1%}</td></tr>')
    head = "".join(f"<th>{html.escape(c)}</th>" for c in [*names, rate])
    return f"<h1>{html.escape(title)}</h1><table><tr>{head}</tr>{''.join(rows)}</table>"
