"""Readers for JSON folders, node and edge files, markdown and HTML tables, and S-expression libraries.

Files are read through Spark's readers, so any store that Spark reaches will do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType


def json_folder(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Records of the schema; files that don't parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", multi_line).json(path)


def blobs(rows: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """``(parsed, refused)`` of a table with one JSON text a row."""
    parsed = rows.withColumn("_p", F.from_json(column, f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_p").isNull() | F.col("_p._bad").isNotNull()
    names = [f.name for f in parsed.schema["_p"].dataType.fields if f.name != "_bad"]
    return parsed.filter(~bad).select(*(f"_p.{n}" for n in names)), rows.join(parsed.filter(bad).select(column), column, "left_semi")


def markdown_cells(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``grid_id, table, row, col, text, is_header`` of the pipe tables in a text, numbered from 0; the rule line isn't a row.

    Lines between pipes that follow each other are one table.
    """
    lines = texts.select(F.col(id_col).alias("grid_id"), F.posexplode(F.split(text_col, r"\r?\n")).alias("_l", "line")).filter(F.rlike(F.trim("line"), F.lit(r"^\|.*\|$")))
    by_place = Window.partitionBy("grid_id").orderBy("_l")
    begins = F.coalesce(F.col("_l") - F.lag("_l").over(by_place) > 1, F.lit(False)).cast("int")
    numbered = lines.withColumn("_b", begins).withColumn("table", F.sum("_b").over(by_place).cast("int"))
    kept = numbered.filter(~F.rlike(F.trim("line"), F.lit(r"^\|[\s:|-]+\|$"))).withColumn("row", F.row_number().over(Window.partitionBy("grid_id", "table").orderBy("_l")) - 1)
    inner = F.expr("substring(trim(line), 2, length(trim(line)) - 2)")
    return kept.select("grid_id", "table", "row", F.posexplode(F.split(inner, r"\|")).alias("col", "text")).select("grid_id", "table", "row", "col", F.trim("text").alias("text"), (F.col("row") == 0).alias("is_header"))


def vocabulary(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``source, term, pos, alias`` of vocabulary files: a line ``term:`` and its aliases below it as ``- alias`` lines, or behind it as ``[a, b]``; # begins a comment."""
    lines = texts.select(F.col(id_col).alias("source"), F.posexplode(F.split(text_col, r"\r?\n")).alias("_l", "line")).withColumn("line", F.regexp_replace("line", r"\s*(^|\s)#.*$", ""))
    over = Window.partitionBy("source").orderBy("_l").rowsBetween(Window.unboundedPreceding, 0)
    key = F.nullif(F.regexp_extract("line", r"^\s*([^\s:#-][^:]*?)\s*:", 1), F.lit(""))
    rows = lines.withColumn("term", F.last(key, True).over(over))
    inline = F.split(F.regexp_extract("line", r":\s*\[(.*)\]\s*$", 1), r"\s*,\s*")
    item = F.array(F.regexp_extract("line", r"^\s*-\s+(.*?)\s*$", 1))
    found = rows.withColumn("a", F.when(F.rlike("line", F.lit(r":\s*\[.*\]\s*$")), inline).when(F.rlike("line", F.lit(r"^\s*-\s+\S")), item)).filter("a IS NOT NULL AND term IS NOT NULL")
    plain = lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")
    each = found.select("source", "term", "_l", F.posexplode("a").alias("_i", "alias")).select("source", "term", "_l", "_i", plain(F.col("alias")).alias("alias")).filter("alias <> ''")
    order = Window.partitionBy("source", "term").orderBy("_l", "_i")
    return each.select("source", "term", (F.row_number().over(order) - 1).alias("pos"), "alias")


Cell = tuple[int, int, int, str, bool, int, int]


class _Tables(HTMLParser):
    """Places the cells of all tables of a page; a table inside a cell is a table of its own, its text not the cell's."""

    def __init__(self) -> None:
        super().__init__()
        self.count, self.cells, self.open = 0, [], []

    def _end_cell(self) -> None:
        table = self.open[-1]
        if table["cell"] is None:
            return
        (text, header, down, across), row, col = table["cell"], max(table["row"], 0), 0
        while (row, col) in table["taken"]:
            col += 1
        table["taken"] |= {(row + i, col + j) for i in range(down) for j in range(across)}
        self.cells.append((table["number"], row, col, " ".join("".join(text).split()), header, down, across))
        table["cell"] = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.open.append({"number": self.count, "row": -1, "cell": None, "taken": set()})
            self.count += 1
        elif self.open and tag == "tr":
            self._end_cell()
            self.open[-1]["row"] += 1
        elif self.open and tag in ("td", "th"):
            self._end_cell()
            given = dict(attrs)
            down, across = (min(1000, int(n)) if (n := given.get(name) or "1").isdecimal() and int(n) else 1 for name in ("rowspan", "colspan"))
            self.open[-1]["cell"] = ([], tag == "th", down, across)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cell"]:
            self.open[-1]["cell"][0].append(data)

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag in ("td", "th", "tr", "table"):
            self._end_cell()
            if tag == "table":
                self.open.pop()


_CELL = StructType([StructField("table", IntegerType()), StructField("row", IntegerType()), StructField("col", IntegerType()), StructField("text", StringType()), StructField("is_header", BooleanType()), StructField("rowspan", IntegerType()), StructField("colspan", IntegerType())])


@F.udtf(returnType=_CELL)
class HtmlCells:
    """The cells of the tables of a page, for a LATERAL join; no rows for null or a page without cells."""

    def eval(self, html: str) -> Iterator[Cell]:
        page = _Tables()
        page.feed(html or "")
        page.close()
        while page.open:  # tables that the page doesn't close
            page.handle_endtag("table")
        yield from page.cells


def html_cells(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``grid_id, table, row, col, text, is_header, rowspan, colspan`` of the cells of every page's tables, numbered from 0 as they begin; cells are placed past earlier spans.

    Cells and rows that aren't closed end with the next one, spans that aren't numbers from 1 to 1000 are 1 or 1000.
    """
    rows = pages.select(F.col(id_col).alias("grid_id"), F.col(html_col).alias("html"))
    return rows.lateralJoin(HtmlCells(F.col("html").outer())).drop("html")


_ATOM = re.compile(r'"((?:[^"\\]|\\.)*)"|([()])|([^\s()"]+)')


def s_expression(text: str) -> list:
    """Nested lists of a parenthesised text; unbalanced ends are ignored."""
    stack: list[list] = [[]]
    for quoted, bracket, atom in _ATOM.findall(text):
        if bracket == "(":
            stack.append([])
        elif bracket == ")":
            if len(stack) > 1:
                done = stack.pop()
                stack[-1].append(done)
        else:
            stack[-1].append(atom or quoted.replace('\\"', '"'))
    while len(stack) > 1:
        done = stack.pop()
        stack[-1].append(done)
    return stack[0]


def _find(node: list, name: str) -> Iterator[list]:
    for x in node:
        if isinstance(x, list):
            if x and x[0] == name:
                yield x
            yield from _find(x, name)


def symbol_pins(libraries: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """``path, symbol, pin_number, pin_name, pin_type`` of symbol libraries."""

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in frames:
            out = []
            for path, text in zip(files.path, files.text, strict=True):
                for symbol in _find(s_expression(text or ""), "symbol"):
                    if len(symbol) > 1 and isinstance(symbol[1], str) and any(isinstance(x, list) and x[:1] == ["property"] for x in symbol):
                        for pin in _find(symbol, "pin"):
                            number, name = next(_find(pin, "number"), [None, ""]), next(_find(pin, "name"), [None, ""])
                            out.append((path, symbol[1], number[1], name[1], pin[1] if len(pin) > 1 and isinstance(pin[1], str) else ""))
            yield pd.DataFrame(out, columns=["path", "symbol", "pin_number", "pin_name", "pin_type"])

    return libraries.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).mapInPandas(parsed, "path string, symbol string, pin_number string, pin_name string, pin_type string")


def footprint_boxes(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """``path, footprint, width, height, needs_review``: extent of the courtyard's lines; (0, 0) is for review."""

    def points(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            out = []
            for path, text in zip(batch.path, batch.text, strict=True):
                for fp in _find(s_expression(text or ""), "footprint"):
                    name = fp[1] if len(fp) > 1 and isinstance(fp[1], str) else ""
                    out.append((path, name, None, None))
                    for line in (x for kind in ("fp_line", "fp_rect") for x in _find(fp, kind)):
                        if any(str(layer[1:2]).find("CrtYd") >= 0 for layer in _find(line, "layer")):
                            out += [(path, name, float(p[1]), float(p[2])) for end in ("start", "end") for p in _find(line, end)]
            yield pd.DataFrame(out, columns=["path", "footprint", "x", "y"])

    xy = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).mapInPandas(points, "path string, footprint string, x double, y double")
    extent = lambda c: F.coalesce(F.max(c) - F.min(c), F.lit(0.0))
    boxes = xy.groupBy("path", "footprint").agg(extent("x").alias("width"), extent("y").alias("height"))
    return boxes.withColumn("needs_review", (F.col("width") == 0) & (F.col("height") == 0))


def library_map(parts: DataFrame, name: str, order: str) -> DataFrame:
    """One row a name, the last in ``order``."""
    over = Window.partitionBy(name).orderBy(F.col(order).desc())
    return parts.withColumn("_r", F.row_number().over(over)).filter("_r = 1").drop("_r")
