"""Office files: sheets as rows of cells, text documents as Markdown lines."""

from __future__ import annotations

import io
import posixpath
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import segment

#: fixed values: blank rows that part two blocks, paragraphs of a block
BLANK_ROWS, PARAGRAPHS = 2, 15
#: Bytes that an office file may inflate to.
INFLATED = 200 << 20


def _parts(content: bytes, needed: str) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(content))
    if sum(i.file_size for i in z.infolist()) > INFLATED:
        raise ValueError("inflates beyond the limit")
    if needed not in z.namelist():
        raise ValueError(f"has no part {needed}")
    return z


def _named(tree: ElementTree.Element, tag: str) -> Iterator[ElementTree.Element]:
    return (x for x in tree.iter() if x.tag.rpartition("}")[2] == tag)


def _attribute(x: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in x.attrib.items() if k.rpartition("}")[2] == name), None)


def column_number(reference: str) -> int:
    """1 for A, 27 for AA."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n


def workbook_cells(content: bytes) -> Iterator[tuple[int, str, int, int, str]]:
    """``sheet number, sheet, row, column, text`` of the cells that hold something; formulas by their stored values."""
    z = _parts(content, "xl/workbook.xml")
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in _named(si, "t")) for si in _named(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")]
    places = {_attribute(r, "Id"): _attribute(r, "Target") for r in _named(ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")), "Relationship")}
    for number, sheet in enumerate(_named(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet")):
        target = places[_attribute(sheet, "id")]
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        for cell in _named(ElementTree.fromstring(z.read(path)), "c"):
            value = next((v.text for v in _named(cell, "v")), None)
            kind = cell.get("t", "n")
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in _named(cell, "t"))
            elif value is None:
                continue
            else:
                text = shared[int(value)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}[value] if kind == "b" else value
            if text.strip():
                yield number, sheet.get("name"), int(re.search(r"\d+", cell.get("r"))[0]), column_number(cell.get("r")), unicodedata.normalize("NFKC", text).replace("\n", " ").replace("|", "\\|")


def cells(items: DataFrame) -> DataFrame:
    """``name, reason, sheet_no, sheet, row, col, text``: a row per cell of each file, or one with the reason it can't be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for name, content in zip(df["name"], df["content"]):
                try:
                    rows = [(name, None, *c) for c in workbook_cells(content)] or [(name, "workbook has no non-empty cells", None, None, None, None, None)]
                except Exception as e:  # noqa: BLE001  outcomes are rows
                    rows = [(name, f"cannot read workbook: {e}"[:300], None, None, None, None, None)]
                yield pd.DataFrame(rows, columns=["name", "reason", "sheet_no", "sheet", "row", "col", "text"]).astype({"sheet_no": "Int64", "row": "Int64", "col": "Int64"})

    return items.select("name", "content").mapInPandas(run, "name string, reason string, sheet_no long, sheet string, row long, col long, text string")


def column_letters(n: Column) -> Column:
    """A for 1, AA for 27, up to three letters."""
    letter = lambda x: F.char((F.lit(65) + x).cast("int"))
    one, two = n - 1, n - 27
    return F.when(n <= 26, letter(one)).when(n <= 702, F.concat(letter(F.floor(two / 26)), letter(two % 26))).otherwise(F.concat(letter(F.floor((n - 703) / 676)), letter(F.floor((n - 703) / 26) % 26), letter((n - 703) % 26)))


def sheet_units(found: DataFrame) -> DataFrame:
    """``name, position, locator, heading_path, text``: blocks of cells parted by ``BLANK_ROWS`` blank rows or more.

    A block is a table with the column letters as its header and the row numbers
    as its first column; its locator is ``file#sheet!A3:F40``.
    """
    c = found.filter("reason is null")
    rows = c.groupBy("name", "sheet_no", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("cells"), F.min("col").alias("low"), F.max("col").alias("high"))
    w = Window.partitionBy("name", "sheet_no").orderBy("row")
    new = F.coalesce((F.col("row") - F.lag("row").over(w) > BLANK_ROWS).cast("int"), F.lit(0))
    numbered = rows.withColumn("new", new).withColumn("block", F.sum("new").over(w))
    blocks = numbered.groupBy("name", "sheet_no", "sheet", "block").agg(F.min("low").alias("left"), F.max("high").alias("right"), F.min("row").alias("top"), F.max("row").alias("bottom"), F.map_from_entries(F.collect_list(F.struct("row", "cells"))).alias("by_row"))
    columns, numbers = F.sequence("left", "right"), F.sequence("top", "bottom")
    line = lambda first, middle: F.concat(F.lit("| "), first, F.lit(" | "), F.array_join(middle, " | "), F.lit(" |"))
    value = lambda r, col: F.coalesce(F.try_element_at(F.try_element_at(F.col("by_row"), r), col), F.lit(""))
    head = F.concat(F.lit("| | "), F.array_join(F.transform(columns, column_letters), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|---|"), F.array_join(F.transform(columns, lambda _: F.lit("---|")), ""))
    body = F.transform(numbers, lambda r: line(r.cast("string"), F.transform(columns, lambda col: value(r, col))))
    plain = F.col("sheet").rlike(r"^[A-Za-z_][A-Za-z0-9_.]*$")
    sheet = F.when(plain, F.col("sheet")).otherwise(F.concat(F.lit("'"), F.replace("sheet", F.lit("'"), F.lit("''")), F.lit("'")))
    area = F.concat(column_letters(F.col("left")), F.col("top").cast("string"), F.lit(":"), column_letters(F.col("right")), F.col("bottom").cast("string"))
    place = F.row_number().over(Window.partitionBy("name").orderBy("sheet_no", "block"))
    return blocks.select("name", place.alias("position"), F.concat("name", F.lit("#"), sheet, F.lit("!"), area).alias("locator"), F.array("sheet").alias("heading_path"), F.concat_ws("\n", head, rule, F.array_join(body, "\n")).alias("text"))


def document_lines(content: bytes) -> list[str]:
    """A text document as Markdown lines: headings with their signs, a blank line after each paragraph."""
    out = []
    for p in _named(ElementTree.fromstring(_parts(content, "word/document.xml").read("word/document.xml")), "p"):
        style = next((_attribute(s, "val") or "" for s in _named(p, "pStyle")), "")
        text = unicodedata.normalize("NFKC", "".join("\n" if x.tag.endswith("}br") else x.text or "" for x in p.iter() if x.tag.endswith(("}t", "}br")))).strip()
        level = re.fullmatch(r"[Hh]eading ?([1-6])", style)
        if text:
            out += [("#" * int(level[1]) + " " + text.replace("\n", " ")) if level else text, ""]
    return "\n".join(out).split("\n")


def document_units(name: str, content: bytes) -> list[tuple[str, list[str], str]]:
    """``locator, heading path, text``: sections under headings, other text in blocks of ``PARAGRAPHS`` paragraphs."""

    def blocks(text: str, first: int = 1) -> list[tuple[str, list[str], str]]:
        parts = [p for p in re.split(r"\n\s*\n", text.strip()) if p.strip()]
        return [(f"{name}#para={first + k}-{first + min(k + PARAGRAPHS, len(parts)) - 1}", [], "\n\n".join(parts[k : k + PARAGRAPHS])) for k in range(0, len(parts), PARAGRAPHS)]

    out = []
    for s in segment.sections("\n".join(document_lines(content))):
        path = list(s["heading_path"])
        if not path:
            out += blocks(s["text"])
            continue
        text = s["text"].strip().partition("\n")[2].strip()  # without the heading itself
        if text:
            out.append((f"{name}#heading={' > '.join(path)}", path, text))
    return out
