"""Excel workbooks through the standard library: sheets are read and written as bounded tables on the driver."""

from __future__ import annotations

import datetime as dt
import os
import re
import uuid
import zipfile
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from scrubline.errors import ReadError

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: The rows a sheet can have at most, by the format.
MOST_ROWS = 1_048_576


def _opened(path: str | Path) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(path)
    except (zipfile.BadZipFile, OSError) as e:
        raise ReadError(f"{path} is no workbook: {e}") from e


def _sheets(book: zipfile.ZipFile) -> dict[str, str]:
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = {}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = targets[sheet.get(f"{_REL}id")]
        found[sheet.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return found


def sheet_names(path: str | Path) -> list[str]:
    """The names of the sheets, in order."""
    with _opened(path) as book:
        return list(_sheets(book))


def _column(ref: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", ref)[0]:
        number = number * 26 + ord(letter) - 64
    return number - 1


def _cells(book: zipfile.ZipFile, part: str) -> list[list]:
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in x.iter(f"{_MAIN}t")) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    rows = []
    for row in ElementTree.fromstring(book.read(part)).iter(f"{_MAIN}row"):
        values: list = []
        for i, cell in enumerate(row.iter(f"{_MAIN}c")):
            at = _column(cell.get("r")) if cell.get("r") else i
            values += [None] * (at + 1 - len(values))
            kind, v = cell.get("t"), cell.find(f"{_MAIN}v")
            if kind == "inlineStr":
                values[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
            elif v is not None and v.text is not None:
                values[at] = shared[int(v.text)] if kind == "s" else v.text == "1" if kind == "b" else v.text if kind in ("str", "e") else float(v.text) if re.search(r"[.eE]", v.text) else int(v.text)
        rows.append(values)
    return rows


def read_sheet(spark: SparkSession, path: str | Path, sheet: str) -> DataFrame:
    """One sheet; its first row names the columns. Numbers stay numbers, mixed columns become text."""
    with _opened(path) as book:
        parts = _sheets(book)
        if sheet not in parts:
            raise ReadError(f"{path} has no sheet {sheet!r}; it has {', '.join(parts)}")
        rows = _cells(book, parts[sheet])
    if not rows:
        raise ReadError(f"sheet {sheet!r} of {path} is empty")
    names = [str(x) if x is not None else f"column_{i}" for i, x in enumerate(rows[0])]
    if len(set(names)) < len(names):
        raise ReadError(f"sheet {sheet!r} of {path} has no unique column names")
    body = [(r + [None] * len(names))[: len(names)] for r in rows[1:]]
    fields = []
    for i, name in enumerate(names):
        kinds = {type(r[i]) for r in body if r[i] is not None}
        kind = T.BooleanType() if kinds == {bool} else T.LongType() if kinds == {int} and all(r[i] is not None for r in body) else T.DoubleType() if kinds and kinds <= {int, float} else T.StringType()
        for r in body:
            if r[i] is not None:
                r[i] = float(r[i]) if isinstance(kind, T.DoubleType) else str(r[i]) if isinstance(kind, T.StringType) else r[i]
        fields.append(T.StructField(name, kind))
    return spark.createDataFrame([tuple(r) for r in body], T.StructType(fields))


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value:
        return f"<c><v>{value!r}</v></c>"
    text = value.isoformat(" ") if isinstance(value, (dt.datetime, dt.date)) else str(value)
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text))}</t></is></c>'


def sheet_titles(names: list[str]) -> list[str]:
    """The names as sheets may have them: at most 31 characters, and still different."""
    titles = [re.sub(r"[\[\]:*?/\\]", "_", n)[:31] for n in names]
    if len({t.lower() for t in titles}) < len(titles):
        raise ReadError(f"sheets would have the same name: {', '.join(titles)}")
    return titles


def write_book(path: str | Path, sheets: dict[str, DataFrame]) -> None:
    """Tables as the sheets of one workbook, row by row; more rows than a sheet can have are an error."""
    titles = sheet_titles(list(sheets))
    work = Path(path).with_name(f".{Path(path).name}.{uuid.uuid4().hex}")
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(titles) + 1))
    try:
        with zipfile.ZipFile(work, "w", zipfile.ZIP_DEFLATED) as book:
            head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            book.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
            book.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>' + "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, t in enumerate(titles, 1)) + "</sheets></workbook>")
            book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(titles) + 1)) + "</Relationships>")
            for i, df in enumerate(sheets.values(), 1):
                with book.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as part:
                    part.write(f'{head}<worksheet xmlns="{_MAIN[1:-1]}"><sheetData><row>{"".join(map(_cell, df.columns))}</row>'.encode())
                    for n, row in enumerate(df.toLocalIterator()):
                        if n + 2 > MOST_ROWS:
                            raise ReadError(f"a sheet holds at most {MOST_ROWS} rows")
                        part.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
                    part.write(b"</sheetData></worksheet>")
        os.replace(work, path)
    finally:
        work.unlink(missing_ok=True)
