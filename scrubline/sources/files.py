"""Tables from files, and tables to files."""

from __future__ import annotations

import codecs
import csv
import json
import os
import shutil
import uuid
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.errors import ReadError
from scrubline.functions import columns as c
from scrubline.plans.registry import ROW_ID
from scrubline.plans.rows import with_row_id
from scrubline.sources import assembly, xlsx

# The texts that mean a missing value in a CSV file.
NA_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
SNIFF_BYTES, SNIFF_LINES, DELIMITERS = 65_536, 20, (",", ";", "\t", "|")


def checked_path(path: str | Path) -> Path:
    """path, if there is something to read."""
    found = Path(path)
    if not found.exists():
        raise ReadError(f"{path} does not exist")
    if found.is_file() and found.stat().st_size == 0:
        raise ReadError(f"{path} is empty")
    return found


def sniff_encoding(path: str | Path) -> tuple[str, str]:
    """The encoding of a text file by its beginning, and that beginning."""
    with open(path, "rb") as file:
        head = file.read(SNIFF_BYTES)
    if b"\0" in head:
        raise ReadError(f"{path} is no text file of one byte a character")
    try:
        # The last character may be cut in two.
        return "utf-8-sig", codecs.getincrementaldecoder("utf-8-sig")().decode(head, final=len(head) < SNIFF_BYTES)
    except UnicodeDecodeError:
        return "cp1252", head.decode("cp1252", "replace")


def sniff_delimiter(lines: Sequence[str]) -> str:
    """The delimiter that splits all first lines into the same number of fields; the comma wins, any other tie is an error."""
    fits = []
    for d in DELIMITERS:
        counts = {len(r) for r in csv.reader(lines, delimiter=d) if r}
        if len(counts) == 1 and min(counts) > 1:
            fits.append(d)
    if not fits or "," in fits:
        return ","
    if len(fits) > 1:
        raise ReadError(f"the delimiter may be any of {' '.join(map(repr, fits))}")
    return fits[0]


def csv_options(path: str | Path) -> dict[str, Any]:
    """encoding, sep and skiprows of a CSV file where they are not the usual ones; to be pinned in a recipe."""
    encoding, text = sniff_encoding(checked_path(path))
    lines = text.splitlines()
    blank = next((i for i, x in enumerate(lines) if x.strip()), 0)
    found = {"encoding": encoding, "sep": sniff_delimiter(lines[blank : blank + SNIFF_LINES]), "skiprows": blank}
    return {k: v for k, v in found.items() if v != {"encoding": "utf-8-sig", "sep": ",", "skiprows": 0}[k]}


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns as integers, decimals or booleans where all their values are; one aggregation decides. Dates stay text."""
    names = [x for x in df.columns if x != ROW_ID]
    if not names:
        return df
    tests, kinds = [], ("bigint", "double", "boolean")
    for i, n in enumerate(names):
        v = F.col(f"`{n}`")
        whole = v.rlike(r"^\s*[+-]?\d{1,19}\s*$") & F.trim(v).try_cast("bigint").isNotNull()
        # A number with missing neighbours is a decimal, as in a data frame.
        tests += [F.coalesce(F.every(whole), F.lit(False)).alias(f"a{i}"), F.coalesce(F.every(c.to_numeric(v).isNotNull() | v.isNull()), F.lit(False)).alias(f"b{i}"), F.coalesce(F.every(v.isin("True", "False", "true", "false", "TRUE", "FALSE") | v.isNull()), F.lit(False)).alias(f"c{i}"), (F.count(v) > 0).alias(f"d{i}")]
    row = df.agg(*tests).first()
    made = []
    for i, n in enumerate(names):
        v = F.col(f"`{n}`")
        kind = next((k for k, t in zip(kinds, "abc") if row[f"d{i}"] and row[f"{t}{i}"]), None)
        made.append((F.trim(v).try_cast("bigint") if kind == "bigint" else c.to_numeric(v) if kind == "double" else F.lower(v).try_cast("boolean") if kind else v).alias(n))
    return df.select(*made, *([ROW_ID] if ROW_ID in df.columns else []))


def _read_csv(spark: SparkSession, path: Path, sep: str, encoding: str, skip: int, text_only: bool) -> DataFrame:
    # The reader knows few character sets; cp1252 is latin-1 but for the codes from 128 to 159.
    charset = {"utf-8-sig": "UTF-8", "cp1252": "ISO-8859-1"}.get(encoding, encoding)
    first = path if path.is_file() else sorted(x for x in path.rglob("*") if x.is_file() and x.name[0] not in "._")[0]
    with open(first, encoding=encoding, newline="") as file:
        # The reader passes over blank lines by itself.
        first_lines = [x for x in (file.readline() for _ in range(skip)) if x.strip()]
        names = next(csv.reader(file, delimiter=sep), [])
    if not names or len(set(names)) < len(names):
        raise ReadError(f"{path} has no unique column names")
    lines = assembly.file_lines(spark, str(path), charset)
    if assembly.crosses_lines(lines, sep):
        # Some record holds a line break: records are assembled, and keep their numbers.
        made = assembly.split_fields(assembly.whole_records(lines, sep, len(first_lines) + 1), sep)
        if path.is_file():
            _no_longer(made.filter(F.size("fields") > len(names)).select(F.array_join("fields", sep).alias("_corrupt")), path)
        made = made.select(*(F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)), F.col("record_no").alias(ROW_ID))
        made = _mapped(made, names, encoding)
        return made if text_only else infer_types(made)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_corrupt"]])
    reader = spark.read.schema(schema).option("sep", sep).option("encoding", charset).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    if first_lines:
        # Lines before the header: records are numbered, and those up to the header left out.
        rows = with_row_id(reader.option("header", False).csv(str(path))).filter(F.col(ROW_ID) > len(first_lines)).drop(ROW_ID)
        made = _mapped(rows, names, encoding)
        return made if text_only else infer_types(made)
    df = reader.option("header", True).option("enforceSchema", True).csv(str(path))
    if path.is_file():
        # Long and short lines are both marked; short ones are filled with nulls at their end, long ones are an error.
        _no_longer(df.filter(F.col("_corrupt").isNotNull() & F.col(f"`{names[-1]}`").isNotNull()), path)
    made = _mapped(df, names, encoding)
    return made if text_only else infer_types(made)


def _no_longer(longer: DataFrame, path: Path) -> None:
    for row in longer.limit(1).collect():
        raise ReadError(f"{path}: a line has more fields than the header: {row['_corrupt'][:80]!r}")


def _mapped(df: DataFrame, names: list[str], encoding: str) -> DataFrame:
    latin = bytes(range(128, 160))
    fixed = lambda v: F.translate(v, latin.decode("latin-1"), latin.decode("cp1252", "replace")) if encoding == "cp1252" else v
    return df.select(*(F.when(~F.col(f"`{n}`").isin(*NA_TEXTS), fixed(F.col(f"`{n}`"))).alias(n) for n in names), *([ROW_ID] if ROW_ID in df.columns else []))


def read_table(spark: SparkSession, source: str | Path | DataFrame, *, sheet: str | None = None, columns: Sequence[str] | None = None, nrows: int | None = None, skiprows: int | Sequence[int] | None = None, sep: str | None = None, encoding: str | None = None, infer: bool = True, numbered: bool = False) -> DataFrame:
    """A table from a CSV, TSV, text, Excel, Parquet or JSON file, or a DataFrame as it is.

    columns keeps those columns in the file's order; nrows the first rows; skiprows
    leaves out rows by number (CSV: line numbers with the header as line 0, others:
    row numbers), or that many lines before the header (CSV) or rows (others).
    numbered keeps the number of a row where reading the file gave it one, as for
    records with line breaks.
    """
    if isinstance(source, DataFrame):
        if sheet is not None or nrows is not None or skiprows is not None:
            raise ReadError("sheet, nrows and skiprows are for files")
        return _picked(source, columns)
    path = checked_path(source)
    suffix = path.suffix.lower()
    offset = 0
    try:
        if suffix in (".xlsx", ".xlsm", ".xls"):
            names = xlsx.sheet_names(path)
            if sheet is None and len(names) > 1:
                raise ReadError(f"{path} has several sheets: {', '.join(names)}")
            df = xlsx.read_sheet(spark, path, sheet or names[0])
        elif suffix == ".parquet":
            df = spark.read.parquet(str(path))
        elif suffix in (".json", ".jsonl", ".ndjson"):
            df = spark.read.option("multiLine", suffix == ".json").json(str(path))
        else:
            found = csv_options(path) if path.is_file() and (sep is None or encoding is None) and suffix != ".tsv" else {}
            lines = skiprows if isinstance(skiprows, int) else found.get("skiprows", 0)
            df = _read_csv(spark, path, sep or ("\t" if suffix == ".tsv" else found.get("sep", ",")), encoding or found.get("encoding", "utf-8-sig"), lines or 0, not infer)
            skiprows = None if isinstance(skiprows, int) else skiprows
            offset = 1
    except PySparkException as e:
        raise ReadError(f"{path} cannot be read: {str(e)[:300]}") from e
    except (OSError, UnicodeDecodeError, csv.Error, ValueError) as e:
        raise ReadError(f"{path} cannot be read: {e}") from e
    df = _picked(df, columns) if columns is not None else df
    if skiprows is not None or nrows is not None:
        rows = with_row_id(df)
        if isinstance(skiprows, int):
            rows = rows.filter(F.col(ROW_ID) >= skiprows).withColumn(ROW_ID, F.col(ROW_ID) - skiprows)
        elif skiprows is not None:
            gone = sorted({x - offset for x in skiprows if x - offset >= 0})
            if gone:
                before = F.size(F.filter(F.array(*map(F.lit, gone)), lambda x: x < F.col(ROW_ID)))
                rows = rows.filter(~F.col(ROW_ID).isin(*gone)).withColumn(ROW_ID, F.col(ROW_ID) - before)
        df = rows.filter(F.col(ROW_ID) < nrows) if nrows is not None else rows
        return df if numbered else df.drop(ROW_ID)
    return df if numbered else df.drop(ROW_ID)


def _picked(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    if columns is None:
        return df
    if missing := [x for x in columns if x not in df.columns]:
        raise ReadError(f"no columns {', '.join(missing)}")
    return df.select(*(F.col(f"`{x}`") for x in df.columns if x in {*columns, ROW_ID}))


def sanitised(df: DataFrame) -> DataFrame:
    """df with texts that a spreadsheet would run made harmless."""
    return df.select(*(c.escape_formula(F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes))


def write_table(df: DataFrame, path: str | Path, sanitize: bool = True, single: bool = True) -> None:
    """A table as CSV, TSV, Excel, Parquet or JSON, by the suffix.

    single=True gives one file in row order, written beside its place and moved
    there when complete; single=False gives a folder of parts, which is what scales.
    """
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    suffix = path.suffix.lower()
    ordered = df.orderBy(ROW_ID).drop(ROW_ID) if ROW_ID in df.columns else df
    if suffix == ".xlsx":
        xlsx.write_book(path, {"Sheet1": sanitised(ordered) if sanitize else ordered})
        return
    if suffix == ".json" and single:
        work = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
        with open(work, "w", encoding="utf-8", newline="\n") as file:
            file.write("[")
            for i, text in enumerate(ordered.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()):
                file.write(("," if i else "") + "\n" + json.dumps(json.loads(text[0]), indent=2, ensure_ascii=False))
            file.write("\n]\n")
        os.replace(work, path)
        return
    work = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    try:
        out = ordered.coalesce(1) if single else ordered
        if suffix == ".parquet":
            out.write.parquet(str(work))
        elif suffix in (".json", ".jsonl", ".ndjson"):
            out.write.option("ignoreNullFields", False).json(str(work))
        else:
            flat = sanitised(out) if sanitize else out
            flat = flat.select(*(c.number_text(F.col(f"`{n}`")).alias(n) if t in ("double", "float") else F.initcap(F.col(f"`{n}`").cast("string")).alias(n) if t == "boolean" else F.col(f"`{n}`") for n, t in flat.dtypes))
            flat.write.option("header", True).option("sep", "\t" if suffix == ".tsv" else ",").option("lineSep", "\n").option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(str(work))
        if single:
            parts = sorted(x for x in work.iterdir() if x.name.startswith("part-"))
            if parts:
                os.replace(parts[0], path)
            else:
                path.write_text(("\t" if suffix == ".tsv" else ",").join(df.columns) + "\n", "utf-8")
        else:
            shutil.rmtree(path, ignore_errors=True)
            os.replace(work, path)
    finally:
        shutil.rmtree(work, ignore_errors=True)


def write_text(path: str | Path, text: str) -> None:
    """A text in UTF-8 with plain line ends."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="\n") as file:
        file.write(text)
