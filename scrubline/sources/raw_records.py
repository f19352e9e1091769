"""Delimited records with their failures, and the valid rows.

A record is read by Python's strict csv reader together with its file's header
and delimiter. What breaks the structure is caught there, before any field gets
a type; fields of the amount and the signup date are then judged by their value.
"""

from __future__ import annotations

import csv
import datetime as dt
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.session import cut, only

csv.field_size_limit(2**31 - 1)

# Words that name a column's role, most telling first; a column with a word of the second list has another role.
ROLES = {
    "amount": (("amount", "amt", "order value", "order total", "net total", "gross val", "gross value", "grand total", "total", "value", "price", "sum", "due"), ("points", "balance", "weight", "discount", "rate", "date")),
    "signup_date": (("signup", "sign up", "joined", "joining", "member since", "registered", "registration", "onboarding", "onboarded", "customer since"), ("last",)),
    "customer_name": (("customer name", "cust nm", "cust name", "account holder", "buyer", "full name", "client", "customer", "name"), ("manager", "user", "file")),
    "city": (("city", "town", "place", "locality"), ()),
    "email": (("email", "e mail", "mail"), ()),
    "phone": (("phone", "tel", "mobile", "contact number", "contact no"), ()),
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MISSING = ("n/a", "null")
_CURRENCY = r"(?:[₹$€£¥]|rs\.?|[a-z]{3})"
AMOUNT = re.compile(rf"[+-]?\(?[+-]?\s*(?:{_CURRENCY}\s*)?[+-]?\s*(?:\d+|\d{{1,3}}(?:,\d{{2,3}})*,\d{{3}})(?:\.\d+)?\s*(?:/-)?\s*(?:{_CURRENCY})?\s*\)?[+-]?", re.I)
_YEAR_FIRST = re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})")
_YEAR_LAST = re.compile(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})")
_NAMED = re.compile(r"(?:[a-z]{3,9},? )?(?:(\d{1,2})(?:st|nd|rd|th)?[ -]([a-z]{3,9})\.?,?[ -](\d{4}|\d{2})|([a-z]{3,9})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4}))", re.I)
PARSED = "line_id long, file_id long, line_no int, fields array<string>, types array<string>, reason string, amount string, signup_type string"
#: Parts into which the lines of one file are spread where they meet the few rows that hold for the whole file.
FILE_PARTS = 16


def plain_name(name: str) -> str:
    """A column's name without letter case, accents, blanks and punctuation."""
    return "".join(c for c in unicodedata.normalize("NFKD", name.casefold()) if c.isalnum())


@lru_cache(4096)
def role_columns(header: tuple[str, ...]) -> dict[str, int]:
    """The place of the column of each role in a header."""
    spaced = [" ".join(re.findall(r"[^\W_]+", name.casefold())) for name in header]
    found: dict[str, int] = {}
    for role, (names, others) in ROLES.items():
        fits = [(k, i) for i, name in enumerate(spaced) if i not in found.values() and not any(re.search(rf"\b{o}", name) for o in others) for k, w in enumerate(names) if re.search(rf"\b{w}", name)]
        if fits:
            found[role] = min(fits)[1]
    return found


def _day(year: str, month: int, day: int) -> dt.date | None:
    try:
        return dt.date(int(year) + (2000 if len(year) == 2 else 0), month, day)
    except ValueError:
        return None


@lru_cache(65536)
def calendar_days(value: str) -> tuple[dt.date, ...]:
    """The real days that value may mean: two where day and month can be swapped, none if it is no day."""
    value = " ".join(value.split())
    if m := _YEAR_FIRST.fullmatch(value):
        days = [_day(m[1], int(m[3]), int(m[4]))]
    elif m := _YEAR_LAST.fullmatch(value):
        days = [_day(m[4], int(m[3]), int(m[1])), _day(m[4], int(m[1]), int(m[3]))]
    elif m := _NAMED.fullmatch(value):
        day, month, year = (m[1], m[2], m[3]) if m[1] else (m[5], m[4], m[6])
        days = [_day(year, MONTHS.index(month[:3].lower()) + 1, int(day))] if month[:3].lower() in MONTHS else []
    else:
        days = []
    return tuple(dict.fromkeys(d for d in days if d))


@lru_cache(65536)
def value_type(value: str) -> str:
    """integer, decimal, boolean, date or text; empty for a blank value."""
    value = value.strip()
    if not value:
        return ""
    if re.fullmatch(r"[+-]?\d+", value):
        return "integer"
    if re.fullmatch(r"[+-]?\d+\.\d+", value):
        return "decimal"
    if value.lower() in ("true", "false", "yes", "no"):
        return "boolean"
    return "date" if calendar_days(value) else "text"


def signup_kind(value: str) -> str:
    """The type of a signup date; for days that can be read in one order only, that order too."""
    kind = value_type(value)
    if kind == "date" and (m := _YEAR_LAST.fullmatch(" ".join(value.split()))):
        return "day_first" if int(m[1]) > 12 else "month_first" if int(m[3]) > 12 else kind
    return kind


def is_amount(value: str) -> bool:
    """Whether a value is empty, marked as not available, or one amount."""
    value = value.strip()
    if not value or value.lower() in MISSING:
        return True
    signs = sum(value.replace("/-", "").count(s) for s in "+-")
    return signs <= 1 and value.count("(") == value.count(")") and bool(AMOUNT.fullmatch(value))


@lru_cache(64)
def _quoted(delimiter: str) -> re.Pattern:
    d = re.escape(delimiter)
    return re.compile(rf'(?<![^{d}])"(?:[^"]|"")*"(?={d}|\Z)')


def read_record(text: str, delimiter: str) -> tuple[list[str] | None, str | None]:
    """The fields of one record, or the reason why it has none."""
    try:
        rows = list(csv.reader([text], delimiter=delimiter, strict=True))
    except csv.Error:
        # The reader also rejects line breaks outside quotes; those are no fault of quoting.
        return (None, "quoting") if '"' in _quoted(delimiter).sub("", text) else (None, "column_count")
    # The reader lets quotes pass inside fields that don't begin with one.
    if '"' in text and '"' in _quoted(delimiter).sub("", text):
        return None, "quoting"
    return (rows[0] if rows and rows[0] else [""]), None


def _parse(whole: bool) -> Callable:
    """The parser of records; whole keeps their fields with the types."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.string())] * 2, *[pa.string()] * 3]
        names = [x.split()[0] for x in PARSED.split(", ")]
        for batch in batches:
            rows = []
            for line, file, no, text, delimiter, head in zip(*(c.to_pylist() for c in batch.columns)):
                header = header_fields(head, delimiter or ",") if head is not None else None
                fields, reason = read_record(text or "", delimiter or ",")
                amount = signup = None
                if header and fields and len(fields) != len(header):
                    fields, reason = None, "column_count"
                if header and fields:
                    roles = role_columns(header)
                    amount = fields[roles["amount"]] if "amount" in roles else None
                    signup = fields[roles["signup_date"]] if "signup_date" in roles else None
                    if amount is not None and not is_amount(amount):
                        reason = "bad_amount"
                types = [value_type(x) for x in fields] if whole and fields and header and reason is None else None
                rows.append((line, file, no, fields if whole else None, types, reason, amount if whole else None, signup_kind(signup) if signup is not None else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return run


@lru_cache(4096)
def header_fields(text: str, delimiter: str) -> tuple[str, ...]:
    return tuple(read_record(text, delimiter)[0] or ())


def by_file(rows: DataFrame, table: DataFrame, how: str = "left") -> DataFrame:
    """rows joined by file_id to a table of one row a file, with the lines of each file in several parts, so that a huge file is no hot key."""
    part = F.pmod(F.xxhash64("line_id"), F.lit(FILE_PARTS)).cast("int")
    spread = table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(FILE_PARTS - 1))))
    return rows.withColumn("_part", part).join(spread, ["file_id", "_part"], how).drop("_part")


def file_heads(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, head, delimiter) of each file that is known or has a header."""
    raw = only(lines, {"line_id": "bigint", "file_id": "bigint", "line_no": "int", "raw_text": "string"})
    heads = raw.filter("line_no = 1").groupBy("file_id").agg(F.min_by("raw_text", "line_id").alias("head"))
    return heads.join(only(files, {"file_id": "bigint", "delimiter": "string"}).dropDuplicates(["file_id"]), "file_id", "full")


def parsed_lines(files: DataFrame, lines: DataFrame, whole: bool = True) -> DataFrame:
    """Every line after a file's header with its fields, their types, and the reason why it fails.

    Columns: line_id, file_id, line_no, fields, types, reason, amount; without whole
    the fields, types and amounts are left out. fields is null where the structure is
    broken, types where the line fails or its file has no header. reason is null for a
    valid line, else the first that applies of: quoting, column_count, bad_amount,
    bad_date. A null text counts as an empty line; lines of a file without header
    are judged by their quotes alone; lines of unknown files are split at commas.
    """
    raw = only(lines, {"line_id": "bigint", "file_id": "bigint", "line_no": "int", "raw_text": "string"})
    rows = by_file(raw.filter("line_no > 1"), file_heads(files, lines)).select("line_id", "file_id", "line_no", "raw_text", "delimiter", "head")
    # Read once; what all lines of a file say about its dates is then joined to what was read.
    parsed = cut(rows.mapInArrow(_parse(whole), PARSED))
    # In a file whose signup column holds dates, a value that is none is an error, and so is a day in the order that the file doesn't use.
    votes = parsed.filter("reason is null and signup_type <> ''")
    dates = F.col("signup_type").isin("date", "day_first", "month_first")
    count = lambda test: F.sum(test.cast("bigint"))
    kinds = votes.groupBy("file_id").agg(count(dates).alias("date"), *(count(F.col("signup_type") == k).alias(k) for k in ("day_first", "month_first", "integer", "decimal", "boolean", "text")))
    dated = kinds.filter(F.col("date") > F.greatest("integer", "decimal", "boolean", "text")).select("file_id", F.lit(True).alias("dated"), "day_first", "month_first")
    turned = (F.col("signup_type") == "month_first") & (F.col("day_first") > F.col("month_first")) | (F.col("signup_type") == "day_first") & (F.col("month_first") > F.col("day_first"))
    bad = F.col("reason").isNull() & F.col("dated").isNotNull() & (F.col("signup_type") != "") & (~dates | turned)
    return by_file(parsed, dated).select("line_id", "file_id", "line_no", "fields", "types", F.when(bad, "bad_date").otherwise(F.col("reason")).alias("reason"), "amount")


def failing_lines(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(line_id, reason) of each line after a header that cannot be loaded; rows are distinct."""
    return parsed_lines(files, lines, whole=False).filter("reason is not null").select("line_id", "reason").distinct()


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        file, head, delimiter = (c.to_pylist() for c in batch.columns)
        made = [list(header_fields(h, d or ",")) for h, d in zip(head, delimiter)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.string()))], names=["file_id", "header"])


def headers(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, header): the column names of each file that has a header."""
    return file_heads(files, lines).filter("head is not null").select("file_id", "head", "delimiter").mapInArrow(_names, "file_id long, header array<string>")


def valid_rows(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(line_id, file_id, line_no, amount, values): each valid line, values by the header's column names.

    amount is the number of the amount column, in whatever notation, or null.
    """
    rows = by_file(parsed_lines(files, lines).filter("types is not null and reason is null"), headers(files, lines), "inner")
    # Names may repeat in a header; the first column of a name holds.
    distinct = F.array_distinct("header")
    values = F.map_from_arrays(distinct, F.transform(distinct, lambda h: F.get("fields", F.array_position("header", h).cast("int") - 1)))
    return rows.select("line_id", "file_id", "line_no", amount_value("amount").alias("amount"), values.alias("values"))


def amount_value(column: str):
    """The number in an amount: brackets or a minus make it negative."""
    text = F.col(column)
    number = F.regexp_replace(F.regexp_extract(text, r"[0-9][0-9,]*(?:\.[0-9]+)?", 0), ",", "").try_cast("double")
    return F.when(text.rlike(r"\(|-\s*(?:[^/0-9-]*)\d|\d\s*-"), -number).otherwise(number)
