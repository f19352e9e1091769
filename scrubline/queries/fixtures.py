"""Queries over small fixed tables whose results can be written down: detection, planning, drift, streaming rules, files.

The tables are the same in every data folder, so the expected rows are values in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.plans import names, planner
from scrubline.plans.detectors import detect
from scrubline.plans.profile import profile
from scrubline.plans.recipe import Recipe
from scrubline.plans.rows import with_row_id
from scrubline.plans.schema import Schema
from scrubline.session import ship, work_folder
from scrubline.sources.files import read_table, write_table
from scrubline.streaming.replay import op_streams, replay_file, rule_streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: A table with one trouble of each kind.
NAMES = ["Customer Name", "Signup Date", "Paid Amount", "Weight", "City", "Email", "Phone", "Score", "Active", "Note"]
ROWS = [
    (" alice smith", "31/01/2024", "₹1,20,000", "1.5 kg", "Bengaluru", "A@X.com ", "+91 98765 43210", 10, "yes", "n/a"),
    ("BOB  JONES", "2024-02-15", "₹1,200", "500 g", "bengaluru", "bob@y.org", "(080) 1234-5678", 11, "no", None),
    ("charlie brown", "1 Jan 2024", "₹1200", "2 kg", "Bengaluru", "not-an-email", "080 22334455", 12, "yes", None),
    ("dan adams", "15/03/2024", "₹50,000", "750 g", "Bengalru", "dan@z.co", "+91 90000 11111", 13, "no", "unknown"),
    ("eve lin", "25/06/2024", "₹900", "3 kg", "Bengaluru", "e@w.io", "N/A", 12, "yes", None),
    ("fay moe", "20/07/2024", "₹9,999", "1 kg", "Mumbai", "f@w.io", "+91 90000 22222", 11, "no", None),
    ("gus poe", "21/07/2024", "₹700", "900 g", "Mumbai", "g@w.io", "+91 90000 33333", 12, "yes", None),
    ("hal roe", "22/07/2024", "₹800", "4 kg", "MUMBAI", "h@w.io", "12", 500, "no", None),
    ("hal roe", "22/07/2024", "₹800", "4 kg", "MUMBAI", "h@w.io", "12", 500, "no", None),
]
SCHEMA = {"columns": {"customer_name": {"dtype": "string", "required": True}, "signup_date": "date", "amount": {"dtype": "float", "min": 0, "aliases": ["Paid Amount"]}, "score": {"dtype": "integer", "unique": True}, "country": {"dtype": "string", "required": True}}}


def _literal(value: object) -> str:
    if isinstance(value, bool):
        return str(value)
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _query(name: str, columns: str, *rows: tuple) -> Callable:
    """Register a query and the rows that it must give; columns are names with their types in SQL."""
    kinds = [c.rsplit(" ", 1) for c in columns.split(", ")]
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)

    def add(function: Callable[[SparkSession], list[tuple] | DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            made = function(spark)
            return made if isinstance(made, DataFrame) else spark.createDataFrame(made, ", ".join(f"{n} {t}" for n, t in kinds))

        QUERIES[f"q_{name}"] = run
        if rows:
            casts = ", ".join(f"CAST({n} AS {({'string': 'VARCHAR', 'int': 'INTEGER'}).get(t, t)}) AS {n}" for n, t in kinds)
            SQL[f"q_{name}"] = f"SELECT {casts} FROM (VALUES {values}) t({', '.join(n for n, _ in kinds)})"
        return function

    return add


def troubled(spark: SparkSession) -> DataFrame:
    kinds = ["string"] * 10
    kinds[7] = "bigint"
    return spark.createDataFrame(ROWS, ", ".join(f"`{n}` {k}" for n, k in zip(NAMES, kinds))).coalesce(1)


def _known(spark: SparkSession) -> tuple:
    """The table with row ids, its profile and its issues; made once a session."""
    context = spark.sparkContext
    if getattr(context, "_scrubline_troubled", None) is None:
        rows = with_row_id(troubled(spark))
        known = profile(rows)
        context._scrubline_troubled = (rows, known, detect(rows, known, Schema.from_dict(SCHEMA)))
    return context._scrubline_troubled


def _detected(spark: SparkSession) -> list[tuple]:
    return [(i.source, i.column, i.kind, i.severity, float(round(i.confidence, 4)), int(i.affected)) for i in _known(spark)[2]]


def _types(spark: SparkSession) -> list[tuple]:
    return [(p.name, p.semantic_type, float(round(p.confidence, 4))) for p in _known(spark)[1].columns.values()]


def _planned(spark: SparkSession) -> list[tuple]:
    rows, known, issues = _known(spark)
    made = []
    for mode in ("review", "auto", "strict"):
        recipe = planner.RulePlanner().plan(rows, known, issues, schema=Schema.from_dict(SCHEMA), mode=mode)
        made += [(mode, c.source, c.rename_to or c.source, ", ".join(o.name for o in c.ops)) for c in recipe.columns]
        made += [(mode, "table", "table", ", ".join(o.name for o in recipe.frame_ops))]
        made += [(mode, "check", r.column, r.check) for r in recipe.validations]
    return made


#: What each column of the table is.
SEMANTIC_TYPES = (
    ('Customer Name', 'text', 0.5),
    ('Signup Date', 'date', 1.0),
    ('Paid Amount', 'currency', 1.0),
    ('Weight', 'unit', 1.0),
    ('City', 'text', 0.5),
    ('Email', 'email', 0.889),
    ('Phone', 'phone', 0.8),
    ('Score', 'integer', 1.0),
    ('Active', 'boolean', 1.0),
    ('Note', 'text', 1.0),
)
_query("semantic_types", "column_name string, semantic_type string, confidence double", *SEMANTIC_TYPES)(_types)


#: What each detector says of the table, with the number of values concerned.
DETECTED = (
    ('schema_mapping', 'Paid Amount', 'schema_mapping', 'info', 1.0, 0),
    ('schema_mapping', 'Customer Name', 'schema_mapping', 'info', 1.0, 0),
    ('schema_mapping', 'Score', 'schema_mapping', 'info', 1.0, 0),
    ('schema_mapping', 'Signup Date', 'schema_mapping', 'info', 1.0, 0),
    ('schema_mapping', 'City', 'weak_schema_match', 'warning', 0.4, 0),
    ('schema_mapping', 'Weight', 'extra_source_column', 'info', 1.0, 0),
    ('schema_mapping', 'Email', 'extra_source_column', 'info', 1.0, 0),
    ('schema_mapping', 'Phone', 'extra_source_column', 'info', 1.0, 0),
    ('schema_mapping', 'Active', 'extra_source_column', 'info', 1.0, 0),
    ('schema_mapping', 'Note', 'extra_source_column', 'info', 1.0, 0),
    ('whitespace', 'Customer Name', 'edge_whitespace', 'warning', 1.0, 1),
    ('whitespace', 'Customer Name', 'repeated_whitespace', 'warning', 1.0, 1),
    ('whitespace', 'Email', 'edge_whitespace', 'warning', 1.0, 1),
    ('nulls', 'Phone', 'disguised_nulls', 'warning', 1.0, 1),
    ('nulls', 'Note', 'disguised_nulls', 'warning', 1.0, 1),
    ('nulls', 'Note', 'ambiguous_nulls', 'warning', 0.45, 1),
    ('nulls', 'Note', 'missing_values', 'warning', 1.0, 7),
    ('dates', 'Signup Date', 'mixed_dates', 'warning', 0.9, 9),
    ('currency', 'Paid Amount', 'currency_as_text', 'warning', 0.95, 9),
    ('emails', 'Email', 'messy_emails', 'warning', 0.95, 1),
    ('emails', 'Email', 'invalid_emails', 'error', 0.9, 1),
    ('phones', 'Phone', 'messy_phones', 'warning', 0.8, 7),
    ('phones', 'Phone', 'invalid_phones', 'warning', 0.9, 3),
    ('units', 'Weight', 'mixed_units', 'warning', 0.9, 9),
    ('categories', 'City', 'category_variants', 'warning', 0.7, 4),
    ('text_case', 'Customer Name', 'inconsistent_case', 'info', 0.55, 9),
    ('text_case', 'City', 'inconsistent_case', 'info', 0.55, 3),
    ('outliers', 'Score', 'outliers', 'info', 0.85, 2),
    ('dedup', None, 'duplicate_rows', 'warning', 1.0, 1),
)
_query("detected", "detector string, column_name string, kind string, severity string, confidence double, affected bigint", *DETECTED)(_detected)


#: The recipe of each mode: operations by column, operations on the table, checks.
PLANNED = (
    ('review', 'Customer Name', 'customer_name', 'title_case'),
    ('review', 'Signup Date', 'signup_date', 'parse_date'),
    ('review', 'Paid Amount', 'amount', 'parse_number'),
    ('review', 'Weight', 'weight', 'normalize_unit'),
    ('review', 'City', 'city', 'normalize_values, title_case'),
    ('review', 'Email', 'email', 'normalize_email'),
    ('review', 'Phone', 'phone', 'to_na, normalize_phone'),
    ('review', 'Score', 'score', 'cast'),
    ('review', 'Active', 'active', ''),
    ('review', 'Note', 'note', 'to_na'),
    ('review', 'table', 'table', 'dedup'),
    ('review', 'check', 'customer_name', 'not_null'),
    ('review', 'check', 'amount', '>= 0'),
    ('review', 'check', 'email', 'valid_email'),
    ('review', 'check', 'phone', 'valid_phone'),
    ('review', 'check', 'score', 'unique'),
    ('auto', 'Customer Name', 'customer_name', 'collapse_whitespace'),
    ('auto', 'Signup Date', 'signup_date', 'parse_date'),
    ('auto', 'Paid Amount', 'amount', 'parse_number'),
    ('auto', 'Weight', 'weight', 'normalize_unit'),
    ('auto', 'City', 'city', 'normalize_values'),
    ('auto', 'Email', 'email', 'normalize_email'),
    ('auto', 'Phone', 'phone', 'to_na, normalize_phone'),
    ('auto', 'Score', 'score', 'cast'),
    ('auto', 'Active', 'active', ''),
    ('auto', 'Note', 'note', 'to_na'),
    ('auto', 'table', 'table', 'dedup'),
    ('auto', 'check', 'customer_name', 'not_null'),
    ('auto', 'check', 'amount', '>= 0'),
    ('auto', 'check', 'email', 'valid_email'),
    ('auto', 'check', 'phone', 'valid_phone'),
    ('auto', 'check', 'score', 'unique'),
    ('strict', 'Customer Name', 'customer_name', 'collapse_whitespace'),
    ('strict', 'Signup Date', 'signup_date', 'parse_date'),
    ('strict', 'Paid Amount', 'amount', 'parse_number'),
    ('strict', 'Weight', 'weight', 'normalize_unit'),
    ('strict', 'City', 'city', ''),
    ('strict', 'Email', 'email', 'normalize_email'),
    ('strict', 'Phone', 'phone', 'to_na'),
    ('strict', 'Score', 'score', 'cast'),
    ('strict', 'Active', 'active', ''),
    ('strict', 'Note', 'note', 'to_na'),
    ('strict', 'table', 'table', 'dedup'),
    ('strict', 'check', 'customer_name', 'not_null'),
    ('strict', 'check', 'amount', '>= 0'),
    ('strict', 'check', 'email', 'valid_email'),
    ('strict', 'check', 'phone', 'valid_phone'),
    ('strict', 'check', 'score', 'unique'),
)
_query("planned", "mode string, source string, target string, content string", *PLANNED)(_planned)


@_query(
    "name_similarity", "a string, b string, score double",
    ("Customer Name", "customer_name", 1.0), ("CustomerName", "customer name", 1.0), ("INR Amount", "amount_inr", 0.8), ("Amt", "Amount", 0.6667), ("x", "y", 0.0),
)
def _similarity(spark: SparkSession) -> list[tuple]:
    pairs = (("Customer Name", "customer_name"), ("CustomerName", "customer name"), ("INR Amount", "amount_inr"), ("Amt", "Amount"), ("x", "y"))
    return [(a, b, names.similarity(a, b)) for a, b in pairs]


_STREAMED = (
    ("strip_whitespace", True), ("cast float", True), ("cast datetime", False), ("cast category", False), ("parse_date formats", True), ("parse_date", False), ("fill_na 0", True), ("fill_na mean", False), ("fill_na zero", True),
    ("normalize_values", True), ("drop_columns", True), ("dedup", False), ("check not_null", True), ("check unique", False), ("check >= 3", True), ("check in", True), ("check matches", True),
)


@_query("streamable", "what string, streams boolean", *_STREAMED)
def _streamable(spark: SparkSession) -> list[tuple]:
    from scrubline.plans.recipe import Op, ValidationRule

    ops = {
        "strip_whitespace": "strip_whitespace", "cast float": {"cast": "float"}, "cast datetime": {"cast": "datetime"}, "cast category": {"cast": "category"}, "parse_date formats": {"parse_date": {"formats": ["%d/%m/%Y"]}}, "parse_date": "parse_date",
        "fill_na 0": {"fill_na": 0}, "fill_na mean": {"fill_na": "mean"}, "fill_na zero": {"fill_na": "zero"}, "normalize_values": {"normalize_values": {"a": "b"}}, "drop_columns": {"drop_columns": ["a"]}, "dedup": "dedup",
    }
    checks = {"not_null": "not_null", "unique": "unique", ">= 3": ">= 3", "in": "in [1, 2]", "matches": "matches: a+"}
    return [(k, op_streams(Op.of(v))) for k, v in ops.items()] + [(f"check {k}", rule_streams(ValidationRule("a", v))) for k, v in checks.items()]


_WRITTEN = ((1, "a, \"b\"", 1.5), (2, "line\nbreak", None), (3, "ü", -2.0))


def _round_trip(suffix: str, **how: object) -> Callable[[SparkSession], DataFrame]:
    def run(spark: SparkSession) -> DataFrame:
        # The sinks write through the file system of the driver, so the shared folder must be mounted there.
        folder = Path(urlparse(work_folder(spark)).path)
        df = spark.createDataFrame([*_WRITTEN], "i bigint, s string, d double").coalesce(1)
        write_table(df, folder / f"t.{suffix}")
        return read_table(spark, folder / f"t.{suffix}", **how).select("i", "s", "d")

    return run


for _suffix in ("csv", "tsv", "json", "parquet", "xlsx"):
    _query(f"file_{_suffix}", "i bigint, s string, d double", *_WRITTEN)(_round_trip(_suffix))
_query("file_nrows", "i bigint, s string, d double", *_WRITTEN[:2])(_round_trip("csv", nrows=2))
_query("file_skiprows", "i bigint, s string, d double", _WRITTEN[0], _WRITTEN[2])(_round_trip("parquet", skiprows=[1]))


@_query("file_sniffed", "name string, age bigint", ("José €", 3), ("Ann", 4))
def _sniffed(spark: SparkSession) -> DataFrame:
    folder = Path(urlparse(work_folder(spark)).path)
    folder.mkdir(parents=True)
    (folder / "c.csv").write_bytes("\n\nname;age\nJosé €;3\nAnn;4\n".encode("cp1252"))
    return read_table(spark, folder / "c.csv")


@_query("file_streamed", "part string, id string, note string", ("clean", "1", "x"), ("clean", "2", "b"), ("held", "7", "c"))
def _streamed(spark: SparkSession) -> DataFrame:
    folder = Path(urlparse(work_folder(spark)).path)
    folder.mkdir(parents=True)
    (folder / "in.csv").write_text("id,note\n1, x \n2,b\n7,c\n")
    recipe = Recipe.from_dict({"columns": {"note": {"ops": ["strip_whitespace"]}}, "validate": [{"column": "id", "check": "< 5"}]})
    replay_file(spark, recipe, str(folder / "in.csv"), str(folder / "out.csv"), on_drift="ignore")
    clean, held = (read_table(spark, folder / f, infer=False).select(F.lit(p).alias("part"), "id", "note") for p, f in (("clean", "out.csv"), ("held", "out.quarantine.csv")))
    return clean.unionByName(held)
