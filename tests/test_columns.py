"""Column operations against plain Python on tricky texts, and literal cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scrubline.errors import OpError, RecipeError
from scrubline.functions import columns as c

TRICKY = ["", " ", "  a  b ", "\tx\n", "O'Brien mc3rd", "ALL CAPS", "ümläut", "a\xa0b", "1,234.56", "(500)", "−5", "12ab34", "10-12", "1.5e3", "₹1,20,000", "1200 INR", "n/a", "None", "£3", "R$5", "5kg", "2,5 lb", None]


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def number(text):
    if text is None:
        return None
    s = text.strip().replace("−", "-")
    negative = len(s) > 1 and s[0] == "(" and s[-1] == ")"
    s = (s[1:-1] if negative else s).replace(",", "").strip()
    m = re.search(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?", s)
    if not m or re.search(r"\d", s[: m.start()] + s[m.end() :]):
        return None
    value = float(m[0])
    return -abs(value) if negative else -value if s.endswith("-") and m[0][0] != "-" else value


@pytest.mark.parametrize(
    ("make", "plain"),
    [
        (c.strip, lambda s: s.strip()),
        (c.collapse, lambda s: " ".join(s.split())),
        (c.title_case, lambda s: " ".join(s.split()).title()),
        (c.capitalize, lambda s: s.strip().capitalize()),
        (c.normalize_email, lambda s: s.strip().lower()),
        (c.key, lambda s: s.strip().casefold()),
    ],
)
def test_text_operations_equal_python(spark, make, plain):
    assert values(spark, TRICKY, make) == [None if t is None else plain(t) for t in TRICKY]


def test_parse_number_equals_python_on_random_texts(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("0123456789.,()-+ eE₹a") for _ in range(rng.randint(0, 9))) for _ in range(3000)] + [t for t in TRICKY if t is not None]
    assert values(spark, texts, c.parse_number) == [number(t) for t in texts]


def test_numbers(spark):
    assert values(spark, ["₹1,20,000", "(500)", "1234.56-", "($5)", "2.3E+05", "", "abc", None], c.parse_number) == [120000.0, -500.0, -1234.56, -5.0, 230000.0, None, None, None]
    assert values(spark, ["1.234,56", "9,50"], lambda x: c.parse_number(x, ",", ".")) == [1234.56, 9.5]
    assert values(spark, ["12d", "1e3", "nan", " 7 "], c.to_numeric) == [None, 1000.0, None, 7.0]
    df = spark.createDataFrame([(x,) for x in (1e16, 1e-5, 0.0001, 1.25e7, 1.5)], "x double")
    assert [r[0] for r in df.select(c.number_text(F.col("x"))).collect()] == ["1e+16", "1e-05", "0.0001", "12500000.0", "1.5"]
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(c.cast(F.col("x"), "int", "double")).collect()] == [0, 2, 2, 0]


def test_dates(spark):
    texts = ["31/01/2024", "2024-01-31", "1 Jan 2024", "Jan 5, 2026", "31/02/2024", "x", None]
    assert values(spark, texts, lambda x: c.parse_date(x, None, True)) == ["2024-01-31", "2024-01-31", "2024-01-01", "2026-01-05", None, None, None]
    assert values(spark, ["15/03/85", "15/03/68"], lambda x: c.parse_date(x, ["%d/%m/%y"])) == ["1985-03-15", "2068-03-15"]
    assert values(spark, ["05/06/2024"], lambda x: c.parse_date(x, ["%d/%m/%Y", "%m/%d/%Y"], dayfirst=True)) == ["2024-06-05"]
    with pytest.raises(OpError):
        c.parse_format(F.lit("x"), "%Q")


def test_units_currencies_phones(spark):
    assert values(spark, ["5kg", "5000 g", "7", "3 m", "heavy", None], c.normalize_unit) == [5000.0, 5000.0, 7.0, None, None, None]
    assert values(spark, ["5kg", "7", "x"], c.unit_of) == ["kg", "g", None]
    assert values(spark, ["R$5", "5 EUR", "5 XYZ", None], lambda x: c.currency_of(x, "INR")) == ["USD", "EUR", "INR", "INR"]
    assert values(spark, ["+91 98-1", "098765 43210", "n/a", None], lambda x: c.normalize_phone(x, "+91")) == ["+91981", "+919876543210", None, None]


def test_values_and_missing(spark):
    assert values(spark, [" N/A ", "unknown", "x", ""], c.to_na) == [None, None, "x", None]
    assert values(spark, ["BLR", " blr ", "x"], lambda x: c.normalize_values(x, {"blr": "Bengaluru"}, True)) == ["Bengaluru", "Bengaluru", "x"]
    assert values(spark, ["a", "b"], lambda x: c.normalize_values(x, {"a": None})) == [None, "b"]
    assert values(spark, ["=1", "x", "-3"], c.escape_formula) == ["'=1", "x", "'-3"]


def test_patterns():
    assert c.java_replacement(r"\1-\g<2>$") == r"$1-$2\$"
    for bad in ("(a+)+", "(a|ab)*", "(", "x" * 600):
        with pytest.raises(RecipeError):
            c.check_pattern(bad)


def test_dates_in_any_form(spark):
    texts = ["31/01/2024", "Wednesday, 14 Feb 2024", "2024.03.05", "20240106", "10-11-12", "March 7th 2024 5pm", "soon", "", None, "2024-01-31T10:00:00+02:00"]
    assert values(spark, texts, lambda x: c.parse_date(x)) == ["2024-01-31", "2024-02-14", "2024-03-05", "2024-01-06", "2012-10-11", "2024-03-07", None, None, None, "2024-01-31"]
    assert values(spark, ["10-11-12", "10.11.12"], lambda x: c.parse_date(x, yearfirst=True))[1] == "2010-11-12"
