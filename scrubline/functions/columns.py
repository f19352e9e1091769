"""Column operations as expressions of the JVM: no Python runs for a row.

Every function takes a Column and its parameters and gives a Column. Text
operations expect strings; what is no string passes through them unchanged,
which the compiler sees to.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubline.errors import OpError, RecipeError

# Tokens for missing and boolean values, currencies, units and date formats.
NA_TOKENS = ("", "na", "n/a", "n.a.", "null", "none", "nil", "nan", "-", "--", "?", "unknown", "not available", "not applicable")
AMBIGUOUS_NA_TOKENS = frozenset({"none", "nil", "-", "--", "?", "unknown"})
TRUE_TOKENS = ("true", "t", "yes", "y", "1")
FALSE_TOKENS = ("false", "f", "no", "n", "0")
CURRENCY_SYMBOLS = {"₹": "INR", "$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₩": "KRW", "₽": "RUB", "R$": "BRL", "¢": "USD"}
CURRENCY_CODES = ("USD", "EUR", "GBP", "INR", "JPY", "CNY", "AUD", "CAD", "CHF", "SGD", "HKD", "NZD", "SEK", "NOK", "DKK", "ZAR", "AED", "SAR", "KRW", "RUB", "BRL")
UNITS = {
    "mass": {"kg": 1000.0, "g": 1.0, "mg": 0.001, "lb": 453.59237, "oz": 28.349523125},
    "length": {"km": 1000.0, "m": 1.0, "cm": 0.01, "mm": 0.001, "in": 0.0254, "ft": 0.3048, "yd": 0.9144},
    "volume": {"l": 1.0, "ml": 0.001, "gal": 3.785411784},
}
UNIT_ALIASES = {"litre": "l", "liter": "l", "litres": "l", "liters": "l", "grams": "g", "kilos": "kg"}
DATE_FORMATS = (
    "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%m-%d-%Y", "%d.%m.%Y", "%d/%m/%y",
    "%m/%d/%y", "%d-%m-%y", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%B %d, %Y", "%d-%b-%Y", "%d-%b-%y", "%b %d %Y", "%d %b %y",
)
DAY_FIRST_FORMATS = frozenset({"%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%d/%m/%y", "%d-%m-%y"})
MONTH_FIRST_FORMATS = frozenset({"%m/%d/%Y", "%m-%d-%Y", "%m/%d/%y"})
EMAIL, URL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$", r"(?i)^(https?://|www\.)\S+$"

UNIT_FAMILY = {u: family for family, units in UNITS.items() for u in units}
BLANKS = r"[\s\x1c-\x1f]+"
MOST_LITERAL_KEYS = 200
MOST_PATTERN_LENGTH = 500


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body uses it; else such expressions grow beyond what can be compiled."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without Unicode blanks at the ends; Spark's trim takes spaces only."""
    return F.regexp_replace(c, rf"(?U)^{BLANKS}|{BLANKS}$", "")


def collapse(c: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return strip(F.regexp_replace(c, rf"(?U){BLANKS}", " "))


def casefold(c: Column) -> Column:
    """Folded for comparing without letter case; upper and lower must not stand next to each other, or one is optimised away."""
    return F.translate(F.lower(F.regexp_replace(F.upper(c), "ẞ", "SS")), "ς", "σ")


def key(c: Column) -> Column:
    """Stripped and folded."""
    return casefold(strip(c))


def capitalize(c: Column) -> Column:
    """The first letter in upper case, the rest in lower case."""
    s = strip(c)
    first = F.upper(F.substring(s, 1, 1))
    return F.concat(F.substring(first, 1, 1), F.lower(F.substr(first, F.lit(2))), F.lower(F.substr(s, F.lit(2))))


def title_case(c: Column) -> Column:
    """Each run of letters capitalised, also behind digits and apostrophes."""
    runs = F.regexp_extract_all(collapse(c), F.lit(r"([\p{IsLowercase}\p{IsUppercase}\p{Lt}]+|[^\p{IsLowercase}\p{IsUppercase}\p{Lt}]+)"), F.lit(1))

    def one(run: Column) -> Column:
        first = F.upper(F.substr(run, F.lit(1), F.lit(1)))
        return F.concat(F.substr(first, F.lit(1), F.lit(1)), F.lower(F.substr(first, F.lit(2))), F.lower(F.substr(run, F.lit(2))))

    return F.array_join(F.transform(runs, one), "")


def remove_symbols(c: Column, symbols: Sequence[str]) -> Column:
    """Without each of symbols, one after the other."""
    return reduce(lambda x, s: F.replace(x, F.lit(s), F.lit("")), [s for s in symbols if s], c)


def check_pattern(pattern: str) -> str:
    """pattern, unless it is too long or its repetitions can take exponential time."""
    if len(pattern) > MOST_PATTERN_LENGTH:
        raise RecipeError(f"pattern is longer than {MOST_PATTERN_LENGTH} characters")
    for m in re.finditer(r"\((?:\?:|\?P<\w+>)?((?:[^()\\]|\\.)*)\)(?:[+*]|\{\d+,\d*\})", pattern):
        inner, parts = m[1], m[1].split("|")
        if re.search(r"(?<!\\)(?:[+*?]|\{\d+,\d*\})", inner) or any(a != b and (a.startswith(b) or b.startswith(a)) for i, a in enumerate(parts) for b in parts[:i]):
            raise RecipeError(f"pattern {pattern!r} repeats a group that itself repeats or overlaps")
    try:
        re.compile(pattern)
    except re.error as e:
        raise RecipeError(f"pattern {pattern!r} is no regular expression: {e}") from e
    return pattern


def java_pattern(pattern: str) -> str:
    """A Python regular expression in the dialect of the JVM."""
    made = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", check_pattern(pattern))
    return "(?U)" + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", made)


def java_replacement(text: str) -> str:
    """A Python replacement text in the dialect of the JVM."""
    marked = re.sub(r"\\g<(\w+)>|\\(\d{1,2})", lambda m: f"\0{m[1] or m[2]}\1", text)
    escaped = marked.replace("\\", "\\\\").replace("$", "\\$")
    return re.sub("\0(\\w+)\1", lambda m: f"${m[1]}" if m[1].isdigit() else f"${{{m[1]}}}", escaped)


def replace(c: Column, pattern: str, repl: str = "", regex: bool = True) -> Column:
    """All matches of pattern replaced by repl."""
    return F.regexp_replace(c, java_pattern(pattern), java_replacement(repl)) if regex else F.replace(c, F.lit(pattern), F.lit(repl))


def to_na(c: Column, tokens: Sequence[str] | None = None, case_insensitive: bool = True) -> Column:
    """Null for values that stand for a missing one."""
    words = list(NA_TOKENS if tokens is None else tokens)
    if not words:
        return c
    hit = key(c).isin(*{w.strip().casefold() for w in words}) if case_insensitive else c.isin(*words)
    return F.when(hit, None).otherwise(c)


def normalize_email(c: Column) -> Column:
    """Stripped and in lower case."""
    return F.lower(strip(c))


def normalize_phone(c: Column, default_country_code: str | None = None) -> Column:
    """The digits, with a plus where there was one; local numbers get the country code for their trunk zeros."""
    text = c.cast("string")
    digits = F.regexp_replace(text, r"(?U)\D", "")
    plus = strip(text).startswith("+")
    local = digits
    if default_country_code:
        code = re.sub(r"\D", "", str(default_country_code))
        local = F.concat(F.lit("+" + code), F.regexp_replace(digits, "^0+", ""))
        local = F.when(digits.startswith(code), F.concat(F.lit("+"), digits)).otherwise(local) if code else local
    return F.when(digits == "", None).when(plus, F.concat(F.lit("+"), digits)).otherwise(local)


_NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"


def no_nan(c: Column) -> Column:
    """Null for not-a-number."""
    return F.when(~F.isnan(c), c)


def parse_number(c: Column, decimal: str = ".", thousands: str = ",", symbols: Sequence[str] = ()) -> Column:
    """The one number in a text; null where there is none, or other digits beside it."""
    def bare(s: Column) -> Column:
        inner = F.when(_bracketed(s), F.substr(s, F.lit(2), F.length(s) - 2)).otherwise(s)
        inner = remove_symbols(inner, [*symbols, thousands] if thousands else symbols)
        return strip(F.replace(inner, F.lit(decimal), F.lit(".")) if decimal != "." else inner)

    def signed(s: Column, plain: Column, token: Column) -> Column:
        fused = F.regexp_count(plain, F.lit(r"(?U)[\d²³¹⁰-⁹₀-₉]")) > F.regexp_count(token, F.lit(r"\d"))
        value = F.when((token != "") & ~fused, token.try_cast("double"))
        return value * F.when(_bracketed(s), F.when(token.startswith("-"), 1.0).otherwise(-1.0)).when(plain.endswith("-") & ~token.startswith("-"), -1.0).otherwise(1.0)

    minus = F.replace(strip(c), F.lit("−"), F.lit("-"))
    return let(minus, lambda s: let(bare(s), lambda plain: let(F.regexp_extract(plain, _NUMBER, 0), lambda token: signed(s, plain, token))))


def _bracketed(s: Column) -> Column:
    return s.startswith("(") & s.endswith(")") & (F.length(s) > 1)


def to_numeric(c: Column) -> Column:
    """A double where the whole text is a number, else null; the suffixes d and f are none."""
    shape = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$|(?i)^[+-]?inf(?:inity)?$"
    return let(strip(c.cast("string")), lambda s: F.when(s.rlike(shape), s.try_cast("double")))


def number_text(c: Column) -> Column:
    """A double written as people write it: no exponent between 1e-4 and 1e16, else two digits of it at least."""
    return let(c.cast("string"), lambda s: _number_text(c, s))


def _number_text(c: Column, s: Column) -> Column:
    sign, mantissa, exponent = (F.regexp_extract(s, r"^(-?)([\d.]+)E(-?\d+)$", i) for i in (1, 2, 3))
    power = exponent.try_cast("int")
    bare = F.regexp_replace(mantissa, r"\.0$", "")
    digits = F.replace(bare, F.lit("."), F.lit(""))
    whole = F.concat(sign, F.rpad(digits, F.greatest(power + 1, F.length(digits)), "0"), F.lit(".0"))
    point = F.concat(sign, F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    padded = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0"))
    made = F.when((power >= 0) & (power < 16), F.when(F.length(digits) <= power + 1, whole).otherwise(point)).when((power < 0) & (power >= -4), small).otherwise(F.concat(sign, bare, F.lit("e"), padded))
    return F.when(F.isnan(c), None).when(s == "Infinity", "inf").when(s == "-Infinity", "-inf").when(s.contains("E"), made).otherwise(s)


def cast(c: Column, to: str, kind: str = "string") -> Column:
    """c, of the Spark type kind, as float, int, string, bool, datetime or category."""
    to = str(to).lower()
    if to in ("float", "float64", "number"):
        return to_numeric(c) if kind == "string" else no_nan(c.cast("double"))
    if to in ("int", "integer", "int64"):
        number = to_numeric(c) if kind == "string" else c.cast("double")
        return F.rint(number).try_cast("bigint")
    if to in ("string", "str", "text"):
        return number_text(c.cast("double")) if kind in ("double", "float") else F.initcap(c.cast("string")) if kind == "boolean" else c.cast("string")
    if to in ("bool", "boolean"):
        if kind == "boolean":
            return c
        word = key(number_text(c) if kind in ("double", "float") else c.cast("string"))
        return F.when(word.isin(*TRUE_TOKENS), True).when(word.isin(*FALSE_TOKENS), False)
    if to in ("datetime", "date"):
        return parse_timestamp(c) if kind == "string" else c.cast("timestamp_ntz")
    if to == "category":
        return c
    raise OpError(f"unknown cast target {to!r}")


def round_half_even(c: Column, decimals: int = 0, kind: str = "double") -> Column:
    """Rounded to decimals places, halves to the even neighbour, in binary floating point."""
    number = to_numeric(c) if kind == "string" else c.cast("double")
    scale = 10.0 ** int(decimals)
    return no_nan(F.rint(number * scale) / scale)


_DIRECTIVES = {"Y": ("yyyy", r"\d{4}"), "m": ("M", r"\d{1,2}"), "d": ("d", r"\d{1,2}"), "H": ("H", r"\d{1,2}"), "M": ("m", r"\d{1,2}"), "S": ("s", r"\d{1,2}"), "b": ("MMM", r"[A-Za-z]{3}"), "B": ("MMMM", r"[A-Za-z]+"), "y": ("yy", r"\d{2}")}
_OUTPUT = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "b": "MMM", "B": "MMMM", "y": "yy", "j": "DDD", "p": "a", "I": "hh"}


def _format_parts(fmt: str) -> list[tuple[bool, str]]:
    return [(True, x[1]) if x[0] == "%" and x != "%%" else (False, x.replace("%%", "%")) for x in re.findall(r"%.|[^%]+", fmt)]


def _quoted(text: str) -> str:
    return "".join("''" if x == "'" else f"'{x}'" if x.isalpha() else x for x in text)


def parse_format(c: Column, fmt: str) -> Column:
    """The timestamp that a text holds in one format, else null."""
    pattern, shape = "", ""
    for directive, text in _format_parts(fmt):
        if directive:
            if text not in _DIRECTIVES:
                raise OpError(f"date format {fmt!r} has the unknown directive %{text}")
            pattern += _DIRECTIVES[text][0]
            shape += _DIRECTIVES[text][1]
        else:
            pattern += _quoted(re.sub(r"\s+", " ", text))
            shape += re.sub(r"\\?\s+", " ", re.escape(text))
    blanks = bool(re.search(r"\s", fmt))
    named = "%b" in fmt or "%B" in fmt

    def bounded(stamp: Column) -> Column:
        # Two-digit years from 69 on are of the last century.
        moved = F.when(F.year(stamp) >= 2069, stamp - F.expr("INTERVAL 100 YEARS")).otherwise(stamp) if "%y" in fmt else stamp
        return F.when((F.year(moved) > 1677) & (F.year(moved) < 2262), moved)

    def parsed(s: Column) -> Column:
        return F.when(s.rlike(f"^{shape}$"), F.try_to_timestamp(F.initcap(s) if named else s, F.lit(pattern)).cast("timestamp_ntz"))

    return let(let(strip(F.regexp_replace(c, r"\s+", " ") if blanks else c), parsed), bounded)


def date_formats(formats: Sequence[str] | None, dayfirst: bool = False) -> list[str]:
    """The formats to try in order; of day-first and month-first ones only the preferred family stays."""
    formats = list(formats or DATE_FORMATS)
    if DAY_FIRST_FORMATS & set(formats) and MONTH_FIRST_FORMATS & set(formats):
        formats = [f for f in formats if f not in (MONTH_FIRST_FORMATS if dayfirst else DAY_FIRST_FORMATS)]
    return formats


def parse_timestamp(c: Column, formats: Sequence[str] | None = None, dayfirst: bool = False, yearfirst: bool = False) -> Column:
    """The first of the formats that fits; with none given the common formats, any ISO form, and then any form that a date parser reads.

    Only values that no format fits go to that parser, in Arrow batches, each value by
    itself; dayfirst and yearfirst tell it how to read numbers.
    """
    tried = F.coalesce(*(parse_format(c, f) for f in date_formats(formats, dayfirst)), *([] if formats else [F.try_to_timestamp(strip(c)).cast("timestamp_ntz")]))
    if formats:
        return tried
    return F.coalesce(tried, any_date(F.when(tried.isNull() & c.rlike(r"\d"), c), dayfirst, yearfirst))


def any_date(c: Column, dayfirst: bool = False, yearfirst: bool = False) -> Column:
    """The date that a text holds in whatever form; null passes through without cost."""

    def read(value: str) -> Any:
        try:
            found = pd.to_datetime(value, dayfirst=dayfirst, yearfirst=yearfirst)
            found = found.tz_convert("UTC").tz_localize(None) if found.tzinfo else found
            return None if pd.isna(found) else found
        except (ValueError, OverflowError, TypeError):
            return None

    def run(values: pd.Series) -> pd.Series:
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            known = {v: read(v) for v in values.dropna().unique()}
        return pd.to_datetime(values.map(known))

    return F.pandas_udf(run, "timestamp_ntz")(c)


def format_timestamp(c: Column, output: str = "%Y-%m-%d") -> Column:
    """A timestamp as text by a strftime pattern; datetime keeps it a timestamp."""
    if str(output).lower() in ("datetime", "raw", "none"):
        return c
    pattern = ""
    for directive, text in _format_parts("%Y-%m-%d" if str(output).lower() in ("iso", "date") else output):
        if directive and text not in _OUTPUT:
            raise OpError(f"output format {output!r} has the unknown directive %{text}")
        pattern += _OUTPUT[text] if directive else _quoted(text)
    return F.date_format(c, pattern)


def parse_date(c: Column, formats: Sequence[str] | None = None, dayfirst: bool = False, output: str = "%Y-%m-%d", yearfirst: bool = False) -> Column:
    """Texts in several formats as dates of one format."""
    return format_timestamp(parse_timestamp(c, formats, dayfirst, yearfirst), output)


def normalize_values(c: Column, mapping: dict, case_insensitive: bool = False) -> Column:
    """Values replaced by the mapping; a key may map to null. Larger mappings go through lookup_values."""
    if len(mapping) > MOST_LITERAL_KEYS:
        raise OpError(f"a mapping of more than {MOST_LITERAL_KEYS} keys needs a lookup table")
    if not mapping:
        return c
    fold = (lambda k: str(k).strip().casefold()) if case_insensitive else str
    pairs = {fold(k): v for k, v in mapping.items()}
    table = F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), F.lit(None if v is None else str(v)).cast("string"))))
    k = key(c.cast("string")) if case_insensitive else c.cast("string")
    return F.when(F.map_contains_key(table, k), F.try_element_at(table, k)).otherwise(c.cast("string"))


def currency_of(c: Column, default: str | None = None) -> Column:
    """The currency of an amount: by the first symbol in the list, else by the first word of three letters if it is a known code."""
    text = c.cast("string")
    found = F.when(text.isNull(), F.lit(default))
    for symbol, code in CURRENCY_SYMBOLS.items():
        found = found.when(F.contains(text, F.lit(symbol)), code)
    word = F.regexp_extract(F.upper(text), r"(?U)\b([A-Z]{3})\b", 1)
    return found.when(word.isin(*CURRENCY_CODES), word).otherwise(F.lit(default))


def unit_name(unit: str) -> str:
    """The unit that a name or its alias means."""
    name = UNIT_ALIASES.get(unit.casefold(), unit.casefold())
    if name not in UNIT_FAMILY:
        raise OpError(f"unknown target unit {unit!r}")
    return name


def unit_parts(c: Column) -> tuple[Column, Column]:
    """Amount and unit of a text like `5 kg`; both null if it is none."""
    shape = r"^\s*([+-]?\d+(?:[.,]\d+)?)\s*([A-Za-z]+)\s*$"
    aliases = F.create_map(*(F.lit(x) for a, u in (UNIT_ALIASES | {u: u for u in UNIT_FAMILY}).items() for x in (a, u)))
    unit = F.try_element_at(aliases, F.lower(F.regexp_extract(c, shape, 2)))
    return F.when(unit.isNotNull(), F.replace(F.regexp_extract(c, shape, 1), F.lit(","), F.lit(".")).try_cast("double")), unit


def normalize_unit(c: Column, to: str = "g", kind: str = "string") -> Column:
    """Amounts in one unit; bare numbers are in it already, other families are null."""
    to = unit_name(to)
    if kind != "string":
        return c.cast("double")
    amount, unit = unit_parts(c)
    factors = F.create_map(*(F.lit(x) for u, f in UNITS[UNIT_FAMILY[to]].items() for x in (u, f)))
    bare = F.when(c.rlike(r"^\s*[+-]?\d+(?:[.,]\d+)?\s*$"), F.replace(strip(c), F.lit(","), F.lit(".")).try_cast("double"))
    return F.when(unit.isNotNull(), amount * F.try_element_at(factors, unit) / F.lit(UNITS[UNIT_FAMILY[to]][to])).otherwise(bare)


def unit_of(c: Column, to: str = "g", kind: str = "string") -> Column:
    """The unit written in a text; the target unit for bare numbers."""
    if kind != "string":
        return F.when(c.isNotNull(), unit_name(to))
    return F.coalesce(unit_parts(c)[1], F.when(c.rlike(r"^\s*[+-]?\d+(?:[.,]\d+)?\s*$"), unit_name(to)))


def escape_formula(c: Column) -> Column:
    """A text that a spreadsheet would run gets an apostrophe in front."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def value_pattern(c: Column) -> Column:
    """The shape of a value: runs of digits as 9+, of letters as A+."""
    return F.regexp_replace(F.regexp_replace(c, r"\d+", "9+"), r"[A-Za-z]+(?!\+)", "A+")


# Checks: true where a value passes; null passes all but not_null.


def valid_email(c: Column) -> Column:
    return c.isNull() | F.lower(strip(c.cast("string"))).rlike(EMAIL)


def valid_url(c: Column) -> Column:
    return c.isNull() | strip(c.cast("string")).rlike(URL)


def valid_phone(c: Column, kind: str = "string") -> Column:
    text = number_text(c) if kind in ("double", "float") else c.cast("string")
    return c.isNull() | F.length(F.regexp_replace(text, r"(?U)\D", "")).between(7, 15)


def compares(c: Column, operator: str, number: float, kind: str = "string") -> Column:
    value = to_numeric(c) if kind == "string" else c.cast("double")
    test = {">=": value >= number, "<=": value <= number, ">": value > number, "<": value < number, "==": value == number, "!=": value != number}[operator]
    return c.isNull() | F.coalesce(test, F.lit(False))


def member_of(c: Column, values: Sequence, kind: str = "string") -> Column:
    text = number_text(c) if kind in ("double", "float") else c.cast("string")
    words = {str(v) for v in values if v is not None}
    passes = text.isin(*words) if words else F.lit(False)
    numbers = [float(v) for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
    if numbers and kind not in ("string", "boolean"):
        passes = passes | c.cast("double").isin(*numbers)
    return c.isNull() | passes


def matches(c: Column, pattern: str) -> Column:
    return c.isNull() | c.cast("string").rlike(java_pattern(pattern))
