"""Statistics and semantic types of columns, as aggregations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubline.functions import columns as c
from scrubline.plans.registry import ROW_ID
from scrubline.plans.rows import with_row_id

SHOWN = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
#: Size of the sketch that brackets quantiles.
QUANTILE_ACCURACY = 10_000
# Parts of column names that hint at a type.
NAME_HINTS = {
    "email": ("email", "e-mail", "mail"), "phone": ("phone", "mobile", "contact", "tel", "cell", "whatsapp"), "date": ("date", "dob", "day", "created", "updated", "signup", "joined", "timestamp"),
    "currency": ("amount", "price", "cost", "salary", "revenue", "inr", "usd", "paid", "total"), "id": ("id", "code", "uuid", "guid", "ref", "sku"),
    "unit": ("weight", "mass", "height", "length", "width", "depth", "volume", "qty", "quantity", "size"),
}
_CODES = "|".join(("INR", "USD", "EUR", "GBP", "JPY"))


def _currency_like(v: Column) -> Column:
    symbol = reduce(lambda a, b: a | b, [F.contains(v, F.lit(s)) for s in c.CURRENCY_SYMBOLS])
    return (symbol | F.upper(v).rlike(rf"(^|\s)({_CODES})|({_CODES})$")) & v.rlike(r"\d")


def _date_like(v: Column) -> Column:
    shaped = v.rlike(r"[/.\-]|\d{1,2}\s*[A-Za-z]{3,}|[A-Za-z]{3,}\s*\d{1,2}") & v.rlike(r"\d")
    return shaped & F.coalesce(*(c.parse_format(v, f) for f in c.DATE_FORMATS)).isNotNull()


def _phone_like(v: Column) -> Column:
    return F.length(F.regexp_replace(v, r"\D", "")).between(7, 15) & (v.rlike(r"[-+() ]") | c.strip(v).rlike(r"^[+0]")) & ~v.rlike(r"[A-Za-z@]")


PREDICATES: dict[str, Callable[[Column], Column]] = {
    "bool": lambda v: c.key(v).isin("true", "false", "yes", "no", "t", "f", "y", "n"),
    "email": lambda v: c.strip(v).rlike(c.EMAIL),
    "url": lambda v: c.strip(v).rlike(c.URL),
    "currency": _currency_like,
    "unit": lambda v: c.unit_parts(v)[1].isNotNull(),
    "date": _date_like,
    "phone": _phone_like,
    "numeric": lambda v: F.regexp_replace(v, r"[(),\s]", "").rlike(r"^[+-]?\d+(\.\d+)?$"),
}


@dataclass
class ColumnProfile:
    """One column: counts, range, lengths, frequent values, semantic type and the signals that decided it."""

    name: str
    dtype: str
    n_rows: int
    null_count: int
    unique_count: int
    min_value: float | None = None
    max_value: float | None = None
    mean_value: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    mean_length: float | None = None
    top_values: list[tuple[Any, int]] = field(default_factory=list)
    samples: list[Any] = field(default_factory=list)
    semantic_type: str = "text"
    confidence: float = 0.0
    signals: dict[str, float] = field(default_factory=dict)

    @property
    def count(self) -> int:
        return self.n_rows - self.null_count


@dataclass
class Profile:
    """A table: its columns and how many rows repeat others."""

    n_rows: int
    columns: dict[str, ColumnProfile]
    duplicate_rows: int


def column_stats(df: DataFrame) -> DataFrame:
    """One row for each column: n_rows, null_count, unique_count, range and mean of numbers, lengths of texts. One pass, exact distinct counts."""
    kinds = {n: t for n, t in df.dtypes if n != ROW_ID}
    made, cells = [F.count(F.lit(1)).alias("n")], []
    for i, (name, kind) in enumerate(kinds.items()):
        col = c.no_nan(F.col(f"`{name}`")) if kind in ("float", "double") else F.col(f"`{name}`")
        made += [F.count(col).alias(f"c{i}"), F.count_distinct(col).alias(f"d{i}")]
        number = col.cast("double") if kind in NUMERIC else F.lit(None).cast("double")
        length = F.length(col) if kind == "string" else F.lit(None).cast("int")
        made += [f(x).alias(f"{n}{i}") for n, f, x in (("lo", F.min, number), ("hi", F.max, number), ("av", F.avg, number), ("sl", F.min, length), ("ll", F.max, length), ("al", F.avg, length))]
        cells.append(F.struct(
            F.lit(name).alias("column"), F.lit(kind).alias("dtype"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"c{i}")).alias("null_count"), F.col(f"d{i}").alias("unique_count"), F.col(f"lo{i}").alias("min_value"),
            F.col(f"hi{i}").alias("max_value"), F.col(f"av{i}").alias("mean_value"), F.col(f"sl{i}").alias("min_length"), F.col(f"ll{i}").alias("max_length"), F.col(f"al{i}").alias("mean_length"),
        ))
    return df.agg(*made).select(F.inline(F.array(*cells)))


def value_counts(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values with their counts; ties by the value as text."""
    return df.filter(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col("value").cast("string")).limit(n)


def first_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The first n distinct values in row order."""
    return df.filter(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("value")).agg(F.min(ROW_ID).alias("at")).orderBy("at").limit(n)


def duplicate_count(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier one; null equals null."""
    columns = [F.col(f"`{x}`") for x in df.columns if x != ROW_ID]
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def key_duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(n_rows, n_keys): rows that share their key with others, and how many such keys there are."""
    return df.dropna(subset=list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))


def exact_quantiles(values: DataFrame, shares: Sequence[float], accuracy: int = QUANTILE_ACCURACY) -> list[float | None]:
    """Exact quantiles, linear between neighbours, of the one column of values; nulls have no say.

    A sketch of fixed size brackets each rank; then only values inside the brackets,
    about four in accuracy of all, are counted, sorted and ranked. No task holds or
    sorts all values.
    """
    v = F.col("v")
    values = values.toDF("v").filter(v.isNotNull())
    slack = 2.0 / accuracy
    edges = [min(1.0, max(0.0, p + d)) for p in shares for d in (-slack, slack)]
    n, found = values.agg(F.count(v), F.percentile_approx(v, edges, accuracy)).first()
    if not n:
        return [None] * len(shares)
    result = []
    for i, share in enumerate(shares):
        low, high = found[2 * i], found[2 * i + 1]
        below = values.agg(F.sum((v < low).cast("bigint"))).first()[0]
        inside = values.filter(v.between(low, high)).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        last = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + below
        place = share * (n - 1)
        wanted = [int(place), min(int(place) + 1, n - 1)]
        ranked = inside.withColumn("last", last).withColumn("first", F.col("last") - F.col("n"))
        rows = ranked.filter(" or ".join(f"(first <= {k} and {k} < last)" for k in wanted)).collect()
        one, two = (next((r.v for r in rows if r["first"] <= k < r["last"]), None) for k in wanted)
        if one is None or two is None:
            # The neighbour may lie just outside the bracket.
            two = values.filter(v > high).agg(F.min(v)).first()[0] if two is None else two
            one = values.filter(v < low).agg(F.max(v)).first()[0] if one is None else one
        result.append(one + (two - one) * (place - int(place)))
    return result


def outlier_bounds(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """(q1, q3, low, high, n_values, n_outliers): values more than k interquartile ranges outside the quartiles, which are exact."""
    kind = dict(df.dtypes)[column]
    number = c.to_numeric(F.col(f"`{column}`")) if kind == "string" else c.no_nan(F.col(f"`{column}`").cast("double"))
    values = df.select(number.alias("v"))
    q1, q3 = exact_quantiles(values, [0.25, 0.75])
    low, high = (None, None) if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    outside = (F.col("v") < F.lit(low).cast("double")) | (F.col("v") > F.lit(high).cast("double"))
    counts = values.agg(F.count("v").alias("n_values"), F.coalesce(F.sum(outside.cast("bigint")), F.lit(0)).alias("n_outliers"))
    return counts.select(*(F.lit(x).cast("double").alias(n) for n, x in (("q1", q1), ("q3", q3), ("low", low), ("high", high))), "n_values", "n_outliers")


def hinted(name: str, kind: str) -> bool:
    return any(h in name.lower() for h in NAME_HINTS[kind])


def resolve_type(name: str, kind: str, count: int, unique: int, signals: dict[str, float], decimals: bool) -> tuple[str, float]:
    """The semantic type by a fixed order of signals, and how sure it is."""
    if count == 0:
        return "empty", 1.0
    fixed = {"boolean": "boolean", "float": "float", "double": "float", "date": "datetime", "timestamp": "datetime", "timestamp_ntz": "datetime"}.get(kind, "integer" if kind in NUMERIC else None)
    if fixed:
        return fixed, 1.0
    if kind != "string":
        return "text", 0.5
    for signal, alone, helped in (("bool", 0.9, None), ("email", 0.8, 0.5), ("url", 0.8, None), ("currency", 0.6, None), ("unit", 0.6, 0.4), ("date", 0.8, 0.5), ("phone", 0.8, 0.5)):
        share = signals.get(signal, 0.0)
        hint = helped is not None and hinted(name, signal)
        if share >= alone or (hint and share >= helped):
            return {"bool": "boolean"}.get(signal, signal), max(share, 0.8) if hint else share
    if signals.get("numeric", 0.0) >= 0.95:
        return ("float" if decimals else "integer"), signals["numeric"]
    distinct = unique / count
    if unique <= 50 and distinct < 0.5:
        return "categorical", 1.0 - distinct
    if distinct >= 0.95:
        return ("id" if hinted(name, "id") else "text"), distinct
    return "text", 0.5


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """All non-null values of a column as (value, n), distinct with counts."""
    return df.filter(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, with_duplicates: bool = True) -> Profile:
    """The profile of a table: one pass for the statistics, and a small job for each text column."""
    rows = with_row_id(df)
    stats = {r["column"]: r for r in column_stats(rows).collect()}
    # One job each for the signals, over all values, and the frequent and the first values of all columns.
    texts = [n for n, t in rows.dtypes if t == "string" and n != ROW_ID and stats[n].n_rows > stats[n].null_count]
    shares: dict[str, Any] = {}
    if texts:
        held = reduce(DataFrame.unionByName, [distinct_values(rows, n).select(F.lit(n).alias("column"), "value", "n") for n in texts])
        signal = [(F.sum(F.when(p(F.col("value")), F.col("n")).otherwise(0)) / F.sum("n")).alias(k) for k, p in PREDICATES.items()]
        decimal = F.max(PREDICATES["numeric"](F.col("value")) & F.contains("value", F.lit("."))).alias("decimals")
        shares = {r["column"]: r for r in held.groupBy("column").agg(*signal, decimal).collect()}
    named = [n for n in stats if stats[n].dtype in SHOWN]
    some = lambda make: reduce(DataFrame.unionByName, [make(rows, n).select(F.lit(n).alias("column"), F.col("value").cast("string").alias("text"), F.monotonically_increasing_id().alias("k"), *extra) for n in named]).collect() if named else []
    extra: list[str] = ["n"]
    frequent = some(value_counts)
    extra = []
    earliest = some(first_values)
    columns = {}
    for name, kind in rows.dtypes:
        if name == ROW_ID:
            continue
        r = stats[name]
        signals = {k: round(shares[name][k] or 0.0, 3) for k in PREDICATES} if name in shares else {}
        found, confidence = resolve_type(name, kind, r.n_rows - r.null_count, r.unique_count, signals, bool(name in shares and shares[name].decimals))
        columns[name] = ColumnProfile(
            name, kind, r.n_rows, r.null_count, r.unique_count, r.min_value, r.max_value, r.mean_value, r.min_length, r.max_length, r.mean_length,
            [(x.text, x.n) for x in sorted((x for x in frequent if x["column"] == name), key=lambda x: x.k)], [x.text for x in sorted((x for x in earliest if x["column"] == name), key=lambda x: x.k)], found, confidence, signals,
        )
    n_rows = next(iter(stats.values())).n_rows if stats else 0
    return Profile(n_rows, columns, duplicate_count(rows).first()[0] if with_duplicates and columns else 0)
