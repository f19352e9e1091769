"""Queries of the cleaning operators, each with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.functions import columns as c
from scrubline.plans import engine, profile
from scrubline.plans.ops import dedup, fill_na
from scrubline.plans.recipe import Recipe
from scrubline.plans.registry import ROW_ID
from scrubline.plans.rows import carry
from scrubline.session import table

# Portable texts: each view gives the same rows in both engines.
CUSTOMER = """SELECT c_custkey,
 concat(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE '' END, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) WHEN c_custkey % 4 = 1 THEN lower(c_name) ELSE replace(c_name, '#', '  ') END, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE '' END) AS name_raw,
 CASE WHEN c_custkey % 29 = 0 THEN 'n/a' WHEN c_custkey % 31 = 0 THEN '12ab34' WHEN c_acctbal < 0 THEN concat('(', cast(cast(floor(abs(c_acctbal)) AS bigint) AS string), ')') WHEN c_custkey % 2 = 0 THEN concat('₹1,', lpad(cast(cast(floor(c_acctbal) AS bigint) % 1000 AS string), 3, '0')) ELSE concat(cast(cast(floor(c_acctbal) AS bigint) AS string), ' USD') END AS amount_raw,
 concat(CASE WHEN c_custkey % 2 = 0 THEN ' User' ELSE 'user' END, cast(c_custkey AS string), CASE WHEN c_custkey % 10 = 0 THEN ' at example' ELSE '@Example.COM' END) AS email_raw,
 CASE WHEN c_custkey % 17 = 0 THEN 'N/A' WHEN c_custkey % 2 = 0 THEN concat('+91 98', lpad(cast(c_custkey AS string), 8, '0')) ELSE concat('(080) ', lpad(cast(c_custkey AS string), 8, '0')) END AS phone_raw,
 CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN lower(c_mktsegment) ELSE concat(c_mktsegment, ' ') END AS segment_raw,
 CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS bal_raw
FROM customer"""
ORDERS = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN concat(lpad(cast(day(o_orderdate) AS string),2,'0'),'/',lpad(cast(month(o_orderdate) AS string),2,'0'),'/',cast(year(o_orderdate) AS string)) WHEN o_orderkey % 3 = 1 THEN concat(cast(year(o_orderdate) AS string),'-',lpad(cast(month(o_orderdate) AS string),2,'0'),'-',lpad(cast(day(o_orderdate) AS string),2,'0')) ELSE 'garbage' END AS date_raw FROM orders"
PART = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'heavy' ELSE concat(cast(p_size AS string), CASE WHEN p_partkey % 5 = 1 THEN 'kg' WHEN p_partkey % 5 = 2 THEN ' G' WHEN p_partkey % 5 = 3 THEN ' lb' ELSE '' END) END AS weight_raw FROM part"
VIEWS = {"customer": (CUSTOMER, "c_custkey"), "orders": (ORDERS, "o_orderkey"), "part": (PART, "p_partkey")}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A portable messy view over one table."""
    text, _ = VIEWS[name]
    return spark.sql(text.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: table(spark, sf_dir, name)})


def _query(name: str, sql: str | None = None) -> Callable:
    def add(function: Callable) -> Callable:
        QUERIES[f"q_{name}"] = function
        if sql:
            SQL[f"q_{name}"] = sql
        return function

    return add


def _column(name: str, source: str, make: Callable[[Column], Column], sql: str, of: str = "customer") -> None:
    """A query that shows one column operation over a messy view."""
    text, key = VIEWS[of]
    QUERIES[f"q_{name}"] = lambda spark, sf_dir: view(spark, sf_dir, of).select(key, make(F.col(source)).alias("value"))
    SQL[f"q_{name}"] = f"SELECT {key}, {sql} AS value FROM ({text}) b"


_VALID = "regexp_matches(lower(trim(email_raw)), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')"
_TRIMMED = "trim(regexp_replace(name_raw, '\\s+', ' ', 'g'))"
_TOKEN = "regexp_extract(replace(trim(amount_raw, '()'), ',', ''), '[+-]?(?:\\d+(?:\\.\\d*)?|\\.\\d+)(?:[eE][+-]?\\d+)?')"
_NUMBER = f"CASE WHEN {_TOKEN} = '' OR length(regexp_replace(amount_raw, '[^0-9]', '', 'g')) > length(regexp_replace({_TOKEN}, '[^0-9]', '', 'g')) THEN NULL WHEN amount_raw LIKE '(%' THEN -abs(try_cast({_TOKEN} AS double)) ELSE try_cast({_TOKEN} AS double) END"
_DATE = "strftime(coalesce(try_strptime(date_raw, '%d/%m/%Y'), try_strptime(date_raw, '%Y-%m-%d')), '%Y-%m-%d')"
_DIGITS = "regexp_replace(phone_raw, '\\D', '', 'g')"
_NA = "('', 'na', 'n/a', 'n.a.', 'null', 'none', 'nil', 'nan', '-', '--', '?', 'unknown', 'not available', 'not applicable')"
_WEIGHT = "CASE WHEN regexp_matches(weight_raw, '^[0-9]+$') THEN cast(weight_raw AS double) ELSE try_cast(regexp_extract(weight_raw, '^([0-9]+)', 1) AS double) * CASE lower(regexp_extract(weight_raw, '([A-Za-z]+)$', 1)) WHEN 'kg' THEN 1000.0::double WHEN 'g' THEN 1.0::double WHEN 'lb' THEN 453.59237::double END END"

_column("strip", "name_raw", c.strip, "trim(name_raw)")
_column("collapse", "name_raw", c.collapse, _TRIMMED)
_column("lower", "name_raw", F.lower, "lower(name_raw)")
_column("upper", "name_raw", F.upper, "upper(name_raw)")
_column("title_case", "name_raw", c.title_case, f"array_to_string(list_transform(regexp_extract_all({_TRIMMED}, '[A-Za-z]+|[^A-Za-z]+'), lambda t: upper(t[1]) || lower(t[2:])), '')")
_column("capitalize", "name_raw", c.capitalize, "upper(trim(name_raw)[1]) || lower(trim(name_raw)[2:])")
_column("remove_symbols", "amount_raw", lambda x: c.remove_symbols(x, ["₹", ",", "(", ")"]), "replace(replace(replace(replace(amount_raw, '₹', ''), ',', ''), '(', ''), ')', '')")
_column("replace_regex", "phone_raw", lambda x: c.replace(x, r"(\d{3})(\d+)", r"\2-\1"), "regexp_replace(phone_raw, '(\\d{3})(\\d+)', '\\2-\\1', 'g')")
_column("replace_literal", "email_raw", lambda x: c.replace(x, "@Example.", "@", regex=False), "replace(email_raw, '@Example.', '@')")
_column("to_na", "amount_raw", c.to_na, f"CASE WHEN lower(trim(amount_raw)) IN {_NA} THEN NULL ELSE amount_raw END")
_column("to_na_exact", "phone_raw", lambda x: c.to_na(x, ["N/A"], False), "nullif(phone_raw, 'N/A')")
_column("email", "email_raw", c.normalize_email, "lower(trim(email_raw))")
_column("phone", "phone_raw", c.normalize_phone, f"CASE WHEN {_DIGITS} = '' THEN NULL WHEN phone_raw LIKE '+%' THEN '+' || {_DIGITS} ELSE {_DIGITS} END")
_column("phone_country", "phone_raw", lambda x: c.normalize_phone(x, "+91"), f"CASE WHEN {_DIGITS} = '' THEN NULL WHEN phone_raw LIKE '+%' OR {_DIGITS} LIKE '91%' THEN '+' || {_DIGITS} ELSE '+91' || ltrim({_DIGITS}, '0') END")
_column("parse_number", "amount_raw", c.parse_number, _NUMBER)
_column("parse_number_eu", "amount_raw", lambda x: c.parse_number(F.translate(x, ",", "."), decimal=",", thousands="."), _NUMBER)
_column("cast_float", "amount_raw", lambda x: c.cast(F.replace(x, F.lit(" USD"), F.lit("")), "float"), "try_cast(replace(amount_raw, ' USD', '') AS double)")
_column("cast_int", "bal_raw", lambda x: c.cast(x, "int", "double"), "CAST(round_even(CAST(bal_raw AS DECIMAL(18, 6)), 0) AS bigint)")
_column("cast_bool", "segment_raw", lambda x: c.cast(F.when(x.startswith("A"), " Yes ").when(x.startswith("B"), "f").otherwise(x), "bool"), "CASE WHEN segment_raw LIKE 'A%' THEN true WHEN segment_raw LIKE 'B%' THEN false END")
_column("cast_string", "c_custkey", lambda x: c.cast(x, "string", "bigint"), "CAST(c_custkey AS VARCHAR)")
_column("cast_datetime", "date_raw", lambda x: F.date_format(c.cast(x, "datetime"), "yyyy-MM-dd HH:mm"), "strftime(coalesce(try_strptime(date_raw, '%m/%d/%Y'), try_strptime(date_raw, '%Y-%m-%d'), try_strptime(date_raw, '%d/%m/%Y')), '%Y-%m-%d %H:%M')", "orders")
_column("round", "bal_raw", lambda x: c.round_half_even(x, 1), "round_even(CAST(bal_raw AS DECIMAL(18, 6)), 1)::double")
_column("parse_date", "date_raw", lambda x: c.parse_date(x, ["%d/%m/%Y", "%Y-%m-%d"]), _DATE, "orders")
_column("parse_date_two_digits", "date_raw", lambda x: c.parse_date(F.regexp_replace(x, r"/\d\d(\d\d)$", "/$1"), ["%d/%m/%y"], output="%d %b %Y"), "strftime(try_strptime(regexp_replace(date_raw, '/\\d\\d(\\d\\d)$', '/\\1'), '%d/%m/%y'), '%d %b %Y')", "orders")
_column("normalize_values", "segment_raw", lambda x: c.normalize_values(x, {"BUILDING": "Building", "building": "Building", "MACHINERY": None}), "CASE segment_raw WHEN 'BUILDING' THEN 'Building' WHEN 'building' THEN 'Building' WHEN 'MACHINERY' THEN NULL ELSE segment_raw END")
_column("normalize_values_folded", "segment_raw", lambda x: c.normalize_values(x, {"building": "B", "machinery": "M"}, True), "CASE lower(trim(segment_raw)) WHEN 'building' THEN 'B' WHEN 'machinery' THEN 'M' ELSE segment_raw END")
_column("extract_currency", "amount_raw", lambda x: c.currency_of(x, "EUR"), "CASE WHEN contains(amount_raw, '₹') THEN 'INR' WHEN amount_raw LIKE '% USD' THEN 'USD' ELSE 'EUR' END")
_column("normalize_unit", "weight_raw", c.normalize_unit, _WEIGHT, "part")
_column("unit_of", "weight_raw", c.unit_of, "CASE WHEN weight_raw = 'heavy' THEN NULL WHEN regexp_matches(weight_raw, '^[0-9]+$') THEN 'g' ELSE lower(regexp_extract(weight_raw, '([A-Za-z]+)$', 1)) END", "part")
_column("formula_escape", "phone_raw", c.escape_formula, "CASE WHEN substr(phone_raw, 1, 1) IN ('=', '+', '-', '@') THEN '''' || phone_raw ELSE phone_raw END")
_column("value_pattern", "phone_raw", c.value_pattern, "regexp_replace(regexp_replace(phone_raw, '\\d+', '9+', 'g'), '[A-Za-z]+', 'A+', 'g')")
_column("check_not_null", "bal_raw", lambda x: x.isNotNull(), "bal_raw IS NOT NULL")
_column("check_email", "email_raw", c.valid_email, f"email_raw IS NULL OR {_VALID}")
_column("check_url", "name_raw", lambda x: c.valid_url(F.concat(F.lit("https://"), F.replace(x, F.lit("  "), F.lit("")))), "regexp_matches(trim('https://' || replace(name_raw, '  ', '')), '(?i)^(https?://|www\\.)\\S+$')")
_column("check_phone", "phone_raw", c.valid_phone, f"length({_DIGITS}) BETWEEN 7 AND 15")
_column("check_compare", "bal_raw", lambda x: c.compares(x, ">=", 0, "double"), "coalesce(bal_raw >= 0, true)")
_column("check_in", "segment_raw", lambda x: c.member_of(x, ["BUILDING", "building"]), "segment_raw IN ('BUILDING', 'building')")
_column("check_regex", "phone_raw", lambda x: c.matches(x, r"^\(\d+\)"), "regexp_matches(phone_raw, '^\\(\\d+\\)')")


def _fill(name: str, sql: str, **how) -> None:
    QUERIES[f"q_fill_{name}"] = lambda spark, sf_dir: fill_na(view(spark, sf_dir, "customer").select("c_custkey", "bal_raw", F.col("c_custkey").alias(ROW_ID)), "bal_raw", **how).select("c_custkey", F.col("bal_raw").alias("value"))
    SQL[f"q_fill_{name}"] = f"SELECT c_custkey, {sql} AS value FROM ({CUSTOMER}) b"


_fill("const", "coalesce(bal_raw, -1)", value=-1)
_fill("zero", "coalesce(bal_raw, 0)", strategy="zero")
_fill("mean", f"round(coalesce(bal_raw, (SELECT avg(bal_raw) FROM ({CUSTOMER}) x)), 6)", strategy="mean")
QUERIES["q_fill_mean"] = lambda spark, sf_dir, f=QUERIES["q_fill_mean"]: f(spark, sf_dir).withColumn("value", F.round("value", 6))
_fill("median", f"coalesce(bal_raw, (SELECT median(bal_raw) FROM ({CUSTOMER}) x))", strategy="median")
_fill("ffill", "last_value(bal_raw IGNORE NULLS) OVER (ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", strategy="ffill")
_fill("bfill", "first_value(bal_raw IGNORE NULLS) OVER (ORDER BY c_custkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", strategy="bfill")


@_query("fill_mode", "SELECT c_custkey, coalesce(s, (SELECT s FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS s, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1))) AS value FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS s FROM customer)")
def _fill_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("value"))
    return fill_na(rows, "value", strategy="mode")


@_query("carry_blocks", "SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM (SELECT event_id, CASE WHEN event_id % 11 = 3 THEN value END AS v FROM events)")
def _carry_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 == 3, F.col("value")).alias("value"), F.col("event_id").alias(ROW_ID))
    return carry(rows, "value", block_rows=1_000).drop(ROW_ID)


_RENAME = Recipe.from_dict({"columns": {"c_name": {"rename_to": "customer_name"}}, "drop_columns": ["c_nationkey"]})


@_query("rename", "SELECT c_custkey, c_name AS customer_name, c_acctbal, c_mktsegment FROM customer")
def _rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.execute(_RENAME, table(spark, sf_dir, "customer")).output()


_DOCUMENTS = "SELECT doc_id, lower(lang) AS l FROM documents"


def _dedup(name: str, sql: str, **how) -> None:
    QUERIES[f"q_dedup_{name}"] = lambda spark, sf_dir: dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.col("doc_id").alias(ROW_ID)), **how).select("doc_id")
    SQL[f"q_dedup_{name}"] = sql


_dedup("first", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1", subset=["text"])
_dedup("last", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1", subset=["text"], keep="last")
_dedup("none", "SELECT doc_id FROM documents QUALIFY count(*) OVER (PARTITION BY text) = 1", subset=["text"], keep=False)
_dedup("folded", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lower(trim(text, ' ' || chr(9) || chr(10))), source ORDER BY doc_id) = 1", subset=["text", "source"], ignore_case=True)


@_query("check_unique", f"SELECT c_custkey, count(*) OVER (PARTITION BY segment_raw, c_custkey % 700) = 1 AS value FROM ({CUSTOMER}) b")
def _check_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrubline.plans.registry import CHECKS

    rows = view(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("|", "segment_raw", (F.col("c_custkey") % 700).cast("string")).alias("k"))
    return rows.select("c_custkey", CHECKS["unique"](F.col("k"), "string").alias("value"))


FLAGSHIP = Recipe.from_dict({
    "columns": {
        "name_raw": {"rename_to": "name", "ops": ["collapse_whitespace", "title_case"]},
        "amount_raw": {"rename_to": "amount", "ops": [{"extract_currency": {"to": "currency", "default": "EUR"}}, "parse_number"]},
        "email_raw": {"rename_to": "email", "ops": ["normalize_email"]},
        "phone_raw": {"rename_to": "phone", "ops": ["to_na", {"normalize_phone": "+91"}]},
        "segment_raw": {"rename_to": "segment", "ops": ["strip_whitespace", "uppercase"]},
        "bal_raw": {"rename_to": "balance"},
    },
    "validate": [
        {"column": "email", "check": "valid_email"}, {"column": "amount", "check": "not_null", "on_fail": "drop"},
        {"column": "balance", "check": ">= 0", "on_fail": "null"}, {"column": "segment", "check": "in", "values": ["BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"], "on_fail": "warn"},
    ],
})
_CLEAN = f"""SELECT c_custkey, {SQL['q_title_case'].split('c_custkey, ')[1].rsplit(' AS value', 1)[0]} AS name, {_NUMBER} AS amount, lower(trim(email_raw)) AS email,
 CASE WHEN phone_raw = 'N/A' THEN NULL WHEN phone_raw LIKE '+%' OR {_DIGITS} LIKE '91%' THEN '+' || {_DIGITS} ELSE '+91' || ltrim({_DIGITS}, '0') END AS phone,
 upper(trim(segment_raw)) AS segment, bal_raw AS balance, CASE WHEN contains(amount_raw, '₹') THEN 'INR' WHEN amount_raw LIKE '% USD' THEN 'USD' ELSE 'EUR' END AS currency FROM ({CUSTOMER}) b"""
_REASONS = f"concat_ws('; ', CASE WHEN NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN 'email:valid_email' END, CASE WHEN amount IS NULL THEN 'amount:not_null' END)"


def flagship(spark: SparkSession, sf_dir: str) -> engine.Result:
    return engine.execute(FLAGSHIP, view(spark, sf_dir, "customer").withColumn(ROW_ID, F.col("c_custkey")))


@_query("flagship_clean", f"SELECT * REPLACE (CASE WHEN balance >= 0 THEN balance END AS balance) FROM ({_CLEAN}) c WHERE {_REASONS} = ''")
def _flagship_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir).output()


@_query("quarantine_reasons", f"SELECT c_custkey, {_REASONS} AS reason FROM ({_CLEAN}) c WHERE {_REASONS} LIKE 'email%'")
def _quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir).quarantine.select("c_custkey", F.col(engine.REASON).alias("reason"))


@_query("dropped_rows", f"SELECT c_custkey AS row_id, {_REASONS} AS reason FROM ({_CLEAN}) c WHERE {_REASONS} <> ''")
def _dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir).dropped


_PAIRS = [("name", "name_raw"), ("email", "email_raw"), ("phone", "phone_raw"), ("segment", "segment_raw")]
_DIFF_SQL = " UNION ALL ".join(f"SELECT c.c_custkey AS row_id, '{a}' AS \"column\", b.{r} AS before, c.{a} AS after FROM ({_CLEAN}) c JOIN ({CUSTOMER}) b USING (c_custkey) WHERE c.{a} IS DISTINCT FROM b.{r}" for a, r in _PAIRS)


@_query("diff_long", _DIFF_SQL)
def _diff_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir).diff.filter(F.col("column").isin(*(a for a, _ in _PAIRS)))


@_query("diff_counts", f"SELECT \"column\", count(*) AS n_changed FROM ({_DIFF_SQL}) GROUP BY 1 UNION ALL SELECT 'amount', count(*) FROM customer UNION ALL SELECT 'balance', count(*) FROM ({_CLEAN}) c WHERE balance < 0 AND {_REASONS} = ''")
def _diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir).changed_counts()


@_query("rule_results", f"SELECT 0 AS rule, 'email' AS \"column\", 'valid_email' AS \"check\", 'quarantine' AS on_fail, count(*) FILTER (NOT {_VALID}) AS n_failed FROM ({CUSTOMER}) b UNION ALL SELECT 1, 'amount', 'not_null', 'drop', count(*) FILTER (amount IS NULL) FROM ({_CLEAN}) c UNION ALL SELECT 2, 'balance', '>= 0', 'null', count(*) FILTER (balance < 0) FROM ({_CLEAN}) c UNION ALL SELECT 3, 'segment', 'in', 'warn', 0")
def _rule_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir).rule_results()


@_query("failed_rows", f"SELECT 0 AS rule, c_custkey AS row_id FROM ({CUSTOMER}) b WHERE NOT {_VALID} UNION ALL SELECT 1, c_custkey FROM ({_CLEAN}) c WHERE amount IS NULL UNION ALL SELECT 2, c_custkey FROM ({_CLEAN}) c WHERE balance < 0")
def _failed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir).failed_rows()


@_query("profile_stats", "SELECT 'c_acctbal' AS \"column\", count(*) AS n_rows, count(*) - count(c_acctbal) AS null_count, count(DISTINCT c_acctbal) AS unique_count, round(min(c_acctbal), 6) AS min_value, round(max(c_acctbal), 6) AS max_value, round(avg(c_acctbal), 6) AS mean_value, NULL::double AS mean_length FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment), NULL, NULL, NULL, round(avg(length(c_mktsegment)), 6) FROM customer")
def _profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profile.column_stats(table(spark, sf_dir, "customer").select("c_acctbal", "c_mktsegment"))
    return stats.select("column", "n_rows", "null_count", "unique_count", *(F.round(x, 6).alias(x) for x in ("min_value", "max_value", "mean_value", "mean_length")))


@_query("value_counts", "SELECT value, n FROM (SELECT l_shipdate AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, CAST(l_shipdate AS VARCHAR) LIMIT 10)".replace("l_shipdate", "l_partkey"))
def _value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(table(spark, sf_dir, "lineitem"), "l_partkey", 10)


@_query("duplicate_rows", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS duplicates FROM documents")
def _duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_count(table(spark, sf_dir, "documents").select("text", "lang", "source"))


@_query("outliers", "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS lo, quantile_cont(l_extendedprice, 0.75) AS hi FROM lineitem) SELECT round(lo, 4) AS q1, round(hi, 4) AS q3, (SELECT count(*) FROM lineitem WHERE l_extendedprice < lo - 1.5 * (hi - lo) OR l_extendedprice > hi + 1.5 * (hi - lo)) AS n_outliers FROM q")
def _outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.outlier_bounds(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return found.select(F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"), "n_outliers")


@_query("duplicate_keys", "SELECT sum(n) AS n_rows, count(*) AS n_keys FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1)")
def _duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.key_duplicates(table(spark, sf_dir, "orders"), ["o_custkey"])


@_query("category_counts", f"SELECT trim(segment_raw) AS value, count(*) AS n FROM ({CUSTOMER}) b GROUP BY 1")
def _category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "customer").groupBy(c.collapse(F.col("segment_raw")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@_query("disguised_nulls", f"SELECT count(*) FILTER (lower(trim(amount_raw)) IN {_NA}) AS amount_raw, count(*) FILTER (lower(trim(phone_raw)) IN {_NA}) AS phone_raw FROM ({CUSTOMER}) b")
def _disguised_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "customer").agg(*(F.sum(c.to_na(F.col(x)).isNull().cast("bigint")).alias(x) for x in ("amount_raw", "phone_raw")))


@_query("whitespace_counts", f"SELECT count(*) FILTER (name_raw <> trim(name_raw)) AS edge, count(*) FILTER (regexp_matches(name_raw, '\\s{{2,}}')) AS inner_runs FROM ({CUSTOMER}) b")
def _whitespace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name_raw")
    return view(spark, sf_dir, "customer").agg(F.sum((n != c.strip(n)).cast("bigint")).alias("edge"), F.sum(n.rlike(r"(?U)\s{2,}").cast("bigint")).alias("inner_runs"))


@_query("semantic_signals", f"SELECT round(avg(CAST({_VALID} AS int)), 6) AS email, round(avg(CAST(regexp_matches(phone_raw, '^[+(]') AS int)), 6) AS phone FROM ({CUSTOMER}) b")
def _semantic_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "customer")
    signal = lambda kind, col: F.round(F.avg(profile.PREDICATES[kind](F.col(col)).cast("int")), 6).alias(kind)
    return rows.agg(signal("email", "email_raw"), signal("phone", "phone_raw"))


SQL["q_stream_replay"] = SQL["q_flagship_clean"]


@_query("stream_replay", SQL["q_stream_replay"])
def _stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrubline.streaming.replay import replay_to_table

    return replay_to_table(spark, FLAGSHIP, view(spark, sf_dir, "customer"))


@_query("infer_schema")
def _infer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrubline.plans.schema import infer_schema

    made = infer_schema(view(spark, sf_dir, "customer"))
    return spark.createDataFrame([(x.name, x.dtype, x.required, x.unique) for x in made.columns], "name string, dtype string, required boolean, unique boolean")


@_query("detect_issues")
def _detect_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrubline.plans.detectors import detect

    found = detect(view(spark, sf_dir, "customer"))
    return spark.createDataFrame([(i.column, i.kind, i.severity, float(i.confidence), i.message) for i in found], "column_name string, kind string, severity string, confidence double, message string")


@_query("plan_recipe")
def _plan_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrubline.plans.planner import plan_recipe

    return spark.createDataFrame([(plan_recipe(view(spark, sf_dir, "customer"), mode="auto").to_yaml(),)], "recipe string")


@_query("fingerprint")
def _fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrubline.plans.drift import fingerprint

    made = fingerprint(table(spark, sf_dir, "customer"))
    return spark.createDataFrame([(made["columns"], made["row_count"], made["hash_sample"])], "columns int, row_count bigint, hash_sample string")


@_query("drift_report", "SELECT * FROM (VALUES ('renamed_column', 'c_acct_bal', 'warning'), ('missing_column', 'c_acctbal', 'warning'), ('missing_column', 'c_nationkey', 'warning'), ('new_column', 'note', 'warning'), ('content_hash_change', NULL, 'info')) t(kind, column_name, severity)")
def _drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrubline.plans.drift import detect_drift, fingerprint

    now = table(spark, sf_dir, "customer")
    changed = now.withColumnRenamed("c_acctbal", "c_acct_bal").drop("c_nationkey").withColumn("note", F.lit("x"))
    found = detect_drift(Recipe(fingerprint=fingerprint(now)), changed)
    return spark.createDataFrame([(x.kind, x.column, x.severity) for x in found], "kind string, column_name string, severity string")
