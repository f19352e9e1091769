"""All queries of the core, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scrubline.operators import column_profile, schema_drift, timestamps
from scrubline.queries import cleaning, fixtures
from scrubline.session import table
from scrubline.sources import raw_records


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_profile.findings(table(spark, sf_dir, "clean_customers"), table(spark, sf_dir, "load_log"), table(spark, sf_dir, "column_profiles"))


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_profile.profile(table(spark, sf_dir, "clean_customers"), table(spark, sf_dir, "load_log"))


def p2_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_profile.induced_patterns(table(spark, sf_dir, "clean_customers"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.schema_changes(table(spark, sf_dir, "feed_files"), table(spark, sf_dir, "raw_lines"))


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.unified_rows(table(spark, sf_dir, "feed_files"), table(spark, sf_dir, "raw_lines"))


def p3_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.appearing_alternatives(table(spark, sf_dir, "feed_files"), table(spark, sf_dir, "raw_lines"))


def p3_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.feed_schemas(table(spark, sf_dir, "feed_files"), table(spark, sf_dir, "raw_lines"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_records.failing_lines(table(spark, sf_dir, "feed_files"), table(spark, sf_dir, "raw_lines"))


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_records.valid_rows(table(spark, sf_dir, "feed_files"), table(spark, sf_dir, "raw_lines"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.signups_in_utc(table(spark, sf_dir, "messy_customers"), table(spark, sf_dir, "branches"))


def p6_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.normalise_signups(table(spark, sf_dir, "messy_customers"), table(spark, sf_dir, "branches"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}
    return {**cleaning.QUERIES, **fixtures.QUERIES, **own}


_P2_FOUND = r"""
WITH v AS (
  SELECT load_id, column_name, t, x FROM (
    SELECT load_id, unnest(['name', 'age', 'city', 'signup', 'price', 'contact']) AS column_name,
      unnest([name, CAST(age AS VARCHAR), city, signup, CAST(price AS VARCHAR), contact]) AS t,
      unnest([NULL, CAST(age AS DOUBLE), NULL, NULL, price, NULL]) AS x FROM clean_customers)),
p AS (
  SELECT load_id, column_name, count(*) AS n, count(t) AS v, count(DISTINCT t) AS u, avg(x) AS m, stddev_pop(x) AS d, min(x) AS lo, max(x) AS hi,
    count(*) FILTER (x IS NULL AND regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(t AS DATE) IS NOT NULL) AS f_date,
    count(*) FILTER (CASE WHEN column_name IN ('age', 'price') THEN x = floor(x) ELSE regexp_full_match(t, '[+-]?[0-9]+') END) AS f_integer,
    count(*) FILTER (x IS NOT NULL OR regexp_full_match(t, '[+-]?[0-9]+([.][0-9]+)?')) AS f_float,
    count(*) FILTER (x IS NULL AND regexp_full_match(t, '[^@\s]+@[^@\s]+[.][^@\s]+')) AS f_email,
    count(*) FILTER (x IS NULL AND regexp_full_match(t, '[-+(). 0-9]+') AND length(regexp_replace(t, '[^0-9]', '', 'g')) BETWEEN 7 AND 15) AS f_phone
  FROM v GROUP BY ALL),
b AS (SELECT a.load_id, c.load_id AS prev FROM load_log a JOIN load_log c ON a.feed_name = c.feed_name AND a.load_seq = c.load_seq + 1),
j AS (SELECT p.*, q.n AS pn, q.v AS pv, q.m AS pm, q.d AS pd, q.lo AS plo, q.hi AS phi FROM p LEFT JOIN b USING (load_id) LEFT JOIN p q ON q.load_id = b.prev AND q.column_name = p.column_name),
r AS (SELECT p.*, c.null_count, c.unique_count, CASE c.semantic_type WHEN 'date' THEN f_date WHEN 'integer' THEN f_integer WHEN 'float' THEN f_float WHEN 'email' THEN f_email WHEN 'phone' THEN f_phone ELSE v END AS fit
  FROM p JOIN column_profiles c USING (load_id, column_name))
SELECT DISTINCT * FROM (
  SELECT load_id, column_name, 'null_count' AS finding FROM r WHERE null_count <> n - v
  UNION ALL SELECT load_id, column_name, 'unique_count' FROM r WHERE unique_count <> u
  UNION ALL SELECT load_id, column_name, 'semantic_type' FROM r WHERE v > 0 AND fit * 100 < v * 80
  UNION ALL SELECT load_id, column_name, 'pattern' FROM r WHERE v > 0 AND fit * 100 >= v * 80 AND fit * 100 < v * 95
  UNION ALL SELECT load_id, column_name, 'null_shift' FROM j WHERE abs((n - v) * pn - (pn - pv) * n) * 10 > n * pn
  UNION ALL SELECT load_id, column_name, 'mean_shift' FROM j WHERE abs(m - pm) > pd / 2
  UNION ALL SELECT load_id, column_name, 'range_shift' FROM j WHERE lo < plo - (phi - plo) OR hi > phi + (phi - plo))
"""


def oracle_sql() -> dict[str, str]:
    return {**cleaning.SQL, **fixtures.SQL, "p2_found": _P2_FOUND}
