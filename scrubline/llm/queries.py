"""The queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scrubline.llm import abusive_content, canonical_values, hidden_duplicates, leakage, name_variants, packing
from scrubline.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.variant_pairs(table(spark, sf_dir, "messy_customers"), table(spark, sf_dir, "ref_cities"))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.entity_rows(table(spark, sf_dir, "messy_customers"), table(spark, sf_dir, "ref_cities"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_duplicates.formatting_copies(table(spark, sf_dir, "messy_customers"))


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_duplicates.collapse(table(spark, sf_dir, "messy_customers"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_values.mapped_cities(table(spark, sf_dir, "messy_customers"), table(spark, sf_dir, "ref_cities"))


def p7_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_values.unmatched_cities(table(spark, sf_dir, "messy_customers"), table(spark, sf_dir, "ref_cities"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


def p8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.usage(p8_packed(spark, sf_dir), table(spark, sf_dir, "pack_limits"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abusive_content.abusive_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abusive_content.document_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abusive_content.source_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


_P4_KEYS = r"""
keys AS (
  SELECT record_id, least(x, y) AS lo, greatest(x, y) AS hi FROM (
    SELECT record_id,
      regexp_replace(lower(nfc_normalize(customer_name)), '[^\p{L}\p{N}]', '', 'g') AS x,
      regexp_replace(lower(nfc_normalize(email)), '[^\p{L}\p{N}]', '', 'g') AS y
    FROM messy_customers WHERE contains(customer_name, '@') OR contains(email, '@')) WHERE x IS NOT NULL AND y IS NOT NULL),
named AS (SELECT record_id, min(record_id) OVER (PARTITION BY lo, hi) AS keep_id, count(*) OVER (PARTITION BY lo, hi) AS n FROM keys)
"""

_P9 = r"""
WITH bare AS (
  SELECT doc_id, regexp_replace(regexp_replace(text, '<[/!?]?[a-zA-Z][^<>]*>|\[/?[a-zA-Z][^\[\]]*\]', ' ', 'g'), '&(#[0-9]+|#x[0-9a-fA-F]+|[a-zA-Z]+);', ' ', 'g') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM bare),
i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dw AS (SELECT doc_id, array_to_string(w[s : s + 11], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS s FROM d)),
iw AS (SELECT item_id, array_to_string(w[s : s + 11], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS s FROM i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (p)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"WITH {_P4_KEYS} SELECT keep_id, record_id AS copy_id FROM named WHERE record_id <> keep_id",
        "p4_collapsed": f"WITH {_P4_KEYS} SELECT m.record_id, m.customer_name, m.email, coalesce(n, 1) AS copies FROM messy_customers m LEFT JOIN named USING (record_id) WHERE keep_id IS NULL OR keep_id = m.record_id",
        "p9_found": _P9,
    }
