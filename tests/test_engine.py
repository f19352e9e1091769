"""Recipes: reading, running, policies, lineage; planning, drift and streaming over the same."""

import pytest
from pyspark.sql import functions as F

from scrubline.errors import RecipeError, ScrublineError, ValidationFailure
from scrubline.plans.detectors import detect
from scrubline.plans.drift import detect_drift, suggest_update
from scrubline.plans.engine import REASON, execute
from scrubline.plans.planner import plan_recipe
from scrubline.plans.recipe import Op, Recipe
from scrubline.plans.registry import OPS, ROW_ID, register_op, unregister_op, unregister_validator, validator
from scrubline.plans.rows import carry, lookup_values, with_row_id

ROWS = [
    ("  alice smith ", "31/01/2024", "₹1,20,000", "Bengaluru", "A@X.com ", "+91 98765 43210"),
    ("BOB JONES", "2024-02-15", "₹1,200", "bengaluru ", "bob@y.org", "9876543210"),
    ("charlie brown", "1 Jan 2024", "₹1200", "Mumbai", "not-an-email", "(080) 1234-5678"),
    ("alice smith", "15/03/2024", "₹50,000", "MUMBAI", "dan@z.co", "080 22334455"),
    ("Dan Adams", "05/06/2024", "₹0", "Bengaluru", "e@w.io", "N/A"),
    ("Eve Lin", "20/07/2024", "₹9,999", "Delhi", "f@w.io", "9000011111"),
]
NAMES = ["Customer Name", "Signup Date", "Amount", "City", "Email", "Phone"]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(ROWS, NAMES)


def test_recipe_round_trip_and_short_forms():
    text = """
version: 1
columns:
  Name: {rename_to: name, strip_whitespace: true, title_case: null}
  When: {ops: [{parse_date: {allowed: ['%d/%m/%Y']}}]}
  City: {ops: [{normalize_values: {BLR: Bengaluru}}]}
dedup: {subset: [name]}
validate:
  - {column: name, check: not_null}
"""
    recipe = Recipe.from_yaml(text)
    assert [o.name for o in recipe.columns[0].ops] == ["strip_whitespace", "title_case"]
    assert Recipe.from_yaml(recipe.to_yaml()).to_dict() == recipe.to_dict()
    for bad in ("columns: 3", "colums: {}", "columns: {a: {nonsense: 1}}", "validate: [{column: a, check: x, on_fail: explode}]", "version: 9"):
        with pytest.raises(RecipeError):
            Recipe.from_yaml(bad)


@pytest.mark.parametrize("name", sorted(OPS))
def test_short_form_of_each_operation_means_the_same(name):
    raw = {"remove_symbols": ["$"], "replace": {"pattern": "a", "repl": "b"}, "cast": "int", "round": 2, "normalize_values": {"a": "b"}, "normalize_unit": "kg", "fill_na": "ffill", "drop_columns": ["a"], "extract_currency": "cur", "dedup": {"keep": "last"}}.get(name)
    op = Op.of({name: raw})
    assert Op.of(op.short()) == op


def test_policies_and_difference(spark, messy):
    recipe = Recipe.from_dict({
        "columns": {"Customer Name": {"rename_to": "name", "ops": ["strip_whitespace"]}, "Email": {"rename_to": "email", "ops": ["normalize_email"]}, "Amount": {"rename_to": "amount", "ops": ["parse_number"]}},
        "validate": [{"column": "email", "check": "valid_email"}, {"column": "amount", "check": "> 0", "on_fail": "drop"}, {"column": "Phone", "check": "valid_phone", "on_fail": "null"}, {"column": "City", "check": "in", "values": ["Delhi"], "on_fail": "warn"}],
    })
    done = execute(recipe, messy)
    assert done.output().columns == ["name", "Signup Date", "amount", "City", "email", "Phone"]
    assert [r[REASON] for r in done.quarantine.collect()] == ["email:valid_email"]
    assert {(r.row_id, r.reason) for r in done.dropped.collect()} == {(2, "email:valid_email"), (4, "amount:> 0")}
    changes = {(r.row_id, r["column"]): (r.before, r.after) for r in done.diff.collect()}
    assert changes[0, "name"] == ("  alice smith ", "alice smith")
    assert changes[0, "amount"] == ("₹1,20,000", "120000.0")
    assert (1, "name") not in changes
    assert {r["column"]: r.n_failed for r in done.rule_results().collect()} == {"email": 1, "amount": 1, "Phone": 1, "City": 5}
    with pytest.raises(ValidationFailure) as e:
        execute(recipe, messy, "strict")
    assert len(e.value.failures) == 4


def test_missing_columns_and_collisions(messy):
    skipped = execute(Recipe.from_dict({"columns": {"Nope": {"ops": ["lowercase"]}}}), messy)
    assert skipped.log and skipped.output().count() == 6
    with pytest.raises(ScrublineError):
        execute(Recipe.from_dict({"columns": {"Nope": {"ops": ["lowercase"]}}}), messy, "strict")
    with pytest.raises(ScrublineError):
        execute(Recipe.from_dict({"columns": {"City": {"rename_to": "Email"}}}), messy)


def test_dedup_keeps_row_order(spark):
    df = spark.createDataFrame([("a", 1), ("A ", 2), ("a", 3), (None, 4), (None, 5)], "k string, v int")
    kept = lambda **how: [r.v for r in execute(Recipe.from_dict({"dedup": {"subset": ["k"], **how}}), df).cleaned.orderBy(ROW_ID).collect()]
    assert kept() == [1, 2, 4]
    assert kept(keep="last") == [2, 3, 5]
    assert kept(keep=False) == [2]
    assert kept(ignore_case=True) == [1, 4]
    done = execute(Recipe.from_dict({"dedup": {"subset": ["k"]}}), df)
    assert {(r.row_id, r.reason) for r in done.dropped.collect()} == {(2, "dedup"), (4, "dedup")}


def test_emitted_columns_and_fills(spark):
    df = spark.createDataFrame([("$1", None, 1.0), ("€2", "x", None), (None, None, 3.0)], "amt string, s string, n double")
    done = execute(Recipe.from_dict({"columns": {"amt": {"ops": [{"extract_currency": "cur"}, "parse_number"]}, "s": {"ops": [{"fill_na": "bfill"}]}, "n": {"ops": [{"fill_na": "mean"}]}}}), df)
    assert [tuple(r) for r in done.cleaned.orderBy(ROW_ID).drop(ROW_ID).collect()] == [(1.0, "x", 1.0, "USD"), (2.0, "x", 2.0, "EUR"), (None, None, 3.0, None)]
    assert done.added == ["cur"]


def test_carry_over_blocks_equals_plain_order(spark):
    values = [None, 1, None, None, 2, None, None, None, None, 3, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"{ROW_ID} long, v int")
    last, plain = None, []
    for v in values:
        last = v if v is not None else last
        plain.append(last)
    assert [r.v for r in carry(df, "v", block_rows=3).orderBy(ROW_ID).collect()] == plain
    assert [r.v for r in carry(df, "v", backward=True, block_rows=3).orderBy(ROW_ID).collect()] == [1, 1, 2, 2, 2, 3, 3, 3, 3, 3, None]


def test_row_ids_are_consecutive(spark):
    df = with_row_id(spark.range(0, 1000, 1, 7).withColumnRenamed("id", "x"))
    assert df.filter(F.col("x") != F.col(ROW_ID)).count() == 0


def test_large_mappings_are_joins(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    table = spark.createDataFrame([("a", "1"), ("b", None)], "from_value string, to_value string")
    assert sorted((r.k or "") for r in lookup_values(df, "k", table).collect()) == ["", "", "1"]


def test_own_operations_and_checks(spark, messy):
    register_op("shout", kind="pandas")(lambda s: s.str.upper() + "!")
    validator("short")(lambda col, kind: F.length(col) < 12)
    try:
        done = execute(Recipe.from_dict({"columns": {"City": {"ops": ["shout"]}}, "validate": [{"column": "City", "check": "short"}]}), messy)
        assert {r.City for r in done.cleaned.select("City").collect()} == {"BENGALURU!", "BENGALURU !", "MUMBAI!", "DELHI!"}
        with pytest.raises(RecipeError):
            register_op("shout")(lambda s: s)
    finally:
        unregister_op("shout")
        unregister_validator("short")


def test_planning_and_drift(spark, messy):
    recipe = plan_recipe(messy, mode="auto")
    ops = {x.source: [o.name for o in x.ops] for x in recipe.columns}
    assert ops["Amount"] == ["parse_number"] and ops["Email"] == ["normalize_email"] and "parse_date" in ops["Signup Date"]
    assert not detect_drift(recipe, messy)
    changed = messy.withColumnRenamed("Amount", "Amt (INR)").withColumn("Signup Date", F.lit("Jan 5, 2026"))
    kinds = {f.kind for f in detect_drift(recipe, changed)}
    assert {"renamed_column", "missing_column", "format_drift"} <= kinds
    fixed, _ = suggest_update(recipe, changed)
    assert "Amt (INR)" in {x.source for x in fixed.columns}
    assert not [f for f in detect_drift(fixed, changed) if f.severity != "info"]


def test_detectors_find_what_is_wrong(spark, messy):
    kinds = {(i.column, i.kind) for i in detect(messy)}
    assert ("Customer Name", "edge_whitespace") in kinds and ("Phone", "disguised_nulls") in kinds
    assert ("Amount", "currency_as_text") in kinds and ("City", "category_variants") in kinds


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a string, b double")
    done = execute(Recipe.from_dict({"columns": {"a": {"ops": ["strip_whitespace"]}, "b": {"ops": [{"fill_na": "mean"}]}}, "validate": [{"column": "a", "check": "unique"}]}), empty)
    assert done.output().count() == 0 and done.diff.count() == 0


@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_quantiles_are_exact(spark, accuracy):
    import random

    import numpy as np

    from scrubline.plans.profile import exact_quantiles, outlier_bounds

    rng = random.Random(8)
    for values in ([], [3.0], [1.0, 2.0], [5.0] * 40 + [6.0], [float(rng.randint(0, 50)) for _ in range(997)], [rng.gauss(0, 1) for _ in range(5000)]):
        df = spark.createDataFrame([(x,) for x in [*values, None]], "x double")
        found = exact_quantiles(df, [0.0, 0.25, 0.5, 0.75, 1.0], accuracy)
        assert found == ([None] * 5 if not values else pytest.approx(list(np.quantile(values, [0, 0.25, 0.5, 0.75, 1.0]))))
    assert outlier_bounds(spark.createDataFrame([(x,) for x in [*range(20), 1000]], "x long"), "x").first().n_outliers == 1
    assert outlier_bounds(spark.createDataFrame([], "x double"), "x").first().n_outliers == 0


def test_values_behind_the_first_50000_are_seen(spark):
    from scrubline.plans.schema import fitting_formats

    late = F.col("id") >= 50_050
    rows = with_row_id(spark.range(0, 50_100, 1, 2).select(F.when(late, "N/A").otherwise(F.concat(F.lit("v"), F.col("id") % 7)).alias("a"), F.when(late, "31/12/2020").otherwise("2020-12-31").alias("d")))
    issues = {i.kind: i.affected for i in detect(rows, only=["nulls"]) if i.column == "a"}
    assert issues["disguised_nulls"] == 50
    assert len(fitting_formats(rows, "d")) == 2


def test_mappings_of_any_size(spark):
    mapping = {f"K{i}": None if i == 7 else f"v{i}" for i in range(1000)}
    df = spark.createDataFrame([(" k5 ", 1), ("K7", 2), ("other", 3), (None, 4), ("K999", 5)], "k string, n int")
    for fold, want in ((False, [" k5 ", None, "other", None, "v999"]), (True, ["v5", None, "other", None, "v999"])):
        recipe = Recipe.from_dict({"columns": {"k": {"ops": [{"normalize_values": {"map": mapping, "case_insensitive": fold}}]}}})
        assert [r.k for r in execute(recipe, df).output().orderBy("n").collect()] == want
