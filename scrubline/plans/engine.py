"""A recipe compiled to one lazy plan, and what it changes.

Column operations and renames become projections, table operations windows and
filters, checks boolean columns. The values before travel in the same row, so
the cell-level difference needs no join.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.errors import RecipeError, ScrublineError, ValidationFailure
from scrubline.functions import columns as c
from scrubline.plans.ops import check_column
from scrubline.plans.recipe import Recipe, ValidationRule
from scrubline.plans.registry import ROW_ID, build_column, op_spec
from scrubline.plans.rows import map_values, with_row_id

REASON = "_quarantine_reason"
MODES = ("review", "auto", "strict")
_BEFORE, _PASS, _WHY = "_before_", "_pass_", "_why"


@dataclass
class Result:
    """The lazy outcome of a recipe.

    cleaned and quarantine keep the row id; dropped has (row_id, reason); diff has
    (row_id, column, before, after) for each changed cell of rows that stayed or
    were removed after the column operations.
    """

    cleaned: DataFrame
    quarantine: DataFrame
    dropped: DataFrame
    diff: DataFrame
    rules: list[ValidationRule] = field(default_factory=list)
    checked: DataFrame | None = None
    renames: dict[str, str] = field(default_factory=dict)
    added: list[str] = field(default_factory=list)
    removed_columns: list[str] = field(default_factory=list)
    log: list[str] = field(default_factory=list)
    recipe: Recipe | None = None
    n_before: DataFrame | None = None

    def output(self) -> DataFrame:
        """The cleaned table without row id."""
        return self.cleaned.drop(ROW_ID)

    def rule_results(self) -> DataFrame:
        """(rule, column, check, on_fail, n_failed) for each rule, in one aggregation."""
        empty = "rule int, column string, check string, on_fail string, n_failed bigint"
        if not self.rules or self.checked is None:
            return self.cleaned.sparkSession.createDataFrame([], empty)
        counts = self.checked.agg(*(F.sum((~F.col(f"{_PASS}{i}")).cast("bigint")).alias(str(i)) for i in range(len(self.rules))))
        cells = [F.struct(F.lit(i).alias("rule"), F.lit(r.column).alias("column"), F.lit(r.check).alias("check"), F.lit(r.on_fail).alias("on_fail"), F.coalesce(F.col(str(i)), F.lit(0)).cast("bigint").alias("n_failed")) for i, r in enumerate(self.rules)]
        return counts.select(F.inline(F.array(*cells)))

    def failed_rows(self) -> DataFrame:
        """(rule, row_id) of every row that fails a rule."""
        if not self.rules or self.checked is None:
            return self.cleaned.sparkSession.createDataFrame([], "rule int, row_id bigint")
        failing = F.array_compact(F.array(*(F.when(~F.col(f"{_PASS}{i}"), F.lit(i)) for i in range(len(self.rules)))))
        return self.checked.select(F.explode(failing).alias("rule"), F.col(ROW_ID).alias("row_id"))

    def changed_counts(self) -> DataFrame:
        """(column, n_changed) over all cells."""
        return self.diff.groupBy("column").agg(F.count(F.lit(1)).alias("n_changed"))

    def summary(self) -> dict:
        """Counts of rows and changes: one job each."""
        changed = {r["column"]: r.n_changed for r in self.changed_counts().collect()}
        return {"rows_out": self.cleaned.count(), "quarantined": self.quarantine.count(), "dropped": self.dropped.count(), "changed_cells": sum(changed.values()), "changed_by_column": changed, "renamed": self.renames, "added_columns": self.added, "removed_columns": self.removed_columns}


def as_text(col: Column, kind: str) -> Column:
    """A value as the text shown in differences."""
    return c.number_text(col) if kind in ("double", "float") else c.cast(col, "string", kind) if kind == "boolean" else col.cast("string")


def without_nan(df: DataFrame) -> DataFrame:
    """df with null for every not-a-number."""
    if not any(t in ("double", "float") for _, t in df.dtypes):
        return df
    return df.select(*(F.when(~F.isnan(f"`{n}`"), F.col(f"`{n}`")).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes))


def _changed(before: Column, after: Column, old: str, new: str) -> Column:
    numeric = {"int", "bigint", "smallint", "tinyint", "float", "double", "boolean"}
    if old == new:
        return ~before.eqNullSafe(after)
    if old in numeric and new in numeric:
        return ~before.cast("double").eqNullSafe(after.cast("double"))
    return before.isNotNull() | after.isNotNull()


def execute(recipe: Recipe, df: DataFrame, mode: str = "review") -> Result:
    """recipe applied to df.

    Columns that df lacks are skipped and logged; mode strict raises instead, and
    raises for every failing check. Rules with the policy error are counted before
    the result is returned, all others stay lazy.
    """
    if mode not in MODES:
        raise ScrublineError(f"mode is one of {', '.join(MODES)}, not {mode!r}")
    if len(set(df.columns)) < len(df.columns):
        raise ScrublineError("column names are not unique")
    work = without_nan(with_row_id(df))
    source = [x for x in df.columns if x != ROW_ID]
    rules = list(recipe.validations)
    log: list[str] = []
    # Only columns that operations or rules may change carry their value before.
    back = {x.rename_to: x.source for x in recipe.columns if x.rename_to}
    touched = [x for x in source if x in {r.source for r in recipe.columns if r.ops} | {back.get(r.column, r.column) for r in rules}]
    kinds = dict(work.dtypes)
    work = work.select("*", *(F.col(f"`{x}`").alias(f"{_BEFORE}{x}") for x in touched))
    derived: set[str] = set()
    for column in recipe.columns:
        if column.source not in work.columns:
            message = f"recipe column {column.source!r} is not in the data"
            if mode == "strict":
                raise ScrublineError(message)
            log.append(f"skipped: {message}")
            continue
        emitted: set[str] = set()
        for op in column.ops:
            if op_spec(op.name).scope == "stateful":
                work = op_spec(op.name).build(work, column.source, **op.params)
                continue
            if op.name == "normalize_values" and len(op.params["mapping"]) > c.MOST_LITERAL_KEYS:
                work = map_values(work, column.source, op.params["mapping"], op.params["case_insensitive"])
                continue
            made = build_column(op.name, F.col(f"`{column.source}`"), dict(work.dtypes)[column.source], op.params)
            for name in made.emit:
                name = name or f"{column.source}_currency"
                if name in derived or name in emitted:
                    raise ScrublineError(f"two operations make the column {name!r}")
                emitted.add(name)
                if name in source and f"{_BEFORE}{name}" not in work.columns:
                    work = work.withColumn(f"{_BEFORE}{name}", F.col(f"`{name}`"))
                    touched.append(name)
            work = work.withColumns({column.source: made.column} | {n or f"{column.source}_currency": col for n, col in made.emit.items()})
        derived |= {x for x in emitted if x not in source}
    rename = {x.source: x.rename_to for x in recipe.columns if x.rename_to and x.rename_to != x.source and x.source in work.columns}
    names = [rename.get(x, x) for x in work.columns]
    if len(set(names)) < len(names):
        raise ScrublineError(f"renaming makes a column twice: {', '.join(sorted({x for x in names if names.count(x) > 1}))}")
    work = work.select(*(F.col(f"`{x}`").alias(rename.get(x, x)) for x in work.columns))
    lost: list[DataFrame] = []
    removed_columns: list[str] = []
    for op in recipe.frame_ops:
        before = work
        work = op_spec(op.name).build(work, **op.params)
        removed_columns += [x for x in before.columns if x not in work.columns and not x.startswith("_")]
        if op.name != "drop_columns":
            gone = before.join(work.select(ROW_ID), ROW_ID, "left_anti")
            lost.append(gone.withColumn(_WHY, F.lit(op.name)))
    applied: list[ValidationRule] = []
    passes: list[Column] = []
    now = dict(work.dtypes)
    for rule in rules:
        if rule.column not in now:
            if mode == "strict":
                raise ValidationFailure(f"check {rule.label} has no column in the data", [rule])
            log.append(f"skipped: check {rule.label} has no column in the data")
            continue
        policy = "error" if mode == "strict" else rule.on_fail
        applied.append(ValidationRule(rule.column, rule.check, policy, rule.params))
        passes.append(F.coalesce(check_column(rule.check, rule.params, F.col(f"`{rule.column}`"), now[rule.column]), F.lit(False)))
    checked = work.select("*", *(p.alias(f"{_PASS}{i}") for i, p in enumerate(passes)))
    errors = [i for i, r in enumerate(applied) if r.on_fail == "error"]
    if errors:
        counts = checked.agg(*(F.sum((~F.col(f"{_PASS}{i}")).cast("bigint")) for i in errors)).first()
        failures = [(applied[i], n) for i, n in zip(errors, counts) if n]
        if failures:
            raise ValidationFailure("checks failed: " + "; ".join(f"{r.label} ({n} rows)" for r, n in failures), [r for r, _ in failures])
    fails = lambda policy: [(~F.col(f"{_PASS}{i}"), r.label) for i, r in enumerate(applied) if r.on_fail in policy]
    anyone = lambda policy: reduce(lambda a, b: a | b, [f for f, _ in fails(policy)], F.lit(False))
    reasons = F.concat_ws("; ", *(F.when(f, F.lit(label)) for f, label in fails(("quarantine", "drop"))))
    inner = [x for x in checked.columns if x.startswith((_PASS, _BEFORE))]
    quarantine = checked.filter(anyone(("quarantine",))).withColumn(REASON, reasons).drop(*inner)
    removed = checked.filter(anyone(("quarantine", "drop"))).withColumn(_WHY, reasons)
    blanked = {}
    for i, r in enumerate(applied):
        if r.on_fail == "null":
            blanked[r.column] = F.when(F.col(f"{_PASS}{i}"), blanked.get(r.column, F.col(f"`{r.column}`")))
    kept = checked.filter(~anyone(("quarantine", "drop"))).withColumns(blanked)
    cleaned = kept.drop(*inner)
    gone = [removed.drop(*(x for x in inner if x.startswith(_PASS))), *lost]
    outputs = [(x, rename.get(x, x)) for x in touched]
    parts = [kept, *gone]
    changes = []
    for part in parts:
        have = dict(part.dtypes)
        cells = [
            F.when(_changed(F.col(f"`{_BEFORE}{old}`"), F.col(f"`{new}`"), kinds[old], have[new]), F.struct(F.lit(new).alias("column"), as_text(F.col(f"`{_BEFORE}{old}`"), kinds[old]).alias("before"), as_text(F.col(f"`{new}`"), have[new]).alias("after")))
            for old, new in outputs if new in have
        ]
        if cells:
            changes.append(part.select(F.col(ROW_ID).alias("row_id"), F.inline(F.array_compact(F.array(*cells)))))
    spark = df.sparkSession
    diff = reduce(DataFrame.unionByName, changes) if changes else spark.createDataFrame([], T.StructType([T.StructField("row_id", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("column", "before", "after"))]))
    dropped = reduce(DataFrame.unionByName, [p.select(F.col(ROW_ID).alias("row_id"), F.col(_WHY).alias("reason")) for p in gone])
    order = [x for x in names if x in cleaned.columns]
    return Result(cleaned.select(*(F.col(f"`{x}`") for x in order)), quarantine, dropped, diff, applied, checked, rename, sorted(derived), removed_columns, log, recipe)


def diff_text(diff: DataFrame, limit: int = 8, colour: bool = False, ascii_only: bool = False) -> str:
    """The first changes of each column as text, like a version control's difference."""
    from pyspark.sql.window import Window

    ranked = diff.withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy("row_id"))).filter(F.col("k") <= limit)
    red, green, end = ("\033[31m", "\033[32m", "\033[0m") if colour else ("", "", "")
    arrow = "->" if ascii_only else "→"
    lines, last = [], None
    for r in ranked.orderBy("column", "row_id").collect():
        if r["column"] != last:
            last = r["column"]
            lines.append(f"@@ {last}")
        lines.append(f"  row {r.row_id}: {red}{'null' if r.before is None else repr(r.before)}{end} {arrow} {green}{'null' if r.after is None else repr(r.after)}{end}")
    return "\n".join(lines)


def check_recipe(recipe: Recipe) -> None:
    """Raise if a check of the recipe is not known."""
    from scrubline.plans.ops import known_check

    for rule in recipe.validations:
        if not known_check(rule.check):
            raise RecipeError(f"unknown check {rule.check!r}")
