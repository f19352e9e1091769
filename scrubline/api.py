"""The engine's front: clean, replay, report, update, workbooks."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from scrubline.errors import DriftError, RecipeError
from scrubline.plans import export
from scrubline.plans.detectors import Issue, detect, quality_score
from scrubline.plans.drift import Finding, detect_drift, fingerprint, suggest_update
from scrubline.plans.engine import Result, execute
from scrubline.plans.planner import Planner, RulePlanner
from scrubline.plans.profile import Profile, profile
from scrubline.plans.recipe import Recipe, WorkbookRecipe, load_any
from scrubline.plans.registry import ROW_ID
from scrubline.plans.rows import with_row_id
from scrubline.plans.schema import Schema, infer_schema, resolve_schema
from scrubline.sources import xlsx
from scrubline.sources.files import csv_options, read_table, write_table, write_text


@dataclass
class CleanResult:
    """The outcome of cleaning: the recipe, what it did, and what was found before."""

    recipe: Recipe
    result: Result
    profile: Profile | None = None
    issues: list[Issue] = field(default_factory=list)
    drift: list[Finding] = field(default_factory=list)

    @property
    def data(self) -> DataFrame:
        return self.result.output()

    @property
    def quarantine(self) -> DataFrame:
        return self.result.quarantine.drop(ROW_ID)

    @property
    def quality(self) -> float | None:
        return quality_score(self.profile, self.issues) if self.profile else None

    def code(self) -> str:
        return export.generate_code(self.recipe)

    def save_all(self, prefix: str | Path) -> None:
        """Recipe, code, clean rows, held rows and report, all under one prefix."""
        self.recipe.save(f"{prefix}.recipe.yaml")
        write_text(f"{prefix}.py", self.code())
        write_table(self.result.cleaned, f"{prefix}.clean.csv")
        write_table(self.result.quarantine, f"{prefix}.quarantine.csv")
        write_text(f"{prefix}.report.html", export.result_report(self.result))


def _recipe(recipe: Recipe | dict | str | Path) -> Recipe:
    return recipe if isinstance(recipe, Recipe) else Recipe.from_dict(recipe) if isinstance(recipe, dict) else Recipe.load(recipe)


def _read(spark: SparkSession, source: Any, **how: Any) -> DataFrame:
    return read_table(spark, source, numbered=True, **{k: v for k, v in how.items() if v is not None})


def clean(spark: SparkSession, source: str | Path | DataFrame, *, schema: Any = None, mode: str = "review", planner: Planner | None = None, **how: Any) -> CleanResult:
    """Profile, detect, plan and clean a table. The way a file is read is pinned in the recipe."""
    is_csv = not isinstance(source, DataFrame) and Path(source).suffix.lower() in (".csv", ".txt", "") and Path(source).is_file()
    found = csv_options(source) if is_csv else {}
    rows = with_row_id(_read(spark, source, **how))
    known, want = profile(rows), resolve_schema(schema)
    issues = detect(rows, known, want)
    recipe = (planner or RulePlanner()).plan(rows, known, issues, schema=want, mode=mode)
    recipe.fingerprint = fingerprint(rows)
    recipe.read = found | {k: v for k, v in how.items() if v is not None}
    return CleanResult(recipe, execute(recipe, rows, mode), known, issues)


def apply_recipe(spark: SparkSession, source: str | Path | DataFrame, recipe: Recipe | dict | str | Path, *, mode: str = "review", on_drift: str = "warn", **how: Any) -> CleanResult:
    """Replay a recipe. How to read: the arguments, else the recipe's read, else the whole file. Changes of columns raise with on_drift="error" or in strict mode."""
    plan = _recipe(recipe)
    given = {k: v for k, v in how.items() if v is not None}
    if not isinstance(source, DataFrame):
        given = {k: v for k, v in plan.read.items() if k in ("sheet", "columns", "nrows", "skiprows", "sep", "encoding")} | given
    df = _read(spark, source, **given)
    found = detect_drift(plan, df) if on_drift != "ignore" else []
    serious = [f for f in found if f.severity != "info"]
    if serious and (on_drift == "error" or mode == "strict"):
        raise DriftError("; ".join(f.message for f in serious))
    return CleanResult(plan, execute(plan, df, mode), drift=found)


def report(spark: SparkSession, source: str | Path | DataFrame, out: str | Path | None = None, schema: Any = None, **how: Any) -> tuple[Profile, list[Issue], float]:
    """Profile, issues and quality of a table, as a page where out is given."""
    rows = with_row_id(_read(spark, source, **how))
    known = profile(rows)
    issues = detect(rows, known, resolve_schema(schema))
    if out:
        write_text(out, export.profile_report(known, issues))
    return known, issues, quality_score(known, issues)


def update(spark: SparkSession, source: str | Path | DataFrame, recipe: Recipe | dict | str | Path, **how: Any) -> tuple[Recipe, list[Finding]]:
    """A recipe fitted to a changed input, and the changes."""
    return suggest_update(_recipe(recipe), _read(spark, source, **how))


def schema_of(spark: SparkSession, source: str | Path | DataFrame, **how: Any) -> Schema:
    return infer_schema(_read(spark, source, **how))


def read_workbook(spark: SparkSession, source: str | Path | dict[str, DataFrame], sheets: list[str] | None = None) -> dict[str, DataFrame]:
    """The sheets of a workbook by name, in order."""
    if isinstance(source, dict):
        return {k: v for k, v in source.items() if sheets is None or k in sheets}
    names = xlsx.sheet_names(source)
    if sheets and (missing := [s for s in sheets if s not in names]):
        raise RecipeError(f"no sheets {', '.join(missing)}")
    return {s: xlsx.read_sheet(spark, source, s) for s in names if sheets is None or s in sheets}


def clean_workbook(spark: SparkSession, source: str | Path | dict[str, DataFrame], sheets: list[str] | None = None, mode: str = "review") -> dict[str, CleanResult]:
    return {name: clean(spark, df, mode=mode) for name, df in read_workbook(spark, source, sheets).items()}


def workbook_recipe(results: dict[str, CleanResult]) -> WorkbookRecipe:
    """The recipes of cleaned sheets, to be saved as one file."""
    return WorkbookRecipe({name: r.recipe for name, r in results.items()})


def apply_workbook(spark: SparkSession, source: str | Path | dict[str, DataFrame], recipes: WorkbookRecipe | dict[str, Any] | str | Path, mode: str = "review", on_drift: str = "warn") -> dict[str, CleanResult]:
    """Each sheet through its recipe; recipes come by sheet, or from the file of a workbook. Sheets without recipe are left out."""
    found = load_any(recipes) if isinstance(recipes, (str, Path)) else recipes
    if isinstance(found, Recipe):
        raise RecipeError(f"{recipes} holds the recipe of a single table")
    plans = found.sheets if isinstance(found, WorkbookRecipe) else WorkbookRecipe.from_dict(found).sheets if set(found) <= {"version", "sheets", "meta"} and "sheets" in found else found
    return {name: apply_recipe(spark, df, plans[name], mode=mode, on_drift=on_drift) for name, df in read_workbook(spark, source).items() if name in plans}


def save_workbook(results: dict[str, CleanResult], path: str | Path, source: str | Path | None = None, overwrite: bool = False) -> None:
    """All clean sheets as one workbook; not over the source unless told to."""
    if source and Path(path).resolve() == Path(source).resolve() and not overwrite:
        raise RecipeError("the workbook would overwrite its source")
    xlsx.write_book(path, {name: r.data for name, r in results.items()})
