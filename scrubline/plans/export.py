"""A recipe as a PySpark module of its own, and reports as HTML."""

from __future__ import annotations

import html
import json

from scrubline.plans.detectors import SEVERITY, Issue, quality_score
from scrubline.plans.engine import Result
from scrubline.plans.profile import Profile
from scrubline.plans.recipe import Recipe

_MODULE = '''"""Generated from a recipe: clean(df) gives the clean rows and the rows held back."""

from pyspark.sql import DataFrame

from scrubline.plans.engine import execute
from scrubline.plans.recipe import Recipe

RECIPE = Recipe.from_dict({recipe})


def clean(df: DataFrame, mode: str = "review") -> tuple[DataFrame, DataFrame]:
    done = execute(RECIPE, df, mode)
    return done.output(), done.quarantine


if __name__ == "__main__":
    import sys

    from pyspark.sql import SparkSession

    from scrubline.sources.files import read_table, write_table

    spark = SparkSession.builder.getOrCreate()
    rows, held = clean(read_table(spark, sys.argv[1]))
    write_table(rows, sys.argv[2])
    write_table(held, sys.argv[2] + ".quarantine.csv")
'''


def generate_code(recipe: Recipe) -> str:
    """A runnable module that replays the recipe; it compiles to the same plan as the recipe itself."""
    literal = repr(json.loads(json.dumps(recipe.to_dict(), default=str)))
    return _MODULE.replace("{recipe}", literal)


def _table(head: list[str], rows: list[list]) -> str:
    cell = lambda x: html.escape("" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x))
    return "<table><tr>" + "".join(f"<th>{cell(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{cell(x)}</td>" for x in r) + "</tr>" for r in rows) + "</table>"


_PAGE = '<!doctype html><html><head><meta charset="utf-8"><title>{title}</title><style>body{{font:14px sans-serif;margin:2em}}table{{border-collapse:collapse;margin:1em 0}}td,th{{border:1px solid #ccc;padding:.3em .6em;text-align:left}}</style></head><body><h1>{title}</h1>{body}</body></html>'


def profile_report(known: Profile, issues: list[Issue], title: str = "Data quality") -> str:
    """Columns and issues of a table as a page, the severest first."""
    columns = _table(["column", "type", "semantic type", "nulls", "distinct", "min", "max", "mean", "frequent values"], [[p.name, p.dtype, p.semantic_type, p.null_count, p.unique_count, p.min_value, p.max_value, p.mean_value, ", ".join(f"{v} ({n})" for v, n in p.top_values[:5])] for p in known.columns.values()])
    ranked = sorted(issues, key=lambda i: (-SEVERITY[i.severity], i.column or "", i.kind))
    found = _table(["severity", "column", "kind", "message", "confidence"], [[i.severity, i.column, i.kind, i.message, i.confidence] for i in ranked])
    return _PAGE.format(title=html.escape(title), body=f"<p>{known.n_rows} rows, {known.duplicate_rows} repeated. Quality {quality_score(known, issues)} of 100.</p>{columns}<h2>Issues</h2>{found}")


def result_report(result: Result, title: str = "Cleaning") -> str:
    """What a recipe did as a page."""
    s = result.summary()
    rules = _table(["column", "check", "on fail", "failed"], [[r["column"], r["check"], r.on_fail, r.n_failed] for r in result.rule_results().orderBy("rule").collect()])
    changes = _table(["column", "changed cells"], sorted(s["changed_by_column"].items()))
    return _PAGE.format(title=html.escape(title), body=f"<p>{s['rows_out']} rows out, {s['quarantined']} held back, {s['dropped']} removed.</p>{rules}{changes}")
