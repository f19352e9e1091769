"""From issues to a recipe: a fix is taken if it is sure enough, and in one order."""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import DataFrame

from scrubline.plans.detectors import Issue, detect
from scrubline.plans.drift import fingerprint
from scrubline.plans.names import snake_case
from scrubline.plans.profile import Profile, profile
from scrubline.plans.recipe import ColumnRecipe, Op, Recipe, ValidationRule
from scrubline.plans.registry import op_spec
from scrubline.plans.rows import with_row_id
from scrubline.plans.schema import Schema, resolve_schema

THRESHOLDS = {"review": 0.5, "auto": 0.65, "strict": 0.85}
# The order of operations, and which ones do the work of others.
OP_ORDER = [
    "strip_whitespace", "collapse_whitespace", "to_na", "extract_currency", "remove_symbols", "normalize_unit", "parse_number", "round", "cast", "parse_date",
    "normalize_email", "normalize_phone", "replace", "normalize_values", "capitalize", "title_case", "lowercase", "uppercase", "fill_na",
]
SUBSUMES = {"normalize_email": {"strip_whitespace", "collapse_whitespace", "lowercase"}, "collapse_whitespace": {"strip_whitespace"}, "title_case": {"strip_whitespace", "collapse_whitespace"}}


class Planner(Protocol):
    """Anything that makes a recipe of a table, its profile and its issues."""

    def plan(self, df: DataFrame, known: Profile, issues: list[Issue], *, schema: Schema | None = None, mode: str = "review") -> Recipe: ...


def ordered(ops: list[Op]) -> list[Op]:
    """ops without repetitions and what others do already, in the canonical order."""
    seen, kept = set(), []
    for op in ops:
        key = (op.name, json.dumps(op.params, sort_keys=True, default=str))
        if key not in seen:
            seen.add(key)
            kept.append(op)
    covered = set().union(*(SUBSUMES.get(o.name, set()) for o in kept)) if kept else set()
    rank = {name: i for i, name in enumerate(OP_ORDER)}
    return sorted((o for o in kept if o.name not in covered), key=lambda o: rank.get(o.name, len(rank)))


def unique_names(wanted: dict[str, tuple[int, str]]) -> dict[str, str]:
    """A name for each column: the wanted one, with a number where an earlier or surer column has it."""
    taken: set[str] = set()
    names = {}
    for source in sorted(wanted, key=lambda s: (wanted[s][0], list(wanted).index(s))):
        name, k = wanted[source][1], 1
        while name in taken:
            k += 1
            name = f"{wanted[source][1]}_{k}"
        taken.add(name)
        names[source] = name
    return {s: names[s] for s in wanted}


class RulePlanner:
    """The planner by fixed rules."""

    def plan(self, df: DataFrame, known: Profile, issues: list[Issue], *, schema: Schema | None = None, mode: str = "review") -> Recipe:
        least = THRESHOLDS[mode]
        sure = [i for i in issues if (i.ops or i.rename_to) and i.confidence >= least]
        omitted = [i for i in issues if (i.ops or i.rename_to) and i.confidence < least]
        open_issues = [i for i in issues if not i.ops and not i.rename_to and i.severity != "info"]
        ops: dict[str, list[Op]] = {name: [] for name in known.columns}
        frame: list[Op] = []
        wanted = {name: (2, snake_case(name)) for name in known.columns}
        for issue in sure:
            made = [Op.of(x) for x in issue.ops]
            if issue.column is None:
                frame += [o for o in made if op_spec(o.name).scope == "frame" and o not in frame]
                continue
            ops[issue.column] += made
            rank = {"schema_mapping": 0, "currency": 1}.get(issue.source, 2)
            if issue.rename_to and rank < wanted[issue.column][0]:
                wanted[issue.column] = (rank, issue.rename_to)
        names = unique_names(wanted)
        targets = {x.name: x for x in schema.columns} if schema else {}
        for source, target in names.items():
            kind = targets[target].dtype if target in targets else None
            p = known.columns[source]
            if kind in ("integer", "float") and p.dtype == "string" and not any(o.name == "parse_number" for o in ops[source]):
                ops[source].append(Op.of("parse_number"))
            if kind == "integer":
                ops[source].append(Op.of({"cast": "integer"}))
            if kind in ("date", "datetime") and p.dtype == "string":
                ops[source] = [o for o in ops[source] if o.name != "parse_date"]
                formats = targets[target].date_formats
                ops[source].append(Op.of({"parse_date": {"formats": formats, "output": "%Y-%m-%d" if kind == "date" else "datetime"}}))
        columns = [ColumnRecipe(s, ordered(ops[s]), n if n != s else None) for s, n in names.items() if ops[s] or n != s]
        rules = self._rules(known, names, targets)
        notes = [f"{len(omitted)} fixes of low confidence left out: {', '.join(sorted({i.kind for i in omitted}))}"] if omitted else []
        notes += [f"{len(open_issues)} issues need a decision: {', '.join(sorted({i.kind for i in open_issues}))}"] if open_issues else []
        return Recipe(columns, frame, rules, meta={"generated_by": "rules", "mode": mode} | ({"notes": notes} if notes else {}))

    @staticmethod
    def _rules(known: Profile, names: dict[str, str], targets: dict) -> list[ValidationRule]:
        rules = []
        for source, target in names.items():
            kind = known.columns[source].semantic_type
            want = targets.get(target)
            if want:
                rules += [ValidationRule(target, "not_null")] if want.required else []
                rules += [ValidationRule(target, "unique")] if want.unique else []
                rules += [ValidationRule(target, f">= {want.min:g}")] if want.min is not None else []
                rules += [ValidationRule(target, f"<= {want.max:g}")] if want.max is not None else []
                rules += [ValidationRule(target, "in", params={"values": list(want.allowed_values)})] if want.allowed_values else []
                kind = want.dtype if want.dtype in ("email", "phone", "url") else None
            if kind in ("email", "phone", "url"):
                rules.append(ValidationRule(target, f"valid_{kind}"))
        return rules


def plan_recipe(df: DataFrame, schema: Schema | dict | str | None = None, mode: str = "review", planner: Planner | None = None) -> Recipe:
    """Profile, detect and plan: the recipe for a table."""
    rows = with_row_id(df)
    known, want = profile(rows), resolve_schema(schema)
    recipe = (planner or RulePlanner()).plan(rows, known, detect(rows, known, want), schema=want, mode=mode)
    recipe.fingerprint = fingerprint(rows)
    return recipe
