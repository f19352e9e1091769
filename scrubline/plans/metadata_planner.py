"""A planner that asks a language model, which sees metadata only and answers with a recipe only."""

from __future__ import annotations

import json
import random
import re
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.errors import RecipeError, ScrublineError
from scrubline.functions.columns import value_pattern
from scrubline.plans.detectors import Issue
from scrubline.plans.planner import RulePlanner
from scrubline.plans.profile import Profile
from scrubline.plans.recipe import Recipe
from scrubline.plans.registry import OPS
from scrubline.plans.schema import Schema

#: Values of a column of which patterns may be shown, characters of a prompt, and operations an answer must not hold.
PATTERN_VALUES, MOST_PROMPT, BLOCKED = 500, 60_000, frozenset({"fill_na"})
SYSTEM = "You plan data cleaning. Answer with one JSON object, a recipe with the keys columns, frame_ops and validate. Use only the operations listed. Never invent values."


class Client(Protocol):
    """A language model."""

    def complete(self, system: str, user: str, max_tokens: int) -> str: ...


def redacted(values: list[str], column: str, n: int = 10) -> list[str]:
    """n values in an order that depends on the column only, with letters and digits hidden."""
    picked = sorted(set(values))
    random.Random(column).shuffle(picked)
    return [re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "9", v)) for v in picked[:n]]


def metadata(df: DataFrame, known: Profile, issues: list[Issue], schema: Schema | None = None) -> dict:
    """What the model sees: statistics, value patterns and findings, but no values."""
    columns = {}
    for name, p in known.columns.items():
        patterns = []
        if p.dtype == "string" and p.count:
            first = df.filter(F.col(f"`{name}`").isNotNull()).limit(PATTERN_VALUES)
            patterns = [r.p for r in first.groupBy(value_pattern(F.col(f"`{name}`")).alias("p")).count().orderBy(F.desc("count"), "p").limit(8).collect()]
        columns[name] = {"dtype": p.dtype, "semantic_type": p.semantic_type, "nulls": p.null_count, "distinct": p.unique_count, "patterns": patterns, "signals": p.signals}
    found = [{"column": i.column, "kind": i.kind, "severity": i.severity, "confidence": i.confidence, "proposal": i.ops} for i in issues if i.kind not in ("category_variants", "near_duplicates")]
    return {"rows": known.n_rows, "columns": columns, "issues": found, "operations": sorted(set(OPS) - BLOCKED), "schema": schema.to_dict() if schema else None}


def first_object(text: str) -> dict:
    """The first complete JSON object in an answer."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            found, _ = decoder.raw_decode(text[m.start() :])
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    raise RecipeError("the answer holds no JSON object")


class MetadataPlanner:
    """Asks the client; any failure falls back to the rules, with a note in the recipe."""

    def __init__(self, client: Client, max_tokens: int = 4_000, fallback: Any = None):
        self.client, self.max_tokens, self.fallback = client, max_tokens, fallback or RulePlanner()

    def plan(self, df: DataFrame, known: Profile, issues: list[Issue], *, schema: Schema | None = None, mode: str = "review") -> Recipe:
        try:
            prompt = json.dumps(metadata(df, known, issues, schema), default=str, ensure_ascii=False)
            if len(prompt) > MOST_PROMPT:
                raise ScrublineError("the metadata exceeds the budget")
            raw = first_object(self.client.complete(SYSTEM, prompt, self.max_tokens))
            recipe = Recipe.from_dict({k: v for k, v in raw.items() if k in ("columns", "frame_ops", "validate")})
            if blocked := {o.name for x in recipe.columns for o in x.ops} & BLOCKED:
                raise RecipeError(f"the answer uses {', '.join(sorted(blocked))}")
            if missing := [x.source for x in recipe.columns if x.source not in known.columns]:
                raise RecipeError(f"the answer names unknown columns {', '.join(missing)}")
            recipe.meta = {"generated_by": "model", "mode": mode}
            return recipe
        except Exception as e:  # noqa: BLE001 - a model may fail in any way; the rules always give a plan
            recipe = self.fallback.plan(df, known, issues, schema=schema, mode=mode)
            recipe.meta["notes"] = [*recipe.meta.get("notes", []), f"planned by rules: {e}"]
            return recipe
