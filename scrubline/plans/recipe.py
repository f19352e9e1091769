"""The recipe: a readable, replayable plan for cleaning a table."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from scrubline.errors import RecipeError
from scrubline.plans import ops as _ops
from scrubline.plans.registry import OPS, op_spec

VERSION = 1
POLICIES = ("quarantine", "drop", "null", "warn", "error")
_TOP = {"version", "source_fingerprint", "columns", "frame_ops", "dedup", "drop_columns", "validate", "validations", "read", "meta", "name"}


@dataclass(frozen=True)
class Op:
    """An operation with its full parameters."""

    name: str
    params: dict = field(default_factory=dict)

    @classmethod
    def of(cls, raw: Any) -> Op:
        if isinstance(raw, Op):
            return raw
        if isinstance(raw, str):
            return cls(raw, _ops.normalize_op(raw, None))
        if isinstance(raw, dict) and len(raw) == 1:
            name, params = next(iter(raw.items()))
            return cls(str(name), _ops.normalize_op(str(name), params))
        raise RecipeError(f"an operation is a name or one name with parameters, not {raw!r}")

    def short(self) -> Any:
        """The form written in recipes."""
        compact = op_spec(self.name).compact(self.params)
        return self.name if compact is None else {self.name: compact}


@dataclass
class ColumnRecipe:
    """What happens to one source column."""

    source: str
    ops: list[Op] = field(default_factory=list)
    rename_to: str | None = None


@dataclass
class ValidationRule:
    """A check on an output column, and what happens to rows that fail."""

    column: str
    check: str
    on_fail: str = "quarantine"
    params: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.on_fail not in POLICIES:
            raise RecipeError(f"on_fail is one of {', '.join(POLICIES)}, not {self.on_fail!r}")

    @property
    def label(self) -> str:
        return f"{self.column}:{self.check}"


@dataclass
class Recipe:
    """Column operations, table operations and checks, in order."""

    columns: list[ColumnRecipe] = field(default_factory=list)
    frame_ops: list[Op] = field(default_factory=list)
    validations: list[ValidationRule] = field(default_factory=list)
    fingerprint: dict | None = None
    read: dict = field(default_factory=dict)
    meta: dict = field(default_factory=dict)
    version: int = VERSION

    @classmethod
    def from_dict(cls, raw: dict) -> Recipe:
        if not isinstance(raw, dict):
            raise RecipeError("a recipe is a mapping")
        if unknown := set(map(str, raw)) - _TOP:
            raise RecipeError(f"unknown keys in the recipe: {', '.join(sorted(unknown))}")
        version = raw.get("version", VERSION)
        if not isinstance(version, int) or not 1 <= version <= 2:
            raise RecipeError(f"recipes of version {version!r} are not known")
        frame = [Op.of({"dedup": raw["dedup"]})] if raw.get("dedup") is not None and raw.get("dedup") is not False else []
        frame += [Op.of({"drop_columns": raw["drop_columns"]})] if raw.get("drop_columns") else []
        frame += [Op.of(x) for x in raw.get("frame_ops") or []]
        for op in frame:
            if op_spec(op.name).scope != "frame":
                raise RecipeError(f"{op.name} is no operation on tables")
        return cls(cls._columns(raw.get("columns") or {}), frame, [cls._rule(x) for x in raw.get("validate", raw.get("validations")) or []], raw.get("source_fingerprint"), dict(raw.get("read") or {}), dict(raw.get("meta") or {}), version)

    @staticmethod
    def _columns(raw: Any) -> list[ColumnRecipe]:
        if isinstance(raw, list):
            entries = [((x.get("source") or x.get("name")), {k: v for k, v in x.items() if k not in ("source", "name")}) if isinstance(x, dict) else (x, {}) for x in raw]
        elif isinstance(raw, dict):
            entries = list(raw.items())
        else:
            raise RecipeError("columns is a mapping or a list")
        made = []
        for source, body in entries:
            if source is None:
                raise RecipeError("a column needs a source")
            body = {"ops": body} if isinstance(body, list) else dict(body or {})
            found = [Op.of(x) for x in body.pop("ops", None) or []]
            rename = body.pop("rename_to", body.pop("rename", None))
            # Operations may also stand beside ops, in the order of their keys.
            for name, params in body.items():
                if name not in OPS:
                    raise RecipeError(f"column {source!r} has the unknown key {name!r}")
                if params is not False:
                    found.append(Op.of(name if params is True or params is None else {name: params}))
            if frame := [x.name for x in found if op_spec(x.name).scope == "frame"]:
                raise RecipeError(f"{frame[0]} is no operation on columns")
            made.append(ColumnRecipe(str(source), found, None if rename is None else str(rename)))
        if len({x.source for x in made}) < len(made):
            raise RecipeError("a source column appears twice")
        return made

    @staticmethod
    def _rule(raw: Any) -> ValidationRule:
        if not isinstance(raw, dict):
            raise RecipeError(f"a check is a mapping, not {raw!r}")
        raw = dict(raw)
        if "column" not in raw and len(raw) == 1:
            column, check = next(iter(raw.items()))
            return ValidationRule(str(column), str(check))
        if "column" not in raw or "check" not in raw:
            raise RecipeError(f"a check needs column and check: {raw!r}")
        column, check = str(raw.pop("column")), str(raw.pop("check"))
        return ValidationRule(column, check, str(raw.pop("on_fail", "quarantine")), raw)

    @classmethod
    def from_yaml(cls, text: str) -> Recipe:
        try:
            return cls.from_dict(yaml.safe_load(text) or {})
        except yaml.YAMLError as e:
            raise RecipeError(f"the recipe is no YAML: {e}") from e

    @classmethod
    def load(cls, path: str | Path) -> Recipe:
        return cls.from_yaml(Path(path).read_text("utf-8-sig"))

    def to_dict(self) -> dict:
        made: dict[str, Any] = {"version": self.version}
        if self.fingerprint:
            made["source_fingerprint"] = self.fingerprint
        if self.read:
            made["read"] = self.read
        made["columns"] = {c.source: {k: v for k, v in (("rename_to", c.rename_to), ("ops", [o.short() for o in c.ops])) if v} for c in self.columns}
        if self.frame_ops:
            made["frame_ops"] = [o.short() for o in self.frame_ops]
        if self.validations:
            made["validate"] = [{"column": r.column, "check": r.check, "on_fail": r.on_fail, **r.params} for r in self.validations]
        if self.meta:
            made["meta"] = self.meta
        return made

    def to_yaml(self) -> str:
        return yaml.safe_dump(self.to_dict(), sort_keys=False, allow_unicode=True)

    def save(self, path: str | Path) -> None:
        with open(path, "w", encoding="utf-8", newline="\n") as file:
            file.write(self.to_yaml())


@dataclass
class WorkbookRecipe:
    """The recipes of a workbook's sheets by name, kept in one file under the key sheets."""

    sheets: dict[str, Recipe] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, raw: dict) -> WorkbookRecipe:
        if not isinstance(raw, dict) or not isinstance(raw.get("sheets"), dict):
            raise RecipeError("the recipe of a workbook has sheets by name")
        return cls({str(name): Recipe.from_dict(body or {}) for name, body in raw["sheets"].items()}, dict(raw.get("meta") or {}))

    def to_dict(self) -> dict:
        made: dict[str, Any] = {"version": 2, "sheets": {name: recipe.to_dict() for name, recipe in self.sheets.items()}}
        return made | ({"meta": self.meta} if self.meta else {})

    def to_yaml(self) -> str:
        return yaml.safe_dump(self.to_dict(), sort_keys=False, allow_unicode=True)

    def save(self, path: str | Path) -> None:
        with open(path, "w", encoding="utf-8", newline="\n") as file:
            file.write(self.to_yaml())


def load_any(path: str | Path) -> Recipe | WorkbookRecipe:
    """The recipe in a file: that of a workbook if it has sheets."""
    try:
        raw = yaml.safe_load(Path(path).read_text("utf-8-sig")) or {}
    except yaml.YAMLError as e:
        raise RecipeError(f"the recipe is no YAML: {e}") from e
    return WorkbookRecipe.from_dict(raw) if isinstance(raw, dict) and "sheets" in raw else Recipe.from_dict(raw)
