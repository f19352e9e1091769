"""The operations, checks and detectors known by name, and how users add theirs.

A column operation takes a Column and gives a Column, or one with derived
columns beside it; kind="pandas" takes a function on pandas Series instead,
which runs in Arrow batches. A table operation takes and gives a DataFrame and
must keep the row id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubline.errors import OpError, RecipeError

ROW_ID = "_rid"


@dataclass(frozen=True)
class Made:
    """What a column operation makes: the column, and derived columns by name."""

    column: Column
    emit: dict[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class OpSpec:
    """An operation: build(column, kind, **params), or (df, column name, **params) for scope "stateful" and (df, **params) for "frame"."""

    name: str
    scope: str
    build: Callable
    coerce: Callable[[Any], dict]
    compact: Callable[[dict], Any]
    text_only: bool = False
    streamable: Callable[[dict], bool] = lambda params: False


OPS: dict[str, OpSpec] = {}
CHECKS: dict[str, Callable[[Column, str], Column]] = {}
DETECTORS: dict[str, tuple[int, str, bool, Callable]] = {}


def register_op(name: str, scope: str = "column", coerce: Callable | None = None, compact: Callable | None = None, kind: str = "native", returns: str = "string", text_only: bool = False, streamable: Callable | bool = False) -> Callable:
    """Decorator that adds an operation; a name can be given once."""

    def add(function: Callable) -> Callable:
        if name in OPS:
            raise RecipeError(f"operation {name!r} exists already")
        if scope not in ("column", "stateful", "frame"):
            raise RecipeError(f"operation {name!r} has the unknown scope {scope!r}")
        build = function
        if kind == "pandas":

            def build(c: Column, kind: str = "string", **params: Any) -> Column:
                return F.pandas_udf(lambda s: function(s, **params), returns)(c)

        OPS[name] = OpSpec(name, scope, build, coerce or (lambda raw: dict(raw or {})), compact or (lambda p: p or None), text_only, streamable if callable(streamable) else lambda p: streamable)
        return function

    return add


def unregister_op(name: str) -> None:
    OPS.pop(name, None)


def op_spec(name: str) -> OpSpec:
    if name not in OPS:
        raise RecipeError(f"unknown operation {name!r}; known are {', '.join(sorted(OPS))}")
    return OPS[name]


def validator(name: str, kind: str = "native") -> Callable:
    """Decorator that adds a check: (Column, kind) to a Column of booleans, or with kind="pandas" a Series to a Series of booleans."""

    def add(function: Callable) -> Callable:
        if name in CHECKS:
            raise RecipeError(f"check {name!r} exists already")
        CHECKS[name] = (lambda c, k: F.pandas_udf(lambda s: function(s).astype(bool), "boolean")(c)) if kind == "pandas" else function
        return function

    return add


def unregister_validator(name: str) -> None:
    CHECKS.pop(name, None)


def detector(name: str, scope: str = "column", priority: int = 50, requires_schema: bool = False) -> Callable:
    """Decorator that adds a detector; detectors run by priority, then name."""

    def add(function: Callable) -> Callable:
        if name in DETECTORS:
            raise RecipeError(f"detector {name!r} exists already")
        DETECTORS[name] = (priority, scope, requires_schema, function)
        return function

    return add


def unregister_detector(name: str) -> None:
    DETECTORS.pop(name, None)


def build_column(name: str, c: Column, kind: str, params: dict) -> Made:
    """The column that an operation makes of c, which has the Spark type kind."""
    spec = op_spec(name)
    if spec.text_only and kind != "string":
        return Made(c)
    try:
        made = spec.build(c, kind=kind, **params)
    except TypeError as e:
        raise OpError(f"operation {name!r}: {e}") from e
    return made if isinstance(made, Made) else Made(made)
