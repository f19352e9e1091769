"""The built-in operations and checks under their names in recipes."""

from __future__ import annotations

import re
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubline.errors import OpError, RecipeError
from scrubline.functions import columns as c
from scrubline.plans.profile import exact_quantiles
from scrubline.plans.registry import CHECKS, ROW_ID, Made, op_spec, register_op, validator
from scrubline.plans.rows import carry


def _pruned(defaults: dict):
    return lambda p: {k: v for k, v in p.items() if v != defaults.get(k)} or None


def _plain(name: str, function) -> None:
    register_op(name, text_only=True, streamable=True)(lambda col, kind="string": function(col))


for _name, _function in {
    "strip_whitespace": c.strip, "collapse_whitespace": c.collapse, "lowercase": F.lower, "uppercase": F.upper, "title_case": c.title_case, "capitalize": c.capitalize, "normalize_email": c.normalize_email,
}.items():
    _plain(_name, _function)


def _symbols(raw: Any) -> dict:
    raw = raw.get("symbols", []) if isinstance(raw, dict) else raw
    return {"symbols": [str(x) for x in (raw if isinstance(raw, (list, tuple)) else [raw] if raw else [])]}


register_op("remove_symbols", coerce=_symbols, compact=lambda p: p["symbols"], text_only=True, streamable=True)(lambda col, kind="string", symbols=(): c.remove_symbols(col, symbols))


def _replace(raw: Any) -> dict:
    if not isinstance(raw, dict) or "pattern" not in raw:
        raise RecipeError("replace needs a pattern")
    made = {"pattern": str(raw["pattern"]), "repl": str(raw.get("repl", "")), "regex": bool(raw.get("regex", True))}
    if made["regex"]:
        c.check_pattern(made["pattern"])
    return made


register_op("replace", coerce=_replace, compact=_pruned({"repl": "", "regex": True}), text_only=True, streamable=True)(lambda col, kind="string", **p: c.replace(col, **p))


def _na(raw: Any) -> dict:
    if isinstance(raw, (list, tuple)):
        return {"tokens": [str(x) for x in raw], "case_insensitive": True}
    raw = raw or {}
    tokens = raw.get("tokens")
    return {"tokens": [str(x) for x in tokens] if tokens is not None else None, "case_insensitive": bool(raw.get("case_insensitive", True))}


register_op("to_na", coerce=_na, compact=_pruned({"tokens": None, "case_insensitive": True}), text_only=True, streamable=True)(lambda col, kind="string", **p: c.to_na(col, **p))


def _phone(raw: Any) -> dict:
    code = raw.get("default_country_code", raw.get("country_code", raw.get("region"))) if isinstance(raw, dict) else raw
    return {"default_country_code": None if code is None else str(code)}


register_op("normalize_phone", coerce=_phone, compact=_pruned({"default_country_code": None}), streamable=True)(lambda col, kind="string", default_country_code=None: c.normalize_phone(col, default_country_code))


@register_op("parse_number", coerce=lambda raw: {"decimal": ".", "thousands": ",", "symbols": []} | {k: (list(v) if k == "symbols" else v) for k, v in (raw or {}).items()}, compact=_pruned({"decimal": ".", "thousands": ",", "symbols": []}), streamable=True)
def _parse_number(col: Column, kind: str = "string", decimal: str = ".", thousands: str = ",", symbols: list | tuple = ()) -> Column:
    if kind == "boolean":
        return F.lit(None).cast("double")
    return c.parse_number(col, decimal, thousands, [str(s) for s in symbols]) if kind == "string" else c.no_nan(col.cast("double"))


def _target(raw: Any) -> dict:
    to = raw.get("to") if isinstance(raw, dict) else raw
    if not to:
        raise RecipeError("cast needs a target type")
    return {"to": str(to)}


register_op("cast", coerce=_target, compact=lambda p: p["to"], streamable=lambda p: p["to"].lower() not in ("category", "datetime", "date"))(lambda col, kind="string", to="string": c.cast(col, to, kind))
register_op("round", coerce=lambda raw: {"decimals": int((raw.get("decimals", raw.get("ndigits", 0)) if isinstance(raw, dict) else raw) or 0)}, compact=lambda p: p["decimals"], streamable=True)(lambda col, kind="double", decimals=0: c.round_half_even(col, decimals, kind))


def _dates(raw: Any) -> dict:
    raw = {"formats": raw} if isinstance(raw, (list, str)) else dict(raw or {})
    formats = raw.pop("formats", raw.pop("allowed", None))
    raw.pop("allowed", None)
    formats = [formats] if isinstance(formats, str) else list(formats) if formats else None
    return {"formats": formats, "dayfirst": False, "yearfirst": False, "output": "%Y-%m-%d"} | raw


@register_op("parse_date", coerce=_dates, compact=_pruned({"formats": None, "dayfirst": False, "yearfirst": False, "output": "%Y-%m-%d"}), streamable=lambda p: bool(p.get("formats")))
def _parse_date(col: Column, kind: str = "string", formats: list | None = None, dayfirst: bool = False, yearfirst: bool = False, output: str = "%Y-%m-%d") -> Column:
    return c.parse_date(col, formats, dayfirst, output, yearfirst) if kind == "string" else c.format_timestamp(col.cast("timestamp_ntz"), output)


def _mapping(raw: Any) -> dict:
    if not isinstance(raw, dict):
        raise RecipeError("normalize_values needs a mapping")
    if set(raw) <= {"map", "case_insensitive"} and isinstance(raw.get("map"), dict):
        return {"mapping": dict(raw["map"]), "case_insensitive": bool(raw.get("case_insensitive", False))}
    return {"mapping": dict(raw), "case_insensitive": False}


register_op("normalize_values", coerce=lambda raw: _mapping({"map": raw["mapping"], "case_insensitive": raw.get("case_insensitive", False)}) if isinstance(raw, dict) and isinstance(raw.get("mapping"), dict) else _mapping(raw), compact=lambda p: {"map": p["mapping"], "case_insensitive": True} if p["case_insensitive"] or set(p["mapping"]) <= {"map", "case_insensitive"} else p["mapping"], streamable=True)(
    lambda col, kind="string", mapping=None, case_insensitive=False: c.normalize_values(col, mapping or {}, case_insensitive)
)


def _currency(raw: Any) -> dict:
    return {"to": raw.get("to"), "default": raw.get("default")} if isinstance(raw, dict) else {"to": raw, "default": None}


@register_op("extract_currency", coerce=_currency, compact=lambda p: _pruned({"to": None, "default": None})(p) if p["default"] is not None else p["to"], streamable=True)
def _extract_currency(col: Column, kind: str = "string", to: str | None = None, default: str | None = None) -> Made:
    return Made(col, {to or "": c.currency_of(col, default)})  # "": named after the source column


def _unit(raw: Any) -> dict:
    raw = raw if isinstance(raw, dict) else {"to": raw}
    return {"to": c.unit_name(str(raw.get("to") or "g")), "emit_unit_column": raw.get("emit_unit_column")}


@register_op("normalize_unit", coerce=_unit, compact=lambda p: p if p["emit_unit_column"] else p["to"], streamable=True)
def _normalize_unit(col: Column, kind: str = "string", to: str = "g", emit_unit_column: str | None = None) -> Made:
    return Made(c.normalize_unit(col, to, kind), {emit_unit_column: c.unit_of(col, to, kind)} if emit_unit_column else {})


STRATEGIES = {"mean", "median", "mode", "ffill", "pad", "bfill", "backfill", "zero", "empty"}


def _fill(raw: Any) -> dict:
    if isinstance(raw, dict) and set(raw) <= {"value", "strategy"}:
        return {"value": raw.get("value"), "strategy": raw.get("strategy")}
    return {"value": None, "strategy": raw} if isinstance(raw, str) and raw in STRATEGIES else {"value": raw, "strategy": None}


@register_op("fill_na", scope="stateful", coerce=_fill, compact=lambda p: p["strategy"] or ({"value": p["value"]} if isinstance(p["value"], str) and p["value"] in STRATEGIES else p["value"]), streamable=lambda p: p.get("strategy") in (None, "zero", "empty"))
def fill_na(df: DataFrame, column: str, value: Any = None, strategy: str | None = None) -> DataFrame:
    """df with the nulls of column filled by a constant, a statistic of the column, or the neighbours in row order."""
    col, kind = F.col(f"`{column}`"), dict(df.dtypes)[column]
    how = strategy.lower() if strategy else None
    number = c.to_numeric(col) if kind == "string" else col.cast("double")
    if how in ("ffill", "pad", "bfill", "backfill"):
        return carry(df, column, backward=how in ("bfill", "backfill"))
    if how == "mode":
        best = df.filter(col.isNotNull()).groupBy(col.alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col("v").cast("string")).limit(1).first()
        value = best.v if best else None
        return df if value is None else df.withColumn(column, F.coalesce(col, F.lit(value).cast(kind)))
    if how in ("mean", "median"):
        value = df.agg(F.avg(number)).first()[0] if how == "mean" else exact_quantiles(df.select(number), [0.5])[0]
        return df if value is None else df.withColumn(column, F.coalesce(col.cast("double") if kind != "string" else col, F.lit(float(value)) if kind != "string" else c.number_text(F.lit(float(value)))))
    value = {"zero": 0, "empty": ""}.get(how, value)
    if value is None:
        raise OpError("fill_na needs a value or a strategy")
    if kind == "string" or isinstance(value, str):
        return df.withColumn(column, F.coalesce(col.cast("string"), F.lit(str(value))))
    if kind in ("int", "bigint", "smallint", "tinyint") and float(value) != int(value):
        return df.withColumn(column, F.coalesce(col.cast("double"), F.lit(float(value))))
    return df.withColumn(column, F.coalesce(col, F.lit(value).cast(kind)))


def _names(raw: Any) -> list[str]:
    return [str(x) for x in (raw if isinstance(raw, (list, tuple)) else [raw])] if raw else []


def _dedup(raw: Any) -> dict:
    raw = raw if isinstance(raw, dict) else {"subset": _names(raw)}
    keep = raw.get("keep", "first")
    keep = False if keep in (False, "none", "false") else keep
    if keep not in ("first", "last", False):
        raise RecipeError(f"dedup keeps first, last or none, not {keep!r}")
    return {"subset": _names(raw.get("subset")) or None, "keep": keep, "ignore_case": bool(raw.get("ignore_case", False))}


@register_op("dedup", scope="frame", coerce=_dedup, compact=_pruned({"subset": None, "keep": "first", "ignore_case": False}))
def dedup(df: DataFrame, subset: list[str] | None = None, keep: str | bool = "first", ignore_case: bool = False) -> DataFrame:
    """df without rows that repeat others in the columns of subset; null equals null. The row order decides which one stays."""
    columns = [x for x in df.columns if not x.startswith("_")] if subset is None else subset
    if missing := [x for x in columns if x not in df.columns]:
        raise OpError(f"dedup: unknown columns {', '.join(missing)}")
    kinds = dict(df.dtypes)
    keys = [c.key(F.col(f"`{x}`")) if ignore_case and kinds[x] == "string" else F.col(f"`{x}`") for x in columns]
    window = Window.partitionBy(*keys)
    rank = F.count(F.lit(1)).over(window) if keep is False else F.row_number().over(window.orderBy(F.asc(ROW_ID) if keep == "first" else F.desc(ROW_ID)))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


@register_op("drop_columns", scope="frame", coerce=lambda raw: {"columns": _names(raw.get("columns") if isinstance(raw, dict) else raw)}, compact=lambda p: p["columns"], streamable=True)
def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df without columns; those it lacks don't matter."""
    return df.select(*(F.col(f"`{x}`") for x in df.columns if x not in columns))


validator("not_null")(lambda col, kind: c.no_nan(col).isNotNull() if kind in ("double", "float") else col.isNotNull())
validator("unique")(lambda col, kind: col.isNull() | (F.count(F.lit(1)).over(Window.partitionBy(col)) == 1))
validator("valid_email")(lambda col, kind: c.valid_email(col))
validator("valid_url")(lambda col, kind: c.valid_url(col))
validator("valid_phone")(lambda col, kind: c.valid_phone(col, kind))

COMPARISON = re.compile(r"^(>=|<=|==|!=|>|<)\s*(-?\d+(?:\.\d+)?)$")


def check_column(check: str, params: dict, col: Column, kind: str) -> Column:
    """True where a value passes the check."""
    check = check.strip()
    if check in CHECKS:
        return CHECKS[check](col, kind)
    if m := COMPARISON.match(check):
        return c.compares(col, m[1], float(m[2]), kind)
    if check == "in" or check.startswith("in "):
        values = params.get("values") if check == "in" else yaml.safe_load(check[3:])
        if not isinstance(values, list):
            raise RecipeError(f"check {check!r} needs a list of values")
        return c.member_of(col, values, kind)
    if m := re.match(r"^(?:matches|regex)\s*:\s*(.+)$", check, re.S):
        return c.matches(col, m[1].strip())
    if check in ("matches", "regex") and params.get("pattern"):
        return c.matches(col, str(params["pattern"]))
    raise RecipeError(f"unknown check {check!r}")


def known_check(check: str) -> bool:
    try:
        check_column(check, {"values": [], "pattern": "x"}, F.lit("x"), "string")
        return True
    except RecipeError:
        return False


def normalize_op(name: str, raw: Any) -> dict:
    """The full parameters of an operation, from its short form."""
    return op_spec(name).coerce(raw)
