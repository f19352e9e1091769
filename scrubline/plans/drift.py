"""Fingerprints of inputs, and what has changed since a recipe was made."""

from __future__ import annotations

import copy
import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.functions import columns as c
from scrubline.plans.names import best_match
from scrubline.plans.recipe import Op, Recipe
from scrubline.plans.registry import ROW_ID
from scrubline.plans.rows import head, with_row_id

HASHED_ROWS, SAME_NAME = 200, 0.6
# The names of types in fingerprints, and the families within which a change is none.
DTYPE_NAMES = {"string": "object", "tinyint": "int64", "smallint": "int64", "int": "int64", "bigint": "int64", "float": "float64", "double": "float64", "boolean": "bool", "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]", "date": "datetime64[ns]"}


def family(dtype: str) -> str:
    """The family of a type name, from whichever engine."""
    name = dtype.lower()
    for part, found in (("datetime", "datetime"), ("timedelta", "timedelta"), ("interval", "timedelta"), ("int", "int"), ("float", "float"), ("double", "float"), ("bool", "bool"), ("object", "string"), ("str", "string"), ("category", "string")):
        if part in name:
            return found
    return name


@dataclass
class Finding:
    """One change, its severity and what would follow it."""

    kind: str
    column: str | None
    severity: str
    message: str
    suggestion: str | None = None
    evidence: dict = field(default_factory=dict)


def _value(v: object) -> str:
    return "" if v is None or v != v else repr(v) if isinstance(v, float) else str(v)


def fingerprint(df: DataFrame) -> dict:
    """Names, types and size of a table, and a hash of its first rows."""
    rows = with_row_id(df)
    names = [x for x in rows.columns if x != ROW_ID]
    first = head(rows, HASHED_ROWS).orderBy(ROW_ID).collect()
    made = hashlib.sha256()
    for name in names:
        made.update(name.encode() + b"\x1e" + "\x1f".join(_value(r[name]) for r in first).encode() + b"\x1d")
    kinds = dict(rows.dtypes)
    return {"columns": len(names), "column_names": names, "dtypes": {n: DTYPE_NAMES.get(kinds[n], kinds[n]) for n in names}, "row_count": rows.count(), "sampled_rows": len(first), "hash_sample": made.hexdigest()[:16]}


def detect_drift(recipe: Recipe, df: DataFrame) -> list[Finding]:
    """How df differs from what the recipe was made for; empty for a recipe without fingerprint."""
    was = recipe.fingerprint
    if not was:
        return []
    now = fingerprint(df)
    old, new = list(was.get("column_names", [])), now["column_names"]
    gone, extra = [x for x in old if x not in new], [x for x in new if x not in old]
    outputs = {x.source: x.rename_to for x in recipe.columns if x.rename_to}
    found = []
    for name in gone:
        # A column may come back under a name like its old one, or like the one it is given.
        match, score = max((best_match(known, extra, SAME_NAME) for known in (name, outputs.get(name, name))), key=lambda m: m[1])
        if match:
            extra.remove(match)
            found.append(Finding("renamed_column", match, "warning", f"{name!r} may now be {match!r}", f"read {name!r} from {match!r}", {"from": name, "similarity": round(score, 3)}))
        found.append(Finding("missing_column", name, "warning", f"{name!r} is missing", None if match else f"drop {name!r} from the recipe"))
    found += [Finding("new_column", x, "warning", f"{x!r} is new") for x in extra]
    for name in old:
        if name in new and family(was["dtypes"][name]) != family(now["dtypes"][name]):
            found.append(Finding("dtype_change", name, "warning", f"{name!r} was {was['dtypes'][name]}, is {now['dtypes'][name]}", evidence={"from": was["dtypes"][name], "to": now["dtypes"][name]}))
    if was.get("row_count") != now["row_count"]:
        found.append(Finding("row_count_change", None, "info", f"{was.get('row_count')} rows before, {now['row_count']} now"))
    if was.get("hash_sample") != now["hash_sample"]:
        found.append(Finding("content_hash_change", None, "info", "the first rows are others"))
    return found + _format_drift(recipe, df)


def _format_drift(recipe: Recipe, df: DataFrame) -> list[Finding]:
    """Date columns with values that none of their formats fits: one aggregation over all of them."""
    kinds = dict(df.dtypes)
    dated = [(x.source, o.params["formats"]) for x in recipe.columns for o in x.ops if o.name == "parse_date" and o.params.get("formats") and kinds.get(x.source) == "string"]
    if not dated:
        return []
    v = lambda n: F.col(f"`{n}`")
    misses = df.agg(*(F.sum((c.to_na(v(n)).isNotNull() & c.parse_timestamp(v(n), f).isNull()).cast("bigint")).alias(str(i)) for i, (n, f) in enumerate(dated))).first()
    found = []
    for i, (name, formats) in enumerate(dated):
        if misses[i]:
            rest = df.select(v(name).alias("value")).filter(c.to_na(F.col("value")).isNotNull() & c.parse_timestamp(F.col("value"), formats).isNull())
            others = [f for f in c.DATE_FORMATS if f not in formats]
            fits = F.array_position(F.array(*(c.parse_format(F.col("value"), f).isNotNull() for f in others)), True)
            extra = [others[r.k - 1] for r in sorted(rest.groupBy(fits.alias("k")).count().filter("k > 0").collect(), key=lambda r: r.k)]
            found.append(Finding("format_drift", name, "warning", f"{misses[i]} dates of {name!r} fit none of its formats", f"add {', '.join(extra)}" if extra else None, {"unparsed": misses[i], "formats": extra}))
    return found


def suggest_update(recipe: Recipe, df: DataFrame) -> tuple[Recipe, list[Finding]]:
    """A recipe for df: renamed sources repointed, date formats extended, the fingerprint renewed; and what it answers to."""
    found = detect_drift(recipe, df)
    made = copy.deepcopy(recipe)
    for finding in found:
        for column in made.columns:
            if finding.kind == "renamed_column" and column.source == finding.evidence["from"]:
                column.rename_to = column.rename_to or column.source
                column.source = finding.column
            if finding.kind == "format_drift" and column.source == finding.column:
                column.ops = [Op(o.name, o.params | {"formats": [*o.params["formats"], *finding.evidence["formats"]]}) if o.name == "parse_date" else o for o in column.ops]
    if {f.kind for f in found} & {"missing_column"}:
        missing = {f.column for f in found if f.kind == "missing_column" and f.suggestion}
        made.columns = [x for x in made.columns if x.source not in missing]
    made.fingerprint = fingerprint(df)
    return made, found
