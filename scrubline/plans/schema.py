"""The target schema: what the columns of a table should be."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.errors import SchemaError
from scrubline.functions import columns as c
from scrubline.plans.names import snake_case
from scrubline.plans.profile import Profile, distinct_values, profile
from scrubline.plans.rows import with_row_id

# The types a schema may name, and the type for each semantic type.
DTYPES = frozenset("string text integer int float number boolean bool date datetime email phone url category id".split())
BY_SEMANTIC = {"integer": "integer", "float": "float", "currency": "float", "boolean": "boolean", "date": "date", "datetime": "datetime", "email": "email", "phone": "phone", "url": "url", "categorical": "category", "id": "string", "text": "string", "empty": "string"}
SPARK = {"integer": T.LongType(), "int": T.LongType(), "float": T.DoubleType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "bool": T.BooleanType(), "datetime": T.TimestampNTZType()}
MOST_ALLOWED_VALUES = 50


@dataclass
class SchemaColumn:
    """One column of a target schema."""

    name: str
    dtype: str = "string"
    required: bool = False
    unique: bool = False
    allowed_values: list | None = None
    date_formats: list[str] | None = None
    min: float | None = None
    max: float | None = None
    aliases: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.dtype.strip().lower() not in DTYPES:
            raise SchemaError(f"column {self.name!r} has the unknown type {self.dtype!r}; known are {', '.join(sorted(DTYPES))}")


@dataclass
class Schema:
    """A target schema."""

    name: str = "table"
    columns: list[SchemaColumn] = field(default_factory=list)

    @classmethod
    def from_dict(cls, raw: dict) -> Schema:
        if not isinstance(raw, dict) or not isinstance(raw.get("columns"), dict):
            raise SchemaError("a schema has columns by name")
        known = set(SchemaColumn.__dataclass_fields__) - {"name"}
        columns = []
        for name, body in raw["columns"].items():
            body = {"dtype": body} if isinstance(body, str) else dict(body or {})
            if unknown := set(body) - known:
                raise SchemaError(f"column {name!r} has the unknown keys {', '.join(sorted(unknown))}")
            columns.append(SchemaColumn(str(name), **body))
        return cls(str(raw.get("name", "table")), columns)

    @classmethod
    def load(cls, path: str | Path) -> Schema:
        try:
            return cls.from_dict(yaml.safe_load(Path(path).read_text("utf-8-sig")))
        except yaml.YAMLError as e:
            raise SchemaError(f"the schema is no YAML: {e}") from e

    def to_dict(self) -> dict:
        return {"name": self.name, "columns": {x.name: {k: v for k, v in x.__dict__.items() if k != "name" and v not in (None, False, [])} for x in self.columns}}

    def to_yaml(self) -> str:
        return yaml.safe_dump(self.to_dict(), sort_keys=False, allow_unicode=True)

    def to_struct_type(self) -> T.StructType:
        return T.StructType([T.StructField(x.name, SPARK.get(x.dtype.lower(), T.StringType()), not x.required) for x in self.columns])


def resolve_schema(schema: Any) -> Schema | None:
    """A schema from a path, a mapping or itself."""
    if schema is None or isinstance(schema, Schema):
        return schema
    return Schema.from_dict(schema) if isinstance(schema, dict) else Schema.load(schema)


def fitting_formats(df: DataFrame, column: str) -> list[str]:
    """The common date formats that the values of a column need, each covering some that no earlier one does."""
    values = distinct_values(df, column)
    fits = [c.parse_format(F.col("value"), f).isNotNull() for f in c.DATE_FORMATS]
    first = F.array_position(F.array(*fits), True)
    used = values.select(first.alias("k")).filter("k > 0").groupBy("k").count().collect()
    return [c.DATE_FORMATS[r.k - 1] for r in sorted(used, key=lambda r: r.k)]


def infer_schema(df: DataFrame, name: str = "table", known: Profile | None = None) -> Schema:
    """A schema that the table fits: types, required and unique columns, allowed values, ranges and date formats."""
    rows = with_row_id(df)
    found = known or profile(rows, with_duplicates=False)
    columns = []
    for p in found.columns.values():
        dtype = BY_SEMANTIC.get(p.semantic_type, "string")
        made = SchemaColumn(snake_case(p.name), dtype, required=p.count > 0 and p.null_count == 0, unique=p.count > 1 and p.unique_count == p.count, aliases=[p.name] if snake_case(p.name) != p.name else [])
        if dtype == "category" and p.unique_count <= MOST_ALLOWED_VALUES:
            made.allowed_values = [r.value for r in rows.select(F.col(f"`{p.name}`").alias("value")).filter("value is not null").distinct().orderBy("value").collect()]
        if dtype in ("integer", "float") and p.min_value is not None:
            made.min, made.max = p.min_value, p.max_value
        if dtype == "date" and p.dtype == "string":
            made.date_formats = fitting_formats(rows, p.name) or None
        columns.append(made)
    return Schema(name, columns)


