"""Detectors: what may be wrong with a table, and the operations that would mend it.

A detector looks at all values of a column, as distinct values with counts,
through aggregations; only bounded results reach the driver.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.errors import ScrublineError
from scrubline.functions import columns as c
from scrubline.plans.names import similarity, snake_case
from scrubline.plans.profile import NUMERIC, ColumnProfile, Profile, distinct_values, key_duplicates, outlier_bounds, profile
from scrubline.plans.registry import DETECTORS, ROW_ID, detector
from scrubline.plans.rows import head, with_row_id
from scrubline.plans.schema import Schema

SEVERITY = {"info": 0.25, "warning": 0.6, "error": 1.0}
SAMPLE, CATEGORY_VALUES, FUZZY_ROWS, FUZZY_SIMILARITY, CATEGORY_SIMILARITY, CATEGORY_RATIO = 50_000, 60, 200, 0.88, 0.86, 0.34
# Which semantic types a schema's type accepts without loss.
COMPATIBLE = {
    "integer": {"integer", "float", "currency"}, "float": {"float", "integer", "currency"}, "currency": {"currency", "float", "integer"}, "date": {"date", "datetime"}, "datetime": {"datetime", "date"},
    "email": {"email", "text", "id"}, "phone": {"phone", "text"}, "url": {"url", "text"}, "category": {"categorical", "text", "id"}, "boolean": {"boolean"},
}


@dataclass
class Issue:
    """One finding: affected counts the rows it concerns; ops and rename_to are the proposal, if there is one."""

    column: str | None
    kind: str
    severity: str
    confidence: float
    message: str
    affected: int = 0
    ops: list = field(default_factory=list)
    rename_to: str | None = None
    evidence: dict = field(default_factory=dict)
    source: str = ""


@dataclass
class Context:
    """What a detector sees: the table with row ids, its profile, the schema, and the column in turn."""

    df: DataFrame
    profile: Profile
    schema: Schema | None = None
    column: str | None = None

    @property
    def stats(self) -> ColumnProfile:
        return self.profile.columns[self.column]

    def values(self) -> DataFrame:
        """(value, n) of all non-null values."""
        return distinct_values(self.df, self.column)

    def counts(self, **tests: Column) -> dict[str, int]:
        """How many of the values pass each test, in one job."""
        row = self.values().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), *(F.coalesce(F.sum(F.when(t, F.col("n"))), F.lit(0)).alias(k) for k, t in tests.items())).first()
        return row.asDict()

    def pandas(self) -> Any:
        """The first values as a pandas Series, for detectors written in pandas."""
        return self.df.filter(F.col(f"`{self.column}`").isNotNull()).orderBy(ROW_ID).limit(SAMPLE).select(f"`{self.column}`").toPandas()[self.column]


def _v() -> Column:
    return F.col("value")


def detect(df: DataFrame, known: Profile | None = None, schema: Schema | None = None, only: list[str] | None = None) -> list[Issue]:
    """All issues, detector by detector (by priority, then name), column by column."""
    rows = with_row_id(df)
    known = known or profile(rows)
    if only and (unknown := set(only) - set(DETECTORS)):
        raise ScrublineError(f"unknown detectors: {', '.join(sorted(unknown))}")
    found: list[Issue] = []
    for name, (_, scope, needs_schema, function) in sorted(DETECTORS.items(), key=lambda x: (x[1][0], x[0])):
        if (only and name not in only) or (needs_schema and schema is None):
            continue
        for column in known.columns if scope == "column" else [None]:
            issues = function(Context(rows, known, schema, column)) or []
            for issue in [issues] if isinstance(issues, Issue) else issues:
                issue.source = name
                found.append(issue)
    return found


def _text(function: Callable[[Context], list[Issue]]) -> Callable[[Context], list[Issue]]:
    return lambda ctx: function(ctx) if ctx.stats.dtype == "string" and ctx.stats.count else []


@detector("schema_mapping", scope="frame", priority=5, requires_schema=True)
def schema_mapping(ctx: Context) -> list[Issue]:
    """Which source column feeds each column of the schema: the best pairs first."""
    pairs = []
    for target in ctx.schema.columns:
        for name, p in ctx.profile.columns.items():
            score = max(similarity(x, name) for x in [target.name, *target.aliases])
            if p.semantic_type not in COMPATIBLE.get(target.dtype.lower(), {p.semantic_type}) and p.semantic_type != "empty":
                score -= 0.15
            pairs.append((-score, target.name, name))
    issues, targets, used = [], {}, set()
    for score, target, name in sorted(pairs):
        if target in targets or name in used or -score < 0.4:
            continue
        targets[target] = name
        used.add(name)
        sure = -score >= 0.6
        issues.append(Issue(name, "schema_mapping" if sure else "weak_schema_match", "info" if sure else "warning", max(0.0, -score) if sure else 0.4, f"{name!r} looks like {target!r}", rename_to=target if sure else None, evidence={"target": target}))
    for target in ctx.schema.columns:
        if target.name not in targets:
            issues.append(Issue(None, "missing_schema_column", "error" if target.required else "warning", 1.0, f"no column for {target.name!r}", evidence={"target": target.name}))
    issues += [Issue(name, "extra_source_column", "info", 1.0, f"{name!r} is not in the schema") for name in ctx.profile.columns if name not in used]
    return issues


@detector("whitespace", priority=10)
@_text
def whitespace(ctx: Context) -> list[Issue]:
    """Blanks at the ends and in runs."""
    n = ctx.counts(edge=_v() != c.strip(_v()), runs=_v().rlike(r"(?U)\s{2,}"))
    issues = []
    if n["edge"]:
        issues.append(Issue(ctx.column, "edge_whitespace", "warning", 1.0, f"{n['edge']} values have blanks at their ends", n["edge"], ["strip_whitespace"]))
    if n["runs"]:
        issues.append(Issue(ctx.column, "repeated_whitespace", "warning", 1.0, f"{n['runs']} values have runs of blanks", n["runs"], ["collapse_whitespace"]))
    return issues


@detector("nulls", priority=20)
def nulls(ctx: Context) -> list[Issue]:
    """Words for missing values, missing values, empty and constant columns."""
    p, issues = ctx.stats, []
    if p.dtype == "string" and p.count:
        words = ctx.values().groupBy(c.key(_v()).alias("value")).agg(F.sum("n").alias("n")).filter(_v().isin(*c.NA_TOKENS)).collect()
        for kind, ambiguous, confidence in (("disguised_nulls", False, 1.0), ("ambiguous_nulls", True, 0.45)):
            hits = {r.value: r.n for r in words if (r.value in c.AMBIGUOUS_NA_TOKENS) == ambiguous}
            if hits:
                issues.append(Issue(ctx.column, kind, "warning", confidence, f"{sum(hits.values())} values stand for missing ones: {', '.join(map(repr, sorted(hits)))}", sum(hits.values()), [{"to_na": {"tokens": sorted(hits)}} if ambiguous else "to_na"], evidence=hits))
    if p.count == 0:
        issues.append(Issue(ctx.column, "empty_column", "warning", 1.0, "the column is empty", p.n_rows))
    elif p.null_count:
        issues.append(Issue(ctx.column, "missing_values", "warning" if p.null_count >= 0.2 * p.n_rows else "info", 1.0, f"{p.null_count} values are missing", p.null_count))
    if p.count > 1 and p.unique_count == 1:
        issues.append(Issue(ctx.column, "constant_column", "info", 1.0, "all values are equal", p.count))
    return issues


@detector("dates", priority=40)
@_text
def dates(ctx: Context) -> list[Issue]:
    """The formats of a date column: each covers values that no earlier one does; a part over 12 tells days from months."""
    if ctx.stats.semantic_type != "date":
        return []
    parts = r"^\s*(\d{1,2})[/.\-](\d{1,2})[/.\-]\d{2,4}\s*$"
    one, two = (F.regexp_extract(_v(), parts, i).try_cast("int") for i in (1, 2))
    n = ctx.counts(day_first=(one > 12) & (two <= 12), month_first=(two > 12) & (one <= 12), either=(one <= 12) & (two <= 12))
    month = n["month_first"] > n["day_first"]
    banned = c.DAY_FIRST_FORMATS if month else c.MONTH_FIRST_FORMATS
    order = [f for f in c.DATE_FORMATS if f not in banned]
    fits = F.array_position(F.array(*(c.parse_format(_v(), f).isNotNull() for f in order)), True)
    used = {r.k: r.n for r in ctx.values().groupBy(fits.alias("k")).agg(F.sum("n").alias("n")).collect()}
    formats = [order[k - 1] for k in sorted(used) if k]
    if not formats or (formats == ["%Y-%m-%d"] and not used.get(0)):
        return []
    sure = n["either"] == 0 or n["day_first"] > 0 or n["month_first"] > 0
    params: dict[str, Any] = {"formats": formats}
    if any("%H" in f for f in formats):
        params["output"] = "%Y-%m-%d %H:%M:%S"
    return [Issue(ctx.column, "mixed_dates" if len(formats) > 1 else "date_format", "warning", 0.9 if sure else 0.75, f"dates in {len(formats)} formats, {used.get(0, 0)} fit none", sum(used.values()), [{"parse_date": params}], evidence={"formats": formats, "unparsed": used.get(0, 0)})]


@detector("emails", priority=45)
@_text
def emails(ctx: Context) -> list[Issue]:
    if ctx.stats.semantic_type != "email":
        return []
    n = ctx.counts(messy=_v() != c.normalize_email(_v()), invalid=~c.valid_email(_v()))
    issues = [Issue(ctx.column, "messy_emails", "warning", 0.95, f"{n['messy']} addresses have blanks or upper case", n["messy"], ["normalize_email"])] if n["messy"] else []
    if n["invalid"]:
        issues.append(Issue(ctx.column, "invalid_emails", "error" if n["invalid"] > 0.02 * n["all"] else "warning", 0.9, f"{n['invalid']} values are no addresses", n["invalid"]))
    return issues


@detector("phones", priority=45)
@_text
def phones(ctx: Context) -> list[Issue]:
    if ctx.stats.semantic_type != "phone":
        return []
    made = c.normalize_phone(_v())
    n = ctx.counts(messy=~_v().eqNullSafe(made), invalid=~c.valid_phone(_v()))
    issues = [Issue(ctx.column, "messy_phones", "warning", 0.8, f"{n['messy']} numbers have separators", n["messy"], ["normalize_phone"])] if n["messy"] else []
    if n["invalid"]:
        issues.append(Issue(ctx.column, "invalid_phones", "warning", 0.9, f"{n['invalid']} values have no 7 to 15 digits", n["invalid"]))
    return issues


@detector("currency", priority=45)
@_text
def currency(ctx: Context) -> list[Issue]:
    """Money as text: one currency goes into the name, several into a column of their own."""
    if ctx.stats.semantic_type != "currency":
        return []
    codes = sorted(r.code for r in ctx.values().select(c.currency_of(_v()).alias("code")).filter("code is not null").distinct().collect())
    n = ctx.counts(unparsed=c.parse_number(_v()).isNull() & c.to_na(_v()).isNotNull())
    base = snake_case(ctx.column)
    if len(codes) == 1:
        return [Issue(ctx.column, "currency_as_text", "warning", 0.95, f"amounts in {codes[0]} are text", n["all"], ["parse_number"], f"{base}_{codes[0].lower()}" if codes[0].lower() not in base.split("_") else base, n)]
    return [Issue(ctx.column, "mixed_currencies", "warning", 0.95, f"amounts in {', '.join(codes) or 'no currency'} are text", n["all"], [{"extract_currency": f"{base}_currency"}, "parse_number"], evidence=n)]


@detector("units", priority=46)
@_text
def units(ctx: Context) -> list[Issue]:
    """Amounts with units of one family."""
    if ctx.stats.semantic_type not in ("unit", "text", "categorical", "id"):
        return []
    found = {r.unit: r.n for r in ctx.values().groupBy(c.unit_parts(_v())[1].alias("unit")).agg(F.sum("n").alias("n")).collect()}
    total, named = sum(found.values()), {u: n for u, n in found.items() if u}
    if sum(named.values()) < max(2, 0.5 * total):
        return []
    families: dict[str, int] = {}
    for u, n in named.items():
        families[c.UNIT_FAMILY[u]] = families.get(c.UNIT_FAMILY[u], 0) + n
    family = max(sorted(families), key=families.get)
    mixed = len(named) > 1
    target = next(u for u, factor in c.UNITS[family].items() if factor == 1.0) if mixed else next(iter(named))
    return [Issue(ctx.column, "mixed_units" if mixed else "units_as_text", "warning", 0.9 if mixed else 0.75, f"amounts in {', '.join(sorted(named))}", sum(named.values()), [{"normalize_unit": target}], evidence=named)]


def _rank(value: str) -> int:
    """How well a spelling is cased: like a title, mixed, in lower case, in upper case."""
    return 0 if value.istitle() else 2 if value.islower() else 3 if value.isupper() else 1


def category_groups(counts: dict[str, int]) -> dict[str, str]:
    """Spellings of categories mapped to the one that stands for them: equal but for case and punctuation, or rare typos.

    The spelling that stands for a group is its commonest, then its best cased.
    Groups are taken the largest first; each joins the first larger one whose
    spelling is nearly its own and that is much more frequent, as antonyms are not.
    """
    groups: dict[str, list[str]] = {}
    for value in counts:
        groups.setdefault("".join(ch for ch in value.casefold() if ch.isalnum()), []).append(value)
    total = {k: sum(counts[v] for v in vs) for k, vs in groups.items()}
    spelled = {k: min(vs, key=lambda v: (-counts[v], _rank(v), v)) for k, vs in groups.items()}
    leading: list[str] = []
    mapping = {}
    for key in sorted(groups, key=lambda k: (-total[k], k)):
        near = (k for k in leading if total[key] <= CATEGORY_RATIO * total[k] and similarity(spelled[key], spelled[k]) >= CATEGORY_SIMILARITY)
        home = next(near, None)
        if home is None:
            leading.append(key)
        best = spelled[home if home is not None else key]
        mapping |= {v: best for v in groups[key] if v != best}
    return dict(sorted(mapping.items()))


@detector("categories", priority=50)
@_text
def categories(ctx: Context) -> list[Issue]:
    if ctx.stats.semantic_type not in ("categorical", "text") or ctx.stats.unique_count > CATEGORY_VALUES:
        return []
    clean = ctx.values().groupBy(c.collapse(_v()).alias("value")).agg(F.sum("n").alias("n")).filter("value <> ''").limit(CATEGORY_VALUES + 1).collect()
    if not 1 < len(clean) <= CATEGORY_VALUES:
        return []
    counts = {r.value: r.n for r in clean}
    mapping = category_groups(counts)
    exact = all("".join(ch for ch in a.casefold() if ch.isalnum()) == "".join(ch for ch in b.casefold() if ch.isalnum()) for a, b in mapping.items())
    return [Issue(ctx.column, "category_variants", "warning", 0.9 if exact else 0.7, f"{len(mapping)} spellings of other values", sum(counts[v] for v in mapping), [{"normalize_values": mapping}], evidence=mapping)] if mapping else []


@detector("text_case", priority=60)
@_text
def text_case(ctx: Context) -> list[Issue]:
    """Names that are not in title case."""
    hint = any(h in ctx.column.lower() for h in ("name", "city", "country", "state", "town", "date", "day"))
    if ctx.stats.semantic_type not in ("text", "categorical") or not hint:
        return []
    n = ctx.counts(other=(_v() != c.title_case(_v())) & _v().rlike("[A-Za-z]"))
    return [Issue(ctx.column, "inconsistent_case", "info", 0.55, f"{n['other']} values are not in title case", n["other"], ["title_case"])] if n["all"] and n["other"] >= 0.25 * n["all"] else []


@detector("outliers", priority=70)
def outliers(ctx: Context) -> list[Issue]:
    p = ctx.stats
    if p.count < 8 or p.semantic_type not in ("integer", "float", "currency") or (p.dtype not in NUMERIC and p.dtype != "string"):
        return []
    r = outlier_bounds(ctx.df, ctx.column).first()
    return [Issue(ctx.column, "outliers", "info", 0.85, f"{r.n_outliers} values lie outside {r.low:g} to {r.high:g}", r.n_outliers, evidence={"low": r.low, "high": r.high})] if r.n_values >= 8 and r.n_outliers else []


def fuzzy_pairs(df: DataFrame, columns: list[str]) -> list[tuple[int, int, float]]:
    """(row, row, similarity) of the first rows that nearly repeat each other; a report over a bounded head."""
    least = 2 * FUZZY_SIMILARITY - 1 - 1e-3
    rows = head(df, FUZZY_ROWS).select(ROW_ID, *(F.col(f"`{x}`").cast("string").alias(x) for x in columns)).orderBy(ROW_ID).collect()
    texts = [(r[ROW_ID], " ".join(" ".join(str(r[x] or "").casefold().split()) for x in columns)) for r in rows]
    found = []
    for k, (i, a) in enumerate(texts):
        matcher = difflib.SequenceMatcher(None, b=snake_case(a))
        for j, b in texts[k + 1 :]:
            matcher.set_seq1(snake_case(b))
            # An upper bound: even all words in common could not lift less than this to the threshold.
            if a != b and matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least and (s := similarity(a, b)) >= FUZZY_SIMILARITY:
                found.append((i, j, s))
    return found


@detector("dedup", scope="frame", priority=80)
def repeated_rows(ctx: Context) -> list[Issue]:
    """Rows that repeat others: exactly, by their key, or nearly."""
    issues, exact = [], ctx.profile.duplicate_rows
    if exact:
        issues.append(Issue(None, "duplicate_rows", "warning", 1.0, f"{exact} rows repeat others", exact, ["dedup"]))
    for name, p in ctx.profile.columns.items():
        if p.semantic_type in ("email", "id") and p.count:
            n = key_duplicates(ctx.df, [name]).first()
            if n.n_rows - n.n_keys > exact:
                issues.append(Issue(name, "duplicate_keys", "warning", 0.6, f"{n.n_rows} rows share {n.n_keys} values of {name!r}", n.n_rows))
    texts = [n for n, p in ctx.profile.columns.items() if p.dtype == "string"]
    pairs = fuzzy_pairs(ctx.df, texts) if texts else []
    if pairs:
        issues.append(Issue(None, "near_duplicates", "info", 0.55, f"{len(pairs)} pairs among the first rows nearly repeat each other", len(pairs), evidence={"pairs": pairs[:20]}))
    return issues


def quality_score(known: Profile, issues: list[Issue]) -> float:
    """100 for a table without issues; each issue costs its severity times the share of rows it concerns."""
    if not known.columns or not known.n_rows:
        return 100.0
    cost = sum(SEVERITY[i.severity] * min(1.0, i.affected / known.n_rows) for i in issues if i.column) + 0.5 * known.duplicate_rows / known.n_rows
    return round(100.0 * max(0.0, 1.0 - cost / len(known.columns)), 1)
