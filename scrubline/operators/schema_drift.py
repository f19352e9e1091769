"""Files of a feed whose columns change, read into one table, with every change.

The schema of a file says for each column how many values have each type; such
schemas are fused by adding up, file by file and along a column's whole path
through a feed, and keep every alternative. In the table a column is a tagged
union: one typed branch for each type, and a canonical value beside them. Changes
are read off the schemas of each file and the one before: columns by name, renamed
ones by what they hold, types by the commonest alternative, and alternatives that
appear without becoming that.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.session import cut, only
from scrubline.sources.raw_records import ROLES, amount_value, by_file, calendar_days, file_heads, header_fields, headers, parsed_lines, plain_name, read_record, role_columns

#: Least share of the fewer distinct values that two columns must share to be one under two names.
SAME_CONTENT = 0.075
_NUMBER = re.compile(r"\(?[-+]?\s*(?:[₹$€£¥]|rs\.?|[a-z]{3})?\s*([\d,]*\d(?:\.\d+)?)\s*(%|[a-z]{2,3}|[₹$€£¥]|/-)?\)?-?", re.I)


def content_keys(value: str) -> list[str]:
    """What a value says in whatever notation, as keys by which equal contents meet."""
    value = value.strip()
    if not value or value.lower() in ("n/a", "null"):
        return []
    if days := calendar_days(value):
        day = days[0]
        return [f"d{day.year}-{min(day.month, day.day)}-{max(day.month, day.day)}"]
    digits = re.sub(r"\D", "", value)
    if re.fullmatch(r"1\d{9}", value):
        # Seconds since 1970 may be a day in another notation, or just a number.
        day = dt.datetime.fromtimestamp(int(value), dt.UTC)
        return [f"d{day.year}-{min(day.month, day.day)}-{max(day.month, day.day)}", f"p{digits[-10:]}"]
    if len(digits) >= 9 and re.fullmatch(r"[-+(). \d]+", value):
        return [f"p{digits[-10:]}"]
    if m := _NUMBER.fullmatch(value):
        number = float(m[1].replace(",", "")) / (100 if m[2] == "%" else 1)
        # Whole numbers may be rounded decimals; small ones would meet by chance.
        return [f"n{round(number, 6):g}"] + ([f"r{int(number + 0.5)}"] if number >= 100 else [])
    if value.lower() in ("true", "false", "yes", "no"):
        return ["b" + str(value.lower() in ("true", "yes"))]
    return ["t" + " ".join(sorted(plain_name(w) for w in re.findall(r"[^\W_]+", value)))]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pair, side, name, values = (c.to_pylist() for c in batch.columns)
        rows = [(p, s, n, k) for p, s, n, v in zip(pair, side, name, values) for k in content_keys(v)]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["file_id", "side", "name", "key"])


def _header_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file, text, delimiter in zip(*(c.to_pylist() for c in batch.columns)):
            seen = set()
            for place, column in enumerate(read_record(text or "", delimiter or ",")[0] or []):
                if (name := plain_name(column)) not in seen:
                    seen.add(name)
                    rows.append((file, name, column, place))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int32()))], names=["file_id", "name", "column_name", "place"])


def file_columns(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, name, column_name, place): the columns of each header, by the name that ignores case, blanks and punctuation.

    Of columns with the same such name in one header the first counts.
    """
    heads = file_heads(files, lines).filter("head is not null")
    return heads.select("file_id", "head", "delimiter").mapInArrow(_header_names, "file_id long, name string, column_name string, place int")


def fused(parts: DataFrame, *path: str) -> DataFrame:
    """Schemas fused by path: (path, union) with union as (type, n) of every alternative a path has had, the commonest first.

    parts has the path, a type and a count n in each row. Fusing is adding up, so
    parts may be schemas of values, of files, or fused schemas again, in any order.
    """
    counted = parts.groupBy(*path, "type").agg(F.sum("n").alias("n"))
    # As many alternatives as there are types.
    ranked = F.reverse(F.array_sort(F.collect_list(F.struct("n", "type"))))
    return counted.groupBy(*path).agg(F.transform(ranked, lambda x: F.struct(x["type"].alias("type"), x["n"].alias("n"))).alias("union"))


def alternatives(unions: DataFrame) -> DataFrame:
    """Fused schemas as one row for each path and type again, to be fused further."""
    return unions.select(*(c for c in unions.columns if c != "union"), F.inline("union"))


class Feed:
    """The files of feeds with their fused schemas, each beside the file before it."""

    def __init__(self, files: DataFrame, lines: DataFrame, same_content: float):
        self.columns = cut(file_columns(files, lines))
        order = only(files, {"file_id": "bigint", "feed_name": "string", "file_seq": "bigint"}).dropna().dropDuplicates(["file_id"])
        earlier = order.select(F.col("file_id").alias("prev_id"), "feed_name", (F.col("file_seq") + 1).alias("file_seq"))
        headed = self.columns.select("file_id").distinct()
        self.pairs = cut(order.join(earlier, ["feed_name", "file_seq"]).select("file_id", "prev_id").join(headed, "file_id").join(headed.toDF("prev_id"), "prev_id"))
        self.order = order
        # Contents are aggregated once: the distinct values of each column with their types; of them the schema of each file.
        valid = parsed_lines(files, lines).filter("types is not null and reason is null")
        cells = valid.select("file_id", F.posexplode(F.arrays_zip("fields", "types")).alias("place", "cell")).select("file_id", "place", F.col("cell.fields").alias("value"), F.col("cell.types").alias("type"))
        self.values = cut(cells.filter("type <> ''").groupBy("file_id", "place", "value", "type").agg(F.count(F.lit(1)).alias("n")))
        self.schemas = cut(fused(self.values, "file_id", "place"))
        self.same_content = same_content
        self._match()

    def _match(self) -> None:
        """both: columns of this file and of the one before under one name; renamed: under two names; new and gone: the rest."""
        now = self.pairs.join(self.columns, "file_id").join(self.schemas, ["file_id", "place"], "left").select("file_id", "name", "column_name", "place", "union")
        past = self.schemas.select(F.col("file_id").alias("prev_id"), F.col("place").alias("prev_place"), F.col("union").alias("prev_union"))
        before = self.pairs.join(self.columns.toDF("prev_id", "name", "prev_column", "prev_place"), "prev_id").join(past, ["prev_id", "prev_place"], "left")
        self.both = cut(now.join(before.select("file_id", "name", "prev_column", "prev_place", "prev_union", F.col("prev_id").alias("held_by")), ["file_id", "name"], "full"))
        self.new = self.both.filter("prev_column is null").select("file_id", F.col("name").alias("new_name"), "column_name", "union", "place")
        self.gone = self.both.filter("column_name is null").select("file_id", F.col("name").alias("gone_name"), "prev_column", "prev_union", "held_by", "prev_place")
        # Contents count only where a file has both, a column gone and a column new.
        wanted_new = self.new.join(self.gone.select("file_id"), "file_id", "left_semi").select("file_id", F.lit("new").alias("side"), F.col("new_name").alias("name"), F.col("file_id").alias("held_by"), "place")
        wanted_gone = self.gone.join(self.new.select("file_id"), "file_id", "left_semi").select("file_id", F.lit("gone").alias("side"), F.col("gone_name").alias("name"), "held_by", F.col("prev_place").alias("place"))
        values = self.values.withColumnRenamed("file_id", "held_by").join(wanted_new.unionByName(wanted_gone), ["held_by", "place"]).select("file_id", "side", "name", "value")
        keys = cut(values.mapInArrow(_keys, "file_id long, side string, name string, key string").distinct().withColumn("level", F.col("key").startswith("r")))
        sizes = keys.groupBy("file_id", "side", "name", "level").agg(F.count(F.lit(1)).alias("size"))
        side = lambda s, d: d.filter(F.col("side") == s).drop("side").withColumnRenamed("name", f"{s}_name")
        shared = side("new", keys).join(side("gone", keys), ["file_id", "key", "level"]).groupBy("file_id", "new_name", "gone_name", "level").agg(F.count(F.lit(1)).alias("shared"))
        shared = shared.join(side("new", sizes).withColumnRenamed("size", "new_size"), ["file_id", "new_name", "level"]).join(side("gone", sizes).withColumnRenamed("size", "gone_size"), ["file_id", "gone_name", "level"])
        share = F.max(F.col("shared") / F.least("new_size", "gone_size"))
        alike = cut(shared.groupBy("file_id", "new_name", "gone_name").agg(share.alias("share")).filter(F.col("share") >= self.same_content))
        rank = F.struct("share", "new_name", "gone_name")
        best_new = alike.groupBy("file_id", "new_name").agg(F.max_by("gone_name", rank).alias("gone_name"))
        best_gone = alike.groupBy("file_id", "gone_name").agg(F.max_by("new_name", rank).alias("new_name"))
        self.renamed = cut(best_new.join(best_gone, ["file_id", "new_name", "gone_name"]).join(self.new, ["file_id", "new_name"]).join(self.gone, ["file_id", "gone_name"]))

    def kept(self) -> DataFrame:
        """(file_id, column_name, place, union, held_by, prev_column, prev_place, prev_union): each column with what it was in the file before."""
        wanted = ("file_id", "column_name", "place", "union", "held_by", "prev_column", "prev_place", "prev_union")
        same = self.both.filter("column_name is not null and prev_column is not null")
        return same.select(*wanted).unionByName(self.renamed.select(*wanted))


def schema_changes(files: DataFrame, lines: DataFrame, same_content: float = SAME_CONTENT) -> DataFrame:
    """(file_id, kind, column_name): each change of a file's columns against the file of its feed with file_seq one less.

    kind: new_column, missing_column, renamed_column or dtype_change. column_name
    is as in this file's header, for missing_column as in the one before. A column
    that is gone and one that is new are the same under another name if they share
    at least same_content of the values of the one with fewer, in any notation, and
    neither has a better partner. The type of a column is the commonest alternative of
    its fused schema; columns without values have none and don't change type. Files
    without header or predecessor have no changes.
    """
    feed = Feed(files, lines, same_content)
    first = lambda c: F.get(c, F.lit(0))["type"]
    retyped = feed.kept().filter(first("union") != first("prev_union"))
    said = lambda d, kind, c: d.select("file_id", F.lit(kind).alias("kind"), F.col(c).alias("column_name"))
    return (
        said(feed.new.join(feed.renamed, ["file_id", "new_name"], "left_anti"), "new_column", "column_name")
        .unionByName(said(feed.gone.join(feed.renamed, ["file_id", "gone_name"], "left_anti"), "missing_column", "prev_column"))
        .unionByName(said(feed.renamed, "renamed_column", "column_name"))
        .unionByName(said(retyped, "dtype_change", "column_name")).distinct()
    )


def appearing_alternatives(files: DataFrame, lines: DataFrame, same_content: float = SAME_CONTENT) -> DataFrame:
    """(file_id, column_name, type, n_values, n_typed): each type that values of a column have in a file and none had in the file before.

    It need not be the commonest one: n_values of n_typed non-empty values have it.
    Columns are followed under other names; new columns have no file before and are
    left out, as are columns that had no values there.
    """
    kept = Feed(files, lines, same_content).kept().filter("prev_union is not null")
    total = F.aggregate("union", F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
    appeared = F.filter("union", lambda x: ~F.array_contains(F.transform("prev_union", lambda y: y["type"]), x["type"]))
    made = kept.select("file_id", "column_name", total.alias("n_typed"), F.explode(appeared).alias("x"))
    return made.select("file_id", "column_name", F.col("x.type").alias("type"), F.col("x.n").alias("n_values"), "n_typed").distinct()


def column_paths(feed: Feed) -> DataFrame:
    """(file_id, place, path): the path of each column: the name it had when it first appeared in its feed, whatever it was called later.

    Each column points to the one it was in the file before; pointers are doubled
    until all reach their first column, so a feed of n files takes log n rounds.
    """
    at = lambda f, p: F.struct(F.col(f).alias("file_id"), F.col(p).alias("place"))
    links = feed.kept().select(at("file_id", "place").alias("here"), at("held_by", "prev_place").alias("root"))
    every = feed.columns.select(at("file_id", "place").alias("here"), "name")
    live = cut(every.join(links, "here", "left").select("here", F.coalesce("root", "here").alias("root"), "name"))
    while True:
        further = live.select(F.col("here").alias("root"), F.col("root").alias("next"))
        moved = cut(live.join(further, "root").select("here", "root", "next", "name"))
        done = moved.filter("root <> next").isEmpty()
        live = moved.select("here", F.col("next").alias("root"), "name")
        if done:
            break
    names = every.select(F.col("here").alias("root"), F.col("name").alias("path"))
    return live.join(names, "root").select("here.file_id", "here.place", "path")


def tagged(value: Column, kind: Column) -> Column:
    """A value as a tagged union: its type, one branch for each type, and the canonical text that equal values of any branch share."""
    text = F.trim(value)
    number = text.try_cast("double")
    return F.struct(
        kind.alias("kind"), F.when(kind == "integer", text.try_cast("bigint")).alias("as_integer"), F.when(kind == "decimal", number).alias("as_decimal"),
        F.when(kind == "boolean", F.lower(text).isin("true", "yes")).alias("as_boolean"), F.when(kind.isin("date", "text"), text).alias("as_text"),
        F.when(kind == "boolean", F.lower(text).isin("true", "yes").cast("string")).when(kind.isin("integer", "decimal"), F.regexp_replace(number.try_cast("decimal(38,6)").cast("string"), r"\.?0+$", ""))
        .when(kind != "", F.regexp_replace(text, r"\s+", " ")).alias("canonical"),
    )


def _role_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file, text, delimiter in zip(*(c.to_pylist() for c in batch.columns)):
            places = role_columns(header_fields(text or "", delimiter or ","))
            rows.append((file, *(places.get(r) for r in ROLES)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if not i else pa.int32()) for i in range(len(ROLES) + 1)], names=["file_id", *ROLES])


def unified_rows(files: DataFrame, lines: DataFrame) -> DataFrame:
    """One table of the valid rows of all files: each role's column under one name, all others in the map extra by their header's name.

    Every column may be of several types, so signup_date, amount and all of extra are
    tagged unions (kind, as_integer, as_decimal, as_boolean, as_text, canonical);
    amount_value is the number in any notation. A role that a file lacks is null.
    """
    rows = parsed_lines(files, lines).filter("types is not null and reason is null")
    places = file_heads(files, lines).filter("head is not null").select("file_id", "head", "delimiter").mapInArrow(_role_places, "file_id long, " + ", ".join(f"{r} int" for r in ROLES)).withColumnsRenamed({r: f"_{r}" for r in ROLES})
    rows = by_file(rows, places.join(headers(files, lines), "file_id"), "inner")
    cell = lambda r: F.get("fields", F.col(f"_{r}"))
    kind = lambda r: F.get("types", F.col(f"_{r}"))
    used = F.array(*(F.col(f"_{r}") for r in ROLES))
    others = F.filter(F.transform("header", lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: ~F.coalesce(F.array_contains(F.array_compact(used), x["i"]), F.lit(False)))
    firsts = F.filter(others, lambda x: F.array_position("header", x["h"]) == x["i"] + 1)
    extra = F.map_from_entries(F.transform(firsts, lambda x: F.struct(x["h"].alias("key"), tagged(F.get("fields", x["i"]), F.get("types", x["i"])).alias("value"))))
    return rows.select(
        "line_id", "file_id", "line_no", cell("customer_name").alias("customer_name"), tagged(cell("signup_date"), kind("signup_date")).alias("signup_date"),
        tagged(cell("amount"), kind("amount")).alias("amount"), amount_value("amount").alias("amount_value"), cell("city").alias("city"), cell("email").alias("email"), cell("phone").alias("phone"), extra.alias("extra"),
    )


def feed_schemas(files: DataFrame, lines: DataFrame, same_content: float = SAME_CONTENT) -> DataFrame:
    """(feed_name, path, union, n_files): the schemas of a feed's files fused along each column's path, with every type it has had."""
    feed = Feed(files, lines, same_content)
    paths = column_paths(feed).join(feed.order.select("file_id", "feed_name"), "file_id")
    held = paths.join(feed.schemas, ["file_id", "place"])
    seen = paths.groupBy("feed_name", "path").agg(F.count_distinct("file_id").alias("n_files"))
    return seen.join(fused(alternatives(held.select("feed_name", "path", "union")), "feed_name", "path"), ["feed_name", "path"], "left")
