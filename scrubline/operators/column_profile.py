"""Column profiles of loads, with expressions induced by minimum description length.

A value is a row of runs: letters, digits, and what stands between. The values
of a load's column with the same row of runs are described together: each run by
a literal, by a few alternatives, or by a class with bounded or open length,
whichever takes the fewest bits for all distinct values. Two such descriptions
become one with an optional part where that is shorter, and values that no
description makes shorter conform to none. All of it is aggregation and joins of
aggregates, so neither a large load nor many shapes end in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubline.functions.columns import let
from scrubline.session import cut, only

#: A run of letters, or of digits, in the row of runs of a value.
LETTER, DIGIT = "\x01", "\x02"
#: Bits for a plain character, a class, a bound of its length, the length of an open run, a letter in one case or any, a digit.
PLAIN_BITS, CLASS_BITS, BOUND_BITS, RUN_BITS, CASED_BITS, LETTER_BITS, DIGIT_BITS = 8.0, 8.0, 8.0, 3.0, 4.7, 5.7, 3.33
#: Bits for one more expression, for each row that is an exception, and for each value that has or lacks an optional part.
EXPRESSION_BITS, EXCEPTION_BITS, OPTION_BITS = 16.0, 2.0, 1.0
#: Most alternatives of a run, and most runs of an optional part: the size of what an expression can say.
ALTERNATIVES, OPTIONAL_RUNS = 16, 3
TYPES = ("date", "integer", "float", "email", "phone")
#: Shares of fitting values below which a type is wrong, or its pattern violated; null shares that differ by more have shifted.
TYPE_SHARE, PATTERN_SHARE, NULL_SHIFT = 80, 95, 10
CUSTOMER_COLUMNS = {"name": "string", "age": "bigint", "city": "string", "signup": "string", "price": "double", "contact": "string"}
KEY = ["load", "column_name"]

_LETTERS = r"[\p{L}\p{M}\p{N}&&[^0-9]]"
_OTHERS = r"[^\p{L}\p{M}\p{N}]"


def _fits(kind: str, text: Column, number: Column, numeric: Column) -> Column:
    """Whether a non-null value fits a semantic type."""
    digits = F.length(F.regexp_replace(text, r"[^0-9]", ""))
    return {
        "date": ~numeric & text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull(),
        "integer": F.when(numeric, number == F.floor(number)).otherwise(text.rlike(r"^[+-]?[0-9]+$")),
        "float": numeric | text.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"),
        "email": ~numeric & text.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
        "phone": ~numeric & text.rlike(r"^[-+(). 0-9]+$") & digits.between(7, 15),
    }[kind]


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|&-])", r"\\$1")


def _signature(text: Column) -> Column:
    """The row of runs of a value."""
    plain = F.translate(text, LETTER + DIGIT, "\x03\x03")
    return F.regexp_replace(F.regexp_replace(plain, _LETTERS + "+", LETTER), "[0-9]+", DIGIT)


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({_LETTERS}+|[0-9]+|{_OTHERS}+)"), F.lit(1))


def long_values(df: DataFrame, group: str, columns: dict[str, str]) -> DataFrame:
    """(load, column_name, text, number, numeric): one row for each row and column of df."""
    rows = only(df, {group: "bigint", **columns})
    numeric = {c: t in ("bigint", "double", "int", "float") for c, t in columns.items()}
    cells = ", ".join(f"'{c}', cast(`{c}` as string), {f'cast(`{c}` as double)' if numeric[c] else 'cast(null as double)'}, {str(numeric[c]).lower()}" for c in columns)
    return rows.filter(F.col(group).isNotNull()).select(F.col(group).alias("load"), F.expr(f"stack({len(columns)}, {cells}) as (column_name, text, number, numeric)"))


def _cheapest(options: list[tuple[Column, Column, Column]]) -> Column:
    """(bits, pattern) of the option with the fewest bits among those whose condition holds."""
    return F.array_min(F.array_compact(F.array(*(F.when(test, F.struct(bits.cast("double").alias("bits"), pattern.alias("pattern"))) for test, bits, pattern in options))))


def _description(s: Column) -> Column:
    """(bits, pattern) of one run, of the statistics s of all distinct values' texts in it."""
    n = s["n_values"].cast("double")
    digit, spread = s["digit"], s["hi"] - s["lo"]
    title = ~digit & ~s["low"] & ~s["up"] & s["title"]
    kind = F.when(digit, F.lit("[0-9]")).when(s["low"], r"\p{Ll}").when(s["up"], r"\p{Lu}").when(s["title"], r"\p{Lu}\p{Ll}").otherwise(r"[\p{L}\p{M}\p{N}]")
    each = F.when(digit, DIGIT_BITS).when(s["low"] | s["up"] | s["title"], CASED_BITS).otherwise(LETTER_BITS)
    # The first letter of a title stands before the class of the others.
    less = title.cast("int")
    lo, hi = (s["lo"] - less).cast("string"), (s["hi"] - less).cast("string")
    bounds = F.when(spread > 0, F.concat(F.lit("{"), lo, F.lit(","), hi, F.lit("}"))).when(s["lo"] - less == 1, "").otherwise(F.concat(F.lit("{"), lo, F.lit("}")))
    letters = s["sum_len"] * each + CLASS_BITS
    size = F.coalesce(F.size(s["texts"]), F.lit(0))
    total = F.aggregate(F.coalesce(s["texts"], F.array().cast("array<string>")), F.lit(0), lambda acc, t: acc + F.length(t))
    one = F.transform(s["texts"], _escaped)
    return _cheapest([
        (size == 1, total * PLAIN_BITS, F.element_at(one, 1)),
        (size > 1, (total + size) * PLAIN_BITS + n * F.log2(size.cast("double")), F.concat(F.lit("(?:"), F.array_join(one, "|"), F.lit(")"))),
        (F.lit(True), letters + 2 * BOUND_BITS + n * F.log2(spread + F.lit(1.0)), F.concat(kind, bounds)),
        (F.lit(True), letters + n * RUN_BITS, F.concat(kind, F.when(title, "*").otherwise("+"))),
    ])


_MERGED = ("texts", "n_values", "lo", "hi", "sum_len", "digit", "low", "up", "title")


def _merged(a: Column, b: Column) -> Column:
    """The statistics of a run in the values of both."""
    return let(F.array_sort(F.array_union(a["texts"], b["texts"])), lambda texts: _merged_with(a, b, texts))


def _merged_with(a: Column, b: Column, texts: Column) -> Column:
    both = {
        "texts": F.when(F.size(texts) <= ALTERNATIVES, texts), "n_values": a["n_values"] + b["n_values"], "lo": F.least(a["lo"], b["lo"]), "hi": F.greatest(a["hi"], b["hi"]), "sum_len": a["sum_len"] + b["sum_len"],
        **{k: a[k] & b[k] for k in ("digit", "low", "up", "title")},
    }
    return F.struct(*(both[k].alias(k) for k in _MERGED))


def _run_statistics(values: DataFrame, shapes: DataFrame) -> DataFrame:
    """(load, column_name, shape, stats): for each shape of several values the statistics of its runs, in order; runs of other characters have none."""
    run = F.col("run")
    several = shapes.filter("n_values > 1").select(*KEY, "shape")
    runs = values.join(several, [*KEY, "shape"], "left_semi").select(*KEY, "shape", F.posexplode(_runs(F.col("text"))).alias("at", "run")).filter(run.rlike(r"^[\p{L}\p{M}\p{N}]"))
    digit = run.rlike("^[0-9]")
    # Digits count by their number alone; that all are the same shows in their hashes.
    counted = cut(runs.groupBy(*KEY, "shape", "at", digit.alias("digit"), F.when(digit, F.lpad(F.lit(""), F.length(run), "9")).otherwise(run).alias("run")).agg(
        F.count(F.lit(1)).alias("n_values"), F.min(F.xxhash64(run)).alias("least"), F.max(F.xxhash64(run)).alias("most"), F.min(F.when(digit, run.try_cast("decimal(38,0)"))).alias("number"),
    ))
    place = [*KEY, "shape", "at"]
    is_low, is_up, is_title = (run.rlike(p) for p in (r"^\p{Ll}+$", r"^\p{Lu}+$", r"^\p{Lu}\p{Ll}*$"))
    sums = counted.groupBy(*place).agg(
        F.sum("n_values").alias("n_values"), F.min(F.length(run)).alias("lo"), F.max(F.length(run)).alias("hi"), F.sum(F.length(run) * F.col("n_values")).alias("sum_len"), F.every("digit").alias("digit"),
        F.every(is_low).alias("low"), F.every(is_up).alias("up"), F.every(is_title).alias("title"), F.min("least").alias("least"), F.max("most").alias("most"), F.min("number").alias("number"),
    )
    rank = F.row_number().over(Window.partitionBy(*place).orderBy("run"))
    first = counted.filter("not digit").withColumn("rank", rank).filter(F.col("rank") <= ALTERNATIVES + 1).groupBy(*place).agg(F.array_sort(F.collect_list("run")).alias("words"))  # at most one more than an expression can hold
    same = F.lpad(F.col("number").cast("string"), F.col("lo"), "0")
    texts = F.when(F.size("words") <= ALTERNATIVES, F.col("words")).when(F.col("digit") & (F.col("least") == F.col("most")) & (F.col("hi") <= 38), F.array(same))
    stats = sums.join(first, place, "left").select(*place, F.struct(*(texts.alias(k) if k == "texts" else F.col(k) for k in _MERGED)).alias("x"))
    return stats.groupBy(*KEY, "shape").agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("stats"))  # as many as the runs of a shape


def _expression(runs: Column, stats: Column, option: Column | None = None) -> Column:
    """(bits, pattern) of a whole shape: its runs one after the other, those of the optional part (from, runs) in brackets."""
    parts = let(stats, lambda st: _parts(runs, st))
    return let(parts, lambda found: _joined(found, option))


def _parts(runs: Column, stats: Column) -> Column:
    return F.transform(runs, lambda r, i: F.when(F.map_contains_key(stats, i), let(F.try_element_at(stats, i), _description)).otherwise(F.struct((F.length(r) * PLAIN_BITS).alias("bits"), _escaped(r).alias("pattern"))))


def _joined(parts: Column, option: Column | None) -> Column:
    bits = F.aggregate(parts, F.lit(EXPRESSION_BITS), lambda acc, x: acc + x["bits"])
    if option is None:
        return F.struct(bits.alias("bits"), F.array_join(F.transform(parts, lambda x: x["pattern"]), "").alias("pattern"))
    marked = F.transform(parts, lambda x, i: F.concat(F.when(i == option["at"], "(?:").otherwise(""), x["pattern"], F.when(i == option["at"] + option["n"] - 1, ")?").otherwise("")))
    return F.struct(bits.alias("bits"), F.array_join(marked, "").alias("pattern"))


def _with_options(described: DataFrame) -> DataFrame:
    """(load, column_name, shape, pattern) of shapes that share an expression with another one that has a part more."""
    size = F.size("runs")
    cuts = F.flatten(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(OPTIONAL_RUNS), size - i)), lambda n: F.struct(i.cast("int").alias("at"), n.cast("int").alias("n")))))
    longer = described.filter((size > 1) & (size <= 64)).withColumn("option", F.explode(cuts))
    end = F.col("option.at") + F.col("option.n")
    signs = F.transform("runs", _signature)
    kept = F.concat(F.slice(signs, F.lit(1), F.col("option.at")), F.slice(signs, end + 1, F.greatest(size - end, F.lit(0))))
    longer = longer.filter(F.size("runs") > F.col("option.n")).withColumn("rest", F.array_join(kept, ""))
    shorter = described.select(*KEY, F.col("shape").alias("rest"), F.col("runs").alias("runs_b"), F.col("stats").alias("stats_b"), F.col("bits").alias("bits_b"), F.col("n_values").alias("n_b"))
    pairs = longer.join(shorter, [*KEY, "rest"])
    at, n = F.col("option.at"), F.col("option.n")
    other = lambda k: F.try_element_at("stats_b", F.when(k < at, k).when(k >= at + n, k - n))
    both = F.transform_values("stats", lambda k, x: F.when((k < at) | (k >= at + n), let(other(k), lambda y: _merged(x, y))).otherwise(x))
    made = cut(pairs.select(*KEY, "shape", "rest", (F.col("bits") + F.col("bits_b") - OPTION_BITS * (F.col("n_values") + F.col("n_b"))).alias("apart"), _expression(F.col("runs"), both, F.col("option")).alias("made")))
    made = made.select(*KEY, "shape", "rest", F.col("made.pattern").alias("pattern"), (F.col("apart") - F.col("made.bits")).alias("saved")).filter("saved > 0")
    # A pair stands if neither shape saves more with another one.
    most = F.struct("saved", "pattern")
    ends = made.select(*KEY, F.explode(F.array("shape", "rest")).alias("end"), "pattern", "saved").groupBy(*KEY, "end").agg(F.max(most).alias("best"))
    for side in ("shape", "rest"):
        made = made.join(ends.select(*KEY, F.col("end").alias(side), F.col("best").alias(f"best_{side}")), [*KEY, side])
    made = made.filter((F.col("best_shape") == most) & (F.col("best_rest") == most))
    return made.select(*KEY, F.explode(F.array("shape", "rest")).alias("shape"), F.col("pattern").alias("shared"))


def _fit_of_shapes(shape: Column, numeric: Column) -> dict[str, Column]:
    """For each type whether all values of a row of runs fit it (true), none does (false), or each must be asked (null).

    Whether a text is an integer, a decimal or an address depends on its row of runs alone.
    """
    digit, maybe = DIGIT, F.lit(None).cast("boolean")
    return {
        "date": F.when(numeric | (shape != f"{digit}-{digit}-{digit}"), False).otherwise(maybe),
        "integer": F.when(numeric, maybe).otherwise(shape.rlike(f"^[+-]?{digit}$")),
        "float": numeric | shape.rlike(rf"^[+-]?{digit}(?:\.{digit})?$"),
        "email": ~numeric & shape.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
        "phone": F.when(numeric | ~shape.rlike(f"^[-+(). {digit}]+$"), False).otherwise(maybe),
    }


def _described_runs(expression: Column) -> tuple[Column, Column]:
    """The rows of runs that an expression describes, with its optional part and without; letters that it spells out stay."""
    plain = F.translate(expression, LETTER + DIGIT, "\x03\x03")
    times = r"(?:[*+]|\{[0-9,]+\})?"
    for what, sign in (
        (r"(?:\\p\{Lu\}\\p\{Ll\}|\\p\{L[lu]\}|\[\\p\{L\}\\p\{M\}\\p\{N\}\])" + times, LETTER), (r"\[0-9\]" + times, DIGIT),
        # Alternatives are runs of letters or of digits; what else stands in brackets is optional.
        (r"\(\?:[0-9]+(?:\|[0-9]+)+\)", DIGIT), (rf"\(\?:{_LETTERS}+(?:\|{_LETTERS}+)+\)", LETTER), ("[0-9]+", DIGIT),
    ):
        plain = F.regexp_replace(plain, what, sign)
    option = r"(?s)\(\?:(.*)\)\?"
    return tuple(F.regexp_replace(F.regexp_replace(plain, option, kept), r"(?s)\\(.)", "$1") for kept in ("$1", ""))


def _fit_of_expressions(expression: Column, numeric: Column) -> dict[str, Column]:
    """The same for the values of an expression: what it says with its optional part must hold without it too."""
    whole, less = (_fit_of_shapes(runs, numeric) for runs in _described_runs(expression))
    return {k: F.when(whole[k] == less[k], whole[k]) for k in whole}


def distinct_texts(df: DataFrame, group: str, columns: dict[str, str]) -> DataFrame:
    """(load, column_name, text, n, number, numeric, shape): the distinct values of each load and column; null is one of them."""
    values = long_values(df, group, columns).groupBy(*KEY, "text").agg(F.count(F.lit(1)).alias("n"), F.max("number").alias("number"), F.max("numeric").alias("numeric"))
    return values.withColumn("shape", _signature(F.col("text")))


def induced(values: DataFrame) -> DataFrame:
    """(load, column_name, shape, expression, n_rows, n_values): the expression of each row of runs, null where exceptions are the shorter description."""
    texts = values.filter("text is not null")
    shapes = cut(texts.groupBy(*KEY, "shape").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_values"), F.sum(F.length("text") * PLAIN_BITS).alias("plain"), F.min("text").alias("sample")))
    stats = _run_statistics(texts, shapes)
    # A shape of one value is that value, letter by letter.
    found = shapes.join(stats, [*KEY, "shape"], "left").withColumn("runs", _runs(F.col("sample")))
    single = F.struct((F.length("sample") * PLAIN_BITS + EXPRESSION_BITS).alias("bits"), _escaped(F.col("sample")).alias("pattern"))
    found = found.withColumn("made", F.when(F.col("n_values") == 1, single).otherwise(_expression(F.col("runs"), F.coalesce("stats", F.create_map().cast("map<int,struct<texts:array<string>,n_values:bigint,lo:int,hi:int,sum_len:bigint,digit:boolean,low:boolean,up:boolean,title:boolean>>")))))
    worth = F.col("made.bits") < F.col("plain") + EXCEPTION_BITS * F.col("n_rows")
    found = cut(found.select(*KEY, "shape", "n_rows", "n_values", "runs", "stats", F.col("made.bits").alias("bits"), F.when(worth, F.col("made.pattern")).alias("expression")))
    shared = _with_options(found.filter("expression is not null and stats is not null"))
    return cut(found.join(shared, [*KEY, "shape"], "left").select(*KEY, "shape", F.coalesce("shared", "expression").alias("expression"), "n_rows", "n_values"))


def fits(values: DataFrame, patterns: DataFrame) -> DataFrame:
    """(load, column_name, null_count, unique_count, n_rows, fit_<type>): how many values of a column fit each type.

    Each expression is tested against the types once and answers for all its values
    where it can; values are asked one by one only where an expression leaves it open,
    and where none describes them.
    """
    of_text, of_number = (_fit_of_expressions(F.col("expression"), F.lit(numeric)) for numeric in (False, True))
    known = patterns.filter("expression is not null").select(*KEY, "shape", F.struct(*(x.alias(k) for k, x in of_text.items())).alias("said"), F.struct(*(x.alias(k) for k, x in of_number.items())).alias("said_of_numbers"))
    rows = values.join(known, [*KEY, "shape"], "left")
    sums = []
    for kind in TYPES:
        each = _fits(kind, F.col("text"), F.col("number"), F.col("numeric"))
        answer = F.when(F.col("numeric"), F.col("said_of_numbers")[kind]).otherwise(F.col("said")[kind])
        fit = F.when(F.col("text").isNull(), False).otherwise(F.coalesce(answer, each))
        sums.append(F.sum(F.when(fit, F.col("n")).otherwise(0)).alias(f"fit_{kind}"))
    return rows.groupBy(*KEY).agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("text").isNull(), F.col("n")).otherwise(0)).alias("null_count"), F.count("text").alias("unique_count"), *sums)


def _numbers(df: DataFrame, group: str, columns: dict[str, str]) -> DataFrame:
    """Mean, population deviation and range of the numeric columns of each load."""
    numeric = [c for c, t in columns.items() if t in ("bigint", "double", "int", "float")]
    rows = only(df, {group: "bigint", **{c: "double" for c in numeric}}).filter(F.col(group).isNotNull())
    made = rows.groupBy(F.col(group).alias("load")).agg(*(f(c).alias(f"{n}_{c}") for c in numeric for n, f in (("mean", F.avg), ("dev", F.stddev_pop), ("min", F.min), ("max", F.max))))
    cells = ", ".join(f"'{c}', mean_{c}, dev_{c}, min_{c}, max_{c}" for c in numeric)
    return made.select("load", F.expr(f"stack({len(numeric)}, {cells}) as (column_name, mean_value, deviation, min_value, max_value)"))


def profile(df: DataFrame, loads: DataFrame, group: str = "load_id", columns: dict[str, str] | None = None, covered: bool = True) -> DataFrame:
    """The profile of each column in each load, beside that of the load before.

    loads has load_id, feed_name and load_seq; the load before has load_seq one less
    in the same feed. Result: load, column_name, n_rows, null_count, unique_count,
    fit_<type>, n_expressions, n_nonconforming (non-null rows that no expression
    describes), mean_value, deviation, min_value, max_value, the same with prev_
    where there is a load before, and (if covered) coverage: the share of the non-null
    rows that an expression of the load before describes.

    Null means SQL null; empty strings are values. Rows without a load are left out;
    a load without rows has no profile, an empty table none at all.
    """
    columns = columns or CUSTOMER_COLUMNS
    values = cut(distinct_texts(df, group, columns))
    patterns = induced(values)
    order = only(loads, {"load_id": "bigint", "feed_name": "string", "load_seq": "bigint"}).dropna().dropDuplicates(["load_id"]).select(F.col("load_id").alias("load"), "feed_name", "load_seq")
    earlier = order.select(F.col("load").alias("prev"), "feed_name", (F.col("load_seq") + 1).alias("load_seq"))
    before = order.join(earlier, ["feed_name", "load_seq"]).select("load", "prev")
    counts = patterns.groupBy(*KEY).agg(F.count_distinct("expression").alias("n_expressions"), F.sum(F.when(F.col("expression").isNull(), F.col("n_rows")).otherwise(0)).alias("n_nonconforming"))
    made = fits(values, patterns).join(counts, KEY, "left").fillna(0, ["n_expressions", "n_nonconforming"])
    made = cut(made.join(_numbers(df, group, columns), KEY, "left"))
    past = made.select(F.col("load").alias("prev"), "column_name", *(F.col(c).alias(f"prev_{c}") for c in ("n_rows", "null_count", "mean_value", "deviation", "min_value", "max_value")))
    made = made.join(before, "load", "left").join(past, ["prev", "column_name"], "left")
    if not covered:
        return made
    # A text can only conform to the one expression of its row of runs.
    had = patterns.filter("expression is not null").select(F.col("load").alias("prev"), "column_name", "shape", F.col("expression").alias("had"))
    now = patterns.join(before, "load").join(had, ["prev", "column_name", "shape"]).select(*KEY, "shape", "had", F.col("had").eqNullSafe(F.col("expression")).alias("same"))
    hit = F.col("same") | F.rlike(F.col("text"), F.concat(F.lit("^(?:"), F.col("had"), F.lit(r")\z")))
    hits = values.filter("text is not null").join(now, [*KEY, "shape"]).filter(hit).groupBy(*KEY).agg(F.sum("n").alias("n_covered"))
    coverage = F.coalesce("n_covered", F.lit(0)) / (F.col("n_rows") - F.col("null_count"))
    return made.join(hits, KEY, "left").withColumn("coverage", F.when(F.col("prev_n_rows").isNotNull() & (F.col("n_rows") > F.col("null_count")), coverage)).drop("n_covered")


def induced_patterns(df: DataFrame, group: str = "load_id", columns: dict[str, str] | None = None) -> DataFrame:
    """(load_id, column_name, pattern, n_rows, n_values): the regular expressions that describe each column of each load.

    pattern is null for the values that no expression describes; nulls are left out.
    """
    parts = induced(cut(distinct_texts(df, group, columns or CUSTOMER_COLUMNS)))
    return parts.groupBy(F.col("load").alias("load_id"), "column_name", F.col("expression").alias("pattern")).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"))


def findings(df: DataFrame, loads: DataFrame, recorded: DataFrame) -> DataFrame:
    """(load_id, column_name, finding): where recorded profiles are wrong, and what changed against the load before.

    Findings: null_count, unique_count (the recorded number is wrong),
    semantic_type (less than 80 % of the values fit the recorded type), pattern
    (80 to 95 % fit), null_shift, mean_shift and range_shift. Columns without values
    have neither type nor mean. Repeated records count once, records of unknown
    loads and null records not at all; rows are distinct.
    """
    found = profile(df, loads, covered=False).withColumnRenamed("load", "load_id")
    said = only(recorded, {"load_id": "bigint", "column_name": "string", "null_count": "bigint", "unique_count": "bigint", "semantic_type": "string"}).distinct()
    said = said.select("load_id", "column_name", F.col("null_count").alias("said_nulls"), F.col("unique_count").alias("said_unique"), F.lower("semantic_type").alias("said_type"))
    values = F.col("n_rows") - F.col("null_count")
    fitting = F.coalesce(*(F.when(F.col("said_type") == k, F.col(f"fit_{k}")) for k in TYPES), values)
    wrong = F.array_compact(F.array(
        F.when(F.col("said_nulls") != F.col("null_count"), "null_count"),
        F.when(F.col("said_unique") != F.col("unique_count"), "unique_count"),
        F.when((values > 0) & (fitting * 100 < values * TYPE_SHARE), "semantic_type").when((values > 0) & (fitting * 100 < values * PATTERN_SHARE), "pattern"),
    ))
    width = F.col("prev_max_value") - F.col("prev_min_value")
    changed = F.array_compact(F.array(
        F.when(F.abs(F.col("null_count") * F.col("prev_n_rows") - F.col("prev_null_count") * F.col("n_rows")) * 100 > NULL_SHIFT * F.col("n_rows") * F.col("prev_n_rows"), "null_shift"),
        F.when(F.abs(F.col("mean_value") - F.col("prev_mean_value")) > F.col("prev_deviation") / 2, "mean_shift"),
        F.when((F.col("min_value") < F.col("prev_min_value") - width) | (F.col("max_value") > F.col("prev_max_value") + width), "range_shift"),
    ))
    key = ["load_id", "column_name"]
    return found.join(said, key, "left").select(*key, F.explode(F.array_union(wrong, changed)).alias("finding")).distinct()
