"""Points in time written in many notations, brought to one UTC instant.

The text is taken apart once by expressions of the JVM. Local times meet the
offset intervals of their zone in an as-of join on zone and year: two intervals
that hold the local time mean that it occurs twice, none that it is skipped,
one gives the offset.
"""

from __future__ import annotations

import calendar
import datetime as dt
import struct
import zoneinfo
from collections.abc import Iterable, Iterator
from importlib import resources
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.session import only

#: Years whose intervals stand in a row each; those before them, and those up to TABLED_YEAR, share one row a zone.
FIRST_YEAR, LAST_YEAR, TABLED_YEAR = 1970, 2069, 2130
#: Before that year every zone keeps the mean time of its place. From REPEATED_YEAR on nothing but yearly rules is left,
#: so any later year has the offsets of the one of these 28 years that has the same calendar.
EARLIEST_YEAR, REPEATED_YEAR = 1800, 2101
EARLIER, LATER = 0, LAST_YEAR + 1

# Offsets in minutes of zone abbreviations in common use. The
# zone of the row goes first where it knows the abbreviation itself.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "WAT": 60, "CAT": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "EAT": 180, "SAST": 120, "GST": 240, "PKT": 300, "IST": 330, "NPT": 345, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? )?"
_TIME = r"(?:(?:T|,? )(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([ap])\.?m\.?(?![a-z]))?)?(?: ?(Z|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?(?:\[[^\[\]]*\])?|\[[^\[\]]+\]|[a-z][a-z_]*(?:/[a-z0-9_+-]+)*))?$"
# Each shape: a cheap test, the pattern, and the order of its groups as kind, three parts of the day, and the time.
_SHAPES = [
    (r"^\d{4}[-/.]", r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + _TIME, ("ymd", 1, 3, 4, 5)),
    (r"^\d{1,2}[-/.]\d", r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{1,2})" + _TIME, ("order", 1, 3, 4, 5)),
    (r"^\d{8}(?!\d)", r"^(\d{4})(\d{2})(\d{2})(?:[T ](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?())?(?: ?(Z|[+-]\d{2}(?::?\d{2})?))?$", ("ymd", 1, 2, 3, 4)),
    (r"^\d+$", r"^(\d{9,18})$", ("epoch", 1, 0, 0, 0)),
    (r"^[A-Za-z]{3,9}\.? \d", r"^" + _MONTH + r"\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})" + _TIME, ("mdy", 1, 2, 3, 4)),
    (r"\d", r"^" + _DAY + r"(\d{1,2})(?:st|nd|rd|th)?[ -]" + _MONTH + r"\.?,?[ -](\d{4}|\d{2})(?!\d)" + _TIME, ("dmy", 1, 2, 3, 4)),
]


def _parts(text: Column) -> Column:
    """[kind, three parts of the day, hour, minute, second, fraction, a or p, zone], or null."""
    layout = None
    for test, pattern, (kind, a, b, c, t) in _SHAPES:
        groups = [f"${i}" if i else "" for i in (a, b, c)] + [f"${t + i}" if t else "" for i in range(6)]
        made = F.regexp_replace(text, "(?i)" + pattern, "\x01".join([kind, *groups]))
        layout = F.when(text.rlike(test), made) if layout is None else layout.when(text.rlike(test), made)
    parts = F.split(layout, "\x01")
    return F.when(F.size(parts) == 10, parts)


def _int(part: Column) -> Column:
    return part.try_cast("int")


def _seconds(year: int) -> int:
    return (dt.date(year, 1, 1).toordinal() - 719_163) * 86400


def _zone_file(zone: str) -> bytes:
    files = [Path(folder, zone) for folder in zoneinfo.TZPATH]
    found = next((f.read_bytes() for f in files if f.is_file()), None)
    return resources.files("tzdata").joinpath("zoneinfo", *zone.split("/")).read_bytes() if found is None else found


def _changes(found: bytes, info: zoneinfo.ZoneInfo) -> list[int]:
    """The instants at which the clocks of a zone may change up to TABLED_YEAR: those its file lists, and those its yearly rule gives."""
    listed, at = [], 0
    for width in (4, 8):
        # The numbers after the version: universal and standard marks, leap seconds, times, kinds, letters.
        utc, std, leaps, times, kinds, letters = struct.unpack_from(">6L", found, at + 20)
        listed = list(struct.unpack_from(f">{times}{'l' if width == 4 else 'q'}", found, at + 44))
        at += 44 + times * (width + 1) + kinds * 6 + letters + leaps * (width + 4) + std + utc
    if b"," in found[at:]:
        # A yearly rule follows: what it gives in 28 years holds for all other years with the same calendar.
        first = dt.datetime.fromtimestamp(max([_seconds(2037), *listed]), dt.UTC).year + 1
        whole = first + 28 <= 2100
        by_year = _scanned(info, first, first + 28 if whole else TABLED_YEAR + 1)
        alike = {_calendar(y): y for y in by_year}
        for year in range(first, TABLED_YEAR + 1):
            same = year if year in by_year else alike[_calendar(year)]
            listed += [u - _seconds(same) + _seconds(year) for u in by_year[same]]
    return sorted({x for x in listed if _seconds(EARLIEST_YEAR) < x < _seconds(TABLED_YEAR + 1) + 60 * 86400})


def _calendar(year: int) -> tuple[int, bool]:
    """The weekday on which a year begins, Sunday being 1, and whether it has a leap day."""
    return dt.date(year, 1, 1).isoweekday() % 7 + 1, calendar.isleap(year)


def _scanned(info: zoneinfo.ZoneInfo, first: int, last: int) -> dict[int, list[int]]:
    """The changes of a yearly rule in each year from first up to last; such changes are months apart."""
    made: dict[int, list[int]] = {y: [] for y in range(first, last)}
    u, month = _seconds(first), 30 * 86400

    def state(u: int) -> tuple:
        moment = dt.datetime.fromtimestamp(u, info)
        return moment.utcoffset(), moment.tzname()

    now = state(u)
    while u < _seconds(last):
        if (then := state(u + month)) != now:
            lo, hi = u, u + month
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if state(mid) == now else (lo, mid)
            if (year := dt.datetime.fromtimestamp(hi, dt.UTC).year) in made:
                made[year].append(hi)
            now = then
        u += month
    return made


def _zone_rows(zones: Iterable[str]) -> Iterator[tuple[str, int, list[dict]]]:
    """The rows of zone_intervals; many zones are others under a second name."""
    known: dict[bytes, list[tuple[int, list[dict]]]] = {}
    for zone in zones:
        found = _zone_file(zone)
        if found not in known:
            known[found] = list(_year_rows(found, zoneinfo.ZoneInfo(zone)))
        yield from ((zone, *row) for row in known[found])


def _year_rows(found: bytes, info: zoneinfo.ZoneInfo) -> Iterator[tuple[int, list[dict]]]:
    edges = [_seconds(EARLIEST_YEAR) - 86400, *_changes(found, info), _seconds(TABLED_YEAR + 1) + 60 * 86400]
    spans: list[list] = []
    for begin, end in zip(edges, edges[1:]):
        moment = dt.datetime.fromtimestamp(begin, info)
        off, name = int(moment.utcoffset().total_seconds()), moment.tzname()
        if spans and spans[-1][2:] == [off, name]:
            spans[-1][1] = end + off
        else:
            spans.append([begin + off, end + off, off, name])
    for year in (EARLIER, *range(FIRST_YEAR, LAST_YEAR + 1), LATER):
        lo = _seconds({EARLIER: EARLIEST_YEAR}.get(year, year)) - 2 * 86400
        hi = _seconds({EARLIER: FIRST_YEAR, LATER: TABLED_YEAR + 1}.get(year, year + 1)) + 2 * 86400
        yield year, [{"lo": a, "hi": b, "off": o, "abbr": n} for a, b, o, n in spans if a < hi and b > lo]


def zone_intervals(spark: SparkSession) -> DataFrame:
    """(zone, year, spans): for each zone and local year the offset intervals around it, in the order of time.

    A span has the local seconds from which (lo) and before which (hi) its offset
    in seconds (off) holds, and the zone's abbreviation then. The years before
    FIRST_YEAR and those after LAST_YEAR share one row each. The number of rows is
    bounded by the zone database: about 600 zones and 102 rows.
    """

    kinds = (pa.string(), pa.int32(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("off", pa.int32()), ("abbr", pa.string())])))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = zip(*_zone_rows(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds)] or [pa.array([], k) for k in kinds], names=["zone", "year", "spans"])

    zones = sorted(zoneinfo.available_timezones() - {"localtime", "Factory"})
    return spark.createDataFrame([(z,) for z in zones], "zone string").mapInArrow(expand, "zone string, year int, spans array<struct<lo:long,hi:long,off:int,abbr:string>>")


def _years_moved(year: Column) -> Column:
    """The seconds from the year with the same calendar to a year beyond the table."""
    first = F.make_date(year, F.lit(1), F.lit(1))
    leap = (F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) == 366).cast("int")
    same = {_calendar(y): y for y in range(REPEATED_YEAR, REPEATED_YEAR + 28)}
    table = F.array(*(F.lit(_seconds(same[day, bool(leap)])) for day in range(1, 8) for leap in (0, 1)))
    return F.unix_date(first).cast("long") * 86400 - F.get(table, (F.dayofweek(first) - 1) * 2 + leap)


def to_utc(df: DataFrame, text: str, zone: str, date_order: str, keep: list[str]) -> DataFrame:
    """keep, and utc_us, kind and status of the point in time in the column text.

    utc_us: microseconds since 1970 in UTC, or null. kind: the notation. status:
    `ok`; `ambiguous` (the local time occurs twice, the first is taken);
    `skipped` (no such local time, moved forward by the gap); `no_zone` (a local
    time without a known zone); `invalid` (no real point in time); `empty`.

    zone and date_order (dmy, mdy or ymd) name columns for texts that say neither.
    All-numeric dates that start with the year are year, month, day; two-digit
    years are 20xx; digits finer than a microsecond are cut off. A zone, offset or
    abbreviation in the text counts before the column; an abbreviation means what
    it means in the row's own zone, if it is used there. Null, blank and unreadable
    texts give a null instant. Rows are neither dropped nor merged.
    """
    spark = df.sparkSession
    s = F.trim(F.regexp_replace(F.col(f"`{text}`"), r"(?U)[\s\x{feff}]+", " "))
    parsed = df.select(*keep, F.col(f"`{zone}`").alias("_zone"), F.lower(F.col(f"`{date_order}`")).alias("_order"), s.alias("_text")).withColumn("_p", _parts(F.col("_text")))
    p = [F.col("_p")[i] for i in range(10)]
    kind = p[0]
    month = lambda c: F.coalesce(F.expr("cast(nullif(array_position(array({}), lower(substr({}, 1, 3))), 0) as int)".format(", ".join(f"'{m}'" for m in MONTHS), c)), F.expr(f"try_cast({c} as int)"))
    # In a row that says ymd, a date with its year at the end can only be day first.
    order = F.when(kind != "order", kind).when((F.col("_order") == "ymd") & (F.length(p[3]) == 4), "dmy").otherwise(F.col("_order"))
    a, b, c = (_int(x) for x in p[1:4])
    year = F.when(order == "ymd", a).otherwise(c)
    year_text = F.when(order == "ymd", p[1]).otherwise(p[3])
    parsed = parsed.select(
        *keep, "_text", "_zone", kind.alias("kind"),
        F.when(F.length(year_text) == 2, year + 2000).when(F.length(year_text) == 4, year).alias("_y"),
        F.when(order == "mdy", month("_p[1]")).otherwise(month("_p[2]")).alias("_m"),
        F.when(order == "ymd", c).when(order == "mdy", b).otherwise(a).alias("_d"),
        F.when(p[4] == "", 0).otherwise(_int(p[4])).alias("_h"), F.when(p[5] == "", 0).otherwise(_int(p[5])).alias("_mi"), F.when(p[6] == "", 0).otherwise(_int(p[6])).alias("_s"),
        F.rpad(F.substring(p[7], 1, 6), 6, "0").try_cast("long").alias("_us"), F.lower(p[8]).alias("_ap"), F.regexp_replace(p[9], r"^\[|\]$", "").alias("_z"),
        F.when(kind == "epoch", p[1].try_cast("long")).alias("_n"),
    )
    hour = F.when(F.col("_ap") == "", F.when(F.col("_h") < 24, F.col("_h"))).when(F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(F.col("_ap") == "p", 12).otherwise(0))
    day = F.unix_date(F.try_make_timestamp_ntz(F.col("_y"), F.col("_m"), F.col("_d"), F.lit(0), F.lit(0), F.lit(0)).cast("date"))
    seconds = F.when((F.col("_mi") < 60) & (F.col("_s") < 60), (day.cast("long") * 24 + hour) * 3600 + F.col("_mi") * 60 + F.col("_s"))
    upper = F.upper("_z")
    sign, hours, minutes = (F.regexp_extract("_z", r"^(?i:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?", i) for i in (1, 2, 3))
    offset = F.when(F.col("_z").rlike(r"^(?i:UTC|GMT)?[+-]\d"), F.when(sign == "-", -1).otherwise(1) * (_int(hours) * 60 + F.when(minutes == "", 0).otherwise(_int(minutes))) * 60)
    offset = F.when(F.abs(offset) <= 18 * 3600, offset).when(upper.isin("Z", "UTC", "GMT", "UT"), 0)
    local = parsed.select(
        *keep, "_text", "kind", "_n", seconds.alias("_t"), F.coalesce("_us", F.lit(0)).alias("_us"), offset.alias("_off"), upper.alias("_abbr"),
        F.when(F.contains("_z", F.lit("/")) & ~F.col("_z").rlike(r"^(?i:UTC|GMT)?[+-]\d"), F.lower("_z")).otherwise(F.lower("_zone")).alias("_key"),
        F.col("_z").rlike(r"^[A-Za-z]{2,5}$").alias("_named"),
        F.when(F.col("_y") < FIRST_YEAR, EARLIER).when(F.col("_y") > LAST_YEAR, LATER).otherwise(F.col("_y")).alias("_year"),
        F.when(F.col("_y") > TABLED_YEAR, _years_moved(F.col("_y"))).otherwise(F.when(F.col("_y") < EARLIEST_YEAR, seconds - _seconds(EARLIEST_YEAR)).otherwise(0)).alias("_moved"),
    )
    spans = zone_intervals(spark).select(F.lower("zone").alias("_key"), F.col("year").alias("_year"), F.col("spans").alias("_spans"))
    joined = local.join(F.broadcast(spans), ["_key", "_year"], "left")  # bounded by the zone database
    # Years beyond the table are looked up at the same time of another year.
    t = F.col("_t") - F.col("_moved")
    year_long = 366 * 86400
    inside = F.filter("_spans", lambda x: (x["lo"] <= t) & (t < x["hi"]))
    before = F.filter("_spans", lambda x: x["hi"] <= t)
    named = F.filter("_spans", lambda x: (x["abbr"] == F.col("_abbr")) & (x["lo"] - year_long <= t) & (t < x["hi"] + year_long))
    table = F.create_map(*(F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v * 60)))
    found = joined.select(
        *keep, "_text", "kind", "_n", "_t", "_us", "_off", "_named", "_spans", inside.alias("_in"),
        F.when(F.col("_named") & F.col("_off").isNull(), F.coalesce(F.get(named, F.lit(0))["off"], F.try_element_at(table, F.col("_abbr")))).alias("_said"),
        F.coalesce(F.try_element_at(before, F.lit(-1))["off"], F.get("_spans", F.lit(0))["off"]).alias("_past"),
    )
    local_off = F.when(F.col("_named"), None).otherwise(F.coalesce(F.get("_in", F.lit(0))["off"], F.col("_past")))
    used = F.coalesce("_off", "_said", local_off)
    n = F.col("_n")
    epoch = F.when(n < 10**11, n * 10**6).when(n < 10**14, n * 1000).otherwise(n)
    utc = F.when(F.col("kind") == "epoch", epoch).otherwise((F.col("_t") - used) * 10**6 + F.col("_us"))
    plain = F.col("_off").isNull() & F.col("_said").isNull()
    status = (
        F.when(F.col("_text").isNull() | (F.col("_text") == ""), "empty")
        .when(F.col("kind") == "epoch", "ok")
        .when(F.col("_t").isNull(), "invalid")
        .when(used.isNull(), "no_zone")
        .when(plain & (F.size("_in") > 1), "ambiguous")
        .when(plain & (F.size("_in") == 0), "skipped")
        .otherwise("ok")
    )
    return found.select(*keep, utc.alias("utc_us"), "kind", status.alias("status"))


def normalise_signups(customers: DataFrame, branches: DataFrame) -> DataFrame:
    """(record_id, utc_us, kind, status) of signup_date of every row of messy_customers.

    Texts without zone or with an all-numeric date are read as the row's branch
    writes them. A row without a known branch has neither; see to_utc for the rest.
    """
    rows = only(customers, {"record_id": "bigint", "branch_code": "string", "signup_date": "string"})
    known = only(branches, {"branch_code": "string", "zone_name": "string", "date_order": "string"}).dropDuplicates(["branch_code"])
    return to_utc(rows.join(known, "branch_code", "left"), "signup_date", "zone_name", "date_order", ["record_id"])


def signups_in_utc(customers: DataFrame, branches: DataFrame) -> DataFrame:
    """(record_id, utc_us) of the rows of messy_customers whose signup_date is a point in time."""
    return normalise_signups(customers, branches).filter(F.col("utc_us").isNotNull()).select("record_id", "utc_us")
