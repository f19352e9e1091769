"""Profiles, timestamps, failing records and drifting schemas on small hard inputs."""

import datetime as dt
import re
import zoneinfo

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrubline.operators import column_profile, schema_drift, timestamps
from scrubline.sources import raw_records

CLEAN = "load_id long, name string, age long, city string, signup string, price double, contact string, n_rows long"
RECORDED = "load_id long, column_name string, null_count long, unique_count long, semantic_type string, load string"


def table(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


# Timestamps


def utc(*parts, zone="UTC", fold=0):
    moment = dt.datetime(*parts, tzinfo=zoneinfo.ZoneInfo(zone), fold=fold)
    return round(moment.timestamp() * 1_000_000)


CASES = [
    ("2024-07-01T12:00:00Z", utc(2024, 7, 1, 12), "ok"),
    ("2024-07-01 12:00:00.1234567+02:00", utc(2024, 7, 1, 10) + 123456, "ok"),
    ("2024-07-01T12:00:00-0330", utc(2024, 7, 1, 15, 30), "ok"),
    ("2024-07-01 12:00:00 UTC+05:45", utc(2024, 7, 1, 6, 15), "ok"),
    ("2024-07-01 12:00:00", utc(2024, 7, 1, 12, zone="Europe/Berlin"), "ok"),
    ("2024-07-01", utc(2024, 7, 1, zone="Europe/Berlin"), "ok"),
    ("1/7/24", utc(2024, 7, 1, zone="Europe/Berlin"), "ok"),
    (" 01.07.2024\t", utc(2024, 7, 1, zone="Europe/Berlin"), "ok"),
    ("20240701 120000", utc(2024, 7, 1, 12, zone="Europe/Berlin"), "ok"),
    ("1st July 2024", utc(2024, 7, 1, zone="Europe/Berlin"), "ok"),
    ("Jul 1, 2024 12:30 pm", utc(2024, 7, 1, 12, 30, zone="Europe/Berlin"), "ok"),
    ("Jul 1, 2024 12:30 AM", utc(2024, 7, 1, 0, 30, zone="Europe/Berlin"), "ok"),
    ("Mon, 01 Jul 2024 12:00:00 +0200", utc(2024, 7, 1, 10), "ok"),
    ("2024-07-01T12:00:00[Asia/Tokyo]", utc(2024, 7, 1, 3), "ok"),
    ("2024-07-01 12:00:00 America/New_York", utc(2024, 7, 1, 16), "ok"),
    ("2024-10-27 02:30:00", utc(2024, 10, 27, 0, 30), "ambiguous"),
    ("2024-10-27 02:30:00 CET", utc(2024, 10, 27, 1, 30), "ok"),
    ("2024-10-27 02:30:00 CEST", utc(2024, 10, 27, 0, 30), "ok"),
    ("2024-10-27 02:30:00+01:00", utc(2024, 10, 27, 1, 30), "ok"),
    ("2024-03-31 02:30:00", utc(2024, 3, 31, 1, 30), "skipped"),
    ("1719835200", utc(2024, 7, 1, 12), "ok"),
    ("1719835200123", utc(2024, 7, 1, 12) + 123000, "ok"),
    ("1719835200123456", utc(2024, 7, 1, 12) + 123456, "ok"),
    ("20240701", utc(2024, 7, 1, zone="Europe/Berlin"), "ok"),
    ("31/02/2024", None, "invalid"),
    ("2024-13-45", None, "invalid"),
    ("00/00/0000", None, "invalid"),
    ("2024-07-01 25:00:00", None, "invalid"),
    ("12/31/2024", None, "invalid"),
    ("soon", None, "invalid"),
    ("x" * 50_000, None, "invalid"),
    ("", None, "empty"),
    (None, None, "empty"),
]


def test_timestamps(spark):
    rows = [(i, "B", text, "clash", 1) for i, (text, _, _) in enumerate(CASES)]
    customers = table(spark, rows, "record_id long, branch_code string, signup_date string, zone_name string, kind int")
    branches = table(spark, [("B", "Europe/Berlin", "dmy")], "branch_code string, zone_name string, date_order string")
    found = {r.record_id: (r.utc_us, r.status) for r in timestamps.normalise_signups(customers, branches).collect()}
    assert found == {i: (want, status) for i, (_, want, status) in enumerate(CASES)}
    assert timestamps.signups_in_utc(customers, branches).count() == sum(want is not None for _, want, _ in CASES)
    assert timestamps.signups_in_utc(customers.limit(0), branches).count() == 0


def test_timestamps_follow_the_branch(spark):
    customers = table(spark, [(1, "US", "7/1/2024"), (2, "JP", "24/7/1"), (3, None, "2024-07-01"), (4, "??", "2024-07-01T00:00Z"), (5, "US", "2024-11-03 01:30:00 EST"), (5, "US", "2024-11-03 01:30:00 EST")], "record_id long, branch_code string, signup_date string")
    branches = table(spark, [("US", "America/New_York", "mdy"), ("JP", "Asia/Tokyo", "ymd")], "branch_code string, zone_name string, date_order string")
    found = sorted((r.record_id, r.utc_us, r.status) for r in timestamps.normalise_signups(customers, branches).fillna(-1).collect())
    assert found == [(1, utc(2024, 7, 1, 4), "ok"), (2, utc(2024, 6, 30, 15), "ok"), (3, -1, "no_zone"), (4, utc(2024, 7, 1), "ok"), (5, utc(2024, 11, 3, 6, 30), "ok"), (5, utc(2024, 11, 3, 6, 30), "ok")]


def test_zone_intervals_agree_with_the_zone_database(spark):
    spans = timestamps.zone_intervals(spark).filter("zone in ('Europe/London', 'Australia/Lord_Howe', 'Asia/Kolkata') and year in (1999, 2024)").collect()
    for row in spans:
        for s in row.spans:
            moment = dt.datetime.fromtimestamp(s.lo - s.off + 3600, zoneinfo.ZoneInfo(row.zone))
            assert moment.utcoffset().total_seconds() == s.off


# Profiles


def test_findings(spark):
    loads = table(spark, [(1, "f", 1, None), (2, "f", 2, None), (3, "g", 1, None)], "load_id long, feed_name string, load_seq int, prev string")
    rows = [(1, f"n{i}", 30 + i % 10, "x", "2024-01-0%d" % (1 + i % 9), 10.0 + i, f"a{i}@b.example", 0) for i in range(20)]
    rows += [(2, None if i < 5 else f"n{i}", 60 + i % 10, "x", "2024-02-30" if i < 5 else "2024-02-01", 10.0 + i if i else 500.0, "+1 555 1234567" if i < 3 else f"a{i}@b.example", 0) for i in range(20)]
    rows += [(None, "lost", 1, "x", "y", 1.0, "z", 0), (3, "", None, None, "", None, "a" * 20_000, 0)]
    recorded = [(1, c, 0, u, t, "") for c, u, t in (("name", 20, "text"), ("age", 10, "integer"), ("city", 1, "categorical"), ("signup", 9, "date"), ("price", 20, "integer"), ("contact", 20, "email"))]
    recorded += [(2, "name", 4, 15, "text", ""), (2, "signup", 0, 2, "date", ""), (2, "contact", 0, 99, "email", ""), (2, "name", 4, 15, "text", ""), (9, "name", 1, 1, "text", ""), (None, None, None, None, None, None)]
    found = {tuple(r) for r in column_profile.findings(table(spark, rows, CLEAN), loads, table(spark, recorded, RECORDED)).collect()}
    assert found == {(2, "name", "null_count"), (2, "signup", "semantic_type"), (2, "contact", "pattern"), (2, "contact", "unique_count"), (2, "name", "null_shift"), (2, "age", "mean_shift"), (2, "price", "mean_shift"), (2, "price", "range_shift"), (2, "age", "range_shift")}


def test_expressions_describe_the_values(spark):
    rows = [(1, f"{'AB' if i % 2 else 'XY'}-{i:04d}", i, "c", f"2024-01-{1 + i % 28:02d}", 1.0, f"a{i}@b.com" if i % 2 else f"a{i}.x@b.com", 0) for i in range(60)] + [(1, "odd one out!", 1, "c", "2024-01-01", 1.0, None, 0)]
    found = {(r.column_name, r.pattern): r.n_rows for r in column_profile.induced_patterns(table(spark, rows, CLEAN)).collect()}
    assert found["name", r"(?:AB|XY)\-[0-9]{4}"] == 60 and found["name", None] == 1
    assert found["signup", r"2024\-01\-[0-9]{2}"] == 61 and found["city", "c"] == 61
    assert found["contact", r"a[0-9]{1,2}(?:\.x)?@b\.com"] == 60
    assert found["age", "[0-9]{1,2}"] == 61


HARD = ["", " ", "\n", "a" * 20_000, "\x01\x02", "x.y*z[1](2){3}+4?^5$|6\\7&&8-9", "é\u0301Ω٣²", "\U0001f600", "00", "0", "-1", "1e5", "a\nb"]


def test_every_described_value_matches_its_expression(spark):
    rows = [(1, v, i, v + str(i % 3), None, None, None, 0) for i, v in enumerate(HARD * 4)] + [(1, None, None, None, None, None, None, 0)]
    values = column_profile.distinct_texts(table(spark, rows, CLEAN), "load_id", {"name": "string", "city": "string", "age": "bigint"})
    made = values.join(column_profile.induced(values), ["load", "column_name", "shape"], "left").collect()
    assert len(made) == len({(r.column_name, r.text) for r in made}) and {r.text for r in made if r.column_name == "name"} == {*HARD, None}
    wrong = values.join(column_profile.induced(values), ["load", "column_name", "shape"]).filter("expression is not null and not text rlike concat('^(?:', expression, ')\\\\z')")
    assert wrong.count() == 0


def test_types_by_expression_are_the_types_of_the_values(spark):
    texts = ["+12", "-3", "4.5", "1,000", "12345", "555-0123", "+1 (555) 010-9999", "1234567890123456", "a@b.c", "a@b", "2024-02-29", "2023-02-29", "2024-2-1", "x", "٣", "1.", ".5", "007", "20240101"]
    rows = [(1, t, i % 7, None, None, i / 2, None, 0) for i, t in enumerate(texts * 3)]
    values = column_profile.distinct_texts(table(spark, rows, CLEAN), "load_id", {"name": "string", "age": "bigint", "price": "double"})
    found = {r.column_name: r for r in column_profile.fits(values, column_profile.induced(values)).collect()}
    digits = lambda t: sum(c.isdigit() for c in t)
    want = {
        "integer": lambda t: re.fullmatch("[+-]?[0-9]+", t), "float": lambda t: re.fullmatch(r"[+-]?[0-9]+(\.[0-9]+)?", t), "email": lambda t: re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", t),
        "phone": lambda t: re.fullmatch(r"[-+(). 0-9]+", t) and 7 <= digits(t) <= 15, "date": lambda t: t == "2024-02-29",
    }
    for kind, fit in want.items():
        assert found["name"][f"fit_{kind}"] == 3 * sum(bool(fit(t)) for t in texts), kind
    assert found["age"].fit_integer == found["age"].fit_float == len(rows) and found["price"].fit_integer == sum(i % 2 == 0 for i in range(len(rows))) and found["price"].fit_email == 0


def test_expressions_answer_for_types(spark):
    cases = {
        "[0-9]{1,3}": "integer float phone?", r"\+[0-9]+": "integer float phone?", r"(?:\-)?[0-9]{2}": "integer float phone?", r"[0-9]+(?:\.[0-9]{2})?": "integer? float phone?", r"(?:12|15)\.5": "float phone?", "12": "integer float phone?", r"[0-9]{4}\-(?:01|12)\-[0-9]{2}": "date? phone?",
        r"\p{Ll}+[0-9]{1,2}@(?:mail|post)\.\p{Ll}{3}": "email", r"\p{Lu}\p{Ll}*(?:@\p{Ll}+\.com)?": "email?", r"[\p{L}\p{M}\p{N}]+@x": "", r"\[0\-9\]": "", "(?:Ann|Bob) 7": "", r"\p{Lu}{2}\([0-9]\)\?": "",
    }
    said = column_profile._fit_of_expressions(F.col("e"), F.lit(False))
    found = {r.e: " ".join(k + "?" * (r[k] is None) for k in ("integer", "float", "email", "date", "phone") if r[k] is not False) for r in spark.createDataFrame([(c,) for c in cases], "e string").select("e", *(x.alias(k) for k, x in said.items())).collect()}
    assert found == cases


def test_types_come_from_the_expressions(spark):
    rows = [(1, f"n{i}", i, None, None, None, None, 0) for i in range(20)]
    values = column_profile.distinct_texts(table(spark, rows, CLEAN), "load_id", {"name": "string"})
    made = column_profile.induced(values)
    assert column_profile.fits(values, made).collect()[0].fit_integer == 0
    assert column_profile.fits(values, made.withColumn("expression", F.lit("[0-9]+"))).collect()[0].fit_integer == 20


def test_profile_of_nothing(spark):
    empty = table(spark, [], CLEAN)
    loads = table(spark, [], "load_id long, feed_name string, load_seq int")
    assert column_profile.profile(empty, loads).count() == 0
    assert column_profile.findings(empty, loads, table(spark, [], RECORDED)).count() == 0


def test_coverage_by_the_load_before(spark):
    loads = table(spark, [(1, "f", 1), (2, "f", 2)], "load_id long, feed_name string, load_seq int")
    rows = [(1, "abcdefgh", 1, None, f"2024-01-{i + 1:02d}", None, None, 0) for i in range(20)] + [(2, "abcdefgh", 1, None, f"2024-01-{i + 1:02d}" if i < 5 else f"{i + 1:02d}/01/2024", None, None, 0) for i in range(20)]
    found = {(r.load, r.column_name): r.coverage for r in column_profile.profile(table(spark, rows, CLEAN), loads).collect()}
    assert found[2, "signup"] == pytest.approx(0.25) and found[2, "name"] == 1.0 and found[1, "signup"] is None
    rows = [(1, f"{'INV' if i % 2 else 'ORD'}-{i:04d}", i, None, None, None, f"a{i}@b.com", 0) for i in range(200)] + [(2, f"ZZZ-{i:04d}" if i < 50 else f"INV-{i:04d}", i, None, None, None, f"a{i}@b.com", 0) for i in range(200)]
    found = {(r.load, r.column_name): r.coverage for r in column_profile.profile(table(spark, rows, CLEAN), loads).collect()}
    assert found[2, "name"] == pytest.approx(0.75) and found[2, "contact"] == 1.0


# Records

FILES = "file_id long, feed_name string, file_seq int, delimiter string, head string"
LINES = "line_id long, file_id long, line_no int, raw_text string, reason string"


def lines_of(spark, files):
    rows, k = [], 0
    for file, texts in files.items():
        for no, text in enumerate(texts, 1):
            k += 1
            rows.append((k, file, no, text, "clash"))
    return table(spark, rows, LINES)


def test_failing_records(spark):
    body = {
        "Ann,01/02/2024,10,a@b.example": None, '"Lee, Ann",01/02/2024,"1,000",x': None, "Ann,,n/a,": None, "Ann,01/02/2024,₹1,x": None, "Ann,01/02/2024,(12.50),x": None, "Ann,01/02/2024,-5 USD,x": None,
        '"line\nbreak",01/02/2024,1,x': None, 'A "n" n,01/02/2024,1,x': "quoting", '"Ann,01/02/2024,1,x': "quoting", '"Ann" ,01/02/2024,1,x': "quoting", '"A ""n"" n",01/02/2024,1,x': None,
        "Ann,01/02/2024,1": "column_count", "": "column_count", "a,b,c,d,e": "column_count", "Ann,01/02/2024,1.2.3,x": "bad_amount", "Ann,01/02/2024,12ab,x": "bad_amount", "Ann,01/02/2024,$,x": "bad_amount",
        "Ann,31/02/2024,1,x": "bad_date", "Ann,12/14/2024,1,x": "bad_date", "Ann,14/12/2024,1,x": None, "Ann,15/12/2024,1,x": None, "Ann,week 12,1,x": "bad_date", "Ann,01/02/2024,9,y": None, "Ann,02/02/2024,9,y": None, "Ann,05/02/2024,9,y": None, "Ann,soon,x1,": "bad_amount",
    }
    files = table(spark, [(1, "f", 1, ",", "x"), (2, "f", 2, ";", "x")], FILES)
    lines = lines_of(spark, {1: ["Full Name,Joined,Order Value,Mail", *body], 2: ["a;b", "1;2", "1,2", None], 3: ["p,q", "1,2"]})
    found = {r.line_id: r.reason for r in raw_records.failing_lines(files, lines).collect()}
    want = {i + 2: reason for i, reason in enumerate(body.values()) if reason}
    n = len(body) + 1
    assert found == want | {n + 3: "column_count", n + 4: "column_count"}
    loaded = {r.line_id: (r.amount, r["values"]) for r in raw_records.valid_rows(files, lines).collect()}
    assert loaded[3] == (1000.0, {"Full Name": "Lee, Ann", "Joined": "01/02/2024", "Order Value": "1,000", "Mail": "x"})
    assert loaded[6][0] == -12.5 and loaded[7][0] == -5.0 and loaded[4][0] is None
    assert set(loaded) == {r.line_id for r in lines.filter("line_no > 1").collect()} - set(found)


def test_records_of_nothing(spark):
    files, lines = table(spark, [], FILES), table(spark, [], LINES)
    assert raw_records.failing_lines(files, lines).count() == 0
    assert schema_drift.schema_changes(files, lines).count() == 0
    assert schema_drift.unified_rows(files, lines).count() == 0


def test_headers_and_repeated_names(spark):
    files = table(spark, [(1, "f", 1, None, "x")], FILES)
    lines = lines_of(spark, {1: ["a,a,b", "1,2,3", "1,2,3"], 7: []})
    assert [r["values"] for r in raw_records.valid_rows(files, lines).collect()] == [{"a": "1", "b": "3"}] * 2


# Drift


def feed(spark, *files):
    rows = [(i, "f", i, ",", "x") for i in range(1, len(files) + 1)]
    return table(spark, rows, FILES), lines_of(spark, dict(enumerate(files, 1)))


def changes(spark, *files):
    return {tuple(r) for r in schema_drift.schema_changes(*feed(spark, *files)).collect()}


PEOPLE = [(f"Person {chr(97 + i)}", 100 + 7 * i, f"{i + 1:02d}/03/2024") for i in range(20)]


def test_changes_of_columns(spark):
    one = ["Name,Amount,Joined", *(f"{n},{a},{d}" for n, a, d in PEOPLE)]
    two = ["name_,Order Value,Joined,Notes", *(f"{n},{a}.40,{d},hi" for n, a, d in PEOPLE)]
    three = ["Order Value,Name,Visits", *(f"{a}.40,{n},{i}" for i, (n, a, d) in enumerate(PEOPLE))]
    assert changes(spark, one, two, three) == {
        (2, "new_column", "Notes"), (2, "renamed_column", "Order Value"), (2, "dtype_change", "Order Value"),
        (3, "missing_column", "Joined"), (3, "missing_column", "Notes"), (3, "new_column", "Visits"),
    }


def test_same_content_in_other_notations_is_no_new_column(spark):
    one = ["Name,When", *(f"{n},{d}" for n, _, d in PEOPLE)]
    two = ["Name,Since", *(f"{n},{d[6:]}-{d[3:5]}-{d[:2]}" for n, _, d in PEOPLE)]
    three = ["Name,Since", *(f"{n},{int(dt.datetime(2024, 3, i + 1, tzinfo=dt.UTC).timestamp())}" for i, (n, _, _) in enumerate(PEOPLE))]
    assert changes(spark, one, two, three) == {(2, "renamed_column", "Since"), (3, "dtype_change", "Since")}


def test_gaps_ties_and_broken_lines(spark):
    # No values, no types, no changes of types; a broken line has no say.
    assert changes(spark, ["a,b", "1,2"], ["a,b"], ['a,b', '"x,2', "z"]) == set()
    files = table(spark, [(1, "f", 1, ",", "x"), (3, "f", 3, ",", "x"), (4, None, 4, ",", "x")], FILES)
    assert schema_drift.schema_changes(files, lines_of(spark, {1: ["a"], 3: ["b"], 4: ["c"]})).count() == 0


def test_one_table_of_all_valid_rows(spark):
    one = ["Buyer,Amt,Signup Date,Extra", "Ann,5,01/02/2024,x", "Bob,bad one,01/02/2024,x"]
    two = ["Order Value,Customer Name", "5.25 USD,Cid"]
    rows = {r.customer_name: r for r in schema_drift.unified_rows(*feed(spark, one, two)).collect()}
    assert set(rows) == {"Ann", "Cid"}
    assert (rows["Ann"].amount.kind, rows["Ann"].amount.as_integer, rows["Ann"].amount_value, rows["Ann"].extra["Extra"].as_text) == ("integer", 5, 5.0, "x")
    assert (rows["Cid"].amount.kind, rows["Cid"].amount.as_text, rows["Cid"].amount_value) == ("text", "5.25 USD", 5.25)
    assert rows["Cid"].signup_date.kind is None and rows["Ann"].signup_date.kind == "date"


def test_alternatives_and_paths(spark):
    one = ["Name,Level", *(f"{n},{a}" for n, a, _ in PEOPLE)]
    two = ["Name,Level", *(f"{n},{a if i else 'many'}" for i, (n, a, _) in enumerate(PEOPLE))]
    three = ["Name,Grade", *(f"{n},{a}.00" for n, a, _ in PEOPLE)]
    files = feed(spark, one, two, three)
    assert {tuple(r) for r in schema_drift.appearing_alternatives(*files).collect()} == {(2, "Level", "text", 1, 20), (3, "Grade", "decimal", 20, 20)}
    found = {r.path: ({x.type: x.n for x in r.union}, r.n_files) for r in schema_drift.feed_schemas(*files).collect()}
    assert found == {"name": ({"text": 60}, 3), "level": ({"integer": 39, "decimal": 20, "text": 1}, 3)}
    assert schema_drift.appearing_alternatives(*feed(spark)).count() == schema_drift.feed_schemas(*feed(spark)).count() == 0


def test_value_types():
    cases = {"5": "integer", "-5": "integer", "5.0": "decimal", "yes": "boolean", "TRUE": "boolean", "31/01/2024": "date", "1 Feb 2024": "date", "31/02/2024": "text", "x": "text", " ": ""}
    assert {k: raw_records.value_type(k) for k in cases} == cases
    assert pd.Series([raw_records.is_amount(x) for x in ("₹1,20,000", "(5)", "5-", "Rs. 8/-", "N/A", "")]).all()
    assert not any(raw_records.is_amount(x) for x in ("1,2,3x", "--5", "5 6", "l9", "9e", "(5"))


YEARS = [(f"{y}-07-04 12:00:00", (y, 7, 4, 12)) for y in (1850, 1918, 1943, 1950, 1965, 1969, 1970, 2037, 2069, 2070, 2075, 2087, 2100, 2130, 2131, 2200, 2400, 9998)]


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/London", "Australia/Lord_Howe", "Africa/Casablanca", "Asia/Kolkata", "EST5EDT"])
def test_timestamps_of_any_year(spark, zone):
    moments = [*YEARS, *((f"{y}-01-15 12:00:00", (y, 1, 15, 12)) for y in (1950, 1965, 2075, 2150))]
    customers = table(spark, [(i, "B", text) for i, (text, _) in enumerate(moments)], "record_id long, branch_code string, signup_date string")
    branches = table(spark, [("B", zone, "ymd")], "branch_code string, zone_name string, date_order string")
    found = {r.record_id: r.utc_us for r in timestamps.signups_in_utc(customers, branches).collect()}
    assert found == {i: utc(*parts, zone=zone) for i, (_, parts) in enumerate(moments)}
