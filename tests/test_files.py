"""Files in and out, detection of their form, streaming replay, the command line."""

import pytest

from scrubline import api
from scrubline.cli import main
from scrubline.errors import DriftError, ReadError, ScrublineError
from scrubline.plans.recipe import Recipe, WorkbookRecipe, load_any
from scrubline.sources import assembly
from scrubline.sources.files import csv_options, read_table, sniff_delimiter, write_table
from scrubline.streaming.replay import check_streamable, replay_file


def test_csv_types_and_selection(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id,name,amt,ok\n" + "".join(f"{i},n{i},{i * 1.5},true\n" for i in range(10)))
    df = read_table(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "amt": "double", "ok": "boolean"}
    assert read_table(spark, path, nrows=3).count() == 3
    assert read_table(spark, path, skiprows=[1, 2]).count() == 8
    assert read_table(spark, path, columns=["amt", "id"]).columns == ["id", "amt"]
    with pytest.raises(ReadError):
        read_table(spark, path, columns=["nope"])


def test_missing_values_quotes_and_bad_lines(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text('a,b\n1,"x, ""y"""\nNA,\n3\n')
    assert [tuple(r) for r in read_table(spark, path).collect()] == [(1.0, 'x, "y"'), (None, None), (3.0, None)]
    path.write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(ReadError):
        read_table(spark, path)
    (tmp_path / "e.csv").write_text("")
    for bad in (tmp_path / "e.csv", tmp_path / "none.csv"):
        with pytest.raises(ReadError):
            read_table(spark, bad)


def test_encoding_delimiter_and_leading_lines(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_bytes("\n\nname;age\nJosé €;3\nAnn;4\n".encode("cp1252"))
    assert csv_options(path) == {"encoding": "cp1252", "sep": ";", "skiprows": 2}
    assert [tuple(r) for r in read_table(spark, path).collect()] == [("José €", 3), ("Ann", 4)]
    with pytest.raises(ReadError):
        sniff_delimiter(["a;b|c", "d;e|f"])


@pytest.mark.parametrize("suffix", ["csv", "tsv", "xlsx", "parquet", "json"])
def test_round_trips(spark, tmp_path, suffix):
    df = spark.createDataFrame([("a, \"b\"", 1, 1.5), ("=x", 2, 2.5)], "s string, i long, d double")
    path = tmp_path / f"t.{suffix}"
    write_table(df, path)
    back = {tuple(r) for r in read_table(spark, path).select("s", "i", "d").collect()}
    safe = suffix in ("csv", "tsv", "xlsx")
    assert back == {('a, "b"', 1, 1.5), ("'=x" if safe else "=x", 2, 2.5)}


def test_workbooks(spark, tmp_path):
    book = {"Customers": spark.createDataFrame([(" a ", 1)], "Name string, Amount long"), "Meta": spark.createDataFrame([("x",)], "note string")}
    done = api.apply_workbook(spark, book, {"Customers": {"columns": {"Name": {"ops": ["strip_whitespace"]}}}})
    api.save_workbook(done, tmp_path / "o.xlsx")
    assert read_table(spark, tmp_path / "o.xlsx").collect()[0].Name == "a"
    with pytest.raises(ScrublineError):
        api.save_workbook(done, tmp_path / "o.xlsx", tmp_path / "o.xlsx")


def test_streaming_equals_the_whole_table(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.csv").write_text("id,name\n" + "".join(f"{k * 10 + i}, n{i} \n" for i in range(10)))
    recipe = Recipe.from_dict({"columns": {"name": {"ops": ["strip_whitespace", "uppercase"]}}, "validate": [{"column": "id", "check": ">= 5"}]})
    summary = replay_file(spark, recipe, str(folder), str(tmp_path / "out"))
    assert (summary.rows_in, summary.rows_out, summary.quarantined, summary.batches) == (30, 25, 5, 3)
    assert {r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {f"N{i}" for i in range(10)}
    for op in ({"columns": {"a": {"ops": [{"fill_na": "mean"}]}}}, {"dedup": {"subset": ["a"]}}, {"validate": [{"column": "a", "check": "unique"}]}):
        with pytest.raises(ScrublineError):
            check_streamable(Recipe.from_dict(op))


def test_command_line_lists_and_fails_cleanly(capsys):
    assert main(["ops"]) == 0 and "parse_number" in capsys.readouterr().out
    assert main(["detectors"]) == 0


def test_line_breaks_inside_quotes_anywhere(spark, tmp_path):
    path = tmp_path / "q.csv"
    rows = [(f"{i}", f'x"{i}' if i % 7 == 0 else f"x{i}") for i in range(3000)]
    rows[2500] = ("2500", "one\ntwo, \"three\"\n\nfour")
    text = "id,note\n" + "".join(f'{a},"{b.replace(chr(34), chr(34) * 2)}"\n' for a, b in rows)
    path.write_text(text)
    assert [(str(r.id), r.note) for r in read_table(spark, path, numbered=True).orderBy("_rid").collect()] == rows
    assert read_table(spark, path).columns == ["id", "note"]
    assert read_table(spark, path, nrows=2502).count() == 2502
    # In the second file of a folder, and across the ends of blocks.
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("id,note\n1,plain\n")
    (folder / "b.csv").write_text(text)
    (folder / "c.csv").write_text('id,note\n7,5" pipe\n8,"' + "long\n" * 2000 + '"\n9,"open\n')
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found = [(str(r.id), r.note) for r in read_table(spark, folder, numbered=True).orderBy("_rid").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert found == [("1", "plain"), *rows, ("7", '5" pipe'), ("8", "long\n" * 2000), ("9", "open\n")] or found[:-1] == [("1", "plain"), *rows, ("7", '5" pipe'), ("8", "long\n" * 2000)]


def test_raw_lines_of_files(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('a,b\r\n1,"x\r\ny"\r\n2,z\r\n')
    assert [(r.line_no, r.raw_text) for r in assembly.raw_lines(spark, str(path)).orderBy("line_no").collect()] == [(1, "a,b"), (2, '1,"x\r\ny"'), (3, "2,z")]


def test_streaming_to_one_file_with_the_held_rows_beside(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id;note\n1; "x" \n2;"a\n=b"\n7;=c\n')
    recipe = Recipe.from_dict({"read": {"sep": ";"}, "columns": {"note": {"ops": ["strip_whitespace"]}}, "validate": [{"column": "id", "check": "< 5"}]})
    summary = replay_file(spark, recipe, str(path), str(tmp_path / "out.csv"))
    assert (summary.rows_out, summary.quarantined) == (2, 1)
    assert (tmp_path / "out.csv").read_text().startswith("id,note\n1,") and "7,'=c" in (tmp_path / "out.quarantine.csv").read_text()
    recipe.fingerprint = {"columns": 2, "column_names": ["id", "other"], "dtypes": {"id": "int64", "other": "object"}, "row_count": 3}
    with pytest.raises(DriftError):
        replay_file(spark, recipe, str(path), str(tmp_path / "out.csv"))
    recipe.validations = []
    replay_file(spark, recipe, str(path), str(tmp_path / "all.csv"), on_drift="ignore")
    assert not (tmp_path / "all.quarantine.csv").exists()


def test_one_recipe_file_for_a_workbook(spark, tmp_path):
    book = {"One": spark.createDataFrame([(" a ",)], "Name string"), "Two": spark.createDataFrame([("b",)], "x string")}
    WorkbookRecipe({"One": Recipe.from_dict({"columns": {"Name": ["strip_whitespace"]}})}).save(tmp_path / "w.yaml")
    done = api.apply_workbook(spark, book, tmp_path / "w.yaml")
    assert set(done) == {"One"} and done["One"].data.collect()[0].Name == "a"
    assert api.workbook_recipe(done).to_dict() == load_any(tmp_path / "w.yaml").to_dict()
