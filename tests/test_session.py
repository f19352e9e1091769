"""Helpers of the session."""

import pytest

from scrubline.session import cut, only


def test_columns_by_exact_name(spark):
    df = spark.createDataFrame([(1, 2, 3, "x")], "id int, Id int, other int, n string").toDF("id", "Id", "id", "Name")
    row = only(df, {"id": "bigint", "Id": "string", "name": "string"}).first()
    assert tuple(row) == (1, "2", "x")
    with pytest.raises(ValueError):
        only(df, {"ID": "int"})
    with pytest.raises(ValueError):
        only(df, {"nope": "int"})


def test_cut_keeps_rows(spark):
    assert cut(spark.range(10)).count() == 10
