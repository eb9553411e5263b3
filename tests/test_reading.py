"""The checked reader: every cell is read or rejected with a reason."""

import pytest
from pyspark.sql import types as T

from loanlens.sources import tables

SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("small", T.ByteType()), T.StructField("x", T.DoubleType()), T.StructField("name", T.StringType())])
LINES = [
    "id,small,x,name",
    "1,2,0.5,plain",
    "2.0,NA,nan,'odd'",
    "3,4.5,zero,\"quoted, with a comma\"",
    "4,300,1e3,",
    "five,6,7,x",
    "6,7",
    "7,8,9,end,more,\"and, more\"",
    "99999999999,1,1,y",
]


@pytest.fixture
def path(tmp_path):
    file = tmp_path / "cells.csv"
    file.write_text("\n".join(LINES) + "\n")
    return str(file)


def test_rejects_and_rows(spark, path):
    read = tables.read_csv_checked(spark, path, SCHEMA, most_rejected=0.5, row_name="n")
    rows = {r.n: tuple(r)[:4] for r in read.rows.collect()}
    assert [rows[k] for k in sorted(rows)] == [
        (1, 2, 0.5, "plain"), (2, None, None, "'odd'"), (3, None, None, "quoted, with a comma"), (4, None, 1000.0, None),
        (None, 6, 7.0, "x"), (6, 7, None, None), (7, 8, 9.0, "end"), (None, 1, 1.0, "y")]
    got = sorted((r["row"], r["column"], r["text"], r["reason"]) for r in read.rejects.collect())
    place = sorted(rows)
    assert got == sorted([
        (place[2], "small", "4.5", "a fraction in an integer column"), (place[2], "x", "zero", "not a number"),
        (place[3], "small", "300", "out of range"), (place[4], "id", "five", "not a number"),
        (place[5], "name", None, "missing from a short record"), (place[5], "x", None, "missing from a short record"),
        (place[6], "#5", "more", "beyond the last column"), (place[6], "#6", '"and, more"', "beyond the last column"),
        (place[7], "id", "99999999999", "out of range")], key=lambda r: (r[0], r[1]))
    assert read.cells_given == 8 * 4 + 2 and read.cells_rejected == len(got)


def test_too_many_rejects_fail_the_read(spark, path):
    with pytest.raises(ValueError, match=r"9 of 34 cells .*id: 1 x not a number"):
        tables.read_csv_checked(spark, path, SCHEMA)


def test_same_rows_as_the_plain_reader(spark, tmp_path):
    file = tmp_path / "clean.csv"
    file.write_text(",id,x,other\n0,1,2.5,a\n1,NA,,b\n2,3.0,-1,c\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("absent", T.StringType()), T.StructField("k", T.LongType())])
    plain = tables.read_csv(spark, str(file), schema, index_column=True, index_name="k")
    checked = tables.read_csv_checked(spark, str(file), schema, 0.0, index_column=True, index_name="k")
    assert checked.rows.columns == plain.columns
    assert sorted(map(tuple, checked.rows.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert checked.rejects.collect() == [] and checked.cells_given == 9


def test_an_empty_file(spark, tmp_path):
    file = tmp_path / "empty.csv"
    file.write_text("id,x\n")
    read = tables.read_csv_checked(spark, str(file), T.StructType([T.StructField("id", T.IntegerType())]))
    assert read.rows.collect() == [] and (read.cells_given, read.cells_rejected) == (0, 0)
