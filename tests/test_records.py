"""One CSV file read by many tasks gives the rows of one reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from coffer.sources.readers import read_ledger_csv
from coffer.sources.records import _ends_inside, csv_records


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(path, rows, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerows(rows)
    path.write_bytes(out.getvalue().encode())


def table(seed, n=90):
    r = random.Random(seed)
    notes = ["", "plain", 'say "hi"', "two\nlines", 'a "q",\n\n"b"\n,', "x,y", '"', "é\n日本", "\n", 'five""" and\n"more', "z" * 700 + "\n" + "y" * 900]
    return [["date", "amount", "note", "type"]] + [[f"d{k}", str(k), r.choice(notes), r.choice(["in", "out", 'q"'])] for k in range(n)]


@pytest.mark.parametrize(("seed", "end"), [(1, "\n"), (2, "\r\n")])
def test_rows_equal_those_of_a_csv_reader(spark, tmp_path, small_splits, seed, end):
    rows = table(seed)
    write(tmp_path / "a ledger.csv", rows, end)
    d = read_ledger_csv(spark, str(tmp_path / "a ledger.csv"))
    got = [(r["date"], r["amount"], r["note"] or "", r["type"]) for r in d.orderBy("_seq").collect()]
    assert got == [tuple(r) for r in rows[1:]]
    blocks = csv_records(spark, [str(tmp_path / "a ledger.csv")]).select("block").distinct().count()
    assert blocks > 4  # splits of one file


def test_stray_and_unclosed_quotes(spark, tmp_path, small_splits):
    text = 'date,note\n1,5" pipe\n2,"a\nb"\n\n3,bare "q" here\n4,"open\n5,end\n'
    (tmp_path / "x.csv").write_text(text)
    d = read_ledger_csv(spark, str(tmp_path / "x.csv")).orderBy("_seq").collect()
    assert [(r["date"], r["note"]) for r in d][:3] == [("1", '5" pipe'), ("2", "a\nb"), ("3", 'bare "q" here')]
    assert [r["date"] for r in d][3:] == ["4", "5"]


def test_only_first_bytes_for_headers(spark, tmp_path):
    write(tmp_path / "a.csv", [["x", "y"], ["1", "2"]])
    write(tmp_path / "b.csv", [["Y", "z"], ["3", "4"]])
    (tmp_path / "empty.csv").write_text("")
    got = sorted((r["x"] or "", r["y"] or "", r["z"] or "") for r in read_ledger_csv(spark, str(tmp_path)).collect())
    assert got == [("", "3", "4"), ("1", "2", "")]


def test_line_states(spark):
    lines = ["", "a,b", '"a"', '"a', 'a"b', 'a","b', '"a""b"', '"a""', 'x,"y,z', '","']
    d = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, v string")
    got = d.select("k", _ends_inside(F.col("v"), 0).alias("f0"), _ends_inside(F.col("v"), 2).alias("f1")).orderBy("k").collect()
    want = [(False, True), (False, True), (False, False), (True, False), (False, False), (True, True), (False, False), (True, True), (True, False), (False, False)]
    for line, g, (f0, f1) in zip(lines, got, want, strict=True):
        assert g["f0"] == f0, line
    assert [g["f1"] for g in got][:2] == [True, True] and not got[3]["f1"]
