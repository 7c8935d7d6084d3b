"""Usual numbers and dates take the short way through the ledger's parse, with the same results."""

import random
import struct

from pyspark.sql import functions as F

from coffer.functions import parse
from coffer.functions.numtext import with_python_texts
from coffer.operators import ledger as LG


def test_python_texts_are_one_step(spark):
    d = spark.range(10).select(F.rand(1).alias("x"), F.rand(2).alias("y"))
    plan = with_python_texts(d, {"x": "a", "y": "b"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project [") == 2  # the numbers, and their texts


def test_python_texts_at_the_ends_of_java_fixed_layout(spark):
    values = [0.001, 0.0009999999999999998, 0.0010000000000000002, 9999999.0, 9999999.999999998, 1e7, 10000000.000000002, 0.0, -0.0]
    r = random.Random(3)
    values += [v for v in (struct.unpack("<d", r.randbytes(8))[0] for _ in range(500)) if v == v]
    values += [-v for v in values]
    d = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double")
    got = dict(with_python_texts(d, {"x": "t"}).select("k", "t").collect())
    assert [got[k] for k in range(len(values))] == [repr(v) for v in values]


def test_usual_numbers_are_read_unstripped(spark):
    usual = {"36.0": 36.0, "0.05": 0.05, "-12.5": -12.5, "+7": 7.0, ".5": 0.5, "1e5": 1e5, "-0.0": 0.0, "1e400": float("inf"), "0": 0.0}
    other = ["0x1p3", "0X1P3", "-0x1p3", "+0X1.8p1", "1.0d", "1_000", " 1", "1 ", "NaN", "Infinity", "+Infinity", "n/a", "", "1..2", "5x5", "--1", None]
    d = spark.createDataFrame([(t,) for t in [*usual, *other]], "t string")
    got = d.select("t", parse.decimal_value(F.col("t")).alias("v"), parse.parse_float(F.col("t")).alias("p")).collect()
    assert {r.t: r.v for r in got if r.v is not None} == usual
    assert {r.t: r.p for r in got if r.t in usual} == usual
    late = {r.t: r.p for r in got if r.t not in usual and r.p is not None}
    assert str(late.pop("NaN")) == "nan"
    assert late == {"1_000": 1000.0, " 1": 1.0, "1 ": 1.0, "Infinity": float("inf"), "+Infinity": float("inf")}


def test_usual_dates_are_read_unstripped(spark):
    texts = {
        "2024-01-31T10:15:00.000Z": "2024-01-31T10:15:00.000",
        "2024-01-31 10:15:00ZZ": "2024-01-31 10:15:00",
        "2024-01-31": "2024-01-31 00:00:00",
        "31/01/2024 10:15": "2024-01-31 10:15:00",
        "2024-01-31Z": None,
        " 2024-01-31": None,
        "2024-01-31\n": None,
        "2024-01-31TZ10:15:00": None,
    }
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert dict(d.select("t", parse.plain_datetime_text(F.col("t"))).collect()) == texts


def test_usual_and_padded_rows_hash_alike(spark):
    """Padding and letters that are removed anyway lead the long way to the same rows."""
    cols = ["Operation Date", "Currency Ticker", "Operation Type", "Operation Amount", "Operation Fees",
            "Countervalue Ticker", "Countervalue at Operation Date", "Operation Hash"]
    days = ["2024-01-31T10:15:00.250Z", "2024-01-31 10:15:00", "31/01/2024 10:15", "2024-01-31", "2024-02-30 10:00:00",
            "2024-01-31 25:00:00", "0000-01-01", "2024-W05-3", "20240131T101500-0330", "soon", "", None]
    amounts = ["36.0", "-0.5", "1e15", "0.00001", "nan", "1_0.5", "0x1p3", "", None]
    rows = [(d, "BTC", "OUT", a, "0.1", "EUR", "1234.5", "h1") for d in days for a in amounts]
    padded = [tuple(None if v is None else f" \t{v} " for v in r[:-1]) + r[-1:] for r in rows]
    for form in ("python", "exact"):
        a, b = (
            sorted(map(str, LG.normalize_ledger(spark.createDataFrame(x, ", ".join(f"`{c}` string" for c in cols)), "2026-01-01 00:00:00", form).collect()))
            for x in (rows, padded)
        )
        assert a == b
