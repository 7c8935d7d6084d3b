"""Ledger normalisation: header resolution, parsing, signs, prices, hashes."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from coffer.functions.names import get_first, resolve_like
from coffer.functions.parse import parse_float, parse_ledger_datetime, to_float
from coffer.operators import ledger as LG

AS_OF = "2030-01-01 00:00:00"


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("x")).first().x


def test_first_present_key():
    columns = ["ticker", "fees", "note"]
    assert get_first(columns, ["date", "note", "fees"]) == "note"
    assert get_first(columns, []) is None and get_first([], ["note"]) is None


def test_numbers_with_a_default(spark):
    assert one(spark, to_float, " -12.75 ") == -12.75
    assert one(spark, lambda c: to_float(c, 7.5), "12,75") == 7.5
    assert one(spark, lambda c: to_float(c, 7.5), None) == 7.5


@pytest.mark.parametrize(
    "text,expected",
    [("1_000", 1000.0), (" 2.5 ", 2.5), ("-.5", -0.5), ("1e3", 1000.0), ("1.0d", None), ("0x10", None),
     ("n/a", None), ("", None), ("1__0", None), ("_1", None)],
)
def test_float_syntax(spark, text, expected):
    assert one(spark, parse_float, text) == expected


def test_float_specials(spark):
    import math

    assert math.isnan(one(spark, parse_float, "NaN"))
    assert math.isnan(one(spark, parse_float, "-nan"))
    assert one(spark, parse_float, "inf") == float("inf")
    assert one(spark, parse_float, "-Infinity") == float("-inf")


@pytest.mark.parametrize(
    "text,expected",
    [
        ("2021-03-02T11:25:33.000Z", dt.datetime(2021, 3, 2, 11, 25, 33)),
        ("2021-03-02T11:25:33Z", dt.datetime(2021, 3, 2, 11, 25, 33)),
        ("2021-03-02 11:25:33", dt.datetime(2021, 3, 2, 11, 25, 33)),
        ("02/03/2021 11:25", dt.datetime(2021, 3, 2, 11, 25)),
        ("2/3/2021 1:05:07", dt.datetime(2021, 3, 2, 1, 5, 7)),
        ("2021-03-02", dt.datetime(2021, 3, 2)),
        ("2021-3-2T1:2:3", dt.datetime(2021, 3, 2, 1, 2, 3)),
        ("2021-03-02T11:25:33+02:00", dt.datetime(2021, 3, 2, 9, 25, 33)),
        ("2021-03-02T11:25:33.5-0130", dt.datetime(2021, 3, 2, 12, 55, 33, 500000)),
        ("20210302", dt.datetime(2021, 3, 2)),
        ("  2021-03-02 11:25:33 ", dt.datetime(2021, 3, 2, 11, 25, 33)),
        ("2021-02-30 10:00:00", None),
        ("2021-03-02 10:00:60", None),
        ("10:00", None),
        ("2025-09", None),
        ("", None),
        ("garbage", None),
    ],
)
def test_parse_dt(spark, text, expected):
    assert one(spark, parse_ledger_datetime, text) == expected


def test_parse_dt_independent_of_session_zone(spark):
    prev = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, parse_ledger_datetime, "2021-03-14 02:30:00") == dt.datetime(2021, 3, 14, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)


def test_resolve_like_passes():
    cols = ["operation date", "currency ticker", "operation amount", "countervalue"]
    assert resolve_like(cols, ["date", "operation date"]) == "operation date"  # substring pass
    assert resolve_like(["date", "countervalue"], ["countervalue at operation date"]) == "date"  # loose trap
    assert resolve_like(["type", "operation hash x"], ["operation hash", "type"]) == "type"  # exact first
    assert resolve_like([""], ["anything"]) == ""  # empty header matches everything
    assert resolve_like(["zzz"], ["a"], [r"^z+$"]) == "zzz"  # regex pass
    assert resolve_like(["zzz"], ["a"]) is None


def _norm(spark, rows, header):
    df = spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in header))
    return {r.note: r for r in LG.normalize_ledger(df, AS_OF).collect()}


def test_normalize_rows(spark):
    header = ['"Operation Date"', "Currency  Ticker", "Operation Type", "Operation Amount",
              "Operation Fees", "Operation Hash", "Countervalue Ticker", "Countervalue at Operation Date"]
    rows = [
        ("2021-03-02T11:25:33.000Z", " BTC ", "OUT", "0.5", "0.001", "h1", "EUR", "-25000"),
        ("02/03/2021 11:25", "eth", "in", "-2", "0", "h2", "usd", "100"),
        ("", "sol", "FEES", "n/a", "1", "h3", "EUR", "10"),
        ("bad date", "ada", "sell", "3", "", "", "EUR", "0"),
    ]
    got = _norm(spark, rows, header)
    r1 = got["h1"]
    assert (r1.symbol, r1.qty, r1.price_eur, r1.fee_eur, r1.exchange) == ("btc", -0.5, 50000.0, 50.0, "ledger")
    assert r1.date_utc == dt.datetime(2021, 3, 2, 11, 25, 33) and not r1.date_defaulted
    r2 = got["h2"]
    assert (r2.qty, r2.price_eur, r2.fee_eur) == (2.0, 0.0, 0.0)  # non-EUR countervalue: no price
    r3 = got["h3"]
    assert r3.qty == 0.0 and str(r3.qty) == "0.0" and r3.price_eur == 0.0 and r3.date_defaulted
    assert r3.date_utc == dt.datetime(2030, 1, 1)
    r4 = got[""]
    assert (r4.symbol, r4.qty, r4.note, r4.date_defaulted) == ("ada", -3.0, "", True)
    assert all(len(r.dedup_hash) == 40 for r in got.values())


def test_note_prefers_exact_type_over_loose_hash(spark):
    # "type" is an exact note alias; "tx hash id" only matches by substring.
    got = LG.resolve_fields(["date", "type", "tx hash id"])
    assert got["note"] == "type" and got["op_type"] == "type"


def test_hash_is_stable_and_content_based(spark):
    header = ["date", "currency", "amount", "type", "note"]
    rows = [("2021-01-01 00:00:00", "btc", "1", "buy", "x"), ("2021-01-01 00:00:00", "btc", "1", "buy", "x"),
            ("2021-01-01 00:00:00", "btc", "1", "buy", "y")]
    df = spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in header))
    h = [r.dedup_hash for r in LG.normalize_ledger(df, AS_OF).collect()]
    assert h[0] == h[1] != h[2]
    h2 = [r.dedup_hash for r in LG.normalize_ledger(df, "1999-01-01").collect()]
    assert h == h2  # the clock only matters for unparseable dates


def test_iso_text_microseconds(spark):
    ts = spark.createDataFrame([("2021-01-01 00:00:01.5",), ("2021-01-01 00:00:01",)], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("t"))
    got = [r.x for r in ts.select(LG.iso_utc(F.col("t")).alias("x")).collect()]
    assert got == ["2021-01-01T00:00:01.500000+00:00", "2021-01-01T00:00:01+00:00"]


def test_last_write_wins(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b"), ("j", 1, "z")], "key string, _seq long, v string")
    got = {r.key: (r.v, r.n_rows) for r in LG.last_write_wins(df, ["key"]).collect()}
    assert got == {"k": ("c", 3), "j": ("z", 1)}


def test_infer_column_types(spark):
    df = spark.createDataFrame([("2021-01-01", "1.5", None, "x"), ("2021-01-02", " 2 ", None, "3")],
                               "Date string, num string, empty string, txt string")
    got = {r.column_name: r.inferred_type for r in LG.infer_column_types(df).collect()}
    assert got == {"Date": "DATE", "num": "DECIMAL(20,2)", "empty": "DECIMAL(20,2)", "txt": "NVARCHAR(255)"}


def test_csv_reader(spark, tmp_path):
    from coffer.sources.readers import read_ledger_csv

    p = tmp_path / "export.csv"
    p.write_text('Operation Date,Currency Ticker,Operation Amount,Operation Type,Operation Hash\n'
                 '2021-03-02 10:00:00,BTC,"1,5",IN,"multi\nline"\n2021-03-03 10:00:00,ETH,2,OUT,h2\n',
                 encoding="utf-8")
    raw = read_ledger_csv(spark, str(p))
    assert all(isinstance(f.dataType.simpleString(), str) for f in raw.schema.fields)
    out = {r.symbol: r for r in LG.normalize_ledger(raw, AS_OF).collect()}
    assert out["btc"].qty == 0.0 and out["btc"].note == "multi\nline"  # "1,5" is not a float
    assert out["eth"].qty == -2.0


def test_readers_stored_tables(spark, tmp_path):
    from coffer.sources.readers import read_prices, read_transactions

    prev = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        df = spark.createDataFrame([("2024-01-01 00:30:00", "BTC", 1.0, 2.0, 0.0)],
                                   "d string, symbol string, qty double, price_eur double, fee_eur double")
        # a session-zoned TIMESTAMP column written by a Paris session: 23:30 UTC the day before
        df.select(F.col("d").cast("timestamp").alias("date_utc"), "symbol", "qty", "price_eur", "fee_eur") \
            .write.parquet(str(tmp_path / "tx"))
        got = read_transactions(spark, str(tmp_path / "tx")).first()
        assert (got.symbol, got.date_utc) == ("btc", dt.datetime(2023, 12, 31, 23, 30))
        spark.createDataFrame([("2024-01-01 10:00:00", "ETH", 5.0)], "ts string, symbol string, price_eur double") \
            .select(F.col("ts").cast("timestamp_ntz").alias("ts"), "symbol", "price_eur").write.parquet(str(tmp_path / "px"))
        p = read_prices(spark, str(tmp_path / "px")).first()
        assert (p.symbol, p.ts) == ("eth", dt.datetime(2024, 1, 1, 10, 0))
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)


def test_hash_equals_that_of_the_original_importer(spark):
    """Hashes over Python's own float texts, as stored tables hold them."""
    header = ["date", "currency", "operation type", "amount", "fees", "hash", "countervalue ticker", "countervalue"]
    rows = [
        ("2021-03-02T11:25:33.000Z", "BTC", "out", "0.00001", "0.0005", "h1", "EUR", "0.3"),
        ("2021-03-02T11:25:33.250Z", "eth", "in", "1e16", "2", "h2", "EUR", "3"),
        ("2021-03-02 11:25:33", "sol", "out", "0", "1", "h3", "EUR", "10"),
        ("2021-03-02 11:25:33", "ada", "fees", "3", "0.1", "", "usd", "10"),
        ("2021-03-02T11:25:33+02:00", "dot", "in", "7", "0.1", "h5", "EUR", "1"),
    ]
    want = []
    for _, sym, op, amount, fees, note, ticker, cv in rows:
        qty = float(amount)
        qty = -abs(qty) if op == "out" else abs(qty) if op == "in" else qty
        price = abs(float(cv)) / abs(qty) if ticker == "EUR" and qty else 0.0
        fee = float(fees) * price if price else 0.0
        iso = {"btc": "11:25:33", "eth": "11:25:33.250000", "dot": "09:25:33"}.get(sym.lower(), "11:25:33")
        want.append(hashlib.sha1(f"2021-03-02T{iso}+00:00|{sym.lower()}|{qty}|{price}|{fee}|{note}".encode()).hexdigest())
    df = spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in header))
    got = {r.symbol: r.dedup_hash for r in LG.normalize_ledger(df, AS_OF).collect()}
    assert [got[r[1].lower()] for r in rows] == want
    exact = {r.symbol: r.dedup_hash for r in LG.normalize_ledger(df, AS_OF, "exact").collect()}
    assert not set(exact.values()) & set(want)
    with pytest.raises(ValueError, match="hash_form"):
        LG.normalize_ledger(df, AS_OF, "hex")


DATE_TEXTS = [
    "2024-01-31", "2024-01-31 10:15:00", "2024-01-31T10:15:59.250", "2024-01-31T10:15:59.2500001", "2024-02-30 10:00:00",
    "0000-01-01", "0000-01-01 00:00:00", "2024-01-31 24:00:00", "2024-01-31 23:59:60", "2024-01-31 23:60:00", "31/12/2023 23:59",
    "31/12/2023 23:59:58", "30/02/2023 10:00", "01/01/0000 10:00", "31/12/2023 24:00", "31/12/2023  23:59", "2024-01-31 10:15:00",
    "2024-01-31 10:15:5\x01", "2024-01-31 10:15:00\n", "2024-01-31T10:15:00Z", "2024-01-31T10:15:00.5+02:00", "20240131T101500",
    "2024-1-3 1:2:3", "2024-W05-3", "-024-01-31 10:15:00", "٢٠٢٤-01-31", "2024-01-31 10:15", "soon", "",
]


def test_cast_dates_equal_the_ladder(spark):
    from coffer.functions.parse import ledger_date_text, plain_datetime_text

    d = spark.createDataFrame([(i, t) for i, t in enumerate(DATE_TEXTS)], "i long, t string")
    plain = plain_datetime_text(ledger_date_text(F.col("t")))
    rows = d.select("t", plain.isNotNull().alias("plain"), plain.try_cast("timestamp_ntz").alias("cast"), parse_ledger_datetime(F.col("t")).alias("ladder"))
    rows = rows.collect()
    assert [r for r in rows if r.plain and r["cast"] != r.ladder] == []
    assert {r.t for r in rows if r.plain} >= {"2024-01-31", "2024-01-31 10:15:00", "31/12/2023 23:59", "2024-01-31T10:15:00Z"}
    raw = d.select(F.col("i").alias("_seq"), F.col("t").alias("Operation Date"))
    got = LG.normalize_ledger(raw, "2001-02-03 04:05:06").select("_seq", "date_utc", "date_defaulted").collect()
    as_of = dt.datetime(2001, 2, 3, 4, 5, 6)
    want = {i: r.ladder.replace(microsecond=0) if r.ladder else as_of for i, r in enumerate(rows)}
    assert {r["_seq"]: r.date_utc for r in got} == want
    assert {r["_seq"] for r in got if r.date_defaulted} == {i for i, r in enumerate(rows) if r.ladder is None}


def test_generated_methods_stay_compilable(spark):
    """Spark's default limit would let the projections run in the JVM's interpreter; a session's own setting stays."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    for before, after in (("65535", "8000"), ("20000", "20000")):
        s = spark.newSession()
        s.conf.set(limit, before)
        LG.normalize_ledger(s.createDataFrame([("2024-01-31",)], "`Operation Date` string"), "2001-02-03 04:05:06")
        assert s.conf.get(limit) == after


def test_unused_columns_are_not_computed(spark):
    """Dates alone need neither the hash nor the numbers; a filter on them is not pushed into the parsing."""
    raw = spark.createDataFrame([("2024-01-31", "1", "b")], "`Operation Date` string, `Operation Amount` string, `Operation Hash` string")
    dates = LG.normalize_ledger(raw, AS_OF, "exact").select("date_utc").filter("date_utc > timestamp_ntz '2024-01-01'")
    plan = dates._jdf.queryExecution().optimizedPlan().toString()
    assert "sha" not in plan and "as double" not in plan.lower()
    assert [r.date_utc for r in dates.collect()] == [dt.datetime(2024, 1, 31)]


def test_number_texts_at_the_edge_of_the_cast(spark):
    texts = ["1.", ".5", "+1e5", "-0", "1d", "1f", "0x1p3", "0X1P3", "1_0", "1e", ".", "\x011", "1\x01", " 1 ", "\t-2.5\n", "1 2", "", None, "NaN", "-Infinity"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {texts[r.i]: r.x for r in d.select("i", parse_float(F.col("t")).alias("x")).collect()}
    want = {"1.": 1.0, ".5": 0.5, "+1e5": 1e5, "-0": 0.0, "1_0": 10.0, " 1 ": 1.0, "\t-2.5\n": -2.5, "-Infinity": float("-inf")}
    assert {t: x for t, x in got.items() if x is not None and x == x} == want
    assert [t for t, x in got.items() if x is not None and x != x] == ["NaN"]


def test_doubles_inside_a_decimal_need_no_cast(spark):
    from pyspark.sql import types as T

    from coffer.operators.quality import domain_rules

    xs = [0.0, 5e-324, -1e-300, 4.9e9, -4.9e9, 9999999999.0, 9999999999.999999, 1e10, -1e10, float("nan"), float("inf"), None]
    d = spark.createDataFrame([(x, None if x is None else str(x)) for x in xs], "x double, t string")
    rules = domain_rules(decimals={"x": T.DecimalType(18, 8), "t": T.DecimalType(18, 8)})
    rows = d.select("x", rules[0][1].alias("bad"), rules[1][1].alias("text_bad"), F.col("x").try_cast("decimal(18,8)").isNull().alias("none")).collect()
    assert [r.bad for r in rows] == [r.none and r.x is not None for r in rows]
    assert [r.text_bad for r in rows if r.x is not None and abs(r.x) > 1e-9] == [r.bad for r in rows if r.x is not None and abs(r.x) > 1e-9]
