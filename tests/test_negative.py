"""Negative inputs: empty transactions, no quotes at all, unparseable
numbers and dates, unmapped symbols (SURVEY §5.4)."""

from pyspark.sql import functions as F

from coffer.operators import holdings as H
from coffer.operators import positions as P
from coffer.operators import prices as PX
from coffer.operators import valuation as V

TX_SCHEMA = "date_utc timestamp_ntz, symbol string, qty decimal(18,8), price_eur decimal(18,8), fee_eur decimal(18,8)"
PX_SCHEMA = "ts timestamp_ntz, symbol string, price_eur decimal(18,8)"


def test_empty_transactions_give_empty_results(spark):
    tx = spark.createDataFrame([], TX_SCHEMA)
    pr = spark.createDataFrame([], PX_SCHEMA)
    assert V.daily_valuation_long(tx, pr).count() == 0
    assert V.daily_valuation_long(tx, pr, coins=["btc"], as_of="2024-01-05").count() == 0
    assert P.positions_asof(tx, pr).count() == 0
    assert H.holdings_report(tx, pr).count() == 0
    assert PX.price_gaps(tx, pr)[1].count() == 0


def test_no_quotes_at_all(spark):
    tx = spark.createDataFrame([("2024-01-01 10:00:00", "btc", "2", "10", "1")],
                               "d string, symbol string, qty string, price_eur string, fee_eur string").select(
        F.col("d").cast("timestamp_ntz").alias("date_utc"), "symbol",
        *[F.col(c).cast("decimal(18,8)").alias(c) for c in ("qty", "price_eur", "fee_eur")])
    pr = spark.createDataFrame([], PX_SCHEMA)
    rows = V.daily_valuation_long(tx, pr, as_of="2024-01-03").orderBy("date").collect()
    assert [r.price_eur for r in rows] == [None, None, None]
    assert all(float(r.value) == 0 and float(r.gain) == -21.0 for r in rows)
    rep = H.holdings_report(tx, pr).first()
    assert float(rep.price_eur) == 0 and float(rep.pnl) == -21.0 and rep.pnl_pct == -100.0


def test_string_numbers_are_scrubbed(spark):
    tx = spark.createDataFrame([("2024-01-01 10:00:00", "ETH", " 2 ", "n/a", None)],
                               "d string, symbol string, qty string, price_eur string, fee_eur string").select(
        F.col("d").cast("timestamp_ntz").alias("date_utc"), "symbol", "qty", "price_eur", "fee_eur")
    pr = spark.createDataFrame([], PX_SCHEMA)
    rep = H.holdings_report(tx, pr).first()
    assert rep.symbol == "eth" and float(rep.qty) == 2.0 and float(rep.investi) == 0.0
