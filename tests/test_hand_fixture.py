"""The hand-worked fixture: three transactions, three quotes, as_of 2024-01-05."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from coffer.operators import holdings as H
from coffer.operators import positions as P
from coffer.operators import prices as PX
from coffer.operators import valuation as V

AS_OF = "2024-01-05"


@pytest.fixture(scope="module")
def tx(spark):
    data = [
        ("2024-01-01 23:30:00", "BTC", "2", "100", "1"),
        ("2024-01-04 10:00:00", "btc", "-1", "150", "2"),
        ("2024-01-03 10:00:00", "eth", "5", "10", "0"),
    ]
    df = spark.createDataFrame(data, "d string, symbol string, qty string, price_eur string, fee_eur string")
    return df.select(
        F.col("d").cast("timestamp_ntz").alias("date_utc"),
        "symbol",
        *[F.col(c).cast("decimal(18,8)").alias(c) for c in ("qty", "price_eur", "fee_eur")],
    )


@pytest.fixture(scope="module")
def pr(spark):
    data = [("2024-01-01 10:00:00", "btc", "90"), ("2024-01-03 09:00:00", "btc", "110"),
            ("2024-01-03 20:00:00", "btc", "120")]
    df = spark.createDataFrame(data, "ts string, symbol string, price_eur string")
    return df.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "symbol",
                     F.col("price_eur").cast("decimal(18,8)").alias("price_eur"))


def d(s):
    return dt.date.fromisoformat(s)


def test_daily_valuation_long(tx, pr):
    out = V.daily_valuation_long(tx, pr, as_of=AS_OF)
    got = {(r.date.isoformat(), r.symbol): r for r in out.collect()}
    assert len(got) == 8  # 4 Paris days (the first trade is 01-02 in Paris) x 2 symbols
    exp = {
        ("2024-01-02", "btc"): (201, 2, 201, 120, 240, 39),
        ("2024-01-03", "btc"): (0, 2, 201, 120, 240, 39),
        ("2024-01-04", "btc"): (2, 1, 203, 120, 120, -83),
        ("2024-01-05", "btc"): (0, 1, 203, 120, 120, -83),
        ("2024-01-02", "eth"): (0, 0, 0, None, 0, 0),
        ("2024-01-03", "eth"): (50, 5, 50, None, 0, -50),
        ("2024-01-04", "eth"): (0, 5, 50, None, 0, -50),
        ("2024-01-05", "eth"): (0, 5, 50, None, 0, -50),
    }
    for k, (bought, qty_cum, bought_cum, price, value, gain) in exp.items():
        r = got[k]
        assert r.bought == D(bought) and r.qty_cum == D(qty_cum) and r.bought_cum == D(bought_cum), k
        assert (r.price_eur is None and price is None) or r.price_eur == D(price), k
        assert r.value == D(value) and r.gain == D(gain), k


def test_prices_before_spine_not_carried(tx, pr):
    # The 90 quote of 01-01 (before the first Paris trade day) must not win
    # the back-fill of 01-02: 120 (the first in-calendar close) does.
    out = V.daily_valuation_long(tx, pr, as_of=AS_OF).filter("symbol = 'btc' AND date = '2024-01-02'")
    assert out.first().price_eur == D(120)


def test_positions_null_before_first_trade(tx, pr):
    out = P.positions_asof(tx, pr, as_of=AS_OF)
    got = {(r.date.isoformat(), r.symbol): r.qty for r in out.collect()}
    assert [got[(f"2024-01-0{i}", "btc")] for i in (2, 3, 4, 5)] == [D(2), D(2), D(1), D(1)]
    assert [got[(f"2024-01-0{i}", "eth")] for i in (2, 3, 4, 5)] == [None, D(5), D(5), D(5)]


def test_holdings_report(tx, pr):
    rep = {r.symbol: r for r in H.holdings_report(tx, pr).collect()}
    btc, eth = rep["btc"], rep["eth"]
    assert (btc.qty, btc.investi, btc.price_eur, btc.valeur_actuelle, btc.pnl) == (
        D(1), D(353), D(120), D(120), D(-233))
    assert btc.pnl_pct == pytest.approx(-233 / 353 * 100)
    assert (eth.qty, eth.investi, eth.price_eur, eth.valeur_actuelle, eth.pnl, eth.pnl_pct) == (
        D(5), D(50), D(0), D(0), D(-50), -100.0)
    snap = {r.symbol: r for r in H.portfolio_snapshot(H.holdings_report(tx, pr), "2024-01-05 12:00:00.7").collect()}
    assert snap["btc"].pnl_pct == D("-66.0057")
    assert snap["btc"].ts == dt.datetime(2024, 1, 5, 12, 0, 0)


def test_missing_utc_price_days(spark, tx, pr):
    symbols, gaps = PX.price_gaps(tx, pr, as_of=AS_OF)
    got = sorted((r.symbol, r.date.isoformat()) for r in gaps.collect())
    exp = [("btc", "2024-01-02"), ("btc", "2024-01-04"), ("btc", "2024-01-05")] + [
        ("eth", f"2024-01-0{i}") for i in range(1, 6)]
    assert got == exp
    rep = {r.symbol: r for r in PX.gap_report(symbols, gaps).collect()}
    assert rep["btc"].n_missing == 3 and rep["btc"].from_day == d("2024-01-02")
    assert rep["btc"].to_day_excl == d("2024-01-06") and rep["eth"].n_missing == 5


def test_wide_sheet_and_views(tx, pr):
    from coffer.schemas import sheet_columns

    coins = ["btc", "eth"]
    long = V.daily_valuation_long(tx, pr, coins=coins, as_of=AS_OF)
    wide = V.daily_valuation_wide(long, coins)
    assert wide.columns == sheet_columns(coins)
    r = wide.filter("date = '2024-01-04'").first().asDict()
    assert r["btc acheté"] == D("2.00") and r["btc acheté cumul"] == D("203.00")
    assert r["btc valeur"] == r["btc valeur cumul"] == r["Valeur BTC"] == D("120.00")
    assert r["total acheté"] == D("253.00") and r["total valeur"] == D("120.00")
    assert r["total gain perte"] == D("-133.00")
    # wide totals equal the long sums on every day
    tot = {x.date: x for x in V.daily_totals(long).collect()}
    for w in wide.collect():
        assert w["total valeur"] == tot[w.date].total_value.quantize(D("0.01"))
    assert V.coin_view(wide, "eth").columns == ["date", "eth acheté", "eth valeur", "eth gain perte",
                                                 "eth acheté cumul", "eth valeur cumul", "acheté ETH", "Valeur ETH"]


def test_symbol_outside_coin_list_sets_start_but_not_totals(spark, tx, pr):
    extra = spark.createDataFrame([("2023-12-30 12:00:00", "doge", "1", "1", "0")],
                                  "d string, symbol string, qty string, price_eur string, fee_eur string").select(
        F.col("d").cast("timestamp_ntz").alias("date_utc"), "symbol",
        *[F.col(c).cast("decimal(18,8)").alias(c) for c in ("qty", "price_eur", "fee_eur")])
    long = V.daily_valuation_long(tx.unionByName(extra), pr, coins=["btc", "eth"], as_of=AS_OF)
    dates = sorted({r.date for r in long.collect()})
    assert dates[0] == d("2023-12-30") and set(r.symbol for r in long.collect()) == {"btc", "eth"}


def test_storage_names_and_main_view(tx, pr):
    from coffer.schemas import sheet_columns

    coins = ["btc", "eth"]
    wide = V.daily_valuation_wide(V.daily_valuation_long(tx, pr, coins=coins, as_of=AS_OF), coins)
    stored = V.to_storage(wide)
    assert "btc_achete_cumul" in stored.columns and "total_gain_perte" in stored.columns
    view = V.main_view(stored, sheet_columns(coins))
    assert view.columns == wide.columns
    assert sorted(view.collect()) == sorted(wide.collect())


def test_try_date(spark):
    from coffer.functions.parse import try_date

    df = spark.createDataFrame([("2024-01-05",), ("2024-01-05 10:00:00",), ("nope",), (None,)], "v string")
    got = [r.d for r in df.select(try_date(F.col("v")).alias("d")).collect()]
    assert got == [d("2024-01-05"), d("2024-01-05"), None, None]
