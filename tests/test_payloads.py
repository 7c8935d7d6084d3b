"""Mapping string, market-chart and current-price payloads."""

import datetime as dt

from coffer.sources import payloads as PL


def test_parse_mapping(spark):
    m = PL.parse_mapping(spark, "btc:bitcoin, eth : ethereum ,bad,btc:bitcoin-2,x:a:b")
    assert {r.symbol: r.coin_id for r in m.collect()} == {"btc": "bitcoin-2", "eth": "ethereum", "x": "a:b"}


def test_market_chart(spark):
    js = '{"prices": [[1704067200000, 12.5], [1704070800000, 13.0], [1704074400000, null], ["x", 1], [1]]}'
    df = spark.createDataFrame([("btc", 1, js), ("eth", 2, "not json")], "symbol string, _seq long, json string")
    pts = sorted((r.symbol, r.pos, r.ts, float(r.price_eur)) for r in PL.parse_market_chart(df).collect())
    assert pts == [("btc", 0, dt.datetime(2024, 1, 1, 0, 0), 12.5), ("btc", 1, dt.datetime(2024, 1, 1, 1, 0), 13.0)]


def test_simple_price_and_joins(spark):
    df = spark.createDataFrame([(1, '{"bitcoin": {"eur": 50200.0}, "ripple": {}, "solana": {"usd": 1}}')],
                               "_seq long, json string")
    q = PL.parse_simple_price(df)
    assert [(r.coin_id, float(r.price_eur)) for r in q.collect()] == [("bitcoin", 50200.0)]
    syms = spark.createDataFrame([("btc",), ("xrp",), ("doge",)], "symbol string")
    m = PL.parse_mapping(spark)
    assert [r.symbol for r in PL.unmapped_symbols(syms, m).collect()] == ["doge"]
    assert [(r.symbol, r.coin_id) for r in PL.quotes_for_symbols(syms, m, q).collect()] == [("btc", "bitcoin")]
    assert [r.coin_id for r in PL.ids_without_quote(syms, m, q).collect()] == ["ripple"]
