"""Streaming price polling (K1–K3) and exports."""

import json
import os
import time

import pytest

from coffer.operators import export as EX
from coffer.streaming import prices as ST


def _land(root, symbol, name, points):
    d = os.path.join(root, f"symbol={symbol}")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w") as f:
        json.dump({"prices": points}, f)
    time.sleep(0.05)  # distinct modification times = landing order


MS = 1704067200000  # 2024-01-01 00:00 UTC
H = 3600 * 1000
D = 24 * H


def test_backfill_stream_fills_missing_days_only(spark, tmp_path):
    landing, table, ckpt = str(tmp_path / "landing"), str(tmp_path / "prices"), str(tmp_path / "ckpt")
    _land(landing, "btc", "a.json", [[MS + H, 10.0], [MS + 2 * H, 11.0], [MS + D + H, 20.0]])
    _land(landing, "eth", "a.json", [[MS + H, 1.0], ["bad", 2.0]])
    q = ST.start_backfill(spark, landing, table, checkpoint=ckpt)
    q.awaitTermination()
    got = sorted((r.symbol, str(r.day), float(r.price_eur)) for r in spark.read.parquet(table).collect())
    assert got == [("btc", "2024-01-01", 11.0), ("btc", "2024-01-02", 20.0), ("eth", "2024-01-01", 1.0)]

    # Late data: a new point for a covered day is dropped; the same (ts, symbol)
    # overwrites; a missing day is filled.
    _land(landing, "btc", "b.json", [[MS + 3 * H, 99.0], [MS + D + H, 21.0], [MS + 2 * D, 30.0]])
    q = ST.start_backfill(spark, landing, table, checkpoint=ckpt)
    q.awaitTermination()
    got = sorted((r.symbol, str(r.day), float(r.price_eur)) for r in spark.read.parquet(table).collect())
    assert got == [("btc", "2024-01-01", 11.0), ("btc", "2024-01-02", 21.0), ("btc", "2024-01-03", 30.0),
                   ("eth", "2024-01-01", 1.0)]


def test_daily_close_stream(spark, tmp_path):
    landing = str(tmp_path / "landing")
    _land(landing, "btc", "a.json", [[MS + H, 10.0], [MS + 2 * H, 11.0]])
    _land(landing, "btc", "b.json", [[MS + 3 * D, 40.0]])  # moves the watermark past day 1
    closes = ST.daily_close_stream(ST.dedup_points(ST.chart_point_stream(spark, landing), "1 hour"), None)
    q = (closes.writeStream.format("memory").queryName("closes_t").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = [(r.symbol, str(r.date), float(r.price_eur)) for r in spark.sql("select * from closes_t").collect()]
    assert ("btc", "2024-01-01", 11.0) in got


def test_running_closes_equal_the_batch(spark, tmp_path):
    """Stopped and started again between files, with late points; the table is that of one batch."""
    from pyspark.sql import functions as F

    from coffer.operators.prices import daily_close_utc
    from coffer.sources.payloads import parse_market_chart

    landing, table, ckpt = (str(tmp_path / n) for n in ("landing", "closes", "ckpt"))
    files = [
        ("btc", [[MS + H, 10.0], [MS + 5 * H, 11.0], [MS + D + H, 20.0]]),
        ("btc", [[MS + 7 * H, 12.0]]),  # corrects a close that is written already
        ("eth", [[MS + 3 * D, 1.0]]),
        ("btc", [[MS + 3 * D, 40.0], [MS + D + 2 * H, 21.0]]),  # late by two days, inside the watermark
    ]
    for k, (symbol, points) in enumerate(files):
        _land(landing, symbol, f"{k}.json", points)
        ST.start_daily_closes(spark, landing, table, checkpoint=ckpt).awaitTermination()
        if k == 0:
            first = {str(r.date): float(r.price_eur) for r in spark.read.parquet(table).collect()}
            assert first == {"2024-01-01": 11.0, "2024-01-02": 20.0}
    raw = spark.read.option("wholetext", True).text(landing).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"symbol=([^/]+)/", 1).alias("symbol"),
        F.unix_micros(F.col("_metadata.file_modification_time")).alias("_seq"),
        F.col("value").alias("json"),
    )
    want = daily_close_utc(parse_market_chart(raw), ["_seq", "pos"]).select("symbol", "date", "ts", "price_eur").collect()
    got = spark.read.parquet(table).select("symbol", "date", "ts", "price_eur").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 4


def test_exports(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    tables = {"Sheet 1": a, "sheet-1": a, "Other": a}
    paths = EX.export_tables(tables, str(tmp_path), export_json=True)
    assert [os.path.basename(p) for p in paths] == ["sheet_1.csv", "sheet_1.json", "sheet_1_2.csv",
                                                   "sheet_1_2.json", "other.csv", "other.json"]
    assert spark.read.option("header", True).csv(paths[0]).count() == 1
    assert EX.select_tables(tables, ["Other", "nope"]) == ["Other"]
    with pytest.raises(ValueError):
        EX.select_tables(tables, ["nope"])
    rep = spark.createDataFrame([("btc", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)],
                                "symbol string, qty double, investi double, price_eur double, "
                                "valeur_actuelle double, pnl double, pnl_pct double")
    p = EX.write_report_csv(rep, str(tmp_path / "snapshot.csv"))
    assert spark.read.option("header", True).csv(p).columns == EX.REPORT_COLUMNS
