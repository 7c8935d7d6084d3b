"""Failures must not lose stored rows, and inputs as users have them."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from coffer import jobs
from coffer.operators.ledger import last_write_wins, normalize_ledger
from coffer.operators.upsert import write_upsert
from coffer.session import ensure_checkpoint_dir
from coffer.sources.payloads import parse_market_chart, parse_simple_price
from coffer.sources.readers import read_ledger_csv, stored
from coffer.streaming.prices import BackfillSink

DAY = dt.date(2024, 1, 5)


def prices(spark, rows):
    df = spark.createDataFrame(rows, "t string, symbol string, p string")
    return df.select(F.col("t").cast("timestamp_ntz").alias("ts"), "symbol", F.col("p").cast("decimal(18,8)").alias("price_eur"))


def put(spark, path, rows):
    df = prices(spark, rows).withColumn("day", F.to_date("ts"))
    write_upsert(df, path, ["ts", "symbol"], ["price_eur"], "day", now="2024-01-09")


def read(spark, path):
    return sorted((str(r.ts), r.symbol, float(r.price_eur)) for r in spark.read.parquet(path).collect())


def test_unreadable_target_stays_as_it_is(spark, tmp_path):
    path = str(tmp_path / "prices")
    put(spark, path, [("2024-01-05 10:00:00", "btc", "1"), ("2024-01-05 10:00:00", "eth", "2")])
    before = read(spark, path)
    bad = os.path.join(path, "day=2024-01-05", "part-bad.parquet")
    with open(bad, "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark says of such a file
        put(spark, path, [("2024-01-05 10:00:00", "sol", "3")])
    os.rename(bad, str(tmp_path / "aside"))
    assert read(spark, path) == before
    put(spark, path, [("2024-01-05 10:00:00", "sol", "3")])
    assert len(read(spark, path)) == 3


def test_only_a_missing_path_is_no_table(spark, tmp_path):
    assert stored(spark, str(tmp_path / "none")) is None
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):  # noqa: B017
        stored(spark, str(tmp_path / "broken"))
    with pytest.raises(Exception):  # noqa: B017
        jobs.build_sheet(spark, str(tmp_path / "none"), str(tmp_path / "broken"), str(tmp_path / "sheet"), "2024-01-05")


def test_staging_folders_go_and_empty_batches_change_nothing(spark, tmp_path):
    path = str(tmp_path / "prices")
    root = ensure_checkpoint_dir(spark).removeprefix("file://").removeprefix("file:")
    there = set(os.listdir(root))
    put(spark, path, [("2024-01-05 10:00:00", "btc", "1")])
    assert set(os.listdir(root)) == there
    before = read(spark, path)
    write_upsert(prices(spark, []).withColumn("day", F.to_date("ts")), path, ["ts", "symbol"], ["price_eur"], "day")
    assert read(spark, path) == before


def test_no_local_folder_off_local_mode():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


HEAD = "Operation Date,Currency Ticker,Operation Type,Operation Amount,Operation Fees,Operation Hash,Countervalue Ticker,Countervalue at Operation Date"


def ledger(spark, folder):
    return normalize_ledger(read_ledger_csv(spark, str(folder)), "2030-01-01")


def test_each_file_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"{HEAD}\n2024-01-01 10:00:00,BTC,IN,2,0,n1,EUR,200\n", encoding="utf-8")
    cols = HEAD.split(",")
    values = dict(zip(cols, "2024-02-01 10:00:00,ETH,OUT,3,0,n2,EUR,30".split(","), strict=True))
    other = [c for c in reversed(cols) if c != "Operation Fees"]
    (tmp_path / "b.csv").write_text("﻿" + ",".join(f'" {c.upper()} "' for c in other) + "\n" + ",".join(values[c] for c in other) + "\n", encoding="utf-8")
    got = {r.symbol: r for r in ledger(spark, tmp_path).collect()}
    assert {s: (str(r.date_utc), r.qty, r.price_eur, r.note, r.date_defaulted) for s, r in got.items()} == {
        "btc": ("2024-01-01 10:00:00", 2.0, 100.0, "n1", False),
        "eth": ("2024-02-01 10:00:00", -3.0, 10.0, "n2", False),
    }


def test_duplicate_and_empty_headers(spark, tmp_path):
    (tmp_path / "dup").mkdir()
    (tmp_path / "dup" / "a.csv").write_text("date,symbol,amount,Amount\n2024-01-01 10:00:00,btc,1,7\n", encoding="utf-8")
    assert [r.qty for r in ledger(spark, tmp_path / "dup").collect()] == [7.0]  # the last one counts
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "a.csv").write_text("date,symbol,\n2024-01-01 10:00:00,btc,5\n", encoding="utf-8")
    # an empty header matches every field that no other header is
    assert [r.qty for r in ledger(spark, tmp_path / "empty").collect()] == [5.0]


def test_quoted_newlines_and_arrival_order(spark, tmp_path):
    for k, (name, note) in enumerate([("z.csv", '"first\nline"'), ("a.csv", "second")]):
        (tmp_path / name).write_text(f"{HEAD}\n2024-01-01 10:00:00,BTC,IN,{k + 1},0,{note},EUR,200\n" * 1, encoding="utf-8")
        os.utime(tmp_path / name, (1_700_000_000 + k, 1_700_000_000 + k))
    rows = ledger(spark, tmp_path)
    assert sorted(r.note for r in rows.collect()) == ["first\nline", "second"]
    last = last_write_wins(rows.select("_seq", "symbol", "note"), ["symbol"]).collect()
    assert [(r.note, r.n_rows) for r in last] == [("second", 2)]  # the later file, whatever its name or size


def test_import_twice_leaves_the_same_rejects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(f"{HEAD}\n2024-01-01 10:00:00,BTC,IN,1e15,0,n1,EUR,200\n2024-01-01 10:00:00,BTC,IN,1,0,n2,EUR,200\n", encoding="utf-8")
    tx, rejects = str(tmp_path / "tx"), str(tmp_path / "rejects")
    for _ in range(2):
        jobs.import_ledger(spark, str(tmp_path / "in"), tx, "2030-01-01", rejects)
        got = spark.read.parquet(rejects).collect()
        assert [(r.qty, r.reason) for r in got] == [(1e15, "decimal:qty")]
        assert spark.read.parquet(tx).count() == 1


def test_different_large_numbers_hash_apart(spark, tmp_path):
    lines = "".join(f"2024-01-01 10:00:00,BTC,IN,{q},0,n,EUR,0\n" for q in ("1e11", "2e11", "nan", "inf", "1e-9", "2e-9", "5e-324", "1.7e308"))
    (tmp_path / "a.csv").write_text(f"{HEAD}\n{lines}", encoding="utf-8")
    rows = ledger(spark, tmp_path).collect()
    assert len({r.dedup_hash for r in rows}) == len(rows) == 8


def test_bad_chart_points_are_skipped_one_by_one(spark):
    points = [[1704067200000, 1.5], [float("inf"), 2.0], [1e300, 3.0], [1704067200000, 1e300], ["x", 4.0], [1704067201000], [-1e300, 1.0]]
    text = json.dumps({"prices": points}).replace("Infinity", '"Infinity"')
    d = spark.createDataFrame([("btc", 1, text)], "symbol string, _seq long, json string")
    assert [(str(r.ts), float(r.price_eur)) for r in parse_market_chart(d).collect()] == [("2024-01-01 00:00:00", 1.5)]


def test_bad_quotes_are_skipped_one_by_one(spark):
    texts = ['{"bitcoin":{"eur":1.0},"status":5}', '{"a":{"eur":"no"},"b":{"eur":2},"c":{},"d":null,"e":{"eur":null}}', "no json"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "_seq int, json string")
    assert sorted((r.coin_id, float(r.price_eur)) for r in parse_simple_price(d).collect()) == [("b", 2.0), ("bitcoin", 1.0)]


def points(spark, rows):
    d = spark.createDataFrame([(s, q, p, t, v) for s, q, p, t, v in rows], "symbol string, _seq long, pos int, t string, v string")
    return d.select("symbol", "_seq", "pos", F.col("t").cast("timestamp_ntz").alias("ts"), F.col("v").cast("decimal(18,8)").alias("price_eur"))


def test_sink_corrects_keys_and_fills_days(spark, tmp_path):
    path = str(tmp_path / "prices")
    sink = BackfillSink(path)
    sink(points(spark, [("btc", 10, 0, "2024-01-05 10:00:00", "1")]), 0)
    batch = points(
        spark,
        [
            ("btc", 20, 0, "2024-01-05 10:00:00", "2"),  # a re-polled key, not the day's last point
            ("btc", 20, 1, "2024-01-05 12:00:00", "3"),  # the day is covered: dropped
            ("btc", 20, 2, "2024-01-06 09:00:00", "4"),
            ("btc", 20, 3, "2024-01-06 11:00:00", "5"),  # the last one of a missing day
            ("eth", 20, 0, "2024-01-05 08:00:00", "6"),
        ],
    )
    want = [("2024-01-05 08:00:00", "eth", 6.0), ("2024-01-05 10:00:00", "btc", 2.0), ("2024-01-06 11:00:00", "btc", 5.0)]
    for batch_id in (1, 1):  # a replayed batch leaves the same table
        sink(batch, batch_id)
        assert read(spark, path) == want
    made = {(r.symbol, str(r.ts)): r.created_at for r in spark.read.parquet(path).collect()}
    assert all(made.values()) and made["btc", "2024-01-05 10:00:00"] == dt.datetime(1970, 1, 1, 0, 0, 0, 10)
    sink(batch.limit(0), 2)
    assert read(spark, path) == want


def test_snapshot_rejects_are_kept_or_raised(spark, tmp_path, monkeypatch):
    tx = prices(spark, [("2024-01-01 10:00:00", "btc", "1")]).select(
        F.col("ts").alias("date_utc"), "symbol", F.col("price_eur").alias("qty"), "price_eur", F.lit(0).cast("decimal(18,8)").alias("fee_eur")
    )
    path = str(tmp_path / "tx")
    tx.write.parquet(path)
    real = jobs.H.portfolio_snapshot
    monkeypatch.setattr(jobs.H, "portfolio_snapshot", lambda report, ts: real(report, ts).withColumn("qty", F.lit(None).cast("decimal(18,8)")))
    args = (spark, path, str(tmp_path / "px"), str(tmp_path / "snap"), "2024-01-05 12:00:00")
    with pytest.raises(ValueError, match="cannot be stored"):
        jobs.snapshot_report(*args)
    for _ in range(2):
        jobs.snapshot_report(*args, rejects_path=str(tmp_path / "rejects"))
        assert [r.reason for r in spark.read.parquet(str(tmp_path / "rejects")).collect()] == ["null:qty"]
