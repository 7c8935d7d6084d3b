"""End-to-end run over parquet tables: import -> backfill -> report -> sheet,
then a re-run with the same inputs leaves the same tables."""

import json
import os
import time
from decimal import Decimal as D

from coffer import jobs

AS_OF = "2024-01-05"
CSV = """Operation Date,Currency Ticker,Operation Type,Operation Amount,Operation Fees,Operation Hash,Countervalue Ticker,Countervalue at Operation Date
2024-01-01T23:30:00.000Z,BTC,IN,2,0.01,h1,EUR,200
2024-01-04 10:00:00,BTC,OUT,1,0,h2,EUR,150
03/01/2024 10:00,ETH,IN,5,0,h3,EUR,50
2024-01-04 10:00:00,BTC,OUT,1,0,h2,EUR,150
bad,VERYLONGSYMBOLNAMEOVERTWENTYCHARS,IN,1,0,h4,EUR,1
"""


def _land(root, symbol, name, points):
    d = os.path.join(root, f"symbol={symbol}")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w") as f:
        json.dump({"prices": points}, f)
    time.sleep(0.05)


def test_full_run(spark, tmp_path):
    csv = tmp_path / "export.csv"
    csv.write_text(CSV, encoding="utf-8")
    tx, px, snap, sheet = (str(tmp_path / n) for n in ("tx", "px", "snap", "sheet"))
    landing = str(tmp_path / "landing")
    ms = 1704067200000 + 2 * 86400000  # 2024-01-03 00:00 UTC
    _land(landing, "btc", "a.json", [[ms + 9 * 3600000, 110.0], [ms + 20 * 3600000, 120.0]])

    rejected = jobs.import_ledger(spark, str(csv), tx, AS_OF, str(tmp_path / "rejects"))
    assert [r.reason for r in rejected.collect()] == ["length:symbol>20"]
    t = spark.read.parquet(tx)
    assert t.count() == 3  # the duplicated line is imported once

    report = jobs.backfill_prices(spark, tx, px, landing, AS_OF)
    got = {r.symbol: r.n_missing for r in report.collect()}
    assert got == {"btc": 5, "eth": 5}  # before the fill: no prices at all
    assert [(str(r.day), float(r.price_eur)) for r in spark.read.parquet(px).collect()] == [("2024-01-03", 120.0)]

    rep = {r.symbol: r for r in jobs.snapshot_report(spark, tx, px, snap, "2024-01-05 12:00:00", str(tmp_path / "csv")).collect()}
    assert float(rep["btc"].price_eur) == 120.0 and float(rep["btc"].qty) == 1.0
    assert spark.read.parquet(snap).count() == 2

    jobs.build_sheet(spark, tx, px, sheet, AS_OF, coins=["btc", "eth"])
    views = jobs.sheet_views(spark, sheet, coins=["btc", "eth"])
    w = {r.date.isoformat(): r.asDict() for r in views["sheet"].collect()}
    assert w["2024-01-02"]["btc valeur"] == D("240.00")  # back-filled 120 x 2
    assert w["2024-01-04"]["btc valeur"] == D("120.00")
    assert list(views["totals"].columns) == ["date", "total acheté", "total valeur", "total gain perte"]

    before = {n: sorted(map(tuple, spark.read.parquet(p).drop("created_at").collect())) for n, p in
              [("tx", tx), ("px", px), ("snap", snap), ("sheet", sheet)]}
    counts: dict[str, int] = {}
    jobs.import_ledger(spark, str(csv), tx, AS_OF, counts=counts)
    assert counts == {"read": 5, "rejected": 1, "inserted": 0, "updated": 3, "kept": 0}
    jobs.backfill_prices(spark, tx, px, landing, AS_OF)
    jobs.snapshot_report(spark, tx, px, snap, "2024-01-05 12:00:00")
    jobs.build_sheet(spark, tx, px, sheet, AS_OF, coins=["btc", "eth"])
    after = {n: sorted(map(tuple, spark.read.parquet(p).drop("created_at").collect())) for n, p in
             [("tx", tx), ("px", px), ("snap", snap), ("sheet", sheet)]}
    assert before == after
