"""Batch jobs over stored parquet tables: the steps of a portfolio run.

Order of a run: ``import_ledger`` -> ``backfill_prices`` -> ``snapshot_report``
-> ``build_sheet``. Each job reads the tables it needs, runs the operators and
applies a keyed upsert (``write_upsert``) to its output table, touching only
the partitions the batch concerns. Jobs take ``as_of`` / ``run_ts`` instead of
reading the clock, so a re-run with the same inputs leaves the same tables.

Tables (parquet directories):
  transactions  partitioned by ``month`` (first day of the UTC month)
  prices        partitioned by ``day`` (UTC)
  snapshots     partitioned by ``run_day``
  sheet         long form, partitioned by ``month``; the wide sheet and its
                views are derived from it (``sheet_views``)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer.operators import holdings as H
from coffer.operators import ledger as LG
from coffer.operators import prices as PX
from coffer.operators import quality as QA
from coffer.operators import upsert as UP
from coffer.operators import valuation as V
from coffer.operators.export import write_report_csv
from coffer.schemas import (
    COINS_DEFAULT,
    LEN_DEDUP_HASH,
    LEN_EXCHANGE,
    LEN_NOTE,
    LEN_SYMBOL,
    MONEY,
    PORTFOLIO_KEY,
    PORTFOLIO_UPDATE,
    PRICE_KEY,
    PRICE_UPDATE,
    TRANSACTIONS_KEY,
    TRANSACTIONS_UPDATE,
)
from coffer.session import scratch_folder
from coffer.sources.payloads import parse_market_chart
from coffer.sources.readers import read_ledger_csv, read_prices, read_transactions, stored


def _prices(spark: SparkSession, path: str) -> DataFrame:
    """The price table, or an empty one before the first backfill."""
    if stored(spark, path) is None:
        return spark.createDataFrame([], "ts timestamp_ntz, symbol string, price_eur decimal(18,8)")
    return read_prices(spark, path)


def import_ledger(
    spark: SparkSession,
    csv_path: str,
    transactions_path: str,
    as_of: str,
    rejects_path: str | None = None,
    hash_form: str = "python",
    counts: dict[str, int] | None = None,
) -> DataFrame:
    """Ledger export -> ``transactions``.

    Rows violating the stored constraints are written to ``rejects_path`` with
    their values as read, a ``reason``, and partitioned by the file they came
    from: importing a file again replaces its rejects. Both outputs read one
    staged copy of the normalised batch. ``hash_form`` is the one of the
    stored table's hashes (``normalize_ledger``). ``counts``, if given, gets
    what the run did: ``read``, ``rejected``, ``inserted``, ``updated`` and
    ``kept`` rows, observed by the jobs that write them. Returns the rejected rows' DataFrame
    (lazy; its staged input stays in the shared folder until that is cleared).
    """
    raw = read_ledger_csv(spark, csv_path)
    batch = LG.normalize_ledger(raw, as_of, hash_form)
    stage = scratch_folder(spark, "ledger")
    money = T.DecimalType(18, 8)
    rules = QA.domain_rules(
        not_null=["date_utc", "symbol", "qty", "price_eur", "fee_eur", "dedup_hash"],
        max_len={"symbol": LEN_SYMBOL, "exchange": LEN_EXCHANGE, "note": LEN_NOTE, "dedup_hash": LEN_DEDUP_HASH},
        decimals={"qty": money, "price_eur": money, "fee_eur": money},
    )
    seen = Observation()
    broken = F.greatest(*[F.coalesce(bad, F.lit(False)) for _, bad in rules])
    batch.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(broken).alias("rejected")).write.parquet(stage)
    batch = spark.read.schema(batch.schema).parquet(stage)
    valid, rejected = QA.domain_split(batch, rules)
    src = LG.to_store(valid).withColumn("month", F.trunc(F.to_date("date_utc"), "month"))
    done = UP.write_upsert(src, transactions_path, TRANSACTIONS_KEY, TRANSACTIONS_UPDATE, "month", seq="_seq", now=as_of)
    if counts is not None:
        counts.update(seen.get | done)
    if rejects_path:
        out = rejected.withColumn("source", F.md5(F.col("_seq.file").cast("binary")))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(rejects_path)
    return rejected


def backfill_prices(
    spark: SparkSession, transactions_path: str, prices_path: str, landing_path: str, as_of: str | None = None
) -> DataFrame:
    """Fill missing UTC price days from landed market-chart payloads
    (F1, F2, H7, F4, E5, H9, A4, F8, E6, I3).

    ``landing_path`` holds one JSON payload per file under ``symbol=<sym>/``.
    Returns the gap report (Q8) computed before the fill (lazy).
    """
    tx = read_transactions(spark, transactions_path)
    symbols, gaps = PX.price_gaps(tx, _prices(spark, prices_path), as_of)
    files = spark.read.option("wholetext", True).text(landing_path).select(
        F.lower(F.regexp_extract(F.col("_metadata.file_path"), r"symbol=([^/]+)/", 1)).alias("symbol"),
        F.unix_micros(F.col("_metadata.file_modification_time")).alias("_seq"),
        F.col("value").alias("json"),
    )
    points = parse_market_chart(files)
    kept = PX.backfill_points(points, gaps, ["_seq", "pos"])
    UP.write_upsert(
        kept.select("ts", "symbol", "price_eur", F.col("date").alias("day")),
        prices_path, PRICE_KEY, PRICE_UPDATE, "day", now=as_of,
    )
    return PX.gap_report(symbols, gaps)


def snapshot_report(
    spark: SparkSession,
    transactions_path: str,
    prices_path: str,
    snapshots_path: str,
    run_ts: str,
    csv_path: str | None = None,
    rejects_path: str | None = None,
) -> DataFrame:
    """Holdings report -> ``snapshots`` (upsert on ``ts, symbol``) and the CSV
    report (E1, E2, F5, C1–C5, I4, I7). Returns the report (lazy).

    Snapshot rows that the table cannot hold go to ``rejects_path`` with a
    ``reason``, one folder per run day that a re-run replaces; without a path
    such a row is an error, raised before anything is written."""
    tx = read_transactions(spark, transactions_path)
    prices = _prices(spark, prices_path)
    report = H.holdings_report(tx, prices)
    snap = H.portfolio_snapshot(report, run_ts)
    valid, rejected = QA.domain_split(snap, QA.domain_rules(not_null=list(snap.columns)))
    if rejects_path:
        out = rejected.withColumn("run_day", F.lit(run_ts).cast("timestamp_ntz").cast("date"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_day").parquet(rejects_path)
    elif bad := rejected.head(1):
        raise ValueError(f"snapshot row cannot be stored: {bad[0].asDict()}")
    UP.write_upsert(
        valid.withColumn("run_day", F.to_date("ts")), snapshots_path, PORTFOLIO_KEY, PORTFOLIO_UPDATE,
        "run_day", now=run_ts,
    )
    if csv_path:
        write_report_csv(report, csv_path)
    return report


def build_sheet(
    spark: SparkSession,
    transactions_path: str,
    prices_path: str,
    sheet_path: str,
    as_of: str,
    coins: Sequence[str] = COINS_DEFAULT,
) -> None:
    """Daily valuation (long form) -> ``sheet`` (upsert on ``date, symbol``,
    NULL numbers stored as 0; old days are never deleted) (F6–F10, G1–G5,
    C2, C6–C8, I5, Q5)."""
    tx = read_transactions(spark, transactions_path)
    prices = _prices(spark, prices_path)
    long = V.daily_valuation_long(tx, prices, coins=list(coins), as_of=as_of)
    numeric = ["bought", "bought_cum", "qty_cum", "price_eur", "value", "gain"]
    src = QA.fill_nulls(long, numeric).withColumn("month", F.trunc("date", "month"))
    UP.write_upsert(src, sheet_path, ["date", "symbol"], numeric, "month", now=None)


def sheet_views(spark: SparkSession, sheet_path: str, coins: Sequence[str] = COINS_DEFAULT) -> dict[str, DataFrame]:
    """The stored sheet as the wide sheet (J1), one view per coin (J2) and the
    totals view (J3)."""
    long = spark.read.parquet(sheet_path).drop("month")
    long = long.withColumn("price_eur", F.col("price_eur").cast(MONEY))
    wide = V.daily_valuation_wide(long, list(coins))
    views = {"sheet": wide, "totals": V.totals_view(wide)}
    for c in coins:
        views[c] = V.coin_view(wide, c)
    return views
