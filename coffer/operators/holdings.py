"""Holdings report and portfolio snapshot.

Plan: a partial/final ``groupBy(symbol)`` over the transactions, the latest
quote per symbol as another ``groupBy(symbol)`` aggregate, and a left join of
the two on ``symbol``. Both join inputs are already hash-partitioned on
``symbol`` by their aggregates, so the join adds no exchange of its own and
nothing is broadcast: both sides have one row per symbol whatever the
transaction volume, and a hot symbol is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer.functions.money import gross_cost, nz, pnl_pct, value
from coffer.functions.parse import scrub_number
from coffer.functions.timecols import to_second
from coffer.operators.prices import latest_price
from coffer.schemas import MONEY, MONEY_SUM, PCT

REPORT_COLUMNS = ["symbol", "qty", "investi", "price_eur", "valeur_actuelle", "pnl", "pnl_pct"]


def scrub_transactions(tx: DataFrame) -> DataFrame:
    """Numeric scrub of qty/price/fee (strip, coerce, bad/NULL -> 0).

    Decimal inputs only get NULL -> 0; string inputs are parsed first.
    """
    cols = []
    for c in ("qty", "price_eur", "fee_eur"):
        dt = tx.schema[c].dataType
        if isinstance(dt, T.StringType):
            cols.append(scrub_number(F.col(c), dt).cast(MONEY).alias(c))
        else:
            cols.append(nz(F.col(c)).alias(c))
    return tx.select(F.lower("symbol").alias("symbol"), *cols)


def holdings_report(tx: DataFrame, prices: DataFrame) -> DataFrame:
    """Per symbol: quantity, amount invested (gross), latest price, value, PnL.

    investi          sum of ``abs(qty)*price + fee`` — sells add (C1, F5)
    price_eur        latest quote by ``ts``, no as-of cut; 0 if none (E1, C3)
    valeur_actuelle  qty * price (C3)
    pnl              valeur_actuelle - investi (C4)
    pnl_pct          pnl / investi * 100, 0 when investi is 0 (C5), DOUBLE
    """
    t = scrub_transactions(tx)
    agg = t.groupBy("symbol").agg(
        F.sum("qty").cast(MONEY_SUM).alias("qty"),
        F.sum(gross_cost(F.col("qty"), F.col("price_eur"), F.col("fee_eur"))).cast(MONEY_SUM).alias("investi"),
    )
    last = latest_price(prices).select("symbol", "price_eur")
    h = agg.join(last, "symbol", "left").withColumn("price_eur", nz(F.col("price_eur")))
    h = h.withColumn("valeur_actuelle", value(F.col("qty"), F.col("price_eur")))
    h = h.withColumn("pnl", (F.col("valeur_actuelle") - F.col("investi")).cast(MONEY_SUM))
    h = h.withColumn("pnl_pct", pnl_pct(F.col("pnl"), F.col("investi")))
    return h.select(*REPORT_COLUMNS)


def portfolio_totals(report: DataFrame) -> DataFrame:
    """one row with total invested, total value and total PnL."""
    return report.agg(
        F.sum("investi").cast(MONEY_SUM).alias("total_investi"),
        F.sum("valeur_actuelle").cast(MONEY_SUM).alias("total_valeur"),
        F.sum("pnl").cast(MONEY_SUM).alias("total_pnl"),
        F.count(F.lit(1)).alias("n_symbols"),
    )


def holdings_rollup(report: DataFrame) -> DataFrame:
    """F9 in one pass: the report's rows and the grand total from one aggregate.

    ``rollup`` gives each row its two grouping sets; ``level`` is their
    ``grouping_id``: 0 for a symbol, 1 for the total (symbol NULL, no price).
    A symbol that is NULL itself keeps level 0.
    """
    sums = [F.sum(c).cast(MONEY_SUM).alias(c) for c in ("investi", "valeur_actuelle", "pnl")]
    rolled = report.rollup("symbol").agg(
        F.grouping_id().cast("int").alias("level"),
        F.max("qty").alias("qty"),
        F.max("price_eur").alias("price_eur"),
        F.count(F.lit(1)).alias("n_symbols"),
        *sums,
    )
    row = F.col("level") == 0  # quantities of different symbols do not add up
    return rolled.select(
        "level",
        "symbol",
        F.when(row, F.col("qty")).alias("qty"),
        "investi",
        F.when(row, F.col("price_eur")).alias("price_eur"),
        "valeur_actuelle",
        "pnl",
        pnl_pct(F.col("pnl"), F.col("investi")).alias("pnl_pct"),
        "n_symbols",
    )


def portfolio_snapshot(report: DataFrame, ts) -> DataFrame:
    """I4 source rows: the report stamped with one run timestamp (cut to the
    second) in the stored types; ``pnl_pct`` as ``DECIMAL(10,4)``.

    ``ts`` is a Python datetime/str or a Column. Rows whose numbers do not fit
    the stored types keep NULLs here and are rejected by ``domain_split``.
    """
    ts_col = ts if not isinstance(ts, (str,)) and hasattr(ts, "_jc") else F.lit(str(ts))
    return report.select(
        to_second(ts_col.cast("timestamp_ntz")).alias("ts"),
        "symbol",
        F.col("qty").try_cast(MONEY).alias("qty"),
        F.col("investi").try_cast(MONEY).alias("investi"),
        F.col("price_eur").try_cast(MONEY).alias("price_eur"),
        F.col("valeur_actuelle").try_cast(MONEY).alias("valeur_actuelle"),
        F.col("pnl").try_cast(MONEY).alias("pnl_eur"),
        F.col("pnl_pct").try_cast(PCT).alias("pnl_pct"),
    )
