"""As-of positions.

For every sheet date and symbol: the running quantity of the latest
transaction day on or before that date, NULL before the symbol's first
transaction (the sheet's own running quantity is 0 there instead).

The backward as-of join is a union of the sparse daily quantities with the
dense calendar, one ``groupBy(symbol, date)`` and one running ``sum`` window:
``sum`` over a frame of only NULLs is NULL, which gives exactly "no
transaction yet". Each window partition holds one row per calendar day (plus
transaction days off the calendar) for one symbol, independent of the
symbol's raw volume.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coffer.operators.segments import running
from coffer.operators.valuation import daily_facts, date_segments
from coffer.schemas import MONEY, MONEY_SUM, SHEET_TZ
from coffer.session import ensure_checkpoint_dir


def positions_asof(
    tx: DataFrame,
    prices: DataFrame | None = None,
    coins: Sequence[str] | None = None,
    as_of: _dt.date | str | None = None,
    tz: str = SHEET_TZ,
    segment_days: int | None = None,
) -> DataFrame:
    """Long as-of positions: ``date, symbol, qty`` (NULL before first trade).

    With ``segment_days`` no task gets more than so many days of a symbol."""
    daily = daily_facts(tx, prices, coins, as_of, tz)
    if segment_days is None:
        w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        daily = daily.withColumn("qty", F.sum("qty_day").over(w))
    else:
        daily = running(date_segments(daily, segment_days), ["symbol"], "__segment", ["date"], sums={"qty": "qty_day"})
    return daily.filter(F.col("on_spine") == 1).select("date", "symbol", F.col("qty").cast(MONEY_SUM).alias("qty"))


def positions_at(tx: DataFrame, probes: DataFrame, segment_days: int = 31) -> DataFrame:
    """As-of by instant: ``probes`` (symbol, ts, ...) with ``qty``, the sum of the
    symbol's transactions at or before ``ts``; NULL before its first one.

    A backward as-of join without a join of instants: transactions, summed per
    (symbol, instant), and probes go through one running sum in the order of
    time, ``segment_days`` of a symbol at a time, so a symbol with a third of
    all rows is spread over its segments. Repeated
    probes each keep their row; probes without symbol or time have no quantity.
    """
    ensure_checkpoint_dir(tx.sparkSession)
    flows = tx.groupBy(F.lower("symbol").alias("__symbol"), F.col("date_utc").alias("__at")).agg(
        F.sum(F.coalesce("qty", F.lit(0)).cast(MONEY)).alias("__qty")
    )
    asked = probes.select(
        F.struct(*[F.col(f"`{c}`") for c in probes.columns]).alias("__probe"), F.lower("symbol").alias("__symbol"), F.col("ts").alias("__at")
    )
    known = asked.filter("__symbol is not null and __at is not null")
    both = flows.filter("__symbol is not null and __at is not null").unionByName(known, allowMissingColumns=True)
    unit = F.floor(F.datediff(F.to_date("__at"), F.lit("1970-01-01").cast("date")) / F.lit(segment_days))
    both = both.withColumns({"__segment": unit, "__late": F.col("__probe").isNotNull()}).checkpoint()
    summed = running(both, ["__symbol"], "__segment", ["__at", "__late"], sums={"__sum": "__qty"})
    # probes at one instant follow each other in any order: their sums are equal
    out = summed.filter("__late").select("__probe.*", F.col("__sum").cast(MONEY_SUM).alias("qty"))
    rest = asked.filter("__symbol is null or __at is null").select("__probe.*", F.lit(None).cast(MONEY_SUM).alias("qty"))
    return out.unionByName(rest)


def positions_wide(long_positions: DataFrame, coins: Sequence[str]) -> DataFrame:
    """``date`` plus ``qty_<coin>`` per coin (conditional aggregates)."""
    sym = F.col("symbol")
    aggs: list[Column] = [
        F.max(F.when(sym == c, F.col("qty"))).alias(f"qty_{c}") for c in coins
    ]
    return long_positions.filter(sym.isin(list(coins))).groupBy("date").agg(*aggs)
