"""Daily valuation sheet.

Plan shape of ``daily_valuation_long``:

1. transactions and quotes, each read once, in one union keyed by (symbol,
   local day) and one hash aggregate (buys and quantities summed, the day's
   last quote by a fixed-width order key); partial aggregation runs before the
   shuffle, so a symbol with a third of all transactions ships at most one
   partial row per task and day. The result is checkpointed;
2. from it: the calendar (a scalar subquery, exploded per symbol; no cross
   join), the symbol list, and the dense spine joined by union and aggregate;
3. one window partitioned by symbol, ordered by date, for the running sums
   and the forward/backward price fill. A window partition holds one row per
   day of the calendar, whatever the symbol's raw volume.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer.functions.money import daily_buy, nz, value
from coffer.functions.timecols import day_spine, local_day
from coffer.operators.prices import last_quote
from coffer.operators.segments import running
from coffer.schemas import (
    MONEY,
    MONEY_SUM,
    SHEET_COIN_LABELS,
    SHEET_NUM,
    SHEET_TAIL_LABELS,
    SHEET_TOTAL_LABELS,
    SHEET_TZ,
    sheet_columns,
)
from coffer.session import ensure_checkpoint_dir

LONG_COLUMNS = ["date", "symbol", "bought", "bought_cum", "qty_cum", "price_eur", "value", "gain"]


def _literal_symbols(spark, coins: Sequence[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in coins])).alias("symbol"))


def spread_symbols(symbols: DataFrame) -> DataFrame:
    """Spread a (small) symbol list before it generates the dense calendar:
    the list itself is tiny, so AQE would coalesce it into one partition and
    one task would emit all symbols x days rows. A round-robin repartition to
    an explicit count (``spark.sql.shuffle.partitions``) is kept by AQE and,
    unlike a hash repartition on ``symbol``, is not merged into the distinct's
    own (coalescible) exchange."""
    n = int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return symbols.repartition(n)


def daily_activity(tx: DataFrame, prices: DataFrame | None, tz: str = SHEET_TZ) -> DataFrame:
    """One row per (symbol, local day) with a transaction or a quote:
    symbol, date, traded, buy_day, qty_day, close (NULL without a quote).

    Each input is read once, and both go through one hash aggregate that is
    combined map-side, so a symbol holding a third of all rows ships a
    row per task and day.
    """
    none = F.lit(None)
    flows = tx.select(
        F.lower("symbol").alias("symbol"),
        local_day("date_utc", tz).alias("date"),
        F.lit(True).alias("traded"),
        daily_buy(nz(F.col("qty")), nz(F.col("price_eur")), nz(F.col("fee_eur"))).cast("decimal(38,16)").alias("buy"),
        nz(F.col("qty")).cast(MONEY).alias("qty"),
        none.cast("timestamp_ntz").alias("ts"),
        none.cast(MONEY).alias("quote"),
    )
    rows = flows
    if prices is not None:
        rows = flows.unionByName(
            prices.select(
                F.lower("symbol").alias("symbol"),
                local_day("ts", tz).alias("date"),
                F.lit(False).alias("traded"),
                none.cast("decimal(38,16)").alias("buy"),
                none.cast(MONEY).alias("qty"),
                "ts",
                F.col("price_eur").cast(MONEY).alias("quote"),
            )
        )
    return rows.groupBy("symbol", "date").agg(
        F.max("traded").alias("traded"),
        F.sum("buy").alias("buy_day"),
        F.sum("qty").alias("qty_day"),
        # the day's last quote; rows without a price have no order key
        last_quote("quote").alias("close"),
    )


def calendar(activity: DataFrame, as_of: _dt.date | str | None) -> Column:
    """The sheet's calendar (H8): from the first transaction day to ``as_of``, or
    else the last day seen, as ONE scalar subquery returning ``array<date>``.

    The array's size is bounded by the calendar span (36,525 dates per
    century), not by the data. Callers reference the returned column once
    (``explode``), so the subquery runs once.
    """
    start = F.min(F.when(F.col("traded"), F.col("date"))).alias("start")
    bounds = activity.agg(start, F.max("date").alias("end"))
    if as_of is not None:
        bounds = bounds.select("start", F.lit(str(as_of)).cast(T.DateType()).alias("end"))
    return bounds.select(day_spine(F.col("start"), F.col("end")).alias("days")).scalar()


def daily_facts(
    tx: DataFrame,
    prices: DataFrame | None,
    coins: Sequence[str] | None = None,
    as_of: _dt.date | str | None = None,
    tz: str = SHEET_TZ,
) -> DataFrame:
    """Dense (symbol, date) rows with the day's buy, qty and close (sparse),
    and sparse rows off the calendar, told apart by ``on_spine``.

    Columns: symbol, date, on_spine, buy_day, qty_day, close. The activity (symbols x
    days at most) is checkpointed in the shared folder; the calendar, the
    symbol list and the facts all derive from it, so no input is read again.
    """
    ensure_checkpoint_dir(tx.sparkSession)
    activity = daily_activity(tx, prices, tz).checkpoint()
    if coins:
        symbols = _literal_symbols(tx.sparkSession, coins)
        facts = activity.filter(F.col("symbol").isin(list(coins)))
    else:
        symbols = spread_symbols(activity.filter("traded").select("symbol").distinct())
        facts = activity
    spine = symbols.select("symbol", F.explode(calendar(activity, as_of)).alias("date"), F.lit(1).alias("on_spine"))
    return (
        spine.unionByName(facts.drop("traded").withColumn("on_spine", F.lit(0)), allowMissingColumns=True)
        .groupBy("symbol", "date")
        .agg(
            F.max("on_spine").alias("on_spine"),
            *[F.max(c).alias(c) for c in ("buy_day", "qty_day", "close")],  # one row at most has them
        )
    )


def date_segments(daily: DataFrame, days: int) -> DataFrame:
    """``daily`` checkpointed, with ``__segment``: the number of its date range of ``days`` days."""
    ranges = F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / F.lit(days))
    return daily.withColumn("__segment", ranges).checkpoint()


def daily_valuation_long(
    tx: DataFrame,
    prices: DataFrame,
    coins: Sequence[str] | None = None,
    as_of: _dt.date | str | None = None,
    tz: str = SHEET_TZ,
    segment_days: int | None = None,
) -> DataFrame:
    """Long daily valuation: one row per (date, symbol) of the dense calendar.

    bought      sum over the day of ``max(qty,0)*price + fee`` (C2, F6)
    bought_cum  running sum of ``bought`` (G1) — sells never reduce it
    qty_cum     running sum of quantities (G2), 0 before the first trade
    price_eur   last quote of the day, forward-filled, and before the first
                quote back-filled (G4, G5); NULL if the symbol has no quote
    value       qty_cum * price, a missing price counting 0 (C6)
    gain        value - bought_cum (C7)

    A symbol's window is one task. With ``segment_days`` it is cut into date
    ranges of so many days, each a task of its own; sums and the nearest
    quotes carry over (``segments.running``).
    """
    # Quotes before the first day must not be carried forward: rows off the
    # calendar go before the window sees them.
    daily = daily_facts(tx, prices, coins, as_of, tz).filter(F.col("on_spine") == 1)
    bought = F.coalesce(F.col("buy_day"), F.lit(0).cast("decimal(38,16)"))
    daily = daily.withColumns({"__bought": bought, "__qty": nz(F.col("qty_day"))})
    if segment_days is None:
        w = Window.partitionBy("symbol").orderBy("date")
        run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        daily = daily.withColumns(
            {
                "__bought_cum": F.sum("__bought").over(run),
                "__qty_cum": F.sum("__qty").over(run),
                "__past": F.last("close", ignorenulls=True).over(run),
                "__next": F.first("close", ignorenulls=True).over(ahead),
            }
        )
    else:
        daily = running(
            date_segments(daily, segment_days), ["symbol"], "__segment", ["date"],
            sums={"__bought_cum": "__bought", "__qty_cum": "__qty"}, lasts={"__past": "close"}, firsts={"__next": "close"},
        )
    out = daily.select(
        "date",
        "symbol",
        F.col("__bought").cast(MONEY_SUM).alias("bought"),
        F.col("__bought_cum").cast(MONEY_SUM).alias("bought_cum"),
        F.col("__qty_cum").cast(MONEY_SUM).alias("qty_cum"),
        F.coalesce("__past", "__next").cast(MONEY).alias("price_eur"),
    )
    out = out.withColumn("value", value(F.col("qty_cum"), F.col("price_eur")))
    out = out.withColumn("gain", (F.col("value") - F.col("bought_cum")).cast(MONEY_SUM))
    return out.select(*LONG_COLUMNS)


def daily_totals(long: DataFrame) -> DataFrame:
    """Per date, total bought (cumulative), total value, total gain."""
    return long.groupBy("date").agg(
        F.sum("bought_cum").cast(MONEY_SUM).alias("total_bought"),
        F.sum("value").cast(MONEY_SUM).alias("total_value"),
        (F.sum("value") - F.sum("bought_cum")).cast(MONEY_SUM).alias("total_gain"),
    )


def _sheet_num(c: Column) -> Column:
    return F.coalesce(c.cast(SHEET_NUM), F.lit(0).cast(SHEET_NUM))


def daily_valuation_wide(long: DataFrame, coins: Sequence[str]) -> DataFrame:
    """The sheet as one wide row per date, in the sheet's column order.

    The long-to-wide pivot over the explicit coin list is written as one
    ``groupBy("date")`` with conditional aggregates (what ``pivot`` with a
    value list expands to), so the per-coin blocks and the totals come out of
    the same partial/final aggregate — one pass over the long plan. All
    numbers are ``DECIMAL(20,2)`` with NULL stored as 0; totals are the sums
    of the unrounded long values over the coin list (trap: symbols outside
    the list still set the first day but are not in the totals).
    """
    coins = list(coins)
    sym = F.col("symbol")
    aggs = []
    for c in coins:
        for m in ("bought", "value", "gain", "bought_cum"):
            aggs.append(F.sum(F.when(sym == c, F.col(m))).alias(f"{c}__{m}"))
    aggs += [
        F.sum(F.when(sym.isin(coins), F.col("bought_cum"))).alias("__tb"),
        F.sum(F.when(sym.isin(coins), F.col("value"))).alias("__tv"),
    ]
    p = long.filter(sym.isin(coins)).groupBy("date").agg(*aggs)
    cols: list[Column] = [F.col("date")]
    for c in coins:
        b, v, g, bc = (F.col(f"{c}__{m}") for m in ("bought", "value", "gain", "bought_cum"))
        lbl = [x.format(c=c) for x in SHEET_COIN_LABELS]
        cols += [
            _sheet_num(b).alias(lbl[0]),
            _sheet_num(v).alias(lbl[1]),
            _sheet_num(g).alias(lbl[2]),
            _sheet_num(bc).alias(lbl[3]),
            _sheet_num(v).alias(lbl[4]),
        ]
    for c in coins:
        lbl = [x.format(C=c.upper()) for x in SHEET_TAIL_LABELS]
        cols += [
            _sheet_num(F.col(f"{c}__bought_cum")).alias(lbl[0]),
            _sheet_num(F.col(f"{c}__value")).alias(lbl[1]),
        ]
    cols += [
        _sheet_num(F.col("__tb")).alias(SHEET_TOTAL_LABELS[0]),
        _sheet_num(F.col("__tv")).alias(SHEET_TOTAL_LABELS[1]),
        _sheet_num(F.col("__tv") - F.col("__tb")).alias(SHEET_TOTAL_LABELS[2]),
    ]
    out = p.select(*cols)
    assert out.columns == sheet_columns(coins)
    return out


def coin_view(wide: DataFrame, coin: str) -> DataFrame:
    """Date plus the (up to 7) columns of one coin that are present."""
    wanted = [x.format(c=coin) for x in SHEET_COIN_LABELS] + [
        x.format(C=coin.upper()) for x in SHEET_TAIL_LABELS
    ]
    present = [c for c in wanted if c in wide.columns]
    return wide.select("date", *[F.col(f"`{c}`") for c in present])


def totals_view(wide: DataFrame) -> DataFrame:
    """Date plus the total columns that are present."""
    present = [c for c in SHEET_TOTAL_LABELS if c in wide.columns]
    return wide.select("date", *[F.col(f"`{c}`") for c in present])


def series_tail(view: DataFrame, value_col: str, n: int, as_of_col: Column | None = None) -> DataFrame:
    """H3 (+D5, H2): the last ``n`` rows by date (all rows when ``n`` is 0),
    returned in ascending date order; ``as_of_col`` cuts future dates."""
    v = view.select("date", F.col(f"`{value_col}`"))
    if as_of_col is not None:
        v = v.filter(F.col("date") <= as_of_col)
    if n and n > 0:
        v = v.orderBy(F.col("date").desc()).limit(n)
    return v.orderBy("date")


def to_storage(wide: DataFrame) -> DataFrame:
    """The wide sheet under storage-safe column names (B17 applied to every
    label, e.g. ``btc acheté cumul`` -> ``btc_achete_cumul``)."""
    from coffer.functions.names import normalize_name

    return wide.select(*[F.col(f"`{c}`").alias(normalize_name(c)) for c in wide.columns])


def main_view(stored: DataFrame, display_columns: Sequence[str]) -> DataFrame:
    """The stored sheet under its display labels, in display order; the
    labels whose storage column is absent are skipped."""
    from coffer.functions.names import normalize_name

    present = set(stored.columns)
    return stored.select(
        *[F.col(normalize_name(c)).alias(c) for c in display_columns if normalize_name(c) in present]
    )
