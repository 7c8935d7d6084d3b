"""Price history operators.

Price tables have columns ``ts`` (UTC NTZ), ``symbol``, ``price_eur`` and
optionally arrival-order columns. Every "last point" pick is an aggregate
(``max_by`` on one ordering key, see ``quote_order``), never a self-join or a
window over raw points: the aggregate is combined map-side, so a symbol with
a huge history costs one partial row per task and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.functions.timecols import local_day, utc_day
from coffer.schemas import MONEY, SHEET_TZ
from coffer.session import ensure_checkpoint_dir


def last_by(value: Column, *order: Column) -> Column:
    """Aggregate: ``value`` of the row with the greatest ``order``; equal
    orders are settled by the value, the greater wins."""
    fields = [o.alias(f"k{i}") for i, o in enumerate(order)] + [value.alias("v")]
    return F.max(F.struct(*fields))["v"]


def quote_order(ts: Column, price: Column) -> Column:
    """Time, then price, as one number: microseconds times 10**18 plus the
    price in units of 1e-8; NULL without a price. A fixed-width order key keeps
    ``max_by`` a hash aggregate with map-side combine (a struct ``max`` would
    sort every map partition) and makes the pick unique on equal times."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    units = (price.cast(MONEY).cast("decimal(38,8)") * F.lit(10**8).cast("decimal(9,0)")).cast("decimal(38,0)")
    return (micros.cast("decimal(18,0)") * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)") + units


def last_quote(price: str = "price_eur", ts: str = "ts") -> Column:
    """Aggregate: the price of the latest quote, the greatest one on equal times."""
    return F.max_by(price, quote_order(F.col(ts), F.col(price))).cast(MONEY)


def _lower_symbol(df: DataFrame) -> Column:
    return F.lower(F.col("symbol")).alias("symbol")


def latest_price(prices: DataFrame) -> DataFrame:
    """Latest quote per symbol — ``symbol, ts, price_eur``.

    "Latest" is the global ``max(ts)`` with no as-of cut, as in the report.
    One partial/final aggregate instead of a self-join on ``max(ts)``.
    """
    p = prices.filter(F.col("price_eur").isNotNull()).select(
        _lower_symbol(prices), "ts", "price_eur"
    )
    return p.groupBy("symbol").agg(
        F.max("ts").alias("ts"), last_quote().alias("price_eur")
    )


def daily_close_local(prices: DataFrame, tz: str = SHEET_TZ) -> DataFrame:
    """F7 (+D3, B14): last non-null price by ``ts`` per (symbol, local day)."""
    p = prices.filter(F.col("price_eur").isNotNull())
    return p.groupBy(_lower_symbol(p), local_day("ts", tz).alias("date")).agg(
        last_quote().alias("price_eur")
    )


def daily_close_utc(prices: DataFrame, order: list[str] | None = None) -> DataFrame:
    """F8 (+B15): one point per (symbol, UTC day), the last in arrival order.

    ``order`` names the arrival-order columns (e.g. payload sequence, then
    position inside the payload); without it the arrival order is the time
    order. Returns ``symbol, date, ts, price_eur``.
    """
    p = prices.filter(F.col("price_eur").isNotNull())
    g = p.groupBy(_lower_symbol(p), utc_day("ts").alias("date"))
    if not order:
        return g.agg(
            F.max("ts").alias("ts"), last_quote().alias("price_eur")
        )
    keys = [F.col(c) for c in order]
    best = F.max(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], "ts", "price_eur"))
    return g.agg(best.alias("b")).select(
        "symbol", "date", F.col("b.ts").alias("ts"), F.col("b.price_eur").cast(MONEY).alias("price_eur")
    )


def tx_span(tx: DataFrame) -> DataFrame:
    """first and last transaction instant."""
    return tx.agg(F.min("date_utc").alias("first_date_utc"), F.max("date_utc").alias("last_date_utc"))


def symbol_universe(tx: DataFrame) -> DataFrame:
    """F1 (+D1): distinct lower-cased non-empty symbols."""
    s = F.lower(F.col("symbol"))
    return tx.select(s.alias("symbol")).filter(F.length("symbol") > 0).distinct()


def days_present(prices: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """F4 (+D4): distinct UTC days with at least one quote, per symbol.

    The optional half-open range ``ts >= start_day and ts < end_day + 1`` is
    written on ``ts`` itself so it reaches the parquet scan; on a table stored
    by UTC ``day`` it is put on that column too, so that other days' folders
    are not opened.
    """
    p = prices
    stored_days = "day" in prices.columns
    if start is not None:
        p = p.filter(F.col("ts") >= start.cast("timestamp_ntz"))
        p = p.filter(F.col("day") >= start) if stored_days else p
    if end is not None:
        p = p.filter(F.col("ts") < F.date_add(end, 1).cast("timestamp_ntz"))
        p = p.filter(F.col("day") <= end) if stored_days else p
    return p.select(_lower_symbol(p), utc_day("ts").alias("date")).distinct()


def last_price_day(prices: DataFrame) -> DataFrame:
    """last UTC day with a quote, per symbol."""
    return prices.groupBy(_lower_symbol(prices)).agg(F.max(utc_day("ts")).alias("last_day"))


def expected_days(symbols: DataFrame, days: Column) -> DataFrame:
    """H7 × symbols (E9): every calendar day for every symbol.

    A per-symbol generator, not a cross join: each symbol row expands into
    its own days, so the work is spread with the symbol partitions.
    """
    from coffer.operators.valuation import spread_symbols

    return spread_symbols(symbols).select("symbol", F.explode(days).alias("date"))


def price_gaps(tx: DataFrame, prices: DataFrame, as_of=None) -> tuple[DataFrame, DataFrame]:
    """E5/H6 (+F2, H7, D4): ``symbols`` and their (symbol, day) pairs without a quote.

    The calendar is the UTC days from the first transaction to ``as_of`` (or
    the last day seen in transactions or quotes). Each input is read once:
    transactions are reduced to their distinct (symbol, day) pairs, whose
    first day bounds the read of the quotes (a range on ``ts`` that reaches
    the scan), and those are reduced likewise. Both reductions are combined
    map-side, so a symbol with a huge history ships one row per task and day;
    what is left (symbols x days at most) is checkpointed, and everything else
    derives from it.
    """
    spark = tx.sparkSession
    ensure_checkpoint_dir(spark)
    tx_days = tx.select(_lower_symbol(tx), utc_day("date_utc").alias("date")).distinct().checkpoint()
    symbols = symbol_universe(tx_days)
    first, last = tx_days.agg(F.min("date"), F.max("date")).first()
    if first is None:
        return symbols, symbols.select("symbol", F.lit(None).cast("date").alias("date")).limit(0)
    end = None if as_of is None else F.lit(str(as_of)).cast("date")
    have = days_present(prices, F.lit(first), end).checkpoint()
    if end is None:
        seen = have.agg(F.max("date")).first()[0]
        end = F.lit(last if seen is None else max(last, seen))
    wanted = expected_days(symbols, F.sequence(F.lit(first), F.greatest(F.lit(first), end)))
    if as_of is not None:
        wanted = wanted.filter(F.col("date") <= end)
    return symbols, wanted.join(have, ["symbol", "date"], "left_anti")


def gap_ranges(gaps: DataFrame) -> DataFrame:
    """H9: per symbol the missing-range envelope ``[first, last + 1 day)``."""
    return gaps.groupBy("symbol").agg(
        F.min("date").alias("from_day"),
        F.date_add(F.max("date"), 1).alias("to_day_excl"),
        F.count(F.lit(1)).alias("n_missing"),
    )


def gap_report(symbols: DataFrame, gaps: DataFrame) -> DataFrame:
    """Q8: every symbol with its missing-day count and range, or "complete"."""
    r = gap_ranges(gaps)
    return (
        symbols.join(r, "symbol", "left")
        .select(
            "symbol",
            F.coalesce(F.col("n_missing"), F.lit(0)).cast("long").alias("n_missing"),
            "from_day",
            "to_day_excl",
            F.when(F.col("n_missing").isNull(), F.lit("complete")).otherwise(F.lit("missing")).alias("status"),
        )
    )


def backfill_points(fetched: DataFrame, gaps: DataFrame, order: list[str] | None = None) -> DataFrame:
    """F8 then E6: one point per fetched (symbol, UTC day), kept only for
    days that are missing. Returns ``symbol, date, ts, price_eur``."""
    daily = daily_close_utc(fetched, order)
    return daily.join(gaps.select("symbol", "date"), ["symbol", "date"], "left_semi")


def points_per_symbol(points: DataFrame) -> DataFrame:
    """number of points per symbol (the upsert count), with the first
    and last point time."""
    return points.groupBy(_lower_symbol(points)).agg(
        F.count(F.lit(1)).alias("n_points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
