"""Money arithmetic on DECIMAL columns.

Sums stay DECIMAL (exact and order-independent). Products are taken on
operands narrowed to a width whose product still fits 38 digits with the
full scale, so no silent scale loss happens before the final cast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer.schemas import MONEY, MONEY_SUM

# Quantity width used in products: 16 integer digits, 8 decimals.
QTY_MUL = T.DecimalType(24, 8)


def nz(c: Column, dtype: T.DataType = MONEY) -> Column:
    """NULL -> 0 in the given decimal type."""
    return F.coalesce(c.cast(dtype), F.lit(0).cast(dtype))


def gross_cost(qty: Column, price: Column, fee: Column) -> Column:
    """``abs(qty) * price + fee`` (sells add to the amount invested)."""
    return F.abs(qty) * price + fee


def daily_buy(qty: Column, price: Column, fee: Column) -> Column:
    """``max(qty, 0) * price + fee`` (sells add only their fee)."""
    return F.greatest(qty, F.lit(0).cast(MONEY)) * price + fee


def value(qty_cum: Column, price: Column) -> Column:
    """``qty * price`` with a missing price (or qty) counted as 0."""
    return (nz(qty_cum, MONEY_SUM).cast(QTY_MUL) * nz(price)).cast(MONEY_SUM)


def pnl_pct(pnl: Column, invested: Column) -> Column:
    """``pnl / invested * 100``; 0 when nothing was invested.

    Computed in DOUBLE like the original ratio; see ``holdings`` for the
    stored ``DECIMAL(10,4)`` form.
    """
    inv = invested.cast(T.DoubleType())
    return F.when(inv == 0, F.lit(0.0)).otherwise(pnl.cast(T.DoubleType()) / inv * 100.0)
