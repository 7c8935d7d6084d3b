"""Ledger export normalisation.

``normalize_ledger`` turns an all-string export with unknown headers into
canonical signed transactions with a chain of projections. Headers are
resolved once per input at plan time (they are metadata); every row-level
rule is a native expression, so the projections are whole-stage
code-generated and run where the file splits are read, with no shuffle.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer.functions.names import column_or_null, normalize_headers, resolve_like
from coffer.functions.numtext import with_python_texts
from coffer.functions.parse import (
    checked_value,
    datetime_from_fields,
    decimal_value,
    ledger_date_text,
    ledger_datetime_fields_text,
    parse_float,
    plain_datetime_text,
    strip_ws,
)
from coffer.functions.timecols import to_second
from coffer.schemas import (
    EUR_TICKER,
    INFLOW_TYPES,
    LEDGER_AMOUNT_KEYS,
    LEDGER_COUNTERVALUE_KEYS,
    LEDGER_COUNTERVALUE_TICKER_KEYS,
    LEDGER_CURRENCY_KEYS,
    LEDGER_DATE_KEYS,
    LEDGER_EXCHANGE,
    LEDGER_FEE_ASSET_KEYS,
    LEDGER_NOTE_KEYS,
    LEDGER_OP_TYPE_KEYS,
    LEDGER_PRICE_FALLBACK_KEYS,
    OUTFLOW_TYPES,
)
from coffer.session import compiled_methods

SEQ = "_seq"

LEDGER_FIELDS = {
    "date": LEDGER_DATE_KEYS,
    "currency": LEDGER_CURRENCY_KEYS,
    "amount": LEDGER_AMOUNT_KEYS,
    "fee": LEDGER_FEE_ASSET_KEYS,
    "countervalue": LEDGER_COUNTERVALUE_KEYS,
    "countervalue_ticker": LEDGER_COUNTERVALUE_TICKER_KEYS,
    "op_type": LEDGER_OP_TYPE_KEYS,
    "note": LEDGER_NOTE_KEYS,
    "price": LEDGER_PRICE_FALLBACK_KEYS,
}

NORMALIZED_COLUMNS = [
    "date_utc",
    "symbol",
    "qty",
    "price_eur",
    "fee_eur",
    "exchange",
    "note",
    "dedup_hash",
    "date_defaulted",
]


def resolve_fields(columns: list[str]) -> dict[str, str | None]:
    """Plan-time B2 resolution of every ledger field over normalised headers."""
    cols = [c for c in columns if c != SEQ]
    return {f: resolve_like(cols, keys) for f, keys in LEDGER_FIELDS.items()}


def _text(c: Column) -> Column:
    """``(value or "")``: NULL and empty both become the empty string."""
    return F.coalesce(c.cast(T.StringType()), F.lit(""))


def signed_qty(qty: Column, op_type: Column) -> Column:
    """Outflows negative, inflows positive, other types unchanged."""
    return (
        F.when(op_type.isin(OUTFLOW_TYPES), -F.abs(qty))
        .when(op_type.isin(INFLOW_TYPES), F.abs(qty))
        .otherwise(qty)
    )


def unit_price(qty: Column, ticker: Column, countervalue: Column, fallback: Column) -> Column:
    """``|countervalue| / |qty|`` for EUR countervalues, else the direct
    price column; the fallback also applies when the derived price is 0."""
    derived = F.when((ticker == EUR_TICKER) & (qty != 0), F.abs(countervalue) / F.abs(qty)).otherwise(
        F.lit(0.0)
    )
    return F.when(derived == 0.0, fallback).otherwise(derived)


def fee_eur(fee_asset: Column, price: Column) -> Column:
    """Fee in asset units times the unit price; 0 when there is no price."""
    return F.when(price != 0.0, fee_asset * price).otherwise(F.lit(0.0))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text of a UTC instant with ``+00:00``; microseconds only when
    non-zero (the ``isoformat`` convention).

    Built from the NTZ string cast (zone-independent, no formatter call).
    """
    return iso_of_text(ts.cast(T.StringType()))


def iso_of_text(txt: Column) -> Column:
    """``iso_utc`` from ``yyyy-MM-dd HH:mm:ss[.f…]`` (or with a ``T``): the
    fraction is padded to six digits, one of zeros is left out."""
    frac = F.rpad(F.substring(txt, 21, 6), 6, "0")
    return F.concat(
        F.substring(txt, 1, 10),
        F.lit("T"),
        F.substring(txt, 12, 8),
        F.when(F.length(txt) <= 19, F.lit("")).when(frac == "000000", F.lit("")).otherwise(F.concat(F.lit("."), frac)),
        F.lit("+00:00"),
    )


def _exponent_guess(x: Column) -> Column:
    finite = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))) & (x != 0)
    return F.floor(F.log2(F.when(finite, F.abs(x)))).cast("int")


def _scaled(x: Column, e: Column) -> Column:
    """``abs(x) * 2**(52 - e)``, exactly: in two halves, so that no factor overflows."""
    low = F.floor((F.lit(52) - e) / 2).cast("int")
    return F.abs(x) * F.pow(F.lit(2.0), low) * F.pow(F.lit(2.0), F.lit(52) - e - low)


def _exact_text(x: Column, guess: Column, scaled: Column) -> Column:
    """The text from the rounded logarithm and the number scaled by it: where
    that is off by one, mantissa and exponent are corrected by a factor of 2."""
    high, low = scaled >= 2.0**53, scaled < 2.0**52
    mantissa = F.when(high, scaled / 2).when(low, scaled * 2).otherwise(scaled)
    e = F.when(high, guess + 1).when(low, guess - 1).otherwise(guess)
    digits = F.concat(
        F.when(x < 0, F.lit("-")).otherwise(F.lit("")), mantissa.cast("long").cast("string"), F.lit("p"), e.cast("string")
    )
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .when(x == 0, F.lit("0"))
        .otherwise(digits)
    )


def double_text(x: Column) -> Column:
    """A text of its own for every double, the same in every engine.

    ``<53-bit mantissa>p<exponent>`` from exact scaling by powers of two;
    ``0`` for both zeros, ``nan``, ``inf`` and ``-inf``. NULL stays NULL. Wide
    projections compute the steps in successive selects (``with_double_texts``).
    """
    guess = _exponent_guess(x)
    return _exact_text(x, guess, _scaled(x, guess))


def with_double_texts(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``df`` with the ``double_text`` of each column under a new name, one step per projection."""
    guess = {c: _exponent_guess(F.col(c)) for c in names}
    step = {f"__g_{c}": guess[c] for c in names} | {f"__e_{c}": _scaled(F.col(c), guess[c]) for c in names}
    texts = {out: _exact_text(F.col(c), F.col(f"__g_{c}"), F.col(f"__e_{c}")) for c, out in names.items()}
    return df.withColumns(step).withColumns(texts).drop(*step)


def dedup_hash(iso: Column, symbol: Column, qty: Column, price: Column, fee: Column, note: Column) -> Column:
    """SHA-1 hex over ``iso|symbol|qty|price|fee|note``, all given as texts.

    A missing part is the empty string.
    """
    return F.sha1(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in (iso, symbol, qty, price, fee, note)]))


HASH_FORMS = {"python": with_python_texts, "exact": with_double_texts}


def normalize_ledger(raw: DataFrame, as_of: _dt.datetime | str, hash_form: str = "python") -> DataFrame:
    """B12 ``row_to_tx`` for a whole export: canonical transaction rows.

    ``hash_form`` chooses the texts of the numbers in ``dedup_hash``:
    ``python`` gives the hashes of tables filled by the original importer, so
    an export imported again finds its rows there; ``exact`` uses
    ``double_text``, which needs no float-to-text rules. Both tell different
    numbers apart; only ``python`` tells ``-0.0`` from ``0.0``.

    ``as_of`` replaces the clock for empty/unparseable dates; those rows are
    flagged in ``date_defaulted``. Price and fee stay DOUBLE here (they come
    from a division); ``to_store`` casts to the stored decimals. A ``_seq``
    column, if present, is passed through for last-write-wins de-duplication.

    The rules are layered in successive projections (texts and parsed
    numbers, then signed quantity, price and fee, then the hash). The rows are
    observed (their number) as they leave: a filter on the result stays above
    that, so it is never pushed down as a copy of the parsing expressions, while
    columns that a query does not use are still pruned. Dates of the usual shapes
    are cast; only others go through the ladder of regular expressions.
    """
    if hash_form not in HASH_FORMS:
        raise ValueError(f"hash_form {hash_form!r} is none of {', '.join(HASH_FORMS)}")
    compiled_methods(raw.sparkSession)
    df = normalize_headers(raw)
    f = resolve_fields(df.columns)
    col = {k: column_or_null(v) for k, v in f.items()}
    seq = [F.col(SEQ)] if SEQ in df.columns else []

    # Texts are stripped once here; the parsers below reference attributes,
    # since conditional branches are not shared by subexpression elimination.
    # Numbers and dates in the usual forms need no stripping and leave no text to carry on.
    numbers = {"__amount": "amount", "__cv": "countervalue", "__px": "price", "__fee": "fee"}
    usual = {n: decimal_value(col[k]) for n, k in numbers.items()}
    first_plain = plain_datetime_text(col["date"].cast(T.StringType()))
    p0 = df.select(
        *seq,
        first_plain.alias("__first"),
        F.when(first_plain.isNull(), ledger_date_text(col["date"])).alias("__d"),
        F.lower(strip_ws(_text(col["currency"]))).alias("symbol"),
        F.lower(strip_ws(_text(col["op_type"]))).alias("__op"),
        F.upper(strip_ws(_text(col["countervalue_ticker"]))).alias("__ticker"),
        *[usual[n].alias(f"{n}_usual") for n in numbers],
        *[F.when(usual[n].isNull(), strip_ws(col[k])).alias(n) for n, k in numbers.items()],
        F.when(_text(col["note"]) == "", F.lit("")).otherwise(col["note"]).alias("note"),
    )

    def num(name):
        return F.coalesce(F.col(f"{name}_usual"), checked_value(F.col(name)), F.lit(0.0))

    plain = F.coalesce(F.col("__first"), plain_datetime_text(F.col("__d")))
    p1 = p0.select(
        *seq,
        "__d",
        plain.alias("__plain"),
        # Whole seconds: the stored time; the fraction only goes into the hash.
        F.substring(plain, 1, 19).try_cast(T.TimestampNTZType()).alias("__cast"),
        "symbol",
        signed_qty(num("__amount"), F.col("__op")).alias("__signed"),
        "__ticker",
        num("__cv").alias("__cv"),
        num("__px").alias("__px"),
        num("__fee").alias("__fee"),
        "note",
    )
    is_cast = F.col("__cast").isNotNull()
    price = unit_price(F.col("__signed"), F.col("__ticker"), F.col("__cv"), F.col("__px"))
    p2 = p1.select(
        *seq,
        "__plain",
        "__cast",
        F.when(~is_cast, ledger_datetime_fields_text(F.coalesce("__d", "__plain"))).alias("__dp"),
        "symbol",
        "__signed",
        price.alias("price_eur"),
        fee_eur(F.col("__fee"), price).alias("fee_eur"),
        "note",
    )
    p3 = HASH_FORMS[hash_form](
        p2.withColumn("__dp", F.when(~is_cast, datetime_from_fields(F.col("__dp")))),
        {"__signed": "__qty", "price_eur": "__price", "fee_eur": "__fee"},
    )
    other = F.coalesce(F.col("__dp"), F.lit(str(as_of)).cast(T.TimestampNTZType()))
    text = F.when(is_cast, F.col("__plain")).otherwise(other.cast(T.StringType()))
    row = p3.select(
        *seq,
        F.when(is_cast, F.col("__cast")).otherwise(to_second(other)).alias("date_utc"),
        "symbol",
        # + 0.0: a signed zero (-abs(0.0)) becomes 0.0, as in a stored decimal.
        (F.col("__signed") + F.lit(0.0)).alias("qty"),
        "price_eur",
        "fee_eur",
        F.lit(LEDGER_EXCHANGE).alias("exchange"),
        "note",
        dedup_hash(
            iso_of_text(text), F.col("symbol"), F.col("__qty"), F.col("__price"), F.col("__fee"), F.col("note"),
        ).alias("dedup_hash"),
        (~is_cast & F.col("__dp").isNull()).alias("date_defaulted"),
    )
    return row.observe(f"ledger_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def to_store(tx: DataFrame) -> DataFrame:
    """Normalised rows in the stored ``transactions`` types (decimals may be
    NULL when a value does not fit; ``domain_split`` rejects those rows)."""
    return tx.select(
        *([F.col(SEQ)] if SEQ in tx.columns else []),
        "date_utc",
        "symbol",
        F.col("qty").try_cast("decimal(18,8)").alias("qty"),
        F.col("price_eur").try_cast("decimal(18,8)").alias("price_eur"),
        F.col("fee_eur").try_cast("decimal(18,8)").alias("fee_eur"),
        "exchange",
        "note",
        "dedup_hash",
    )


def last_write_wins(df: DataFrame, keys: list[str], seq: str = SEQ) -> DataFrame:
    """One row per key, the one with the greatest ``seq``.

    An aggregate (``max`` of a struct led by ``seq``), not a window: it is
    combined map-side, so a key repeated across a third of the input still
    ships one partial row per task.
    """
    others = [c for c in df.columns if c not in keys]
    packed = F.max(F.struct(F.col(seq).alias("__seq"), *[F.col(c) for c in others if c != seq]))
    agg = df.groupBy(*keys).agg(packed.alias("__w"), F.count(F.lit(1)).alias("n_rows"))
    return agg.select(*keys, *[F.col(f"__w.{c}").alias(c) for c in others if c != seq],
                      F.col("__w.__seq").alias(seq), "n_rows")


def infer_column_types(df: DataFrame) -> DataFrame:
    """Q1: inferred storage type per column over the whole table.

    ``date`` (case-insensitive name) -> DATE; every non-null value parses as
    a float -> DECIMAL(20,2) (an all-NULL column counts as numeric); else
    NVARCHAR(255). One aggregate with a ``bool_and`` per column.
    """
    aggs = []
    names = df.columns
    for i, c in enumerate(names):
        ok = F.col(f"`{c}`").isNull() | parse_float(F.col(f"`{c}`").cast("string")).isNotNull()
        aggs.append(F.coalesce(F.bool_and(ok), F.lit(True)).alias(f"n{i}"))
    flags = df.agg(*aggs)
    rows = []
    for i, c in enumerate(names):
        if c.strip().lower() == "date":
            t = F.lit("DATE")
        else:
            t = F.when(F.col(f"n{i}"), F.lit("DECIMAL(20,2)")).otherwise(F.lit("NVARCHAR(255)"))
        rows.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), t.alias("inferred_type")))
    return flags.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
