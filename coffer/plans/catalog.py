"""Query catalogue: every registered query with its DuckDB oracle.

A query is a function ``(spark, sf_dir) -> DataFrame`` that reads the
driver's tables through an adapter (``coffer.sources.testdata``) and runs one
or more library operators on them, over the whole tables. ``oracle`` is the
independent DuckDB SQL for the same result (or None for operators that are
not expressible in SQL; those are tested against brute force in tests/).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from coffer.plans import oracle as O
from coffer.schemas import COINS_DEFAULT
from coffer.session import scratch_folder
from coffer.sources import testdata as TD


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    ids: str


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None, ids: str):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, oracle, ids)
        return fn

    return deco


# --- adapters' SQL shorthands -------------------------------------------------
TX_E = TD.sql_tx_events("u")
PR_E = TD.sql_prices_events("u")
TX_C = TD.sql_tx_events("coins")
PR_C = TD.sql_prices_events("coins")
TX_L = TD.SQL_TX_LINEITEM
PR_L = TD.SQL_PRICES_LINEITEM
COINS = COINS_DEFAULT

# --- valuation sheet -------------------------------------------------------------
from coffer.operators import valuation as V  # noqa: E402
from coffer.operators import positions as P  # noqa: E402
from coffer.operators import holdings as H  # noqa: E402


@register("daily_valuation_long", O.daily_long(TX_E, PR_E), "E9 H8 F6 F7 E3 G1 G2 G4 G5 C2 C6 C7 B14")
def q_daily_valuation_long(spark, sf):
    return V.daily_valuation_long(TD.tx_events(spark, sf), TD.prices_events(spark, sf))


@register("daily_valuation_long_l", O.daily_long(TX_L, PR_L), "E9 H8 F6 F7 E3 G1 G2 G4 G5 C2 C6 C7")
def q_daily_valuation_long_l(spark, sf):
    return V.daily_valuation_long(TD.tx_lineitem(spark, sf), TD.prices_lineitem(spark, sf))


_LONG_C = O.daily_long(TX_C, PR_C, COINS)


def _long_c(spark, sf):
    return V.daily_valuation_long(
        TD.tx_events(spark, sf, "coins"), TD.prices_events(spark, sf, "coins"), coins=COINS
    )


@register("daily_valuation_wide", O.daily_wide(_LONG_C, COINS), "F10 C8 D7")
def q_daily_valuation_wide(spark, sf):
    return V.daily_valuation_wide(_long_c(spark, sf), COINS)


@register("daily_totals", O.daily_totals(O.daily_long(TX_L, PR_L)), "C8 J3")
def q_daily_totals(spark, sf):
    return V.daily_totals(V.daily_valuation_long(TD.tx_lineitem(spark, sf), TD.prices_lineitem(spark, sf)))


@register("coin_view", O.coin_view(O.daily_wide(_LONG_C, COINS), "btc"), "J2 D7 H2")
def q_coin_view(spark, sf):
    return V.coin_view(V.daily_valuation_wide(_long_c(spark, sf), COINS), "btc")


@register("positions_asof", O.positions_long(TX_L, PR_L), "E4 G3 G6")
def q_positions_asof(spark, sf):
    return P.positions_asof(TD.tx_lineitem(spark, sf), TD.prices_lineitem(spark, sf))


@register(
    "positions_wide",
    O.positions_wide(O.positions_long(TX_C, PR_C, COINS), COINS),
    "J4 E4",
)
def q_positions_wide(spark, sf):
    long = P.positions_asof(
        TD.tx_events(spark, sf, "coins"), TD.prices_events(spark, sf, "coins"), coins=COINS
    )
    return P.positions_wide(long, COINS)


# --- holdings report ---------------------------------------------------------------


@register("holdings_report", O.holdings(TX_L, PR_L), "E1 E2 F5 C1 C3 C4 C5")
def q_holdings_report(spark, sf):
    return H.holdings_report(TD.tx_lineitem(spark, sf), TD.prices_lineitem(spark, sf))


@register("holdings_report_e", O.holdings(TX_E, PR_E), "E1 E2 F5 C1 C3 C4 C5")
def q_holdings_report_e(spark, sf):
    return H.holdings_report(TD.tx_events(spark, sf), TD.prices_events(spark, sf))


@register("portfolio_totals", O.portfolio_totals(O.holdings(TX_L, PR_L)), "F9")
def q_portfolio_totals(spark, sf):
    return H.portfolio_totals(H.holdings_report(TD.tx_lineitem(spark, sf), TD.prices_lineitem(spark, sf)))


@register("latest_price", O.latest_price(PR_E), "E1")
def q_latest_price(spark, sf):
    from coffer.operators.prices import latest_price

    return latest_price(TD.prices_events(spark, sf))


# --- ledger normalisation ----------------------------------------------------------
from coffer.operators import ledger as LG  # noqa: E402

LEDGER_AS_OF = "2026-01-01 00:00:00"  # stands in for the clock on unparseable dates
RAW_COLUMNS = [
    "_seq", "Operation Date", "Currency Ticker", "Operation Type", "Operation Amount",
    "Operation Fees", "Operation Hash", "Countervalue Ticker", "Countervalue at Operation Date",
]
_NORM_SQL = O.ledger_normalize(TD.SQL_LEDGER_RAW, LEDGER_AS_OF)


@register("ledger_normalize", _NORM_SQL, "B1 B2 B4 B5 B6 B7 B8 B9 B10 B11 B12 B16")
def q_ledger_normalize(spark, sf):
    return LG.normalize_ledger(TD.ledger_raw(spark, sf), LEDGER_AS_OF, "exact")


@register("ledger_import_distinct", O.ledger_import_distinct(_NORM_SQL), "B11")
def q_ledger_import_distinct(spark, sf):
    norm = LG.normalize_ledger(TD.ledger_raw(spark, sf), LEDGER_AS_OF, "exact")
    d = LG.last_write_wins(norm.select("_seq", "dedup_hash", "date_utc", "symbol", "note"), ["dedup_hash"])
    return d.select("dedup_hash", "date_utc", "symbol", "note", "_seq", "n_rows")


@register("infer_column_types", O.infer_types_raw(TD.SQL_LEDGER_RAW, RAW_COLUMNS), "Q1 H5")
def q_infer_column_types(spark, sf):
    return LG.infer_column_types(TD.ledger_raw(spark, sf))


# --- prices, gaps, payloads, mapping ------------------------------------------------
from coffer.operators import prices as PX  # noqa: E402
from coffer.schemas import COINS_MAP_DEFAULT  # noqa: E402
from coffer.sources import payloads as PL  # noqa: E402

_POINTS_U = O.chart_points(TD.SYMBOL_SQL["u"])
_POINTS_C = O.chart_points(TD.SYMBOL_SQL["coins"])
_GAPS_L = O.gaps(TX_L, PR_L)
_GAPS_E = O.gaps(TX_E, PR_E)
_QUOTES_C = O.simple_quotes(TD.SYMBOL_SQL["coins"], COINS_MAP_DEFAULT)


def _gaps(tx, pr):
    return PX.price_gaps(tx, pr)[1]


@register("daily_close_paris", O.daily_close_paris(PR_E), "F7 B14 D3")
def q_daily_close_paris(spark, sf):
    return PX.daily_close_local(TD.prices_events(spark, sf))


@register("daily_close_utc", O.daily_close_utc(_POINTS_C), "F8 B15 A4")
def q_daily_close_utc(spark, sf):
    pts = PL.parse_market_chart(TD.market_chart_payloads(spark, sf, "coins"))
    return PX.daily_close_utc(pts, ["_seq", "pos"])


@register("market_chart_points", O.market_chart_summary(_POINTS_C), "A4 F11")
def q_market_chart_points(spark, sf):
    return PX.points_per_symbol(PL.parse_market_chart(TD.market_chart_payloads(spark, sf, "coins")))


@register("price_gaps", _GAPS_L, "E5 H6 H7 F4 F2 E9")
def q_price_gaps(spark, sf):
    return _gaps(TD.tx_lineitem(spark, sf), TD.prices_lineitem(spark, sf))


@register("gap_ranges", O.gap_ranges(_GAPS_L), "H9")
def q_gap_ranges(spark, sf):
    return PX.gap_ranges(_gaps(TD.tx_lineitem(spark, sf), TD.prices_lineitem(spark, sf)))


@register("gap_report", O.gap_report(TX_L, _GAPS_L), "Q8")
def q_gap_report(spark, sf):
    return PX.gap_report(*PX.price_gaps(TD.tx_lineitem(spark, sf), TD.prices_lineitem(spark, sf)))


@register("backfill_points_kept", O.backfill_kept(_POINTS_U, _GAPS_E), "E6 F8 A4")
def q_backfill_points_kept(spark, sf):
    gaps = _gaps(TD.tx_events(spark, sf), TD.prices_events(spark, sf))
    pts = PL.parse_market_chart(TD.market_chart_payloads(spark, sf, "u"))
    return PX.backfill_points(pts, gaps, ["_seq", "pos"])


@register("symbol_universe", O.symbol_universe(TX_C), "F1 D1")
def q_symbol_universe(spark, sf):
    return PX.symbol_universe(TD.tx_events(spark, sf, "coins"))


@register("tx_span", O.tx_span(TX_L), "F2")
def q_tx_span(spark, sf):
    return PX.tx_span(TD.tx_lineitem(spark, sf))


@register("last_price_day", O.last_price_day(PR_L), "F3")
def q_last_price_day(spark, sf):
    return PX.last_price_day(TD.prices_lineitem(spark, sf))


@register("mapped_symbols", O.mapped_symbols(TX_C, COINS_MAP_DEFAULT), "A6 D2")
def q_mapped_symbols(spark, sf):
    return PL.mapped_symbols(PX.symbol_universe(TD.tx_events(spark, sf, "coins")), PL.parse_mapping(spark))


@register("unmapped_symbols", O.unmapped_symbols(TX_C, COINS_MAP_DEFAULT), "E8 A6")
def q_unmapped_symbols(spark, sf):
    return PL.unmapped_symbols(PX.symbol_universe(TD.tx_events(spark, sf, "coins")), PL.parse_mapping(spark))


def _latest_quotes(spark, sf):
    from pyspark.sql import functions as F

    from coffer.functions.timecols import to_second

    q = PL.parse_simple_price(TD.simple_price_payloads(spark, sf))
    best = F.max(F.struct("fetched_at", "_seq", "price_eur"))
    return q.groupBy("coin_id").agg(best.alias("b")).select(
        "coin_id",
        to_second(F.col("b.fetched_at")).alias("ts"),
        F.col("b.price_eur").alias("price_eur"),
    )


@register("quotes_joined", O.quotes_joined(TX_C, _QUOTES_C, COINS_MAP_DEFAULT), "A5 D6 E7 B16")
def q_quotes_joined(spark, sf):
    syms = PX.symbol_universe(TD.tx_events(spark, sf, "coins"))
    return PL.quotes_for_symbols(syms, PL.parse_mapping(spark), _latest_quotes(spark, sf)).select(
        "symbol", "coin_id", "ts", "price_eur"
    )


@register("ids_without_quote", O.ids_without_quote(TX_C, _QUOTES_C, COINS_MAP_DEFAULT), "E8 A5")
def q_ids_without_quote(spark, sf):
    syms = PX.symbol_universe(TD.tx_events(spark, sf, "coins"))
    quotes = PL.parse_simple_price(TD.simple_price_payloads(spark, sf))
    return PL.ids_without_quote(syms, PL.parse_mapping(spark), quotes)


# --- upserts --------------------------------------------------------------------------
from pyspark.sql import functions as F  # noqa: E402

from coffer.operators import quality as QA  # noqa: E402
from coffer.operators import upsert as UP  # noqa: E402
from coffer.schemas import (  # noqa: E402
    LEN_DEDUP_HASH, LEN_EXCHANGE, LEN_NOTE, LEN_SYMBOL, MONEY, PORTFOLIO_KEY, PORTFOLIO_UPDATE,
    PRICE_KEY, PRICE_UPDATE, TRANSACTIONS_KEY, TRANSACTIONS_UPDATE, sheet_columns,
)

RUN_TS = "2026-01-01 00:00:00"  # one run timestamp, as the report stamps every row
_TX_COLS = ["date_utc", "symbol", "qty", "price_eur", "fee_eur", "exchange", "note", "dedup_hash", "created_at"]
# Existing table = an earlier export, incoming batch = a later overlapping export.
_L_OLD, _L_NEW = "1998-01-01", "1997-01-01"
_E_OLD, _E_NEW = "2024-01-20", "2024-01-10"

_TX_TARGET_SQL = (
    f"SELECT date_utc, symbol, qty, price_eur, fee_eur, exchange, note, dedup_hash, date_utc AS created_at "
    f"FROM ({_NORM_SQL}) WHERE date_utc < TIMESTAMP '{_L_OLD}'"
)
_TX_SOURCE_SQL = f"SELECT * FROM ({_NORM_SQL}) WHERE date_utc >= TIMESTAMP '{_L_NEW}'"


@register(
    "upsert_transactions",
    O.upsert(_TX_TARGET_SQL, _TX_SOURCE_SQL, TRANSACTIONS_KEY, TRANSACTIONS_UPDATE, _TX_COLS, "_seq", LEDGER_AS_OF),
    "I1 I2 I6 I10",
)
def q_upsert_transactions(spark, sf):
    # parsed once, for the stored table as for the batch
    norm = LG.normalize_ledger(TD.ledger_raw(spark, sf), LEDGER_AS_OF, "exact")
    path = scratch_folder(spark, "parsed")
    norm.write.parquet(path)
    norm = spark.read.schema(norm.schema).parquet(path)
    target = norm.filter(F.col("date_utc") < F.lit(_L_OLD).cast("timestamp_ntz")).select(
        *_TX_COLS[:-1], F.col("date_utc").alias("created_at")
    )
    source = norm.filter(F.col("date_utc") >= F.lit(_L_NEW).cast("timestamp_ntz"))
    return UP.upsert(target, source, TRANSACTIONS_KEY, TRANSACTIONS_UPDATE, seq="_seq", now=LEDGER_AS_OF)


_PR_TARGET_SQL = f"SELECT ts, symbol, price_eur, ts AS created_at FROM ({PR_E}) WHERE ts < TIMESTAMP '{_E_OLD}'"
_PR_SOURCE_SQL = (
    f"SELECT ts, symbol, price_eur, event_id AS _seq FROM ({PR_E}) WHERE ts >= TIMESTAMP '{_E_NEW}' "
    f"UNION ALL SELECT ts, symbol, price_eur, -1 AS _seq FROM ({O.backfill_kept(_POINTS_U, _GAPS_E)})"
)


@register(
    "upsert_prices",
    O.upsert(_PR_TARGET_SQL, _PR_SOURCE_SQL, PRICE_KEY, PRICE_UPDATE, ["ts", "symbol", "price_eur", "created_at"],
             "_seq", RUN_TS),
    "I1 I3 I6 I10 E6",
)
def q_upsert_prices(spark, sf):
    pr = TD.prices_events(spark, sf)
    target = pr.filter(F.col("ts") < F.lit(_E_OLD).cast("timestamp_ntz")).select(
        "ts", "symbol", "price_eur", F.col("ts").alias("created_at")
    )
    fresh = pr.filter(F.col("ts") >= F.lit(_E_NEW).cast("timestamp_ntz")).select(
        "ts", "symbol", "price_eur", F.col("event_id").alias("_seq")
    )
    backfill = q_backfill_points_kept(spark, sf).select("ts", "symbol", "price_eur", F.lit(-1).cast("long").alias("_seq"))
    return UP.upsert(target, fresh.unionByName(backfill), PRICE_KEY, PRICE_UPDATE, seq="_seq", now=RUN_TS)


_TX_L_OLD = f"SELECT * FROM ({TX_L}) WHERE date_utc < TIMESTAMP '{_L_OLD}'"
_SNAP_COLS = ["ts", "symbol", "qty", "investi", "price_eur", "valeur_actuelle", "pnl_eur", "pnl_pct", "created_at"]


def _snapshot_sql(holdings_sql: str, created: bool) -> str:
    c = ", TIMESTAMP '{t}' AS created_at".format(t=RUN_TS) if created else ""
    return f"""SELECT TIMESTAMP '{RUN_TS}' AS ts, symbol,
      TRY_CAST(qty AS DECIMAL(18,8)) AS qty, TRY_CAST(investi AS DECIMAL(18,8)) AS investi,
      TRY_CAST(price_eur AS DECIMAL(18,8)) AS price_eur,
      TRY_CAST(valeur_actuelle AS DECIMAL(18,8)) AS valeur_actuelle,
      TRY_CAST(pnl AS DECIMAL(18,8)) AS pnl_eur, TRY_CAST(pnl_pct AS DECIMAL(10,4)) AS pnl_pct{c}
    FROM ({holdings_sql})"""


@register(
    "upsert_snapshot",
    O.upsert(_snapshot_sql(O.holdings(_TX_L_OLD, PR_L), True), _snapshot_sql(O.holdings(TX_L, PR_L), False),
             PORTFOLIO_KEY, PORTFOLIO_UPDATE, _SNAP_COLS, None, RUN_TS),
    "I1 I4 I10 C5",
)
def q_upsert_snapshot(spark, sf):
    tx = TD.tx_lineitem(spark, sf)
    pr = TD.prices_lineitem(spark, sf)
    old = H.holdings_report(tx.filter(F.col("date_utc") < F.lit(_L_OLD).cast("timestamp_ntz")), pr)
    target = H.portfolio_snapshot(old, RUN_TS).withColumn("created_at", F.lit(RUN_TS).cast("timestamp_ntz"))
    source = H.portfolio_snapshot(H.holdings_report(tx, pr), RUN_TS)
    return UP.upsert(target, source, PORTFOLIO_KEY, PORTFOLIO_UPDATE, now=RUN_TS)


_SHEET_COLS = sheet_columns(COINS)
_WIDE_OLD_SQL = O.daily_wide(O.daily_long(TX_C, PR_C, COINS, as_of="2024-01-20"), COINS)
_WIDE_NEW_SQL = O.daily_wide(_LONG_C, COINS)


@register(
    "upsert_sheet",
    O.upsert(_WIDE_OLD_SQL, _WIDE_NEW_SQL, ["date"], _SHEET_COLS[1:], _SHEET_COLS, None, None, None),
    "I1 I5 F10",
)
def q_upsert_sheet(spark, sf):
    tx = TD.tx_events(spark, sf, "coins")
    pr = TD.prices_events(spark, sf, "coins")
    old = V.daily_valuation_wide(V.daily_valuation_long(tx, pr, coins=COINS, as_of="2024-01-20"), COINS)
    new = V.daily_valuation_wide(V.daily_valuation_long(tx, pr, coins=COINS), COINS)
    merged = UP.upsert(old, new, ["date"], _SHEET_COLS[1:], created_col=None)
    return UP.fill_numeric_nulls(merged, _SHEET_COLS[1:])


# --- quality ----------------------------------------------------------------------------


@register("key_violations", O.key_violations(TX_L, ["date_utc", "symbol"]), "Q2")
def q_key_violations(spark, sf):
    return QA.key_violations(TD.tx_lineitem(spark, sf), ["date_utc", "symbol"])


def _ledger_rules():
    return QA.domain_rules(
        not_null=["date_utc", "symbol", "dedup_hash"],
        max_len={"symbol": LEN_SYMBOL, "exchange": LEN_EXCHANGE, "note": LEN_NOTE, "dedup_hash": LEN_DEDUP_HASH},
        decimals={"qty": MONEY, "price_eur": MONEY, "fee_eur": MONEY},
    )


def _domain_rules_sql() -> list[tuple[str, str]]:
    parts = []
    for c in ["date_utc", "symbol", "dedup_hash"]:
        parts.append((f"null:{c}", f"{c} IS NULL"))
    for c, n in [("symbol", LEN_SYMBOL), ("exchange", LEN_EXCHANGE), ("note", LEN_NOTE), ("dedup_hash", LEN_DEDUP_HASH)]:
        parts.append((f"length:{c}>{n}", f"length({c}) > {n}"))
    for c in ["qty", "price_eur", "fee_eur"]:
        parts.append((f"decimal:{c}", f"{c} IS NOT NULL AND TRY_CAST({c} AS DECIMAL(18,8)) IS NULL"))
    return parts


def _domain_audit_sql(norm_sql: str = _NORM_SQL) -> str:
    sel = " UNION ALL ".join(
        f"SELECT '{r}' AS reason, count(*) FILTER (WHERE coalesce({p}, false)) AS n_rejected, count(*) AS n_rows FROM n"
        for r, p in _domain_rules_sql()
    )
    return f"WITH n AS ({norm_sql}) {sel}"


@register("domain_audit", _domain_audit_sql(), "Q3")
def q_domain_audit(spark, sf):
    return QA.domain_audit(LG.normalize_ledger(TD.ledger_raw(spark, sf), LEDGER_AS_OF, "exact"), _ledger_rules())


@register("null_audit", O.null_audit(O.positions_long(TX_L, PR_L), "qty"), "Q4 H4")
def q_null_audit(spark, sf):
    return QA.null_audit(P.positions_asof(TD.tx_lineitem(spark, sf), TD.prices_lineitem(spark, sf)), "qty")


_POS_WIDE_C = O.positions_wide(O.positions_long(TX_C, PR_C, COINS), COINS)


@register(
    "null_fill",
    "SELECT date, " + ", ".join(f"CAST(coalesce(qty_{c}, 0) AS DECIMAL(28,8)) AS qty_{c}" for c in COINS)
    + f" FROM ({_POS_WIDE_C})",
    "Q5",
)
def q_null_fill(spark, sf):
    return QA.fill_nulls(q_positions_wide(spark, sf), [f"qty_{c}" for c in COINS])


@register(
    "series_tail",
    f'SELECT date, "btc valeur" FROM ({O.coin_view(O.daily_wide(_LONG_C, COINS), "btc")}) ORDER BY date DESC LIMIT 10',
    "H3 H2 Q6",
)
def q_series_tail(spark, sf):
    from coffer.functions.names import find_value_column

    view = q_coin_view(spark, sf)
    return V.series_tail(view, find_value_column(view.columns, "btc"), 10)


# --- names --------------------------------------------------------------------------------
from coffer.functions import names as NM  # noqa: E402


@register(
    "normalized_names",
    f"SELECT p_partkey, {O.normalize_name('p_name')} AS name_norm, {O.normalize_name('p_type')} AS type_norm FROM part",
    "B17",
)
def q_normalized_names(spark, sf):
    part = TD.table(spark, sf, "part")
    return part.select(
        "p_partkey",
        NM.normalize_name_col(F.col("p_name")).alias("name_norm"),
        NM.normalize_name_col(F.col("p_type")).alias("type_norm"),
    )


@register(
    "safe_names",
    f"""SELECT p_partkey, CASE WHEN rn = 1 THEN base ELSE base || '_' || CAST(rn AS VARCHAR) END AS safe_name
    FROM (SELECT p_partkey, {O.safe_base('p_brand')} AS base,
                 row_number() OVER (PARTITION BY {O.safe_base('p_brand')} ORDER BY p_partkey) AS rn FROM part)""",
    "B18",
)
def q_safe_names(spark, sf):
    part = TD.table(spark, sf, "part").select("p_partkey", "p_brand")
    return NM.safe_names_col(part, "p_brand", "p_partkey").select("p_partkey", "safe_name")


from coffer.plans import cases  # noqa: E402, F401  (registers its queries)
