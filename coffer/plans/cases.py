"""Registered queries on hard inputs: the rules that clean test tables never reach."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from coffer.functions import names as NM
from coffer.functions.parse import parse_ledger_datetime, try_date
from coffer.operators import holdings as H
from coffer.operators import ledger as LG
from coffer.operators import positions as P
from coffer.operators import prices as PX
from coffer.operators import quality as QA
from coffer.operators import upsert as UP
from coffer.operators import valuation as V
from coffer.plans import oracle as O
from coffer.plans.catalog import (
    COINS,
    LEDGER_AS_OF,
    PR_L,
    REGISTRY,
    TX_C,
    TX_L,
    _L_NEW,
    _L_OLD,
    _LONG_C,
    _QUOTES_C,
    _TX_COLS,
    _domain_audit_sql,
    _domain_rules_sql,
    _ledger_rules,
    q_daily_valuation_wide,
    register,
)
from coffer.schemas import COINS_MAP_DEFAULT, TRANSACTIONS_KEY, TRANSACTIONS_UPDATE, sheet_columns
from coffer.session import scratch_folder
from coffer.sources import payloads as PL
from coffer.sources import testdata as TD

AS_OF_DAY = "1996-06-30"
HARD_SQL = O.ledger_normalize(TD.SQL_LEDGER_HARD, LEDGER_AS_OF)


def _hard(spark, sf):
    return LG.normalize_ledger(TD.ledger_hard(spark, sf), LEDGER_AS_OF, "exact")


@register(
    "ledger_hash_compat",
    f"SELECT _seq, dedup_hash FROM ({O.ledger_normalize(TD.SQL_LEDGER_HARD, LEDGER_AS_OF, 'python')})",
    "B11",
)
def q_ledger_hash_compat(spark, sf):
    """The hashes that tables filled by the original importer hold."""
    return LG.normalize_ledger(TD.ledger_hard(spark, sf), LEDGER_AS_OF).select("_seq", "dedup_hash")


@register("ledger_dates", f"SELECT _seq, date_utc, date_defaulted FROM ({HARD_SQL})", "B5 B12 B16")
def q_ledger_dates(spark, sf):
    return _hard(spark, sf).select("_seq", "date_utc", "date_defaulted")


@register("ledger_reimport", O.ledger_import_distinct(HARD_SQL), "B11 I6")
def q_ledger_reimport(spark, sf):
    d = LG.last_write_wins(_hard(spark, sf).select("_seq", "dedup_hash", "date_utc", "symbol", "note"), ["dedup_hash"])
    return d.select("dedup_hash", "date_utc", "symbol", "note", "_seq", "n_rows")


@register("domain_audit_hard", _domain_audit_sql(HARD_SQL), "Q3")
def q_domain_audit_hard(spark, sf):
    return QA.domain_audit(_hard(spark, sf), _ledger_rules())


def _rejects_sql() -> str:
    whens = " ".join(f"WHEN coalesce({p}, false) THEN '{r}'" for r, p in _domain_rules_sql())
    return f"""SELECT * FROM (
      SELECT _seq, CASE {whens} END AS reason, {O._double_text('qty')} AS qty, length(note) AS n_note FROM ({HARD_SQL}))
    WHERE reason IS NOT NULL"""


@register("domain_rejects", _rejects_sql(), "Q3")
def q_domain_rejects(spark, sf):
    """The rejected rows keep the value that was rejected."""
    rejected = QA.domain_split(_hard(spark, sf), _ledger_rules())[1]
    return rejected.select(
        "_seq", "reason", LG.double_text(F.col("qty")).alias("qty"), F.length("note").cast("long").alias("n_note")
    )


@register("domain_valid", f"""WITH r AS ({_rejects_sql()})
    SELECT _seq, dedup_hash FROM ({HARD_SQL}) WHERE _seq NOT IN (SELECT _seq FROM r)""", "Q3 I2")
def q_domain_valid(spark, sf):
    return LG.to_store(QA.domain_split(_hard(spark, sf), _ledger_rules())[0]).select("_seq", "dedup_hash")


@register("holdings_from_text", O.holdings(TD.SQL_TX_LINEITEM_TEXT, PR_L), "B13 E2 F5")
def q_holdings_from_text(spark, sf):
    return H.holdings_report(TD.tx_lineitem_text(spark, sf), TD.prices_lineitem(spark, sf))


@register(
    "try_dates",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(o_orderdate AS DATE)
       WHEN 5 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""",
    "B19",
)
def q_try_dates(spark, sf):
    return TD.order_date_texts(spark, sf).select("o_orderkey", try_date(F.col("text")).alias("day"))


@register("price_gaps_asof", O.gaps(TX_L, PR_L, AS_OF_DAY), "D4 E5 H6 H7")
def q_price_gaps_asof(spark, sf):
    return PX.price_gaps(TD.tx_lineitem(spark, sf), TD.prices_lineitem(spark, sf), AS_OF_DAY)[1]


@register(
    "null_audit_asof",
    O.null_audit(f"SELECT * FROM ({O.positions_long(TX_L, PR_L)}) WHERE date <= DATE '{AS_OF_DAY}'", "qty"),
    "D5 Q4 H4",
)
def q_null_audit_asof(spark, sf):
    pos = P.positions_asof(TD.tx_lineitem(spark, sf), TD.prices_lineitem(spark, sf))
    return QA.null_audit(pos, "qty", as_of=F.lit(AS_OF_DAY).cast("date"))


@register("main_view", O.daily_wide(_LONG_C, COINS), "J1 B17")
def q_main_view(spark, sf):
    wide = q_daily_valuation_wide(spark, sf)
    return V.main_view(V.to_storage(wide), [*sheet_columns(COINS), "no such label"])


@register(
    "schema_evolution",
    """SELECT n_nationkey, n_name, NULL::BIGINT AS r_regionkey, NULL::VARCHAR AS r_name FROM nation
       UNION ALL SELECT NULL, NULL, r_regionkey, r_name FROM region""",
    "Q7",
)
def q_schema_evolution(spark, sf):
    target = TD.table(spark, sf, "nation").select("n_nationkey", "n_name", F.col("n_nationkey").alias("index"))
    incoming = TD.table(spark, sf, "region").select("r_regionkey", "r_name")
    return QA.evolve_schema(target, incoming)


@register("latest_price_tied", O.latest_price(TD.SQL_TIED_PRICES), "E1")
def q_latest_price_tied(spark, sf):
    return PX.latest_price(TD.tied_prices(spark, sf))


@register("daily_close_tied", O.daily_close_paris(TD.SQL_TIED_PRICES), "F7 B14")
def q_daily_close_tied(spark, sf):
    return PX.daily_close_local(TD.tied_prices(spark, sf))


_SOME_QUOTES = f"SELECT * FROM ({_QUOTES_C}) WHERE coin_id NOT IN ('bitcoin', 'ethereum')"


@register("ids_without_some_quotes", O.ids_without_quote(TX_C, _SOME_QUOTES, COINS_MAP_DEFAULT), "E8 A5")
def q_ids_without_some_quotes(spark, sf):
    symbols = PX.symbol_universe(TD.tx_events(spark, sf, "coins"))
    landed = TD.simple_price_payloads(spark, sf)
    broken = F.regexp_replace(F.regexp_replace("json", "bitcoin.*", 'bitcoin":5}'), "ethereum.*", 'ethereum":{"eur":"no"}}')
    quotes = PL.parse_simple_price(landed.withColumn("json", broken))
    return PL.ids_without_quote(symbols, PL.parse_mapping(spark), quotes)


@register("positions_segmented", O.positions_long(TX_L, PR_L), "E4 G3 G6")
def q_positions_segmented(spark, sf):
    """``positions_asof`` without a task per symbol."""
    return P.positions_asof(TD.tx_lineitem(spark, sf), TD.prices_lineitem(spark, sf), segment_days=200)


@register("valuation_segmented", O.daily_long(TX_L, PR_L), "F6 F7 G1 G2 G4 G5 E3")
def q_valuation_segmented(spark, sf):
    return V.daily_valuation_long(TD.tx_lineitem(spark, sf), TD.prices_lineitem(spark, sf), segment_days=200)


@register(
    "positions_at_quotes",
    f"""WITH t AS (
      SELECT lower(symbol) AS symbol, date_utc, sum(coalesce(qty, 0)) AS q FROM ({TX_L}) GROUP BY ALL),
    c AS (SELECT symbol, date_utc, sum(q) OVER (PARTITION BY symbol ORDER BY date_utc) AS cum FROM t)
    SELECT p.ts, p.symbol, p.price_eur, CAST(c.cum AS DECIMAL(28,8)) AS qty
    FROM ({PR_L}) p ASOF LEFT JOIN c ON p.symbol = c.symbol AND p.ts >= c.date_utc""",
    "E4",
)
def q_positions_at_quotes(spark, sf):
    """The quantity held at the instant of each quote."""
    return P.positions_at(TD.tx_lineitem(spark, sf), TD.prices_lineitem(spark, sf))


@register(
    "holdings_rollup",
    f"""WITH h AS ({O.holdings(TX_L, PR_L)}),
    t AS (
      SELECT CAST(sum(investi) AS DECIMAL(28,8)) AS investi, CAST(sum(valeur_actuelle) AS DECIMAL(28,8)) AS valeur_actuelle,
        CAST(sum(pnl) AS DECIMAL(28,8)) AS pnl, count(*) AS n_symbols FROM h)
    SELECT 0 AS level, symbol, qty, investi, price_eur, valeur_actuelle, pnl, pnl_pct, CAST(1 AS BIGINT) AS n_symbols FROM h
    UNION ALL
    SELECT 1, NULL, NULL, investi, NULL, valeur_actuelle, pnl,
      CASE WHEN CAST(investi AS DOUBLE) = 0 THEN 0.0 ELSE CAST(pnl AS DOUBLE) / CAST(investi AS DOUBLE) * 100.0 END, n_symbols
    FROM t""",
    "F5 F9",
)
def q_holdings_rollup(spark, sf):
    return H.holdings_rollup(H.holdings_report(TD.tx_lineitem(spark, sf), TD.prices_lineitem(spark, sf)))


@register(
    "schema_reconcile",
    """SELECT CAST(o_orderkey % 1000 AS BIGINT) AS k, CAST(o_totalprice AS DECIMAL(14,4)) AS price,
         CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day, CAST(o_custkey AS VARCHAR) AS ref, o_orderstatus AS status, NULL AS priority
       FROM orders
       UNION ALL SELECT CAST(o_orderkey AS BIGINT), CAST(o_totalprice AS DECIMAL(14,4)), CAST(o_orderdate AS TIMESTAMP),
         o_orderpriority, NULL, o_orderpriority FROM orders""",
    "Q7 Q1",
)
def q_schema_reconcile(spark, sf):
    """Two loads of a table whose column types conflict."""
    orders = TD.table(spark, sf, "orders")
    stored = orders.select(
        (F.col("o_orderkey") % 1000).cast("int").alias("k"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("price"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_custkey").cast("long").alias("ref"),
        F.col("o_orderstatus").alias("status"),
    )
    incoming = orders.select(
        F.col("o_orderkey").cast("long").alias("k"),
        F.col("o_totalprice").cast("decimal(14,4)").alias("price"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("day"),
        F.col("o_orderpriority").alias("ref"),
        F.col("o_orderpriority").alias("priority"),
    )
    return QA.reconciled_union(stored, incoming)[0]


@register(
    "safe_names_chained",
    f"""WITH b AS (SELECT list(s_suppkey ORDER BY s_suppkey) AS ks, list({O.safe_base('name')} ORDER BY s_suppkey) AS bs FROM ({TD.SQL_CHAINED_NAMES})),
    r AS (
      SELECT ks, list_reduce(list_concat([[]::VARCHAR[]], list_transform(bs, lambda x: [x])), lambda acc, x: acc || [
        list_filter(list_transform(range(1, len(acc) + 2), lambda i: CASE WHEN i = 1 THEN x[1] ELSE x[1] || '_' || CAST(i AS VARCHAR) END),
                    lambda n: NOT list_contains(acc, n))[1]]) AS names FROM b)
    SELECT unnest(ks) AS s_suppkey, unnest(names) AS safe_name FROM r""",
    "B18",
)
def q_safe_names_chained(spark, sf):
    """Names of which some look like the numbered copy of another."""
    return NM.safe_names_col(TD.chained_names(spark, sf), "name", "s_suppkey").select("s_suppkey", "safe_name")


@register("ledger_week_dates", TD.SQL_WEEK_DATES, "B5")
def q_ledger_week_dates(spark, sf):
    return TD.week_texts(spark, sf).select("o_orderkey", parse_ledger_datetime(F.col("text")).alias("date_utc"))


@register("upsert_bucketed", REGISTRY["upsert_transactions"].oracle, "I1 I2 I6 I10")
def q_upsert_bucketed(spark, sf):
    """``upsert_transactions`` into a table stored in buckets of its key; both sides come from one staged parse."""
    root = scratch_folder(spark, "bucketed")
    norm = LG.normalize_ledger(TD.ledger_raw(spark, sf), LEDGER_AS_OF, "exact")
    norm.write.parquet(f"{root}/parsed")
    norm = spark.read.schema(norm.schema).parquet(f"{root}/parsed")
    target = norm.filter(F.col("date_utc") < F.lit(_L_OLD).cast("timestamp_ntz"))
    target = target.select(*_TX_COLS[:-1], F.col("date_utc").alias("created_at"))
    name = f"transactions_{uuid.uuid4().hex}"
    UP.write_bucketed(target, name, TRANSACTIONS_KEY, UP.bucket_count(spark, target.count()), f"{root}/table")
    source = norm.filter(F.col("date_utc") >= F.lit(_L_NEW).cast("timestamp_ntz"))
    return UP.bucketed_upsert(source, name, TRANSACTIONS_KEY, TRANSACTIONS_UPDATE, seq="_seq", now=LEDGER_AS_OF)
