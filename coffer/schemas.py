"""Target schemas, keys and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the values of the system being replaced,
# because results (column labels, alias resolution, signs, mappings) depend
# on them. Kept together, in their original order, as plain text.
# ---------------------------------------------------------------------------

# Coins of the daily valuation sheet, in sheet order.
COINS_DEFAULT = ["btc", "eth", "avax", "dot", "ada", "sol", "xrp"]

# Default symbol -> price-provider id mapping string.
COINS_MAP_DEFAULT = (
    "btc:bitcoin,eth:ethereum,sol:solana,ada:cardano,"
    "avax:avalanche-2,dot:polkadot,xrp:ripple"
)

# Ledger CSV header aliases, per field, in match-priority order.
LEDGER_DATE_KEYS = ["date", "operation date", "datetime", "time", "timestamp"]
LEDGER_CURRENCY_KEYS = ["currency", "currency ticker", "asset", "symbol", "ticker"]
LEDGER_AMOUNT_KEYS = [
    "operation amount",
    "amount",
    "amount (asset)",
    "quantity",
    "qty",
    "value",
]
LEDGER_FEE_ASSET_KEYS = ["operation fees", "network fee", "fee", "fees"]
LEDGER_COUNTERVALUE_KEYS = [
    "countervalue at operation date",
    "countervalue",
    "countervalue at csv export",
]
LEDGER_COUNTERVALUE_TICKER_KEYS = ["countervalue ticker", "fiat", "fiat ticker"]
LEDGER_OP_TYPE_KEYS = ["operation type", "type"]
LEDGER_NOTE_KEYS = [
    "operation hash",
    "hash",
    "tx hash",
    "txid",
    "operation id",
    "id",
    "memo",
    "note",
    "type",
]
LEDGER_PRICE_FALLBACK_KEYS = [
    "price eur",
    "price (eur)",
    "spot price eur",
    "spot price (eur)",
    "eur price",
    "eur/price",
    "price",
]

# Operation types that force the sign of the quantity.
OUTFLOW_TYPES = ["out", "send", "withdrawal", "withdraw", "sell"]
INFLOW_TYPES = ["in", "receive", "deposit", "buy"]

# Exchange label written on every imported ledger row.
LEDGER_EXCHANGE = "ledger"

# Countervalue ticker that allows deriving a unit price.
EUR_TICKER = "EUR"

# Calendar time zone of the valuation sheet.
SHEET_TZ = "Europe/Paris"

# Column-name normalisation: accent replacements, then one correction.
NAME_ACCENT_REPLACEMENTS = [
    ("é", "e"),
    ("è", "e"),
    ("ê", "e"),
    ("à", "a"),
    ("ù", "u"),
    ("ç", "c"),
    ("œ", "oe"),
]
NAME_CORRECTIONS = [("avx", "avax")]

# Sheet labels. Per coin ``c`` (lower case) and ``C`` (upper case):
SHEET_COIN_LABELS = [
    "{c} acheté",
    "{c} valeur",
    "{c} gain perte",
    "{c} acheté cumul",
    "{c} valeur cumul",
]
SHEET_TAIL_LABELS = ["acheté {C}", "Valeur {C}"]
SHEET_TOTAL_LABELS = ["total acheté", "total valeur", "total gain perte"]

# Default number of offending dates listed per symbol by the NULL audit.
NULL_AUDIT_SAMPLE = 5

# Declared string length limits (NVARCHAR(n)) of the stored tables.
LEN_SYMBOL = 20
LEN_EXCHANGE = 50
LEN_NOTE = 500
LEN_DEDUP_HASH = 40

# ---------------------------------------------------------------------------
# Declared types
# ---------------------------------------------------------------------------

MONEY = T.DecimalType(18, 8)
MONEY_SUM = T.DecimalType(28, 8)
SHEET_NUM = T.DecimalType(20, 2)
PCT = T.DecimalType(10, 4)

TRANSACTIONS = T.StructType(
    [
        T.StructField("date_utc", T.TimestampNTZType(), False),
        T.StructField("symbol", T.StringType(), False),
        T.StructField("qty", MONEY, False),
        T.StructField("price_eur", MONEY, False),
        T.StructField("fee_eur", MONEY, False),
        T.StructField("exchange", T.StringType(), True),
        T.StructField("note", T.StringType(), True),
        T.StructField("dedup_hash", T.StringType(), False),
        T.StructField("created_at", T.TimestampNTZType(), True),
    ]
)
TRANSACTIONS_KEY = ["dedup_hash"]
TRANSACTIONS_UPDATE = ["qty", "price_eur", "fee_eur", "exchange", "note"]

PRICE_SNAPSHOT = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("symbol", T.StringType(), False),
        T.StructField("price_eur", MONEY, False),
        T.StructField("created_at", T.TimestampNTZType(), True),
    ]
)
PRICE_KEY = ["ts", "symbol"]
PRICE_UPDATE = ["price_eur"]

PORTFOLIO_SNAPSHOT = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("symbol", T.StringType(), False),
        T.StructField("qty", MONEY, False),
        T.StructField("investi", MONEY, False),
        T.StructField("price_eur", MONEY, False),
        T.StructField("valeur_actuelle", MONEY, False),
        T.StructField("pnl_eur", MONEY, False),
        T.StructField("pnl_pct", PCT, False),
        T.StructField("created_at", T.TimestampNTZType(), True),
    ]
)
PORTFOLIO_KEY = ["ts", "symbol"]
PORTFOLIO_UPDATE = ["qty", "investi", "price_eur", "valeur_actuelle", "pnl_eur", "pnl_pct"]

# Market-chart payload: {"prices": [[epoch_ms, price], ...]}. Points are read
# as text so that one malformed point does not null the whole array.
MARKET_CHART_JSON = "prices array<array<string>>"


def sheet_columns(coins: list[str]) -> list[str]:
    """Wide sheet column order: date, per-coin blocks, tail blocks, totals."""
    head = [lbl.format(c=c) for c in coins for lbl in SHEET_COIN_LABELS]
    tail = [lbl.format(C=c.upper()) for c in coins for lbl in SHEET_TAIL_LABELS]
    return ["date"] + head + tail + list(SHEET_TOTAL_LABELS)
