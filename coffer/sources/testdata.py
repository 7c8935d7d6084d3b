"""Adapters from the driver's test tables to ledger-shaped inputs.

The test tables hold no portfolio data. These functions only map their rows
into the schemas the operators expect (transactions, price points, a raw
all-string ledger export, JSON price payloads); they do none of the
operators' work. Each Spark adapter has a DuckDB twin (the ``sql_*``
functions and ``SQL_*`` strings below) so the oracle queries read exactly the
same rows.

Adapters
  * E  — ``events``: transactions from purchase/signup/error events, price
         points from view events, extra "fetched" points from click events.
  * L  — ``lineitem ⨝ part (⨝ orders)``: brands as symbols, ship dates as
         transaction times, per-day maximum retail price as quotes.
  * raw ledger — ``lineitem ⨝ part`` rendered as an all-string CSV-like
         export with mixed date formats and an occasional bad amount.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.schemas import COINS_DEFAULT, MONEY

# Symbol schemes for the events adapter. ``u``: 25 symbols u0..u24.
# ``coins``: the sheet's coins plus two that have no provider mapping.
COIN_SYMBOLS = COINS_DEFAULT + ["matic", "link"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, as scanned."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_symbol(scheme: str) -> Column:
    if scheme == "u":
        return F.concat(F.lit("u"), (F.col("user_id") % 25).cast("string"))
    if scheme == "coins":
        arr = F.array(*[F.lit(s) for s in COIN_SYMBOLS])
        return F.element_at(arr, (F.col("user_id") % len(COIN_SYMBOLS)).cast("int") + 1)
    raise ValueError(scheme)


def tx_events(spark: SparkSession, sf_dir: str, scheme: str = "u") -> DataFrame:
    """Adapter E transactions: event_id, date_utc, symbol, qty, price_eur, fee_eur."""
    ev = table(spark, sf_dir, "events")
    sign = F.when(F.col("event_type") == "error", F.lit(-1)).otherwise(F.lit(1))
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.filter(F.col("event_type").isin("purchase", "signup", "error")).select(
        "event_id",
        F.col("ts").alias("date_utc"),
        _event_symbol(scheme).alias("symbol"),
        (sign * k).cast(MONEY).alias("qty"),
        F.col("value").cast(MONEY).alias("price_eur"),
        (F.col("value").cast("decimal(18,2)") * F.lit(0.01).cast("decimal(4,2)"))
        .cast(MONEY)
        .alias("fee_eur"),
    )


def prices_events(
    spark: SparkSession, sf_dir: str, scheme: str = "u", event_type: str = "view"
) -> DataFrame:
    """Adapter E price points: event_id, ts, symbol, price_eur."""
    ev = table(spark, sf_dir, "events")
    return ev.filter(F.col("event_type") == event_type).select(
        "event_id",
        "ts",
        _event_symbol(scheme).alias("symbol"),
        F.col("value").cast(MONEY).alias("price_eur"),
    )


def tx_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter L transactions: date_utc, symbol, qty, price_eur, fee_eur."""
    li = table(spark, sf_dir, "lineitem")
    pa = table(spark, sf_dir, "part")
    qty = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return li.join(pa, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_shipdate").alias("date_utc"),
        F.lower("p_brand").alias("symbol"),
        qty.cast(MONEY).alias("qty"),
        F.col("p_retailprice").cast(MONEY).alias("price_eur"),
        (F.col("l_tax").cast("decimal(4,2)") * F.col("l_quantity").cast("decimal(8,2)"))
        .cast(MONEY)
        .alias("fee_eur"),
    )


def prices_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter L quotes: ts (order date), symbol (brand), max retail price."""
    li = table(spark, sf_dir, "lineitem")
    pa = table(spark, sf_dir, "part")
    od = table(spark, sf_dir, "orders")
    return (
        li.join(pa, F.col("l_partkey") == F.col("p_partkey"))
        .join(od, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_orderdate").alias("ts"), F.lower("p_brand").alias("symbol"))
        .agg(F.max("p_retailprice").cast(MONEY).alias("price_eur"))
    )


def ledger_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string ledger export with headers as a ledger app writes them.

    ``_seq`` is the export's line order (order key, line number).
    """
    # NTZ -> text without the session zone: the string cast of an NTZ value
    # is "yyyy-MM-dd HH:mm:ss" (ship dates carry no fraction).
    li = table(spark, sf_dir, "lineitem").withColumn("__shipdate", F.col("l_shipdate").cast("string"))
    pa = table(spark, sf_dir, "part")
    txt = F.col("__shipdate")
    ymd, hms = F.substring(txt, 1, 10), F.substring(txt, 12, 8)
    dmy = F.concat(F.substring(txt, 9, 2), F.lit("/"), F.substring(txt, 6, 2), F.lit("/"), F.substring(txt, 1, 4))
    date_s = (
        F.when(F.col("l_linenumber") % 4 == 0, F.concat(ymd, F.lit("T"), hms, F.lit(".000Z")))
        .when(F.col("l_linenumber") % 4 == 1, F.concat(ymd, F.lit(" "), hms))
        .when(F.col("l_linenumber") % 4 == 2, F.concat(dmy, F.lit(" "), F.substring(txt, 12, 5)))
        .otherwise(ymd)
    )
    op = (
        F.when(F.col("l_returnflag") == "R", "OUT")
        .when(F.col("l_returnflag") == "A", "IN")
        .otherwise("FEES")
    )
    amount = F.when(F.col("l_orderkey") % 97 == 0, F.lit("n/a")).otherwise(
        F.col("l_quantity").cast("string")
    )
    joined = li.join(pa, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("_seq"),
        date_s.alias("Operation Date"),
        F.upper("p_brand").alias("Currency Ticker"),
        op.alias("Operation Type"),
        amount.alias("Operation Amount"),
        F.col("l_tax").cast("string").alias("Operation Fees"),
        F.concat(
            F.lit("h"), F.col("l_orderkey").cast("string"), F.lit("-"),
            F.col("l_linenumber").cast("string"),
        ).alias("Operation Hash"),
        F.when(F.col("l_suppkey") % 10 == 0, "USD").otherwise("EUR").alias("Countervalue Ticker"),
        F.col("l_extendedprice").cast("string").alias("Countervalue at Operation Date"),
    )


def market_chart_payloads(spark: SparkSession, sf_dir: str, scheme: str = "coins") -> DataFrame:
    """Market-chart JSON payloads, one per click event: symbol, _seq, json.

    ``{"prices": [[epoch_ms, price]]}`` — the shape of the provider payload;
    ``_seq`` is the landing order.
    """
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "click")
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("ts"))
    point = F.array(F.floor(micros / 1000).cast("double"), F.col("value"))
    return ev.select(
        _event_symbol(scheme).alias("symbol"),
        F.col("event_id").alias("_seq"),
        F.to_json(F.struct(F.array(point).alias("prices"))).alias("json"),
    )


def simple_price_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current-price JSON payloads, one per view event: _seq, json.

    ``{"<provider id>": {"eur": price}}`` with the provider id of the event's
    coin taken from the default mapping string; unmapped coins produce an
    entry without ``eur``.
    """
    from coffer.schemas import COINS_MAP_DEFAULT

    pairs = dict(p.split(":") for p in COINS_MAP_DEFAULT.split(","))
    ids = F.create_map(*[x for s, i in pairs.items() for x in (F.lit(s), F.lit(i))])
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    sym = _event_symbol("coins")
    cid = F.coalesce(F.element_at(ids, sym), sym)
    inner = F.when(F.element_at(ids, sym).isNotNull(), F.to_json(F.struct(F.col("value").alias("eur")))).otherwise(
        F.lit("{}")
    )
    js = F.concat(F.lit('{"'), cid, F.lit('":'), inner, F.lit("}"))
    return ev.select(F.col("event_id").alias("_seq"), F.col("ts").alias("fetched_at"), js.alias("json"))


#: What ``ledger_hard`` puts in place of dates, by order key modulo a prime.
HARD_DATES = {
    101: "",
    103: "2024-02-30 10:00:00",
    107: "2024-03-31T01:30:00.250+02:00",
    109: "2024-03-31 01:30:00.5",
    113: "31/12/2023 23:59:58",
    127: "20240131T101500-0330",
}
HARD_AMOUNTS = {83: "nan", 89: "1e15", 97: " -1_0.5 "}


def ledger_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw ledger with defaulted, invalid, offset and fractional dates, numbers that no
    stored type holds, overlong notes, and a later re-export of a part of its lines."""
    raw = ledger_raw(spark, sf_dir)
    k = F.expr("_seq div 8")

    def put(cases: dict[int, str], otherwise: str) -> Column:
        out = F.col(f"`{otherwise}`")
        for m, v in reversed(cases.items()):
            out = F.when(k % m == 0, F.lit(v)).otherwise(out)
        return out.alias(otherwise)

    note = F.when(k % 79 == 0, F.repeat("Operation Hash", F.lit(100))).otherwise(F.col("Operation Hash"))
    hard = raw.withColumns(
        {
            "Operation Date": put(HARD_DATES, "Operation Date"),
            "Operation Amount": put(HARD_AMOUNTS, "Operation Amount"),
            "Operation Hash": note,
        }
    )
    again = hard.filter(k % 7 == 0).withColumn("_seq", F.col("_seq") + F.lit(1 << 40))
    return hard.unionByName(again)


def tx_lineitem_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter L transactions with numbers as texts: padded, and some no numbers."""
    tx = tx_lineitem(spark, sf_dir)

    def text(c: str) -> Column:
        t = F.concat(F.lit(" "), F.col(c).cast("string"), F.lit(" "))
        return F.when(F.col("price_eur") > 1900, F.lit("n/a")).when(F.col("price_eur") > 1800, F.lit(None)).otherwise(t).alias(c)

    return tx.select("date_utc", "symbol", *[text(c) for c in ("qty", "price_eur", "fee_eur")])


def order_date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and its date as a text of one of several forms, some invalid."""
    day = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    form = F.col("o_orderkey") % 6
    text = (
        F.when(form == 0, day)
        .when(form == 1, F.concat(day, F.lit(" 13:14:15")))
        .when(form == 2, F.concat(F.substring(day, 1, 5), F.lit("02-30")))
        .when(form == 3, F.lit("soon"))
        .when(form == 4, F.lit(None).cast("string"))
        .otherwise(F.concat(day, F.lit("T23:59:59.5")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))


def tied_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter L quotes with times cut to the month, so several have the same."""
    pr = prices_lineitem(spark, sf_dir)
    return pr.select(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("ts"), "symbol", "price_eur")


# ---------------------------------------------------------------------------
# DuckDB twins of the adapters (used inside ``oracle_sql`` strings).
# ---------------------------------------------------------------------------

_COINS_SQL = "[" + ", ".join(f"'{s}'" for s in COIN_SYMBOLS) + "]"

SYMBOL_SQL = {
    "u": "concat('u', CAST(user_id % 25 AS VARCHAR))",
    "coins": f"{_COINS_SQL}[CAST(user_id % {len(COIN_SYMBOLS)} AS INTEGER) + 1]",
}


def sql_tx_events(scheme: str = "u") -> str:
    return f"""
    SELECT event_id, ts AS date_utc, {SYMBOL_SQL[scheme]} AS symbol,
      CAST((CASE WHEN event_type = 'error' THEN -1 ELSE 1 END)
           * CAST(json_extract_string(props, '$.k') AS INTEGER) AS DECIMAL(18,8)) AS qty,
      CAST(value AS DECIMAL(18,8)) AS price_eur,
      CAST(CAST(value AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(18,8)) AS fee_eur
    FROM events WHERE event_type IN ('purchase', 'signup', 'error')"""


def sql_prices_events(scheme: str = "u", event_type: str = "view") -> str:
    return f"""
    SELECT event_id, ts, {SYMBOL_SQL[scheme]} AS symbol,
      CAST(value AS DECIMAL(18,8)) AS price_eur
    FROM events WHERE event_type = '{event_type}'"""


SQL_TX_LINEITEM = """
    SELECT l_shipdate AS date_utc, lower(p_brand) AS symbol,
      CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS DECIMAL(18,8)) AS qty,
      CAST(p_retailprice AS DECIMAL(18,8)) AS price_eur,
      CAST(CAST(l_tax AS DECIMAL(4,2)) * CAST(l_quantity AS DECIMAL(8,2)) AS DECIMAL(18,8)) AS fee_eur
    FROM lineitem JOIN part ON l_partkey = p_partkey"""

SQL_PRICES_LINEITEM = """
    SELECT o_orderdate AS ts, lower(p_brand) AS symbol,
      CAST(max(p_retailprice) AS DECIMAL(18,8)) AS price_eur
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
    GROUP BY o_orderdate, lower(p_brand)"""

SQL_LEDGER_RAW = """
    SELECT l_orderkey * 8 + l_linenumber AS _seq,
      CASE l_linenumber % 4
        WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.000Z')
        WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')
        WHEN 2 THEN strftime(l_shipdate, '%d/%m/%Y %H:%M')
        ELSE strftime(l_shipdate, '%Y-%m-%d') END AS "Operation Date",
      upper(p_brand) AS "Currency Ticker",
      CASE l_returnflag WHEN 'R' THEN 'OUT' WHEN 'A' THEN 'IN' ELSE 'FEES' END AS "Operation Type",
      CASE WHEN l_orderkey % 97 = 0 THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS "Operation Amount",
      CAST(l_tax AS VARCHAR) AS "Operation Fees",
      concat('h', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS "Operation Hash",
      CASE WHEN l_suppkey % 10 = 0 THEN 'USD' ELSE 'EUR' END AS "Countervalue Ticker",
      CAST(l_extendedprice AS VARCHAR) AS "Countervalue at Operation Date"
    FROM lineitem JOIN part ON l_partkey = p_partkey"""


def _sql_cases(cases: dict[int, str], otherwise: str) -> str:
    whens = " ".join(f"WHEN (_seq // 8) % {m} = 0 THEN '{v}'" for m, v in cases.items())
    return f'CASE {whens} ELSE "{otherwise}" END AS "{otherwise}"'


_HARD = f"""
    SELECT * REPLACE (
      {_sql_cases(HARD_DATES, "Operation Date")},
      {_sql_cases(HARD_AMOUNTS, "Operation Amount")},
      CASE WHEN (_seq // 8) % 79 = 0 THEN repeat("Operation Hash", 100) ELSE "Operation Hash" END AS "Operation Hash")
    FROM ({SQL_LEDGER_RAW})"""
SQL_LEDGER_HARD = f"""{_HARD}
    UNION ALL SELECT * REPLACE (_seq + {1 << 40} AS _seq) FROM ({_HARD}) WHERE (_seq // 8) % 7 = 0"""

_NO_NUMBER = "CASE WHEN price_eur > 1800 THEN 0 ELSE {c} END"
SQL_TX_LINEITEM_TEXT = "SELECT date_utc, symbol, " + ", ".join(
    f"CAST({_NO_NUMBER.format(c=c)} AS DECIMAL(18,8)) AS {c}" for c in ("qty", "price_eur", "fee_eur")
) + f" FROM ({SQL_TX_LINEITEM})"

SQL_TIED_PRICES = f"SELECT date_trunc('month', ts) AS ts, symbol, price_eur FROM ({SQL_PRICES_LINEITEM})"


def week_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and o_orderdate as an ISO week date, in the four forms there are."""
    d = F.col("o_orderdate").cast("date")
    year, week = F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lpad(F.weekofyear(d).cast("string"), 2, "0")
    day = (F.weekday(d) + 1).cast("string")
    form = F.col("o_orderkey") % 4
    text = (
        F.when(form == 0, F.concat(year, F.lit("-W"), week, F.lit("-"), day))
        .when(form == 1, F.concat(year, F.lit("W"), week, day, F.lit("T10:30:00Z")))
        .when(form == 2, F.concat(year, F.lit("-W"), week))
        .otherwise(F.concat(F.lit(" "), year, F.lit("W"), week, F.lit("T0930+0100")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))


SQL_WEEK_DATES = """SELECT o_orderkey, CASE o_orderkey % 4
      WHEN 0 THEN date_trunc('day', o_orderdate)
      WHEN 1 THEN date_trunc('day', o_orderdate) + INTERVAL '10 hours 30 minutes'
      WHEN 2 THEN date_trunc('week', o_orderdate)
      ELSE date_trunc('week', o_orderdate) + INTERVAL '8 hours 30 minutes' END::TIMESTAMP AS date_utc
    FROM orders"""


def chained_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s_suppkey and a name from its keys, some of which end like a numbered copy."""
    n, k = F.col("s_nationkey").cast("string"), F.col("s_suppkey")
    own = F.when(k % 4 == 0, F.concat(F.lit("_"), (k % 9 + 2).cast("string"))).otherwise(F.lit(""))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("n"), F.substring(n, 1, 1), own).alias("name"))


SQL_CHAINED_NAMES = """SELECT s_suppkey, 'n' || CAST(s_nationkey AS VARCHAR)[1]
      || CASE WHEN s_suppkey % 4 = 0 THEN '_' || CAST(s_suppkey % 9 + 2 AS VARCHAR) ELSE '' END AS name FROM supplier"""
