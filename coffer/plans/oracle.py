"""DuckDB SQL twins of the operators, used as the independent oracle.

Each function returns a SQL string over the pre-registered driver views.
They are written from the operators' specifications, not generated from the
Spark plans, and use DuckDB idioms (ASOF-free windows, ``generate_series``).
Products of DECIMAL(18,8) operands are widened to DECIMAL(20,8) first:
DuckDB keeps the product of two 18-digit decimals at 18 digits and overflows.
"""

from __future__ import annotations

from collections.abc import Sequence

from coffer.schemas import SHEET_COIN_LABELS, SHEET_TAIL_LABELS, SHEET_TOTAL_LABELS, SHEET_TZ


def local_day(expr: str, tz: str = SHEET_TZ) -> str:
    return f"CAST(({expr} AT TIME ZONE 'UTC') AT TIME ZONE '{tz}' AS DATE)"


def _in_list(values: Sequence[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def bounds_ctes(tx: str = "t", pr: str | None = "q", as_of: str | None = None) -> str:
    """CTE ``bounds(start_d, end_d)``: first local tx day, last local day seen."""
    end = "(SELECT max(date) FROM {tx})".format(tx=tx)
    if as_of:
        end = f"DATE '{as_of}'"
    elif pr:
        end = f"greatest({end}, coalesce((SELECT max(date) FROM {pr}), {end}))"
    return f"bounds AS (SELECT (SELECT min(date) FROM {tx}) AS start_d, {end} AS end_d)"


def spine_cte(syms: str) -> str:
    return f"""spine AS (
      SELECT s.symbol, CAST(unnest(generate_series(CAST(b.start_d AS TIMESTAMP),
             CAST(b.end_d AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date
      FROM {syms} s, bounds b)"""


def daily_long(tx_sql: str, pr_sql: str, coins: Sequence[str] | None = None, as_of: str | None = None) -> str:
    """Long daily valuation over transactions ``tx_sql`` and quotes ``pr_sql``."""
    coin_tx = f"WHERE symbol IN {_in_list(coins)}" if coins else ""
    syms = (
        "(SELECT unnest([" + ", ".join(f"'{c}'" for c in coins) + "]) AS symbol)"
        if coins
        else "(SELECT DISTINCT symbol FROM t)"
    )
    return f"""
WITH t0 AS ({tx_sql}),
t AS (
  SELECT lower(symbol) AS symbol, {local_day('date_utc')} AS date,
         coalesce(qty, 0) AS qty, coalesce(price_eur, 0) AS price_eur, coalesce(fee_eur, 0) AS fee_eur
  FROM t0),
q0 AS ({pr_sql}),
q AS (SELECT lower(symbol) AS symbol, ts, price_eur, {local_day('ts')} AS date
      FROM q0 WHERE price_eur IS NOT NULL),
{bounds_ctes('t', 'q', as_of)},
{spine_cte(syms)},
fl AS (
  SELECT symbol, date,
         sum(greatest(CAST(qty AS DECIMAL(20,8)), 0) * CAST(price_eur AS DECIMAL(20,8)) + fee_eur) AS buy,
         sum(qty) AS qty
  FROM t {coin_tx} GROUP BY symbol, date),
cl AS (
  SELECT symbol, date, price_eur AS close FROM (
    SELECT symbol, date, price_eur,
           row_number() OVER (PARTITION BY symbol, date ORDER BY ts DESC, price_eur DESC) AS rn
    FROM q) WHERE rn = 1),
d AS (
  SELECT sp.symbol, sp.date, fl.buy, fl.qty, cl.close
  FROM spine sp LEFT JOIN fl ON fl.symbol = sp.symbol AND fl.date = sp.date
                LEFT JOIN cl ON cl.symbol = sp.symbol AND cl.date = sp.date),
r AS (
  SELECT date, symbol,
    CAST(coalesce(buy, 0) AS DECIMAL(28,8)) AS bought,
    CAST(sum(coalesce(buy, 0)) OVER w AS DECIMAL(28,8)) AS bought_cum,
    CAST(sum(coalesce(qty, 0)) OVER w AS DECIMAL(28,8)) AS qty_cum,
    CAST(coalesce(last_value(close IGNORE NULLS) OVER w,
                  first_value(close IGNORE NULLS) OVER wf) AS DECIMAL(18,8)) AS price_eur
  FROM d
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         wf AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
v AS (
  SELECT date, symbol, bought, bought_cum, qty_cum, price_eur,
    CAST(CAST(qty_cum AS DECIMAL(24,8)) * CAST(coalesce(price_eur, 0) AS DECIMAL(18,8)) AS DECIMAL(28,8)) AS value
  FROM r)
SELECT date, symbol, bought, bought_cum, qty_cum, price_eur, value,
       CAST(value - bought_cum AS DECIMAL(28,8)) AS gain
FROM v"""


def daily_totals(long_sql: str) -> str:
    return f"""
SELECT date,
  CAST(sum(bought_cum) AS DECIMAL(28,8)) AS total_bought,
  CAST(sum(value) AS DECIMAL(28,8)) AS total_value,
  CAST(sum(value) - sum(bought_cum) AS DECIMAL(28,8)) AS total_gain
FROM ({long_sql}) GROUP BY date"""


def _q(label: str) -> str:
    return '"' + label.replace('"', '""') + '"'


def _num(expr: str) -> str:
    return f"coalesce(CAST({expr} AS DECIMAL(20,2)), CAST(0 AS DECIMAL(20,2)))"


def daily_wide(long_sql: str, coins: Sequence[str]) -> str:
    cols = ["date"]
    for c in coins:
        lbl = [x.format(c=c) for x in SHEET_COIN_LABELS]
        b = f"sum(CASE WHEN symbol = '{c}' THEN bought END)"
        v = f"sum(CASE WHEN symbol = '{c}' THEN value END)"
        g = f"sum(CASE WHEN symbol = '{c}' THEN gain END)"
        bc = f"sum(CASE WHEN symbol = '{c}' THEN bought_cum END)"
        for expr, name in zip((b, v, g, bc, v), lbl):
            cols.append(f"{_num(expr)} AS {_q(name)}")
    for c in coins:
        lbl = [x.format(C=c.upper()) for x in SHEET_TAIL_LABELS]
        bc = f"sum(CASE WHEN symbol = '{c}' THEN bought_cum END)"
        v = f"sum(CASE WHEN symbol = '{c}' THEN value END)"
        cols.append(f"{_num(bc)} AS {_q(lbl[0])}")
        cols.append(f"{_num(v)} AS {_q(lbl[1])}")
    cols.append(f"{_num('sum(bought_cum)')} AS {_q(SHEET_TOTAL_LABELS[0])}")
    cols.append(f"{_num('sum(value)')} AS {_q(SHEET_TOTAL_LABELS[1])}")
    cols.append(f"{_num('sum(value) - sum(bought_cum)')} AS {_q(SHEET_TOTAL_LABELS[2])}")
    return (
        "SELECT " + ",\n  ".join(cols)
        + f"\nFROM ({long_sql}) WHERE symbol IN {_in_list(coins)} GROUP BY date"
    )


def coin_view(wide_sql: str, coin: str) -> str:
    labels = [x.format(c=coin) for x in SHEET_COIN_LABELS] + [
        x.format(C=coin.upper()) for x in SHEET_TAIL_LABELS
    ]
    return "SELECT date, " + ", ".join(_q(x) for x in labels) + f" FROM ({wide_sql})"


def positions_long(tx_sql: str, pr_sql: str | None, coins: Sequence[str] | None = None) -> str:
    """As-of positions with a correlated-free ASOF JOIN over cumulated days."""
    coin_tx = f"WHERE symbol IN {_in_list(coins)}" if coins else ""
    syms = (
        "(SELECT unnest([" + ", ".join(f"'{c}'" for c in coins) + "]) AS symbol)"
        if coins
        else "(SELECT DISTINCT symbol FROM t)"
    )
    pr_ctes = ""
    if pr_sql:
        pr_ctes = f"""q0 AS ({pr_sql}),
q AS (SELECT {local_day('ts')} AS date FROM q0 WHERE price_eur IS NOT NULL),"""
    return f"""
WITH t0 AS ({tx_sql}),
t AS (SELECT lower(symbol) AS symbol, {local_day('date_utc')} AS date, qty FROM t0),
{pr_ctes}
{bounds_ctes('t', 'q' if pr_sql else None)},
{spine_cte(syms)},
agg AS (SELECT symbol, date, sum(coalesce(qty, 0)) AS qty_day FROM t {coin_tx} GROUP BY symbol, date),
cum AS (SELECT symbol, date,
          sum(qty_day) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS qty_cum
        FROM agg)
SELECT sp.date, sp.symbol, CAST(cum.qty_cum AS DECIMAL(28,8)) AS qty
FROM spine sp ASOF LEFT JOIN cum ON sp.symbol = cum.symbol AND sp.date >= cum.date"""


def positions_wide(long_sql: str, coins: Sequence[str]) -> str:
    cols = ", ".join(f"max(CASE WHEN symbol = '{c}' THEN qty END) AS qty_{c}" for c in coins)
    return f"SELECT date, {cols} FROM ({long_sql}) WHERE symbol IN {_in_list(coins)} GROUP BY date"


def latest_price(pr_sql: str) -> str:
    return f"""
SELECT symbol, ts, CAST(price_eur AS DECIMAL(18,8)) AS price_eur FROM (
  SELECT lower(symbol) AS symbol, ts, price_eur,
         row_number() OVER (PARTITION BY lower(symbol) ORDER BY ts DESC, price_eur DESC) AS rn
  FROM ({pr_sql}) WHERE price_eur IS NOT NULL) WHERE rn = 1"""


def holdings(tx_sql: str, pr_sql: str) -> str:
    return f"""
WITH t AS (
  SELECT lower(symbol) AS symbol, coalesce(qty, 0) AS qty,
         coalesce(price_eur, 0) AS price_eur, coalesce(fee_eur, 0) AS fee_eur
  FROM ({tx_sql})),
a AS (
  SELECT symbol, CAST(sum(qty) AS DECIMAL(28,8)) AS qty,
         CAST(sum(abs(CAST(qty AS DECIMAL(20,8))) * CAST(price_eur AS DECIMAL(20,8)) + fee_eur)
              AS DECIMAL(28,8)) AS investi
  FROM t GROUP BY symbol),
l AS ({latest_price(pr_sql)}),
h AS (
  SELECT a.symbol, a.qty, a.investi, coalesce(l.price_eur, CAST(0 AS DECIMAL(18,8))) AS price_eur
  FROM a LEFT JOIN l ON a.symbol = l.symbol),
v AS (
  SELECT *, CAST(CAST(qty AS DECIMAL(24,8)) * price_eur AS DECIMAL(28,8)) AS valeur_actuelle FROM h)
SELECT symbol, qty, investi, price_eur, valeur_actuelle,
       CAST(valeur_actuelle - investi AS DECIMAL(28,8)) AS pnl,
       CASE WHEN CAST(investi AS DOUBLE) = 0 THEN 0.0
            ELSE CAST(CAST(valeur_actuelle - investi AS DECIMAL(28,8)) AS DOUBLE)
                 / CAST(investi AS DOUBLE) * 100.0 END AS pnl_pct
FROM v"""


def portfolio_totals(holdings_sql: str) -> str:
    return f"""
SELECT CAST(sum(investi) AS DECIMAL(28,8)) AS total_investi,
       CAST(sum(valeur_actuelle) AS DECIMAL(28,8)) AS total_valeur,
       CAST(sum(pnl) AS DECIMAL(28,8)) AS total_pnl,
       count(*) AS n_symbols
FROM ({holdings_sql})"""


# --- ledger -------------------------------------------------------------------

FLOAT_RE = r"[+-]?(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?"


def to_float(expr: str, default: str = "0.0") -> str:
    s = f"regexp_replace(coalesce(CAST({expr} AS VARCHAR), ''), '^\\s+|\\s+$', '', 'g')"
    return f"""coalesce(CASE
      WHEN regexp_full_match({s}, '{FLOAT_RE}') THEN TRY_CAST(replace({s}, '_', '') AS DOUBLE)
      WHEN regexp_full_match({s}, '(?i)[+-]?nan') THEN CAST('nan' AS DOUBLE)
      WHEN regexp_full_match({s}, '(?i)[+]?inf(?:inity)?') THEN CAST('inf' AS DOUBLE)
      WHEN regexp_full_match({s}, '(?i)-inf(?:inity)?') THEN CAST('-inf' AS DOUBLE) END, {default})"""


def parse_dt(expr: str) -> str:
    s = f"replace(regexp_replace(coalesce(CAST({expr} AS VARCHAR), ''), '^\\s+|\\s+$', '', 'g'), 'Z', '')"
    n2 = r"(\d{1,2})"
    fmts = [
        (rf"(?i)(\d{{4}})-{n2}-{n2}T{n2}:{n2}:{n2}", (1, 2, 3, 4, 5, 6)),
        (rf"(\d{{4}})-{n2}-{n2}\s+{n2}:{n2}:{n2}", (1, 2, 3, 4, 5, 6)),
        (rf"{n2}/{n2}/(\d{{4}})\s+{n2}:{n2}", (3, 2, 1, 4, 5, None)),
        (rf"{n2}/{n2}/(\d{{4}})\s+{n2}:{n2}:{n2}", (3, 2, 1, 4, 5, 6)),
    ]
    cands = []
    for pat, g in fmts:
        def e(i, pat=pat):
            return "0" if i is None else f"CAST(regexp_extract({s}, '{pat}', {i}) AS INTEGER)"
        y, mo, d, h, mi, sec = (e(i) for i in g)
        cands.append(
            f"CASE WHEN regexp_full_match({s}, '{pat}') AND {h} < 24 AND {mi} < 60 AND {sec} < 60 "
            f"THEN try(make_timestamp({y}, {mo}, {d}, {h}, {mi}, {sec})) END"
        )
    # ISO fallback: DuckDB's own ISO cast of the extended form, then the offset.
    iso = rf"regexp_replace({s}, '^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})', '\1-\2-\3T\4:\5:\6')"
    off = r"([+-])(\d{2}):?(\d{2})$"
    cands.append(
        f"CASE WHEN regexp_full_match({iso}, '\\d{{4}}-\\d{{2}}-\\d{{2}}[Tt ]\\d{{2}}:\\d{{2}}:\\d{{2}}(?:[.,]\\d+)?[+-]\\d{{2}}:?\\d{{2}}') "
        f"THEN TRY_CAST(regexp_replace({iso}, '{off}', '') AS TIMESTAMP) - to_minutes(CAST(regexp_extract({iso}, '{off}', 1) || '1' AS INTEGER) "
        f"* (60 * CAST(regexp_extract({iso}, '{off}', 2) AS INTEGER) + CAST(regexp_extract({iso}, '{off}', 3) AS INTEGER))) END"
    )
    cands.append(
        f"CASE WHEN regexp_full_match({s}, '\\d{{4}}-\\d{{2}}-\\d{{2}}(?:[Tt ]\\d{{2}}(?::\\d{{2}}(?::\\d{{2}}(?:[.,]\\d+)?)?)?)?') "
        f"THEN TRY_CAST({s} AS TIMESTAMP) END"
    )
    return "coalesce(" + ", ".join(cands) + ")"


def _double_text(x: str) -> str:
    """Exact mantissa and exponent of a double (DuckDB scales by powers of two exactly)."""
    def scaled(e: str) -> str:
        low = f"CAST(floor((52 - ({e})) / 2.0) AS INTEGER)"
        return f"(abs({x}) * pow(2.0, {low}) * pow(2.0, 52 - ({e}) - {low}))"

    guess = f"CAST(floor(log2(abs({x}))) AS INTEGER)"
    e = f"(CASE WHEN {scaled(guess)} >= pow(2.0, 53) THEN {guess} + 1 WHEN {scaled(guess)} < pow(2.0, 52) THEN {guess} - 1 ELSE {guess} END)"
    return (
        f"CASE WHEN isnan({x}) THEN 'nan' WHEN isinf({x}) THEN CASE WHEN {x} > 0 THEN 'inf' ELSE '-inf' END "
        f"WHEN {x} = 0 THEN '0' ELSE (CASE WHEN {x} < 0 THEN '-' ELSE '' END) || CAST(CAST({scaled(e)} AS BIGINT) AS VARCHAR) "
        f"|| 'p' || CAST({e} AS VARCHAR) END"
    )


def ledger_normalize(raw_sql: str, as_of: str, hash_form: str = "exact") -> str:
    """Hard-wired to the raw adapter's headers (the Spark side resolves them).

    DuckDB writes a double in Python's form (but for the sign of a NaN), so ``python`` is a cast."""
    text = _double_text if hash_form == "exact" else lambda x: f"CASE WHEN isnan({x}) THEN 'nan' ELSE CAST({x} AS VARCHAR) END"
    return f"""
WITH r AS ({raw_sql}),
a AS (
  SELECT _seq, {parse_dt('"Operation Date"')} AS parsed,
    lower(trim(coalesce("Currency Ticker", ''))) AS symbol,
    lower(trim(coalesce("Operation Type", ''))) AS op,
    {to_float('"Operation Amount"')} AS q0,
    upper(trim(coalesce("Countervalue Ticker", ''))) AS ticker,
    {to_float('"Countervalue at Operation Date"')} AS cv,
    {to_float('"Operation Fees"')} AS fee_asset,
    coalesce("Operation Hash", '') AS note
  FROM r),
b AS (
  SELECT *, coalesce(parsed, TIMESTAMP '{as_of}') AS dt,
    CASE WHEN op IN ('out', 'send', 'withdrawal', 'withdraw', 'sell') THEN -abs(q0)
         WHEN op IN ('in', 'receive', 'deposit', 'buy') THEN abs(q0) ELSE q0 END AS signed, signed + 0.0 AS qty
  FROM a),
c AS (
  SELECT *, CASE WHEN ticker = 'EUR' AND qty <> 0 THEN abs(cv) / abs(qty) ELSE 0.0 END AS p0 FROM b),
d AS (SELECT *, CASE WHEN p0 = 0.0 THEN 0.0 ELSE p0 END AS price_eur FROM c),
e AS (SELECT *, CASE WHEN price_eur <> 0.0 THEN fee_asset * price_eur ELSE 0.0 END AS fee_eur FROM d)
SELECT _seq, date_trunc('second', dt) AS date_utc, symbol, qty, price_eur, fee_eur,
  'ledger' AS exchange, note,
  sha1(concat_ws('|',
    strftime(dt, '%Y-%m-%dT%H:%M:%S')
      || CASE WHEN microsecond(dt) % 1000000 <> 0
              THEN '.' || lpad(CAST(microsecond(dt) % 1000000 AS VARCHAR), 6, '0') ELSE '' END
      || '+00:00',
    symbol,
    coalesce({text('signed')}, ''),
    coalesce({text('price_eur')}, ''),
    coalesce({text('fee_eur')}, ''),
    note)) AS dedup_hash,
  parsed IS NULL AS date_defaulted
FROM e"""


def ledger_import_distinct(norm_sql: str) -> str:
    return f"""
SELECT dedup_hash, arg_max(date_utc, _seq) AS date_utc, arg_max(symbol, _seq) AS symbol,
       arg_max(note, _seq) AS note, max(_seq) AS _seq, count(*) AS n_rows
FROM ({norm_sql}) GROUP BY dedup_hash"""


def infer_types_raw(raw_sql: str, columns: Sequence[str]) -> str:
    parts = []
    for i, c in enumerate(columns):
        q = _q(c)
        if c.strip().lower() == "date":
            t = "'DATE'"
        else:
            s = f"regexp_replace(CAST({q} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"
            ok = (
                f"({q} IS NULL OR regexp_full_match({s}, '{FLOAT_RE}') "
                f"OR regexp_full_match({s}, '(?i)[+-]?(?:nan|inf|infinity)'))"
            )
            t = f"CASE WHEN coalesce(bool_and({ok}), true) THEN 'DECIMAL(20,2)' ELSE 'NVARCHAR(255)' END"
        parts.append(f"SELECT {i} AS position, '{c}' AS column_name, (SELECT {t} FROM r) AS inferred_type")
    return f"WITH r AS ({raw_sql})\n" + "\nUNION ALL\n".join(parts)


# --- prices, gaps, payloads ---------------------------------------------------------


def daily_close_paris(pr_sql: str) -> str:
    return f"""
SELECT symbol, date, CAST(price_eur AS DECIMAL(18,8)) AS price_eur FROM (
  SELECT lower(symbol) AS symbol, {local_day('ts')} AS date, price_eur,
         row_number() OVER (PARTITION BY lower(symbol), {local_day('ts')}
                            ORDER BY ts DESC, price_eur DESC) AS rn
  FROM ({pr_sql}) WHERE price_eur IS NOT NULL) WHERE rn = 1"""


def chart_points(scheme_symbol_sql: str) -> str:
    """Market-chart points of the click payloads, derived without JSON."""
    return f"""
SELECT {scheme_symbol_sql} AS symbol, event_id AS _seq, 0 AS pos,
       make_timestamp((epoch_us(ts) // 1000) * 1000) AS ts,
       CAST(value AS DECIMAL(18,8)) AS price_eur
FROM events WHERE event_type = 'click'"""


def daily_close_utc(points_sql: str) -> str:
    return f"""
SELECT symbol, date, ts, price_eur FROM (
  SELECT lower(symbol) AS symbol, CAST(ts AS DATE) AS date, ts, price_eur,
         row_number() OVER (PARTITION BY lower(symbol), CAST(ts AS DATE)
                            ORDER BY _seq DESC, pos DESC) AS rn
  FROM ({points_sql}) WHERE price_eur IS NOT NULL) WHERE rn = 1"""


def market_chart_summary(points_sql: str) -> str:
    return f"""
SELECT lower(symbol) AS symbol, count(*) AS n_points, min(ts) AS first_ts, max(ts) AS last_ts
FROM ({points_sql}) GROUP BY lower(symbol)"""


def gaps(tx_sql: str, pr_sql: str, as_of: str | None = None) -> str:
    """Missing UTC price days per transaction symbol, first tx day .. ``as_of`` or the last day seen."""
    last = (
        f"DATE '{as_of}'"
        if as_of
        else """greatest((SELECT max(date) FROM t),
                           coalesce((SELECT max(CAST(ts AS DATE)) FROM q), (SELECT max(date) FROM t)))"""
    )
    return f"""
WITH t AS (SELECT lower(symbol) AS symbol, CAST(date_utc AS DATE) AS date FROM ({tx_sql})),
q AS (SELECT lower(symbol) AS symbol, ts FROM ({pr_sql})),
bounds AS (SELECT (SELECT min(date) FROM t) AS start_d, {last} AS end_d),
{spine_cte('(SELECT DISTINCT symbol FROM t)')},
have AS (SELECT DISTINCT q.symbol, CAST(q.ts AS DATE) AS date FROM q, bounds b
         WHERE q.ts >= CAST(b.start_d AS TIMESTAMP) AND q.ts < CAST(b.end_d + 1 AS TIMESTAMP))
SELECT sp.symbol, sp.date FROM spine sp
WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.symbol = sp.symbol AND h.date = sp.date)"""


def gap_ranges(gaps_sql: str) -> str:
    return f"""
SELECT symbol, min(date) AS from_day, CAST(max(date) + 1 AS DATE) AS to_day_excl, count(*) AS n_missing
FROM ({gaps_sql}) GROUP BY symbol"""


def gap_report(tx_sql: str, gaps_sql: str) -> str:
    return f"""
WITH s AS (SELECT DISTINCT lower(symbol) AS symbol FROM ({tx_sql})),
r AS ({gap_ranges(gaps_sql)})
SELECT s.symbol, CAST(coalesce(r.n_missing, 0) AS BIGINT) AS n_missing, r.from_day, r.to_day_excl,
       CASE WHEN r.n_missing IS NULL THEN 'complete' ELSE 'missing' END AS status
FROM s LEFT JOIN r ON s.symbol = r.symbol"""


def backfill_kept(points_sql: str, gaps_sql: str) -> str:
    return f"""
SELECT d.* FROM ({daily_close_utc(points_sql)}) d
WHERE EXISTS (SELECT 1 FROM ({gaps_sql}) g WHERE g.symbol = d.symbol AND g.date = d.date)"""


def symbol_universe(tx_sql: str) -> str:
    return f"SELECT DISTINCT lower(symbol) AS symbol FROM ({tx_sql}) WHERE length(lower(symbol)) > 0"


def tx_span(tx_sql: str) -> str:
    return f"SELECT min(date_utc) AS first_date_utc, max(date_utc) AS last_date_utc FROM ({tx_sql})"


def last_price_day(pr_sql: str) -> str:
    return f"SELECT lower(symbol) AS symbol, max(CAST(ts AS DATE)) AS last_day FROM ({pr_sql}) GROUP BY 1"


def mapping(mapping_str: str) -> str:
    return f"""
SELECT symbol, arg_max(coin_id, pos) AS coin_id FROM (
  SELECT trim(split_part(pair, ':', 1)) AS symbol,
         trim(substr(pair, strpos(pair, ':') + 1)) AS coin_id, pos
  FROM (SELECT unnest(string_split('{mapping_str}', ',')) AS pair,
               generate_subscripts(string_split('{mapping_str}', ','), 1) AS pos)
  WHERE strpos(pair, ':') > 0) GROUP BY symbol"""


def mapped_symbols(tx_sql: str, mapping_str: str) -> str:
    return f"""
SELECT s.symbol, m.coin_id FROM ({symbol_universe(tx_sql)}) s JOIN ({mapping(mapping_str)}) m
ON s.symbol = m.symbol"""


def unmapped_symbols(tx_sql: str, mapping_str: str) -> str:
    return f"""
SELECT s.symbol FROM ({symbol_universe(tx_sql)}) s
WHERE NOT EXISTS (SELECT 1 FROM ({mapping(mapping_str)}) m WHERE m.symbol = s.symbol)"""


def simple_quotes(scheme_symbol_sql: str, mapping_str: str) -> str:
    """Current-price quotes of the view payloads, derived without JSON."""
    return f"""
SELECT event_id AS _seq, ts AS fetched_at, m.coin_id, CAST(value AS DECIMAL(18,8)) AS price_eur
FROM events e JOIN ({mapping(mapping_str)}) m ON m.symbol = {scheme_symbol_sql}
WHERE event_type = 'view'"""


def quotes_joined(tx_sql: str, quotes_sql: str, mapping_str: str) -> str:
    return f"""
WITH lq AS (
  SELECT coin_id, price_eur, date_trunc('second', fetched_at) AS ts FROM (
    SELECT *, row_number() OVER (PARTITION BY coin_id ORDER BY fetched_at DESC, _seq DESC) AS rn
    FROM ({quotes_sql})) WHERE rn = 1)
SELECT ms.symbol, ms.coin_id, lq.ts, lq.price_eur
FROM ({mapped_symbols(tx_sql, mapping_str)}) ms JOIN lq ON lq.coin_id = ms.coin_id"""


def ids_without_quote(tx_sql: str, quotes_sql: str, mapping_str: str) -> str:
    return f"""
SELECT DISTINCT coin_id FROM ({mapped_symbols(tx_sql, mapping_str)}) ms
WHERE NOT EXISTS (SELECT 1 FROM ({quotes_sql}) q WHERE q.coin_id = ms.coin_id)"""


# --- upserts, quality, names ----------------------------------------------------------


def upsert(
    target_sql: str,
    source_sql: str,
    keys: Sequence[str],
    update_cols: Sequence[str],
    columns: Sequence[str],
    seq: str | None = None,
    now: str | None = None,
    created_col: str | None = "created_at",
) -> str:
    part = ", ".join(_q(k) for k in keys)
    src = f"SELECT * FROM ({source_sql})"
    if seq:
        src = f"""SELECT * EXCLUDE (__rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {_q(seq)} DESC) AS __rn
      FROM ({source_sql})) WHERE __rn = 1"""
    on = " AND ".join(f"t.{_q(k)} = s.{_q(k)}" for k in keys)
    sel = []
    for c in columns:
        qc = _q(c)
        if c in keys:
            e = f"CASE WHEN t.__thit THEN t.{qc} ELSE s.{qc} END"
        elif c in update_cols:
            e = f"CASE WHEN s.__shit THEN s.{qc} ELSE t.{qc} END"
        elif created_col and c == created_col and now:
            e = f"CASE WHEN t.__thit THEN t.{qc} ELSE TIMESTAMP '{now}' END"
        else:
            e = f"CASE WHEN t.__thit THEN t.{qc} ELSE s.{qc} END"
        sel.append(f"{e} AS {qc}")
    sel.append(
        "CASE WHEN t.__thit AND s.__shit THEN 'updated' WHEN t.__thit THEN 'kept' ELSE 'inserted' END AS _action"
    )
    return f"""
WITH t AS (SELECT *, true AS __thit FROM ({target_sql})),
s AS (SELECT *, true AS __shit FROM ({src}))
SELECT {", ".join(sel)}
FROM t FULL OUTER JOIN s ON {on}"""


def key_violations(sql: str, keys: Sequence[str]) -> str:
    k = ", ".join(keys)
    return f"SELECT {k}, count(*) AS n FROM ({sql}) GROUP BY {k} HAVING count(*) > 1"


def null_audit(sql: str, value_col: str, group_col: str = "symbol", sample: int = 5) -> str:
    return f"""
WITH d AS (SELECT * FROM ({sql})),
c AS (SELECT {group_col}, count(*) FILTER (WHERE {value_col} IS NULL) AS n_null FROM d GROUP BY {group_col}),
s AS (SELECT {group_col}, string_agg(CAST(date AS VARCHAR), ', ' ORDER BY date) AS sample_dates FROM (
        SELECT {group_col}, date, row_number() OVER (PARTITION BY {group_col} ORDER BY date) AS rn
        FROM d WHERE {value_col} IS NULL) WHERE rn <= {sample} GROUP BY {group_col})
SELECT c.{group_col}, c.n_null, coalesce(s.sample_dates, '') AS sample_dates
FROM c LEFT JOIN s ON c.{group_col} = s.{group_col}"""


def normalize_name(expr: str) -> str:
    s = f"lower(regexp_replace({expr}, '^\\s+|\\s+$', '', 'g'))"
    for a, b in [("é", "e"), ("è", "e"), ("ê", "e"), ("à", "a"), ("ù", "u"), ("ç", "c"), ("œ", "oe"), ("avx", "avax")]:
        s = f"replace({s}, '{a}', '{b}')"
    s = f"regexp_replace({s}, '[\\s\\-/]+', '_', 'g')"
    s = f"regexp_replace({s}, '[^a-z0-9_]', '', 'g')"
    s = f"trim(regexp_replace({s}, '_+', '_', 'g'), '_')"
    s = f"CASE WHEN {s} = '' THEN 'col' ELSE {s} END"
    return f"CASE WHEN regexp_matches({s}, '^[0-9]') THEN 'c_' || {s} ELSE {s} END"


def safe_base(expr: str) -> str:
    s = f"lower(regexp_replace({expr}, '^\\s+|\\s+$', '', 'g'))"
    s = f"regexp_replace({s}, '[\\s\\-/]+', '_', 'g')"
    s = f"regexp_replace({s}, '[^a-z0-9_]+', '', 'g')"
    s = f"trim(regexp_replace({s}, '_+', '_', 'g'), '_')"
    return f"CASE WHEN {s} = '' THEN 'sheet' ELSE {s} END"
