"""Price-provider payloads and the symbol mapping.

HTTP fetching is not part of this library: payloads land as JSON documents
(files read with ``spark.read.text`` / ``readStream``, or a string column) and
are parsed here with ``from_json`` into typed rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.functions.parse import parse_float_text
from coffer.schemas import COINS_MAP_DEFAULT, MARKET_CHART_JSON, MONEY

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
#: Milliseconds of 0001-01-01 and 9999-12-31T23:59:59.999.
MIN_MS, MAX_MS = -62_135_596_800_000.0, 253_402_300_799_999.0


def parse_mapping(spark: SparkSession, mapping: str = COINS_MAP_DEFAULT) -> DataFrame:
    """``"btc:bitcoin,eth:ethereum"`` -> rows ``symbol, coin_id``.

    Pairs without ``:`` are ignored, both sides are trimmed, the text after
    the first ``:`` is the id, and a symbol listed twice keeps its last id.
    The result is as small as the configuration string; joins broadcast it.
    """
    pairs = spark.range(1).select(
        F.posexplode(F.split(F.lit(mapping), ",")).alias("pos", "pair")
    ).filter(F.col("pair").contains(":"))
    kv = pairs.select(
        "pos",
        F.trim(F.substring_index("pair", ":", 1)).alias("symbol"),
        F.trim(F.expr("substring(pair, instr(pair, ':') + 1)")).alias("coin_id"),
    )
    return kv.groupBy("symbol").agg(F.max_by("coin_id", "pos").alias("coin_id"))


def mapped_symbols(symbols: DataFrame, mapping: DataFrame) -> DataFrame:
    """Symbols that have a provider id — ``symbol, coin_id``."""
    return symbols.join(F.broadcast(mapping), "symbol", "inner")


def unmapped_symbols(symbols: DataFrame, mapping: DataFrame) -> DataFrame:
    """Symbols without a provider id."""
    return symbols.join(F.broadcast(mapping), "symbol", "left_anti")


def parse_market_chart(payloads: DataFrame, json_col: str = "json") -> DataFrame:
    """A4: market-chart payloads -> one row per price point.

    ``{"prices": [[epoch_ms, price], ...]}``. Keeps every other payload
    column, adds ``pos`` (position in the payload, the arrival order inside
    it), ``ts`` (UTC NTZ, microsecond precision) and ``price_eur``. Points
    that are not a pair of numbers, or whose time or price does not fit its
    type, are skipped; the payload's other points stay.
    """
    keep = [c for c in payloads.columns if c != json_col]
    parsed = payloads.select(*keep, F.from_json(F.col(json_col), MARKET_CHART_JSON).alias("__p"))
    pts = parsed.select(*keep, F.posexplode_outer("__p.prices").alias("pos", "__pt"))
    pair = pts.filter(F.size("__pt") == 2).select(
        *keep,
        "pos",
        parse_float_text(F.get("__pt", F.lit(0))).alias("__ms"),
        parse_float_text(F.get("__pt", F.lit(1))).alias("__px"),
    )
    # times outside the years 1 to 9999, infinities and NaN become NULL
    ms = F.when(F.col("__ms").between(MIN_MS, MAX_MS), F.col("__ms"))
    micros = F.round(ms * 1000).cast("long")
    return pair.select(
        *keep,
        "pos",
        F.timestamp_add("MICROSECOND", micros, F.expr(EPOCH)).alias("ts"),
        F.col("__px").try_cast(MONEY).alias("price_eur"),
    ).filter(F.col("ts").isNotNull() & F.col("price_eur").isNotNull())


def parse_simple_price(payloads: DataFrame, json_col: str = "json") -> DataFrame:
    """A5 (+D6): current-price payloads -> ``coin_id, price_eur`` rows.

    ``{"<id>": {"eur": price}, ...}``; an entry that is no object or has no
    numeric ``eur`` price is dropped, the payload's other entries stay. Other payload columns (fetch time, sequence) are kept.
    """
    keep = [c for c in payloads.columns if c != json_col]
    parsed = payloads.select(*keep, F.from_json(F.col(json_col), "map<string,string>").alias("__m"))
    ex = parsed.select(*keep, F.explode("__m").alias("coin_id", "__q"))
    eur = F.from_json(F.col("__q"), "map<string,string>")["eur"]
    return ex.select(*keep, "coin_id", parse_float_text(eur).try_cast(MONEY).alias("price_eur")).filter(
        F.col("price_eur").isNotNull()
    )


def quotes_for_symbols(symbols: DataFrame, mapping: DataFrame, quotes: DataFrame) -> DataFrame:
    """Symbol -> id -> quote. Every symbol mapped to a quoted id gets its
    price (two symbols may share an id)."""
    return mapped_symbols(symbols, mapping).join(quotes, "coin_id", "inner")


def ids_without_quote(symbols: DataFrame, mapping: DataFrame, quotes: DataFrame) -> DataFrame:
    """Expected provider ids (of the given symbols) absent from the quotes."""
    expected = mapped_symbols(symbols, mapping).select("coin_id").distinct()
    return expected.join(quotes.select("coin_id").distinct(), "coin_id", "left_anti")
