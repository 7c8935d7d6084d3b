"""Price polling as Structured Streaming (K1, K2, K3).

Payload files land in a directory, one JSON document per file, under a
``symbol=<sym>/`` sub-directory (the provider's market-chart payload does not
name its coin). The jobs:

* ``chart_point_stream`` — landing files -> typed points (A4);
* ``dedup_points`` — a re-polled point (same ``ts, symbol``) is kept once
  (the first copy) while it is inside the watermark, for consumers that want
  each point once;
* ``daily_close_stream`` (K2) — last point per (symbol, UTC day) by arrival,
  emitted in append mode once the watermark passes the day's end, or
  (``start_daily_closes``) kept as a running table that late points correct;
* ``BackfillSink`` (K1, K3) — ``foreachBatch`` sink: a point for a day that
  the table already covers is dropped (only missing days are filled), except
  that a point with an existing ``(ts, symbol)`` key overwrites its price (a
  re-poll corrects, it is not discarded); the batch is applied with the
  partition-scoped keyed upsert, so re-running the polling or replaying a
  batch after a failure leaves the same table (idempotent).

Local-time (Paris) closes stay batch operators: streaming windows are
aligned on UTC days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.functions.timecols import instant_to_utc_ntz, utc_day, utc_ntz_to_instant
from coffer.operators.upsert import write_upsert
from coffer.schemas import MONEY, PRICE_KEY, PRICE_UPDATE
from coffer.session import ensure_checkpoint_dir, remove_folder, scratch_folder
from coffer.sources.payloads import parse_market_chart
from coffer.sources.readers import stored


def chart_point_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming points ``symbol, _seq, pos, ts, price_eur, event_time``.

    ``_seq`` is the file's modification time in microseconds (its landing
    order); ``pos`` the point's position inside the payload; ``ts`` the UTC
    NTZ time and ``event_time`` the same instant as a ``TIMESTAMP`` (the type
    watermarks and windows need).
    """
    raw = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(landing_dir)
    )
    files = raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"symbol=([^/]+)/", 1).alias("symbol"),
        F.unix_micros(F.col("_metadata.file_modification_time")).alias("_seq"),
        F.col("value").alias("json"),
    )
    return parse_market_chart(files).select(
        F.lower("symbol").alias("symbol"), "_seq", "pos", "ts", "price_eur",
        utc_ntz_to_instant("ts").alias("event_time"),
    )


def dedup_points(points: DataFrame, delay: str = "2 days") -> DataFrame:
    """One row per ``(ts, symbol)`` within the watermark — the first copy;
    state is dropped once the watermark passes. Not used by the backfill
    sink, where a later copy of a key must overwrite the earlier one."""
    return points.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["ts", "symbol"])


def daily_close_stream(points: DataFrame, delay: str | None = "1 day") -> DataFrame:
    """K2: last point per (symbol, UTC day) in arrival order, appended once
    the watermark passes the end of the day. ``symbol, date, ts, price_eur``.

    ``delay=None`` when ``points`` already carries a watermark on
    ``event_time`` (e.g. after ``dedup_points``).
    """
    best = F.max(F.struct("_seq", "pos", "ts", "price_eur"))
    wm = points if delay is None else points.withWatermark("event_time", delay)
    return (
        wm.groupBy("symbol", F.window("event_time", "1 day"))
        .agg(best.alias("b"))
        .select(
            "symbol",
            F.to_date(instant_to_utc_ntz(F.col("window.start"))).alias("date"),
            F.col("b.ts").alias("ts"),
            F.col("b.price_eur").cast(MONEY).alias("price_eur"),
        )
    )


class ClosesSink:
    """K2 ``foreachBatch`` target of the running closes: a parquet table keyed on
    (symbol, date), partitioned by month. Each batch brings the closes that
    changed, at most one per key; a replayed batch leaves the same table."""

    def __init__(self, table_path: str):
        self.table_path = table_path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("month", F.trunc("date", "month"))
        write_upsert(rows, self.table_path, ["symbol", "date"], ["ts", "price_eur"], "month")


def start_daily_closes(
    spark: SparkSession,
    landing_dir: str,
    table_path: str,
    checkpoint: str | None = None,
    delay: str = "7 days",
    available_now: bool = True,
):
    """K2 as a running table: the close of each (symbol, UTC day) so far, corrected by late points.

    Update mode with state per open day: a point that arrives after its day's
    close was written, but inside the watermark ``delay``, changes the stored
    row; the state of a day goes when the watermark passes its end, and points
    that late are dropped. Started again on the same checkpoint, it goes on
    where it stopped. Returns the ``StreamingQuery``.
    """
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/closes-stream"
    closes = daily_close_stream(chart_point_stream(spark, landing_dir), delay)
    writer = closes.writeStream.outputMode("update").foreachBatch(ClosesSink(table_path)).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


class BackfillSink:
    """K3 ``foreachBatch`` target: a parquet price table partitioned by UTC day.

    For each micro-batch: points whose ``(ts, symbol)`` the table has already
    overwrite its price (the last by arrival of each key); of the rest, one
    point per (symbol, UTC day), the last by arrival, fills days that the
    table lacks. What is left is upserted on ``(ts, symbol)``, rewriting only
    the touched day partitions. The batch is parsed once, into the shared
    folder. ``now`` is stored as ``created_at`` of new rows (by default the
    arrival time of the row's file).
    """

    def __init__(self, table_path: str, now: str | None = None):
        self.table_path = table_path
        self.now = now

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stage = scratch_folder(spark, "points")
        points = batch.select("symbol", "_seq", "pos", "ts", "price_eur", utc_day("ts").alias("day"))
        points.write.parquet(stage)
        points = spark.read.schema(points.schema).parquet(stage)
        days = [r[0] for r in points.select("day").distinct().collect()]  # a batch's days
        if days:  # watermark-only micro-batches carry no rows
            last = F.max(F.struct("_seq", "pos", "ts", "price_eur")).alias("b")
            keyed = points.groupBy("ts", "symbol", "day").agg(last)
            table = stored(spark, self.table_path)
            fresh, known = keyed, None
            if table is not None:
                # partition pruning: only the batch's days are read
                table = table.filter(F.col("day").isin(days)).select("symbol", "day", "ts")
                known = keyed.join(table.select("symbol", "ts").distinct(), ["symbol", "ts"], "left_semi")
                fresh = keyed.join(table.select("symbol", "day").distinct(), ["symbol", "day"], "left_anti")
            rows = fresh.groupBy("symbol", "day").agg(F.max("b").alias("b"))
            if known is not None:
                rows = rows.unionByName(known.select("symbol", "day", "b"))
            made = F.lit(self.now).cast("timestamp_ntz") if self.now else F.expr(
                "timestampadd(MICROSECOND, b._seq, TIMESTAMP_NTZ '1970-01-01 00:00:00')"
            )
            write_upsert(
                rows.select(F.col("b.ts").alias("ts"), "symbol", F.col("b.price_eur").alias("price_eur"), "day", made.alias("created_at")),
                self.table_path,
                PRICE_KEY,
                PRICE_UPDATE,
                partition_col="day",
            )
        remove_folder(spark, stage)


def start_backfill(
    spark: SparkSession,
    landing_dir: str,
    table_path: str,
    checkpoint: str | None = None,
    available_now: bool = True,
):
    """Run K1 + K3: landing files -> points -> price table (keyed upsert).

    The checkpoint defaults to a folder under ``spark.checkpoint.dir``.
    Returns the ``StreamingQuery``.
    """
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/backfill-stream"
    points = chart_point_stream(spark, landing_dir)
    writer = points.writeStream.foreachBatch(BackfillSink(table_path)).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
