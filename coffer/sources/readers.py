"""Readers for ledger exports and stored tables (A1, A2, A3).

Stored tables are parquet directories; the readers only select the columns
an operator needs so that pruning (and any filter written after them) reaches
the scan.
"""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer.functions.names import norm_key
from coffer.functions.timecols import as_utc_ntz
from coffer.sources.records import csv_records


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at ``path``, or None if there is no such path.

    Only a missing path counts as "not created yet". Any other failure
    (permissions, unreadable or half-written files) is the caller's to see.
    """
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _headers(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """(header line, files) for each different header line among the files of ``path``.

    The files are those of the listing that Spark makes anyway; of each, the
    first row is asked for, so only its first bytes are read.
    """

    def head(file: str) -> tuple[str, str | None]:
        row = spark.read.option("lineSep", "\n").text(file).head()
        return file, row and row["value"].rstrip("\r")

    files = sorted(unquote(f) for f in spark.read.text(path).inputFiles())
    by_header: dict[str, list[str]] = {}
    with ThreadPoolExecutor(8) as pool:
        for file, header in pool.map(head, files):
            if header is not None:
                by_header.setdefault(header, []).append(file)
    return sorted(by_header.items())


def _columns(header: str) -> list[tuple[int, str]]:
    """(position, header) of the columns to keep: of equal keys the last one."""
    names = next(csv.reader([header.lstrip("\ufeff")]), [])
    last = {norm_key(n): (i, n) for i, n in enumerate(names)}
    return sorted(last.values())


def read_ledger_csv(spark: SparkSession, path: str, seq: str = "_seq") -> DataFrame:
    """A1: ledger CSV exports with a header row each, UTF-8, quoted fields.

    Every file is read by its own header: files are grouped by header line,
    fields are named by position, and of columns whose headers have the same
    key the last one counts. An empty header is the column ``" "`` (its key is
    empty). Columns are named by their keys, so files whose headers differ in
    order, case or blanks line up; a column that a file lacks is NULL there.
    Every value stays a string; embedded newlines in quoted fields are
    allowed, in header names they are not.

    ``seq`` is the arrival order that last-write-wins needs: a struct of the
    file's modification time, its path, and the row's place in it (split and
    line). One file is read by as many tasks as it has splits, quoted newlines
    or not (``records.csv_records``); its lines are staged once in the shared
    folder. An opening quote that nothing closes is a character of its field.
    """
    groups = _headers(spark, path)
    if not groups:
        raise ValueError(f"no ledger file with a header line in {path}")
    frames = []
    for header, files in groups:
        n = len(next(csv.reader([header.lstrip("\ufeff")]), []))
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n)])
        options = {"multiLine": "true", "escape": '"', "mode": "PERMISSIVE"}
        data = csv_records(spark, files).withColumn("fields", F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options))
        frames.append(
            data.select(
                *[F.col(f"fields.c{i}").alias(norm_key(name) or " ") for i, name in _columns(header)],
                F.struct("time", "file", "block", "line").alias(seq),
            )
        )
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """A2: ``date_utc, symbol (lower), qty, price_eur, fee_eur`` from a stored table."""
    df = spark.read.parquet(path)
    return df.select(
        as_utc_ntz(df, "date_utc").alias("date_utc"),
        F.lower("symbol").alias("symbol"),
        "qty",
        "price_eur",
        "fee_eur",
    )


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """A3: ``symbol (lower), ts, price_eur`` from a stored price table, and its
    partition column ``day`` where it has one (bounds on it skip whole folders)."""
    df = spark.read.parquet(path)
    day = ["day"] if "day" in df.columns else []
    return df.select(F.lower("symbol").alias("symbol"), as_utc_ntz(df, "ts").alias("ts"), "price_eur", *day)
