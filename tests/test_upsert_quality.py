"""Upserts (merge semantics, idempotence) and quality audits."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from coffer.operators import quality as QA
from coffer.operators import upsert as UP


def _target(spark):
    return spark.createDataFrame(
        [("a", 1, "x", dt.datetime(2020, 1, 1)), ("b", 2, "y", dt.datetime(2020, 1, 2))],
        "k string, v int, keep string, created_at timestamp_ntz",
    )


def test_upsert_semantics(spark):
    src = spark.createDataFrame([("b", 20, "NEW", 1), ("b", 21, "NEWER", 2), ("c", 3, "z", 1)],
                                "k string, v int, keep string, _seq long")
    out = UP.upsert(_target(spark), src, ["k"], ["v"], seq="_seq", now="2024-01-01 00:00:00")
    got = {r.k: r for r in out.collect()}
    assert (got["a"].v, got["a"]._action) == (1, "kept")
    assert (got["b"].v, got["b"].keep, got["b"]._action) == (21, "y", "updated")  # last write wins; keep stays
    assert got["b"].created_at == dt.datetime(2020, 1, 2)
    assert (got["c"].v, got["c"].keep, got["c"]._action) == (3, "z", "inserted")
    assert got["c"].created_at == dt.datetime(2024, 1, 1)


def test_upsert_idempotent(spark):
    src = spark.createDataFrame([("b", 20, "NEW"), ("c", 3, "z")], "k string, v int, keep string")
    once = UP.upsert(_target(spark), src, ["k"], ["v"], now="2024-01-01").drop("_action")
    twice = UP.upsert(once, src, ["k"], ["v"], now="2025-01-01").drop("_action")
    assert sorted(once.collect()) == sorted(twice.collect())


def test_upsert_null_keys_never_match(spark):
    t = spark.createDataFrame([(None, 1)], "k string, v int")
    s = spark.createDataFrame([(None, 2)], "k string, v int")
    out = UP.upsert(t, s, ["k"], ["v"], created_col=None)
    assert sorted(r._action for r in out.collect()) == ["inserted", "kept"]


def test_write_upsert_partitions(spark, tmp_path):
    path = str(tmp_path / "prices")
    mk = lambda rows: spark.createDataFrame(rows, "ts string, symbol string, price_eur double").select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), "symbol", "price_eur",
        F.to_date(F.col("ts").cast("timestamp_ntz")).alias("day"))
    UP.write_upsert(mk([("2024-01-01 10:00:00", "btc", 1.0), ("2024-01-02 10:00:00", "btc", 2.0)]),
                    path, ["ts", "symbol"], ["price_eur"], "day", now="2024-01-03")
    UP.write_upsert(mk([("2024-01-02 10:00:00", "btc", 2.5), ("2024-01-03 10:00:00", "btc", 3.0)]),
                    path, ["ts", "symbol"], ["price_eur"], "day", now="2024-01-04")
    got = sorted((r.ts.day, r.price_eur) for r in spark.read.parquet(path).collect())
    assert got == [(1, 1.0), (2, 2.5), (3, 3.0)]


def test_key_violations_and_domain(spark):
    df = spark.createDataFrame([("a", "x" * 25, 1.0), ("a", "y", 1e12), ("b", None, float("nan"))],
                               "k string, s string, n double")
    assert [(r.k, r.n) for r in QA.key_violations(df, ["k"]).collect()] == [("a", 2)]
    rules = QA.domain_rules(not_null=["s"], max_len={"s": 20}, decimals={"n": D("0").__class__ and __import__("pyspark.sql.types", fromlist=["DecimalType"]).DecimalType(18, 8)})
    valid, rejected = QA.domain_split(df, rules)
    assert valid.count() == 0
    assert sorted(r.reason for r in rejected.collect()) == ["decimal:n", "length:s>20", "null:s"]
    audit = {r.reason: r.n_rejected for r in QA.domain_audit(df, rules).collect()}
    assert audit == {"null:s": 1, "length:s>20": 1, "decimal:n": 2}


def test_null_audit_and_fill(spark):
    df = spark.createDataFrame(
        [(f"2024-01-{d:02d}", "btc", None if d < 8 else 1.0) for d in range(1, 11)]
        + [("2024-01-01", "eth", 2.0)], "date string, symbol string, v double",
    ).withColumn("date", F.col("date").cast("date"))
    got = {r.symbol: r for r in QA.null_audit(df, "v").collect()}
    assert got["btc"].n_null == 7
    assert got["btc"].sample_dates == "2024-01-01, 2024-01-02, 2024-01-03, 2024-01-04, 2024-01-05"
    assert (got["eth"].n_null, got["eth"].sample_dates) == (0, "")
    cut = {r.symbol: r.n_null for r in QA.null_audit(df, "v", as_of=F.lit("2024-01-03").cast("date")).collect()}
    assert cut["btc"] == 3
    filled = QA.fill_nulls(df, ["v"])
    assert {r.column_name: r.n_null for r in QA.count_nulls(filled, ["v"]).collect()} == {"v": 0}


def test_evolve_schema(spark):
    t = spark.createDataFrame([("2024-01-01", 1.0, 0)], "date string, a double, index long")
    i = spark.createDataFrame([("2024-01-02", 2.0, 3.0)], "date string, a double, b double")
    out = QA.evolve_schema(t, i)
    assert out.columns == ["date", "a", "b"] and out.count() == 2
