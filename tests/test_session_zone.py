"""Results must not depend on spark.sql.session.timeZone (the driver's
session may not be UTC): canonical instants are UTC TIMESTAMP_NTZ."""

import pytest
from pyspark.sql import functions as F

from coffer.functions.timecols import to_second
from coffer.operators import ledger as LG
from coffer.operators import valuation as V

SF = "/root/testdata/sf0.001"


@pytest.fixture
def zone(spark):
    prev = spark.conf.get("spark.sql.session.timeZone")

    def set_zone(z):
        spark.conf.set("spark.sql.session.timeZone", z)

    yield set_zone
    spark.conf.set("spark.sql.session.timeZone", prev)


def test_sheet_independent_of_zone(spark, zone):
    from coffer.sources import testdata as TD

    def run():
        return sorted(tuple(r) for r in V.daily_valuation_long(TD.tx_events(spark, SF), TD.prices_events(spark, SF)).collect())

    zone("UTC")
    base = run()
    zone("America/New_York")
    assert run() == base
    zone("Asia/Kolkata")
    assert run() == base


def test_second_truncation_in_dst_gap(spark, zone):
    zone("America/New_York")
    df = spark.createDataFrame([("2021-03-14 02:30:15.5",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    got = df.select(to_second(F.col("t")).alias("x")).first().x
    assert str(got) == "2021-03-14 02:30:15"


def test_ledger_independent_of_zone(spark, zone):
    from coffer.sources import testdata as TD

    def run():
        n = LG.normalize_ledger(TD.ledger_raw(spark, SF), "2026-01-01 00:00:00")
        return sorted((r.date_utc, r.dedup_hash) for r in n.collect())

    zone("UTC")
    base = run()
    zone("America/New_York")
    assert run() == base
