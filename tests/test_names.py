"""Name normalisation (plan-time and column forms agree) and unique names."""

import pytest
from pyspark.sql import functions as F

from coffer.functions import names as NM

NAMES = ["btc acheté", "\x1cx\x1fy\x1c", "a\u00a0b\u2028c", "Valeur BTC", "total gain perte", "AVX prix", "  9 lives ", "---", "çà et là / œuvre",
         "a\tb-c/d", "", "déjà_vu__x"]


def test_normalize_name_forms_agree(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    got = [r.x for r in df.select(NM.normalize_name_col(F.col("n")).alias("x")).collect()]
    assert got == [NM.normalize_name(n) for n in NAMES]
    assert NM.normalize_name("btc acheté cumul") == "btc_achete_cumul"
    assert NM.normalize_name("9 lives") == "c_9_lives" and NM.normalize_name("---") == "col"
    assert NM.normalize_name("avx") == "avax"


def test_safe_base_forms_agree(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    got = [r.x for r in df.select(NM.safe_base_col(F.col("n")).alias("x")).collect()]
    assert got == [NM.safe_base(n) for n in NAMES]
    assert NM.safe_base("Résumé") == "rsum"  # accents dropped, not folded


def test_unique_names_plan_time():
    assert NM.unique_names(["a", "a", "b", "a"]) == ["a", "a_2", "b", "a_3"]
    assert NM.unique_names(["x_2", "x", "x"]) == ["x_2", "x", "x_3"]  # chain case


@pytest.mark.parametrize("n_groups", [1, 3])
def test_rank_within_group_matches_row_number(spark, n_groups):
    from pyspark.sql import Window

    df = spark.range(0, 5000).select((F.col("id") % n_groups).alias("g"), ((F.col("id") * 7919) % 5000).alias("o"))
    got = NM.rank_within_group(df, "g", "o", "r")
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("o")))
    assert sorted(got.collect()) == sorted(ref.collect())


def test_safe_names_col(spark):
    df = spark.createDataFrame([(1, "Sheet 1"), (2, "sheet-1"), (3, "Other"), (4, "SHEET 1")], "k long, n string")
    got = {r.k: r.safe_name for r in NM.safe_names_col(df, "n", "k").collect()}
    assert got == {1: "sheet_1", 2: "sheet_1_2", 3: "other", 4: "sheet_1_3"}


def test_find_value_column():
    assert NM.find_value_column(["date", "btc valeur", "btc valeur cumul"], "btc") == "btc valeur"
    assert NM.find_value_column(["date", "BTC Valeur Cumul"], "btc") == "BTC Valeur Cumul"
    assert NM.find_value_column(["date", "Valeur BTC"], "btc") is None


def test_ranks_without_exchange_reuse(spark):
    from pyspark.sql import Window

    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        n = 400_000
        df = spark.range(0, n).select(
            (F.col("id") % 7).alias("g"), ((F.col("id") * 7919) % n).alias("o"), F.col("id").cast("string").alias("extra")
        )
        got = NM.rank_within_group(df, "g", "o", "r")
        per = got.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("r").alias("d"), F.max("r").alias("m")).collect()
        assert len(per) == 7 and all(r.n == r.d == r.m for r in per)
        ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("o")))
        assert got.exceptAll(ref).isEmpty()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_ranks_with_null_groups_and_orders(spark):
    df = spark.createDataFrame([(None, "b"), (None, None), ("x", "c"), ("x", "a")], "g string, o string")
    got = sorted((tuple(r) for r in NM.rank_within_group(df, "g", "o", "r").collect()), key=str)
    assert got == sorted([(None, None, 1), (None, "b", 2), ("x", "a", 1), ("x", "c", 2)], key=str)


def test_resolver_order():
    cols = ["op date", "amount", "", "fee total"]
    assert NM.resolve_like(cols, ["fees", "amount"]) == "amount"  # an exact match of a later candidate first
    assert NM.resolve_like(cols[:2] + cols[3:], ["fee"]) == "fee total"
    assert NM.resolve_like(cols, ["nothing"]) == ""  # an empty header fits anything
    assert NM.resolve_like(["abc"], ["x"], ["^a.c$"]) == "abc"
    assert NM.resolve_like(["abc"], ["x"]) is None
