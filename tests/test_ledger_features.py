"""Chained names, bucketed upserts, counts, type lattice, instants, week dates, pruned price days."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer.functions.names import safe_base, safe_names_col, unique_names
from coffer.functions.parse import parse_ledger_datetime
from coffer.operators import positions as P
from coffer.operators import prices as PX
from coffer.operators import quality as QA
from coffer.operators import upsert as UP
from coffer.plans.catalog import REGISTRY
from coffer.sources.readers import read_prices


@pytest.mark.parametrize("seed", [1, 2])
def test_chained_names_equal_the_sequential_rule(spark, seed):
    r = random.Random(seed)
    pool = ["x", "x_2", "x_3", "x_2_2", "x_10", "y", "y_2", "x_1", "z_02", "Sheet", "w w"]
    names = [r.choice(pool) for _ in range(150)] + ["hot"] * 120 + ["hot_5", "hot_60", "hot_5"]
    r.shuffle(names)
    want = unique_names(safe_base(n) for n in names)
    d = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, name string").repartition(3)
    got = {q["k"]: q["safe_name"] for q in safe_names_col(d, "name", "k", segment=16).collect()}
    assert [got[k] for k in range(len(names))] == want
    assert safe_names_col(d.limit(0), "name", "k").collect() == []


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_upsert_moves_only_the_batch(spark, tmp_path):
    rows = [(k, f"v{k}", dt.datetime(2020, 1, 1)) for k in range(500)]
    first = spark.createDataFrame(rows, "key long, value string, created_at timestamp_ntz")
    batch = spark.createDataFrame([(k, f"n{s}", s) for s, k in enumerate([3, 3, 499, 1000, 1001])], "key long, value string, _seq long")
    name, args = "bucketed_test", (["key"], ["value"], 8)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    done = UP.write_bucketed_upsert(first, name, *args, path=str(tmp_path))
    assert done == {"inserted": 500, "updated": 0, "kept": 0}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = exchanges(UP.bucketed_upsert(batch, name, ["key"], ["value"], seq="_seq", now="2021-01-01"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan
    side = plan[: plan.index("Bucketed: true")].rsplit("FullOuter", 1)[1]
    assert "Exchange" not in side  # between the join and the stored side
    for expect in ({"inserted": 2, "updated": 2, "kept": 498}, {"inserted": 0, "updated": 4, "kept": 498}):
        done = UP.write_bucketed_upsert(batch, name, *args, seq="_seq", now="2021-01-01", path=str(tmp_path))
        assert done == expect
        got = {r.key: (r.value, r.created_at) for r in spark.table(name).collect()}
        assert len(got) == 502 and got[3] == ("n1", dt.datetime(2020, 1, 1)) and got[1000] == ("n3", dt.datetime(2021, 1, 1))
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}__next")  # cut off before the new table took its name
    UP.write_bucketed_upsert(batch, name, *args, seq="_seq", now="2021-01-01", path=str(tmp_path))
    assert spark.table(name).count() == 502
    spark.sql(f"DROP TABLE {name}")


def test_new_bucketed_table_follows_rows_and_is_not_moved_by_the_join(spark, tmp_path):
    assert [UP.bucket_count(spark, n, per_bucket=100) for n in (0, 400, 401, 5000)] == [4, 4, 5, 50]
    first = spark.range(500).selectExpr("id AS key", "concat('v', id) AS value", "timestamp_ntz '2020-01-01' AS created_at")
    batch = spark.range(490, 510).selectExpr("id AS key", "'new' AS value", "id AS _seq")
    spark.sql("DROP TABLE IF EXISTS buckets_by_rows")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        UP.write_bucketed(first, "buckets_by_rows", ["key"], UP.bucket_count(spark, 500), str(tmp_path / "t"))
        merged = UP.bucketed_upsert(batch, "buckets_by_rows", ["key"], ["value"], seq="_seq", now="2021-01-01")
        plan = exchanges(merged)
        assert "Bucketed: true" in plan
        assert "Exchange" not in plan[: plan.index("Bucketed: true")].rsplit("FullOuter", 1)[1]
        assert {r[UP.ACTION]: r["count"] for r in merged.groupBy(UP.ACTION).count().collect()} == {"kept": 490, "updated": 10, "inserted": 10}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.sql("DROP TABLE IF EXISTS buckets_by_rows")


def test_bucketed_query_counts_its_buckets_from_the_stored_rows(spark, tmp_path, monkeypatch):
    spark.sql("SELECT 1L AS p_partkey, 'Brand#1' AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, 41).selectExpr(
        "id AS l_orderkey", "1L AS l_partkey", "id AS l_suppkey", "1 AS l_linenumber", "2.0D AS l_quantity", "30.0D AS l_extendedprice",
        "0.01D AS l_tax", "'A' AS l_returnflag", "timestamp_ntz '1996-01-01' + make_interval(CAST(id % 3 AS INT)) AS l_shipdate",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    asked, made, real = [], [], UP.write_bucketed
    monkeypatch.setattr(UP, "bucket_count", lambda _, rows: asked.append(rows) or 11)
    monkeypatch.setattr(UP, "write_bucketed", lambda df, name, keys, n, path=None: made.append(n) or real(df, name, keys, n, path))
    out = {r["_action"]: r["count"] for r in REGISTRY["upsert_bucketed"].build(spark, str(tmp_path)).groupBy("_action").count().collect()}
    assert (asked, made) == ([27], [11])
    assert out == {"kept": 13, "updated": 14, "inserted": 13}


def test_write_upsert_counts(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "key long, value string, part string")
    path = str(tmp_path / "t")
    assert UP.write_upsert(d, path, ["key"], ["value"], "part") == {"inserted": 2, "updated": 0, "kept": 0}
    more = spark.createDataFrame([(2, "B", "q"), (3, "c", "q"), (4, "d", "r")], "key long, value string, part string")
    assert UP.write_upsert(more, path, ["key"], ["value"], "part") == {"inserted": 2, "updated": 1, "kept": 0}
    assert UP.write_upsert(more.limit(0), path, ["key"], ["value"], "part") == {"inserted": 0, "updated": 0, "kept": 0}


def test_type_lattice(spark):
    dec, long, text, ntz = T.DecimalType, T.LongType(), T.StringType(), T.TimestampNTZType()
    cases = [
        (T.IntegerType(), long, long, True),
        (T.IntegerType(), dec(6, 2), dec(12, 2), True),
        (long, dec(20, 2), dec(22, 2), True),
        (dec(38, 0), dec(38, 20), text, True),
        (T.IntegerType(), T.DoubleType(), T.DoubleType(), True),
        (long, T.DoubleType(), T.DoubleType(), False),
        (dec(10, 2), T.FloatType(), T.DoubleType(), False),
        (T.DateType(), ntz, ntz, True),
        (T.DateType(), long, text, True),
        (T.NullType(), T.DateType(), T.DateType(), True),
        (T.BooleanType(), text, text, False),
    ]
    for a, b, want, kept in cases:
        assert QA.least_upper_type(a, b) == QA.least_upper_type(b, a) == (want, kept)
    old = spark.createDataFrame([(1, dt.date(2020, 1, 2), "x", 9)], "a int, b date, c string, index int")
    new = spark.createDataFrame([(2**40, "not a date", 1.5, None)], "a long, b string, d double, index2 int")
    both, report = QA.reconciled_union(old, new)
    assert dict(both.dtypes) == {"a": "bigint", "b": "string", "c": "string", "d": "double", "index2": "int"}
    assert {tuple(r) for r in both.collect()} == {(1, "2020-01-02", "x", None, None), (2**40, "not a date", None, 1.5, None)}
    verdicts = {r.column_name: r.verdict for r in report.collect()}
    assert verdicts == {"a": "widened", "b": "text", "c": "absent", "d": "added", "index2": "added"}


def test_positions_at_instants(spark):
    r = random.Random(5)
    at = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=r.randrange(400) * 86400 // 3)
    tx = [(at(), r.choice(["BTC", "eth"]), float(r.randint(-5, 9))) for _ in range(400)] + [(None, "btc", 5.0)]
    probes = [(k, r.choice(["btc", "ETH", "none", None]), r.choice([at(), None])) for k in range(300)]
    t = spark.createDataFrame(tx, "date_utc timestamp_ntz, symbol string, qty double")
    p = spark.createDataFrame(probes, "qty_id int, symbol string, ts timestamp_ntz")
    got = {q["qty_id"]: q["qty"] for q in P.positions_at(t, p, segment_days=9).collect()}
    for k, symbol, ts in probes:
        mine = [q for d, s, q in tx if d and ts and symbol and s.lower() == symbol.lower() and d <= ts]
        assert (got[k] is None) == (not mine) and (not mine or float(got[k]) == sum(mine))


def test_week_dates_as_python_reads_them(spark):
    r = random.Random(6)
    texts = ["2025-W38-7", "2025W387", "2025-W38", "2025W38", "2025-W387", "2025W38-7", "2025-W54-1", "2025-W53-1", "2020-W53-7", "2025-W00-1"]
    texts += ["2025-W38-0", "2025-W38-8", "2025-w38-1", "2025-W38-7T10:11:12", "2025W387T101112.5+0130", "2025-W38 07:08", "0000-W01-1", "2025-W3-1"]
    texts += [f"{r.randint(1970, 2060)}-W{r.randint(1, 53):02d}-{r.randint(1, 7)}" for _ in range(300)]

    def want(s):
        try:
            d = dt.datetime.fromisoformat(s)
        except ValueError:
            return None
        return d.astimezone(dt.UTC).replace(tzinfo=None) if d.tzinfo else d

    d = spark.createDataFrame([(k, s) for k, s in enumerate(texts)], "k int, s string")
    got = {q["k"]: q["d"] for q in d.select("k", parse_ledger_datetime(F.col("s")).alias("d")).collect()}
    assert {s: got[k] for k, s in enumerate(texts)} == {s: want(s) for s in texts}


def test_stored_price_days_are_pruned(spark, tmp_path):
    rows = [(dt.datetime(2020, 1, 1) + dt.timedelta(days=k), "btc", 1.0 + k) for k in range(40)]
    d = spark.createDataFrame(rows, "ts timestamp_ntz, symbol string, price_eur double")
    path = str(tmp_path / "prices")
    d.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    days = PX.days_present(read_prices(spark, path), F.lit(dt.date(2020, 1, 30)), F.lit(dt.date(2020, 2, 2)))
    filters = re.search(r"PartitionFilters: \[(.*?)\]", exchanges(days)).group(1)
    assert "day" in filters and ">=" in filters and "<=" in filters
    assert sorted(q.date for q in days.collect()) == [dt.date(2020, 1, 30) + dt.timedelta(days=k) for k in range(4)]


def test_an_upsert_cut_off_while_it_swaps_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    d = spark.createDataFrame([(1, "a", "p"), (2, "b", "q"), (3, "c", "r")], "key long, value string, part string")
    UP.write_upsert(d, path, ["key"], ["value"], "part")
    swap = UP._swap_in
    monkeypatch.setattr(UP, "_swap_in", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("driver lost")))
    batch = spark.createDataFrame([(1, "A", "p"), (4, "d", "s")], "key long, value string, part string")
    with pytest.raises(RuntimeError):
        UP.write_upsert(batch, path, ["key"], ["value"], "part")
    monkeypatch.setattr(UP, "_swap_in", swap)
    assert spark.read.parquet(path).count() == 3  # the note is no data
    more = spark.createDataFrame([(2, "B", "q")], "key long, value string, part string")
    assert UP.write_upsert(more, path, ["key"], ["value"], "part") == {"inserted": 0, "updated": 1, "kept": 0}
    assert {(r.key, r.value) for r in spark.read.parquet(path).collect()} == {(1, "A"), (2, "B"), (3, "c"), (4, "d")}
    assert not UP.finish_upsert(spark, path, "part")


def test_cleanup_removes_what_operators_staged(spark):
    from coffer.session import cleanup, scratch_folder

    path = scratch_folder(spark, "trial")
    spark.range(3).write.parquet(path)
    assert cleanup(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    assert cleanup(spark) == 0
