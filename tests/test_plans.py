"""Plan-shape guards: the properties the operators rely on at scale, checked
on the physical plans (regressions here are performance bugs, not wrong
results)."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan_text(df):
    df.write.format("noop").mode("overwrite").save()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def _names():
    from coffer.plans.catalog import REGISTRY

    return sorted(REGISTRY)


@pytest.mark.parametrize("name", _names())
def test_no_cross_products(spark, name):
    import __spark_entry__ as E

    p = plan_text(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


@pytest.mark.parametrize("which", ["events", "lineitem"])
def test_each_fact_is_read_once(spark, which):
    from coffer.operators import positions as P
    from coffer.operators import prices as PX
    from coffer.operators import valuation as V
    from coffer.sources import testdata as TD

    if which == "events":
        tx, pr = TD.tx_events(spark, SF), TD.prices_events(spark, SF)
    else:
        tx, pr = TD.tx_lineitem(spark, SF), TD.prices_lineitem(spark, SF)
    activity = V.daily_activity(tx, pr)
    assert _scans(activity) == _scans(tx) + _scans(pr)
    p = plan_text(activity)
    assert "SortAggregate" not in p and "partial_" in p  # map-side combine before the exchange
    # all that is built on the activity reads its checkpoint only
    for df in (V.daily_valuation_long(tx, pr), P.positions_asof(tx, pr), *PX.price_gaps(tx, pr)):
        p = plan_text(df)
        assert "FileScan" not in p and "ExistingRDD" in p
        assert "SortAggregate" not in p


def test_holdings_use_hash_aggregates(spark):
    import __spark_entry__ as E

    p = plan_text(E.queries()["holdings_report"](spark, SF))
    assert "SortAggregate" not in p and "partial_" in p


def test_gap_range_reaches_the_scan(spark):
    from coffer.operators import prices as PX
    from coffer.sources import testdata as TD

    pr = TD.prices_events(spark, SF)
    bounded = PX.days_present(pr, F.lit(dt.date(2024, 1, 5)), F.lit(dt.date(2024, 1, 9)))
    p = bounded._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: [^\n]*GreaterThanOrEqual\(ts,2024-01-05", p)
    assert re.search(r"ts#\d+ < 2024-01-10", p)


@pytest.mark.parametrize("job", ["normalized", "upsert_transactions", "split"])
def test_filters_do_not_copy_the_parsing(spark, job):
    import __spark_entry__ as E
    from coffer.operators import ledger as LG
    from coffer.operators import quality as QA
    from coffer.sources import testdata as TD

    norm = LG.normalize_ledger(TD.ledger_raw(spark, SF), "2030-01-01")
    plain = len(norm._jdf.queryExecution().executedPlan().toString())
    if job == "normalized":
        df = norm.filter("date_utc < timestamp_ntz '1995-01-01'")
    elif job == "split":
        df = QA.domain_split(norm, QA.domain_rules(not_null=["date_utc", "qty"], max_len={"note": 3}))[0]
    else:
        df = E.queries()["upsert_transactions"](spark, SF)
    assert len(df._jdf.queryExecution().executedPlan().toString()) < 4 * plain


def test_sheet_spreads_the_spine(spark):
    import __spark_entry__ as E

    spark.conf.set("spark.sql.shuffle.partitions", "4")
    p = plan_text(E.queries()["daily_valuation_long"](spark, SF))
    assert "RoundRobinPartitioning(4)" in p and "Generate explode" in p
    assert "Window" in p and "SortMergeJoin" not in p  # union + aggregate, no joins


def test_no_adapter_shuffle(spark):
    from coffer.sources import testdata as TD

    for df in (TD.tx_events(spark, SF), TD.prices_events(spark, SF), TD.market_chart_payloads(spark, SF)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_holdings_join_reuses_aggregate_partitioning(spark):
    import __spark_entry__ as E

    df = E.queries()["holdings_report"](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    txt = plan.toString()
    if "SortMergeJoin" in txt:  # AQE may also turn it into a broadcast join of two tiny sides
        lines = txt.split("\n")
        j = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
        # each join side is Sort directly over the aggregate: no exchange in between
        sides = [i for i, line in enumerate(lines[j + 1:], j + 1) if re.match(r"^[\s:]*[+:]- Sort ", line)]
        assert len(sides) >= 2
        for i in sides[:2]:
            assert "HashAggregate" in lines[i + 1] and "Exchange" not in lines[i + 1], txt


def test_scan_pruning_and_pushdown(spark):
    from coffer.operators import valuation as V
    from coffer.sources import testdata as TD

    df = V.daily_activity(TD.tx_events(spark, SF), TD.prices_events(spark, SF))
    s = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    txt = df._jdf.queryExecution().explainString(s)
    assert "PushedFilters: [In(event_type, [error,purchase,signup])]" in txt
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in txt  # quotes: no props
