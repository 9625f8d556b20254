"""Plan shape: what must hold for the jobs to scale (filters at the scan, shuffle reuse)."""

import re

import pytest

from conftest import SF01
from salesmart.plans.queries import Job
from salesmart.operators import reports as R


@pytest.fixture()
def static_spark(spark):
    # static plans with sort-merge joins, as on large data where nothing is broadcast
    old = {k: spark.conf.get(k) for k in ["spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"]}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.catalog.clearCache()  # cached per-order rows of earlier tests would show their own plans
    yield spark
    spark.catalog.clearCache()
    for k, v in old.items():
        spark.conf.set(k, v)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_period_filter_reaches_orders_scan(static_spark):
    p = _plan(R.executive_dashboard(Job(static_spark, SF01).orders))
    orders_scan = [ln for ln in p.splitlines() if "FileScan parquet" in ln and "o_orderkey" in ln][0]
    assert "GreaterThanOrEqual(o_orderdate" in orders_scan


def test_order_grain_reads_items_once(static_spark):
    p = _plan(R.executive_dashboard(Job(static_spark, SF01).orders))
    # one scan of the items, aggregated per order before its only shuffle; nothing cached, no window
    assert p.count("l_orderkey") and len([ln for ln in p.splitlines() if "FileScan parquet" in ln and "l_orderkey" in ln]) == 1
    assert "InMemoryTableScan" not in p and "Window" not in p
    ids = set(re.findall(r"Exchange hashpartitioning\([^\n]*plan_id=(\d+)", p))
    assert len(ids) == 2
    assert p.count("Exchange SinglePartition") == 1


def test_state_join_has_plain_exchanges(static_spark):
    """Both sides of the customer join are shuffles of their own, which AQE can split at a hot customer."""
    p = _plan(Job(static_spark, SF01).orders_c)
    join = [i for i, ln in enumerate(p.splitlines()) if "SortMergeJoin [id_cliente#" in ln]
    assert len(join) == 1 and "left_semi" not in p.lower() and "LeftSemi" not in p
    assert len(re.findall(r"Exchange hashpartitioning\((?:id_cliente|customer_id)#", p)) == 2


@pytest.mark.parametrize("key", ["delivery_days", "late_flag", "dim_tempo", "time_parts", "change_log", "apply_changes"])
def test_order_only_keys_join_no_items(static_spark, key):
    from salesmart.plans.queries import registry

    p = _plan(registry()[key](static_spark, SF01))
    assert "l_linenumber" not in p and "l_extendedprice" not in p


def test_building_starts_no_job(spark):
    from salesmart.plans.queries import registry

    sc = spark.sparkContext
    sc.setJobGroup("building", "plans only")
    try:
        for f in registry().values():
            f(spark, SF01)
        assert list(sc.statusTracker().getJobIdsForGroup("building")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_projection_pruned(static_spark):
    p = _plan(R.kpi_totals(Job(static_spark, SF01).orders))
    li_scan = [ln for ln in p.splitlines() if "FileScan parquet" in ln and "l_orderkey" in ln][0]
    assert "l_comment" not in li_scan and "l_returnflag" not in li_scan and "l_quantity" not in li_scan


def test_sales_base_filters_by_date_and_splits_products(static_spark):
    """The period reaches the orders scans; the raw dimensions come by plain exchanges on key and part,
    and the items are read twice at most (per-order aggregate, item join)."""
    from salesmart.plans.queries import registry

    p = _plan(registry()["sales_base"](static_spark, SF01))
    scans = [ln for ln in p.splitlines() if "FileScan parquet" in ln]
    assert all("GreaterThanOrEqual(o_orderdate" in ln or "DataFilters: [cast(o_orderdate" in ln
               for ln in scans if "o_orderdate" in ln)
    assert re.search(r"Exchange hashpartitioning\(id_produto#\d+L?, _part#", p)
    assert re.search(r"Exchange hashpartitioning\(id_vendedor#\d+L?, _part#", p)
    reads = set(re.findall(r"FileScan parquet \[(l_orderkey[^\]]*)\]", p))
    assert len({re.sub(r"#\d+L?", "", r) for r in reads}) <= 2


@pytest.mark.parametrize("acting, plain", [("city_respelled", "orders_by_city"), ("month_spine_wide", "monthly_revenue"),
                                           ("rate_filled_wide", "rate_monthly")])
def test_keys_that_act(spark, acting, plain):
    from salesmart.plans.queries import registry

    assert {tuple(r) for r in registry()[acting](spark, SF01).collect()} != {tuple(r) for r in registry()[plain](spark, SF01).collect()}


def test_narrow_density_adds_few_points(spark):
    """A narrow bandwidth gives each value a few grid points; the sums equal those of all points."""
    import math
    import statistics

    from pyspark.sql import functions as F

    from salesmart.operators.distribution import density

    xs = [i / 1000 for i in range(4000)] + [1e5]
    got = {r["ponto"]: r for r in density(spark.createDataFrame([(x,) for x in xs], "v double"), "v").collect()}
    h = statistics.stdev(xs) * len(xs) ** -0.2
    step = (max(xs) - min(xs)) / 199
    assert len(got) == 200
    for k in (0, 1, 50, 198, 199):
        s = sum(math.exp(-0.5 * ((k * step - x) / h) ** 2) for x in xs)
        assert got[k]["densidade_x1e6"] == pytest.approx(s / (len(xs) * h * math.sqrt(2 * math.pi)) * 1e6, abs=2e-6)
    near = math.ceil(2 * 38.7 * h / step)
    assert near < 200


def test_api_base_joins_customers_before_items(static_spark):
    """Customer attributes come to the orders, so no item row is shuffled by customer."""
    from salesmart.plans.queries import registry

    p = _plan(registry()["api_base"](static_spark, SF01))
    lines = p.splitlines()
    by_customer = [i for i, ln in enumerate(lines) if re.search(r"Exchange hashpartitioning\(customer_id#\d+L?, _part#", ln)]
    assert len(by_customer) >= 2
    for i in by_customer:
        below = next(ln for ln in lines[i:] if "FileScan parquet" in ln)
        assert "o_orderkey" in below or "c_custkey" in below


def test_session_leaves_partitions_to_the_cluster():
    from salesmart.session import session_conf

    assert "spark.sql.shuffle.partitions" not in session_conf()
    assert session_conf(8)["spark.sql.shuffle.partitions"] == "8"


@pytest.mark.parametrize("key, scans", [
    ("sales_base", 2), ("enriched_base", 2), ("analytic_base", 2), ("api_base", 2), ("profile_nulls", 2), ("profile_top_nulls", 2),
    ("profile_duplicates", 2), ("orders_dedup", 1), ("payload_insights", 1), ("trend_quality", 1), ("item_value", 1),
    ("item_freight_pct", 1), ("revenue_by_category", 1), ("items_by_category", 1), ("revenue_by_seller", 1)])
def test_scans_of_the_items(static_spark, key, scans):
    """Item-level keys read the items for the per-order rows, whose exchange also gives the hot orders, and for the join."""
    from salesmart.plans.queries import registry

    p = _plan(registry()[key](static_spark, SF01))
    assert len([ln for ln in p.splitlines() if "FileScan parquet" in ln and "l_orderkey" in ln]) <= scans


@pytest.mark.parametrize("columns", [["order_id", "price"], ["order_id", "atraso_entrega_dias"], []])
def test_hot_orders_share_the_exchange(spark, columns):
    """The executed plan with hot orders present reads the items twice, whatever columns are asked for."""
    import dataclasses

    from salesmart.params import driver_params
    from salesmart.sources.tpch import RawTables, driver_base

    df = driver_base(RawTables(spark, SF01), dataclasses.replace(driver_params(), hot_rows=3))
    df = df.select(*columns) if columns else df.groupBy().count()
    df.collect()
    final = _plan(df).split("== Initial Plan ==")[0]
    assert len([ln for ln in final.splitlines() if "FileScan parquet" in ln and "l_orderkey" in ln]) == 2
    assert "ReusedExchange" in final
