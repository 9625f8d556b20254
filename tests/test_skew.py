"""A hot order (a third of all line items) is salted over tasks; results stay exact."""

from pyspark.sql import functions as F

from conftest import SF001
from salesmart.operators import reports as R
from salesmart.operators.mart import fato_vendas
from salesmart.operators.orders import order_facts
from salesmart.params import Params, Period, Thresholds
from salesmart.sources.tpch import RawTables, driver_base


def _skewed_raw(spark):
    raw = RawTables(spark, SF001)
    items = raw.items
    hot = raw.orders.agg(F.min("order_id")).first()[0]
    cut = items.agg(F.percentile("product_id", 1 / 3)).first()[0]
    # every item of the lowest third of products moves to one order
    raw.__dict__["items"] = items.withColumn(
        "order_id", F.when(F.col("product_id") <= cut, F.lit(hot)).otherwise(F.col("order_id")))
    return raw, hot


def _facts(raw, hot_rows):
    p = Params(period=Period.of("1990-01-01", "2030-12-31"), thresholds=Thresholds(), delivered_status="F",
               hot_rows=hot_rows)
    fact = fato_vendas(driver_base(raw, p))
    return fact, order_facts(fact, p.thresholds)


def test_hot_order_salted_and_exact(spark):
    raw, hot = _skewed_raw(spark)
    n_hot = raw.items.where(F.col("order_id") == hot).count()
    assert n_hot * 3 >= raw.items.count() * 0.9
    fact_s, salted = _facts(raw, hot_rows=100)        # the hot order is split into many buckets
    fact_p, plain = _facts(raw, hot_rows=10**12)      # no salting
    plan = fact_s._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan
    assert fact_s.count() == fact_p.count()
    a, b = R.executive_dashboard(salted).first(), R.executive_dashboard(plain).first()
    assert a.asDict() == b.asDict()
    row = salted.where(F.col("id_pedido") == hot).first()
    assert row["n_itens"] == n_hot


def test_split_left_join_is_a_left_join(spark):
    """Equal rows that share a bucket, empty buckets, rows without a match and without a key, keys only on the right."""
    from salesmart.operators.cleaning import split_left_join

    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "k int, x string")
    right = spark.createDataFrame([(1, None)] * 7 + [(1, 5)] * 4 + [(2, 9), (9, 1), (None, 2)], "k int, v int")
    counts = right.where(F.col("k").isNotNull()).groupBy("k").agg(F.max("v").alias("top"), F.count("*").alias("n"))
    with_counts = left.join(counts, "k", "left")
    want = sorted(map(str, left.join(right, "k", "left").select("k", "x", "v").collect()))
    for hot_rows in (1, 2, 3, 100):
        got = split_left_join(with_counts, right, "k", counts, "n", ["top"], hot_rows)
        assert sorted(map(str, got.select("k", "x", "v").collect())) == want
    none = split_left_join(with_counts.where("x = 'c'"), right.limit(0), "k", counts.limit(0), "n", ["top"], 1)
    assert [tuple(r) for r in none.select("k", "x", "v").collect()] == [(3, "c", None)]
