"""Adapter: the driver's TPC-H-shaped tables as the reference's raw inputs.

Mapping (fixed for this adapter):
    order  <- orders:   order_id=o_orderkey, customer_id=o_custkey, status=o_orderstatus,
                        purchase=o_orderdate, estimate=o_orderdate + 365 days x priority digit
    item   <- lineitem: order_item_id=l_linenumber, product_id=l_partkey, seller_id=l_suppkey,
                        price=extendedprice x (1-discount), freight=extendedprice x tax (decimals)
    delivered date      = latest l_shipdate of the order
    customer <- customer + nation: unique id = c_custkey, state = nation name,
                        city = lower("<segment> <nation>")
    product  <- part:   category = p_type;  seller <- supplier + nation: state = nation name

The delivered date is the latest ship date of the order's items, taken as an
aggregate (map-side combined, safe for a hot order) and joined 1:1 to orders;
the items are joined with hot orders salted (``split_left_join``).
"""

from __future__ import annotations

import os
from decimal import Decimal
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.functions.columns import item_total, year_month
from salesmart.operators.cleaning import derive_delivery, derive_values, join_attributes, split_left_join
from salesmart.params import Params

PRIORITY_DAYS = 365  # promised days per priority step (1-URGENT .. 5-LOW)


# Explicit schemas of the driver tables: no footer inference per read, and the
# scan reads only these columns even before Catalyst prunes further.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    schema = SCHEMAS.get(name)
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


class RawTables:
    """The driver tables in the raw shape; each frame is built (and its table read) on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def nation(self) -> DataFrame:
        return self._t("nation").select("n_nationkey", "n_name")

    @cached_property
    def orders(self) -> DataFrame:
        o = self._t("orders").where(F.col("o_orderkey").isNotNull())  # primary key
        priority = F.substring("o_orderpriority", 1, 1).try_cast("int")
        return o.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            F.timestamp_add("DAY", priority * F.lit(PRIORITY_DAYS), F.col("o_orderdate"))
             .alias("order_estimated_delivery_date"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        c = self._t("customer")
        n = self.nation
        return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_custkey").alias("customer_unique_id"),
            F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("customer_zip_code_prefix"),
            F.lower(F.concat_ws(" ", "c_mktsegment", "n_name")).alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )

    @cached_property
    def items(self) -> DataFrame:
        ext = F.col("l_extendedprice").cast("decimal(12,2)")
        return self._t("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            (ext * (F.lit(Decimal("1")) - F.col("l_discount").cast("decimal(4,2)"))).alias("price"),
            (ext * F.col("l_tax").cast("decimal(4,2)")).alias("freight_value"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return self._t("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_type").alias("product_category_name"),
            F.length("p_name").alias("product_name_lenght"),
            F.length(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("product_description_lenght"),
            F.col("p_size").alias("product_weight_g"),
        )

    @cached_property
    def sellers(self) -> DataFrame:
        s = self._t("supplier")
        n = self.nation
        return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(
            F.col("s_suppkey").alias("seller_id"),
            F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("seller_zip_code_prefix"),
            F.lower("n_name").alias("seller_city"),
            F.col("n_name").alias("seller_state"),
        )


def raw_text(raw: RawTables) -> DataFrame:
    """Events as raw text: time and number are text, and in rows of type ``error`` neither can be parsed."""
    broken = F.col("event_type") == "error"
    return raw._t("events").select(
        "event_id", F.when(broken, F.col("props")).otherwise(F.col("ts").cast("string")).alias("instante"),
        F.when(broken, F.col("event_type")).otherwise(F.regexp_extract("props", ": ([0-9]+)", 1)).alias("valor"))


def raw_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    """Driver tables in the raw shape."""
    return RawTables(spark, sf_dir)


def per_order_items(raw: RawTables) -> DataFrame:
    """One row per order with items: delivered date (latest ship date) and the sums and counts
    of its items. A map-side-combined aggregate, so a hot order costs one row per task."""
    value = item_total("price", "freight_value")
    return raw.items.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.max("shipping_limit_date").alias("order_delivered_customer_date"),
        F.count("*").alias("_n_linhas"),
        F.sum(value).alias("receita_itens"),
        F.sum("freight_value").alias("frete_itens"),
        F.count(value).alias("n_valores"),
        F.count("order_item_id").alias("n_itens"))


def driver_orders(raw: RawTables, params: Params) -> DataFrame:
    """Order-level base (orders ⟕ items aggregated per order): all that order-grain reports need,
    from one scan of the items and without an item row in a join. Filters on order columns (the
    report period) reach the orders scan."""
    o = raw.orders.join(per_order_items(raw), "order_id", "left")
    o = o.withColumn("customer_unique_id", F.col("customer_id"))
    return derive_delivery(o, params.delivered_status).withColumn("ano_mes", year_month("order_purchase_timestamp"))


def driver_base(raw: RawTables, params: Params, customers: DataFrame | None = None) -> DataFrame:
    """Item-level base from the driver tables: orders ⟕ items.

    Here the order's customer key already is the unique customer id, so the
    fact needs no customer join; customer attributes live in the customer
    dimension, joined at order grain where a report needs them. ``customers``, where
    given, are joined to the orders before the items (J1, J2).

    The delivered date and the item count come from the per-order aggregate, joined 1:1.
    The items then come by a left join that salts orders above ``params.hot_rows`` items
    over several tasks (``split_left_join``), so it has no side that a hot order could
    overfill. The items are read twice: for the aggregate, whose exchange also serves the
    list of hot orders, and for the join. Nothing is cached.
    """
    per_order = raw.items.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.max("shipping_limit_date").alias("order_delivered_customer_date"),
        F.count("*").alias("_n_itens"))
    orders = raw.orders if customers is None else join_attributes(raw.orders, customers, "customer_id", "order_id")
    orders = orders.join(per_order, "order_id", "left")
    joined = split_left_join(orders, raw.items, "order_id", per_order, "_n_itens", ["order_delivered_customer_date"],
                             params.hot_rows)
    joined = joined.drop("_n_itens").withColumn("customer_unique_id", F.col("customer_id"))
    return derive_values(derive_delivery(joined, params.delivered_status))
