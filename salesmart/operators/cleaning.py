"""Cleaning and the item-level analytic base.

Order-level measures (C4-C8) depend only on order columns, so they can be
derived before or after the item join with the same result; the driver adapter
derives them after the join to avoid a second pass over line items.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.functions.columns import (delivered_flag, elapsed_days, item_total, late_flag,
                                         safe_timestamp, year_month)

ORDER_TIMESTAMPS = (
    "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
    "order_delivered_customer_date", "order_estimated_delivery_date")


def parse_timestamps(df: DataFrame, cols: Sequence[str], fmt: str | None = None) -> DataFrame:
    """Text columns to timestamps, bad values NULL; non-text columns kept as they are."""
    types = dict(df.dtypes)
    return df.withColumns({c: safe_timestamp(c, fmt) for c in cols if c in types and types[c] == "string"})


def derive_delivery(df: DataFrame, delivered_status: str = "delivered") -> DataFrame:
    """Delivery time, promised time, delay (floored days) and the two flags."""
    df = df.withColumns({
        "tempo_entrega_dias": elapsed_days("order_purchase_timestamp", "order_delivered_customer_date"),
        "prazo_estimado_dias": elapsed_days("order_purchase_timestamp", "order_estimated_delivery_date"),
        "atraso_entrega_dias": elapsed_days("order_estimated_delivery_date", "order_delivered_customer_date"),
    })
    return df.withColumns({
        "entregue_com_atraso": late_flag("order_status", "atraso_entrega_dias", delivered_status),
        "pedido_entregue": delivered_flag("order_status", delivered_status),
    })


def derive_values(df: DataFrame) -> DataFrame:
    """Item total and the purchase month."""
    return df.withColumns({
        "valor_total_item": item_total("price", "freight_value"),
        "ano_mes": year_month("order_purchase_timestamp"),
    })


def clean_orders(orders: DataFrame, delivered_status: str = "delivered") -> DataFrame:
    return derive_delivery(parse_timestamps(orders, ORDER_TIMESTAMPS), delivered_status)


def clean_items(items: DataFrame) -> DataFrame:
    return parse_timestamps(items, ["shipping_limit_date"])


def keep_left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left ⟕ right`` on ``key`` when ``right`` may hold a hot key (many rows per key).

    Spark's skew handling cannot split the right side of a left outer join,
    so one key with a third of the rows would land in one task. Written as
    inner join (both sides splittable by AQE) plus the unmatched left rows
    (anti join against the distinct right keys, which collapse map-side),
    the result is the same rows.
    """
    matched = left.join(right, key, "inner")
    keys = right.select(key).where(F.col(key).isNotNull()).distinct()
    unmatched = left.join(keys, key, "left_anti")
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name != key]
    return matched.unionByName(unmatched.select("*", *extra))


def split_left_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, n: str, others: Sequence[str],
                    hot_rows: int) -> DataFrame:
    """``left ⟕ right`` on ``key`` that spreads hot keys of ``right`` over tasks.

    ``counts`` holds ``key``, ``n`` (the number of ``right`` rows of a key) and ``others``; ``left`` already carries
    its columns, NULL where ``right`` has no row. Keys with more than ``hot_rows`` rows get ``ceil(n / hot_rows)``
    salt buckets: each of their ``right`` rows picks a bucket by a hash of its columns and the ``left`` row is
    copied once per bucket, so the join key (key, bucket) spreads one hot key over many tasks. Other keys keep
    bucket 0. A copy whose bucket stays empty finds no row and goes; a ``left`` row without any ``right`` row is
    told by its missing count and stays.

    The hot-key list has at most total rows / ``hot_rows`` entries, a bound of its own (some 200,000 for 10^12
    rows), so it is broadcast. Both uses of ``counts`` read all its columns (the hash of a hot row and the test of a
    missing row take ``others`` along), whatever the caller selects later: so they stay the same plan and share one
    exchange. Nothing runs while it is built.
    """
    buckets = F.ceil(F.col(n) / F.lit(hot_rows)).cast("int")
    hot = F.broadcast(counts.where(F.col(n) > hot_rows).select(
        F.col(key).alias("_hot_key"), buckets.alias("_buckets"), F.xxhash64(*others).alias("_seed")))
    salt = F.pmod(F.xxhash64("_seed", *[F.col(c) for c in right.columns]), F.col("_buckets")).cast("int")
    r = (right.join(hot, F.col(key) == F.col("_hot_key"), "left")
         .withColumn("_right_salt", F.when(F.col("_buckets").isNull(), F.lit(0)).otherwise(salt))
         .withColumnRenamed(key, "_right_key").drop("_hot_key", "_buckets", "_seed"))
    copies = F.when(F.col(n) > hot_rows, buckets).otherwise(F.lit(1))
    lft = left.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    joined = lft.join(r, (F.col(key) == F.col("_right_key")) & (F.col("_salt") == F.col("_right_salt")), "left")
    none = F.col(n).isNull()
    for c in others:
        none = none & F.col(c).isNull()
    return joined.where(F.col("_right_key").isNotNull() | none).drop("_salt", "_right_key", "_right_salt")


def analytic_base(orders: DataFrame, customers: DataFrame, items: DataFrame) -> DataFrame:
    """orders ⟕ customers ⟕ items: one row per item, plus one per itemless order."""
    base = keep_left_join(orders.join(customers, "customer_id", "left"), items, "order_id")
    return derive_values(base)


def join_attributes(left: DataFrame, dim: DataFrame, key: str, spread: str, buckets: int = 1024) -> DataFrame:
    """left ⟕ dim on ``key``, where rows without a key match nothing: they are dealt over the tasks by a hash
    of ``spread`` (itemless orders have no product and no seller, and would all meet in one task)."""
    part = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(buckets))).otherwise(F.lit(0))
    # computed from the key: a plain 0 would be folded into a filter and not be part of the exchange
    d = dim.withColumn("_part", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("bigint"))
    return left.withColumn("_part", part).join(d, [key, "_part"], "left").drop("_part")


def enrich(base: DataFrame, products: DataFrame, sellers: DataFrame, spread: str = "order_id") -> DataFrame:
    """Add product and seller attributes (J3); join strategy left to AQE by size."""
    return join_attributes(join_attributes(base, products, "product_id", spread), sellers, "seller_id", spread)


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """C18."""
    return df.na.drop(subset=list(keys))


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C19."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in cols})
