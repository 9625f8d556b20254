"""Per-order facts (A17, C15, C16) — the hub of every order-level report.

One ``groupBy(id_pedido)``: when the fact comes straight from the
orders ⟕ lineitem join it is already hash-partitioned by the order key, so the
aggregate runs without a new exchange. Every "COUNT(DISTINCT id_pedido)" and
"COUNT(DISTINCT CASE ...)" of the reference becomes a plain count over these
rows, and state/city reports join customers at order grain instead of item grain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.functions.columns import critical_flag, share_pct, year_month
from salesmart.params import Thresholds


def order_facts(sales: DataFrame, th: Thresholds) -> DataFrame:
    o = sales.groupBy("id_pedido").agg(
        F.min("id_cliente").alias("id_cliente"),  # constant per order (T8)
        F.min("data").alias("data"),
        F.min("status_pedido").alias("status_pedido"),
        F.sum("valor_total_item").alias("receita_itens"),  # NULL for itemless orders (SQL sum)
        F.sum("valor_frete").alias("frete_itens"),
        F.count("valor_total_item").alias("n_valores"),
        F.count("id_item_pedido").alias("n_itens"),
        F.max("entregue_com_atraso").alias("entregue_com_atraso"),
        F.max("pedido_entregue").alias("pedido_entregue"),
        F.sum("tempo_entrega_dias").alias("soma_tempo_itens"),
        F.count("tempo_entrega_dias").alias("n_tempo_itens"),
        F.avg("tempo_entrega_dias").alias("tempo_medio_entrega_dias"),
    )
    return _order_values(o, th)


def order_facts_direct(orders: DataFrame, th: Thresholds) -> DataFrame:
    """The same rows from an order-level base (``sources.tpch.driver_orders``), without item rows.

    An order's measures count once per item row, as in the item-level base; an itemless order is one row.
    """
    rows = F.coalesce(F.col("_n_linhas"), F.lit(1))
    t = F.col("tempo_entrega_dias")
    o = orders.select(
        F.col("order_id").alias("id_pedido"),
        F.col("customer_unique_id").alias("id_cliente"),
        F.to_date("order_purchase_timestamp").alias("data"),
        F.col("order_status").alias("status_pedido"),
        "receita_itens", "frete_itens",
        F.coalesce("n_valores", F.lit(0).cast("bigint")).alias("n_valores"),
        F.coalesce("n_itens", F.lit(0).cast("bigint")).alias("n_itens"),
        "entregue_com_atraso", "pedido_entregue",
        (t * rows).alias("soma_tempo_itens"),
        F.when(t.isNotNull(), rows).otherwise(F.lit(0).cast("bigint")).alias("n_tempo_itens"),
        t.cast("double").alias("tempo_medio_entrega_dias"),
    )
    return _order_values(o, th)


def _order_values(o: DataFrame, th: Thresholds) -> DataFrame:
    zero = F.lit(0).cast("decimal(38,4)")
    o = o.withColumns({
        # T4: an itemless order is worth 0, so it stays in ticket denominators
        "valor_pedido": F.coalesce(F.col("receita_itens"), zero),
        "frete_pedido": F.coalesce(F.col("frete_itens"), zero),
        "ano_mes": year_month("data"),
    })
    return o.withColumns({
        "peso_frete_pedido_pct": share_pct("frete_pedido", "valor_pedido"),
        "pedido_critico": critical_flag("valor_pedido", "frete_pedido", th),
    })


def with_customer(orders: DataFrame, dim_clientes: DataFrame, how: str = "inner") -> DataFrame:
    """Order rows with customer state and city (J5 at order grain).

    The customer dimension grows with the data, so no broadcast hint: AQE
    picks broadcast only when the runtime size is under the threshold.
    """
    return orders.join(dim_clientes.select("id_cliente", "estado_cliente", "cidade_cliente"),
                       "id_cliente", how)
