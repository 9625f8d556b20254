"""KPIs, rankings and summary views.

Inputs are per-order rows from ``order_facts`` (``orders``) or those rows with
customer state/city (``orders_c``, see ``with_customer``). Working at order
grain turns the reference's distinct counts into plain counts, and the
one-row KPIs are single global aggregates (partial per task, one tiny merge).

Ratios are computed in double from exact decimal sums; money stays decimal.
Rankings sort by value and then by key, so ties are deterministic (T12).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesmart.functions.text import NO, YES


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def ratio(num, den, scale: float = 1.0) -> Column:
    """``num / den * scale`` in double; NULL when ``den`` is 0 or NULL."""
    r = F.try_divide(_d(num), F.nullif(_d(den), F.lit(0.0)))
    return r * F.lit(scale) if scale != 1.0 else r


def top(df: DataFrame, value: str, key: str, k: int | None) -> DataFrame:
    """Top-k by ``value`` desc, ``key`` asc as tie-break (O1, O2); k=None keeps all."""
    if k is None:
        return df
    return df.orderBy(F.col(value).desc_nulls_last(), F.col(key).asc_nulls_last()).limit(k)


# --------------------------------------------------------------------------- KPIs

def kpi_totals(orders: DataFrame) -> DataFrame:
    """Revenue, distinct orders, revenue per order, mean item value."""
    a = orders.agg(F.sum("receita_itens").alias("receita_total"),
                   F.count("*").alias("total_pedidos"),
                   F.sum("n_valores").alias("n_valores"))
    return a.select("receita_total", "total_pedidos",
                    ratio("receita_total", "total_pedidos").alias("ticket_medio"),
                    ratio("receita_total", "n_valores").alias("valor_medio_item"))


def kpi_delivery(orders: DataFrame) -> DataFrame:
    """Delivered orders and their share of all orders (A3)."""
    a = orders.agg(F.count("*").alias("total_pedidos"),
                   F.count_if(F.col("pedido_entregue") == 1).alias("pedidos_entregues"))
    return a.withColumn("pct_entregues", ratio("pedidos_entregues", "total_pedidos", 100.0))


def late_rate(orders: DataFrame) -> DataFrame:
    """Late share of delivered orders, unknown delay counted as on time."""
    dlv = F.col("pedido_entregue") == 1
    a = orders.agg(
        F.count_if(dlv).alias("pedidos_entregues"),
        F.count_if(dlv & (F.col("entregue_com_atraso") == 1)).alias("pedidos_atrasados"),
        F.count_if(dlv & (F.col("entregue_com_atraso") == 0)).alias("pedidos_no_prazo"),
        F.count_if(dlv & F.col("entregue_com_atraso").isNull()).alias("pedidos_sem_data"))
    return a.withColumn("taxa_atraso_pct", ratio("pedidos_atrasados", "pedidos_entregues", 100.0))


def late_rate_known(orders: DataFrame) -> DataFrame:
    """Late share among delivered orders with a known delay."""
    d = orders.where(F.col("pedido_entregue") == 1)
    a = d.agg(F.count("entregue_com_atraso").alias("pedidos_com_flag"),
              F.sum("entregue_com_atraso").cast("bigint").alias("pedidos_atrasados"))
    return a.withColumn("taxa_atraso_pct", ratio("pedidos_atrasados", "pedidos_com_flag", 100.0))


def critical_orders(orders: DataFrame) -> DataFrame:
    """Count and share of critical orders."""
    a = orders.agg(F.sum("pedido_critico").cast("bigint").alias("pedidos_criticos"),
                   F.count("*").alias("total_pedidos"))
    return a.withColumn("pct_criticos", ratio("pedidos_criticos", "total_pedidos", 100.0))


def kpi_freight(orders: DataFrame) -> DataFrame:
    """Mean per-order freight share and the overall freight share (A20, A13 total)."""
    return orders.agg(
        F.round(F.avg("peso_frete_pedido_pct"), 6).alias("peso_frete_medio_pct"),
        ratio(F.sum("frete_itens"), F.sum("receita_itens"), 100.0).alias("peso_frete_total_pct"))


def executive_dashboard(orders: DataFrame) -> DataFrame:
    """Six KPIs in one pass (A39): the reference's repeated scalar subqueries (J8) become one aggregate."""
    dlv = F.col("pedido_entregue") == 1
    a = orders.agg(
        F.sum("receita_itens").alias("receita_total"),
        F.count("*").alias("total_pedidos"),
        F.sum("frete_itens").alias("frete_total"),
        F.count_if(dlv).alias("entregues"),
        F.count_if(dlv & (F.col("entregue_com_atraso") == 1)).alias("atrasados"),
        F.sum("pedido_critico").cast("bigint").alias("pedidos_criticos"))
    return a.select(
        "receita_total", "total_pedidos",
        ratio("receita_total", "total_pedidos").alias("ticket_medio"),
        ratio("frete_total", "receita_total", 100.0).alias("peso_frete_pct"),
        ratio("atrasados", "entregues", 100.0).alias("taxa_atraso_pct"),
        "pedidos_criticos")


def kpi_snapshot(orders: DataFrame, run_date: dt.date) -> DataFrame:
    """Five KPIs stamped with the run date, in the snapshot table's types."""
    k = executive_dashboard(orders)
    return k.select(
        F.lit(run_date).alias("data_calculo"),
        F.col("receita_total").cast("decimal(15,2)").alias("receita_total"),
        F.col("total_pedidos").cast("int").alias("total_pedidos"),
        F.round("ticket_medio", 2).alias("ticket_medio"),
        F.round("taxa_atraso_pct", 2).alias("taxa_atraso"),
        F.round(ratio("pedidos_criticos", "total_pedidos", 100.0), 2).alias("perc_pedidos_criticos"))


def data_period(orders: DataFrame) -> DataFrame:
    """First and last order date."""
    return orders.agg(F.min("data").alias("primeira_data"), F.max("data").alias("ultima_data"),
                      F.count("*").alias("total_pedidos"))


# ----------------------------------------------------------------------- rankings

def revenue_by(orders_c: DataFrame, dim: str, k: int | None = None) -> DataFrame:
    """Revenue per dimension value (A7; NULL group kept as in SQL, T5)."""
    g = orders_c.groupBy(dim).agg(F.sum("receita_itens").alias("receita_total"))
    return top(g, "receita_total", dim, k)


def orders_by(orders_c: DataFrame, dim, k: int | None = None, name: str | None = None) -> DataFrame:
    """Distinct orders per dimension value."""
    g = orders_c.groupBy(dim).agg(F.count("*").alias("total_pedidos"))
    key = name or (dim if isinstance(dim, str) else g.columns[0])
    return top(g, "total_pedidos", key, k)


def revenue_by_seller(sales: DataFrame, dim_vendedores: DataFrame | None, k: int | None = 10) -> DataFrame:
    """Revenue per seller.

    Aggregated before the join (one row per seller leaves each task), then
    semi-joined to the seller dimension, which is what the inner join did.
    Without a dimension every seller that sold counts, as a dimension built
    from the same sales would have it.
    """
    g = sales.groupBy("id_vendedor").agg(F.sum("valor_total_item").alias("receita_total")).where(F.col("id_vendedor").isNotNull())
    if dim_vendedores is not None:
        g = g.join(dim_vendedores.select("id_vendedor"), "id_vendedor", "left_semi")
    return top(g, "receita_total", "id_vendedor", k)


def _by_category(sales: DataFrame, dim_produtos: DataFrame, how: str) -> DataFrame:
    """``how``: inner with a dimension of the products sold; left with all products, a sold one that is not there having no category."""
    per_product = sales.groupBy("id_produto").agg(
        F.sum("valor_total_item").alias("receita"), F.count("*").alias("itens")).where(F.col("id_produto").isNotNull())
    return per_product.join(dim_produtos.select("id_produto", "categoria_produto"), "id_produto", how)


def revenue_by_category(sales: DataFrame, dim_produtos: DataFrame, k: int | None = 10, how: str = "inner") -> DataFrame:
    """Revenue per category, NULL category its own group (A10, T5); pre-aggregated per product."""
    g = _by_category(sales, dim_produtos, how).groupBy("categoria_produto").agg(
        F.sum("receita").alias("receita_total"))
    return top(g, "receita_total", "categoria_produto", k)


def items_by_category(sales: DataFrame, dim_produtos: DataFrame, k: int | None = 10, how: str = "inner") -> DataFrame:
    """Items sold per category."""
    g = _by_category(sales, dim_produtos, how).groupBy("categoria_produto").agg(
        F.sum("itens").cast("bigint").alias("total_itens_vendidos"))
    return top(g, "total_itens_vendidos", "categoria_produto", k)


def ticket_by(orders_c: DataFrame, dim: str = "estado_cliente") -> DataFrame:
    """Revenue per order by dimension, ordered by revenue."""
    g = orders_c.groupBy(dim).agg(F.sum("receita_itens").alias("receita_total"),
                                  F.count("*").alias("total_pedidos"))
    return g.withColumn("ticket_medio", ratio("receita_total", "total_pedidos"))


def freight_share_by(orders_c: DataFrame, dim: str = "estado_cliente", k: int | None = None) -> DataFrame:
    """Freight / (product + freight) per dimension."""
    g = orders_c.groupBy(dim).agg(F.sum("frete_itens").alias("frete_total"),
                                  F.sum("receita_itens").alias("receita_total"),
                                  F.count("*").alias("total_pedidos"))
    g = g.withColumn("frete_pct", ratio("frete_total", "receita_total", 100.0))
    return top(g, "frete_pct", dim, k)


def late_rate_by(orders_c: DataFrame, dim: str = "estado_cliente", min_orders: int = 100,
                 k: int | None = None) -> DataFrame:
    """Late rate per dimension, groups with at least ``min_orders`` orders."""
    g = orders_c.groupBy(dim).agg(
        F.count("*").alias("total_pedidos"),
        F.count_if(F.col("pedido_entregue") == 1).alias("pedidos_entregues"),
        F.count_if(F.col("entregue_com_atraso") == 1).alias("pedidos_atrasados"))
    g = (g.where(F.col("total_pedidos") >= min_orders)
         .withColumn("taxa_atraso_pct", ratio("pedidos_atrasados", "pedidos_entregues", 100.0)))
    return top(g, "taxa_atraso_pct", dim, k)


def delivery_time_by(orders_c: DataFrame, dim: str = "estado_cliente", weight: str = "item") -> DataFrame:
    """Mean delivery days per dimension (A15 item-weighted / A16 order-weighted, T19).

    Only rows with a known time count (F4); the time and customer dimensions of
    the SQL version (J6) are the period filter and ``orders_c``.
    """
    if weight == "item":
        g = (orders_c.where(F.col("n_tempo_itens") > 0).groupBy(dim)
             .agg(F.sum("soma_tempo_itens").alias("s"), F.sum("n_tempo_itens").alias("n")))
        return g.select(dim, F.round(ratio("s", "n"), 6).alias("tempo_medio_entrega_dias"))
    d = orders_c.where(F.col("pedido_entregue") == 1)
    g = d.groupBy(dim).agg(
        F.count("*").alias("pedidos_entregues"),
        F.sum("entregue_com_atraso").cast("bigint").alias("pedidos_atrasados"),
        F.round(F.avg("tempo_medio_entrega_dias"), 6).alias("tempo_medio_entrega_dias"))
    return g.withColumn("taxa_atraso_pct", ratio("pedidos_atrasados", "pedidos_entregues", 100.0))


def revenue_by_status(orders: DataFrame) -> DataFrame:
    """Revenue and orders per order status."""
    return orders.groupBy("status_pedido").agg(F.sum("receita_itens").alias("receita_total"),
                                               F.count("*").alias("total_pedidos"))


def concentration(ranking: DataFrame, key: str, value: str, total: DataFrame, k: int) -> DataFrame:
    """Share of the total for the top-k, each and running.

    ``total`` is a one-row aggregate, read as a scalar subquery.
    """
    t = top(ranking.where(F.col(key).isNotNull()), value, key, k)
    w = Window.orderBy(F.col(value).desc(), F.col(key).asc())  # k rows only, after the limit
    t = t.withColumn("_total", total.select("total").scalar())
    return t.select(
        F.row_number().over(w).alias("posicao"), key, value,
        ratio(value, "_total", 100.0).alias("participacao_pct"),
    ).withColumn("participacao_acumulada_pct",
                 F.round(F.sum("participacao_pct").over(Window.orderBy("posicao")
                                                        .rowsBetween(Window.unboundedPreceding, 0)), 6))


def state_share(orders_c: DataFrame, state: str) -> DataFrame:
    """Revenue share of one named state."""
    a = orders_c.agg(
        F.sum(F.when(F.col("estado_cliente") == state, F.col("receita_itens"))).alias("receita_estado"),
        F.sum("receita_itens").alias("receita_total"))
    return a.select(F.lit(state).alias("estado_cliente"), "receita_estado", "receita_total",
                    ratio("receita_estado", "receita_total", 100.0).alias("participacao_pct"))


def state_report(orders_c: DataFrame, state: str) -> DataFrame:
    """Revenue, orders and ticket of one state."""
    s = orders_c.where(F.col("estado_cliente") == F.lit(state))
    a = s.agg(F.sum("receita_itens").alias("receita_total"), F.count("*").alias("total_pedidos"))
    return a.select(F.lit(state).alias("estado_cliente"),
                    F.col("receita_total").cast("decimal(15,2)").alias("receita_total"),
                    "total_pedidos",
                    F.round(ratio("receita_total", "total_pedidos"), 2).alias("ticket_medio"))


def orders_by_weekday(orders: DataFrame) -> DataFrame:
    """Orders and revenue per ISO weekday, 1 = Monday."""
    return orders.groupBy((F.weekday("data") + 1).alias("dia_semana"),
                          F.date_format("data", "EEEE").alias("nome_dia")).agg(
        F.count("*").alias("total_pedidos"), F.sum("receita_itens").alias("receita_total"))


def value_split(orders: DataFrame, flag: str) -> DataFrame:
    """Value counts of a 0/1 flag, NULL left out, with shares."""
    g = orders.where(F.col(flag).isNotNull()).groupBy(F.col(flag).alias("valor")).agg(
        F.count("*").alias("contagem"))
    w = Window.partitionBy()  # two rows at most
    return g.withColumn("pct", ratio("contagem", F.sum("contagem").over(w), 100.0))


# -------------------------------------------------------------------------- views

def view_state_summary(orders_c: DataFrame) -> DataFrame:
    """State summary view."""
    g = orders_c.groupBy("estado_cliente").agg(
        F.count("*").alias("total_pedidos"), F.sum("receita_itens").alias("receita_total"),
        F.sum("frete_itens").alias("frete_total"))
    return g.select("estado_cliente", "total_pedidos", "receita_total",
                    ratio("receita_total", "total_pedidos").alias("ticket_medio"),
                    ratio("frete_total", "receita_total", 100.0).alias("peso_frete_pct"))


def month_summary(orders: DataFrame) -> DataFrame:
    """Revenue, orders and ticket per month (A48; content of the monthly table, K7)."""
    g = orders.groupBy("ano_mes").agg(F.sum("receita_itens").alias("receita"),
                                      F.count("*").alias("total_pedidos"))
    return g.select("ano_mes", F.col("receita").cast("decimal(15,2)").alias("receita_total"),
                    "total_pedidos", F.round(ratio("receita", "total_pedidos"), 2).alias("ticket_medio"))


def view_month_summary(orders: DataFrame) -> DataFrame:
    """Month summary with change against the previous month.

    The window runs after the aggregate: one row per month, never per item.
    """
    g = orders.groupBy("ano_mes").agg(F.count("*").alias("total_pedidos"),
                                      F.sum("receita_itens").alias("receita_total"))
    prev = F.lag("receita_total").over(Window.orderBy("ano_mes"))
    return g.select("ano_mes", "total_pedidos", "receita_total",
                    ratio("receita_total", "total_pedidos").alias("ticket_medio"),
                    ratio(F.col("receita_total") - prev, prev, 100.0).alias("variacao_pct"))


def view_critical_orders(orders: DataFrame) -> DataFrame:
    """One row per order with freight share and the critical verdict."""
    return orders.select(
        "id_pedido",
        F.col("receita_itens").alias("valor_pedido"),
        F.col("frete_itens").alias("frete_pedido"),
        ratio("frete_itens", "receita_itens", 100.0).alias("peso_frete_pct"),
        F.when(F.col("pedido_critico") == 1, YES).otherwise(NO).alias("is_critico"),
        ratio("frete_itens", "receita_itens").alias("ordem_critico"))


def view_delivery_performance(orders_c: DataFrame) -> DataFrame:
    """Delivery performance by state."""
    g = orders_c.groupBy("estado_cliente").agg(
        F.count("*").alias("total_pedidos"),
        F.count_if(F.col("pedido_entregue") == 1).alias("pedidos_entregues"),
        F.count_if(F.col("entregue_com_atraso") == 1).alias("pedidos_atrasados"),
        F.sum("soma_tempo_itens").alias("s"), F.sum("n_tempo_itens").alias("n"))
    return g.select("estado_cliente", "total_pedidos", "pedidos_entregues", "pedidos_atrasados",
                    F.round(ratio("s", "n"), 6).alias("tempo_medio_entrega_dias"),
                    ratio("pedidos_atrasados", "pedidos_entregues", 100.0).alias("taxa_atraso_pct"))

