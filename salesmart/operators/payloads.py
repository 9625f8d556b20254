"""Report payloads: the reference's API responses as one-row DataFrames.

Maps keep their order (T24): rows are collected as ``struct(rank, key, value)``,
sorted, then turned into a map, so ``to_json`` prints them in rank order. The
maps are keyed by states or months — bounded domains, not data rows — and the
ranked-rows form (``*_rows``) is what callers use when the domain could grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesmart.functions.text import brl, days_text, int_text, pct_text
from salesmart.operators import reports as R


def ranked(df: DataFrame, value: str, key: str) -> DataFrame:
    """Add ``posicao`` by value desc, key asc; run on small, already aggregated frames."""
    return df.withColumn("posicao", F.row_number().over(
        Window.orderBy(F.col(value).desc_nulls_last(), F.col(key).asc_nulls_last())))


def ordered_map(rows: DataFrame, rank: str, key: str, value: str) -> DataFrame:
    """One row with a map key -> value in rank order."""
    entry = F.struct(F.col(rank).alias("r"), F.col(key).alias("k"), F.col(value).alias("v"))
    entries = F.array_sort(F.collect_list(entry))
    kv = F.transform(entries, lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value")))
    return rows.agg(F.map_from_entries(kv).alias("mapa"))


def payload_root(orders: DataFrame) -> DataFrame:
    """Orders and the first/last date."""
    return R.data_period(orders)


def formatted_kpis(orders: DataFrame) -> DataFrame:
    """Revenue, orders and ticket as text."""
    k = R.kpi_totals(orders)
    return k.select(brl("receita_total").alias("receita_total"), int_text("total_pedidos").alias("total_pedidos"),
                    brl("ticket_medio").alias("ticket_medio"))


def state_revenue_rows(orders_c: DataFrame) -> DataFrame:
    """States by revenue with money text (R3 rows)."""
    g = R.revenue_by(orders_c, "estado_cliente").where(F.col("estado_cliente").isNotNull())
    return ranked(g, "receita_total", "estado_cliente").select(
        "posicao", "estado_cliente", "receita_total", brl("receita_total").alias("receita_texto"))


def payload_states(orders_c: DataFrame, focus_state: str) -> DataFrame:
    """State -> money text map plus the focus state's share, 0 where it has no sales."""
    m = ordered_map(state_revenue_rows(orders_c), "posicao", "estado_cliente", "receita_texto")
    s = R.state_share(orders_c, focus_state).select(
        pct_text(F.coalesce("participacao_pct", F.lit(0.0))).alias("participacao_foco"))
    return m.select(F.to_json("mapa").alias("receita_por_estado"), s.scalar().alias("participacao_foco"))


def month_revenue_rows(orders: DataFrame) -> DataFrame:
    """Months ascending with money text (R4 rows)."""
    g = orders.groupBy("ano_mes").agg(F.sum("receita_itens").alias("receita_total"))
    return g.select("ano_mes", "receita_total", brl("receita_total").alias("receita_texto"))


def payload_months(orders: DataFrame) -> DataFrame:
    """Month -> money text map, months ascending."""
    m = month_revenue_rows(orders)
    return ordered_map(m, "ano_mes", "ano_mes", "receita_texto").select(
        F.to_json("mapa").alias("receita_mensal"))


def payload_insights(orders: DataFrame) -> DataFrame:
    """Critical orders and late rate, numbers and text."""
    dlv = F.col("pedido_entregue") == 1
    a = orders.agg(F.sum("pedido_critico").cast("bigint").alias("pedidos_criticos"), F.count("*").alias("total_pedidos"),
                   F.count_if(dlv).alias("entregues"), F.count_if(dlv & (F.col("entregue_com_atraso") == 1)).alias("atrasados"))
    c = a.withColumns({"pct_criticos": R.ratio("pedidos_criticos", "total_pedidos", 100.0),
                       "taxa_atraso_pct": R.ratio("atrasados", "entregues", 100.0)})
    return c.select(
        "pedidos_criticos", "total_pedidos", F.round("pct_criticos", 6).alias("pct_criticos"),
        pct_text("pct_criticos").alias("pct_criticos_texto"),
        F.round("taxa_atraso_pct", 6).alias("taxa_atraso_pct"),
        pct_text("taxa_atraso_pct").alias("taxa_atraso_texto"))


def freight_rows(orders_c: DataFrame, k: int = 5) -> DataFrame:
    """Top-k freight-share states with order counts (R6 rows)."""
    t = R.freight_share_by(orders_c.where(F.col("estado_cliente").isNotNull()), "estado_cliente", k)
    return ranked(t, "frete_pct", "estado_cliente").select(
        "posicao", "estado_cliente", F.round("frete_pct", 6).alias("frete_pct"),
        pct_text("frete_pct").alias("frete_texto"), "total_pedidos", int_text("total_pedidos").alias("pedidos_texto"))


def late_rows(orders_c: DataFrame, min_orders: int, k: int = 5) -> DataFrame:
    """Top-k late-rate states with at least ``min_orders`` orders; empty-safe (R7 rows)."""
    t = R.late_rate_by(orders_c.where(F.col("estado_cliente").isNotNull()), "estado_cliente", min_orders, k)
    return ranked(t, "taxa_atraso_pct", "estado_cliente").select(
        "posicao", "estado_cliente", F.round("taxa_atraso_pct", 6).alias("taxa_atraso_pct"),
        pct_text("taxa_atraso_pct").alias("taxa_texto"), "total_pedidos",
        int_text("total_pedidos").alias("pedidos_texto"))


def payload_ranked(rows: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """Ranked rows -> one-row JSON map (R6, R7); an empty input gives ``{}``."""
    return ordered_map(rows, "posicao", key, text).select(F.to_json("mapa").alias(name))


def payload_impact(rows: DataFrame, key: str, text: str, text_name: str, name: str) -> DataFrame:
    """Ranked rows -> one-row JSON map key -> {percent text, order count text}."""
    both = F.struct(F.col(text).alias(text_name), F.col("pedidos_texto").alias("total_pedidos"))
    return payload_ranked(rows.withColumn("_ambos", both), key, "_ambos", name)


def formatted_snapshot(snapshot: DataFrame) -> DataFrame:
    """KPI snapshot as text."""
    return snapshot.select(
        "data_calculo", brl("receita_total").alias("receita_total"), int_text("total_pedidos").alias("total_pedidos"),
        brl("ticket_medio").alias("ticket_medio"), pct_text("taxa_atraso").alias("taxa_atraso"),
        pct_text("perc_pedidos_criticos").alias("perc_pedidos_criticos"))


def formatted_delivery(view: DataFrame) -> DataFrame:
    """Delivery performance by state as text, days with their suffix."""
    counts = ("total_pedidos", "pedidos_entregues", "pedidos_atrasados")
    return view.select("estado_cliente", *[int_text(c).alias(c) for c in counts],
                       days_text("tempo_medio_entrega_dias").alias("tempo_medio_entrega"),
                       pct_text("taxa_atraso_pct").alias("taxa_atraso_pct"))
