"""SQL surface: the mart and the reference's views as session views, the state
report as a parameterised query and as a SQL table function (A40-A43, A45, F8, O6).

Users who work in SQL get the same objects the DataFrame functions build:
``register_views`` creates temporary views over lazily built DataFrames (no
data is computed at registration), so every SQL query over them is planned by
Catalyst together with the mart build.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salesmart.operators import reports as R
from salesmart.operators.mart import Mart, sales
from salesmart.operators.orders import order_facts, with_customer
from salesmart.params import Params


def register_views(spark: SparkSession, mart: Mart, params: Params) -> dict[str, DataFrame]:
    """Create the session views; returns them by name."""
    s = sales(mart, params.period)
    orders = order_facts(s, params.thresholds)
    orders_c = with_customer(orders, mart.dim_clientes)
    views = {
        "fato_vendas": mart.fato, "dim_clientes": mart.dim_clientes, "dim_produtos": mart.dim_produtos,
        "dim_vendedores": mart.dim_vendedores, "dim_tempo": mart.dim_tempo,
        "vendas_periodo": s, "pedidos": orders, "pedidos_clientes": orders_c,
        "vw_resumo_vendas_estado": R.view_state_summary(orders_c),
        "vw_resumo_vendas_mensal": R.view_month_summary(orders),
        "vw_pedidos_criticos": R.view_critical_orders(orders),
        "vw_performance_entregas": R.view_delivery_performance(orders_c),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    register_state_function(spark)
    return views


STATE_REPORT_SQL = """
SELECT estado_cliente,
       CAST(sum(receita_itens) AS DECIMAL(15,2)) AS receita_total,
       count(*) AS total_pedidos,
       round(try_divide(CAST(sum(receita_itens) AS DOUBLE), CAST(count(*) AS DOUBLE)), 2) AS ticket_medio
FROM pedidos_clientes
WHERE estado_cliente = {uf}
GROUP BY estado_cliente
"""


def state_report_sql(spark: SparkSession, state: str) -> DataFrame:
    """State report through a named parameter marker (F8); needs ``register_views``."""
    return spark.sql(STATE_REPORT_SQL.format(uf=":uf"), args={"uf": state})


def register_state_function(spark: SparkSession) -> None:
    """``SELECT * FROM relatorio_estado('SP')`` as a temporary SQL table function."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION relatorio_estado(uf STRING) "
        "RETURNS TABLE (estado_cliente STRING, receita_total DECIMAL(15,2), total_pedidos BIGINT, "
        "ticket_medio DOUBLE) RETURN " + STATE_REPORT_SQL.format(uf="uf"))
