"""SQL surface over the mart: session views, parameterised state report, SQL table function."""

import pytest

from conftest import SF001
from salesmart.operators import reports as R
from salesmart.plans.queries import Job
from salesmart.plans.views import register_views, state_report_sql


def test_views_and_state_report(spark):
    j = Job(spark, SF001)
    register_views(spark, j.mart, j.p)
    state = spark.sql("SELECT estado_cliente FROM vw_resumo_vendas_estado ORDER BY total_pedidos DESC LIMIT 1").first()[0]
    df_api = R.state_report(j.orders_c, state).first()
    by_param = state_report_sql(spark, state).first()
    by_func = spark.sql(f"SELECT * FROM relatorio_estado('{state}')").first()
    for r in (by_param, by_func):
        assert r["estado_cliente"] == state
        assert r["receita_total"] == df_api["receita_total"]
        assert r["total_pedidos"] == df_api["total_pedidos"]
        assert r["ticket_medio"] == pytest.approx(df_api["ticket_medio"])
    crit = spark.sql("SELECT count(*) FROM vw_pedidos_criticos WHERE is_critico = 'Sim'").first()[0]
    assert crit == R.critical_orders(j.orders).first()["pedidos_criticos"]
    assert spark.sql("SELECT count(*) FROM vw_resumo_vendas_mensal").first()[0] == j.monthly.count()
