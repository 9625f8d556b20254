"""Invariants on the driver data, at sf0.001."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from salesmart.operators import distribution as D
from salesmart.operators import reports as R
from salesmart.operators import series as S
from salesmart.plans.queries import Job


@pytest.fixture(scope="module")
def job(spark):
    return Job(spark, SF001)


def test_sums_agree(job):
    total = job.orders.agg(F.sum("receita_itens")).first()[0]
    by_month = job.monthly.agg(F.sum("receita_mensal")).first()[0]
    by_state = R.revenue_by(job.orders_c, "estado_cliente").agg(F.sum("receita_total")).first()[0]
    cum = S.cumulative(job.monthly).orderBy(F.col("ano_mes").desc()).first()["receita_acumulada"]
    items = job.sales.agg(F.sum("valor_total_item")).first()[0]
    assert total == by_month == by_state == cum == items


def test_delivery_counts_add_up(job):
    lt = R.late_rate(job.orders).first()
    assert lt["pedidos_atrasados"] + lt["pedidos_no_prazo"] + lt["pedidos_sem_data"] == lt["pedidos_entregues"]


def test_histogram_counts_all(job):
    h = D.histogram(job.orders, "valor_pedido", 50).agg(F.sum("contagem")).first()[0]
    assert h == job.orders.count()


def test_fact_rows_and_keys(job, spark):
    items = spark.read.parquet(f"{SF001}/lineitem.parquet").count()
    orders = spark.read.parquet(f"{SF001}/orders.parquet")
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    itemless = orders.join(li, orders.o_orderkey == li.l_orderkey, "left_anti").count()
    assert job.fato.count() == items + itemless
    for dim, key in [(job.dim_clientes, "id_cliente"), (job.dim_produtos, "id_produto"),
                     (job.dim_vendedores, "id_vendedor"), (job.dim_tempo, "data")]:
        assert dim.count() == dim.select(key).distinct().count()
