"""Raw-shaped order, item, customer, product and seller rows -> cleaning -> base -> star schema -> per-order facts and KPIs.

Cases: itemless order (T4), customer with two addresses (T7), null category (T5),
not delivered / delivered without date (T2), bad timestamp text (T18).
"""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from salesmart.operators import reports as R
from salesmart.operators.cleaning import analytic_base, clean_items, clean_orders
from salesmart.operators.mart import build_mart, sales, sales_base
from salesmart.operators.orders import order_facts, with_customer
from salesmart.params import STUDY, Period
from salesmart.sources.files import RAW_CUSTOMERS, RAW_ITEMS, RAW_ORDERS, RAW_PRODUCTS, RAW_SELLERS

D = Decimal


@pytest.fixture()
def raw(spark):
    orders = spark.createDataFrame([
        # id, customer, status, purchase, approved, carrier, delivered, estimate
        ("o1", "c1", "delivered", "2017-03-01 10:00:00", None, None, "2017-03-10 10:00:00", "2017-03-09 10:00:00"),
        ("o2", "c2", "delivered", "2017-03-05 09:00:00", None, None, "2017-03-08 09:00:00", "2017-03-20 09:00:00"),
        ("o3", "c3", "shipped", "2017-04-02 08:00:00", None, None, None, "2017-04-20 08:00:00"),
        ("o4", "c4", "delivered", "2017-04-03 08:00:00", None, None, None, "2017-04-20 08:00:00"),
        ("o5", "c5", "delivered", "2017-05-01 08:00:00", None, None, "xx", "2017-05-20 08:00:00"),
        ("o6", "c6", "delivered", "2019-01-01 08:00:00", None, None, "2019-01-05 08:00:00", "2019-01-10 08:00:00"),
    ], RAW_ORDERS)
    customers = spark.createDataFrame([
        ("c1", "u1", "01000", "SAO PAULO", "SP"), ("c2", "u2", "20000", "rio de janeiro", "RJ"),
        ("c3", "u1", "02000", "osasco", "SP"), ("c4", "u3", "30000", "belo horizonte", "MG"),
        ("c5", "u4", "40000", "salvador", "BA"), ("c6", "u5", "50000", "curitiba", "PR"),
    ], RAW_CUSTOMERS)
    items = spark.createDataFrame([
        ("o1", 1, "p1", "s1", "2017-03-02 00:00:00", D("50.00"), D("10.00")),
        ("o1", 2, "p2", "s2", "2017-03-02 00:00:00", D("30.00"), D("5.00")),
        ("o2", 1, "p1", "s1", "2017-03-06 00:00:00", D("20.00"), D("15.00")),
        ("o3", 1, "p3", "s2", "2017-04-03 00:00:00", D("200.00"), D("20.00")),
        ("o5", 1, "p2", "s1", "2017-05-02 00:00:00", D("10.00"), D("2.00")),
        ("o6", 1, "p1", "s1", "2019-01-02 00:00:00", D("10.00"), D("1.00")),
    ], RAW_ITEMS)  # o4 has no items
    products = spark.createDataFrame([("p1", "cama", 10, 100, 1, 500.0, 10.0, 10.0, 10.0),
                                      ("p2", None, 12, 90, 2, 300.0, 5.0, 5.0, 5.0),
                                      ("p3", "perfumaria", 8, 50, 1, 100.0, 1.0, 1.0, 1.0)], RAW_PRODUCTS)
    sellers = spark.createDataFrame([("s1", "13000", "campinas", "SP"), ("s2", "80000", "curitiba", "PR")], RAW_SELLERS)
    return orders, customers, items, products, sellers


@pytest.fixture()
def mart(raw):
    orders, customers, items, products, sellers = raw
    base = analytic_base(clean_orders(orders), customers, clean_items(items))
    return build_mart(base, products, sellers)


def test_fact_grain_and_flags(mart):
    f = {(r["id_pedido"], r["id_item_pedido"]): r for r in mart.fato.collect()}
    assert len(f) == 7  # 6 items + 1 itemless order
    assert f[("o4", None)]["valor_total_item"] is None
    o1 = f[("o1", 1)]
    assert (o1["tempo_entrega_dias"], o1["prazo_estimado_dias"], o1["atraso_entrega_dias"]) == (9, 8, 1)
    assert (o1["entregue_com_atraso"], o1["pedido_entregue"]) == (1, 1)
    assert f[("o2", 1)]["entregue_com_atraso"] == 0
    assert (f[("o3", 1)]["entregue_com_atraso"], f[("o3", 1)]["pedido_entregue"]) == (None, 0)
    assert (f[("o4", None)]["entregue_com_atraso"], f[("o4", None)]["pedido_entregue"]) == (None, 1)
    assert f[("o5", 1)]["tempo_entrega_dias"] is None  # 'xx' parsed to NULL, no error
    assert f[("o1", 1)]["id_cliente"] == "u1"  # unique customer id (T11)


def test_dimensions(mart):
    c = {r["id_cliente"]: r for r in mart.dim_clientes.collect()}
    assert set(c) == {"u1", "u2", "u3", "u4", "u5"}
    assert c["u1"]["cep_prefixo_cliente"] == "01000"  # earliest purchase wins (T7)
    p = {r["id_produto"]: r for r in mart.dim_produtos.collect()}
    assert set(p) == {"p1", "p2", "p3"} and p["p2"]["categoria_produto"] is None
    assert mart.dim_vendedores.count() == 2
    t = {str(r["data"]): r for r in mart.dim_tempo.collect()}
    assert t["2017-03-01"]["nome_mes"] == "March" and t["2017-03-01"]["trimestre"] == 1
    assert t["2017-03-01"]["ano_mes"] == "2017-03" and len(t) == 6


def test_order_facts_and_kpis(mart):
    s = sales(mart, STUDY.period)
    o = order_facts(s, STUDY.thresholds)
    rows = {r["id_pedido"]: r for r in o.collect()}
    assert set(rows) == {"o1", "o2", "o3", "o4", "o5"}  # o6 is outside the period
    assert rows["o4"]["valor_pedido"] == 0 and rows["o4"]["receita_itens"] is None  # T4
    assert rows["o2"]["pedido_critico"] == 1  # 35 < 100 and 15 > 0.3 * 35
    assert rows["o1"]["pedido_critico"] == 0
    k = R.kpi_totals(o).first()
    assert k["receita_total"] == D("362.0000") and k["total_pedidos"] == 5
    assert k["ticket_medio"] == pytest.approx(362 / 5)  # itemless order stays in the denominator
    lt = R.late_rate(o).first()
    assert (lt["pedidos_entregues"], lt["pedidos_atrasados"], lt["pedidos_sem_data"]) == (4, 1, 2)
    assert lt["taxa_atraso_pct"] == pytest.approx(25.0)
    assert R.late_rate_known(o).first()["taxa_atraso_pct"] == pytest.approx(50.0)  # unknowns left out (T2)
    assert R.critical_orders(o).first()["pedidos_criticos"] == 1


def test_rankings(mart, spark):
    s = sales(mart, STUDY.period)
    o = order_facts(s, STUDY.thresholds)
    oc = with_customer(o, mart.dim_clientes)
    st = {r[0]: r[1] for r in R.revenue_by(oc, "estado_cliente").collect()}
    assert st == {"SP": D("315.0000"), "RJ": D("35.0000"), "MG": None, "BA": D("12.0000")}
    cat = {r[0]: r[1] for r in R.revenue_by_category(s, mart.dim_produtos, None).collect()}
    assert cat == {"cama": D("95.0000"), None: D("47.0000"), "perfumaria": D("220.0000")}  # null category kept (T5)
    sel = {r[0]: r[1] for r in R.revenue_by_seller(s, mart.dim_vendedores, None).collect()}
    assert sel == {"s1": D("107.0000"), "s2": D("255.0000")}
    top = R.revenue_by_seller(s, mart.dim_vendedores, 1).collect()
    assert [r[0] for r in top] == ["s2"]
    sb = sales_base(mart, STUDY.period)
    # p2 (no category) on o1 and o5, plus the itemless o4: the null-category group of the left joins
    assert sb.count() == 6 and sb.where(F.col("categoria_produto").isNull()).count() == 3
    dt_ = R.delivery_time_by(oc, "estado_cliente", "item").collect()
    assert {r[0]: r[1] for r in dt_}["SP"] == pytest.approx(9.0)


def test_invariants_on_small_period(mart):
    s = sales(mart, Period.of("2017-01-01", "2018-08-31"))
    o = order_facts(s, STUDY.thresholds)
    oc = with_customer(o, mart.dim_clientes, "left")
    total = o.agg(F.sum("receita_itens")).first()[0]
    by_month = o.groupBy("ano_mes").agg(F.sum("receita_itens").alias("r")).agg(F.sum("r")).first()[0]
    by_state = oc.groupBy("estado_cliente").agg(F.sum("receita_itens").alias("r")).agg(F.sum("r")).first()[0]
    assert total == by_month == by_state


def test_rows_without_key_are_spread_and_kept(spark):
    """Rows without a product match nothing, not even a product without an id, and meet in no single task."""
    from salesmart.operators.cleaning import join_attributes

    left = spark.range(5000).select(F.col("id").alias("o"), F.when(F.col("id") % 2 == 0, F.col("id") % 10).alias("k"))
    dim = spark.createDataFrame([(0, "a"), (2, "b"), (None, "x")], "k bigint, v string")
    out = join_attributes(left, dim, "k", "o")
    assert out.columns == ["k", "o", "v"] and out.count() == 5000
    assert {(r[0], r[1]): r[2] for r in out.groupBy("k", "v").count().collect()} == {
        (None, None): 2500, (0, "a"): 500, (2, "b"): 500, (4, None): 500, (6, None): 500, (8, None): 500}
    part = F.pmod(F.xxhash64("o"), F.lit(1024))
    assert left.where("k IS NULL").groupBy(part).count().count() > 500
