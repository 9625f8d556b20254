"""One-row payloads: ordered JSON maps (T24), empty-safe ranked payloads, formatted KPIs."""

import json

from salesmart.operators import payloads as P
from salesmart.operators import reports as R
from salesmart.plans.queries import Job

from conftest import SF001


def test_state_map_in_revenue_order(spark):
    j = Job(spark, SF001)
    row = P.payload_states(j.orders_c, j.p.focus_state).first()
    states = list(json.loads(row["receita_por_estado"]).keys())
    expected = [r["estado_cliente"] for r in R.revenue_by(j.orders_c, "estado_cliente", 100).collect()
                if r["estado_cliente"] is not None]
    assert states == expected
    assert row["participacao_foco"].endswith("%")
    months = list(json.loads(P.payload_months(j.orders).first()["receita_mensal"]).keys())
    assert months == sorted(months)


def test_ranked_payloads_empty_safe(spark):
    j = Job(spark, SF001)
    none = P.late_rows(j.orders_c, min_orders=10**9)
    assert none.count() == 0
    assert P.payload_ranked(none, "estado_cliente", "taxa_texto", "atraso").first()["atraso"] == "{}"
    top = P.payload_ranked(P.freight_rows(j.orders_c, 5), "estado_cliente", "frete_texto", "frete").first()["frete"]
    assert len(json.loads(top)) == 5
    k = P.formatted_kpis(j.orders).first()
    assert k["receita_total"].startswith("R$ ") and "," in k["receita_total"]


def test_impact_payload_has_percent_and_orders(spark):
    j = Job(spark, SF001)
    rows = P.freight_rows(j.orders_c, 5)
    got = json.loads(P.payload_impact(rows, "estado_cliente", "frete_texto", "frete_percentual", "estados").first()["estados"])
    want = {r["estado_cliente"]: {"frete_percentual": r["frete_texto"], "total_pedidos": r["pedidos_texto"]} for r in rows.collect()}
    assert got == want and list(got) == [r["estado_cliente"] for r in rows.orderBy("posicao").collect()]


def test_percent_text_of_null_is_null(spark):
    from pyspark.sql import functions as F

    from salesmart.functions.text import pct_text

    d = spark.sql("SELECT CAST(NULL AS DOUBLE) AS a, 17.276D AS b").select(pct_text("a").alias("a"), pct_text(F.col("b")).alias("b"))
    assert tuple(d.first()) == (None, "17,28%")
    j = Job(spark, SF001)
    assert P.payload_states(j.orders_c, "no such state").first()["participacao_foco"] == "0,00%"
