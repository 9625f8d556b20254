"""Monthly series, trend and forecast on the reference's published monthly revenue.

Fixed values: the monthly revenue 2017-01..2018-08 and the figures derived from
it, as published with the reference's outputs (SURVEY §5 layer 1).
"""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from salesmart.operators import forecast as M
from salesmart.operators import series as S
from salesmart.params import Period

MONTHS = ["2017-01", "2017-02", "2017-03", "2017-04", "2017-05", "2017-06", "2017-07", "2017-08", "2017-09",
          "2017-10", "2017-11", "2017-12", "2018-01", "2018-02", "2018-03", "2018-04", "2018-05", "2018-06",
          "2018-07", "2018-08"]
REVENUE = ["137188.49", "286280.62", "432048.59", "412422.24", "586190.95", "502963.04", "584971.62", "668204.60",
           "720398.91", "769312.37", "1179143.77", "863547.23", "1107301.89", "986908.96", "1155126.82",
           "1159698.04", "1149781.82", "1022677.11", "1058728.03", "1003308.47"]


@pytest.fixture()
def monthly(spark):
    rows = [(m, Decimal(v)) for m, v in zip(MONTHS, REVENUE)]
    return spark.createDataFrame(rows, "ano_mes string, receita_mensal decimal(18,2)")


def test_total_and_cumulative(monthly):
    c = S.cumulative(monthly).orderBy("ano_mes").collect()
    assert c[-1]["receita_acumulada"] == Decimal("15786203.57")


def test_growth_trimmed_mean_and_falls(monthly):
    g = S.growth(monthly)
    first = g.orderBy("ano_mes").collect()[1]
    assert first["crescimento_mom_pct"] == pytest.approx(108.67685036842376, rel=1e-12)
    t = S.trimmed_mean(g).first()
    assert t["n_crescimentos"] == 19 and t["n_usados"] == 17
    assert t["p_inf"] == pytest.approx(-15.45476873101089, abs=1e-6)
    assert t["p_sup"] == pytest.approx(58.81287276338304, abs=1e-6)
    assert t["crescimento_medio_pct"] == pytest.approx(11.405519095865, abs=1e-6)
    assert S.falling_months(g).count() == 7


def test_trimmed_mean_needs_five(spark):
    four = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 100.0)], "ano_mes string, crescimento_mom_pct double")
    five = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 4.0), ("e", 100.0)],
                                 "ano_mes string, crescimento_mom_pct double")
    assert S.trimmed_mean(four).first()["n_usados"] == 4  # plain mean
    assert S.trimmed_mean(five).first()["n_usados"] == 3  # p5..p95 band drops both ends


def test_trend_and_forecast(monthly):
    n = M.number_months(monthly)
    fit = M.trend(n, "receita_mensal")
    f = fit.first()
    assert f["inclinacao"] == pytest.approx(49668.694834586466, rel=1e-9)
    assert f["intercepto"] == pytest.approx(267788.88273684, rel=1e-9)
    q = M.trend_quality(n, fit, "receita_mensal").first()
    assert q["r2"] == pytest.approx(0.8185357468, abs=1e-8)
    assert q["mae"] == pytest.approx(95852.69, abs=0.01)
    assert q["veredito"] == "explica_bem"
    fc = M.forecast(fit, 3).orderBy("mes_num").collect()
    assert [r["ano_mes"] for r in fc] == ["2018-09", "2018-10", "2018-11"]
    assert [r["previsao"] for r in fc] == pytest.approx([1310831.47, 1360500.17, 1410168.86], abs=0.006)
    inside = M.month_trend(n, fit, "receita_mensal").orderBy("mes_num").first()
    assert inside["previsao"] == pytest.approx(317457.58, abs=0.006)


def test_trend_per_group(spark):
    rows = [("A", f"2020-0{i}", float(10 * i)) for i in range(1, 5)] + [("B", f"2020-0{i}", float(7)) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "g string, ano_mes string, y double")
    n = M.number_months(df, ["g"])
    fit = {r["g"]: r for r in M.trend(n, "y", ["g"]).collect()}
    assert fit["A"]["inclinacao"] == pytest.approx(10.0)
    assert fit["B"]["inclinacao"] == pytest.approx(0.0)


def test_month_gap_and_spine(spark):
    m = spark.createDataFrame([("2020-01", 10.0), ("2020-02", 20.0), ("2020-04", 10.0)], "ano_mes string, receita_mensal double")
    g = {r["ano_mes"]: r["crescimento_mom_pct"] for r in S.growth(m).collect()}
    assert g["2020-04"] == pytest.approx(-50.0)  # compares with 2020-02, the previous remaining month (T9)
    spine = S.month_spine(spark, Period.of("2020-01-01", "2020-04-30"))
    full = S.on_spine(spine, m, ["receita_mensal"]).orderBy("ano_mes").collect()
    assert [(r[0], r[1]) for r in full] == [("2020-01", 10.0), ("2020-02", 20.0), ("2020-03", 0.0), ("2020-04", 10.0)]


def test_fill_both_and_corr(spark):
    df = spark.createDataFrame([("2020-01", None), ("2020-02", 3.0), ("2020-03", None)], "ano_mes string, v double")
    assert [r["v"] for r in S.fill_both(df, "v").orderBy("ano_mes").collect()] == [3.0, 3.0, 3.0]
    const = spark.createDataFrame([(1.0, 3.2), (2.0, 3.2), (3.0, 3.2)], "a double, b double")
    c = S.correlation(const, "a", "b").first()
    assert c["correlacao"] is None and c["n_meses"] == 3  # constant side: NULL, no error (T15)


def test_correlation_with_rounded_rate(spark):
    # The committed series of sales vs dollar rate (rounded rate), correlation 0.5493
    rate = [3.2, 3.1, 3.13, 3.14] + [3.2] * 16
    rows = [(m, float(v), r) for m, v, r in zip(MONTHS, REVENUE, rate)]
    df = spark.createDataFrame(rows, "ano_mes string, receita double, dolar double")
    c = S.correlation(df, "receita", "dolar").first()["correlacao"]
    assert c == pytest.approx(0.5493, abs=5e-5)
    v = df.agg(S.correlation_verdict(F.lit(c)).alias("v")).first()["v"]
    assert v == "positiva_forte"


def test_first_last_and_change(monthly):
    r = S.change_first_last(monthly, "receita_mensal").first()
    assert r["primeiro_mes"] == "2017-01" and r["ultimo_mes"] == "2018-08"
    assert r["variacao_pct"] == pytest.approx((1003308.47 - 137188.49) / 137188.49 * 100)
