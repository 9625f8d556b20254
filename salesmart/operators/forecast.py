"""Least-squares trend over a monthly series and a short forecast.

The fit is an aggregate (``regr_slope`` / ``regr_intercept`` / ``regr_r2``), so it
runs per group in a single shuffle when ``group_cols`` are given (e.g. a line
per state), not only on the whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_months(m: DataFrame, group_cols: Sequence[str] = (), order: str = "ano_mes") -> DataFrame:
    """1..n over the months present, per group."""
    w = Window.partitionBy(*group_cols).orderBy(order) if group_cols else Window.orderBy(order)
    return m.withColumn("mes_num", F.row_number().over(w))


def trend(numbered: DataFrame, y: str, group_cols: Sequence[str] = (), x: str = "mes_num") -> DataFrame:
    """Slope, intercept, R² and the last month of each series."""
    yy, xx = F.col(y).cast("double"), F.col(x).cast("double")
    aggs = [F.regr_slope(yy, xx).alias("inclinacao"), F.regr_intercept(yy, xx).alias("intercepto"),
            F.regr_r2(yy, xx).alias("r2"), F.count("*").alias("n_meses"),
            F.max(x).alias("ultimo_mes_num"), F.max("ano_mes").alias("ultimo_ano_mes")]
    g = numbered.groupBy(*group_cols) if group_cols else numbered
    return g.agg(*aggs)


def _join_fit(df: DataFrame, fit: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    if group_cols:
        return df.join(fit, list(group_cols), "inner")
    return df.withColumns({c: fit.select(c).scalar() for c in fit.columns})  # one-row fit as scalars


def predicted(slope: str = "inclinacao", intercept: str = "intercepto", x: str = "mes_num") -> Column:
    return F.col(intercept) + F.col(slope) * F.col(x).cast("double")


def month_trend(numbered: DataFrame, fit: DataFrame, y: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """In-sample prediction per month (M1)."""
    j = _join_fit(numbered, fit, group_cols)
    return j.select(*group_cols, "ano_mes", "mes_num", F.col(y).alias("valor"),
                    F.round(predicted(), 2).alias("previsao"))


def forecast(fit: DataFrame, horizon: int = 3, group_cols: Sequence[str] = ()) -> DataFrame:
    """The next ``horizon`` months after the last one of each series."""
    f = fit.select(*group_cols, "inclinacao", "intercepto", "ultimo_mes_num", "ultimo_ano_mes",
                   F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    month = F.add_months(F.to_date(F.concat(F.col("ultimo_ano_mes"), F.lit("-01"))), F.col("h"))
    f = f.withColumn("mes_num", F.col("ultimo_mes_num") + F.col("h"))
    return f.select(*group_cols, "mes_num", F.date_format(month, "yyyy-MM").alias("ano_mes"),
                    F.round(predicted(), 2).alias("previsao"))


def trend_quality(numbered: DataFrame, fit: DataFrame, y: str, group_cols: Sequence[str] = (),
                  r2_good: float = 0.7) -> DataFrame:
    """MAE, R² and the verdict of the fit."""
    j = _join_fit(numbered, fit, group_cols)
    err = F.abs(F.col(y).cast("double") - predicted())
    g = j.groupBy(*group_cols, "inclinacao", "intercepto", "r2", "n_meses")
    q = g.agg(F.avg(err).alias("mae"))
    return q.select(*group_cols, "n_meses", F.round("inclinacao", 4).alias("inclinacao"),
                    F.round("intercepto", 2).alias("intercepto"), F.round("r2", 8).alias("r2"),
                    F.round("mae", 2).alias("mae"),
                    F.when(F.col("r2") > r2_good, "explica_bem").when(F.col("r2").isNotNull(), "alta_variabilidade")
                    .alias("veredito"))
