"""Monthly series: totals, running sums, growth, trimmed mean, spine, fills, correlation
(A6, A23, A27-A29, A33, A34, F5-F7, J9, J10, O4, W1-W4).

Windows without PARTITION BY run only on month-grain frames (one row per
month of the period), never on item or order rows, so the single window
partition stays a few hundred rows at any data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesmart.functions.columns import year_month

from salesmart.params import Period
from salesmart.operators.reports import ratio


def _by_month():
    return Window.orderBy("ano_mes")


def monthly(orders: DataFrame, value: str = "receita_itens", name: str = "receita_mensal") -> DataFrame:
    """Revenue per month (A6); months without orders are absent (see ``month_spine``)."""
    return orders.groupBy("ano_mes").agg(F.sum(value).alias(name))


def cumulative(m: DataFrame, value: str = "receita_mensal") -> DataFrame:
    """Running total by month."""
    return m.withColumn("receita_acumulada", F.sum(value).over(
        _by_month().rowsBetween(Window.unboundedPreceding, 0)))


def mom_variation(m: DataFrame, value: str = "receita_mensal") -> DataFrame:
    """Change against the previous calendar row, NULL when that is 0 or missing."""
    prev = F.lag(value).over(_by_month())
    return m.withColumn("variacao_mom_pct", ratio(F.col(value) - prev, prev, 100.0))


def growth(m: DataFrame, value: str = "receita_mensal") -> DataFrame:
    """Percent change to the previous remaining month after dropping months <= 0."""
    pos = m.where(F.col(value) > 0)
    prev = F.lag(value).over(_by_month())
    pct = (F.try_divide(F.col(value).cast("double"), prev.cast("double")) - F.lit(1.0)) * F.lit(100.0)
    return pos.withColumn("crescimento_mom_pct", pct)


def falling_months(g: DataFrame) -> DataFrame:
    """Months whose growth is negative."""
    return g.where(F.col("crescimento_mom_pct") < 0)


def trimmed_mean(g: DataFrame, col: str = "crescimento_mom_pct", lo: float = 0.05,
                 hi: float = 0.95, min_n: int = 5) -> DataFrame:
    """Mean of the values inside the [p_lo, p_hi] band, inclusive.

    Percentiles are exact with linear interpolation; with fewer than
    ``min_n`` values nothing is trimmed.
    """
    v = g.where(F.col(col).isNotNull()).select(F.col(col).alias("x"))
    stats = v.agg(F.count("*").alias("n"), F.percentile("x", lo).alias("p_inf"), F.percentile("x", hi).alias("p_sup"))
    n, p_inf, p_sup = (stats.select(c).scalar() for c in ("n", "p_inf", "p_sup"))  # one-row scalar subqueries
    used = v.where((n < min_n) | F.col("x").between(p_inf, p_sup))
    return used.agg(n.alias("n_crescimentos"), F.round(p_inf, 6).alias("p_inf"), F.round(p_sup, 6).alias("p_sup"),
                    F.count("*").alias("n_usados"), F.round(F.avg("x"), 6).alias("crescimento_medio_pct"))


def month_spine(spark: SparkSession, period: Period) -> DataFrame:
    """Every month of the period, ``ano_mes`` text (O4). Size = months in the period."""
    start = F.lit(period.start.replace(day=1))
    end = F.lit(period.end.replace(day=1))
    months = spark.range(1).select(F.explode(F.sequence(start, end, F.expr("INTERVAL 1 MONTH"))).alias("m"))
    return months.select(F.date_format("m", "yyyy-MM").alias("ano_mes"))


def on_spine(spine: DataFrame, series: DataFrame, fill_zero: list[str] = ()) -> DataFrame:
    """Spine ⟕ series on month, chosen columns filled with 0."""
    j = spine.join(series, "ano_mes", "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(j.schema[c].dataType)) for c in fill_zero})


def fill_both(df: DataFrame, col: str, order: str = "ano_mes") -> DataFrame:
    """Forward fill, then backward fill for a leading gap."""
    w = Window.orderBy(order)
    fwd = F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    bwd = F.first(col, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(col, F.coalesce(fwd, bwd))


def guarded_corr(a, b) -> Column:
    """Pearson correlation; NULL (not an error) when either side is constant."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation over pairs with both values present, rounded to 6 places."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    return pairs.agg(F.count("*").alias("n_meses"), F.round(guarded_corr("a", "b"), 6).alias("correlacao"))


def correlation_verdict(c) -> Column:
    """Three-way reading of a correlation at ±0.5."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.when(c > 0.5, "positiva_forte").when(c < -0.5, "negativa_forte")
            .when(c.isNotNull(), "fraca"))


def first_last(m: DataFrame, value: str, order: str = "ano_mes") -> DataFrame:
    """First and last point of a series with their values."""
    return m.agg(F.min(order).alias("primeiro_mes"), F.min_by(value, order).alias("valor_primeiro"),
                 F.max(order).alias("ultimo_mes"), F.max_by(value, order).alias("valor_ultimo"))


def change_first_last(m: DataFrame, value: str, order: str = "ano_mes") -> DataFrame:
    """Percent change from the first to the last point."""
    fl = first_last(m, value, order)
    return fl.withColumn("variacao_pct", ratio(F.col("valor_ultimo") - F.col("valor_primeiro"),
                                               "valor_primeiro", 100.0))


def monthly_mean(df: DataFrame, ts: str, value: str, name: str) -> DataFrame:
    """Monthly mean of an external series."""
    return df.groupBy(year_month(ts).alias("ano_mes")).agg(F.avg(value).alias(name))
