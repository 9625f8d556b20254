"""Histograms and a Gaussian density curve.

Both start from a one-row min/max (or moments) aggregate; no global sort or
global window. For the density every value adds its kernel to each point of
the fixed grid (a generator with a constant fan-out, compiled with the
projection); the per-point sums combine map-side, so each task ships ``grid``
rows whatever the data size, and the values are never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins over [min, max]; max lands in the last bin, one bin if min = max.

    Returns all ``bins`` bins (empty ones with 0), with edges and counts.
    """
    x = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("x"))
    rng = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo_s, hi_s = rng.select("lo").scalar(), rng.select("hi").scalar()  # one-row scalar subqueries
    b = F.when(hi_s - lo_s == 0, F.lit(1)).otherwise(
        F.least(F.floor((F.col("x") - lo_s) / (hi_s - lo_s) * F.lit(float(bins))) + 1, F.lit(bins)))
    counts = x.groupBy(b.cast("bigint").alias("bin")).agg(F.count("*").alias("contagem"))
    width = F.col("hi") - F.col("lo")
    n_bins = F.when(width == 0, F.lit(1)).otherwise(F.lit(bins))
    grid = rng.select("lo", "hi", F.explode(F.sequence(F.lit(1), n_bins)).alias("bin"))
    edges = grid.select(
        F.col("bin").cast("bigint").alias("bin"),
        F.round(F.col("lo") + width * (F.col("bin") - 1) / F.lit(float(bins)), 6).alias("inicio"),
        F.round(F.col("lo") + width * F.col("bin") / F.lit(float(bins)), 6).alias("fim"))
    return edges.join(counts, "bin", "left").select(
        "bin", "inicio", "fim", F.coalesce("contagem", F.lit(0)).alias("contagem"))


#: exp(-z^2 / 2) is 0.0 in double from z = 38.61 on.
FAR = 38.7


def density(df: DataFrame, col: str, grid: int = 200) -> DataFrame:
    """Gaussian kernel density at ``grid`` points over [min, max], Scott bandwidth.

    h = stddev_samp * n^(-1/5); f(g) = Σ exp(-((g - x)/h)² / 2) / (n h √(2π)).
    Output: point index, x, density x 1e6 (rounded to 6 places).
    """
    x = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("x"))
    st = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"),
               F.stddev_samp("x").alias("sd"))
    st = st.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    lo, hi, n, h = (st.select(c).scalar() for c in ("lo", "hi", "n", "h"))  # one-row scalar subqueries
    step = (hi - lo) / F.lit(float(grid - 1))
    g = lo + step * F.col("ponto").cast("double")
    z = (g - F.col("x")) / h
    kernel = F.exp(F.lit(-0.5) * (z * z))
    # beyond FAR bandwidths the kernel is exactly 0.0 in double, so a value adds to the grid points
    # within that reach alone; explode + project stay in whole-stage codegen, and the sum per grid
    # point combines map-side, so the values themselves are never shuffled
    first = F.greatest(F.ceil((F.col("x") - h * FAR - lo) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("x") + h * FAR - lo) / step), F.lit(grid - 1)).cast("int")
    near = x.where(h > 0).select("x", first.alias("first"), last.alias("last")).where("first <= last")
    sums = (near.select("x", F.explode(F.sequence("first", "last")).alias("ponto"))
            .groupBy("ponto").agg(F.sum(kernel).alias("s")))
    points = df.sparkSession.range(grid).select(F.col("id").cast("int").alias("ponto")).where(h > 0)
    per_point = points.join(sums, "ponto", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    norm = n.cast("double") * h * F.lit(math.sqrt(2 * math.pi))
    return per_point.select(
        F.col("ponto").cast("bigint").alias("ponto"),
        F.round(lo + step * F.col("ponto").cast("double"), 6).alias("x"),
        F.round(F.col("s") / norm * F.lit(1e6), 6).alias("densidade_x1e6"))
