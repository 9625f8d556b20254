"""Profiling: shape, types, nulls, duplicates, row counts.

Null counts for all columns come from one aggregate pass, then unpivot to
one row per column; duplicates from one grouped count over all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def head(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First n rows by an explicit order (P1); a bare limit has no defined order."""
    return df.orderBy(*order).limit(n)


def profile_shape(df: DataFrame, name: str) -> DataFrame:
    """Rows and columns of a table."""
    return df.agg(F.count("*").alias("linhas")).select(
        F.lit(name).alias("tabela"), "linhas", F.lit(len(df.columns)).cast("bigint").alias("colunas"))


def column_types(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Column names and types as rows (P3); schema metadata only, no data read."""
    return spark.createDataFrame(df.dtypes, "coluna string, tipo string")


def profile_nulls(df: DataFrame) -> DataFrame:
    """Null count and percent per column, one pass over the data."""
    cols = df.columns
    counts = df.agg(F.count("*").alias("__n"),
                    *[F.count_if(F.col(_q(c)).isNull()).alias(f"c{i}") for i, c in enumerate(cols)])
    types = dict(df.dtypes)
    pairs = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', '{types[c]}', c{i}" for i, c in enumerate(cols))
    long = counts.selectExpr("__n", f"stack({len(cols)}, {pairs}) AS (coluna, tipo, nulos)")
    return long.select("coluna", "tipo", "nulos",
                       F.round(F.col("nulos").cast("double") / F.nullif(F.col("__n").cast("double"), F.lit(0.0))
                               * 100.0, 2).alias("pct_nulos"))


def top_nulls(df: DataFrame, k: int = 15) -> DataFrame:
    """Columns with the most nulls."""
    return profile_nulls(df).orderBy(F.col("nulos").desc(), F.col("coluna").asc()).limit(k)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Copies beyond the first of fully equal rows, NULL equal to NULL."""
    g = df.groupBy(*[F.col(_q(c)) for c in df.columns]).count()
    return g.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("linhas_duplicadas"),
                 F.count("*").alias("linhas_distintas"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table as one UNION ALL of counts."""
    parts = [df.agg(F.count("*").alias("quantidade")).select(F.lit(name).alias("tabela"), "quantidade")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
