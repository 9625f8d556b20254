"""Sinks: Parquet tables, CSV export, Brazilian CSV, JDBC load, snapshot append,
full refresh, catalog listing (K1-K7, S9).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.session import shared_path


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Main store (K1). Partition the fact by month so period filters prune files."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_table(df: DataFrame, name: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Managed Parquet table in the session catalog (K4)."""
    w = df.write.mode(mode).format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV export with header; NULL is written as an empty field, a quote within quotes is doubled (K1, K2)."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def _plain_number(c: Column) -> Column:
    """A number's text without an exponent, where 18 decimals hold it exactly; doubles keep their shortest digits and one decimal at least."""
    s = c.cast("string")
    plain = F.regexp_replace(s.try_cast("decimal(38,18)").cast("string"), "(\\.[0-9]*?[1-9])0+$|(\\.0)0*$", "$1$2")
    return F.when(s.contains("E") & (plain.try_cast("double") == c.cast("double")), plain).otherwise(s)


def to_br_text(df: DataFrame) -> DataFrame:
    """Numbers as text with decimal comma (no grouping), other columns unchanged (K3)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.DoubleType, T.FloatType)):
            c = F.translate(_plain_number(c), ".", ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_csv_br(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``;``-separated CSV with decimal comma (K3)."""
    to_br_text(df).write.mode(mode).option("header", True).option("sep", ";").option("escape", '"').csv(path)


def create_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def list_tables(spark: SparkSession, database: str) -> DataFrame:
    """Tables and views of a database, ordered by name, without the session's temporary views."""
    rows = [(database, t.name) for t in spark.catalog.listTables(database) if not t.isTemporary]
    return spark.createDataFrame(rows, "table_schema string, table_name string").orderBy("table_name")


def load_jdbc(tables: dict[str, DataFrame], url: str, properties: dict[str, str]) -> None:
    """Load tables through JDBC in the given order (dimensions before the fact) (K4).

    ``truncate`` keeps the target DDL and empties the table instead of dropping it.
    """
    for name, df in tables.items():
        (df.write.mode("overwrite").option("truncate", True)
         .jdbc(url=url, table=name, properties=properties))


def append_snapshot(df: DataFrame, path: str, run_col: str = "data_calculo") -> None:
    """Append one KPI snapshot per run date (K6), idempotently.

    Snapshots are partitioned by the run date and written with dynamic
    partition overwrite: a retried or repeated run replaces its own date and
    leaves the others, so a job restarted after a failure adds no duplicates.
    """
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(run_col).parquet(path))


def assert_unique(df: DataFrame, key: Sequence[str]) -> None:
    """Raise when a key repeats; only the first offending key reaches the driver."""
    dup = df.groupBy(*key).count().where(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"key {list(key)} not unique: {dup[0].asDict()}")


def refresh(df: DataFrame, path: str, key: Sequence[str]) -> None:
    """Full refresh of a keyed summary table (K7). The rows are stored once in the shared folder, so check and
    write read them from there: nothing is computed twice, and the old table may be an input."""
    staged = shared_path(df.sparkSession, f"refresh-{uuid.uuid4().hex}")
    df.write.parquet(staged)
    rows = df.sparkSession.read.parquet(staged)
    assert_unique(rows, key)
    rows.write.mode("overwrite").parquet(path)
