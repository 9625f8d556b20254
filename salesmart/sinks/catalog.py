"""Load of the mart into a database of the catalog, with a check before anything is swapped.

All tables are written under names of this run first, in the given order (dimensions before the fact). The rows
that went into each write are counted while they pass, and compared with the rows of the written table. Only
when all agree do the names that users read turn to them: these are views, so no file is moved or copied, which
an object store would do for a rename. If that fails half way, the names turn back to the run before, which
the database's properties tell. So a load that fails at any point leaves the tables as they were.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from salesmart.sinks.writers import create_database, list_tables, write_table

#: Property of a database: the run whose tables its names stand for.
RUN = "salesmart_run"


def _stage(spark: SparkSession, tables: Mapping[str, DataFrame], staged: Mapping[str, str], partition_by: Mapping[str, Sequence[str]]) -> list[tuple]:
    rows = []
    for order, (name, df) in enumerate(tables.items(), 1):
        passed = Observation()
        write_table(df.observe(passed, F.count(F.lit(1)).alias("n")), staged[name], partition_by.get(name, ()))
        rows.append((order, name, passed.get["n"], spark.table(staged[name]).count()))
    return rows


def _show(spark: SparkSession, database: str, names: Sequence[str], run: str | None) -> None:
    """The names stand for the tables of ``run``; without one they go."""
    for name in names:
        if run:
            spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS SELECT * FROM {database}.{name}__{run}")
        else:
            spark.sql(f"DROP VIEW IF EXISTS {database}.{name}")


def _swap(spark: SparkSession, database: str, names: Sequence[str], run: str) -> None:
    old = {r[0]: r[1] for r in spark.sql(f"DESCRIBE DATABASE EXTENDED {database}").collect()}.get("Properties", "")
    before = next(iter(re.findall(rf"{RUN},([0-9a-z]+)\)", old)), None)
    try:
        _show(spark, database, names, run)
        spark.sql(f"ALTER DATABASE {database} SET DBPROPERTIES ('{RUN}' = '{run}')")
    except Exception:
        _show(spark, database, names, before)
        raise
    if before:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {database}.{name}__{before}")


def load_database(spark: SparkSession, database: str, tables: Mapping[str, DataFrame], partition_by: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Replaces the tables of ``database`` all together; returns ordem, tabela, linhas_origem, linhas_carregadas, confere
    of those that the catalog lists afterwards. Raises, with nothing changed, if a table could not be written whole."""
    run = uuid.uuid4().hex[:12]
    create_database(spark, database)
    staged = {name: f"{database}.{name}__{run}" for name in tables}
    try:
        rows = _stage(spark, tables, staged, partition_by or {})
        short = [f"{name}: {n} of {m} rows" for _, name, m, n in rows if n != m]
        if short:
            raise RuntimeError("load check failed: " + "; ".join(short))
        _swap(spark, database, list(tables), run)
    except Exception:
        for name in staged.values():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        raise
    report = spark.createDataFrame(rows, "ordem int, tabela string, linhas_origem bigint, linhas_carregadas bigint")
    listed = list_tables(spark, database).select(F.col("table_name").alias("tabela"))
    return report.join(listed, "tabela").select("ordem", "tabela", "linhas_origem", "linhas_carregadas", (F.col("linhas_origem") == F.col("linhas_carregadas")).alias("confere"))
