"""Change log as a snapshot diff, log view, retention, change application.

The reference writes one audit row per INSERT/UPDATE/DELETE from a row
trigger. On Spark the same records come from comparing two snapshots of a
table: a full outer join on the key, the operation read from which side is
missing or whether the row images differ (null-safe struct compare), and the
row images as JSON — built only for rows that changed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_log(old: DataFrame, new: DataFrame, key: str, table: str, at: Column | dt.datetime) -> DataFrame:
    """Change records: operacao, tabela_afetada, chave, dados_anteriores, dados_novos, data_consulta.

    ``at`` is the change time: a literal, or an expression over the row images
    ``_old`` / ``_new`` (e.g. the newest event date of the row).
    """
    o = old.select(F.col(key), F.struct(*[F.col(c) for c in old.columns]).alias("_old"))
    n = new.select(F.col(key), F.struct(*[F.col(c) for c in new.columns]).alias("_new"))
    j = o.join(n, key, "full_outer")
    op = (F.when(F.col("_old").isNull(), "INSERT").when(F.col("_new").isNull(), "DELETE")
          .when(~F.col("_old").eqNullSafe(F.col("_new")), "UPDATE"))
    at_col = at if isinstance(at, Column) else F.lit(at)
    return j.withColumn("operacao", op).where(F.col("operacao").isNotNull()).select(
        "operacao", F.lit(table).alias("tabela_afetada"), F.col(key).alias("chave"),
        F.to_json("_old").alias("dados_anteriores"), F.to_json("_new").alias("dados_novos"),
        at_col.alias("data_consulta"))


def change_log_view(log: DataFrame, width: int = 200) -> DataFrame:
    """Summary view, newest first, row image cut to ``width`` characters."""
    return log.select(
        "operacao", "tabela_afetada", "chave", "data_consulta",
        F.substring(F.coalesce("dados_novos", "dados_anteriores"), 1, width).alias("resumo"),
    ).orderBy(F.col("data_consulta").desc(), "chave")


def retain(log: DataFrame, run_date: dt.date, days: int = 90, ts: str = "data_consulta") -> DataFrame:
    """Keep records not older than ``days`` before ``run_date``; removal is strict ``<``."""
    limit = F.date_sub(F.lit(run_date), days).cast("timestamp_ntz")
    return log.where(F.col(ts).cast("timestamp_ntz") >= limit)


def apply_changes(base: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Apply change records to a snapshot: latest record per key wins.

    Anti-join the touched keys, union the new images of INSERT/UPDATE rows.
    """
    latest = log.groupBy(F.col("chave").alias(key)).agg(
        F.max_by(F.struct("operacao", "dados_novos"), "data_consulta").alias("r"))
    kept = base.join(latest.select(key), key, "left_anti")
    images = (latest.where(F.col("r.operacao") != "DELETE")
              .select(F.from_json("r.dados_novos", base.schema).alias("row")).select("row.*"))
    return kept.unionByName(images)
