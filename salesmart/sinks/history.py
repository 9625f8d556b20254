"""Tables kept by partition: snapshots of several runs, a refresh of what has changed, retention by day.

What a run has not touched is neither read nor written again. Every step may be repeated: a run that failed and
starts anew ends in the same table.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesmart.session import shared_path
from salesmart.sources.files import exists

SAME, REBUILT, NEW, GONE = "igual", "refeita", "nova", "removida"


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), folder


def _replace(df: DataFrame, path: str, by: str) -> None:
    """Overwrites the partitions that ``df`` has rows for, and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def run_changes(history: DataFrame, run_col: str, values: list[str]) -> DataFrame:
    """A snapshot history with the change of each value since the run before; one row a run, so the window is small."""
    w = Window.orderBy(run_col)
    return history.select(run_col, *values, *[(F.col(v) - F.lag(v).over(w)).alias(f"{v}_variacao") for v in values])


def partition_marks(rows: DataFrame, by: str) -> DataFrame:
    """(by, linhas, soma, xor): rows and two hashes of the contents of each partition, in whatever order its rows come."""
    cols = [F.col(f"`{c}`") for c in sorted(rows.columns)]
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("linhas"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("soma"), F.bit_xor(F.xxhash64(F.lit(1), *cols)).alias("xor"))


def refresh_changed(rows: DataFrame, path: str, by: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Keeps the summary at ``path``, partitioned by ``by``, as ``build(rows)`` would have it, and builds only the partitions whose
    source rows differ from those of the last refresh. Returns (by, situacao). ``build`` works within a partition.

    The marks of the sources are written last, so a refresh that broke off is done again."""
    spark = rows.sparkSession
    marks = f"{path}.marcas"
    now = _stored(partition_marks(rows, by), "marks")
    before = _stored(spark.read.parquet(marks), "marks-before") if exists(marks) else now.limit(0)
    n, b = now.alias("n"), before.alias("b")
    state = (F.when(F.col("b.linhas").isNull(), NEW).when(F.col("n.linhas").isNull(), GONE)
             .when((F.col("n.linhas") == F.col("b.linhas")) & (F.col("n.soma") == F.col("b.soma")) & (F.col("n.xor") == F.col("b.xor")), SAME).otherwise(REBUILT))
    seen = n.join(b, F.col(f"n.{by}").eqNullSafe(F.col(f"b.{by}")), "full_outer")
    report = _stored(seen.select(F.coalesce(F.col(f"n.{by}"), F.col(f"b.{by}")).alias(by), state.alias("situacao")), "refresh")
    wanted = report.where(F.col("situacao").isin(NEW, REBUILT)).select(F.col(by).alias("_wanted"))
    _replace(build(rows.join(wanted, F.col(by).eqNullSafe(F.col("_wanted")), "left_semi")), path, by)
    # as many as partitions have vanished
    for r in report.where(F.col("situacao") == GONE).collect():
        fs, folder = _folder(spark, f"{path}/{by}={'__HIVE_DEFAULT_PARTITION__' if r[by] is None else r[by]}")
        fs.delete(folder, True)
    now.write.mode("overwrite").parquet(marks)
    return report


def retain_days(spark: SparkSession, path: str, cutoff: dt.datetime, day: str, ts: str) -> dict[str, str]:
    """Removes the records before ``cutoff`` from a log partitioned by ``day`` (a date, of ``ts``): whole days go as folders, without
    a row being read; only the day of the cutoff is written anew. Returns what was done with each day that changed."""
    fs, folder = _folder(spark, path)
    done: dict[str, str] = {}
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        found = re.fullmatch(rf"{day}=(\d{{4}}-\d{{2}}-\d{{2}})", name)
        if not found:
            continue
        start = dt.datetime.fromisoformat(found[1])
        if start + dt.timedelta(days=1) <= cutoff:
            fs.delete(status.getPath(), True)
            done[found[1]] = GONE
        elif start < cutoff:
            kept = _stored(spark.read.parquet(path).where((F.col(day) == F.lit(start.date())) & (F.col(ts).cast("timestamp_ntz") >= F.lit(cutoff.isoformat(" ")).cast("timestamp_ntz"))), "border-day")
            if kept.isEmpty():
                fs.delete(status.getPath(), True)
                done[found[1]] = GONE
            else:
                _replace(kept, path, day)
                done[found[1]] = REBUILT
    return done
