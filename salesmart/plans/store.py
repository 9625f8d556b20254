"""Build the mart once, store it, and serve reports from the stored tables.

``store_mart`` writes the fact partitioned by month (period filters prune
folders) and the dimensions as Parquet. ``materialize`` writes an
intermediate result (e.g. the per-order facts that every report reads) to
the cluster's shared checkpoint folder and reads it back: the lineage is cut
and a lost executor costs a re-read, not a recomputation from the raw tables.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession

from salesmart.functions.columns import year_month
from salesmart.operators.mart import Mart
from salesmart.session import settings, shared_path
from salesmart.sinks.writers import write_parquet

TABLES = ("fato_vendas", "dim_clientes", "dim_produtos", "dim_vendedores", "dim_tempo")


#: Bytes of input files for each shuffle partition while the mart is built: their rows, some ten times as large once
#: they lie in memory, are sorted there without a spill where a task has 100 MB.
PARTITION_BYTES = 4 << 20
#: Of larger inputs each partition holds more.
MAX_PARTITIONS = 20_000


def store_mart(mart: Mart, root: str, input_bytes: int = 0) -> None:
    """Write the mart; the larger its input files, the more tasks share its joins, so none has more to sort."""
    spark = mart.fato.sparkSession
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(-(-input_bytes // PARTITION_BYTES), MAX_PARTITIONS)
    # a task of the scan holds its orders while it sums their items
    sized = {"spark.sql.shuffle.partitions": str(max(own, wanted)), "spark.sql.files.maxPartitionBytes": "16m"}
    # rows of a month come together, so a month gets few files; AQE splits a large one. Partitions are not merged
    # again, and the few months of a task are written side by side instead of sorted
    fact = mart.fato.withColumn("ano_mes", year_month("data")).hint("rebalance", "ano_mes")
    with settings(spark, sized | {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.maxConcurrentOutputFileWriters": "32"}):
        write_parquet(fact, os.path.join(root, "fato_vendas"), ["ano_mes"])
    # dimensions are small, but their keys come from all items, so their partitions are merged to that size only
    with settings(spark, sized | {"spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES)}):
        for name, df in zip(TABLES[1:], mart[1:]):
            write_parquet(df, os.path.join(root, name))


def load_mart(spark: SparkSession, root: str) -> Mart:
    return Mart(*[spark.read.parquet(os.path.join(root, t)) for t in TABLES])


_STORED: dict[tuple[str, str], str] = {}


def listed_files(spark: SparkSession, paths: list[str]) -> Iterator[tuple[str, int, int]]:
    """(name, length, time) of all files of some inputs, as their file systems list them."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        files = jvm.org.apache.hadoop.fs.Path(path)
        listed = files.getFileSystem(conf).listFiles(files, True)
        while listed.hasNext():
            f = listed.next()
            yield f.getPath().toString(), f.getLen(), f.getModificationTime()


def file_marks(spark: SparkSession, paths: list[str]) -> str:
    """A hash of name, length and time of all files of some inputs."""
    marks = sorted(" ".join(map(str, f)) for f in listed_files(spark, paths))
    return hashlib.sha256("\n".join(marks).encode()).hexdigest()[:24]


def stored_mart(spark: SparkSession, mart: Callable[[], Mart], inputs: list[str]) -> Mart:
    """The mart of some input files, written once in an application and read by all reports that follow.
    Files that are new or changed make it another mart."""
    key = (spark.sparkContext.applicationId, file_marks(spark, inputs))
    if key not in _STORED:
        root = shared_path(spark, f"mart-{key[1]}-{uuid.uuid4().hex}")
        store_mart(mart(), root, sum(n for _, n, _ in listed_files(spark, inputs)))
        _STORED[key] = root
    return load_mart(spark, _STORED[key])


def months_by_calendar(mart: Mart, calendar: Column) -> DataFrame:
    """Fact rows of the dates that a condition on the time dimension picks, with its columns. The fact is joined on its
    partition column as well, so Spark reads only the months that the dimension's rows name (dynamic partition pruning)."""
    dates = mart.dim_tempo.where(calendar)
    return mart.fato.join(dates, ["ano_mes", "data"])


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and return the stored copy."""
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.parquet(path)


def month_filter_prunes(df: DataFrame) -> bool:
    """True when the scan of a stored fact carries a partition filter on ``ano_mes``."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "PartitionFilters: [" in plan and "ano_mes" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


__all__ = ["store_mart", "load_mart", "stored_mart", "months_by_calendar", "materialize", "month_filter_prunes"]
