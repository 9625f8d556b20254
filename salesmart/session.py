"""Spark session with the settings the jobs rely on.

ANSI mode stays on (the 4.x default); the code uses ``try_*`` and ``nullif``
where the reference tolerates bad values. AQE re-plans joins from runtime sizes
and splits skewed shuffle partitions.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession


def session_conf(shuffle_partitions: int | None = None) -> dict[str, str]:
    """Settings of the jobs; the number of shuffle partitions is the cluster's own unless one is given."""
    own = {} if shuffle_partitions is None else {"spark.sql.shuffle.partitions": str(shuffle_partitions)}
    return own | {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot join key even when that costs an extra shuffle downstream
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.ansi.enabled": "true",
    }


def get_session(master: str | None = None, app: str = "salesmart", shuffle_partitions: int | None = None,
                driver_memory: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A session with the jobs' settings; master, memory and partitions are those of the submit unless given."""
    b = SparkSession.builder.appName(app)
    given = {"spark.master": master, "spark.driver.memory": driver_memory}
    for k, v in {**{k: v for k, v in given.items() if v}, **session_conf(shuffle_partitions), **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


@contextmanager
def settings(spark: SparkSession, conf: Mapping[str, str]) -> Iterator[None]:
    """The session with some settings of its own; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession, local_fallback: str | None = None) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only when the session has none (local runs, tests) a scratch folder is set.
    """
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        master = spark.sparkContext.master
        if not local_fallback and (master.startswith("local-") or not master.startswith("local")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        cur = local_fallback or tempfile.mkdtemp(prefix="salesmart-ckpt-")
        spark.conf.set("spark.checkpoint.dir", cur)
    spark.sparkContext.setCheckpointDir(cur)
    return cur


def shared_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table under the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), name)
