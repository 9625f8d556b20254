"""Exact deduplication by a stream with keyed state.

A stream reads the table's files; its state, kept in RocksDB with checkpoints in the shared
folder and without expiry, holds for each digest of a text the stable row (largest doc_id)
with the locator of its content (file and row number) and the number of rows. Spark combines
the rows of a digest on the map side, so a text that a third of all rows hold reaches its
state as one row per task. New files can be added and the same checkpoint continued.

A hit is a row whose digest has another stable row. The full bytes of every hit are compared
with the content at the locator; digests for which they differ (two texts, one digest) are
grouped by the text itself.

Defined cases: a null text counts as empty; of rows with equal doc_id and text the one later in
the order (file, row number) stays; a null doc_id is below all others; an empty table gives no
rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.llm.common import run_folder, stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(frame: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    place = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return frame.select(place.alias("place"), text.alias("text"), digest(text).alias("digest"))


def update_state(spark: SparkSession, path: str, checkpoint: str, digest: Callable[[Column], Column] = sha256, max_files: int | None = None) -> None:
    """Reads the files of ``path`` that ``checkpoint`` has not seen into the state."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # RocksDB would set aside 4 MB of disk for every partition of the state, whatever it holds
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(spark.read.parquet(path).schema)
        if max_files:
            source = source.option("maxFilesPerTrigger", max_files)
        # as a pattern, since a stream takes a plain path for a folder and the table may be one file
        held = _rows(source.parquet(f"{path[:-1]}[{path[-1]}]"), digest).groupBy("digest").agg(F.max("place").alias("keep"), F.count(F.lit(1)).alias("n"))
        query = held.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(digest, keep, n): what the stream's state holds."""
    held = spark.read.format("statestore").load(checkpoint)
    keep, n = held.schema["value"].dataType.fieldNames()
    return held.select(F.col("key.digest").alias("digest"), F.col("value")[keep].alias("keep"), F.col("value")[n].alias("n"))


def dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, checkpoint: str | None = None, max_files: int | None = None) -> DataFrame:
    """One row per row of the table at ``path``: doc_id, keep_id, group_size, kept, text_sha256."""
    checkpoint = checkpoint or run_folder(spark, "dedup-state")
    update_state(spark, path, checkpoint, digest, max_files)
    classes = stored(state(spark, checkpoint), "dedup-classes")
    rows = _rows(spark.read.parquet(path), digest)

    # full bytes of each hit against the content at the locator
    copies = stored(rows.join(classes.where("n > 1").drop("n"), "digest"), "dedup-copies")
    content = copies.where("place = keep").select("keep", F.col("text").alias("content"))
    other = copies.where("place <> keep").join(content, "keep").where(F.col("text") != F.col("content"))
    collided = stored(other.select("digest").distinct(), "dedup-collisions")

    named = rows.select("digest", "place", sha256(F.col("text")).alias("text_sha256"))
    if collided.isEmpty():
        joined = named.join(classes, "digest")
    else:
        exact = rows.join(collided, "digest").groupBy("digest", "text").agg(F.max("place").alias("keep"), F.count(F.lit(1)).alias("n"))
        exact = exact.select("digest", sha256(F.col("text")).alias("text_sha256"), "keep", "n")
        plain = named.join(collided, "digest", "left_anti").join(classes, "digest")
        joined = plain.unionByName(named.join(exact, ["digest", "text_sha256"]))
    return joined.select(
        F.col("place.doc_id").alias("doc_id"),
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("place") == F.col("keep")).alias("kept"),
        "text_sha256",
    )
