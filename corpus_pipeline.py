"""From raw documents to packed training sequences.

Each stage works on all that its predecessor kept and is written as Parquet before the next one
reads it. All but the last return the columns of ``documents``; extra columns are passed on. The
stages' own docstrings define nulls, empty texts, ties and repeated rows; an empty table passes
through as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.llm import bm25, gam, linededup, minhash, packing
from salesmart.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels, rejects go."""
    return gam.keep_good(docs, gam.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat go; all documents stay, ``n_chars`` follows the text."""
    # the row travels as one column, so no name of it meets one that the operator adds
    out = linededup.drop_lines(docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("__whole")))
    new = {"text": F.col("text"), "n_chars": F.char_length("text")}
    return out.select(*[new[c].cast(t).alias(c) if c in new else F.col("__whole")[c].alias(c) for c, t in docs.dtypes])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more of their shingles of five words in common)
    stays: the one of the least doc_id (of rows that share it, one). Documents without words stay all, but for rows equal in doc_id and text."""
    found = minhash.near_duplicates(docs, percent=80)
    best = found.where("kept AND n_shingles > 0").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("best"))
    wordless = found.where("n_shingles = 0").select("doc_id", "text_hash").distinct()
    keep = best.select("best.doc_id", "best.text_hash").unionByName(wordless).select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.struct(*docs.columns).alias("__row"), F.xxhash64(text).alias("__own"))
    kept = own.join(keep, F.col("__row.doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.col("__own") == F.col("__hash")))
    kept = kept.select("__row", F.coalesce(F.col("__doc"), F.lit(0)).alias("__key"), F.col("__doc").isNull().alias("__null"), "__hash").dropDuplicates(["__key", "__null", "__hash"])
    return kept.select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return bm25.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack),
]

#: Classifier, MinHash and tokenizer cannot be expressed in SQL; tests/llm holds a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the pieces of the last one."""
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stored(stage(spark, out, sf_dir), f"stage-{name}")
    return out
