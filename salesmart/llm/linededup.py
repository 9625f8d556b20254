"""Repeated lines across documents, with DataFrame functions only.

Texts are split at line feeds; a line's key is the line without white space at both
ends, A-Z lower-cased. Keys of ``min_chars`` code points or more that ``min_docs``
documents or more hold lose all their lines except in the largest doc_id that holds
them. Keys are compared by 128 bits of hashes. Lines are counted with partial sums
on the map side; the keys over the threshold are written to the shared folder, so the
join that brings them back to the lines has a plain exchange on either side and Spark
can split a key that a third of the documents hold.

Defined cases: a null or empty text is one empty line; rows of equal doc_id are one
document when documents are counted, and each row is rewritten on its own; a null
doc_id is a document below all others; an empty table gives no rows. Only doc_id and
text are read; ``drop_lines`` passes other columns on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.llm.common import ASCII_SPACE, ascii_lower, stored


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(ASCII_SPACE)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_drops(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, text_hash, drops): the positions, from 0, of the lines that a row loses."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.transform(_lines(text), line_key)).alias("pos", "line"))
        .where(F.char_length("line") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))
    )
    often = (
        lines.groupBy("h1", "h2").agg(F.count_distinct(F.struct("doc_id")).alias("n_docs"), F.max(F.struct("doc_id")).alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", F.col("keeper.doc_id").alias("keeper"))
    )
    often = stored(often, "frequent-lines")
    return (
        lines.join(often, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drops"))
    )


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All rows and columns of ``docs``, with ``text`` rewritten, and the columns n_lines (before)
    and n_dropped. A name of ``docs`` that equals one of these two is left behind."""
    drops = line_drops(docs, min_chars, min_docs).select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), "drops")
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "text")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.struct(*names).alias("__row"), text.alias("__text"), F.col("doc_id").cast("long").alias("__own"), F.xxhash64(text).alias("__own_hash"))
    # equal texts under one doc_id appear in drops once, so no row is doubled
    joined = own.join(drops, (F.col("__own") .eqNullSafe(F.col("__doc"))) & (F.col("__own_hash") == F.col("__hash")), "left")
    lines = _lines(F.col("__text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops"))
    out = F.when(F.col("drops").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return joined.select(*[F.col("__row")[c].alias(c) for c in names], out.alias("text"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"))


def line_dedup_digest(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256 of the text that stays."""
    return drop_lines(docs.select("doc_id", "text"), min_chars, min_docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))
