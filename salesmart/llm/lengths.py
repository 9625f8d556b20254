"""Exact histogram of encoded document lengths, and what it answers.

Each task counts its own documents by length; Spark sums the counts. The histogram
has one row per distinct length. Running sums over it, from either end, answer for
every context limit L how many documents fit, how many tokens they hold and how
many tokens are left if every document is cut at L. Running sums are made in two
steps, within buckets of lengths and over the buckets, so no task gets all rows.

Defined cases: a null or empty text has length 0; repeated rows count each; an
empty table gives an empty histogram. Only text is read (doc_id may be null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesmart.llm.common import map_arrow, stored, texts
from salesmart.llm.tokens import tokenizer, tokenizer_path

#: Lengths of one bucket of the running sums.
BUCKET = 1024


def length_histogram(docs: DataFrame, tokenizer_name: str = "byte_bpe_50k.json") -> DataFrame:
    """(n_tokens, n_docs): documents of each encoded length."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk = tokenizer(tokenizer_path(tokenizer_name))
        for batch in batches:
            got = [n for _, _, n in tk.batches(batch)]
            if got:
                n, times = np.unique(np.concatenate(got), return_counts=True)
                yield pa.record_batch([pa.array(n), pa.array(times)], names=["n_tokens", "n_docs"])

    part = map_arrow(texts(docs).select("text"), counted, "n_tokens long, n_docs long")
    return part.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def limit_table(hist: DataFrame) -> DataFrame:
    """For each distinct length as limit L: documents of that length, up to it and beyond it,
    tokens of those up to it, tokens left when all documents are cut at L (between two rows it
    is linear, so the table answers for every L), share of the documents up to L, padding of
    all documents to L after the cut."""
    # two branches below read it: written once, or every text would be encoded for either
    hist = stored(hist.select(F.col("n_tokens"), F.col("n_docs"), F.floor(F.col("n_tokens") / BUCKET).alias("bucket")), "length-histogram")
    whole = hist.groupBy("bucket").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"))
    # a bucket holds BUCKET lengths: as many rows as the longest document has thousands of tokens
    before, after = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(
        "bucket",
        F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("docs").over(after), F.lit(0)).alias("docs_after"),
        F.sum("docs").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_docs"),
    )
    upto = Window.partitionBy("bucket").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    beyond = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = hist.select(
        "*",
        F.sum("n_docs").over(upto).alias("docs_in"),
        F.sum(F.col("n_docs") * F.col("n_tokens")).over(upto).alias("tokens_in"),
        F.coalesce(F.sum("n_docs").over(beyond), F.lit(0)).alias("docs_out"),
    ).join(whole, "bucket")
    fit, longer, fit_tokens = F.col("docs_in") + F.col("docs_before"), F.col("docs_out") + F.col("docs_after"), F.col("tokens_in") + F.col("tokens_before")
    cut = fit_tokens + longer * F.col("n_tokens")
    return rows.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", fit.alias("docs_upto"), longer.alias("docs_beyond"),
        fit_tokens.alias("tokens_upto"), cut.alias("tokens_after_cut"),
        (fit / F.col("all_docs")).alias("quantile"), (F.col("all_docs") * F.col("n_tokens") - cut).alias("padding"),
    )


def answers(limits: DataFrame, wanted: list[int]) -> DataFrame:
    """(context_limit, docs_upto, tokens_after_cut) for any limits, read off the limit table."""
    at = []
    for limit in wanted:
        below = F.col("context_limit") <= limit
        got = F.max(F.when(below, F.struct("context_limit", "docs_upto", "docs_beyond", "tokens_after_cut")))
        at.append(F.struct(F.lit(limit).cast("long").alias("wanted"), got.alias("row"), F.sum("n_docs").alias("all_docs")))
    one = limits.agg(F.array(*at).alias("all")).select(F.inline("all"))
    row = F.col("row")
    return one.select(
        F.col("wanted").alias("context_limit"),
        F.coalesce(row["docs_upto"], F.lit(0)).alias("docs_upto"),
        F.coalesce(row["tokens_after_cut"] + row["docs_beyond"] * (F.col("wanted") - row["context_limit"]), F.col("all_docs") * F.col("wanted"), F.lit(0)).alias("tokens_after_cut"),
    )


def quantiles(limits: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least such a share of the documents does not exceed."""
    one = limits.agg(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.min(F.when(F.col("quantile") >= s, F.col("context_limit"))).alias("n_tokens")) for s in shares]).alias("all"))
    return one.select(F.inline("all"))
