"""Phrases whose words stand together more often than their parts would have them, by language.

Every word starts one window: itself and the words that follow it in its piece of text (its lead
columns), three in all, padded with empty words where the piece ends. Only these longest windows are
counted: each task counts its own, Spark's ROLLUP adds them up to the counts of windows, of their
first two words and of their first word; the words' counts make up the language's. A phrase of any length is the
beginning of as many windows as it has occurrences, so no shorter phrase is ever counted on its own.

Windows are counted in ``slices``, those of one first pair in the same slice, so the disk that the
shuffle takes is that of a slice; its files go when its counts are written. Phrases of two and
three words with fewer than ``min_count`` occurrences go then, for neither they nor a longer phrase
can be a candidate or a part of one. What is left is joined to the counts of the parts. The
first ``top`` of a language are taken in two steps, of parts by a hash and then of all parts' firsts,
so no task ranks all phrases of a language.

Arithmetic is in decimals of 38 digits, exact for phrases of up to 10**15 occurrences.

Defined cases: a null text is empty; a null lang is ``und``, as is the lang of that name; rows count
each, repeated ones and those of a null or repeated doc_id as well; a text without words has no
phrase; words may be of any length; an empty table gives no rows. Only text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesmart.llm.common import map_arrow, run_folder, stored
from salesmart.llm.tokens import slices as row_slices
from salesmart.llm.tokens import text_buffers
from salesmart.llm.words import Words, mix

#: Bytes that end a piece of text; blank and tab only end a word.
BREAK = np.zeros(256, dtype=bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
APART = BREAK.copy()
APART[[32, 9]] = True
#: Bytes of text whose windows a task counts at once.
HELD = 2 << 20
#: Parts of a language in the first step of the ranking.
PARTS = 64
FACTOR = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: ``head`` is the language, a tab and the first word, which holds no tab.
WINDOWS = "head string, w2 string, w3 string, n long"


def spread(names: pa.Array) -> np.ndarray:
    """A number for each word, the same everywhere, to deal words by; words that share one are dealt alike."""
    data, offsets = text_buffers(names)
    if not len(data):
        return np.zeros(len(names), dtype=np.uint64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    return mix(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * FACTOR[place & 63], offsets[:-1]))


def window_counts(langs: pa.Array, texts: pa.Array, slice_no: int = 0, n_slices: int = 1) -> pa.RecordBatch:
    """(head, w2, w3, n): the distinct windows of some texts that fall into a slice; an empty word is padding."""
    w = Words(texts, space=APART)
    of = np.repeat(np.arange(len(texts)), w.count)
    # both grow along the text, so their sum tells the pieces of all texts apart
    piece = np.cumsum(BREAK[w.data], dtype=np.int32)[w.start] + of if len(w.start) else of
    first = w.code.astype(np.int64) + 1
    lead = [first]
    for k in (1, 2):
        led = np.zeros_like(first)
        led[:-k] = np.where(piece[k:] == piece[:-k], first[k:], 0)
        lead.append(led)
    coded = langs.dictionary_encode()
    lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[of]
    if n_slices > 1:
        hashes = np.concatenate([np.zeros(1, np.uint64), spread(w.names)])
        mine = mix(hashes[lead[0]] * np.uint64(3) + hashes[lead[1]]) % np.uint64(n_slices) == slice_no
        lang, lead = lang[mine], [x[mine] for x in lead]
    base = len(w.names) + 1
    pair, pair_of = np.unique((lang * base + lead[0]) * base + lead[1], return_inverse=True)
    window, n = np.unique(pair_of * base + lead[2], return_counts=True)
    of_window = pair[window // base]
    # ``pair`` ascends, so its heads stand together
    head = of_window // base
    new = np.append(True, head[1:] != head[:-1]) if len(head) else np.zeros(0, bool)
    names = pa.concat_arrays([pa.array([""], pa.large_string()), w.names]).cast(pa.string())
    heads = pc.binary_join_element_wise(coded.dictionary.cast(pa.string()).take(pa.array(head[new] // base)), names.take(pa.array(head[new] % base)), "\t")
    return pa.record_batch([heads.take(pa.array(np.cumsum(new) - 1)), names.take(pa.array(of_window % base)), names.take(pa.array(window % base)), pa.array(n)], names=["head", "w2", "w3", "n"])


def phrase_counts(docs: DataFrame, min_count: int = 10, n_slices: int = 3) -> DataFrame:
    """(size, lang, w1, w2, w3, f): occurrences of phrases of three, two and one words and (size 0) of
    all words of a language, the phrases of two and three words with ``min_count`` or more only."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    path = run_folder(spark, "phrase-counts")
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")  # the shuffle files of a slice go as soon as its counts are written
    try:
        for k in range(n_slices):

            def counted(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    text = batch.column(1)
                    for a, b in row_slices(text_buffers(text)[1], HELD):
                        yield window_counts(batch.column(0).slice(a, b - a), text.slice(a, b - a), k, n_slices)
                pa.default_memory_pool().release_unused()

            windows = map_arrow(rows, counted, WINDOWS)
            sums = spark.sql("SELECT head, w2, w3, cast(3 - bit_count(grouping_id()) AS int) AS size, sum(n) AS f FROM {windows} GROUP BY head, ROLLUP (w2, w3)", windows=windows)
            last = F.when(F.col("size") == 3, F.col("w3")).otherwise(F.col("w2"))
            kept = sums.where((F.col("size") == 1) | ((F.col("f") >= min_count) & (last != "")))
            first = F.substring_index("head", "\t", -1)
            lang = F.expr("left(head, length(head) - length(substring_index(head, '\\t', -1)) - 1)")
            kept.select("size", lang.alias("lang"), first.alias("w1"), "w2", "w3", "f").write.parquet(f"{path}/part={k}")
    finally:
        spark.conf.set(cleanup, before)
    found = spark.read.schema("size int, lang string, w1 string, w2 string, w3 string, f long").parquet(*[f"{path}/part={k}" for k in range(n_slices)])
    # a word has a count in every slice; a longer phrase is in one slice alone
    words = stored(found.where("size = 1").groupBy("lang", "w1").agg(F.sum("f").alias("f")), "words")
    none = F.lit(None).cast("string")
    all_words = words.groupBy("lang").agg(F.sum("f").alias("f")).select(F.lit(0).alias("size"), "lang", none.alias("w1"), none.alias("w2"), none.alias("w3"), "f")
    words = words.where(F.col("f") >= min_count).select(F.lit(1).alias("size"), "lang", "w1", none.alias("w2"), none.alias("w3"), "f")
    return stored(found.where("size >= 2").unionByName(words).unionByName(all_words), "phrases")


def _of(counts: DataFrame, size: int, words: list[str], f: str) -> DataFrame:
    own = counts.where(F.col("size") == size)
    return own.select("lang", *[F.col(f"w{i + 1}").alias(w) for i, w in enumerate(words)], F.col("f").alias(f))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right))."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    return F.call_function("div", a * a * F.lit(1000000).cast("decimal(7,0)"), left * right)


def _candidate(a: Column, cuts: list[tuple[Column, Column]]) -> Column:
    """(score, k, l, r) of the lowest cut, the first of equal ones."""
    return F.array_min(F.array(*[F.struct(score(a, left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")) for k, (left, right) in enumerate(cuts, 1)]))


def collocations(docs: DataFrame, min_count: int = 10, within: int = 50, top: int = 2000, n_slices: int = 3) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the first ``top`` phrases of two and three words. A phrase
    goes if a longer candidate that holds it has ``within`` hundredths of its occurrences or more."""
    counts = phrase_counts(docs, min_count, n_slices)
    triples, pairs = _of(counts, 3, ["w1", "w2", "w3"], "a"), _of(counts, 2, ["w1", "w2"], "a")

    longer = reduce(DataFrame.unionByName, [triples.select("lang", F.col(x).alias("w1"), F.col(y).alias("w2"), "a") for x, y in (("w1", "w2"), ("w2", "w3"))])
    longer = longer.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longest"))
    pairs = pairs.join(longer, ["lang", "w1", "w2"], "left").where(F.coalesce(F.col("longest") * 100 < F.col("a") * within, F.lit(True)))
    pairs = pairs.join(_of(counts, 1, ["w1"], "f1"), ["lang", "w1"]).join(_of(counts, 1, ["w2"], "f2"), ["lang", "w2"])
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", _candidate(F.col("a"), [(F.col("f1"), F.col("f2"))]).alias("cut"))

    triples = triples.join(_of(counts, 2, ["w1", "w2"], "f12"), ["lang", "w1", "w2"]).join(_of(counts, 2, ["w2", "w3"], "f23"), ["lang", "w2", "w3"])
    triples = triples.join(_of(counts, 1, ["w1"], "f1"), ["lang", "w1"]).join(_of(counts, 1, ["w3"], "f3"), ["lang", "w3"])
    cuts = [(F.col("f1"), F.col("f23")), (F.col("f12"), F.col("f3"))]
    triples = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", _candidate(F.col("a"), cuts).alias("cut"))

    every = pairs.unionByName(triples).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    every = every.withColumn("__part", part).withColumn("__nth", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).where(F.col("__nth") <= top)
    every = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return every.join(_of(counts, 0, [], "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
