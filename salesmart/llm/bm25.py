"""Benchmark decontamination: every passage of the corpus asks an inverted index of the test items.

Words are A-Z lower-cased, without ASCII punctuation at their ends. Items are indexed in parts of at
most ``PART`` words. A part's postings weigh its terms by BM25 (``K1``, ``B``), divided by the
score that the part's own text gets, so 1 means that a passage has all terms of the part. Passages
are windows of ``2 * PART`` words at every ``PART``-th word of a document, so each run of PART words
lies in one window whole. Postings are kept in blocks of ``BLOCK`` parts with the greatest weight of
each term in each block. Windows are scored block-max WAND's way, a batch of them at once: in each
block, the terms with the least block maxima, up to a sum of ``LIGHT``, cannot reach ``threshold``
by themselves, so only the lists of the other terms are walked; their block maxima plus that sum
bound a window's scores in the block. Blocks whose bound reaches ``threshold`` are bounded again by
part, and those that still reach it are scored in full. That keeps all parts above the threshold, with no top-k.

A part that reaches the threshold names its item, which is verified on the words of the whole
document: question and answer must both have ``overlap`` of their distinct shingles of five words
in it (a shorter question or answer: its whole sequence). The answer of an item is its last sentence,
the question all before; an item of one sentence is all question.

The distinct texts of the items are dealt out to shards of some ``SHARD_CHARS`` characters. A task
builds the index of a shard from its texts and the document frequencies of its terms, and writes it
as a file below the shared folder; Spark hands these files to the executors (from the shared folder
itself where it is a remote one). So no text and no posting is gathered on the driver, which
knows the names of the files only, and a task holds one shard at a time. The documents are read once
for any number of shards. The item_ids of a text are joined to what is found, so an item that is
repeated many times is indexed and verified once.

Defined cases: null or empty texts and items without words match nothing; repeated rows and items
are judged each on its own; an empty table gives no rows. Only doc_id and text (item_id and
text) are read; ``decontaminate`` passes all columns on.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.common import ascii_lower, map_arrow, run_folder, ship, texts
from salesmart.llm.tokens import ragged, slices, text_buffers
from salesmart.llm.words import Words, distinct, mix

K1, B, PART, BLOCK, LIGHT, SIZE = 1.2, 0.75, 64, 4, 0.4, 5
SHARD_CHARS = 16 << 20
#: Bytes of text that are searched at once.
HELD = 1 << 20
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def item_words(text: str) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in (x.strip(PUNCTUATION) for x in re.split(r"[ \t-\r]+", low)) if w]


def question_answer(text: str) -> tuple[str, str]:
    """All but the last sentence, and the last; no answer if there is one sentence."""
    cuts = [m.end() for m in re.finditer(r"[.?!][ \t-\r]+|\n", text.rstrip())]
    at = next((c for c in reversed(cuts) if item_words(text[c:]) and item_words(text[:c])), None)
    return (text, "") if at is None else (text[:at], text[at:])


def term_stats(items: DataFrame) -> tuple[DataFrame, int, float]:
    """(term, df), the number of parts, and their mean length, over all items."""
    words = F.filter(F.transform(F.split(ascii_lower(F.col("text")), r"[ \t-\r]+"), lambda w: F.trim(w, F.lit(PUNCTUATION))), lambda w: w != "")
    parts = items.select(words.alias("words")).where(F.size("words") > 0)
    parts = parts.select(F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / PART).cast("int")), lambda i: F.slice("words", i * PART + 1, PART))).alias("words"))
    n, mean = parts.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.size("words")), F.lit(1.0))).first()
    return parts.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), n, mean


class Index:
    """The inverted index of one shard of items."""

    def __init__(self, items: list[tuple[object, str]], df: dict[str, int], n: int, mean: float):
        self.items = [i for i, _ in items]
        self.terms: dict[bytes, int] = {}
        self.part_item, term, part, weight = [], [], [], []
        self.checks: list[list[tuple[int, np.ndarray]]] = []  # of question and answer: words of a shingle, shingles
        for at, (_, text) in enumerate(items):
            words = item_words(text)
            halves = [item_words(x) for x in question_answer(text)]
            self.checks.append([(min(SIZE, len(x)), run_hashes(x)) for x in halves])
            for s in range(0, len(words), PART):
                own = words[s : s + PART]
                tf: dict[str, int] = {}
                for w in own:
                    tf[w] = tf.get(w, 0) + 1
                got = {w: np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(own) / mean)) for w, f in tf.items()}
                whole = sum(got.values())
                for w, x in got.items():
                    term.append(self.terms.setdefault(w.encode(), len(self.terms)))
                    part.append(len(self.part_item))
                    weight.append(x / whole)
                self.part_item.append(at)
        term, part, weight = np.array(term, dtype=np.int64), np.array(part, dtype=np.int64), np.array(weight)
        self.blocks = -(-len(self.part_item) // BLOCK)
        # postings in (term, block, part) order; a list is one term in one block
        order = np.lexsort((part, term))
        self.part, self.weight, term = part[order], weight[order], term[order]
        of = term * max(1, self.blocks) + self.part // BLOCK
        self.list_key, self.list_start = np.unique(of, return_index=True)
        self.list_end = np.append(self.list_start[1:], len(of))
        self.list_max = np.maximum.reduceat(self.weight, self.list_start) if len(of) else np.zeros(0)
        self.list_block = self.list_key % max(1, self.blocks)
        self.names = pa.array([t.decode() for t in self.terms], pa.string())
        # the lightest lists of each block, as many as weigh LIGHT together, are not walked
        order = np.lexsort((self.list_max, self.list_block))
        upto = np.cumsum(self.list_max[order])
        block = self.list_block[order]
        start = np.searchsorted(block, np.arange(self.blocks))
        upto -= np.concatenate([[0], upto])[start][block] if len(order) else 0
        light = np.zeros(len(order), dtype=bool)
        light[order] = upto <= LIGHT
        self.light = np.bincount(self.list_block[light], weights=self.list_max[light], minlength=self.blocks)
        walked = np.flatnonzero(~light)
        self.walk_block, self.walk_max = self.list_block[walked], self.list_max[walked]
        self.walk_from, self.walk_size = self.list_start[walked], (self.list_end - self.list_start)[walked]
        post = ragged(self.list_start[light], (self.list_end - self.list_start)[light])
        self.light_part = np.bincount(self.part[post], weights=self.weight[post], minlength=self.blocks * BLOCK).reshape(-1, BLOCK)
        self.walk_start = np.searchsorted(self.list_key[walked] // max(1, self.blocks), np.arange(len(self.terms) + 1))

    def bounded(self, term: np.ndarray, stretch: np.ndarray, n: int, joined: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(window, block) whose bound reaches the threshold; window k is stretch k and, where ``joined``, k + 1."""
        windows, blocks = [], []
        step = max(1, (1 << 21) // max(1, self.blocks))  # stretches of one dense table
        edge = np.searchsorted(stretch, np.arange(0, n + step + 1, step))
        for i, at in enumerate(range(0, n, step)):
            end = min(at + step, n)
            # one stretch more, for the last window
            own = slice(edge[i], edge[i + 1] if end == n else np.searchsorted(stretch, end + 1))
            t = term[own]
            lists = self.walk_start[t + 1] - self.walk_start[t]
            which = ragged(self.walk_start[t], lists)
            cell = np.repeat(stretch[own] - at, lists) * self.blocks + self.walk_block[which]
            sums = np.bincount(cell, weights=self.walk_max[which], minlength=(end - at + 1) * self.blocks)
            sums = sums.reshape(-1, self.blocks)
            bound = sums[: end - at] + np.where(joined[at:end, None], sums[1 : end - at + 1], 0.0) + self.light
            open_ = bound >= threshold - 1e-9
            # in the blocks left, the same by part: postings of the stretches of an open window
            need = np.zeros_like(sums, dtype=bool)
            need[: end - at] = open_
            need[1 : end - at + 1] |= open_ & joined[at:end, None]
            ok = need.ravel()[cell]
            which, cell = which[ok], cell[ok]
            post = ragged(self.walk_from[which], self.walk_size[which])
            cells, place = np.flatnonzero(need), np.cumsum(need.ravel()) - 1
            fine = place[np.repeat(cell, self.walk_size[which])] * BLOCK + self.part[post] % BLOCK
            parts = np.bincount(fine, weights=self.weight[post], minlength=len(cells) * BLOCK).reshape(-1, BLOCK)
            w, b = np.nonzero(open_)
            both = parts[place[w * self.blocks + b]] + self.light_part[b]
            second = joined[w + at]
            both[second] += parts[place[(w[second] + 1) * self.blocks + b[second]]]
            left = (both >= threshold - 1e-9).any(axis=1)
            w, b = w[left], b[left]
            windows.append(w + at)
            blocks.append(b)
        return np.concatenate([np.zeros(0, np.int64), *windows]), np.concatenate([np.zeros(0, np.int64), *blocks])

    def scored(self, pair: np.ndarray, term: np.ndarray, block: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, part, score) >= threshold; (pair, term) rows are distinct, ``block`` is that of the row's pair."""
        want = term * max(1, self.blocks) + block
        at = np.minimum(np.searchsorted(self.list_key, want), len(self.list_key) - 1)
        ok = self.list_key[at] == want
        pair, at = pair[ok], at[ok]
        n = self.list_end[at] - self.list_start[at]
        post = ragged(self.list_start[at], n)
        keys, of = np.unique(np.repeat(pair, n) * max(1, len(self.part_item)) + self.part[post], return_inverse=True)
        score = np.bincount(of, weights=self.weight[post], minlength=len(keys))
        hit = score >= threshold - 1e-9
        return keys[hit] // max(1, len(self.part_item)), keys[hit] % max(1, len(self.part_item)), score[hit]


def run_hashes(words: list[str], size: int = SIZE) -> np.ndarray:
    """Hashes of the distinct shingles of a word sequence (fewer words: the whole one)."""
    from pandas.util import hash_array

    if not words:
        return np.zeros(0, np.uint64)
    h = hash_array(np.array([w.encode() for w in words], dtype=object), categorize=False)
    return np.unique(rolled(h, min(size, len(words))))


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    acc = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
    for i in range(size):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return acc


def search_texts(col: pa.Array, index: Index, threshold: float, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item, best score, share of the question, share of the answer) of the verified items of each text."""
    from pandas.util import hash_array

    col = col.fill_null("")
    for a, b in slices(text_buffers(col)[1], HELD):
        w = Words(col.slice(a, b - a))
        if not len(w.code) or not len(index.terms):
            continue
        names = pc.utf8_trim(w.names.cast(pa.string()), characters=PUNCTUATION)
        known = pc.fill_null(pc.index_in(names, index.names), -1).to_numpy().astype(np.int64)
        real = pc.greater(pc.binary_length(names), 0).to_numpy(zero_copy_only=False)[w.code]
        row = np.repeat(np.arange(b - a), w.count)[real]
        code = w.code[real]
        first = np.searchsorted(row, np.arange(b - a + 1))
        # window k of a text has its words from k * PART on, 2 * PART of them
        windows = -(-np.diff(first) // PART)
        base = np.cumsum(windows) - windows
        stretch = base[row] + (np.arange(len(code)) - first[row]) // PART
        owner = np.repeat(np.arange(b - a), windows)
        joined = np.append(owner[1:] == owner[:-1], False)
        term = known[code]
        has = np.flatnonzero(term >= 0)
        window, block = index.bounded(term[has], stretch[has], len(owner), joined, threshold)
        begin = first[owner[window]] + (window - base[owner[window]]) * PART
        n = np.minimum(begin + 2 * PART, first[owner[window] + 1]) - begin
        pair = np.repeat(np.arange(len(window)), n)
        terms = term[ragged(begin, n)]
        rows = distinct(pair[terms >= 0] * len(index.terms) + terms[terms >= 0])
        pair, terms = rows // len(index.terms), rows % len(index.terms)
        best: dict[tuple[int, int], float] = {}
        for k, part, score in zip(*(x.tolist() for x in index.scored(pair, terms, block[pair], threshold))):
            key = (int(owner[window[k]]), index.part_item[part])
            best[key] = max(best.get(key, 0.0), score)
        if best:
            plain = names.to_pylist()
        sets: dict[tuple[int, int], np.ndarray] = {}
        for (r, item), score in sorted(best.items()):
            own = hash_array(np.array([plain[c].encode() for c in code[first[r] : first[r + 1]].tolist()], dtype=object), categorize=False)
            share = []
            for size, want in index.checks[item]:
                if size and (r, size) not in sets:
                    sets[r, size] = distinct(rolled(own, size))
                share.append(float(np.isin(want, sets[r, size]).mean()) if size else 1.0)
            if min(share) >= overlap:
                yield a + r, item, score, share[0], share[1]


def _cleaned(items: DataFrame) -> DataFrame:
    """(item_id, content, text); content names a text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.sha2(text, 256).alias("content"), text.alias("text"))


def _shards(items: DataFrame) -> list[str]:
    """Names of the files that hold the shards' indexes, one each; document frequencies are those of all items."""
    spark = items.sparkSession
    ship(spark)
    df, n, mean = term_stats(items)
    own = items.groupBy("content").agg(F.first("text").alias("text"))
    chars = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-chars // SHARD_CHARS))
    own = own.withColumn("shard", F.pmod(F.xxhash64("content"), F.lit(shards)))
    words = F.explode(F.split(ascii_lower(F.col("text")), r"[ \t-\r]+"))
    terms = own.select(F.col("shard").alias("of"), words.alias("w")).select("of", F.trim("w", F.lit(PUNCTUATION)).alias("term")).distinct().join(df, "term")

    def built(left: pa.Table, right: pa.Table) -> pa.Table:
        known = dict(zip(right.column("term").to_pylist(), right.column("df").to_pylist()))
        rows = sorted(zip(left.column("content").to_pylist(), left.column("text").to_pylist()))
        return pa.table({"index": pa.array([pickle.dumps(Index(rows, known, n, mean))], pa.binary())})

    path = run_folder(spark, "bm25-shards")
    indexes = own.groupBy("shard").cogroup(terms.groupBy("of")).applyInArrow(built, "index binary")
    indexes.write.option("maxRecordsPerFile", 1).parquet(path)
    files = sorted(spark.read.schema("index binary").parquet(path).inputFiles())
    for f in files:
        spark.sparkContext.addFile(f)
    return [f.rsplit("/", 1)[1] for f in files]


def _indexes(files: list[str]) -> Callable[[], Iterator[Index]]:
    """What yields the indexes of ``files``, one held at a time; a single one is read once."""
    held: dict[str, list[Index]] = {}

    def read(name: str) -> list[Index]:
        if name not in held:
            held.clear()
            held[name] = [pickle.loads(x.as_py()) for x in pq.read_table(SparkFiles.get(name)).column("index")]
        return held[name]

    def each() -> Iterator[Index]:
        # the one that is held comes first
        for name in sorted(files, key=lambda f: f not in held):
            yield from read(name)

    return each


FOUND = "doc_id long, content string, score double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.8) -> DataFrame:
    """One row per document and verified item: doc_id, item_id, score, question_overlap, answer_overlap."""
    items = _cleaned(items)
    files = _shards(items)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = _indexes(files)
        for batch in batches:
            for index in each():
                rows = list(search_texts(batch.column(1), index, threshold, overlap))
                at, item, *rest = zip(*rows) if rows else ((), (), (), (), ())
                cols = [batch.column(0).take(pa.array(at, pa.int64())), pa.array([index.items[i] for i in item], pa.string()), *(pa.array(x, pa.float64()) for x in rest)]
                yield pa.record_batch(cols, names=[c.split()[0] for c in FOUND.split(", ")])

    found = map_arrow(texts(docs), matched, FOUND)
    return found.join(items.select("content", "item_id"), "content").select("doc_id", "item_id", "score", "question_overlap", "answer_overlap")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no verified item."""
    files, at = _shards(_cleaned(items)), docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = _indexes(files)
        for batch in batches:
            ok = np.ones(batch.num_rows, dtype=bool)
            col = batch.column(at).cast(pa.string())
            for index in each():
                for row, *_ in search_texts(col, index, threshold, overlap):
                    ok[row] = False
            yield batch.filter(pa.array(ok))
        pa.default_memory_pool().release_unused()  # the worker stays, for other stages

    return docs.mapInArrow(clean, docs.schema)
