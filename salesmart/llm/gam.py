"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins at quantiles of the training rows. Training goes round
the features (cyclic boosting): a shallow tree over the bins of one feature, fitted to what the
model leaves unexplained, is added to that feature's lookup table, a little at a time. Then the
pairs of features that explain most of the rest get tables of their own, over coarser bins, by
shallow trees that cut both features. A score is the sum of one entry of each table.

Features are taken from bytes and words of the whole text; columns other than the text are never
read for them. Training uses at most ``max_rows`` labelled documents, those of the least hash of
their doc_id, so the rows that come to the driver are bounded; the model is a few kilobytes. Rows
that share a doc_id are one document, with the mean of their features.

Defined cases: a null or empty text has zeros for all features and gets the score that follows;
labels that are null do not count, several labels of one document are averaged (1 from one half
on); repeated rows are scored each on its own; a null doc_id is never trained on; with no labelled
rows the score is 0.5, with one class only its share; an empty table gives no rows. Only doc_id and
text are read; ``keep_good`` passes all columns on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.common import map_arrow, ship, texts
from salesmart.llm.tokens import slices, text_buffers
from salesmart.llm.words import Words

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "letters", "digits", "space", "beyond_ascii", "pipes", "shouts", "symbols",
    "stops", "commas", "other_marks", "words_with_marks", "line_words", "distinct_words", "top_word", "same_as_before", "word_pairs",
)


def _classes() -> np.ndarray:
    """Class of each byte; 0 is none of the others."""
    out = np.zeros(256, dtype=np.uint8)
    for c, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\n\r\x0b\x0c", "|", "!", "#$%&*", ".?", ",;:"), 1):
        out[[ord(x) for x in chars]] = c
    out[128:] = 10
    return out


CLASS = _classes()
#: Bytes of text of which the features are taken at once.
HELD = 1 << 20


def text_features(col: pa.Array) -> np.ndarray:
    """(texts, features)."""
    out = np.zeros((len(col), len(FEATURES)))
    col = col.fill_null("")
    for a, b in slices(text_buffers(col)[1], HELD):
        w = Words(col.slice(a, b - a), lower=False)
        n = b - a
        size = np.diff(w.offsets).astype(float)
        row = np.repeat(np.arange(n), np.diff(w.offsets))
        count = np.bincount(row * 11 + CLASS[w.data], minlength=n * 11).reshape(n, 11)
        share = count / np.maximum(size, 1)[:, None]
        words = w.count.astype(float)
        per_word = np.maximum(words, 1)
        of = np.repeat(np.arange(n), w.count)
        low, _ = _lower_codes(w)
        code = low[w.code]
        key = np.sort(of * (int(low.max(initial=0)) + 1) + code)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(key)))
        whose = key[first] // (int(low.max(initial=0)) + 1) if len(key) else first
        distinct = np.bincount(whose, minlength=n)
        top = np.zeros(n)
        np.maximum.at(top, whose, times)
        within = of[1:] == of[:-1]  # of two neighbouring words, whether they are of one text
        same = (code[1:] == code[:-1]) & within if len(code) else np.zeros(0, bool)
        pair = np.sort(((of[1:] * (1 << 40)) ^ (code[1:].astype(np.int64) * 1000003 + code[:-1]) & ((1 << 40) - 1))[within]) if len(code) > 1 else np.zeros(0, np.int64)
        fresh = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
        pairs = np.bincount(np.clip(fresh >> 40, 0, n - 1), minlength=n) if len(pair) else np.zeros(n)
        marks = count[:, 5] + count[:, 6] + count[:, 7]
        lines = np.bincount(row[w.data == 10], minlength=n) + 1
        letters = count[:, 1] + count[:, 2]
        out[a:b] = np.stack([
            np.log1p(size), np.log1p(words), (size - count[:, 4]) / per_word, count[:, 1] / np.maximum(letters, 1), letters / np.maximum(size, 1), share[:, 3],
            share[:, 4], share[:, 10], count[:, 5] / per_word, count[:, 6] / per_word, count[:, 7] / per_word, count[:, 8] / per_word, count[:, 9] / per_word,
            share[:, 0], marks / per_word, words / lines, distinct / per_word, top / per_word,
            np.bincount(of[1:][same], minlength=n) / per_word if len(code) else np.zeros(n), pairs / per_word,
        ], axis=1)
    return out


def _lower_codes(w: Words) -> tuple[np.ndarray, int]:
    """A code for each name, equal for names that differ in case of A-Z only."""
    import pyarrow.compute as pc

    coded = pc.ascii_lower(w.names).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)


@dataclass
class Model:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: int = 1

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        f = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            f += t[bins[:, j]]
        for i, j, t in self.pairs:
            f += t[bins[:, i] // self.coarse, bins[:, j] // self.coarse]
        return 1 / (1 + np.exp(-f))


def _leaves(g: np.ndarray, h: np.ndarray, depth: int, least: float, reg: float) -> np.ndarray:
    """Values of a tree of ``depth`` cuts over ordered bins with gradients ``g`` and weights ``h``."""
    cg, ch = np.cumsum(g), np.cumsum(h)
    best, at = 0.0, None
    if depth and len(g) > 1:
        lg, lh = cg[:-1], ch[:-1]
        rg, rh = cg[-1] - lg, ch[-1] - lh
        gain = lg**2 / (lh + reg) + rg**2 / (rh + reg) - cg[-1] ** 2 / (ch[-1] + reg)
        gain[(lh < least) | (rh < least)] = 0
        at = int(gain.argmax())
        best = gain[at]
    if best <= 1e-12:
        return np.full(len(g), cg[-1] / (ch[-1] + reg))
    return np.concatenate([_leaves(g[: at + 1], h[: at + 1], depth - 1, least, reg), _leaves(g[at + 1 :], h[at + 1 :], depth - 1, least, reg)])


def _cross(g: np.ndarray, h: np.ndarray, least: float, reg: float) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree that cuts both axes of a grid once."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, ha = cg[:-1, :-1], ch[:-1, :-1]
    parts = [(a, ha), (cg[:-1, -1:] - a, ch[:-1, -1:] - ha), (cg[-1:, :-1] - a, ch[-1:, :-1] - ha)]
    parts.append((cg[-1, -1] - sum(x for x, _ in parts), ch[-1, -1] - sum(x for _, x in parts)))
    gain = sum(x**2 / (y + reg) for x, y in parts) - cg[-1, -1] ** 2 / (ch[-1, -1] + reg)
    gain[np.minimum.reduce([y for _, y in parts]) < least] = 0
    if not gain.size or gain.max() <= 1e-12:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    value = [x[i, j] / (y[i, j] + reg) for x, y in parts]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, rate: float = 0.15, depth: int = 2, n_pairs: int = 8, coarse: int = 4, least: float = 2.0, reg: float = 1.0) -> Model:
    if not len(y):
        return Model(0.0)
    p = y.mean()
    if p in (0.0, 1.0):
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return Model(float(np.log(p / (1 - p))))
    m = Model(float(np.log(p / (1 - p))), coarse=coarse)
    m.edges = [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    b = m.bins(x)
    f = np.full(len(y), m.base)
    for _ in range(rounds):
        for j, table in enumerate(m.tables):
            q = 1 / (1 + np.exp(-f))
            g, h = np.bincount(b[:, j], weights=y - q, minlength=len(table)), np.bincount(b[:, j], weights=q * (1 - q), minlength=len(table))
            step = rate * _leaves(g, h, depth, least, reg)
            table += step
            f += step[b[:, j]]
    small = b // coarse
    sizes = [len(t) // coarse + 1 for t in m.tables]

    def grids(i: int, j: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, shape = small[:, i] * sizes[j] + small[:, j], (sizes[i], sizes[j])
        return tuple(np.bincount(at, weights=v, minlength=shape[0] * shape[1]).reshape(shape) for v in (y - q, q * (1 - q)))

    q = 1 / (1 + np.exp(-f))
    every = [(i, j) for i in range(len(sizes)) for j in range(i)]
    ranked = sorted(every, key=lambda ij: -_cross(*grids(*ij, q), least, reg)[0])[:n_pairs]
    m.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for i, j in ranked]
    for _ in range(rounds // 2):
        for i, j, table in m.pairs:
            q = 1 / (1 + np.exp(-f))
            _, step = _cross(*grids(i, j, q), least, reg)
            table += rate * step
            f += rate * step[small[:, i], small[:, j]]
    return m


def held_out(doc_id, remainder: int = 1, of: int = 3):
    return F.coalesce(F.crc32(doc_id.cast("string")) % of == remainder, F.lit(False))


def _mean(x):
    """The mean, the same in whatever order rows are added up; of equal values, the value itself."""
    return F.when(F.min(x) == F.max(x), F.min(x)).otherwise(F.avg(x.cast("decimal(28,15)")).cast("double"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **how) -> Model:
    """Learns from labelled documents that are not held out, ``max_rows`` of them at most."""
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    wanted = wanted.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    wanted = wanted.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # at most max_rows rows of two numbers
    rows = texts(docs).join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "quality")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column(1))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    every = map_arrow(rows, measured, "doc_id long, quality int, x array<double>")
    # rows that share a doc_id become one: so max_rows at most come to the driver, and no chosen document goes
    got = every.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.array(*[_mean(F.col("x")[k]) for k in range(len(FEATURES))]).alias("x")).orderBy("doc_id").collect()
    return fit(np.array([r.x for r in got]).reshape(len(got), len(FEATURES)), np.array([float(r.quality) for r in got]), **how)


SCORES = "doc_id long, score double"


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(model.score(text_features(batch.column(1))))], names=["doc_id", "score"])

    out = map_arrow(texts(docs), scored, SCORES)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``least`` or more."""
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(text_features(batch.column(at).cast(pa.string()))) >= least))
        pa.default_memory_pool().release_unused()  # the worker stays, for other stages

    ship(docs.sparkSession)
    return docs.mapInArrow(kept, docs.schema)
