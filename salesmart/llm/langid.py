"""Language of a text, by family first and then among the languages of the family.

Features of a text are its byte n-grams of one to three bytes (lower case, with all white space,
digits and ASCII marks as one kind of blank), counted in ``BUCKETS`` buckets by a hash, damped by a
logarithm and scaled to length 1. Languages that are closer to each other than pairs of languages
are on the whole (by the mean features, joined step by step) form a family, unless families are given.
One linear support vector machine for each family, against all others, tells the family; within it,
one for each two languages votes, and of equal votes the larger sum of margins decides.

Learning takes a bounded sample: ``max_rows`` training documents at most, spread evenly over the languages,
those of the least hash of their doc_id; languages beyond the ``MAX_LANGS`` most frequent are not learned.
So at most ``max_rows`` rows of ``BUCKETS`` numbers come to the driver. All documents are scored, whole.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if there
is nothing to learn from; documents with a null lang, a null doc_id or no letter are not learned from; rows that
share doc_id and lang are one training document; every row is scored on its own; an empty table
gives no rows. Only doc_id, text and (for learning) lang are read; lang is no input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesmart.llm.common import map_arrow
from salesmart.llm.tokens import slices, text_buffers

BUCKETS = 2048
MAX_LANGS = 100
#: Bytes of text, and texts, of which the features are taken at once.
HELD, TEXTS = 1 << 20, 256
UNKNOWN = "und"


def _kinds() -> np.ndarray:
    """What each byte counts as: ASCII letters and bytes beyond ASCII as themselves, all others as a blank."""
    out = np.full(256, 32, dtype=np.uint64)
    for a, b in ((97, 123), (128, 256)):
        out[a:b] = np.arange(a, b)
    return out


KIND = _kinds()


def features(texts: pa.Array) -> np.ndarray:
    """(texts, BUCKETS) of single floats; texts are in lower case."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    texts = texts.fill_null("")
    for a, b in slices(text_buffers(texts)[1], HELD):
        data, offsets = text_buffers(texts.slice(a, b - a))
        x = KIND[data]
        row = np.repeat(np.arange(b - a, dtype=np.int64), np.diff(offsets))
        counts = np.zeros((b - a) * BUCKETS)
        gram = np.zeros(len(x), dtype=np.uint64)
        for n in range(min(3, len(x))):
            # of the bytes up to n places on; a gram that runs over the end of its text is left out
            gram[: len(x) - n] = gram[: len(x) - n] * np.uint64(257) + x[n:] + np.uint64(1)
            whole = row[n:] == row[: len(row) - n]
            bucket = (gram[: len(x) - n] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(53)).astype(np.int64)
            counts += np.bincount((row[: len(row) - n] * BUCKETS + bucket)[whole], minlength=len(counts))
        got = np.log1p(counts.reshape(b - a, BUCKETS))
        out[a:b] = got / np.maximum(np.sqrt((got**2).sum(axis=1, keepdims=True)), 1e-12)
    return out


def machine(x: np.ndarray, y: np.ndarray, reg: float = 1e-5, steps: int = 200) -> np.ndarray:
    """Weights and offset of a linear support vector machine (squared hinge, both classes weighing
    the same) for labels of 1 and -1, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = ahead = np.zeros(x.shape[1])
    # rows have length sqrt(2), the weights sum to 1: the gradient changes by 4 times a step at most
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        step = ahead + (x.T @ (2 * weight * slack * y) - reg * ahead) / (4 + reg)
        ahead, w = step + k / (k + 3) * (step - w), step
    return w


def learned_families(means: np.ndarray) -> list[list[int]]:
    """Languages whose mean features are, on average, more alike than all pairs of languages are."""
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    like = unit @ unit.T
    groups = [[i] for i in range(len(means))]
    if len(groups) < 3:
        return groups
    usual = like[np.triu_indices(len(means), 1)].mean()
    while len(groups) > 1:
        near, i, j = max((like[np.ix_(g, h)].mean(), -i, -j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        if near <= usual + 1e-9:
            break
        groups[-i] += groups.pop(-j)
    return [sorted(g) for g in groups]


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    families: list[list[int]] = field(default_factory=list)
    family_weights: np.ndarray = field(default_factory=lambda: np.zeros((0, BUCKETS + 1)))
    #: of each family the pairs (i, j) of its languages and their weights; above 0 speaks for i
    pairs: list[tuple[list[tuple[int, int]], np.ndarray]] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score from 0 to 1) of each row."""
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        margin = x @ self.family_weights.T
        family = margin.argmax(axis=1) if margin.shape[1] else np.zeros(len(x), np.int64)
        sure = _sure(margin.max(axis=1)) if margin.shape[1] > 1 else np.ones(len(x))
        lang, score = np.zeros(len(x), np.int64), np.zeros(len(x))
        for f, (members, (pairs, weights)) in enumerate(zip(self.families, self.pairs)):
            mine = np.flatnonzero(family == f)
            if not len(mine):
                continue
            votes, sums, belief = (np.zeros((len(mine), len(members))) for _ in range(3))
            if pairs:
                for (i, j), m in zip(pairs, (x[mine] @ weights.T).T):
                    a, b = members.index(i), members.index(j)
                    votes[:, a] += m > 0
                    votes[:, b] += m <= 0
                    sums[:, a] += np.clip(m, -1, 1)
                    sums[:, b] -= np.clip(m, -1, 1)
                    belief[:, a] += _sure(m)
                    belief[:, b] += _sure(-m)
                belief /= len(members) - 1
            else:
                belief += 1
            best = (votes + sums / (4 * len(members))).argmax(axis=1)
            lang[mine] = np.array(members)[best]
            score[mine] = belief[np.arange(len(mine)), best]
        return lang, np.clip(score * sure, 0, 1)


def _sure(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-3 * np.clip(margin, -10, 10)))


def fit(x: np.ndarray, langs: list[str], families: dict[str, str] | None = None) -> Model:
    """``families`` may name the family of a language; one without a name there is its own."""
    names = sorted(set(langs))
    y = np.array([names.index(lang) for lang in langs], dtype=np.int64)
    if not names:
        return Model()
    if families is None:
        groups = learned_families(np.stack([x[y == i].mean(axis=0) for i in range(len(names))]))
    else:
        own: dict[str, list[int]] = {}
        for i, name in enumerate(names):
            own.setdefault(families.get(name, f"\0{name}"), []).append(i)
        groups = list(own.values())
    of = np.zeros(len(names), np.int64)
    for f, g in enumerate(groups):
        of[g] = f
    m = Model(names, groups, np.zeros((len(groups), x.shape[1] + 1)))
    if len(groups) > 1:
        m.family_weights = np.stack([machine(x, np.where(of[y] == f, 1.0, -1.0)) for f in range(len(groups))])
    for g in groups:
        pairs = [(i, j) for k, i in enumerate(g) for j in g[k + 1 :]]
        rows = [np.flatnonzero((y == i) | (y == j)) for i, j in pairs]
        m.pairs.append((pairs, np.stack([machine(x[r], np.where(y[r] == i, 1.0, -1.0)) for (i, _), r in zip(pairs, rows)]) if pairs else np.zeros((0, x.shape[1] + 1))))
    return m


def held_out(doc_id: Column, remainder: int = 2, of: int = 4) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % of == remainder, F.lit(False))


def _readable(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, whether the text has a letter, the text in lower case, more columns."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("letters"), F.lower(text).alias("text"), *more)


def train(docs: DataFrame, max_rows: int = 2000, families: dict[str, str] | None = None) -> Model:
    """Learns from documents with a lang that are not held out, ``max_rows`` of them at most."""
    lang = F.col("lang").cast("string").alias("lang")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    usual = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    if not usual:
        return Model()
    each = max(1, max_rows // len(usual))
    # the least hashes of a language lie below this bound, some times `each` of them, so no task ranks all documents of a language
    hashed = F.xxhash64("doc_id")
    bound = F.create_map(*[F.lit(x) for r in usual for x in (r.lang, int(-(2**63) + min(1.0, (4 * each + 100) / r.ids) * (2**64 - 2**12)))])
    first = F.row_number().over(Window.partitionBy("lang").orderBy(hashed, "doc_id"))
    chosen = known.where(hashed <= F.element_at(bound, F.col("lang"))).distinct().withColumn("nth", first).where(F.col("nth") <= each)
    chosen = chosen.select(F.col("doc_id").alias("id"), F.col("lang").alias("own"))
    # at most max_rows rows of an id and a lang
    rows = _readable(docs, lang).join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("own"))).where("letters").select("doc_id", "lang", "text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                part = batch.slice(a, TEXTS)
                x = features(part.column(2))
                yield pa.record_batch([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "lang", "x"])

    every = map_arrow(rows, measured, "doc_id long, lang string, x binary")
    got = every.groupBy("doc_id", "lang").agg(F.min("x").alias("x")).orderBy("lang", "doc_id").collect()
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), dtype=np.float32).reshape(len(got), BUCKETS)
    return fit(x, [r.lang for r in got], families)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, UNKNOWN], dtype=object)
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                part = batch.slice(a, TEXTS)
                letters = part.column(1).to_numpy(zero_copy_only=False).astype(bool) & bool(model.langs)
                lang, score = model.predict(features(part.column(2))) if model.langs else (np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows))
                lang = np.where(letters, lang, len(model.langs))
                yield pa.record_batch([part.column(0), pa.array(names[lang], pa.string()), pa.array(np.where(letters, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    out = map_arrow(_readable(docs), told, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
