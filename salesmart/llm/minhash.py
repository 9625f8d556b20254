"""Near-duplicates by MinHash bands and sequential Bayesian verification.

A document's set holds its distinct word shingles, as 64-bit hashes. Documents of one set form
a class, by a 128-bit digest, of which one stands for all; classes are numbered. ``HASHES`` minima are cut into
bands of ``band_rows``; classes that agree on all 64-bit minima of a band meet in a bucket (its key
is a hash of these minima, so unrelated sets do not meet by chance). Eight bits of each minimum are
kept as the signature.
In a bucket, signatures are compared batch by batch: with a uniform prior on the similarity,
a pair goes as soon as the posterior probability of a similarity of ``threshold`` or more falls
below a level, chosen so that all batches together lose a pair of just the threshold with
probability ``miss`` at most. What is left is verified on the full sets of the texts.

A bucket of near copies could hold very many true pairs, so verification goes in two steps, and
loses no link that could join two components: first every bucket names a maximum spanning forest
of its surviving pairs (fewer pairs than members), which is verified and joined to components;
then members that have a surviving pair with another component meet in their bucket again, with
their texts, and are verified there pair by pair, until their components are one. So no pair
leaves its task unless it is a link that joins two components. Buckets of more than ``CELL``
members are dealt out as cells of two parts each, so no task holds a bucket whole.

The bands follow from the threshold: they are the longest, of ``ROWS`` bytes at most, whose
chance to miss a pair of just that similarity is ``miss`` or less. With ``miss`` 1e-6 that is 24
bands of 5 at 0.85, (1 - 0.85**5)**24 = 7.7e-7, and 30 bands of 4 at 0.80, (1 - 0.8**4)**30 =
1.4e-7 (24 of 5 would miss 7.3e-5 there). A pair is judged in the first band where it meets, which 32
bits of the bands' keys tell: that an earlier band agrees in these alone has a chance of 30 * 2**-32.

Defined cases: a null or empty text has no set, links with nothing and is its own component;
repeated rows are copies; rows of one doc_id with different texts are judged each on its own;
a null doc_id takes the least doc_id of its component, null if it has none; an empty table gives
no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.common import map_arrow, stored, texts
from salesmart.llm.graph import components
from salesmart.llm.tokens import slices, text_buffers
from salesmart.llm.words import mix, shingle_sets

HASHES, ROWS, BATCH, CELL, BAND_BITS = 120, 5, 20, 2048, 7
#: Shingles that are hashed at once; bytes of text of which the sets are held at once.
CHUNK, HELD = 1 << 15, 1 << 20


def _factors() -> np.ndarray:
    return np.random.default_rng(8).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: np.ndarray, offsets: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (texts, HASHES), zeros for texts without a set, and keys of bands of ``rows`` minima (texts,
    bands): a hash of the minima, with the number of the band in the last ``BAND_BITS`` bits."""
    factors, n = _factors(), len(offsets) - 1
    low = np.full((HASHES, n), np.iinfo(np.uint64).max, dtype=np.uint64)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        full = np.flatnonzero(np.diff(offsets[at : end + 1]) > 0) + at
        if len(full):
            part = sets[offsets[at] : offsets[end]]
            starts = offsets[full] - offsets[at]
            work = np.empty_like(part)
            for k in range(HASHES):
                np.multiply(part, factors[k], out=work)
                low[k, full] = np.minimum.reduceat(work, starts)
        at = end
    out = ((low >> np.uint64(24)) ^ (low >> np.uint64(40))).astype(np.uint8).T
    out = np.ascontiguousarray(out)
    out[np.diff(offsets) == 0] = 0
    bands = HASHES // rows
    keys = np.zeros((n, bands), dtype=np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + low[r::rows].T)
    return out, keys >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS) | np.arange(bands, dtype=np.uint64)


@cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For each number of batches compared, the least number of equal bytes with which the posterior
    probability of a similarity >= threshold still reaches a level: ``miss`` over the batches, or so
    much less that a pair of just the threshold is lost in all batches with probability ``miss`` at most."""
    level = miss * BATCH / HASHES
    while lost(least := bounds(threshold, level), threshold) > miss:
        level /= 2
    return least


def lost(least: tuple[int, ...], similarity: float) -> float:
    """The probability that a pair falls below one of the bounds."""
    p = similarity + (1 - similarity) / 256
    batch = np.array([comb(BATCH, k) * p**k * (1 - p) ** (BATCH - k) for k in range(BATCH + 1)])
    left, out = np.ones(1), 0.0
    for bound in least:
        left = np.convolve(left, batch)
        out += float(left[:bound].sum())
        left[:bound] = 0
    return out


def bounds(threshold: float, level: float) -> tuple[int, ...]:
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / 256  # unequal minima have equal bytes by chance
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        tail = weight[:, s >= threshold].sum(axis=1) / weight.sum(axis=1)
        out.append(int(np.argmax(tail >= level)))
    return tuple(out)


def band_rows(percent: int, miss: float) -> int:
    """The most bytes of a band, up to ``ROWS``, with which all bands of a signature miss a pair of
    similarity ``percent`` with probability ``miss`` at most."""
    for rows in range(ROWS, 0, -1):
        if HASHES % rows == 0 and (1 - (percent / 100) ** rows) ** (HASHES // rows) <= miss:
            return rows
    raise ValueError(f"{HASHES} minima cannot find pairs of similarity {percent} % with a miss of {miss}")


def survivors(sig: np.ndarray, tags: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, band: int, percent: int, miss: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, equal bytes) of the pairs that no bound prunes, whose sizes allow a link, and that meet in ``band`` first."""
    ok = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
    i, j = i[ok], j[ok]
    equal = np.zeros(len(i), dtype=np.int64)
    for b, least in enumerate(least_matches(percent / 100, miss)):
        cols = slice(b * BATCH, (b + 1) * BATCH)
        equal = equal + (sig[i, cols] == sig[j, cols]).sum(axis=1)
        ok = equal >= least
        i, j, equal = i[ok], j[ok], equal[ok]
    if band and len(i):
        before = (tags[i, :band] == tags[j, :band]).any(axis=1)
        i, j, equal = i[~before], j[~before], equal[~before]
    return i, j, equal


def forest(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the pairs of a maximum spanning forest."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    taken = []
    order = np.argsort(-weight, kind="stable")
    for k, a, b in zip(order.tolist(), i[order].tolist(), j[order].tolist()):
        a, b = root(a), root(b)
        if a != b:
            up[a] = b
            taken.append(k)
    return np.array(taken, dtype=np.int64)


def _sign(docs: DataFrame, size: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, digest, n_shingles, sig, bands); digest: that of the set, null without a set;
    sig: the signature and 32 bits of each band's key; bands: the keys."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(2).fill_null("")
            for a, b in slices(text_buffers(col)[1], HELD):
                sets, offsets = shingle_sets(col.slice(a, b - a), size)
                (sig, keys), data = signatures(sets, offsets, rows), memoryview(sets).cast("B") if len(sets) else b""
                cuts = (offsets * 8).tolist()
                digest = [hashlib.blake2b(data[x:y], digest_size=16).digest() if y > x else None for x, y in zip(cuts, cuts[1:])]
                cols = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(digest, pa.binary()), pa.array(np.diff(offsets))]
                tags = (keys >> np.uint64(32)).astype(np.uint32)
                cols += [pa.array([s.tobytes() + t.tobytes() for s, t in zip(sig, tags)], pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary())]
                yield pa.record_batch(cols, names=["doc_id", "text_hash", "digest", "n_shingles", "sig", "bands"])
        pa.default_memory_pool().release_unused()  # the worker stays, for other stages

    own = texts(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_arrow(own, signed, "doc_id long, text_hash long, digest binary, n_shingles long, sig binary, bands binary")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, low, high, part, node, size, sig): members of buckets of two or more, dealt out to cells."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int64)
            of = np.repeat(np.arange(batch.num_rows), len(key) // max(1, batch.num_rows))
            yield pa.record_batch([pa.array(key), batch.column(0).take(pa.array(of))], names=["key", "node"])

    bands = map_arrow(nodes.select("node", "bands"), banded, "key long, node long")
    sizes = bands.groupBy("key").count().where("count > 1")
    # the number of parts of a bucket; most have one
    member = bands.join(sizes, "key").select("key", "node", F.ceil(F.col("count") / CELL).cast("int").alias("parts"))
    member = member.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    member = member.select("key", "node", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    return member.join(nodes.select("node", "size", "sig"), "node").select("key", "low", "high", "part", "node", "size", "sig")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole cells from sorted rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        new = np.flatnonzero(_edges(pa.Table.from_batches([held[-2].slice(held[-2].num_rows - 1), batch] if len(held) > 1 else [batch])))
        if len(new):
            t = pa.Table.from_batches(held)
            cut = len(t) - batch.num_rows + int(new[-1]) + (0 if len(held) > 1 else 1)
            yield t.slice(0, cut)
            held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _edges(t: pa.Table) -> np.ndarray:
    """For each row but the first, whether it begins a cell."""
    key, low, high = (t.column(c).to_numpy() for c in ("key", "low", "high"))
    return (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])


def _candidates(t: pa.Table, percent: int, miss: float, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, equal bytes): rows of surviving pairs, cell by cell. ``whole``: all whose root differs, else a forest."""
    key, low, high, part, size = (t.column(c).to_numpy() for c in ("key", "low", "high", "part", "size"))
    root = t.column("root").to_numpy() if whole else None
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint8).reshape(len(t), -1)
    sig, tags = sig[:, :HASHES], np.ascontiguousarray(sig[:, HASHES:]).view(np.uint32)
    at = np.flatnonzero(np.concatenate([[True], _edges(t)]))
    end = np.append(at[1:], len(key))
    band = key & ((1 << BAND_BITS) - 1)
    # buckets of two, all of a band at once
    two = at[end - at == 2]
    two = two[low[two] == high[two]]
    for k in np.unique(band[two]):
        i = two[band[two] == k]
        if whole:
            i = i[root[i] != root[i + 1]]
        yield survivors(sig, tags, size, i, i + 1, int(k), percent, miss)
    for x, y in zip(at.tolist(), end.tolist()):
        if y - x < 2 or y - x == 2 and low[x] == high[x]:
            continue
        own, found = np.arange(x, y), []
        step = max(1, (1 << 17) // (y - x))
        for s in range(x, y, step):
            i, j = (g.ravel() for g in np.meshgrid(np.arange(s, min(s + step, y)), own, indexing="ij"))
            ok = i < j if low[x] == high[x] else (part[i] == low[x]) & (part[j] == high[x])
            if whole:
                ok &= root[i] != root[j]
            found.append(survivors(sig, tags, size, i[ok], j[ok], int(band[x]), percent, miss))
        i, j, equal = (np.concatenate(f) for f in zip(*found))
        if not whole:
            take = forest(y - x, i - x, j - x, equal)
            i, j, equal = i[take], j[take], equal[take]
        yield i, j, equal


def _dealt(buckets: DataFrame) -> DataFrame:
    return buckets.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")


def _first_pairs(buckets: DataFrame, percent: int, miss: float) -> DataFrame:
    """(a, b): a maximum spanning forest of each cell."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches):
            node = t.column("node").to_numpy()
            for i, j, _ in _candidates(t, percent, miss, False):
                yield pa.record_batch([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

    return map_arrow(_dealt(buckets), paired, "a long, b long")


def _open_members(buckets: DataFrame, percent: int, miss: float) -> DataFrame:
    """The rows of ``buckets`` (with root) that have a surviving pair with another component."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches):
            use = np.zeros(len(t), dtype=bool)
            for i, j, _ in _candidates(t, percent, miss, True):
                use[i] = use[j] = True
            yield from t.filter(pa.array(use)).to_batches()

    rows = _dealt(buckets)
    return map_arrow(rows, marked, ", ".join(f"{c} {k}" for c, k in rows.dtypes))


def _joining_links(members: DataFrame, percent: int, miss: float, size: int) -> DataFrame:
    """(a, b): links between components, verified on the full sets of ``members``' texts. A pair is
    skipped if links found in this task have joined its components already."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for t in _cells(batches):
            node, root, text = t.column("node").to_numpy(), t.column("root").to_numpy().tolist(), t.column("text")
            held: dict[int, np.ndarray] = {}
            links = []

            def members_set(row: int) -> np.ndarray:
                if row not in held:
                    held[row] = shingle_sets(pa.array([text[row].as_py()], pa.string()), size)[0]
                return held[row]

            for i, j, equal in _candidates(t, percent, miss, True):
                for k in np.argsort(-equal, kind="stable").tolist():
                    x, y = int(i[k]), int(j[k])
                    rx, ry = top(root[x]), top(root[y])
                    if rx != ry and similar(members_set(x), members_set(y), percent):
                        up[rx] = ry
                        links.append((min(node[x], node[y]), max(node[x], node[y])))
            a, b = zip(*links) if links else ((), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return map_arrow(_dealt(members), linked, "a long, b long")


def similar(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets that are not empty."""
    if 100 * min(len(u), len(v)) < percent * max(len(u), len(v)):
        return False
    common = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
    return 100 * common >= percent * (len(u) + len(v) - common)


def _verified(pairs: DataFrame, content: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, dtype=bool)
            one, two = batch.column(2), batch.column(3)
            size_of = text_buffers(one)[1] + text_buffers(two)[1]
            for x, y in slices(size_of, HELD):
                (s, so), (t, to) = shingle_sets(one.slice(x, y - x), size), shingle_sets(two.slice(x, y - x), size)
                for k in range(y - x):
                    ok[x + k] = similar(s[so[k] : so[k + 1]], t[to[k] : to[k + 1]], percent)
            yield batch.select([0, 1]).filter(pa.array(ok))
        pa.default_memory_pool().release_unused()

    one = content.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = content.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return map_arrow(joined, checked, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, miss: float = 1e-6, size: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept,
    text_hash (xxhash64 of the text) and root (the same number for all of a component, null without a set)."""
    rows = stored(_sign(docs, size, band_rows(percent, miss)), "signatures")
    nodes = rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"), F.first("bands").alias("bands"),
    )
    # the numbers are fixed by being written; all that follows reads them
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "set-classes")
    buckets = stored(_buckets(nodes), "buckets")
    pairs = stored(_first_pairs(buckets, percent, miss), "first-pairs").distinct()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "text_hash"), "node")
    found = texts(docs).select(F.xxhash64("text").alias("text_hash"), "text").join(wanted, "text_hash")
    content = stored(found.groupBy("node").agg(F.min("text").alias("text")), "candidate-texts")
    links = stored(_verified(pairs, content, percent, size), "first-links")
    roots = components(links)
    named = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = stored(_open_members(named, percent, miss), "open-members")
    more = stored(_joining_links(members.join(content, "node"), percent, miss, size), "more-links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    whole = nodes.select("digest", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(whole.join(best, "root").select("digest", "root", "component_id"), "components")
    return rows.join(named, "digest", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("digest").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
        "text_hash", "root",
    )
