"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (its dense layers and
its attention). Documents are packed in blocks of about ``block_tokens``; each task
packs the blocks of its own partition, so nothing is shuffled and memory is bounded
by a block. Within a block, whole sequences are cut off long documents first; the
rests go in descending order to the sequence of the lowest cost that still has room
for them. A rest that fits nowhere whole is cut over the cheapest sequences with
room. A block gets as many sequences as its tokens need, so fewer than
``capacity`` places of a block stay empty.

Defined cases: a null or empty text is a document of the end id alone; repeated
rows are packed each on its own; a null doc_id is kept as null; an empty table
gives no pieces. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from salesmart.llm.common import map_arrow, texts
from salesmart.llm.tokens import tokenizer, tokenizer_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def pack(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[np.ndarray, ...]:
    """(document, start, length, sequence, offset) of each piece of one block."""
    doc, start, length, seq, offset = ([] for _ in range(5))
    whole, rest = np.divmod(lengths, capacity)
    n = int(whole.sum())
    doc.append(np.repeat(np.arange(len(lengths)), whole))
    start.append((np.arange(n) - np.repeat(np.cumsum(whole) - whole, whole)) * capacity)
    length.append(np.full(n, capacity))
    seq.append(np.arange(n))
    offset.append(np.zeros(n, dtype=np.int64))
    cost_of = linear * rest + quadratic * rest * rest
    order = np.lexsort((np.arange(len(rest)), -cost_of))
    order = order[rest[order] > 0]
    sequences = -(-int(rest.sum()) // capacity)
    room = np.full(sequences, capacity, dtype=np.int64)
    cost = np.zeros(sequences)
    pieces: list[tuple[int, int, int, int, int]] = []
    for d in order.tolist():
        at, left = int(whole[d]) * capacity, int(rest[d])
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
            s = int(np.where(fits, cost, np.inf).argmin())
            take = min(left, int(room[s]))
            pieces.append((d, at, take, n + s, capacity - int(room[s])))
            room[s] -= take
            cost[s] += linear * take + quadratic * take * take
            at, left = at + take, left - take
    for out, col in zip((doc, start, length, seq, offset), np.array(pieces, dtype=np.int64).reshape(-1, 5).T):
        out.append(col)
    return tuple(np.concatenate(x).astype(np.int64) for x in (doc, start, length, seq, offset))


def pack_documents(
    docs: DataFrame, tokenizer_name: str = "byte_bpe_50k.json", end_id: int = 0, capacity: int = 1024,
    linear: float = 1.0, quadratic: float = 1 / 1024, block_tokens: int = 1 << 20,
) -> DataFrame:
    """One row per piece; ``sequence_id`` holds the partition in its upper bits, so
    ids are unique and a task that runs again gives the same ones."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tk, first = tokenizer(tokenizer_path(tokenizer_name)), TaskContext.get().partitionId() << 36
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal first
            ids = np.concatenate([x[1] for x in held])
            counts = np.concatenate([x[2] for x in held])
            names = pa.concat_arrays([x[0] for x in held])
            held.clear()
            begin = np.cumsum(counts) - counts
            doc, start, length, seq, offset = pack(counts, capacity, linear, quadratic)
            data = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
            lo = ((begin[doc] + start) * 4).tolist()
            hi = ((begin[doc] + start + length) * 4).tolist()
            crc = np.array([zlib.crc32(data[a:b]) for a, b in zip(lo, hi)], dtype=np.int64)
            cost = linear * length + quadratic * length.astype(float) ** 2
            cols = [names.take(pa.array(doc)), start, length, crc, counts[doc], seq + first, offset, cost]
            first += int(seq.max()) + 1
            yield pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names=[c.split()[0] for c in PIECES.split(", ")])

        tokens = 0
        for batch in batches:
            for row, ids, counts in tk.batches(batch):
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                held.append((batch.column(0).slice(row, len(counts)), ids, counts + 1))
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield from block()
                    tokens = 0
        if tokens:
            yield from block()

    return map_arrow(texts(docs), packed, PIECES)
