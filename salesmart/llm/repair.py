"""Token ids in grammar-compressed shards (Re-Pair), written and read by Spark.

Documents are dealt out by ranges of doc_id, so shards follow each other in ascending
order. A task encodes its documents, fills shards of about ``shard_ids`` ids and
compresses each: the most frequent pairs of neighbouring symbols of a shard become new
symbols (nonterminals), again and again. A round takes many pairs at once; where chosen
pairs overlap, every second one of a run is replaced. The rounds go on as long as a rule saves
bytes: a rule takes 8 bytes (two symbols and its length; 12 with symbols of 32 bits) and each use
saves a symbol, so pairs with 5 uses (4) or more are replaced, until there are none. Symbols have
16 bits as long as 4096 nonterminals fit beside the vocabulary, else 32; with 16, the work also ends
when all are in use (16,128 beside 49,408 ids), as wider symbols cost more than further rules
save (README). A shard holds its rules, the
expansion length of every rule, the remaining symbols, the position in ids of every
``STEP``-th symbol, and its documents' ids and lengths. So any range of ids is decoded
from the symbols around it alone.

The file is a Parquet table, one row per shard: (part, seq) in ascending order, ``base``
(ids of the part before the shard), n_docs, n_ids and the shard's bytes, in little-endian:

    4s magic "RPG2", u4 bytes of a symbol (2 or 4), u4 first nonterminal, u4 rules,
    u4 rounds, u4 documents, u8 symbols, u8 ids;
    rules (2 symbols each), u4 expansion lengths, u4 rules made by each round,
    symbols, u8 position of every STEP-th symbol, i8 doc_ids, u1 doc_id-is-null, u8 ids of each document.

Defined cases: a null or empty text is the end id alone; rows of equal doc_id follow each
other in the order of their texts' hash and text; a null doc_id comes first; an empty table
gives an empty file. Only doc_id and text are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesmart.llm.common import map_arrow, run_folder, texts
from salesmart.llm.tokens import ragged, tokenizer, tokenizer_path

MAGIC = b"RPG2"
HEAD = struct.Struct("<4sIIIIIQQ")
STEP = 4096
SHARDS = "part int, seq int, base long, n_docs long, n_ids long, payload binary"
#: Places of the table in which a round looks chosen pairs up.
SLOTS_LOG2 = 18
#: Up to so many pairs of a round are chosen so that none overlap.
FEW = 512


def _nth(at: np.ndarray) -> np.ndarray:
    """For each of ascending places, how many right before it follow each other without a gap."""
    head = np.concatenate([[True], np.diff(at) != 1])[: len(at)]
    return np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))


def _count_pairs(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair at each place, distinct pairs, how often each; in a run of one symbol, every second place counts)."""
    wide = seq.dtype.itemsize * 2
    kind = np.dtype(f"u{wide}")
    pairs = (seq[:-1].astype(kind) << kind.type(wide * 4)) | seq[1:]
    again = np.flatnonzero(pairs[1:] == pairs[:-1]) + 1
    s = np.sort(np.delete(pairs, again[_nth(again) % 2 == 0]))
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return pairs, s[at], np.diff(np.append(at, len(s)))


def _slot(pairs: np.ndarray) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)


def _apart(pairs: np.ndarray, half: int) -> np.ndarray:
    """The pairs, in their order, that can overlap none taken before: so each keeps all its uses."""
    lefts, rights, out = set(), set(), []
    for k, p in enumerate(pairs.tolist()):
        a, b = p >> half, p & ((1 << half) - 1)
        if a not in rights and b not in lefts:
            lefts.add(a)
            rights.add(b)
            out.append(k)
    return pairs[out]


def compress(ids: np.ndarray, first: int, per_round: int = 4096) -> tuple[np.ndarray, list[int], np.ndarray]:
    """(rules, rules of each round, remaining symbols); nonterminals count up from ``first``. The work
    ends when no rule saves bytes any more or no symbol is left."""
    kind = np.uint16 if first + 4096 <= 1 << 16 else np.uint32
    width = np.dtype(kind).itemsize
    room = (1 << (8 * width)) - first
    least = (2 * width + 4) // width + 1  # a rule takes two symbols and a length, each use saves a symbol
    seq, rules, made = ids.astype(kind), [], []
    while room and len(seq) > 1:
        pairs, distinct, times = _count_pairs(seq)
        often = np.flatnonzero(times >= least)
        often = often[np.argsort(-times[often], kind="stable")][: min(per_round, room)]
        # one pair for each place of the table: the most frequent one
        _, one = np.unique(_slot(distinct[often]), return_index=True)
        chosen = distinct[often[np.sort(one)]]
        if not len(chosen):
            break
        if len(chosen) <= FEW:
            chosen = _apart(chosen, 8 * width)
        place = np.zeros(1 << SLOTS_LOG2, dtype=np.uint32)
        place[_slot(chosen)] = np.arange(1, len(chosen) + 1)
        found = place[_slot(pairs)]
        at = np.flatnonzero(found)
        rank = found[at].astype(np.int64) - 1
        same = chosen[rank] == pairs[at]
        at, rank = at[same], rank[same]
        # of overlapping places every second one
        nth = _nth(at)
        at, rank = at[nth % 2 == 0], rank[nth % 2 == 0]
        # a rule that overlaps left too few uses for waits for a later round
        uses = np.bincount(rank, minlength=len(chosen))
        used, ok = np.flatnonzero(uses >= least), uses[rank] >= least
        if not len(used):
            per_round = min(per_round, FEW)
            continue
        at, rank = at[ok], rank[ok]
        name = np.zeros(len(chosen), dtype=np.int64)
        name[used] = np.arange(len(used)) + first + sum(made)
        rules.append(np.stack([chosen[used] >> (8 * width), chosen[used] & ((1 << (8 * width)) - 1)], axis=1).astype(kind))
        made.append(len(used))
        room -= len(used)
        seq[at] = name[rank]
        stay = np.ones(len(seq), dtype=bool)
        stay[at + 1] = False
        seq = seq[stay]
    return np.concatenate([np.zeros((0, 2), kind), *rules]), made, seq


def _expansions(rules: np.ndarray, made: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all rules' expansions one after the other, start, length of each rule)."""
    flat, starts, lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    done = 0
    for n in made.tolist():
        part, done = rules[done : done + n].astype(np.int64).ravel(), done + n
        got, each = _expand(part, first, flat, starts, lengths)
        own = each.reshape(-1, 2).sum(axis=1)
        starts = np.concatenate([starts, len(flat) + np.cumsum(own) - own])
        lengths, flat = np.concatenate([lengths, own]), np.concatenate([flat, got])
    return flat, starts, lengths


def _expand(symbols: np.ndarray, first: int, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each symbol)."""
    is_rule = symbols >= first
    which = np.flatnonzero(is_rule)
    rule = symbols[which].astype(np.int64) - first
    each = np.ones(len(symbols), dtype=np.int64)
    each[which] = lengths[rule]
    to = np.cumsum(each) - each
    out = np.empty(int(each.sum()), dtype=np.uint32)
    out[to[~is_rule]] = symbols[~is_rule]
    out[ragged(to[which], lengths[rule])] = flat[ragged(starts[rule], lengths[rule])]
    return out, each


def encode_shard(ids: np.ndarray, first: int, doc_ids: list[int | None], doc_lengths: np.ndarray, **how) -> bytes:
    rules, made, seq = compress(ids, first, **how)
    made = np.array(made, dtype="<u4")
    _, _, lengths = _expansions(rules, made, first)
    each = np.ones(len(seq), dtype=np.int64)
    big = np.flatnonzero(seq >= first)
    each[big] = lengths[seq[big].astype(np.int64) - first]
    positions = (np.cumsum(each) - each)[::STEP]
    parts = [
        HEAD.pack(MAGIC, seq.dtype.itemsize, first, len(rules), len(made), len(doc_ids), len(seq), len(ids)),
        rules.tobytes(), lengths.astype("<u4").tobytes(), made.tobytes(), seq.tobytes(), positions.astype("<u8").tobytes(),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), np.array([d is None for d in doc_ids], dtype="u1").tobytes(), doc_lengths.astype("<u8").tobytes(),
    ]
    return b"".join(parts)


class Shard:
    """A shard's bytes, read again."""

    def __init__(self, payload: bytes):
        magic, width, self.first, n_rules, n_rounds, self.n_docs, n_seq, self.n_ids = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        rules = take(f"<u{width}", 2 * n_rules).reshape(-1, 2)
        self.expansion_lengths = take("<u4", n_rules)
        made = take("<u4", n_rounds)
        self.symbols = take(f"<u{width}", n_seq)
        self.positions = take("<u8", -(-n_seq // STEP)).astype(np.int64)
        doc_ids, nulls = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = pa.array(doc_ids, mask=nulls.astype(bool))
        self.doc_lengths = take("<u8", self.n_docs).astype(np.int64)
        self._rules = _expansions(rules, made, self.first)

    def ids(self) -> np.ndarray:
        return _expand(self.symbols, self.first, *self._rules)[0]

    def range(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on, from the symbols around them."""
        if n <= 0 or start >= self.n_ids:
            return np.zeros(0, np.uint32)
        lo = int(np.searchsorted(self.positions, start, side="right")) - 1
        hi = int(np.searchsorted(self.positions, start + n, side="left"))
        got, _ = _expand(self.symbols[lo * STEP : hi * STEP], self.first, *self._rules)
        return got[start - int(self.positions[lo]) :][:n]


def write_shards(docs: DataFrame, path: str, tokenizer_name: str = "word_bpe_49k.json", end_id: int = 2, shard_ids: int = 1 << 20, **how) -> None:
    """Encodes ``docs`` in ascending doc_id order and writes the shards to ``path``."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tk, part = tokenizer(tokenizer_path(tokenizer_name)), TaskContext.get().partitionId()
        first, base, seq = max(tk.size, end_id + 1), 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def shard() -> pa.RecordBatch:
            nonlocal base, seq
            ids, lengths = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            names = [d for x in held for d in x[0]]
            held.clear()
            row = [[part], [seq], [base], [len(names)], [len(ids)], [encode_shard(ids, first, names, lengths, **how)]]
            base, seq = base + len(ids), seq + 1
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array(v, k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in SHARDS.split(", ")])

        n = 0
        for batch in batches:
            for row, ids, counts in tk.batches(batch):
                held.append((batch.column(0).slice(row, len(counts)).to_pylist(), np.insert(ids, np.cumsum(counts), end_id), counts + 1))
                n += len(ids) + len(counts)
                if n >= shard_ids:
                    yield shard()
                    n = 0
        if n:
            yield shard()

    rows = texts(docs).withColumn("hash", F.xxhash64("text"))
    # the hash parts rows of one doc_id; ranges and task numbers both ascend
    ordered = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    map_arrow(ordered, encoded, SHARDS).write.option("compression", "none").parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document of the file: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = Shard(payload)
                data = memoryview(np.ascontiguousarray(s.ids(), dtype="<u4")).cast("B")
                ends = np.cumsum(s.doc_lengths)
                crc = [zlib.crc32(data[a * 4 : b * 4]) for a, b in zip((ends - s.doc_lengths).tolist(), ends.tolist())]
                cols = [s.doc_ids, pa.array(np.full(s.n_docs, part, np.int32)), pa.array(ends - s.doc_lengths + base), pa.array(s.doc_lengths), pa.array(crc, pa.int64())]
                yield pa.record_batch(cols, names=["doc_id", "part", "start", "n_tokens", "ids_crc32"])

    rows = map_arrow(shards.select("part", "base", "payload"), decoded, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each task that wrote: bounded by the number of partitions, not by the data
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer_name: str = "word_bpe_49k.json", end_id: int = 2, **how) -> DataFrame:
    """Writes the shards to a new folder below the shared one and returns what the files hold."""
    spark = docs.sparkSession
    path = run_folder(spark, "token-shards")
    write_shards(docs, path, tokenizer_name, end_id, **how)
    return read_documents(spark.read.schema(SHARDS).parquet(path))
