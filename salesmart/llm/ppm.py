"""Prediction by partial matching: the code length of every text under byte contexts.

The model counts, over all training texts (A-Z lower-cased), which byte follows which ``ORDER``
bytes; the counts of shorter contexts are sums of these. A byte is coded in the longest context
that training has seen; if the context never had that byte, an escape of probability
d / (n + d) is coded (d distinct bytes, n occurrences; PPM method C) and the next shorter context
is asked, without the bytes that the longer one had (symbol exclusion). Below the empty context
all bytes left are alike. Texts begin after ORDER bytes 0xFE and end with a byte 0xFF, which
UTF-8 does not use, so the code length covers the end of the text too.

The code length of a byte depends on the last ORDER + 1 bytes alone, so Spark computes it once
for every such gram and brings it back to the texts:

1. Texts are dealt out to blocks of about ``BLOCK_BYTES`` and written, compressed, to the shared folder.
2. Each block gives its distinct words and grams with their counts in training texts.
3. Words: one shuffle by word sums the counts of all blocks. Grams: counts are summed with partial
   sums; the rows of ``DEAL`` (three) context bytes meet in one task, which builds their branch of the
   trie (the two bytes before them and the coded one are free: 256**3 grams at most) and codes each
   gram. What contexts of two bytes count is a table of its own (256**3 rows at most), joined by key:
   Spark broadcasts it where its size allows. Contexts of one byte or none come from a table of at
   most 256 * 256 rows, which every task gets.
4. Counts and code lengths go back to the blocks they came from, a block to a partition, and each
   block's texts are scored. Words are told by their rank among the block's words.

The training data are never gathered anywhere: tables of words and grams grow with the corpus.

Defined cases: a null or empty text has the end token and the end byte alone; repeated rows are
scored and counted each on its own; a null doc_id counts as training; without training texts
every count is 0; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesmart.llm.common import map_arrow, run_folder, ship, stored, texts
from salesmart.llm.tokens import slices, text_buffers
from salesmart.llm.words import LOWER, Words

ORDER = 5
PAD, END = 0xFE, 0xFF
BLOCK_BYTES = 32 << 20
#: Grams take some 50 bytes for each byte of text while they are counted or looked up.
GRAM_BYTES = 1 << 20
#: Words take some 30 bytes for each byte of text while they are cut.
WORD_BYTES = 1 << 20
#: Bytes of context whose grams meet in one task.
DEAL = 3
#: Blocks beyond this number share partitions; a task works on one block after the other.
MAX_PARTITIONS = 200_000


def gram_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ORDER + 1 bytes up to each byte as a number, offsets by text), end bytes included."""
    n = len(offsets) - 1
    gap = ORDER + 1  # ORDER bytes before a text, one after it
    padded = np.full(len(data) + gap * n + ORDER, PAD, dtype=np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(n) * gap + ORDER, np.diff(offsets))
    padded[place] = data
    begin = offsets[:-1] + np.arange(n) * gap + ORDER
    end = offsets[1:] + np.arange(n) * gap + ORDER
    padded[end] = END
    key = np.zeros(len(padded), dtype=np.uint64)
    for i in range(ORDER + 1):
        key[ORDER:] = (key[ORDER:] << np.uint64(8)) | padded[i : len(padded) - ORDER + i]
    real = np.ones(len(padded), dtype=bool)
    for i in range(ORDER):
        real[begin - 1 - i] = False
    real[len(data) + gap * n :] = False
    return key[real], offsets + np.arange(n + 1)


def count_grams(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[at], np.diff(np.append(at, len(s)))


def low_orders(counts: np.ndarray) -> dict[str, np.ndarray]:
    """From a 256 x 256 table of counts (byte before, byte): what contexts of one byte and none need."""
    one = counts.reshape(256, 256)
    zero = one.sum(axis=0)
    return {"one": one, "zero": zero, "n1": one.sum(axis=1), "d1": (one > 0).sum(axis=1), "x1": (zero[None, :] * (one > 0)).sum(axis=1)}


def code_grams(grams: np.ndarray, counts: np.ndarray, low: dict[str, np.ndarray], two: dict[str, np.ndarray]) -> np.ndarray:
    """log10 probability of the last byte of each distinct gram; ``grams`` must hold all grams of their last
    ``DEAL`` context bytes that training has. ``two`` has, for each gram, what its context of two bytes counts:
    ``c`` the coded byte, ``n`` all bytes, ``d`` distinct ones, ``x`` these bytes in the context of one."""
    out = np.zeros(len(grams))
    open_ = np.ones(len(grams), dtype=bool)
    skip_n, skip_d = np.zeros(len(grams)), np.zeros(len(grams))
    # counts of the contexts of ORDER .. DEAL bytes
    level, at = {}, np.arange(len(grams))
    uniq, num = grams, counts.astype(np.int64)
    for k in range(ORDER, DEAL - 1, -1):
        if k < ORDER:
            low_keys, back = np.unique(uniq & np.uint64((1 << (8 * (k + 1))) - 1), return_inverse=True)
            num = np.bincount(back, weights=num, minlength=len(low_keys)).astype(np.int64)
            up, uniq, at = back, low_keys, back[at]
        else:
            up = None
        ctx, of = np.unique(uniq >> np.uint64(8), return_inverse=True)
        n = np.bincount(of, weights=num, minlength=len(ctx))
        d = np.bincount(of, weights=num > 0, minlength=len(ctx))
        level[k] = {"num": num, "of": of, "n": n, "d": d, "at": at, "up": up}
    some = np.zeros(len(uniq), dtype=np.int64)  # a gram of each gram of DEAL context bytes
    some[at] = np.arange(len(grams))
    first = (grams >> np.uint64(8) & np.uint64(255)).astype(np.int64)
    byte = (grams & np.uint64(255)).astype(np.int64)
    for k in range(ORDER, -1, -1):
        if k >= DEAL:
            lv = level[k]
            c, n, d = lv["num"][lv["at"]], lv["n"][lv["of"]][lv["at"]], lv["d"][lv["of"]][lv["at"]]
            # what the bytes of this context count in the next shorter one
            short = level[k - 1]["num"][level[k - 1]["up"]] if k > DEAL else two["c"][some]
            x = np.bincount(lv["of"], weights=short * (lv["num"] > 0), minlength=len(lv["n"]))[lv["of"]][lv["at"]]
        elif k == 2:
            c, n, d, x = two["c"], two["n"], two["d"], two["x"]
        elif k == 1:
            c, n, d, x = low["one"][first, byte], low["n1"][first], low["d1"][first], low["x1"][first]
        else:
            c, n, d, x = low["zero"][byte], np.full(len(grams), low["zero"].sum()), np.full(len(grams), (low["zero"] > 0).sum()), None
        seen = n > 0
        left_n, left_d = n - skip_n, d - skip_d
        act = open_ & seen & (left_n > 0)
        hit = act & (c > 0)
        miss = act & (c == 0)
        out[hit] += np.log10(c[hit] / (left_n[hit] + left_d[hit]))
        out[miss] += np.log10(left_d[miss] / (left_n[miss] + left_d[miss]))
        open_ &= ~hit
        if x is not None:
            skip_n, skip_d = np.where(seen, x, skip_n), np.where(seen, d, skip_d)
    rest = 256 - int((low["zero"] > 0).sum())
    out[open_] -= np.log10(rest)
    return out


PARTS = "block long, n_train long, payload binary"


def _blocks(docs: DataFrame) -> DataFrame:
    """Parts of blocks: a block is texts that follow each other in a task, BLOCK_BYTES or one text; a part
    holds some of its (doc_id, text, train), compressed, so blocks move between tasks at a third of their size."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            offsets = text_buffers(batch.column(1))[1]
            for a, b in slices(offsets):
                n = int(offsets[b] - offsets[a])
                if held and held + n > BLOCK_BYTES:
                    block, held = block + 1, 0
                held += n
                part, sink = batch.slice(a, b - a), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                learn = int(np.count_nonzero(part.column(2).to_numpy(zero_copy_only=False)))
                yield pa.record_batch([pa.array([block]), pa.array([learn]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "n_train", "payload"])

    return map_arrow(docs, dealt, PARTS)


def _unpacked(payload: pa.Scalar) -> tuple[pa.Array, pa.Array, np.ndarray]:
    t = pa.ipc.open_stream(payload.as_buffer()).read_all().combine_chunks().to_batches()[0]
    return t.column(0), t.column(1), t.column(2).to_numpy(zero_copy_only=False)


def _counted(blocks: DataFrame, what: str, schema: str) -> DataFrame:
    """Distinct words or grams of each block, with their counts in its training texts; words with their rank."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        block, size = None, 0

        def summed() -> pa.Table:
            t = pa.concat_tables(held).group_by("key", use_threads=False).aggregate([("n", "sum")])
            return pa.table({"key": t.column("key"), "n": t.column("n_sum")})

        def done() -> Iterator[pa.RecordBatch]:
            t = summed()
            if what == "words":  # numbered in byte order, as the scorer of the block finds them again
                t = t.sort_by("key")
                t = t.append_column("id", pa.array(np.arange(len(t))))
            t = t.append_column("block", pa.array(np.full(len(t), block, dtype=np.int64)))
            yield from t.combine_chunks().to_batches(max_chunksize=100_000)

        for batch in batches:
            for own, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                if own != block and held:
                    yield from done()
                    held, size = [], 0
                block = own
                _, part, learn = _unpacked(payload)
                for a, b in slices(text_buffers(part)[1], WORD_BYTES if what == "words" else GRAM_BYTES):
                    if what == "words":
                        w = Words(part.slice(a, b - a))
                        mask = np.repeat(learn[a:b], w.count)
                        n = np.bincount(w.code[mask], minlength=len(w.names))
                        held.append(pa.table({"key": w.names.cast(pa.string()), "n": pa.array(n)}))
                    else:
                        data, offsets = text_buffers(part.slice(a, b - a))
                        keys, ends = gram_keys(LOWER[data], offsets)
                        mask = np.repeat(learn[a:b], np.diff(ends))
                        seen, n = count_grams(keys[mask])
                        new = np.setdiff1d(keys[~mask], seen)
                        held.append(pa.table({"key": pa.array(np.concatenate([seen, new]).astype(np.int64)), "n": pa.array(np.concatenate([n, np.zeros(len(new), np.int64)]))}))
                    size += len(held[-1])
                    if size > max(1_000_000, 2 * len(held[0])):  # the first holds all sums so far
                        held = [summed()]
                        size = len(held[0])
        if held:
            yield from done()
        held = []
        pa.default_memory_pool().release_unused()

    return map_arrow(blocks.select("block", "payload"), counted, schema)


TWO = (1 << 24) - 1  # two context bytes and the coded one


def _two_bytes(spark: SparkSession, grams: DataFrame) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """What contexts of two bytes count, a row for each gram of them (256**3 rows at most), and what shorter ones count."""
    counts = stored(grams.groupBy(F.col("key").bitwiseAND(F.lit(TWO)).alias("gram")).agg(F.sum("n").alias("c")), "two-byte-grams")
    pairs = counts.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(F.sum("c").alias("short"))
    table = np.zeros(1 << 16, dtype=np.int64)
    for pair, n in pairs.collect():  # 256 * 256 rows at most
        table[pair] = n
    before = F.shiftright("gram", 8)
    contexts = (counts.where("c > 0").join(F.broadcast(pairs), F.col("gram").bitwiseAND(F.lit(0xFFFF)) == F.col("pair"))
                .groupBy(before.alias("before")).agg(F.sum("c").alias("n2"), F.count("*").alias("d2"), F.sum("short").alias("x2")))
    rows = counts.withColumn("before", before).join(contexts, "before", "left")
    return stored(rows.select("gram", F.col("c").alias("c2"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n2", "d2", "x2")]), "two-byte-contexts"), low_orders(table)


def _coded(totals: DataFrame, two: DataFrame, low: dict[str, np.ndarray]) -> DataFrame:
    """(key, value): log10 probability of each gram; rows of ``DEAL`` context bytes meet in one task."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last = 0, None

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            key, n, c, n2, d2, x2 = (t.column(name).to_numpy() for name in ("key", "n", "c2", "n2", "d2", "x2"))
            value = code_grams(key.astype(np.uint64), n, low, {"c": c, "n": n2, "d": d2, "x": x2})
            return pa.record_batch([pa.array(key), pa.array(value)], names=["key", "value"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ctx = batch.column("ctx").to_numpy()
            cut = int(np.searchsorted(ctx, ctx[-1]))  # the last context may go on in the next batch
            if ctx[-1] != last and rows + cut > 200_000:
                held.append(batch.slice(0, cut))
                yield out()
                held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows, last = rows + batch.num_rows, ctx[-1]
        if rows:
            yield out()

    ctx = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * DEAL) - 1))
    rows = totals.join(two, F.col("key").bitwiseAND(F.lit(TWO)) == F.col("gram")).drop("gram")
    rows = rows.withColumn("ctx", ctx).repartition("ctx").sortWithinPartitions("ctx", "key")
    return map_arrow(rows, coded, "key long, value double")


SCORES = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def score_texts(docs: DataFrame, held_out: int = 2, of: int = 7) -> DataFrame:
    """Learns from rows whose crc32(doc_id as text) mod ``of`` is not ``held_out`` and scores all rows."""
    spark = docs.sparkSession
    ship(spark)
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of != held_out, F.lit(True))
    path = run_folder(spark, "text-blocks")
    _blocks(texts(docs).withColumn("train", train)).write.option("compression", "none").parquet(path)
    blocks = spark.read.schema(PARTS).parquet(path)

    # words: the sum of a word's counts, brought to every block that has it
    words = _counted(blocks, "words", "key string, n long, id long, block long")
    own = Window.partitionBy("key")
    words = words.select("n", "id", "block", F.sum("n").over(own).alias("total"), (F.row_number().over(own.orderBy("block")) == 1).alias("first"))
    path = run_folder(spark, "word-counts")
    words.write.option("compression", "zstd").parquet(path)
    words = spark.read.parquet(path)
    n_words, known = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("first") & (F.col("total") > 0), 1))).first()
    task, nth = F.shiftright("block", 32), F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    ends, n_blocks, tasks, most = blocks.agg(*[F.coalesce(c, F.lit(0)) for c in (F.sum("n_train"), F.count_distinct("block"), F.max(task) + 1, F.max(nth) + 1)]).first()
    n_all, distinct = n_words + ends, known + (1 if ends else 0)

    # grams: their counts, the trie, and the code length of each
    path = run_folder(spark, "gram-counts")
    _counted(blocks, "grams", "key long, n long, block long").write.option("compression", "zstd").parquet(path)
    grams = spark.read.parquet(path)
    two, low = _two_bytes(spark, grams)
    coded = _coded(grams.groupBy("key").agg(F.sum("n").alias("n")), two, low)
    back = grams.select("key", "block").join(coded, "key")

    # words go back by their rank in the block, below 0
    found = words.select("block", (-F.col("id") - 1).alias("key"), F.col("total").cast("double").alias("value")).unionByName(back.select("block", "key", "value"))
    scale = np.log10(n_all + 1 * (distinct + 1))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        key, value = right.column("key").to_numpy(), right.column("value").to_numpy()
        order = np.argsort(key)
        key, value = key[order], value[order]
        del right, order
        n_names = int(np.searchsorted(key, 0))
        total, key, value = value[:n_names][::-1], key[n_names:], value[n_names:]
        held = []  # words of each slice of each part: distinct ones, their places, how many a text has
        for payload in left.column("payload"):
            part, cut = _unpacked(payload)[1], []
            for x, y in slices(text_buffers(part)[1], WORD_BYTES):
                w = Words(part.slice(x, y - x))
                cut.append((w.names.cast(pa.string()), w.code.astype(np.int32), w.count.astype(np.int32)))
                del w
            held.append(cut)
            del part, cut
        # one dictionary for all slices, and the rank of each of its words
        coded = pa.concat_arrays([pa.array([], pa.string()), *(w[0] for cut in held for w in cut)]).dictionary_encode()
        words, place = coded.dictionary, coded.indices.to_numpy()
        if len(words) != n_names:
            raise ValueError(f"a block of {len(words)} words got the counts of {n_names}")
        of_word = np.zeros(n_names)
        of_word[pc.sort_indices(words).to_numpy()] = total
        seen = of_word[place]
        ends_at = iter(np.cumsum([len(w[0]) for cut in held for w in cut]).tolist())
        held = [[(seen[end - len(word) : end], code, count) for word, code, count in cut for end in [next(ends_at)]] for cut in held]
        del coded, words, place, of_word, total
        pa.default_memory_pool().release_unused()
        names, train, tokens, known, base, score = [], [], [], [], [], []
        for i, payload in enumerate(left.column("payload")):
            own, part, learn = _unpacked(payload)
            names.append(own)
            train.append(learn)
            for word, code, count in held[i]:
                c, n = word[code], len(count)
                row = np.repeat(np.arange(n), count)
                tokens.append(count.astype(np.int64) + 1)
                known.append(np.bincount(row, weights=c > 0, minlength=n).astype(np.int64) + (ends > 0))
                base.append(np.bincount(row, weights=np.log10(c + 1), minlength=n) + np.log10(ends + 1) - (count + 1) * scale)
            held[i] = None
            for x, y in slices(text_buffers(part)[1], GRAM_BYTES):
                data, offsets = text_buffers(part.slice(x, y - x))
                keys, at = gram_keys(LOWER[data], offsets)
                coded = pa.array(keys.astype(np.int64)).dictionary_encode()
                bits = value[np.searchsorted(key, coded.dictionary.to_numpy())][coded.indices.to_numpy()]
                score.append(np.add.reduceat(bits, at[:-1]))
        pa.default_memory_pool().release_unused()
        cols = [pa.concat_arrays(names), *(pa.array(np.concatenate(x)) for x in (train, tokens, known, base, score))]
        return pa.table(cols, names=[c.split()[0] for c in SCORES.split(", ")])

    # blocks are numbered across the tasks that dealt them: first ones, second ones, ...
    own = (nth * F.lit(tasks) + task).cast("int")
    parts = max(min(tasks * most, 2 * n_blocks, MAX_PARTITIONS), 1)
    sides = [x.withColumn("block", own).repartitionById(parts, F.col("block")).groupBy("block") for x in (blocks, found)]
    out = sides[0].cogroup(sides[1]).applyInArrow(scored, SCORES)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
