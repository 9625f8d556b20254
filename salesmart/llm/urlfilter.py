"""URL rules by cascades of Bloom filters, with DataFrame functions only.

A key is a host (or one of its parents) followed by a start of the path. A cascade holds a
list of keys and answers exactly for every key of a known universe, here all keys of the
corpus: its first level is a Bloom filter of the listed keys, the second one of those keys of
the universe that the first wrongly lets through, the third one of the listed keys that the
second lets through, and so on until no wrong answer is left. The first level's rate of wrong
answers is chosen as |listed| / |universe|, the others' as one half, so every level has about
as many keys as the list or fewer: the whole cascade takes some 1.5 * log2(|universe| /
|listed|) + 5 bits a listed key. Only these bits (never keys) come to the driver, and they go
into the query as constants; judging a url needs no join.

Defined cases: a null url or one without ``://`` has an empty host and path and no rule; equal
urls are judged alike, row by row; an empty table or an empty list is allowed; ``rule`` is null
and the verdict ``default`` where no rule fits. Of fitting rules the longest wins, then the
longer host. Other columns of the table stay unread.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.llm.common import ascii_lower, stored


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: str  # 64-bit words, as text, with commas between

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")
        out = F.lit(True)
        for at in positions(key, self.bits, self.hashes, self.seed):
            out = out & (F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out


def positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    one, two = F.xxhash64(F.lit(2 * seed), key), F.xxhash64(F.lit(2 * seed + 1), key)
    # halves of 32 bits, so the sums stay in range
    one, two = F.shiftrightunsigned(one, 32), F.shiftrightunsigned(two, 32).bitwiseOR(F.lit(1))
    return [F.pmod(one + F.lit(i) * two, F.lit(bits).cast("long")) for i in range(hashes)]


def build_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    hashes = max(1, round(-math.log2(rate)))
    bits = 64 * max(1, math.ceil(max(1, n) * -math.log(rate) / math.log(2) ** 2 / 64))
    at = keys.select(F.explode(F.array(*positions(F.col("key"), bits, hashes, seed))).alias("at"))
    word = F.expr("shiftleft(1L, cast(at & 63 as int))")
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(word).alias("set"))
    full = ["0"] * (bits // 64)
    for word, value in words.collect():
        full[word] = str(value)
    return Level(bits, hashes, seed, ",".join(full))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over."""
        out = None
        for level in reversed(self.levels):
            out = level.holds(key) if out is None else level.holds(key) & ~out
        return F.lit(False) if out is None else out


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """``listed`` and ``universe``: distinct ``key`` each; ``universe`` is read once per level."""
    inside = stored(listed, "listed-keys")
    outside = stored(universe.join(inside, "key", "left_anti"), "other-keys")
    n_in, n_out = inside.count(), outside.count()
    levels: list[Level] = []
    while n_in:
        rate = min(0.5, max(n_in, 1) / n_out) if not levels and n_out else 0.5
        levels.append(level := build_level(inside, n_in, rate, len(levels)))
        # what the new level wrongly lets through is what the next one holds
        inside, outside = stored(outside.where(level.holds(F.col("key"))), "let-through"), inside
        n_in = inside.count()
    return Cascade(tuple(levels))


def with_host_path(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return pages.select("page_id", ascii_lower(host).alias("host"), path.alias("path"))


def candidates(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Every (length, length of the host, key) under which a rule for the url may be listed."""
    parts = F.split(host, r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    starts = F.filter(F.array(*[F.lit(n) for n in path_lengths]), lambda n: n <= F.char_length(path))
    keys = F.flatten(F.transform(parents, lambda h: F.transform(starts, lambda n: F.struct((F.char_length(h) + n).alias("size"), F.char_length(h).alias("host_size"), F.concat(h, F.substr(path, F.lit(1), n)).alias("key")))))
    return keys


def judge(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """``rules``: (verdict, host, path). Returns page_id, host, path, rule, verdict."""
    pages = with_host_path(pages)
    lengths = sorted({len(path) for _, _, path in rules}) or [0]
    keyed = pages.withColumn("keys", candidates(F.col("host"), F.col("path"), lengths))
    universe = stored(keyed.select(F.explode("keys.key").alias("key")).distinct(), "url-keys")
    verdicts = sorted({v for v, _, _ in rules})
    held = {v: build_cascade(spark.createDataFrame([(h.lower() + p,) for w, h, p in rules if w == v], "key string").distinct(), universe) for v in verdicts}

    def longest(cascade: Cascade) -> Column:
        return F.array_max(F.filter("keys", lambda k: cascade.contains(k["key"])))

    best = {v: longest(c) for v, c in held.items()}
    judged = keyed.select("page_id", "host", "path", *[b.alias(f"best_{v}") for v, b in best.items()])
    # a key listed under two verdicts takes the later one in alphabetical order
    top = F.array_max(F.array(*[F.when(F.col(f"best_{v}").isNotNull(), F.struct(F.col(f"best_{v}.size").alias("size"), F.col(f"best_{v}.host_size").alias("host_size"), F.lit(v).alias("verdict"), F.col(f"best_{v}.key").alias("key"))) for v in verdicts] or [F.lit(None).cast("struct<size:int,host_size:int,verdict:string,key:string>")]))
    return judged.withColumn("top", top).select("page_id", "host", "path", F.col("top.key").alias("rule"), F.coalesce(F.col("top.verdict"), F.lit(default)).alias("verdict"))
