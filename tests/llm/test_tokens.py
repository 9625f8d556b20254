"""Ids against the library on whole texts; shards, packing and lengths against a plain version."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from salesmart.llm import lengths, packing, repair
from salesmart.llm.tokens import tokenizer, tokenizer_path

from .conftest import ODD

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def whole(name, text):
    return tokenizer(tokenizer_path(name)).tk.encode(text or "", add_special_tokens=False).ids


def crc_ids(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("name", NAMES)
def test_ids_are_the_librarys(name):
    rng = random.Random(3)
    alphabet = "ab Z.,'!|&é́ßẞ 　\x85\x1c\n\t\r 東½²İ<|>"
    texts = [*ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(600))]
    ids, counts = tokenizer(tokenizer_path(name)).ids(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == whole(name, text), text


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    ids = rng.choice(rng.integers(0, 49_000, 300), 60_000).astype(np.uint32)
    ids[5000:9000] = 7  # overlapping pairs
    for seq in (ids, ids[:1], ids[:0], np.zeros(999, np.uint32)):
        s = repair.Shard(repair.encode_shard(seq, 49_408, [1], np.array([len(seq)])))
        assert (s.ids() == seq).all() and s.n_ids == len(seq)
        for _ in range(50):
            a, n = int(rng.integers(0, len(seq) + 1)), int(rng.integers(0, 9000))
            assert (s.range(a, n) == seq[a : a + n]).all()
    assert len(repair.encode_shard(ids, 49_408, [1], np.array([len(ids)]))) < 2 * len(ids)
    wide = repair.Shard(repair.encode_shard(ids, 65_000, [None], np.array([len(ids)])))
    assert (wide.ids() == ids).all() and wide.doc_ids.to_pylist() == [None]


@pytest.mark.parametrize("first,least", [(49_408, 5), (65_000, 4)], ids=["16 bits", "32 bits"])
def test_grammar_goes_on_as_long_as_a_rule_saves_bytes(first, least):
    """No pair is left that a rule would pay for, and each rule has been worth its bytes."""
    rng = np.random.default_rng(3)
    phrases = [rng.integers(0, 9000, rng.integers(2, 12)) for _ in range(900)]
    ids = np.concatenate([phrases[k] for k in rng.zipf(1.3, 6000) % 900] + [np.full(70, 9001), rng.integers(9100, 40_000, 20_000), *[np.array([9002, 9003, 9100 + k]) for k in range(6)]]).astype(np.uint32)
    rules, made, seq = repair.compress(ids, first)
    assert sum(made) == len(rules) < (1 << 16) - 49_408
    assert repair.Shard(repair.encode_shard(ids, first, [1], np.array([len(ids)]))).ids().tolist() == ids.tolist()
    left, at, symbols = Counter(), {}, seq.tolist()
    for i, pair in enumerate(zip(symbols, symbols[1:])):
        if at.get(pair) != i - 1:  # uses of one pair must not overlap
            left[pair], at[pair] = left[pair] + 1, i
    assert max(left.values()) < least
    assert len(ids) - len(seq) >= least * len(rules)


def test_shards_in_doc_order(spark, odd, none):
    got = repair.encode_documents(odd, shard_ids=2000).collect()
    assert len(got) == odd.count()
    rows = sorted(got, key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    want = Counter((r.doc_id, len(w := [*whole(NAMES[0], r.text), 2]), crc_ids(w)) for r in odd.collect())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert repair.encode_documents(none).count() == 0


def test_packing(spark, odd, none):
    docs = odd.where("doc_id IS NOT NULL AND coalesce(text, '') NOT LIKE 'other%'").dropDuplicates(["doc_id", "text"])
    got = packing.pack_documents(docs, block_tokens=5000).collect()
    texts = {r.doc_id: [*whole(NAMES[1], r.text), 0] for r in docs.collect()}
    for d, ids in texts.items():
        mine = sorted((r for r in got if r.doc_id == d), key=lambda r: r.start)
        at = 0
        for r in mine:
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc_ids(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(none).count() == 0
    assert packing.pack_documents(odd).count() >= odd.count()


def test_packing_balances_cost_without_padding():
    rng = np.random.default_rng(2)
    lengths_ = rng.integers(1, 900, 800)
    doc, start, length, seq, offset = packing.pack(lengths_, 1024, 1.0, 1 / 1024)
    fill = np.bincount(seq, weights=length)
    assert fill.sum() == lengths_.sum() and len(fill) == -(-lengths_.sum() // 1024) and fill.max() <= 1024
    cost = np.bincount(seq, weights=length + length**2 / 1024)
    assert cost.std() / cost.mean() < 0.25


def test_length_table(spark, odd, none):
    hist = lengths.length_histogram(odd)
    n = sorted(len(whole(NAMES[1], r.text)) for r in odd.collect())
    assert {r.n_tokens: r.n_docs for r in hist.collect()} == Counter(n)
    table = lengths.limit_table(hist)
    for r in table.collect():
        k = r.context_limit
        assert (r.docs_upto, r.docs_beyond) == (sum(x <= k for x in n), sum(x > k for x in n))
        assert (r.tokens_upto, r.tokens_after_cut) == (sum(x for x in n if x <= k), sum(min(x, k) for x in n))
        assert r.padding == sum(k - min(x, k) for x in n) and abs(r.quantile - r.docs_upto / len(n)) < 1e-12
    wanted = [1, 7, 100, 1024, 10**6]
    got = {r.context_limit: (r.docs_upto, r.tokens_after_cut) for r in lengths.answers(table, wanted).collect()}
    assert got == {k: (sum(x <= k for x in n), sum(min(x, k) for x in n)) for k in wanted}
    assert lengths.quantiles(table, [0.5]).first().n_tokens == n[-(-len(n) // 2) - 1]
    assert lengths.limit_table(lengths.length_histogram(none)).count() == 0
