"""Dedup, near duplicates, decontamination, language model, classifier, URL rules against plain versions."""

import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from salesmart.llm import bm25, gam, linededup, minhash, ppm, streamdedup, urlfilter

from .conftest import crc

SPACE = re.compile(r"[ \t-\r]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return [w for w in SPACE.split(low(text)) if w]


def near_copies(n=60, seed=5):
    """Families of texts with a few words changed, chains and strangers among them."""
    rng = random.Random(seed)
    out = []
    for _ in range(n // 6):
        base = [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(rng.randrange(30, 160))]
        for _ in range(6):
            out.append(" ".join(base))
            base = list(base)
            for _ in range(rng.randrange(3)):
                base[rng.randrange(len(base))] = "new" + str(rng.randrange(1000))
    return out


def test_near_duplicates_are_exact(spark, odd, none):
    rows = [(i, t) for i, t in enumerate(near_copies(240))] + [(i + 500, t) for i, t in enumerate(near_copies(60))]
    rows += [(900, ""), (901, None), (902, "a b"), (903, "A  b"), (904, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.near_duplicates(odd).count() == odd.count()


def test_cells_of_two_parts_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 3)
    docs = spark.createDataFrame(list(enumerate(near_copies(36, 9))), "doc_id long, text string")
    small = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    monkeypatch.setattr(minhash, "CELL", 2048)
    assert small == {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()}


def test_bands_and_bounds_of_minhash():
    """Band keys follow the whole minima, and all bounds together lose a pair of the threshold with the chosen probability at most."""
    import numpy as np

    for similarity in (0.8, 0.85):
        least = minhash.least_matches(similarity, 1e-6)
        assert 0 < minhash.lost(least, similarity) <= 1e-6 and minhash.lost(least, similarity + 0.05) < minhash.lost(least, similarity)
        assert minhash.lost(least, 0.3) > 0.99
    sets = np.random.default_rng(3).integers(0, 1 << 63, 40_000, dtype=np.uint64).reshape(4000, 10)
    sets[1] = sets[0]
    sig, keys = minhash.signatures(sets.ravel(), np.arange(4001) * 10, 1)
    assert (keys[0] == keys[1]).all() and (keys & 127 == np.arange(120)).all()
    # single minima of 8 bits agree often by chance, their keys only where the minima do
    assert len(np.unique(keys[1:, 0])) == 3999 and len(np.unique(sig[1:, 0])) <= 256


@pytest.mark.parametrize("digest", [streamdedup.sha256, lambda t: F.length(t).cast("string")], ids=["sha256", "colliding"])
def test_stream_dedup(spark, odd, none, tmp_out, digest):
    odd.write.parquet(f"{tmp_out}/docs.parquet")
    got = Counter(map(tuple, streamdedup.dedup(spark, f"{tmp_out}/docs.parquet", digest, max_files=1).drop("text_sha256").collect()))
    groups = defaultdict(list)
    for r in odd.collect():
        groups[r.text or ""].append(r.doc_id)
    want = Counter()
    for ids in groups.values():
        best = max(ids, key=lambda i: (i is not None, i or 0))
        for k, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)):
            want[i, best, len(ids), k == 0] += 1
    assert got == want
    none.write.parquet(f"{tmp_out}/none.parquet")
    assert streamdedup.dedup(spark, f"{tmp_out}/none.parquet").count() == 0


def test_lines(spark, odd, none):
    rows = odd.collect()
    keys = defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            k = low(line.strip(" \t\n\x0b\x0c\r"))
            if len(k) >= 40:
                keys[k].add(r.doc_id)
    often = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in keys.items() if len(ids) >= 5}
    want = Counter()
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if (k := low(x.strip(" \t\n\x0b\x0c\r"))) not in often or often[k] == r.doc_id]
        want[r.doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    out = linededup.drop_lines(odd)
    assert Counter(map(tuple, out.select("doc_id", "text", "n_lines", "n_dropped").collect())) == want
    assert sum(r.n_dropped for r in out.collect()) == 6
    assert linededup.line_dedup_digest(none).count() == 0


def test_url_rules(spark):
    rng = random.Random(4)
    hosts = ["com", "a.com", "www.example.com", "x.www.example.com", "example.com", "notexample.com", "shop.net", "NET", "a.org", ""]
    paths = ["", "/", "/en", "/en/1", "/es/", "/fr/x?y#z", "/enx/", "?q=/en/", "#/es/"]
    rows = [(i, f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(300)] + [(900, None), (901, "no-scheme.com/en/"), (902, ""), (903, "://com/")]
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for r in urlfilter.judge(spark, pages, rules).join(pages, "page_id").collect():
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = low(host)
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *(max(fit)[1:] if fit else (None, "allow")))
    assert urlfilter.judge(spark, pages.where("page_id < 0"), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge(spark, pages, []).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 3000, 41).select(F.concat(F.lit("k"), "id").alias("key"))
    c = urlfilter.build_cascade(listed, universe)
    assert len(c.levels) > 1
    got = {r.key for r in universe.where(c.contains(F.col("key"))).collect()}
    assert got == {r.key for r in listed.collect()}


def test_code_lengths(spark, odd, none):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["The", "cat", "sat", "on", "mat", "été", "x" + str(rng.randrange(40))]) for _ in range(rng.randrange(40)))) for i in range(60)]
    rows += [(200, ""), (201, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = {i for i, _ in rows if crc(str(i)) % 7 != 2}
    counts, ctx = Counter(), [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    data = {i: b"\xfe" * ppm.ORDER + low(t).encode() + b"\xff" for i, t in rows}
    for i, t in rows:
        if i in train:
            counts.update([*words(t), None])
            for p in range(ppm.ORDER, len(data[i])):
                for k in range(ppm.ORDER + 1):
                    ctx[k][data[i][p - k : p]][data[i][p]] += 1
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in ppm.score_texts(docs).collect()}
    for i, t in rows:
        own, score, b = [*words(t), None], 0.0, data[i]
        for p in range(ppm.ORDER, len(b)):
            out: set = set()
            for k in range(ppm.ORDER, -1, -1):
                seen = {s: c for s, c in ctx[k].get(b[p - k : p], {}).items() if s not in out}
                if b[p] in seen:
                    score += math.log10(seen[b[p]] / (sum(seen.values()) + len(seen)))
                    break
                if seen:
                    score += math.log10(len(seen) / (sum(seen.values()) + len(seen)))
                    out |= set(seen)
            else:
                score -= math.log10(256 - len(ctx[0][b""]))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert math.isclose(r.score, score, rel_tol=1e-9)
    assert ppm.score_texts(odd).count() == odd.count()
    assert ppm.score_texts(none).count() == 0


def test_counting_grams_holds_little_of_a_block(spark, monkeypatch):
    """4 MB of text at once took some 60 bytes for each of its bytes, in each worker of an executor."""
    rng = np.random.default_rng(3)
    texts = pa.array([bytes(rng.integers(97, 123, 20_000, dtype=np.uint8)).decode() for _ in range(210)])
    batch = pa.record_batch([pa.array(range(210)), texts, pa.array([i % 3 > 0 for i in range(210)])], names=["doc_id", "text", "train"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    block = pa.record_batch([pa.array([0]), pa.array([sink.getvalue().to_pybytes()])], names=["block", "payload"])
    monkeypatch.setattr(ppm, "map_arrow", lambda df, f, schema: f)
    counted = ppm._counted(spark.createDataFrame([], ppm.PARTS), "grams", "key long, n long, block long")
    tracemalloc.start()
    rows = sum(int(np.sum(b.column("n").to_numpy())) for b in counted(iter([block])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 140 * 20_001
    assert peak < 100 << 20


def test_decontamination(spark, odd, none):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    items = [(i, f"{prose(rng.randrange(15, 150))}.\n{prose(8)}?") for i in range(40)] + [(90, None), (91, ""), (92, "...")]
    docs = [(i, prose(rng.randrange(0, 400))) for i in range(80)]
    docs += [(100 + i, f"{prose(100)} {t.upper()} {prose(70)}") for i, t in items[:40]] + [(300, " ".join(items[0][1].split()[:6])), (301, None)]
    frame, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in bm25.contaminated(frame, tests).collect()}
    assert got == {(100 + i, i) for i, _ in items[:40]}
    assert {r.doc_id for r in bm25.decontaminate(frame, tests).collect()} == {i for i, _ in docs if not 100 <= i < 140}
    assert bm25.contaminated(none, tests).count() == 0 and bm25.contaminated(odd, tests).count() == 0
    assert bm25.contaminated(frame, tests.where("item_id < 0")).count() == 0
    assert bm25.decontaminate(odd, tests).count() == odd.count() and bm25.decontaminate(odd, tests).columns == odd.columns


def test_bounds_lose_no_part():
    """All parts whose score reaches the threshold, by adding up every posting."""
    rng = random.Random(9)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(500)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(50)]
    df = Counter(w for _, t in items for w in set(t.split()))
    ix = bm25.Index(items, df, len(items), 30.0)
    import numpy as np

    for _ in range(20):
        text = rng.choice(items)[1].split()[:22] + [rng.choice(vocabulary) for _ in range(60)]
        term = np.array([ix.terms[w.encode()] for w in text if w.encode() in ix.terms])
        w, b = ix.bounded(term, np.zeros(len(term), np.int64), 1, np.array([False]), 0.5)
        own = np.unique(term)
        pair, t = np.repeat(np.arange(len(b)), len(own)), np.tile(own, len(b))
        _, part, score = ix.scored(pair, t, b[pair], 0.5)
        mine = {t for t in text}
        full = {i: sum(ix.weight[k] for k in range(len(ix.part)) if ix.part[k] == i and list(ix.terms)[np.searchsorted(ix.list_start, k, "right") * 0 + _term(ix, k)].decode() in mine) for i in range(50)}
        assert {i: round(s, 9) for i, s in zip(part.tolist(), score.tolist())} == {i: round(s, 9) for i, s in full.items() if s >= 0.5}


def _term(ix, posting):
    import numpy as np

    at = int(np.searchsorted(ix.list_start, posting, "right")) - 1
    return int(ix.list_key[at] // ix.blocks)


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = gam.train(docs, labels)
    assert model.pairs and len(model.tables) == len(gam.FEATURES)
    got = gam.score_documents(docs, model)
    assert got.count() == docs.count()
    wrong, n = 0, 0
    for r in got.join(labels, "doc_id").collect():
        assert r.held_out == (crc(str(r.doc_id)) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.held_out:
            wrong, n = wrong + (r.predicted != r.quality), n + 1
    assert n > 100 and wrong / n < 0.05
    assert gam.score_documents(odd, model).count() == odd.count() and gam.score_documents(none, model).count() == 0
    assert gam.keep_good(odd, model, 0.0).columns == odd.columns
    empty = gam.train(docs, labels.where("doc_id < 0"))
    assert {r.score for r in gam.score_documents(docs.limit(3), empty).collect()} == {0.5}


def test_url_rules_on_odd_rows(spark):
    """Repeated rows, a null id, a very long url and extra columns of clashing names: judged row by row."""
    rules = [("block", "net", "/es/"), ("allow", "a.net", "/es/")]
    urls = [(1, "http://a.net/es/x"), (1, "http://a.net/es/x"), (None, "HTTP://B.Net/es/"), (2, f"http://{'s.' * 200}net/es/{'p' * 50_000}"), (3, "x://net/es")]
    pages = spark.createDataFrame([(*r, "h", "p", "r", "v", "k") for r in urls], "page_id long, url string, host string, path string, rule string, verdict string, keys string")
    got = Counter((r.page_id, r.rule, r.verdict) for r in urlfilter.judge(spark, pages, rules).collect())
    assert got == {(1, "a.net/es/", "allow"): 2, (None, "net/es/", "block"): 1, (2, "net/es/", "block"): 1, (3, None, "allow"): 1}


def test_decontamination_with_odd_items(spark):
    """Repeated items, a null id and extra columns that clash with the documents'."""
    rng = random.Random(12)
    text = " ".join(f"w{rng.randrange(300)}" for _ in range(60)) + ".\n" + " ".join(f"w{rng.randrange(300)}" for _ in range(8)) + "?"
    other = " ".join(f"v{rng.randrange(300)}" for _ in range(60))
    items = spark.createDataFrame([(i, text, 7, "h", "s") for i in (1, 1, None)], "item_id long, text string, doc_id long, hash string, score string")
    docs = spark.createDataFrame([(1, f"{other} {text} {other}", "i"), (1, f"{other} {text} {other}", "i"), (2, other, "i"), (None, text, "i")], "doc_id long, text string, item_id string")
    assert {r.doc_id for r in bm25.decontaminate(docs, items).collect()} == {2}
    assert bm25.decontaminate(docs, items).count() == 1 and bm25.decontaminate(docs, items).columns == docs.columns
    assert {r.doc_id for r in bm25.contaminated(docs, items).collect()} == {1, None}


def test_decontamination_in_shards(spark, monkeypatch):
    """Several shards, a third of the items equal: item_ids and shares of the plain overlap rule, every repeat on its own."""
    rng = random.Random(14)

    def prose(n):
        return [f"w{rng.randrange(500)}" for _ in range(n)]

    items = [(i, " ".join(prose(rng.randrange(20, 160))) + ".\n" + " ".join(prose(9)) + "?") for i in range(40)]
    items += [(100 + i, items[7][1]) for i in range(20)] + [(None, items[7][1]), (3, items[3][1])]
    docs = []
    for i, (_, text) in enumerate(items[:41]):
        words = text.split(" ")
        for k in range(i % 4):  # words replaced: some leave the overlap above its bound, some do not
            words[rng.randrange(len(words) - 10)] = "changed"
        docs.append((i, " ".join(prose(80) + words + prose(50))))
    docs += [(90, " ".join(prose(900))), (91, " ".join(t for _, t in items[5:30])), (92, None)]

    def runs(words, n):
        return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}

    want = Counter()
    for d, text in docs:
        own = bm25.item_words(text or "")
        for item, t in items:
            halves = [runs(w, min(5, len(w))) for w in map(bm25.item_words, bm25.question_answer(t))]
            share = [len(h & runs(own, len(next(iter(h))))) / len(h) for h in halves]
            if min(share) >= 0.8:
                want[d, item, *(round(x, 9) for x in share)] += 1
    assert any(x < 1 for *_, x, _ in want) and len({i for _, i, *_ in want}) > 30
    monkeypatch.setattr(bm25, "SHARD_CHARS", 4000)
    tests = spark.createDataFrame(items, "item_id long, text string")
    assert len(bm25._shards(bm25._cleaned(tests))) >= 3
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = bm25.contaminated(frame, tests)
    assert Counter((r.doc_id, r.item_id, round(r.question_overlap, 9), round(r.answer_overlap, 9)) for r in got.collect()) == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id for r in bm25.decontaminate(frame, tests).collect()} == {d for d, _ in docs} - {d for d, *_ in want}


def test_quality_with_odd_labels(spark):
    """Null and repeated labels and extra columns that clash with the documents' change no score's range or count."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    odd_labels = labels.unionByName(labels.limit(20)).unionByName(spark.createDataFrame([(None, 1), (0, None), (10**12, 1)], labels.schema))
    odd_labels = odd_labels.withColumns({"text": F.lit("t"), "score": F.lit("s"), "source": F.lit(1), "held_out": F.lit("x")})
    got = gam.score_documents(docs, gam.train(docs, odd_labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    # labels of held-out rows change nothing
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")).cast(labels.schema["quality"].dataType))
    plain = {r.doc_id: r.score for r in gam.score_documents(docs, gam.train(docs, labels)).collect()}
    assert {r.doc_id: r.score for r in gam.score_documents(docs, gam.train(docs, turned)).collect()} == plain


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    """A text alone, first and last of a batch has the same features; word_pairs counts pairs within the text."""
    texts = ["one", "", "one two three four five six seven eight nine ten", "one", None, "a b A b a", "ten one"]
    at = gam.FEATURES.index("word_pairs")
    for order in (texts, texts[::-1]):
        got = gam.text_features(pa.array(order, pa.string()))
        for row, text in zip(got, order):
            assert row.tolist() == gam.text_features(pa.array([text], pa.string()))[0].tolist()
            w = words(text)
            assert row[at] == len(set(zip(w, w[1:]))) / max(1, len(w))


def test_quality_learns_from_every_chosen_document(spark):
    """Repeated rows of one doc_id take no other document's place: the model is that of the rows once."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    first = labels.where(~gam.held_out(F.col("doc_id"))).join(docs, "doc_id").agg(F.min("doc_id")).first()[0]
    copies = docs.where(F.col("doc_id") == first).crossJoin(spark.range(60)).select("doc_id", "text")
    plain, skewed = (gam.train(d, labels, max_rows=40) for d in (docs, docs.unionByName(copies)))
    assert len(plain.tables) == len(gam.FEATURES)
    assert skewed.base == plain.base and all((a == b).all() for a, b in zip(skewed.tables, plain.tables)) and len(skewed.tables) == len(plain.tables)
    twice = gam.train(docs.unionByName(docs), labels, max_rows=40)
    assert twice.base == plain.base and all((a == b).all() for a, b in zip(twice.edges, plain.edges))
    # different texts of one doc_id: the mean of their features
    two = spark.createDataFrame([(first, "one two"), (first, "three FOUR!"), (first, "five")], docs.schema)
    one = spark.createDataFrame([(first, 1)], labels.schema)
    assert gam.train(two, one).base > 0
