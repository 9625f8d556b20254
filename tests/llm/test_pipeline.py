"""run() against the stages' plain counterparts on a small table."""

import re

import pyarrow as pa

import corpus_pipeline
from salesmart.llm import bm25, gam, minhash
from salesmart.llm.common import stored, table

from .test_tokens import NAMES, crc_ids, whole

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[ \t-\r]+")


def words(text):
    return [w for w in SPACE.split(low(text)) if w]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size=5):
    w = words(text)
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def test_stages_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "pack"]
    docs = table(spark, SF, "documents")
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        was, now = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(now) <= set(was) and out.count() == len(now)
        if name == "quality":
            gone = [labels[d] for d in set(was) - set(now) if d in labels]
            assert gone.count(1) <= len(gone) // 10
        elif name == "line_dedup":
            assert set(now) == set(was) and all(r.n_chars == len(r.text) for r in now.values())
        elif name == "near_dedup":
            groups = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, percent=80).collect()}
            assert set(now) == {d for d, c in groups.items() if c == d}
        else:
            assert set(was) - set(now) == {d for d, r in was.items() if any(" ".join(i.split()) in " ".join(r.text.split()) for i in items)}
        docs = out
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_on_odd_rows(spark, odd, none):
    rows = odd.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars", "key", "hash", "n_lines", "n_dropped")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns
        n = out.count()
        assert 0 < n <= rows.count()
        if name != "quality":  # a document that stays keeps what the user's columns hold
            assert {(r.key, r.hash, r.n_lines, r.n_dropped) for r in out.collect()} == {(1, "h", "mine", "z")}
        assert stage(spark, rows.where("doc_id = -1"), SF).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b) if a else 0.0


def test_near_dedup_takes_pairs_from_80_percent(spark):
    """Of pairs of similarity 0.80 to 0.85 one document goes; of pairs just below, none."""
    rows, sets = {}, {}
    for k, at in enumerate([(50, 58), (50, 60), (40, 55), (30, 50, 70), (20, 40, 60)]):
        base = [f"p{k}w{i}" for i in range(103)]
        near = [f"{w}x" if i in at else w for i, w in enumerate(base)]
        for d, w in ((2 * k, base), (2 * k + 1, near)):
            rows[d], sets[d] = " ".join(w), shingles(" ".join(w))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    like = {d: jaccard(sets[d], sets[d + 1]) for d in range(0, 10, 2)}
    assert sum(0.8 <= x < 0.85 for x in like.values()) == 3 and sum(0.7 < x < 0.8 for x in like.values()) == 2
    assert kept == {*like, *(d + 1 for d, x in like.items() if x < 0.8)}
    assert [minhash.band_rows(p, 1e-6) for p in (85, 80)] == [5, 4]


def plain_lines(texts, min_chars=40, min_docs=5):
    holders = {}
    for d, t in texts.items():
        for line in t.split("\n"):
            if len(k := low(line.strip(" \t\n\x0b\x0c\r"))) >= min_chars:
                holders.setdefault(k, set()).add(d)
    often = {k: max(ds) for k, ds in holders.items() if len(ds) >= min_docs}
    return {d: "\n".join(x for x in t.split("\n") if often.get(low(x.strip(" \t\n\x0b\x0c\r")), d) == d) for d, t in texts.items()}


def plain_near(texts):
    sets, up = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {d: t for d, t in texts.items() if root(d) == d}


def plain_clean(texts, items):
    def runs(w, n):
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    out = {}
    for d, t in texts.items():
        own, found = bm25.item_words(t), False
        for item in items:
            halves = [w for x in bm25.question_answer(item) if (w := bm25.item_words(x))]
            found |= bool(halves) and all(len(r & runs(own, n)) >= 0.8 * len(r) for w in halves for n in [min(5, len(w))] for r in [runs(w, n)])
        if not found:
            out[d] = t
    return out


def test_run_against_plain_versions(spark, monkeypatch):
    """The rows of each stage of run(), texts included, and the pieces against the library's ids."""
    seen = {}
    monkeypatch.setattr(corpus_pipeline, "stored", lambda df, name: seen.setdefault(name, stored(df, name)))
    pieces = corpus_pipeline.run(spark, SF).collect()
    got = {name: {r.doc_id: r.text for r in out.collect()} for name, out in seen.items() if name != "stage-pack"}
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model, texts = gam.train(docs, labels), {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(texts) == docs.count()
    items = [r.text or "" for r in table(spark, SF, "benchmark").collect()]
    steps = {
        "stage-quality": lambda x: {d: t for d, t in x.items() if model.score(gam.text_features(pa.array([t], pa.string())))[0] >= 0.5},
        "stage-line_dedup": plain_lines, "stage-near_dedup": plain_near, "stage-decontaminate": lambda x: plain_clean(x, items),
    }
    for name, step in steps.items():
        was, texts = texts, step(texts)
        assert got[name] == texts, name
        assert texts != was, f"{name} has nothing to do"
    assert {r.doc_id for r in pieces} == set(texts)
    for d, t in texts.items():
        ids, at = [*whole(NAMES[1], t), 0], 0
        for r in sorted((r for r in pieces if r.doc_id == d), key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids) and r.ids_crc32 == crc_ids(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
