"""Collocations against a plain version; languages by held-out accuracy and a plain scorer."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from salesmart.llm import collocations, langid
from salesmart.llm.common import table

from .conftest import crc
from .test_texts import low

SF = "/root/testdata/sf0.001"


def plain_phrases(rows, min_count=10, within=50, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low(text)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for size in (1, 2, 3):
                f.update((lang, *w[i : i + size]) for i in range(len(w) - size + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    longest = Counter()
    for p, a in found.items():
        if len(p) == 4:
            for part in ((p[0], *p[1:3]), (p[0], *p[2:])):
                longest[part] = max(longest[part], a)
    out = []
    for p, a in found.items():
        if 100 * longest[p] >= within * a and p in longest:
            continue
        cuts = [(1000000 * a * a // (f[p[:k]] * f[(p[0], *p[k:])]), k, f[p[:k]], f[(p[0], *p[k:])]) for k in range(2, len(p))]
        score, _, left, right = min(cuts)
        out.append((p[0], " ".join(p[1:]), a, left, right, n[p[0]], score))
    ranked, at = [], Counter()
    for r in sorted(out, key=lambda r: (r[0], -r[6], -r[2], r[1].encode())):
        at[r[0]] += 1
        if at[r[0]] <= top:
            ranked.append((r[0], at[r[0]], *r[1:]))
    return ranked


def phrases(docs, **how):
    return sorted(tuple(r) for r in collocations.collocations(docs, **how).collect())


def test_collocations(spark, odd, none):
    rng = random.Random(4)
    words = ["New", "york", "city", "é", "a", "of", "the", "x" * 3000, "pad"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\t ", " ", ". ", "\n", ", "]) for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = [(i % 40, rng.choice(["en", "de", None, "und", ""]), t) for i, t in enumerate(texts)] + [(None, "en", "new york city " * 3000), (7, "en", None), (7, "en", ""), (8, "fr", "..,")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    want = plain_phrases([r[1:] for r in rows])
    assert phrases(docs) == want and phrases(docs, n_slices=1) == want and len(want) > 60
    assert phrases(docs, top=7, min_count=3) == plain_phrases([r[1:] for r in rows], min_count=3, top=7)
    assert phrases(docs, within=100, min_count=3) == plain_phrases([r[1:] for r in rows], within=100, min_count=3)
    assert phrases(odd, min_count=2) == plain_phrases([(r.lang, r.text) for r in odd.collect()], min_count=2)
    assert phrases(none) == []


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 10**14 + 7, 3 * 10**14 + 1, 2 * 10**14 + 3
    row = spark.range(1).selectExpr(f"{a}L AS a", f"{left}L AS l", f"{right}L AS r")
    assert row.select(collocations.score(row.a, row.l, row.r)).first()[0] == 10**6 * a * a // (left * right)


def test_windows_of_slices_make_up_all(spark):
    texts = pa.array(["a b c a b, c. d", "", "a b c a b, c. d e f g", "x"])
    langs = pa.array(["p", "p", "q", "q"])
    def bag(*parts):
        return Counter({tuple(r.values())[:3]: r["n"] for p in parts for r in p.to_pylist()})
    assert bag(*[collocations.window_counts(langs, texts, k, 4) for k in range(4)]) == bag(collocations.window_counts(langs, texts))


def held(d):
    return crc(str(d)) % 4 == 2


def test_languages_held_out(spark):
    docs = table(spark, SF, "documents")
    got = langid.predict(docs, langid.train(docs)).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(lang) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    clear = [r for r in got if r.held_out and re.search(r"[^\W\d_]", text[r.doc_id] or "")]
    assert sum(r.lang_pred == lang[r.doc_id] for r in clear) >= 0.97 * len(clear) > 30


def plain_features(text):
    """Damped n-gram counts, one by one, by the bucket rule of the operator."""
    data = [b if 97 <= b < 123 or b >= 128 else 32 for b in text.lower().encode()]
    out = np.zeros(langid.BUCKETS)
    for n in (1, 2, 3):
        for i in range(len(data) - n + 1):
            g = 0
            for b in data[i : i + n]:
                g = (g * 257 + b + 1) % 2**64
            out[g * 0x9E3779B97F4A7C15 % 2**64 >> 53] += 1
    out = np.log1p(out)
    return out / max(np.sqrt((out**2).sum()), 1e-12)


def test_features_and_votes_are_the_plain_ones():
    texts = ["Der kühle Wind", "", "a", "le vent  frais 12", "wind" * 700, "é"]
    x = langid.features(pa.array([t.lower() for t in texts]))
    assert np.allclose(x, np.stack([plain_features(t) for t in texts]), atol=1e-6)
    rng = np.random.default_rng(5)
    m = langid.fit(x[rng.integers(0, 6, 60)] + rng.random((60, langid.BUCKETS), np.float32) * 0.01, [f"l{k % 5}" for k in range(60)], {"l0": "p", "l1": "p", "l2": "p", "l3": "q", "l4": "q"})
    assert sorted(map(sorted, m.families)) == [[0, 1, 2], [3, 4]]
    lang, score = m.predict(x)
    for row, got, s in zip(x.astype(float), lang, score):
        row = np.append(row, 1)
        family = max(range(2), key=lambda f: row @ m.family_weights[f])
        pairs, weights = m.pairs[family]
        votes = dict.fromkeys(m.families[family], 0.0)
        for (i, j), w in zip(pairs, weights):
            v = row @ w
            votes[i if v > 0 else j] += 1
            for k, sign in ((i, 1), (j, -1)):
                votes[k] += sign * np.clip(v, -1, 1) / (4 * len(votes))
        assert votes[got] >= max(votes.values()) - 1e-9 and 0 <= s <= 1


def test_families_are_learned():
    base = np.eye(3, langid.BUCKETS)
    means = np.stack([base[0] + 0.1 * base[2], base[0], base[1], base[1] + 0.1 * base[2], base[1] - 0.1 * base[2]])
    assert sorted(langid.learned_families(means)) == [[0, 1], [2, 3, 4]]
    assert langid.learned_families(means[:2]) == [[0], [1]]


def test_languages_of_odd_rows(spark, odd, none):
    got = langid.predict(odd, langid.train(odd)).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got} == {"a", "b", "und"}
    texts = Counter(r.text for r in odd.collect())
    assert sum(r.lang_pred == "und" for r in got) == sum(n for t, n in texts.items() if not re.search(r"[^\W\d_]", t or ""))
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert langid.predict(none, langid.train(odd)).count() == 0
    nothing = langid.predict(odd, langid.train(none)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    one = langid.predict(odd, langid.train(odd.where("lang = 'a'")))
    assert {r.lang_pred for r in one.collect()} == {"a", "und"}
