"""The Merkle manifest against a plain version."""

import hashlib
import zlib

from pyspark.sql import functions as F

from salesmart.llm import merkle


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes, at):
    """(what remains, siblings of node ``at`` with their side)."""
    path = []
    while len(nodes) > 1:
        other = at ^ 1
        path.append((other & 1, nodes[other]) if other < len(nodes) else None)
        nodes, at = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], at >> 1
    return nodes[0], path


def plain(rows):
    """Rows of the manifest; rows: (doc_id, source, lang, n_chars, text)."""
    leaf = {r: digest(*map(part, r)) for r in rows}
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf[r])):
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots = [climb([leaf[r] for r in groups[g]], 0)[0] for g in langs]
    out = []
    for k, g in enumerate(langs):
        root, top = climb(subroots, k)
        for i, r in enumerate(groups[g]):
            path = climb([leaf[x] for x in groups[g]], i)[1] + top
            now = r
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                now = (*r[:3], r[3] + 1, r[4])
            fold = digest(*map(part, now))
            for step in path:
                fold = digest(fold) if step is None else digest(fold, step[1]) if step[0] else digest(step[1], fold)
            out.append((r[0], leaf[r], subroots[k], root, digest(*[s[1] for s in path if s]), fold, fold == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def manifest(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    return sorted((tuple(r) for r in got.drop("lang", "idx", "siblings").collect()), key=str)


def test_manifest(spark, monkeypatch):
    rows = [(3 * i + 1, None if i % 5 == 0 else "s", ("en", "de", None, "", "é")[i % 5 if i < 40 else 0], None if i % 3 == 0 else i, None if i % 7 == 0 else f"téxt {i}") for i in range(300)]
    rows += [(1, "s", "en", 2, "again"), (1, "s", "en", 2, "again"), (None, "s", "en", 1, "no id"), (None, None, None, None, None), (9, "s", "lone", 1, "x"), (10, "s", "two", 1, "x"), (11, "s", "two", 1, "x")]
    assert manifest(spark, rows) == plain(rows)
    # trees of many blocks, each of four nodes
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    assert manifest(spark, rows[:70]) == plain(rows[:70])


def test_manifest_of_one_group_and_of_lone_leaves(spark):
    for rows in ([(1, "s", "en", 1, "x")], [(i, "s", "en", 1, "x") for i in range(9)], [(i, "s", f"l{i}", i, "x") for i in range(11)]):
        assert manifest(spark, rows) == plain(rows)


def test_manifest_of_odd_rows(spark, odd, none):
    docs = odd.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    want = plain([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()])
    got = merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    assert sorted((tuple(r) for r in got.drop("lang", "idx", "siblings").collect()), key=str) == want
    assert merkle.manifest(docs.where("doc_id = -1")).collect() == []
    # without tampering all hold; siblings are whole digests
    kept = merkle.manifest(docs).collect()
    assert len(kept) == docs.count() and all(r.verified and len(r.siblings) % 32 == 0 for r in kept)
