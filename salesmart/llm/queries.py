"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.llm import bm25, collocations, gam, langid, lengths, linededup, merkle, minhash, packing, ppm, repair, streamdedup, urlfilter
from salesmart.llm.common import table

#: (verdict, host, path) of the rules that op7 judges by.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.encode_documents(table(spark, sf_dir, "documents"))


def op2_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return gam.score_documents(docs, gam.train(docs, table(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.limit_table(lengths.length_histogram(table(spark, sf_dir, "documents")))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(table(spark, sf_dir, "documents"))


def op6_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamdedup.dedup(spark, f"{sf_dir}/documents.parquet")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark, table(spark, sf_dir, "pages"), URL_RULES)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "root")


def op9_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup_digest(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered).drop("lang", "idx", "siblings")


QUERIES = (
    op1_repair, op2_gam, op3_packing, op4_lengths, op5_ppm, op6_stream_dedup, op7_url_filter, op8_minhash, op9_bm25, op10_line_dedup,
    op11_collocations, op12_langid, op13_merkle,
)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


OP6 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP7 = """
WITH rules(verdict, rule, host, path) AS (VALUES
  ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
  ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
own AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
fit AS (
  SELECT o.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY o.page_id ORDER BY length(r.rule) DESC) AS nth
  FROM own o JOIN rules r ON (o.host = r.host OR ends_with(o.host, '.' || r.host)) AND starts_with(o.path, r.path))
SELECT o.page_id, o.host, o.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM own o LEFT JOIN fit f ON o.page_id = f.page_id AND f.nth = 1
"""

#: White space at both ends of a line, as DuckDB's trim takes it.
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP10 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT a.doc_id, a.pos, a.line, b.k IS NOT NULL AND a.doc_id <> b.keeper AS gone FROM keyed a LEFT JOIN often b ON a.k = b.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


OP11 = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
f1 AS (SELECT lang, w[i] AS p, count(*) AS f FROM spots GROUP BY ALL),
f2 AS (SELECT lang, w[i] || ' ' || w[i + 1] AS p, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM spots WHERE i < len(w) GROUP BY ALL),
f3 AS (SELECT lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS p, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM spots WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, p, max(f) AS f FROM (SELECT lang, x || ' ' || y AS p, f FROM f3 UNION ALL SELECT lang, y || ' ' || z, f FROM f3) GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.p AS phrase, c.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.p = c.x JOIN f1 r ON r.lang = c.lang AND r.p = c.y LEFT JOIN longer g ON g.lang = c.lang AND g.p = c.p
  WHERE c.f >= 10 AND (g.f IS NULL OR 100 * g.f < 50 * c.f)
  UNION ALL
  SELECT c.lang, c.p, c.f, 1, l.f, r.f FROM f3 c JOIN f1 l ON l.lang = c.lang AND l.p = c.x JOIN f2 r ON r.lang = c.lang AND r.p = c.y || ' ' || c.z
  UNION ALL
  SELECT c.lang, c.p, c.f, 2, l.f, r.f FROM f3 c JOIN f2 l ON l.lang = c.lang AND l.p = c.x || ' ' || c.y JOIN f1 r ON r.lang = c.lang AND r.p = c.z),
scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n::BIGINT AS n, r.score
FROM ranked r JOIN (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang) n ON n.lang = r.lang WHERE r.rank <= 2000
"""


def _counted(column: str) -> str:
    """A column as a Merkle leaf holds it."""
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _level_of(nodes: str) -> str:
    return f"list_transform(range(1, len({nodes}) + 1, 2), lambda i: sha256({nodes}[i] || coalesce({nodes}[i + 1], '')))"


def _crc32(text: str) -> str:
    """Of a text of ASCII characters: each byte is added, then eight bits go, one by one."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::UBIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {steps}), lambda c, x: CASE WHEN x < 256 THEN xor(c, x) ELSE xor(c >> 1, 3988292384::UBIGINT * (c & 1)) END), 4294967295::UBIGINT)"


def _steps(of: str) -> str:
    """The steps of a proof in order: S and the sibling to the left, P and the one to the right, N for none."""
    at = f"((({of}.place - 1) >> level) + 1)"
    return f"list(CASE WHEN {at} % 2 = 0 THEN 'S' || nodes[{at} - 1] WHEN {at} < len(nodes) THEN 'P' || nodes[{at} + 1] ELSE 'N' END ORDER BY level)"


OP13 = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, sha256({" || ".join(_counted(c) for c in merkle.COLUMNS)}) AS leaf,
         CASE WHEN n_chars IS NOT NULL AND {_crc32("doc_id::VARCHAR")} % 7 = 0
              THEN sha256({" || ".join(_counted("(n_chars + 1)" if c == "n_chars" else c) for c in merkle.COLUMNS)}) END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) AS place FROM leaves),
levels AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY place) AS nodes FROM placed GROUP BY lang
  UNION ALL SELECT lang, level + 1, {_level_of("nodes")} FROM levels WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) AS place FROM levels WHERE len(nodes) = 1),
tops AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL SELECT level + 1, {_level_of("nodes")} FROM tops WHERE len(nodes) > 1),
low AS (
  SELECT p.lang, p.place, {_steps("p")} AS steps
  FROM placed p JOIN levels l ON p.lang IS NOT DISTINCT FROM l.lang WHERE len(l.nodes) > 1 GROUP BY p.lang, p.place),
high AS (SELECT s.place, {_steps("s")} AS steps FROM subroots s JOIN tops t ON len(t.nodes) > 1 GROUP BY s.place),
proofs AS (
  SELECT p.*, s.subroot, (SELECT nodes[1] FROM tops WHERE len(nodes) = 1) AS root,
         list_concat(coalesce(low.steps, []::VARCHAR[]), coalesce(high.steps, []::VARCHAR[])) AS steps
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN low ON p.lang IS NOT DISTINCT FROM low.lang AND p.place = low.place LEFT JOIN high ON s.place = high.place),
folds AS (
  SELECT *, list_reduce(list_prepend(coalesce(changed, leaf), steps), lambda acc, x:
    sha256(CASE x[1] WHEN 'S' THEN substr(x, 2) || acc WHEN 'P' THEN acc || substr(x, 2) ELSE acc END)) AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: substr(x, 2)), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified FROM folds
"""


def oracle() -> dict[str, str]:
    return {"op6_stream_dedup": OP6, "op7_url_filter": OP7, "op10_line_dedup": OP10, "op11_collocations": OP11, "op13_merkle": OP13}
