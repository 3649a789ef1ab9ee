"""Queries over the whole test tables, one for each operator of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import exact_dedup, merkle, mixing, mpegts, partenum, pii, sentencepiece_lattice, sharding, token_pack, toxicity, tput, url_filter, warc
from spanloom.llm.common import table


#: For the synthetic tables, where the session sets none; no secret, so not for real documents.
TEST_KEY = "a key for synthetic documents"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.join(table(spark, sf_dir, "documents"))


def op3_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.features(mpegts.store(table(spark, sf_dir, "documents")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = pii.configured_key(spark) if spark.conf.get(pii.KEY_SETTING, None) else TEST_KEY
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key).select("doc_id", "text", F.size("pii").cast("long").alias("n_values"), F.array_join("pii.kind", ",").alias("kinds"))


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=24)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), sentencepiece_lattice.Vocabulary.load())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decide(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_tput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tput.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.build(table(spark, sf_dir, "documents")))


def op13_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_pack.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_ngram_jaccard, op3_mpeg_ts, op4_warc, op5_pii, op6_kd_sharding, op7_toxicity, op8_sentencepiece, op9_exact_dedup, op10_mixing, op11_tput, op12_merkle, op13_token_pack)}


_OP1 = """
WITH split AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'allow'), ('org', '/es/', 'block')),
best AS (
  SELECT page_id, host, path, (SELECT max_by(struct_pack(r := h || p, v := v), length(h || p)) FROM rules WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, p)) AS b
  FROM split)
SELECT page_id, host, path, b.r AS rule, coalesce(b.v, 'allow') AS verdict FROM best
"""

_OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM w
"""

_OP9 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


_OP2 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(y) FROM r WHERE r.x = d.doc_id), d.doc_id)) AS component_id FROM documents d LEFT JOIN n USING (doc_id)
"""


_OP11 = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY ALL),
facts AS (SELECT count(*) AS N, CAST(sum(n) AS BIGINT) AS L FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(N) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tfs CROSS JOIN facts SEMI JOIN asked USING (term) GROUP BY term),
impacts AS (SELECT term, doc_id, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * l.n * f.N) // f.L))) AS c FROM tfs JOIN lengths l USING (doc_id) CROSS JOIN facts f SEMI JOIN asked USING (term)),
scores AS (SELECT item_id, doc_id, CAST(sum(qtf * w * c) AS BIGINT) AS score FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

_OP12 = """
WITH RECURSIVE bits AS (SELECT doc_id, source, text, lang, n_chars, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), 4294967295) AS crc FROM documents),
f AS (SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
  text, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM bits),
leaves AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS tampered FROM f),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes(source, level, pos, hash) AS (
  SELECT source, 0, pos, leaf FROM placed
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY source, level) AS n FROM nodes) WHERE n > 1 GROUP BY source, level, pos // 3),
subroots AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, max_by(hash, level) AS subroot, max(level) AS height FROM nodes GROUP BY source),
tops(level, pos, hash) AS (
  SELECT 0, pos, subroot FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY level) AS n FROM tops) WHERE n > 1 GROUP BY level, pos // 3),
root AS (SELECT max_by(hash, level) AS root, max(level) AS height FROM tops),
runs AS (SELECT source, level, pos // 3 AS run, list(hash ORDER BY pos) AS hashes FROM nodes GROUP BY ALL),
top_runs AS (SELECT level, pos // 3 AS run, list(hash ORDER BY pos) AS hashes FROM tops GROUP BY ALL),
walk(doc_id, source, leaf, tampered, pos, level, siblings, node) AS (
  SELECT doc_id, source, leaf, tampered, pos, 0, '', tampered FROM placed
  UNION ALL
  SELECT w.doc_id, w.source, leaf, tampered, w.pos // 3, w.level + 1,
    siblings || array_to_string(hashes[:w.pos % 3] || hashes[w.pos % 3 + 2:], ''), sha256(array_to_string(hashes[:w.pos % 3] || [node] || hashes[w.pos % 3 + 2:], ''))
  FROM walk w JOIN subroots s ON w.source IS NOT DISTINCT FROM s.source JOIN runs r ON w.source IS NOT DISTINCT FROM r.source AND w.level = r.level AND w.pos // 3 = r.run WHERE w.level < s.height),
climb(doc_id, source, leaf, subroot, pos, level, siblings, node) AS (
  SELECT doc_id, w.source, leaf, subroot, s.pos, 0, siblings, node FROM walk w JOIN subroots s ON w.source IS NOT DISTINCT FROM s.source AND w.level = s.height
  UNION ALL
  SELECT doc_id, source, leaf, subroot, c.pos // 3, c.level + 1,
    siblings || array_to_string(hashes[:c.pos % 3] || hashes[c.pos % 3 + 2:], ''), sha256(array_to_string(hashes[:c.pos % 3] || [node] || hashes[c.pos % 3 + 2:], ''))
  FROM climb c CROSS JOIN root JOIN top_runs r ON c.level = r.level AND c.pos // 3 = r.run WHERE c.level < root.height)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, node AS folded_root, node = root AS verified FROM climb CROSS JOIN root WHERE level = root.height
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _OP1, "op2_ngram_jaccard": _OP2, "op4_warc": _OP4, "op9_exact_dedup": _OP9, "op11_tput": _OP11, "op12_merkle": _OP12}
