"""The SQL, for DuckDB, of the queries in spanloom.queries: written from the definitions, not from the plans."""

from __future__ import annotations

import html
import re

from spanloom import queries
from spanloom.operators import golden
from spanloom.plans import fixtures
from spanloom.plans.config import Chunking

_T = r"'[\p{L}\p{N}]+'"
_TILE = r"'[\p{L}\p{N}]+[^\p{L}\p{N}]*'"


def _tok(column: str) -> str:
    return f"regexp_extract_all(lower({column}), {_T})"


def _chunk_ctes(config: Chunking, name: str = "chunks") -> str:
    size, stride = config.chunk_size, config.chunk_size - config.chunk_overlap
    return rf"""
{name}_t AS (SELECT doc_id, regexp_extract_all(text, {_TILE}) AS tiles, length(regexp_extract(text, '^[^\p{{L}}\p{{N}}]*')) AS lead FROM documents),
{name}_w AS (SELECT *, len(tiles) AS n, unnest(generate_series(0, CASE WHEN len(tiles) <= {size} THEN 0 ELSE CAST(ceil((len(tiles) - {size}) / {stride}.0) AS BIGINT) * {stride} END, {stride})) AS token_start FROM {name}_t WHERE len(tiles) > 0),
{name}_c AS (SELECT doc_id, token_start, least(token_start + {size}, n) AS token_end, lead + length(array_to_string(tiles[1:token_start], '')) AS char_start,
  regexp_replace(array_to_string(tiles[token_start + 1:least(token_start + {size}, n)], ''), '[^\p{{L}}\p{{N}}]+$', '') AS text FROM {name}_w),
{name} AS (SELECT doc_id, substr(sha256('{{"chunking":"{config.hash}","doc_id":"' || doc_id || '","token_end":' || token_end || ',"token_start":' || token_start || '}}'), 1, 16) AS chunk_id,
  token_start, token_end, char_start, char_start + length(text) AS char_end, text FROM {name}_c)"""


_CHUNKS = _chunk_ctes(fixtures.CHUNKING)
_GOLD = rf"""
gold AS (SELECT b.item_id, b.text AS passage, d.doc_id, d.text, strpos(d.text, b.text) AS pos FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
queries AS (SELECT DISTINCT 'q-' || lpad(CAST(item_id AS VARCHAR), 4, '0') AS query_id, array_to_string(list_filter({_tok('passage')}, lambda x, i: i % 4 = 1), ' ') AS query,
  (['factual-lookup', 'multi-hop', 'negation-exclusion', 'procedural', 'ambiguous-terminology'])[item_id % 5 + 1] AS category, CASE WHEN item_id % 4 = 0 THEN 'human' ELSE 'llm' END AS origin FROM gold),
labels AS (
  SELECT 'q-' || lpad(CAST(item_id AS VARCHAR), 4, '0') AS query_id, doc_id, pos - 1 AS char_start, pos - 1 + length(passage) AS char_end, 3 AS gain, passage AS quote FROM gold
  UNION ALL
  SELECT 'q-' || lpad(CAST(item_id AS VARCHAR), 4, '0'), doc_id, pos - 1 + length(passage) // 2, pos - 1 + length(passage), CASE WHEN item_id % 2 = 1 THEN 2 ELSE 1 END, substr(passage, length(passage) // 2 + 1) FROM gold)"""
_TERMS = f"terms AS (SELECT DISTINCT query_id, unnest({_tok('query')}) AS term FROM queries)"
_INDEX = f"""
sized AS (SELECT chunk_id, {_tok('text')} AS t FROM chunks),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM sized),
postings AS (SELECT chunk_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM sized) GROUP BY chunk_id, term),
idf AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, stats GROUP BY term)"""


def _bm25(b: float = 0.75, n: int = 10, name: str = "lexical") -> str:
    return f"""
{name}_s AS (SELECT query_id, chunk_id, sum(idf * tf * 2.2 / (tf + 1.2 * (1 - {b} + {b} * dl / avgdl))) AS score FROM terms JOIN postings USING (term) JOIN idf USING (term), stats GROUP BY query_id, chunk_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {name}_s) WHERE rank <= {n})"""


def _hash_ctes(source: str, key: str, column: str, name: str) -> str:
    return f"""
{name}_b AS (SELECT {key}, ('0x' || substr(md5(unnest({_tok(column)})), 1, 8))::UBIGINT % 256 AS bucket FROM {source}),
{name}_n AS (SELECT {key}, bucket, count(*)::DOUBLE AS n FROM {name}_b GROUP BY {key}, bucket),
{name} AS (SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x FROM {name}_n)"""


_HASHED = _hash_ctes("chunks", "chunk_id", "text", "cv") + "," + _hash_ctes("queries", "query_id", "query", "qv")


def _hash_arm(n: int, name: str = "near") -> str:
    """Chunks that share no bucket with a query score 0 and rank after all others."""
    return f"""
{name}_s AS (SELECT q.query_id, c.chunk_id, coalesce(sum(q2.x * v.x), 0) AS score FROM (SELECT DISTINCT query_id FROM qv) q CROSS JOIN (SELECT DISTINCT chunk_id FROM chunks) c LEFT JOIN cv v ON v.chunk_id = c.chunk_id LEFT JOIN qv q2 ON q2.query_id = q.query_id AND q2.bucket = v.bucket GROUP BY q.query_id, c.chunk_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {name}_s) WHERE rank <= {n})"""


_ARMS = ",".join([_CHUNKS, _GOLD, _TERMS, _INDEX, _bm25(n=50), _HASHED, _hash_arm(50)])
_FUSED = """
fused AS (SELECT query_id, chunk_id, coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) AS score, a.score AS dense, b.score AS lexical, a.rank AS dense_rank, b.rank AS lexical_rank FROM near a FULL JOIN lexical b USING (query_id, chunk_id)),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM fused) WHERE rank <= 50)"""
_RESULTS = ",".join([_CHUNKS, _GOLD, _TERMS, _INDEX, _bm25()]) + ", results AS (SELECT l.query_id, l.chunk_id, l.rank, c.doc_id, c.char_start, c.char_end FROM lexical l JOIN chunks c USING (chunk_id))"
_COVERS = """
covers AS (SELECT r.query_id, r.doc_id, l.char_start AS span_start, l.char_end AS span_end, l.gain, r.rank, r.chunk_id FROM results r JOIN labels l ON l.query_id = r.query_id AND l.doc_id = r.doc_id
  WHERE least(r.char_end, l.char_end) - greatest(r.char_start, l.char_start) >= greatest(64.0, 0.5 * (l.char_end - l.char_start)))"""
_METRICS = """
spans AS (SELECT l.query_id, l.doc_id, l.char_start, l.gain, (SELECT min(c.rank) FROM covers c WHERE c.query_id = l.query_id AND c.doc_id = l.doc_id AND c.span_start = l.char_start AND c.span_end = l.char_end AND c.gain = l.gain) AS first_rank,
  row_number() OVER (PARTITION BY l.query_id ORDER BY l.gain DESC) AS ideal FROM labels l),
ks(k) AS (VALUES (1), (3), (5), (10)),
base AS (SELECT query_id, k, sum(CASE WHEN gain >= 2 AND first_rank <= k THEN 1.0 ELSE 0 END) / sum(CASE WHEN gain >= 2 THEN 1 ELSE 0 END) AS recall,
  coalesce(1.0 / min(CASE WHEN gain >= 2 AND first_rank <= k THEN first_rank END), 0) AS mrr, sum(CASE WHEN ideal <= k THEN (2 ** gain - 1) / log2(ideal + 1) ELSE 0 END) AS idcg
  FROM spans, ks GROUP BY query_id, k HAVING sum(CASE WHEN gain >= 2 THEN 1 ELSE 0 END) > 0),
dcg AS (SELECT query_id, k, sum((2 ** g - 1) / log2(first_rank + 1)) AS dcg FROM (SELECT query_id, first_rank, max(gain) AS g FROM spans WHERE first_rank IS NOT NULL GROUP BY query_id, first_rank), ks WHERE first_rank <= k GROUP BY query_id, k),
metrics AS (SELECT q.query_id, q.category, q.origin, b.k, b.recall, b.mrr, CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END AS ndcg FROM base b JOIN queries q USING (query_id) LEFT JOIN dcg USING (query_id, k)),
long AS (UNPIVOT metrics ON recall, mrr, ndcg INTO NAME metric VALUE value)"""
_LOG = "log AS (SELECT event_id AS seq, 'c-' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS subject, CASE event_type " + " ".join(f"WHEN '{e}' THEN '{a}'" for e, a in fixtures.ACTIONS.items()) + " END AS action, value AS seconds FROM events), latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY subject ORDER BY seq DESC) = 1)"
_CANDIDATES = "candidates AS (SELECT 'c-' || lpad(CAST(c_custkey AS VARCHAR), greatest(4, length(CAST(c_custkey AS VARCHAR))), '0') AS subject FROM customer)"
_STRIP = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '(?s)<!--.*?-->', '', 'g'), '(?is)<\s*script\b[^>]*>.*?<\s*/\s*script\s*>', '', 'g'), '(?is)<\s*style\b[^>]*>.*?<\s*/\s*style\s*>', '', 'g'), '(?is)<\s*head\b[^>]*>.*?<\s*/\s*head\s*>', '', 'g'), '(?is)<\s*noscript\b[^>]*>.*?<\s*/\s*noscript\s*>', '', 'g'), '(?i)<\s*/?\s*(?:p|div|br|li|tr|h1|h2|h3|h4|h5|h6|blockquote|pre|hr|section|article|table|ul|ol)\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g')"
_ENTITIES = "replace(replace(replace(replace({c}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
_HTML = r"regexp_matches({c}, '(?i)<\s*(p|div|br|span|body|html)\b')"
_CHOICE = "(VALUES ('factual-lookup'), ('multi-hop'), ('negation-exclusion'), ('procedural'), ('ambiguous-terminology')) AS cats(category)"
_QUOTES = """
halves AS (SELECT doc_id, text, substr(text, length(text) // 2, 40) AS half FROM documents),
quotes AS (SELECT doc_id, text, unnest([0, 1, 2, 3]) AS ord, unnest([substr(text, 1, 10), half, half || '#', repeat(substr(text, 1, 1), 25)]) AS quote FROM halves),
coded AS (SELECT *, strpos(text, quote) AS pos, CASE WHEN length(quote) < 20 THEN 'quote-too-short' WHEN length(quote) > 600 THEN 'quote-too-long' WHEN strpos(text, quote) = 0 THEN 'quote-not-found' WHEN strpos(substr(text, strpos(text, quote) + 1), quote) > 0 THEN 'quote-ambiguous' END AS code FROM quotes)"""
def _apart(sql: str) -> str:
    """The same tables with the labelled set under names that leave queries and labels free."""
    return re.sub(r"\blabels\b", "labels0", re.sub(r"\bqueries\b", "queries0", sql))


_RANKINGS = {"dense": "near", "hybrid": "ranked", "lexical": "lexical"}


def _config_ctes(rankings: dict[str, str] = _RANKINGS, *more: str) -> str:
    """metrics of configurations at once: every id of a query has its configuration before it."""
    union = " UNION ALL ".join(f"SELECT '{c}' AS config, query_id, chunk_id, rank FROM {t}" for c, t in rankings.items())
    own = f"""
configs(config) AS (VALUES {", ".join(f"('{c}')" for c in rankings)}),
queries AS (SELECT config || '/' || query_id AS query_id, category, origin FROM queries0, configs),
labels AS (SELECT config || '/' || query_id AS query_id, doc_id, char_start, char_end, gain FROM labels0, configs),
rankings AS ({union}),
results AS (SELECT config || '/' || r.query_id AS query_id, chunk_id, rank, c.doc_id, c.char_start, c.char_end FROM rankings r JOIN chunks c USING (chunk_id) WHERE rank <= 10)"""
    return ", ".join([_apart(_ARMS), _apart(_FUSED), *map(_apart, more), own, _COVERS, _METRICS, "scores AS (SELECT split_part(query_id, '/', 1) AS config, split_part(query_id, '/', 2) AS query_id, * EXCLUDE (query_id) FROM metrics)"])


_UNPIVOTED = "parts AS (UNPIVOT scores ON recall, mrr, ndcg INTO NAME metric VALUE value)"
_GROUPED = "SELECT config, CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(origin) = 0 THEN 'origin' ELSE 'overall' END AS grp_type, coalesce(category, origin, 'all') AS grp, metric, k, round(avg(value), 6) AS mean, count(*) AS n FROM parts GROUP BY GROUPING SETS ((config, metric, k), (config, category, metric, k), (config, origin, metric, k))"
_COUNTED = "SELECT count(*) AS n_queries, count(*) FILTER (WHERE query_id NOT IN (SELECT query_id FROM labels0 WHERE gain >= 2)) AS n_skipped FROM queries0"
#: Reranked: the whole depth of the fused ranking, by the stand-in for a model.
_SCORED = "again AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, ('0x' || substr(md5(query_id || chunk_id), 1, 8))::UBIGINT / 4294967296.0 AS score FROM ranked))"


def _gate_ctes() -> str:
    """judged: (config, ord, metric, k, base, now, max_drop, d, outcome) of all that the policy asks."""
    flat = re.sub(r"\blexical\b", "flat", re.sub(r"\b(fused|ranked)\b", r"\g<1>0", _FUSED)).replace("AS flat,", "AS lexical,")
    rankings = {"b:dense": "near", "b:hybrid": "ranked", "b:lexical": "lexical", "n:lexical": "flat", "n:hybrid": "ranked0", "n:rerank": "again"}
    policy = ", ".join(f"('{c}', {i}, '{key.rpartition('_at_')[0]}', {key.rpartition('_at_')[2]}, {drop})" for i, c in enumerate(fixtures.GATED.gated_configs) for key, drop in fixtures.GATED.max_absolute_drop.items())
    return ", ".join([
        _config_ctes(rankings, _bm25(b=0.0, n=50, name="flat"), flat, _SCORED), _UNPIVOTED,
        "means AS (SELECT split_part(config, ':', 1) AS side, split_part(config, ':', 2) AS config, metric, k, avg(value) AS mean FROM parts GROUP BY ALL)",
        f"policy(config, ord, metric, k, max_drop) AS (VALUES {policy})",
        "judged AS (SELECT p.config, p.ord, p.metric, p.k, b.mean AS base, n.mean AS now, p.max_drop::DOUBLE AS max_drop, round(b.mean - n.mean, 12) + 0.0 AS d, CASE WHEN b.mean IS NULL OR n.mean IS NULL THEN 'unreported' WHEN b.mean - n.mean > p.max_drop::DOUBLE + 1e-9 THEN 'regression' ELSE 'ok' END AS outcome FROM policy p LEFT JOIN (FROM means WHERE side = 'b') b ON b.config = p.config AND b.metric = p.metric AND b.k = p.k LEFT JOIN (FROM means WHERE side = 'n') n ON n.config = p.config AND n.metric = p.metric AND n.k = p.k)",
    ])


def _digest_ctes(columns: str, source: str, name: str) -> str:
    """name_0, name_1, name_2: nodes of a digest tree of eight bits over source, by level."""
    fields = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns.split())
    up = lambda low, high: f"{name}_{high} AS (SELECT range // 16 AS range, CAST(sum(docs) AS BIGINT) AS docs, sha256(string_agg(range || '*' || digest, ',' ORDER BY range)) AS digest FROM {name}_{low} GROUP BY range // 16)"
    return f"""
{name}_l AS (SELECT CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 2))::UBIGINT AS BIGINT) AS range, CAST(doc_id AS VARCHAR) AS doc_id, sha256({fields}) AS digest, count(*) AS n FROM {source} GROUP BY ALL),
{name}_0 AS (SELECT range, CAST(sum(n) AS BIGINT) AS docs, sha256(string_agg(digest || '*' || n, ',' ORDER BY digest, doc_id)) AS digest FROM {name}_l GROUP BY range), {up(0, 1)}, {up(1, 2)}"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ", ".join(p.strip().rstrip(",") for p in parts) + " " + select


def _chunk_sql(config: Chunking) -> str:
    return _with(_chunk_ctes(config), select="SELECT doc_id, chunk_id, token_start, token_end, char_start, char_end, md5(text) AS text_md5 FROM chunks")


def oracle_sql() -> dict[str, str]:
    gold = (_CHUNKS, _GOLD, _TERMS, _INDEX)
    top = "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM lexical"
    dense = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_inner_product(q.e, c.e) / sqrt(list_inner_product(q.e, q.e)) / sqrt(list_inner_product(c.e, c.e)) AS score FROM v q, v c WHERE q.vec_id % 100 = 0 {also}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s)"
    dense_top = _with(dense.format(also=""), select="SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 50")
    metrics = (_RESULTS, _COVERS, _METRICS)
    return {
        "doc_tokens": f"SELECT doc_id, len({_tok('text')}) AS n_tokens, len(list_distinct({_tok('text')})) AS n_distinct FROM documents",
        "conv_turn_tokens": f"SELECT role, count(*) AS turns, sum(len({_tok('text')}))::BIGINT AS n_tokens FROM conversations GROUP BY role",
        "is_html": f"SELECT page_id, {_HTML.format(c='html')} AS is_html, {_HTML.format(c='url')} AS url_is_html FROM pages",
        # the pages have no character that NFKC changes
        "html_text": f"WITH a AS (SELECT page_id, {_ENTITIES.format(c=_STRIP.format(c='html'))} AS t FROM pages)," + r""" b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '\[\*\d+\]', '', 'g'), '(?m)^[ \t]*\*\d+[ \t]*$', '', 'g'), '[ \t\x0b\f\x{a0}]+', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM b) SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM c""",
        "html_references": "WITH o(odd) AS (SELECT $$" + html.unescape(queries.ODD_REFERENCES).replace("\0", "") + f"$$), b AS (SELECT page_id, odd || {_ENTITIES.format(c='html')} || odd AS t FROM pages, o) SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM b",
        # common runs as islands: places of equal tokens on one diagonal without a gap
        "echo_longest_run": _with(_GOLD, f"e AS (SELECT item_id, doc_id, {_tok('substr(passage, 1, 120)')} AS q, {_tok('passage')} AS p FROM gold)", "qs AS (SELECT item_id, doc_id, unnest(q) AS t, generate_subscripts(q, 1) AS i FROM e)", "ps AS (SELECT item_id, doc_id, unnest(p) AS t, generate_subscripts(p, 1) AS j FROM e)",
            "met AS (SELECT item_id, doc_id, i - j AS d, i - row_number() OVER (PARTITION BY item_id, doc_id, i - j ORDER BY i) AS island FROM qs JOIN ps USING (item_id, doc_id, t))", "runs AS (SELECT item_id, doc_id, max(n) AS run FROM (SELECT item_id, doc_id, count(*) AS n FROM met GROUP BY item_id, doc_id, d, island) GROUP BY ALL)",
            "told AS (SELECT item_id, doc_id, coalesce(run, 0) AS run, CASE WHEN len(q) = 0 THEN 0 ELSE len(list_distinct(list_intersect(q, p))) / len(list_distinct(q)) END AS overlap FROM e LEFT JOIN runs USING (item_id, doc_id))",
            select=f"SELECT item_id, doc_id, run AS longest_run, round(overlap, 6) AS overlap, overlap >= {golden.ECHO_SHARE} OR run >= {golden.ECHO_RUN} AS warned FROM told"),
        "html_blocks": f"WITH b AS (SELECT page_id, {_ENTITIES.format(c=_STRIP.format(c='html'))} AS body FROM pages) SELECT page_id, length(body) AS n_chars, md5(body) AS text_md5 FROM b",
        "normalize_ws": r"""WITH a AS (SELECT doc_id, '  *7' || chr(10) || ' ' || replace(replace(text, '. ', ' [*12] .' || chr(13) || chr(10) || '  ' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10)), ', ', ',' || chr(9) || '  ') || ' ' || chr(10) || chr(10) AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '\[\*[0-9]+\]', '', 'g'), '(?m)^[ \t]*\*[0-9]+[ \t]*$', '', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \t\x0b\f]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM b)
SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM c""",
        "eligible_docs": "SELECT d.doc_id, length(text) AS n_chars FROM documents d LEFT JOIN labels l USING (doc_id) WHERE length(text) BETWEEN 500 AND 5000 AND NOT coalesce(l.toxic = 1, false)",
        "first_n_eligible": "SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(text) BETWEEN 500 AND 5000 ORDER BY doc_id LIMIT 150",
        "extract_body": f"SELECT page_id, coalesce(n_name, '') AS title, md5({_ENTITIES.format(c='CASE WHEN page_id % 2 = 0 THEN ' + chr(39) + 'plain ' + chr(39) + ' || url WHEN ' + _HTML.format(c='html') + ' THEN ' + _STRIP.format(c='html') + ' ELSE html END')}) AS body_md5 FROM pages LEFT JOIN nation ON n_nationkey = page_id",
        "index_build": _with(*gold, select="SELECT 'chunks' AS store, count(*) AS n FROM chunks UNION ALL SELECT 'postings', count(*) FROM postings UNION ALL SELECT 'terms', count(*) FROM idf UNION ALL SELECT 'vectors', count(*) FROM chunks UNION ALL SELECT 'queries', count(*) FROM queries UNION ALL SELECT 'labels', count(*) FROM labels"),
        "chunks_512_50": _chunk_sql(Chunking(chunk_size=512, chunk_overlap=50)),
        "chunks_256_25": _chunk_sql(Chunking(chunk_size=256, chunk_overlap=25)),
        "chunk_counts": _with(_CHUNKS, select="SELECT doc_id, count(*) AS n, sum(char_end - char_start)::BIGINT AS chars FROM chunks GROUP BY doc_id"),
        "chunk_invariant_violations": _with(_CHUNKS, select="SELECT c.doc_id, chunk_id FROM chunks c JOIN documents d USING (doc_id) WHERE char_end <= char_start OR token_end <= token_start OR substr(d.text, char_start + 1, char_end - char_start) <> c.text OR c.doc_id % 10 IN (1, 2, 3)"),
        "snippets": r"WITH f AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM benchmark) SELECT item_id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(substr(t, 1, 80)) || '…' END AS snippet FROM f",
        "corpus_stats": _with(_CHUNKS, _INDEX, select="SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(DISTINCT term) FROM postings) AS n_terms, (SELECT count(*) FROM postings) AS n_postings FROM stats"),
        "term_df_idf": _with(_CHUNKS, _INDEX, select="SELECT term, df, round(idf, 6) AS idf FROM idf"),
        "postings_tf": _with(_CHUNKS, _INDEX, select="SELECT chunk_id, term, tf, dl FROM postings"),
        "query_terms": _with(_GOLD, _TERMS, select="SELECT query_id, term FROM terms"),
        "bm25_top10": _with(*gold, _bm25(), select=top),
        "bm25_b0": _with(*gold, _bm25(b=0.0), select=top),
        "bm25_repeat_term": _with(*gold, _bm25(), select=top),
        "bm25_candidates_only": _with(*gold, _bm25(), select="SELECT query_id, count(*) AS n, round(max(score), 6) AS best FROM lexical_s GROUP BY query_id"),
        "unit_norms": "WITH v AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) SELECT vec_id, round(n, 6) AS norm, 1.0::DOUBLE AS unit_norm FROM v",
        "dense_top50": dense_top,
        "dense_arrow_top50": dense_top,
        "dense_self_excluded": _with(dense.format(also="AND q.vec_id <> c.vec_id"), select="SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"),
        "hash_embed_chunks": _with(_CHUNKS, _hash_ctes("chunks", "chunk_id", "text", "cv"), select="SELECT chunk_id, count(*) AS n_buckets, round(max(x), 6) AS top, round(sum(x), 6) AS total FROM cv GROUP BY chunk_id"),
        "hash_dense_top10": _with(_CHUNKS, _GOLD, _HASHED, _hash_arm(10), select="SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM near"),
        "rrf_full_outer_arms": _with(_ARMS, _FUSED, select="SELECT query_id, chunk_id, dense_rank, lexical_rank, round(dense, 6) AS dense, round(lexical, 6) AS lexical FROM fused"),
        "rrf_fused": _with(_ARMS, _FUSED, select="SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM ranked WHERE rank <= 10"),
        "hybrid_assembled": _with(_ARMS, _FUSED, select="SELECT query_id, chunk_id, rank, round(dense, 6) AS dense, round(lexical, 6) AS lexical, round(score, 9) AS fused, NULL::DOUBLE AS rerank FROM ranked WHERE rank <= 10"),
        "rerank_top_n_in": _with(_ARMS, _FUSED, "p AS (SELECT query_id, chunk_id, ('0x' || substr(md5(query_id || chunk_id), 1, 8))::UBIGINT / 4294967296.0 AS score FROM ranked WHERE rank <= 20), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM p)", select="SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM o WHERE rank <= 10"),
        "rerank_missing_pairs": _with(_ARMS, _FUSED, select="SELECT query_id, chunk_id FROM ranked WHERE substr(md5(query_id || chunk_id), 32, 1) = '0'"),
        "golden_queries": _with(_GOLD, select="SELECT query_id, query, category, origin FROM queries"),
        "golden_labels": _with(_GOLD, select="SELECT query_id, doc_id, char_start, char_end, gain, md5(quote) AS quote_md5 FROM labels"),
        "span_cover": _with(_RESULTS, _COVERS, select="SELECT * FROM covers"),
        "query_metrics": _with(*metrics, select="SELECT query_id, category, origin, k, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM metrics"),
        "config_scores": _with(_config_ctes(), select="SELECT config, query_id, category, origin, k, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM scores"),
        "config_report": _with(_config_ctes(), _UNPIVOTED, select=_GROUPED),
        "query_counts": _with(_GOLD, select="SELECT count(*) AS n_queries, count(*) FILTER (WHERE query_id NOT IN (SELECT query_id FROM labels WHERE gain = 2)) AS n_skipped FROM queries"),
        "wiring_problems": _with(_CHUNKS, "v AS (SELECT chunk_id, right(chunk_id, 1) AS h FROM chunks)", select="SELECT 'unresolved-vector' AS problem, 'no-' || chunk_id AS subject, 1 AS n FROM v WHERE h = '2' UNION ALL SELECT 'missing-vector', chunk_id, 1 FROM v WHERE h IN ('1', '2') UNION ALL SELECT 'duplicate-vector', chunk_id, 2 FROM v WHERE h = '3'"),
        "ranking_duplicates": _with(_ARMS, select="SELECT query_id, chunk_id, 2 AS n FROM near JOIN lexical USING (query_id, chunk_id)"),
        "pairs_inside": _with(_apart(_GOLD), select="SELECT query_id, category FROM queries0 WHERE query_id IN (SELECT query_id FROM labels0 GROUP BY query_id HAVING bool_and(doc_id IN (SELECT doc_id FROM labels)))"),
        "rerank_counts": _with(_ARMS, _FUSED, select="SELECT count(DISTINCT query_id) AS n_queries, count(*) AS pair_count FROM ranked"),
        "skipped_queries": _with(_GOLD, select="SELECT query_id, category FROM queries WHERE query_id NOT IN (SELECT query_id FROM labels WHERE gain = 2)"),
        "macro_grouping_sets": _with(*metrics, select="SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(origin) = 0 THEN 'origin' ELSE 'overall' END AS grp_type, coalesce(category, origin, 'all') AS grp, metric, k, round(avg(value), 6) AS mean, count(*) AS n FROM long GROUP BY GROUPING SETS ((metric, k), (category, metric, k), (origin, metric, k))"),
        "macro_overall": _with(*metrics, select="SELECT metric, k, round(avg(value), 6) AS mean, count(*) AS n FROM long GROUP BY metric, k"),
        "latency_median": "SELECT event_type, round(median(value), 6) AS value, round(median(value * 2), 6) AS value2 FROM events GROUP BY event_type",
        "index_keys": _with(_CHUNKS, _chunk_ctes(Chunking(chunk_size=256, chunk_overlap=25), "wide"), select="SELECT '128' AS windows, count(*) AS n, 3 AS version FROM chunks UNION ALL SELECT '256', count(*), 3 FROM wide"),
        "index_key_search": _with(_CHUNKS, _GOLD, _HASHED, _hash_arm(10), select="SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM near"),
        "index_key_rows": _with(_CHUNKS, select="SELECT doc_id, chunk_id, char_start, char_end, md5(text) AS text_md5 FROM chunks"),
        "retrieve_hybrid": _with(_ARMS, _FUSED, _SCORED, select="SELECT o.query_id, o.chunk_id, o.rank, round(f.dense, 6) AS dense, round(f.lexical, 6) AS lexical, round(f.score, 9) AS fused, round(o.score, 6) AS rerank, c.doc_id, c.char_start, c.char_end, md5(c.text) AS text_md5 FROM again o JOIN fused f USING (query_id, chunk_id) JOIN chunks c USING (chunk_id) WHERE o.rank <= 10"),
        "paged_read": "SELECT page_id, url, length(html) AS n_chars, md5(html) AS html_md5 FROM pages",
        "paged_first_n": "SELECT page_id, length(html) AS n_chars FROM pages WHERE length(html) BETWEEN 1500 AND 40000 ORDER BY page_id LIMIT 60",
        "run_reports": _with(_config_ctes(), _UNPIVOTED, f"means AS ({_GROUPED})", f"counted AS ({_COUNTED})", select="SELECT * FROM means, counted"),
        "run_latency": "SELECT (['dense', 'hybrid', 'lexical'])[user_id % 3 + 1] AS config, round(median(value), 6) AS total_ms FROM events GROUP BY ALL",
        "gate_regressions": _with(_gate_ctes(), select="SELECT config, metric, k, round(base, 6) AS base, round(now, 6) AS now, round(d, 6) AS drop, max_drop, outcome, CASE WHEN outcome = 'unreported' THEN printf('%s %s@%d: not reported', config, metric, k) ELSE printf('%s %s@%d: %.3f -> %.3f (%+.3f, limit -%.3f)', config, metric, k, base, now, round(now - base, 12) + 0.0, max_drop) END AS verdict FROM judged"),
        "gate_identity": "SELECT * FROM (VALUES ('lexical', '', 'config_hash'), ('hybrid', 'corpus_manifest_hash', 'config_hash')) AS t(config, failures, warnings) WHERE (SELECT count(*) FROM documents WHERE text <> upper(text)) > 0",
        "gate_verdicts": _with(_gate_ctes(), select="SELECT min(ord) AS ord, config, CASE WHEN config = 'rerank' THEN 'skipped_no_baseline' WHEN config IN ('dense', 'hybrid') OR bool_or(outcome <> 'ok') THEN 'failed' ELSE 'passed' END AS status, CASE config WHEN 'rerank' THEN 0 WHEN 'dense' THEN 1 WHEN 'hybrid' THEN 1 + count(*) FILTER (outcome <> 'ok') ELSE count(*) FILTER (outcome <> 'ok') END AS n_failures, CASE WHEN config IN ('lexical', 'hybrid') THEN 'config_hash' ELSE '' END AS warnings FROM judged GROUP BY config"),
        "snapshot_digest": _with(_digest_ctes("doc_id lang source text", "documents", "tree"), select="SELECT 0 AS level, * FROM tree_0 UNION ALL SELECT 1, * FROM tree_1 UNION ALL SELECT 2, * FROM tree_2"),
        "snapshot_faults": "SELECT CAST(('0x' || substr(sha256(doc_id), 1, 2))::UBIGINT AS BIGINT) AS range, doc_id, problem FROM (SELECT CAST(CASE doc_id % 97 WHEN 3 THEN doc_id + 1000000000 ELSE doc_id END AS VARCHAR) AS doc_id, (['changed', 'missing', 'repeated', 'added'])[doc_id % 97 + 1] AS problem FROM documents WHERE doc_id % 97 < 4)",
        "review_latest": _with(_LOG, select="SELECT subject, seq, action, round(seconds, 6) AS seconds FROM latest"),
        "review_summary": _with(_LOG, select="SELECT (SELECT count(*) FROM customer) AS generated, (SELECT count(*) FROM log) AS recorded, count(*) AS subjects, count(*) FILTER (action = 'accept') AS accept, count(*) FILTER (action = 'edit') AS edit, count(*) FILTER (action = 'reject') AS reject, count(*) FILTER (action = 'skip') AS skip, (SELECT count(*) FROM log) - count(*) AS superseded FROM latest"),
        "pending": _with(_LOG, "candidates AS (SELECT 'c-' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS subject, c_name AS query FROM customer)", select="SELECT subject, query FROM candidates WHERE subject NOT IN (SELECT subject FROM latest WHERE action IN ('accept', 'edit', 'reject'))"),
        "golden_materialized": _with(_LOG, select="SELECT 'q-' || substr(subject, 3) AS query_id, action, seq FROM latest WHERE action IN ('accept', 'edit')"),
        "next_human_id": "SELECT 'q-h-' || lpad(CAST(max(n_nationkey) + 1 AS VARCHAR), 3, '0') AS query_id FROM nation",
        "edited_fields": _with(_GOLD, select="SELECT query_id AS subject, concat_ws(',', CASE WHEN origin = 'human' AND upper(query) <> query THEN 'query' END, CASE WHEN category = 'procedural' THEN 'category' END) AS fields, CASE WHEN (origin = 'human' AND upper(query) <> query) OR category = 'procedural' THEN 'edit' ELSE 'accept' END AS action FROM queries"),
        "validate_labels": _with(_GOLD, "moved AS (SELECT query_id, CASE WHEN char_start % 5 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, CASE WHEN gain = 1 THEN char_start + 1 ELSE char_start END AS char_start, CASE WHEN gain = 1 THEN char_end + 1 WHEN gain = 2 THEN char_end + 1000000 ELSE char_end END AS char_end, quote FROM labels), c AS (SELECT m.*, CASE WHEN d.text IS NULL THEN 'unknown-document' WHEN char_end > length(d.text) THEN 'span-out-of-range' WHEN substr(d.text, char_start + 1, char_end - char_start) <> quote THEN 'quote-mismatch' END AS code FROM moved m LEFT JOIN documents d USING (doc_id))", select="SELECT query_id, doc_id, char_start, char_end, 'error' AS severity, code FROM c WHERE code IS NOT NULL"),
        "validate_policy": _with(_GOLD, "q AS (SELECT * FROM queries WHERE origin = 'llm')", select=f"SELECT 'warning' AS severity, 'set-incomplete' AS code, 'all' AS subject, count(*) AS n FROM q HAVING count(*) < 100 UNION ALL SELECT 'warning', 'category-under-populated', category, count(query_id) FROM {_CHOICE} LEFT JOIN q USING (category) GROUP BY category HAVING count(query_id) < 12 UNION ALL SELECT 'warning', 'no-human-authored-queries', 'human', 0 FROM q HAVING count(*) > 0"),
        "category_counts_with_zero": _with(_GOLD, "q AS (SELECT * FROM queries WHERE category <> 'procedural')", select=f"SELECT category, count(query_id) AS n FROM {_CHOICE} LEFT JOIN q USING (category) GROUP BY category"),
        "set_problems": _with(_GOLD, select="SELECT 'duplicate-query' AS problem, md5(any_value(query)) AS subject, 2 AS n FROM queries WHERE origin = 'human' GROUP BY query_id UNION ALL SELECT 'duplicate-span', query_id, count(*) * 2 FROM labels WHERE gain = 2 GROUP BY query_id, doc_id, char_start, char_end UNION ALL SELECT 'no-relevant-label', query_id || '-b', 0 FROM queries WHERE origin = 'human'"),
        "passage_samples": "WITH p AS (SELECT doc_id, text, unnest([0, 1]) AS ord FROM documents WHERE length(text) >= 2000), s AS (SELECT *, ('0x' || substr(md5(doc_id || ':' || ord), 1, 8))::UBIGINT % (length(text) - least(1500, length(text)) + 1) AS char_start, least(1500, length(text)) AS w FROM p) SELECT doc_id, ord, char_start, char_start + w AS char_end, md5(substr(text, (char_start + 1)::BIGINT, w)) AS text_md5 FROM s",
        "resolve_quotes": _with(_QUOTES, select="SELECT doc_id, ord, coalesce(code, 'ok') AS code, CASE WHEN code IS NULL THEN pos - 1 END AS quote_start, CASE WHEN code IS NULL THEN pos - 1 + length(quote) END AS quote_end FROM coded"),
        "quote_rejections": _with(_QUOTES, select="SELECT code, count(*) AS n FROM coded WHERE code IS NOT NULL GROUP BY code"),
        "proposals_judged": """WITH p AS (SELECT doc_id, doc_id % 9 AS n, text, substr(text, 1, 30) AS q FROM documents),
c AS (SELECT *, CASE WHEN length(q) < 20 THEN 'quote-too-short' WHEN strpos(text, q) = 0 THEN 'quote-not-found' WHEN strpos(substr(text, 2), q) > 0 THEN 'quote-ambiguous' END AS qc FROM p),
d AS (SELECT *, CASE n WHEN 7 THEN 'request-failed' WHEN 8 THEN 'no-tool-call' WHEN 0 THEN 'declined' WHEN 1 THEN 'no-query' WHEN 2 THEN 'bad-category' WHEN 3 THEN 'no-spans' WHEN 4 THEN 'bad-gain' WHEN 5 THEN coalesce(qc, 'duplicate-span') ELSE qc END AS code FROM c)
SELECT doc_id, code, CASE WHEN code IS NULL THEN printf('c-%04d', doc_id) END AS candidate_id, CASE WHEN code IS NULL THEN 100 + length(q) END AS char_end FROM d""",
        "authored_pairs": """WITH p AS (SELECT doc_id, doc_id % 8 AS n, text, substr(text, 1, 30) AS q FROM documents),
c AS (SELECT *, CASE WHEN length(q) < 20 THEN 'quote-too-short' WHEN strpos(substr(text, 2), q) > 0 THEN 'quote-ambiguous' END AS qc FROM p),
d AS (SELECT *, CASE n WHEN 1 THEN 'no-query' WHEN 2 THEN 'bad-category' WHEN 3 THEN 'no-spans' WHEN 4 THEN 'unknown-document' WHEN 5 THEN 'bad-gain' WHEN 6 THEN coalesce(qc, 'no-relevant-label') WHEN 7 THEN coalesce(qc, 'duplicate-span') ELSE qc END AS problem FROM c)
SELECT CAST(doc_id AS VARCHAR) AS form_id, problem, CASE WHEN problem IS NULL THEN length(q) END AS char_end FROM d""",
        "label_highlights": _with(_GOLD, select="SELECT l.query_id, l.doc_id, md5(substr(d.text, 1, l.char_start) || '{3: ' || substr(d.text, l.char_start + 1, l.char_end - l.char_start) || '}' || substr(d.text, l.char_end + 1)) AS screen_md5 FROM labels l JOIN documents d USING (doc_id) WHERE gain = 3"),
        "echo_overlap": f"WITH b AS (SELECT item_id, list_distinct(list_concat(list_filter({_tok('text')}, lambda x, i: i % 4 = 1), ['zzz', 'yyy'])) AS q, {_tok('text')} AS p FROM benchmark) SELECT item_id, round(len(list_filter(q, lambda x: list_contains(p, x))) / len(q), 6) AS overlap FROM b",
        "dup_query_fold": r"SELECT md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS folded_md5, count(*) AS n FROM (SELECT text FROM conversations UNION ALL SELECT ' ' || chr(9) || replace(text, ' ', '  ') || chr(10) FROM conversations WHERE role = 'user') GROUP BY 1 HAVING count(*) > 1",
        "distinct_texts": "WITH t AS (SELECT text FROM documents UNION SELECT text FROM benchmark UNION SELECT text FROM conversations) SELECT count(*) AS n, sum(length(text))::BIGINT AS chars FROM t",
        "cache_misses": "SELECT DISTINCT md5(text) AS key FROM conversations WHERE md5(text) NOT IN (SELECT md5(text) FROM conversations WHERE role = 'user')",
        "cache_fill_report": "SELECT count(*) AS total, count(DISTINCT text) AS \"unique\", count(DISTINCT CASE WHEN length(text) % 2 = 0 THEN text END) AS reused, count(DISTINCT CASE WHEN length(text) % 2 = 1 THEN text END) AS computed FROM conversations",
        "store_verify": "SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_keys, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim, count(*) = count(DISTINCT vec_id) AND min(len(embedding)) = 64 AND max(len(embedding)) = 64 AS sound FROM embeddings",
    }
