"""The engine's operators as queries over the bundled tables; spanloom.oracle has the SQL of each."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.identity import content_hash
from spanloom.operators import aggregate, authoring, caches, chunking, corpus, dense, evaluate, fusion, gate, golden, lexical, relevance, retrieve
from spanloom.operators.ranking import duplicates, top_n
from spanloom.plans import fixtures, prepared
from spanloom.plans.config import Chunking
from spanloom.plans.fixtures import table
from spanloom.sources import digests, paged, stores, versioned
from spanloom.sources.scratch import materialise, scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}
ARM_N, TOP_K = 50, 10


def query(f: Query) -> Query:
    _REGISTRY[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _r(c: str, places: int = 6):
    return F.round(c, places).alias(c)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


_chunks, _golden = prepared.chunks, prepared.golden


# ---------------------------------------------------------------- corpus


@query
def doc_tokens(spark, d):
    t = T.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query
def conv_turn_tokens(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.size(T.tokens(F.col("text")))).alias("n_tokens"))


@query
def is_html(spark, d):
    return table(spark, d, "pages").select("page_id", T.looks_like_html(F.col("html")).alias("is_html"), T.looks_like_html(F.col("url")).alias("url_is_html"))


@query
def html_blocks(spark, d):
    """Pages as text, with references decoded by built-in functions."""
    body = T.html_to_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(body).cast("long").alias("n_chars"), F.md5(body).alias("text_md5"))


@query
def html_text(spark, d):
    """Pages as text, with all references decoded, spacing normalised."""
    plain = materialise(table(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("plain")), "html-plain")
    return plain.select("page_id", T.normalise(F.col("plain")).alias("text")).select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


#: References of every kind.
ODD_REFERENCES = " &lt;b&gt; &amp;amp; &notit; &not &hellip;&eacute;&NotEqualTilde; &#233; &#xE9; &#128; &#0; &#55296; &#x110000; &#1; &nosuch; & &; &#; &copy2 "


@query
def html_references(spark, d):
    """Pages with references of every kind put into them, decoded: names, numbers, without semicolon, unknown, beyond."""
    rows = table(spark, d, "pages").select("page_id", T.decode_references(F.concat(F.lit(ODD_REFERENCES), F.col("html"), F.lit(ODD_REFERENCES))).alias("text"))
    return rows.select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@query
def normalize_ws(spark, d):
    """Spacing of texts with line ends, page marks and blanks put into them."""
    dirty = F.replace(F.replace("text", F.lit(". "), F.lit(" [*12] .\r\n  \r\n\r\n\r\n")), F.lit(", "), F.lit(",\t  "))
    clean = T.normalise_spacing(F.concat(F.lit("  *7\n "), dirty, F.lit(" \n\n")))
    return _docs(spark, d).select("doc_id", F.length(clean).cast("long").alias("n_chars"), F.md5(clean).alias("text_md5"))


@query
def eligible_docs(spark, d):
    labels = table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("ocr"))
    return corpus.eligible(_docs(spark, d).join(labels, "doc_id", "left"), corpus.Selection(min_chars=500, max_chars=5000), ocr="ocr").select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query
def first_n_eligible(spark, d):
    rows = corpus.eligible(_docs(spark, d), corpus.Selection(min_chars=500, max_chars=5000))
    return corpus.first_n(rows, 150).select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query
def extract_body(spark, d):
    """Bodies where half of the records have plain text and the rest HTML, left-joined with metadata that some lack."""
    pages = table(spark, d, "pages").select("page_id", "html", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("plain "), F.col("url"))).otherwise(F.lit("  ")).alias("plain"))
    meta = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), F.col("n_name").alias("title"))
    body = corpus.extract_body(F.col("plain"), F.col("html"), normalised=False)
    return pages.join(meta, "page_id", "left").select("page_id", F.coalesce("title", F.lit("")).alias("title"), F.md5(body).alias("body_md5"))


# ---------------------------------------------------------------- a paged service


def _busy(call: int, params: dict) -> tuple | None:
    """A service that is busy at every third request."""
    return (429, {"Retry-After": "0"}, "") if call % 3 == 1 else None


def _service(spark, d):
    pages = table(spark, d, "pages")
    schema = "page_id long, url string, html string"
    folder = prepared.once(spark, d, "service", ("pages",), lambda: paged.store_pages(pages.select("page_id", "url", "html"), "page_id", 100))
    ends = pages.agg(F.coalesce(F.min("page_id"), F.lit(0)).alias("low"), F.coalesce(F.max("page_id") + 1, F.lit(0)).alias("high")).first()
    return paged.Service(paged.FileTransport(folder, "page_id", 100, _busy), schema, "page_id", ("url",), 100), ends["low"], ends["high"]


@query
def paged_read(spark, d):
    """All records of a service that is often busy, in two reads: the service filters one of them, Spark the other."""
    service, low, high = _service(spark, d)
    secure = F.col("url").startswith("https://")
    rows = paged.read(spark, service, low, high, 16).where(secure).unionByName(paged.read(spark, service, low, high, 16).where(F.col("url").isNull() | ~secure))
    return rows.select("page_id", "url", F.length("html").cast("long").alias("n_chars"), F.md5("html").alias("html_md5"))


@query
def paged_first_n(spark, d):
    """The first 60 pages, by id, with a body of a certain length; later windows of ids are not asked for."""
    service, low, high = _service(spark, d)
    keep = lambda rows: rows.where(F.length("html").between(1500, 40_000))
    return paged.first_n(spark, service, keep, 60, low, high).select("page_id", F.length("html").cast("long").alias("n_chars"))


# ---------------------------------------------------------------- chunks


@query
def index_build(spark, d):
    """Rows of each store that retrieval reads; making them is the cost of an index."""
    c = prepared.corpus(spark, d)
    stores = {"chunks": c.chunks, "postings": c.bm25.postings, "terms": c.bm25.terms, "vectors": c.vectors, "queries": c.queries, "labels": c.labels}
    counts = [f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("store"), "n") for name, f in stores.items()]
    return reduce(DataFrame.unionByName, counts)


def _chunk_rows(spark, d, config):
    return chunking.chunks(_docs(spark, d), config).select("doc_id", "chunk_id", "token_start", "token_end", "char_start", "char_end", F.md5("text").alias("text_md5"))


@query
def chunks_512_50(spark, d):
    return _chunk_rows(spark, d, Chunking(chunk_size=512, chunk_overlap=50))


@query
def chunks_256_25(spark, d):
    return _chunk_rows(spark, d, Chunking(chunk_size=256, chunk_overlap=25))


@query
def chunk_counts(spark, d):
    return _chunks(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("char_end") - F.col("char_start")).cast("long").alias("chars"))


@query
def chunk_invariant_violations(spark, d):
    """The chunks with faults put into them: ends moved, texts changed, spans emptied."""
    n, c = F.col("doc_id") % 10, _chunks(spark, d)
    moved = c.withColumn("char_end", F.col("char_end") + F.when(n == 1, 1).otherwise(0)).withColumn("text", F.when(n == 2, F.concat(F.lit("#"), F.expr("substring(text, 2)"))).otherwise(F.col("text"))).withColumn("token_end", F.when(n == 3, F.col("token_start")).otherwise(F.col("token_end")))
    return chunking.violations(moved, _docs(spark, d)).select("doc_id", "chunk_id")


@query
def snippets(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.snippet(F.col("text"), 80).alias("snippet"))


# ---------------------------------------------------------------- lexical


@query
def corpus_stats(spark, d):
    i = prepared.bm25(spark, d)
    p = i.postings.agg(F.count(F.lit(1)).alias("n_postings"), F.count_distinct("term").alias("n_terms"))
    return i.stats.crossJoin(p).select("n", _r("avgdl"), "n_terms", "n_postings")


@query
def term_df_idf(spark, d):
    return prepared.bm25(spark, d).terms.select("term", "df", _r("idf"))


@query
def postings_tf(spark, d):
    return prepared.bm25(spark, d).postings.select("chunk_id", "term", "tf", F.col("dl").cast("long").alias("dl"))


def _terms(spark, d):
    return lexical.query_terms(_golden(spark, d)[0])


@query
def query_terms(spark, d):
    return _terms(spark, d)


@query
def bm25_top10(spark, d):
    return lexical.search_stored(prepared.bm25(spark, d), _terms(spark, d), TOP_K).select("query_id", "chunk_id", _r("score"), "rank")


@query
def bm25_b0(spark, d):
    return lexical.search_stored(prepared.bm25(spark, d), _terms(spark, d), TOP_K, b=0.0).select("query_id", "chunk_id", _r("score"), "rank")


@query
def bm25_repeat_term(spark, d):
    """Queries with every term twice rank as the plain ones do."""
    doubled = _golden(spark, d)[0].select("query_id", F.concat_ws(" ", "query", "query").alias("query"))
    return lexical.search_stored(prepared.bm25(spark, d), lexical.query_terms(doubled), TOP_K).select("query_id", "chunk_id", _r("score"), "rank")


@query
def bm25_candidates_only(spark, d):
    return lexical.score_stored(prepared.bm25(spark, d), _terms(spark, d)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("best"))


# ---------------------------------------------------------------- dense


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def _vector_queries(spark, d):
    return _vectors(spark, d).where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")


@query
def unit_norms(spark, d):
    return _vectors(spark, d).select(F.col("chunk_id").alias("vec_id"), F.round(dense.norm(F.col("vector")), 6).alias("norm"), F.round(dense.norm(dense.unit(F.col("vector"))), 6).alias("unit_norm"))


@query
def dense_top50(spark, d):
    return dense.search(_vector_queries(spark, d), _vectors(spark, d), 50).select("query_id", "chunk_id", _r("score"), "rank")


@query
def dense_self_excluded(spark, d):
    return dense.search(_vector_queries(spark, d), _vectors(spark, d), 10, skip_same=True).select("query_id", "chunk_id", _r("score"), "rank")


@query
def dense_arrow_top50(spark, d):
    return dense.search_arrow(_vector_queries(spark, d), _vectors(spark, d), 50).select("query_id", "chunk_id", _r("score"), "rank")


@query
def hash_embed_chunks(spark, d):
    v = F.col("vector")
    return prepared.vectors(spark, d).select("chunk_id", dense.unit(v).alias("vector")).select("chunk_id", F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("n_buckets"), F.round(F.array_max(v), 6).alias("top"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def _hash_arm(spark, d, n):
    q = dense.hash_embed(_golden(spark, d)[0], "query_id", "query")
    return dense.search_arrow(q, prepared.vectors(spark, d), n)


@query
def hash_dense_top10(spark, d):
    return _hash_arm(spark, d, TOP_K).select("query_id", "chunk_id", _r("score"), "rank")


# ---------------------------------------------------------------- fusion, rerank, assembly


def _arms(spark, d):
    """Both arms, written once, as fusion, rerank and assembly read them more than once."""
    return materialise(_hash_arm(spark, d, ARM_N), "arm-dense"), materialise(lexical.search_stored(prepared.bm25(spark, d), _terms(spark, d), ARM_N), "arm-lexical")


@query
def rrf_full_outer_arms(spark, d):
    return fusion.full_outer_arms(*_arms(spark, d)).select("query_id", "chunk_id", "dense_rank", "lexical_rank", _r("dense"), _r("lexical"))


@query
def rrf_fused(spark, d):
    return top_n(fusion.reciprocal_rank(list(_arms(spark, d))), TOP_K).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


def _rerank_scores(ranked):
    return ranked.select("query_id", "chunk_id", fixtures.pair_score(F.col("query_id"), F.col("chunk_id")).alias("score"))


def _hybrid(spark, d):
    near, words = _arms(spark, d)
    fused = materialise(fusion.reciprocal_rank([near, words]), "fused")
    return near, words, fused, top_n(fused, ARM_N)


@query
def hybrid_assembled(spark, d):
    near, words, fused, ranked = _hybrid(spark, d)
    return fusion.assemble(ranked.where(F.col("rank") <= TOP_K), near, words, fused).select("query_id", "chunk_id", "rank", _r("dense"), _r("lexical"), F.round("fused", 9).alias("fused"), "rerank")


@query
def rerank_top_n_in(spark, d):
    *_, ranked = _hybrid(spark, d)
    return fusion.rerank(ranked, _rerank_scores(ranked), 20, TOP_K).select("query_id", "chunk_id", _r("score"), "rank")


@query
def rerank_missing_pairs(spark, d):
    *_, ranked = _hybrid(spark, d)
    store = _rerank_scores(ranked).where(F.substring(F.md5(F.concat("query_id", "chunk_id")), 32, 1) != "0")
    return fusion.missing_pairs(ranked, store)


# ---------------------------------------------------------------- relevance and metrics


def _results(spark, d):
    found = materialise(lexical.search_stored(prepared.bm25(spark, d), _terms(spark, d), TOP_K), "found")
    return materialise(prepared.chunks(spark, d).select("chunk_id", "doc_id", "char_start", "char_end").join(found, "chunk_id"), "results")


@query
def golden_queries(spark, d):
    return _golden(spark, d)[0]


@query
def golden_labels(spark, d):
    return _golden(spark, d)[1].select("query_id", "doc_id", "char_start", "char_end", "gain", F.md5("quote").alias("quote_md5"))


@query
def span_cover(spark, d):
    return relevance.covers(_results(spark, d), _golden(spark, d)[1])


def _scores(spark, d):
    q, labels = _golden(spark, d)
    return relevance.query_scores(_results(spark, d), labels, q)


@query
def query_metrics(spark, d):
    return _scores(spark, d).select("query_id", "category", "origin", "k", _r("recall"), _r("mrr"), _r("ndcg"))


@query
def skipped_queries(spark, d):
    """Queries of a set in which only the half-passage labels are left: even items have none that is relevant."""
    q, labels = _golden(spark, d)
    return relevance.skipped(labels.where("gain < 3"), q).select("query_id", "category")


@query
def macro_grouping_sets(spark, d):
    return aggregate.macro(relevance.long_form(_scores(spark, d))).select("grp_type", "grp", "metric", "k", _r("mean"), "n")


@query
def macro_overall(spark, d):
    return aggregate.macro(relevance.long_form(_scores(spark, d))).where("grp_type = 'overall'").select("metric", "k", _r("mean"), "n")


@query
def bootstrap_ci(spark, d):
    return aggregate.bootstrap(relevance.long_form(_scores(spark, d))).select("metric", "k", _r("mean"), _r("ci_low"), _r("ci_high"), "n")


@query
def latency_median(spark, d):
    return aggregate.latency_medians(table(spark, d, "events").withColumn("value2", F.col("value") * 2), ("event_type",), ("value", "value2")).select("event_type", _r("value"), _r("value2"))


_CONFIGS = ["dense", "hybrid", "lexical"]


def _config_scores(spark, d):
    """Three configurations over one index, each with its own ranking."""
    near, words, _, ranked = _hybrid(spark, d)
    arms = {"dense": near, "lexical": words, "hybrid": ranked}
    ranking = reduce(DataFrame.unionByName, [a.where(F.col("rank") <= TOP_K).select(F.lit(c).alias("config"), "query_id", "chunk_id", "rank") for c, a in arms.items()])
    located = ranking.join(_chunks(spark, d).select("chunk_id", "doc_id", "char_start", "char_end"), "chunk_id")
    q, labels = _golden(spark, d)
    return evaluate.config_scores(located, labels, q, _CONFIGS)


@query
def config_scores(spark, d):
    return _config_scores(spark, d).select("config", "query_id", "category", "origin", "k", _r("recall"), _r("mrr"), _r("ndcg"))


@query
def config_report(spark, d):
    return evaluate.report(_config_scores(spark, d)).select("config", "grp_type", "grp", "metric", "k", _r("mean"), "n")


@query
def query_counts(spark, d):
    """Queries and skipped ones of the set without its full passages."""
    q, labels = _golden(spark, d)
    return evaluate.query_counts(labels.where("gain < 3"), q)


@query
def wiring_problems(spark, d):
    """An index with vectors that are lost, twice there or of no chunk, over the true chunks."""
    v = prepared.vectors(spark, d).withColumn("n", F.conv(F.substring("chunk_id", 16, 1), 16, 10).cast("int"))
    wrong = v.where("n <> 1").withColumn("chunk_id", F.when(F.col("n") == 2, F.concat(F.lit("no-"), F.col("chunk_id"))).otherwise(F.col("chunk_id"))).unionByName(v.where("n = 3")).drop("n")
    return retrieve.wiring_problems(_chunks(spark, d), vectors=wrong, dimension=256)


def _stored_index(spark, d):
    """(path, configuration): an index of two keys, the first of which was loaded with other chunks and then replaced."""
    config, other = fixtures.configuration("dense"), fixtures.configuration("dense", chunking=Chunking(chunk_size=256, chunk_overlap=25))

    def make():
        path = scratch_dir(spark, "keyed")
        wide = materialise(dense.with_hash_counts(chunking.chunks(_docs(spark, d), other.chunking)), "chunks-wide")
        retrieve.store(other, wide, None, path)
        versioned.load(wide.select("chunk_id", "doc_id", "char_start", "char_end", "text", "vector").withColumn("index_key", F.lit(retrieve.index_key(config))), path)
        retrieve.store(config, materialise(dense.with_hash_counts(_chunks(spark, d)), "chunks-vectors"), None, path)
        return path

    return prepared.once(spark, d, "keyed-index", ("documents",), make), config, other


@query
def index_keys(spark, d):
    path, config, other = _stored_index(spark, d)
    names = F.create_map(F.lit(retrieve.index_key(config)), F.lit("128"), F.lit(retrieve.index_key(other)), F.lit("256"))
    return versioned.loaded_keys(spark, path).select(names[F.col("index_key")].alias("windows"), "n", "version")


@query
def index_key_search(spark, d):
    path, config, _ = _stored_index(spark, d)
    q = dense.hash_embed(_golden(spark, d)[0], "query_id", "query")
    return retrieve.search_by_key(path, retrieve.index_key(config), q, TOP_K).select("query_id", "chunk_id", _r("score"), "rank")


@query
def index_key_rows(spark, d):
    """What is stored for the key that was replaced."""
    path, config, _ = _stored_index(spark, d)
    return versioned.read(spark, path, retrieve.index_key(config)).select("doc_id", "chunk_id", "char_start", "char_end", F.md5("text").alias("text_md5"))


@query
def retrieve_hybrid(spark, d):
    """A hybrid configuration from the stored index: both arms, fusion, rerank, truncation, assembly, the chunks' places."""
    path, *_ = _stored_index(spark, d)
    q, _ = _golden(spark, d)
    *_, ranked = _hybrid(spark, d)
    config = fixtures.configuration("hybrid", reranked=True)
    found = retrieve.retrieve_stored(config, q.select("query_id", "query"), dense.hash_embed(q, "query_id", "query"), path, _rerank_scores(ranked), index=prepared.bm25(spark, d))
    return found.select("query_id", "chunk_id", "rank", _r("dense"), _r("lexical"), F.round("fused", 9).alias("fused"), _r("rerank"), "doc_id", "char_start", "char_end", F.md5("text").alias("text_md5"))


@query
def ranking_duplicates(spark, d):
    """Chunks that two arms name, were they taken for one ranking."""
    near, words = _arms(spark, d)
    return duplicates(near.select("query_id", "chunk_id").unionByName(words.select("query_id", "chunk_id"))).withColumnRenamed("count", "n")


@query
def pairs_inside(spark, d):
    """Queries whose labels all lie in documents that the table of labels covers."""
    q, labels = _golden(spark, d)
    return golden.pairs_inside(q, labels, table(spark, d, "labels")).select("query_id", "category")


# ---------------------------------------------------------------- runs, snapshots and the gate


def _tree(rows, columns, bits=8, id_col="doc_id"):
    return digests.tree(rows, columns, bits, id_col)


@query
def snapshot_digest(spark, d):
    """Every node of the digest tree over the documents."""
    return _tree(table(spark, d, "documents"), ["doc_id", "lang", "source", "text"]).nodes


@query
def snapshot_faults(spark, d):
    """Documents that a later copy of the corpus has changed, lost, repeated or added, found from the root down."""
    docs, n = table(spark, d, "documents").select("doc_id", "lang", "source", "text"), F.col("doc_id") % 97
    changed = docs.where(n != 1).withColumn("text", F.when(n == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    now = changed.unionByName(docs.where(n == 2)).unionByName(docs.where(n == 3).withColumn("doc_id", F.col("doc_id") + 1_000_000_000))
    columns = ["doc_id", "lang", "source", "text"]
    return digests.faults(_tree(docs, columns), _tree(now, columns))


def _labelled_hash(spark, d) -> str:
    q, labels = _golden(spark, d)
    rows = q.select("query_id", F.concat_ws("/", "query", "category", "origin").alias("fact")).unionByName(labels.select("query_id", F.concat_ws("/", "doc_id", "char_start", "char_end", "gain", "quote").alias("fact")))
    return _tree(rows, ["query_id", "fact"], id_col="query_id").root


def _reports(spark, d, rankings: dict, hashes: dict[str, str], corpus_hash: dict[str, str]):
    """Reports of rankings by configuration, written as run files and read back."""
    located = reduce(DataFrame.unionByName, [a.where(F.col("rank") <= TOP_K).select(F.lit(c).alias("config"), "query_id", "chunk_id", "rank") for c, a in rankings.items()])
    located = located.join(_chunks(spark, d).select("chunk_id", "doc_id", "char_start", "char_end"), "chunk_id")
    q, labels = _golden(spark, d)
    scores = materialise(evaluate.config_scores(located, labels, q, sorted(rankings)), "run-scores")
    golden_hash = _labelled_hash(spark, d)
    identity = spark.createDataFrame([(c, hashes[c], golden_hash, corpus_hash[c], "1") for c in rankings], "config string, config_hash string, golden_set_hash string, corpus_manifest_hash string, code_version string")
    latency = aggregate.latency_medians(table(spark, d, "events").select(F.element_at(F.array(*map(F.lit, sorted(rankings))), (F.col("user_id") % len(rankings) + 1).cast("int")).alias("config"), F.col("value").alias("total_ms")), ("config",), ("total_ms",))
    path = scratch_dir(spark, "runs")
    stores.write_runs(evaluate.reports(scores, identity, evaluate.query_counts(labels, q), latency), path)
    return path


def _sides(spark, d):
    """(baseline, current run), each from its files.

    Blessed are hash vectors, BM25 and their fusion.  Run now: BM25 without regard to length, its fusion over a corpus that is
    another by its digest, and a reranked run; the hash vectors were not run.
    """

    def make():
        docs = table(spark, d, "documents")
        same, other = _tree(docs, ["doc_id", "text"]).root, _tree(docs.withColumn("text", F.upper("text")), ["doc_id", "text"]).root
        near, words, _, fused = _hybrid(spark, d)
        one = lambda name, *more: content_hash([name, fixtures.configuration(name, *more).config_hash])
        first = _reports(spark, d, {"dense": near, "lexical": words, "hybrid": fused}, {c: one(c) for c in ("dense", "lexical", "hybrid")}, dict.fromkeys(("dense", "lexical", "hybrid"), same))
        blessed = scratch_dir(spark, "baseline")
        stores.bless(stores.read_runs(spark, first), blessed, "first run", "2024-01-01T00:00:00Z")
        flat = materialise(lexical.search_stored(prepared.bm25(spark, d), _terms(spark, d), ARM_N, b=0.0), "arm-flat")
        refused = materialise(top_n(fusion.reciprocal_rank([near, flat]), ARM_N), "fused-flat")
        again = fusion.rerank(fused, _rerank_scores(fused), 50, TOP_K)
        now = {"lexical": flat, "hybrid": refused, "rerank": again}
        hashes = {"lexical": one("lexical", 0.0), "hybrid": one("hybrid", 0.0), "rerank": one("rerank", 0.75, True)}
        second = _reports(spark, d, now, hashes, {"lexical": same, "hybrid": other, "rerank": same})
        return blessed, second

    blessed, second = prepared.once(spark, d, "gate-sides", ("documents", "benchmark", "events"), make)
    return stores.read_baseline(spark, blessed), stores.read_runs(spark, second)


@query
def run_reports(spark, d):
    """Means of all groups of the blessed runs, from their files."""
    base, _ = _sides(spark, d)
    flat = lambda column: F.explode(column).alias("metric", "ks")
    overall = base.select("config_name", F.lit("overall").alias("grp_type"), F.lit("all").alias("grp"), "n_queries", "n_skipped", flat("overall"))
    groups = [base.select("config_name", F.lit(t).alias("grp_type"), "n_queries", "n_skipped", F.explode(c).alias("grp", "t")).select("config_name", "grp_type", "grp", "n_queries", "n_skipped", flat("t")) for t, c in (("category", "by_category"), ("origin", "by_origin"))]
    rows = reduce(DataFrame.unionByName, [overall, *groups]).select("*", F.explode("ks").alias("k", "s"))
    return rows.select(F.col("config_name").alias("config"), "grp_type", "grp", "metric", F.col("k").cast("int").alias("k"), F.round("s.mean", 6).alias("mean"), F.col("s.n").alias("n"), "n_queries", "n_skipped")


@query
def run_latency(spark, d):
    base, _ = _sides(spark, d)
    return base.select(F.col("config_name").alias("config"), F.round(F.col("latency")["total_ms"], 6).alias("total_ms"))


@query
def gate_regressions(spark, d):
    base, now = _sides(spark, d)
    rows = gate.regressions(gate.policy_rows(now, fixtures.GATED), stores.run_metrics(base), stores.run_metrics(now))
    return gate.verdict_text(rows).select("config", "metric", "k", _r("base"), _r("now"), _r("drop"), "max_drop", "outcome", "verdict")


@query
def gate_identity(spark, d):
    base, now = _sides(spark, d)
    return gate.identity_failures(fixtures.GATED, stores.run_identity(base), stores.run_identity(now)).select("config", F.array_join("failures", ",").alias("failures"), F.array_join("warnings", ",").alias("warnings"))


@query
def gate_verdicts(spark, d):
    base, now = _sides(spark, d)
    return gate.evaluate(fixtures.GATED, stores.run_metrics(base), stores.run_metrics(now), stores.run_identity(base), stores.run_identity(now))


# ---------------------------------------------------------------- review log and golden set


def _log(spark, d):
    return fixtures.review_log(table(spark, d, "events"))


def _candidates(spark, d):
    return table(spark, d, "customer").select(F.concat(F.lit("c-"), F.lpad(F.col("c_custkey").cast("string"), 4, "0")).alias("subject"), F.col("c_name").alias("query"))


@query
def review_latest(spark, d):
    return golden.latest(_log(spark, d)).select("subject", "seq", "action", _r("seconds"))


@query
def review_summary(spark, d):
    return golden.review_summary(_log(spark, d), _candidates(spark, d))


@query
def pending(spark, d):
    return golden.pending(_candidates(spark, d), _log(spark, d))


@query
def golden_materialized(spark, d):
    return golden.materialise_set(_log(spark, d)).select(golden.query_id_of(F.col("subject")).alias("query_id"), "action", "seq")


@query
def next_human_id(spark, d):
    ids = table(spark, d, "nation").select(F.concat(F.lit("q-h-"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("query_id"))
    return golden.next_human_id(ids)


@query
def edited_fields(spark, d):
    q, _ = _golden(spark, d)
    before = q.select(F.col("query_id").alias("subject"), "query", "category", F.col("origin").alias("labels"))
    after = before.withColumn("query", F.when(F.col("labels") == "human", F.upper("query")).otherwise(F.col("query"))).withColumn("category", F.when(F.col("category") == "procedural", "multi-hop").otherwise(F.col("category")))
    return golden.edited_fields(before, after).select("subject", F.array_join("edited_fields", ",").alias("fields"), "action")


@query
def validate_labels(spark, d):
    """Labels moved out of their documents, to other text and to documents that are not there."""
    _, labels = _golden(spark, d)
    moved = labels.withColumn("doc_id", F.when(F.col("char_start") % 5 == 0, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")))
    moved = moved.withColumn("char_start", F.when(F.col("gain") == 1, F.col("char_start") + 1).otherwise(F.col("char_start"))).withColumn("char_end", F.when(F.col("gain") == 1, F.col("char_end") + 1).when(F.col("gain") == 2, F.col("char_end") + 1_000_000).otherwise(F.col("char_end")))
    return golden.validate_labels(moved, _docs(spark, d))


@query
def validate_policy(spark, d):
    return golden.validate_policy(_golden(spark, d)[0].where("origin = 'llm'"))


@query
def category_counts_with_zero(spark, d):
    return aggregate.counts_with_zero(_golden(spark, d)[0].where("category <> 'procedural'"), "category", aggregate.CATEGORIES)


@query
def set_problems(spark, d):
    """The set with its human queries given twice, once in capitals, and without labels for one category."""
    q, labels = _golden(spark, d)
    more = q.where("origin = 'human'").select(F.concat("query_id", F.lit("-b")).alias("query_id"), F.upper("query").alias("query"), "category", "origin")
    found = golden.set_problems(q.unionByName(more), labels.unionByName(labels.where("gain = 2")))
    return found.select("problem", F.when(F.col("problem") == "duplicate-query", F.md5("subject")).otherwise(F.col("subject")).alias("subject"), "n")


# ---------------------------------------------------------------- passages, quotes, proposals, echoes


@query
def passage_samples(spark, d):
    return golden.hashed_passages(_docs(spark, d), 2).select("doc_id", "ord", "char_start", "char_end", F.md5("text").alias("text_md5"))


@query
def passage_sample_round_robin(spark, d):
    return golden.sample_passages(_docs(spark, d), 40, 7).select("passage_id", "doc_id", "char_start", "char_end", F.md5("text").alias("text_md5"))


def _quotes(spark, d):
    """Each document's text with four quotes: too short, found, not found, and a run that may occur twice."""
    rows = _docs(spark, d).select("doc_id", "text", F.lit(0).alias("char_start"))
    half = F.expr("substring(text, length(text) div 2, 40)")
    return rows.select("doc_id", "char_start", "text", F.posexplode(F.array(F.substring("text", 1, 10), half, F.concat(half, F.lit("#")), F.repeat(F.substring("text", 1, 1), 25))).alias("ord", "quote"))


@query
def resolve_quotes(spark, d):
    return golden.resolve_quotes(_quotes(spark, d)).select("doc_id", "ord", F.coalesce("code", F.lit("ok")).alias("code"), F.col("quote_start").cast("long").alias("quote_start"), F.col("quote_end").cast("long").alias("quote_end"))


@query
def quote_rejections(spark, d):
    return golden.resolve_quotes(_quotes(spark, d)).where("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query
def proposals_judged(spark, d):
    """Proposals of every kind of fault, by document number."""
    n = F.col("doc_id") % 9
    quote = F.expr("substring(text, 1, 30)")
    spans = F.when(n == 3, F.array().cast("array<struct<quote:string,gain:int>>")).when(n == 4, F.array(F.struct(quote.alias("quote"), F.lit(7).alias("gain")))).when(n == 5, F.array(F.struct(quote.alias("quote"), F.lit(2).alias("gain")), F.struct(quote.alias("quote"), F.lit(3).alias("gain")))).otherwise(F.array(F.struct(quote.alias("quote"), F.lit(2).alias("gain"))))
    rows = _docs(spark, d).select(F.concat(F.lit("p-"), F.col("doc_id").cast("string")).alias("passage_id"), F.col("doc_id").cast("int").alias("ord"), "doc_id", F.lit(100).alias("char_start"), "text", (n == 0).alias("decline"), F.when(n == 1, "  ").otherwise("what").alias("query"), F.when(n == 2, "poetry").otherwise("multi-hop").alias("category"), spans.alias("spans"), (n == 7).alias("request_failed"), (n != 8).alias("tool_called"))
    return golden.judge_proposals(rows).select("doc_id", "code", "candidate_id", F.col("labels")[0]["char_end"].cast("long").alias("char_end"))


@query
def authored_pairs(spark, d):
    """A form for each document, with every kind of fault by document number, parsed and resolved in whole documents."""
    n = F.col("doc_id") % 8
    span = F.struct(F.when(n == 4, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")).alias("doc_id"), F.when(n == 5, 7).when(n == 6, 1).otherwise(3).alias("gain"), F.expr("substring(text, 1, 30)").alias("quote"))
    spans = F.when(n == 3, F.array().cast("array<struct<doc_id:bigint,gain:int,quote:string>>")).when(n == 7, F.array(span, span)).otherwise(F.array(span))
    forms = _docs(spark, d).select(F.col("doc_id").alias("form_id"), F.to_json(F.struct(F.when(n == 1, " ").otherwise("what").alias("query"), F.when(n == 2, "poetry").otherwise("procedural").alias("category"), spans.alias("spans"))).alias("text"))
    out = authoring.resolve(authoring.parse(forms), _docs(spark, d).withColumn("char_start", F.lit(0)))
    return out.select("form_id", "problem", F.col("labels")[0]["char_end"].cast("long").alias("char_end"))


@query
def label_highlights(spark, d):
    """Documents with the passages of a query marked in them."""
    _, labels = _golden(spark, d)
    marked = labels.where("gain = 3").groupBy("query_id", "doc_id").agg(F.collect_list(F.struct("char_start", "char_end", "gain")).alias("labels")).join(_docs(spark, d), "doc_id")
    return marked.select("query_id", "doc_id", F.md5(authoring.highlight(F.col("text"), F.lit(0), F.col("labels"))).alias("screen_md5"))


def _echo_rows(spark, d):
    gold = fixtures.gold_documents(_docs(spark, d), table(spark, d, "benchmark"))
    return golden.echo(gold.select("item_id", "doc_id", F.expr("substring(passage, 1, 120)").alias("query"), F.col("passage").alias("text")))


@query
def echo_overlap(spark, d):
    every = F.array_join(F.filter(T.tokens(F.col("text")), lambda _, i: i % 4 == 0), " ")
    rows = table(spark, d, "benchmark").select("item_id", F.concat_ws(" ", every, F.lit("zzz yyy")).alias("query"), "text")
    return golden.echo(rows).select("item_id", _r("overlap"))


@query
def echo_longest_run(spark, d):
    return golden.echo_warning(_echo_rows(spark, d)).select("item_id", "doc_id", F.col("longest_run").cast("long").alias("longest_run"), _r("overlap"), F.col("warning").isNotNull().alias("warned"))


# ---------------------------------------------------------------- stores


@query
def dup_query_fold(spark, d):
    """Texts of a conversation, those of users once more with other blanks around and between words."""
    c = table(spark, d, "conversations").select("text", "role")
    again = c.where("role = 'user'").withColumn("text", F.concat(F.lit(" \t"), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\n")))
    folded = T.fold_query(F.col("text"), unicode_fold=False)
    return c.unionByName(again).groupBy(F.md5(folded).alias("folded_md5")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query
def distinct_texts(spark, d):
    found = caches.distinct_texts(_docs(spark, d), table(spark, d, "benchmark"), table(spark, d, "conversations"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query
def cache_misses(spark, d):
    asked = table(spark, d, "conversations").select(F.md5("text").alias("key"))
    store = table(spark, d, "conversations").where("role = 'user'").select(F.md5("text").alias("key"))
    return caches.misses(asked, store)


@query
def rerank_counts(spark, d):
    """Queries and pairs of a store of rerank scores."""
    *_, ranked = _hybrid(spark, d)
    return caches.score_counts(_rerank_scores(ranked).select(F.col("query_id").alias("query_key"), F.col("chunk_id").alias("passage_key"), "score"))


@query
def cache_fill_report(spark, d):
    asked = table(spark, d, "conversations").select(F.md5("text").alias("key"), F.length("text").cast("long").alias("value"))
    store = asked.where("value % 2 = 0").dropDuplicates(["key"])
    return caches.fill(asked, store, lambda todo: todo)[1]


@query
def store_verify(spark, d):
    return caches.check_store(table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding"), 64).select("n_rows", "n_keys", F.col("min_dim").cast("long").alias("min_dim"), F.col("max_dim").cast("long").alias("max_dim"), "sound")
