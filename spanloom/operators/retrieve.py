"""A configuration as one plan over all queries: arms, fusion, rerank, truncation, assembly."""

from __future__ import annotations

from dataclasses import asdict, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.identity import content_hash
from spanloom.operators import dense, fusion, lexical
from spanloom.operators.ranking import RankingError, top_n
from spanloom.plans.config import Retrieval
from spanloom.sources import versioned
from spanloom.sources.scratch import materialise


def unresolved(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked chunk ids that no chunk has: must be none."""
    return ranked.select("chunk_id").distinct().join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def wiring_problems(chunks: DataFrame, *, vectors: DataFrame | None = None, postings: DataFrame | None = None, dimension: int | None = None) -> DataFrame:
    """(problem, subject, n): what keeps an index from being served over chunks; no rows where all fits.

    unresolved-vector and unresolved-posting: ids that no chunk has; missing-vector: chunks without one; duplicate-vector;
    wrong-dimension; empty-corpus.
    """
    none = chunks.sparkSession.sql("SELECT 'x' AS problem, 'x' AS subject, 0L AS n LIMIT 0")
    known = chunks.select("chunk_id")
    found = [none, known.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("empty-corpus").alias("problem"), F.lit("all").alias("subject"), "n")]
    per_id = lambda df, problem: df.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(problem).alias("problem"), F.col("chunk_id").cast("string").alias("subject"), "n")
    if vectors is not None:
        found += [per_id(vectors.join(known, "chunk_id", "left_anti"), "unresolved-vector"), per_id(known.join(vectors.select("chunk_id"), "chunk_id", "left_anti"), "missing-vector"), per_id(vectors, "duplicate-vector").where("n > 1")]
        if dimension is not None:
            found.append(per_id(vectors.where(F.size("vector") != dimension), "wrong-dimension"))
    if postings is not None:
        found.append(per_id(postings.join(known, "chunk_id", "left_anti"), "unresolved-posting"))
    return reduce(DataFrame.unionByName, found)


def checked_wiring(config: Retrieval, chunks: DataFrame, vectors: DataFrame, index: lexical.Bm25Index | None = None) -> None:
    """Raise, with the first problems, unless a configuration can be served over chunks by these indexes."""
    if (config.retrieval_mode == "hybrid") != (index is not None):
        raise RankingError("a hybrid configuration, and only it, has a lexical index")
    found = wiring_problems(chunks, vectors=vectors, postings=index.postings if index else None, dimension=config.embedding.dimension).limit(5).collect()
    if found:
        raise RankingError("; ".join(f"{r['problem']} {r['subject']}" for r in found))


def retrieve(config: Retrieval, queries: DataFrame, chunks: DataFrame, query_vectors: DataFrame, chunk_vectors: DataFrame, rerank_scores: DataFrame | None = None, top_k: int | None = None, index: lexical.Bm25Index | None = None) -> DataFrame:
    """(query_id, chunk_id, rank, dense, lexical, fused, rerank, doc_id, char_start, char_end, text) of all queries.

    queries: (query_id, query), none blank; vectors: (query_id | chunk_id, vector).  The query prefix belongs to the
    embedder's input only, so lexical and rerank stages see the bare query.  With a stored index of the chunks no text is
    tokenised again.  Arms and results, which have a few rows a query, are written, as later stages read them more than once.
    """
    k = config.top_k if top_k is None else top_k
    if k < 1 or k > config.dense_top_n:
        raise ValueError("top_k is 1 to dense_top_n")
    if config.reranker.enabled != (rerank_scores is not None):
        raise ValueError("an enabled reranker, and only it, has scores")
    queries = queries.withColumn("query", F.when(F.trim("query") == "", F.raise_error(F.lit("a query is blank")).cast("string")).otherwise(F.col("query")))
    near = materialise(dense.search_arrow(query_vectors.join(queries.select("query_id"), "query_id", "left_semi"), chunk_vectors, config.dense_top_n), "retrieve-dense")
    words = fused = None
    ranked = near
    if config.lexical is not None and config.fusion is not None:
        if config.lexical.backend != "bm25":
            raise ValueError("only bm25 is an in-engine lexical arm")
        terms, own = lexical.query_terms(queries), config.lexical
        words = materialise(lexical.search_stored(index, terms, own.top_n, own.k1, own.b) if index else lexical.search(chunks, terms, own.top_n, own.k1, own.b), "retrieve-lexical")
        fused = materialise(fusion.reciprocal_rank([near, words], config.fusion.k), "retrieve-fused")
        ranked = top_n(fused, max(k, config.reranker.top_n_in if config.reranker.enabled else k))
    reranked = fusion.rerank(ranked, rerank_scores, config.reranker.top_n_in, k) if rerank_scores is not None else None
    final = reranked if reranked is not None else ranked.where(F.col("rank") <= k)
    out = materialise(fusion.assemble(final, near, words, fused, reranked), "retrieve-results")
    # the chunks that results name, told where they lie: no other text is shuffled
    named = chunks.join(out.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "doc_id", "char_start", "char_end", "text", F.lit(True).alias("known"))
    located = out.join(named, "chunk_id", "left")
    lost = F.raise_error(F.concat(F.lit("no chunk has the id "), F.col("chunk_id").cast("string"))).cast(located.schema["doc_id"].dataType)
    return located.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id")).otherwise(lost)).drop("known")


# ---------------------------------------------------------------- from a stored index


def index_key(config: Retrieval) -> str:
    """What an index is made of: configurations that cut and embed alike share one."""
    return content_hash({"chunking": asdict(config.chunking), "embedding": asdict(config.embedding)}, 16)


def store(config: Retrieval, chunks: DataFrame, vectors: DataFrame | None, path: str) -> str:
    """Put chunks with their vectors under the configuration's key, in one transaction; the key.

    Chunks that have their vectors as a column need no others, and are joined with nothing.

    Every chunk has one vector of the configuration's dimension, and there is a chunk: else an error, and nothing is stored.
    """
    checked_wiring(config if config.retrieval_mode == "dense" else replace(config, retrieval_mode="dense", lexical=None, fusion=None), chunks, chunks.select("chunk_id", "vector") if vectors is None else vectors)
    key = index_key(config)
    own = chunks.select("chunk_id", "doc_id", "char_start", "char_end", "text", *(["vector"] if vectors is None else []))
    versioned.load((own if vectors is None else own.join(vectors.select("chunk_id", "vector"), "chunk_id")).withColumn("index_key", F.lit(key)), path)
    return key


def search_by_key(path: str, key: str, query_vectors: DataFrame, n: int, version: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the n nearest chunks of an index key, exactly."""
    return dense.search_arrow(query_vectors, versioned.read(query_vectors.sparkSession, path, key, version).select("chunk_id", "vector"), n)


def retrieve_stored(config: Retrieval, queries: DataFrame, query_vectors: DataFrame, path: str, rerank_scores: DataFrame | None = None, version: int | None = None, index: lexical.Bm25Index | None = None) -> DataFrame:
    """As ``retrieve``, over what the index at path holds for the configuration, and a BM25 index of the same chunks."""
    rows = versioned.read(queries.sparkSession, path, index_key(config), version)
    return retrieve(config, queries, rows.drop("vector", "index_key"), query_vectors, rows.select("chunk_id", "vector"), rerank_scores, index=index)
