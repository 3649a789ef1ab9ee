"""Exact cosine search by matrix products: over a grid of blocks, or with all queries in each task; and a hashing embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import spaced
from spanloom.operators.lexical import counted
from spanloom.operators.ranking import CELLS, Best, top_n

#: Bytes of query vectors that each task may hold.
MOST_QUERY_BYTES = 256 << 20
#: A block of vectors, as doubles and in rows, and a block of queries in rows: what a task holds of a search over a grid.
BLOCK_BYTES, BLOCK_ROWS, QUERY_ROWS = 16 << 20, 16_384, 2_048


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(vector: Column) -> Column:
    """The vector over its norm, as doubles; an error for a zero, empty or infinite one."""
    bad = lambda n: n.isNull() | F.isnan(n) | (n == 0) | (n == float("inf"))
    refused = F.raise_error(F.lit("a vector has no direction")).cast("array<double>")
    # the norm as a variable, so that it is worked out once for a vector, not for each of its numbers
    return F.transform(F.array(norm(vector)), lambda n: F.when(bad(n), refused).otherwise(F.transform(vector, lambda x: x.cast("double") / n)))[0]


def _block(id_col: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(id_col, "vector"), F.lit(blocks)).cast("int")


def _each(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors over their norms, a row for each; as unit, an error for one that has no direction."""
    lists = vectors.combine_chunks()
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    if flat.null_count or not size.all():
        raise ValueError("a vector has no direction")
    if (size != size[0]).any():
        raise ValueError("vectors differ in length")
    own = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(size), -1)
    length = np.linalg.norm(own, axis=1, keepdims=True)
    if not (np.isfinite(length) & (length > 0)).all():
        raise ValueError("a vector has no direction")
    return own / length


def _others(query_ids: pa.Array, ids: pa.Array):
    """A function from a range of ids to a mask: the ids that are not the query's own; none where either is missing, as in SQL."""
    coded = pa.concat_arrays([query_ids, ids.cast(query_ids.type)]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    q, v = coded[: len(query_ids)], coded[len(query_ids) :]
    return lambda first, last: (v[first:last, None] != q) & (q >= 0) & (v[first:last, None] >= 0)


def _cell(n: int, skip_same: bool):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", queries.schema.field("query_id").type), ("chunk_id", vectors.schema.field("chunk_id").type), ("score", pa.float64())])
        if not queries.num_rows or not vectors.num_rows:
            return out.empty_table()
        query_ids, ids = queries["query_id"].combine_chunks(), vectors["chunk_id"].combine_chunks()
        q, v = _matrix(queries["qv"]), _matrix(vectors["cv"])
        if q.shape[1] != v.shape[1]:
            raise ValueError("vectors differ in length")
        best, others = Best(query_ids, n), _others(query_ids, ids) if skip_same else None
        for first in range(0, len(v), step := max(1, CELLS // len(q))):
            score = v[first : first + step] @ q.T
            best.add(ids.slice(first, step), score, others(first, first + step) if others else None)
        return pa.Table.from_batches(best.rows(), out)

    return run


def _blocks(rows: DataFrame, most_rows: int, least: int = 1) -> int:
    """Blocks of some BLOCK_BYTES and most_rows each at most; `least`, if that leaves a thousand rows for each."""
    count, numbers = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0))).first()
    return max(1, -(-8 * numbers // BLOCK_BYTES), -(-count // most_rows), min(least, -(-count // 1000)))


def search(queries: DataFrame, vectors: DataFrame, n: int, skip_same: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank).  queries: (query_id, vector); vectors: (chunk_id, vector); all pairs, exactly.

    All pairs are a grid: blocks of queries by blocks of vectors, a matrix product for each cell, of which the n best of each
    query go on.  A cell is of bounded size, so neither side has to fit anywhere, and no vector passes through the driver.
    """
    asked, stored = _blocks(queries, QUERY_ROWS), _blocks(vectors, BLOCK_ROWS, vectors.sparkSession.sparkContext.defaultParallelism)
    # aliases, as the two sides may be of one table and cogroup tells columns apart by where they come from
    q = queries.select(F.col("query_id").alias("query_id"), F.col("vector").alias("qv"), _block("query_id", asked).alias("i"), _each(stored).alias("j"))
    v = vectors.select(F.col("chunk_id").alias("chunk_id"), F.col("vector").alias("cv"), _block("chunk_id", stored).alias("j"), _each(asked).alias("i"))
    ids = [f"{c} {d.schema[c].dataType.simpleString()}" for c, d in (("query_id", queries), ("chunk_id", vectors))]
    found = q.groupBy("i", "j").cogroup(v.groupBy("i", "j")).applyInArrow(_cell(n, skip_same), ", ".join([*ids, "score double"]))
    return top_n(found, n)


def search_arrow(queries: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """As search, by matrix products over batches; each task keeps its n best of each query, ties and all rules alike."""
    rows = queries.select("query_id", "vector").collect()  # the stated query set
    ids = [r["query_id"] for r in rows]
    matrix = np.array([r["vector"] for r in rows], dtype=np.float64)
    if matrix.nbytes > MOST_QUERY_BYTES:
        raise ValueError("split the queries: they are more than a task may hold")
    if not len(rows):
        return search(queries, vectors, n)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    kind = vectors.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(ids, n)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
            own /= np.linalg.norm(own, axis=1, keepdims=True)
            for first in range(0, batch.num_rows, step := max(1, CELLS // len(ids))):
                score = own[first : first + step] @ matrix.T
                if not np.isfinite(score).all():
                    raise ValueError("a score is not finite")
                best.add(batch.column("chunk_id").slice(first, step), score)
        yield from best.rows()

    found = vectors.select("chunk_id", "vector").mapInArrow(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {kind}, score double")
    return top_n(found, n)


def _buckets(coded: pa.DictionaryArray, dimension: int) -> np.ndarray:
    """The bucket of each token; a distinct one is hashed once."""
    own = [int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big") % dimension for t in coded.dictionary.to_pylist()]
    return np.array(own, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]


def _bucket_counts(dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            bucket = _buckets(coded, dimension)
            row = np.repeat(np.arange(batch.num_rows), size)
            weights = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
            counts = np.bincount(row * dimension + bucket, weights, batch.num_rows * dimension).astype(np.int32).reshape(batch.num_rows, dimension)
            counts[size == 0, 0] = 1
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dimension), pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), vectors], names=["id", "counts"])

    return run


def hash_counted(rows: DataFrame, id_col: str = "chunk_id", dimension: int = 256) -> DataFrame:
    """(id, vector of whole numbers) of counted rows (id, terms, tfs): counts of tokens by bucket of their MD5; the first
    axis for rows without tokens.

    Made where the rows are, on Arrow batches, a batch's distinct terms hashed once; nothing is shuffled.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    found = rows.select(F.col(id_col).alias("id"), "terms", "tfs")
    return found.mapInArrow(_bucket_counts(dimension), f"id {kind}, counts array<int>").select(F.col("id").alias(id_col), F.col("counts").alias("vector"))


def _with_vectors(dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("flat")
            lists = pc.split_pattern(pc.if_else(pc.equal(flat, ""), pa.scalar(None, flat.type), flat), " ")
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            bucket = _buckets(coded, dimension)
            counts = np.bincount(np.repeat(np.arange(batch.num_rows), size) * dimension + bucket, minlength=batch.num_rows * dimension).astype(np.int32).reshape(batch.num_rows, dimension)
            counts[size == 0, 0] = 1
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dimension), pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=[*batch.schema.names[:-1], "vector"])

    return run


def with_hash_counts(rows: DataFrame, text_col: str = "text", dimension: int = 256) -> DataFrame:
    """rows with their hash_counts as a column, vector: no join of texts with vectors is needed."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["vector array<int>"])
    return rows.select("*", spaced(F.col(text_col)).alias("flat")).mapInArrow(_with_vectors(dimension), schema)


def hash_counts(rows: DataFrame, id_col: str, text_col: str, dimension: int = 256) -> DataFrame:
    """hash_counted of rows (id, text)."""
    own = counted(rows.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text"))).withColumnRenamed("chunk_id", id_col)
    return hash_counted(own, id_col, dimension)


def hash_embed(rows: DataFrame, id_col: str, text_col: str, dimension: int = 256) -> DataFrame:
    """(id, vector): hash_counts over their norm."""
    return hash_counts(rows, id_col, text_col, dimension).select(id_col, unit(F.col("vector")).alias("vector"))
