"""Stand-ins for inputs that the bundled tables do not have: a labelled query set, rerank scores, a review log, runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import tokens
from spanloom.operators.aggregate import CATEGORIES
from spanloom.plans.config import Chunking, Embedding, Fusion, GatePolicy, Lexical, Reranker, Retrieval
from spanloom.sources.scratch import materialise

#: Windows small enough that test documents have several.
CHUNKING = Chunking(chunk_size=128, chunk_overlap=16)
ANCHOR, MOST_BARE = 5, 1000
#: Published means at k = 10 of four runs, and the policy they are gated by.
RUNS = {
    "dense_512": {"recall": 0.777778, "mrr": 0.503082, "ndcg": 0.510907},
    "dense_256": {"recall": 0.785185, "mrr": 0.504762, "ndcg": 0.524736},
    "hybrid_512": {"recall": 0.861111, "mrr": 0.623624, "ndcg": 0.607400},
    "hybrid_512_rerank": {"recall": 0.866667, "mrr": 0.580026, "ndcg": 0.578218},
}
POLICY = GatePolicy(("dense_512", "dense_256", "hybrid_512", "hybrid_512_rerank"), {"recall_at_10": 0.010, "ndcg_at_10": 0.015, "mrr_at_10": 0.020})
#: The gate of the queries: one configuration of it was not run, one was never blessed.
GATED = GatePolicy(("lexical", "rerank", "hybrid", "dense"), {"recall_at_10": 0.010, "ndcg_at_10": 0.015, "mrr_at_10": 0.020, "recall_at_5": 0.0, "recall_at_20": 0.0})
_VECTORS = Embedding("hashing", "1", 256)


def configuration(name: str, b: float = 0.75, reranked: bool = False, chunking: Chunking = CHUNKING) -> Retrieval:
    """The configurations that the queries run: hash vectors, alone or fused with BM25 of the given b."""
    hybrid = {} if name == "dense" else {"lexical": Lexical("bm25", 50, b=b), "fusion": Fusion()}
    return Retrieval(name, "hybrid" if hybrid else "dense", 10, 50, chunking, _VECTORS, reranker=Reranker(True, "md5", "1", 50) if reranked else Reranker(), description=name, **hybrid)


ACTIONS = {"click": "accept", "view": "skip", "error": "reject", "purchase": "edit", "signup": "accept"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text whose words a task holds at once.
SLICE_TEXT = 4 << 20


def _word_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with a column text, the number of words of each row, and hashes of all words, row after row."""
    for batch in batches:
        bytes_ = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(bytes_) // SLICE_TEXT
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for first, last in zip(cuts, cuts[1:], strict=False):
            rows = batch.slice(first, last - first)
            lists = pc.split_pattern_regex(rows.column("text"), r"[ \t\n\x0B\f\r]+")
            coded = lists.flatten().dictionary_encode()
            own = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
            yield rows, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), own[coded.indices.to_numpy(zero_copy_only=False)]


def _hash_runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on."""
    count = max(0, len(words) - n + 1)
    acc = np.full(count, n, np.uint64)
    for j in range(n):
        acc = (acc ^ words[j : j + count]) * np.uint64(0xFF51AFD7ED558CCD)
        acc ^= acc >> np.uint64(32)
    return acc.view(np.int64)


def _passage_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, many, words in _word_runs(batches):
        size, start = np.minimum(ANCHOR, many - 2), np.cumsum(many) - many
        anchor = [int(_hash_runs(words[s + 1 : s + 1 + n], n)[0]) if n > 0 else None for s, n in zip(start.tolist(), size.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(size, pa.int32()), pa.array(anchor, pa.int64())], names=["item_id", "passage", "size", "anchor"])


def _document_runs(sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, many, words in _word_runs(batches):
            row, end = np.repeat(np.arange(rows.num_rows), many), np.repeat(np.cumsum(many), many)
            for n in sizes:
                hashed = _hash_runs(words, n)
                whole = np.arange(len(hashed)) + n <= end[: len(hashed)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(row[: len(hashed)][whole])), pa.array(hashed[whole])], names=["doc_id", "anchor"])

    return run


def gold_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(item_id, passage, doc_id, text, at): documents that hold a benchmark passage, and its 1-based place.

    Words of a passage from the second on, but the last, are whole words wherever it is pasted: up to ANCHOR of them are
    equi-joined, as hashes, with the documents' runs of as many words, then the passage is looked for.  A passage of one or two
    words has no such run; there may be MOST_BARE of them, which meet every document.
    """
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    b = benchmark.select("item_id", "text").mapInArrow(_passage_anchors, f"item_id {kind(benchmark, 'item_id')}, passage string, size int, anchor long")
    anchored = b.where("size > 0")
    sizes = [r["size"] for r in anchored.select("size").distinct().collect()]  # ANCHOR values at most
    runs = docs.select("doc_id", "text").mapInArrow(_document_runs(sizes), f"doc_id {kind(docs, 'doc_id')}, anchor long")
    near = runs.join(anchored.drop("size"), "anchor").select("item_id", "passage", "doc_id").distinct()
    # written, as it is small: documents then meet it where they lie
    near = materialise(near, "gold-near")
    found = docs.select("doc_id", "text").join(near, "doc_id").select("item_id", "passage", "doc_id", "text")
    bare = b.where("size <= 0").select("item_id", "passage")
    if (n := bare.count()) > MOST_BARE:
        raise ValueError(f"{n} passages of one or two words; at most {MOST_BARE} may meet every document")
    if n:
        found = found.unionByName(docs.select("doc_id", "text").crossJoin(F.broadcast(bare)).select("item_id", "passage", "doc_id", "text"))
    return found.withColumn("at", F.call_function("locate", F.col("passage"), F.col("text"))).where("at > 0")


def query_id(item: Column) -> Column:
    return F.concat(F.lit("q-"), F.lpad(item.cast("string"), 4, "0"))


def golden_set(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries, labels): the whole passage with gain 3, its second half with gain 2 (odd items) or 1."""
    gold = materialise(gold_documents(docs, benchmark), "gold")
    half = F.floor(F.length("passage") / 2).cast("int")
    span = lambda start, end, gain: F.struct(start.cast("int").alias("char_start"), end.cast("int").alias("char_end"), gain.cast("int").alias("gain"))
    at, end = F.col("at") - 1, F.col("at") - 1 + F.length("passage")
    labels = gold.select("item_id", "doc_id", "text", F.explode(F.array(span(at, end, F.lit(3)), span(at + half, end, F.when(F.col("item_id") % 2 == 1, 2).otherwise(1)))).alias("s"))
    labels = labels.select(query_id(F.col("item_id")).alias("query_id"), "doc_id", "s.*", F.expr("substring(text, s.char_start + 1, s.char_end - s.char_start)").alias("quote"))
    every_fourth = F.filter(tokens(F.col("passage")), lambda _, i: i % 4 == 0)
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("item_id") % len(CATEGORIES) + 1).cast("int"))
    queries = gold.select("item_id", "passage").distinct().select(query_id(F.col("item_id")).alias("query_id"), F.array_join(every_fourth, " ").alias("query"), category.alias("category"), F.when(F.col("item_id") % 4 == 0, "human").otherwise("llm").alias("origin"))
    return queries, labels


def pair_score(query: Column, chunk: Column) -> Column:
    """A number in [0, 1) that hangs on the pair alone, in place of a reranker."""
    return F.conv(F.substring(F.md5(F.concat(query, chunk)), 1, 8), 16, 10).cast("double") / 4294967296.0


def review_log(events: DataFrame) -> DataFrame:
    """(seq, subject, action, decided_at) with a subject for each user."""
    action = F.coalesce(*[F.when(F.col("event_type") == e, a) for e, a in ACTIONS.items()])
    return events.select(F.col("event_id").alias("seq"), F.concat(F.lit("c-"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("subject"), action.alias("action"), F.col("value").alias("seconds"))


def run_rows(spark: SparkSession, shift: dict[str, float] | None = None) -> DataFrame:
    rows = [(c, m, 10, v + (shift or {}).get(f"{c}.{m}", 0.0)) for c, ms in RUNS.items() for m, v in ms.items()]
    return spark.createDataFrame(rows, "config string, metric string, k int, mean double")


def run_identity(spark: SparkSession, corpus: str = "m1", drop: tuple[str, ...] = ()) -> DataFrame:
    return spark.createDataFrame([(c, "g1", corpus, "h-" + c) for c in RUNS if c not in drop], "config string, golden_set_hash string, corpus_manifest_hash string, config_hash string")
