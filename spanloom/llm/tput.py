"""Ranked lexical search by TPUT: three phases over posting lists that are partitioned by term and ordered by impact.

Score.  Terms are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z are lowered.  N documents have
a term, L is the number of their terms, n that of one document, df the documents with a term, tf its places in one.
``w = floor(1000 * ln((2 N + 2) / (2 df + 1)))``, ``m = 25 + (75 n N) div L`` and the impact of a posting is ``c = (10^9
tf) div (1000 tf + 8 m)``.  A document's score is the sum over a query's terms, repeats included, of ``w * c``.

Index.  One scan counts terms where the documents lie and writes a row a document (row, doc_id, n, terms, tfs), the store
that scores are looked up in.  Posting lists (term, c, row, doc_id) come from it, sorted by ranges of (term, c down, row):
a term lies in few files, the best of a list come first, and a very frequent term takes many ranges.  An index made for
given queries holds their terms only, a filter within the scan; one made without holds all.

Search.  (1) The ``head`` best of every list are fetched; sums over them bound scores from below.  The PROBED * k documents with the
best sums are looked up, which lifts their bounds to their scores: the k-th of these is tau of a query.  (2) Every list gives
up its postings of at least EASE * tau / lists, one threshold for all lists of a query, once for all queries that want it,
to the slice of their document, where each query's sums are made.  A list that a document was not met in can add less than
the threshold, and no more than the list's best, so a document has a bound from above too, and is out where that is
below tau; a document met in no list cannot reach it, as EASE is below 1, and so there is room for documents met in a few
to be out too.  (3) Exact scores of candidates whose bounds differ are looked up in the store of documents, and the k best
by (score down, doc_id up) are the answer, the same as of full scoring.

Queries go in blocks of about BLOCK_TERMS (query, term) rows, the only ones that a task holds; slices have about SLICE_POSTINGS
postings and are dealt by a hash of the row, so neither grows with the data.

Defined cases: documents with null text or without terms neither count nor match; rows that repeat are documents each;
equal scores rank by doc_id, null last; rows of one item_id are one query, rows without item_id are none; a query without terms, or with none that a
document has, has no rows; a term in so many documents that w is 0 adds nothing; whole texts count, however long; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import from_bytes, gathered, materialise, release, text_bytes

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Best postings of a list that phase 1 fetches (at least k).
HEAD = 100
#: Documents for each of the k that phase 1 looks up, and the share of tau / lists that is the threshold (1 at most).
PROBED, EASE = 10, 0.5
#: (query, term) rows of a block of queries, and postings of a slice and of a range of the sort.
BLOCK_TERMS, SLICE_POSTINGS, RANGE_POSTINGS = 50_000, 1 << 20, 2 << 20
#: Asked terms up to this many filter the scan; with more, all terms are indexed.
MOST_TERMS = 1_000_000
SLICE_BYTES = 8 << 20
_DOCS = "row long, doc_id long, n long, terms array<string>, tfs array<int>"
_FOUND = "item int, row long, doc_id long, lower long, upper long"


@dataclass(frozen=True)
class Index:
    """docs (row, doc_id, n, terms, tfs), terms (term, df, w), postings (term, c, row, doc_id) and their number."""

    docs: DataFrame
    terms: DataFrame
    postings: DataFrame
    n_docs: int
    n_terms: int
    n_postings: int


# ---------------------------------------------------------------- index


_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[48:58], _PLAIN[97:123], _PLAIN[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_PLAIN[65:91] = np.arange(97, 123)


def _counting(asked: pa.Array | None):
    """Terms of each document with their numbers, and how many terms it has in all; documents without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", SLICE_BYTES):
            offsets, data = text_bytes(batch.column("text"))
            lists = pc.ascii_split_whitespace(from_bytes(offsets, _PLAIN[data]))
            flat = lists.flatten().dictionary_encode()
            names, codes = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            real = pc.not_equal(names, "").to_numpy(zero_copy_only=False)
            wanted = real if asked is None else real & pc.is_in(names, value_set=asked).to_numpy(zero_copy_only=False)
            n = np.bincount(owner[real[codes]], minlength=batch.num_rows)
            keep = wanted[codes]
            key = np.sort(owner[keep] * max(1, len(names)) + codes[keep])
            head = np.flatnonzero(np.diff(key, prepend=-1))
            tf = np.diff(head, append=len(key))
            who, which = np.divmod(key[head], max(1, len(names)))
            full = np.flatnonzero(n)
            ends = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=batch.num_rows)[full])]).astype(np.int32)
            at = pa.array(ends, pa.int32())
            rows = pa.array(full)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(rows), batch.column("doc_id").take(rows), pa.array(n[full].astype(np.int64)), pa.ListArray.from_arrays(at, names.take(pa.array(which)).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(tf.astype(np.int32)))],
                names=["row", "doc_id", "n", "terms", "tfs"],
            )
        release()

    return run


def _impact(n_docs: int, n_terms: int) -> Column:
    m = F.expr(f"25 + (75 * n * {n_docs}L) div {max(1, n_terms)}L")
    tf = F.col("tf").cast("long")
    return F.call_function("div", tf * F.lit(1_000_000_000), tf * F.lit(1000) + m * F.lit(8))


def _spread(docs: DataFrame, n_docs: int, n_terms: int, *more: str) -> DataFrame:
    """A row a posting: term, c, row, doc_id."""
    rows = docs.select("row", "doc_id", "n", *more, F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    return rows.select(F.col("p.terms").alias("term"), "n", F.col("p.tfs").alias("tf"), "row", "doc_id", *more).withColumn("c", _impact(n_docs, n_terms)).select("term", "c", "row", "doc_id", *more)


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, qtf) of items (item_id, text)."""
    words = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"({TERM})"), F.lit(1))
    return items.select("item_id", F.explode(words).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def build(docs: DataFrame, queries: DataFrame | None = None) -> Index:
    """An index of docs (doc_id, text), of all terms or of those of queries (item_id, term, qtf)."""
    asked = None
    if queries is not None:
        names = queries.select("term").distinct().limit(MOST_TERMS + 1).toArrow().column("term").combine_chunks()
        asked = names.cast(pa.large_string()) if len(names) <= MOST_TERMS else None
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    store = materialise(rows.mapInArrow(_counting(asked), _DOCS), "tput-docs")
    facts = store.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms"), F.sum(F.size("terms")).alias("postings")).first()
    n_docs, n_terms, n_postings = facts["docs"], facts["terms"] or 0, facts["postings"] or 0
    df = store.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (F.col("df") * 2 + 1).cast("double"))).cast("long")
    terms = materialise(df.withColumn("w", weight), "tput-terms")
    order = [F.col("term"), F.col("c").desc(), F.col("row")]
    lists = _spread(store, n_docs, n_terms).repartitionByRange(max(1, -(-n_postings // RANGE_POSTINGS)), *order).sortWithinPartitions(*order)
    return Index(store, terms, materialise(lists, "tput-lists"), n_docs, n_terms, n_postings)


# ---------------------------------------------------------------- search


def _best(rows: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each group, with ``rank``; Spark prunes in each task before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)


def _kth(rows: DataFrame, value: str, k: int, name: str) -> DataFrame:
    """(item_id, name): the k-th largest value of each query, 0 where there are fewer rows."""
    ranked = _best(rows.select("item_id", value), "item_id", [F.col(value).desc()], k)
    return ranked.groupBy("item_id").agg(F.coalesce(F.max(F.when(F.col("rank") == k, F.col(value))), F.lit(0)).alias(name))


def _exact(index: Index, q: DataFrame, asked: DataFrame) -> DataFrame:
    """(item_id, row, doc_id, score) of asked (item_id, row), from the store of documents."""
    looked = _spread(index.docs.join(asked, "row"), index.n_docs, index.n_terms, "item_id")
    return looked.join(q, ["item_id", "term"]).groupBy("item_id", "row", "doc_id").agg(F.sum(F.col("qtf") * F.col("w") * F.col("c")).alias("score"))


@dataclass(frozen=True)
class _Block:
    """Queries of a block, as arrays: query i has the lists begin[i] to begin[i + 1] of (term, weight, bound)."""

    begin: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    bound: np.ndarray
    threshold: np.ndarray
    tau: np.ndarray
    k: int


def _sums(b: _Block):
    """Bounds of the documents of a slice, for each query: those that may be among its k best."""

    def run(group: pa.Table) -> pa.Table:
        d = {c: group.column(c).to_numpy().astype(np.int64) for c in ("term", "row", "c")}
        doc = pc.fill_null(group.column("doc_id"), np.iinfo(np.int64).max).to_numpy()
        by = np.argsort(d["term"], kind="stable")
        term, c = d["term"][by], d["c"][by]
        rows, first, local = np.unique(d["row"][by], return_index=True, return_inverse=True)
        key = doc[by][first]
        null = group.column("doc_id").is_null().to_numpy()[by][first]
        out: list[tuple[np.ndarray, ...]] = []
        lower, spare = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for i in range(len(b.begin) - 1):
            own = slice(b.begin[i], b.begin[i + 1])
            lower[:], spare[:] = 0, 0
            starts, stops = np.searchsorted(term, b.term[own]), np.searchsorted(term, b.term[own], side="right")
            for low, high, weight, bound in zip(starts.tolist(), stops.tolist(), b.weight[own].tolist(), b.bound[own].tolist(), strict=True):
                if low == high:
                    continue
                part, at = c[low:high] * weight, local[low:high]
                if b.threshold[i] > 1:
                    hit = part >= b.threshold[i]
                    part, at = part[hit], at[hit]
                lower[at] += part
                spare[at] += bound
            upper = lower + (b.bound[own].sum() - spare)
            live = np.flatnonzero((lower > 0) & (upper >= b.tau[i]))
            if len(live) > b.k:
                # beaten by k documents of this slice: those with the best sums, of equal ones the smallest doc_ids
                low = lower[live]
                edge = np.partition(low, len(low) - b.k)[len(low) - b.k]
                tied = np.sort(key[live[low == edge]])[b.k - int((low > edge).sum()) - 1]
                live = live[(upper[live] > edge) | ((upper[live] == edge) & (key[live] <= tied))]
            if len(live):
                out.append((np.full(len(live), i, np.int32), rows[live], key[live], lower[live], upper[live], null[live]))
        item, row, ids, low, high, none = map(np.concatenate, zip(*out, strict=True)) if out else [np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.int64, np.int64, bool)]
        return pa.table({"item": item, "row": row, "doc_id": pa.array(ids, pa.int64(), mask=none), "lower": low, "upper": high})

    return run


def _search_block(index: Index, rows: DataFrame, k: int) -> DataFrame:
    """(item_id, row, doc_id, lower, upper): candidates of the queries in rows (item_id, term, qtf, w, top, tau)."""
    spark = rows.sparkSession
    kind = rows.schema["item_id"]
    held = rows.orderBy("item_id", "term").collect()  # a block of the stated queries
    names = list(dict.fromkeys(r["item_id"] for r in held))
    number = {x: i for i, x in enumerate(names)}
    terms = {t: i for i, t in enumerate(sorted({r["term"] for r in held}))}
    item = np.array([number[r["item_id"]] for r in held], np.int64)
    lists = np.bincount(item, minlength=len(names))
    begin = np.concatenate([[0], np.cumsum(lists)])
    tau = np.array([held[b]["tau"] for b in begin[:-1]], np.int64)
    threshold = np.maximum(1, np.ceil(tau * (EASE / np.maximum(1, lists))).astype(np.int64))
    weight = np.array([r["qtf"] * r["w"] for r in held], np.int64)
    best = weight * np.array([r["top"] for r in held], np.int64)
    block = _Block(begin, np.array([terms[r["term"]] for r in held], np.int64), weight, np.minimum(best, threshold[item] - 1), threshold, tau, k)
    # the least impact for which some query of the block wants a posting of a list
    least: dict[str, int] = {}
    for r, w, t in zip(held, weight.tolist(), threshold[item].tolist(), strict=True):
        least[r["term"]] = min(least.get(r["term"], 1 << 62), -(-t // w))
    wanted = spark.createDataFrame([(t, i, least[t]) for t, i in terms.items()], "term string, number int, least long")
    items = spark.createDataFrame([(i, x) for x, i in number.items()], f"item int, item_id {kind.dataType.simpleString()}")
    slices = max(1, -(-index.n_postings // SLICE_POSTINGS))
    sent = index.postings.join(F.broadcast(wanted), "term").where("c >= least").select(F.col("number").alias("term"), "row", "doc_id", "c", F.pmod(F.xxhash64("row"), F.lit(slices)).alias("slice"))
    found = sent.groupBy("slice").applyInArrow(_sums(block), _FOUND)
    found = materialise(found.join(F.broadcast(items), "item").drop("item"), "tput-found")
    second = _kth(found, "lower", k, "second")
    return materialise(found.join(second, "item_id").where("upper >= second"), "tput-candidates")


def search(index: Index, queries: DataFrame, k: int = 10, head: int = HEAD) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query (item_id, term, qtf)."""
    q = materialise(queries.join(index.terms, "term").where("w > 0").select("item_id", "term", "qtf", "w"), "tput-queries")
    # 1. heads of the lists, and the k-th sum over them
    lists = index.postings.join(q.select("term").distinct(), "term", "left_semi")
    heads = materialise(_best(lists, "term", [F.col("c").desc(), F.col("row")], max(k, head)).select("term", "c", "row", "rank"), "tput-heads")
    sums = q.join(heads, "term").groupBy("item_id", "row").agg(F.sum(F.col("qtf") * F.col("w") * F.col("c")).alias("lower"))
    probed = materialise(_best(sums, "item_id", [F.col("lower").desc(), F.col("row")], k * PROBED).select("item_id", "row"), "tput-probed")
    tops = heads.where("rank = 1").select("term", F.col("c").alias("top"))
    known = q.join(tops, "term").join(_kth(_exact(index, q, probed), "score", k, "tau"), "item_id")
    blocks = max(1, -(-q.count() // BLOCK_TERMS))
    known = materialise(known.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "tput-bounds")
    # 2. postings over the thresholds, block by block
    left = None
    for b in range(blocks):
        some = _search_block(index, known.where(F.col("block") == b).drop("block"), k)
        left = some if left is None else left.unionByName(some)
    # 3. scores of those whose bounds differ
    open_ = left.where("lower < upper").select("item_id", "row")
    scored = left.where("lower = upper").select("item_id", "row", "doc_id", F.col("lower").alias("score")).unionByName(_exact(index, q, open_))
    ranked = _best(scored, "item_id", [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")], k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of docs (doc_id, text) for items (item_id, text)."""
    queries = materialise(query_terms(items), "tput-asked")
    return search(build(docs, queries), queries, k)
