"""Shared helpers of the llm operators: scratch tables, batch slicing, fast tokenising and distributed components.

Scratch tables are those of ``spanloom.sources.scratch``: Parquet in the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources import scratch

#: The white space of every contract here, as a character class body for Java and DuckDB patterns.
SPACE = r"\x20\x09-\x0D"


#: Rows in an Arrow batch where the session leaves Spark's default of 10,000, too many for whole texts.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch from Spark's default, so that a batch of texts stays a few megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    bound_batches(spark)
    return scratch.scratch_dir(spark, tag)


def materialise(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage and gives the planner true sizes."""
    bound_batches(df.sparkSession)
    return scratch.materialise(df, tag, *partition_by)


def bucketed(df: DataFrame, tag: str, key: str, buckets: int) -> DataFrame:
    """Write a frame to the shared folder, dealt to buckets by key, and read it back: joins by key need not move it.

    The table is an external one of the session's catalog, as Spark keeps the facts of buckets there.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, tag)
    name = path.rpartition("/")[2].replace("-", "_")
    scratch.note_table(spark, name)
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What the optimiser's estimate is clamped to; frames that it knows nothing of are at the top.
MOST_BYTES = 1 << 50


def plan_bytes(df: DataFrame, least: int = 1 << 20) -> int:
    """The optimiser's size estimate of a frame, clamped; it only steers how finely work is dealt out."""
    return min(max(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), least), MOST_BYTES)


def sized(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """The frame and its size; one whose size nobody knows (rows of the driver, output of Python) is written first."""
    total = plan_bytes(df)
    if total == MOST_BYTES:
        df = materialise(df, tag)
        total = plan_bytes(df)
    return df, total


def unused(df: DataFrame, name: str) -> str:
    """A column name that a frame has not, however its columns are called."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def sub_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches so that one slice holds about max_bytes of the text column (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def release() -> None:
    """Give freed memory back: a Python worker lives on after its task, beside the ones of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; it decides by itself


def gathered(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Join Arrow batches to ones of about max_bytes of the text column (one row at least); larger ones are sliced."""
    held, size = [], 0

    def joined() -> pa.RecordBatch:
        out = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()  # before the work on the copy begins
        return out

    for batch in sub_batches(batches, column, max_bytes):
        more = int(pc.sum(pc.binary_length(batch.column(column))).as_py() or 0)
        if held and size + more > max_bytes:
            yield joined()
            size = 0
        held.append(batch)
        size += more
    if held:
        yield joined()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply); equal inputs give equal outputs, near ones far ones."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of texts in UTF-8, from 0; null as empty.  Slices of a batch become arrays of their own."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], "<i8", n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8, offsets[-1]) if offsets[-1] else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] :]


def from_bytes(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """The texts of offsets and bytes."""
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype("<i8").tobytes()), pa.py_buffer(data.tobytes())])


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(words per text, 64-bit hash of each word); a null text has no words.

    Words are runs of other than ASCII white space; A-Z are lowered when asked, other letters never change.

    A hash chains eight bytes at a time through a bijective mixer, from the length: short words of equal length never
    collide, others with a probability of about 2^-64.
    """
    offsets, data = text_bytes(texts)
    lists = pc.ascii_split_whitespace(from_bytes(offsets, _LOWER[data] if lower else data))
    flat = lists.flatten().cast(pa.large_binary())
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(flat)
    offsets = np.frombuffer(flat.buffers()[1], "<i8", n + 1, flat.offset * 8) if n else np.zeros(1, np.int64)
    data = np.concatenate([np.frombuffer(flat.buffers()[2], np.uint8, offsets[-1]), np.zeros(8, np.uint8)]) if n and offsets[-1] else np.zeros(8, np.uint8)
    eight = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    start, size = offsets[:-1], np.diff(offsets)
    out = mix64((size + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    active, done = np.flatnonzero(size), 0
    while len(active):
        left = np.minimum(size[active] - done, 8).astype(np.uint64)
        value = eight[start[active] + done] & (np.uint64(2**64 - 1) >> (np.uint64(64) - left * np.uint64(8)))
        out[active] = mix64(out[active] ^ value)
        done += 8
        active = active[size[active] > done]
    if n and (empty := size == 0).any():
        owner = np.repeat(np.arange(len(counts)), counts)[~empty]
        counts, out = np.bincount(owner, minlength=len(counts)).astype(np.int64), out[~empty]
    return counts, out


#: Links that one task may join (16 bytes each); more go through rounds of joins.
TASK_LINKS = 2_000_000


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of the links of one task, by union-find towards the smallest node."""
    boss: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := boss.setdefault(top, top)) != top:
            top = up
        while boss[x] != top:
            boss[x], x = top, boss[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(u), find(v)
            boss[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(boss), pa.int64()), pa.array([find(x) for x in list(boss)], pa.int64())], names=["node", "component"])


def components(edges: DataFrame, tag: str = "components", max_rounds: int = 60, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, component) for each node of the undirected links (a, b); component is the smallest node reached.

    Links are counted first: up to task_links of them are joined by union-find in one task.  More alternate large-star
    and small-star steps (each a partial aggregation and an equi-join), so a hub with very many links costs a
    pre-aggregated minimum, never one collected list; each round is written to the shared folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialise(e, tag)
    if e.count() <= task_links:
        return e.coalesce(1).mapInArrow(_union, "node long, component long")
    stamp = None
    for _ in range(max_rounds):
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now[0] == 0 or tuple(now) == stamp:
            break
        stamp = tuple(now)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = materialise(small.select("x.u", "x.v").where("u <> v").distinct(), tag)
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
