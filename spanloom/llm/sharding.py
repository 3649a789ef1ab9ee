"""K-d tree sharding: split recursively at distributed weighted medians along the widest metadata dimension.

A node with ``k`` shards to make splits so that its left child gets ``k // 2 / k`` of its bytes (the weighted median
where k is even), along the dimension in which it is widest: the range of the dimension over the range in the whole
table.  A leaf is a shard; leaves reach the target of total bytes / shards.  Dimensions are numbers of DIM_BITS bits, so
one aggregation of bytes by (node, dimension, value) and a running sum over it find the widest dimension and the value
at the cut, for all nodes of a level.  Rows of that very value are told apart by a hash of doc_id, in two more
aggregations of TIE_BITS / 2 bits each, so a hot value or group of copies is split like any other.  The driver sees one
row for a node and step; rows are never moved or written again before they have their shard.

Defined cases: a null text counts no bytes (size 8); a null dimension sorts before all values; rows with the same
dimensions and hash of doc_id stay together (so rows that repeat a doc_id and text do), and their slots are still
distinct; equal texts under different doc_ids may part, as any rows of a hot value may; an empty table gives no rows;
fewer rows than shards leave some shards empty; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import materialise

#: Bits of a dimension's values and of the hash of doc_id that tells rows of one value apart.
DIM_BITS, TIE_BITS = 12, 24
#: Rows in a block in which slots are numbered by one sort.
SLOT_ROWS = 50_000
_HALF = 1 << TIE_BITS // 2


def _table(spark: SparkSession, rows: list[tuple[int, ...]], *names: str) -> DataFrame:
    """A small table of whole numbers that the planner holds itself; one row a node."""
    values = ", ".join("(" + ", ".join(f"{x}L" for x in r) + ")" for r in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})"))


def _cut(bytes_by: DataFrame, key: list[str], want: DataFrame) -> dict[int, tuple[int, int]]:
    """For each node the smallest value at which its running sum of bytes reaches ``need``, and the bytes below it.

    bytes_by: (node, key..., value, bytes); want: (node, key..., need), at most one row a node, need at most its bytes.
    """
    upto = F.sum("bytes").over(Window.partitionBy("node", *key).orderBy("value"))
    reached = bytes_by.join(want, ["node", *key]).withColumn("upto", upto).where("upto >= need")
    found = reached.groupBy("node").agg(F.min_by(F.struct("value", F.expr("upto - bytes").alias("under")), "value").alias("x"))
    return {r["node"]: (r["x"]["value"], r["x"]["under"]) for r in found.collect()}  # one row a node


def _widest(sums: list, spread: dict[int, int]) -> dict[int, int]:
    """The widest dimension of each node; of equal ones the first."""
    width: dict[int, dict[int, float]] = {}
    for r in sums:
        width.setdefault(r["node"], {})[r["dim"]] = (r["high"] - r["low"]) / spread[r["dim"]]
    return {n: max(sorted(w), key=w.__getitem__) for n, w in width.items()}


def place(rows: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """rows (dims..., tie, size) with the first shard of their leaf as ``node``."""
    spark = rows.sparkSession
    level, spread = {0: shards}, {}
    out = rows.withColumn("node", F.lit(0).cast("long"))
    while split := {n: k for n, k in level.items() if k > 1}:
        values = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("dim"), F.col(d).alias("value")) for i, d in enumerate(dims)])).alias("x")
        by_value = out.select("node", "size", values).groupBy("node", F.col("x.dim").alias("dim"), F.col("x.value").alias("value")).agg(F.sum("size").alias("bytes"))
        by_value = materialise(by_value, "shard-sums")
        sums = by_value.groupBy("node", "dim").agg(F.sum("bytes").alias("bytes"), F.min("value").alias("low"), F.max("value").alias("high")).collect()  # nodes x dims
        if not sums:
            break
        spread = spread or {r["dim"]: max(1, r["high"] - r["low"]) for r in sums}
        dim = {n: d for n, d in _widest(sums, spread).items() if n in split}
        total = {r["node"]: r["bytes"] for r in sums}
        need = {n: max(1, total[n] * (split[n] // 2) // split[n]) for n in dim}
        if need:
            value = _cut(by_value, ["dim"], _table(spark, [(n, dim[n], need[n]) for n in need], "node", "dim", "need"))
            left = {n: need[n] - value[n][1] for n in need}
            # among rows of the value at the cut: the upper half of the hash, then the lower
            own = F.get(F.array(*dims), F.col("d").cast("int"))
            at = out.join(_table(spark, [(n, dim[n], value[n][0]) for n in need], "node", "d", "at"), "node").where(own == F.col("at"))
            upper = _cut(at.groupBy("node", F.expr(f"tie div {_HALF}").alias("value")).agg(F.sum("size").alias("bytes")), [], _table(spark, list(left.items()), "node", "need"))
            at = at.join(_table(spark, [(n, upper[n][0]) for n in need], "node", "upper"), "node").where(f"tie div {_HALF} = upper")
            lower = _cut(at.groupBy("node", F.expr(f"tie % {_HALF}").alias("value")).agg(F.sum("size").alias("bytes")), [], _table(spark, [(n, left[n] - upper[n][1]) for n in need], "node", "need"))
            cut = _table(spark, [(n, dim[n], value[n][0], upper[n][0] * _HALF + lower[n][0], n + split[n] // 2) for n in need], "node", "d", "at", "tie_at", "right")
            goes_left = F.coalesce((own < F.col("at")) | ((own == F.col("at")) & (F.col("tie") <= F.col("tie_at"))), F.lit(True))
            out = out.join(cut, "node", "left").withColumn("node", F.when(goes_left, F.col("node")).otherwise(F.col("right"))).drop("d", "at", "tie_at", "right")
        for n, k in split.items():
            level[n], level[n + k // 2] = k // 2, k - k // 2
    return out


def base_rows(docs: DataFrame) -> DataFrame:
    """Size, checksum and metadata dimensions of every document, without the texts."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    most = (1 << DIM_BITS) - 1

    def rank(c: str) -> Column:
        """The place of a name among hashes; null is before all."""
        return F.when(F.col(c).isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(most)) + 1)

    return docs.select(
        "doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        rank("source").alias("source"), rank("lang").alias("lang"), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << TIE_BITS)).alias("tie"),
    ).withColumn("length", F.least(F.floor(F.log2(F.col("size")) * 100).cast("long"), F.lit(most).cast("long")))


def assign(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document; the law is ``bytes``.

    Dimensions: source, language (places of their hashes) and length (hundredths of a power of two of the bytes).
    """
    rows = materialise(base_rows(docs), "shard-rows")
    placed = materialise(place(rows, ["length", "source", "lang"], shards), "shard-placed")
    total = rows.count()
    blocks = max(1, -(-total // (SLOT_ROWS * shards)))
    placed = placed.select("doc_id", "size", "text_crc32", "tie", F.col("node").alias("shard")).withColumn("block", F.pmod(F.col("tie"), F.lit(blocks)))
    # slots: a running count over the few blocks of a shard, then a sort within each block
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = placed.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "block").orderBy("tie", "doc_id")
    return placed.withColumn("at", F.row_number().over(within)).join(F.broadcast(start) if blocks * shards <= 100_000 else start, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
