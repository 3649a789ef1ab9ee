"""A digest of a corpus that any cluster can check and that names what differs: a Merkle tree over ranges of ids.

A document's digest is SHA-256 of its columns (each ``-`` if null, else the bytes of its UTF-8, a colon and the value).  Its range is
the first ``bits`` bits of the SHA-256 of its id, so ranges are even, one document more changes one range only, and no
bounds have to be kept.  A range's digest is SHA-256 of its documents' digests in order, each with how often it occurs; FAN
neighbouring ranges make a node of the next level, in order, until one is left: the root.  All of it is aggregation: no
task sees more than a range, and the driver sees the root.

Two trees are compared from the root down, and only documents of ranges that differ are compared one by one.

Defined cases: rows that repeat count; a null id has a range of its own among the others; ranges without documents are
no nodes; a corpus without documents has the digest of the empty text as root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.scratch import materialise

FAN_BITS = 4
#: Documents that a range shall have at most, on average, where its bits are not given.
RANGE_DOCS = 1024
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def row_digest(columns: list[str]) -> Column:
    def field(c: str) -> Column:
        text = F.col(f"`{c}`").cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, columns)), 256)


def range_of(doc_id: Column, bits: int) -> Column:
    head = F.conv(F.substring(F.sha2(F.coalesce(doc_id.cast("string"), F.lit("")), 256), 1, 8), 16, 10).cast("long")
    return F.shiftright(head, 32 - bits).cast("long")


def bits_for(count: int) -> int:
    """Bits, a multiple of FAN_BITS, for ranges of RANGE_DOCS documents."""
    need = max(0, -(-count // RANGE_DOCS) - 1).bit_length()
    return min(28, -(-need // FAN_BITS) * FAN_BITS)


def leaves(docs: DataFrame, columns: list[str], bits: int, id_col: str = "doc_id") -> DataFrame:
    """(range, doc_id, digest, n) of every document; n counts rows alike."""
    rows = docs.select(range_of(F.col(id_col), bits).alias("range"), F.col(id_col).cast("string").alias("doc_id"), row_digest(columns).alias("digest"))
    return rows.groupBy("range", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))


def _joined(order: list[str], part: Column) -> Column:
    listed = F.array_sort(F.collect_list(F.struct(*order, part.alias("part"))))
    return F.sha2(F.array_join(F.transform(listed, lambda x: x["part"]), ","), 256)


@dataclass(frozen=True)
class Tree:
    """nodes (level, range, docs, digest), from the ranges at level 0 up to the root, and the leaves they stand for."""

    leaves: DataFrame
    nodes: DataFrame
    bits: int

    @property
    def root(self) -> str:
        top = self.nodes.where(F.col("level") == self.bits // FAN_BITS).first()
        return top["digest"] if top else EMPTY

    @property
    def docs(self) -> int:
        return int(self.nodes.where("level = 0").agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0])


def tree(docs: DataFrame, columns: list[str], bits: int | None = None, id_col: str = "doc_id") -> Tree:
    """The tree of docs over columns; without bits they follow from the number of documents."""
    bits = bits_for(docs.count()) if bits is None else bits
    if bits % FAN_BITS or not 0 <= bits <= 28:
        raise ValueError(f"bits are a multiple of {FAN_BITS} from 0 to 28")
    rows = materialise(leaves(docs, columns, bits, id_col), "digest-leaves")
    level = rows.groupBy("range").agg(F.sum("n").alias("docs"), _joined(["digest", "doc_id"], F.concat("digest", F.lit("*"), F.col("n").cast("string"))).alias("digest"))
    level = materialise(level.select(F.lit(0).alias("level"), "range", "docs", "digest"), "digest-ranges")
    nodes = level
    for up in range(1, bits // FAN_BITS + 1):
        above = level.groupBy(F.shiftright("range", FAN_BITS).alias("above")).agg(F.sum("docs").alias("docs"), _joined(["range"], F.concat(F.col("range").cast("string"), F.lit("*"), F.col("digest"))).alias("digest"))
        level = above.select(F.lit(up).alias("level"), F.col("above").alias("range"), "docs", "digest")
        nodes = nodes.unionByName(level)
    return Tree(rows, materialise(nodes, "digest-nodes"), bits)


def save(tree_: Tree, path: str) -> None:
    """Keep a tree beside what it is the digest of; leaves lie in order of their range, so few are read for a fault."""
    tree_.nodes.coalesce(1).sortWithinPartitions("level", "range").write.mode("overwrite").parquet(f"{path}/nodes")
    tree_.leaves.repartitionByRange("range").sortWithinPartitions("range").write.mode("overwrite").parquet(f"{path}/leaves")


def load(spark: SparkSession, path: str) -> Tree:
    nodes = spark.read.parquet(f"{path}/nodes")
    top = nodes.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]
    return Tree(spark.read.parquet(f"{path}/leaves"), nodes, top * FAN_BITS)


def faulty_ranges(before: Tree, now: Tree) -> DataFrame:
    """(range, docs_before, docs_now): ranges that differ, found from the root down; none are read where roots agree."""
    if before.bits != now.bits:
        raise ValueError("trees of different bits")
    spark, found = before.nodes.sparkSession, None
    for level in range(before.bits // FAN_BITS, -1, -1):
        sides = [t.nodes.where(F.col("level") == level).drop("level") for t in (before, now)]
        if found is not None:
            sides = [s.join(found.select(F.col("range").alias("above")), F.shiftright("range", FAN_BITS) == F.col("above"), "left_semi") for s in sides]
        b, a = sides[0].alias("b"), sides[1].alias("a")
        met = b.join(a, F.col("b.range") == F.col("a.range"), "full").where(~F.col("b.digest").eqNullSafe(F.col("a.digest")))
        found = materialise(met.select(F.coalesce("b.range", "a.range").alias("range"), F.coalesce("b.docs", F.lit(0)).alias("docs_before"), F.coalesce("a.docs", F.lit(0)).alias("docs_now")), "digest-faults")
        if found.isEmpty():
            break
    return found if found is not None else spark.createDataFrame([], "range long, docs_before long, docs_now long")


def faults(before: Tree, now: Tree) -> DataFrame:
    """(range, doc_id, problem): changed, missing, added or repeated documents, of the ranges that differ alone."""
    where = faulty_ranges(before, now).select("range")
    side = lambda t, name: t.leaves.join(where, "range", "left_semi").groupBy("range", "doc_id").agg(F.sum("n").alias(name + "_n"), F.sort_array(F.collect_set("digest")).alias(name))
    b, a = side(before, "b").alias("x"), side(now, "a").alias("y")
    met = b.join(a, (F.col("x.range") == F.col("y.range")) & F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")), "full")
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "added").when(F.col("a") != F.col("b"), "changed").when(F.col("a_n") != F.col("b_n"), "repeated")
    return met.select(F.coalesce("x.range", "y.range").alias("range"), F.coalesce("x.doc_id", "y.doc_id").alias("doc_id"), problem.alias("problem")).where("problem is not null")
