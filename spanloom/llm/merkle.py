"""A Merkle manifest of a dataset: a tree for each source and one over the sources, kept as an external-memory node store.

H is SHA-256; digests are hashed as hex text.  A leaf is H of doc_id, source, lang, n_chars and text, each ``-`` if null,
else the bytes of its UTF-8, a colon and the value.  In a source leaves ascend by doc_id (null first, then by the leaf);
of every ARITY consecutive nodes one parent is made, of fewer at the end too, until one node is left: the subroot.  The
subroots, by source (null first, in bytewise order), make a tree in the same way; its last node is the root.

Store.  ``build`` scans the documents once, for their leaves; texts never move.  Leaves are sorted by ranges of (source,
doc_id, leaf), so a source with a third of all rows, or one row that repeats, takes many ranges; their places come from
the counts of the runs.  Runs stream into Parquet partitioned by level, with a row (source, level, pos, n, hash) a node.
SPAN levels are made in one pass: a task takes an aligned stretch of ARITY ** SPAN nodes of the level that the pass
before has written last, and each level within is read in order to make the next.  A pass shrinks its input by
ARITY ** SPAN, so ten thousand million leaves take three.

Proofs.  ``paths`` goes down pass by pass.  The levels of a pass are scanned together and meet by their coordinate (source
and stretch) with the path of the stretch's topmost node, which the pass above has made; a node's path is its siblings,
then the path of its parent.  Only paths of nodes at whose level a pass begins are written, one for each ARITY ** SPAN
leaves; paths of leaves are used where they are made.

Defined cases: a null is the value ``-``, so an empty text differs from none; rows that repeat count each, in any order,
as they are equal; rows without doc_id are leaves like others and are never tampered with; a source of one leaf has it
as subroot, with no siblings; one source alone makes its subroot the root; an empty table has no nodes and no root; texts
of any length are hashed whole; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import bound_batches, materialise, plan_bytes, scratch_dir

ARITY, SPAN = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bytes of leaves that one range of a sort gets.
RANGE_BYTES = 32 << 20
_NODE = "source string, level int, pos long, n long, hash string"


# ---------------------------------------------------------------- leaves


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """Digest of a document, or of one with another text."""
    return F.sha2(F.concat(*[_field(F.col(c) if c != "text" or text is None else text) for c in FIELDS]), 256)


def tampered_text() -> Column:
    """The text without line feeds where the checksum of the decimal doc_id is even; all others as they are."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def depth(n: Column) -> Column:
    """Levels above n leaves: the least d for which ARITY ** d is at least n."""
    powers = F.array(*[F.lit(ARITY**d) for d in range(40) if ARITY**d < 1 << 63])
    return F.size(F.filter(powers, lambda p: p < n)).cast("int")


def placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (source, ...) with pos, from 0 and without gaps in each source by the order of ``by``, and n, its rows.

    No source is ever one task: rows are sorted by ranges, then numbered by the counts of the ranges before.
    """
    order = [F.col(c).asc_nulls_first() for c in ("source", *by)]
    row = rows.withColumn("tie", F.monotonically_increasing_id())
    parts = max(1, -(-plan_bytes(rows) // RANGE_BYTES))
    runs = row.repartitionByRange(parts, *order, F.col("tie")).sortWithinPartitions(*order, F.col("tie")).drop("tie")
    runs = materialise(runs.withColumn("run", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "merkle-runs")
    before = Window.partitionBy("source").orderBy("run")
    spans = runs.groupBy("source", "run").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    spans = spans.select("run", "source", "first", F.coalesce(F.sum("rows").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("rows").over(Window.partitionBy("source")).alias("n"))
    spans = materialise(spans, "merkle-spans")  # the planner broadcasts it where its size allows
    met = runs.alias("r").join(spans.alias("s"), (F.col("r.run") == F.col("s.run")) & F.col("r.source").eqNullSafe(F.col("s.source")))
    return met.select(*[F.col(f"r.`{c}`") for c in rows.columns], (F.col("at") - F.col("first") + F.col("start")).alias("pos"), "n")


# ---------------------------------------------------------------- the store


@dataclass(frozen=True)
class Tree:
    """Nodes of the trees of all sources, by level; ``tops`` (source, pos, n, hash) has the last node of each.

    Level 0 is in the folder as any other; ``deepest`` is the level of the highest of these last nodes.
    """

    folder: str
    nodes: DataFrame
    tops: DataFrame
    deepest: int


@dataclass(frozen=True)
class Manifest:
    """leaves (source, pos, n, doc_id, hash, tampered), the trees of the sources, the subroots as leaves (pos, n, name,
    hash), the tree over them and its root (none where there are no rows)."""

    leaves: DataFrame
    sources: Tree
    over_leaves: DataFrame
    over: Tree
    root: str | None


def _parents(hashes: list[str]) -> list[str]:
    return [sha256("".join(hashes[i : i + ARITY]).encode()).hexdigest() for i in range(0, len(hashes), ARITY)]


def _counts(n: int, base: int, span: int) -> list[int]:
    """Nodes of a source of n leaves on the levels base to base + span."""
    return [-(-n // ARITY**level) for level in range(base, base + span + 1)]


def _raise(base: int, span: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        n, stretch = group.column("n")[0].as_py(), key[1].as_py()
        hashes, level, counts = group.column("hash").to_pylist(), base, _counts(n, base, span)
        out: list[tuple[int, int, str]] = []
        while level < base + span and counts[level - base] > 1:
            hashes, level = _parents(hashes), level + 1
            first = stretch * ARITY ** (span - (level - base))
            out += [(level, first + i, h) for i, h in enumerate(hashes)]
        levels, pos, hashed = zip(*out, strict=True) if out else ((), (), ())
        k = len(out)
        return pa.table({"source": pa.array([key[0].as_py()] * k, pa.string()), "level": pa.array(levels, pa.int32()), "pos": pa.array(pos, pa.int64()), "n": pa.array([n] * k, pa.int64()), "hash": pa.array(hashed, pa.string())})

    return run


def grow(leaves: DataFrame, tag: str, span: int = SPAN) -> Tree:
    """The trees over leaves (source, pos, n, hash), level by level into one store."""
    spark = leaves.sparkSession
    bound_batches(spark)
    folder, schema = scratch_dir(spark, tag), leaves.select("source", F.lit(0).alias("level"), "pos", "n", "hash").schema
    put = lambda df: df.select("source", "level", "pos", "n", "hash").write.mode("append").partitionBy("level").parquet(folder)
    put(leaves.withColumn("level", F.lit(0)))
    nodes = lambda: spark.read.schema(schema).parquet(folder)
    deepest = (nodes().where("level = 0").agg(F.max(depth(F.col("n"))).alias("d")).first() or {"d": None})["d"] or 0
    for base in range(0, deepest, span):
        last = nodes().where((F.col("level") == base) & (depth(F.col("n")) > base))
        put(last.withColumn("stretch", F.expr(f"pos div {ARITY**span}")).groupBy("source", "stretch").applyInArrow(_raise(base, span), _NODE))
    every = nodes()
    tops = materialise(every.where((F.col("pos") == 0) & (F.col("level") == depth(F.col("n")))).select("source", "pos", "n", "hash"), tag + "-tops")
    return Tree(folder, every, tops, deepest)


def build(docs: DataFrame, span: int = SPAN) -> Manifest:
    """The manifest of docs (FIELDS), with the leaf of the tampered text beside each leaf."""
    narrow = docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf().alias("hash"), leaf(tampered_text()).alias("tampered"))
    leaves = materialise(placed(materialise(narrow, "merkle-leaves"), ["doc_id", "hash"]), "merkle-placed")
    sources = grow(leaves, "merkle-nodes", span)
    tops = sources.tops.select(F.lit("all").alias("source"), F.struct(F.col("source").isNotNull().alias("named"), F.col("source").alias("name")).alias("name"), "hash")
    over_leaves = materialise(placed(tops, ["name"]), "merkle-sources")
    over = grow(over_leaves, "merkle-over", span)
    top = over.tops.first()
    return Manifest(leaves, sources, over_leaves, over, top["hash"] if top else None)


# ---------------------------------------------------------------- proofs


def _step(hashes: list[str], i: int) -> str:
    """One level of a path: the place of the node in its run, then its siblings from left to right."""
    low = i - i % ARITY
    return str(i - low) + "".join(hashes[low:i]) + "".join(hashes[i + 1 : low + ARITY]) + "/"


def fold(node: str, path: str) -> str:
    """The root that a digest and the path of its place lead to."""
    for step in path.split("/")[:-1]:
        own = 1 + 64 * int(step[0])
        node = sha256((step[1:own] + node + step[own:]).encode()).hexdigest()
    return node


def path_digest(path: str) -> str:
    """H of the siblings of a path, level by level, left to right."""
    return sha256("".join(step[1:] for step in path.split("/")[:-1]).encode()).hexdigest()


def _paths_of(group: pa.Table, base: int) -> tuple[list[str], str]:
    """Paths of the nodes of level base in a stretch, by place, and the subroot; from its nodes and its topmost's path."""
    levels: dict[int, list[tuple[int, str]]] = {}
    above, subroot, leaves = "", "", 0
    for level, pos, n, node, path in zip(*(group.column(c).to_pylist() for c in ("level", "pos", "n", "hash", "path")), strict=True):
        if level is None:
            above, subroot = path, node
        else:
            levels.setdefault(level, []).append((pos, node))
            leaves = n
    paths = [above]
    if leaves > 1:
        for level in sorted(levels, reverse=True):
            hashes = [h for _, h in sorted(levels[level])]
            paths = [_step(hashes, i) + paths[i // ARITY] for i in range(len(hashes))]
    if len(paths) != len(levels.get(base, [])):
        raise ValueError(f"the node store lacks nodes below level {base + 1}")
    return paths, subroot


def _through(base: int):
    """Paths of the nodes at which the pass below begins."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        paths, subroot = _paths_of(group, base)
        pos = sorted(p for p, level in zip(group.column("pos").to_pylist(), group.column("level").to_pylist(), strict=True) if level == base)
        k = len(paths)
        return pa.table({"source": pa.array([key[0].as_py()] * k, pa.string()), "pos": pa.array(pos, pa.int64()), "path": pa.array(paths, pa.string()), "hash": pa.array([subroot] * k, pa.string())})

    return run


def _at_leaves(folded: bool):
    """The rows of leaves with their paths, or with what a path's digest and the fold of the tampered leaf are."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        paths, subroot = _paths_of(group, 0)
        rows = group.filter(pc.equal(group.column("level"), 0)).sort_by("pos")
        out = {"source": pa.array([key[0].as_py()] * len(paths), pa.string()), "pos": rows.column("pos"), "doc_id": rows.column("doc_id"), "leaf": rows.column("hash"), "subroot": pa.array([subroot] * len(paths), pa.string())}
        if folded:
            out |= {"proof_sha256": pa.array(map(path_digest, paths), pa.string()), "folded_root": pa.array(map(fold, rows.column("tampered").to_pylist(), paths), pa.string())}
        else:
            out |= {"path": pa.array(paths, pa.string())}
        return pa.table(out)

    return run


def _same(left: DataFrame, right: DataFrame, how: str, *on: str) -> DataFrame:
    """A join in which a null source is a source."""
    met = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on]
    out = left.alias("l").join(right.alias("r"), met, how)
    return out if how == "left_semi" else out.select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in on])


def _proofs(leaves: DataFrame, tree: Tree, tops: DataFrame, wanted: DataFrame | None, folded: bool, span: int = SPAN) -> DataFrame:
    """leaves (source, pos, n, doc_id, hash, tampered); tops (source, path, hash): paths of the last nodes of sources."""
    facts = ["source", "stretch", "level", "pos", "n", "hash", "path", "doc_id", "tampered"]
    none = {"path": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("long"), "tampered": F.lit(None).cast("string")}
    need = None if wanted is None else wanted.select("source", "pos").distinct()
    height, step = depth(F.col("n")), ARITY**span
    tops = _same(tops, tree.tops.select("source", "n"), "inner", "source")
    above = None
    for base in reversed(range(0, max(tree.deepest, 1), span)):
        # sources that end in this pass, and stretches whose topmost node the pass above has met
        ending = tops.where((height <= base + span) & ((height > base) | F.lit(base == 0))).select("source", F.lit(0).cast("long").alias("stretch"), "path", "hash")
        begun = ending if above is None else ending.unionByName(above.select("source", F.col("pos").alias("stretch"), "path", "hash"))
        own = tree.nodes.where((F.col("level") >= max(base, 1)) & (F.col("level") < base + span) & (F.col("level") < height))
        place = F.expr("pos div element_at(powers, level + 1)")
        own = own.withColumn("powers", F.array(*[F.lit(ARITY ** (span - max(0, level - base))) for level in range(base + span)])).withColumn("stretch", place).drop("powers").withColumns(none)
        if base == 0:
            own = own.select(facts).unionByName(leaves.select("source", F.expr(f"pos div {step}").alias("stretch"), F.lit(0).alias("level"), "pos", "n", "hash", none["path"].alias("path"), "doc_id", "tampered"))
        if need is not None:
            asked = need.select("source", F.expr(f"pos div {step * ARITY**base}").alias("stretch")).distinct()
            own, begun = _same(own, asked, "left_semi", "source", "stretch"), _same(begun, asked, "left_semi", "source", "stretch")
        tip = begun.select("source", "stretch", F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("n"), "hash", "path", none["doc_id"].alias("doc_id"), none["tampered"].alias("tampered"))
        groups = own.select(facts).unionByName(tip).groupBy("source", "stretch")
        if base:
            above = materialise(groups.applyInArrow(_through(base), "source string, pos long, path string, hash string"), "merkle-paths")
    more = "proof_sha256 string, folded_root string" if folded else "path string"
    out = groups.applyInArrow(_at_leaves(folded), f"source string, pos long, doc_id long, leaf string, subroot string, {more}")
    return out if need is None else _same(out, need, "left_semi", "source", "pos")


def _tops(manifest: Manifest, span: int) -> DataFrame:
    """(source, path, hash) of the subroots: their paths to the root."""
    named = manifest.over_leaves
    leaves = named.select(F.lit("all").alias("source"), "pos", "n", F.lit(None).cast("long").alias("doc_id"), "hash", F.lit(None).cast("string").alias("tampered"))
    start = manifest.over.tops.select("source", F.lit("").alias("path"), "hash")
    found = _proofs(leaves, manifest.over, start, None, False, span).select("pos", "path")
    return materialise(named.join(found, "pos").select(F.col("name.name").alias("source"), "path", "hash"), "merkle-tops")


def proofs(manifest: Manifest, wanted: DataFrame | None = None, span: int = SPAN) -> DataFrame:
    """(source, pos, doc_id, leaf, subroot, path) of the leaves at wanted coordinates (source, pos), or of all.

    ``fold(leaf, path)`` is the root if, and only if, the leaf is what was built over.  A path is a step a level, each
    the node's place in its run and the digests of its siblings.
    """
    return _proofs(manifest.leaves, manifest.sources, _tops(manifest, span), wanted, False, span)


def verified(manifest: Manifest, span: int = SPAN) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf, folded from the tampered text."""
    out = _proofs(manifest.leaves, manifest.sources, _tops(manifest, span), None, True, span)
    root = F.lit(manifest.root).cast("string")
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def audit(docs: DataFrame, root: str, paths: DataFrame) -> DataFrame:
    """(doc_id, leaf, verified): documents as they are now against proofs made before; null where no proof is for them."""
    now = docs.select("doc_id", leaf().alias("now"))
    check = F.udf(lambda node, path: None if path is None else fold(node, path), "string")
    met = now.join(paths.select("doc_id", "path"), now["doc_id"].eqNullSafe(paths["doc_id"]), "left").select(now["doc_id"], "now", "path")
    return met.select("doc_id", F.col("now").alias("leaf"), (check("now", "path") == root).alias("verified"))
