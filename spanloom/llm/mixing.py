"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; a document of the source is to be copied target / source size times on
average.  The whole part of that is taken as it is; the fractions are rounded dependently: two documents meet, and mass
(words, so that the source's sum never moves) is transferred from one to the other at random until one of them is a
whole number; that one is settled and the other meets the next.  A block of documents leaves one unsettled document,
and blocks combine their residuals in a reduction tree of fan-in FAN_IN until a source has one document left, which is
rounded to the nearer whole.  So a source's taken words differ from its target by half a document at most.

Randomness is a hash of (seed, level, row), a row being its doc_id, text and number among rows alike in both; blocks are
hashes of the row too and rows are sorted in a block.  So reruns agree whatever the partitions, and rows without doc_id,
or of one doc_id, or alike in all, are dealt to as many blocks as any others.

Defined cases: a null text has no words; documents without words take nothing; a null source is a source of its own,
last; empty table: no rows; repeated rows are rounded one by one; a source of no words has target 0; extra columns are
kept by ``mix`` and ignored by ``decide``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import materialise, mix64, unused, word_count

#: Fixed by the contract of the query: weights by order of the source, share of all words, most copies of a document.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Documents in a first block, and residuals that one step of the tree combines.
BLOCK_ROWS = 4096
FAN_IN = 256

_SCHEMA = "doc_id long, source string, size long, mark long, key long, copies long, open double, block long"
#: Rows alike that one generated row stands for until they are numbered.
ALIKE = 10_000


def targets(sizes: list[tuple[str | None, int]], share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> dict[str | None, float]:
    """Target words of each source.  Sources by code point, null last, weigh in turn; none gets over most x its size.

    What a full source cannot take is shared by weight among the others, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, left, out = dict(order), share * sum(n for _, n in order), {}
    open_ = [s for s, _ in order]
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = most * size[s]
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def pivot(size: np.ndarray, part: np.ndarray, luck: np.ndarray) -> tuple[np.ndarray, int]:
    """Round the fractions ``part`` so that sum(size * part) stays: 0 or 1 for all but one, whose index is returned (-1: none).

    luck: a uniform number for each row, used when the row meets the one still open.
    """
    out, held = np.zeros(len(part)), -1
    for j in range(len(part)):
        p = part[j]
        if p <= 1e-12 or p >= 1 - 1e-12:
            out[j] = round(p)
            continue
        if held < 0:
            held, out[j] = j, p
            continue
        i, a, b, q = held, size[held], size[j], out[held]
        up = min((1 - q) * a, p * b)  # words that can go from j to i
        down = min(q * a, (1 - p) * b)  # and from i to j
        if luck[j] * (up + down) < down:
            q, p, moved = q + up / a, p - up / b, up
        else:
            q, p, moved = q - down / a, p + down / b, down
        assert moved >= 0
        out[i], out[j] = q, p
        whole_i, whole_j = q <= 1e-12 or q >= 1 - 1e-12, p <= 1e-12 or p >= 1 - 1e-12
        if whole_i:
            out[i] = round(q)
        if whole_j:
            out[j] = round(p)
        held = -1 if whole_i and whole_j else j if whole_i else i
    return out, held


def _combine(last: bool, level: int, seed: int):
    def run(group: pa.Table) -> pa.Table:
        key, size, part, copies = (group.column(c).to_numpy() for c in ("key", "size", "open", "copies"))
        order = np.lexsort((part, key, -size))
        luck = mix64(key.astype(np.uint64) ^ mix64(np.array([seed * 1_000_003 + level], np.uint64))) / 2.0**64
        done, held = pivot(size[order], part[order], luck[order])
        if held >= 0 and last:
            done[held], held = float(done[held] >= 0.5), -1
        left = np.full(len(order), np.nan)
        if held >= 0:
            left[held], done[held] = done[held], 0
        own = group.take(pa.array(order))
        return pa.table({c: own.column(c) for c in ("doc_id", "source", "size", "mark", "key")} | {"copies": pa.array(copies[order] + done.astype(np.int64), pa.int64()), "open": pa.array(left, pa.float64(), mask=np.isnan(left)), "block": own.column("block")})

    return run


def decide(docs: DataFrame, seed: int = 7, size: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source, mark) of every document; taken = copies x size.

    ``mark`` is a hash of the text; rows alike in doc_id, source, size and mark get as many decisions as they are.
    """
    words = word_count(F.col("text")) if size is None else size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), F.xxhash64("text").alias("mark"))
    alike = rows.groupBy("doc_id", "source", "size", "mark").agg(F.count(F.lit(1)).alias("n"))
    some = alike.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {ALIKE}"))))
    each = some.withColumn("nth", F.explode(F.sequence(F.col("first") * ALIKE, F.least(F.col("n"), (F.col("first") + 1) * ALIKE) - 1)))
    return _decide(materialise(each.select("doc_id", "source", "size", "mark", F.xxhash64("doc_id", "mark", "nth").alias("key")), "mix-rows"), seed)


def _decide(rows: DataFrame, seed: int) -> DataFrame:
    """decide() of rows (doc_id, source, size, mark, key) that lie in files."""
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).collect()  # one row for each source
    target = targets([(r["source"], r["source_size"]) for r in by_source])
    plan = rows.sparkSession.createDataFrame(
        [(r["source"], r["source_size"], target[r["source"]], target[r["source"]] / r["source_size"] if r["source_size"] else 0.0, max(1, -(-r["n"] // BLOCK_ROWS))) for r in by_source],
        "source_name string, source_size long, target double, rate double, blocks long",
    )
    rows = rows.join(F.broadcast(plan) if len(by_source) <= 100_000 else plan, F.col("source").eqNullSafe(F.col("source_name"))).drop("source_name")
    whole = F.floor(F.col("rate") + 1e-12)
    start = rows.select("doc_id", "source", "size", "mark", "key", F.when(F.col("size") > 0, whole).otherwise(0).cast("long").alias("copies"), F.when(F.col("size") > 0, F.greatest(F.col("rate") - whole, F.lit(0.0))).otherwise(0.0).alias("open"), F.pmod("key", "blocks").alias("block"))
    most = max([1, *(-(-r["n"] // BLOCK_ROWS) for r in by_source)])
    level, settled, open_ = 0, None, start
    while True:
        step = materialise(open_.groupBy("source", "block").applyInArrow(_combine(most == 1, level, seed), _SCHEMA), f"mix-level{level}")
        done = step.where("open is null").drop("open", "block")
        settled = done if settled is None else settled.unionByName(done)
        if most == 1:
            break
        level, most = level + 1, math.ceil(most / FAN_IN)
        open_ = step.where("open is not null").withColumn("block", F.floor(F.col("block") / FAN_IN).cast("long"))
    known = plan.select("source_name", "source_size", "target")
    return settled.join(F.broadcast(known) if len(by_source) <= 100_000 else known, F.col("source").eqNullSafe(F.col("source_name"))).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "mark"
    )


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mixture itself: each document as often as it is copied, with all its columns; documents taken 0 times go.

    Rows alike in doc_id, source and text are numbered, and each takes one of the decisions made for them; so what the
    mixture takes is what was decided, row by row.
    """
    key, nth, copies, copy = (unused(docs, c) for c in ("mix_key", "mix_nth", "mix_copies", "mix_copy"))
    named = lambda doc_id, source, size, mark: F.to_json(F.struct(doc_id.cast("long").alias("d"), source.cast("string").alias("s"), size.alias("n"), mark.alias("m")))
    chosen = decide(docs, seed).where("copies > 0").groupBy(named(F.col("doc_id"), F.col("source"), F.col("size"), F.col("mark")).alias(key), "copies").agg(F.count(F.lit(1)).alias("n"))
    # copies of a key are two numbers at most, each with its count; rows take them in turn
    chosen = chosen.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("copies", "n")), False).alias(copies))
    keyed = docs.withColumn(key, named(F.col("doc_id"), F.col("source"), word_count(F.col("text")), F.xxhash64("text"))).join(chosen, key)
    numbered = keyed.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1))))
    first = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("mine"))
    mine = lambda acc, x: F.struct((acc["upto"] + x["n"]).alias("upto"), F.when((F.col(nth) > acc["upto"]) & (F.col(nth) <= acc["upto"] + x["n"]), x["copies"]).otherwise(acc["mine"]).alias("mine"))
    return _repeated(numbered, F.aggregate(copies, first, mine, lambda acc: acc["mine"]), copy, docs.columns)


def _repeated(rows: DataFrame, times: Column, copy: str, columns: list[str]) -> DataFrame:
    """Each row so many times."""
    some = rows.withColumn(copy, times.cast("int")).where(F.col(copy) > 0)
    return some.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).select(*[F.col(f"`{c}`") for c in columns])
