"""Exact deduplication against a minimal perfect hash of historical distinct digests.

The index of the history is split into buckets by the digest's first bits (digests are distinct, so buckets are even
whatever the data).  Each bucket holds a minimal perfect hash of its digests, built level by level: at each level a key
takes the position its seeded hash names if no other key of the level wants it, and the rest go on to the next level.
The rank of a key's bit among all levels' bits is its slot; slots hold the full 32-byte digest and the locator (the
smallest doc_id) of the winner, with the number of rows.  A lookup goes to the one slot that a digest can have and
compares all its bytes, so a digest that is not a member never passes.  Members are repeats of their slot's winner;
nonmembers are grouped among themselves by digest.

Defined cases: a null text counts as empty; empty texts equal each other; texts of any length are hashed whole; rows
that repeat a doc_id and its text are the same document and all report the same decision; a null doc_id loses against
every other and, if alone, keeps itself (keep_id null); extra columns are ignored by ``decide`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import SPACE, materialise, mix64, unused

#: Positions per key at each level of the perfect hash.
GAMMA = 1.5
#: Digests per bucket that the index aims at.
BUCKET_KEYS = 4096
NO_ID = 2**63 - 1
#: A digest with more rows than this, and than one row in HOT_SHARE, does not meet its rows in one task.
HOT_ROWS, HOT_SHARE = 256, 50_000

_INDEX = "bucket int, n int, sizes array<int>, bits binary, digests binary, locators binary, counts binary"
_FOUND = "digest binary, member boolean, winner long, n long"


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def _level_hash(lo: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(lo + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)


def build_mphf(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """keys: distinct digests as uint64 rows (n, 4).  Returns the level sizes and the bits of all levels.

    Keys that agree in the word a level hashes part by the next words in turn, so the build ends for distinct keys.
    """
    left, sizes, levels, level = np.arange(len(keys)), [], [], 0
    while len(left):
        size = max(64, int(len(left) * GAMMA))
        at = _level_hash(keys[left, level % 4] ^ mix64(keys[left, (level + 1) % 4]), level, size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        left, level = left[~alone[at]], level + 1
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool)


def mphf_slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key: exact for members; any slot or -1 for others."""
    rank = np.cumsum(bits) - 1
    out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        if not len(left):
            break
        at = base + _level_hash(keys[left, level % 4] ^ mix64(keys[left, (level + 1) % 4]), level, size)
        hit = bits[at]
        out[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    return out


def _words(column: pa.Array) -> np.ndarray:
    """A binary column of 32-byte values as uint64 rows (n, 4)."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, 4)


def _build_bucket(group: pa.Table) -> pa.Table:
    group = group.combine_chunks()
    keys = _words(group.column("digest"))
    sizes, bits = build_mphf(keys)
    slot = mphf_slots(keys, sizes, bits)
    back = np.argsort(slot)
    assert len(slot) == 0 or (slot[back] == np.arange(len(slot))).all()
    take = lambda name: group.column(name).to_numpy()[back].astype("<i8").tobytes()
    return pa.table(
        {
            "bucket": pa.array([group.column("bucket")[0].as_py()], pa.int32()), "n": pa.array([len(keys)], pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int32())),
            "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()), "digests": pa.array([keys[back].tobytes()], pa.binary()), "locators": pa.array([take("winner")], pa.binary()), "counts": pa.array([take("n")], pa.binary()),
        }
    )


def _look_up(left: pa.Table, right: pa.Table) -> pa.Table:
    """left: new digests of a bucket; right: the bucket's index row, if any.  What the slots hold, with their members, then the nonmembers."""
    left = left.combine_chunks()
    if not right.num_rows:
        return _found(left.column("digest").to_pylist(), np.zeros(left.num_rows, bool), left.column("winner").to_numpy(), left.column("n").to_numpy())
    row = right.to_pylist()[0]
    held = np.frombuffer(row["digests"], "<u8").reshape(-1, 4)
    winner, n = np.frombuffer(row["locators"], "<i8").copy(), np.frombuffer(row["counts"], "<i8").copy()
    digest = [row["digests"][32 * i : 32 * i + 32] for i in range(len(held))]
    if left.num_rows:
        keys, new_winner, new_n = _words(left.column("digest")), left.column("winner").to_numpy(), left.column("n").to_numpy()
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(row["sizes"])].astype(bool)
        slot = mphf_slots(keys, row["sizes"], bits)
        member, asked = np.zeros(len(keys), bool), np.flatnonzero(slot >= 0)
        member[asked] = (held[slot[asked]] == keys[asked]).all(axis=1)
        got = slot[member]  # left's digests are distinct, so are these
        winner[got] = np.minimum(winner[got], new_winner[member])
        n[got] += new_n[member]
        digest += [d for d, m in zip(left.column("digest").to_pylist(), member.tolist(), strict=True) if not m]
        winner, n = np.concatenate([winner, new_winner[~member]]), np.concatenate([n, new_n[~member]])
    return _found(digest, np.arange(len(digest)) < len(held), winner, n)


def _found(digest, member, winner, n) -> pa.Table:
    return pa.table({"digest": pa.array(digest, pa.binary()), "member": pa.array(member, pa.bool_()), "winner": pa.array(winner, pa.int64()), "n": pa.array(n, pa.int64())})


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of every row; digest is the SHA-256 of the normalised text in UTF-8."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("digest"))


def _distinct(rows: DataFrame, buckets: int) -> DataFrame:
    """A row for each digest, pre-aggregated before the shuffle: bucket, winner, number of rows."""
    bucket = F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    return rows.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("winner"), F.count(F.lit(1)).alias("n")).select(bucket.alias("bucket"), "digest", "winner", "n")


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The perfect-hash index of a history of (doc_id, digest) rows: one row for each bucket."""
    return _distinct(history, buckets).groupBy("bucket").applyInArrow(_build_bucket, _INDEX)


def look_up(new: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """A row for each digest of the history's slots and each nonmember among new (doc_id, digest) rows: in the history or not, winner, rows in both."""
    return _distinct(new, buckets).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_look_up, _FOUND)


def bucket_count(rows: int) -> int:
    return max(1, -(-rows // BUCKET_KEYS))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, in_history) for every row of docs.

    The history is the lower half of the range of doc_id, as an earlier crawl would be; the rest is looked up in its
    index.  The split changes the path a row takes, not the result: the winner is the smallest doc_id of equal texts.
    """
    rows = materialise(digests(docs, id_col, text_col), "dedup-digests")
    low, high, count = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    middle = 0 if low is None else (low + high) // 2
    buckets = bucket_count(count)
    old, new = rows.where(F.col("doc_id") <= middle), rows.where(F.col("doc_id").isNull() | (F.col("doc_id") > middle))
    index = materialise(build_index(old, buckets), "dedup-index")
    # a slot speaks for the history's rows and for members, so a digest has one row
    groups = materialise(look_up(new, index, buckets).select("digest", F.col("member").alias("in_history"), "winner", F.col("n").alias("group_size")), "dedup-groups")
    # fewer than HOT_SHARE digests can have more than count / HOT_SHARE rows each: those go by a bounded broadcast
    is_hot = F.col("group_size") > max(HOT_ROWS, count // HOT_SHARE)
    hot = F.broadcast(groups.where(is_hot))
    told = rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(groups.where(~is_hot), "digest"))
    keep_id = F.when(F.col("winner") != NO_ID, F.col("winner"))
    return told.select(
        "doc_id", keep_id.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "in_history"
    )


def keep(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; a document given twice with one doc_id stays once.

    A document is its doc_id and text: where one doc_id stands on several texts, each text stays or goes by itself.
    A row without doc_id stays once, if no row with a doc_id has its text.
    """
    own = unused(docs, "document")
    key = lambda digest, doc_id: F.concat(digest, F.lit(":"), F.coalesce(doc_id.cast("long").cast("string"), F.lit("")))
    kept = decide(docs).where("kept").select(key(F.col("text_sha256"), F.col("doc_id")).alias(own)).distinct()
    digest = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    return docs.withColumn(own, key(digest, F.col("doc_id"))).join(kept, own, "left_semi").dropDuplicates([own]).drop(own)
