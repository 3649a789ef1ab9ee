"""N-gram Jaccard join by PartEnum signatures.

A document's set is its distinct word shingles (five words; whole texts, A-Z lowered), each as a 64-bit hash.  Two sets
link when 100 * |intersection| >= 80 * |union|.

Signatures.  Sizes fall into bands [l, r] with r = l / 0.8, so linked sets lie in the same or in neighbouring bands; a
set is signed under its own band's scheme and the next band's.  Within a scheme linked sets differ in at most
K = floor(2 r / 9) features.  The scheme partitions the feature domain (the range of the hash) into n1 groups of n2
parts and enumerates, in each group, the subsets of n2 - 1 parts; if (K + 1) / 2 groups or more are compared, some group
differs in one feature at most, so some subset of its parts is equal in both sets: they share that signature.  A subset
with no feature in it is no evidence and is not emitted, and one with a single feature is weak evidence that shared
passages give in plenty; groups are therefore somewhat more than (K + 1) / 2, and a set emits subsets of two features or
more if its groups are filled well enough for the argument to hold with them, else those of one feature too, else (few,
small sets) also its prefix features under the scheme, which two such sets must share (prefix filter).  Of two linked
sets, the better filled one decides which subsets must meet, and the other emits those too.  So no link is lost.

Dataflow.  One scan makes the sets and packs their signatures into blobs by signature bucket; a signature that several
sets of a slice share leaves the slice once, with star links from its smallest set to the others.  A bucket's task joins
equal signatures the same way.  Star links are checked exactly (shingle by shingle, on re-read texts of candidates
alone) and folded into components.  Then members of one signature that are still in different components are compared,
block by block, by parity sketches, which never turn away a pair that links; what passes is checked exactly: twice the
nearest of each member, then, with the components that gives, all that is left.  So no link between
different components is missed, and a large group of near copies costs few exact checks.  Equal sets are one class from the start and stand in for their documents.

Defined cases: null and empty texts, and texts without words, have no set and link with nothing; fewer than five words
are one shingle; texts of any length are taken whole; repeated rows are members of one class; a null doc_id is linked
like others but never names a component unless all its documents lack one (then the component is null); empty tables
give no rows; extra columns are ignored.  Different shingles with equal 64-bit hashes (probability about 2^-64 a pair)
count as one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import SPACE, bound_batches, components, materialise, mix64, release, sized, sub_batches, unused, word_hashes

WIDTH = 5
#: Schemes that allow so many differing features emit subsets of two features or more only, where those suffice.
LARGE = 12
NUM, DEN = 4, 5  # a similarity of 4/5
#: Bytes of text of which the signatures make one bucket.
BUCKET_TEXT = 8 << 20
#: Bytes of text whose signatures meet before they are shuffled.
SLICE_TEXT = 1 << 20
#: Ids of candidate documents that a broadcast may carry (8 bytes each), and members of a signature in one block.
MOST_BROADCAST, BLOCK = 500_000, 4096
#: Rows of the signatures with one smallest member that one task compares.
DEALT = 2048
#: Pairs that a task remembers to have named.
NAMED = 200_000
_HEAD, _LINK, _GROUP = 0, 1, 2
_ROWS = "kind byte, a long, b long, n long, id long, bucket int, blob binary"
_U = np.uint64


# ---------------------------------------------------------------- sets


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, features): sorted distinct shingle hashes of each text, one text after another."""
    counts, hashes = word_hashes(texts, lower=True)
    starts = np.concatenate([[0], np.cumsum(counts)])
    acc = np.full(len(hashes), 0x9E3779B97F4A7C15, _U)
    for j in range(width):  # position by position, over all words at once
        acc[: max(len(hashes) - j, 0)] ^= hashes[j:]
        acc *= _U(0xFF51AFD7ED558CCD)
        acc ^= acc >> _U(29)
    acc = mix64(acc)
    parts, sizes = [], np.zeros(len(counts), np.int64)
    for i, n in enumerate(counts.tolist()):
        if n >= width:
            one = np.sort(acc[starts[i] : starts[i + 1] - width + 1])
            if len(one) > 1:
                one = one[np.concatenate([[True], one[1:] != one[:-1]])]
        elif n:
            one = np.array([_short(hashes[starts[i] : starts[i + 1]])], _U)
        else:
            continue
        sizes[i] = len(one)
        parts.append(one)
    return sizes, np.concatenate(parts) if parts else np.zeros(0, _U)


def _short(hashes: np.ndarray) -> int:
    acc = np.array([len(hashes)], _U)
    for h in hashes:
        acc = mix64(acc * _U(31) ^ h)
    return int(acc[0])


def set_ids(sizes: np.ndarray, features: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; equal sets, equal ids; 0 for empty ones."""
    out = np.zeros(len(sizes), _U)
    full = np.flatnonzero(sizes)
    if len(full):
        start = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        out[full] = mix64(np.add.reduceat(mix64(features), start) ^ mix64(sizes[full].astype(_U)))
    return out.view(np.int64)


# ---------------------------------------------------------------- schemes


def bands(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper sizes of the bands up to one beyond that of size most."""
    low, high = [1], [DEN // NUM]
    while high[-1] < most:
        low.append(high[-1] + 1)
        high.append(low[-1] * DEN // NUM)
    low.append(high[-1] + 1)
    high.append(low[-1] * DEN // NUM)
    return np.array(low), np.array(high)


def scheme(high: int) -> tuple[int, int, int]:
    """(K, n1, n2) of a band: most differing features, groups, parts in a group (one part may differ)."""
    k = 2 * high // 9
    return (0, 1, 1) if k == 0 else (k, math.ceil((k + 1) / 2 * 1.2) + 1, 3)


def signatures(sizes: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, signature) of all sets; owner is the set's index."""
    owners, signs = [], []
    if not len(features):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    low, high = bands(int(sizes.max()))
    own = np.searchsorted(high, np.maximum(sizes, 1))
    start = np.concatenate([[0], np.cumsum(sizes)])
    mixed = mix64(features ^ _U(0xA5A5A5A5A5A5A5A5))
    for step in (0, 1):
        for n2 in (1, 3):
            plans = {int(b): scheme(int(high[b + step])) for b in np.unique(own[sizes > 0])}
            members = np.array([i for i in np.flatnonzero(sizes) if plans[int(own[i])][2] == n2], np.int64)
            if not len(members):
                continue
            band = own[members] + step
            k, n1 = (np.array([plans[int(b)][j] for b in own[members]], np.int64) for j in (0, 1))
            m, parts = sizes[members], n1 * n2
            where = np.repeat(start[members], m) + _ramp(m)
            feature, row = features[where], np.repeat(np.arange(len(members)), m)
            part = ((feature >> _U(32)) * parts[row].astype(_U) >> _U(32)).astype(np.int64)
            base = np.concatenate([[0], np.cumsum(parts)])
            cell = base[row] + part  # features are sorted, so cells are too
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            total = np.zeros(base[-1], _U)
            total[cell[first]] = np.add.reduceat(mixed[where], first)
            filled = np.zeros(base[-1], np.int64)
            filled[cell[first]] = np.diff(np.append(first, len(cell)))
            holder = np.repeat(np.arange(len(members)), n1)  # of each group
            tag = mix64((band[holder].astype(_U) << _U(40)) + _ramp(n1).astype(_U))
            total, filled = total.reshape(-1, n2), filled.reshape(-1, n2)
            subsets = [[0]] if n2 == 1 else [[j for j in range(n2) if j != out] for out in range(n2)]
            held = np.stack([filled[:, subset].sum(axis=1) for subset in subsets], axis=1)
            # of the features in which a linked set may differ, each group takes two
            limit = np.minimum(k, m // 4)
            sure = lambda need: np.bincount(holder, (held >= need).all(axis=1), len(members)) * 2 > limit
            strong = (k >= LARGE) & sure(2)
            need = np.where(strong, 2, 1)[holder]
            for s, subset in enumerate(subsets):
                some = held[:, s] >= need
                value = tag + _U(s + 1)
                for j in subset:
                    value = mix64(value ^ total[:, j]) + _U(j)
                owners.append(members[holder[some]])
                signs.append(mix64(value[some]))
            if n2 > 1:
                for i in np.flatnonzero(~strong & ~sure(1)):
                    at = start[members[i]]
                    prefix = features[at : at + m[i] - (NUM * m[i] + DEN - 1) // DEN + 1]
                    owners.append(np.full(len(prefix), members[i]))
                    signs.append(mix64(prefix ^ mix64(np.array([band[i] + (1 << 50)], _U))))
    return np.concatenate(owners), np.concatenate(signs)


def _ramp(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each length, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


# ---------------------------------------------------------------- signature join


def _stars(sign: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sort (signature, id) pairs, drop repeats: signatures, ids, start of each group, size of each group."""
    order = np.lexsort((ids, sign))
    sign, ids = sign[order], ids[order]
    del order
    fresh = np.ones(len(sign), bool)
    fresh[1:] = (sign[1:] != sign[:-1]) | (ids[1:] != ids[:-1])
    sign, ids = sign[fresh], ids[fresh]
    start = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]])) if len(sign) else np.zeros(0, np.int64)
    return sign, ids, start, np.diff(np.append(start, len(sign)))


def _links(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Distinct star links (smallest id, other id) of the groups."""
    big = size > 1
    if not big.any():
        return np.zeros((0, 2), np.int64)
    rest = np.repeat(start[big] + 1, size[big] - 1) + _ramp(size[big] - 1)
    return np.unique(np.stack([np.repeat(ids[start[big]], size[big] - 1), ids[rest]], axis=1), axis=0)


def _rows(kind: int, a, b=None, n=None, id=None, bucket=None, blob=None) -> pa.RecordBatch:
    size = len(a)
    fill = lambda x, t: pa.nulls(size, t) if x is None else pa.array(x, t)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, kind), pa.int8()), fill(a, pa.int64()), b if isinstance(b, pa.Array) else fill(b, pa.int64()), fill(n, pa.int64()), id if isinstance(id, pa.Array) else fill(id, pa.int64()), fill(bucket, pa.int32()), fill(blob, pa.binary())],
        names=["kind", "a", "b", "n", "id", "bucket", "blob"],
    )


def _scan(buckets: int):
    """Documents to packed rows by bucket: heads, star links and group members within the slice, and signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text", SLICE_TEXT):
            sizes, features = shingle_sets(batch.column("text"))
            ids = set_ids(sizes, features)
            ends = np.cumsum(sizes)
            sketches = [sketch(features[e - n : e], 2).tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield _rows(_HEAD, ids, b=batch.column("mark"), n=sizes, id=batch.column("doc_id"), bucket=-1 - np.abs(ids % buckets), blob=sketches)
            _, once = np.unique(ids, return_index=True)  # equal sets of the slice sign once
            kept = np.zeros(len(sizes), bool)
            kept[once] = True
            sizes_once, features_once = np.where(kept, sizes, 0), features[np.repeat(kept, sizes)]
            owner, sign = signatures(sizes_once, features_once)
            bucket = (sign % _U(buckets)).astype(np.int64)
            # 39 bits beside the bucket's number, and one that says that a group met here
            key = ((sign >> _U(24)) & _U((1 << 39) - 1)).astype(np.int64) | (bucket << 39)
            key, member, start, size = _stars(key, ids[owner])
            link = _links(member, start, size)
            many = np.repeat(size > 1, size)
            if len(link):
                spread = -1 - np.abs(link[:, 0] % buckets)
                yield _rows(_LINK, link[:, 0], b=link[:, 1], bucket=spread)
                yield _rows(_GROUP, key[many], b=member[many], bucket=-1 - (key[many] >> 39))
            yield _pack(key[start], member[start], size > 1)

    return run


def _pack(key: np.ndarray, member: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
    """One row a bucket: sets (8 bytes each), signatures of each (a count), and the signatures (5 bytes each)."""
    if not len(key):
        return _rows(3, np.zeros(0, np.int64), bucket=np.zeros(0, np.int64), blob=[])  # a slice of texts without words
    order = np.lexsort((member, key >> 39))
    key, member, met = key[order], member[order], met[order]
    bucket = key >> 39
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    value = (((key & ((1 << 39) - 1)) << 1) | met).astype("<u8")
    low, top = value.astype("<u4"), (value >> _U(32)).astype(np.uint8)
    blobs = []
    for s, e in zip(cut, np.append(cut[1:], len(key)), strict=True):
        m = member[s:e]
        head = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        blobs.append(np.uint32(len(head)).tobytes() + m[head].astype("<i8").tobytes() + np.diff(np.append(head, len(m))).astype("<u4").tobytes() + low[s:e].tobytes() + top[s:e].tobytes())
    return _rows(3, np.zeros(len(blobs), np.int64), bucket=bucket[cut], blob=blobs)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    ids = np.frombuffer(blob, "<i8", n, 4)
    count = np.frombuffer(blob, "<u4", n, 4 + 8 * n)
    total = int(count.sum())
    low = np.frombuffer(blob, "<u4", total, 4 + 12 * n)
    top = np.frombuffer(blob, np.uint8, total, 4 + 12 * n + 4 * total)
    value = low.astype(np.int64) | (top.astype(np.int64) << 32)
    return value >> 1, (value & 1).astype(bool), np.repeat(ids, count)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition sorted by bucket: pass on packed rows, join the signatures of each bucket."""

    def flush() -> Iterator[pa.RecordBatch]:
        if not blobs:
            return
        # blobs go as they are unpacked, and nothing is held twice: this is where a task holds most
        blobs.reverse()
        keys, members, marks = [], [], []
        while blobs:
            k, met, m = _unpack(blobs.pop())
            keys.append(k)
            members.append(m)
            marks.append(k[met])
        marked = np.unique(np.concatenate(marks))
        del marks, k, m, met
        key = np.concatenate(keys)
        keys.clear()
        member = np.concatenate(members)
        members.clear()
        key, member, start, size = _stars(key, member)
        link = _links(member, start, size)
        if len(link):
            yield _rows(_LINK, link[:, 0], b=link[:, 1])
        # of two sets that met only here, the star is all; members of larger groups go on
        more = (size > 2) | ((size > 1) & np.isin(key[start], marked))
        more = np.repeat(more, size)
        if more.any():
            yield _rows(_GROUP, key[more] | (at << 39), b=member[more])

    at, blobs = -1, []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        if (kind != 3).any():
            yield batch.filter(pa.array(kind != 3))
        buckets, column = batch.column("bucket"), batch.column("blob")
        for i in np.flatnonzero(kind == 3).tolist():
            if (bucket := buckets[i].as_py()) != at:
                yield from flush()
                at = bucket
            blobs.append(column[i].as_py())
    yield from flush()
    release()


# ---------------------------------------------------------------- exact check


def _candidate_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches, "text", SLICE_TEXT):
        sizes, features = shingle_sets(batch.column("text"))
        ids, ends = set_ids(sizes, features), np.cumsum(sizes)
        blobs = [features[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(blobs, pa.binary())], names=["a", "features"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * |intersection| >= 80 * |union| of two sorted arrays of distinct features."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or DEN * len(a) < NUM * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("fa"), batch.column("fb")
        ok = [linked(np.frombuffer(left[i].as_buffer(), _U), np.frombuffer(right[i].as_buffer(), _U)) for i in range(batch.num_rows)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _checked(pairs: DataFrame, heads: DataFrame, docs: DataFrame, many: bool = False) -> DataFrame:
    """The pairs (a, b) of set ids whose sets link: exactly, shingle by shingle.

    Sets are made anew from the text of one document for each.  Few documents are asked for by a broadcast of their
    ids, whose number is counted first; more by a shuffle.  Many doubtful pairs first pass finer sketches.
    """
    pairs = materialise(pairs, "jaccard-pairs")
    ids = pairs.select("a").union(pairs.select("b")).distinct().join(heads, "a").select(F.col("id").alias("_id")).distinct()
    asked = materialise(ids, "jaccard-asked")
    asked = F.broadcast(asked) if asked.count() <= MOST_BROADCAST else asked
    found = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    # rows that repeat, or that have no doc_id, make a set more than once; a pair needs it once
    sets = materialise(found.select("text").mapInArrow(_candidate_sets, "a long, features binary").dropDuplicates(["a"]), "jaccard-sets")
    if many:
        pairs = materialise(_likely(pairs, sets.mapInArrow(_sketch_rows, "a long, n long, sketch binary")), "jaccard-pairs")
    one = sets.withColumnRenamed("features", "fa")
    other = sets.select(F.col("a").alias("b"), F.col("features").alias("fb"))
    links = pairs.join(one, "a").join(other, "b").select("a", "b", "fa", "fb").mapInArrow(_verify, "a long, b long")
    return materialise(links.distinct(), "jaccard-links")


# ---------------------------------------------------------------- members of a signature in different components


def sketch(features: np.ndarray, share: int) -> np.ndarray:
    """Parities of the numbers of features that fall on each of (a power of two of at least share x size) bits, as words.

    Two sets differ in as many features, at least, as their sketches differ in bits; halves of a sketch xor to the
    sketch of half the bits.
    """
    bits = max(64, 1 << (share * max(len(features), 1) - 1).bit_length())
    count = np.bincount((mix64(features) & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8)).view(_U)


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x, _U) for x in batch.column("features").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array([len(x) for x in sets], pa.int64()), pa.array([sketch(x, 8).tobytes() for x in sets], pa.binary())], names=["a", "n", "sketch"])


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = [batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")]
        ok = []
        for na, nb, sa, sb in zip(*d, strict=True):
            fits = DEN * min(na, nb) >= NUM * max(na, nb)
            if fits:
                x, y = np.frombuffer(sa, _U), np.frombuffer(sb, _U)
                width = min(len(x), len(y))
                fits = int(np.bitwise_count(_fold(x, width) ^ _fold(y, width)).sum()) * 9 <= na + nb
            ok.append(fits)
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sizes and sketches (a, n, sketch) allow a link."""
    one = sketches.select("a", F.col("n").alias("na"), F.col("sketch").alias("sa"))
    other = sketches.select(F.col("a").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_may_link, "a long, b long")


def _fold(words: np.ndarray, width: int) -> np.ndarray:
    while len(words) > width:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _differing(x: np.ndarray, y: np.ndarray, sketches: list[np.ndarray]) -> np.ndarray:
    """Bits in which the sketches of rows x and y differ, pair by pair, at the width of the narrower."""
    width = np.array([len(k) for k in sketches])
    narrow = np.minimum(width[x], width[y])
    out = np.zeros(len(x), np.int64)
    for w in np.unique(narrow):
        pick = np.flatnonzero(narrow == w)
        used, at = np.unique(np.concatenate([x[pick], y[pick]]), return_inverse=True)
        bits = np.stack([_fold(sketches[r], int(w)) for r in used])
        left, right = at[: len(pick)], at[len(pick) :]
        step = max(1, (8 << 20) // (8 * int(w)))
        for s in range(0, len(pick), step):
            out[pick[s : s + step]] = np.bitwise_count(bits[left[s : s + step]] ^ bits[right[s : s + step]]).sum(axis=1, dtype=np.int64)
    return out


def _near(top: int):
    """Rows (low, share, i, j, a, c, n, sketch, side, g) in order of the first four, g a list, to pairs of members that may
    link, and their signatures.

    Pairs lie in different components (and different blocks, where i is not j), fit in size and have sketches that
    allow a link.  With top, only so many for each member of a signature: those whose sketches differ least.  Rows that
    come out: (true, a, b) for pairs, mostly once in a task, and (false, g, 0) for signatures that had one.
    """
    named: set[tuple[int, int]] = set()

    def settle(whole: pa.Table) -> pa.RecordBatch:
        lists = whole.column("g").combine_chunks()
        of = np.repeat(np.arange(whole.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        g = lists.flatten().to_numpy()
        order = np.lexsort((g, _runs(whole)[of]))
        of, g = of[order], g[order]
        d = {"g": g} | {c: whole.column(c).to_numpy()[of] for c in ("i", "j", "a", "c", "n", "side")}
        sketches = [np.frombuffer(k, _U) for k in whole.column("sketch").to_pylist()]
        new = np.concatenate([[True], (d["g"][1:] != d["g"][:-1]) | (d["i"][1:] != d["i"][:-1]) | (d["j"][1:] != d["j"][:-1])])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(new))[np.cumsum(new) - 1]  # of each row's group
        pairs, groups, row = [], [], 0
        while row < len(new):
            # as many rows as give about 300,000 pairs
            last = row + max(1, int(np.searchsorted(np.cumsum((end - np.arange(len(new)) - 1)[row : row + 100_000]), 300_000)))
            rows = np.arange(row, min(last, len(new)))
            row = last
            m = end[rows] - rows - 1
            x = np.repeat(rows, m)
            y = x + 1 + _ramp(m)
            ok = (d["c"][x] != d["c"][y]) & ((d["i"][x] == d["j"][x]) | (d["side"][x] != d["side"][y]))
            ok &= DEN * np.minimum(d["n"][x], d["n"][y]) >= NUM * np.maximum(d["n"][x], d["n"][y])
            x, y = x[ok], y[ok]
            differ = _differing(of[x], of[y], sketches)
            ok = differ * 9 <= d["n"][x] + d["n"][y]
            x, y, differ = x[ok], y[ok], differ[ok]
            groups.append(np.unique(d["g"][x]))
            if top and len(x):
                one, other = np.concatenate([x, y]), np.concatenate([y, x])
                by = np.lexsort((d["a"][other], np.concatenate([differ, differ]), one))
                one, other = one[by], other[by]
                first = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
                nth = np.arange(len(one)) - np.repeat(first, np.diff(np.append(first, len(one))))
                x, y = one[nth < top], other[nth < top]
            p, q = d["a"][x], d["a"][y]
            pairs.append(np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1), axis=0))
        pair, group = np.unique(np.concatenate(pairs), axis=0), np.unique(np.concatenate(groups))
        fresh = [p not in named for p in map(tuple, pair.tolist())]
        pair = pair[np.array(fresh, bool)]
        if len(named) > NAMED:
            named.clear()
        named.update(map(tuple, pair.tolist()))
        a, b = np.concatenate([pair[:, 0], group]), np.concatenate([pair[:, 1], np.zeros(len(group), np.int64)])
        is_pair = np.arange(len(a)) < len(pair)
        return pa.RecordBatch.from_arrays([pa.array(is_pair), pa.array(a), pa.array(b)], names=["pair", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += len(batch.column("g").flatten())
            if count < 20_000:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            number = _runs(whole)
            cut = int(np.searchsorted(number, number[-1]))  # the last deal may go on
            if not cut:
                continue
            yield settle(whole.slice(0, cut))
            rest = whole.slice(cut).combine_chunks()
            held, count = rest.to_batches(), len(rest.column("g").combine_chunks().flatten())
        if count:
            yield settle(pa.Table.from_batches(held).combine_chunks())

    return run


def _runs(rows: pa.Table) -> np.ndarray:
    """The number of each row's deal: rows alike in low, share, i and j lie together."""
    change = np.zeros(rows.num_rows, bool)
    for c in ("low", "share", "i", "j"):
        key = rows.column(c).to_numpy()
        change[1:] |= key[1:] != key[:-1]
    return np.cumsum(change)


def _cross_pairs(group: DataFrame, sketches: DataFrame, top: int) -> DataFrame:
    """(pair, a, b) of groups (g, a, c), by blocks of BLOCK members; larger groups as pairs of blocks.

    Signatures with one smallest member, a family, mostly have the same others.  Where all members of a family make no
    more pairs than its signatures do one by one, they are compared as one group, so a member goes to a task once however
    many signatures it shares.  Other families go by signature, a member once a task with the list of its signatures
    there; those with more than DEALT rows in all are dealt to several tasks.  A pair that several tasks name is made one
    by whoever reads this.
    """
    signs = group.groupBy("g").agg(F.count(F.lit(1)).alias("members"), F.min("a").alias("low"))
    held = group.join(signs, "g").groupBy("low", "a", "c").agg(F.collect_list(F.struct("g", "members")).alias("signs"))
    held = materialise(held, "jaccard-held")
    blocks = lambda members: F.ceil(members / BLOCK).cast("int")
    pairs = F.aggregate("signs", F.lit(0).cast("long"), lambda n, x: n + x["members"] - 1)
    rows = F.aggregate("signs", F.lit(0).cast("long"), lambda n, x: n + F.ceil(x["members"] / BLOCK))
    families = held.groupBy("low").agg(F.count(F.lit(1)).alias("size"), F.sum(pairs).alias("pairs"), F.ceil(F.sum(rows) / DEALT).alias("shares"), F.max(F.array_max("signs.members")).alias("most"))
    whole = F.col("size") * (F.col("size") - 1) <= F.col("pairs")
    # a family's own number is negative, those of signatures are not
    own = F.col("low").bitwiseOR(F.lit(-(1 << 63)))
    families = families.select("low", "size", "shares", whole.alias("whole"), ((F.col("shares") == 1) & (F.col("most") <= BLOCK)).alias("small"))
    dealt = held.join(families, "low")
    # a family with a likely pair stands for all its signatures, which its smallest member has
    stands = dealt.where("whole and a = low").select(own.alias("own"), F.explode("signs.g").alias("sign"))
    deal = lambda share, members, g: F.struct(share.cast("long").alias("share"), blocks(members).alias("blocks"), g.alias("g"))
    deals = (
        F.when(F.col("whole"), F.array(deal(F.lit(0), F.col("size"), F.array(own))))
        .when(F.col("small"), F.array(deal(F.lit(0), F.lit(1), F.col("signs.g"))))
        .otherwise(F.transform("signs", lambda x: deal(F.pmod(F.xxhash64(x["g"]), F.col("shares")), x["members"], F.array(x["g"]))))
    )
    dealt = dealt.select("low", "a", "c", F.inline(deals)).groupBy("low", "share", "blocks", "a", "c").agg(F.flatten(F.collect_list("g")).alias("g"))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("low", "share", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "a", "c", "side", "g")
    dealt = dealt.join(sketches, "a").select("low", "share", "i", "j", "a", "c", "n", "sketch", "side", "g")
    near = dealt.repartition("low", "share", "i", "j").sortWithinPartitions("low", "share", "i", "j").mapInArrow(_near(top), "pair boolean, a long, b long")
    return near.join(stands, ~F.col("pair") & (F.col("a") == F.col("own")), "left").select("pair", F.coalesce("sign", "a").alias("a"), "b")


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (a, n, id, mark), the set, size, doc_id and hash of the text of every row of docs (doc_id, text, mark), and
    sets (a, c, id): the component and the smallest doc_id of every set that is not empty."""
    docs, total = sized(docs, "jaccard-input")
    buckets = min(max(16, total // BUCKET_TEXT * 4), 1 << 24)  # a bucket's number has 24 bits
    packed = docs.mapInArrow(_scan(buckets), _ROWS)
    # a few buckets a task, dealt evenly: a task then fetches and sorts some 10 MB
    parts = min(max(8, buckets // 4), 50_000)
    met = packed.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket").mapInArrow(_meet, _ROWS).drop("bucket")
    met = materialise(met, "jaccard", "kind")
    rows = met.where(f"kind = {_HEAD}").select("a", "n", "id", F.col("b").alias("mark"), F.col("blob").alias("sketch"))
    heads = materialise(rows.where("n > 0").groupBy("a").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "jaccard-heads")
    rows = rows.drop("sketch")
    star = materialise(met.where(f"kind = {_LINK}").select("a", "b").distinct(), "jaccard-star")
    links = _checked(_likely(star, heads), heads, docs)
    parts = materialise(components(links, "jaccard-components"), "jaccard-parts")

    # members of a signature that the star left in different components: twice the nearest of each, then all
    group = materialise(met.where(f"kind = {_GROUP}").select(F.col("a").alias("g"), F.col("b").alias("a")).distinct(), "jaccard-groups")
    tested = star
    for top in (1, 1, 0):
        placed = group.join(parts.withColumnRenamed("node", "a"), "a", "left").select("g", "a", F.coalesce("component", "a").alias("c"))
        apart = placed.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("members")).where("low < high and members > 2").select("g")
        apart = materialise(placed.join(apart, "g", "left_semi"), "jaccard-apart")
        if apart.isEmpty():
            break
        near = materialise(_cross_pairs(apart, heads.select("a", "n", "sketch"), top), "jaccard-near", "pair")
        # signatures without a likely pair have none later either
        group = apart.select("g", "a").join(near.where("not pair").select(F.col("a").alias("g")).distinct(), "g", "left_semi")
        pairs = materialise(near.where("pair").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "jaccard-fresh")
        if pairs.isEmpty():
            continue
        tested = tested.unionByName(pairs)
        more = _checked(pairs, heads, docs, many=not top)
        if not more.isEmpty():
            links = links.unionByName(more)
            parts = materialise(components(links, "jaccard-components"), "jaccard-parts")

    named = heads.join(parts.withColumnRenamed("node", "a"), "a", "left").select("a", F.coalesce("component", "a").alias("c"), "id")
    return rows, named


def _narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    bound_batches(docs.sparkSession)
    rows, named = _grouped(_narrow(docs, id_col, text_col))
    # the smallest doc_id of a component names it
    least = named.groupBy("c").agg(F.min("id").alias("component_id"))
    labels = named.join(least, "c").select("a", "component_id")
    return rows.where("n > 0").join(labels, "a").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id").unionByName(
        rows.where("n = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents without their near copies: one row of each component stays, with all its columns.

    It is a row of the smallest doc_id (null last), of several texts of that doc_id one by a fixed rule; rows alike in
    doc_id and text (told apart by 64 bits of a hash) count as one.  So a row stays or goes by its own text, whatever
    else its doc_id stands on.  Rows without words are linked with nothing: all stay.
    """
    bound_batches(docs.sparkSession)
    own = unused(docs, "jaccard_row")
    key = lambda doc_id, mark: F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), F.lit(":"), mark.cast("string"))
    rows, named = _grouped(_narrow(docs))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "a", "mark")).alias("w")
    stays = rows.where("n > 0").join(named.select("a", "c"), "a").groupBy("c").agg(first).select(key(F.col("w.id"), F.col("w.mark")).alias(own))
    worded = F.coalesce(F.col("text").rlike(f"[^{SPACE}]"), F.lit(False))
    some = docs.where(worded).withColumn(own, key(F.col("doc_id"), F.xxhash64("text"))).join(stays, own, "left_semi").dropDuplicates([own]).drop(own)
    return some.unionByName(docs.where(~worded))
