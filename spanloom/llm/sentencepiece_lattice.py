"""SentencePiece encoding and decoding over a relational lattice.

The vocabulary and its scores come from a given .model file; nothing is trained.  A text is encoded as the sequence of
pieces with the largest sum of scores (the Viterbi path of SentencePiece's unigram segmentation; for a vocabulary whose
scores are merge ranks, as in BPE models, this is the best path under those scores, not the merge order's).  A space is
the mark U+2581, a mark is put before the text, characters that no piece spells become byte pieces, and of paths with
equal sums the one whose last piece is longer wins, at each place.

Relations.  A text falls into words: it is cut wherever no piece contains the two characters that meet there, so no
path is lost.  One scan writes the corpus as a bucketed table of slices: a row lists a slice's distinct words by hash
bucket, and its documents as numbers of these words.  In a bucket the distinct words are exploded into their substrings of
bounded length, equi-joined with the piece table (broadcast: a vocabulary is bounded), edges are grouped by word and
folded to the best path by a higher-order aggregate that keeps sums and back-pointers.  The paths go to the slices, and
the slices' documents are spelled out where they lie: neither texts nor documents are shuffled, and the scan is made
once, so words and documents of a slice cannot differ.

Words of more than LONG characters (they have no safe cut between bytes) are cut once more between characters, and folded
in the scan by the same rule in linear time (``Vocabulary.viterbi``), with the same result.

Defined cases: null and empty texts have no pieces and decode to the empty text; texts of any length are encoded whole;
U+2581 in a text decodes as a space, as in SentencePiece; repeated rows are encoded each; a null doc_id stays null;
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import bucketed, from_bytes, gathered, release, sized, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: SentencePiece lowers the smallest score by this for a character that no piece spells.
UNKNOWN_PENALTY = 10.0
LONG = 200
#: Bytes of text in a slice: one row of the scratch table, and the work of one Python call.
SLICE_BYTES = 7 << 20
_NORMAL, _UNUSED, _BYTE, _USER = 1, 5, 6, 4


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + n]
            at += n


@dataclass(frozen=True)
class Vocabulary:
    """pieces[i] = (text, score, type) of piece i."""

    pieces: tuple[tuple[str, float, int], ...]

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        with open(path, "rb") as f:
            data = f.read()
        out = []
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                out.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, _NORMAL)))
        return cls(tuple(out))

    @cached_property
    def table(self) -> dict[str, tuple[int, float]]:
        return {p: (i, float(s)) for i, (p, s, kind) in enumerate(self.pieces) if kind in (_NORMAL, _USER)}

    @cached_property
    def byte_ids(self) -> list[int]:
        at = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == _BYTE}
        unknown = next((i for i, (_, _, kind) in enumerate(self.pieces) if kind == 2), 0)
        return [at.get(f"<0x{b:02X}>", unknown) for b in range(256)]

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.table), default=1)

    @cached_property
    def unknown_score(self) -> float:
        return min((s for _, s in self.table.values()), default=0.0) - UNKNOWN_PENALTY

    @cached_property
    def spelled(self) -> list[bytes]:
        """The bytes that each piece decodes to."""
        return [bytes([int(p[3:5], 16)]) if kind == _BYTE else p.replace(MARK, " ").encode() if kind in (_NORMAL, _USER, _UNUSED) else b"" for p, _, kind in self.pieces]

    @cached_property
    def joins(self) -> np.ndarray:
        """joins[a, b]: some piece has bytes a and b of UTF-8 (a space for the mark) side by side, or b is inside a character."""
        out = np.zeros((256, 256), bool)
        out[:, 0x80:0xC0] = True
        for p in self.table:
            b = p.replace(MARK, " ").encode()
            for x, y in zip(b, b[1:], strict=False):
                out[x, y] = True
        return out

    @cached_property
    def pairs(self) -> set[str]:
        """Pairs of characters that some piece has side by side."""
        return {p[i : i + 2] for p in self.table for i in range(len(p) - 1)}

    def viterbi(self, word: str) -> list[int]:
        """The best path of a word of any length in one pass; the definition that the relational fold follows."""
        n = len(word)
        best, back = [0.0] + [0.0] * n, [(0, ())] * (n + 1)
        for end in range(1, n + 1):
            found = None
            for start in range(max(0, end - self.longest), end):
                hit = self.table.get(word[start:end])
                if hit is None:
                    if end - start > 1:
                        continue
                    step, ids = self.unknown_score, tuple(self.byte_ids[b] for b in word[start:end].encode())
                else:
                    step, ids = hit[1], (hit[0],)
                if found is None or best[start] + step > found:
                    found, back[end] = best[start] + step, (start, ids)
            best[end] = found
        out, at = [], n
        while at:
            at, ids = back[at]
            out.append(ids)
        return [i for ids in reversed(out) for i in ids]


# ---------------------------------------------------------------- words of slices


def _text(x: str) -> pa.Scalar:
    return pa.scalar(x, pa.large_string())


def words_of(texts: pa.Array, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(words per text, 32-bit number of each word, distinct words).  Spaces are still spaces; each text begins with one more."""
    texts = pc.replace_substring(from_bytes(*text_bytes(texts)), MARK, " ")
    offsets, data = text_bytes(pc.if_else(pc.equal(texts, _text("")), _text(""), pc.binary_join_element_wise(_text(" "), texts, _text(""))))
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        cut[1:-1] = ~joins[data[:-1], data[1:]]
    cut[offsets] = True
    at = np.flatnonzero(cut)
    per_text = np.searchsorted(at, offsets)
    at = at if len(data) else np.zeros(1, np.int64)
    flat = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype("<i8").tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    words = flat.dictionary.cast(pa.large_string()).to_pylist()
    return np.diff(per_text), flat.indices.to_numpy(zero_copy_only=False), words


def _finer(word: str, pairs: set[str]) -> list[str]:
    """A long word cut wherever no piece has its two characters side by side."""
    at = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in pairs), len(word)]
    return [word[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def pack_words(words: list[str]) -> tuple[bytes, int]:
    """Words as sizes and bytes, compressed; and the number of bytes before."""
    raw = [w.encode() for w in words]
    data = np.uint32(len(raw)).tobytes() + np.array([len(w) for w in raw], "<u2").tobytes() + b"".join(raw)
    return pa.compress(data, "zstd", asbytes=True), len(data)


def unpack_words(blob: bytes, size: int) -> pa.Array:
    data = pa.decompress(blob, size, "zstd", asbytes=True)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(data, "<u2", n, 4).astype(np.int64))
    return from_bytes(np.concatenate([[0], ends]), np.frombuffer(data, np.uint8, offset=4 + 2 * n))


def _planes(x: np.ndarray) -> bytes:
    """Byte planes of 32-bit numbers: small numbers leave planes of zeros, which compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).reshape(-1).view("<u4")


_LIST = pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary()), ("size", pa.int64())]))
_SLICE = "slice long, lists array<struct<bucket: int, words: binary, size: bigint>>, ids array<bigint>, blob binary, size long"


def _slice(number: int, batch: pa.RecordBatch, vocabulary: Vocabulary, buckets: int) -> pa.RecordBatch:
    """One row: the slice's distinct words by bucket, and its documents as numbers of these words.

    Words are numbered in the order of the lists, long ones last; a permutation in the blob makes frequent words small
    numbers, which compress well.
    """
    counts, codes, words = words_of(batch.column("text"), vocabulary.joins)
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets if len(w) <= LONG else buckets for w in words), np.int64, len(words))
    # sorted, so that lists compress well and the order is the words' own
    order = pc.sort_indices(pa.table({"bucket": bucket, "word": pa.array(words, pa.large_string())}), [("bucket", "ascending"), ("word", "ascending")]).to_numpy()
    start = np.searchsorted(bucket[order], np.arange(buckets + 1))
    words = [words[i] for i in order]
    some = np.flatnonzero(np.diff(start))
    packed = [pack_words(words[start[b] : start[b + 1]]) for b in some]
    lists = [{"bucket": b, "words": p, "size": n} for b, (p, n) in zip(some.tolist(), packed, strict=True)]
    place = np.empty(len(words), np.int32)
    place[order] = np.arange(len(words))
    often = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # from frequency's number to word
    rank = np.empty(len(words), np.int32)
    rank[often] = np.arange(len(words))
    long = [np.array([i for w in _finer(w.replace(" ", MARK), vocabulary.pairs) for i in vocabulary.viterbi(w)], "<u4") for w in words[start[buckets] :]]
    crc = [zlib.crc32(t) for t in pc.fill_null(batch.column("text").cast(pa.large_binary()), b"").to_pylist()]
    long_ids = np.concatenate(long) if long else np.zeros(0, "<u4")
    head = np.array([len(counts), len(words), len(long), len(long_ids), len(codes)], "<u4")
    plain = [head, counts.astype("<u4"), np.array(crc, "<u4"), np.array([len(x) for x in long], "<u4"), long_ids]
    data = b"".join(x.astype("<u4").tobytes() for x in plain) + _planes(place[often].astype("<u4")) + _planes(rank[codes].astype("<u4"))
    ids = pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([lists], _LIST), ids, pa.array([pa.compress(data, "zstd", asbytes=True)], pa.binary()), pa.array([len(data)], pa.int64())], names=["slice", "lists", "ids", "blob", "size"])


def _cut(vocabulary: Vocabulary, buckets: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for place, batch in enumerate(gathered(batches, "text", size)):
            yield _slice(part << 24 | place, batch, vocabulary, buckets)
            release()

    return run


def _distinct(blobs: list[bytes], sizes: list[int]) -> pa.Array:
    """The distinct words of a bucket's lists, in order; a word's number is its place."""
    found = pc.unique(pa.concat_arrays([unpack_words(b, n) for b, n in zip(blobs, sizes, strict=True)]))
    return found.take(pc.sort_indices(found))


def _distinct_words(listed: pa.Table) -> pa.Table:
    """(bucket, number, word): the distinct words of a bucket."""
    found = _distinct(listed.column("words").to_pylist(), listed.column("size").to_pylist())
    return pa.table({"bucket": pa.array(np.full(len(found), listed.column("bucket")[0].as_py()), pa.int32()), "number": pa.array(np.arange(len(found)), pa.int32()), "word": found.cast(pa.string())})


# ---------------------------------------------------------------- lattice


def piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    return spark.createDataFrame([(p, i, s) for p, (i, s) in vocabulary.table.items()], "piece string, id int, score double")


def encode_words(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(bucket, number, ids) of distinct words (bucket, number, word), by the lattice of their substrings."""
    spark = words.sparkSession
    marked = words.where("word <> ''").select("bucket", "number", F.translate("word", " ", MARK).alias("marked"), F.length("word").alias("n"))
    starts = marked.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
    spans = starts.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(vocabulary.longest), F.col("n") - F.col("start")))).alias("size"))
    spans = spans.select("bucket", "number", "start", "size", F.substring("marked", F.col("start") + 1, F.col("size")).alias("piece"))
    edges = spans.join(F.broadcast(piece_table(spark, vocabulary)), "piece", "left").where("id is not null or size = 1")
    # an edge: end and start in one number, so that sorting orders by end, then start; minus a code point for no piece
    edge = F.struct(((F.col("start") + F.col("size")) * 1024 + F.col("start")).alias("at"), F.coalesce("id", -F.ascii("piece")).alias("id"), F.coalesce("score", F.lit(vocabulary.unknown_score)).alias("score"))
    grouped = edges.groupBy("bucket", "number").agg(F.sort_array(F.collect_list(edge)).alias("edges"))

    # state: best sums of the places done and back-pointers to them, and place, sum and back-pointer of the one at hand
    start = F.struct(F.array().cast("array<double>").alias("sums"), F.array().cast("array<struct<begin:int,id:int>>").alias("backs"), F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.struct(F.lit(0).alias("begin"), F.lit(0).alias("id")).alias("back"))

    def push(acc, x):
        end, begin = F.shiftright(x["at"], 10), x["at"].bitwiseAND(F.lit(1023))
        back = F.struct(begin.alias("begin"), x["id"].alias("id")).alias("back")

        def state(sums, backs, total):
            return F.struct(sums.alias("sums"), backs.alias("backs"), end.alias("at"), total.alias("sum"), back)

        total = F.get(acc["sums"], begin) + x["score"]
        same = F.when(total > acc["sum"], state(acc["sums"], acc["backs"], total)).otherwise(acc)
        # the first edge to a place closes the one before, which may be where it starts
        before = F.when(begin == acc["at"], acc["sum"]).otherwise(F.get(acc["sums"], begin)) + x["score"]
        return F.when(end == acc["at"], same).otherwise(state(F.array_append(acc["sums"], acc["sum"]), F.array_append(acc["backs"], acc["back"]), before))

    def walk(acc):
        """The pieces from the last place back to the first, in order."""
        first = F.struct(acc["back"]["begin"].alias("at"), F.array(acc["back"]["id"]).alias("ids"))
        step = lambda got, i: F.when(i == got["at"], F.struct(F.get(acc["backs"], i)["begin"].alias("at"), F.array_append(got["ids"], F.get(acc["backs"], i)["id"]).alias("ids"))).otherwise(got)
        back = F.aggregate(F.sequence(acc["at"] - 1, F.lit(1), F.lit(-1)), first, step, lambda got: F.reverse(got["ids"]))
        return F.when(acc["at"] > 1, back).otherwise(F.array(acc["back"]["id"]))

    spelled = grouped.select("bucket", "number", F.aggregate("edges", start, push, walk).alias("ids"))
    # characters that no piece spells, as the pieces of their bytes
    as_bytes = lambda c: F.transform(F.filter(F.split(F.regexp_replace(F.hex(F.encode(F.decode(F.unhex(F.lpad(F.hex(-c), 8, "0")), "UTF-32"), "UTF-8")), "(..)", "$1 "), " "), lambda h: h != ""), lambda h: F.element_at(F.lit(vocabulary.byte_ids), F.conv(h, 16, 10).cast("int") + 1))
    spread = F.flatten(F.transform("ids", lambda i: F.when(i < 0, as_bytes(i)).otherwise(F.array(i))))
    return spelled.select("bucket", "number", F.when(F.exists("ids", lambda i: i < 0), spread).otherwise(F.col("ids")).alias("ids"))


def _answer(listed: pa.Table, known: pa.Table) -> pa.Table:
    """Paths of the words that each slice listed in a bucket: numbers of pieces and pieces, packed."""
    release()
    blobs, raws = listed.column("words").to_pylist(), listed.column("size").to_pylist()
    words = _distinct(blobs, raws)
    known = known.combine_chunks().sort_by("number")
    if not np.array_equal(known.column("number").to_numpy(), np.arange(len(words))):
        raise ValueError("a listed word has no path")
    lists = known.column("ids").combine_chunks() if isinstance(known.column("ids"), pa.ChunkedArray) else known.column("ids")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    rows = []
    for blob, raw in zip(blobs, raws, strict=True):
        w = pc.index_in(unpack_words(blob, raw), value_set=words).to_numpy(zero_copy_only=False).astype(np.int64)
        m = size[w]
        ids = flat[np.repeat(start[w], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
        rows.append((pa.compress(m.astype("<u2").tobytes(), "zstd", asbytes=True), 2 * len(m), pa.compress(_planes(ids.astype("<u4")), "zstd", asbytes=True), 4 * len(ids)))
    return pa.table({"number": listed.column("slice"), "bucket": listed.column("at"), "sizes": pa.array([r[0] for r in rows], pa.binary()), "n": pa.array([r[1] for r in rows], pa.int64()), "ids": pa.array([r[2] for r in rows], pa.binary()), "raw": pa.array([r[3] for r in rows], pa.int64())})


_OUT = "doc_id long, n_pieces long, ids array<int>, text_crc32 long, decoded_crc32 long"


def _spell(vocabulary: Vocabulary):
    spelled = vocabulary.spelled

    def run(docs: pa.Table, paths: pa.Table) -> pa.Table:
        """A slice's documents, as its row has them, and the paths of its words by bucket."""
        release()  # what the slice before has left
        order = np.argsort(paths.column("bucket").to_numpy(), kind="stable")
        columns = [paths.column(c).to_pylist() for c in ("sizes", "n", "ids", "raw")]
        sizes = [np.frombuffer(pa.decompress(columns[0][i], columns[1][i], "zstd", asbytes=True), "<u2") for i in order]
        ids = [_unplanes(pa.decompress(columns[2][i], columns[3][i], "zstd", asbytes=True)) for i in order]
        row = docs.to_pylist()
        if len(row) != 1:
            raise ValueError("a slice is one row")
        data = pa.decompress(row[0]["blob"], row[0]["size"], "zstd", asbytes=True)
        n, n_words, n_long, n_ids, n_codes = np.frombuffer(data, "<u4", 5).tolist()
        at, parts = 20, []
        for m in (n, n, n_long, n_ids):
            parts.append(np.frombuffer(data, "<u4", m, at))
            at += 4 * m
        counts, crc, long_sizes, long_ids = parts
        # 32-bit places halve the memory of what follows: a slice has far fewer than 2^31 pieces
        often = _unplanes(data[at : at + 4 * n_words]).astype(np.int32)
        size = np.concatenate([*sizes, long_sizes]).astype(np.int32)
        if len(size) != n_words:
            raise ValueError("a listed word has no path")
        flat = np.concatenate([*ids, long_ids])
        codes = often[_unplanes(data[at + 4 * n_words :])] if n_codes else np.zeros(0, np.int32)
        del data
        m = size[codes]
        ends = np.concatenate([[0], np.cumsum(m, dtype=np.int64)])
        shift = (np.cumsum(size, dtype=np.int64) - size)[codes] - ends[:-1]
        place = np.repeat(shift.astype(np.int32), m)
        place += np.arange(ends[-1], dtype=np.int32)
        spelt = flat[place].astype(np.int32)
        cut = ends[np.concatenate([[0], np.cumsum(counts.astype(np.int64))])]
        del place, shift, m, codes, flat
        found = [zlib.crc32(b"".join([spelled[i] for i in spelt[a:b].tolist()])[1:]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table({"doc_id": pa.array(row[0]["ids"], pa.int64()), "n_pieces": pa.array(np.diff(cut), pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(spelt)), "text_crc32": pa.array(crc.astype(np.int64)), "decoded_crc32": pa.array(found, pa.int64())})

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids, text_crc32, decoded_crc32) of every row of docs.

    The two checksums are of the text and of what the pieces decode to; they are equal unless the text has U+2581.
    """
    docs, total = sized(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "pieces-input")
    size = max(SLICE_BYTES, min(64 << 20, total // 100_000))
    buckets = max(32, min(total // (2 << 20), 2048 + total // (4 << 30)))
    slices = bucketed(docs.mapInArrow(_cut(vocabulary, buckets, size), _SLICE), "pieces-slices", "slice", max(8, min(50_000, total // size + 1)))
    # one shuffle deals the lists, which are read twice, and one their distinct words, before these are exploded
    listed = slices.select("slice", F.explode("lists").alias("x")).select("slice", "x.bucket", "x.words", "x.size").repartitionById(buckets, F.col("bucket"))
    words = listed.groupBy("bucket").applyInArrow(_distinct_words, "bucket int, number int, word string").repartitionById(buckets, F.col("bucket"))
    asked = listed.select(F.col("bucket").alias("at"), "slice", "words", "size")
    paths = asked.groupBy("at").cogroup(encode_words(words, vocabulary).groupBy("bucket")).applyInArrow(_answer, "number long, bucket int, sizes binary, n long, ids binary, raw long")
    return slices.select("slice", "ids", "blob", "size").groupBy("slice").cogroup(paths.groupBy("number")).applyInArrow(_spell(vocabulary), _OUT)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""
    spelled = vocabulary.spelled

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join([spelled[i] for i in ids or []])[1:].decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
