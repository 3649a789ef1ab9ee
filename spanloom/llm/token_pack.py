"""Token ids in packed files: each id in the fewest bits that hold the vocabulary, read at random by block offsets.

``write`` deals documents to tasks by ranges of doc_id, encodes them there and streams them into files, so neither ids
nor texts are written in between; ``read`` is a Python data source with a partition for each file, and ``windows`` reads
runs of ids at given places of the whole sequence, as a training loader does.

A file holds blocks of BLOCK ids, then tables, then a footer of fixed length:

    blocks    ids in little-endian bit order, ``bits`` bits each; a block begins at a byte
    tables    int64 doc_id, uint8 doc_id is null, uint64 end of the document among the file's ids (a row a document);
              uint64 offset of a block, and of the end of the last; uint32 CRC-32 of a block's bytes
    footer    magic, version, bits, ids in a block, documents, ids, place of the tables

so the bytes of an id are found without reading anything before it, and a block is unpacked by a few NumPy operations on
whole arrays.  A reader checks magic, lengths and the CRC of each block that it takes, and raises on a file that is cut.

Encoding.  The tokenizers library encodes about 0.8 MB of text in a second, so equal parts of texts are encoded once.  A
byte-level tokenizer with its usual pattern never joins a character that is no white space with white space after it:
texts are cut there, distinct parts are found by a dictionary, those a worker has not met yet are encoded together by
the library, as one text again, and its ids are dealt back to the parts by the bytes they spell.  The ids are those of
the whole text.  Other tokenizers (a normalizer, another pattern, tokens with white space) encode whole texts.

Order: doc_id ascending, null first; rows of one doc_id by a hash of the text.  Ranges also split rows of one doc_id.

Files are named by task attempt and put in place by a rename; readers use the list of files that the tasks returned, so
a retried task leaves no double documents.  Files go through pyarrow's file systems by URI.

Defined cases: null and empty texts are the end id alone; texts of any length are encoded whole; repeated rows are
stored each; empty tables write no file and give no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spanloom.llm.common import gathered, materialise, plan_bytes, release, scratch_dir, text_bytes

MAGIC, VERSION = b"SLTOKENS", 1
FOOTER, FOOTER_BYTES = "<8sIIIQQQ", 44
#: Ids in a block (a multiple of 8), and ids in a file at which the writer begins another.
BLOCK, FILE_IDS = 8192, 16 << 20
#: Bytes of the optimiser's estimate that one writing task gets.
TASK_BYTES = 24 << 20
#: Bytes of text that are cut and encoded at once, and parts that a worker remembers; it forgets all when there are more.
SLICE_BYTES, MOST_PARTS = 8 << 20, 1_000_000
END_ID = 2
FILES = "part int, ord int, file string, docs long, ids long"
DOCUMENTS = "file string, doc long, doc_id long, start long, n_tokens long, ids array<int>, ids_crc32 long"


# ---------------------------------------------------------------- bits


def bits_of(vocabulary: int) -> int:
    """The fewest bits that hold every id of a vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in little-endian bit order; the last byte is filled up with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype("<u4").reshape(-1, 1).view(np.uint8)).reshape(len(ids), 4)
    return np.packbits(np.unpackbits(spread, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    """The first count ids of packed bytes."""
    if len(data) * 8 < count * bits:
        raise ValueError(f"{len(data)} bytes hold no {count} ids of {bits} bits")
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


# ---------------------------------------------------------------- encoding


def _among(characters: str | list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) if isinstance(c, str) else c for c in characters]] = True
    return out


#: White space before which a cut may be, letters, and marks before which a cut may be after a letter.
_BLANK, _MARK = _among("\t\n\v\f\r "), _among('.,;:!?)"')
_LETTER = _among([*range(65, 91), *range(97, 123)])
#: ASCII that is no white space of any kind.
_FULL = _among([*range(9), *range(14, 28), *range(33, 128)])
#: What a byte is, as bits: 1 white space, 2 sure to be none, 4 an ASCII letter, 8 the second byte of a character, 16 the
#: first byte of a letter from U+00C0 on.
_KIND = (_BLANK + 2 * _FULL + 4 * _LETTER + 8 * _among(range(0x80, 0xC0)) + 16 * _among(range(0xC3, 0xE0))).astype(np.uint8)
_BLANKS, _FULLS = frozenset(np.flatnonzero(_BLANK).tolist()), frozenset(np.flatnonzero(_FULL).tolist())


def _cuts(offsets: np.ndarray, data: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Places at which texts may be cut: their starts and ends, white space after a character that surely is none, and a
    mark after a letter."""
    at = np.zeros(len(data) + 1, bool)
    at[offsets] = True
    if len(data) > 1:
        kind = _KIND[data]
        sure = kind & 2
        sure[1:] |= (kind[1:] >> 2) & (kind[:-1] >> 3)
        at[1:-1] |= ((sure[:-1] >> 1) & kind[1:] & 1).view(bool)
        marks = np.flatnonzero(mark[data[1:]])
        at[marks[kind[marks] & 4 > 0] + 1] = True
    return np.flatnonzero(at)


class Encoder:
    """A tokenizer file of the tokenizers library, with the ids of parts that were met before."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            text = f.read()
        self.tokenizer = Tokenizer.from_buffer(text)
        facts = json.loads(text)
        added = facts.get("added_tokens") or []
        kind = facts.get("pre_tokenizer") or {}
        self.in_parts = (
            facts.get("normalizer") is None and kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in added)
        )
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.mark = _MARK & ~_among([b for t in added for b in t["content"].encode()])
        self.forget()
        if self.in_parts:
            own = {t["id"] for t in added}
            self.spelled = np.zeros(self.vocabulary, np.int64)
            for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
                self.spelled[i] = len(token.encode()) if i in own else len(token)  # a byte is one character in the others

    def forget(self) -> None:
        """Begin with no parts: number i has the ids bounds[i] to bounds[i + 1] of flat."""
        self.known: dict[bytes, int] = {}
        self.flat, self.bounds = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def _append(self, parts: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        n, base = len(self.known), self.bounds[len(self.known)]
        while base + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(parts) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.flat[base : base + len(ids)] = ids
        self.bounds[n + 1 : n + 1 + len(parts)] = base + ends
        self.known.update(zip(parts, range(n, n + len(parts)), strict=True))

    def _learn(self, parts: list[bytes]) -> None:
        """Ids of parts, all new: those with a safe cut on both sides as one text, the others each by itself."""
        inner, alone = [], []
        for p in parts:
            (inner if p[0] in _BLANKS and (p[-1] in _FULLS or (len(p) > 1 and p[-1] >= 0x80 and 0xC3 <= p[-2] <= 0xDF)) else alone).append(p)
        if alone:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in alone], add_special_tokens=False)]
            self._append(alone, np.concatenate([np.array(x, np.uint32) for x in lists]), np.cumsum([len(x) for x in lists]))
        for at in range(0, len(inner), 4096):
            some = inner[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(some).decode()], add_special_tokens=False)[0].ids, np.uint32)
            self._append(some, ids, np.searchsorted(np.cumsum(self.spelled[ids]), np.cumsum([len(p) for p in some]), side="right"))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids): the ids of all texts in a row, and where each text's end; null is empty."""
        if not self.in_parts:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.cumsum([len(x) for x in lists], dtype=np.int64), np.concatenate([np.array(x, np.uint32) for x in lists] or [np.zeros(0, np.uint32)])
        offsets, data = text_bytes(texts)
        cuts = _cuts(offsets, data, self.mark)
        if len(cuts) < 2:
            return np.zeros(len(texts), np.int64), np.zeros(0, np.uint32)
        parts = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype("<i8").tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
        own, spelling = text_bytes(parts.dictionary)
        spelling, own = spelling.tobytes(), own.tolist()
        names = [spelling[i:j] for i, j in zip(own[:-1], own[1:], strict=True)]
        if len(self.known) + len(names) > MOST_PARTS:
            self.forget()
        if new := [p for p in names if p not in self.known]:
            self._learn(new)
        number = np.array([self.known[p] for p in names])[parts.indices.to_numpy(zero_copy_only=False)]
        start = self.bounds[number]
        size = self.bounds[number + 1] - start
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(start - ends + size, size) + np.arange(ends[-1])]
        return np.concatenate([[0], ends])[np.searchsorted(cuts, offsets[1:])], ids


def _encoder(path: str) -> Encoder:
    """The encoder of this worker process: it lives on from task to task, with the parts it knows."""
    kept = vars(sys.modules.setdefault("spanloom-encoders", ModuleType("spanloom-encoders")))
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


# ---------------------------------------------------------------- files


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Writer:
    """One file, written from front to end."""

    def __init__(self, fs: pafs.FileSystem, folder: str, bits: int, block: int) -> None:
        self.fs, self.folder, self.bits, self.block = fs, folder, bits, block
        self.name = uuid.uuid4().hex
        self.out = fs.open_output_stream(f"{folder}/{self.name}.open")
        self.rest = np.zeros(0, np.uint32)
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.offsets, self.crcs, self.ids = [0], [], 0

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))
        self.crcs.append(zlib.crc32(data))

    def add(self, docs: np.ndarray, nulls: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> None:
        """Documents with the ends of each among ids."""
        self.docs.append(docs)
        self.nulls.append(nulls)
        self.ends.append(ends + self.ids)
        self.ids += len(ids)
        every = np.concatenate([self.rest, ids])
        whole = len(every) // self.block * self.block
        for at in range(0, whole, self.block):
            self._put(every[at : at + self.block])
        self.rest = every[whole:].copy()

    def close(self) -> tuple[str, int, int]:
        """(file, documents, ids), the file in its place."""
        if len(self.rest):
            self._put(self.rest)
        docs = np.concatenate(self.docs)
        for column, kind in ((docs, "<i8"), (np.concatenate(self.nulls), "u1"), (np.concatenate(self.ends), "<u8"), (self.offsets, "<u8"), (self.crcs, "<u4")):
            self.out.write(np.asarray(column).astype(kind).tobytes())
        self.out.write(struct.pack(FOOTER, MAGIC, VERSION, self.bits, self.block, len(docs), self.ids, self.offsets[-1]))
        self.out.close()
        self.fs.move(f"{self.folder}/{self.name}.open", f"{self.folder}/{self.name}.tokens")
        return f"{self.name}.tokens", len(docs), self.ids


class Shard:
    """A file opened for reading: its tables are read, its blocks only when asked for."""

    def __init__(self, path: str) -> None:
        fs, at = _open_fs(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        if size < FOOTER_BYTES:
            raise ValueError(f"{path} is no file of token ids")
        magic, version, self.bits, self.block, self.docs, self.n_ids, tables = struct.unpack(FOOTER, self.file.read_at(FOOTER_BYTES, size - FOOTER_BYTES))
        blocks = -(-self.n_ids // self.block) if self.block else 0
        if magic != MAGIC or version != VERSION or tables + 17 * self.docs + 12 * blocks + 8 + FOOTER_BYTES != size:
            raise ValueError(f"{path} is no whole file of token ids")
        data = self.file.read_at(size - FOOTER_BYTES - tables, tables)
        at = 0

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.null = column("<i8", self.docs), column("u1", self.docs).astype(bool)
        self.ends = column("<u8", self.docs).astype(np.int64)
        self.offsets, self.crcs = column("<u8", blocks + 1).astype(np.int64), column("<u4", blocks)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file; only the blocks that hold them are read."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        base = self.offsets[first]
        data = self.file.read_at(int(self.offsets[last + 1] - base), int(base))
        out = []
        for b in range(first, last + 1):
            own = data[self.offsets[b] - base : self.offsets[b + 1] - base]
            if zlib.crc32(own) != self.crcs[b]:
                raise ValueError(f"block {b} is not what was written")
            out.append(unpack(own, min(self.block, self.n_ids - b * self.block), self.bits))
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file."""
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def close(self) -> None:
        self.file.close()


def _writing(folder: str, tokenizer: str, end_id: int, file_ids: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, made = _encoder(tokenizer), None, []
        bits = bits_of(max(encoder.vocabulary, end_id + 1))
        fs, at = _open_fs(folder)
        for batch in gathered(batches, "text", SLICE_BYTES):
            ends, ids = encoder.encode(batch.column("text"))
            ids = np.insert(ids, ends, np.uint32(end_id))
            ends = ends + np.arange(1, len(ends) + 1)
            if out is None:
                fs.create_dir(at, recursive=True)
                out = _Writer(fs, at, bits, block)
            docs = batch.column("doc_id")
            out.add(pc.fill_null(docs, 0).to_numpy(zero_copy_only=False).astype(np.int64), docs.is_null().to_numpy(zero_copy_only=False), ends, ids)
            if out.ids >= file_ids:
                made.append(out.close())
                out = None
        if out is not None:
            made.append(out.close())
        release()
        if made:
            part = TaskContext.get().partitionId()
            names, n_docs, n_ids = zip(*made, strict=True)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(made), pa.int32()), "ord": pa.array(range(len(made)), pa.int32()), "file": pa.array(names), "docs": pa.array(n_docs, pa.int64()), "ids": pa.array(n_ids, pa.int64())})

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, file_ids: int = FILE_IDS, block: int = BLOCK) -> DataFrame:
    """Encode docs (doc_id, text) into files under folder; returns (file, docs, ids, start) of each, already written.

    ``start`` counts the ids of all files before, so it places a file in the whole sequence.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    parts = max(1, -(-plan_bytes(rows) // TASK_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    files = materialise(ranged.select("doc_id", "text").mapInArrow(_writing(folder, tokenizer, end_id, file_ids, block), FILES), "token-files")
    before = Window.orderBy("part", "ord").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return materialise(files.select("file", "docs", "ids", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start")), "token-list")


# ---------------------------------------------------------------- reading


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class TokenReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.with_ids = options["path"], str(options.get("ids", "true")).lower() != "false"

    def partitions(self) -> list[InputPartition]:
        fs, at = _open_fs(self.folder)
        found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
        return [_File(f"{self.folder.rstrip('/')}/{f.base_name}") for f in sorted(found, key=lambda f: -f.size) if f.base_name.endswith(".tokens")] or [_File("")]

    def read(self, partition: _File):
        if not partition.path:
            return
        shard = Shard(partition.path)
        name = partition.path.rpartition("/")[2]
        starts = np.concatenate([[0], shard.ends[:-1]]) if shard.docs else shard.ends
        i = 0
        while i < shard.docs:
            # documents of about a million ids at once, one at least
            j = max(i + 1, int(np.searchsorted(shard.ends, starts[i] + (1 << 20), side="right")))
            ids, base = shard.ids(int(starts[i]), int(shard.ends[j - 1])).astype("<u4"), int(starts[i])
            raw = memoryview(ids).cast("B")
            crcs = [zlib.crc32(raw[4 * (s - base) : 4 * (e - base)]) for s, e in zip(starts[i:j].tolist(), shard.ends[i:j].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts[i:j], shard.ends[j - 1]) - base, pa.int32()), pa.array(ids.view("<i4"))) if self.with_ids else pa.nulls(j - i, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (j - i)), pa.array(np.arange(i, j)), pa.array(shard.doc_ids[i:j], pa.int64(), mask=shard.null[i:j]), pa.array(starts[i:j], pa.int64()), pa.array(shard.ends[i:j] - starts[i:j], pa.int64()), lists, pa.array(crcs, pa.int64())],
                names=["file", "doc", "doc_id", "start", "n_tokens", "ids", "ids_crc32"],
            )
            i = j
        shard.close()


class TokenSource(DataSource):
    """``spark.read.format("tokens").option("ids", "false").load(folder)``: a row a document, start within its file."""

    @classmethod
    def name(cls) -> str:
        return "tokens"

    def schema(self) -> str:
        return DOCUMENTS

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options)


def read(spark: SparkSession, folder: str, files: DataFrame, ids: bool = True) -> DataFrame:
    """Documents of the files that ``write`` listed, start counted over all files; without ``ids`` their lists are null."""
    spark.dataSource.register(TokenSource)
    found = spark.read.format("tokens").option("ids", str(ids).lower()).load(folder)
    return found.join(files.select("file", F.col("start").alias("base")), "file").withColumn("start", F.col("start") + F.col("base")).drop("base")


def _fetching(folder: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = Shard(f"{folder.rstrip('/')}/{key[0].as_py()}")
        d = table.to_pydict()
        lists = [shard.ids(a, b).astype("<i4") for a, b in zip(d["low"], d["high"], strict=True)]
        shard.close()
        return pa.table({"at": pa.array(d["at"], pa.int64()), "low": pa.array([f + a for f, a in zip(d["base"], d["low"], strict=True)], pa.int64()), "ids": pa.array(lists, pa.list_(pa.int32()))})

    return run


def windows(folder: str, files: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(at, ids): for each distinct place of wanted (at), up to length ids of the whole sequence from there on.

    Places meet files by equi-joins on pieces of the sequence as long as a file and a window at most may be; a task opens
    a file once for a salted share of its windows and reads the blocks they lie in, nothing else.
    """
    piece = max(FILE_IDS, length)
    on = lambda low, high: F.explode(F.sequence(F.expr(f"({low}) div {piece}"), F.expr(f"({high}) div {piece}"))).alias("piece")
    spans = files.where("ids > 0").select("file", F.col("start").alias("base"), (F.col("start") + F.col("ids")).alias("end"), on("start", "start + ids - 1"))
    asked = wanted.select(F.col("at").cast("long").alias("at")).where("at >= 0").distinct().select("at", on("at", f"at + {length - 1}"))
    met = asked.join(spans, "piece").select("at", "file", "base", F.greatest("at", "base").alias("low"), F.least(F.col("at") + length, "end").alias("high")).where("low < high").distinct()
    met = met.select("at", "file", "base", (F.col("low") - F.col("base")).alias("low"), (F.col("high") - F.col("base")).alias("high"), F.pmod(F.xxhash64("at"), F.lit(16)).alias("salt"))
    got = met.groupBy("file", "salt").applyInArrow(_fetching(folder), "at long, low long, ids array<int>")
    return got.groupBy("at").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("low", "ids"))), lambda x: x["ids"])).alias("ids"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write documents as packed ids and read the files: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = scratch_dir(spark, "tokens")
    files = write(docs, folder, tokenizer, end_id)
    return read(spark, folder, files, ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
