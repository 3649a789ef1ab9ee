"""WARC archives as a PySpark Python data source (short name ``warc``), with a writer and revisit records.

Reading: one partition for each archive file; record-type and header predicates are pushed down (equality, IN, NULL and
string-prefix tests on columns of the WARC header); a record's header is parsed first, and the block of a record that
is not wanted is skipped by its Content-Length without being decoded.  With option ``payload=false`` no block is read.

Writing: ``write_pages`` makes one file for each task, and more where they would be large.  A file holds plain WARC/1.1 headers; a response's block is an
HTTP response whose body may be compressed (Content-Encoding: deflate), so headers can be walked without inflating.  A
payload of at least MIN_REVISIT bytes that other pages have too is stored once, with the largest page_id; the others are
revisit records that refer to it.  Files are written under a task-attempt's own name and put in place by a rename, and
readers use the list of files the successful tasks returned, so a retried task leaves no double records.

A header or block that ends before its length, a body that ends before its coding does, and a payload that is not
its record's digest (where the digest is a hex SHA-1 of the whole payload, as written here) are errors that name the
archive and the place: a cut archive never gives fewer or shorter records in silence.

Files go through pyarrow's file systems by URI: local and shared folders, HDFS, object stores.

Defined cases: null html is an empty payload, a response; payloads of any length are kept whole; a null URL writes an
empty target; a null page_id never is a revisit's response; rows that repeat the largest page_id of their payload are all responses;
empty tables write no file; extra columns of pages are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith

from spanloom.llm.common import materialise, scratch_dir, sub_batches

MIN_REVISIT = 1000
SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, page_id long, payload_bytes long, payload_digest string, refers_to long, content_length long, file string, offset long, payload binary"
_HEAD_COLUMNS = {"record_type", "record_id", "target_uri", "warc_date", "page_id", "payload_bytes", "payload_digest", "refers_to", "content_length"}
_DATE = "1970-01-01T00:00:00Z"
_VERSION = b"WARC/1.1\r\n"
#: Bytes that one read of the file system fetches.
BUFFER = 1 << 20
#: Bytes of an archive at which the writer begins another.
FILE_BYTES = 128 << 20


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>"


def _page_of(urn: str | None) -> int | None:
    text = (urn or "").strip("<>").rpartition(":")[2]
    return int(text) if text.lstrip("-").isdigit() else None


def encode_record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, length: int, refers_to: int | None) -> bytes:
    """One WARC record; payload None makes a revisit without a body."""
    lines = [f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {length}", "Content-Type: application/http;msgtype=response"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if payload is None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
        block = http + b"\r\n"
    else:
        body = zlib.compress(payload, 1)
        if len(body) < len(payload):
            http += b"Content-Encoding: deflate\r\n"
        else:
            body = payload
        block = http + f"Content-Length: {len(body)}\r\n\r\n".encode() + body
    return _VERSION + "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def decode_payload(block: bytes) -> bytes:
    """The entity body of an HTTP response block, content encodings undone; other blocks as they are."""
    if not block.startswith(b"HTTP/"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    headers = parse_headers(head.partition(b"\r\n")[2])
    if headers.get("transfer-encoding", "").lower() == "chunked":
        body = _joined_chunks(body)
    if headers.get("content-encoding", "identity").lower() in ("deflate", "gzip", "x-gzip"):
        coded = zlib.decompressobj(47)
        try:
            body = coded.decompress(body)
        except zlib.error as e:
            raise ValueError(f"the body is not what its coding says: {e}") from e
        if not coded.eof:
            raise ValueError("the body ends before its coding does")
    return body


def _joined_chunks(body: bytes) -> bytes:
    """A body in chunks as one; as it is where crawlers have joined them already."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not size or any(c not in b"0123456789abcdefABCDEF" for c in size):
            return body
        at = end + 2 + int(size, 16)
        if at > len(body):
            return body
        if not int(size, 16):
            return b"".join(out)
        out.append(body[end + 2 : at])
        at += 2


class _Stream:
    """A buffered reader over a (possibly gzipped) archive that can skip; what ends too early is an error."""

    def __init__(self, handle, gz: bool) -> None:
        self.raw, self.gz = handle, gz
        self.size = None if gz else handle.size()
        self.buffer, self.at, self.start = b"", 0, 0

    def _more(self) -> bool:
        data = self.raw.read(BUFFER)
        self.buffer, self.start, self.at = self.buffer[self.at :] + data, self.start + self.at, 0
        return bool(data)

    def until(self, mark: bytes) -> bytes | None:
        while (end := self.buffer.find(mark, self.at)) < 0:
            if not self._more():
                if self.buffer[self.at :].strip(b"\r\n"):
                    raise ValueError("the archive ends within a header")
                return None
        out, self.at = self.buffer[self.at : end], end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        out = [self.buffer[self.at : self.at + n]]
        self.at += len(out[0])
        left = n - len(out[0])
        while left and self._more():  # long blocks are joined once, not grown read by read
            out.append(self.buffer[self.at : self.at + left])
            self.at += len(out[-1])
            left -= len(out[-1])
        if left:
            raise ValueError(f"the archive ends {left} bytes before a block does")
        return b"".join(out)

    def skip(self, n: int) -> None:
        inside = min(n, len(self.buffer) - self.at)
        self.at += inside
        if (n := n - inside) <= 0:
            return
        if self.gz:
            while n > 0 and self._more():
                inside = min(n, len(self.buffer) - self.at)
                self.at, n = self.at + inside, n - inside
            if n > 0:
                raise ValueError(f"the archive ends {n} bytes before a block does")
        else:
            where = self.start + self.at + n
            if where > self.size:
                raise ValueError(f"the archive ends {where - self.size} bytes before a block does")
            self.raw.seek(where)
            self.buffer, self.at, self.start = b"", 0, where

    @property
    def offset(self) -> int:
        return self.start + self.at


def read_records(handle, tests: list, with_payload: bool, gz: bool = False, name: str = "") -> Iterator[tuple]:
    """Records of one open archive as tuples in the order of SCHEMA, headers tested before blocks are decoded."""
    s, offset = _Stream(handle, gz), 0
    try:
        while True:
            offset = s.offset
            head = s.until(b"\r\n\r\n")
            if head is None:
                return
            head = head.lstrip(b"\r\n")
            if not head.startswith(b"WARC/"):
                raise ValueError("no WARC record")
            h = parse_headers(head.partition(b"\r\n")[2])
            length = int(h.get("content-length", 0))
            uri, digest = h.get("warc-target-uri"), h.get("warc-payload-digest")
            values = {
                "record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "target_uri": uri, "warc_date": h.get("warc-date"), "page_id": _page_of(h.get("warc-record-id")),
                "payload_bytes": int(h["warc-payload-length"]) if "warc-payload-length" in h else None, "payload_digest": digest.rpartition(":")[2] if digest else None,
                "refers_to": _page_of(h.get("warc-refers-to")), "content_length": length,
            }
            wanted = all(test(values.get(c)) for c, test in tests)
            payload = None
            if wanted and with_payload:
                payload = decode_payload(s.take(length))
                own = values["record_type"] == "response" and values["payload_bytes"] is not None and digest and len(values["payload_digest"]) == 40
                if own and (len(payload) != values["payload_bytes"] or hashlib.sha1(payload).hexdigest() != values["payload_digest"]):
                    raise ValueError("the payload is not that of its digest")
            else:
                s.skip(length)
            s.skip(4)
            if wanted:
                yield (*values.values(), name, offset, payload)
    except (ValueError, EOFError, OSError, zlib.error) as e:
        raise ValueError(f"{name}, record at {offset}: {e}") from e


class _File(InputPartition):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Test:
    """A picklable predicate on one header value."""

    def __init__(self, kind: str, value) -> None:
        self.kind, self.value = kind, value

    def __call__(self, x) -> bool:
        if self.kind == "null":
            return x is None
        if x is None:
            return False
        return {"set": lambda: True, "in": lambda: x in self.value, "prefix": lambda: str(x).startswith(self.value)}[self.kind]()


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.tests = options["path"], []
        self.with_payload = str(options.get("payload", "true")).lower() != "false"

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in _HEAD_COLUMNS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((name, _Test("in", {f.value})))
            elif isinstance(f, In):
                self.tests.append((name, _Test("in", set(f.value))))
            elif isinstance(f, StringStartsWith):
                self.tests.append((name, _Test("prefix", f.value)))
            elif isinstance(f, IsNull):
                self.tests.append((name, _Test("null", None)))
            elif isinstance(f, IsNotNull):
                self.tests.append((name, _Test("set", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for base in self.path.split(","):
            fs, at = _open_fs(base)
            info = fs.get_file_info(at)
            files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, allow_not_found=True, recursive=True))
            scheme = base.partition("://")[0] + "://" if "://" in base and not base.startswith("file:") else ""
            out += [_File(scheme + f.path if scheme else f.path, f.size) for f in files if f.type == pafs.FileType.File and f.base_name.endswith((".warc", ".warc.gz"))]
        return sorted(out, key=lambda f: -f.size) or [_File("", 0)]

    def read(self, partition: _File):
        if not partition.path:
            return
        fs, at = _open_fs(partition.path)
        gz = at.endswith(".gz")
        with fs.open_input_stream(at, compression="gzip") if gz else fs.open_input_file(at) as handle:
            yield from read_records(handle, self.tests, self.with_payload, gz, at.rpartition("/")[2])


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payload", "false").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def _writer(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open_fs(folder)
        name, handle, count = "", None, 0

        def close() -> pa.RecordBatch:
            handle.close()
            fs.move(f"{at}/{name}.open", f"{at}/{name}.warc")
            return pa.RecordBatch.from_pydict({"file": [f"{name}.warc"], "records": pa.array([count], pa.int64())})

        for batch in sub_batches(batches, "html"):
            cols = [batch.column(c) for c in ("page_id", "url", "html", "digest", "length", "refers_to")]
            for row in zip(*(c.to_pylist() for c in cols), strict=True):
                page, url, html, digest, length, refers = row
                if handle is None:
                    fs.create_dir(at, recursive=True)
                    name, count = uuid.uuid4().hex, 0
                    handle = fs.open_output_stream(f"{at}/{name}.open")
                handle.write(encode_record(page, url, None if refers is not None else (html or "").encode(), digest, length, refers))
                count += 1
                if handle.tell() >= file_bytes:
                    yield close()
                    handle = None
        if handle is not None:
            yield close()

    return run


def write_pages(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) under folder; returns (file, records), already written.

    A task goes on to another archive when one has file_bytes, so that no archive, which one task reads, is large.

    Repeated payloads are found by digest and length over all rows with a partial aggregation; only digests that repeat
    are joined back, by broadcast if their table on disk is below Spark's threshold, else by a shuffle.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("length"))
    same = rows.where(F.col("length") >= MIN_REVISIT).groupBy("digest", "length").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null").drop("n")
    same = materialise(same, "warc-repeats")
    refers = F.when(F.coalesce(F.col("page_id") != F.col("last"), F.col("last").isNotNull()), F.col("last"))
    flagged = rows.join(same, ["digest", "length"], "left").withColumn("refers_to", refers)
    # a revisit is written without its payload, so it need not travel
    out = flagged.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "digest", "length", "refers_to")
    return materialise(out.mapInArrow(_writer(folder, file_bytes), "file string, records long"), "warc-files")


def read_pages(spark: SparkSession, folder: str, files: DataFrame | None = None, payload: bool = True) -> DataFrame:
    """Records of the archives in folder; of the given files only, if a list is given (what retried tasks left is not in it)."""
    register(spark)
    found = spark.read.format("warc").option("payload", str(payload).lower()).load(folder)
    return found if files is None else found.join(files.select("file"), "file", "left_semi")


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and digest of what was read: of the decoded payload where there is one, else as the header says."""
    for batch in sub_batches(batches, "payload"):
        d = batch.to_pydict()
        for i, body in enumerate(d["payload"]):
            if d["record_type"][i] == "response":
                d["payload_bytes"][i], d["payload_digest"][i] = len(body), hashlib.sha1(body).hexdigest()
        yield pa.RecordBatch.from_pydict({c: pa.array(d[c], t) for c, t in (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()))})


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as WARC and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = scratch_dir(spark, "warc")
    files = write_pages(pages, folder)
    found = read_pages(spark, folder, files)
    return found.where(F.col("record_type").isin("response", "revisit")).select("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload").mapInArrow(
        _check, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )
