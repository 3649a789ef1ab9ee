"""An index that is replaced by key, in transactions: all of a write or nothing, and readers never see half of one.

``rows.write.format("keyed_index").mode("append").save(path)`` replaces the rows of the index keys (column ``index_key``)
that rows hold, and leaves other keys as they are.  Tasks write Parquet files of their own under ``data/<job>``; when all
have ended, the commit lists them in a new version file, and that file's appearance is the only thing that readers look at.
A job that fails takes its files away; one that is killed leaves files that no version names, which ``vacuum`` removes.

A version file holds each key's files and rows.  Two writers that both follow version n would both make n + 1: the file is
made only if it is absent, and the loser reads the new version and puts its keys over that, so neither is lost.  (On file
systems that cannot make a file only if it is absent, one writer at a time may write.)

Readers ask for a version once and read the files it names, with Spark's own Parquet reader, so columns and row groups are
pruned as ever; a version stays readable until it is vacuumed.

Defined cases: a null key is an error and nothing is written; a write without rows makes no version; rows that repeat are
kept; reading a key that was never loaded is an error.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from spanloom.sources.stores import StoreError

KEY = "index_key"
#: Rows that a writer holds before they go to their key's file.
GROUP_ROWS = 50_000


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _versions(fs: pafs.FileSystem, at: str) -> list[int]:
    found = fs.get_file_info(pafs.FileSelector(f"{at}/versions", allow_not_found=True))
    return sorted(int(f.base_name[1:-5]) for f in found if f.base_name.startswith("v") and f.base_name.endswith(".json"))


def _read_version(fs: pafs.FileSystem, at: str, version: int) -> dict:
    with fs.open_input_stream(f"{at}/versions/v{version:09d}.json") as f:
        return json.loads(f.read())


def _make(fs: pafs.FileSystem, name: str, data: bytes) -> bool:
    """Make a file whole, if it is absent; whether this call made it."""
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    hidden = f"{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(hidden) as f:
        f.write(data)
    if isinstance(fs, pafs.LocalFileSystem):
        try:
            os.link(hidden, name)
        except FileExistsError:
            return False
        finally:
            os.unlink(hidden)
        return True
    if fs.get_file_info(name).type != pafs.FileType.NotFound:
        fs.delete_file(hidden)
        return False
    fs.move(hidden, name)
    return True


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str, int]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.job = path, uuid.uuid4().hex
        # made here alone: a task that still runs when the write is aborted finds no folder and leaves no file
        fs, at = _open(path)
        fs.create_dir(f"{at}/data/{self.job}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, at = _open(self.path)
        folder, done, held = f"{at}/data/{self.job}", [], {}
        counts: dict[str, int] = {}
        writers: dict[str, tuple[str, pq.ParquetWriter]] = {}

        def flush(key: str) -> None:
            table = pa.concat_tables(held.pop(key))
            if key not in writers:
                name = f"{folder}/{uuid.uuid4().hex}.parquet"
                writers[key] = name, pq.ParquetWriter(name, table.schema, filesystem=fs)
            writers[key][1].write_table(table)
            counts[key] = counts.get(key, 0) + table.num_rows

        for batch in iterator:
            keys = batch.column(KEY)
            if keys.null_count:
                raise StoreError("a row has no index_key")
            for key in pc.unique(keys).to_pylist():
                held.setdefault(key, []).append(pa.Table.from_batches([batch.filter(pc.equal(keys, key))]))
                if sum(t.num_rows for t in held[key]) >= GROUP_ROWS:
                    flush(key)
        for key in list(held):
            flush(key)
        for key, (name, writer) in writers.items():
            writer.close()
            done.append((key, name.removeprefix(at + "/"), counts[key]))
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        new: dict[str, list] = {}
        for m in messages:
            for key, name, rows in m.files if m else []:
                new.setdefault(key, []).append([name, rows])
        if not new:
            self.abort(messages)
            return
        fs, at = _open(self.path)
        while True:
            last = max(_versions(fs, at), default=0)
            keys = (_read_version(fs, at, last)["keys"] if last else {}) | {k: sorted(v) for k, v in new.items()}
            if _make(fs, f"{at}/versions/v{last + 1:09d}.json", json.dumps({"version": last + 1, "job": self.job, "keys": keys}).encode()):
                return

    def abort(self, messages: list[_Written | None]) -> None:
        fs, at = _open(self.path)
        if fs.get_file_info(f"{at}/data/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{at}/data/{self.job}")


class KeyedIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_index"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if KEY not in schema.fieldNames():
            raise StoreError("rows of an index have an index_key")
        return _Writer(self.options["path"])


def load(rows: DataFrame, path: str) -> None:
    """Replace the keys that rows hold, and no others, in one transaction."""
    rows.sparkSession.dataSource.register(KeyedIndex)
    rows.write.format("keyed_index").mode("append").save(path)


def current(path: str) -> int:
    """The number of the version that readers see now; 0 where nothing was ever loaded."""
    return max(_versions(*_open(path)), default=0)


def _state(path: str, version: int | None) -> dict:
    fs, at = _open(path)
    version = current(path) if version is None else version
    if not version:
        return {"version": 0, "keys": {}}
    if version not in _versions(fs, at):
        raise StoreError(f"no version {version} of {path}")
    return _read_version(fs, at, version)


def loaded_keys(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(index_key, n, version) from the version file alone; no rows where nothing was ever loaded."""
    state = _state(path, version)
    return spark.createDataFrame([(k, sum(n for _, n in files), state["version"]) for k, files in sorted(state["keys"].items())], "index_key string, n long, version long")


def read(spark: SparkSession, path: str, index_key: str, version: int | None = None) -> DataFrame:
    """Rows of a key as of a version (the current one at the call); later writes do not change what the frame reads."""
    files = _state(path, version)["keys"].get(index_key)
    if not files:
        raise StoreError(f"nothing is loaded for {index_key}")
    return spark.read.parquet(*[f"{path.rstrip('/')}/{name}" for name, _ in files])


def vacuum(path: str, keep: int = 1) -> int:
    """Remove versions but the last ``keep``, and files that those do not name; the number of files removed.

    No write may run meanwhile: its files are not named yet.
    """
    if keep < 1:
        raise StoreError("a version stays")
    fs, at = _open(path)
    every = _versions(fs, at)
    for v in every[:-keep]:
        fs.delete_file(f"{at}/versions/v{v:09d}.json")
    named = {f"{at}/{name}" for v in every[-keep:] for files in _read_version(fs, at, v)["keys"].values() for name, _ in files}
    gone = 0
    for f in fs.get_file_info(pafs.FileSelector(f"{at}/data", recursive=True, allow_not_found=True)):
        if f.type == pafs.FileType.File and f.path not in named:
            fs.delete_file(f.path)
            gone += 1
    return gone
