"""A paged web service as a Spark source: planned ranges, pushed filters, retries with bounded waits, first-n reads.

The service is described, not assumed: a ``Service`` names its id field, what it can filter by and its page size, and a
transport answers requests.  Transports are objects with ``get(params) -> (status, headers, body)`` that can be pickled; a
body is JSON with ``results`` (a list of records in order of id), ``next`` (the cursor of the following page or null) and, where
the service has it, ``count`` (records of the whole request).

Plan.  The range of ids is cut into as many ranges as asked for, a partition each; a partition follows its cursors, which
is the only order that a service gives.  Equality, IN, comparison and prefix predicates on fields that the service filters
by become request parameters; the others stay with Spark.  A lost executor repeats its range.

Faults.  429, 5xx and broken connections are tried ``tries`` times with waits that grow by ``wait_s``, or as long as
Retry-After says; a longer wait than ``most_wait_s`` is an error, not a sleep.  401 and 403 are errors at once, as are other
statuses, bodies that are no JSON, a cursor that comes again, ids out of order or of another range, and fewer or more
records than ``count`` promised: a short answer never passes for a whole one.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType, _parse_datatype_string

from spanloom.sources.scratch import materialise, scratch_dir


class ServiceError(RuntimeError):
    """A service that cannot be read, or answers that cannot be right."""


@dataclass(frozen=True)
class Retry:
    tries: int = 4
    wait_s: float = 2.0
    most_wait_s: float = 120.0


@dataclass(frozen=True)
class Service:
    """What a service offers: schema (DDL) of its records, id field, fields that it filters by, records in a page."""

    transport: Any
    schema: str
    id_field: str = "id"
    filters: tuple[str, ...] = ()
    page_size: int = 100
    retry: Retry = field(default_factory=Retry)


def request(service: Service, params: dict[str, str], sleep: Callable[[float], None] = time.sleep) -> dict[str, Any]:
    """One page, after as many tries as it takes and the service's rules allow."""
    rules, why = service.retry, ""
    for n in range(1, rules.tries + 1):
        wait = rules.wait_s * n
        try:
            status, headers, body = service.transport.get(params)
        except OSError as e:
            why = f"{type(e).__name__}: {e}"
        else:
            if status == 200:
                try:
                    return json.loads(body)
                except ValueError as e:
                    raise ServiceError(f"{params}: the answer is no JSON: {e}") from e
            if status in (401, 403):
                raise ServiceError(f"{params}: {status}, the service does not let us in")
            if status != 429 and status < 500:
                raise ServiceError(f"{params}: status {status}")
            why = f"status {status}"
            told = {k.lower(): v for k, v in headers.items()}.get("retry-after", "")
            wait = float(told) if told.replace(".", "", 1).isdigit() else wait
        if n < rules.tries:
            if wait > rules.most_wait_s:
                raise ServiceError(f"{params}: {why}, and {wait:g} s to wait, over {rules.most_wait_s:g}")
            sleep(wait)
    raise ServiceError(f"{params}: {why}, {rules.tries} times")


def walk(service: Service, low: int, high: int, params: dict[str, str], sleep: Callable[[float], None] = time.sleep) -> Iterator[dict[str, Any]]:
    """Records of the ids from low to below high, page by page."""
    asked = params | {f"{service.id_field}__gte": str(low), f"{service.id_field}__lt": str(high), "order_by": service.id_field, "page_size": str(service.page_size)}
    cursor, last, seen, promised, met = None, None, 0, None, set()
    while True:
        page = request(service, asked if cursor is None else asked | {"cursor": cursor}, sleep)
        results = page.get("results")
        if not isinstance(results, list):
            raise ServiceError(f"{asked}: a page without results")
        promised = page["count"] if promised is None and page.get("count") is not None else promised
        for r in results:
            at = r.get(service.id_field)
            if not isinstance(at, int) or not low <= at < high or (last is not None and at < last):
                raise ServiceError(f"{asked}: {service.id_field} {at} after {last}, of {low} to {high}")
            last, seen = at, seen + 1
            yield r
        cursor = page.get("next")
        if cursor is None:
            break
        if cursor in met:
            raise ServiceError(f"{asked}: cursor {cursor} comes again")
        met.add(cursor)
    if promised is not None and promised != seen:
        raise ServiceError(f"{asked}: {seen} records, not the {promised} promised")


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


_SIGNS = {GreaterThan: "gt", GreaterThanOrEqual: "gte", LessThan: "lt", LessThanOrEqual: "lte"}


class _Reader(DataSourceReader):
    def __init__(self, service: Service, schema: StructType, options: dict) -> None:
        self.service, self.names, self.params = service, schema.fieldNames(), {}
        self.low, self.high, self.parts = int(options["low"]), int(options["high"]), int(options.get("partitions", 1))

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            key, value = None, getattr(f, "value", None)
            if name == self.service.id_field and isinstance(value, int) and type(f) in _SIGNS:
                # the range itself shrinks: no request is made for what is cut off
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                else:
                    self.high = min(self.high, value + isinstance(f, LessThanOrEqual))
                continue
            if name in self.service.filters:
                if isinstance(f, EqualTo):
                    key, value = name, str(value)
                elif isinstance(f, In) and all("," not in str(v) for v in f.value):
                    key, value = f"{name}__in", ",".join(map(str, f.value))
                elif isinstance(f, StringStartsWith):
                    key = f"{name}__startswith"
                elif type(f) in _SIGNS:
                    key, value = f"{name}__{_SIGNS[type(f)]}", str(value)
            if key is None or key in self.params:
                yield f
            else:
                self.params[key] = value

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(self.parts, self.high - self.low))
        cuts = [self.low + (self.high - self.low) * i // n for i in range(n + 1)]
        return [_Range(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b] or [_Range(0, 0)]

    def read(self, partition: _Range):
        if partition.low < partition.high:
            for r in walk(self.service, partition.low, partition.high, self.params):
                yield tuple(r.get(c) for c in self.names)


def source(service: Service, name: str = "paged") -> type[DataSource]:
    """A data source over a service: ``spark.read.format(name).option("low", ...).option("high", ...).load()``."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return service.schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(service, schema, self.options)

    return Paged


def read(spark: SparkSession, service: Service, low: int, high: int, partitions: int = 1, name: str = "paged") -> DataFrame:
    """Records of the ids from low to below high; filters on the frame reach the requests."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source(service, name))
    return spark.read.format(name).option("low", low).option("high", high).option("partitions", partitions).load()


def first_n(spark: SparkSession, service: Service, keep: Callable[[DataFrame], DataFrame], n: int, low: int, high: int, partitions: int = 8, name: str = "paged") -> DataFrame:
    """The first n records, by id, that ``keep`` leaves: ids are read in windows, each twice as wide as the one before,
    until there are n or no ids are left.  A window is read once, and nothing after the last one needed is asked for."""
    width, at, found, count = max(1, n) * 2, low, None, 0
    while at < high and count < n:
        stop = min(high, at + width)
        some = materialise(keep(read(spark, service, at, stop, partitions, name)), "paged-window")
        found = some if found is None else found.unionByName(some)
        count, at, width = count + some.count(), stop, width * 2
    if found is None:
        found = keep(spark.createDataFrame([], _parse_datatype_string(service.schema)))
    return found.orderBy(service.id_field).limit(n)


# ---------------------------------------------------------------- a service in files


class FileTransport:
    """Pages from files, as a service would give them: for tests, mirrors and machines without a network.

    ``fault(call, params)``, if given, may answer in place of the files: (status, headers, body) or None.
    """

    def __init__(self, folder: str, id_field: str, page_size: int, fault: Callable[[int, dict], tuple | None] | None = None) -> None:
        self.folder, self.id_field, self.page_size, self.fault, self.calls = folder, id_field, page_size, fault, 0

    def _page(self, number: int) -> list[dict]:
        fs, at = pafs.FileSystem.from_uri(self.folder if "://" in self.folder or self.folder.startswith("file:") else f"file://{self.folder}")
        out = []
        for f in fs.get_file_info(pafs.FileSelector(f"{at}/page={number}", allow_not_found=True)):
            if f.base_name.startswith("part-"):
                with fs.open_input_stream(f.path, compression=None) as handle:
                    out += [json.loads(line) for line in handle.read().decode().splitlines()]
        return sorted(out, key=lambda r: r[self.id_field])

    def _fits(self, r: dict, params: dict[str, str]) -> bool:
        tests = {"": lambda x, v: str(x) == v, "in": lambda x, v: str(x) in v.split(","), "startswith": lambda x, v: str(x).startswith(v), "gt": lambda x, v: type(x)(v) < x, "gte": lambda x, v: type(x)(v) <= x, "lt": lambda x, v: type(x)(v) > x, "lte": lambda x, v: type(x)(v) >= x}
        for key, value in params.items():
            name, _, sign = key.partition("__")
            if key not in ("order_by", "page_size", "cursor") and (r.get(name) is None or not tests[sign](r[name], value)):
                return False
        return True

    def get(self, params: dict[str, str]) -> tuple[int, dict[str, str], str]:
        self.calls += 1
        if self.fault and (answer := self.fault(self.calls, params)) is not None:
            return answer
        low, high = int(params[f"{self.id_field}__gte"]), int(params[f"{self.id_field}__lt"])
        page = int(params.get("cursor", low // self.page_size))
        results = [r for r in self._page(page) if self._fits(r, params)]
        more = (page + 1) * self.page_size < high
        return 200, {}, json.dumps({"results": results, "next": str(page + 1) if more else None})


def store_pages(rows: DataFrame, id_field: str, page_size: int) -> str:
    """Write rows as the files of a FileTransport, a folder a page of ids; the folder."""
    folder = scratch_dir(rows.sparkSession, "service")
    lines = rows.select(F.expr(f"`{id_field}` div {page_size}").alias("page"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    lines.repartition("page").write.partitionBy("page").text(folder)
    return folder
