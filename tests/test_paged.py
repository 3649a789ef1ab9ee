"""The paged source: faults of a service, pushed filters, first-n windows."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.sources import paged

ROWS = [(i, f"{'a' if i % 3 else 'b'}{i}", i % 7) for i in range(5, 500, 2)]
SCHEMA = "id long, name string, size int"


@pytest.fixture(scope="module")
def folder(spark):
    return paged.store_pages(spark.createDataFrame(ROWS, SCHEMA), "id", 20)


def service(folder, fault=None, **retry):
    return paged.Service(paged.FileTransport(folder, "id", 20, fault), SCHEMA, "id", ("name", "size"), 20, paged.Retry(**retry))


def test_reads_whole_ranges_in_any_number_of_partitions(spark, folder):
    for parts in (1, 3, 50):
        assert sorted(map(tuple, paged.read(spark, service(folder), 0, 600, parts).collect())) == ROWS
    assert [r["id"] for r in paged.read(spark, service(folder), 7, 12).collect()] == [7, 9, 11]
    assert paged.read(spark, service(folder), 9, 9).count() == 0 and paged.read(spark, service(folder), 900, 1000).count() == 0


def test_filters_reach_the_requests(spark, folder):
    def seen(call, params):
        """Asked without its filters, the service fails."""
        return None if params.get("name__startswith") == "a" and params.get("size") == "3" and int(params["id__gte"]) >= 100 else (400, {}, "")

    rows = paged.read(spark, service(folder, seen), 0, 600, 4).where("name like 'a%' and size = 3 and id >= 100 and length(name) > 1")
    assert sorted(r["id"] for r in rows.collect()) == [i for i, name, size in ROWS if name[0] == "a" and size == 3 and i >= 100]
    several = paged.read(spark, service(folder), 0, 600, 2).where(F.col("size").isin(1, 2) & (F.col("id") < 60))
    assert sorted(r["id"] for r in several.collect()) == [i for i, _, size in ROWS if size in (1, 2) and i < 60]


def pages_of(folder, fault=None, **retry):
    slept = []
    rows = list(paged.walk(service(folder, fault, **retry), 0, 600, {}, slept.append))
    return [r["id"] for r in rows], slept


IDS = [r[0] for r in ROWS]


def test_busy_and_broken_services_are_tried_again(folder):
    waits = {1: (429, {"Retry-After": "7"}, ""), 2: (503, {}, ""), 5: (500, {}, "")}
    assert pages_of(folder, lambda call, _: waits.get(call)) == (IDS, [7.0, 4.0, 2.0])

    def broken(call, _):
        if call == 3:
            raise ConnectionResetError("reset")

    assert pages_of(folder, broken) == (IDS, [2.0])


@pytest.mark.parametrize(
    ("fault", "message"),
    [
        (lambda call, p: (401, {}, "") if call == 2 else None, "does not let us in"),
        (lambda call, p: (404, {}, "") if call == 2 else None, "status 404"),
        (lambda call, p: (429, {"Retry-After": "121"}, ""), "121 s to wait"),
        (lambda call, p: (503, {}, "") if call > 4 else None, "status 503, 4 times"),
        (lambda call, p: (200, {}, '{"results": [') if call == 3 else None, "no JSON"),
        (lambda call, p: (200, {}, "{}") if call == 3 else None, "without results"),
        (lambda call, p: (200, {}, json.dumps({"results": [{"id": 9}], "next": "4"})) if call == 4 else None, "id 9 after"),
        (lambda call, p: (200, {}, json.dumps({"results": [{"id": 900}], "next": None})) if call == 1 else None, "id 900"),
        (lambda call, p: (200, {}, json.dumps({"results": [], "next": "1"})) if p.get("cursor") == "3" else None, "comes again"),
        (lambda call, p: (200, {}, json.dumps({"results": [{"id": 5}, {"id": 7}], "next": None, "count": 3})), "2 records, not the 3"),
    ],
)
def test_what_cannot_be_right_is_an_error(folder, fault, message):
    with pytest.raises(paged.ServiceError, match=message):
        pages_of(folder, fault)


def test_a_fault_in_a_task_fails_the_job(spark, folder):
    with pytest.raises(Exception, match="does not let us in"):
        paged.read(spark, service(folder, lambda call, p: (401, {}, "")), 0, 600, 2).count()


def test_first_n_stops_asking(spark, folder):
    def late(call, params):
        return (500, {}, "") if int(params["id__gte"]) >= 200 else None

    keep = lambda rows: rows.where("size = 3")
    got = paged.first_n(spark, service(folder, late, tries=1), keep, 5, 0, 600, 2)
    assert [r["id"] for r in got.collect()] == [i for i, _, size in ROWS if size == 3][:5]
    every = paged.first_n(spark, service(folder), keep, 1000, 0, 600, 2)
    assert [r["id"] for r in every.collect()] == [i for i, _, size in ROWS if size == 3]
    assert paged.first_n(spark, service(folder), keep, 3, 0, 0).count() == 0
