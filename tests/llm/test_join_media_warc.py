"""N-gram Jaccard join, transport streams and WARC against brute force and round trips."""

import gzip
import hashlib
import os
import random
import re
import time
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import mpegts, partenum, warc
from spanloom.llm.common import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    boss = list(range(len(rows)))

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        u = len(sets[i] | sets[j])
        if u and 100 * len(sets[i] & sets[j]) >= 80 * u:
            boss[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(groups[find(i)])) for i in range(len(rows)))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for n in (1, 3, 5, 6, 8, 12, 20, 40, 80, 150, 400):
        base = [rng.choice(vocabulary) for _ in range(n)]
        rows += [" ".join(base), "  ".join(base).upper(), " ".join(base)]
        rows += [" ".join(edited(rng, base, k)) for k in range(1, 2 + n // 15)]
    # a chain in which neighbours link and ends do not, and a crowd of near copies around one text
    base = [rng.choice(vocabulary) for _ in range(120)]
    for step in range(8):
        rows.append(" ".join(base))
        base = edited(rng, base, 2)
    core = [rng.choice(vocabulary) for _ in range(100)]
    rows += [" ".join(edited(rng, core, rng.randrange(1, 5))) for _ in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(55)]
    rows += [" ".join([rng.choice(vocabulary) for _ in range(200)] + passage) for _ in range(30)]
    rows += [None, "", " \t\n", "x " * 20_000]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a", F.lit("clash")).withColumn("features", F.lit(1))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in partenum.join(docs).collect())
    assert got == brute(rows)


def test_join_repeated_rows_null_ids_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(4, text), (4, text), (2, text + " end"), (None, text), (None, "alone it stands here now")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in partenum.join(docs).collect()), key=repr)
    assert got == sorted([(4, 2), (4, 2), (2, 2), (None, 2), (None, None)], key=repr)
    assert partenum.join(docs.limit(0)).count() == 0
    assert sorted((r["doc_id"] for r in partenum.keep_one(docs).collect()), key=repr) == sorted([2, None], key=repr)  # the row without doc_id is a copy too


def test_signatures_meet_for_linked_sets():
    rng = random.Random(7)
    for _ in range(60):
        n = rng.choice([1, 2, 4, 6, 9, 15, 30, 70, 200, 600])
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        texts = pa.array([" ".join(base)] + [" ".join(edited(rng, base, rng.randrange(0, max(2, n // 20)))) for _ in range(5)])
        sizes, features = partenum.shingle_sets(texts)
        owner, sign = partenum.signatures(sizes, features)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for i, j in combinations(range(6), 2):
            if partenum.linked(features[ends[i] : ends[i + 1]], features[ends[j] : ends[j + 1]]):
                assert set(sign[owner == i]) & set(sign[owner == j])


@pytest.mark.parametrize("words", [1, 2, 3, 4])
def test_a_slice_of_few_words(spark, words):
    text = " ".join("abcd"[:words])
    for alone in ([text], [None, text, ""]):
        sizes, features = partenum.shingle_sets(pa.array(alone, pa.string()))
        mixed = partenum.shingle_sets(pa.array(alone + ["one two three four five six"], pa.string()))
        assert sizes.tolist() == [int(bool(t)) for t in alone] and features.tolist() == mixed[1][:1].tolist()
    got = partenum.join(spark.createDataFrame([(7, text)], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got] == [(7, 1, 7)]


def test_slices_hash_alike():
    texts = pa.array(["A b c d e f", None, "x", "é É q w e r t", "", "the quick brown fox jumps over"] * 5)
    for start in range(12):
        part = texts.slice(start, 9)
        assert [x.tolist() for x in partenum.shingle_sets(part)] == [x.tolist() for x in partenum.shingle_sets(pa.array(part.to_pylist()))]


def test_sketches_never_turn_links_away():
    rng = np.random.default_rng(1)
    for share in (1, 8):
        for n in (5, 60, 700):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.sort(np.concatenate([a[: int(n * 0.9)], rng.integers(0, 2**63, n // 15).astype(np.uint64)]))
            x, y = partenum.sketch(a, share), partenum.sketch(b, share)
            width = min(len(x), len(y))
            assert int(np.bitwise_count(partenum._fold(x, width) ^ partenum._fold(y, width)).sum()) <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 6), (6, 5), (7, 7)], "a long, b long")
    for bound in (10, 0):  # in one task, and by rounds of joins
        assert {r["node"]: r["component"] for r in components(edges, task_links=bound).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5}


@pytest.mark.parametrize("n", [64, 128, 4096, 4160, 12_288, 100_032])
def test_transport_stream_round_trip(n):
    payload = os.urandom(n)
    stream = mpegts.mux(payload)
    out = mpegts.demux(stream)
    assert out.payload == payload and len(stream) % 188 == 0 and out.continuity_errors == out.damaged == 0
    assert out.programs == {1: mpegts.PMT_PID} and out.streams == {mpegts.DATA_PID: mpegts.STREAM_TYPE}
    assert [p for p, _, _ in out.units] == [mpegts.FIRST_PTS + i * mpegts.TICKS for i in range(-(-n // mpegts.UNIT))]
    assert [r for _, _, r in out.units] == [i % mpegts.GROUP == 0 for i in range(len(out.units))]


def test_lost_and_repeated_packets_are_counted():
    stream = mpegts.mux(os.urandom(20_032))
    cut = mpegts.demux(stream[: 188 * 30] + stream[188 * 31 :])
    twice = mpegts.demux(stream[: 188 * 31] + stream[188 * 30 :])
    assert cut.continuity_errors == 1 and cut.damaged >= 1
    assert twice.duplicates == 1 and twice.payload == mpegts.demux(stream).payload
    assert mpegts.demux(b"junk" + stream).payload == mpegts.demux(stream).payload
    assert mpegts.demux(b"").payload == b""


def test_media_columns(spark):
    rows = [(1, "é" * 5000), (2, None), (3, ""), (None, "x"), (4, "é" * 5000), (4, "é" * 5000)]
    media = mpegts.store(spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash")))
    out = mpegts.features(media).toPandas()
    same = out[out["n_bytes"] == 10_000]
    assert len(same) == 3 and same.drop(columns="doc_id").drop_duplicates().shape[0] == 1
    assert set(out[out["n_bytes"] == 0]["payload_bytes"]) == {64}
    assert out["feature"].str.endswith("stored_index=same").all()
    # timestamps and random-access points lie in the table, and are those of the streams
    held = {repr((r["doc_id"], [tuple(u) for u in r["access_units"]])) for r in media.select("doc_id", "access_units").collect()}
    assert held == {repr((r["doc_id"], [tuple(u) for u in r["access_units"]])) for r in mpegts.access_units(media).collect()}
    wrong = media.withColumn("access_units", F.slice("access_units", 2, 100))
    assert mpegts.features(wrong).where("feature like '%stored_index=differs'").count() == len(out)
    assert {len(r["access_units"]) for r in mpegts.access_units(media).where("doc_id = 1").collect()} == {3}
    assert mpegts.features(mpegts.store(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def page_rows():
    big = "<html>" + "é" * 700 + "</html>"
    return [(1, "http://a/1", big), (2, "http://a/2", big), (9, "http://a/9\r\n", big), (3, None, None), (4, "http://b", "small"), (5, "http://b", "small"), (6, "u", os.urandom(3000).hex()), (9, "http://a/9", big)]


def test_warc_round_trip(spark):
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame(page_rows(), "page_id long, url string, html string").withColumn("digest", F.lit(0))).collect())
    n = len(("<html>" + "é" * 700 + "</html>").encode())
    assert got == [(1, n, "revisit", 9), (2, n, "revisit", 9), (3, 0, "response", None), (4, 5, "response", None), (5, 5, "response", None), (6, 6000, "response", None), (9, n, "response", None), (9, n, "response", None)]
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_predicates_skip_payloads(spark, tmp_path):
    folder = str(tmp_path / "w")
    warc.write_pages(spark.createDataFrame(page_rows(), "page_id long, url string, html string"), folder)
    found = warc.read_pages(spark, folder)
    some = found.where("record_type = 'revisit'")
    assert some.count() == 2 and found.where("target_uri like 'http://b%'").count() == 2
    assert "record_type" not in [x for x in str(some._jdf.queryExecution().executedPlan()).split("\n") if "Filter" in x and "isnotnull" in x]
    assert found.where("page_id in (4, 6)").select("payload").count() == 2
    assert all(r["payload"] is None for r in warc.read_pages(spark, folder, payload=False).collect())
    assert {bytes(r["payload"]) for r in found.where("page_id = 4").collect()} == {b"small"}


def test_warc_reader_skips_without_decoding(tmp_path, monkeypatch):
    path = tmp_path / "x.warc"
    path.write_bytes(b"".join(warc.encode_record(i, "u", b"p" * 100_000, "d", 100_000, None) for i in range(5)))
    decoded = []
    monkeypatch.setattr(warc, "decode_payload", lambda b: decoded.append(1) or b)
    with pa.fs.LocalFileSystem().open_input_file(str(path)) as handle:
        rows = list(warc.read_records(handle, [("page_id", warc._Test("in", {3}))], True))
    assert [r[4] for r in rows] == [3] and len(decoded) == 1


def test_media_of_bytes_that_are_not_utf8(spark):
    docs = spark.createDataFrame([(1, bytearray(b"ab\xff\xfe")), (2, bytearray(b"\xc3"))], "doc_id long, text binary").select("doc_id", F.col("text").cast("string").alias("text"))
    rows = {r["doc_id"]: r for r in mpegts.features(mpegts.store(docs)).collect()}
    assert [rows[i]["n_bytes"] for i in (1, 2)] == [4, 1] and [rows[i]["payload_bytes"] for i in (1, 2)] == [64, 64]
    assert rows[1]["payload_sha256"] == hashlib.sha256(b"ab\xff\xfe".ljust(64, b"\0")).hexdigest()


def test_media_against_a_plain_reader(spark):
    """A reader of its own: packets of the data PID joined, PES headers cut off, units in order."""
    texts = ["", "é" * 5000, "x" * 40_000]
    for r in mpegts.store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        elementary = bytearray()
        for at in range(0, len(r["media"]), 188):
            packet = r["media"][at : at + 188]
            assert packet[0] == 0x47
            if ((packet[1] & 31) << 8 | packet[2]) != mpegts.DATA_PID:
                continue
            elementary += packet[4:] if not packet[3] & 32 else packet[5 + packet[4] :]
        payload, at = b"", 0
        for unit in r["access_units"]:
            assert elementary[at : at + 4] == b"\0\0\1\xbd" and unit["offset"] == len(payload)
            size = int.from_bytes(elementary[at + 4 : at + 6], "big")
            payload += elementary[at + 9 + elementary[at + 8] : at + 6 + size]
            at += 6 + size
        assert at == len(elementary) and payload == mpegts.pad(texts[r["doc_id"]])


def test_warc_long_pages_and_many_archives(spark, tmp_path):
    rng = random.Random(9)
    pages = [(i, f"http://x/{i}", "".join(rng.choice("abcdefgh") for _ in range(n))) for i, n in enumerate([5_000_000, 10, 2_000_000, 0, 1500, 1500])]
    files = warc.write_pages(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"), file_bytes=400_000)
    assert files.count() > 2
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_pages(spark, str(tmp_path / "w"), files).where("record_type = 'response'").collect()}
    assert got == {i: t for i, _, t in pages}


# ---------------------------------------------------------------- rows alike, archives cut


def test_linked_pair_with_very_many_repeated_rows(spark):
    """2,000 rows of one text, 2,000 of a near copy, 2,000 without doc_id: sets are compared once, not row by row."""
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:59], "other"])
    rows = [(1, " ".join(base))] * 2000 + [(2, near)] * 2000 + [(None, near)] * 1000 + [(None, " ".join(base))] * 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.monotonic()
    got = partenum.join(docs).groupBy("doc_id", "component_id").count().collect()
    assert time.monotonic() - began < 90
    assert {(r["doc_id"], r["component_id"]): r["count"] for r in got} == {(1, 1): 2000, (2, 1): 2000, (None, 1): 2000}
    assert [tuple(r) for r in partenum.keep_one(docs).collect()] == [(1, " ".join(base))]


def test_keep_one_decides_by_row(spark):
    a, other = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    near = a.replace("a49", "x")
    rows = [(3, a), (5, near), (5, other), (None, near), (None, "c d e"), (None, "c d e"), (7, None), (7, ""), (None, " "), (None, " "), (8, other + " ")]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, `a.b` int")
    kept = partenum.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(3, a), (5, other), (None, "c d e"), (7, None), (7, ""), (None, " "), (None, " ")], key=str)


def one_archive(tmp_path, spark):
    pages = spark.createDataFrame([(1, "http://a/1", "x" * 40), (2, "http://a/2", "".join(map(chr, range(33, 127))) * 12), (3, "http://a/3", None), (4, "http://a/4", "".join(map(chr, range(33, 127))) * 12)], "page_id long, url string, html string")
    name = warc.write_pages(pages.coalesce(1), str(tmp_path / "w")).first()["file"]
    return (tmp_path / "w" / name).read_bytes()


@pytest.mark.parametrize("payload", [True, False])
@pytest.mark.parametrize("gz", [True, False])
def test_an_archive_cut_anywhere_is_an_error(spark, tmp_path, payload, gz):
    data = one_archive(tmp_path, spark)
    read = lambda d: [r for r in warc.read_records(pa.BufferReader(d) if not gz else pa.input_stream(pa.BufferReader(gzip.compress(d)), compression="gzip"), [], payload, gz, "x")]
    whole = read(data)
    ends = {r[10] for r in whole} | {len(data)}
    assert len(whole) == 4
    for cut in range(1, len(data)):
        if cut in ends:
            assert len(read(data[:cut])) == sum(r[10] < cut for r in whole)
        else:
            with pytest.raises(ValueError, match="x, record at"):
                read(data[:cut])


def test_changed_payloads_and_chunked_bodies(spark, tmp_path):
    data = one_archive(tmp_path, spark)
    at = data.index(b"x" * 40) if b"x" * 40 in data else data.index(b"\r\n\r\n", data.index(b"HTTP/1.1")) + 6
    bad = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
    with pytest.raises(ValueError, match="record at 0"):
        list(warc.read_records(pa.BufferReader(bad), [], True, False, "x"))
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert warc.decode_payload(head + b"4\r\nabcd\r\n2;x=1\r\nef\r\n0\r\n\r\n") == b"abcdef"
    assert warc.decode_payload(head + b"joined already") == b"joined already"


def test_a_member_goes_to_the_pair_scan_once(spark, monkeypatch):
    """Many signatures with the same members: each member and its sketch are dealt out once, not once a signature."""

    def rows(top):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([True] * b.num_rows), b.column("a"), pa.array([0] * b.num_rows, pa.int64())], names=["pair", "a", "b"])

        return run

    rng = np.random.default_rng(5)
    base = rng.integers(1, 2**63, 60, dtype=np.uint64)
    sets = [np.sort(np.concatenate([base, rng.integers(1, 2**63, k, dtype=np.uint64)])) for k in (0, 5, 9, 60)]
    group = spark.createDataFrame([(g, a, a) for g in range(40) for a in range(4)], "g long, a long, c long")
    sketches = spark.createDataFrame([(a, len(x), bytearray(partenum.sketch(x, 2).tobytes())) for a, x in enumerate(sets)], "a long, n long, sketch binary")
    got = partenum._cross_pairs(group, sketches, 0).collect()
    assert {(r["a"], r["b"]) for r in got if r["pair"]} >= {(0, 1), (0, 2), (1, 2)} and {r["a"] for r in got if not r["pair"]} == set(range(40))
    assert all((r["a"], r["b"]) != (0, 3) for r in got if r["pair"])
    monkeypatch.setattr(partenum, "_near", rows)
    assert sorted(r["a"] for r in partenum._cross_pairs(group, sketches, 0).collect()) == [0, 1, 2, 3]


def test_a_family_goes_to_the_pair_scan_once_however_large(spark, monkeypatch):
    """300 signatures of 40 members, more rows than one task compares: a member is dealt out once, not once a task."""

    def rows(top):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([True] * b.num_rows), b.column("a"), pa.array([0] * b.num_rows, pa.int64())], names=["pair", "a", "b"])

        return run

    group = spark.createDataFrame([(g, a, a) for g in range(300) for a in range(40)], "g long, a long, c long")
    word = bytearray(partenum.sketch(np.arange(1, 20, dtype=np.uint64), 2).tobytes())
    sketches = spark.createDataFrame([(a, 19, word) for a in range(40)], "a long, n long, sketch binary")
    got = partenum._cross_pairs(group, sketches, 0).collect()
    assert {(r["a"], r["b"]) for r in got if r["pair"]} == {(a, b) for b in range(40) for a in range(b)}
    assert {r["a"] for r in got if not r["pair"]} == set(range(300))
    monkeypatch.setattr(partenum, "_near", rows)
    assert sorted(r["a"] for r in partenum._cross_pairs(group, sketches, 0).collect()) == list(range(40))


@pytest.mark.parametrize("block", [4096, 7])
def test_families_of_small_signatures_are_compared_by_signature(spark, monkeypatch, block):
    """Signatures that have the smallest member alone in common: pairs within each, and none across."""
    monkeypatch.setattr(partenum, "BLOCK", block)
    members = {g: [0, *range(1 + 10 * g, 11 + 10 * g)] for g in range(20)}
    group = spark.createDataFrame([(g, a, a) for g, m in members.items() for a in m], "g long, a long, c long")
    word = bytearray(partenum.sketch(np.arange(1, 20, dtype=np.uint64), 2).tobytes())
    sketches = spark.createDataFrame([(a, 19, word) for a in range(201)], "a long, n long, sketch binary")
    got = partenum._cross_pairs(group, sketches, 0).collect()
    assert {(r["a"], r["b"]) for r in got if r["pair"]} == {(a, b) for m in members.values() for a in m for b in m if a < b}
    assert {r["a"] for r in got if not r["pair"]} == set(members)
