"""Packed token files: ids against the library on whole texts, bits against plain integers, files cut at any place."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import token_pack
from spanloom.llm.common import scratch_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = token_pack.Encoder(PATH)
ODD = [None, "", " ", "\n", "  a", "a  ", "a \n b", "don't, can''t. x's", "a<|endoftext|>b <|endoftext|> ", "é à.", "a b c", "a  b", "\u0085 x", "\x1c a", "日本 語。 x", "a" * 3000, "x\t\ty", "1.5,2 3", "<|endof text|>", '"q" (r)! ?;:', "　 a", "ß b", "Ā. b"]


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def encoded(texts):
    ends, ids = ENCODER.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)]


def test_parts_give_the_ids_of_whole_texts(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ODD
    assert encoded(texts) == [ids_of(t) for t in texts]
    assert encoded([]) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t.,'|<>aZsé1  ß–中")), st.characters(codec="utf-8")), max_size=30), max_size=6))
def test_any_text(texts):
    assert encoded(texts) == [ids_of(t) for t in texts]


def test_a_small_memory_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(token_pack, "MOST_PARTS", 5)
    e = token_pack.Encoder(PATH)
    for t in ["one two three", "four five six seven", "one two three four"] * 2:
        ends, ids = e.encode(pa.array([t]))
        assert ids.tolist() == ids_of(t)


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    e = token_pack.Encoder(path)
    assert not e.in_parts
    texts = ["Some Text  here", None, "and more"]
    ends, ids = e.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)] == [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("bits", range(1, 33))
def test_bits(bits):
    rng = random.Random(bits)
    ids = [rng.randrange(1 << bits) for _ in range(1003)]
    data = token_pack.pack(np.array(ids, np.uint32), bits)
    plain = sum(x << (i * bits) for i, x in enumerate(ids))
    assert data == plain.to_bytes(-(-1003 * bits // 8), "little")
    assert token_pack.unpack(data, 1003, bits).tolist() == ids
    with pytest.raises(ValueError):
        token_pack.unpack(data[:-1], 1003, bits)
    assert token_pack.bits_of(1 << bits) == bits


def expected(rows):
    """(doc_id, start, n_tokens, ids_crc32) by plain Python, for rows without equal doc_ids."""
    at, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*ids_of(text), 2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [tuple(r) for r in token_pack.round_trip(docs, PATH).orderBy("start").collect()]
    assert got == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def stored(spark, rows, **kw):
    docs = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, file string, ids int, start long").repartition(3)
    folder = scratch_dir(spark, "tokens")
    files = token_pack.write(docs, folder, PATH, **kw)
    return folder, files


def test_odd_rows_small_files_and_windows(spark):
    rows = [(37 * i % 97, t) for i, t in enumerate(ODD)] + [(None, "no id"), (-5, "below")]
    folder, files = stored(spark, rows, file_ids=50, block=16)
    assert files.count() > 1
    got = token_pack.read(spark, folder, files).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == expected(rows)
    every = [x for r in got for x in r["ids"]]
    assert every == [x for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])) for x in [*ids_of(t), 2]]
    n = len(every)
    wanted = spark.createDataFrame([(a,) for a in [0, 0, 3, 40, 49, 50, 51, n // 2, n - 1, n, n + 9, -1]], "at long")
    for length in (1, 13, 200):
        found = {r["at"]: r["ids"] for r in token_pack.windows(folder, files, wanted, length).collect()}
        assert found == {a: every[a : a + length] for a in [0, 3, 40, 49, 50, 51, n // 2, n - 1]}


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "same text")] * 50 + [(1, "other")] * 3 + [(None, None)] * 4
    folder, files = stored(spark, rows)
    got = token_pack.read(spark, folder, files, ids=False).orderBy("start").collect()
    assert len(got) == 57 and [r["doc_id"] for r in got[:4]] == [None] * 4
    at = 0
    for r in got:
        assert r["start"] == at and r["ids"] is None
        at += r["n_tokens"]
    folder, files = stored(spark, [])
    assert files.count() == 0 and token_pack.read(spark, folder, files).count() == 0
    assert token_pack.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_a_file_cut_or_changed_anywhere_is_an_error(spark, tmp_path):
    folder, files = stored(spark, [(i, f"text number {i}") for i in range(30)], block=16)
    name = files.where("ids > 0").first()["file"]
    at = folder.removeprefix("file://").removeprefix("file:") + "/" + name
    data = open(at, "rb").read()
    bad = tmp_path / "x.tokens"
    for cut in range(len(data)):
        bad.write_bytes(data[:cut])
        with pytest.raises(ValueError):
            token_pack.Shard(str(bad))
    bad.write_bytes(bytes([data[0] ^ 1]) + data[1:])
    with pytest.raises(ValueError):
        token_pack.Shard(str(bad)).document(0)
    bad.write_bytes(data)
    shard = token_pack.Shard(str(bad))
    assert shard.bits == 16 and shard.document(int(shard.docs) - 1)[-1] == 2


def test_long_text_is_encoded_whole(spark):
    text = " ".join(f"w{i}," for i in range(60_000)) + "x" * 20_000
    folder, files = stored(spark, [(1, text), (2, "b")])
    r = token_pack.read(spark, folder, files).where("doc_id = 1").first()
    assert r["ids"] == [*ids_of(text), 2]


def test_leftovers_of_a_lost_task_are_not_read(spark):
    folder, files = stored(spark, [(1, "a"), (2, "b")])
    token_pack.write(spark.createDataFrame([(9, "left by a lost task")], "doc_id long, text string"), folder, PATH)
    assert {r["doc_id"] for r in token_pack.read(spark, folder, files).select(F.col("doc_id")).collect()} == {1, 2}
