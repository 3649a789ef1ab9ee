"""The Merkle manifest against a plain tree in Python."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from spanloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    out = ""
    for value in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text):
        out += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return h(out)


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([h("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return out


def climb(levels, i, node):
    """(siblings as one string, the root from node) of the i-th leaf."""
    siblings = ""
    for level in levels[:-1]:
        low = i - i % 3
        run = level[low : low + 3]
        siblings += "".join(run[: i - low] + run[i - low + 1 :])
        run[i - low] = node
        node, i = h("".join(run)), i // 3
    return siblings, node


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        text = r["text"]
        even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, text), leaf_of(r, text.replace("\n", "") if even and text is not None else text), r["doc_id"]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(groups[s])]) for s in names}
    top = levels_of([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, other, doc) in enumerate(sorted(groups[s])):
            low, node = climb(trees[s], i, other)
            high, root = climb(top, k, node)
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], h(low + high), root, root == top[-1][0]))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def sample(sizes, seed=1):
    rng = random.Random(seed)
    rows, ids = [], rng.sample(range(-1000, 100_000), sum(sizes.values()))
    for source, n in sizes.items():
        for _ in range(n):
            doc = ids.pop()
            rows.append({"doc_id": doc, "text": rng.choice([None, "", "a\nb", "\n", f"text {doc}\n\n", "é" * rng.randrange(5)]), "lang": rng.choice([None, "de", "1:"]), "source": source, "n_chars": rng.choice([None, doc, 0])})
    rng.shuffle(rows)
    return rows


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    assert as_rows(merkle.verified(merkle.build(docs))) == brute(rows)


@pytest.mark.parametrize("span", [1, 2, 3])
def test_trees_of_many_sizes_in_passes(spark, span):
    """Sources of 1 to 82 leaves, among them powers of three, in passes of one to three levels."""
    rows = sample({None: 4, "": 1, "a": 2, "B": 3, "b": 9, "c": 10, "é": 27, "z": 28, "zz": 82, "Z": 1, "nul": 5})
    assert as_rows(merkle.verified(merkle.build(frame(spark, rows), span), span)) == brute(rows)


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1}, {"a": 7}, {"a": 1, "b": 1}, {"x": 1, "y": 1, "w": 1, "v": 1}])
def test_small_tables(spark, sizes):
    rows = sample(sizes)
    assert as_rows(merkle.verified(merkle.build(frame(spark, rows)))) == brute(rows)


def test_repeated_rows_null_ids_long_texts_and_other_columns(spark):
    rows = sample({"a": 5, "b": 2})
    rows += [dict(rows[0])] * 40 + [{"doc_id": None, "text": t, "lang": None, "source": "a", "n_chars": None} for t in ("x\n", None, "x\n")] + [{"doc_id": rows[0]["doc_id"], "text": "y" * 300_000 + "\n", "lang": "de", "source": rows[0]["source"], "n_chars": 1}]
    docs = frame(spark, rows).selectExpr("*", "1 AS pos", "'q' AS hash", "2 AS n", "'p' AS path", "3 AS level")
    assert as_rows(merkle.verified(merkle.build(docs))) == brute(rows)


def test_empty_table(spark):
    m = merkle.build(frame(spark, []))
    assert m.root is None and merkle.verified(m).count() == 0 and merkle.proofs(m).count() == 0


def test_proofs_by_coordinate_and_audit(spark):
    rows = sample({"a": 30, "b": 4, "c": 1})
    docs = frame(spark, rows)
    m = merkle.build(docs, 2)
    every = {(r["source"], r["pos"]): r for r in merkle.proofs(m, None, 2).collect()}
    assert len(every) == 35 and all(merkle.fold(r["leaf"], r["path"]) == m.root for r in every.values())
    asked = [("a", 0), ("a", 29), ("b", 3), ("c", 0), ("c", 5), ("none", 1), ("a", 29)]
    some = {(r["source"], r["pos"]): r for r in merkle.proofs(m, spark.createDataFrame(asked, "source string, pos long"), 2).collect()}
    assert set(some) == {("a", 0), ("a", 29), ("b", 3), ("c", 0)} and all(some[k] == every[k] for k in some)
    changed = [dict(r, text="changed") if r["doc_id"] == rows[0]["doc_id"] else r for r in rows] + [dict(rows[1], doc_id=10**9)]
    found = {r["doc_id"]: r["verified"] for r in merkle.audit(frame(spark, changed), m.root, merkle.proofs(m, None, 2)).collect()}
    assert found.pop(10**9) is None and [d for d, ok in found.items() if not ok] == [rows[0]["doc_id"]]


def test_store_has_every_level_once(spark):
    m = merkle.build(frame(spark, sample({"a": 30})), 2)
    counts = {r["level"]: r["count"] for r in m.sources.nodes.groupBy("level").count().collect()}
    assert counts == {0: 30, 1: 10, 2: 4, 3: 2, 4: 1} and m.sources.deepest == 4
