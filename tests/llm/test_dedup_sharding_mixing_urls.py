"""Exact dedup, sharding, mixing and URL filter against brute force, with odd inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.llm import exact_dedup, mixing, sharding, url_filter
from spanloom.llm.common import mix64

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOC)


ODD = [(5, "a  b", "x"), (3, "a\tb", "x"), (9, "a b ", "y"), (1, None, "y"), (2, "", None), (7, "c", "x"), (7, "c", "x"), (None, "c", "x"), (None, "only", None), (8, "z" * 50_000, "y"), (11, "z" * 50_000, "x")]


def test_dedup_against_brute_force(spark):
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.decide(docs_of(spark, ODD)).collect()), key=repr)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, _ in ODD:
        groups[norm(t)].append(i)
    want = []
    for i, t, _ in ODD:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("hot", [0, 1, 2, 10])
def test_dedup_hot_digests_take_another_way_to_the_same_result(spark, monkeypatch, hot):
    want = sorted(map(repr, exact_dedup.decide(docs_of(spark, ODD)).collect()))
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot)
    assert sorted(map(repr, exact_dedup.decide(docs_of(spark, ODD)).collect())) == want


def test_dedup_keep_has_all_columns_once(spark):
    extra = docs_of(spark, ODD).withColumn("digest", F.lit(1)).withColumn("winner", F.lit("w")).withColumn("document", F.lit("d")).withColumn("_document", F.lit("d"))
    kept = exact_dedup.keep(extra)
    assert kept.columns == extra.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([3, 9, 1, 7, 8, None], key=repr)


def test_dedup_keeps_each_text_of_a_repeated_id(spark):
    rows = [(3, "copy", "x"), (5, "copy", "x"), (5, "own", "x"), (7, "left", "x"), (7, "right", "x"), (7, "right", "x"), (None, "copy", "x"), (None, "bare", "x"), (None, "bare", "x")]
    for parts in (1, 5):
        kept = exact_dedup.keep(docs_of(spark, rows).repartition(parts))
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(3, "copy"), (5, "own"), (7, "left"), (7, "right"), (None, "bare")], key=repr)


@pytest.mark.parametrize("buckets", [1, 40])
def test_slots_answer_for_history_and_members(spark, buckets):
    rows = [(i, str(i % 30)) for i in range(45)], [(100 + i, str(20 + i % 25)) for i in range(60)] + [(None, "only"), (None, "1")]
    old, new = (exact_dedup.digests(spark.createDataFrame(r, "doc_id long, text string")) for r in rows)
    got = exact_dedup.look_up(new, exact_dedup.build_index(old, buckets), buckets).collect()
    want = []
    for text in {t for r in rows for _, t in r}:
        ids = [[exact_dedup.NO_ID if i is None else i for i, t in r if t == text] for r in rows]
        want.append((hashlib.sha256(text.encode()).digest(), bool(ids[0]), min(ids[0] + ids[1]), len(ids[0] + ids[1])))
    assert sorted((bytes(r["digest"]), r["member"], r["winner"], r["n"]) for r in got) == sorted(want)


def test_dedup_empty(spark):
    assert exact_dedup.decide(docs_of(spark, [])).count() == 0 and exact_dedup.keep(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 100, 5000])
def test_perfect_hash_is_minimal_and_byte_checked(n):
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), "<u8").reshape(-1, 4)
    sizes, bits = exact_dedup.build_mphf(keys)
    assert sorted(exact_dedup.mphf_slots(keys, sizes, bits).tolist()) == list(range(n))


def shards(spark, rows, k=24):
    return sharding.assign(docs_of(spark, rows), k).toPandas()


def test_sharding_balances_bytes_and_slots(spark):
    rng = random.Random(2)
    rows = [(i, "w" * int(rng.expovariate(1 / 300)), f"s{i % 5}") for i in range(1500)] + [(10_000 + i, "copy " * 40, "s0") for i in range(700)] + [(20_000, "é" * 3000, "s1"), (20_001, None, None), (None, "", "s2")]
    out = shards(spark, rows, 12)
    assert len(out) == len(rows) and set(out["law"]) == {"bytes"} and out["grown_shard"].isna().all()
    sums = out.groupby("shard")["size"].sum()
    assert set(sums.index) == set(range(12))
    assert sums.max() - sums.min() <= 2 * out["size"].max()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    text = {i: t or "" for i, t, _ in rows}
    for r in out[out["doc_id"].notna()].head(300).itertuples():
        assert (r.size if False else r[2]) == len(text[int(r.doc_id)].encode()) + 8 and r.text_crc32 == crc32(text[int(r.doc_id)].encode())


def median_tree(rows, k, first, spread, dims=("length", "source", "lang")):
    """(row number, shard) by direct weighted medians: the widest dimension, cut at (value, tie)."""
    if k == 1 or not rows:
        return [(r["n"], first) for r in rows]
    width = [(max(r[d] for r in rows) - min(r[d] for r in rows)) / spread[d] for d in dims]
    key = lambda r: (r[dims[width.index(max(width))]], r["tie"])
    need, upto, cut = max(1, sum(r["size"] for r in rows) * (k // 2) // k), 0, None
    for r in sorted(rows, key=key):
        upto, cut = upto + r["size"], key(r)
        if upto >= need:
            break
    left, right = [r for r in rows if key(r) <= cut], [r for r in rows if key(r) > cut]
    return median_tree(left, k // 2, first, spread) + median_tree(right, k - k // 2, first + k // 2, spread)


def test_sharding_against_direct_medians(spark):
    rng = random.Random(5)
    docs = docs_of(spark, [(i, "w" * int(rng.expovariate(1 / 200)), rng.choice(["a", "a", "a", "b", None])) for i in range(600)])
    rows = [r.asDict() | {"n": r["doc_id"]} for r in sharding.base_rows(docs).collect()]
    spread = {d: max(1, max(r[d] for r in rows) - min(r[d] for r in rows)) for d in ("length", "source", "lang")}
    got = sharding.assign(docs, 7).collect()
    assert {(r["doc_id"], r["shard"]) for r in got} == set(median_tree(rows, 7, 0, spread))
    unnamed = {d["doc_id"] for d in docs.where("source is null").collect()}
    assert unnamed and all((r["source"] == 0) == (r["n"] in unnamed) for r in rows)  # before all names


def test_sharding_small_tables(spark):
    for n in (1, 2, 24):
        some = shards(spark, [(i, "t" * i, f"s{i}") for i in range(n)])
        assert sorted(some["doc_id"]) == list(range(n)) and some.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(len(s)))).all()
    assert len(shards(spark, [])) == 0
    few = shards(spark, [(1, "a", "x"), (1, "a", "x"), (2, None, None)])
    assert len(few) == 3 and few.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(len(s)))).all()


def test_targets_share_excess_by_weight():
    got = mixing.targets([("b", 100), ("a", 100), (None, 100)])
    assert got == pytest.approx({"a": 200.0, "b": 450 * 1 / 6 + 25 / 3, None: 450 * 2 / 6 + 50 / 3})
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


@pytest.mark.parametrize("seed", range(5))
def test_pivot_keeps_the_sum(seed):
    rng = np.random.default_rng(seed)
    size, part = rng.integers(1, 100, 200).astype(float), rng.random(200)
    out, held = mixing.pivot(size, part, rng.random(200))
    assert (size * out).sum() == pytest.approx((size * part).sum())
    loose = [i for i in range(200) if out[i] not in (0.0, 1.0)]
    assert loose == ([held] if held >= 0 else [])


def test_mixing_meets_targets_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["s1", "s2", "s2", "s10", None])) for i in range(1200)] + [(None, "x y", "s1"), (5000, None, "s2")]
    a = mixing.decide(docs_of(spark, rows)).toPandas()
    b = mixing.decide(docs_of(spark, rows).repartition(7)).toPandas()
    key = lambda d: Counter((repr(r.doc_id), r[2], r.taken) for r in d.itertuples())
    assert key(a) == key(b) and len(a) == len(rows)
    assert (a["taken"] <= 2 * a["size"]).all()
    for _, g in a.groupby(a["source"].fillna("~")):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max() / 2 + 1e-6
    mixed = mixing.mix(docs_of(spark, rows).withColumn("copies", F.lit("clash")))
    assert mixed.columns[-1] == "copies" and mixed.count() == a["copies"].where(a["size"] > 0, 0).sum()


def test_mixing_takes_what_it_decided_for_repeated_rows(spark):
    rows = [(1, "a b c", "s1")] * 40 + [(2, "d e", "s1"), (2, "d e f", "s1"), (None, "g h", None), (None, "g h", None), (3, None, "s2")]
    docs = docs_of(spark, rows).withColumns({c: F.lit("clash") for c in ("mix_key", "mix_nth", "copies", "mix_copy", "_copies")})
    decided = Counter()
    for r in mixing.decide(docs).collect():
        decided[r["doc_id"], r["size"]] += r["copies"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter((r["doc_id"], len((r["text"] or "").split())) for r in mixed.collect()) == +decided


def test_mixing_empty(spark):
    assert mixing.decide(docs_of(spark, [])).count() == 0


URLS = [None, "", "no scheme", "http://Example.COM/en/7x?q#f", "https://a.b.example.com/en/12", "ftp://net/de/8", "http://example.net/de/81#x", "x://org", "http://org/es/", "http://myexample.com/en/7", "http://É.com/en/", "http://com?x", "a://b://com/en/", "http://example.com:80/en/7", "http://.com/en/", "http://x.org/es\n/es/"]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("most", [url_filter.MOST_BROADCAST, 0])
def test_urls_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MOST_BROADCAST", most)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string")
    clashes = ["url_host", "url_path", "url_best", "_host", "_path", "best", "key", "entry", "v", "block", "w0"]
    pages = pages.withColumns({c: F.lit(c) for c in [*clashes, "Host", "rule"]})
    got = url_filter.judge(pages, spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string"))
    assert got.columns == ["page_id", "url", *clashes, "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows} == {i: brute(u, url_filter.RULES) for i, u in enumerate(URLS * 2)}
    assert all(r[c] == c for r in rows for c in clashes)


def test_rules_of_the_contract(spark):
    urls = {"https://a.com/en/": ("com/en/", "block"), "http://example.com/en/71": ("example.com/en/7", "allow"), "http://a.net/de/": ("net/de/", "allow"), "http://www.example.net/de/81": ("example.net/de/8", "block"), "x://org/es/": ("org/es/", "block"), "http://a.net/en/": (None, "allow")}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(pages, spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string")).collect()
    assert {r["url"]: (r["rule"], r["verdict"]) for r in got} == urls


def test_long_list_against_brute_force(spark):
    rng = random.Random(8)
    rules = [(rng.choice(["com", "a.com", "b.org", "x.b.org"]), "/" + "".join(rng.choice("ab") for _ in range(rng.randrange(6))), rng.choice(["allow", "block"])) for _ in range(60)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"http://{rng.choice(['com', 'z.a.com', 'x.b.org', 'b.org', 'org'])}/{''.join(rng.choice('ab') for _ in range(rng.randrange(8)))}" for _ in range(300)]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    for r in got.collect():
        host, path, rule, verdict = brute(urls[r["page_id"]], rules)
        assert (r["host"], r["path"]) == (host, path) and len(r["rule"] or "") == len(rule or "")  # entries of equal length: the longer host
        if sum(len(h + p) == len(rule or "") for h, p, _ in rules if (host == h or host.endswith("." + h)) and path.startswith(p)) == 1:
            assert (r["rule"], r["verdict"]) == (rule, verdict)


def test_bloom_has_no_false_negatives_and_few_positives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom = url_filter.BlockedBloom(keys, 3000)
    assert bloom.may_hold(keys, "key").count() == 3000
    assert bloom.may_hold(spark.range(10_000).select(F.concat(F.lit("no"), "id").alias("key")), "key").count() < 300


def test_empty_list_allows_all(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://com/en/")], "page_id long, url string")
    assert url_filter.judge(pages, none).first()["verdict"] == "allow"


# ---------------------------------------------------------------- mixing: rows alike, rows without doc_id


def plain_mixture(rows, seed, block_rows, fan_in):
    """Decisions (doc_id, source, size, copies) of the reduction tree in plain Python, from rows (doc_id, source, size, key)."""
    target = mixing.targets([(s, sum(r[2] for r in rows if r[1] == s)) for s in {r[1] for r in rows}])
    number = {s: -(-sum(r[1] == s for r in rows) // block_rows) for s in target}
    most, out, level = max(number.values()), [], 0
    open_ = []
    for doc, source, size, key in rows:
        total = sum(r[2] for r in rows if r[1] == source)
        rate = target[source] / total if total else 0.0
        whole = int(rate + 1e-12) if size else 0
        open_.append([doc, source, size, key, whole, max(rate - whole, 0.0) if size else 0.0, key % number[source]])
    while True:
        groups = {}
        for r in open_:
            groups.setdefault((r[1], r[6]), []).append(r)
        rest = []
        for group in groups.values():
            group.sort(key=lambda r: (-r[2], r[3], r[5]))
            key = np.array([r[3] for r in group], np.int64).astype(np.uint64)
            luck = mix64(key ^ mix64(np.array([seed * 1_000_003 + level], np.uint64))) / 2.0**64
            done, held = mixing.pivot(np.array([r[2] for r in group]), np.array([r[5] for r in group]), luck)
            for i, r in enumerate(group):
                if i == held and most > 1:
                    rest.append([*r[:5], done[i], r[6] // fan_in])
                else:
                    out.append((r[0], r[1], r[2], r[4] + int(done[i] >= 0.5 if i == held else done[i])))
        if most == 1:
            return sorted(out, key=str)
        open_, level, most = rest, level + 1, -(-most // fan_in)


def test_draws_equal_a_plain_tree_and_rows_alike_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    monkeypatch.setattr(mixing, "ALIKE", 7)
    rng = random.Random(3)
    rows = [(None, "a", "one two three")] * 90 + [(None, "a", f"no id {i}") for i in range(60)] + [(5, "b", f"of five {i % 9} " * (i % 4)) for i in range(80)] + [(i, rng.choice(["a", "b", None]), "w " * rng.randrange(30)) for i in range(100)] + [(1, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    decided = mixing.decide(docs)
    blocks = {}
    numbered = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark")).withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source", "size", "mark").orderBy(F.lit(1))) - 1)
    keyed = [tuple(r) for r in numbered.select("doc_id", "source", "size", F.xxhash64("doc_id", "mark", F.col("nth").cast("long"))).collect()]
    for doc, source, _, key in keyed:
        if doc is None and source == "a":
            blocks[key % 12] = blocks.get(key % 12, 0) + 1
    assert len(blocks) > 8 and max(blocks.values()) < 40
    assert sorted(((r["doc_id"], r["source"], r["size"], r["copies"]) for r in decided.collect()), key=str) == plain_mixture(keyed, 7, 16, 3)
    mixed = mixing.mix(docs).groupBy("doc_id", "source", "text").count().collect()
    assert sum(r["count"] for r in mixed) == decided.agg(F.sum("copies")).first()[0]
