"""Pseudonyms, toxicity, SentencePiece and the pipeline."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import mixing, pii, toxicity
from spanloom.llm import sentencepiece_lattice as sp

PRIVATE = ["call +1 (988) 555-2485 or 212-555-0199.", "mail Bosbt.42@mail8.example.com, x", "pan 4041894974608795 bad 4041894974608796 4111 1111 1111 1111", "on 2024-02-29 not 2023-02-29 or 31/12/1999.", "ip 70.123.182.155 no 300.1.1.1 v 1.2.3.4.5", "ssn 123-45-6789 000-12-3456", None, "", "plain text", "a 4041894974608795 b 4041894974608795"]


def test_pseudonyms_keep_format_and_come_back(spark):
    docs = spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string").withColumn("_hits", F.lit(1))
    out = pii.pseudonymise(docs, "k1")
    rows = {r["doc_id"]: r for r in out.collect()}
    kinds = {i: [v["kind"] for v in r["pii"]] for i, r in rows.items()}
    assert kinds == {0: ["phone", "phone"], 1: ["email"], 2: ["card", "card"], 3: ["date", "date"], 4: ["ip"], 5: ["ssn"], 6: [], 7: [], 8: [], 9: ["card", "card"]}
    assert rows[9]["pii"][0] == rows[9]["pii"][1] and rows[9]["pii"][0]["pseudonym"] == rows[2]["pii"][0]["pseudonym"]
    for i, r in rows.items():
        if kinds[i]:
            assert r["text"] != PRIVATE[i]
        else:
            assert r["text"] == PRIVATE[i]
    assert "4041894974608796" in rows[2]["text"] and "2023-02-29" in rows[3]["text"] and "000-12-3456" in rows[5]["text"]
    again = pii.pseudonymise(out.drop("pii"), "k1")
    assert {r["doc_id"]: [v["kind"] for v in r["pii"]] for r in again.collect()} == kinds
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymise(out.drop("pii"), "k1", back=True).collect()}
    assert back == dict(enumerate(PRIVATE))
    assert {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, "k2").collect()} != {i: r["text"] for i, r in rows.items()}


@pytest.mark.parametrize("a,b", [(1, 7), (7, 1), (10, 10), (319, 229), (13, 50)])
def test_feistel_is_a_permutation(spark, a, b):
    rows = spark.range(a * b).select("id", pii.feistel(F.col("id"), a, b, F.lit("t")).alias("x")).select("id", "x", pii.feistel(F.col("x"), a, b, F.lit("t"), True).alias("y")).collect()
    assert sorted(r["x"] for r in rows) == list(range(a * b)) and all(r["y"] == r["id"] for r in rows)


def test_pseudonyms_of_long_local_parts(spark):
    mails = ["edtionrereinsh.78@x.org", "Maximiliana.Featherstonehaugh@x.org", "a1.1234567890123456789@x.org", "q" * 300 + "@x.org", "abcdefghijklm@x.org", "abcdefghijkln@x.org", "abcdefghijkl@x.org"]
    rng = random.Random(5)
    mails += ["".join(rng.choices("mnopqrstuvwxyz", k=12)) + "@x.org" for _ in range(100)]  # values beyond 2^53
    docs = spark.createDataFrame([(i, f"to {m}.") for i, m in enumerate(mails)], "doc_id long, text string")
    out = pii.pseudonymise(docs, "k1")
    got = [r["text"] for r in out.orderBy("doc_id").collect()]
    for mail, text in zip(mails, got, strict=True):
        old, new = mail.split("@")[0], text[3:].split("@")[0]
        assert len(old) == len(new) and all((a.islower(), a.isupper(), a.isdigit()) == (b.islower(), b.isupper(), b.isdigit()) and (a.isalnum() or a == b) for a, b in zip(old, new, strict=True))
        for kind in (str.isalpha, str.isdigit):  # what follows the 12th
            tail, made = ("".join(c for c in x if kind(c))[12:] for x in (old, new))
            assert not tail or tail != made
    assert len(set(got)) == len(mails)
    assert [r["text"] for r in pii.pseudonymise(out.drop("pii"), "k1", back=True).orderBy("doc_id").collect()] == [f"to {m}." for m in mails]


def test_phones_with_any_codes(spark):
    phones = ["+1 (017) 555-7713", "+1 (988) 055-7713", "+1 199-999-9999", "+1 (000) 000-0000", "+1 (988) 555-7713", "+1.200.199.0001"]
    docs = spark.createDataFrame([(i, f"at {p}.") for i, p in enumerate([*phones, "017-555-7713", "(017) 555-7713"])], "doc_id long, text string")
    out = pii.pseudonymise(docs, "k1")
    got = [r["text"] for r in out.orderBy("doc_id").collect()]
    for old, text in zip(phones, got, strict=False):
        new = text[3:-1]
        assert new != old and [c if not c.isdigit() else "0" for c in new] == [c if not c.isdigit() else "0" for c in old]
        valid = lambda p: (d := "".join(c for c in p if c.isdigit()))[0] == "1" and d[1] > "1" and d[4] > "1"
        assert valid(old) == valid(new)
    assert got[6:] == ["at 017-555-7713.", "at (017) 555-7713."]
    assert [r["text"] for r in pii.pseudonymise(out.drop("pii"), "k1", back=True).orderBy("doc_id").collect()] == [r["text"] for r in docs.collect()]


def test_pii_empty(spark):
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), "k").count() == 0


INSULTS = ["vilewort", "grimslur", "foulterm", "réeuxbad"]


def classify(token):
    """The kind of a whole token, by other means than the operator's patterns."""
    import datetime
    import ipaddress

    digits = re.sub("[^0-9]", "", token)
    if re.fullmatch(r"[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}", token):
        return "phone" if digits[0] in "23456789" and digits[3] in "23456789" else None
    if 13 <= len(digits) <= 19 and (token == digits or re.fullmatch(r"[0-9]{4}(-[0-9]{4}){3}", token)):
        double = [int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
        return "card" if sum(double) % 10 == 0 else None
    if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", token):
        area, group, serial = (int(x) for x in token.split("-"))
        return "ssn" if 0 < area < 900 and area != 666 and group and serial else None
    if "@" in token:
        return "email"
    if token.count(".") == 3:
        try:
            ipaddress.IPv4Address(token)
            return "ip"
        except ValueError:
            return None
    for form in ("%Y-%m-%d", "%d/%m/%Y"):
        try:
            if len(digits) == 8 and 1900 <= datetime.datetime.strptime(token, form).year <= 2099:
                return "date"
        except ValueError:
            pass
    return None


def test_pii_against_another_finder(spark):
    rng = random.Random(12)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    makers = [
        lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: num(16), lambda: "-".join(num(4) for _ in range(4)), lambda: num(rng.randrange(12, 21)), lambda: f"{num(3)}-{num(2)}-{num(4)}",
        lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), lambda: f"{rng.randrange(1890, 2110)}-{rng.randrange(1, 14):02d}-{rng.randrange(1, 33):02d}", lambda: f"{rng.randrange(1, 33):02d}/{rng.randrange(1, 14):02d}/{rng.randrange(1890, 2110)}",
        lambda: "christopher.montgomery.the.third" + num(3) + "@example.com", lambda: "plain", lambda: num(5),
    ]
    tokens = [[rng.choice(makers)() for _ in range(20)] for _ in range(150)]
    docs = spark.createDataFrame([(i, " ".join(t), "raw", "h", 1) for i, t in enumerate(tokens)], "doc_id long, text string, pii string, _values string, pii_made int")
    out = pii.pseudonymise(docs, "k")
    assert out.columns == [*docs.columns, "pii_"]
    seen = set()
    for r in out.collect():
        old, new = tokens[r["doc_id"]], r["text"].split(" ")
        kinds = [classify(t) for t in old]
        seen |= set(kinds)
        assert [v["kind"] for v in r["pii_"]] == [k for k in kinds if k] and (r["pii"], r["_values"], r["pii_made"]) == ("raw", "h", 1)
        for a, b, k in zip(old, new, kinds, strict=True):
            assert classify(b) == k if k else a == b
            assert re.sub("[0-9]", "0", a) == re.sub("[0-9]", "0", b) or k in ("email", "ip")
        assert not any("montgomery" in t or "christopher" in t for t in new)
    assert seen == {None, "phone", "card", "ssn", "ip", "date", "email"}


def test_pii_long_text_and_repeated_rows(spark):
    text = ("lorem ipsum " * 20_000) + "call 415-555-2671 now"
    rows = pii.pseudonymise(spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string"), "k").collect()
    assert len({r["text"] for r in rows}) == 1 and rows[0]["text"] != text and rows[0]["text"][: len(text) - 20] == text[:-20]


def test_pii_key_comes_from_the_session(spark):
    with pytest.raises(ValueError):
        pii.configured_key(spark)
    spark.conf.set(pii.KEY_SETTING, "secret")
    assert pii.configured_key(spark) == "secret"
    spark.conf.unset(pii.KEY_SETTING)


def labelled(n, seed):
    rng = random.Random(seed)
    words = [f"clean{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                text.insert(rng.randrange(len(text)), rng.choice(INSULTS).upper() if rng.random() < 0.3 else rng.choice(INSULTS) + "%%%")
        rows.append((seed * 100_000 + i, " ".join(text), toxic if rng.random() > 0.02 else 1 - toxic, toxic))
    return rows


def test_toxicity_held_out(spark):
    train, test = labelled(1500, 1), labelled(400, 2)
    schema = "doc_id long, text string, toxic int, truth int"
    docs = spark.createDataFrame(train, schema)
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert (np.diff(model.thetas) >= 0).all() and (model.weights > 0).all()
    out = toxicity.score(spark.createDataFrame(test, schema).withColumn("grade", F.lit("clash")), model).toPandas().set_index("doc_id")
    truth = {r[0]: r[3] for r in test}
    wrong = [i for i, r in out.iterrows() if bool(r["rejected"]) != bool(truth[i])]
    assert len(wrong) <= 4
    assert out["severity"].between(0, 2).all() and (out["grade"] <= 2).all()
    kept = toxicity.keep_clean(spark.createDataFrame(test, schema), model)
    assert kept.columns == ["doc_id", "text", "toxic", "truth"] and {r["doc_id"] for r in kept.collect()} == set(out.index[~out["rejected"]])


def test_toxicity_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x " * 10_000), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (2, 0), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == 4 and not any(r["rejected"] for r in out)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert len(toxicity.train(docs, labels.limit(0)).features) == 0


def test_features_ignore_case_and_marks():
    one = lambda t: {(int(a), int(b)) for owner, f in toxicity.features(pa.array([t])) for a, b in zip(owner, f, strict=True)}
    assert one("ÉTÉ%% Word### word") == one("été word") and one(None) == one("") == set()


def test_fit_is_at_the_optimum():
    """No small step of any parameter lowers the loss, written down anew; weights stay at least zero."""
    rng = np.random.default_rng(4)
    x = rng.random((400, 12)) < 0.2
    latent = x[:, :4].sum(axis=1) * 2.0 + rng.logistic(size=400)
    grades = (latent > 1.5).astype(int) + (latent > 3.5)
    row, feature = np.nonzero(x)
    model = toxicity._descend(grades, row, feature, np.arange(12), 1e-2)
    w = np.zeros(12)
    w[model.features] = model.weights

    def loss(w, theta):
        sig = lambda z: 1 / (1 + np.exp(-z))
        at = np.concatenate([np.zeros((400, 1)), sig(theta[None, :] - (x @ w)[:, None]), np.ones((400, 1))], axis=1)
        return -np.log(at[np.arange(400), grades + 1] - at[np.arange(400), grades]).mean() + 1e-2 / 2 * w @ w

    best = loss(w, model.thetas)
    assert (w >= 0).all() and (w[:4] > 0.5).all()
    for i in range(12):
        for step in (-0.05, 0.05):
            moved = w.copy()
            moved[i] = max(0, moved[i] + step)
            assert loss(moved, model.thetas) >= best - 1e-6
    for j in range(2):
        for step in (-0.05, 0.05):
            assert loss(w, model.thetas + step * (np.arange(2) == j)) >= best - 1e-6


def test_repeated_documents_of_a_labelled_id_count_once(spark):
    docs = spark.createDataFrame([(1, "good words here")] * 30 + [(1, "other words"), (2, "bad words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0)], "doc_id long, grade int")
    grades, row, feature = toxicity.sample(docs, labels)
    assert grades.tolist() == [1, 1] and set(row.tolist()) == {0, 1}
    assert sorted(grades.tolist()) == sorted(toxicity.sample(docs.repartition(5), labels)[0].tolist())


TOY = sp.Vocabulary(tuple([("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] + [(p, s, 1) for p, s in [("▁", -5.0), ("a", -3.0), ("b", -3.0), ("ab", -4.0), ("▁a", -3.5), ("▁ab", -4.0), ("bab", -5.5), ("ba", -4.5), ("▁▁", -6.0), ("é", -2.0), ("aé", -6.0)]]))


def best_paths(word):
    """All segmentations of a word with their sums."""
    out = []
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at, pieces, total = 0, [], 0.0
        for end in [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]:
            piece = word[at:end]
            if piece in TOY.table:
                pieces.append(TOY.table[piece][0])
                total += TOY.table[piece][1]
            elif len(piece) == 1:
                pieces += [TOY.byte_ids[b] for b in piece.encode()]
                total += TOY.unknown_score
            else:
                break
            at = end
        else:
            out.append((total, pieces))
    return out


def test_viterbi_is_the_best_of_all_paths(spark):
    words = ["".join(w) for n in (1, 2, 4, 6) for w in itertools.islice(itertools.product("ab▁éz", repeat=n), 0, None, 1 if n < 4 else 37)]
    for w in words:
        paths = best_paths(w)
        top = max(t for t, _ in paths)
        assert any(t == top and p == TOY.viterbi(w) for t, p in paths)
    rows = sp.encode_words(spark.createDataFrame([(0, i, w.replace("▁", " ")) for i, w in enumerate(words)], "bucket int, number int, word string"), TOY).collect()
    assert len(rows) == len(words) and all(list(r["ids"]) == TOY.viterbi(words[r["number"]]) for r in rows)


def test_encode_survives_a_source_that_changes_its_order(spark):
    """The corpus is scanned once, so rows that come in another order the next time cannot meet the wrong words."""
    rows = [(i, f"{a} {b} {c}") for i, (a, b, c) in enumerate(itertools.permutations(["alpha", "beta", "gamma", "delta", "epsilon"], 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").orderBy(F.rand())
    vocabulary = sp.Vocabulary.load()
    got = {r["doc_id"]: r["text"] for r in sp.decode(sp.encode(docs, vocabulary), vocabulary).collect()}
    assert got == dict(rows)


TEXTS = [None, "", " ", "ab  ab\nba", "zzz é日𝄞", "a" * 1000 + " b", "ab" * 300, "the same", "the same", "\t\r\n"]


def test_encode_and_decode(spark, tmp_path):
    spark.createDataFrame([(i if i != 3 else None, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for vocabulary in (TOY, sp.Vocabulary.load()):
        out = sp.encode(docs, vocabulary).persist()
        want = {t or "": vocabulary.viterbi((" " + t).replace(" ", "▁")) if t else [] for t in TEXTS}
        back = {r["doc_id"]: r["text"] for r in sp.decode(out, vocabulary).collect()}
        rows = out.collect()
        assert len(rows) == len(TEXTS)
        for r in rows:
            text = TEXTS[3 if r["doc_id"] is None else r["doc_id"]] or ""
            assert list(r["ids"]) == want[text] and r["n_pieces"] == len(want[text]) and r["text_crc32"] == r["decoded_crc32"] and back[r["doc_id"]] == text
        out.unpersist()
    assert sp.encode(docs.limit(0), TOY).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    sizes = [docs.count()]
    from spanloom.llm.common import materialise

    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialise(stage(spark, docs, sf), "test-stage")
        sizes.append(out.count())
        if i < 4:
            assert out.columns == columns
            if i < 3:
                assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = out
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] and sizes[4] == sizes[5] and docs.where("text_crc32 <> decoded_crc32").count() == 0


def chained(rows, model, vocabulary):
    """(documents that reach the mixture, pieces of a text) of the pipeline, one text after another."""
    from test_join_media_warc import brute

    def rejected(text):
        found = {int(f) for _, some in toxicity.features(pa.array([text], pa.string())) for f in some}
        total = sum(w for f, w in zip(model.features.tolist(), model.weights.tolist(), strict=True) if f in found)
        return model.above(np.array([total]))[0, 0] >= toxicity.REJECT_AT

    clean = [r for r in rows if not rejected(r[1])]
    first = {}
    for i, text, _ in sorted(clean):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), i)
    single = [r for r in clean if r[0] in set(first.values())]
    alone = {i for i, _, component in brute([(i, t) for i, t, _ in single]) if i == component}
    assert len(rows) > len(clean) > len(single) > len(alone)  # every stage has something to drop
    return [r for r in single if r[0] in alone], lambda t: vocabulary.viterbi((" " + t).replace(" ", "▁")) if t else []


@pytest.mark.parametrize("broken", [None, 0, 1, 2, 3])
def test_pipeline_against_brute_force(spark, tmp_path, monkeypatch, broken):
    import corpus_pipeline

    made = labelled(300, 4)
    rows = [(i, t, f"s{i % 3}" if i % 7 else None) for i, t, _, _ in made]
    rows += [(900_000 + k, "  ".join(t.split()), "s1") for k, (_, t, _) in enumerate(rows[:20])]  # exact copies
    rows += [(910_000 + k, t + " end", "s2") for k, (_, t, _) in enumerate(rows[20:60])]  # near ones of the longer texts
    rows += [(920_000, None, "s1"), (920_001, "", "s2"), (920_002, "two words", "s0"), (920_003, "three short words", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, toxic) for i, _, toxic, _ in made], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    left, pieces = chained(rows, toxicity.train(docs, labels), sp.Vocabulary.load())
    text = {i: t for i, t, _ in left}
    if broken is not None:  # a stage that loses some of the longer documents does not pass
        lost = sorted(text, key=lambda i: -len(text[i] or ""))[:3]
        name, stage = corpus_pipeline.STAGES[broken]
        changed = list(corpus_pipeline.STAGES)
        changed[broken] = (name, lambda s, d, f: stage(s, d, f).where(~F.col("doc_id").isin(lost)))
        monkeypatch.setattr(corpus_pipeline, "STAGES", changed)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = Counter(r["doc_id"] for r in got)
    right = set(copies) <= set(text)
    size = {i: len((t or "").split()) for i, t in text.items()}
    of = {s: [i for i, _, source in left if source == s] for s in {r[2] for r in left}}
    target = mixing.targets([(s, sum(size[i] for i in ids)) for s, ids in of.items()])
    for s, ids in of.items():
        rate = target[s] / sum(size[i] for i in ids)
        right &= all(copies[i] in ((int(rate + 1e-9), int(rate + 1e-9) + 1) if size[i] else (0,)) for i in ids)
        right &= abs(sum(copies[i] * size[i] for i in ids) - target[s]) <= max(size[i] for i in ids) / 2 + 1e-6
    right &= all(list(r["ids"]) == pieces(text[r["doc_id"]]) and r["n_pieces"] == len(r["ids"]) for r in got if r["doc_id"] in text)
    assert right == (broken is None)


def test_the_driver_gets_screened_features_alone(spark):
    """The model of the features that the executors screen is that of all; most features stay there."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(3000)]
    rows = [(i, " ".join(rng.sample(words, 60)) + (" vilest wretched" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)] + [(300, None, 0), (301, "", 1)]
    both = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    docs, labels = both.select("doc_id", "text"), both.select("doc_id", F.col("toxic").alias("grade"))
    grades, row, feature = toxicity.sample(docs, labels)
    few = toxicity.sample(docs, labels, screened=True)
    assert few[0].tolist() == grades.tolist() and 0 < len(few[2]) < len(feature) / 20
    whole, model = toxicity.fit(toxicity.severity_grades(grades, row, feature), row, feature), toxicity.train(docs, both.select("doc_id", "toxic"))
    assert len(model.features) and all(np.array_equal(getattr(whole, x), getattr(model, x)) for x in ("features", "weights", "thetas"))
