"""Toxicity: cumulative-link ordinal regression over sparse text features.

Grades 0 < 1 < ... < J share one weight vector across ordered thresholds: P(grade <= j) = sigmoid(theta_j - w.x).  The
expected severity is the sum over j of P(grade > j).  Features are whether a text has a word, or a word with a certain
beginning of 4 to 8 bytes, in letters of any language, lower-cased (ASCII and Latin-1), each hashed to 32 bits.

Fitting.  The sample is bounded: at most SAMPLE_ROWS labelled rows, those with the smallest hash of doc_id.  Its features
are counted on the executors; those that go with grade > 0 go to the driver, which fits weights of at least zero (clean
words cannot buy a text off) by projected gradient descent with an L2 penalty.  Scoring covers every whole text with one scan
and no shuffle.

The tables label rows as toxic or not; ``severity_grades`` makes three ordered grades of that: 0 not toxic; toxic rows
are 1, or 2 if they have more marker features (such as occur almost in toxic rows alone) than half of the toxic rows.

Defined cases: null and empty texts have no features and get the score of the thresholds alone; texts of any length
count whole; a feature counts once for a text however often it occurs; ties of the sampling hash go to the smaller
doc_id; labelled rows that repeat a doc_id count once (the most severe), and so do documents that
repeat one (the text whose features hash least); null labels are no labels; without labelled
rows or with one grade alone no text is rejected; empty tables give no rows; extra columns are ignored by ``score`` and
kept by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import from_bytes, materialise, mix64, sub_batches, text_bytes, word_hashes

#: Bound of the labelled sample that a model is fitted on.
SAMPLE_ROWS = 4000
PREFIXES = (4, 5, 6, 7, 8)
#: Features must occur in as many rows of the sample.
LEAST_ROWS = 3
#: Least association (standard deviations above chance) of a feature; penalty; most steps of a fit.
LEAST_Z, L2, STEPS = 4.0, 5e-4, 400
#: A text is rejected when P(grade > 0) is at least this.
REJECT_AT = 0.4


@dataclass(frozen=True)
class Model:
    """features: sorted hashes with weights that are not zero; thetas: increasing thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thetas: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) of each row, one column for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thetas[None, :] - score[:, None], -60, 60)))


_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def letters_only(texts: pa.Array) -> pa.Array:
    """Texts with A-Z and the capitals of Latin-1 lowered and every other ASCII character but letters made a space."""
    offsets, data = text_bytes(texts)
    data = _FOLD[data]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[capital] += 0x20
    return from_bytes(offsets, data)


def _folded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts' word counts, hashes of words, first eight bytes of words, sizes of words)."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten().cast(pa.large_binary())
    n = len(flat)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(flat.buffers()[1], "<i8", n + 1, flat.offset * 8) if n else np.zeros(1, np.int64)
    size = np.diff(offsets)
    data = np.concatenate([np.frombuffer(flat.buffers()[2], np.uint8, offsets[-1]), np.zeros(8, np.uint8)]) if n and offsets[-1] else np.zeros(8, np.uint8)
    head = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))[np.minimum(offsets[:-1], len(data) - 8)]
    owner, full = np.repeat(np.arange(len(counts)), counts), size > 0
    _, words = word_hashes(texts, lower=False)
    return owner[full], words, head[full], size[full]


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (text, 32-bit feature), kind by kind; a text's feature may come more than once."""
    owner, words, head, size = _folded_words(letters_only(texts))
    yield owner, (words >> np.uint64(32)).astype(np.int64)
    for n in PREFIXES:
        long = size >= n
        value = head[long] & np.uint64((1 << 8 * n) - 1)
        yield owner[long], (mix64(value ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(32)).astype(np.int64)


# ---------------------------------------------------------------- fitting


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches, "text"):
        parts = [np.stack(p, axis=1) for p in features(batch.column("text"))]
        pairs = np.unique(np.concatenate(parts), axis=0) if parts else np.zeros((0, 2), np.int64)
        cut = np.searchsorted(pairs[:, 0], np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(pairs[:, 1]))], names=["doc_id", "grade", "features"])


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, screened: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grades, row of each feature, feature) of the bounded sample; labels: (doc_id, grade).

    With screened, features that ``_screen`` turns away for grades above 0 stay on the executors.
    """
    known = labels.where("doc_id is not null and grade is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("grade").cast("int").alias("grade"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()  # bounded by the parameter
    if not chosen:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    few = docs.sparkSession.createDataFrame([(r["doc_id"], r["grade"]) for r in chosen], "doc_id long, grade int")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id").select("doc_id", "grade", "text").mapInArrow(_sample_rows, "doc_id long, grade int, features array<long>")
    # one row a doc_id: of several texts the one whose features hash least
    one = F.min_by(F.struct("grade", "features"), F.struct(F.xxhash64("features"), F.size("features")))
    found = materialise(found.groupBy("doc_id").agg(one.alias("x")).select("doc_id", "x.grade", "x.features"), "toxicity-sample")
    if screened:
        found = _screened(found)
    found = found.toArrow().sort_by("doc_id").combine_chunks()
    ids = found.column("doc_id").to_numpy()
    grades = found.column("grade").to_numpy().astype(np.int64)
    lists = found.column("features").combine_chunks() if isinstance(found.column("features"), pa.ChunkedArray) else found.column("features")
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
    row, feature = np.repeat(np.arange(len(ids)), n), lists.flatten().to_numpy()
    use = first[row]
    return grades[first], (np.cumsum(first) - 1)[row[use]], feature[use]


def _screened(found: DataFrame) -> DataFrame:
    """Rows (doc_id, grade, features) with the features alone that ``_screen`` keeps for grades above 0, and some at its edge."""
    rows, base = found.agg(F.count(F.lit(1)), F.avg((F.col("grade") > 0).cast("double"))).first()
    if not rows:
        return found
    n, p, base = F.count(F.lit(1)), F.sum((F.col("grade") > 0).cast("long")), F.lit(base)
    z = (p - n * base) / F.sqrt(F.greatest(n * base * (1 - base), F.lit(1e-9)))
    each = found.select("doc_id", "grade", F.explode("features").alias("feature"))
    kept = each.groupBy("feature").agg(n.alias("n"), z.alias("z")).where((F.col("n") >= LEAST_ROWS) & (F.col("z") >= LEAST_Z - 1e-6)).select("feature")
    held = each.join(kept, "feature").groupBy("doc_id").agg(F.sort_array(F.collect_list("feature")).alias("features"))
    return found.select("doc_id", "grade").join(held, "doc_id", "left").select("doc_id", "grade", F.coalesce("features", F.array().cast("array<long>")).alias("features"))


def _screen(positive: np.ndarray, row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features kept, and for each their rows among the positive and the others."""
    names, at = np.unique(feature, return_inverse=True)
    n = np.bincount(at, minlength=len(names))
    p = np.bincount(at, positive[row], len(names))
    base = positive.mean()
    z = (p - n * base) / np.sqrt(np.maximum(n * base * (1 - base), 1e-9))
    z[n < LEAST_ROWS] = -1e9
    order = np.flatnonzero(z >= LEAST_Z)
    return names[order], p[order], (n - p)[order]


def severity_grades(toxic: np.ndarray, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Three ordered grades of the flag, as the module's docstring says."""
    grades = (toxic > 0).astype(np.int64)
    if not 0 < grades.sum() < len(grades):
        return grades
    names, p, rest = _screen(grades, row, feature)
    ratio = ((p + 0.5) / (grades.sum() + 1)) / ((rest + 0.5) / ((1 - grades).sum() + 1))
    markers = names[ratio >= 20]
    count = np.bincount(row, np.isin(feature, markers), len(grades))
    grades[(grades == 1) & (count > np.median(count[grades == 1]))] = 2
    return grades


def fit(grades: np.ndarray, row: np.ndarray, feature: np.ndarray, l2: float = L2) -> Model:
    """The model of the features that go with grades above the lowest."""
    some = len(np.unique(grades)) > 1
    names = _screen((grades > grades.min()).astype(float), row, feature)[0] if some else np.zeros(0, np.int64)
    return _descend(grades, row, feature, names, l2)


def _descend(grades: np.ndarray, row: np.ndarray, feature: np.ndarray, names: np.ndarray, l2: float) -> Model:
    """Accelerated proximal gradient descent on the mean negative log-likelihood + l2 / 2 * sum(w * w), w >= 0."""
    levels = np.unique(grades)
    if len(levels) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.array([60.0]))
    y = np.searchsorted(levels, grades)
    top, n = len(levels) - 1, len(grades)
    at = np.searchsorted(names, feature)
    held = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == feature) if len(names) else np.zeros(len(feature), bool)
    r, c = row[held], at[held]
    share = np.array([(y <= j).mean() for j in range(top)]).clip(1e-6, 1 - 1e-6)
    theta = np.log(share / (1 - share))
    w = np.zeros(len(names))
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))

    def gradient(w: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        score = np.bincount(r, w[c], n)
        cdf = np.concatenate([np.zeros((n, 1)), sig(theta[None, :] - score[:, None]), np.ones((n, 1))], axis=1)
        density = np.concatenate([np.zeros((n, 1)), cdf[:, 1:-1] * (1 - cdf[:, 1:-1]), np.zeros((n, 1))], axis=1)
        i = np.arange(n)
        prob = np.maximum(cdf[i, y + 1] - cdf[i, y], 1e-12)
        d_score = (density[i, y + 1] - density[i, y]) / prob / n  # of the loss by the score
        d_theta = np.zeros(top)
        for j in range(top):
            d_theta[j] = -((density[:, j + 1] * (y == j)).astype(float) / prob - density[:, j + 1] * (y == j + 1) / prob).sum() / n
        return float(-np.log(prob).mean() + l2 / 2 * w @ w), np.bincount(c, d_score[r], len(w)) + l2 * w, d_theta

    step, w0, t0, momentum = 1.0, w, theta, 1.0
    vw, vt = w, theta
    loss, gw, gt = gradient(vw, vt)
    for _ in range(STEPS):
        while True:  # backtracking
            nw = np.maximum(vw - step * gw, 0)
            nt = np.maximum.accumulate(vt - step * gt + np.arange(top) * 1e-9)
            dw, dt = nw - vw, nt - vt
            new_loss = gradient(nw, nt)[0]
            if new_loss <= loss + gw @ dw + gt @ dt + (dw @ dw + dt @ dt) / (2 * step) + 1e-12 or step < 1e-9:
                break
            step /= 2
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        vw, vt = nw + (momentum - 1) / after * (nw - w0), nt + (momentum - 1) / after * (nt - t0)
        vt = np.maximum.accumulate(vt)
        small = max(np.abs(nw - w0).max(initial=0), np.abs(nt - t0).max()) < 1e-5
        w0, t0, momentum = nw, nt, after
        if small:
            break
        loss, gw, gt = gradient(vw, vt)
        step *= 1.3
    live = np.flatnonzero(w0)
    return Model(names[live], w0[live], t0)


# ---------------------------------------------------------------- scoring


def _scorer(model: Model):
    hit = np.zeros(1 << 16, bool)  # which features can be in the model, by their low bits
    hit[model.features & 0xFFFF] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            rows, places = [], []
            for owner, feature in features(batch.column("text")):
                some = hit[feature & 0xFFFF]
                owner, feature = owner[some], feature[some]
                at = np.minimum(np.searchsorted(model.features, feature), max(len(model.features) - 1, 0))
                ok = model.features[at] == feature if len(model.features) else np.zeros(len(feature), bool)
                rows.append(owner[ok])
                places.append(at[ok])
            pair = np.unique(np.concatenate(rows) * max(len(model.features), 1) + np.concatenate(places))
            row, place = np.divmod(pair, max(len(model.features), 1))
            score = np.bincount(row, model.weights[place] if len(place) else None, batch.num_rows).astype(float)
            above = model.above(score)
            grade = (above >= 0.5).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(above.sum(axis=1).round(9)), pa.array(grade, pa.int32()), pa.array(above[:, 0].round(9)), pa.array(above[:, 0] >= REJECT_AT)], names=["doc_id", "severity", "grade", "p_toxic", "rejected"]
            )

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from documents and labels (doc_id, toxic)."""
    toxic, row, feature = sample(docs, labels.select("doc_id", F.col("toxic").alias("grade")), rows, screened=True)
    return fit(severity_grades(toxic, row, feature), row, feature)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, rejected) of every row of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(model), "doc_id long, severity double, grade int, p_toxic double, rejected boolean")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model does not reject, with all their columns, in one scan."""
    judge = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            asked = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("text")], names=["doc_id", "text"])
            rejected = pa.concat_arrays([b.column("rejected") for b in judge(iter([asked]))])
            yield batch.filter(pc.invert(rejected))

    return docs.mapInArrow(run, docs.schema)
