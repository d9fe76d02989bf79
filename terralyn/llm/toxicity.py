"""Operator 7: toxicity by cumulative-link ordinal regression.

Severity grades are ordered: 0 for a document labelled as not toxic, 1 for a toxic one of good quality, 2 for a toxic
one of bad quality. P(grade >= k) = sigmoid(w x - t_k), with one weight vector for all thresholds t_1 < t_2, fitted
by the likelihood of the grades, P(grade >= k) - P(grade >= k + 1). Features are the presence of hashed words. The fit reads at most FIT_ROWS labelled documents of each grade, chosen by a hash of
their ids, and each stands for its share of all labels of its grade, which are counted, so the bound does not move the
probabilities; scoring covers every document. The score is the expected grade, the sum of P(grade >= k) over k. A
document is toxic from a cut of P(grade >= 1) that is best on the parts of the sample that a fit has not seen.

Cases: a null or empty text has no features and is graded by the thresholds alone; without labels of two grades at
least, every severity is 0; grades that no label has get no threshold; labels of unknown documents are ignored, and of
several labels of a document the most severe counts; equal rows are all returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, freed, steps, utf8, word_hashes

#: The bound of the fit: labelled documents of each grade.
FIT_ROWS = 3000
FEATURE_BITS = 18
#: Documents of the fit in which a feature must occur.
MIN_DOCS = 5
#: Standard errors by which a feature's rate must differ between grade 0 and the others; chance words stay out.
LEAST_Z = 5.0
ROUNDS, STEP, PENALTY = 600, 0.1, 1e-5
#: Parts of the sample, each judged by a fit on the others, and the cut where they hold no toxic document.
FOLDS, CUT = 4, 0.25


@dataclass
class Model:
    grades: list[int]
    thresholds: np.ndarray
    weights: np.ndarray  # float32, 2 ** FEATURE_BITS: a fixed size
    cut: float = CUT  # of P(grade >= 1)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each distinct hashed word of some texts."""
    hashes, bounds = word_hashes(data, offsets)
    bits = (hashes & U64((1 << FEATURE_BITS) - 1)).astype(np.int64)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    both = np.unique(rows << FEATURE_BITS | bits)
    return both >> FEATURE_BITS, both & ((1 << FEATURE_BITS) - 1)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: one row for each labelled document."""
    toxic, quality = (F.coalesce(F.col(c).cast("int"), F.lit(d)) for c, d in (("toxic", 0), ("quality", 1)))
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(toxic == 1, 2 - quality).otherwise(0)).alias("grade"))


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Grade, weight, fold and features of each document of the sample.

    A weight is the number of labels for which a chosen one stands: labels without a document and documents that share
    an id are met by chance alike in the sample and outside it.
    """
    own = graded(labels)
    counts = {r["grade"]: r["count"] for r in own.groupBy("grade").count().collect()}  # a row for each grade
    parts = [own.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS) for g in (0, 1, 2)]
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2])  # at most 3 x FIT_ROWS rows
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in steps(offsets):
                row, feature = _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cut = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in ("grade", "fold")], pa.ListArray.from_arrays(pa.array(cut), pa.array(feature.astype(np.int32)))], ["grade", "fold", "features"])

    got = rows.select("grade", "fold", "text").mapInArrow(run, "grade int, fold int, features array<int>").toArrow()
    features = got.column("features").combine_chunks()
    grade, fold = (got.column(c).to_numpy().astype(np.int64) for c in ("grade", "fold"))
    weight = np.array([max(1.0, counts.get(g, 0) / FIT_ROWS) for g in range(3)])[grade]
    return grade, weight, fold, [np.asarray(x.values) for x in features] if len(features) else []


def ordered(free: np.ndarray) -> np.ndarray:
    """Thresholds from the first one and the logarithms of the gaps above it."""
    return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def loss(x: np.ndarray, row: np.ndarray, column: np.ndarray, level: np.ndarray, part: np.ndarray, width: int) -> tuple[float, np.ndarray]:
    """The negative log-likelihood of the grades, -log(P(y >= k) - P(y >= k + 1)) by part, with a ridge; and its gradient.

    x: width weights, then thresholds as `ordered` takes them; (row, column) say which features a document has.
    """
    w, free = x[:width], x[width:]
    t, docs = ordered(free), np.arange(len(level))
    score = np.bincount(row, w[column], len(level))
    # P(y >= k) for every k, from that of all (1) to that above the last grade (0)
    reach = np.column_stack([np.ones(len(level)), 1 / (1 + np.exp(np.clip(t[None, :] - score[:, None], -40, 40))), np.zeros(len(level))])
    a, b = reach[docs, level], reach[docs, level + 1]
    p = np.maximum(a - b, 1e-300)
    by_score = -(1 - a - b) * part  # the derivatives of log(a - b) by the score of all links together
    by_t = np.zeros((len(level), len(t) + 2))
    by_t[docs, level] += a * (1 - a) / p * part
    by_t[docs, level + 1] -= b * (1 - b) / p * part
    by_t = by_t[:, 1:-1].sum(axis=0)
    by_free = np.cumsum(by_t[::-1])[::-1] * np.concatenate([[1.0], np.exp(free[1:])])
    value = float(-(np.log(p) * part).sum() + PENALTY / 2 * (w @ w))
    return value, np.concatenate([np.bincount(column, by_score[row], width) + PENALTY * w, by_free])


def _fitted(grade: np.ndarray, weight: np.ndarray, features: list[np.ndarray]) -> Model:
    weights = np.zeros(1 << FEATURE_BITS, np.float32)
    grades = sorted({int(g) for g in grade})
    if len(grades) < 2:
        return Model(grades, np.zeros(0), weights)
    flat = np.concatenate(features)
    row = np.repeat(np.arange(len(features)), [len(x) for x in features])
    toxic = grade > grades[0]
    every = np.bincount(flat, minlength=1 << FEATURE_BITS)
    with_it = np.bincount(flat[toxic[row]], minlength=1 << FEATURE_BITS)
    n, n1 = len(grade), int(toxic.sum())
    rate = every / n
    gap = with_it / n1 - (every - with_it) / (n - n1)
    apart = gap / np.sqrt(np.maximum(rate * (1 - rate), 1 / n) * (1 / n1 + 1 / (n - n1)))
    used = np.flatnonzero((every >= MIN_DOCS) & (np.abs(apart) >= LEAST_Z))
    place = np.full(1 << FEATURE_BITS, -1)
    place[used] = np.arange(len(used))
    own = place[flat] >= 0
    row, column = row[own], place[flat[own]]
    level = np.searchsorted(grades, grade)
    share = np.array([np.average(level >= k, weights=weight) for k in range(1, len(grades))])
    first = -np.log(share / (1 - share))
    # thresholds as the first one and the logarithms of the gaps above it, so that they stay in order
    x = np.concatenate([np.zeros(len(used)), first[:1], np.log(np.maximum(np.diff(first), 0.05))])
    m, v = np.zeros(len(x)), np.zeros(len(x))
    part = weight / weight.sum()
    for n in range(1, ROUNDS + 1):
        _, g = loss(x, row, column, level, part, len(used))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - STEP * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)
    w, t = x[: len(used)], ordered(x[len(used) :])
    weights[used] = np.where(np.abs(w) > 0.02, w, 0)
    return Model(grades, t, weights)


def best_cut(p: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The cut between two values of p with the best F1 of p >= cut against toxic; CUT where nothing is toxic."""
    order = np.argsort(-p, kind="stable")
    p, weight, toxic = p[order], weight[order], toxic[order]
    hit, said = np.cumsum(weight * toxic), np.cumsum(weight)
    if not len(p) or not hit[-1]:
        return CUT
    ends = np.flatnonzero(np.append(p[1:] < p[:-1], True))
    k = ends[np.argmax(2 * hit[ends] / (said[ends] + hit[-1]))]
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits weights, thresholds and the cut on the driver, from the bounded sample alone."""
    grade, weight, fold, features = _sample(docs, labels)
    model = _fitted(grade, weight, features)
    if not len(model.thresholds):
        return model
    seen, p = np.zeros(len(grade), bool), np.zeros(len(grade))
    for k in range(FOLDS):
        rest, held = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        part = _fitted(grade[rest], weight[rest], [features[i] for i in rest])
        if part.grades[:1] == model.grades[:1] and len(part.thresholds) and len(held):
            row = np.repeat(np.arange(len(held)), [len(features[i]) for i in held])
            sums = np.bincount(row, part.weights[np.concatenate([features[i] for i in held])], len(held))
            p[held], seen[held] = 1 / (1 + np.exp(np.clip(part.thresholds[0] - sums, -40, 40))), True
    model.cut = best_cut(p[seen], grade[seen] > model.grades[0], weight[seen])
    return model


def _judge(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and P(grade >= 1) of each text; zeros where nothing could be fitted."""
    gaps = np.diff(model.grades).astype(float)
    data, offsets = utf8(column)
    severity, toxic = np.zeros(len(column)), np.zeros(len(column))
    for i, j in steps(offsets):
        if len(gaps):
            row, feature = _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            sums = np.bincount(row, model.weights[feature], j - i)
            reach = 1 / (1 + np.exp(np.clip(model.thresholds[None, :] - sums[:, None], -40, 40)))
            severity[i:j], toxic[i:j] = (reach * gaps[None, :]).sum(axis=1), reach[:, 0]
    return severity, toxic


def score(docs: DataFrame, model: Model, cut: float | None = None) -> DataFrame:
    """doc_id, expected_severity, grade (the expected one, rounded) and toxic (P(grade >= 1) of at least cut, or else the model's)."""
    cut = model.cut if cut is None else cut

    def run(batches):
        for batch in batches:
            severity, toxic = _judge(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(severity), pa.array(np.floor(severity + 0.5).astype(np.int32)), pa.array(toxic >= cut)], ["doc_id", "expected_severity", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(freed(run), "doc_id long, expected_severity double, grade int, toxic boolean")


def keep(docs: DataFrame, model: Model, cut: float | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, that are not toxic."""
    cut = model.cut if cut is None else cut

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_judge(batch.column("text").cast(pa.string()), model)[1] < cut))

    return docs.mapInArrow(freed(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
