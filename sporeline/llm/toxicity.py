"""Toxicity by cumulative-link ordinal regression over sparse text features.

A document's severity is one of the grades 0..K-1. The model is P(grade > k) = sigmoid(w.x - threshold[k]): one weight
vector for all thresholds, which are ordered by construction. Features are hashed words and the first 3 to 6 letters
of words; x holds log(1 + count) of each selected feature. The output is the expected grade, sum over k of P(grade > k).

Grades are what the labels say: 0 for documents that aren't toxic, up to GRADES - 1; there are as many thresholds as
the highest grade. Labels of 0 and 1 alone give one threshold, and the severity is then the chance of being toxic.

Fitting uses a bounded sample of labelled documents (SAMPLE rows, the lowest by a hash of doc_id), in two Spark passes
over it: the first counts in how many documents of each grade a feature stands and selects SELECTED features by the
highest z-score of their log-odds at any threshold; the second gathers the counts of the selected features only. Of the
sample, every fifth hash is not fitted on; the chance from which a document is called toxic is chosen there.

Documents that are null, empty or without letters have no features: their severity is that of the thresholds alone.
Labels that are null or no grade, or whose document is missing, don't count; a document with two different labels counts
with both. Rows are scored one by one, whatever their doc_id and other columns; long texts are read whole; an empty table
gives an empty result. Without labels of two grades nothing can be learned, and all documents have severity 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sporeline.llm._shared import slices, table

WORD = re.compile(r"[^\W\d_]+")
BITS, PREFIXES = 22, (3, 4, 5, 6)
#: Labelled documents used at most, and features selected at most.
SAMPLE, SELECTED, LEAST_DOCS = 12_000, 3000, 5
#: Grades there may be, and words whose features a worker keeps.
GRADES, CACHED = 16, 300_000


def features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    names = [f"w {word}", *(f"p {word[:n]}" for n in PREFIXES if len(word) > n)]
    return [xxhash.xxh32_intdigest(x.encode()) >> (32 - BITS) for x in names]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class Model:
    """weights by feature hash, ordered thresholds, and the chance of a grade above 0 from which a document is called toxic."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    cut: float = 0.5

    def severity(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the chance of any grade above 0."""
        if not self.thresholds:
            return np.zeros(len(sums)), np.zeros(len(sums))
        above = _sigmoid(sums[:, None] - np.array(self.thresholds))
        return above.sum(axis=1), above[:, 0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, ridge: float = 5e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximise the likelihood of grades, by Adam on a sparse matrix (rows, columns, values)."""
    k = int(grades.max(initial=0))
    share = [np.clip((grades > j).mean(), 1e-4, 1 - 1e-4) for j in range(k)]
    first = np.log((1 - np.array(share)) / np.array(share))
    theta = np.r_[np.zeros(n_features), first[:1], np.log(np.maximum(np.diff(first), 1e-2))]  # gaps as logarithms keep the order
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = len(grades)
    for step in range(1, steps + 1):
        w, gaps = theta[:n_features], np.exp(theta[n_features + 1 :])
        cuts = theta[n_features] + np.r_[0, np.cumsum(gaps)]
        s = np.bincount(rows, values * w[columns], minlength=n)
        above = np.c_[np.ones(n), _sigmoid(s[:, None] - cuts), np.zeros(n)]  # P(grade >= 0), .., P(grade > k)
        at = np.arange(n)
        p = np.maximum(above[at, grades] - above[at, grades + 1], 1e-9)
        slope = above * (1 - above)
        ds = (slope[at, grades] - slope[at, grades + 1]) / p
        dcut = np.zeros((n, k + 2))
        dcut[at, grades] -= slope[at, grades] / p
        dcut[at, grades + 1] += slope[at, grades + 1] / p
        dcuts = dcut[:, 1 : k + 1].sum(axis=0)
        grad = np.r_[np.bincount(columns, values * ds[rows], minlength=n_features) / n - ridge * w, dcuts.sum() / n, np.cumsum(dcuts[::-1])[::-1][1:] * gaps / n]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:n_features], theta[n_features] + np.r_[0, np.cumsum(np.exp(theta[n_features + 1 :]))]


def best_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The chance from which calling documents toxic gives the highest F1, midway to the next lower chance."""
    by = np.argsort(-p, kind="stable")
    hits = np.cumsum(toxic[by])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + toxic.sum())
    f1[:-1][p[by][:-1] == p[by][1:]] = 0  # equal chances fall on the same side
    k = int(f1.argmax())
    return float((p[by][k] + p[by][min(k + 1, len(p) - 1)]) / 2)


def _presence(sample: DataFrame) -> DataFrame:
    """feature, grade, n: documents of the grade that have the feature. A task sums its documents before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for b in slices(batches, "text"):
            if len(known) > CACHED:
                known = {}
            codes = []
            for t, y in zip(b.column("text").to_pylist(), b.column("grade").to_pylist(), strict=True):
                words = set(words_of(t))
                for w in words.difference(known):
                    known[w] = features(w)
                held = np.unique(np.fromiter(chain.from_iterable(map(known.__getitem__, words)), np.int64))
                codes.append(y << BITS | held)
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.record_batch([pa.array(code & (1 << BITS) - 1), pa.array((code >> BITS).astype(np.int32)), pa.array(n.astype(np.int64))], names=["feature", "grade", "n"])

    return sample.select("text", "grade").mapInArrow(work, "feature long, grade int, n long").groupBy("feature", "grade").agg(F.sum("n").alias("n"))


def _select(sample: DataFrame, sizes: dict[int, int], selected: int) -> list[int]:
    """The features that tell grades apart best at any of the thresholds."""
    by_grade = _presence(sample).groupBy("feature").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col("grade") > k, F.col("n")).otherwise(0)).alias(f"above_{k}") for k in range(max(sizes))))
    scores = []
    for k in range(max(sizes)):
        above, below = (sum(n for g, n in sizes.items() if (g > k) == up) for up in (True, False))
        have, lack = F.col(f"above_{k}") + 0.5, F.col("n") - F.col(f"above_{k}") + 0.5
        scores.append(F.abs(F.log(have / (above + 1)) - F.log(lack / (below + 1))) / F.sqrt(1 / have + 1 / lack))
    z = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return [x.feature for x in by_grade.where(F.col("n") >= LEAST_DOCS).withColumn("z", z).where("z >= 3").orderBy(F.desc("z"), "feature").limit(selected).collect()]


class Counts:
    """Counts of selected features in texts; the features of words met before are kept."""

    def __init__(self, places: dict[int, int]):
        self.places, self.known = places, {}

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, feature's place and count, by row and place."""
        if len(self.known) > CACHED:
            self.known = {}
        codes = [np.zeros(0, np.int64)]
        for i, t in enumerate(texts):
            words = words_of(t)
            for w in set(words).difference(self.known):
                self.known[w] = [self.places[x] for x in features(w) if x in self.places]
            codes.append(i << BITS | np.fromiter(chain.from_iterable(map(self.known.__getitem__, words)), np.int64))
        code, n = np.unique(np.concatenate(codes), return_counts=True)
        return code >> BITS, code & (1 << BITS) - 1, n


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, grade, held_out of at most sample labelled documents, the lowest by a hash of doc_id; only ids are compared until they are chosen."""
    grade = F.col("toxic").cast("int")
    known = labels.where(F.col("doc_id").isNotNull() & grade.between(0, GRADES - 1) & (grade == F.col("toxic"))).select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).distinct()
    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"))
    chosen = known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 4
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "grade", held_out.alias("held_out"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, selected: int = SELECTED) -> Model:
    """A model from labels (doc_id, toxic: the grade) of docs (doc_id, text)."""
    held = labelled(docs, labels, sample).persist()
    sizes = {x.grade: x.n for x in held.where("NOT held_out").groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        held.unpersist()
        return Model()
    best = _select(held.where("NOT held_out"), sizes, selected)
    places = {x: i for i, x in enumerate(best)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(places)
        for b in slices(batches, "text"):
            row, at, n = counts.of(b.column("text").to_pylist())
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=b.num_rows))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (at, n)]
            yield pa.record_batch([b.column("grade"), b.column("held_out"), *lists], names=["grade", "held_out", "at", "counts"])

    found = held.mapInArrow(count, "grade int, held_out boolean, at array<int>, counts array<int>").toPandas()  # sample rows at most
    held.unpersist()
    sizes_, grades, out = found["at"].map(len).to_numpy(), found["grade"].to_numpy().astype(np.int64), found["held_out"].to_numpy().astype(bool)
    rows, columns = np.repeat(np.arange(len(found)), sizes_), np.concatenate([*found["at"], np.zeros(0, int)]).astype(np.int64)
    values = np.log1p(np.concatenate([*found["counts"], np.zeros(0)]).astype(float))
    fitted = ~out[rows]
    place = np.cumsum(~out) - 1
    weights, cuts = fit_ordinal(place[rows[fitted]], columns[fitted], values[fitted], grades[~out], len(best))
    model = Model(dict(zip(best, weights.tolist(), strict=True)), cuts.tolist())
    p = model.severity(np.bincount(rows, values * weights[columns], minlength=len(grades)))[1]
    if 0 < (grades[out] > 0).sum() < out.sum():
        model.cut = best_cut(p[out], grades[out] > 0)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, toxic for each row of docs. The model has a bounded number of weights."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        counts, weights = Counts({x: i for i, x in enumerate(m.weights)}), np.array([*m.weights.values(), 0.0])
        for b in slices(batches, "text"):
            row, at, n = counts.of(b.column("text").to_pylist())
            severity, p = m.severity(np.bincount(row, np.log1p(n) * weights[at], minlength=b.num_rows))
            yield pa.record_batch([b.column("doc_id"), pa.array(severity), pa.array(p), pa.array((p >= m.cut) & bool(m.thresholds))], names=["doc_id", "severity", "p_toxic", "toxic"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(work, "doc_id long, severity double, p_toxic double, toxic boolean")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
