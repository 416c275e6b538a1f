"""Language identification by interpolated Kneser-Ney models of characters, one for each language.

A text is its words (runs of letters, lower-cased), each between boundary marks; a character is predicted from the
ORDER - 1 characters before it in its word. N-grams are counted with Spark over a bounded sample of labelled texts;
lower orders count the different characters that stand before an n-gram. Each order keeps its n-grams and contexts as
sorted 64-bit hashes, and for each of them the languages that have it with their values. The language with the lowest cross-entropy per
character is chosen; of equal ones, the first by name.

Rejection is calibrated on labelled texts that no model was fitted on: a prediction is accepted while its
cross-entropy is at most the quantile CALIBRATED of what texts of that language have.

Letters are the characters of Unicode's categories L, in training and prediction alike. Texts that are null or have no
letter are `und` with score 0, as are all texts where nothing was learned. Rows are judged one by one, whatever their
doc_id and other columns; long texts are read whole; an empty table gives an empty result, and no labels at all give
models that call every text `und`. Every label with a text of MAX_CHARS characters or less is learned. Its sample has FITTED texts and
CALIBRATING ones at most, and of each kind the first text and those after it within the label's share of CHARS characters.
Rows with one doc_id and label count as often as they stand there. N-grams of all orders and their contexts are counted and hashed
by Spark; the driver holds them as arrays only, whose size CHARS and the number of labels bound.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sporeline.llm._shared import discard, materialize, slices, table

WORD = re.compile(r"[^\W\d_]+")  # letters, and numbers that aren't digits
ORDER, DISCOUNT = 5, 0.75
START, END = "\x02", "\x03"
#: Labelled texts of a language that models are fitted on at most, and those that calibrate rejection; both within Spark's limit for ranking before a shuffle.
FITTED, CALIBRATING, CALIBRATED = 1000, 250, 0.99
#: Characters of a text that is learned from at most, and of all texts that models are fitted on, of which each label has the same share.
MAX_CHARS, CHARS = 1_000_000, 50_000_000
#: Scores of different words that a worker keeps, and words that are scored at once, times languages.
CACHED, AT_ONCE = 1_200_000, 80_000
#: Values of a table of n-grams by languages that a worker looks up as a whole; larger ones stay sparse.
SMALL = 2_000_000
#: Characters that count as independent at most when scores are compared.
EVIDENCE = 25
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the n-grams that end at each place; the first order - 1 places hold shorter ones."""
    h = np.full(len(codes), order, np.uint64) * _MIX
    for k in range(order):
        shifted = codes if not k else np.r_[np.zeros(k, np.uint64), codes[:-k]]
        h = (h ^ (shifted + np.uint64(k + 1)) * _STEP) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _keys(grams: list[str], order: int) -> np.ndarray:
    """The hash of each of these n-grams of one order."""
    return _hashes(_codes("".join(grams)), order)[order - 1 :: order] if order and grams else np.full(len(grams), _hashes(np.zeros(1, np.uint64), 0)[0])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    words = WORD.findall((text or "").lower())
    if "".join(words).isalpha():
        return words
    return [x for w in words for x in ([w] if w.isalpha() else ("".join(run) for letters, run in groupby(w, str.isalpha) if letters))]


@dataclass
class Sparse:
    """Sorted hashes; the entries starts[k] to starts[k + 1] of the k-th one have a language each, and its values."""

    hashes: np.ndarray
    starts: np.ndarray
    languages: np.ndarray
    values: np.ndarray
    whole: list[np.ndarray] | None = None  # a worker's tables of all hashes by languages, and a last row of what is missing, if they are small

    @classmethod
    def of(cls, held: list[dict[str, tuple[float, ...]]], order: int, width: int) -> Sparse:
        names = list(dict.fromkeys(g for x in held for g in x))
        place = {g: i for i, g in enumerate(names)}
        keys = _keys(names, order)
        by = np.argsort(keys, kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[by] = np.arange(len(names))
        row = rank[np.array([place[g] for x in held for g in x], np.int64)]
        language = np.repeat(np.arange(len(held)), [len(x) for x in held])
        values = np.array([v for x in held for v in x.values()], float).reshape(-1, width)
        order_ = np.lexsort((language, row))
        return cls(keys[by], np.r_[0, np.cumsum(np.bincount(row, minlength=len(names)))], language[order_], values[order_])

    @classmethod
    def of_entries(cls, keys: np.ndarray, languages: np.ndarray, values: np.ndarray) -> Sparse:
        """From a hash, a language and values for each entry, in any order."""
        by = np.lexsort((languages, keys))
        hashes, starts = np.unique(keys[by], return_index=True)
        return cls(hashes, np.r_[starts, len(keys)], languages[by], values[by])

    def find(self, keys: np.ndarray, n: int, missing: tuple[float, ...]) -> list[np.ndarray]:
        """For each value a table of keys by n languages."""
        if not len(self.hashes):
            return [np.full((len(keys), n), m) for m in missing]
        at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
        found = self.hashes[at] == keys
        if self.whole is None and len(self.hashes) * n <= SMALL:
            row = np.repeat(np.arange(len(self.hashes)), np.diff(self.starts))
            self.whole = [np.full((len(self.hashes) + 1, n), m) for m in missing]
            for k, x in enumerate(self.whole):
                x[row, self.languages] = self.values[:, k]
        if self.whole is not None:
            at = np.where(found, at, len(self.hashes))
            return [x[at] for x in self.whole]
        out = [np.full((len(keys), n), m) for m in missing]
        if found.any():
            hit = np.flatnonzero(found)
            first, sizes = self.starts[at[hit]], self.starts[at[hit] + 1] - self.starts[at[hit]]
            entry = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
            for k, x in enumerate(out):
                x[np.repeat(hit, sizes), self.languages[entry]] = self.values[entry, k]
        return out


@dataclass
class Models:
    """languages, and for each order: n-grams with their discounted counts, contexts with their totals and the weight left to the order below."""

    languages: list[str]
    grams: list[Sparse] = field(default_factory=list)
    contexts: list[Sparse] = field(default_factory=list)
    uniform: float = 1.0
    limits: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, languages: list[str], top: list[tuple[str, str, int]], order: int = ORDER, discount: float = DISCOUNT) -> Models:
        """As models_of() does, from counts at hand. top: language, n-gram of the highest order, count; n-grams at a word's start are padded with START."""
        out = cls(languages)
        place = {x: i for i, x in enumerate(languages)}
        out.uniform = 1 / max(2, len({g[-1] for _, g, _ in top}))
        counts: list[dict[str, int]] = [{} for _ in languages]
        for lang, gram, n in top:
            counts[place[lang]][gram] = counts[place[lang]].get(gram, 0) + n
        tables = []
        for _ in range(order):  # from the highest order down
            tables.append(counts)
            lower: list[dict[str, int]] = [{} for _ in languages]
            for i, held in enumerate(counts):
                for gram, n in held.items():
                    rest = gram[1:]
                    lower[i][rest] = lower[i].get(rest, 0) + (n if rest[:1] == START else 1)
            counts = lower
        for k, held in enumerate(reversed(tables), 1):
            out.grams.append(Sparse.of([{g: (max(0.0, n - discount),) for g, n in x.items()} for x in held], k, 1))
            totals: list[dict[str, list[float]]] = [{} for _ in held]
            for i, x in enumerate(held):
                for g, n in x.items():
                    t = totals[i].setdefault(g[:-1], [0.0, 0.0])
                    t[0] += n
                    t[1] += 1
            out.contexts.append(Sparse.of([{h: (t, discount * d / t) for h, (t, d) in x.items()} for x in totals], k - 1, 2))
        return out

    def word_costs(self, words: list[str]) -> np.ndarray:
        """Nats that each word, with its end mark, costs under each language's model."""
        n, pad = len(self.languages), START * (len(self.grams) - 1)
        codes = _codes("".join(f"{pad}{w}{END}" for w in words))
        sizes = np.array([len(w) + 1 for w in words])
        starts = np.cumsum(sizes + len(pad)) - sizes
        at = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        p = np.full((len(at), n), self.uniform)
        for k in range(1, len(self.grams) + 1):
            total, left = self.contexts[k - 1].find(_hashes(codes, k - 1)[at - 1] if k > 1 else np.full(len(at), _hashes(codes[:1], 0)[0]), n, (0.0, 1.0))
            p = self.grams[k - 1].find(_hashes(codes, k)[at], n, (0.0,))[0] / np.maximum(total, 1e-300) * (total > 0) + left * p
        return np.add.reduceat(-np.log(p), np.r_[0, np.cumsum(sizes)[:-1]], axis=0)


class Scorer:
    """Cross-entropies of texts; the costs of words met before are kept in a bounded cache."""

    def __init__(self, models: Models):
        self.models, self.at = models, {}
        self.costs = np.zeros((0, len(models.languages)))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of each text, and its nats per character under each language."""
        words = [words_of(t) for t in texts]
        if len(self.at) * max(1, len(self.models.languages)) > CACHED:
            self.at, self.costs = {}, self.costs[:0]
        new = list(set().union(*words).difference(self.at)) if words else []
        step = max(1, AT_ONCE // max(1, len(self.models.languages)))
        for k in range(0, len(new), step):
            part = new[k : k + step]
            self.at.update(zip(part, range(len(self.costs), len(self.costs) + len(part)), strict=True))
            self.costs = np.vstack([self.costs, self.models.word_costs(part)])
        n = np.array([sum(map(len, w)) + len(w) for w in words])
        out = np.zeros((len(words), len(self.models.languages)))
        for i, w in enumerate(words):
            if w:
                out[i] = self.costs[list(map(self.at.__getitem__, w))].sum(axis=0) / n[i]
        return n, out


def predict(docs: DataFrame, models: Models, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, accepted for each row of docs, and the string columns keep as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer, limits = Scorer(m), np.array([m.limits.get(x, np.inf) for x in m.languages])
        for b in slices(batches, "text"):
            n, h = scorer.entropies(b.column("text").to_pylist())
            known = (n > 0) & bool(m.languages)
            best = h.argmin(axis=1) if m.languages else np.zeros(len(n), int)
            lowest = h.min(axis=1) if m.languages else np.zeros(len(n))
            odds = np.exp(-np.minimum(n, EVIDENCE)[:, None] * (h - lowest[:, None])).sum(axis=1) if m.languages else np.ones(len(n))
            names = [m.languages[i] if k else "und" for i, k in zip(best.tolist(), known.tolist(), strict=True)]
            accepted = known & (lowest <= limits[best]) if m.languages else known
            yield pa.record_batch(
                [b.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(known, 1 / odds, 0.0)), pa.array(lowest, mask=~known), pa.array(accepted), *(b.column(c) for c in keep)],
                names=["doc_id", "lang_pred", "score", "cross_entropy", "accepted", *keep],
            )

    schema = ", ".join(["doc_id long, lang_pred string, score double, cross_entropy double, accepted boolean", *(f"{c} string" for c in keep)])
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"), *keep).mapInArrow(work, schema)


def top_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n: the n-grams of the highest order in docs' words (columns text and lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            held = Counter((x, w) for x, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True) for w in words_of(t))
            yield pa.record_batch([pa.array([x for x, _ in held], pa.string()), pa.array([w for _, w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["lang", "word", "n"])

    pad = START * (order - 1)
    words = docs.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    padded = F.concat(F.lit(pad), F.col("word"), F.lit(END))
    grams = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(order)))
    return words.select("lang", "n", F.explode(grams).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def models_of(top: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> Models:
    """Models from lang, gram, n of the highest order. Only hashes, labels and values of n-grams and contexts come to the driver, as arrays."""
    levels = [top]
    for k in range(order - 1, 0, -1):
        rest = F.substring("gram", 2, k)
        met = F.when(rest.startswith(START), F.col("n")).otherwise(1)  # a word's start has nothing before it to tell apart
        levels.append(levels[-1].groupBy("lang", rest.alias("gram")).agg(F.sum(met).alias("n")))
    parts = []
    for k, x in zip(range(order, 0, -1), levels, strict=True):
        total = F.sum("n")
        contexts = x.groupBy("lang", F.substring("gram", 1, k - 1).alias("gram")).agg(total.cast("double").alias("v"), (discount * F.count("*") / total).alias("w"))
        parts.append(x.select("lang", "gram", F.lit(2 * k).alias("table"), F.greatest(F.col("n") - discount, F.lit(0.0)).alias("v"), F.lit(0.0).alias("w")))
        parts.append(contexts.select("lang", "gram", F.lit(2 * k + 1).alias("table"), "v", "w"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, keys = np.array(b.column("gram").to_pylist(), object), np.zeros(b.num_rows, np.uint64)
            sizes = np.fromiter(map(len, grams), int, len(grams))
            for n in np.unique(sizes).tolist():
                keys[sizes == n] = _keys(grams[sizes == n].tolist(), n)
            yield pa.record_batch([b.column("lang"), b.column("table"), pa.array(keys.view(np.int64)), b.column("v"), b.column("w")], names=["lang", "table", "key", "v", "w"])

    held = reduce(DataFrame.unionByName, parts).mapInArrow(hashed, "lang string, table int, key long, v double, w double").toArrow()
    names = sorted(pc.unique(held["lang"]).to_pylist())
    language = pc.index_in(held["lang"], pa.array(names, pa.string())).to_numpy().astype(np.int64)
    table_, keys, values = held["table"].to_numpy(), held["key"].to_numpy().view(np.uint64), np.column_stack([held["v"].to_numpy(), held["w"].to_numpy()])
    out = Models(names)
    for k in range(1, order + 1):
        for to, which, width in ((out.grams, 2 * k, 1), (out.contexts, 2 * k + 1, 2)):
            at = table_ == which
            to.append(Sparse.of_entries(keys[at], language[at], values[at, :width]))
    out.uniform = 1 / max(2, len(out.grams[0].hashes))
    return out


def train(labelled: DataFrame, fitted: int = FITTED, calibrating: int = CALIBRATING) -> Models:
    """Models from a bounded sample of each label's texts, the lowest by a hash of doc_id (columns doc_id, text, lang).

    Every fifth hash is kept for calibration, unless a label has no others. Each task ranks its own rows first and hands on those within the limit only.
    """
    usable = labelled.where(f"lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL AND length(text) <= {MAX_CHARS}").select("doc_id", "text", "lang")
    share = CHARS / max(1, usable.select("lang").distinct().count())
    part = F.when(F.lit(calibrating > 0), (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 4).cast("int")).otherwise(0)
    by = Window.partitionBy("lang", "part").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = usable.select("doc_id", "lang", part.alias("part"), F.length("text").cast("long").alias("size")).withColumn("r", F.row_number().over(by)).where(F.col("r") <= max(fitted, calibrating))
    within = (F.col("r") <= F.when(F.col("part") == 1, calibrating).otherwise(fitted)) & (F.col("chars") <= share)
    kept = ranked.withColumn("chars", F.sum("size").over(by)).where((F.col("r") == 1) | within)
    # a label whose texts are all of the part that calibrates is fitted on them
    chosen = materialize(kept.select("doc_id", "lang", (F.col("part") - F.min("part").over(Window.partitionBy("lang"))).alias("part")).distinct(), "chosen")
    sample = materialize(usable.join(chosen, ["doc_id", "lang"]), "sample")
    top = materialize(top_counts(sample.where("part = 0")), "grams")
    models = models_of(top)
    own = predict(sample.where("part = 1"), models, keep=("lang",)).where("lang = lang_pred")
    models.limits = {x.lang: float(x.q) for x in own.groupBy("lang").agg(F.percentile_approx("cross_entropy", CALIBRATED).alias("q"), F.count("*").alias("n")).where("n >= 20").collect()}
    for x in (chosen, sample, top):
        discard(x)
    return models


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 3 == 1


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, models).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
