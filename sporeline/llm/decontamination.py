"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are sequences of words (runs of word characters, lower-cased). An item of n words may be off by
e = n // WORDS_AN_EDIT word edits. It is split into e + 1 pieces, of which e edits leave at least one as it is; so an
automaton over all pieces finds every place where an item may stand. Around each such place Myers' bit-parallel
distance decides. A benchmark of BLOCK_BYTES or less is sent to all tasks, and documents are never moved.

A larger benchmark stays distributed. Its pieces are a table, and so are the runs of words in texts that are as long as
pieces; a filter of FILTER_BITS bits that all pieces are entered in keeps out most runs that are no piece. Both tables
are joined by hash, the places found for a text and an item are brought together, and the texts' words around them and
the items join for the distance. A piece that a large share of texts has is dealt to many tasks.

Null and empty texts and items match nothing. Items with equal texts are each reported. Rows with a null or repeated
doc_id are reported like any other; extra columns don't matter; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sporeline.llm._edits import distances
from sporeline.llm._shared import materialize, salted_join, slices, table, unused

WORD = re.compile(r"\w+")
WORDS_AN_EDIT = 8
#: Bytes of items that one automaton is built from, and bits of the filter of a larger benchmark's pieces.
BLOCK_BYTES, FILTER_BITS = 32 << 20, 1 << 27


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def pieces(words: list[str], edits: int) -> list[tuple[int, list[str]]]:
    """edits + 1 pieces of about the same length, with their places."""
    edges = [len(words) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, words[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Matcher:
    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(i, words_of(t)) for i, t in items]
        self.items = [(i, w, len(w) // WORDS_AN_EDIT) for i, w in self.items if w]
        places: dict[str, list[tuple[int, int, int]]] = {}
        for k, (_, words, edits) in enumerate(self.items):
            for at, piece in pieces(words, edits):
                places.setdefault(f" {' '.join(piece)} ", []).append((k, at, len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, of in places.items():
            self.automaton.add_word(piece, of)
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def match(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """item_id, edits, first word, word after the last one, places: the best place of each item that text has."""
        words = words_of(text)
        if not words or self.empty:
            return []
        whole = f" {' '.join(words)} "
        found: dict[int, set[int]] = {}
        starts: list[int] = []
        for end, of in self.automaton.iter(whole):
            if not starts:
                at = 1
                for w in words:
                    starts.append(at)
                    at += len(w) + 1
            after = bisect_right(starts, end)  # words up to the piece's end
            for k, at, n in of:
                found.setdefault(k, set()).add(after - n - at)
        out = []
        for k in sorted(found):
            item, pattern, edits = self.items[k]
            best = best_place(pattern, edits, found[k], len(words), lambda lo, hi: words[lo:hi])
            if best:
                out.append((item, *best))
        return out


def best_place(pattern: list[str], edits: int, starts: set[int], n: int, window) -> tuple[int, int, int, int] | None:
    """edits, first word, word after the last one, places: the best of the places near starts where a text of n words, of which window(lo, hi) gives some, has pattern."""
    hits = []
    for lo, hi in spans_of(starts, len(pattern), edits, n):
        held = window(lo, hi)
        ends = distances(pattern, held)
        best = min(ends)
        if best <= edits:
            end = ends.index(best)
            back = distances(pattern[::-1], held[end::-1], anywhere=False)  # where the best match that ends here starts
            hits.append((best, lo + end - back.index(min(back)), lo + end + 1))
    return (*min(hits), len(hits)) if hits else None


def spans_of(starts: set[int], size: int, edits: int, n: int) -> list[list[int]]:
    """First word and word after the last one of the stretches of a text of n words in which matches that begin near starts lie."""
    spans: list[list[int]] = []
    for at in sorted(starts):
        lo, hi = max(0, at - edits), min(n, at + size + 2 * edits)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(hi, spans[-1][1])
        else:
            spans.append([lo, hi])
    return spans


SCHEMA = "doc_id long, item_id long, edits int, start_word int, end_word int, places int"


def _runs(words: list[str], size: int) -> np.ndarray:
    """Hashes of the runs of size words."""
    h = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    n = max(0, len(words) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _found_by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """SCHEMA's columns, but number (the row of docs: columns number, text) for doc_id, for a benchmark (columns item, item_id, text) of any size."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = []
            for item, t in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = words_of(t)
                if words:
                    rows += [(int(_runs(piece, len(piece))[0]), len(piece), item, at, len(words)) for at, piece in pieces(words, len(words) // WORDS_AN_EDIT)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["hash", "size", "item", "at", "n"])

    cuts = materialize(items.select("item", "text").mapInArrow(cut, "hash long, size int, item long, at int, n int"), "pieces")
    bit = F.pmod("hash", F.lit(FILTER_BITS))
    words = cuts.groupBy(F.shiftright(bit, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(hash, {FILTER_BITS}) % 64 as int))")).alias("bits")).toPandas()  # FILTER_BITS / 64 rows at most
    table_ = np.zeros(FILTER_BITS // 64, np.int64)
    table_[words["word"].to_numpy()] = words["bits"].to_numpy()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((table_.view(np.uint64), [r.size for r in cuts.select("size").distinct().collect()]))  # pieces have WORDS_AN_EDIT words at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes = shared.value
        for b in slices(batches, "text"):
            for number, t in zip(b.column("number").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = words_of(t)
                for size in sizes:
                    h = _runs(words, size)
                    bit = h.view(np.uint64) & np.uint64(FILTER_BITS - 1)
                    at = np.flatnonzero(held[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
                    if len(at):
                        yield pa.record_batch([pa.array(h[at]), pa.array(np.full(len(at), number)), pa.array(at.astype(np.int32))], names=["hash", "number", "place"])

    runs = docs.select("number", "text").mapInArrow(scan, "hash long, number long, place int")
    met = salted_join(materialize(runs, "runs"), cuts, "hash").select("number", "item", "n", (F.col("place") - F.col("at")).alias("start"))
    starts = materialize(met.groupBy("number", "item", "n").agg(F.collect_set("start").alias("starts")), "starts")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, t, wanted in zip(*(b.column(c).to_pylist() for c in ("number", "text", "wanted")), strict=True):
                words = words_of(t)
                rows = []
                for x in wanted:
                    spans = spans_of(set(x["starts"]), x["n"], x["n"] // WORDS_AN_EDIT, len(words))
                    rows.append((number, x["item"], x["starts"], len(words), [{"lo": lo, "words": words[lo:hi]} for lo, hi in spans]))
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.struct([("lo", pa.int32()), ("words", pa.list_(pa.string()))]))]
                yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["number", "item", "starts", "size", "windows"])

    wanted = starts.groupBy("number").agg(F.collect_list(F.struct("item", "n", "starts")).alias("wanted"))
    around = docs.join(wanted, "number").select("number", "text", "wanted").mapInArrow(windows, "number long, item long, starts array<int>, size int, windows array<struct<lo:int,words:array<string>>>")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for number, item_id, text, starts, n, held in zip(*(b.column(c).to_pylist() for c in ("number", "item_id", "text", "starts", "size", "windows")), strict=True):
                pattern = words_of(text)
                by = {x["lo"]: x["words"] for x in held}
                best = best_place(pattern, len(pattern) // WORDS_AN_EDIT, set(starts), n, lambda lo, hi, by=by: by[lo])
                if best:
                    out.append((number, item_id, *best))
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
            yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["number", "item_id", "edits", "start_word", "end_word", "places"])

    pairs = salted_join(materialize(around, "windows"), items, "item", spread="number")
    return pairs.select("number", "item_id", "text", "starts", "size", "windows").mapInArrow(verify, SCHEMA.replace("doc_id", "number"))


def _items(benchmark: DataFrame, item_key: str, item_text: str) -> DataFrame:
    return benchmark.where(benchmark[item_text].isNotNull()).select(benchmark[item_key].cast("long").alias("item_id"), benchmark[item_text].alias("text"))


def _small(items: DataFrame, limit: int) -> list[tuple[int, str]] | None:
    """The items if they have limit bytes or less in all."""
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    return [(r.item_id, r.text) for r in items.collect()] if size <= limit else None


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and benchmark item that stands in it, with the best place."""
    items = _items(benchmark, item_key, item_text)
    taken = docs.where(docs[text].isNotNull()).select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    small = _small(items, limit)
    if small is None:
        numbered = materialize(taken.withColumn("number", F.monotonically_increasing_id()), "documents")
        numbers = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")
        found = _found_by_join(numbered, numbers)
        return numbered.select("number", "doc_id").join(found, "number").select("doc_id", "item_id", "edits", "start_word", "end_word", "places")
    shared = docs.sparkSession.sparkContext.broadcast(small)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for b in slices(batches, "text"):
            rows = [(d, *m) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for m in matcher.match(t)]
            if rows:
                columns = zip(*rows, strict=True)
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "edits", "start_word", "end_word", "places"])

    return taken.mapInArrow(work, SCHEMA)


def without_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that no benchmark item stands in, with all their columns. For a small benchmark, documents are filtered where they are."""
    items = _items(benchmark, item_key, item_text)
    small = _small(items, limit)
    if small is None:
        name = unused(docs, "number")
        numbered = materialize(docs.withColumn(name, F.monotonically_increasing_id()), "documents")
        numbers = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")
        found = _found_by_join(numbered.where(numbered[text].isNotNull()).select(numbered[name].alias("number"), numbered[text].alias("text")), numbers)
        return numbered.join(found.select(F.col("number").alias(name)).distinct(), name, "left_anti").select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(small)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for b in slices(batches, text):
            yield b.filter(pa.array([not matcher.match(t) for t in b.column(text).to_pylist()]))

    return docs.mapInArrow(work, docs.schema)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES: dict[str, str] = {}
