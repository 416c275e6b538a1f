"""SimHash near-duplicates by an inverted index over bytes at their positions.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 4 of their 8 bytes, so at least 4 bytes are
equal at the same position: that is the guaranteed minimum. Posting lists of single bytes would hold a 256th of the
corpus each; so a list is kept for each of 20 triples of positions and the three bytes found there. The triples are a
Turan system: any 4 positions contain one of them, so every pair that reaches the minimum meets in some list. In a
list, the equal bytes of a pair are tallied, pairs with 4 or more are kept, and their differing bits are counted.

A list of more than LONG fingerprints is split by a fourth byte: each of its pairs shares one of the other five bytes,
so five lists for each triple, of the byte found there, still hold every pair. Lists that hold more than a HOT-th of all
postings, of which there are less than HOT, are split before the shuffle, others by the task that meets them; so the
comparisons of lists are bounded by LONG for each posting, or by 32-bit keys.

Equal fingerprints are one class, so copies are never paired. Of a list only a forest of its links is handed on: short
lists are compared in whole-array steps, and in long ones a link's end is set aside once reached, so that a large
group of near copies costs about its size and not its square. Components are found by rounds of Spark joins.

Documents of one fingerprint, and fingerprints of one component, may be a third of all: the joins that name them deal
such groups to many tasks.

A text that is null or has no word has fingerprint zero. Rows with a null doc_id take part, but don't name a
component; a component with no doc_id has a null name. Repeated rows and doc_ids each keep their row. Extra columns
don't matter, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sporeline.llm._components import components
from sporeline.llm._shared import HOT, materialize, salted_join, slices, table, unused

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Texts' shingles that are hashed at once.
RUN = 1 << 16
#: Fingerprints of a list that is compared in whole-array steps, of a list beyond which it is split, and postings that are compared at once.
SHORT, LONG, ROWS = 16, 1 << 14, 1 << 18


def triples() -> list[tuple[int, int, int]]:
    """Triples of the 8 positions of which any 4 positions contain one."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]

    def taken(t: tuple[int, ...]) -> bool:
        held = [[group[p] for p in t].count(g) for g in range(3)]
        return 3 in held or any(held[g] == 2 and held[(g + 1) % 3] == 1 for g in range(3))

    return [t for t in combinations(range(8), 3) if taken(t)]


TRIPLES = triples()
#: The positions outside each triple.
OTHERS = np.array([[p for p in range(8) if p not in t] for t in TRIPLES])


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), RUN):
        h = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[at : at + RUN], ends[at : at + RUN], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fp: the fingerprint's bits as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(work, "doc_id long, fp long")


def _linked(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Count filter, then verification: which pairs share enough bytes and differ in few enough bits."""
    x = a ^ b
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - max_bits
    shared[shared] = np.bitwise_count(x[shared]) <= max_bits
    return shared


def _forest(fps: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join up a list as all of its links would: what is reached is compared only with what isn't."""
    rest = np.sort(fps)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = _linked(np.full(len(rest), at, np.uint64), rest, max_bits)
            found = rest[near]
            if len(found):
                yield np.full(len(found), at, np.uint64), found
                queue.extend(found.tolist())
                rest = rest[~near]


def list_links(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within the posting lists of sorted keys."""
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(edges)
    for k in np.flatnonzero(sizes > SHORT).tolist():
        yield from _forest(fps[edges[k] : edges[k + 1]], max_bits)
    some = (sizes > 1) & (sizes <= SHORT)
    of, owner = fps[np.repeat(some, sizes)], np.repeat(np.flatnonzero(some), sizes[some])
    for lag in range(1, int(sizes[some].max(initial=0))):
        at = np.flatnonzero(owner[lag:] == owner[:-lag])
        a, b = of[at], of[at + lag]
        near = _linked(a, b, max_bits)
        if near.any():
            yield a[near], b[near]


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that join up the same components as all links do."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the triples find pairs that differ in 4 bytes at most")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            held = np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8).astype(np.int64)
            keys = [i << 24 | held[:, p] << 16 | held[:, q] << 8 | held[:, r] for i, (p, q, r) in enumerate(TRIPLES)]
            yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.tile(fp, len(TRIPLES)))], names=["key", "fp"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
            yield deeper(key, fp)

    def deeper(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        bytes_ = np.take_along_axis(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8).astype(np.int64), OTHERS[key >> 24], axis=1)
        keys = 1 << 40 | key[:, None] << 11 | np.arange(OTHERS.shape[1]) << 8 | bytes_
        return pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(fp, OTHERS.shape[1]))], names=["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch], longest: int | None = None) -> Iterator[pa.RecordBatch]:
        """Links (key null, a, b) of whole lists, and the postings (key, a, b null) of those of more than longest fingerprints, split."""

        def out(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            long = np.repeat(np.diff(edges) > longest, np.diff(edges)) if longest else np.zeros(len(keys), bool)
            if long.any():
                yield postings(keys[long], fps[long])
            for a, b in list_links(keys[~long], fps[~long].astype(np.int64).view(np.uint64), max_bits):
                yield pa.record_batch([pa.nulls(len(a), pa.int64()), pa.array(a.astype(np.uint64).view(np.int64)), pa.array(b.astype(np.uint64).view(np.int64))], names=["key", "a", "b"])

        def postings(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            x = deeper(keys, fps)
            return pa.record_batch([x.column("key"), x.column("fp"), pa.nulls(x.num_rows, pa.int64())], names=["key", "a", "b"])

        keys, fps, size = [], [], 0
        going = None  # the key of a list that is split as it comes
        for b in batches:
            key, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
            if going is not None and len(key):
                n = int(np.searchsorted(key, going, "right"))
                if n:
                    yield postings(key[:n], fp[:n])
                key, fp, going = key[n:], fp[n:], going if n == len(key) else None
            if not len(key):
                continue
            keys.append(key)
            fps.append(fp)
            size += len(key)
            if size >= ROWS:
                k, f = np.concatenate(keys), np.concatenate(fps)
                last = int(np.searchsorted(k, k[-1]))  # the last list may go on
                if last:
                    yield from out(k[:last], f[:last])
                k, f = k[last:], f[last:]
                if longest and len(k) > longest:
                    yield postings(k, f)
                    going, k, f = k[-1], k[:0], f[:0]
                keys, fps, size = ([k], [f], len(k)) if len(k) else ([], [], 0)
        if size:
            yield from out(np.concatenate(keys), np.concatenate(fps))

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links_, schema = "key long, a long, b long", "key long, fp long"
    posted = fps.select("fp").mapInArrow(post, schema)
    # a sketch of the frequent keys: less than HOT of them, whatever the input
    hot = [x for x in posted.select("key").stat.freqItems(["key"], 1 / HOT).first()[0] or [] if x is not None]
    often = posted.where(F.col("key").isin(hot)).groupBy("key").count().where(F.col("count") > LONG).select("key").collect() if hot else []
    hot = [x.key for x in often]
    lists = posted.where(~F.col("key").isin(hot)).unionByName(posted.where(F.col("key").isin(hot)).mapInArrow(split, schema)) if hot else posted
    dealt = lambda df: df.repartition(n, "key").sortWithinPartitions("key")
    # keys of split lists have bit 40
    met = materialize(dealt(lists).mapInArrow(lambda x: meet(x, LONG), links_), "links")
    rest = dealt(met.where("key IS NOT NULL").select("key", F.col("a").alias("fp"))).mapInArrow(meet, links_)
    return met.where("key IS NULL").select("a", "b").unionByName(rest.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach) for each row of docs."""
    fps = materialize(fingerprints(docs, text, key), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(classes, max_bits))
    grouped = materialize(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "classes")
    lowest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = salted_join(grouped, lowest, "root").select("fp", "component_id")
    return salted_join(fps, named, "fp", spread="doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, max_bits: int = MAX_BITS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one document of each group of near-duplicates: the one of the smallest doc_id.

    A doc_id on several rows stays if any of them is the first of its group; rows without a doc_id all stay. The ids that go
    are stored first, so that Spark knows their size: it sends few of them to all tasks, and shuffles docs only for many.
    """
    groups = near_duplicates(docs, max_bits, text, key).where("doc_id IS NOT NULL")
    name = unused(docs, "gone")
    gone = groups.groupBy(F.col("doc_id").alias(name)).agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first")).where("NOT first").select(name)
    gone = materialize(gone, "gone")
    return docs.join(gone, docs[key].cast("long") == gone[name], "left_anti")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_simhash_dedup": op9_simhash_dedup}
ORACLES: dict[str, str] = {}
