"""Substring dedup: passages that stand in several documents, exactly or with small edits, by collinear chaining.

Texts are sequences of words (runs of word characters, lower-cased), and a text's key is its hash, so that exact copies
are one text. The work is five Spark steps:

1. seeds: of every WINDOW neighbouring runs of SEED words the one with the lowest hash is kept, wherever it stands.
2. matches: each seed is matched with its first place in the text of the lowest key that has it. A task first links the
   equal seeds of its own block of texts and shuffles one text's rows of each; the others, a few for each block, take
   over what theirs was matched with. So a seed that a third of all texts has makes one row for each block there.
3. contexts: neighbouring seeds may have different partners where each of them stands in many texts. So runs of LEAST
   words, and pairs of seeds on either side of such a change, are matched in the same way as if they were seeds.
4. chains: a shuffle by pair of texts; runs of matches on one diagonal are anchors, and a Fenwick tree over the places in
   the other text finds each anchor's best predecessor at a cost for the gap.
5. windows: the words around a chain are cut out of both texts, once for all chains that need them.
6. alignment: stretches between anchors are aligned by edit distance, chains that aren't similar enough are split, and
   ends are extended.

A stretch of a text is repeated if chains of LEAST words or more, SIMILAR or more of them equal, cover MIN_WORDS words
without a gap. Each stretch is reported with its chains' originals, which are in texts of lower keys. Every run of SEED + WINDOW - 1
equal words shares a seed. Every run of LEAST words in a longer equal run shares a partner with which it makes a chain of LEAST
words, however often its parts stand in the corpus and however texts are dealt to tasks, so that exact repeats are
found whole. Fuzzy ones need runs of equal words long enough for seeds that stand near each other: of passages of 70 words and more,
the tests hold nine of ten found with every seventh word changed; with every sixth one changed, two of three are found, and with
every fifth one there is no seed.

Null texts and those of fewer than SEED words have no passages. Rows with equal texts are copies: all but those of the
smallest doc_id are reported as copies of it, and the text's stretches once. Null and repeated doc_ids are reported like
any other, passages within one text aren't. Very long texts are worked on whole, as arrays of word hashes. Extra columns
don't matter, whatever their names; an empty table gives an empty result. Copies have equal MD5 sums beside equal keys; two
different texts of one 64-bit key (one pair of them is to be expected in 6 * 10^9 texts) count as one when passages are sought.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sporeline.llm._edits import distance
from sporeline.llm._shared import discard, discarded_after, materialize, salted_join, slices, table, unused

WORD = re.compile(r"\w+")
SEED, WINDOW = 5, 3
#: Words of a repeated stretch, of a chain in it, and the share of equal words, at least.
MIN_WORDS, LEAST, SIMILAR = 40, 20, 0.8
#: Words between anchors of a chain at most, words beyond its ends that are looked at, and those that count when a text's chains are too few for a stretch.
MAX_GAP, MARGIN, REACH = 25, 16, 10
#: What a word between anchors costs in either text; an anchor's word is worth 1. Alignment judges what is chained.
GAP = 0.15
#: Characters of text whose seeds are linked at once, and rows of matches that are chained, of seeds that are read and of links that are handed on at once.
BLOCK_CHARS, ROWS = 4 << 20, 1 << 17
#: Different words whose hashes a worker keeps, or windows that it counts.
CACHED = 1 << 18
#: Chains of a task that ask for the same window before others of the task ask for a copy of it, so many at a time.
FIRST, COPY = 8, 1 << 12
_MIX, _STEP, _NONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFFFFFFFFFFFFFFFF)


class WordHashes(dict):
    """The hash of each word met so far."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > CACHED:
            self.clear()
        words = WORD.findall((text or "").lower())
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _sliding(x: np.ndarray, width: int, op, fill) -> np.ndarray:
    """op over x[i : i + width] for each i, with fill beyond the end."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = op(out, np.r_[out[step:], np.full(min(step, len(out)), fill, x.dtype)])
        have += step
    return out


def seeds_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, text's number and first word of the seeds of texts (arrays of word hashes)."""
    sizes = np.array([len(x) for x in texts], np.int64)
    room = sizes + WINDOW  # empty places, so that no window sees two texts
    starts = np.cumsum(room) - room
    codes = np.zeros(int(room.sum()) + SEED, np.uint64)
    for x, at in zip(texts, starts.tolist(), strict=True):
        codes[at : at + len(x)] = x
    n = len(codes) - SEED
    owner = np.repeat(np.arange(len(texts)), room)
    place = np.arange(n) - starts[owner]
    h = np.zeros(n, np.uint64)
    for j in range(SEED):
        h = (h ^ codes[j : j + n]) * _MIX
        h ^= h >> np.uint64(31)
    h = np.where(place + SEED <= sizes[owner], h * _STEP & ~np.uint64(1), _NONE)
    lowest = _sliding(h, WINDOW, np.minimum, _NONE)
    before = np.minimum.accumulate(h[: WINDOW - 1])  # of windows that begin before the first text; those of others begin in empty places
    best = _sliding(np.r_[before, lowest][::-1], WINDOW, np.maximum, np.uint64(0))[::-1][WINDOW - 1 :]  # the highest minimum of the windows that a place is in
    at = np.flatnonzero((best == h) & (h != _NONE))
    tied = np.r_[False, (h[at][1:] == h[at][:-1]) & (np.diff(at) == 1), False]  # a word over and over: of WINDOW places the first, and the last of all
    begun = np.maximum.accumulate(np.where(tied[: len(at)], 0, np.arange(len(at))))
    at = at[((np.arange(len(at)) - begun) % WINDOW == 0) | ~tied[1 : len(at) + 1]]
    return h[at], owner[at], place[at]


def contexts_of(owner: np.ndarray, place: np.ndarray, h: np.ndarray, low: np.ndarray, low_place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, text's number, first and last seed's place of the contexts of shared seeds (by text and place), of which low and low_place are the partner and its place.

    A context is a run of seeds that cover LEAST words without a gap (an odd hash), or a pair of seeds (an even one), and has more than one partner.
    """
    diagonal = place - low_place
    joined = np.r_[False, (owner[1:] == owner[:-1]) & (place[1:] - place[:-1] <= WINDOW)][: len(place)]
    change = ~np.r_[False, joined[1:] & (low[1:] == low[:-1]) & (diagonal[1:] == diagonal[:-1])][: len(place)]
    gaps, changes = np.cumsum(~joined), np.cumsum(change)
    along = owner << 33 | place
    end = np.searchsorted(along, along + LEAST - SEED)
    i = np.flatnonzero(end < len(place))
    j = end[i]
    keep = (gaps[j] == gaps[i]) & (changes[j] != changes[i])
    i, j = i[keep], j[keep]
    run = np.zeros(len(i), np.uint64)
    for k in range(int((j - i).max(initial=-1)) + 1):
        at = np.minimum(i + k, j)
        more = (run ^ h[at] ^ (place[at] - place[i]).astype(np.uint64) * _STEP) * _MIX
        run = np.where(i + k <= j, more ^ more >> np.uint64(29), run)  # a context's hash has its own seeds, however long others are
    heads = np.flatnonzero(change)
    out = [(run | np.uint64(1), owner[i], place[i], place[j])]
    for skip in (1, 2):  # from the last seed before a change to the first after it, and after the next one
        a, b = heads[1 : len(heads) + 1 - skip] - 1, heads[skip:]
        keep = (owner[a] == owner[b]) & (low[a] != low[b]) & (place[b] - place[a] <= MAX_GAP + SEED)
        a, b = a[keep], b[keep]
        pair = (h[a] * _MIX ^ h[b]) * _STEP
        out.append((pair & ~np.uint64(1), owner[a], place[a], place[b]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


ALONE, FIRST_OF_BLOCK, FOLLOWER = range(3)
#: tag: number of the block, and one of these three in the lowest two bits. at: a place, and how far the last seed is from it in the lowest FAR bits.
FAR = 8
ROW_SCHEMA = "hash long, key long, tag long, at long"
MATCH_SCHEMA = "hash long, key long, tag long, at long, other long, other_at long"


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c.astype(np.int64, copy=False)) for c in columns], names=[x.split()[0] for x in schema.split(", ")])


def _first_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a row is the first of those with its value, and the number of that row; equal values stand together."""
    first = np.r_[True, x[1:] != x[:-1]][: len(x)]
    return first, np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))


def link_block(block: int, hashes: np.ndarray, key: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows (ROW_SCHEMA) of a block. All but the first place in the lowest key of a hash are followers."""
    by = np.lexsort((at, key, hashes))
    h, key, at = hashes[by].view(np.int64), key[by], at[by]
    first, of = _first_of(h)
    led = np.zeros(len(h), bool)
    led[of[~first]] = True
    kind = np.where(~first, FOLLOWER, np.where(led, FIRST_OF_BLOCK, ALONE))
    return _batch(ROW_SCHEMA, h, key, block << 2 | kind, at)


class Block:
    """Seeds or contexts of a task's texts, linked block by block. Of texts only these are held."""

    def __init__(self, task: int):
        self.number, self.held = task, []

    def add(self, hashes: np.ndarray, key: np.ndarray, at: np.ndarray) -> None:
        self.held.append((hashes, key, at))

    def linked(self) -> Iterator[pa.RecordBatch]:
        """Rows (ROW_SCHEMA) of what was added, ROWS at a time; then the next block begins."""
        columns = [np.concatenate(x) for x in zip(*self.held, strict=True)]
        self.held.clear()
        rows = link_block(self.number, *columns)
        del columns
        self.number += 1
        for at in range(0, rows.num_rows, ROWS):
            yield rows.slice(at, ROWS)


def seed_rows(batches: Iterator[pa.RecordBatch], task: int) -> Iterator[pa.RecordBatch]:
    """Rows (ROW_SCHEMA) of the seeds of texts (columns key, text), a text once in each block of about BLOCK_CHARS; texts are read in slices and let go."""
    words, block, seen, size = WordHashes(), Block(task), set(), 0
    for b in slices(batches, "text"):
        new: dict[int, np.ndarray] = {}
        for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
            if k not in seen:
                seen.add(k)
                new[k] = words.of(t)
                size += len(t)
        h, owner, place = seeds_of(list(new.values()))
        block.add(h, np.array(list(new), np.int64)[owner], place << FAR)
        if size > BLOCK_CHARS:
            yield from block.linked()
            seen, size = set(), 0
    if seen:
        yield from block.linked()


def context_rows(batches: Iterator[pa.RecordBatch], task: int) -> Iterator[pa.RecordBatch]:
    """Rows (ROW_SCHEMA) of the contexts of lists of shared seeds (columns key, seeds), of which about ROWS are read at once."""
    block, size = Block(task), 0
    for whole in batches:
        ends = np.cumsum(whole.column("seeds").value_lengths().to_numpy(zero_copy_only=False))
        begin = 0
        while begin < whole.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + ROWS, "right")))
            b, begin = whole.slice(begin, end - begin), end
            held = b.column("seeds")
            place, h, low, low_place = (held.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            owner = np.repeat(np.arange(b.num_rows), held.value_lengths().to_numpy())
            code, of, first, last = contexts_of(owner, place, h.view(np.uint64), low, low_place)
            block.add(code, b.column("key").to_numpy()[of], first << FAR | last - first)
            size += len(code)
            if size > 4 * ROWS:
                yield from block.linked()
                size = 0
    if block.held:
        yield from block.linked()


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a hash with the first place of its lowest key; those with nothing to say are dropped, followers go along."""

    def told(rows: np.ndarray) -> pa.RecordBatch:
        h, key, tag, at = rows[:, np.lexsort((rows[3], rows[1], rows[0]))]
        of = _first_of(h)[1]
        some = (key != key[of]) | (tag & 3 == FIRST_OF_BLOCK)
        return _batch(MATCH_SCHEMA, *(x[some] for x in (h, key, tag, at, key[of], at[of])))

    held = np.zeros((4, 0), np.int64)  # rows of the last hash, which may go on
    for b in batches:
        rows = np.stack([b.column(i).to_numpy() for i in range(4)])
        follows = rows[2] & 3 == FOLLOWER
        if follows.any():
            some, none = rows[:, follows], np.zeros(int(follows.sum()))
            yield _batch(MATCH_SCHEMA, *some, none, none)
        rows = np.concatenate([held, rows[:, ~follows]], axis=1)
        whole = int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0
        if whole:
            yield told(rows[:, :whole])
        held = rows[:, whole:]
    yield told(held)


def matched(rows: DataFrame, name: str) -> DataFrame:
    """hash, key, at, other, other_at for rows (ROW_SCHEMA): each with the first place of its hash in the text of the lowest key that has it, if that is another text."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = lambda k: F.col("tag").bitwiseAND(3) == k
    dealt = rows.repartition(n, F.when(kind(FOLLOWER), F.xxhash64("key", "at")).otherwise(F.col("hash"))).sortWithinPartitions("hash")
    found = materialize(dealt.mapInArrow(_match, MATCH_SCHEMA), name)
    block = F.shiftright("tag", 2).alias("block")
    led = found.where(kind(FIRST_OF_BLOCK)).select("hash", block, "other", "other_at")
    followers = found.where(kind(FOLLOWER)).select("hash", block, "key", "at").join(led, ["hash", "block"])
    columns = "hash", "key", "at", "other", "other_at"
    return discarded_after(materialize(found.where(~kind(FOLLOWER)).select(*columns).unionByName(followers.select(*columns)).where("key <> other"), name), found)


def seed_matches(docs: DataFrame) -> DataFrame:
    """The matches of the seeds of texts (columns key, text)."""

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return seed_rows(batches, TaskContext.get().partitionId() << 32)

    return matched(docs.select("key", "text").mapInArrow(seed, ROW_SCHEMA), "seeds")


def context_matches(seeds: DataFrame) -> DataFrame:
    """The matches of the contexts of shared seeds, from seed_matches()."""

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return context_rows(batches, TaskContext.get().partitionId() << 32)

    place, low_place = F.shiftright("at", FAR).alias("place"), F.shiftright("other_at", FAR)
    ends = seeds.select("key", place, "hash", F.col("other").alias("low"), low_place.alias("low_place"))
    firsts = seeds.select(F.col("other").alias("key"), low_place.alias("place"), "hash", F.col("other").alias("low"), low_place.alias("low_place"))
    shared = ends.unionByName(firsts).groupBy("key", "place").agg(F.min("hash").alias("hash"), F.min("low").alias("low"), F.min("low_place").alias("low_place"))
    lists = shared.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "hash", "low", "low_place"))).alias("seeds"))
    return matched(lists.mapInArrow(context, ROW_SCHEMA), "contexts")


def matches(seeds: DataFrame, contexts: DataFrame) -> DataFrame:
    """key, other, place, other_place, words: equal words of a text and of one of a lower key, from both kinds of matches."""
    run, far = F.col("hash") % 2 != 0, lambda c: F.col(c).bitwiseAND((1 << FAR) - 1)
    place = lambda c, after=0: (F.shiftright(c, FAR) + after).cast("int")
    plain = lambda df, p, q, words: df.select("key", "other", p.alias("place"), q.alias("other_place"), words.cast("int").alias("words"))
    parts = (
        plain(seeds, place("at"), place("other_at"), F.lit(SEED)),
        plain(contexts, place("at"), place("other_at"), F.when(run, far("at")).otherwise(0) + SEED),
        plain(contexts.where(~run), place("at", far("at")), place("other_at", far("other_at")), F.lit(SEED)),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def chain_anchors(anchors: np.ndarray) -> list[list[int]]:
    """Chains of anchors (rows: first place, last place, first and last place in the other text), best first, as lists of rows.

    An anchor's score is its words plus the best of no predecessor and of an earlier anchor's score less GAP for each word
    between them in either text. That cost is a sum over ends, so a Fenwick tree of prefix maxima finds the best.
    """
    n = len(anchors)
    p0, p1, r0, r1 = (c.tolist() for c in anchors.T)
    ranks = sorted(set(r1))
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (len(ranks) + 1)
    begin, end = sorted(range(n), key=lambda i: (p0[i], r0[i])), sorted(range(n), key=lambda i: (p1[i], r1[i]))
    score, before, done = [0.0] * n, [-1] * n, 0
    for i in begin:
        while done < n and p1[end[done]] < p0[i]:
            j = end[done]
            value = (score[j] + GAP * (2 * SEED + p1[j] + r1[j]), j)
            at = bisect_left(ranks, r1[j]) + 1
            while at <= len(ranks):
                tree[at] = max(tree[at], value)
                at += at & -at
            done += 1
        at, best = bisect_left(ranks, r0[i]), (-np.inf, -1)
        while at:
            best = max(best, tree[at])
            at -= at & -at
        gain = best[0] - GAP * (p0[i] + r0[i])
        score[i] = p1[i] - p0[i] + SEED + max(0.0, gain)
        before[i] = best[1] if gain > 0 else -1
    out, used = [], [False] * n
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def split_gaps(chain: np.ndarray) -> list[np.ndarray]:
    """A chain's rows (as in chain_anchors) in pieces without a gap of more than MAX_GAP words in either text."""
    wide = np.maximum(chain[1:, 0] - chain[:-1, 1], chain[1:, 2] - chain[:-1, 3]) - SEED > MAX_GAP
    return np.split(chain, np.flatnonzero(wide) + 1)


def chains_of(pairs: np.ndarray, place: np.ndarray, other_place: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Number of the pair and the anchors of each chain of LEAST - 2 * MARGIN words or more; pairs are numbered in order, matches have words."""
    by = np.lexsort((place, place - other_place, pairs))
    pairs, place, other_place, words = pairs[by], place[by], other_place[by], words[by]
    diagonal = place - other_place
    other = np.r_[True, (pairs[1:] != pairs[:-1]) | (diagonal[1:] != diagonal[:-1])]
    run = np.cumsum(other) << 33
    high = np.maximum.accumulate(run + place + words - SEED) - run  # the last seed's place so far on the diagonal
    new = other | np.r_[True, place[1:] - high[:-1] > SEED + WINDOW]
    first = np.flatnonzero(new)
    final = np.r_[first[1:], len(new)] - 1
    anchors = np.stack([place[first], high[final], other_place[first], high[final] - diagonal[final]], axis=1)
    of = pairs[first]
    edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
    words = np.add.reduceat(anchors[:, 1] - anchors[:, 0] + SEED, edges[:-1])
    for k in np.flatnonzero(words >= LEAST // 2).tolist():
        own = anchors[edges[k] : edges[k + 1]]
        pieces = [x for chain in ([[0]] if len(own) == 1 else chain_anchors(own)) for x in split_gaps(own[chain])]
        for piece in needed([x for x in pieces if min(x[-1, 1] - x[0, 0], x[-1, 3] - x[0, 2]) + SEED >= LEAST // 2]):
            yield int(of[edges[k]]), piece


def needed(pieces: list[np.ndarray]) -> list[np.ndarray]:
    """Pieces of chains of two texts without exact ones whose words others cover: where a word stands over and over, each place has one."""
    exact = [x for x in pieces if len(x) == 1 and x[0, 1] - x[0, 0] + SEED >= LEAST]
    out = [x for x in pieces if len(x) > 1 or x[0, 1] - x[0, 0] + SEED < LEAST]
    exact.sort(key=lambda x: (int(x[0, 0]), -int(x[0, 1])))
    end, best = -1, None  # words that are covered, and the piece that goes farthest of those that begin in them
    for x in exact:
        if best is not None and x[0, 0] > end:
            out.append(best)
            end, best = best[0, 1] + SEED, None
        if x[0, 1] + SEED > end and (best is None or x[0, 1] > best[0, 1]):
            if x[0, 0] > end:
                out.append(x)
                end = x[0, 1] + SEED
            else:
                best = x
    return out if best is None else [*out, best]


CHAIN_SCHEMA = "key long, other long, begin int, end int, other_begin int, other_end int, copy long, anchors array<int>"


def chains(matched: DataFrame) -> DataFrame:
    """key, other, the words of either that alignment looks at, the copy of the other's window that it asks for, and anchors (each one's first and last place in either text)."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, asked = TaskContext.get().partitionId() + 1 << 32, Counter()

        def copy(window: tuple) -> int:
            asked[window] += 1
            return 0 if asked[window] <= FIRST else task | asked[window] // COPY

        def out(rows: np.ndarray) -> pa.RecordBatch:
            key, place, other, other_place, words = rows
            pairs = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (other[1:] != other[:-1])])
            at = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
            found = list(chains_of(pairs, place, other_place, words))
            of = at[[p for p, _ in found]] if found else np.zeros(0, np.int64)
            edges = np.array([(a[0, 0], a[-1, 1], a[0, 2], a[-1, 3]) for _, a in found], np.int64).reshape(-1, 4)
            # edges are rounded, so that texts that share a passage ask for the same window
            begin, end = np.maximum(0, edges[:, ::2] - MARGIN) // MARGIN * MARGIN, -(-(edges[:, 1::2] + SEED + MARGIN) // MARGIN) * MARGIN
            if len(asked) > CACHED:
                asked.clear()
            copies = [copy(w) for w in zip(other[of].tolist(), begin[:, 1].tolist(), end[:, 1].tolist(), strict=True)]
            spans = [pa.array(x.astype(np.int32)) for x in (begin[:, 0], end[:, 0], begin[:, 1], end[:, 1])]
            return pa.record_batch([pa.array(key[of]), pa.array(other[of]), *spans, pa.array(copies, pa.int64()), pa.array([a.ravel() for _, a in found], pa.list_(pa.int32()))], names=[x.split()[0] for x in CHAIN_SCHEMA.split(", ")])

        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            rows = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "place", "other", "other_place", "words")])
            held.append(rows)
            size += rows.shape[1]
            if size >= ROWS and rows.shape[1] and (held[0][0, 0], held[0][2, 0]) != (rows[0, -1], rows[2, -1]):
                rows = np.concatenate(held, axis=1)
                whole = int(np.flatnonzero((rows[0] != rows[0, -1]) | (rows[2] != rows[2, -1]))[-1]) + 1  # the last pair may go on
                yield out(rows[:, :whole])
                held, size = [rows[:, whole:]], rows.shape[1] - whole
        if size:
            yield out(np.concatenate(held, axis=1))

    n = int(matched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return matched.repartition(n, "key", "other").sortWithinPartitions("key", "other", "place", "other_place").mapInArrow(chain, CHAIN_SCHEMA)


def align(own: np.ndarray, window: np.ndarray, own_begin: int, begin: int, anchors: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """First word, word after the last one, the same in the other text, and edits, of the similar parts of a chain.

    own: word hashes of the text from its word own_begin on; window: those of the other text from its word begin on.
    """
    parts = [anchors - np.array([own_begin, own_begin, begin, begin])]
    out = []
    while parts:
        a = parts.pop()
        starts, ends, costs = [], [], []
        at, there = a[0, 0], a[0, 2]
        for p0, p1, r0, r1 in a.tolist():
            p0, r0 = max(p0, at), max(r0, there)  # anchors may overlap by part of a seed
            starts.append((p0, r0))
            p1, r1 = p1 + SEED, r1 + SEED
            n = max(0, min(p1 - p0, r1 - r0))
            costs.append(int((own[p0 : p0 + n] != window[r0 : r0 + n]).sum()) + max(p1 - p0, r1 - r0, 0) - n)
            ends.append((max(p1, at), max(r1, there)))
            at, there = ends[-1]
        gaps = [distance(own[ends[i][0] : starts[i + 1][0]].tolist(), window[ends[i][1] : starts[i + 1][1]].tolist()) for i in range(len(a) - 1)]
        edits, (p, r), (q, s) = sum(costs) + sum(gaps), starts[0], ends[-1]
        left, left_there, lost_left = _extend(own[:p][::-1], window[:r][::-1])
        right, right_there, lost_right = _extend(own[q:], window[s:])
        edits += lost_left + lost_right
        p, r, q, s = p - left, r - left_there, q + right, s + right_there
        size = max(q - p, s - r)
        if edits <= (1 - SIMILAR) * size:
            if size >= LEAST:
                out.append((own_begin + p, own_begin + q, begin + r, begin + s, edits))
        elif gaps:
            worst = gaps.index(max(gaps))
            parts += [a[: worst + 1], a[worst + 1 :]]
    return out


def _extend(own: np.ndarray, other: np.ndarray) -> tuple[int, int, int]:
    """Words by which an end grows in either text, MARGIN at most, and edits among them.

    It goes along the diagonal for the most equal words less two for each that differs; then past a word that only one
    text has, if more than two such points follow; and so on.
    """
    own, other = own[:MARGIN], other[:MARGIN]
    i = j = edits = 0
    skips, least = [(0, 0)], 0
    while True:
        gain, k, differ, a, b = max((*_along(own[i + a :], other[j + b :]), a, b) for a, b in skips)
        if gain > least:
            i, j, edits = i + a + k, j + b + k, edits + differ + a + b
        elif least:
            return i, j, edits
        skips, least = [(0, 1), (1, 0)], 2


def _along(own: np.ndarray, other: np.ndarray) -> tuple[int, int, int]:
    n = min(len(own), len(other))
    if not n:
        return 0, 0, 0
    same = own[:n] == other[:n]
    gain = np.cumsum(np.where(same, 1, -2))
    k = int(gain.argmax())
    return int(gain[k]), k + 1, int((~same[: k + 1]).sum())


SPAN_SCHEMA = "key long, chain_start int, chain_end int, other long, other_start int, other_end int, edits int"


def stretches(spans: DataFrame) -> DataFrame:
    """spans (key, chain_start, chain_end, ..) with start_word and end_word of the stretch that a text's spans cover without a gap around each; only those of MIN_WORDS words or more."""
    before = Window.partitionBy("key").orderBy("chain_start", "chain_end").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.col("chain_start") > F.max("chain_end").over(before), F.lit(True))
    numbered = spans.withColumn("first", first).withColumn("stretch", F.sum(F.col("first").cast("int")).over(Window.partitionBy("key").orderBy("chain_start", "chain_end").rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("key", "stretch")
    out = numbered.withColumn("start_word", F.min("chain_start").over(whole)).withColumn("end_word", F.max("chain_end").over(whole))
    return out.where(F.col("end_word") - F.col("start_word") >= MIN_WORDS).drop("first", "stretch")


def passages(docs: DataFrame) -> DataFrame:
    """The chains in repeated stretches of distinct texts (columns key, text), by key; other is the key of the text with the original."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches, "text"):
            new = []
            for k in b.column("key").to_pylist():
                new.append(k not in seen)
                seen.add(k)
            yield b.filter(pa.array(new, pa.bool_()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = WordHashes(), (None, None)
        for b in slices(batches, "text"):
            for key, text, spans in zip(*(b.column(c).to_pylist() for c in ("key", "text", "spans")), strict=True):
                if held[0] != key:  # copies of a text in other blocks come one after another
                    own = words.of(text)
                    held = key, text
                    names = list(spans[0]) if spans else []
                    columns = [pa.array([x[n] for x in spans], t) for n, t in zip(names, (pa.int32(), pa.int32(), pa.int64()), strict=False)]
                    yield pa.record_batch([pa.array([key] * len(spans), pa.int64()), *columns, pa.array([own[x["begin"] : x["end"]].tobytes() for x in spans], pa.binary())], names=["key", *names, "window"])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "window"):
            out = []
            for key, begin, own, other, other_begin, window, anchors in zip(*(b.column(c).to_pylist() for c in ("key", "begin", "own", "other", "other_begin", "window", "anchors")), strict=True):
                found = align(np.frombuffer(own, np.uint64), np.frombuffer(window, np.uint64), begin, other_begin, np.array(anchors, np.int64).reshape(-1, 4))
                out += [(key, p, q, other, r, s, edits) for p, q, r, s, edits in found]
            kinds = [pa.int64(), *[pa.int32()] * 2, pa.int64(), *[pa.int32()] * 3]
            yield pa.record_batch([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in SPAN_SCHEMA.split(", ")])

    spark = docs.sparkSession
    texts = docs.select("key", "text").mapInArrow(once, "key long, text string").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    seeds = seed_matches(docs)
    contexts = context_matches(seeds)
    linked = discarded_after(materialize(chains(matches(seeds, contexts)), "chains"), seeds, contexts)
    reach = linked.withColumn("chain_start", F.col("anchors")[0] - REACH).withColumn("chain_end", F.element_at("anchors", -3) + SEED + REACH)
    found = discarded_after(materialize(stretches(reach).select(*linked.columns), "chains"), linked)
    asked = found.select("key", "begin", "end", F.lit(0).cast("long").alias("copy")).unionByName(found.select(F.col("other").alias("key"), F.col("other_begin").alias("begin"), F.col("other_end").alias("end"), "copy"))
    spans = asked.groupBy("key").agg(F.collect_set(F.struct("begin", "end", "copy")).alias("spans"))
    cuts = texts.join(spans, "key").select("key", "text", "spans").mapInArrow(cut, "key long, begin int, end int, copy long, window binary")
    windows = materialize(cuts, "windows")
    theirs = windows.select(F.col("key").alias("other"), F.col("begin").alias("other_begin"), F.col("end").alias("other_end"), "copy", "window")
    own = windows.where("copy = 0").select("key", "begin", "end", F.col("window").alias("own"))
    pairs = found.join(theirs, ["other", "other_begin", "other_end", "copy"]).join(own, ["key", "begin", "end"])
    spans = materialize(pairs.select("key", "begin", "own", "other", "other_begin", "window", "anchors").mapInArrow(aligned, SPAN_SCHEMA).distinct(), "spans")
    discard(found)
    discard(windows)
    return stretches(spans)


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.where(docs[text].isNotNull()).select(F.xxhash64(docs[text]).alias("key"), docs[text].alias("text"))


def repeated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each repeated stretch of each text, and one for each copy of a text.

    doc_id and other_id are the smallest ones with the text, and with the original of the stretch's longest chain, whose
    words are chain_start to chain_end and other_start to other_end, with so many edits; others has the doc_ids of all
    chains' originals. A copy's row has the doc_id of the first of its text as other_id, and no words.
    """
    found = passages(keyed(docs, text))
    ids = docs.where(docs[text].isNotNull()).select(F.xxhash64(docs[text]).alias("key"), F.md5(docs[text].cast("binary")).alias("sum"), docs[key].cast("long").alias("doc_id"))
    firsts = materialize(ids.groupBy("key", "sum").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "firsts")
    first = firsts.groupBy("key").agg(F.min("first").alias("first"))
    named = salted_join(found, first.select(F.col("key").alias("other"), F.col("first").alias("other_id")), "other")
    chain = ["chain_start", "chain_end", "other_id", "other_start", "other_end", "edits"]
    longest = F.max_by(F.struct(*chain), F.struct(F.col("chain_end") - F.col("chain_start"), -F.col("chain_start"), "other_id"))
    rows = named.groupBy("key", "start_word", "end_word").agg(longest.alias("c"), F.sort_array(F.collect_set("other_id")).alias("others")).join(first, "key")
    rows = rows.select(F.col("first").alias("doc_id"), "start_word", "end_word", "c.*", "others")
    copy = salted_join(ids, firsts.where("n > 1").select("key", F.col("sum").alias("first_sum"), "first"), "key").where("sum = first_sum AND NOT doc_id <=> first")
    none = F.lit(None).cast("int")
    return rows.unionByName(copy.select("doc_id", *(none.alias(c) for c in ("start_word", "end_word", "chain_start", "chain_end")), F.col("first").alias("other_id"), none.alias("other_start"), none.alias("other_end"), none.alias("edits"), F.array("first").alias("others")))


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without repeated passages: each stays in the text that has the original. A text that is nothing but repeats goes.

    Copies aren't touched, as near-duplicate operators choose which of them stays.
    """
    key, spans = unused(docs, "text_key"), unused(docs, "spans")
    # Two texts of one key can't be told apart in what is found; neither loses words.
    sums = docs.where(docs[text].isNotNull()).select(F.xxhash64(docs[text]).alias(key), F.md5(docs[text].cast("binary")).alias("sum"))
    unlike = sums.groupBy(key).agg(F.min("sum").alias("low"), F.max("sum").alias("high")).where("low <> high")
    cuts = materialize(passages(keyed(docs, text)).groupBy(F.col("key").alias(key)).agg(F.collect_set(F.struct("start_word", "end_word")).alias(spans)).join(unlike, key, "left_anti"), "cuts")
    columns = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            at = b.schema.get_field_index(text)
            held = b.column(spans).to_pylist()
            texts = [t if s is None else remove_words(t, [(x["start_word"], x["end_word"]) for x in s]) for t, s in zip(b.column(text).to_pylist(), held, strict=True)]
            left = pa.array([s is None or bool(t) for t, s in zip(texts, held, strict=True)])
            yield b.set_column(at, text, pa.array(texts, pa.string())).select(columns).filter(left)

    return salted_join(docs.withColumn(key, F.xxhash64(docs[text])), cuts, key, "left").select(*columns, spans).mapInArrow(cut, docs.schema)


def remove_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans and what stands between them; what is left is joined by a line end."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for begin, end in sorted(spans):
        if begin < len(places) and end > begin:
            a, b = places[begin][0], places[min(end, len(places)) - 1][1]
            if a > at:
                out.append(text[at:a].strip())
            at = max(at, b)
    out.append(text[at:].strip())
    return "\n".join(x for x in out if WORD.search(x))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents"))


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
ORACLES: dict[str, str] = {}
