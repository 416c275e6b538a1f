"""Token ids in binary files: word-aligned Simple-8b blocks, written in doc_id order and read back.

Word format. A 64-bit word has a 4-bit selector at the top and, below it, equally wide ids, the first one lowest.
Selectors 0 to 13 stand for 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 and 1 ids of 1, 2, 3, 4, 5, 6, 7, 8, 10,
12, 15, 20, 30 and 60 bits. Selector 15 is the escape: the next word is one id of 64 bits. Each word takes as many of
the document's next ids as fit. A document starts at a word of its own; what its last word has beyond its ids is zero.

File format. A store is a folder of Parquet files, file k (column part) with the ids of the k-th range of doc_ids.
A row is a block of whole documents: block, first_id (ids of the part before it), doc_ids, n_ids, word_offsets (each
document's first word), and words (little-endian). Blocks are decoded on their own, all words of a selector at once.

Documents come in ascending doc_id order, nulls first; equal doc_ids in the order of a hash of their ids. Null and
empty texts have only the end id. Extra columns don't matter; an empty table gives an empty store and result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sporeline.llm import _bytebpe
from sporeline.llm._bytebpe import parts, vocabulary
from sporeline.llm._shared import new_path, slices, table

# Ids in a word and bits of each, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
#: The first selector that fits each id of up to 17 bits.
NARROWEST = np.searchsorted(1 << WIDTHS, np.arange(1 << 17), side="right").astype(np.int8)
#: Ids from which a block is full, and bytes from which a task hands on blocks.
BLOCK_IDS = 1 << 17
#: UTF-8 bytes of text whose distinct chunks a task names at once.
NAMED_BYTES = 1 << 23
#: Chunks whose ids are put together at once, and ids that are coded at once, if no text has more.
GATHERED = 1 << 16
CODED_IDS = 1 << 18
#: Chunks that the library encodes in one text.
RUN = 256
#: Bytes that a worker's cache of chunks holds.
CACHED = 40_000_000
#: White space in UTF-8: single bytes, first bytes of more, and these characters' bytes as numbers.
SPACES = [chr(c).encode() for c in range(1 << 16) if chr(c).isspace()]
WHITE, WIDE_WHITE = np.zeros(256, bool), np.zeros(256, bool)
WHITE[[x[0] for x in SPACES if len(x) == 1]] = True
WIDE_WHITE[[x[0] for x in SPACES if len(x) > 1]] = True
WHITE_CODES = np.array([int.from_bytes(x) for x in SPACES if len(x) > 1])


def _narrowest(ids: np.ndarray) -> np.ndarray:
    """The first selector that each id fits; ESCAPE - 1 where none does."""
    if ids.max(initial=0) < len(NARROWEST):
        return NARROWEST[ids]
    return np.searchsorted(np.uint64(1) << WIDTHS.astype(np.uint64), ids, side="right").astype(np.int8)


def _steps(fits_below: np.ndarray) -> np.ndarray:
    """For each id the first selector whose count of ids, from this one on, all fit; ESCAPE where one doesn't fit alone."""
    out = np.full(len(fits_below), ESCAPE, np.int8)
    for s in range(len(COUNTS) - 1, -1, -1):
        n, ok, have = int(COUNTS[s]), fits_below <= s, 1
        while have < n and ok.any():
            step = min(have, n - have)
            ok = ok & np.r_[ok[step:], np.zeros(step, bool)]
            have += step
        out[ok] = s
    return out


def encode_blocks(documents: list[np.ndarray]) -> list[np.ndarray]:
    """The words of each document's ids."""
    pad = int(COUNTS[0])
    sizes = np.array([len(d) for d in documents], np.int64)
    starts = np.r_[0, np.cumsum(sizes + pad)]
    ids = np.zeros(starts[-1], np.uint64)
    for d, at in zip(documents, starts.tolist(), strict=False):
        ids[at : at + len(d)] = d
    narrow = ids.max(initial=0) < 1 << 60
    selector = _steps(_narrowest(ids))
    step = np.r_[COUNTS, 1, 1].astype(np.uint8)[selector].tobytes()
    taken: list[int] = []
    words_of = []
    for at, n in zip(starts.tolist(), sizes.tolist(), strict=False):
        end, before = at + n, len(taken)
        while at < end:
            taken.append(at)
            at += step[at]
        words_of.append(len(taken) - before)
    at = np.array(taken, np.int64)
    s = selector[at].astype(np.int64)
    words = np.zeros(len(at), np.uint64)
    for k in np.unique(s).tolist():
        of = s == k
        first, word = at[of], np.full(int(of.sum()), k << 60, np.uint64)
        if k != ESCAPE:
            for j in range(int(COUNTS[k])):
                word |= ids[first + j] << np.uint64(j * int(WIDTHS[k]))
        words[of] = word
    if not narrow:  # the raw word follows its escape
        escaped = s == ESCAPE
        words = np.insert(words, np.flatnonzero(escaped) + 1, ids[at[escaped]])
        owner = np.repeat(np.arange(len(documents)), words_of)
        words_of = (np.array(words_of) + np.bincount(owner[escaped], minlength=len(documents))).tolist()
    return np.split(words, np.cumsum(words_of)[:-1]) if documents else []


def decode_block(words: np.ndarray, word_offsets: np.ndarray, n_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block's documents end to end, and where each one starts."""
    ends = np.r_[0, np.cumsum(n_ids)]
    s = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (s == ESCAPE).any():  # a raw word's top bits may look like a selector: go along the words that follow escapes
        after = False
        for k in np.flatnonzero(s == ESCAPE).tolist():
            after = not (k and raw[k])
            if after and k + 1 < len(words):
                raw[k + 1] = True
        s[raw] = -1
    counts = np.where(raw, 1, np.where(s == ESCAPE, 0, np.r_[COUNTS, 0, 0][s]))
    place = np.r_[0, np.cumsum(counts)]
    ids = np.zeros(place[-1], np.uint64)
    ids[place[:-1][raw]] = words[raw]
    for k in range(len(COUNTS)):
        of = np.flatnonzero(s == k)
        if len(of):
            shifts = np.arange(COUNTS[k], dtype=np.uint64) * np.uint64(WIDTHS[k])
            ids[place[of][:, None] + np.arange(COUNTS[k])] = (words[of][:, None] >> shifts) & np.uint64((1 << int(WIDTHS[k])) - 1)
    first = place[word_offsets]
    keep = np.repeat(first - ends[:-1], n_ids) + np.arange(ends[-1])
    return ids[keep], ends[:-1]


def cut_places(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the chunks of texts that lie end to end begin: at each text that isn't empty, and at each space before a character that isn't white space."""
    first = np.zeros(len(data) + 4, bool)
    first[offsets] = True
    spaces = np.flatnonzero(data == 32)
    spaces = spaces[~first[spaces + 1]]
    after = data[spaces + 1]
    cut = ~WHITE[after]
    wide = np.flatnonzero(WIDE_WHITE[after])  # few characters but these begin like white space of more bytes
    if len(wide):
        code = np.zeros(len(wide), np.int64)
        for j in range(1, 4):
            code = code << 8 | data[np.minimum(spaces[wide] + j, len(data) - 1)]
        cut[wide] = ~(np.isin(code >> 8, WHITE_CODES) | np.isin(code, WHITE_CODES))
    first[spaces[cut]] = True
    return np.flatnonzero(first[: len(data)])


class ChunkIds:
    """Chunks by name (the leading space is part of it), and their ids, end to end in one array; those of number k end at ends[k + 1].

    Names lie in an Arrow array, which takes a fraction of what Python's strings and dictionaries would; number[i] is the i-th name's,
    used[i] how many columns have had it (2: or more).
    """

    def __init__(self, library, spaced: np.ndarray):
        self.library, self.spaced = library, spaced
        self.clear()

    def clear(self) -> None:
        self.names, self.number, self.used = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.ids, self.ends = array("I"), array("q", [0])

    @property
    def held(self) -> int:
        """Bytes of names and ids."""
        return self.names.nbytes + self.number.nbytes + self.used.nbytes + 4 * len(self.ids) + 8 * len(self.ends)

    def shrink(self, most: int) -> None:
        """Forgets the chunks that only one column had (of those kept before: none since then), or all if the others take over half of most bytes."""
        keep = self.used > 1
        names, number = self.names.filter(pa.array(keep)), self.number[keep]
        ids, ends = self.gather(number)
        self.clear()
        self._learn(ids, ends)
        self.names, self.number, self.used = names, np.arange(len(names), dtype=np.int32), np.ones(len(names), np.uint8)
        if 2 * self.held > most:
            self.clear()

    def _learn(self, ids: np.ndarray, ends: np.ndarray) -> None:
        self.ends.frombytes((self.ends[-1] + ends.astype(np.int64)).tobytes())
        self.ids.frombytes(ids.tobytes())

    def _one_by_one(self, new: list[str], lead: str) -> None:
        if new:
            ids = [np.array(e.ids, "<u4") for e in self.library([lead + x for x in new])]
            self._learn(np.concatenate(ids), np.cumsum([len(x) for x in ids]))

    def numbers_alone(self, new: list[str]) -> np.ndarray:
        """Learns chunks that weren't met before, as they are."""
        begin = len(self.ends) - 1
        self._one_by_one(new, "")
        return np.arange(begin, begin + len(new))

    def numbers_after(self, new: list[str]) -> np.ndarray:
        """Learns chunks that a space stands before, which isn't given.

        Those with no other space are encoded RUN at a time, end to end: the library cuts before each, and only its first token begins with a space.
        """
        begin, numbers = len(self.ends) - 1, np.zeros(len(new), np.int64)
        odd = np.array([" " in x for x in new], bool)
        plain = list(compress(new, (~odd).tolist()))
        if plain:
            runs = self.library([" " + " ".join(plain[k : k + RUN]) for k in range(0, len(plain), RUN)])
            ids = np.concatenate([np.array(e.ids, "<u4") for e in runs])
            self._learn(ids, np.r_[np.flatnonzero(self.spaced[ids])[1:], len(ids)])
        self._one_by_one(list(compress(new, odd.tolist())), " ")
        numbers[~odd] = np.arange(begin, begin + len(plain))
        numbers[odd] = np.arange(begin + len(plain), begin + len(new))
        return numbers

    def _numbers_of_new(self, new: pa.Array) -> np.ndarray:
        """Learns these chunks. Most are one space and a word, so that their bytes, which lie end to end, are cut into words in one go."""
        offsets = np.frombuffer(new.buffers()[1], np.int32)[new.offset : new.offset + len(new) + 1]
        data = np.frombuffer(new.buffers()[2] or b"\0", np.uint8)
        second = data[np.minimum(offsets[:-1] + 1, len(data) - 1)]
        word = (np.diff(offsets) > 1) & ~WHITE[second] & ~WIDE_WHITE[second] & pc.starts_with(new, " ").to_numpy(zero_copy_only=False)
        word &= pc.count_substring(new, " ").to_numpy() == 1
        after = data[offsets[0] : offsets[-1]][np.repeat(word, np.diff(offsets))].tobytes().decode().split(" ")[1:]
        rest = new.filter(pa.array(~word)).to_pylist()
        spaced = np.array([x[:1] == " " and bool(x[1:2].strip()) for x in rest], bool)
        number = np.zeros(len(new), np.int32)
        at = np.flatnonzero(~word)
        number[np.r_[np.flatnonzero(word), at[spaced]]] = self.numbers_after(after + [x[1:] for x in compress(rest, spaced.tolist())])
        number[at[~spaced]] = self.numbers_alone(list(compress(rest, (~spaced).tolist())))
        return number

    def numbers(self, chunks: pa.Array) -> np.ndarray:
        """The number of each chunk: Arrow names the chunks after those that are known, and only what is new becomes Python's strings."""
        if not len(chunks):
            return np.zeros(0, np.int32)
        known = len(self.names)
        named = pa.chunked_array([self.names, chunks]).dictionary_encode().chunks[-1]
        if len(named.dictionary) > known:
            self.names, self.number = named.dictionary, np.concatenate([self.number, self._numbers_of_new(named.dictionary[known:])])
            self.used = np.append(self.used, np.zeros(len(self.names) - known, np.uint8))
        indices = named.indices.to_numpy()
        seen = np.zeros(len(self.names), np.uint8)
        seen[indices] = 1
        self.used = np.minimum(self.used + seen, 2)
        return self.number[indices]

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks with these numbers end to end, and where each one's end."""
        ends = np.asarray(self.ends)
        begins = ends[numbers]
        sizes = ends[numbers + 1] - begins
        placed = np.cumsum(sizes)
        at = np.repeat(begins - placed + sizes, sizes)
        at += np.arange(len(at))
        return np.asarray(self.ids)[at], placed


class LibraryEncoder:
    """Ids by the tokenizers library.

    With a plain byte-level BPE vocabulary, which cuts before each word anyway, the library gets each distinct chunk
    once, and a bounded cache keeps its ids. The chunks of a column of texts are an Arrow array over the column's own bytes;
    texts with special strings and very long ones are cut one by one.
    With any other vocabulary the library gets whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        try:
            self.vocab = vocabulary(path)
        except ValueError:
            self.vocab = None
        if self.vocab is not None:
            self.strings = {i: x for x, i in self.vocab.special.items()}
            self.cache = ChunkIds(self._library, np.array([x[:1] == b" " for x in self.vocab.bytes_of]))

    def _library(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _cut(self, text: str) -> pa.Array:
        """A text's chunks, whatever it has."""
        cut = [[self.strings[s]] if s is not None else c for s, c in parts(text, self.vocab)]
        return pa.array([x for first, *rest in cut for x in (first, *(" " + c for c in rest))], pa.string())

    def _chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All texts' chunks end to end, and how many each text has."""
        texts = pc.fill_null(texts, "")
        apart = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 2 * _bytebpe.SPAN
        for x in self.vocab.special:
            apart |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(~apart), texts, "") if apart.any() else texts
        offsets = np.frombuffer(plain.buffers()[1], np.int32)[plain.offset : plain.offset + len(plain) + 1]
        data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        places = cut_places(data, offsets)
        chunks = pa.StringArray.from_buffers(len(places), pa.py_buffer(np.append(places, len(data)).astype(np.int32)), pa.py_buffer(data))
        ends = np.searchsorted(places, offsets)
        sizes = np.diff(ends)
        if apart.any():
            found, begin = [], 0
            for k in np.flatnonzero(apart).tolist():
                found += [chunks[begin : ends[k]], self._cut(texts[k].as_py())]
                begin, sizes[k] = ends[k], len(found[-1])
            chunks = pa.concat_arrays([*found, chunks[begin:]])
        return chunks, sizes

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.vocab is None:
            whole = texts.to_pylist() if isinstance(texts, pa.Array) else texts
            return [np.array(e.ids, "<u4") for e in self._library([t or "" for t in whole])]
        if not len(texts):
            return []
        if self.cache.held > CACHED:
            self.cache.shrink(CACHED)
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        chunks, sizes = self._chunks(texts if texts.type == pa.string() else texts.cast(pa.string()))
        numbers, ends, out, begin = self.cache.numbers(chunks), np.cumsum(sizes), [], 0
        while begin < len(ends):  # some texts at a time, so that what is made for each id stays small
            first = int(ends[begin] - sizes[begin])
            stop = max(begin + 1, int(np.searchsorted(ends, first + GATHERED, side="right")))
            ids, placed = self.cache.gather(numbers[first : ends[stop - 1]])
            out += np.split(ids, np.r_[0, placed][ends[begin : stop - 1] - first])
            begin = stop
        return out


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def doc_bounds(docs: DataFrame, key: str, n: int) -> list[int]:
    """Doc_ids that part the documents in n ranges of about as many rows."""
    shares = [k / n for k in range(1, n)]
    bounds = docs.agg(F.percentile_approx(key, shares, 10_000).alias("b")).first().b if shares else []
    return sorted(set(bounds or []))


BLOCK_SCHEMA = "part int, block long, first_id long, doc_ids array<long>, n_ids array<long>, word_offsets array<long>, words binary"


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, text: str = "text", key: str = "doc_id") -> None:
    """Encode every whole text and write the ids in doc_id order. Texts are never shuffled, only coded ids."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    bounds = np.array(doc_bounds(taken, "doc_id", n), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        for b in slices(batches, "text", NAMED_BYTES):
            encoded = encoder.encode(b.column("text"))
            group = np.cumsum([len(x) + 1 for x in encoded]) // CODED_IDS
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(encoded)]
            for begin, end in pairwise(cuts):
                ids = [np.append(x, np.uint32(end_id)).astype("<u4", copy=False) for x in encoded[begin:end]]
                keys = b.column("doc_id")[begin:end]
                part = np.searchsorted(bounds, keys.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="left")
                hashes = [zlib.crc32(x) for x in ids]
                words = [w.tobytes() for w in encode_blocks(ids)]
                yield pa.record_batch([pa.array(part, pa.int32()), keys, pa.array(hashes, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(words, pa.binary())], names=["part", "doc_id", "hash", "n_ids", "words"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, block, first = [], 0, 0, 0

        def row() -> pa.RecordBatch:
            offsets = np.r_[0, np.cumsum([len(w) // 8 for *_, w in held])][:-1]
            one = [held[0][0], block, first, [x[1] for x in held], [x[2] for x in held], offsets.tolist(), b"".join(x[3] for x in held)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            return pa.record_batch([pa.array([x], k) for x, k in zip(one, kinds, strict=True)], names=["part", "block", "first_id", "doc_ids", "n_ids", "word_offsets", "words"])

        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "n_ids", "words")), strict=True):
                if held and (n_held + x[2] > BLOCK_IDS or x[0] != held[0][0]):
                    yield row()
                    block, first = (block + 1, first + n_held) if x[0] == held[0][0] else (0, 0)
                    held, n_held = [], 0
                held.append(x)
                n_held += x[2]
        if held:
            yield row()

    coded = taken.mapInArrow(encode, "part int, doc_id long, hash long, n_ids long, words binary")
    ordered = coded.repartitionById(n, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "hash", "n_ids")
    ordered.select("part", "doc_id", "n_ids", "words").mapInArrow(pack, BLOCK_SCHEMA).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def with_starts(blocks: DataFrame) -> DataFrame:
    """start: the ids of all parts and blocks before a block.

    One row a part is all that is gathered and sent to the tasks; there are as many parts as shuffle partitions.
    """
    totals = blocks.groupBy("part").agg(F.sum(F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.join(F.broadcast(totals.select("part", before.alias("_before"))), "part").withColumn("start", F.col("_before") + F.col("first_id"))


DIGEST_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def store_digests(spark: SparkSession, path: str) -> DataFrame:
    """Each document's place in the store and the crc32 of its ids, from the files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, docs, n, offsets, words in zip(*(b.column(c).to_pylist() for c in ("start", "doc_ids", "n_ids", "word_offsets", "words")), strict=True):
                ids, at = decode_block(np.frombuffer(words, "<u8"), np.array(offsets, np.int64), np.array(n, np.int64))
                whole = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(whole[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), n, strict=True)]
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(at + start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return with_starts(read_store(spark, path)).select("start", "doc_ids", "n_ids", "word_offsets", "words").mapInArrow(work, DIGEST_SCHEMA)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and its ids, decoded from the files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, n, offsets, words in zip(*(b.column(c).to_pylist() for c in ("doc_ids", "n_ids", "word_offsets", "words")), strict=True):
                ids, at = decode_block(np.frombuffer(words, "<u8"), np.array(offsets, np.int64), np.array(n, np.int64))
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array([ids[a : a + k].astype(np.int64) for a, k in zip(at.tolist(), n, strict=True)], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return read_store(spark, path).select("doc_ids", "n_ids", "word_offsets", "words").mapInArrow(work, "doc_id long, ids array<long>")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-store-" + re.sub(r"\W+", "-", sf_dir.rsplit("/", 1)[-1]))
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return store_digests(spark, path)


QUERIES = {"op1_token_store": op1_token_store}
ORACLES: dict[str, str] = {}
