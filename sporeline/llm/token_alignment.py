"""Alignment of two tokenizers by a dictionary of groups.

Tokens of a byte-level BPE vocabulary (A) and of a sentencepiece model (B) cover the same bytes. Where tokens of both end, the text
is cut into groups, each of some A ids and some B ids; an A and a B token whose bytes overlap are linked. Few groups are
distinct: a worker interns them, and Spark keeps a dictionary of them, in which each one's links are expanded once for the
whole corpus, and multiplied by the number of documents that hold each linked pair. Results go back to documents by group.

Documents are worked on in blocks of about BLOCK_BYTES of text, in one row each: a block has its own list of distinct groups, and
its documents speak of groups by their places in that list. Blocks are stored before anything is counted, so that a lost
executor's work is done again from the same blocks.

Texts that are null or empty, or that either tokenizer doesn't give back byte for byte after a space, have no tokens.
Special strings inside texts are plain text. Long texts are a block of their own. Rows are aligned one by one, whatever their
doc_id; each counts as a document. Extra columns don't matter, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sporeline.llm._bytebpe import PRE_TOKENS, merge_ranked, vocabulary
from sporeline.llm._shared import materialize, slices, table

#: UTF-8 bytes of text in a block, one document at least.
BLOCK_BYTES = 4 << 20
#: Characters of distinct chunks that a worker keeps aligned.
CACHED = 12_000_000

#: Both tokenizers cut before a space between two characters that aren't spaces, the second of which isn't white space.
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
ODD = re.compile(r" (?:\s|\Z)")
#: Strings that a model with any normalisation would change.
PROBES = ("ﬁ Å Ａ ① ㈱", "a  b", " a ", "a\tb\nc", "Á ä", "x y​z", "　q", "İß")


class Pieces:
    """A sentencepiece model: encodes with a space before the text, and gives each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        plain = [p for i, p in enumerate(names) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        #: Whether texts may be cut at CUT: no piece goes on after a space behind another character, and texts stay as they are.
        self.cuts = not any("▁" in p.lstrip("▁") for p in plain) and all(b"".join(self.bytes_of[i] for i in x) == b" " + s.encode() for s, x in zip(PROBES, self.encode(list(PROBES)), strict=True))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def overlaps(a: list[int], b: list[int], a_size, b_size) -> list[tuple[int, int]]:
    """The linked pairs of a group, repeats included: tokens lie end to end, and pairs that share a byte are linked."""
    out, i, j = [], 0, 0
    a_end, b_end = a_size(a[0]), b_size(b[0])
    while True:
        out.append((a[i], b[j]))
        if a_end <= b_end:
            i += 1
            if a_end == b_end:
                j += 1
        else:
            j += 1
        if i == len(a) or j == len(b):
            return out
        a_end, b_end = (a_end + a_size(a[i]) if a_end <= b_end else a_end), (b_end + b_size(b[j]) if b_end <= a_end else b_end)


def group_key(a: list[int], b: list[int]) -> bytes:
    """A group as 32-bit words: how many A ids, those, and the B ids."""
    return np.array([len(a), *a, *b], "<u4").tobytes()


def group_ids(key: bytes) -> tuple[list[int], list[int]]:
    words = np.frombuffer(key, "<u4").tolist()
    return words[1 : words[0] + 1], words[words[0] + 1 :]


class Aligner:
    """Chunks met before are kept with their groups; groups are numbered, and each one's links are expanded once."""

    def __init__(self, path_a: str, path_b: str):
        self.vocab, self.pieces = vocabulary(path_a), Pieces(path_b)
        self.a_sizes = np.array([len(x) for x in self.vocab.bytes_of])
        self.b_sizes = np.array([len(x) for x in self.pieces.bytes_of])
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.new: list[str] = []
        self.held = 0
        self.bad: set[int] = set()
        self.chunk_text: list[str] = []
        self.chunk_groups, self.chunk_at = array("I"), array("q", [0])
        self.chunk_sizes = [array("q") for _ in range(3)]  # A ids, B ids, links
        self.group: dict[bytes, int] = {}
        self.group_text: list[str] = []
        self.group_links: list[int] = []
        self.links, self.link_at = array("Q"), array("q", [0])

    def _group(self, key: bytes) -> int:
        n = self.group.get(key)
        if n is None:
            n = self.group[key] = len(self.group)
            a, b = group_ids(key)
            self.group_text.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
            pairs = [x << 32 | y for x, y in overlaps(a, b, self.a_sizes.item, self.b_sizes.item)]
            self.group_links.append(len(pairs))
            self.links.extend(sorted(set(pairs)))
            self.link_at.append(len(self.links))
        return n

    def _groups(self, a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> np.ndarray:
        """The numbers of groups a[a_at[i]:a_at[i + 1]] | b[b_at[i]:b_at[i + 1]]: those of one shape are told apart together."""
        n_a, n_b = np.diff(a_at), np.diff(b_at)
        out = np.zeros(len(n_a), np.int64)
        shapes, of = np.unique(n_a << 32 | n_b, return_inverse=True)
        by = np.argsort(of, kind="stable")
        for shape, at in zip(shapes.tolist(), np.split(by, np.cumsum(np.bincount(of))[:-1]), strict=True):
            na, nb = shape >> 32, shape & 0xFFFFFFFF
            rows = np.empty((len(at), 1 + na + nb), "<u4")
            rows[:, 0] = na
            rows[:, 1 : 1 + na] = a[a_at[at][:, None] + np.arange(na)]
            rows[:, 1 + na :] = b[b_at[at][:, None] + np.arange(nb)]
            if na == nb == 1:
                known, inverse = np.unique(rows[:, 1].astype(np.int64) << 32 | rows[:, 2], return_inverse=True)
                keys = [group_key([x >> 32], [x & 0xFFFFFFFF]) for x in known.tolist()]
            else:
                known, inverse = np.unique(rows.view(f"V{rows.itemsize * rows.shape[1]}").ravel(), return_inverse=True)
                keys = [x.tobytes() for x in known]
            out[at] = np.fromiter(map(self._group, keys), np.int64, len(keys))[inverse]
        return out

    def _learn(self) -> None:
        """Align the chunks in new, which are texts without the space before them, all at once."""
        new, self.new = self.new, []
        if not new:
            return
        cut = [PRE_TOKENS.findall(" " + x) for x in new]
        order: dict[str, int] = {}
        places = np.fromiter((order.setdefault(p, len(order)) for x in cut for p in x), np.int64)
        coded = merge_ranked(self.vocab, [p.encode() for p in order])
        coded_at = np.r_[0, np.cumsum([len(x) for x in coded])]
        a, per = _gathered(np.concatenate(coded), coded_at, places)
        n_a = np.diff(np.r_[0, np.cumsum(per)][np.r_[0, np.cumsum([len(x) for x in cut])]])
        lists = self.pieces.encode(new)
        n_b = np.array([len(x) for x in lists])
        b = np.fromiter((i for x in lists for i in x), np.int64, int(n_b.sum()))
        want = [b" " + x.encode() for x in new]
        sizes = np.array([len(x) for x in want])
        bad = np.zeros(len(new), bool)
        for ids, n, of, token_sizes in ((a, n_a, self.vocab.bytes_of, self.a_sizes), (b, n_b, self.pieces.bytes_of, self.b_sizes)):
            ends = np.r_[0, np.cumsum(n)]
            if b"".join(map(of.__getitem__, ids.tolist())) != b"".join(want) or (np.diff(np.r_[0, np.cumsum(token_sizes[ids])][ends]) != sizes).any() or not token_sizes[ids].all():
                for i, x in enumerate(want):
                    held = ids[ends[i] : ends[i + 1]]
                    bad[i] |= b"".join(map(of.__getitem__, held.tolist())) != x or not token_sizes[held].all()
        if bad.any():
            self.bad.update((len(self.chunk_text) + np.flatnonzero(bad)).tolist())
            a, b = a[np.repeat(~bad, n_a)], b[np.repeat(~bad, n_b)]
            n_a, n_b, sizes = (np.where(bad, 0, x) for x in (n_a, n_b, sizes))
        a_ends, b_ends, chunk_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]), np.cumsum(sizes)
        ended = np.zeros(int(sizes.sum()) + 1, bool)
        ended[a_ends] = True
        both = b_ends[ended[b_ends]]
        groups = self._groups(a, b, np.r_[0, np.searchsorted(a_ends, both) + 1], np.r_[0, np.searchsorted(b_ends, both) + 1])
        at = np.r_[0, np.searchsorted(both, chunk_ends, "right")]
        links = np.diff(np.r_[0, np.cumsum(np.array(self.group_links, np.int64)[groups])][at])
        names, edges = list(map(self.group_text.__getitem__, groups.tolist())), at.tolist()
        texts = [";".join(names[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
        self.held += sum(map(len, new)) + sum(map(len, texts)) + 40 * len(new)
        self.chunk_text.extend(texts)
        self.chunk_at.frombytes((at[1:] + len(self.chunk_groups)).astype(np.int64).tobytes())
        self.chunk_groups.frombytes(groups.astype(np.uint32).tobytes())
        for kind, n in zip(self.chunk_sizes, (n_a, n_b, links), strict=True):
            kind.frombytes(n.astype(np.int64).tobytes())

    def chunks(self, text: str | None) -> list[int]:
        """The numbers of a text's chunks; those that are new wait to be learned."""
        if not text:
            return []
        if not self.pieces.cuts:
            parts = [text]
        else:
            parts = CUT.split(text) if text[0] == " " or ODD.search(text) else text.split(" ")
        out, number = [], self.number
        for p in parts:
            n = number.get(p)
            if n is None:
                n = number[p] = len(self.chunk_text) + len(self.new)
                self.new.append(p)
            out.append(n)
        return out


def _gathered(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[at[r]:at[r + 1]] of all rows, end to end, and each run's length."""
    begin, size = at[rows], at[rows + 1] - at[rows]
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - begin, size)], size


_LISTS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_held", "held", "times", "keys", "a", "b", "df")
BLOCK_SCHEMA = "block long, " + ", ".join(f"{c} array<{t}>" for c, t in zip(_LISTS, ("bigint", "bigint", "bigint", "bigint", "bigint", "string", "int", "int", "int", "binary", "int", "int", "bigint"), strict=True))
_TYPES = dict(zip(_LISTS, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64()), strict=True))


class _Block:
    """Documents whose chunks are known, until they are handed on as one row."""

    def __init__(self):
        self.ids, self.chunks, self.bytes = [], [], 0

    def row(self, number: int, of: Aligner) -> pa.RecordBatch:
        docs = [c if not (of.bad and of.bad.intersection(c)) else [] for c in self.chunks]
        sha = []
        for c in docs:
            h = hashlib.sha256()
            for at in range(0, len(c), 1 << 16):
                h.update(((";" if at else "") + ";".join(map(of.chunk_text.__getitem__, c[at : at + (1 << 16)]))).encode())
            sha.append(h.hexdigest() if c else "")
        n_chunks = np.array([len(c) for c in docs])
        flat = np.fromiter((x for c in docs for x in c), np.int64, int(n_chunks.sum()))
        doc_of = np.repeat(np.arange(len(docs)), n_chunks)
        sums = [np.bincount(doc_of, np.array(kind)[flat], len(docs)).astype(np.int64) for kind in of.chunk_sizes]
        groups, sizes = _gathered(np.array(of.chunk_groups, np.int64), np.array(of.chunk_at), flat)
        n_groups = np.bincount(doc_of, sizes, len(docs)).astype(np.int64)
        # Each document's distinct groups, and how often it has them.
        found, times = np.unique(np.repeat(doc_of, sizes) << 32 | groups, return_counts=True)
        doc, group = found >> 32, found & 0xFFFFFFFF
        known, held = np.unique(group, return_inverse=True)
        # How many documents hold each linked pair, however many of their groups link it.
        pairs, per = _gathered(np.array(of.links), np.array(of.link_at), group)
        names, code = np.unique(pairs, return_inverse=True)
        df = np.bincount(np.unique(np.repeat(doc, per) << 32 | code) & 0xFFFFFFFF, minlength=len(names))
        keys = list(of.group)  # in order of their numbers
        values = (self.ids, sums[0], sums[1], n_groups, sums[2], sha, np.bincount(doc, minlength=len(docs)), held, times, [keys[g] for g in known.tolist()], names >> np.uint64(32), names & np.uint64(0xFFFFFFFF), df)
        lists = []
        for name, v in zip(_LISTS, values, strict=True):
            flat_v = pa.array(v if isinstance(v, list) else v.astype(_TYPES[name].to_pandas_dtype()), _TYPES[name])
            lists.append(pa.ListArray.from_arrays(pa.array([0, len(flat_v)], pa.int32()), flat_v))
        return pa.record_batch([pa.array([number], pa.int64()), *lists], names=["block", *_LISTS])


def blocks(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A stored table with a row for each block of documents: see the columns in BLOCK_SCHEMA."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        of, block, number = Aligner(path_a, path_b), _Block(), TaskContext.get().partitionId() << 32
        for b in slices(batches, "text"):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                block.ids.append(i)
                block.chunks.append(of.chunks(t))
                block.bytes += len(t or "")
            of._learn()
            if block.bytes >= BLOCK_BYTES:
                yield block.row(number, of)
                block, number = _Block(), number + 1
                if of.held > CACHED:
                    of.clear()
        if block.ids:
            yield block.row(number, of)

    return materialize(docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(work, BLOCK_SCHEMA), "blocks")


def pair_counts(held: DataFrame) -> DataFrame:
    """a, b, n_docs, best: in how many documents two ids are linked, and whether no other B id has more with this A id."""
    pairs = held.select(F.explode(F.arrays_zip("a", "b", "df")).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.df").alias("n_docs"))
    top = pairs.groupBy(F.col("a").alias("of")).agg(F.max("n_docs").alias("most"))  # a row for each id of A's vocabulary at most
    return pairs.join(top, F.col("a") == F.col("of")).select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def group_values(held: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """key, n_best, count_sum for each distinct group: its links that are best, and the sum of its links' counts."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Aligner(path_a, path_b)
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                out: list[list] = [[], [], [], []]
                for key in batch.column("key").slice(begin, 4096).to_pylist():
                    links: dict[tuple[int, int], int] = {}
                    for pair in overlaps(*group_ids(key), of.a_sizes.item, of.b_sizes.item):
                        links[pair] = links.get(pair, 0) + 1
                    for (a, b), n in links.items():
                        for column, x in zip(out, (key, a, b, n), strict=True):
                            column.append(x)
                yield pa.record_batch([pa.array(out[0], pa.binary()), *(pa.array(x, pa.int32()) for x in out[1:3]), pa.array(out[3], pa.int64())], names=["key", "a", "b", "times"])

    distinct = held.select(F.explode("keys").alias("key")).distinct()
    links = distinct.mapInArrow(expand, "key binary, a int, b int, times long")
    return links.join(pair_counts(held), ["a", "b"]).groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))


ROW_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of a block, from the values of the block's groups."""
    for batch in batches:
        for i in range(batch.num_rows):
            column = lambda name: batch.column(name).slice(i, 1).flatten()  # noqa: B023, E731
            values = column("found")
            place = np.zeros(len(values), np.int64) if not len(values) else values.field("at").to_numpy()
            of = np.zeros((2, int(place.max()) + 1 if len(place) else 1), np.int64)
            if len(place):
                of[0, place], of[1, place] = values.field("n_best").to_numpy(), values.field("count_sum").to_numpy()
            n_held, held, times = (column(c).to_numpy().astype(np.int64) for c in ("n_held", "held", "times"))
            ends = np.r_[0, np.cumsum(n_held)]
            sums = [np.diff(np.r_[0, np.cumsum(x[held] * times)][ends]) for x in of]
            yield pa.record_batch([*(column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *(pa.array(x) for x in sums), column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each document: how many tokens, groups and links it has, how many links are the best of their A id, and the sum of its links' counts."""
    held = blocks(docs, path_a, path_b, text, key)
    places = held.select("block", F.posexplode("keys").alias("at", "key"))
    # A block has as many values as it has distinct groups, which BLOCK_BYTES bounds.
    back = places.join(group_values(held, path_a, path_b), "key").groupBy("block").agg(F.collect_list(F.struct("at", "n_best", "count_sum")).alias("found"))
    rows = held.select("block", *_LISTS[:9]).join(back, "block", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<at:int,n_best:bigint,count_sum:bigint>>")))
    return rows.mapInArrow(_rows, ROW_SCHEMA)


def links(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """a, b, n_docs, best: the table of linked ids itself, for moving embeddings from one vocabulary to the other."""
    return pair_counts(blocks(docs, path_a, path_b, text, key))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op12_token_alignment": op12_token_alignment}
ORACLES: dict[str, str] = {}
