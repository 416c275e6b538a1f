"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that no token of the vocabulary has inside it can never be merged across, so a text
may be cut there: the fragments are encoded on their own, and their ids put together. Such cuts are taken at two
levels: before a space that a word follows (no token has a space after another kind of character), and inside a
pre-token by the table of pairs. Fragments met before come from a cache of bounded size.

Texts that are null or empty have no ids and decode to the empty text. Long texts are worked on in spans.
Repeated rows and doc_ids are encoded row by row, extra columns don't matter, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sporeline.llm._bytebpe import PRE_TOKENS, ChunkCache, Vocabulary, chunk_numbers, merge_ranked, vocabulary
from sporeline.llm._shared import slices, table


class Codec:
    """Encodes and decodes as the vocabulary's own library does without truncation, padding or template."""

    def __init__(self, path: str):
        self.vocab: Vocabulary = vocabulary(path)
        self.cache = ChunkCache()

    def fragments_of(self, pre_tokens: list[bytes]) -> tuple[list[bytes], list[int]]:
        """All pre-tokens cut at their forced boundaries, and how many fragments each one has."""
        whole = b"".join(pre_tokens)
        held = np.frombuffer(whole, np.uint8).astype(np.int64)
        cut = np.ones(len(held) + 1, bool)
        cut[1:-1] = ~self.vocab.inside[held[:-1] << 8 | held[1:]]
        ends = np.cumsum([len(x) for x in pre_tokens])
        cut[ends] = True
        edges = np.flatnonzero(cut)
        counts = np.diff(np.searchsorted(edges, np.r_[0, ends]))
        edges = edges.tolist()
        return [whole[a:b] for a, b in zip(edges, edges[1:], strict=False)], counts.tolist()

    def _chunks(self, new: list[str]) -> list[bytes]:
        """The ids of each chunk, as 32-bit words: fragments are encoded once each, then put together."""
        cut = [PRE_TOKENS.findall(x) for x in new]
        fragments, counts = self.fragments_of([p.encode() for x in cut for p in x])
        known = list(dict.fromkeys(fragments))
        codes = dict(zip(known, (x.astype("<u4").tobytes() for x in merge_ranked(self.vocab, known)), strict=True))
        coded, sizes, out, at = list(map(codes.__getitem__, fragments)), iter(counts), [], 0
        for x in cut:
            n = sum(next(sizes) for _ in x)
            out.append(coded[at] if n == 1 else b"".join(coded[at : at + n]))
            at += n
        return out

    def coded(self, texts: list[str | None]) -> Iterator[Iterator[list[int]]]:
        """For each text its ids, in runs of bounded length."""
        for x in chunk_numbers(texts, self.vocab, self.cache, self._chunks):
            yield ([s] if s is not None else np.frombuffer(b"".join(self.cache.values(c)), "<u4").tolist() for s, c in x)

    def encode(self, text: str | None) -> list[int]:
        return [i for run in next(iter(self.coded([text]))) for i in run]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


CODE_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids, and the text that the ids decode to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for b in slices(batches, "text"):
            ids = [[i for run in runs for i in run] for runs in codec.coded(b.column("text").to_pylist())]
            yield pa.record_batch([b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.string())], names=CODE_SCHEMA.names)

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(work, CODE_SCHEMA)


def code_digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of the text that they decode to; neither is ever whole in memory."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        decimals = [str(i) for i in range(codec.vocab.size)]
        for b in slices(batches, "text"):
            counts, hashes, decoded = [], [], []
            for runs in codec.coded(b.column("text").to_pylist()):
                n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
                for ids in runs:
                    if ids:
                        ids_hash.update((("," if n else "") + ",".join(map(decimals.__getitem__, ids))).encode())
                        text_hash.update(codec.decode(ids).encode())
                        n += len(ids)
                counts.append(n)
                hashes.append(ids_hash.hexdigest())
                decoded.append(text_hash.hexdigest())
            yield pa.record_batch([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(work, DIGEST_SCHEMA)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return code_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op4_bpe_codec": op4_bpe_codec}
ORACLES: dict[str, str] = {}
