"""Token counts by rank-synchronous merging of arrays.

Pre-tokens not met before are held as one ragged array, all merged together (_bytebpe.merge_ranked), and the
symbols that survive are counted. A text's count is the sum over its chunks, whose counts a bounded cache keeps.

Null and empty texts have no tokens; long ones are worked on in spans. Rows are counted one by one, whatever
their doc_id and other columns; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sporeline.llm._bytebpe import PRE_TOKENS, ChunkCache, chunk_numbers, merge_ranked, vocabulary
from sporeline.llm._shared import slices, table

#: Tokens that fit a training window.
LIMIT = 1024


class Counter:
    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.cache = ChunkCache()

    def _chunks(self, new: list[str]) -> list[int]:
        cut = [PRE_TOKENS.findall(x) for x in new]
        order: dict[str, int] = {}
        for x in cut:
            for p in x:
                order.setdefault(p, len(order))
        counts = [len(x) for x in merge_ranked(self.vocab, [p.encode() for p in order])]
        return [sum(counts[order[p]] for p in x) for x in cut]

    def counts(self, texts: list[str | None]) -> list[int]:
        return [sum(1 if s is not None else sum(self.cache.values(c)) for s, c in x) for x in chunk_numbers(texts, self.vocab, self.cache, self._chunks)]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for b in slices(batches, "text"):
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), pa.array(counter.counts(b.column("text").to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long").alias("n_bytes")
    counted = docs.select(docs[key].cast("long").alias("doc_id"), size, docs[text].alias("text")).mapInArrow(work, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES: dict[str, str] = {}
