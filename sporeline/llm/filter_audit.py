"""An audit of how filters interact: what each one removes at each place of every order, and its Shapley share.

Spark counts documents by part and by the set of filters that they fail (a mask); there are at most 2^k such cells for k
filters. The k! orders of a part are then visited from its cells alone by swaps of neighbours, of which each changes two
steps only. A filter's Shapley share is what it removes, added up along the walk.

Null texts count as empty, a null source as the empty one. A document without a doc_id has no smaller one and is smaller than
none, so it never counts as a copy; rows of one doc_id are counted one by one and aren't copies of each other. Several labels of
one doc_id count as one, which holds if any of them does; labels without a doc_id are left out. Texts of any length are
judged whole, extra columns don't matter, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sporeline.llm._shared import let, table

# The white space that parts words.
SPACE = " \t\n\x0b\f\r"
#: Orders of more filters than this are too many to list.
MOST = 8
#: Parts whose orders a task holds at once.
PARTS = 64


def text_failures(text: Column) -> Column:
    """A mask of filters on the text alone: bit 0 short, 1 repetitive, 2 upper case, 3 symbols."""
    t = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))
    few = lambda w: (F.size(w) < 50).cast("int") + 2 * (100 * F.size(F.array_distinct(w)).cast("long") < 65 * F.size(w).cast("long")).cast("int")
    upper = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))
    return let(words, few) + 4 * (100 * upper.cast("long") > 5 * F.length(t).cast("long")).cast("int") + 8 * t.rlike("[#$%&*|]").cast("int")


def document_cells(docs: DataFrame, labels: DataFrame, failures: Callable[[Column], Column] = text_failures, k: int = 4) -> DataFrame:
    """part, mask, n, good, toxic: documents by source and by the filters they fail; bit k is set for copies of smaller doc_ids.

    Texts are hashed where they are read and never shuffled. Copies are grouped before they meet, so that a text that a third
    of all documents have is one row for each task, source and label.
    """
    t = F.coalesce(docs["text"], F.lit(""))
    seen = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["source"], F.lit("")).alias("part"), F.sha2(t, 256).alias("h"), failures(docs["text"]).alias("mask"))
    known = labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].alias("of")).agg(
        F.max((F.coalesce(labels["quality"], F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce(labels["toxic"], F.lit(0)) == 1).cast("int")).alias("toxic")
    )
    # Rows without a doc_id meet no label; they are dealt out by their text's hash.
    keyed = seen.withColumn("key", F.coalesce("doc_id", F.xxhash64("h", "part")))
    labelled = keyed.join(known, (keyed["key"] == known["of"]) & keyed["doc_id"].isNotNull(), "left")
    by = ("h", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    rows = labelled.groupBy("key", "doc_id", *by).agg(F.count("*").alias("m"))
    some = rows.groupBy("h", "part", "mask", "good", "toxic").agg(
        F.sum("m").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("m")).otherwise(0)).alias("named"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "m"))).alias("least")
    )
    repeated = rows.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "first")
    met = some.join(repeated, "h", "left")
    copies = F.when(F.col("first").isNull() | F.col("least").isNull(), 0).otherwise(F.col("named") - F.when(F.col("least.doc_id") == F.col("first"), F.col("least.m")).otherwise(0))
    both = F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + (1 << k)).alias("mask"), F.col("copies").alias("n")))
    split = met.withColumn("copies", copies).select("part", "good", "toxic", F.explode(both).alias("c")).where("c.n > 0")
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), F.sum(F.col("good") * F.col("c.n")).alias("good"), F.sum(F.col("toxic") * F.col("c.n")).alias("toxic"))


def swaps(k: int) -> Iterator[tuple[list[int], int | None]]:
    """All orders of k things, each with the place whose thing was swapped with the next one to reach it (None at first).

    Things move left or right until a larger one or the end stops them; of those that can move, the largest does.
    """
    order, step = list(range(k)), [-1] * k
    yield order[:], None
    while True:
        free = [x for i, x in enumerate(order) if 0 <= i + step[x] < k and order[i + step[x]] < x]
        if not free:
            return
        x = max(free)
        i = order.index(x)
        j = i + step[x]
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, k):
            step[y] = -step[y]
        yield order[:], min(i, j)


STEP = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def walk(cells: np.ndarray, k: int) -> Iterator[tuple[list[int], dict[str, np.ndarray]]]:
    """For each order its steps: STEP's counts as arrays [part, step], from cells [measure: n, good, toxic; part; mask].

    The arrays are changed in place: a swap of neighbours leaves what comes before and after both as it was.
    """
    masks = np.arange(1 << k)
    fails = [(masks >> f & 1).astype(bool) for f in range(k)]
    failing = [cells[0][:, fails[f]].sum(1) for f in range(k)]
    only = [cells[0][:, 1 << f] for f in range(k)]
    out = {name: np.zeros((cells.shape[1], k), np.int64) for name in STEP}

    def settle(order: list[int], i: int) -> None:
        f, before = order[i], sum(1 << g for g in order[:i])
        gone = fails[f] & (masks & before == 0)
        lost = cells[:, :, gone].sum(2)
        out["removed"][:, i], out["good_lost"][:, i], out["toxic_lost"][:, i] = lost
        out["kept"][:, i] = cells[0][:, masks & (before | 1 << f) == 0].sum(1)
        out["redundant"][:, i] = failing[f] - lost[0]
        out["unique_fails"][:, i] = only[f]

    for order, at in swaps(k):
        for i in range(k) if at is None else (at, at + 1):
            settle(order, i)
        yield order, out


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step, STEP's counts and shapley for each part, order and step, from cells (part, mask, n, good, toxic)."""
    k = len(letters)
    if not 0 < k <= MOST:
        raise ValueError(f"from 1 to {MOST} filters")
    names = ["part", "filter_order", "step", *STEP, "shapley"]

    def orders(rows: list[tuple[str, list]]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, len(rows), 1 << k), np.int64)
        for i, (_, found) in enumerate(rows):
            for c in found:
                held[:, i, c["mask"]] += (c["n"], c["good"], c["toxic"])
        share = np.zeros((len(rows), k), np.int64)
        for order, at in walk(held, k):
            share[:, order] += at["removed"]
        parts = pa.array([p for p, _ in rows], pa.string()).take(pa.array(np.repeat(np.arange(len(rows)), k)))
        steps = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows)))
        for order, at in walk(held, k):
            name = "".join(letters[f] for f in order)
            yield pa.record_batch([parts, pa.array([name] * len(parts)), steps, *(pa.array(at[c].flatten()) for c in STEP), pa.array(share[:, order].flatten())], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PARTS):
                part = b.slice(at, PARTS)
                yield from orders(list(zip(part.column("part").to_pylist(), part.column("cells").to_pylist(), strict=True)))

    # At most 2^k cells for each part.
    grouped = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return grouped.mapInArrow(work, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*STEP, "shapley")))


LETTERS = "ABCDE"


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(document_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), LETTERS)


def _orders_sql(letters: str) -> str:
    """All orders of the filters, each with its steps: the filter's bit, and the bits of those before it."""
    k = len(letters)
    one = "(VALUES " + ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(letters)) + ")"
    tables = ", ".join(f"{one} f{i}(x, b)" for i in range(k))
    distinct = " AND ".join(f"f{i}.b <> f{j}.b" for i in range(k) for j in range(i))
    steps = " UNION ALL ".join(f"SELECT o, {i + 1} AS step, b{i} AS bit, {' + '.join(['0', *(f'b{j}' for j in range(i))])} AS before FROM every" for i in range(k))
    return f"every AS (SELECT {' || '.join(f'f{i}.x' for i in range(k))} AS o, {', '.join(f'f{i}.b AS b{i}' for i in range(k))} FROM {tables} WHERE {distinct}), steps AS ({steps})"


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents
), f AS (
  SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d
), l AS (
  SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), {_orders_sql(LETTERS)}, out AS (
  SELECT part, o AS filter_order, step, bit, sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, {", ".join(f"{c}::BIGINT AS {c}" for c in STEP)}, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM out
"""

QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLES = {"op13_filter_audit": ORACLE_SQL}
