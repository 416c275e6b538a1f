"""Tables in the folder all executors share, and small helpers of the operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text a Python task works on at once.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset on one machine (tests), a new temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sporeline-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discarded_after(df: DataFrame, *used: DataFrame) -> DataFrame:
    """df, which materialize() wrote, after the tables that it was made from are deleted."""
    for x in used:
        discard(x)
    return df


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have: name with as many underscores before it as that takes."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


#: Keys with more than a HOT-th of all rows are sure to be found by the sketch.
HOT = 1024


def hot_keys(big: DataFrame, key: str) -> dict[int, list]:
    """Keys that hold more rows than a shuffle partition would have, by the groups (a power of two) that they are dealt to.

    A frequent-items sketch names fewer than HOT keys, rare ones among them, and these are counted: so a rare key is never dealt out,
    groups have half of a partition's rows or less, and all groups together are at most four for each partition.
    """
    keys = big.select(F.col(key).alias("k"))
    found = [x for x in keys.stat.freqItems(["k"], 1 / HOT).first()[0] or [] if x is not None]
    if not found:
        return {}
    counts = {x.k: x.n for x in keys.groupBy(F.when(F.col("k").isin(found), F.col("k")).alias("k")).agg(F.count("*").alias("n")).collect()}
    fair = sum(counts.values()) / int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out: dict[int, list] = {}
    for k, n in counts.items():
        if k is not None and n > fair:
            out.setdefault(1 << math.ceil(math.log2(2 * n / fair)), []).append(k)
    return out


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", spread: str | None = None) -> DataFrame:
    """big joined with small (few rows for each key) on key, where any share of big's rows may have one key.

    Rows of big with a hot key are dealt to groups by a hash of the column spread (by default, of all but the key that have one),
    as many as the key's share needs, and the key's rows of small are copied to each. To find hot keys, big's keys are read twice.
    """
    hot = hot_keys(big, key)
    kinds = {c: t for c, t in big.dtypes if "map<" not in t and "variant" not in t}
    by = [spread] if spread else [c for c in kinds if c != key]
    if not hot or not by:
        return big.join(small, key, how)
    salt = unused(small, unused(big, "salt"))
    dealt, copies = F.lit(0), F.array(F.lit(0))
    for n, keys in hot.items():
        dealt = F.when(F.col(key).isin(keys), F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in by)), F.lit(n)).cast("int")).otherwise(dealt)
        copies = F.when(F.col(key).isin(keys), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(copies)
    return big.withColumn(salt, dealt).join(small.withColumn(salt, F.explode(copies)), [key, salt], how).drop(salt)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once: a lambda's variable is never inlined."""
    return F.transform(F.array(value), body)[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about most (SLICE_BYTES) of text, one row at least."""
    most = most or SLICE_BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)
