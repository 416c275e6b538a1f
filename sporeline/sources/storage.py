"""Tables in the folder that all executors share: they cut lineage, and survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset on one machine (tests), a new temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sporeline-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """As stored, dealt to buckets of column: joins on column read the buckets as they lie, without another shuffle of df."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, column).write.bucketBy(buckets, column).option("path", f"{shared_dir(spark)}/{table}").format("parquet").saveAsTable(table)
    return spark.table(table)


def dropped(df: DataFrame) -> None:
    """Delete a table that stored() or bucketed() wrote and nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "-" not in folder.getName():  # a bucketed one, which has a name
            spark.sql(f"DROP TABLE IF EXISTS {folder.getName()}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
