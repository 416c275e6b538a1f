"""Hosts of odd urls, and joins on keys that many rows have."""

import time

import duckdb
import pytest
from compare import assert_same

from pyspark.sql import functions as F

from sporeline.llm import url_filters
from sporeline.llm._shared import hot_keys, salted_join

HOSTS = {
    "http://[2001:db8::1]/x": "[2001:db8::1]", "http://[2001:db8::1]:8080/x": "[2001:db8::1]", "https://me:pw@[::1]?q": "[::1]", "http://[2001:db8::1": None,
    "http://good.com./": "good.com", "http://www.com/": "www.com", "http://www.good.com/": "good.com", "http://www.good.com.:80#x": "good.com", "http://www./": "www",
    "HTTP://WWW.A.B/c": "a.b", "http://user@a.b:1/": "a.b", "http://10.1.2.3/": "10.1.2.3", "http:///x": None, "a.b/c": None, "http://...": None, "": None, None: None,
    f"http://{'a.' * 125}abc/": f"{'a.' * 125}abc", f"http://{'a.' * 126}ab/": None, "ftp://x": "x",
}


def test_hosts(spark):
    df = spark.createDataFrame([(u,) for u in HOSTS], "url string")
    assert {r.url: r.host for r in df.select("url", url_filters.host_of(F.col("url")).alias("host")).collect()} == HOSTS


def test_same_hosts_in_sql(spark, tmp_path):
    pages = spark.createDataFrame(list(enumerate(HOSTS)), "page_id long, url string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert assert_same(url_filters.op8_url_filters(spark, str(tmp_path)), db, url_filters.ORACLE_SQL) == len(HOSTS)


def test_odd_hosts_are_judged_by_their_own_entries(spark):
    captures = spark.createDataFrame(list(enumerate(["http://[2001:db8::1]/x", "http://[2001:db8::2]/x", "http://good.com./", "http://www.com/", "http://9.1.2.3/", "http://x.com/"])), "page_id long, url string").withColumn("fetched_on", F.lit("2024-02-01").cast("date"))
    changes = spark.createDataFrame([("[2001:db8::1]",), ("good.com",), ("com",), ("1.2.3",), ("X.com.",)], "pattern string").select("pattern", F.lit("2024-01-01").cast("date").alias("changed_on"), F.lit("block").alias("action"))
    assert {r.page_id for r in url_filters.judge(captures, changes).where("blocked").collect()} == {0, 2, 5}


def test_a_url_of_very_many_labels_takes_no_time(spark):
    captures = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "com/")], "page_id long, url string").withColumn("fetched_on", F.lit("2024-02-01").cast("date"))
    changes = spark.createDataFrame([("com",)], "pattern string").select("pattern", F.lit("2024-01-01").cast("date").alias("changed_on"), F.lit("block").alias("action"))
    began = time.time()
    row = url_filters.judge(captures, changes).first()
    assert row.host is None and not row.blocked and time.time() - began < 20


@pytest.mark.parametrize("kind", ["array<map<string,int>>", "struct<m:map<string,int>>", "map<string,int>"])
def test_joins_on_hot_keys_with_nested_maps(spark, kind):
    big = spark.range(5000).select(F.lit(1).alias("k"), "id", F.lit(None).cast(kind).alias("extra"))
    small = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    out = salted_join(big, small, "k")
    assert out.count() == 5000 and out.agg(F.count_distinct("id")).first()[0] == 5000


def test_rare_keys_are_not_dealt_out_and_hot_ones_by_their_share(spark):
    big = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    hot = hot_keys(big, "k")  # a third of the rows, for 4 partitions: 20000 rows of 15000 a partition
    assert hot == {4: [-1]}
    small = big.select("k").distinct()
    assert salted_join(big, small, "k").count() == 60_000
    assert hot_keys(big.where("k <> -1"), "k") == {} and hot_keys(big.where("false"), "k") == {}
