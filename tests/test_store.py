"""Responses as a data source, and a sink of files that are there once or not at all."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from webloom.sources import store

PAGES = "url string, html string"


def stored(path):
    return sorted(f for _, _, names in os.walk(path) for f in names if not f.startswith(("_", ".")))


def test_responses_in_batches_and_as_a_stream(spark, tmp_path):
    store.register(spark)
    path = str(tmp_path / "r")
    empty = str(tmp_path / "none")
    os.mkdir(empty)
    assert spark.read.format("webloom_responses").load(empty).count() == 0
    rows = [[(f"https://h{k % 3}.example/{b}/{k}#x", f"<p>{k}" * k) for k in range(20)] + [(None, "x"), ("https://a.example/none", None)] for b in range(3)]
    for b in range(2):
        store.layout(spark.createDataFrame(rows[b], PAGES), path, b, 4)
    read = lambda: spark.read.format("webloom_responses").load(path)
    assert {(r.url, bytes(r.body).decode()) for r in read().collect()} == {(u.split("#")[0], h) for b in range(2) for u, h in rows[b] if u and h is not None}
    hosts = read().select(F.spark_partition_id().alias("p"), F.split("url", "/")[2].alias("host"), F.split("url", "/")[3].alias("batch")).distinct().groupBy("host", "batch").count()
    assert hosts.where("count > 1").isEmpty()  # a host's pages of a batch are one task's
    got, sizes = set(), []

    def put(df, n):
        found = df.select("url").collect()
        sizes.append(len(found))
        got.update(r.url for r in found)

    def go():
        stream = spark.readStream.format("webloom_responses").option("maxFilesPerTrigger", 2).load(path)
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(put).start()
        query.processAllAvailable()
        query.stop()

    go()
    assert len(sizes) >= 2 and len(got) == sum(sizes) == 40
    store.layout(spark.createDataFrame(rows[2], PAGES), path, 2, 4)
    sizes.clear()
    go()  # goes on at its offset
    assert sum(sizes) == 20 and len(got) == 60


def test_fetched_responses(spark, tmp_path):
    def fetch(targets):
        for url in targets:
            yield {"url": url, "status_code": 404 if "gone" in url else 200, "body": url.encode()}

    spark.dataSource.register(store.fetching(fetch, "fetched_for_test"))
    store.layout(spark.createDataFrame([("https://a.example/1",), ("https://a.example/gone",), (None,)], "url string"), str(tmp_path / "f"))
    got = spark.read.format("fetched_for_test").load(str(tmp_path / "f")).collect()
    assert {(r.url, r.status_code, bytes(r.body).decode()) for r in got} == {("https://a.example/1", 200, "https://a.example/1"), ("https://a.example/gone", 404, "https://a.example/gone")}


def test_files_are_stored_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(40).select(F.concat(F.lit("n"), "id", F.lit(".md")).alias("name"), F.concat(F.lit("b"), "id").alias("body")).repartition(3)
    store.write_files(rows, path)
    assert stored(path) == sorted(f"n{k}.md" for k in range(40)) and os.path.exists(f"{path}/_SUCCESS")
    store.write_files(spark.createDataFrame([("a/b.md", "x"), ("null.md", None)], "name string, body string"), path)
    assert stored(path) == ["a-b.md", "null.md"]
    store.write_files(spark.createDataFrame([("c.md", "y")], "name string, body string"), path, "append")
    assert stored(path) == ["a-b.md", "c.md", "null.md"]


def test_a_job_that_fails_leaves_no_files(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = spark.range(40, numPartitions=4).select(F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise("b").alias("body"))
    with pytest.raises(Exception, match="broken"):
        store.write_files(bad, path)
    assert not os.path.exists(path) or os.listdir(path) == []


RETRY = """
import os, sys
from pyspark.sql import SparkSession, functions as F
from pyspark import TaskContext
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
from webloom.sources import store
def fail_once(batches):
    for k, batch in enumerate(batches):
        yield batch
        if k == 2 and TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1:
            raise ValueError("this attempt is lost")
spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
rows = spark.range(60, numPartitions=3).select(F.concat(F.lit("n"), "id").alias("name"), F.lit("b").alias("body")).mapInArrow(fail_once, "name string, body string")
store.write_files(rows, sys.argv[1])
"""


def test_an_attempt_that_runs_again_stores_once(tmp_path):
    path = str(tmp_path / "out")
    done = subprocess.run([sys.executable, "-c", RETRY, path], env=os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0 and "this attempt is lost" in done.stderr
    assert stored(path) == sorted(f"n{k}" for k in range(60))
