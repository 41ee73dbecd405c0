"""The folder that driver and executors share, and tables written there on the way to a result."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch while a table is written.
ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset and all runs in one process."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not have:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        have = os.path.join(tempfile.gettempdir(), f"webloom-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", have)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(have)
    return have


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/webloom-{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts lineage and survives lost executors."""
    return Scratch(df.sparkSession).write(df, kind)


class Scratch:
    """Tables written to the shared folder on the way to a result; `drop` deletes them once no table needs them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def write(self, df: DataFrame, kind: str) -> DataFrame:
        """df written and read back, with small batches between the JVM and Python, which bounds what both hold of long texts."""
        path, conf = new_path(self.spark, kind), self.spark.conf
        before = conf.get(BATCH_ROWS)
        conf.set(BATCH_ROWS, min(int(before), ROWS) if int(before) > 0 else ROWS)
        try:
            df.write.parquet(path)
        finally:
            conf.set(BATCH_ROWS, before)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, kind: str, column: str, deal: bool = True, compression: str | None = None) -> DataFrame:
        """df dealt once by a column, written and read back in as many buckets as shuffle partitions: joins and aggregates by that column
        take the buckets as they are. It also spreads rows that came in few parts. deal: False for rows that are in such buckets already."""
        path, n = new_path(self.spark, kind), max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        name = f"webloom_{kind}_{uuid.uuid4().hex}"
        writer = (df.repartition(n, column) if deal else df).write.bucketBy(n, column).option("path", path)
        (writer.option("compression", compression) if compression else writer).format("parquet").saveAsTable(name)
        self.paths.append(path)
        self.tables.append(name)
        return self.spark.table(name)

    def drop(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths.clear()
