"""Spark helpers of this subpackage: keys of texts, sizes of inputs and partitions, components of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.shared import Scratch, shared_dir, written

__all__ = ["Scratch", "check_of", "clashes", "components", "input_bytes", "key_of", "partitions", "shared_dir", "told_apart", "written"]


def key_of(value: Column) -> Column:
    """A 64-bit key of a text or bytes."""
    return F.coalesce(F.xxhash64(value), F.lit(0))


def check_of(value: Column) -> Column:
    """64 more bits of a text or bytes, by other functions than its key."""
    return F.coalesce(F.shiftleft(F.hash(value).cast("long"), 32).bitwiseXOR(F.crc32(value)), F.lit(0))


def clashes(rows: DataFrame) -> DataFrame | None:
    """The keys of rows (node, check, ...) that several values share, as (node, low); None if there are none."""
    found = rows.groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("node", "low")
    found = written(found, "clashes")
    return None if found.isEmpty() else found


def told_apart(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """rows (node, check, ...) without check, where values that only share a key are nodes of their own: 128 bits know them."""
    if found is None:
        return rows.drop("check")
    named = rows.join(found.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left")
    node = F.when(F.col("check") != F.col("low"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return named.withColumn("node", node).drop("check", "c_node", "low")


def input_bytes(df: DataFrame) -> int:
    """About how many bytes df has: from the files it reads, or counted where that is not known."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 60:
        return known
    return df.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def components(links: DataFrame, kind: str, rounds: int = 60) -> DataFrame:
    """Rows (node, root) for all nodes of `links` (a, b): root is the smallest node that can be reached.

    Every round takes the least label over the links, then follows labels of labels, so that long chains halve;
    labels are written to the shared folder in each round and rounds end once nothing changes.
    """
    scratch = Scratch(links.sparkSession)
    both = scratch.write(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), kind)
    label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
    label = scratch.write(label, kind)
    for _ in range(rounds):
        last = Scratch(links.sparkSession)
        near = both.join(label, both["b"] == label["node"]).groupBy(F.col("a").alias("n")).agg(F.min("root").alias("m"))
        step = label.join(near, label["node"] == near["n"], "left").select("node", "root", F.least("root", F.coalesce("m", "root")).alias("next"))
        jump = label.select(F.col("node").alias("j"), F.col("root").alias("far"))
        step = step.join(jump, step["next"] == jump["j"], "left").select("node", "root", F.least("next", F.coalesce("far", "next")).alias("next"))
        step = last.write(step, kind)
        changed = step.where("root <> next").limit(1).count()
        label = step.select("node", F.col("next").alias("root"))
        if not changed:
            scratch.drop()
            return label
        scratch.paths += last.paths
    raise RuntimeError("components did not settle")
