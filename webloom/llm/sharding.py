"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone, without a table of the ring; one more shard takes
rows only into itself, 1/(n + 1) of them. `slot` numbers a shard's rows gapless from 0 in the order of bin, key and
the other columns named; a bin is part of the key's hash, so a shard is numbered in many tasks, and only counts of
(shard, bin) are summed up: bins are as many as keep them within MAX_COUNTS rows, whatever the input, which may be
broadcast. With so many shards that even one bin each is more, their counts are joined without a broadcast. A bin of more
than HOT_BIN rows, as where a third of all rows are alike, is written and numbered in parts.

Defined cases: rows with one key share a shard (that is the law) and are dealt to bins by their other columns too; rows without
key have one key, NO_KEY, and so share a shard as well; repeated rows get slots of their own; very long texts are not read; an empty table gives no rows;
columns beside those named are passed on, whatever their names, unless they clash with an output column, which
replaces them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._kernels import U64, mix
from ._spark import written

MAX_COUNTS = 1 << 17
#: Rows of a bin that one task numbers, and the parts that a larger one is dealt to.
HOT_BIN, PARTS = 1 << 22, 1024
#: The key of rows that have none.
NO_KEY = -(1 << 63)


def stable_key(values: np.ndarray) -> np.ndarray:
    """A 64-bit key of integers, the same in every run and release."""
    return mix(values.astype(U64) + U64(0x9E3779B97F4A7C15))


def jump(keys: np.ndarray, n: int) -> np.ndarray:
    """The shard in [0, n) of each 64-bit key (Lamping and Veach, 2014)."""
    state = keys.astype(U64)
    shard = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    following = np.zeros(len(state), np.int64)
    while len(live):
        shard[live] = following[live]
        state[live] = state[live] * U64(2862933555777941757) + U64(1)
        following[live] = ((shard[live] + 1) * (float(1 << 31) / ((state[live] >> U64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[following[live] < n]
    return shard


def assign(df: DataFrame, key: str = "doc_id", order: tuple[str, ...] = (), shards: int = 16, bins: int = 4096) -> DataFrame:
    """df with law, shard, slot and grown_shard (the shard if there were one more); bins is a limit."""
    if shards < 1:
        raise ValueError("there must be a shard")
    bins = max(1, min(bins, MAX_COUNTS // (shards + 1)))
    made = ["law", "shard", "slot", "grown_shard"]
    df = df.drop(*made)
    order = tuple(c for c in order if c != key)
    rest = F.xxhash64(*order) if order else F.lit(0).cast("long")
    # By position, so that no name of df can clash with a name in here.
    at = {c: f"c{i}" for i, c in enumerate(df.columns)}

    def dealt(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            other = batch.column(1).to_numpy(zero_copy_only=False)
            k = stable_key(values)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(jump(k, shards), pa.int32()), pa.array(jump(k, shards + 1), pa.int32()), pa.array((mix(k ^ other.astype(U64)) % U64(bins)).astype(np.int32))], names=[*at.values(), "shard", "grown", "bin"])

    wide = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)), rest, *(F.col(f"`{c}`").alias(n) for c, n in at.items()))
    schema = T.StructType([*(T.StructField(at[f.name], f.dataType) for f in df.schema.fields), *(T.StructField(c, T.IntegerType()) for c in ("shard", "grown", "bin"))])
    rows = wide.toDF("key", "rest", *at.values()).mapInArrow(dealt, schema)
    counts = rows.groupBy("shard", "bin").count()
    hot = written(counts.where(F.col("count") > HOT_BIN).select(F.col("shard").alias("hs"), F.col("bin").alias("hb")), "hot")
    if hot.isEmpty():
        rows = rows.withColumn("part", F.lit(0))
    else:
        # Hot bins are at most MAX_COUNTS, as all bins are. Written rows have the same numbers whenever they are read.
        own = (F.col("shard") == F.col("hs")) & (F.col("bin") == F.col("hb"))
        marked = F.broadcast(hot) if (shards + 1) * bins <= MAX_COUNTS else hot
        crowded = written(rows.join(marked, own, "left_semi"), "crowded").withColumn("part", (1 + F.monotonically_increasing_id() % PARTS).cast("int"))
        rows = rows.join(marked, own, "left_anti").withColumn("part", F.lit(0)).unionByName(crowded)
        counts = rows.groupBy("shard", "bin", "part").count()
    counts = counts if "part" in counts.columns else counts.withColumn("part", F.lit(0))
    before = counts.select(F.col("shard").alias("s"), F.col("bin").alias("b"), F.col("part").alias("p"), (F.sum("count").over(Window.partitionBy("shard").orderBy("bin", "part")) - F.col("count")).alias("before"))
    before = F.broadcast(before) if hot.isEmpty() and (shards + 1) * bins <= MAX_COUNTS else before
    within = F.row_number().over(Window.partitionBy("shard", "bin", "part").orderBy(*(at[c] for c in (key, *order)))) - 1
    numbered = rows.withColumn("within", within).join(before, (F.col("shard") == F.col("s")) & (F.col("bin") == F.col("b")) & (F.col("part") == F.col("p")))
    return numbered.select(*(F.col(n).alias(c) for c, n in at.items()), F.lit("key").alias("law"), "shard", (F.col("before") + F.col("within")).alias("slot"), F.col("grown").alias("grown_shard"))
