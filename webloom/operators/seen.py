"""The URLs that a crawl knows, in buckets by hash, so that asking which ones are new moves the candidates only.

URLs are rows of a table that is bucketed by url in the work folder; each batch that is added also leaves a Bloom filter per bucket. Candidates
are dealt into the same buckets, those that no filter of their bucket knows are new, and the rest meets the bucket itself in an
anti-join that has no exchange on its side. A wave's shuffle follows its candidates however long the crawl has run.

The number of buckets belongs to a work folder: take as many as a wave of the planned crawl should have tasks.

Defined cases: a null URL is never new; a URL that is added again is there twice and known once; a batch that a stopped crawl adds again
does no harm; an empty table knows nothing. Filters have BITS bits a URL for its bucket's share of a batch, so a batch of any size keeps them at
some 0.3 % of false alarms, which the anti-join clears.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.shared import Scratch

BUCKETS, BITS, HASHES = 32, 12, 8
_HASHED = "bucket int, url string, depth long, hash long"


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """HASHES places of each 64-bit hash in a filter of so many bits, one row a hash."""
    h = hashes.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * high[:, None]) % np.uint64(bits)).astype(np.int64)


def _filter_of(table: pa.Table) -> pa.Table:
    """The filter of one bucket's URLs in a batch."""
    bits = max(64, 8 * math.ceil(BITS * table.num_rows / 8))
    field = np.zeros(bits, bool)
    field[_places(table.column("hash").to_numpy(), bits).ravel()] = True
    return pa.table({"bucket": table.column("bucket")[:1], "bits": pa.array([np.packbits(field).tobytes()], pa.binary())})


def _asked(candidates: pa.Table, filters: pa.Table) -> pa.Table:
    """Candidates of one bucket, and whether a filter knows them."""
    hashes = candidates.column("hash").to_numpy()
    maybe = np.zeros(len(hashes), bool)
    for raw in filters.column("bits").to_pylist():
        field = np.unpackbits(np.frombuffer(raw, np.uint8))
        maybe |= field[_places(hashes, len(field))].all(axis=1)
    return pa.table({"url": candidates.column("url"), "depth": candidates.column("depth"), "maybe": pa.array(maybe)})


class Seen:
    """The known URLs of a work folder, which driver and executors share; a later session goes on with them."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.urls, self.filters = f"{path.rstrip('/')}/urls-{buckets}", f"{path.rstrip('/')}/filters-{buckets}"
        self.name = "webloom_seen_" + hashlib.sha256(self.urls.encode()).hexdigest()[:24]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (url STRING, depth BIGINT) USING parquet CLUSTERED BY (url) INTO {buckets} BUCKETS LOCATION '{self.urls}'")
        spark.createDataFrame([], "bucket int, bits binary").write.mode("ignore").parquet(self.filters)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _hashed(self, rows: DataFrame) -> DataFrame:
        # The bucket is the one that Spark puts a URL into.
        return rows.where("url is not null").select(F.pmod(F.hash("url"), F.lit(self.buckets)).cast("int").alias("bucket"), "url", F.col("depth").cast("long").alias("depth"), F.xxhash64("url").alias("hash"))

    def add(self, rows: DataFrame) -> None:
        """Adds rows (url, depth)."""
        known = rows.where("url is not null").select("url", F.col("depth").cast("long").alias("depth"))
        known.repartition(self.buckets, "url").write.bucketBy(self.buckets, "url").option("path", self.urls).format("parquet").mode("append").saveAsTable(self.name)
        self._hashed(rows).groupBy("bucket").applyInArrow(_filter_of, "bucket int, bits binary").write.mode("append").parquet(self.filters)

    def new(self, candidates: DataFrame, scratch: Scratch | None = None) -> DataFrame:
        """url, depth of the candidates (url, depth) that are not known, once each, at their least depth."""
        scratch = scratch or Scratch(self.spark)
        once = candidates.groupBy("url").agg(F.min("depth").alias("depth"))
        filters = self.spark.read.schema("bucket int, bits binary").parquet(self.filters)
        asked = self._hashed(once).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_asked, "url string, depth long, maybe boolean")
        asked = scratch.write(asked, "asked")
        return asked.where("not maybe").select("url", "depth").unionByName(self.unknown(asked.where("maybe").select("url", "depth")))

    def unknown(self, candidates: DataFrame) -> DataFrame:
        """Candidates that are not in the table, by an anti-join that leaves the table in its buckets."""
        known = self.table().select(F.col("url").alias("known")).hint("merge")
        return candidates.join(known, F.col("url") == F.col("known"), "left_anti")
