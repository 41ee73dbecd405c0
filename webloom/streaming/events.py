"""Streams: running counters, windows over event time, duplicates, and links that come before or after their page.

Every function takes a static or a streaming DataFrame; `drain` runs a stream over what is there and stops.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from webloom.functions import audit
from webloom.operators import dashboard, links
from webloom.shared import new_path


def timed(events: DataFrame, delay: str | None = "1 day", column: str = "ts") -> DataFrame:
    """Event time as a timestamp (watermarks do not take one without zone), and a watermark on streams."""
    out = events.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, delay) if delay and events.isStreaming else out


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    """event_type, start, n, value of each window."""
    grouped = events.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return grouped.select("event_type", F.col("window.start").alias("start"), "n", "value")


def sliding(events: DataFrame, size: str = "1 day", step: str = "6 hours") -> DataFrame:
    """event_type, start, n of each window of `size`, one beginning every `step`; an event is in as many as it falls into."""
    grouped = events.groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n"))
    return grouped.select("event_type", F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, n of each run of events without a longer gap."""
    grouped = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), "n")


def discovered(crawled: DataFrame) -> DataFrame:
    """Each URL once; state grows with the URLs, or is bounded by a watermark on `ts`."""
    return crawled.dropDuplicatesWithinWatermark(["url"]) if crawled.isStreaming and "ts" in crawled.columns else crawled.dropDuplicates(["url"])


def counters(crawled: DataFrame) -> DataFrame:
    """Running status counters; in complete mode on streams."""
    return dashboard.status_classes(crawled)


@contextmanager
def one_watermark(spark: SparkSession):
    """While streams start in here, rows are late against the watermark that closes windows, not the one before it."""
    name = "spark.sql.streaming.statefulOperator.allowMultiple"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run(stream: DataFrame, place: str, put: Callable[[DataFrame, int], None], mode: str = "append", bounded: bool = True) -> StreamingQuery:
    """Hands each micro-batch of all input that is there to `put`, with the state in `place`, and stops; a later call goes on from there.

    bounded: the source says itself what is there when the run begins, as Spark's own do; else batches are asked for until none comes.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", place).foreachBatch(put)
    if bounded:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    else:
        query = writer.start()
        query.processAllAvailable()
        query.stop()
    return query


def drain(stream: DataFrame, mode: str = "append", progress: list[dict] | None = None, bounded: bool = True) -> DataFrame:
    """Runs a stream over all input that is there, and returns what it gave; what Spark tells of each batch goes to `progress`.

    Results and state are in the shared folder. A mode that repeats rows is written whole by each batch to a folder of
    its own, and the last one counts.
    """
    spark = stream.sparkSession
    place = new_path(spark, "stream")
    last: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")
        last.append(number)

    query = run(stream, f"{place}/state", put, mode, bounded)
    if progress is not None:
        progress += [json.loads(p.json) for p in query.recentProgress]
    if not last:
        return spark.createDataFrame([], stream.schema)
    path = f"{place}/out/batch={max(last)}" if mode == "complete" else f"{place}/out"
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)


def upsert(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The grid after a micro-batch (rows with `seq`): the last row of each URL."""
    return links.latest(batch if current is None else current.unionByName(batch))


def merge_inlinks(spark: SparkSession, rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows with inlinks whichever of row and link came first: a batch join over what both streams have written."""
    return links.with_inlinks(rows, edges)


#: State of any size, and of maps and timers, is kept in RocksDB.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A join's state is one store a partition and not four, and a batch stores what it changed and not whole files.
JOIN_STATE = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.streaming.join.stateFormatVersion": "3", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


class _Inlinks(StatefulProcessor):
    """The sources of one page: a map entry each, so that a batch writes what it brings and nothing else."""

    def __init__(self, wait: int | None):
        self.wait = wait

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", "known boolean")
        self.told = handle.getMapState("told", "src string", "at long")
        self.waiting = handle.getMapState("waiting", "src string", "at long", self.wait)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        page, sources = False, {}
        for batch in rows:
            page = page or bool(batch["src"].isna().any())
            sources |= dict.fromkeys(batch["src"].dropna())
        known, new = self.known.exists(), []
        if page and not known:
            self.known.update((True,))
            new = [None]
            for (src,) in list(self.waiting.keys()):
                sources.setdefault(src)
            self.waiting.clear()
        held = self.told if known or page else self.waiting
        for src in sources:
            if not held.containsKey((src,)):
                held.updateValue((src,), (0,))
                if held is self.told:
                    new.append(src)
        if new:
            yield pd.DataFrame({"url": [key[0]] * len(new), "src": pd.Series(new, dtype=object)})

    def close(self) -> None:
        pass


def inlinks_stream(rows: DataFrame, edges: DataFrame, wait: int | None = None) -> DataFrame:
    """url, src: each inlink of a page once, from a stream of pages (url) and one of links (src, dst), whichever comes first.

    A page is told with a null source when it comes, with the sources that waited for it, and further ones as they come: what is told
    and what state is written follow the batch, not the number of sources a page has. It is a join of two streams, each row of which is taken once:
    links, and pages as their own links with a null source, meet the pages.

    Links to pages that never come are forgotten `wait` milliseconds after they came, if that is given; this needs a timer for each, which a
    processor in Python keeps.
    """
    for name, value in JOIN_STATE.items():
        rows.sparkSession.conf.set(name, value)
    told = rows.select("url", F.lit(None).cast("string").alias("src")).union(edges.where("src is not null").select("dst", "src")).where("url is not null")
    if wait:
        return told.groupBy("url").transformWithStateInPandas(_Inlinks(wait), "url string, src string", "Append", "ProcessingTime")
    pages = rows.where("url is not null").select(F.col("url").alias("page")).dropDuplicates(["page"])
    return told.dropDuplicates(["url", "src"]).join(pages, F.col("url") == F.col("page")).select("url", "src")


def gathered_inlinks(told: DataFrame) -> DataFrame:
    """url, n, inlinks of what inlinks_stream told: the sorted sources of each page in one row, as the data model has them."""
    sources = F.array_sort(F.collect_set("src"))
    return told.groupBy("url").agg(sources.alias("inlinks")).select("url", F.size("inlinks").cast("long").alias("n"), "inlinks")


#: Keys that rows of pages are dealt to in the running audit.
SPREAD = 64


class _Deltas(StatefulProcessor):
    """What a batch adds to the audit counts: of a value, by how often it was there before; of pages, by their flags."""

    def __init__(self, plain: list[str], several: dict[str, str]):
        self.plain, self.several = plain, several

    def init(self, handle) -> None:
        self.rows = handle.getValueState("rows", "rows long")

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        name, flags, n = key[0], np.zeros(len(self.plain), np.int64), 0
        for batch in rows:
            n += len(batch)
            if name == "":
                values = batch["flags"].to_numpy(np.int64)
                flags += np.array([int((values >> k & 1).sum()) for k in range(len(self.plain))])
        if name == "":
            yield pd.DataFrame({"filter": self.plain, "delta": flags})
            return
        before = self.rows.get()[0] if self.rows.exists() else 0
        self.rows.update((before + n,))
        # The first page with a value is none of several until the second comes.
        delta = (before + n if before + n > 1 else 0) - (before if before > 1 else 0)
        if delta:
            yield pd.DataFrame({"filter": [self.several[name]], "delta": [delta]})

    def close(self) -> None:
        pass


def audit_deltas(pages: DataFrame) -> DataFrame:
    """filter, delta: what each micro-batch of a stream of pages adds to the audit counts.

    State is a count for each title, description and h1; a page is its own row's flags and up to three values, so work follows the batch.
    """
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    table, several = audit.audit(), {v: k for k, v in dashboard.DUPLICATES.items()}
    plain = [n for n in table if n not in dashboard.DUPLICATES]
    flags = reduce(lambda a, b: a.bitwiseOR(b), [F.when(table[n][1], F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, n in enumerate(plain)])
    own = F.struct(F.lit("").alias("name"), F.pmod(F.xxhash64("url"), F.lit(SPREAD)).cast("string").alias("value"), flags.alias("flags"))
    values = [F.struct(F.lit(n).alias("name"), F.col(n).alias("value"), F.lit(0).cast("long").alias("flags")) for n in several]
    rows = pages.select(F.explode(F.array(own, *values)).alias("r")).select("r.*").where("coalesce(value, '') <> ''")
    return rows.groupBy("name", "value").transformWithStateInPandas(_Deltas(plain, several), "filter string, delta long", "Append", "None")


def recounting(place: str, put: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A handler of micro-batches of audit_deltas that hands on the audit counts so far.

    A batch's sums, a row per predicate, are kept in `place`; one that comes again replaces itself.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch.groupBy("filter").agg(F.sum("delta").alias("delta")).write.mode("overwrite").parquet(f"{place}/batch={number}")
        sums = batch.sparkSession.read.schema("filter string, delta long").parquet(place)
        names = list(audit.audit())
        put(dashboard.audit_rows(sums.agg(*(F.coalesce(F.sum(F.when(F.col("filter") == n, F.col("delta"))), F.lit(0)).cast("long").alias(n) for n in names))), number)

    return handle


def follow(stream: DataFrame, place: str, put: Callable[[DataFrame, int], None], mode: str = "append", every: str = "1 second") -> StreamingQuery:
    """A stream that hands each micro-batch to `put`, with its state in `place`.

    Stopping the query is a pause: the same call with the same place goes on where it stopped. Sources bound what one batch takes
    (maxFilesPerTrigger), which is the back-pressure.
    """
    return stream.writeStream.outputMode(mode).option("checkpointLocation", place).trigger(processingTime=every).foreachBatch(put).start()
