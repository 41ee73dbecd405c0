"""The crawl as waves: fetch a frontier, extract, follow links, anti-join what is known, again.

Each wave is a job whose rows and frontier are written to the work folder, so a crawl that stops goes on from its last whole wave.
Depth is the number of links from a seed. The driver holds counts only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import schema
from webloom.config import AuditConfig
from webloom.functions import audit, urls
from webloom.operators import dashboard, links
from webloom.operators.ranks import ranked
from webloom.operators.seen import Seen
from webloom.shared import Scratch
from webloom.sources import extract, seeds

_FRONTIER = "url string, depth long"


def assemble(responses: DataFrame, config: AuditConfig) -> DataFrame:
    """CRAWL rows of responses (RESPONSE columns, depth, blocked); only 2xx HTML is parsed."""
    ok = F.coalesce(F.col("status_code").between(200, 299), F.lit(False))
    gate = ok & F.coalesce(F.lower("content_type").contains("text/html"), F.lit(False)) & F.col("body").isNotNull()
    gated = responses.withColumn("parsed", gate).withColumn("html", F.when(gate, F.col("body"))).drop("body")
    rows = extract.extract_pages(gated.withColumn("size_bytes", F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")), config)
    status = audit.indexability(F.col("blocked"), F.col("status_code").isNull(), F.col("status_code"), F.col("noindex"), F.col("canonical"), F.col("url"))
    made = {"indexability_status": status, "indexable": status == "Indexable", "inlinks": F.array().cast("array<string>")}
    made["error_message"] = F.when(F.col("blocked"), "Blocked by Robots.txt").otherwise(F.coalesce("error_message", F.when(~ok & F.col("status_code").isNotNull(), F.col("status_code").cast("string"))))
    made["response_time_ms"] = F.coalesce("response_time_ms", F.lit(0)).cast("long")
    page = {f.name for f in schema.PARSED.fields}
    out = []
    for f in schema.CRAWL.fields:
        value = made.get(f.name, F.col(f.name))
        out.append((F.when(F.col("parsed"), value).otherwise(schema.default_of(f)) if f.name in page else value).alias(f.name))
    return rows.select(*out)


def first_urls(frontier: DataFrame, most: int) -> DataFrame:
    """The first URLs of a frontier in their order: all where there are no more, else by their places, which are numbered in ranges."""
    if frontier.count() <= most:
        return frontier
    return ranked(frontier, [F.col("url")]).where(F.col("place") <= most).drop("place")


@dataclass
class Crawl:
    """A crawl in a work folder that driver and executors share."""

    spark: SparkSession
    config: AuditConfig
    work: str
    fetcher: seeds.Fetcher | None = None
    stored: DataFrame | None = None
    #: Disallowed prefixes; read from the robots.txt beside the first seed if not given.
    robots: list[str] | None = None

    def _has(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _respond(self, frontier: DataFrame) -> DataFrame:
        blocked = links.robots_blocked(F.col("url"), self.robots or [] if self.config.respect_robots else [])
        marked = frontier.withColumn("blocked", blocked)
        asked = marked.where("not blocked")
        if self.stored is not None:
            got = asked.join(seeds.pages_as_responses(self.stored), "url", "left").withColumn("error_message", F.when(F.col("status_code").isNull(), "Network Error: not stored"))
        else:
            spread = asked.repartition(max(1, self.config.max_concurrency))
            got = spread.join(seeds.fetch_with(spread, self.fetcher), "url")
        return got.unionByName(marked.where("blocked"), allowMissingColumns=True)

    def run(self, lines: list[str]) -> DataFrame:
        """CRAWL rows of all that can be reached from seed lines, inlinks merged."""
        spark, config = self.spark, self.config
        good, bad = seeds.seed_rows(lines)
        if config.respect_robots and self.robots is None and good:
            ask = self.fetcher if self.stored is None else seeds.stored_fetcher(self.stored)
            self.robots = seeds.fetch_robots(ask, good[0], config.user_agent)
        base = (urls.normalise(good[0]) or "").split("://", 1)[-1].split("/")[0].split(":")[0] if good else "localhost"
        catalogue = None
        if config.crawl_mode == "Path" and good:
            catalogue = spark.range(1).select(urls.catalogue(F.lit(good[0])).alias("u")).first()["u"]
            good = list(dict.fromkeys([*good, *([catalogue] if catalogue else [])]))
        wave = crawled = 0
        while self._has(f"{self.work}/rows/wave={wave}/_SUCCESS"):
            wave += 1
        if wave:
            crawled = spark.read.parquet(f"{self.work}/rows").count()
        elif not self._has(f"{self.work}/frontier/wave=0/_SUCCESS"):
            spark.createDataFrame([(u, 0) for u in dict.fromkeys(good)], _FRONTIER).write.mode("overwrite").parquet(f"{self.work}/frontier/wave=0")
        seen = Seen(spark, f"{self.work}/seen")
        while self._has(f"{self.work}/frontier/wave={wave}/_SUCCESS") and crawled < config.max_urls:
            frontier = spark.read.schema(_FRONTIER).parquet(f"{self.work}/frontier/wave={wave}")
            # Before the wave is fetched; a crawl that stopped in between adds it again, which does no harm.
            seen.add(frontier)
            dashboard.sketch(frontier).write.mode("overwrite").parquet(f"{self.work}/sketches/wave={wave}")
            frontier = first_urls(frontier, config.max_urls - crawled)
            assemble(self._respond(frontier), config).write.mode("overwrite").parquet(f"{self.work}/rows/wave={wave}")
            rows = spark.read.schema(schema.CRAWL).parquet(f"{self.work}/rows/wave={wave}")
            crawled += rows.count()
            scratch = Scratch(spark)
            following = seen.new(links.followed(rows, base, config, catalogue).select(F.col("dst").alias("url"), "depth"), scratch)
            wave += 1
            following.write.mode("overwrite").parquet(f"{self.work}/frontier/wave={wave}")
            scratch.drop()
            if spark.read.schema(_FRONTIER).parquet(f"{self.work}/frontier/wave={wave}").isEmpty():
                break
        rows = spark.read.schema(schema.CRAWL).parquet(f"{self.work}/rows") if self._has(f"{self.work}/rows") else spark.createDataFrame([], schema.CRAWL)
        merged = links.with_inlinks(rows.select(*schema.CRAWL.names), links.followed(rows, base, config, catalogue).select("src", "dst"))
        out = merged.select(*schema.CRAWL.names)
        if bad:
            failed = spark.createDataFrame([(u,) for u in bad], "seed string")
            out = out.unionByName(failed.select(*schema.failed_row(F.col("seed"), F.lit(0), "Failed Connection", F.concat(F.lit("Invalid URL: "), F.col("seed")))))
        return out

    def about_discovered(self) -> DataFrame:
        """discovered: about how many URLs the waves so far had in their frontiers, from their sketches alone."""
        return dashboard.merged_discovered(self.spark.read.schema("sketch binary").parquet(f"{self.work}/sketches"))

    def stats(self, rows: DataFrame) -> DataFrame:
        """Counters of a crawl; rows of seeds that are no URL do not count."""
        known = self.spark.read.schema(_FRONTIER).parquet(f"{self.work}/frontier")
        counted = rows.where(~F.coalesce(F.col("error_message").startswith("Invalid URL: "), F.lit(False)))
        return dashboard.status_classes(counted).crossJoin(F.broadcast(dashboard.discovered(known)))
