"""Dashboard aggregates over crawled pages, each in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import audit


def _count(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def status_classes(pages: DataFrame) -> DataFrame:
    status = F.col("status_code")
    classed = F.coalesce(status.between(200, 599), F.lit(False))
    by = {f"status_{k}xx": F.coalesce(status.between(100 * k, 100 * k + 99), F.lit(False)) for k in (2, 3, 4, 5)}
    return pages.agg(F.count("*").alias("crawled"), *(_count(v).alias(k) for k, v in by.items()), _count(~classed).alias("errors"))


def discovered(links: DataFrame, approximate: bool = False) -> DataFrame:
    """How many distinct URLs are known."""
    return links.agg((F.approx_count_distinct("url") if approximate else F.count_distinct("url")).alias("discovered"))


def duplicates(pages: DataFrame, names: tuple[str, ...] = audit.COUNTED) -> DataFrame:
    """One row: for each name, how many pages have a value that others have too.

    Values are counted by partial sums and the counts over 1 added up, so no page is joined to its value's count and a value that is
    very common is one row a task when it moves.
    """
    values = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names)))
    rows = pages.select(values.alias("v")).where("coalesce(v.value, '') <> ''").groupBy("v.name", "v.value").agg(F.count("*").alias("rows")).where("rows > 1")
    return rows.agg(*(F.coalesce(F.sum(F.when(F.col("name") == n, F.col("rows"))), F.lit(0)).cast("long").alias(n) for n in names))


#: Bits of a sketch's registers: an error of some 0.4 %.
SKETCH = 16


def sketch(links: DataFrame) -> DataFrame:
    """One row `sketch` that stands for the distinct URLs; sketches of waves or days are merged by merged_discovered."""
    return links.agg(F.hll_sketch_agg("url", SKETCH).alias("sketch"))


def merged_discovered(sketches: DataFrame) -> DataFrame:
    """discovered: about how many distinct URLs stored sketches (sketch) stand for together, without their URLs."""
    return sketches.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).cast("long").alias("discovered"))


#: The predicates on values that other pages have too, and the values.
DUPLICATES = {"title_duplicate": "title", "desc_duplicate": "meta_desc", "h1_duplicate": "h1"}


def counts_of(pages: DataFrame, names: list[str]) -> DataFrame:
    """One row: `n`, all pages, and for each of the audit predicates named how many pages it holds for."""
    table, several = audit.audit(), tuple(DUPLICATES[n] for n in names if n in DUPLICATES)
    plain = pages.agg(F.count("*").alias("n"), *(_count(table[n][1]).alias(n) for n in names if n not in DUPLICATES))
    if not several:
        return plain
    # One row each.
    return plain.crossJoin(F.broadcast(duplicates(pages, several).withColumnsRenamed({v: k for k, v in DUPLICATES.items() if v in several})))


def audit_rows(counts: DataFrame) -> DataFrame:
    """ord, filter, label, category, count of one row that has a column for each audit predicate."""
    rows = F.array(*(F.struct(F.lit(k).cast("int").alias("ord"), F.lit(name).alias("filter"), F.lit(audit.LABELS[name]).alias("label"), F.lit(category).alias("category"), F.col(name).alias("count")) for k, (name, (category, _)) in enumerate(audit.audit().items())))
    return counts.select(F.inline(rows))


def audit_counts(pages: DataFrame) -> DataFrame:
    """ord, filter, label, category, count of all audit predicates: one aggregate of pages and one of values, turned to rows."""
    return audit_rows(counts_of(pages, list(audit.audit())))


#: Points per share of pages that have an issue, and how it is told.
WEIGHTS = (("title_missing", 20), ("title_duplicate", 5), ("desc_missing", 15), ("h1_missing", 10), ("images_missing_alt", 5), ("canonical_missing", 5), ("schema_errors", 3), ("status_4xx", 10), ("status_5xx", 10))
ISSUES = (("title_missing", "Missing Titles", "error"), ("desc_missing", "Missing Descriptions", "warning"), ("h1_missing", "Missing H1", "warning"), ("images_missing_alt", "Images w/o Alt", "warning"), ("status_4xx", "4xx Errors", "error"), ("status_5xx", "5xx Errors", "error"))
MOST_ISSUES = 5


def health_score(pages: DataFrame) -> DataFrame:
    """score (0 to 100, half up), band; pages that have no row score 0 of 0 as 100."""
    counted = counts_of(pages, [name for name, _ in WEIGHTS])
    lost = reduce(lambda a, b: a + b, [F.col(name) * weight for name, weight in WEIGHTS])
    raw = F.when(F.col("n") == 0, 100.0).otherwise(100.0 - lost / F.col("n"))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).cast("long")
    return counted.select(score.alias("score"), F.when(score >= 80, "Good").when(score >= 50, "Needs Work").otherwise("Poor").alias("band"))


def averages(pages: DataFrame) -> DataFrame:
    return pages.agg(*(F.coalesce(F.expr(f"try_divide(sum({c}), count(*))").cast("long"), F.lit(0).cast("long")).alias(f"avg_{c}") for c in ("response_time_ms", "size_bytes", "word_count")))


def depth_histogram(pages: DataFrame) -> DataFrame:
    """Six buckets, the last for 5 and deeper, zero-filled."""
    counts = pages.groupBy(F.least("depth", F.lit(5)).alias("bucket")).agg(F.count("*").alias("n"))
    every = pages.sparkSession.range(6).withColumnRenamed("id", "depth")
    rows = every.join(counts, F.col("depth") == F.col("bucket"), "left").select("depth", F.coalesce("n", F.lit(0)).cast("long").alias("pages"))
    return rows


def histogram_scale(histogram: DataFrame, height: int = 100) -> DataFrame:
    """Bar heights in proportion to the largest bucket, two pixels at least."""
    top = histogram.agg(F.greatest(F.max("pages"), F.lit(1)).alias("top"))
    return histogram.crossJoin(F.broadcast(top)).select("depth", "pages", F.greatest(F.lit(2.0), F.col("pages") / F.col("top") * height).alias("bar"))


def top_issues(pages: DataFrame) -> DataFrame:
    table = audit.audit()
    wide = pages.agg(*(_count(table[name][1]).alias(name) for name, _, _ in ISSUES))
    rows = F.array(*(F.struct(F.lit(k).cast("int").alias("ord"), F.lit(label).alias("issue"), F.lit(severity).alias("severity"), F.col(name).alias("count")) for k, (name, label, severity) in enumerate(ISSUES)))
    return wide.select(F.inline(rows)).where("count > 0").orderBy(F.desc("count"), "ord").limit(MOST_ISSUES).drop("ord")


def progress(stats: DataFrame, limit: int) -> DataFrame:
    """Two notions of progress of (crawled, discovered): of the dashboard and of the toolbar."""
    wanted = F.least(F.lit(limit), F.col("discovered"))
    share = F.col("crawled") / F.greatest(wanted, F.lit(1))
    return stats.select("crawled", "discovered", F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)).alias("dashboard"), F.when(wanted > 0, F.col("crawled") / wanted).otherwise(0.0).alias("toolbar"))


def social_summary(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode(audit.social_messages()).alias("message")).groupBy("message").agg(F.count("*").alias("pages"))
