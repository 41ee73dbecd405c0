"""The link graph and the frontier of a crawl."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.config import AuditConfig
from webloom.functions import urls

from .ranks import ranked


def edges(pages: DataFrame) -> DataFrame:
    """src, dst of all links, copies included."""
    return pages.select(F.col("url").alias("src"), F.explode("outlinks").alias("dst"))


def with_inlinks(pages: DataFrame, links: DataFrame) -> DataFrame:
    """pages with the sorted set of sources that link to each; links to oneself count."""
    sources = links.groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("sources"))
    return pages.drop("inlinks").join(sources, F.col("url") == F.col("dst"), "left").withColumn("inlinks", F.coalesce("sources", F.array().cast("array<string>"))).drop("dst", "sources")


def inlink_counts(links: DataFrame) -> DataFrame:
    """dst, n: distinct sources by count alone, for targets whose sources would fill a row."""
    return links.distinct().groupBy("dst").agg(F.count("*").alias("n"))


def _valid(pattern: str | None) -> str | None:
    """A pattern that both engines read; one that does not compile, or looks around or back, counts as none."""
    if not pattern:
        return None
    try:
        re.compile(pattern)
    except re.error:
        return None
    return None if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", pattern) else pattern


def allowed(url: Column, config: AuditConfig, catalogue: str | None = None) -> Column:
    """Which links a crawl may follow: catalogue prefix (Path mode), then include, then exclude."""
    ok = F.lit(config.crawl_mode in ("Crawl", "Path"))
    if config.crawl_mode == "Path" and catalogue:
        ok &= url.startswith(catalogue)
    if include := _valid(config.include_regex):
        ok &= url.rlike(include)
    if exclude := _valid(config.exclude_regex):
        ok &= ~url.rlike(exclude)
    return ok


def in_depth(depth: Column, config: AuditConfig) -> Column:
    return F.lit(True) if config.max_depth is None else depth + 1 <= config.max_depth


def followed(pages: DataFrame, base_domain: str, config: AuditConfig, catalogue: str | None = None) -> DataFrame:
    """src, dst, depth of the links that are recorded and may be crawled."""
    links = pages.where(in_depth(F.col("depth"), config)).select(F.col("url").alias("src"), F.explode("outlinks").alias("dst"), (F.col("depth") + 1).alias("depth"))
    return links.where(F.coalesce(urls.domain(F.col("dst")) == base_domain, F.lit(False)) & allowed(F.col("dst"), config, catalogue))


def unseen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """url, depth of candidates that are not known yet, once each, at their least depth."""
    new = candidates.join(seen.select(F.col("url").alias("known")), F.col("url") == F.col("known"), "left_anti")
    return new.groupBy("url").agg(F.min("depth").alias("depth"))


def latest(rows: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """The last row of each key; by aggregate, so a key with many versions is reduced before it moves."""
    whole = F.struct(*(c for c in rows.columns))
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.col(order)).alias("_row")).select("_row.*")


def lookup(pages: DataFrame, url: str) -> DataFrame:
    return pages.where(F.col("url") == url)


def add_missing(seeds: DataFrame, more: DataFrame) -> DataFrame:
    """seeds with the URLs of more that are not among them."""
    return seeds.select("url").union(more.select("url")).distinct()


def robots_blocked(url: Column, rules: list[str]) -> Column:
    """Whether the path begins with a rule; a file's rules are few, so they are literals."""
    p = urls.path(url)
    blocked = F.lit(False)
    for rule in rules:
        blocked |= p.startswith(rule)
    return F.coalesce(blocked, F.lit(False))


def robots_matches(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (url, ...) with `rule`, the longest of their host's robots rules (host, rule) that their path begins with; null if none.

    An equi-join on (host, prefix): a host's rules say which lengths there are, a page's path is cut at those lengths only, and
    the pieces are looked up. No page meets a rule that it does not begin with, however many hosts and rules there are.
    """
    rules = rules.where("host is not null and rule <> ''").select(F.col("host").alias("r_host"), "rule").distinct()
    lengths = rules.groupBy(F.col("r_host").alias("l_host")).agg(F.collect_set(F.char_length("rule")).alias("lengths"))
    names = pages.columns
    asked = pages.withColumns({"_host": urls.host(F.col("url")), "_path": urls.path(F.col("url"))}).join(lengths, F.col("_host") == F.col("l_host"), "left")
    fitting = F.filter("lengths", lambda n: n <= F.char_length("_path"))
    prefixes = F.transform(F.sort_array(fitting, False), lambda n: F.substring(F.col("_path"), F.lit(1), n))
    keyed = asked.select("url", "_host", F.explode(prefixes).alias("_prefix")).distinct()
    met = keyed.join(rules, (F.col("_host") == F.col("r_host")) & (F.col("_prefix") == F.col("rule")))
    longest = met.groupBy(F.col("url").alias("m_url")).agg(F.max_by("rule", F.struct(F.char_length("rule"), "rule")).alias("rule"))
    return pages.join(longest, F.col("url") == F.col("m_url"), "left").select(*names, "rule")


def sorted_view(pages: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """The grid's order by one column, nulls as 0 or empty text."""
    missing = F.lit("") if dict(pages.dtypes)[column] == "string" else F.lit(0)
    key = F.coalesce(F.col(column), missing)
    return pages.orderBy(key.desc() if descending else key.asc(), "url")


def placed(pages: DataFrame, column: str) -> DataFrame:
    """All rows of pages with their place in the grid's order by one column, ties by URL."""
    missing = F.lit("") if dict(pages.dtypes)[column] == "string" else F.lit(0)
    return ranked(pages, [F.coalesce(F.col(column), missing), F.coalesce("url", F.lit(""))])
