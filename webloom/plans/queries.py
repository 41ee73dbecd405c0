"""The registered queries of the engine, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import schema
from webloom.config import AuditConfig
from webloom.functions import audit, text, urls
from webloom.operators import dashboard, links, markup, mining, tree
from webloom.plans.surrogate import PREDICATES, SQL, doc_pages, from_documents
from webloom.shared import new_path, written
from webloom.sources import export, extract, seeds, store, structured
from webloom.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    def add(query: Query) -> Query:
        key = name or query.__name__
        QUERIES[key] = query
        if sql:
            ORACLES[key] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


# Audits.


@register("WITH " + SQL + ", flags AS (SELECT " + ", ".join(f"({p}) AS f_{n}" for n, p in PREDICATES.items()) + " FROM doc_pages) SELECT * FROM (" + " UNION ALL ".join(f"SELECT {k} AS ord, '{n}' AS filter, '{audit.LABELS[n].replace(chr(39), chr(39) * 2)}' AS label, '{c}' AS category, count(*) FILTER (f_{n}) AS count FROM flags" for k, (n, c) in enumerate(zip(PREDICATES, ["Overview"] + ["Response Codes"] * 4 + ["Page Titles"] * 4 + ["Meta Descriptions"] * 4 + ["Headings"] * 5 + ["Images"] + ["Canonicals"] * 2 + ["Social / OG"] * 2 + ["Structured Data"] * 2))) + ")")
def audit_counts(spark, sf_dir):
    return dashboard.audit_counts(doc_pages(spark, sf_dir))


def _audit(name: str) -> None:
    @register(f"WITH {SQL}, flags AS (SELECT url, ({PREDICATES[name]}) AS hit FROM doc_pages) SELECT url FROM flags WHERE hit", f"audit_{name}")
    def query(spark, sf_dir):
        return audit.matching(doc_pages(spark, sf_dir), name).select("url")


for _name in PREDICATES:
    _audit(_name)


@register(f"WITH {SQL} SELECT title, count(*) AS pages FROM doc_pages WHERE coalesce(title, '') <> '' GROUP BY title HAVING count(*) > 1")
def dup_title(spark, sf_dir):
    rows = doc_pages(spark, sf_dir).where(F.coalesce("title", F.lit("")) != "")
    return rows.groupBy("title").agg(F.count("*").alias("pages")).where("pages > 1")


_H1 = r"trim(replace(replace(replace(replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'))".replace('\\"', '"')
_TITLE = _H1.replace("h1", "title")


@register(f"SELECT page_id, h1, count(*) OVER (PARTITION BY h1) AS pages FROM (SELECT page_id, {_H1} AS h1 FROM pages) QUALIFY count(*) OVER (PARTITION BY h1) > 1")
def dup_h1(spark, sf_dir):
    rows = written(page_h1_extract(spark, sf_dir), "h1")  # one pass over the pages, for counts and rows
    counts = rows.groupBy(F.col("h1").alias("v")).agg(F.count("*").alias("pages")).where("pages > 1")
    return rows.join(counts, F.col("h1") == F.col("v")).select("page_id", "h1", "pages")


@register(f"WITH {SQL} SELECT url, title, status_code FROM doc_pages WHERE contains(lower(url), 'th') OR contains(lower(title), 'th') OR contains(lower(meta_desc), 'th') OR contains(CAST(status_code AS VARCHAR), 'th')")
def search_rows(spark, sf_dir):
    return doc_pages(spark, sf_dir).where(audit.search("  Th ")).select("url", "title", "status_code")


@register(f"WITH {SQL} SELECT url FROM doc_pages WHERE status_code BETWEEN 400 AND 499 AND (contains(lower(url), 'src0') OR contains(lower(title), 'src0') OR contains(lower(meta_desc), 'src0'))")
def filter_and_search(spark, sf_dir):
    return audit.matching(doc_pages(spark, sf_dir), "status_4xx").where(audit.search("src0")).select("url")


def _suggest(name: str, column: str) -> None:
    @register(f"WITH {SQL} SELECT url FROM doc_pages WHERE trim(coalesce({column}, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = ''", f"suggest_{name}")
    def query(spark, sf_dir):
        return doc_pages(spark, sf_dir).where(audit.wants_suggestion(name)).select("url")


_suggest("title", "title")
_suggest("description", "meta_desc")


@register(f"WITH {SQL} SELECT url, CASE WHEN image_kind = 1 THEN 1 ELSE 0 END AS images FROM doc_pages WHERE image_kind = 1")
def suggest_alt(spark, sf_dir):
    return doc_pages(spark, sf_dir).select("url", F.size(audit.wants_alt()).alias("images")).where("images > 0")


@register(
    f"WITH {SQL}"
    """, m AS (SELECT url, concat_ws(chr(10),
      CASE WHEN og_title IS NULL THEN 'Missing og:title tag.' WHEN og_title <> title THEN 'Warning: og:title does not match HTML title tag.' END,
      CASE WHEN og_description IS NULL THEN 'Missing og:description tag.' WHEN og_description <> meta_desc THEN 'Warning: og:description does not match HTML meta description.' END,
      CASE WHEN og_image IS NULL THEN 'Missing og:image tag.' END, CASE WHEN twitter_card IS NULL THEN 'Missing twitter:card tag.' END) AS m FROM doc_pages)
    SELECT url, CASE WHEN m = '' THEN 'All Open Graph and Twitter Card tags are correctly configured.' ELSE m END AS messages FROM m"""
)
def social_diag(spark, sf_dir):
    return doc_pages(spark, sf_dir).select("url", F.array_join(audit.social_messages(), "\n").alias("messages"))


@register(f"WITH {SQL} SELECT url, CASE WHEN status_code NOT BETWEEN 200 AND 299 THEN 'Non-200 Status Code' WHEN canonical IS NOT NULL AND canonical <> url THEN 'Canonicalised' ELSE 'Indexable' END AS indexability FROM doc_pages")
def indexability(spark, sf_dir):
    status = audit.indexability(F.lit(False), F.col("status_code").isNull(), F.col("status_code"), F.lit(False), F.col("canonical"), F.col("url"))
    return doc_pages(spark, sf_dir).select("url", status.alias("indexability"))


# Dashboard.


@register(f"WITH {SQL} SELECT count(*) AS crawled, " + ", ".join(f"count(*) FILTER (status_code BETWEEN {k}00 AND {k}99) AS status_{k}xx" for k in (2, 3, 4, 5)) + ", count(*) FILTER (status_code NOT BETWEEN 200 AND 599) AS errors FROM doc_pages")
def status_classes(spark, sf_dir):
    return dashboard.status_classes(doc_pages(spark, sf_dir))


@register(f"WITH {SQL} SELECT CAST(sum(response_time_ms) // count(*) AS BIGINT) AS avg_response_time_ms, CAST(sum(size_bytes) // count(*) AS BIGINT) AS avg_size_bytes, CAST(sum(word_count) // count(*) AS BIGINT) AS avg_word_count FROM doc_pages")
def avg_metrics(spark, sf_dir):
    return dashboard.averages(doc_pages(spark, sf_dir))


@register(f"WITH {SQL} SELECT r AS depth, count(url) AS pages FROM range(6) t(r) LEFT JOIN doc_pages ON least(depth, 5) = r GROUP BY r")
def depth_histogram(spark, sf_dir):
    return dashboard.depth_histogram(doc_pages(spark, sf_dir))


@register(f"WITH {SQL}, h AS (SELECT r AS depth, count(url) AS pages FROM range(6) t(r) LEFT JOIN doc_pages ON least(depth, 5) = r GROUP BY r) SELECT depth, pages, greatest(2.0, CAST(pages AS DOUBLE) / greatest((SELECT max(pages) FROM h), 1) * 100) AS bar FROM h")
def depth_bars(spark, sf_dir):
    return dashboard.histogram_scale(dashboard.depth_histogram(doc_pages(spark, sf_dir)))


@register(
    f"WITH {SQL}, flags AS (SELECT "
    + ", ".join(f"({PREDICATES[n]}) AS {n}" for n, _ in dashboard.WEIGHTS)
    + " FROM doc_pages), score AS (SELECT CAST(round(greatest(0, least(100, 100.0 - ("
    + " + ".join(f"{w} * count(*) FILTER ({n})" for n, w in dashboard.WEIGHTS)
    + ") / CAST(count(*) AS DOUBLE)))) AS BIGINT) AS score FROM flags) SELECT score, CASE WHEN score >= 80 THEN 'Good' WHEN score >= 50 THEN 'Needs Work' ELSE 'Poor' END AS band FROM score"
)
def health_score(spark, sf_dir):
    return dashboard.health_score(doc_pages(spark, sf_dir))


@register(
    f"WITH {SQL}, c AS ("
    + " UNION ALL ".join(f"SELECT {k} AS ord, '{label}' AS issue, '{severity}' AS severity, count(*) FILTER ({PREDICATES[n]}) AS count FROM doc_pages" for k, (n, label, severity) in enumerate(dashboard.ISSUES))
    + ") SELECT issue, severity, count FROM c WHERE count > 0 ORDER BY count DESC, ord LIMIT 5"
)
def top_issues(spark, sf_dir):
    return dashboard.top_issues(doc_pages(spark, sf_dir))


@register(f"WITH {SQL} SELECT count(*) AS crawled, count(DISTINCT outlink) AS discovered, greatest(0.0, least(1.0, CAST(count(*) AS DOUBLE) / greatest(least(500, count(DISTINCT outlink)), 1))) AS dashboard, CAST(count(*) AS DOUBLE) / least(500, count(DISTINCT outlink)) AS toolbar FROM doc_pages")
def progress(spark, sf_dir):
    rows = doc_pages(spark, sf_dir)
    return dashboard.progress(rows.agg(F.count("*").alias("crawled"), F.count_distinct(F.col("outlinks")[0]).alias("discovered")), 500)


@register(f"WITH {SQL} SELECT url, word_count FROM doc_pages ORDER BY word_count DESC, url LIMIT 50")
def grid_sorted_topn(spark, sf_dir):
    return links.sorted_view(doc_pages(spark, sf_dir).select("url", "word_count"), "word_count", True).limit(50)


def _sorted(column: str, name: str, sql: str | None = None) -> None:
    """The whole grid in the order of a column: every row with its place."""
    missing = "''" if column in ("title", "url", "indexability_status") else "0"

    @register(f"WITH {SQL} SELECT url, row_number() OVER (ORDER BY coalesce({sql or column}, {missing}), url) AS place FROM doc_pages", f"sort_{name}")
    def query(spark, sf_dir):
        return links.placed(doc_pages(spark, sf_dir).select(*dict.fromkeys(("url", column))), column).select("url", "place")


for _name in ("url", "status_code", "title", "word_count", "size_bytes", "depth", "response_time_ms"):
    _sorted(_name, _name)
_sorted("indexability_status", "indexability", "CASE WHEN indexable THEN 'Indexable' ELSE 'Other' END")


@register(
    f"WITH {SQL} SELECT url, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN printf('%.1f', size_bytes / 1024) || ' KB' ELSE printf('%.1f', size_bytes / 1048576) || ' MB' END AS size, printf('%.2f', size_bytes / 1024) || ' KB' AS grid_size, '(' || length(title) || ' chars)' AS title_label, CASE WHEN h1_count > 1 THEN '(Multiple tags: ' || h1_count || ' found)' ELSE '' END AS h1_label, CAST(status_code AS VARCHAR) AS status FROM doc_pages"
)
def labels_and_formats(spark, sf_dir):
    return doc_pages(spark, sf_dir).select("url", text.bytes_label(F.col("size_bytes")).alias("size"), text.kilobytes(F.col("size_bytes")).alias("grid_size"), text.length_label(F.col("title")).alias("title_label"), text.multiple_label(F.col("h1_count")).alias("h1_label"), text.status_label(F.col("status_code")).alias("status"))


# Pages: extraction, links, URLs.


@register(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_title_extract(spark, sf_dir):
    return markup.fields(pages(spark, sf_dir), "title").select("page_id", "title")


@register(f"SELECT page_id, {_H1} AS h1 FROM pages")
def page_h1_extract(spark, sf_dir):
    return markup.fields(pages(spark, sf_dir), "h1").select("page_id", "h1")


#: Targets as browsers write them: the page's host without its scheme's own port, the path's other characters percent-encoded.
_ORIGIN = "regexp_replace(regexp_replace(regexp_extract(url, '^(https?://[^/?#]+)', 1), '^(http://[^:]+):80$', '\\1'), '^(https://[^:]+):443$', '\\1')"
_LINKS = f"SELECT url AS src, {_ORIGIN} || '/' || replace(replace(url_encode(substr(href, 2)), '%2C', ','), '%2F', '/') AS dst FROM (SELECT url, replace(unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)), '&amp;', '&') AS href FROM pages)"


def page_links(spark, sf_dir):
    """src, dst of all links of the pages."""
    return links.edges(markup.fields(pages(spark, sf_dir), "outlinks"))


@register("SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href=')) AS links FROM pages")
def page_link_extract(spark, sf_dir):
    return markup.fields(pages(spark, sf_dir), "outlinks").select("page_id", F.size("outlinks").cast("long").alias("links"))


@register(r"SELECT page_id, len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)^.*?<body[^>]*>', ''), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' ', 'g'), '\S+')) AS words FROM pages")
def page_word_count(spark, sf_dir):
    return markup.fields(pages(spark, sf_dir), "word_count").select("page_id", F.col("word_count").alias("words"))


_WORDS = r"len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)^.*?<body[^>]*>', ''), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' ', 'g'), '\S+'))"


def _meta(name: str, key: str = "name") -> str:
    return f"nullif(trim(regexp_extract(html, '(?is)<meta [^>]*{key}=\"{name}\"[^>]*content=\"([^\"]*)\"', 1)), '')"


def _tags(tag: str) -> str:
    return f"len(regexp_extract_all(html, '(?i)<{tag}[ >]'))"


@register(
    f"SELECT page_id, url, {_TITLE} AS title, {_meta('description')} AS meta_desc, nullif(regexp_extract(html, '(?is)<link [^>]*rel=\"canonical\"[^>]*href=\"([^\"]*)\"', 1), '') AS canonical, contains(lower(coalesce({_meta('robots')}, '')), 'noindex') AS noindex, "
    f"{_H1} AS h1, {_tags('h1')} AS h1_count, nullif(regexp_extract(html, '(?is)<h2[^>]*>(.*?)</h2>', 1), '') AS h2, {_tags('h2')} AS h2_count, {_WORDS} AS word_count, CAST({_tags('img')} AS INT) AS images, "
    f"coalesce((SELECT string_agg(dst, ' ' ORDER BY pos) FROM (SELECT {_ORIGIN} || '/' || replace(replace(url_encode(substr(replace(h, '&amp;', '&'), 2)), '%2C', ','), '%2F', '/') AS dst, pos FROM (SELECT unnest(hrefs) AS h, generate_subscripts(hrefs, 1) AS pos))), '') AS outlinks, "
    f"{_meta('og:title', 'property')} AS og_title, {_meta('twitter:card')} AS twitter_card, CAST(len(regexp_extract_all(html, 'application/ld.json|itemscope')) AS INT) AS schemas, '' AS schema_errors, CAST({_tags('h[1-6]')} AS INT) AS headings "
    "FROM (SELECT *, regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1) AS hrefs FROM pages)"
)
def pages_extracted_dom(spark, sf_dir):
    """All scalar fields of every page."""
    rows = extract.extract_pages(pages(spark, sf_dir), AuditConfig(extract_microdata=True))
    return rows.select("page_id", "url", "title", "meta_desc", "canonical", "noindex", "h1", "h1_count", "h2", "h2_count", "word_count", F.size("images").alias("images"), F.array_join("outlinks", " ").alias("outlinks"), "og_title", "twitter_card", F.size("schema_json_ld").alias("schemas"), F.array_join("schema_errors", "; ").alias("schema_errors"), F.size("headings").alias("headings"))


@register(ORACLES["pages_extracted_dom"].replace("application/ld.json|itemscope", "application/ld.json"))
def page_fields(spark, sf_dir):
    """The fields of every page by column functions alone, in the stage that reads the pages."""
    rows = markup.fields(pages(spark, sf_dir), "title", "meta_desc", "canonical", "noindex", "h1", "h1_count", "h2", "h2_count", "word_count", "images", "outlinks", "og_title", "twitter_card", "schema_json_ld", "schema_errors", "headings")
    return rows.select("page_id", "url", "title", "meta_desc", "canonical", "noindex", "h1", "h1_count", "h2", "h2_count", "word_count", F.size("images").alias("images"), F.array_join("outlinks", " ").alias("outlinks"), "og_title", "twitter_card", F.size("schema_json_ld").alias("schemas"), F.array_join("schema_errors", "; ").alias("schema_errors"), F.size("headings").alias("headings"))


#: Kinds of links: how one is written on a page, and what it means there (o: origin, p: path, d: its folder, q: query).
_REFERENCES = {
    "'next page' || page_id": "o || d || 'next%20page' || page_id",
    "'../up/./x?y=' || page_id || '#z'": "o || regexp_replace(d, '[^/]+/$', '') || 'up/x?y=' || page_id || '#z'",
    "'?q=a b'": "o || p || '?q=a%20b'",
    "'#top' || page_id": "o || p || q || '#top' || page_id",
    "'//Cdn.Example:443/' || page_id": "split_part(url, ':', 1) || '://cdn.example' || CASE WHEN starts_with(url, 'http:') THEN ':443' ELSE '' END || '/' || page_id",
    "'mailto:a' || page_id || '@b.example'": "'mailto:a' || page_id || '@b.example'",
    "'HTTPS://Other.EXAMPLE:443/x/../y'": "'https://other.example/y'",
    "'http://h:99999/' || page_id": "NULL",
    "'/stra\u00dfe'": "o || '/stra%C3%9Fe'",
    "''": "o || p || q",
}


@register(
    f"WITH b AS (SELECT page_id, url, o, regexp_replace(p, '^$', '/') AS p, regexp_replace(regexp_replace(p, '^$', '/'), '[^/]*$', '') AS d, q FROM (SELECT page_id, url, {_ORIGIN} AS o, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p, regexp_extract(url, '^[^?#]*([?][^#]*)', 1) AS q FROM pages)) "
    + " UNION ALL ".join(f"SELECT page_id, {r} AS reference, {t} AS target FROM b" for r, t in _REFERENCES.items())
)
def url_resolution(spark, sf_dir):
    """Links of every form, seen from every page."""
    rows = pages(spark, sf_dir).select("page_id", "url", F.explode(F.array(*(F.expr(r) for r in _REFERENCES))).alias("reference"))
    return rows.select("page_id", "reference", urls.resolved(F.col("url"), F.col("reference")).alias("target"))


#: JSON-LD blocks of the documents by doc_id, and what is wrong with each.
_BLOCKS = {
    """'{"@context": "https://schema.org", "@type": "Article", "id": ' || doc_id || '}'""": "''",
    """'{"@context": "http://schema.org/", "id": ' || doc_id || '}'""": f"'{structured.NO_TYPE}'".replace("'@type'", "''@type''"),
    """'{"@context": "https://x.example/' || doc_id || '", "@graph": null}'""": "'" + structured.OTHER_CONTEXT.replace("'", "''").replace("{}", "https://x.example/' || doc_id || '") + "'",
    """'[' || doc_id || ', {"@type": "Thing"}, {"@context": {}, "name": "a"}]'""": f"'{structured.BAD_ITEM}; " + "; ".join((structured.NO_CONTEXT, structured.NO_CONTEXT, structured.NO_TYPE)).replace("'", "''") + "'",
    "CAST(doc_id AS STRING)": f"'{structured.BAD_ROOT}'",
    """'{"@context": ' || doc_id""": "'" + structured.NO_JSON.format("this is not JSON") + "'",
    """'[]'""": "''",
}


@register("SELECT doc_id, CASE " + " ".join(f"WHEN doc_id % {len(_BLOCKS)} = {k} THEN {said}" for k, said in enumerate(_BLOCKS.values())) + " END AS errors FROM documents WHERE doc_id IS NOT NULL")
def jsonld_checks(spark, sf_dir):
    """JSON-LD checks over variants, in the stage that reads the blocks."""
    rows = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    block = F.expr("CASE " + " ".join(f"WHEN doc_id % {len(_BLOCKS)} = {k} THEN {b}" for k, b in enumerate(_BLOCKS)) + " END")
    return rows.select("doc_id", block.alias("block")).select("doc_id", F.array_join(markup.checks(F.col("block")), "; ").alias("errors"))


@register(f"SELECT page_id, len(regexp_extract_all(html, '(?i)<h1[ >]')) > 1 AS several FROM pages")
def duplicate_h1_flag(spark, sf_dir):
    return markup.fields(pages(spark, sf_dir), "headings").select("page_id", audit.duplicate_h1_flag().alias("several"))


#: Markdown of the generated pages: a heading, then paragraphs, of which some open a <b> that nothing closes. It goes on in all
#: later paragraphs, nested once for each, but no more than three are carried on into the next paragraph.
_MARKDOWN = (
    "bodies AS (SELECT page_id, url, html, regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>(?:<b>)?[^<]*') AS p FROM pages), "
    "paragraphs AS (SELECT page_id, i, starts_with(t, '<p><b>') AS opens, trim(regexp_replace(replace(replace(regexp_replace(t, '^<p>(<b>)?', ''), '&quot;', chr(34)), '&amp;', '&'), '\\s+', ' ', 'g')) AS t FROM (SELECT page_id, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM bodies)), "
    "nested AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY page_id ORDER BY i) AS b FROM paragraphs), "
    "written AS (SELECT page_id, string_agg(repeat('**', CAST(least(b, CASE WHEN opens THEN 4 ELSE 3 END) AS INT)) || t || CASE WHEN opens THEN chr(10) ELSE '' END || repeat('**', CAST(least(b, CASE WHEN opens THEN 4 ELSE 3 END) AS INT)), chr(10) || chr(10) ORDER BY i) AS t FROM nested GROUP BY page_id), "
    f"markdowns AS (SELECT page_id, url, '# ' || regexp_replace({_H1}, '\\s+', ' ', 'g') || coalesce(chr(10) || chr(10) || t, '') AS markdown FROM pages LEFT JOIN written USING (page_id))"
)


@register(f"WITH {_MARKDOWN} SELECT url, markdown FROM markdowns")
def html_to_markdown(spark, sf_dir):
    return extract.to_markdown_pages(pages(spark, sf_dir))


@register(_LINKS)
def link_edges(spark, sf_dir):
    return page_links(spark, sf_dir)


@register(f"SELECT dst, string_agg(DISTINCT src, ' ' ORDER BY src) AS sources, count(DISTINCT src) AS n FROM ({_LINKS}) GROUP BY dst")
def inlinks(spark, sf_dir):
    grouped = page_links(spark, sf_dir).groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("s"))
    return grouped.select("dst", F.array_join("s", " ").alias("sources"), F.size("s").cast("long").alias("n"))


@register(f"SELECT src, count(*) AS links, count(DISTINCT dst) AS targets FROM ({_LINKS}) GROUP BY src")
def outlink_counts(spark, sf_dir):
    return page_links(spark, sf_dir).groupBy("src").agg(F.count("*").alias("links"), F.count_distinct("dst").alias("targets"))


@register(f"SELECT dst AS url, 1 AS depth FROM ({_LINKS}) WHERE dst NOT IN (SELECT regexp_replace(url, '#.*$', '') FROM pages) GROUP BY dst")
def frontier_next(spark, sf_dir):
    seen = pages(spark, sf_dir).select(urls.without_fragment(F.col("url")).alias("url"))
    return links.unseen(page_links(spark, sf_dir).select(F.col("dst").alias("url"), F.lit(1).alias("depth")), seen)


@register(f"SELECT regexp_replace(url, '#.*$', '') AS url FROM pages UNION SELECT dst FROM ({_LINKS})")
def discovered_union(spark, sf_dir):
    return links.add_missing(pages(spark, sf_dir).select(urls.without_fragment(F.col("url")).alias("url")), page_links(spark, sf_dir).select(F.col("dst").alias("url")))


@register(f"SELECT count(DISTINCT dst) AS discovered FROM ({_LINKS})")
def discovered_count(spark, sf_dir):
    return dashboard.discovered(page_links(spark, sf_dir).select(F.col("dst").alias("url")))


@register(f"SELECT count(DISTINCT dst) AS discovered, true AS near FROM ({_LINKS})")
def discovered_sketch(spark, sf_dir):
    """The exact count of link targets, and whether that of merged sketches, one for each part of the pages, is within two in a hundred."""
    found = written(page_links(spark, sf_dir).select(F.col("dst").alias("url"), F.pmod(F.xxhash64("src"), F.lit(7)).alias("part")), "targets")
    sketches = found.groupBy("part").agg(F.hll_sketch_agg("url", dashboard.SKETCH).alias("sketch"))
    both = dashboard.discovered(found).crossJoin(F.broadcast(dashboard.merged_discovered(sketches).withColumnRenamed("discovered", "about")))
    return both.select("discovered", (F.abs(F.col("about") - F.col("discovered")) <= F.greatest(F.lit(1.0), F.col("discovered") * 0.02)).alias("near"))


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = "CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END"


@register(f"SELECT {_HOST} AS host, count(*) AS pages FROM pages GROUP BY 1")
def host_counts(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


@register(f"SELECT page_id, {_PATH} AS path, regexp_replace(url, '#.*$', '') AS bare FROM pages")
def url_path(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.path(F.col("url")).alias("path"), urls.without_fragment(F.col("url")).alias("bare"))


_SLUG = (
    f"s AS (SELECT page_id, regexp_extract(regexp_replace({_PATH}, '/+$', ''), '([^/]*)$', 1) AS last FROM pages), e AS (SELECT page_id, CASE WHEN last LIKE '_%.%' AND strpos(substr(last, 2), '.') > 0 THEN regexp_replace(last, '\\.[^.]*$', '') ELSE last END AS stem FROM s), "
    r"slugs AS (SELECT page_id, CASE WHEN stem = '' THEN 'index' ELSE translate(regexp_replace(stem, '[^\p{L}\p{M}\p{N}_-]', '-', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS slug FROM e)"
)


@register(f"WITH {_SLUG} SELECT page_id, slug FROM slugs")
def url_slug(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.slug(F.col("url")).alias("slug"))


@register("SELECT src, CASE WHEN regexp_extract(last, '[.]([^.]+)$', 1) = '' THEN 'png' ELSE regexp_extract(last, '[.]([^.]+)$', 1) END AS extension FROM (SELECT src, regexp_extract(regexp_extract(src, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) AS last FROM (SELECT regexp_replace(url, '#.*$', '') || CASE page_id % 3 WHEN 0 THEN '.jpeg?v=1.5' WHEN 1 THEN '.x.webp' ELSE '' END AS src FROM pages))")
def image_extension(spark, sf_dir):
    """The file ending that an image is stored under; a page's address with an ending stands for an image's."""
    ending = F.when(F.col("page_id") % 3 == 0, ".jpeg?v=1.5").when(F.col("page_id") % 3 == 1, ".x.webp").otherwise("")
    images = pages(spark, sf_dir).select(F.concat(urls.without_fragment(F.col("url")), ending).alias("src"))
    return images.select("src", urls.extension(F.col("src")).alias("extension"))


@register(
    "WITH b AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages), c AS (SELECT page_id, CASE WHEN regexp_matches(u, '^[^/]+//[^/]*$') THEN u || '/' ELSE u END AS u FROM b), d AS (SELECT page_id, u, list_filter(string_split(regexp_extract(u, '^[a-z]+://[^/]*(.*)$', 1), '/'), lambda x: x <> '') AS s FROM c) "
    "SELECT page_id, CASE WHEN u LIKE '%/' THEN u WHEN contains(s[-1], '.') OR len(s) > 1 THEN regexp_replace(u, '[^/]*$', '') ELSE u || '/' END AS catalogue FROM d"
)
def catalogue_url(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.catalogue(F.col("url")).alias("catalogue"))


#: A robots file for the queries: the star group counts, the other crawler's does not.
ROBOTS = "User-agent: *\nDisallow: /a\nDisallow: /d\nDisallow:\n\n# note\nUser-agent: otherbot\nDisallow: /\n"


@register(f"SELECT page_id, starts_with({_PATH}, '/a') OR starts_with({_PATH}, '/d') AS blocked FROM pages")
def robots_blocked(spark, sf_dir):
    rules = seeds.robots_rules(ROBOTS, "webloom/0.1")
    return pages(spark, sf_dir).select("page_id", links.robots_blocked(F.col("url"), rules).alias("blocked"))


#: Robots files that differ by host: folders of some of its pages, and two that are the same everywhere.
_HOST_RULES = f"files AS (SELECT {_HOST} AS host, {_PATH} AS path, page_id FROM pages), rules AS (SELECT host, substr(min(path), 1, 4) AS rule FROM files GROUP BY host UNION SELECT host, max(path) FROM files GROUP BY host UNION SELECT DISTINCT host, unnest(['/a', '/da']) FROM files)"


@register(f"WITH {_HOST_RULES}, met AS (SELECT page_id, max_by(rule, struct_pack(n := length(rule), r := rule)) AS rule FROM files f JOIN rules r ON f.host = r.host AND starts_with(f.path, r.rule) GROUP BY page_id) SELECT page_id, met.rule IS NOT NULL AS blocked, met.rule AS rule FROM files LEFT JOIN met USING (page_id)")
def robots_all_hosts(spark, sf_dir):
    """The pages of all hosts under the robots files of all hosts."""
    rows = pages(spark, sf_dir)
    paths = rows.groupBy(urls.host(F.col("url")).alias("host")).agg(F.min(urls.path(F.col("url"))).alias("first"), F.max(urls.path(F.col("url"))).alias("last"))
    lines = ["User-agent: otherbot", "Disallow: /", "User-agent: *", F.concat(F.lit("Disallow: "), F.substring("first", 1, 4)), F.concat(F.lit("disallow: "), "last"), "Disallow: /a", "Disallow: /da", "Disallow:"]
    files = paths.select("host", F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in lines)).alias("value"))
    met = links.robots_matches(rows.select("page_id", "url"), seeds.robots_rules_table(files, "webloom/0.1"))
    return met.select("page_id", F.col("rule").isNotNull().alias("blocked"), "rule")


@register(f"SELECT src, dst FROM ({_LINKS}) WHERE regexp_matches(dst, '[a-m]$') AND NOT regexp_matches(dst, 'qu|th')")
def regex_include_exclude(spark, sf_dir):
    return page_links(spark, sf_dir).where(links.allowed(F.col("dst"), AuditConfig(include_regex="[a-m]$", exclude_regex="qu|th")))


@register(f"WITH {SQL} SELECT url FROM doc_pages WHERE starts_with(url, 'https://site.example/en/src0/')")
def path_mode(spark, sf_dir):
    return doc_pages(spark, sf_dir).where(links.allowed(F.col("url"), AuditConfig(crawl_mode="Path"), "https://site.example/en/src0/")).select("url")


@register("SELECT CASE WHEN regexp_matches(trim(line), '^https?://') THEN trim(line) ELSE 'https://' || trim(line) END AS url FROM (SELECT unnest(string_split(string_agg(' ' || replace(url, 'https://', '') || ' ' || chr(10), '' ORDER BY page_id), chr(10))) AS line FROM pages) WHERE trim(line) <> ''")
def seed_urls(spark, sf_dir):
    lines = pages(spark, sf_dir).select(F.concat(F.lit(" "), F.replace("url", F.lit("https://"), F.lit("")), F.lit(" \n")).alias("value"))
    return seeds.seed_lines(lines)


@register(f"SELECT DISTINCT {_HOST} AS host, unnest(['/a', '/d']) AS rule FROM pages")
def robots_table(spark, sf_dir):
    files = pages(spark, sf_dir).select(urls.host(F.col("url")).alias("host")).distinct().withColumn("value", F.lit(ROBOTS))
    return seeds.robots_rules_table(files, "webloom/0.1")


@register(f"WITH {SQL} SELECT url AS src, outlink AS dst, depth + 1 AS depth FROM doc_pages WHERE depth + 1 <= 5")
def links_followed(spark, sf_dir):
    return links.followed(doc_pages(spark, sf_dir), "site.example", AuditConfig(max_depth=5))


@register(f"WITH {SQL} SELECT url, status_code FROM doc_pages WHERE url = (SELECT max(url) FROM doc_pages)")
def page_lookup(spark, sf_dir):
    rows = doc_pages(spark, sf_dir)
    return links.lookup(rows, rows.agg(F.max("url")).first()[0]).select("url", "status_code")


@register(f"WITH {SQL} SELECT url, 'Article' AS types, 'https://schema.org' AS contexts FROM doc_pages WHERE has_schema")
def schema_summary(spark, sf_dir):
    rows = doc_pages(spark, sf_dir).where(F.size("schema_json_ld") > 0)
    return rows.select("url", structured.summary(structured.combined(F.col("schema_json_ld"))).alias("s")).select("url", "s.types", "s.contexts")


@register(
    f"WITH {SQL} SELECT url, CASE doc_id % 5 WHEN 0 THEN 'Article + Unknown + Person, Place' WHEN 1 THEN 'WebPage' WHEN 2 THEN 'A + B' WHEN 3 THEN 'Unknown (Invalid JSON)' ELSE 'Unknown' END AS types, "
    "CASE doc_id % 5 WHEN 0 THEN 'https://schema.org + schema.org + x' WHEN 1 THEN 'c' || doc_id WHEN 2 THEN 'schema.org + schema.org' WHEN 3 THEN 'Unknown' ELSE 'schema.org' END AS contexts FROM doc_pages"
)
def schema_summary_arrays(spark, sf_dir):
    """Blocks of every form: an array of items with an array in it, one item, two blocks, none that is valid, no type."""
    i = F.regexp_extract("url", r"(\d+)$", 1).cast("long")
    several = F.array(F.lit('[{"@type":"Article","@context":"https://schema.org"},{"name":"n"},[{"@type":"Person","@context":"x"},{"@type":"Place"}]]'))
    one = F.array(F.lit("{broken"), F.concat(F.lit('{"@type":"WebPage","@context":"c'), i.cast("string"), F.lit('"}')))
    blocks = F.when(i % 5 == 0, several).when(i % 5 == 1, one).when(i % 5 == 2, F.array(F.lit('{"@type":"A"}'), F.lit('{"@type":"B"}'))).when(i % 5 == 3, F.array(F.lit("{broken"))).otherwise(F.array(F.lit('{"@type":["T"]}')))
    return doc_pages(spark, sf_dir).select("url", structured.summary(F.coalesce(structured.combined(blocks), F.lit("{"))).alias("s")).select("url", "s.types", "s.contexts")


@register(
    f"WITH {SQL} SELECT m AS message, count(*) AS pages FROM (SELECT unnest(CASE WHEN len(ms) = 0 THEN ['{audit.SOCIAL_FINE}'] ELSE ms END) AS m FROM (SELECT list_filter([CASE WHEN og_title IS NULL THEN '{audit.OG_TITLE_MISSING}' WHEN og_title <> title THEN '{audit.OG_TITLE_OTHER}' END, "
    f"CASE WHEN og_description IS NULL THEN '{audit.OG_DESCRIPTION_MISSING}' WHEN og_description <> meta_desc THEN '{audit.OG_DESCRIPTION_OTHER}' END, CASE WHEN og_image IS NULL THEN '{audit.OG_IMAGE_MISSING}' END, CASE WHEN twitter_card IS NULL THEN '{audit.CARD_MISSING}' END], lambda x: x IS NOT NULL) AS ms FROM doc_pages)) GROUP BY m"
)
def social_summary(spark, sf_dir):
    return dashboard.social_summary(doc_pages(spark, sf_dir))


# Text mining.

_CLEAN = r"lower(regexp_replace({}, '[^\p{{L}}\p{{M}}\p{{N}}]', ' ', 'g'))"
_TOKENS = r"list_filter(regexp_split_to_array(" + _CLEAN + r", '\s+'), lambda t: t <> '')"
_STOPS = "(" + ", ".join(f"'{w}'" for w in dict.fromkeys(text.STOP_WORDS)) + ")"
_HEADING_TEXT = "coalesce(title, '') || ' ' || coalesce(h1, '') || ' ' || coalesce(h1, '')"


def _grams(rows: str, value: str, keys: str) -> str:
    """SQL: one row (keys, toks, i, n, g) per gram of 1 to 4 tokens."""
    return f"SELECT {keys}, len(toks) AS size, n, toks[i : i + n - 1] AS g FROM (SELECT {keys}, toks, unnest(range(1, len(toks) + 1)) AS i FROM (SELECT {keys}, {_TOKENS.format(value)} AS toks FROM {rows})), (SELECT unnest([1, 2, 3, 4]) AS n) WHERE i + n - 1 <= len(toks)"


_ENDS = f"g[1] NOT IN {_STOPS} AND g[-1] NOT IN {_STOPS}"
_NGRAMS = f"WITH {SQL}, grams AS ({_grams('doc_pages', _HEADING_TEXT, 'status_code')}) SELECT array_to_string(g, ' ') AS phrase, n AS length, count(*) AS frequency FROM grams WHERE status_code BETWEEN 200 AND 299 AND {_ENDS} AND len(list_filter(g, lambda t: strlen(t) < 2)) = 0 AND strlen(array_to_string(g, ' ')) >= 3 GROUP BY 1, 2 HAVING count(*) > 1"


@register(f"{_NGRAMS} ORDER BY frequency DESC, phrase LIMIT 200")
def ngram_top200(spark, sf_dir):
    return mining.top_ngrams(doc_pages(spark, sf_dir))


@register(f"SELECT length, count(*) AS phrases, CAST(sum(frequency) AS BIGINT) AS total FROM ({_NGRAMS}) GROUP BY length")
def ngram_by_len(spark, sf_dir):
    return mining.ngrams(doc_pages(spark, sf_dir)).groupBy("length").agg(F.count("*").alias("phrases"), F.sum("frequency").alias("total"))


@register(f"{_NGRAMS} ORDER BY frequency DESC, phrase LIMIT 200")
def ngram_heavy(spark, sf_dir):
    """The same by a sketch of frequent phrases and an exact count of those it names."""
    return mining.heavy_ngrams(doc_pages(spark, sf_dir))


_KEYWORDS = f"keywords AS (SELECT DISTINCT url, array_to_string(g, ' ') AS keyword FROM ({_grams('(SELECT url, unnest([coalesce(title, chr(32)), coalesce(h1, chr(32))]) AS field FROM doc_pages WHERE status_code BETWEEN 200 AND 299 AND indexable)', 'field', 'url')}) WHERE {_ENDS} AND strlen(array_to_string(g, ' ')) >= 4 AND ((n = 1 AND size = 1) OR (n > 1 AND len(list_filter(g, lambda t: strlen(t) < 2)) = 0)))"


@register(f"WITH {SQL}, {_KEYWORDS} SELECT url, keyword FROM keywords")
def candidate_keywords(spark, sf_dir):
    return mining.candidate_keywords(doc_pages(spark, sf_dir))


_STRIPPED = r"regexp_replace(coalesce(markdown, ''), '\[([^\]]*)(?:\]|\z)(?:\([^)]*(?:\)|\z))?|[*_`#]', '\1', 'g')"


_OPPORTUNITIES = (
    f"WITH {SQL}, {_KEYWORDS}, bodies AS (SELECT url, {_HEADING_TEXT} || ' ' || {_STRIPPED} AS body FROM doc_pages WHERE status_code BETWEEN 200 AND 299), "
    f"phrases AS (SELECT DISTINCT url, array_to_string(g, ' ') AS phrase FROM ({_grams('bodies', 'body', 'url')})), "
    # Other than words and spaces becomes #, so a hit is the phrase between two of space and #.
    r"marked AS (SELECT url, body AS whole, '#' || regexp_replace(lower(body), '[^\p{L}\p{M}\p{N} ]', '#', 'g') || '#' AS body FROM bodies), "
    "hits AS (SELECT p.url, p.phrase FROM (SELECT url, phrase FROM phrases SEMI JOIN keywords ON phrase = keyword) p JOIN marked b ON p.url = b.url "
    "WHERE contains(b.body, ' ' || p.phrase || ' ') OR contains(b.body, '#' || p.phrase || ' ') OR contains(b.body, ' ' || p.phrase || '#') OR contains(b.body, '#' || p.phrase || '#')), "
    "pairs AS (SELECT h.url AS source_url, k.url AS target_url, h.phrase AS keyword, row_number() OVER (PARTITION BY h.url, k.url ORDER BY len(string_split(h.phrase, ' ')) DESC, h.phrase) AS r FROM hits h JOIN keywords k ON h.phrase = k.keyword WHERE h.url <> k.url), "
    "chances AS (SELECT source_url, target_url, keyword FROM pairs ANTI JOIN doc_pages ON source_url = doc_pages.url AND target_url = outlink WHERE r = 1) "
)


@register(_OPPORTUNITIES + "SELECT * FROM chances")
def link_opportunities(spark, sf_dir):
    return mining.link_opportunities(doc_pages(spark, sf_dir), context=False)


_MARKUP = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')"


@register(
    _OPPORTUNITIES + ", places AS (SELECT source_url, keyword, whole, least(" + ", ".join(f"nullif(instr(body, '{x}' || keyword || '{y}'), 0)" for x in " #" for y in " #") + ") AS hit FROM (SELECT DISTINCT source_url, keyword FROM chances) JOIN marked ON url = source_url) "
    f"""SELECT source_url AS "Source URL", target_url AS "Target URL", keyword AS "Keyword", '...' || {_MARKUP.format("substr(whole, greatest(hit - 35, 1), hit - greatest(hit - 35, 1) + length(keyword) + 35)")} || '...' AS "Context" FROM chances JOIN places USING (source_url, keyword)"""
)
def link_opportunities_context(spark, sf_dir):
    return export.opportunities_table(mining.link_opportunities(doc_pages(spark, sf_dir)))


@register(f"WITH {SQL} SELECT url, {_STRIPPED} AS plain FROM doc_pages")
def strip_markdown(spark, sf_dir):
    return doc_pages(spark, sf_dir).select("url", text.strip_markdown(F.coalesce("markdown", F.lit(""))).alias("plain"))


# Tree.

_SEGMENTS = "list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')"
_FOLDERS = f"placed AS (SELECT *, CASE WHEN len(s) > 0 AND (contains(s[-1], '.') OR url NOT LIKE '%/') THEN s[: len(s) - 1] ELSE s END AS parts FROM (SELECT *, {_SEGMENTS} AS s FROM {{}}))"
_ROLLUP = _FOLDERS + ", above AS (SELECT parts, status_code, unnest(range(0, len(parts) + 1)) AS lvl FROM placed), tree AS (SELECT CASE WHEN lvl = 0 THEN '/' ELSE '/' || array_to_string(parts[:lvl], '/') || '/' END AS path, CAST(lvl AS INT) AS depth, CASE WHEN lvl = 0 THEN 'Root' ELSE parts[lvl] END AS name, count(*) AS pages, count(*) FILTER (coalesce(status_code, 0) >= 400) AS errors, count(*) FILTER (len(parts) = lvl) AS direct_pages FROM above GROUP BY ALL)"


@register(f"WITH {SQL}, {_ROLLUP.format('doc_pages')} SELECT * FROM tree")
def dir_rollup(spark, sf_dir):
    return tree.rollup(doc_pages(spark, sf_dir))


@register(f"WITH p AS (SELECT url, CAST(NULL AS INT) AS status_code FROM pages), {_ROLLUP.format('p')} SELECT * FROM tree")
def dir_rollup_pages(spark, sf_dir):
    return tree.rollup(pages(spark, sf_dir).select("url", F.lit(None).cast("int").alias("status_code")))


@register(f"WITH {SQL}, {_ROLLUP.format('doc_pages')}, up AS (SELECT regexp_replace(path, '[^/]+/$', '') AS path, count(*) AS n FROM tree WHERE path <> '/' GROUP BY 1) SELECT path, coalesce(n, 0) AS subfolders, direct_pages FROM tree LEFT JOIN up USING (path)")
def dir_children(spark, sf_dir):
    return tree.children(tree.rollup(doc_pages(spark, sf_dir)))


_SHOWN = "shown AS (SELECT *, CASE WHEN len(parts) = 0 THEN '/' ELSE '/' || array_to_string(parts, '/') || '/' END AS folder, row_number() OVER (PARTITION BY parts ORDER BY url) AS rank FROM placed QUALIFY rank <= 25)"


@register(f"WITH {SQL}, {_FOLDERS.format('doc_pages')}, {_SHOWN} SELECT folder, url, rank FROM shown")
def top_pages_per_folder(spark, sf_dir):
    return tree.shown_pages(doc_pages(spark, sf_dir)).select("folder", "url", "rank")


_LAYOUT = (
    f"WITH {SQL}, {_ROLLUP.format('doc_pages')}, {_SHOWN}, nodes AS (SELECT 'folder' AS kind, path, NULL AS url, depth, pages, replace(CASE WHEN path = '/' THEN '' ELSE substr(path, 2) END, '/', chr(1)) AS key, 0 AS rank FROM tree "
    "UNION ALL SELECT 'page', folder, url, len(parts) + 1, 1, replace(CASE WHEN folder = '/' THEN '' ELSE substr(folder, 2) END, '/', chr(1)) || chr(1114111), rank FROM shown), "
    "placed2 AS (SELECT *, row_number() OVER (ORDER BY key, rank) - 1 AS idx, sum(CASE WHEN kind = 'folder' AND path = '/' THEN 0.0 WHEN kind = 'folder' THEN 65.0 ELSE 36.0 END) OVER (ORDER BY key, rank ROWS UNBOUNDED PRECEDING) AS y FROM nodes), "
    "f AS (SELECT *, max(CASE WHEN kind = 'folder' THEN idx END) OVER (PARTITION BY path) AS fi, depth - CASE WHEN kind = 'page' THEN 1 ELSE 0 END AS fd FROM placed2), "
    "a AS (SELECT *, fd * 0.7::DOUBLE + fi * 0.45::DOUBLE + CASE WHEN kind = 'page' THEN (rank - 1) * 0.15::DOUBLE ELSE 0 END AS theta, fmod(fi * 0.35::DOUBLE, pi()) AS phi, 140.0::DOUBLE + fd * 90 + CASE WHEN kind = 'page' THEN 60 ELSE 0 END AS r FROM f) "
)


@register(_LAYOUT + "SELECT kind, path, url, idx, CAST(depth * 240.0 - 450.0 AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, round(CASE WHEN kind = 'page' THEN 6.0 ELSE least(35.0, 12.0 + sqrt(pages) * 2.2) END, 6)::DOUBLE AS radius FROM a")
def layout_2d(spark, sf_dir):
    return tree.layout(doc_pages(spark, sf_dir)).select("kind", "path", "url", "idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.round("radius", 6).alias("radius"))


@register(_LAYOUT + "SELECT idx FROM a WHERE contains(lower(path), 'src1') OR contains(lower(coalesce(url, '')), 'src1')")
def node_search(spark, sf_dir):
    return tree.layout(doc_pages(spark, sf_dir)).where(tree.node_search("SRC1")).select("idx")


@register(_LAYOUT + "SELECT idx FROM a WHERE power(depth * 240.0 - 450.0 + 210, 2) + power(y - 65, 2) <= power(greatest(CASE WHEN kind = 'page' THEN 6.0 ELSE least(35.0, 12.0 + sqrt(pages) * 2.2) END, 12.0), 2) ORDER BY idx LIMIT 1")
def hit_test(spark, sf_dir):
    """What is under one point; one node is the feature."""
    return tree.hit_test(tree.layout(doc_pages(spark, sf_dir)), -210.0, 65.0).select("idx")


@register(_LAYOUT + "SELECT idx FROM a WHERE depth * 240.0 - 450.0 BETWEEN -50 AND 850 AND y BETWEEN -50 AND 650")
def in_view(spark, sf_dir):
    nodes = tree.layout(doc_pages(spark, sf_dir))
    return nodes.where(F.col("idx") >= 0).transform(lambda n: tree.in_view(n, 800.0, 600.0)).select("idx")


@register(f"WITH {SQL}, {_ROLLUP.format('doc_pages')} SELECT path FROM tree")
def folder_prefixes(spark, sf_dir):
    return tree.prefixes(doc_pages(spark, sf_dir))


@register(f"WITH {SQL}, {_ROLLUP.format('doc_pages')}, open AS (SELECT path FROM tree WHERE depth < 2) SELECT path, depth < 2 AS opened FROM tree WHERE depth <= 2")
def layout_partly_open(spark, sf_dir):
    """Folders that are drawn if those of the two upper levels are open."""
    rows = doc_pages(spark, sf_dir)
    some = tree.rollup(rows).where("depth < 2").select("path")
    return tree.layout(rows, expanded=some).where("kind = 'folder'").select("path", F.col("label").endswith("[-]").alias("opened"))


@register(_LAYOUT + "SELECT idx, round(r * sin(phi) * cos(theta), 4) + 0.0 AS x3, round(r * sin(phi) * sin(theta), 4) + 0.0 AS y3, round(r * cos(phi), 4) + 0.0 AS z3 FROM a")
def layout_3d(spark, sf_dir):
    return tree.layout(doc_pages(spark, sf_dir)).select("idx", *((F.round(c, 4) + 0.0).alias(c) for c in ("x3", "y3", "z3")))


@register(_LAYOUT + "SELECT h.idx AS source, b.idx AS target FROM a b JOIN a h ON h.kind = 'folder' AND h.path = CASE WHEN b.kind = 'page' THEN b.path WHEN b.path = '/' THEN NULL ELSE regexp_replace(b.path, '[^/]+/$', '') END")
def layout_edges(spark, sf_dir):
    return tree.layout_edges(tree.layout(doc_pages(spark, sf_dir)))


_LABEL = "CASE WHEN strlen(p) > 30 THEN '...' || right(p, 28) ELSE p END"


@register(
    _LAYOUT + f", seen AS (SELECT a.*, r * sin(phi) * cos(theta) AS x3, r * sin(phi) * sin(theta) AS y3, r * cos(phi) AS z3, t.name, t.errors, d.status_code, d.indexable, {_PATH.replace('url', 'a.url')} AS p FROM a LEFT JOIN tree t ON a.kind = 'folder' AND t.path = a.path LEFT JOIN doc_pages d ON a.url = d.url), "
    "turned AS (SELECT *, x3 * cos(0.5) + z3 * sin(0.5) AS x1, z3 * cos(0.5) - x3 * sin(0.5) AS z1 FROM seen), tilted AS (SELECT *, y3 * cos(0.25) - z1 * sin(0.25) AS y2, y3 * sin(0.25) + z1 * cos(0.25) AS z2 FROM turned), "
    "scaled AS (SELECT *, CASE WHEN z2 + 600 > 50 THEN 600 / (z2 + 600) ELSE 0.1::DOUBLE END AS scale FROM tilted) "
    "SELECT idx, CASE WHEN kind = 'folder' THEN CASE WHEN errors > 0 THEN 'folder_error' ELSE 'folder_ok' END WHEN status_code IS NULL THEN 'none' WHEN status_code BETWEEN 200 AND 299 THEN CASE WHEN indexable THEN 'ok' ELSE 'not_indexable' END WHEN status_code BETWEEN 300 AND 399 THEN 'redirect' ELSE 'error' END AS colour, "
    f"CASE WHEN kind = 'page' THEN {_LABEL} ELSE CASE WHEN path = '/' THEN 'Root (/)' ELSE name END || ' (' || pages || ') [-]' END AS label, "
    "round(x1 * scale, 4) + 0.0 AS proj_x, round(y2 * scale, 4) + 0.0 AS proj_y, round(z2, 4) + 0.0 AS proj_z, round(scale, 6) + 0.0 AS proj_scale, path = '/' OR (kind = 'folder' AND pages >= 28) AS label_shown, row_number() OVER (ORDER BY z2, idx) AS paint FROM scaled"
)
def layout_projected(spark, sf_dir):
    """What a camera sees, in the order it is painted in."""
    nodes = tree.painted(tree.projected(tree.layout(doc_pages(spark, sf_dir)), 0.5, 0.25))
    rounded = [(F.round(c, 6 if c == "proj_scale" else 4) + 0.0).alias(c) for c in ("proj_x", "proj_y", "proj_z", "proj_scale")]
    return nodes.select("idx", tree.colour().alias("colour"), "label", *rounded, tree.label_shown(F.lit(1000)).alias("label_shown"), "paint")


# Exports.


def _line(column: str) -> str:
    return rf"regexp_replace(coalesce({column}, ''), '\r?\n', ' ', 'g')"


#: The main table's columns in SQL, in order.
_MAIN = {
    "Address": "url", "Status Code": "CAST(status_code AS VARCHAR)", "Error Message": "''", "Indexable": "CAST(indexable AS VARCHAR)", "Indexability": "CASE WHEN indexable THEN 'Indexable' ELSE 'Other' END",
    "Title": _line("title"), "Title Length": f"CAST(length({_line('title')}) AS VARCHAR)", "Meta Description": _line("meta_desc"), "Meta Length": f"CAST(length({_line('meta_desc')}) AS VARCHAR)",
    "H1": _line("h1"), "H1 Count": "CAST(h1_count AS VARCHAR)", "H2": _line("h2"), "H2 Count": "CAST(h2_count AS VARCHAR)", "Word Count": "CAST(word_count AS VARCHAR)", "Size (Bytes)": "CAST(size_bytes AS VARCHAR)", "Canonical": "coalesce(canonical, '')",
    "Depth": "CAST(depth AS VARCHAR)", "Response Time (ms)": "CAST(response_time_ms AS VARCHAR)", "Inlinks": "''", "Outlinks": "outlink",
    "Images": "CASE image_kind WHEN 0 THEN '' WHEN 1 THEN '/img/' || doc_id || '.png' WHEN 2 THEN '/img/' || doc_id || '.png (alt: )' ELSE '/img/' || doc_id || '.png (alt: a picture)' END",
    "OG Title": _line("og_title"), "OG Description": "coalesce(og_description, '')", "OG Image": "coalesce(og_image, '')", "OG URL": "''", "OG Type": "'article'", "Twitter Title": "''", "Twitter Description": "''", "Twitter Image": "''", "Twitter Card": "coalesce(twitter_card, '')",
    "Schema Errors": "CASE WHEN has_errors THEN 'Missing ''@type'' property.' ELSE '' END", "Headings": "CASE WHEN h1 IS NULL THEN '' ELSE 'H1: ' || h1 END", "Markdown": r"regexp_replace(markdown, '\r?\n', chr(13) || chr(10), 'g')",
    "Schema": """CASE WHEN has_schema THEN '{"@context":"https://schema.org","@type":"Article"}' ELSE '' END""",
}


@register(f"WITH {SQL} SELECT " + ", ".join(f'{v} AS "{k}"' for k, v in _MAIN.items()) + " FROM doc_pages")
def csv_projection(spark, sf_dir):
    return export.main_table(doc_pages(spark, sf_dir))


@register(f"WITH {SQL} SELECT outlink AS target FROM doc_pages")
def outlinks_export(spark, sf_dir):
    return export.outlinks_table(doc_pages(spark, sf_dir)).select(F.col("Destination Outlink URL").alias("target"))


@register(f"WITH {SQL} SELECT b.url AS source FROM (SELECT DISTINCT url FROM doc_pages) a JOIN (SELECT DISTINCT url, outlink FROM doc_pages) b ON b.outlink = a.url")
def inlinks_export(spark, sf_dir):
    rows = doc_pages(spark, sf_dir)
    return export.inlinks_table(links.with_inlinks(rows, links.edges(rows))).select(F.col("Source Inlink URL").alias("source"))


@register(f"WITH {SQL} SELECT url, CASE WHEN h1 IS NULL THEN '' ELSE 'H1: ' || h1 || chr(10) END AS outline FROM doc_pages")
def outline_export(spark, sf_dir):
    return doc_pages(spark, sf_dir).select("url", export.outline().alias("outline"))


@register(f"WITH {SQL} SELECT '/img/' || doc_id || '.png' AS src, CASE image_kind WHEN 3 THEN 'a picture' ELSE '' END AS alt FROM doc_pages WHERE image_kind <> 0")
def images_export(spark, sf_dir):
    return export.images_table(doc_pages(spark, sf_dir)).select(F.col("Image Source URL").alias("src"), F.col("Alt Text").alias("alt"))


@register(f"WITH {_SLUG}, {_MARKDOWN} SELECT slug || '.md' AS name, max(url) AS url, max_by(markdown, url) AS markdown, count(*) > 1 AS collides FROM markdowns JOIN slugs USING (page_id) GROUP BY slug")
def markdown_export(spark, sf_dir):
    return export.markdown_files(extract.to_markdown_pages(pages(spark, sf_dir)))


@register(f"WITH {SQL} SELECT url, title, markdown, len(markdown) AS size, image_kind <> 0 AS images FROM doc_pages")
def project_round_trip(spark, sf_dir):
    """Pages as a project in parts, read back record by record."""
    rows, path = doc_pages(spark, sf_dir), new_path(spark, "project")
    whole = rows.select(*(F.col(f.name) if f.name in rows.columns else schema.default_of(f).alias(f.name) for f in schema.CRAWL.fields))
    stats = dashboard.status_classes(whole).withColumn("discovered", F.lit(0).cast("long"))
    seeds.write_project(whole, "https://site.example", AuditConfig(), stats, path)
    back = seeds.read_project(spark, path)[2]
    return back.select("url", "title", "markdown", F.char_length("markdown").cast("long").alias("size"), (F.size("images") > 0).alias("images"))


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """The pages laid out by host in three batches, which is the order a stream takes them in."""
    store.register(spark)
    rows, path = pages(spark, sf_dir), new_path(spark, "responses")
    for k in range(3):
        store.layout(rows.where(F.col("page_id") % 3 == k), path, k, 4)
    return path


_RESPONSES = "SELECT regexp_replace(url, '#.*$', '') AS url, CAST(200 AS INT) AS status_code, CAST(strlen(html) AS BIGINT) AS size FROM pages"


@register(_RESPONSES)
def responses_read(spark, sf_dir):
    """Stored responses through the data source, a partition for each file of a host bucket."""
    read = spark.read.format("webloom_responses").load(_stored(spark, sf_dir))
    return read.select("url", "status_code", F.octet_length("body").cast("long").alias("size"))


@register(_RESPONSES)
def responses_stream(spark, sf_dir):
    """The same as a stream: offsets are counts of files, and a micro-batch takes at most three."""
    read = spark.readStream.format("webloom_responses").option("maxFilesPerTrigger", 3).load(_stored(spark, sf_dir))
    return streams.drain(read.select("url", "status_code", F.octet_length("body").cast("long").alias("size")), bounded=False)


@register(f"WITH {_SLUG}, {_MARKDOWN} SELECT slug || '.md' AS name, sha256(max_by(markdown, url)) AS digest FROM markdowns JOIN slugs USING (page_id) GROUP BY slug")
def markdown_stored(spark, sf_dir):
    """Markdown files as they are in the folder they were exported to."""
    path = new_path(spark, "markdown")
    export.store_markdown(extract.to_markdown_pages(pages(spark, sf_dir)), path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.try_url_decode(name).alias("name"), F.sha2(F.col("content"), 256).alias("digest"))


# Events and streams.

_TUMBLING = "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"


def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


@register(_TUMBLING)
def events_tumbling(spark, sf_dir):
    return _ntz(streams.tumbling(streams.timed(table(spark, sf_dir, "events")))).withColumn("value", F.round("value", 4))


@register("WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def events_session(spark, sf_dir):
    return _ntz(streams.sessions(streams.timed(table(spark, sf_dir, "events"))))


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def events_props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


#: Micro-batches that a stream of a table comes in.
PARTS = 5


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of PARTS micro-batches; one that is a single file is written in parts first."""
    rows = table(spark, sf_dir, name)
    files, path = len(rows.inputFiles()), f"{sf_dir}/{name}.parquet"
    if files < PARTS:
        path = new_path(spark, f"{name}-parts")
        rows.repartition(PARTS).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-files // PARTS))).parquet(path)


#: Days of arrivals in a micro-batch of _arrivals, which has six.
DAYS = 20


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as a stream in the order of arrival: six micro-batches of twenty days each, files written one after the other."""
    rows, path = table(spark, sf_dir, "clicks"), new_path(spark, "arrivals")
    batch = F.least(F.floor(F.dayofyear("arrived_at") / DAYS), F.lit(5))
    for k in range(6):
        part = rows.where(batch == k).select("ts", "client_id", F.col("kind").alias("event_type"), "value")
        part.coalesce(1).write.parquet(f"{path}/part={k}")
    return spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


#: A row is late if its window had ended by the latest time of all batches before its own, less an hour, and windows that have ended by the last are told.
_LATE = (
    f"arrived AS (SELECT *, least(dayofyear(arrived_at) // {DAYS}, 5) AS b FROM clicks WHERE ts IS NOT NULL AND arrived_at IS NOT NULL), marks AS (SELECT b, max(epoch_ms(ts)) AS top FROM arrived GROUP BY b), "
    "open AS (SELECT k AS b, coalesce((SELECT max(top) FROM marks WHERE marks.b < k) - 3600000, 0) AS mark FROM range(7) t(k)), last AS (SELECT mark AS done FROM open WHERE b = 6), "
    "judged AS (SELECT a.*, mark, done FROM arrived a JOIN open USING (b), last)"
)


@register(f"WITH {_LATE} SELECT event_type, start, n FROM (SELECT kind AS event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n, any_value(done) AS done FROM judged WHERE epoch_ms(time_bucket(INTERVAL 6 HOUR, ts)) + 21600000 > mark GROUP BY 1, 2) WHERE epoch_ms(start) + 21600000 <= done")
def closed_windows_stream(spark, sf_dir):
    """Tumbling windows of six hours that the watermark has closed, in append mode: late rows are left out, each window is told once."""
    with streams.one_watermark(spark):
        events = streams.timed(_arrivals(spark, sf_dir), "1 hour")
        return _ntz(streams.drain(streams.tumbling(events, "6 hours").select("event_type", "start", "n")))


@register(f"WITH {_LATE} SELECT b AS batch, count(DISTINCT (kind, time_bucket(INTERVAL 6 HOUR, ts))) AS late FROM judged WHERE epoch_ms(time_bucket(INTERVAL 6 HOUR, ts)) + 21600000 <= mark GROUP BY b")
def late_windows_stream(spark, sf_dir):
    """For each micro-batch with late rows, how many windows (by kind) they came too late for."""
    with streams.one_watermark(spark):
        told: list[dict] = []
        streams.drain(streams.tumbling(streams.timed(_arrivals(spark, sf_dir), "1 hour"), "6 hours"), progress=told)
        late = [(int(p["batchId"]), sum(int(o["numRowsDroppedByWatermark"]) for o in p["stateOperators"])) for p in told]
    return spark.createDataFrame([x for x in late if x[1]], "batch long, late long")


@register("SELECT kind AS event_type, time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start, count(*) AS n FROM clicks, range(4) t(k) WHERE ts IS NOT NULL GROUP BY 1, 2")
def sliding_stream(spark, sf_dir):
    """Windows of a day, one beginning every six hours, over six micro-batches."""
    return _ntz(streams.drain(streams.sliding(streams.timed(_arrivals(spark, sf_dir), None)), "complete"))


@register("WITH e AS (SELECT client_id AS user_id, ts FROM clicks WHERE ts IS NOT NULL), g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def sessions_stream(spark, sf_dir):
    """Sessions of clients over six micro-batches: those that later rows join are merged."""
    events = streams.timed(_arrivals(spark, sf_dir), None).withColumnRenamed("client_id", "user_id")
    return _ntz(streams.drain(streams.sessions(events.where("ts is not null")), "complete"))


@register("WITH " + SQL + ", flags AS (SELECT " + ", ".join(f"({p}) AS f_{n}" for n, p in PREDICATES.items()) + " FROM doc_pages) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS filter, count(*) FILTER (f_{n}) AS count FROM flags" for n in PREDICATES) + ")")
def audit_counts_stream(spark, sf_dir):
    """The audit counts kept up batch by batch, as they stand after the last one."""
    told: list[DataFrame] = []
    place = new_path(spark, "recount")
    streams.run(streams.audit_deltas(from_documents(_stream(spark, sf_dir, "documents"))), f"{place}/state", streams.recounting(f"{place}/sums", lambda counts, n: told.append(counts)))
    return told[-1].select("filter", "count")


@register("SELECT DISTINCT user_id || '/' || event_type AS url FROM events")
def dedup_stream(spark, sf_dir):
    """Each address once: a user's kind of event stands for it."""
    return streams.drain(streams.discovered(_stream(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("url"))))


@register("SELECT count(*) AS crawled, " + ", ".join(f"count(*) FILTER (event_id % 5 = {k - 2}) AS status_{k}xx" for k in (2, 3, 4, 5)) + ", count(*) FILTER (event_id % 5 = 4) AS errors FROM events")
def status_stream(spark, sf_dir):
    """Running status counters; an event's number stands for a response's status."""
    return streams.drain(streams.counters(_stream(spark, sf_dir, "events").select((200 + 100 * (F.col("event_id") % 5)).alias("status_code"))), "complete")


@register(f"WITH {SQL} SELECT a.url, (SELECT string_agg(DISTINCT b.url, ' ' ORDER BY b.url) FROM doc_pages b WHERE b.outlink = a.url) AS sources FROM doc_pages a")
def inlinks_two_streams(spark, sf_dir):
    """Pages and links as two streams; all that was told of each page."""
    documents = _stream(spark, sf_dir, "documents")
    last = streams.gathered_inlinks(streams.drain(streams.inlinks_stream(from_documents(documents), links.edges(from_documents(documents)))))
    return last.select("url", F.when(F.col("n") > 0, F.array_join("inlinks", " ")).alias("sources"))


@register("SELECT event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY event_type")
def counters_stream(spark, sf_dir):
    running = _stream(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return streams.drain(running, "complete").withColumn("value", F.round("value", 4))


@register(_TUMBLING)
def tumbling_stream(spark, sf_dir):
    return _ntz(streams.drain(streams.tumbling(streams.timed(_stream(spark, sf_dir, "events"))), "complete")).withColumn("value", F.round("value", 4))


@register(f"WITH {SQL}, u AS (SELECT * FROM doc_pages) SELECT outlink AS url, max(doc_id) AS seq, arg_max(title, doc_id) AS title FROM u GROUP BY outlink")
def grid_upsert(spark, sf_dir):
    """The last row that came for each address: here each document's link target stands for its address."""
    rows = doc_pages(spark, sf_dir).select(F.col("outlinks")[0].alias("url"), F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("seq"), "title")
    whole = streams.upsert(None, rows)
    return whole.select("url", "seq", F.col("title"))


@register(f"WITH {SQL} SELECT a.url, (SELECT string_agg(DISTINCT b.url, ' ' ORDER BY b.url) FROM doc_pages b WHERE b.outlink = a.url) AS sources FROM doc_pages a")
def inlinks_merged(spark, sf_dir):
    rows = doc_pages(spark, sf_dir)
    merged = links.with_inlinks(rows, links.edges(rows))
    return merged.select("url", F.when(F.size("inlinks") > 0, F.array_join("inlinks", " ")).alias("sources"))
