"""All fields of a page in one pass over its tree, in Arrow batches."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.config import AuditConfig
from webloom.functions import urls
from webloom.schema import PARSED

from . import structured
from .htmltree import HEADINGS, Element, parse
from .markdown import ignored, to_markdown

#: Field -> (attribute that names the meta tag, its value).
METAS = {
    "meta_desc": ("name", "description"), "og_title": ("property", "og:title"), "og_description": ("property", "og:description"), "og_image": ("property", "og:image"), "og_url": ("property", "og:url"), "og_type": ("property", "og:type"),
    "twitter_title": ("name", "twitter:title"), "twitter_description": ("name", "twitter:description"), "twitter_image": ("name", "twitter:image"), "twitter_card": ("name", "twitter:card"),
}


def extract(url: str, html: str, config: AuditConfig | None = None, tests: list | None = None, markdown: bool = True) -> dict:
    """The PARSED fields of a page; links are seen from `url` itself."""
    config = config or AuditConfig()
    root = parse(html)
    out: dict = {f.name: None for f in PARSED.fields}
    out |= {"outlinks": [], "images": [], "schema_json_ld": [], "schema_errors": [], "headings": [], "noindex": False, "word_count": 0, "h1_count": 0, "h2_count": 0}
    metas: dict[tuple[str, str], Element] = {}
    seen_canonical = seen_body = False
    for e in root.walk():
        tag = e.tag
        if tag in HEADINGS:
            text = e.text().strip()
            if tag in ("h1", "h2"):
                if not out[f"{tag}_count"]:
                    out[tag] = text
                out[f"{tag}_count"] += 1
            if text:
                out["headings"].append({"level": int(tag[1]), "text": text})
        elif tag == "title":
            if out["title"] is None:
                out["title"] = e.text().strip()
        elif tag == "meta":
            for attribute in ("name", "property"):
                if attribute in e.attrs:
                    metas.setdefault((attribute, e.attrs[attribute].lower()), e)
        elif tag == "link":
            if not seen_canonical and e.attrs.get("rel", "").lower() == "canonical":
                seen_canonical = True
                out["canonical"] = e.attrs["href"].strip() if "href" in e.attrs else None
        elif tag == "body":
            if not seen_body:
                seen_body = True
                out["word_count"] = sum(len(s.split()) for s in e.strings())
        elif tag == "img":
            if "src" in e.attrs:
                out["images"].append({"src": urls.resolve(url, e.attrs["src"]) or e.attrs["src"], "alt": e.attrs.get("alt"), "local_path": None})
        elif tag == "a":
            if "href" in e.attrs and (target := urls.resolve(url, e.attrs["href"])):
                out["outlinks"].append(urls.drop_fragment(target))
        elif tag == "script" and e.attrs.get("type", "").lower() == "application/ld+json":
            block = e.text().strip()
            if block:
                out["schema_json_ld"].append(block)
                out["schema_errors"] += structured.check(block)
    for field, key in METAS.items():
        if key in metas and "content" in metas[key].attrs:
            out[field] = metas[key].attrs["content"].strip()
    robots = metas.get(("name", "robots"))
    out["noindex"] = robots is not None and "noindex" in robots.attrs.get("content", "").lower()
    if config.extract_microdata:
        out["schema_json_ld"] += structured.microdata(root)
    if markdown:
        out["markdown"] = to_markdown(root, config, tests)
    return out


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


#: Bytes of HTML that are held as fields at a time; a longer page is a step of its own.
STEP_BYTES = 1 << 23


def _steps(batches, html: str):
    """Slices of batches with at most STEP_BYTES of HTML each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(html))), 0).to_pylist()
        begin = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > STEP_BYTES:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        yield batch.slice(begin)


def extract_pages(pages: DataFrame, config: AuditConfig | None = None, html: str = "html", markdown: bool = True) -> DataFrame:
    """pages (url, HTML as text or bytes) with the PARSED fields; bytes are read as UTF-8, faulty ones replaced.

    One Python pass a page, however many fields are used; other columns of pages are kept in front.
    """
    config = config or AuditConfig()
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType([*kept, *PARSED.fields])
    parsed = _arrow(PARSED)
    names = [f.name for f in kept]

    def run(batches):
        tests = ignored(config)
        for batch in _steps(batches, html):
            index = {n: i for i, n in enumerate(batch.schema.names)}
            rows = []
            for url, body in zip(batch.column(index["url"]).to_pylist(), batch.column(index[html]).to_pylist()):
                text = body.decode("utf-8", "replace") if isinstance(body, bytes) else body or ""
                rows.append(extract(url or "", text, config, tests, markdown))
            columns = [pa.array([r[f.name] for r in rows], f.type) for f in parsed]
            yield pa.RecordBatch.from_arrays([*(batch.column(index[n]) for n in names), *columns], names=schema.names)

    return pages.mapInArrow(run, schema)


def to_markdown_pages(pages: DataFrame, config: AuditConfig | None = None) -> DataFrame:
    """url, markdown of pages (url, html)."""
    return extract_pages(pages.select("url", "html"), config).select("url", "markdown")


def local_links(parsed: DataFrame, base_domain) -> DataFrame:
    """Outlinks of a page that stay on a domain, exactly; addresses never match."""
    base = F.lit(base_domain) if isinstance(base_domain, str) else base_domain
    return parsed.withColumn("local_queue", F.filter("outlinks", lambda u: F.coalesce(urls.domain(u) == base, F.lit(False))))
