"""Schemas of the engine's tables; never inferred."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _LONG = T.StringType(), T.LongType()
STRINGS = T.ArrayType(_TEXT, False)
IMAGES = T.ArrayType(T.StructType([T.StructField("src", _TEXT, False), T.StructField("alt", _TEXT), T.StructField("local_path", _TEXT)]), False)
HEADINGS = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType(), False), T.StructField("text", _TEXT, False)]), False)


def _row(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


SOCIAL = ("og_title", "og_description", "og_image", "og_url", "og_type", "twitter_title", "twitter_description", "twitter_image", "twitter_card")

#: What one page's HTML holds.
PARSED = _row(
    ("title", _TEXT, True), ("meta_desc", _TEXT, True), ("h1", _TEXT, True), ("h1_count", _LONG, False), ("h2", _TEXT, True), ("h2_count", _LONG, False), ("word_count", _LONG, False), ("canonical", _TEXT, True), ("noindex", T.BooleanType(), False),
    ("outlinks", STRINGS, False), ("images", IMAGES, False), *((c, _TEXT, True) for c in SOCIAL), ("schema_json_ld", STRINGS, False), ("schema_errors", STRINGS, False), ("headings", HEADINGS, False), ("markdown", _TEXT, True),
)

#: One crawled URL.
CRAWL = _row(
    ("url", _TEXT, False), ("status_code", T.IntegerType(), True), ("error_message", _TEXT, True), ("indexable", T.BooleanType(), False), ("indexability_status", _TEXT, False),
    ("title", _TEXT, True), ("meta_desc", _TEXT, True), ("h1", _TEXT, True), ("h1_count", _LONG, False), ("h2", _TEXT, True), ("h2_count", _LONG, False), ("word_count", _LONG, False), ("size_bytes", _LONG, False),
    ("canonical", _TEXT, True), ("inlinks", STRINGS, False), ("outlinks", STRINGS, False), ("images", IMAGES, False), ("depth", _LONG, False), ("response_time_ms", _LONG, False), *((c, _TEXT, True) for c in SOCIAL),
    ("schema_json_ld", STRINGS, False), ("schema_errors", STRINGS, False), ("headings", HEADINGS, False), ("markdown", _TEXT, True),
)

#: A fetched response, as a fetcher returns it.
RESPONSE = _row(("url", _TEXT, False), ("status_code", T.IntegerType(), True), ("error_message", _TEXT, True), ("content_type", _TEXT, True), ("body", T.BinaryType(), True), ("response_time_ms", _LONG, True))

EDGES = _row(("src", _TEXT, False), ("dst", _TEXT, False))
OPPORTUNITY = _row(("source_url", _TEXT, False), ("target_url", _TEXT, False), ("keyword", _TEXT, False), ("context", _TEXT, False))
NGRAM = _row(("phrase", _TEXT, False), ("length", T.IntegerType(), False), ("frequency", _LONG, False))
STATS = _row(*((c, _LONG, False) for c in ("crawled", "discovered", "status_2xx", "status_3xx", "status_4xx", "status_5xx", "errors")))


def default_of(field: T.StructField) -> Column:
    """What a row that was not fetched or parsed holds in a column: null, zero, false or empty."""
    if field.nullable:
        value = F.lit(None)
    elif isinstance(field.dataType, T.ArrayType):
        value = F.array()
    elif isinstance(field.dataType, T.BooleanType):
        value = F.lit(False)
    else:
        value = F.lit(0) if field.dataType == _LONG else F.lit("")
    return value.cast(field.dataType).alias(field.name)


def failed_row(url: Column, depth: Column, status: str, message: Column) -> list[Column]:
    """The columns of a CRAWL row for a URL that gave nothing."""
    own = {"url": url, "depth": depth.cast("long"), "indexability_status": F.lit(status), "error_message": message}
    return [own[f.name].alias(f.name) if f.name in own else default_of(f) for f in CRAWL.fields]
