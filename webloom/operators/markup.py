"""Fields of pages by column functions alone: a page is cut into tokens once, and every field is read from the tokens.

Nothing is exploded or moved and no Python runs on executors: titles, headings, metas, links, images, words and JSON-LD
are array expressions over one row, so a scan of the fields a query uses goes in one stage. Elements end at their own end
tag, at the next start tag that closes them, or with the page; what needs a tree (Markdown, microdata, pages
whose faults only a tree mends) is `sources.extract`. Null HTML is an empty page; a null URL resolves no relative link.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.schema import PARSED, default_of
from webloom.sources import structured
from webloom.sources.extract import METAS

_VALUE = r"""\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+"""
_PAIR = rf"([^\s/>][^\s/>=]*+)(?:{_VALUE})?+"
_ATTRIBUTES = rf"(?:[\s/]++|{_PAIR})*+"
#: Elements whose content is text up to their own end tag; of the second kind character references are read.
_RAW, _ESCAPABLE = "script|style|xmp|iframe|noembed|noframes", "title|textarea"
#: Comments, elements of raw text up to their end tag, tags, declarations, text. Loops are possessive, so that Java keeps no stack for them,
#: and what is open at the end of a page is one token, so that time follows the page.
TOKEN = "(?is)" + "|".join((
    r"<!--(?:-?>|.*?(?:--!?>|\z))",
    rf"<({_RAW}|{_ESCAPABLE})(?=[\s/>]){_ATTRIBUTES}>.*?(?=</\1[\s/>]|\z)",
    rf"</?[a-z][^\s/>]*+{_ATTRIBUTES}(?:>|\z)",
    r"<[!?/][^>]*+(?:>|\z)",
    r"(?:[^<]++|<(?![a-z/!?]))++",
    r"<",
))
_HEAD_ONLY = "html|head|base|basefont|bgsound|link|meta|noframes|script|style|template|title"
_REFERENCE = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+;?)|[^&]++|&"


def _named() -> Column:
    """The named character references of the standard, from Python's table, as one constant."""
    return F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")


def _point(n: Column) -> Column:
    """The character of a code point; what is none is U+FFFD."""
    fine = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    # References to C1 controls mean the characters of Windows-1252.
    western = n.between(128, 159) & ~n.isin(129, 141, 143, 144, 157)
    byte = F.decode(F.unhex(F.hex(n.cast("int"))), "UTF-8")
    wide = F.decode(F.unhex(F.lpad(F.hex(n.cast("int")), 8, "0")), "UTF-32")
    table = F.lit("€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ")
    return F.when(~fine | n.isNull(), "�").when(western, F.substring(table, (n - 127).cast("int"), F.lit(1))).when(n < 128, byte).otherwise(wide)


def decoded(value: Column, attribute: bool = False) -> Column:
    """Text with its character references read; in attributes a name without semicolon counts only if nothing of a name follows."""

    def numbered(p: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(p, "([0-9a-fA-F]+);?$", 1), "^0+(?=.)", "")
        number = F.when(p.rlike("^&#[xX]"), F.when(F.length(digits) <= 8, F.conv(digits, 16, 10))).when(F.length(digits) <= 9, digits)
        return urls.let(number.cast("bigint"), _point)

    def named(p: Column) -> Column:
        name = F.substring(p, F.lit(2), F.length(p))
        if attribute:
            return F.coalesce(F.try_element_at(_named(), name), p)
        # The longest name the text begins with; those that need no semicolon are two to six characters long.
        lengths = F.filter(F.array(F.length(name), *(F.lit(k) for k in range(6, 1, -1))), lambda k: k <= F.length(name))
        found = F.transform(lengths, lambda k: F.concat(F.try_element_at(_named(), F.substring(name, F.lit(1), k)), F.substring(name, k + 1, F.length(name))))
        return F.coalesce(F.get(F.array_compact(found), 0), p)

    def piece(p: Column) -> Column:
        frequent = F.when(p == "&amp;", "&").when(p == "&quot;", '"').when(p == "&lt;", "<").when(p == "&gt;", ">").when(p == "&nbsp;", "\xa0")
        return F.when(~p.startswith("&") | (p == "&"), p).when(frequent.isNotNull(), frequent).when(p.startswith("&#"), numbered(p)).otherwise(named(p))

    pattern = _REFERENCE.replace("*+;?)", r"*+(?:;|(?!=)))") if attribute else _REFERENCE

    def whole(v: Column) -> Column:
        return F.when(v.contains("&"), F.array_join(F.transform(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)), piece), "")).otherwise(v)

    return urls.let(value, whole)


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def _is(token: Column, tags: str) -> Column:
    return token.rlike(rf"(?i)^<(?:{tags})[\s/>]")


def _content(token: Column) -> Column:
    """What stands in the token of an element of raw text."""
    return F.regexp_replace(token, rf"(?is)\A<[a-z][^\s/>]*+{_ATTRIBUTES}>", "")


def text_of(token: Column) -> Column:
    """The text a token adds to the elements around it."""
    tag = token.rlike("(?i)^<[a-z/!?]")
    return F.when(_is(token, _RAW), _content(token)).when(tag & ~_is(token, _ESCAPABLE), "").otherwise(decoded(F.when(tag, _content(token)).otherwise(token)))


def _node(token: Column) -> Column:
    """A start tag as its name, its attributes' names and their values."""
    inside = F.regexp_extract(token, rf"(?is)\A<[a-z][^\s/>]*+({_ATTRIBUTES})>", 1)

    def value(v: Column) -> Column:
        return decoded(F.when(v.rlike("^[\"']"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v), True)

    return F.struct(
        F.lower(F.regexp_extract(token, r"(?i)^<([a-z][^\s/>]*)", 1)).alias("tag"),
        F.transform(F.regexp_extract_all(inside, F.lit(f"(?s){_PAIR}"), F.lit(1)), F.lower).alias("names"),
        F.transform(F.regexp_extract_all(inside, F.lit(f"(?s){_PAIR}"), F.lit(2)), value).alias("values"),
        F.when(_is(token, "script"), token).alias("raw"),
    )


def attribute(node: Column, name: str) -> Column:
    """The first attribute of this name; null if there is none, empty without a value."""
    return F.get(node["values"], (F.array_position(node["names"], F.lit(name)) - 1).cast("int"))


def tokens(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `tokens`, `nodes` (the start tags that fields are read from) and `marks` (places of heading tags)."""
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    clean = F.regexp_replace(F.translate(body, "\x00", "�"), "\r\n?", "\n")
    rows = pages.withColumn("tokens", F.regexp_extract_all(clean, F.lit(TOKEN), F.lit(0)))
    nodes = F.transform(F.filter("tokens", lambda t: _is(t, "a|img|meta|link|script")), _node)
    marks = F.transform("tokens", lambda t, i: F.when(t.rlike(r"(?i)^</?h[1-6][\s/>]") & t.endswith(">"), i))
    return rows.withColumns({"nodes": nodes, "marks": F.filter(marks, lambda i: i.isNotNull())})


def _headings() -> Column:
    """Level and text of every heading element, empty ones included: from a start tag up to the next tag of a heading."""

    def section(i: Column, k: Column) -> Column:
        level = F.regexp_extract(F.get(F.col("tokens"), i), "(?i)^<h([1-6])", 1)
        end = F.coalesce(F.get(F.col("marks"), k + 1), F.size("tokens"))
        text = stripped(F.array_join(F.transform(F.slice("tokens", i + 2, end - i - 1), text_of), ""))
        return F.when(level != "", F.struct(level.cast("int").alias("level"), text.alias("text")))

    return F.filter(F.transform("marks", section), lambda s: s.isNotNull())


def _words() -> Column:
    """Words of every text node of the body, which begins at its tag or at what may not stand in a head."""

    def begins(t: Column) -> Column:
        opened = t.rlike("(?i)^<[a-z]") & ~_is(t, _HEAD_ONLY)
        return opened | (~t.rlike("(?i)^<[a-z/!?]") & t.rlike(r"[^ \t\n\f\r]"))

    first = F.array_position(F.transform("tokens", begins), True).cast("int")
    inside = F.when(first > 0, F.slice("tokens", first, F.size("tokens"))).otherwise(F.array().cast("array<string>"))
    return F.aggregate(inside, F.lit(0).cast("long"), lambda n, t: n + F.regexp_count(text_of(t), F.lit(r"(?U)\S+")))


def _first(values: Column) -> Column:
    return F.get(values, 0)


def _meta(key: str, value: str) -> Column:
    return _first(F.filter("metas", lambda m: m[key] == value))["content"]


def checks(block: Column) -> Column:
    """What is wrong with a JSON-LD block, in the order of its items; of a block that is no JSON only that."""
    # Spark's parser takes what begins with a JSON value; between brackets and in an object only a whole value fits.
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), block, F.lit("]"))), "$", "array<variant>")
    member = F.try_parse_json(F.concat(F.lit('{"v":'), block, F.lit(',"w":0}')))
    value = F.when((F.size(alone) == 1) & member.isNotNull(), F.get(alone, 0))
    return urls.let(value, _said)


def _said(value: Column) -> Column:
    kind = F.schema_of_variant(value)

    def item(v: Column) -> Column:
        context = F.try_variant_get(v, "$['@context']", "variant")
        said = F.when(F.schema_of_variant(context) == "STRING", F.try_variant_get(v, "$['@context']", "string"))
        about = F.when(said.isNull(), structured.NO_CONTEXT).when(~said.contains("schema.org"), F.format_string(structured.OTHER_CONTEXT.replace("{}", "%s"), said))
        typed = F.try_variant_get(v, "$['@type']", "variant").isNotNull() | F.try_variant_get(v, "$['@graph']", "variant").isNotNull()
        no_object = F.array(F.lit(structured.BAD_ITEM))
        return F.when(~F.schema_of_variant(v).startswith("OBJECT"), no_object).otherwise(F.array_compact(F.array(about, F.when(~typed, structured.NO_TYPE))))

    items = F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))
    wrong = F.array(F.lit(structured.NO_JSON.format("this is not JSON")))
    root = F.array(F.lit(structured.BAD_ROOT))
    return F.when(value.isNull(), wrong).when(~kind.rlike("^(ARRAY|OBJECT)"), root).otherwise(F.flatten(F.transform(items, item)))


def _needs(pages: DataFrame, html: str, wanted: set[str]) -> DataFrame:
    """Tokens, and of what several fields share that which the wanted ones need."""
    rows = tokens(pages, html)
    if wanted & {"h1", "h1_count", "h2", "h2_count", "headings"}:
        rows = rows.withColumn("sections", _headings())
    if wanted & {*METAS, "noindex"}:
        metas = F.filter("nodes", lambda n: n["tag"] == "meta")
        rows = rows.withColumn("metas", F.transform(metas, lambda n: F.struct(F.lower(attribute(n, "name")).alias("name"), F.lower(attribute(n, "property")).alias("property"), attribute(n, "content").alias("content"))))
    if wanted & {"schema_json_ld", "schema_errors"}:
        script = F.filter("nodes", lambda n: (n["tag"] == "script") & (F.lower(attribute(n, "type")) == "application/ld+json"))
        rows = rows.withColumn("blocks", F.filter(F.transform(script, lambda n: stripped(_content(n["raw"]))), lambda b: b != ""))
    return rows


def _level(level: int) -> Column:
    return F.filter("sections", lambda s: s["level"] == level)


def _canonical() -> Column:
    found = F.filter("nodes", lambda n: (n["tag"] == "link") & (F.lower(attribute(n, "rel")) == "canonical"))
    return stripped(attribute(_first(found), "href"))


def _outlinks() -> Column:
    targets = F.transform(F.filter("nodes", lambda n: n["tag"] == "a"), lambda n: urls.without_fragment(urls.resolved(F.col("url"), attribute(n, "href"))))
    return F.filter(targets, lambda u: u.isNotNull())


def _images() -> Column:
    def picture(n: Column) -> Column:
        src = urls.let(attribute(n, "src"), lambda v: F.coalesce(urls.resolved(F.col("url"), v), v))
        return F.struct(src.alias("src"), attribute(n, "alt").alias("alt"), F.lit(None).cast("string").alias("local_path"))

    return F.transform(F.filter("nodes", lambda n: (n["tag"] == "img") & F.array_contains(n["names"], "src")), picture)


FIELDS = {
    "title": lambda: stripped(decoded(_content(_first(F.filter("tokens", lambda t: _is(t, "title") & t.contains(">")))))),
    "h1": lambda: _first(_level(1))["text"], "h1_count": lambda: F.size(_level(1)), "h2": lambda: _first(_level(2))["text"], "h2_count": lambda: F.size(_level(2)),
    "word_count": _words, "canonical": _canonical, "noindex": lambda: F.coalesce(F.lower(_meta("name", "robots")).contains("noindex"), F.lit(False)), "outlinks": _outlinks, "images": _images,
    "schema_json_ld": lambda: F.col("blocks"), "schema_errors": lambda: F.flatten(F.transform("blocks", checks)), "headings": lambda: F.filter("sections", lambda s: s["text"] != ""),
    **{field: lambda key=key: stripped(_meta(*key)) for field, key in METAS.items()},
}


def fields(pages: DataFrame, *wanted: str, html: str = "html") -> DataFrame:
    """pages (url, HTML) with the wanted PARSED fields in place of the HTML; all of them if none is named.

    `markdown` is null and microdata is not read. Of a JSON-LD block that is no JSON the message names no place in it.
    """
    chosen = [f for f in PARSED.fields if not wanted or f.name in wanted]
    rows = _needs(pages, html, {f.name for f in chosen})
    kept = [c for c in pages.columns if c != html]
    return rows.select(*kept, *(FIELDS[f.name]().cast(f.dataType.simpleString()).alias(f.name) if f.name in FIELDS else default_of(f) for f in chosen))
