"""Fields of pages by column functions, against the tree's and by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_extract import BASIC
from webloom.functions import urls
from webloom.operators import markup
from webloom.schema import PARSED
from webloom.sources import extract, structured

NAMES = [f.name for f in PARSED.fields if f.name != "markdown"]
CASES = {
    "basic": BASIC,
    "empty": "",
    "text": "no tags at all &amp; 3 < 4 words",
    "raw": "<title>a &lt; b</title><script>var t = '<h1>no</h1><a href=/no>';</script><style>h1 { }</style><body>x<script>1 2</script><h1>yes</h1>",
    "comments": "<!-- <h1>no</h1> --><h1>a <!-- b > c -->d</h1>",
    "attributes": "<a href=/x/ title='it>s'>1</a><a href = \"/y\" href=/z>2</a><a\nhref='/q?a=1&amp;b=2'>3</a><a name=x>4</a><a href>5</a><A HREF=/U>6</A><img src=a.png alt><img alt=b><img src='/c d.png' alt='&quot;x&quot;'>",
    "references": "<h1>&copy; &copy2 &notit; &nosuch; &#65;&#x42; &#x1F600; &#150; &#0; &#xD800; & &; &amp;amp;</h1><a href='/?a=1&reg;'>x</a>",
    "headings": "<h1></h1><h2> a <b>b</b>c </h2><h3>x<h4>y</h4><H1>second</H1><h6>open",
    "metas": "<meta name=description content=' a '><meta name=description content=b><meta property='og:title' content='T'><meta name='twitter:card'><meta NAME=ROBOTS content='a,NoIndex'><link rel=alternate href=/no><link rel=CANONICAL href=' /c '>",
    "json_ld": "<script type='application/ld+json'> {\"@context\": \"https://schema.org\"} </script><script type=application/LD+JSON>[]</script><script type='application/ld+json'> </script>",
    "head": "<html><head><title>t</title><meta charset=utf-8></head>\n<body class=a>one<p>two three</p>fo<b>ur</b>&nbsp;five</body></html>",
    "no_body": "<title>t</title><link rel=x> \n words<p>more",
    "newlines": "<h1>a\r\nb\rc</h1>\x00<p>\x00",
    "declared": "<!DOCTYPE html><?xml version='1'?></><h1>z</h1>",
}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(k, f"https://Shop.example/a/{k}?q#f", h) for k, h in CASES.items()], "name string, url string, html string")
    return {r["name"]: r for r in markup.fields(rows).collect()}


@pytest.mark.parametrize("name", CASES)
def test_equals_the_tree(found, name):
    want = extract.extract(found[name]["url"], CASES[name], markdown=False)
    got = found[name].asDict(recursive=True)
    assert {n: got[n] for n in NAMES} == {n: want[n] for n in NAMES}


def test_text_areas_hold_text(spark):
    row = markup.fields(spark.createDataFrame([("https://a.example/", "<textarea><h1>in</h1> &amp;</textarea><h1>yes</h1>")], "url string, html string"), "headings", "word_count").first()
    assert [h["text"] for h in row["headings"]] == ["yes"] and row["word_count"] == 3


def test_comments_and_references_by_the_standard(spark):
    """Where Python's tokenizer differs: short comments, text on both sides of a comment, names before an = sign."""
    html = "<!--><h1>a<!-- b -->d</h1><!--->x<a href='/?a=1&copy=2'></a><!-- open <h1>"
    row = markup.fields(spark.createDataFrame([("https://a.example/", html)], "url string, html string"), "h1", "h1_count", "outlinks", "word_count").first()
    assert (row["h1"], row["h1_count"], row["word_count"], row["outlinks"]) == ("ad", 1, 3, ["https://a.example/?a=1&copy=2"])


def test_null_and_other_columns(spark):
    rows = spark.createDataFrame([(None, None, "x"), (None, "<a href=/rel>r</a><a href=https://b.example>b</a>", "y")], "url string, html string, tokens string")
    empty, linked = sorted(markup.fields(rows.withColumnRenamed("tokens", "label"), "title", "outlinks", "word_count").collect(), key=lambda r: r["label"])
    assert (empty["title"], empty["outlinks"], empty["word_count"]) == (None, [], 0)
    assert linked["outlinks"] == ["https://b.example/"]


@pytest.mark.parametrize("html", ["<h1>" * 50_000, "<a " + "x=1 " * 100_000 + "href=/y>", "a < b " * 100_000, "<!-- " + "-" * 300_000, "&amp;" * 100_000, "<a href='" + "/.." * 3_000 + "/z'>", "<p title='" * 20_000, "<h1 x" * 50_000], ids=["tags", "attributes", "text", "comment", "references", "dots", "quotes", "open"])
def test_long_pages_end(spark, html):
    rows = spark.createDataFrame([("https://a.example/", html)], "url string, html string")
    row = markup.fields(rows, "h1_count", "outlinks", "word_count").first()
    assert row["h1_count"] == (50_000 if html.startswith("<h1>") else 0)


def test_one_stage_without_python(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    plan = markup.fields(pages, "title", "outlinks")._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Exchange", "MapInArrow", "EvalPython", "Generate"))


def test_resolution_equals_the_other(spark):
    bases = ["https://a.example/b/c?d#e", "http://A.example:80", "https://u:p@a.example:8443/x/", "ftp://f.example/x", "mailto:x", ""]
    refs = [".", "..", "/", "x", "../..", "./a/../b/./", "a b", "?x", "#y", "//h", "//H:80/p", "https:foo", "HTTP://B.example:80/q", "https://b.example:", "javascript:void(0)", "tel:+1 2", "/\u00fc?\u00fc=%41#\u00fc", "\t/x\n", "a\\b", "/a/..", "/a/.", "/...", "http://[::1]:81/", "http://h:99999/"]
    rows = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    got = rows.select("b", "r", urls.resolved(F.col("b"), F.col("r")).alias("u")).collect()
    wrong = [(r.b, r.r, r.u, urls.resolve(r.b, r.r)) for r in got if r.u != urls.resolve(r.b, r.r)]
    assert not wrong


def test_resolution_by_the_standard(spark):
    want = {"": "http://a.example/b?c", "http:///x": "http://x/", "///x/y": "http://x/y", "a//b": "http://a.example/a//b", "HTTP://B.example:80/../q": "http://b.example/q"}
    got = spark.createDataFrame([(r,) for r in want], "r string").select("r", urls.resolved(F.lit("http://a.example/b?c#d"), F.col("r")).alias("u")).collect()
    assert {r.r: r.u for r in got} == want


def test_checks_equal_the_other(spark):
    blocks = ["{}", "[]", "[[]]", "null", '"a"', "1", '{"@context": null, "@type": null}', '{"@context": ["https://schema.org"], "@graph": []}', '[{"@context": "schema.org", "@type": "A"}, 3, {"@context": "x", "@type": "B"}]']
    got = spark.createDataFrame([(b,) for b in blocks], "b string").select("b", markup.checks(F.col("b")).alias("e")).collect()
    assert {r.b: r.e for r in got} == {b: structured.check(b) for b in blocks}
    broken = spark.createDataFrame([("{",), (json.dumps({"@type": "A"}) + "x",), ("{}]",), ("{}, {}",), ('{}, "w": 1',)], "b string").select(markup.checks(F.col("b")).alias("e")).collect()
    assert all(len(r.e) == 1 and r.e[0].startswith("JSON parsing error: ") for r in broken)
