"""Extraction, Markdown, structured data and the tree underneath."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.config import AuditConfig
from webloom.sources import extract, htmltree, markdown, structured

BASIC = """<!doctype html><html><head><title> Shop  of things </title>
<META NAME="Description" content=" All the things. "><link rel="canonical" href="https://shop.example/all">
<meta name="robots" content="NOINDEX, nofollow"></head><body><h1>Things</h1><h1>More</h1><h2>Part</h2><h3> </h3>
<img src="/a.png" alt="A thing"><img src="https://cdn.example/b.png"><a href="/inside#top">in</a>
<a href="https://other.example/x">out</a><a href="mailto:a@b.example">mail</a></body></html>"""


def test_basic_fields():
    got = extract.extract("https://shop.example/start", BASIC)
    assert (got["title"], got["meta_desc"], got["canonical"], got["noindex"]) == ("Shop  of things", "All the things.", "https://shop.example/all", True)
    assert (got["h1"], got["h1_count"], got["h2"], got["h2_count"]) == ("Things", 2, "Part", 1)
    assert [h["text"] for h in got["headings"]] == ["Things", "More", "Part"]
    assert got["images"] == [{"src": "https://shop.example/a.png", "alt": "A thing", "local_path": None}, {"src": "https://cdn.example/b.png", "alt": None, "local_path": None}]
    assert got["outlinks"] == ["https://shop.example/inside", "https://other.example/x", "mailto:a@b.example"]


def test_local_queue(spark):
    rows = extract.extract_pages(spark.createDataFrame([("https://shop.example/start", BASIC)], "url string, html string"))
    local = extract.local_links(rows, "shop.example").first()["local_queue"]
    assert local == ["https://shop.example/inside"]


def test_social_tags():
    names = {"og:title": "og_title", "og:description": "og_description", "og:image": "og_image", "og:url": "og_url", "og:type": "og_type"}
    twitter = {"twitter:title": "twitter_title", "twitter:description": "twitter_description", "twitter:image": "twitter_image", "twitter:card": "twitter_card"}
    html = "".join(f'<meta property="{k}" content=" {v} ">' for k, v in names.items()) + "".join(f'<meta name="{k}" content="{v}">' for k, v in twitter.items())
    got = extract.extract("https://a.example/", html)
    assert all(got[v] == v for v in [*names.values(), *twitter.values()])


def test_json_ld():
    blocks = ['{"@context": "https://schema.org", "@type": "Article"}', '{"@type": "Thing"}', '{"@context": ']
    got = extract.extract("https://a.example/", "".join(f'<script type="application/ld+json"> {b} </script>' for b in blocks))
    assert got["schema_json_ld"] == [b.strip() for b in blocks]
    assert got["schema_errors"][0] == structured.NO_CONTEXT and got["schema_errors"][1].startswith("JSON parsing error: ")
    assert structured.check("3") == [structured.BAD_ROOT]
    assert structured.check('[1, {"@context": "https://x.example", "@graph": []}]') == [structured.BAD_ITEM, structured.OTHER_CONTEXT.format("https://x.example")]
    assert structured.check("[]") == [] and structured.check('{"@context": 1}') == [structured.NO_CONTEXT, structured.NO_TYPE]


def test_microdata():
    import json

    html = """<div itemscope itemtype="https://schema.org/Product"><span itemprop="name">Lamp</span><span itemprop="tag">a</span><i itemprop="tag">b</i>
    <div itemprop="offers" itemscope itemtype="http://schema.org/Offer"><b itemprop="price">9</b><meta itemprop="currency" content="EUR"></div></div>"""
    got = extract.extract("https://a.example/", html, AuditConfig(extract_microdata=True))["schema_json_ld"]
    assert json.loads(got[0]) == {"@context": "https://schema.org", "@type": "Product", "name": "Lamp", "tag": ["a", "b"], "offers": {"@context": "https://schema.org", "@type": "Offer", "price": "9", "currency": "EUR"}}
    assert extract.extract("https://a.example/", html)["schema_json_ld"] == []


def test_summary_and_combined(spark):
    from pyspark.sql import functions as F

    rows = [('{"@type": "A", "@context": "https://schema.org"}',), ('[{"@type": "A"}, {"@type": ["B"]}]',), ("[]",), ("nonsense",), ('{"x": 1}',)]
    got = spark.createDataFrame(rows, "b string").select(structured.summary(F.col("b")).alias("s")).collect()
    assert [tuple(r["s"]) for r in got] == [("A", "https://schema.org"), ("A + Unknown", "schema.org + schema.org"), ("Unknown (Invalid JSON)", "Unknown"), ("Unknown (Invalid JSON)", "Unknown"), ("Unknown", "schema.org")]
    arrays = spark.createDataFrame([(["{}", "x", "[1]"],), (["{}"],), (["x"],)], "a array<string>")
    assert [r["c"] for r in arrays.select(structured.combined(F.col("a")).alias("c")).collect()] == ["[{},[1]]", "{}", None]
    assert structured.pretty('{"a":1}') == '{\n  "a": 1\n}' and structured.pretty("{") == "{"


MARKDOWN = """<html><head><title>T</title></head><body><header>Top bar</header><nav>Menu</nav><main id="content"><h1>Big one</h1>
<p>Words <strong>bold</strong> and <em>slanted</em> with a <a href="https://l.example">link</a>.</p>
<ul><li>first</li><li>second<ul><li>deep</li></ul></li></ul><ol><li>one</li><li>two</li></ol>
<pre><code>a = 1
  b = 2</code></pre><blockquote>said one<br>said two</blockquote><img src="i.png" alt="Pic"><code>x</code>
<table><tr><th>k</th><th>v</th></tr><tr><td>a|b</td><td>2</td></tr></table></main><footer>Bottom</footer></body></html>"""


def test_markdown_constructs():
    got = extract.extract("https://a.example/", MARKDOWN)["markdown"]
    for part in ("# Big one", "Words **bold** and *slanted* with a [link](https://l.example).", "- first", "1. one\n\n2. two", "```\na = 1\n  b = 2\n```", "> said one\n> said two", "![Pic](i.png)", "` x `", "| k | v |\n| --- | --- |\n| a\\|b | 2 |"):
        assert part in got, part
    for part in ("Top bar", "Menu", "Bottom"):
        assert part not in got
    whole = extract.extract("https://a.example/", MARKDOWN, AuditConfig(md_only_main_content=False, md_keep_links=False, md_ignore_images=True))["markdown"]
    assert "Top bar" in whole and "](https" not in whole and "![" not in whole


def test_markdown_ignored_selectors():
    html = '<body><div class="x ads">Buy</div><div><p>Keep</p><div id="talk">Noise</div><p data-k="v">Gone</p></div></body>'
    got = extract.extract("https://a.example/", html, AuditConfig(md_only_main_content=False, md_ignored_selectors=".ads, #talk, !!, div > [data-k=v]"))["markdown"]
    assert got == "Keep"


def test_quirks():
    root = htmltree.parse("<p>one <b>two<p>three</b> four<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><script>if (a</p>b)</script>end")
    tags = [e.tag for e in root.walk()]
    assert tags.count("p") == 2 and tags.count("b") == 2 and tags.count("li") == 2 and tags.count("td") == 3 and tags.count("tr") == 2
    assert [e.text() for e in root.walk() if e.tag == "li"] == ["a", "b"]
    assert htmltree.parse("").tag == "html" and [e.tag for e in htmltree.parse("x").walk()] == ["html", "head", "body"]


def test_selectors():
    root = htmltree.parse('<div class="a b"><p id="i" lang="EN">x</p></div>')
    p = next(e for e in root.walk() if e.tag == "p")
    assert all(htmltree.selector(s)(p) for s in ("p", "#i", "div p", "div.a > p", "body .b p", '[lang="en"]', "h1, p", "*", "[id^=i]"))
    assert not any(htmltree.selector(s)(p) for s in ("div", "body > p", ".a", "[x]"))
    with pytest.raises(ValueError):
        htmltree.selector("!!")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\tab#", max_size=60))
def test_tidy_is_idempotent(text):
    once = markdown.tidy(text)
    assert markdown.tidy(once) == once and "\n\n\n" not in once


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<table>", "<tr>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "text ", "<h1>", "</h1>", "<a href=x>", "</a>", "<script>", "</script>", "<br>", "&amp;", "<!--", "-->"]), max_size=25).map("".join))
def test_any_html_is_taken(html):
    got = extract.extract("https://a.example/", html)
    assert got["word_count"] >= 0 and isinstance(got["markdown"], str)


@pytest.mark.parametrize("n", [1, 3, 4, 6])
def test_unclosed_formatting_does_not_add_up(n):
    """Of formatting elements that are alike the last three are reopened; those a cell is in do not count in it."""
    tree = htmltree.parse("<article>" + "<p><b>x" * n + "<p>y</article>")
    marks = ["**" * min(k + 1, 4) for k in range(n)]
    want = [f"{m}x{m}" for m in marks] + ["**" * min(n, 3) + "y" + "**" * min(n, 3)]
    assert markdown.to_markdown(tree, AuditConfig()).split("\n\n") == want
    mixed = htmltree.parse("<article><p><b><b class=c><b><b><b>a</b></b></b><p>z</article>")
    # The first of four alike lapses and three are closed, so the one of class c is left.
    assert [e.attrs for e in list(mixed.walk())[-2:]] == [{}, {"class": "c"}]
    cells = htmltree.parse("<b><b><b><table><tr><td><p><b>a<p>z</td></tr></table>")
    assert [e.tag for e in cells.walk()][-4:] == ["p", "b", "p", "b"]


DEEP = 100_000


@pytest.mark.parametrize("opening, closing", [("<div>", "</div>"), ("<div>", ""), ("<ul><li>", ""), ("<div itemscope itemprop=p>", "</div>"), ("<b>", ""), ("<section><p>", "")])
def test_deep_pages(opening, closing):
    """No page is too deep: neither the tree, nor the fields, nor Markdown or microdata recurse."""
    depth = DEEP if opening != "<b>" else 3000
    page = f"<title>t</title><body>{opening * depth}<h1>end</h1>{closing * depth}"
    out = extract.extract("https://a.example/", page, AuditConfig(extract_microdata=True))
    assert out["title"] == "t" and out["h1"] == "end" and "end" in out["markdown"]


@pytest.mark.parametrize("opening", ["<table><tr><td>a|b", "<blockquote>q", "<ol><li>x", "<h1>a<div>", "<table><tr><td><ul><li>x<blockquote>y<p>z", "<div><tr><td>x"])
def test_markdown_of_nested_blocks_is_linear(opening):
    page = opening * (DEEP // opening.count("<") * 2) + "end"
    got = markdown.to_markdown(htmltree.parse(page), AuditConfig())
    assert "end" in got and len(got) < 4 * len(page)
    few = markdown.to_markdown(htmltree.parse(opening * 12 + "end"), AuditConfig())
    assert "end" in few and len(few) < 60 * len(opening * 12)


def test_nested_tables_are_written_once():
    inner = "<table><tr><td>in</td><td>ner</td></tr></table>"
    got = markdown.to_markdown(htmltree.parse(f"<table><tr><td>out{inner}</td><td>er</td></tr><tr><td>last</td></tr></table>"), AuditConfig())
    assert got.count("ner") == 1 and got.startswith("| out  \\| in \\| ner \\|") and got.endswith("| er |\n| --- | --- |\n| last |")


def test_microdata_of_many_levels():
    page = "".join(f'<div itemscope itemprop="p{k}" itemtype="https://schema.org/T"><span itemprop=n>v{k}</span>' for k in range(2000))
    (block,) = structured.microdata(htmltree.parse(page))
    assert block.count('"@type"') == structured.DEEPEST + 1 and "v1999" in block


def test_batches_are_cut_by_bytes(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"url": list("abcde"), "html": ["x" * 10, None, "y" * 30, "z", "w" * 9]})
    monkeypatch.setattr(extract, "STEP_BYTES", 12)
    assert [b.column(0).to_pylist() for b in extract._steps([batch], "html")] == [["a", "b"], ["c"], ["d", "e"]]
