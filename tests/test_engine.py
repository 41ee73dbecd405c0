"""Predicates, dashboard, URLs, mining, tree, exports, crawl and streams on small fixtures."""

import csv

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom import schema
from webloom.config import AuditConfig
from webloom.functions import audit, text, urls
from webloom.operators import dashboard, links, mining, tree
from webloom.plans.crawl import Crawl
from webloom.sources import export, seeds
from webloom.streaming import events

EMPTY = {"h1_count": 0, "h2_count": 0, "word_count": 0, "size_bytes": 0, "inlinks": [], "outlinks": [], "images": [], "depth": 0, "response_time_ms": 0, "schema_json_ld": [], "schema_errors": [], "headings": [], "indexable": True, "indexability_status": "Indexable", "status_code": 200}


def crawl_rows(spark, *rows):
    full = [tuple(({**EMPTY, "url": f"https://a.example/{k}"} | r).get(f.name) for f in schema.CRAWL.fields) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, schema.CRAWL)


def hits(df, name):
    return sorted(int(r.url.rsplit("/", 1)[1]) for r in audit.matching(df, name).collect())


CASES = {
    "status_2xx": ([{"status_code": 200}, {"status_code": 299}, {"status_code": 300}, {"status_code": None}], [0, 1]),
    "status_3xx": ([{"status_code": 301}, {"status_code": 404}], [0]), "status_4xx": ([{"status_code": 404}, {"status_code": 500}], [0]), "status_5xx": ([{"status_code": 599}, {"status_code": 600}], [0]),
    "title_missing": ([{"title": None}, {"title": ""}, {"title": " "}], [0, 1]), "title_duplicate": ([{"title": "a"}, {"title": "a"}, {"title": "A"}, {"title": ""}, {"title": ""}], [0, 1]),
    "title_too_long": ([{"title": "é" * 60}, {"title": "é" * 61}, {}], [1]), "title_too_short": ([{"title": "x" * 29}, {"title": "x" * 30}, {"title": ""}], [0]),
    "desc_missing": ([{}, {"meta_desc": "x"}], [0]), "desc_duplicate": ([{"meta_desc": "d"}, {"meta_desc": "d"}, {}], [0, 1]), "desc_too_long": ([{"meta_desc": "x" * 155}, {"meta_desc": "x" * 156}], [1]), "desc_too_short": ([{"meta_desc": "x" * 69}, {"meta_desc": "x" * 70}, {}], [0]),
    "h1_missing": ([{}, {"h1": ""}, {"h1": "x"}], [0, 1]), "h1_multiple": ([{"h1_count": 1}, {"h1_count": 2}], [1]), "h1_duplicate": ([{"h1": "x"}, {"h1": "x"}, {"h1": "y"}], [0, 1]), "h2_missing": ([{}, {"h2": "x"}], [0]), "h2_multiple": ([{"h2_count": 2}, {}], [0]),
    "images_missing_alt": ([{"images": [("s", None, None)]}, {"images": [("s", "", None)]}, {"images": [("s", "a", None)]}, {}], [0, 1]), "canonical_missing": ([{}, {"canonical": ""}], [0]), "canonical_other": ([{}, {"canonical": "https://a.example/1"}, {"canonical": "/2"}], [2]),
    "og_title_missing": ([{}, {"og_title": " \t"}, {"og_title": "x"}], [0, 1]), "og_desc_missing": ([{}, {"og_description": "x"}], [0]), "schema_present": ([{}, {"schema_json_ld": ["{}"]}], [1]), "schema_errors": ([{}, {"schema_errors": ["e"]}], [1]), "all": ([{}, {}], [0, 1]),
}


@pytest.mark.parametrize("name", CASES)
def test_predicates(spark, name):
    rows, want = CASES[name]
    assert hits(crawl_rows(spark, *rows), name) == want


def test_failed_rows_match_what_is_missing(spark):
    failed = spark.createDataFrame([("https://a.example/0",)], "u string").select(*schema.failed_row(F.col("u"), F.lit(0), "Failed Connection", F.lit("why")))
    assert failed.columns == schema.CRAWL.names
    names = {n for n in audit.audit() if hits(failed, n)}
    assert names == {"all", "title_missing", "desc_missing", "h1_missing", "h2_missing", "canonical_missing", "og_title_missing", "og_desc_missing"}


def test_score_and_bands(spark):
    good = {"title": "t", "meta_desc": "d", "h1": "h", "canonical": "c"}
    score = lambda *rows: tuple(dashboard.health_score(crawl_rows(spark, *rows)).first())
    assert score({**good}) == (100, "Good")
    assert score({"status_code": 404, "images": [("s", None, None)], "schema_errors": ["e"], "title": ""}) == (32, "Poor")
    assert score(*[{**good, "title": f"t{k}"} for k in range(7)], {**good, "title": None}) == (98, "Good")
    assert dashboard.health_score(crawl_rows(spark)).first()["score"] == 100


def test_dashboard(spark):
    df = crawl_rows(spark, {"depth": 0, "word_count": 5}, {"depth": 7, "word_count": 2}, {"depth": 5, "status_code": 404}, {"status_code": None, "title": "x"})
    assert [tuple(r) for r in dashboard.depth_histogram(df).orderBy("depth").collect()] == [(0, 2), (1, 0), (2, 0), (3, 0), (4, 0), (5, 2)]
    assert tuple(dashboard.averages(df).first()) == (0, 0, 1)
    assert dashboard.status_classes(df).first().asDict() == {"crawled": 4, "status_2xx": 2, "status_3xx": 0, "status_4xx": 1, "status_5xx": 0, "errors": 1}
    issues = [tuple(r) for r in dashboard.top_issues(df).collect()]
    assert issues[0] == ("Missing Descriptions", "warning", 4) and issues[1] == ("Missing H1", "warning", 4) and len(issues) == 4
    counts = {r["filter"]: r["count"] for r in dashboard.audit_counts(df).collect()}
    assert len(counts) == 25 and counts["title_missing"] == 3 and counts["all"] == 4
    bars = dashboard.histogram_scale(dashboard.depth_histogram(df)).orderBy("depth").collect()
    assert bars[0]["bar"] == 100 and bars[1]["bar"] == 2
    p = dashboard.progress(spark.createDataFrame([(3, 10), (0, 0), (20, 10)], "crawled long, discovered long"), 6).collect()
    assert [(r.dashboard, r.toolbar) for r in p] == [(0.5, 0.5), (0.0, 0.0), (1.0, 20 / 6)]


def test_search_takes_signs_as_they_are(spark):
    df = crawl_rows(spark, {"title": "100% sure"}, {"meta_desc": "SURE_thing"}, {"status_code": 404})
    found = lambda q: df.where(audit.search(q)).count()
    assert (found("0%"), found("sure_"), found(" 404 "), found(""), found("SURE")) == (1, 1, 1, 3, 2)


def test_indexability(spark):
    rows = [(301, False, None), (200, True, "/x"), (200, False, "/x"), (200, False, "u"), (200, False, None), (None, False, None)]
    df = spark.createDataFrame(rows, "s int, n boolean, c string").withColumn("u", F.lit("u"))
    status = audit.indexability(F.lit(False), F.col("s").isNull(), F.col("s"), F.col("n"), F.col("c"), F.col("u"))
    assert [r[0] for r in df.select(status).collect()] == ["Non-200 Status Code", "Noindex", "Canonicalised", "Indexable", "Indexable", "Failed Connection"]


def test_social_messages(spark):
    fine = {"title": "t", "meta_desc": "d", "og_title": "t", "og_description": "d", "og_image": "i", "twitter_card": "c"}
    df = crawl_rows(spark, fine, {**fine, "og_title": "other", "og_image": None}, {})
    got = [r[0] for r in df.orderBy("url").select(audit.social_messages()).collect()]
    assert got[0][0].startswith("All Open Graph") and got[1] == ["Warning: og:title does not match HTML title tag.", "Missing og:image tag."] and len(got[2]) == 4


def one(spark, column, *values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, u string").orderBy("k")
    return [r[0] for r in rows.select(column).collect()]


def test_urls(spark):
    u = F.col("u")
    assert one(spark, urls.clean_seed(u), "a.example", "http://a.example", " https://a.example/x ") == ["https://a.example", "http://a.example", "https://a.example/x"]
    assert one(spark, urls.catalogue(u), "https://a.example/x/y", "https://a.example/x/", "https://a.example", "https://a.example/x", "https://a.example/x/y?q=1#f", "https://a.example/f.html", "https://a.example/x/f.html", "nonsense") == [
        "https://a.example/x/", "https://a.example/x/", "https://a.example/", "https://a.example/x/", "https://a.example/x/", "https://a.example/", "https://a.example/x/", None]
    assert one(spark, urls.slug(u), "https://a.example", "https://a.example/X/Page.One.html", "https://a.example/.hidden", "https://a.example/a%20b/", "https://a.example/für-Ö") == ["index", "page-one", "-hidden", "a-20b", "für-Ö"]
    assert one(spark, urls.domain(u), "https://A.example:8/x", "https://127.0.0.1/", "https://[::1]/", "mailto:a@b") == ["a.example", None, None, None]
    assert one(spark, urls.extension(u), "https://a.example/i.JPG?x=.gif", "https://a.example/i") == ["JPG", "png"]
    assert one(spark, urls.without_fragment(u), "https://a.example/x#y") == ["https://a.example/x"]


def test_resolution():
    base = "https://A.example:443/d/p?q"
    cases = {"x": "https://a.example/d/x", "/für a": "https://a.example/f%C3%BCr%20a", "../y": "https://a.example/y", "//b.example": "https://b.example/", "?k=v": "https://a.example/d/p?k=v", "#f": "https://a.example/d/p?q#f", "mailto:a@b.example": "mailto:a@b.example", "javascript:void(0)": "javascript:void(0)", "http://b.example:80/%7e": "http://b.example/%7e"}
    assert {k: urls.resolve(base, k) for k in cases} == cases
    assert urls.resolve(base, "http://[bad") is None


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc/.é?#% ", max_size=15))
def test_normalising_is_idempotent(tail):
    once = urls.normalise("https://a.example/" + tail)
    assert once is None or urls.normalise(once) == once


def test_robots(spark):
    rules = seeds.robots_rules("# x\nUser-agent: *\nDisallow: /private\ndisallow: /tmp # y\nDisallow:\nAllow: /\n\nUser-agent: otherbot\nDisallow: /all\n", "webloom/0.1")
    assert rules == ["/private", "/tmp # y"]
    df = spark.createDataFrame([("https://a.example/private/x?y",), ("https://a.example/public",), ("https://a.example/p?x=/private",)], "url string")
    assert [r[0] for r in df.select(links.robots_blocked(F.col("url"), rules)).collect()] == [True, False, False]
    files = spark.createDataFrame([("h", "User-agent: a\nUser-agent: *\nDisallow: /z\nUser-agent: q\nDisallow: /n")], "host string, value string")
    assert [tuple(r) for r in seeds.robots_rules_table(files, "webloom").collect()] == [("h", "/z")]


def test_text(spark):
    u = F.col("u")
    assert one(spark, text.tokens(u), "İstanbul, e-mail 5½!", "", None) == [["i̇stanbul", "e", "mail", "5½"], [], []]
    assert one(spark, text.strip_markdown(u), "a [l*nk](http://x) *b* `c` # d ![i](s) [open", "[x](y") == ["a l*nk b c  d !i open", "x"]
    assert one(spark, text.escape_markup(u), "<a & 'b\">") == ["&lt;a &amp; &#39;b&quot;&gt;"]
    assert one(spark, text.bytes_label(u.cast("long")), "1023", "1024", "1280", "1048576", "5242880") == ["1023 B", "1.0 KB", "1.2 KB", "1.0 MB", "5.0 MB"]
    assert one(spark, text.whole_word_at(u, F.lit("red car")), "a red carpet, red car.", "scarred car", "Red, car") == [15, 0, 0]
    assert one(spark, text.tail_label(u), "/short", "/" + "x" * 40) == ["/short", "..." + "x" * 28]


def py_tokens(s):
    return "".join(c.lower() if c.isalnum() else " " for c in s).split()


def brute_opportunities(rows):
    stop = set(text.STOP_WORDS)

    def keywords(field):
        w = py_tokens(field)
        out = {w[0]} if len(w) == 1 and w[0] not in stop and len(w[0].encode()) >= 4 else set()
        for n in (2, 3, 4):
            for i in range(len(w) - n + 1):
                g = w[i : i + n]
                if g[0] not in stop and g[-1] not in stop and all(len(x.encode()) >= 2 for x in g) and len(" ".join(g).encode()) >= 4:
                    out.add(" ".join(g))
        return out

    def body(r):
        import re

        plain = re.sub(r"\[([^\]]*)(?:\]|\Z)(?:\([^)]*(?:\)|\Z))?|[*_`#]", lambda m: m[1] or "", r.get("markdown") or "")
        return " ".join([r.get("title") or "", r.get("h1") or "", " ".join(h[1] for h in r.get("headings", [])), plain])

    def hit(b, k):
        low, at = b.lower(), -1
        while (at := low.find(k, at + 1)) >= 0:
            if (at == 0 or not low[at - 1].isalnum()) and (at + len(k) == len(low) or not low[at + len(k)].isalnum()):
                return True
        return False

    out = set()
    for s in rows:
        w = py_tokens(body(s))
        grams = {" ".join(w[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)}
        for t in rows:
            if s["url"] != t["url"] and t.get("indexable", True) and t["url"] not in s.get("outlinks", []):
                ks = [k for k in keywords(t.get("title") or "") | keywords(t.get("h1") or "") if k in grams and hit(body(s), k)]
                if ks:
                    out.add((s["url"], t["url"], min(ks, key=lambda k: (-len(k.split()), k))))
    return out


def test_opportunities(spark):
    base = "https://a.example/"
    rows = [
        {"url": base + "0", "title": "Red garden chairs for sale", "h1": "Garden", "markdown": "See [blue lamp shades](x) and *wood* tables. red, garden <b>"},
        {"url": base + "1", "title": "Blue lamp shades", "h1": "Lamp", "markdown": "we sell red garden chairs & more", "outlinks": []},
        {"url": base + "2", "title": "Wood tables", "h1": "Wood tables", "markdown": "nothing of the kind blue lamp", "outlinks": [base + "1"], "indexable": False, "headings": [(1, "red garden chairs")]},
        {"url": base + "3", "title": "Gone", "status_code": 404, "markdown": "red garden chairs"},
        {"url": base + "4", "title": "chairs", "h1": None, "markdown": "red-garden lamp. Blue  lamp shades"},
    ]
    got = mining.link_opportunities(crawl_rows(spark, *rows))
    found = {tuple(r)[:3]: r["context"] for r in got.collect()}
    assert set(found) == brute_opportunities([r for r in rows if r.get("status_code", 200) == 200])
    assert found[(base + "1", base + "0", "red garden chairs")] == "...Blue lamp shades Lamp  we sell <b>red garden chairs</b> &amp; more..."
    assert "<b>" not in export.opportunities_table(got).agg(F.max("Context")).first()[0]


def test_link_opportunities_move_no_pairs(spark, monkeypatch):
    """Classes of targets, split into blocks and parts, give the same pairs; no aggregate has the targets of sources as keys."""
    base = "https://shared.example/"
    lines = ["green copper kettles", "green copper kettles for tea", "oak tables"]
    rows = [{"url": base + str(k), "title": lines[k % 3], "h1": lines[k % 2] if k % 5 else None, "markdown": f"Some {lines[(k + 1) % 3]} and item{k % 4}", "outlinks": [base + str((k + 7) % 30), base + str((k + 3) % 30)], "status_code": 404 if k % 11 == 5 else 200} for k in range(30)]
    want = brute_opportunities([r for r in rows if r["status_code"] == 200])
    assert len(want) > 300
    for block, part, parts in ((1000, 50_000, 32), (3, 2, 3)):
        monkeypatch.setattr(mining, "BLOCK", block)
        monkeypatch.setattr(mining, "PART", part)
        monkeypatch.setattr(mining, "PARTS", parts)
        got = mining.link_opportunities(crawl_rows(spark, *rows), context=False)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not any("Aggregate" in line and "target_url" in line for line in plan.splitlines())
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == want
    assert {tuple(r)[:3] for r in mining.link_opportunities(crawl_rows(spark, *rows)).collect()} == want


def test_snippets_are_cut_from_what_is_around_their_words(spark):
    """Each hit has the number of its first word, so that no text is searched for each keyword; all snippets equal those of a search."""
    base = "https://snippets.example/"
    texts = [
        "green copper kettles", "  --green copper kettles", "x " * 50 + "green  copper kettles, green copper kettles" + " y" * 50, "\u0130stanbul green copper kettles \u0130 oak tables" + "." * 60,
        "Oak\ntables; oak tables\U0001f600green copper kettles" + " " * 90 + "end <a> & b", "stra\u00dfe \u03a3\u0391\u03a3 oak tables green", "\u0397 \u00e9t\u00e9 \u0394\u039f\u03a3 oak tables \u24b6b", "", "OAK TABLES" + "-" * 40 + "GREEN COPPER KETTLES",
    ]
    rows = [{"url": base + str(k), "title": ["green copper kettles", "oak tables", None][k % 3], "markdown": t, "outlinks": []} for k, t in enumerate(texts)]
    pages = crawl_rows(spark, *rows)
    bodies = pages.select("url", mining.source_text().alias("body"))
    sources = bodies.select("url", text.pieces(F.col("body")).alias("pieces"), text.tokens(F.col("body")).alias("words"))
    assert sources.join(bodies, "url").where("array_join(pieces, '') <> body").isEmpty()
    hits = mining.named_keywords(sources, mining.candidate_keywords(pages).select("keyword")).collect()
    assert {r.at == 0 for r in hits if r.url == base + "3"} == {True} and all(r.at > 0 for r in hits if r.url != base + "3") and len(hits) > 15
    got = mining.link_opportunities(pages)
    place = text.whole_word_at(F.col("body"), F.col("keyword"))
    want = got.join(bodies, F.col("source_url") == F.col("url")).select("source_url", "target_url", "keyword", "context", text.snippet(F.col("body"), place, F.char_length("keyword")).alias("searched"))
    found = want.collect()
    assert len(found) > 20 and all(r.context == r.searched for r in found)
    assert {tuple(r)[:3] for r in found} == brute_opportunities(rows)


def test_pages_that_ask_for_keywords_stay_where_they_are(spark, monkeypatch):
    """Hits come from a filter of the keywords: no page's words are dealt anew, and false alarms change nothing, however small the filter is."""
    base = "https://filter.example/"
    lines = ["green copper kettles", "green copper kettles for tea", "oak tables", "fine oak tables"]
    rows = [{"url": base + str(k), "title": lines[k % 4], "h1": lines[k % 3] if k % 5 else None, "markdown": f"Some {lines[(k + 1) % 4]} {'\u0130' * (k % 2)} and item{k % 4}, oak\ntables of the green  copper", "outlinks": [base + str((k + 7) % 20)]} for k in range(20)]
    want, plans, bucketed = brute_opportunities(rows), [], mining.Scratch.bucketed

    def seen(self, df, kind, *args, **options):
        if kind == "hits":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return bucketed(self, df, kind, *args, **options)

    monkeypatch.setattr(mining.Scratch, "bucketed", seen)
    for bits, most in ((16, 1 << 21), (0, 1 << 21), (16, 1)):
        monkeypatch.setattr(mining, "BITS", bits)
        monkeypatch.setattr(mining, "MOST_NUMBERS", most)
        found = [tuple(r)[:3] for r in mining.link_opportunities(crawl_rows(spark, *rows)).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    assert "Exchange hashpartitioning" not in plans[0] and "Exchange hashpartitioning" not in plans[1]


def test_parts_of_link_opportunities_are_tasks_of_their_own(spark, monkeypatch):
    """A task that goes through all parts of a bucket holds the tables of all of them until it ends."""
    base = "https://parts.example/"
    rows = [{"url": base + str(k), "title": f"copper kettles number{k}", "markdown": f"Some copper kettles number{(k + 1) % 12}", "outlinks": []} for k in range(12)]
    monkeypatch.setattr(mining, "PART", 2)
    monkeypatch.setattr(mining, "PARTS", 3)
    for context in (False, True):
        got = mining.link_opportunities(crawl_rows(spark, *rows), context=context)
        assert got.rdd.getNumPartitions() == 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert {tuple(r)[:3] for r in got.collect()} == brute_opportunities(rows)


def test_ngrams(spark):
    df = crawl_rows(spark, {"title": "The red fox", "h1": "Red fox", "headings": [(1, "Red fox")]}, {"title": "a b cd", "status_code": 500})
    got = {(r.phrase, r.length): r.frequency for r in mining.ngrams(df).collect()}
    assert got == {("red", 1): 3, ("fox", 1): 3, ("red fox", 2): 3, ("fox red", 2): 2, ("red fox red", 3): 2, ("fox red fox", 3): 2, ("red fox red fox", 4): 2}
    assert mining.top_ngrams(df, most=2).count() == 2


def test_tree(spark):
    df = crawl_rows(spark, {"url": "https://a.example/"}, {"url": "https://a.example/x/p.html", "status_code": 404}, {"url": "https://b.example/x/y/"}, {"url": "https://a.example/x/y", "status_code": None}, {"url": "https://a.example/x/z/?q"})
    rows = {r.path: (r.pages, r.errors, r.direct_pages, r.depth) for r in tree.rollup(df).collect()}
    assert rows == {"/": (5, 1, 1, 0), "/x/": (4, 1, 3, 1), "/x/y/": (1, 0, 1, 2)}
    assert {r.path: r.subfolders for r in tree.children(tree.rollup(df)).collect()} == {"/": 1, "/x/": 1, "/x/y/": 0}
    nodes = tree.layout(df)
    listed = [(r.kind, r.path, r.y) for r in nodes.orderBy("idx").collect()]
    assert listed == [("folder", "/", 0.0), ("folder", "/x/", 65.0), ("folder", "/x/y/", 130.0), ("page", "/x/y/", 166.0), ("page", "/x/", 202.0), ("page", "/x/", 238.0), ("page", "/x/", 274.0), ("page", "/", 310.0)]
    assert {tuple(r) for r in tree.layout_edges(nodes).collect()} == {(0, 1), (1, 2), (2, 3), (1, 4), (1, 5), (1, 6), (0, 7)}
    seen = tree.projected(nodes, 0.3, 0.1)
    assert seen.where("proj_scale <= 0").count() == 0 and tree.hit_test(nodes, -450, 3).first()["path"] == "/"
    assert nodes.where(tree.node_search("X/Y")).count() > 0 and nodes.where(tree.label_shown(F.lit(5), "auto")).count() == 3
    assert {r[0] for r in nodes.select(tree.colour()).collect()} == {"folder_error", "folder_ok", "ok", "error", "none"}
    assert tree.in_view(nodes, 100, 100).count() >= 0 and tree.prefixes(df).count() == 3


def test_csv_and_exports(spark, tmp_path):
    df = crawl_rows(spark, {"title": 'a "q"\r\nb', "images": [("s", None, None), ("t", "", None), ("v", "x\ny", None)], "outlinks": ["u", "u"], "headings": [(1, "h\nx"), (2, "y")], "markdown": "l1\nl2", "inlinks": ["i"]})
    export.write_csv(export.main_table(df), str(tmp_path / "csv"), one_file=True)
    raw = next((tmp_path / "csv").glob("*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf")
    rows = list(csv.reader(raw.decode("utf-8-sig").splitlines(keepends=True)))
    head, row = rows[0], dict(zip(rows[0], rows[1]))
    assert len(head) == 34 and head[0] == "Address" and head[-1] == "Schema"
    assert row["Title"] == 'a "q" b' and row["Title Length"] == "7" and row["Images"].split() == ["s", "t", "(alt:", ")", "v", "(alt:", "x", "y)"]
    assert row["Headings"] == "H1: h x | H2: y" and row["Indexable"] == "true" and row["OG Title"] == ""
    assert export.inlinks_table(df).count() == 1 and export.outlinks_table(df).count() == 2
    assert [tuple(r) for r in export.images_table(df).collect()] == [("s", "", ""), ("t", "", ""), ("v", "x\ny", "")]
    assert df.select(export.outline()).first()[0] == "H1: h\nx\nH2: y\n"
    stored = export.with_local_images(df, export.image_files(df).where("src = 's'")).first()["images"]
    assert stored[0]["local_path"].endswith(".png") and stored[1]["local_path"] is None


def test_markdown_files(spark, tmp_path):
    df = crawl_rows(spark, {"url": "https://a.example/x/page.html", "markdown": "one"}, {"url": "https://a.example/y/page", "markdown": "two"}, {"url": "https://a.example/none"})
    got = [tuple(r) for r in export.markdown_files(df).collect()]
    assert got == [("page.md", "https://a.example/y/page", "two", True)]
    folder = str(tmp_path)

    def put(name, body):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(body)

    assert export.write_markdown(df, put) == (1, 0) and (tmp_path / "page.md").read_text() == "two"


def test_project_round_trip(spark, tmp_path):
    df = crawl_rows(spark, {"title": "t\n\"x\"", "images": [("s", None, None)], "headings": [(2, "h")]}, {"status_code": None})
    stats = dashboard.status_classes(df).withColumn("discovered", F.lit(2).cast("long"))
    seeds.project_json(df, "https://a.example", AuditConfig(max_urls=7), stats).coalesce(1).write.text(str(tmp_path / "p"))
    seed, config, rows, got = seeds.read_project(spark, str(tmp_path / "p"))
    assert (seed, config.max_urls, got["crawled"], got["errors"]) == ("https://a.example", 7, 2, 1)
    assert sorted(map(str, rows.select(*schema.CRAWL.names).collect())) == sorted(map(str, df.collect()))
    assert "key" not in config.to_json()


def test_projects_are_read_and_written_in_parts(spark, tmp_path):
    """Lines of ours as parts and as one file, and a document indented by two spaces; records with what could be taken for borders."""
    import json

    odd = ['],\n  "stats": {', '\n    },\n    {\n', '{"seed_url": x "results": [', None, "é\u2028]"]
    df = crawl_rows(spark, *({"title": odd[k % 5], "images": [("s", None, "p")] * (k % 2), "headings": [(2, "h}")]} for k in range(200))).repartition(5)
    stats = dashboard.status_classes(df).withColumn("discovered", F.lit(9).cast("long"))
    want = sorted(map(str, df.collect()))
    folder, file = str(tmp_path / "p"), str(tmp_path / "p.json")
    seeds.write_project(df, "https://a.example", AuditConfig(max_urls=7), stats, folder, file)
    whole = json.load(open(file, encoding="utf-8"))
    assert len(whole["results"]) == 200 and whole["stats"]["crawled"] == 200
    pretty = tmp_path / "pretty.json"
    pretty.write_text(json.dumps(whole, indent=2, ensure_ascii=False), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        for path in (folder, file, str(pretty)):
            seed, config, rows, got = seeds.read_project(spark, path)
            assert (seed, config.max_urls, got["crawled"]) == ("https://a.example", 7, 200)
            assert sorted(map(str, rows.select(*schema.CRAWL.names).collect())) == want
            assert rows.groupBy(F.spark_partition_id()).count().count() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    seeds.write_project(df.limit(0), "s", AuditConfig(), stats, folder, file)
    assert json.load(open(file))["results"] == [] and seeds.read_project(spark, file)[2].count() == 0
    (tmp_path / "flat.json").write_text(json.dumps(whole))
    assert seeds.read_project(spark, str(tmp_path / "flat.json"))[2].count() == 200


SITE = {
    "https://a.example/": '<title>Home</title><a href="/one">1</a><a href="/two#x">2</a><a href="https://b.example/">b</a><a href="/secret/x">s</a>',
    "https://a.example/one": '<title>One</title><a href="/">home</a><a href="/one">self</a><a href="/three">3</a>',
    "https://a.example/two": '<meta name="robots" content="noindex"><a href="/one">1</a>',
    "https://a.example/three": "<title>Three</title>",
}


def fetcher_of(site):
    def fetch(targets):
        for url in targets:
            if url in site:
                yield {"url": url, "status_code": 200, "content_type": "text/html; charset=utf-8", "body": site[url].encode(), "response_time_ms": 3}
            else:
                yield {"url": url, "status_code": None, "error_message": "Network Error: unknown", "response_time_ms": 0}

    return fetch


def test_crawl(spark, tmp_path):
    crawl = Crawl(spark, AuditConfig(max_concurrency=2), str(tmp_path / "w"), fetcher=fetcher_of(SITE), robots=["/secret"])
    rows = {r.url: r for r in crawl.run(["a.example", "http://bad host/"]).collect()}
    base = "https://a.example/"
    assert {u: r.depth for u, r in rows.items()} == {base: 0, base + "one": 1, base + "two": 1, base + "secret/x": 1, base + "three": 2, "http://bad host/": 0}
    assert rows[base + "one"].inlinks == [base, base + "one", base + "two"]
    assert rows[base + "secret/x"].indexability_status == "Blocked by Robots.txt" and rows[base + "two"].indexability_status == "Noindex"
    assert rows["http://bad host/"].error_message == "Invalid URL: http://bad host/" and rows[base].size_bytes == len(SITE[base])
    again = crawl.run(["a.example"])
    assert again.count() == 5 and crawl.stats(again).first()["discovered"] == 5
    limited = Crawl(spark, AuditConfig(max_urls=2), str(tmp_path / "l"), fetcher=fetcher_of(SITE)).run(["a.example"])
    assert limited.count() == 2
    listed = Crawl(spark, AuditConfig(crawl_mode="List"), str(tmp_path / "m"), fetcher=fetcher_of(SITE)).run(["a.example", "a.example/one"])
    assert listed.count() == 2 and listed.where("size(inlinks) > 0").count() == 0
    shallow = Crawl(spark, AuditConfig(max_depth=1), str(tmp_path / "s"), fetcher=fetcher_of(SITE)).run(["a.example"])
    assert {r.url for r in shallow.collect()} == {base, base + "one", base + "two", base + "secret/x"}
    stored = spark.createDataFrame(list(SITE.items()), "url string, html string")
    offline = Crawl(spark, AuditConfig(include_regex="one|three", exclude_regex="(unclosed"), str(tmp_path / "o"), stored=stored).run(["a.example"])
    assert {r.url for r in offline.collect()} == {base, base + "one", base + "three"}


def test_inlinks_in_either_order(spark):
    rows = crawl_rows(spark, {"url": "t"})
    edges = spark.createDataFrame([("a", "t"), ("b", "t"), ("a", "t"), ("a", "z")], "src string, dst string")
    assert events.merge_inlinks(spark, rows, edges).first()["inlinks"] == ["a", "b"]
    newer = spark.createDataFrame([("u", 1, "x"), ("u", 2, "y"), ("v", 1, "z")], "url string, seq int, t string")
    assert {tuple(r) for r in events.upsert(None, newer).collect()} == {("u", 2, "y"), ("v", 1, "z")}


def test_streams_equal_batch(spark, sf):
    from webloom.plans import queries as q

    table = spark.read.parquet(f"{sf}/events.parquet")
    batch = events.tumbling(events.timed(table)).count()
    assert q.tumbling_stream(spark, sf).count() == batch
    assert q.dedup_stream(spark, sf).count() == table.select("user_id", "event_type").distinct().count()
    # The parts of the stream are in no order of time, so a watermark would make most rows late.
    sessions = events.sessions(events.timed(q._stream(spark, sf, "events"), None))
    late = events.drain(sessions.where("n > 0"), "complete").count()
    assert late == events.sessions(events.timed(table)).count()


def test_models_and_suggestions(spark):
    assert seeds.models('{"data": [{"id": "b"}, {"id": "a"}, {}]}') == ["a", "b"]
    asked = spark.createDataFrame([("https://a.example",)], "url string").withColumn("prompt", audit.prompt("title", F.col("url")))
    got = seeds.suggest(asked, lambda p: f" {len(p)} ").first()
    assert "https://a.example" in got["prompt"] and got["suggestion"] == str(len(got["prompt"]))


def test_seed_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text("a.example\n\n  http://b.example  \n")
    assert [r.url for r in seeds.read_seed_file(spark, str(tmp_path / "s.txt")).collect()] == ["https://a.example", "http://b.example"]


def test_analysis_can_be_called_off(spark):
    from webloom.plans import jobs

    done = jobs.Analysis(spark, lambda: spark.range(10), lambda df: df.count())
    assert done.wait(60) == "finished" and done.result == 10
    endless = jobs.Analysis(spark, lambda: spark.range(1 << 40).selectExpr("sum(id % 7) AS s"), lambda df: df.collect())
    import time

    time.sleep(2)
    assert 0 <= jobs.progress(spark) <= 1
    endless.cancel()
    assert endless.wait(20) == "cancelled"
    assert jobs.Analysis(spark, lambda: spark.range(1), lambda df: 1 / 0).wait(60) == "failed"


def test_stream_pauses_and_goes_on(spark, tmp_path):
    rows = crawl_rows(spark, {"title": "x"}).select("url", "title")
    rows.write.parquet(str(tmp_path / "in"))
    got = []
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = events.follow(stream(), str(tmp_path / "state"), lambda df, n: got.extend(df.collect()))
    query.processAllAvailable()
    query.stop()
    rows.withColumn("title", F.lit("y")).write.mode("append").parquet(str(tmp_path / "in"))
    query = events.follow(stream(), str(tmp_path / "state"), lambda df, n: got.extend(df.collect()))
    query.processAllAvailable()
    query.stop()
    assert [r.title for r in got] == ["x", "y"]


def test_json_tokens():
    from webloom.sources import structured

    text = '{"a": ["b\\"", -1.5e3, true]}'
    assert [(text[a:b], k) for a, b, k in structured.tokens(text)] == [('"a"', "key"), ('"b\\""', "string"), ("-1.5e3", "number"), ("true", "word")]


def test_robots_are_fetched(spark, tmp_path):
    """With default settings a disallowed path is a failed row, from a fetcher and from stored pages."""
    site = SITE | {"https://a.example/robots.txt": "User-agent: *\nDisallow: /secret\n"}
    asked = Crawl(spark, AuditConfig(), str(tmp_path / "f"), fetcher=fetcher_of(site)).run(["a.example"])
    stored = spark.createDataFrame(list(site.items()), "url string, html string")
    offline = Crawl(spark, AuditConfig(), str(tmp_path / "o"), stored=stored).run(["a.example"])
    for rows in (asked, offline):
        row = rows.where("url = 'https://a.example/secret/x'").first()
        assert (row.indexability_status, row.error_message, row.status_code) == ("Blocked by Robots.txt", "Blocked by Robots.txt", None)
        assert rows.where("error_message = 'Blocked by Robots.txt'").count() == 1
    free = Crawl(spark, AuditConfig(respect_robots=False), str(tmp_path / "n"), stored=spark.createDataFrame([*site.items(), ("https://a.example/secret/x", "s")], "url string, html string")).run(["a.example"])
    assert free.where("url = 'https://a.example/secret/x'").first().status_code == 200


def test_model_catalogue_is_fetched():
    def fetch(targets):
        for url in targets:
            yield {"url": url, "status_code": 200 if url == "m" else 500, "body": b'{"data": [{"id": "b"}, {"id": "a"}]}'}

    assert seeds.fetch_models(fetch, "m") == ["a", "b"] and seeds.fetch_models(fetch, "x") == []


def test_images_are_downloaded(spark, tmp_path):
    folder = str(tmp_path)

    def fetch(targets):
        for url in targets:
            yield {"url": url, "status_code": 404 if url == "t" else 200, "body": url.encode()}

    def put(path, body):
        import os

        os.makedirs(f"{folder}/images", exist_ok=True)
        with open(f"{folder}/{path}", "wb") as f:
            f.write(body)

    df = crawl_rows(spark, {"images": [("s", None, None), ("t", "", None)]}, {"url": "https://a.example/2", "images": [("s", None, None)]})
    got = export.download_images(df, fetch, put)
    (stored,) = got.collect()
    assert stored.src == "s" and (tmp_path / stored.local_path).read_bytes() == b"s"
    assert [i.local_path for r in export.with_local_images(df, got).collect() for i in r.images if i.src == "s"] == [stored.local_path] * 2


def test_labels_are_cut_by_bytes(spark):
    long = "/" + "é" * 40
    assert one(spark, text.tail_label(F.col("u")), long, long + "x", "/short") == ["..." + "é" * 14, "..." + "é" * 13 + "x", "/short"]


def test_layout_of_some_open_folders(spark):
    df = crawl_rows(spark, {"url": "https://a.example/"}, {"url": "https://a.example/x/p.html"}, {"url": "https://a.example/x/y/q.html"}, {"url": "https://a.example/z/r.html"})
    some = spark.createDataFrame([("/",), ("/x/",)], "path string")
    rows = [(r.kind, r.path, r.label) for r in tree.layout(df, expanded=some).orderBy("idx").collect()]
    assert rows == [("folder", "/", "Root (/) (4) [-]"), ("folder", "/x/", "x (2) [-]"), ("folder", "/x/y/", "y (1) [+]"), ("page", "/x/", "/x/p.html"), ("folder", "/z/", "z (1) [+]"), ("page", "/", "/")]
    shut = tree.layout(df, expanded=some.limit(0)).collect()
    assert [r.path for r in shut] == ["/"]
    drawn = tree.painted(tree.projected(tree.layout(df), 0.3, 0.1)).orderBy("paint").collect()
    assert [r.proj_z for r in drawn] == sorted(r.proj_z for r in drawn) and [r.paint for r in drawn] == list(range(1, len(drawn) + 1))


def parts_of(spark, path, batches, kind):
    """A stream that takes one batch after the other."""
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, kind).coalesce(1).write.parquet(f"{path}/part={k}")
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


def test_inlinks_of_two_streams(spark, tmp_path):
    """Links before their page, after it, again, and to no page; then the streams stop, and go on from their state."""
    rows, edges = (tmp_path / "rows", "url string"), (tmp_path / "edges", "src string, dst string")
    streams = [parts_of(spark, rows[0], [[("t",)], [("u",)], [("t",)]], rows[1]), parts_of(spark, edges[0], [[("a", "t"), ("b", "u"), ("a", "z")], [("c", "t"), ("a", "t")], [(None, "t")]], edges[1])]
    told = []
    put = lambda df, n: told.append(sorted(map(tuple, df.collect()), key=repr))
    events.run(events.inlinks_stream(*streams), str(tmp_path / "state"), put)
    assert len(told) >= 3
    assert sorted((x for batch in told for x in batch), key=repr) == sorted([("t", None), ("t", "a"), ("t", "c"), ("u", None), ("u", "b")], key=repr)
    for k, batch in enumerate([[("d", "t"), ("a", "t"), ("e", "v")]]):
        spark.createDataFrame(batch, edges[1]).coalesce(1).write.parquet(f"{edges[0]}/later={k}")
    spark.createDataFrame([("z",)], rows[1]).coalesce(1).write.parquet(f"{rows[0]}/later=0")
    told.clear()
    again = [spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path)) for path, kind in (rows, edges)]
    events.run(events.inlinks_stream(*again), str(tmp_path / "state"), put)
    assert sorted((x for batch in told for x in batch), key=repr) == sorted([("t", "d"), ("z", None), ("z", "a")], key=repr)
    got = {r.url: (r.n, r.inlinks) for r in events.gathered_inlinks(spark.createDataFrame([("t", None), ("t", "c"), ("t", "a"), ("w", None)], "url string, src string")).collect()}
    assert got == {"t": (2, ["a", "c"]), "w": (0, [])}


def test_inlinks_of_two_streams_need_no_python(spark, tmp_path):
    """Links and pages meet in a join of streams; a page with many sources, copies and nulls are told as before, whatever the order."""
    pages = [[("p0",), (None,)], [("p1",), ("p0",)], [("hot",), ("p2",)]]
    edges = [[(f"s{k}", "hot") for k in range(300)] + [("p0", "p1"), (None, "p1")], [(f"s{k}", "hot") for k in range(150, 450)] + [("p0", None), ("p1", "p1")], [("p2", "p0"), ("x", "none"), ("p2", "p0")]]
    streams = parts_of(spark, tmp_path / "pages", pages, "url string"), parts_of(spark, tmp_path / "edges", edges, "src string, dst string")
    stream = events.inlinks_stream(*streams)
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "Join Inner" in plan
    told = [tuple(r) for r in events.drain(stream).collect()]
    want = {("p0", None), ("p1", None), ("p2", None), ("hot", None), ("p1", "p0"), ("p1", "p1"), ("p0", "p2")} | {("hot", f"s{k}") for k in range(450)}
    assert len(told) == len(want) and set(told) == want


def test_audits_are_recounted_by_batch(spark, sf, tmp_path):
    """After each micro-batch the counts are those of all pages so far, also where a stream goes on from its state."""
    from webloom.plans.surrogate import doc_pages

    whole = doc_pages(spark, sf)
    rows = sorted(whole.collect(), key=lambda r: r.url)
    cut = [rows[:1], rows[1:30], rows[30:31] * 2, rows[31:120], rows[120:]]
    stream = parts_of(spark, tmp_path / "in", cut[:3], whole.schema)
    told = {}
    handle = events.recounting(str(tmp_path / "sums"), lambda counts, n: told.update({n: {r.filter: r["count"] for r in counts.collect()}}))
    events.run(events.audit_deltas(stream), str(tmp_path / "state"), handle)
    for k, batch in enumerate(cut[3:], 3):
        spark.createDataFrame(batch, whole.schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    again = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    events.run(events.audit_deltas(again), str(tmp_path / "state"), handle)
    for k in range(5):
        so_far = spark.createDataFrame([r for batch in cut[: k + 1] for r in batch], whole.schema)
        assert told[k] == {r.filter: r["count"] for r in dashboard.audit_counts(so_far).collect()}


def test_counts_without_joins_equal_flags_by_row(spark, sf):
    from webloom.plans.surrogate import doc_pages

    rows = doc_pages(spark, sf).union(doc_pages(spark, sf).limit(20))
    flagged = audit.with_value_counts(rows)
    want = {n: flagged.where(p).count() for n, (_, p) in audit.audit().items() if n in dashboard.DUPLICATES}
    got = {r.filter: r["count"] for r in dashboard.audit_counts(rows).collect()}
    assert {n: got[n] for n in want} == want
    plan = dashboard.audit_counts(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # of two rows, one each


def test_robots_of_many_hosts(spark):
    pages = spark.createDataFrame([(1, "https://A.example/x/y"), (2, "https://a.example/x"), (3, "https://b.example/x/y"), (4, "https://c.example"), (5, "no url"), (6, None), (7, "https://a.example/x/y")], "id int, url string")
    rules = spark.createDataFrame([("a.example", "/x"), ("a.example", "/x/"), ("a.example", "/x/"), ("b.example", "/y"), ("c.example", "/"), (None, "/x"), ("b.example", "")], "host string, rule string")
    got = {r.id: r.rule for r in links.robots_matches(pages, rules).collect()}
    assert got == {1: "/x/", 2: "/x", 3: None, 4: "/", 5: None, 6: None, 7: "/x/"}


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from webloom import shared

    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(SimpleNamespace(conf={}, sparkContext=context))


# Known URLs in buckets.


def test_seen_urls(spark, tmp_path):
    from webloom.operators.seen import Seen

    seen = Seen(spark, str(tmp_path / "s"), buckets=8)
    none = spark.createDataFrame([], "url string, depth long")
    assert sorted(map(tuple, seen.new(spark.createDataFrame([("u1", 3), ("u1", 2), (None, 1)], none.schema)).collect())) == [("u1", 2)]
    seen.add(none)
    seen.add(spark.range(3000).select(F.concat(F.lit("u"), "id").alias("url"), F.lit(0).alias("depth")))
    seen.add(spark.range(2990, 3500).select(F.concat(F.lit("u"), "id").alias("url"), F.lit(1).alias("depth")))
    asked = spark.range(2000, 6000).select(F.concat(F.lit("u"), "id").alias("url"), (F.col("id") % 5).alias("depth"))
    want = {(f"u{k}", k % 5) for k in range(3500, 6000)}
    assert set(map(tuple, seen.new(asked.union(asked)).collect())) == want
    # Another session finds the table by its folder.
    spark.sql(f"DROP TABLE {seen.name}")
    again = Seen(spark, str(tmp_path / "s"), buckets=8)
    assert set(map(tuple, again.new(asked).collect())) == want
    # Only the candidates are dealt anew: the bucketed side has no exchange.
    plan = again.unknown(asked.repartition(3))._jdf.queryExecution().executedPlan().toString()
    sides = plan[plan.index("Exchange hashpartitioning(url") :]
    assert plan.count("hashpartitioning") == 1 and "Bucketed: true" in sides and "SelectedBucketsCount: 8 out of 8" in sides


def test_seen_filters_let_few_through(spark, tmp_path):
    from webloom.operators.seen import Seen
    from webloom.shared import Scratch

    seen = Seen(spark, str(tmp_path / "s"), buckets=4)
    seen.add(spark.range(5000).select(F.concat(F.lit("u"), "id").alias("url"), F.lit(0).alias("depth")))
    scratch = Scratch(spark)
    seen.new(spark.range(5000, 25000).select(F.concat(F.lit("u"), "id").alias("url"), F.lit(0).alias("depth")), scratch)
    assert spark.read.parquet(scratch.paths[0]).where("maybe").count() < 400


def test_crawl_limit_takes_the_first_urls(spark):
    from webloom.plans.crawl import first_urls

    frontier = spark.range(100).select(F.format_string("u%03d", "id").alias("url"), F.lit(0).cast("long").alias("depth"))
    assert {r.url for r in first_urls(frontier, 7).collect()} == {f"u{k:03d}" for k in range(7)}
    assert first_urls(frontier, 100).count() == 100


# Sketches.


def test_heavy_ngrams_equal_the_full_count(spark, monkeypatch):
    """A few phrases that are common and many that are rare: the sketch is small, and what it names is enough."""
    common = [f"very common phrase {k}" for k in range(30)]
    titles = [c for k, c in enumerate(common) for _ in range(60 + k)] + [f"rare{k} thing{k}" for k in range(3000)]
    df = crawl_rows(spark, *({"url": f"u{k}", "title": t} for k, t in enumerate(titles))).repartition(5)
    want = mining.top_ngrams(df, F.col("title"), 20).collect()
    full = []
    monkeypatch.setattr(mining, "top_ngrams", lambda *a: full.append(a) or want_frame)
    want_frame = spark.createDataFrame(want)
    assert mining.heavy_ngrams(df, F.col("title"), 20, 2000).collect() == want and not full
    # Too small a sketch, or fewer phrases than asked for: all are counted.
    assert mining.heavy_ngrams(df, F.col("title"), 20, 16).collect() == want and len(full) == 1
    mining.heavy_ngrams(df.limit(0), F.col("title"), 20).collect()
    assert len(full) == 2


def test_sketches_of_waves_merge(spark):
    waves = [spark.range(k * 4000, k * 4000 + 6000).select(F.concat(F.lit("u"), "id").alias("url")) for k in range(4)]
    kept = spark.createDataFrame([dashboard.sketch(w).first() for w in waves])
    assert abs(dashboard.merged_discovered(kept).first()[0] - 18000) < 18000 * 0.02
    assert dashboard.merged_discovered(kept.limit(0)).first()[0] == 0
