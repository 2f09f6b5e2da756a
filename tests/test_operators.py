import hashlib
import json
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftloom import workers
from driftloom.functions.weburl import parse
from driftloom.operators import assets, crawl, dedup, dom, extract, llms_index, paths, render, robots, scope, sitemap, snapshot, summary
from driftloom.config import Config
from driftloom.plans import pipeline as P
from driftloom.sources.fetching import State

RECORD = (
    "ord long, ok boolean, url string, final_url string, canonical_url string, status int, source string, title string, markdown string, links array<string>, content_hash string, extractor string, "
    "confidence double, quality_reasons array<string>, aliases array<string>, output_path string, error string, failure_kind string"
)


def record(i, url, final=None, **more):
    base = dict(
        ord=i, ok=True, url=url, final_url=final or url, canonical_url=None, status=200, source="crawl", title="T", markdown="body " * 5, links=[], content_hash="h", extractor="html",
        confidence=0.8, quality_reasons=[], aliases=None, output_path=None, error=None, failure_kind=None,
    )
    return tuple((base | more).values())


def records(spark, *rows):
    return spark.createDataFrame(list(rows), RECORD)


FAILED = dict(ok=False, markdown="", content_hash="", extractor="none", confidence=0.0, title=None)


# Extraction.


def fetched(spark, *rows):
    full = [(i, u, u, 200, t, b, 1.0, True, None, None, "crawl") for i, (u, t, b) in enumerate(rows)]
    return extract.extract(spark.createDataFrame(full, P._FETCHED)).orderBy("ord").collect()


PROSE = "This paragraph explains how the tool is set up. It has several sentences, enough for a page. " * 4


def test_html_becomes_markdown(spark):
    html = f"""<html><head><title>Doc</title><link rel="canonical" href="/canon?x#y"></head><body><nav><a href="/n">Nav</a></nav>
    <main><h1>Head</h1><p>{PROSE}<b>bold</b> <a href="/l">link</a><br>next<p>second<ul><li>one<li>two<ol><li>deep</ol></ul><pre><code class="language-py">x = 1
  y</code></pre><table><tr><th>A<th>B<tr><td>1<td>2</table><blockquote><p>quoted</blockquote><img src="i.png" alt="alt"></main><footer>foot</footer></body></html>"""
    r = fetched(spark, ("https://e.com/a/b", "text/html", html))[0]
    assert r.ok and r.extractor == "html" and r.title == "Head" and r.canonical_url == "https://e.com/canon"
    for piece in ("# Head", "**bold** [link](/l)\nnext", "second", "- one\n- two\n  1. deep", "```py\nx = 1\n  y\n```", "| A | B |\n| --- | --- |\n| 1 | 2 |", "> quoted", "![alt](i.png)"):
        assert piece in r.markdown, piece
    assert "Nav" not in r.markdown and "foot" not in r.markdown and r.links == ["/l", "i.png"]
    assert r.content_hash == hashlib.sha256(r.markdown.encode()).hexdigest()


def test_texts_and_failures(spark):
    shell = '<html><head><title>App</title><script src="/m.js"></script></head><body><div id="app"></div></body></html>'
    rows = fetched(
        spark,
        ("https://e.com/a.yaml", "text/yaml", "k: v\n"),
        ("https://e.com/a.md", "text/markdown", "# Title\n\ntext"),
        ("https://e.com/app", "text/html", shell),
        ("https://e.com/empty", "text/html", "<html><body></body></html>"),
        ("https://e.com/c", "text/html", f"<html><body><main><h1>Client Challenge</h1><p>{PROSE}</p></main></body></html>"),
        ("https://e.com/select-language", "text/html", f'<html><body class="path-select-language"><main><p>{PROSE}</p></main></body></html>'),
        ("https://e.com/x", "application/json", '{"a": "```"}'),
    )
    assert rows[0].markdown == "# /a.yaml\n\n```yaml\nk: v\n```" and rows[0].extractor == "text" and rows[0].title == "/a.yaml"
    assert rows[1].markdown == "# Title\n\ntext" and rows[1].extractor == "markdown" and rows[1].title == "Title"
    assert (rows[2].failure_kind, rows[2].error) == ("empty", "app shell without static text")
    assert (rows[3].failure_kind, rows[3].error) == ("empty", "empty content")
    assert (rows[4].failure_kind, rows[4].error) == ("blocked", "blocked by client challenge")
    assert (rows[5].failure_kind, rows[5].error) == ("empty", "language selector without article content")
    assert "````" in rows[6].markdown
    for r in rows[2:6]:
        assert not r.ok and r.markdown == "" and r.links == [] and r.content_hash == "" and r.extractor == "none" and r.confidence == 0


def test_unreadable_pages_fail_alone(spark):
    deep = "<html><body>" + "<div>" * 5000 + "x"
    bad, good = fetched(spark, ("https://e.com/a", "text/html", deep), ("https://e.com/b", "text/html", f"<html><main><p>{PROSE}</p></main></html>"))
    assert (bad.ok, bad.failure_kind) == (False, "extract") and "RecursionError" in bad.error and good.ok


def test_page_text_fallback_and_metadata(spark):
    links = "".join(f'<a href="/{i}">L{i}</a>' for i in range(3))
    html = f"<html><body><main>{links}</main><div>{PROSE}</div></body></html>"
    assert fetched(spark, ("https://e.com/", "text/html", html.replace("<main>", "<article>").replace("</main>", "</article>")))[0].ok
    bare = "<html>" + f"<p>{PROSE}</p>"
    assert PROSE.split(".")[0] in fetched(spark, ("https://e.com/", "text/html", bare))[0].markdown
    meta = '<html><head><meta name="og:title" content="Named"><meta name="description" content="A page that says a few words about what it is for."></head><body></body></html>'
    r = fetched(spark, ("https://e.com/", "text/html", meta))[0]
    assert r.title == "Named" and r.extractor == "fallback" and r.confidence < 0.6 and "few words" in r.markdown


def test_serialised_text(spark):
    sentences = [f"Sentence number {i} tells something useful about the product here" for i in range(8)]
    data = json.dumps({"props": [{"children": s} for s in sentences], "x": "https://a.b", "cls": "flex-row items-center justify-between p-4"})
    html = f"<html><head><title>Doc</title></head><body><div id='root'>x</div><script>self.push({data})</script></body></html>"
    text = dom.serialised_text(html, "Doc")
    assert text.startswith("# Doc") and all(s in text for s in sentences) and "flex-row" not in text
    assert fetched(spark, ("https://e.com/", "text/html", html))[0].extractor == "fallback"


def test_outline_of_huge_pages():
    body = "<h1>Big</h1>" + "".join(f"<h2>Part {i}</h2>" for i in range(5)) + "<a href='#'>anchor</a>" * 520 + "<p>" + "x" * 2_000_000 + "</p>"
    found = dom.features(f"<html><body>{body}</body></html>")
    assert "## Page Outline" in found["outline"] and "- Part 3" in found["outline"] and "anchor" not in found["outline"]


def test_references_without_semicolon():
    page = "<article><h1>a &amp; b &copy c&amp</h1><a href='/x?a=1&ampb&lt;'>&#65; &nosuch; &</a></article><script>x &amp y</script>"
    loose, strict = dom.tree(page), dom.tree(page, strict=True)
    assert loose.first("h1").text() == "a & b © c&" and strict.first("h1").text() == "a & b &copy c&amp"
    assert strict.first("a").attrs["href"] == "/x?a=1&ampb<" and strict.first("a").text() == "A &nosuch; &"
    assert loose.first("script").text() == strict.first("script").text() == "x &amp y"
    assert dom.features(page)["title"] == "a & b © c&"


def test_navigation_links():
    html = """<nav><a href="/a">a</a><a href="/menu" data-bs-toggle="dropdown">m</a></nav><div class="Sidebar-x"><a href="/s">s</a></div><aside><a href="/b">b</a></aside><p><a href="/c">c</a></p>
    <a class="dropdown-toggle" role="button" aria-expanded="false" href="/d">d</a>"""
    found = dom.features(html)
    assert found["nav"] == ["/a", "/b", "/s"] and found["anchors"] == ["/a", "/s", "/b", "/c"]


def test_batches_for_python_are_small(spark):
    """What reaches a Python worker at once follows bytes, not the rows of its task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    pages = spark.range(2000, numPartitions=1).select(F.col("id").alias("page_id"), F.repeat(F.lit("x"), 20_000).alias("html"))
    extract.page_features(pages, "html")

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], names=["n"])

    found = [r.n for r in pages.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 40_000_000 and max(found) < 2 * workers.BATCH


# Deduplication.


@pytest.mark.parametrize("mode", ["routes", "components", "sequential"])
def test_dedup_prefers_the_better_source(spark, mode):
    rows = records(
        spark,
        record(0, "https://e.com/ref/exports", source="nav", links=["/x"]),
        record(1, "https://e.com/bad", **FAILED, error="HTTP 404", failure_kind="not_found"),
        record(2, "https://e.com/ref/exports.md", source="llms", extractor="markdown", markdown="better", links=["/a"]),
        record(3, "https://e.com/Web/Fetch_API"),
        record(4, "https://e.com/Web/Fetch%5FAPI"),
    )
    got = {r.ord: r for r in dedup.dedupe(rows, mode).collect()}
    assert sorted(got) == [0, 1, 3] and not got[1].ok
    assert got[0].markdown == "better" and got[0].aliases == ["https://e.com/ref/exports"] and got[0].links == ["/a", "/x"]
    assert got[3].url.endswith("Fetch_API") and got[3].aliases == ["https://e.com/Web/Fetch%5FAPI"]


@pytest.mark.parametrize("mode", ["components", "sequential"])
def test_dedup_follows_redirects(spark, mode):
    rows = records(spark, record(0, "https://e.com/old", "https://e.com/new"), record(1, "https://e.com/other"), record(2, "https://e.com/new", source="llms"))
    got = {r.ord: r for r in dedup.dedupe(rows, mode).collect()}
    assert sorted(got) == [0, 1] and got[0].source == "llms" and got[0].aliases == ["https://e.com/old"]


def _folded_plainly(rows):
    """The records in order, each joining the first survivor it shares a key with."""
    kept, holder = [], {}
    for row in rows:
        home = next((holder[k] for k in row["keys"] if k in holder), len(kept))
        if home == len(kept):
            kept.append(row | {"place": row["ord"]})
        else:
            before = kept[home]
            win, lose = (row, before) if row["score"] > before["score"] else (before, row)
            own = {u for u in (win["url"], win["final_url"], win["canonical_url"]) if u}
            extra = {u for u in (lose["url"], lose["final_url"], lose["canonical_url"]) if u} | {u for r in (win, lose) for u in r["aliases"] or ()}
            kept[home] = win | {"place": before["place"], "aliases": sorted(extra - own) or None, "links": sorted({*win["links"], *lose["links"]}), "keys": [*before["keys"], *row["keys"]]}
        holder |= dict.fromkeys(kept[home]["keys"], home)
    return [(r["ord"], r["place"], r["aliases"], r["links"]) for r in kept]


def test_fold_in_order():
    """As a plain fold on random records, where keys change hands; the cost of a large group grows with its records."""
    for seed in range(300):
        draw = random.Random(seed)
        name = lambda: f"u{draw.randrange(9)}"
        rows = [
            {"ord": i, "part": 0, "score": draw.randrange(4), "url": name(), "final_url": name(), "canonical_url": draw.choice([None, name()]), "keys": [f"k{draw.randrange(12)}" for _ in range(3)],
             "aliases": draw.choice([None, [name(), name()]]), "links": [name() for _ in range(draw.randrange(3))]}
            for i in range(14)
        ]
        fold = dedup._Fold()
        for row in rows:
            fold.take(dict(row))
        assert [tuple(r.values()) for b in fold.survivors() for r in b.to_pylist()] == _folded_plainly(rows)
    fold, began = dedup._Fold(), time.perf_counter()
    for i in range(20_000):
        fold.take({"ord": i, "score": i, "url": f"u{i}", "final_url": f"u{i}", "canonical_url": None, "keys": ["all", f"k{i}"], "aliases": None, "links": [f"l{i}"]})
    assert time.perf_counter() - began < 10 and sum(b.num_rows for b in fold.survivors()) == 1


def test_only_shared_keys_make_components(spark):
    keys = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (2, "b"), (3, "d"), (3, "e"), (4, "e"), (5, "x"), (5, "x")], "ord long, key string")
    assert sorted(map(tuple, dedup.components(keys).collect())) == [(0, 0), (2, 0), (3, 3), (4, 3)]


def test_dedup_of_nothing(spark):
    for mode in ("routes", "components", "sequential"):
        assert dedup.dedupe(records(spark).limit(0), mode).count() == 0


# Paths and links.


def placed(spark, *urls, **kw):
    rows = records(spark, *[record(i, u) for i, u in enumerate(urls)])
    return [r.output_path for r in paths.assign_paths(rows, **kw).orderBy("ord").collect()]


def test_output_paths(spark):
    assert placed(spark, "https://e.com/docs/", "https://e.com/docs/a", "https://e.com/docs/a/b.html") == ["index.md", "a.md", "a/b.md"]
    assert placed(spark, "https://e.com/docs", "https://e.com/docs/a") == ["index.md", "a.md"]
    assert placed(spark, "https://e.com/a/B%20c.HTML") == ["a/b-c.md"] and placed(spark, "https://e.com/") == ["index.md"]
    twins = placed(spark, "https://e.com/x/a", "https://f.com/x/a", "https://f.com/y")
    assert twins[0] == f"x/a-{hashlib.sha256(b'https://e.com/x/a').hexdigest()[:8]}.md" and twins[1] != twins[0] and twins[2] == "y.md"
    assert placed(spark, "https://e.com/a", "https://e.com/b", most=1) == ["a.md", None]
    assert placed(spark, "https://e.com/%2e%2e%2e/x", "https://e.com/y")[0] == "page/x.md"


def test_relative_paths(spark):
    for a, b, want in (("a/b.md", "a/c.md", "./c.md"), ("a/b.md", "index.md", "../index.md"), ("x.md", "y/z.md", "./y/z.md"), ("a/b/c.md", "a/d/e.md", "../d/e.md"), ("a.md", "a.md", "./a.md")):
        assert spark.range(1).select(paths.relative_path(F.lit(a), F.lit(b)).alias("v")).first().v == want


def test_links_between_pages(spark):
    body = 'see [b](../docs/b?x#part "t") ![i](/docs/b) [out](https://o.com/) [self](a) [bad](http://[)'
    rows = records(spark, record(0, "https://e.com/docs/a", markdown=body), record(1, "https://e.com/docs/b"), record(2, "https://e.com/docs/c", **FAILED, error="e", failure_kind="http"))
    done = paths.rewrite_links(paths.assign_paths(rows)).orderBy("ord").collect()
    assert done[0].markdown == 'see [b](./b.md "t") ![i](./b.md) [out](https://o.com/) [self](./a.md) [bad](http://[)'
    assert done[0].content_hash == hashlib.sha256(done[0].markdown.encode()).hexdigest() and done[2].content_hash == ""


# Snapshots and rendering.

ROOTS = {
    (): "492adeaa96b0681b1ca894c1b32fd5b9e0e5c9d84663bc45812dc1e701692464",
    (("a.md", "x"),): "77d9231f3d3a4841f5d91201ee91ea305e25db9f412ffd57cf80f8ac526e78b7",
    (("a.md", "x"), ("b.md", "y")): "4929c60e68bba77e83e412b3a7d95c0309cf206f997b9a2b4391f8f7454ccb62",
    (("a.md", "x"), ("b.md", "y"), ("c.md", "z")): "4146b6c22a2470ae8b4bbbf941ca17e3bccb5f7f17f8c84e663f892c28038aee",
}


@pytest.mark.parametrize("files", list(ROOTS))
def test_known_roots(spark, files):
    frame = spark.createDataFrame(list(files), "path string, body string")
    assert snapshot.root(frame) == (ROOTS[files], len(files), len(files))


@pytest.mark.parametrize("n", [1024, 1025, 2500])
def test_roots_of_many_files(spark, n):
    files = [(f"{i}.md", "é" * (i % 5)) for i in range(n)]
    h = lambda *parts: hashlib.sha256(b"".join(p.encode() + b"\0" for p in parts)).hexdigest()
    level = sorted(h("leaf", p, hashlib.sha256(b.encode()).hexdigest()) for p, b in files)
    while len(level) > 1:
        level = [h("node", level[i], level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
    assert snapshot.root(spark.createDataFrame(files, "path string, body string")) == (h("root", level[0]), n, sum(len(b.encode()) for _, b in files))


def test_rendered_page_and_manifest(spark):
    row = record(0, "https://e.com/a", title='Say "hi"\n', markdown="text", confidence=1.0, aliases=["https://e.com/b"], output_path="a.md")
    rows = records(spark, row, record(1, "https://e.com/c", **FAILED, error="HTTP 404", failure_kind="not_found"))
    page = rows.where("ord = 0").select(render.rendered().alias("v")).first().v
    assert page == '---\ntitle: "Say \\"hi\\"\\n"\nurl: "https://e.com/a"\nfinalUrl: "https://e.com/a"\nstatus: 200\nextractor: "html"\nconfidence: 1\ncontentHash: "h"\naliases: ["https://e.com/b"]\n---\ntext\n'
    good, bad = [json.loads(r.value) for r in render.manifest_lines(rows).orderBy("ord").collect()]
    assert good["bytes"] == len(page.encode()) and good["outputHash"] == hashlib.sha256(page.encode()).hexdigest() and good["confidence"] == 1 and "markdown" not in good
    assert bad["bytes"] == 0 and "outputHash" not in bad and bad["failureKind"] == "not_found" and bad["links"] == []


def test_tree():
    assert render.tree_text(["b.md", "a/x.md", "_z.md", "a/B.md"]) == ".\n|-- _z.md\n|-- a\n|   |-- B.md\n|   `-- x.md\n`-- b.md\n"


def test_summary(spark):
    rows = records(
        spark,
        record(0, "https://e.com/a", output_path="a.md", source="seed"),
        record(1, "https://e.com/b", confidence=0.5),
        record(2, "https://e.com/c", **FAILED, error="HTTP 404", failure_kind="not_found"),
    )
    facts = summary.run_summary(rows, Config(seed_url="https://e.com/", max=3, max_explicit=True), 3, 0, ("root", 1, 9), 2000.04)
    assert (facts["status"], facts["written"], facts["failed"], facts["lowQuality"], facts["maxReached"]) == ("partial", 1, 1, 1, True)
    assert facts["bySource"] == {"seed": 1, "llms": 0, "sitemap": 0, "nav": 0, "crawl": 2, "asset": 0} and facts["byFailureKind"] == {"not_found": 1}
    assert facts["errors"] == [{"url": "https://e.com/c", "error": "HTTP 404", "kind": "not_found"}] and facts["pagesPerSecond"] == 0.5 and facts["elapsedMs"] == 2000.0
    text = render.handoff(rows, facts)
    assert "Stale/not-found links: 1" in text and "https://e.com/c: not_found: HTTP 404" in text and "low confidence" in text


# Robots, sitemaps, indexes, scopes.

ROBOTS = """User-agent: driftloom
Disallow: /private

User-agent: *
Allow: /
Sitemap: /s.xml
"""


def test_robots(spark):
    agent = "Mozilla/5.0 (compatible; driftloom/0.1)"
    rules = robots.robots_for(ROBOTS, "https://e.com", agent)
    assert not rules.allowed("https://e.com/private/page") and rules.allowed("https://e.com/public/page") and rules.sitemaps == ["https://e.com/s.xml"]
    for body, path, want in [
        ("User-agent: *\nDisallow: /a\nAllow: /a", "/a", True), ("User-agent: *\nDisallow: /*.pdf$", "/x.pdf", False), ("User-agent: *\nDisallow: /*.pdf$", "/x.pdfs", True), ("User-agent: *\nDisallow:", "/x", True),
        ("User-agent: a\nUser-agent: *\nDisallow: /x", "/x?y", False), ("User-agent: *\nDisallow: /x # why", "/x", False), ("User-agent: *\nDisallow: *", "/x", True), ("User-agent: other\nDisallow: /", "/x", True),
    ]:
        here = robots.robots_for(body, "https://e.com", agent)
        assert here.allowed(f"https://e.com{path}") is want, (body, path)
        table = robots.rules_table(spark.createDataFrame([("https://e.com", body)], "origin string, body string"))
        got = robots.allowed_urls(spark.createDataFrame([(f"https://e.com{path}",)], "url string"), table, agent).first().allowed
        assert got is want, (body, path)
    late = "User-agent: *\n\nDisallow: /x"
    assert not robots.robots_for(late, "https://e.com", agent).allowed("https://e.com/x") and robots.robots_for(late, "https://e.com", agent, strict=True).allowed("https://e.com/x")


def site(pages):
    calls = []

    def fetch(url):
        calls.append(url)
        kind, body, status = (*pages.get(url, ("text/plain", "", 404)), 200)[:3]
        return State(url, url, url, done=True, status=status, content_type=kind, body=body, ok=status == 200, error=None if status == 200 else f"HTTP {status}", failure_kind=None if status == 200 else "blocked" if status == 403 else "not_found")

    return fetch, calls


def xml(root, *locs):
    child = "sitemap" if root == "sitemapindex" else "url"
    return "application/xml", f"<?xml version='1.0'?><{root} xmlns='x'>" + "".join(f"<{child}><loc> {u} </loc></{child}>" for u in locs) + f"</{root}>"


def test_sitemaps():
    e = "https://e.com"
    fetch, calls = site({f"{e}/sitemap.xml": xml("sitemapindex", f"{e}/part-1.xml", f"{e}/part-2.xml"), f"{e}/part-1.xml": xml("urlset", f"{e}/a"), f"{e}/part-2.xml": xml("urlset", f"{e}/b?x#y", f"{e}/search")})
    assert sitemap.discover(f"{e}/", [], fetch, 1) == [f"{e}/b"] and calls == [f"{e}/sitemap.xml", f"{e}/part-2.xml"]
    fetch, calls = site({f"{e}/docs.sitemap.xml": xml("urlset", f"{e}/docs/a"), f"{e}/broad.xml": xml("urlset", f"{e}/z")})
    assert sitemap.discover(f"{e}/docs", [f"{e}/broad.xml"], fetch, 1) == [f"{e}/docs/a"] and f"{e}/broad.xml" not in calls
    fetch, _ = site({f"{e}/sitemap.xml": xml("urlset", f"{e}/sitemap-x.xml"), f"{e}/sitemap-x.xml": xml("urlset", f"{e}/in")})
    assert sitemap.discover(f"{e}/", [], fetch) == [f"{e}/in"]
    fetch, calls = site({f"{e}/sitemap.xml": xml("sitemapindex", f"{e}/page", *[f"{e}/c{i}.xml" for i in range(6)]), **{f"{e}/c{i}.xml": ("", "", 403) for i in range(6)}})
    assert sitemap.discover(f"{e}/", [], fetch, 2) == [f"{e}/page"] and sum("/c" in c for c in calls) == 5
    assert sitemap.prioritised([f"{e}/sitemap-de.xml", f"{e}/sitemap-us_en.xml"], "/en-us/") == [f"{e}/sitemap-us_en.xml", f"{e}/sitemap-de.xml"]


def test_sitemap_table(spark):
    rows = spark.createDataFrame([("https://e.com/s.xml", xml("sitemapindex", "https://e.com/a-1.xml", "https://e.com/p", "https://e.com/a-2.xml")[1], "/")], "url string, body string, scope string")
    got = {(r.loc, r.kind, r["rank"]) for r in sitemap.entries_table(rows).collect()}
    assert ("https://e.com/a-2.xml", "sitemap", 0.0) in got and any(k == "page" and u.endswith("/p") for u, k, _ in got)


def test_index_files(spark):
    e = "https://e.com"
    body = "# Docs\n- [A](/docs/a.md): see [B](/docs/b.md)\n- German (12 pages) /docs/de\nplain /docs/c.md, and https://e.com/docs/d.md.\n[Nested](/docs/index.md) llms-full.txt\n[root](/)"
    fetch, _ = site({f"{e}/llms.txt": ("text/plain", body), f"{e}/docs/index.md": ("text/markdown", "- [Z](z.md)")})
    want = [f"{e}/llms.txt", f"{e}/docs/a.md", f"{e}/docs/c.md", f"{e}/docs/d.md", f"{e}/docs/index.md", f"{e}/llms-full.txt", f"{e}/docs/z.md"]
    assert sorted(llms_index.discover(f"{e}/", fetch, None)) == sorted(want)
    assert len(llms_index.discover(f"{e}/", fetch, 3)) == 3
    rows = spark.createDataFrame([(f"{e}/llms.txt", "text/plain", body), (f"{e}/x", "text/html", body), (f"{e}/y", "", "<!DOCTYPE html>- [a](b)")], "url string, content_type string, body string")
    assert {r.link for r in llms_index.links_table(rows).collect()} == {*want[1:-1], f"{e}/"}
    assert llms_index.link_rank(f"{e}/widgets/a", parse(f"{e}/llms.txt")) == 10
    assert llms_index.probes(f"{e}/docs/a") == [f"{e}/docs/a/llms.txt", f"{e}/docs/llms.txt", f"{e}/llms.txt"]


def test_scopes(spark):
    assert scope.parent_scopes("/a/b/c") == ["/a/b/", "/a/", "/"]
    assert scope.widest([("/a/b", 1), ("/a/", 4), ("/", 99)]) == "/a/" and scope.widest([("/a/b", 1), ("/a/", 3), ("/", 4)]) == "/"
    seed = "https://e.com/"
    rows = [(seed, i, f"https://docs.e.com/guide/{i}.md") for i in range(5)] + [(seed, 9, "https://x.org/a")]
    got = scope.corpus_targets(spark.createDataFrame(rows, "seed string, ord long, url string")).collect()
    assert [tuple(r) for r in got] == [(seed, "https://docs.e.com", "/guide/")]
    few = [(seed, 0, "https://x.org/a"), (seed, 1, "https://x.org/b")]
    assert scope.corpus_targets(spark.createDataFrame(few, "seed string, ord long, url string")).count() == 0


def test_crawl_levels(spark):
    e = "https://e.com"
    edges = [(f"{e}/", f"{e}/a"), (f"{e}/a", f"{e}/b"), (f"{e}/b", f"{e}/"), (f"{e}/a", "https://o.com/x"), (f"{e}/b", f"{e}/c.png"), (f"{e}/b", f"{e}/d")]
    got = crawl.crawl(spark.createDataFrame([(f"{e}/", "/")], "seed string, scope string"), spark.createDataFrame(edges, "src string, dst string"), 5)
    assert {(r.url, r.level) for r in got.collect()} == {(f"{e}/a", 1), (f"{e}/b", 2), (f"{e}/d", 3)}


def test_asset_pages(spark):
    e = "https://e.com"
    block = 'var Intro=(function(){t(0,"p");t(1,"Intro text that is long enough to be kept as a page of its own");t(2,`code\\nline ${x}`)})();var next=1;'
    main = f'{block}const r=[{{path:"intro",component:Intro,data:{{title:"Intro"}}}},{{path:"guide",loadChildren:()=>import("./g.js")}}]'
    fetch, _ = site({f"{e}/m.js": ("application/javascript", main), f"{e}/g.js": ("application/javascript", main)})
    got = dict(assets.discover(f"{e}/", {"base_href": None, "scripts": ["/m.js?v=1", "https://cdn.x/y.js"]}, fetch, 10, lambda u: True))
    assert set(got) == {f"{e}/intro", f"{e}/guide/intro"}
    assert got[f"{e}/intro"] == "# Intro\n\nIntro text that is long enough to be kept as a page of its own\n\n```\ncode\nline\n```"
    apps = spark.createDataFrame([(f"{e}/", f"{e}/", f"{e}/m.js"), (f"{e}/b/", f"{e}/b", f"{e}/m.js"), (f"{e}/c/", f"{e}/c/", f"{e}/gone.js")], "seed string, base string, script string")
    scripts = spark.createDataFrame([(f"{e}/m.js", main), (f"{e}/g.js", main), (f"{e}/n.js", None)], "url string, body string")
    rows = {(r.seed, r.url): r.markdown for r in assets.asset_pages(apps, scripts).collect()}
    mounts = {(s, f"{b}{'guide/' * n}intro") for s, b in ((f"{e}/", f"{e}/"), (f"{e}/b/", f"{e}/b/")) for n in range(33)}
    # The second script mounts itself once more at each level; prefixes grow until the last level.
    assert {(f"{e}/", f"{e}/intro"), (f"{e}/b/", f"{e}/b/guide/intro")} <= rows.keys() <= mounts
    assert set(rows.values()) == {got[f"{e}/intro"]}


def test_script_facts_survive_quotes_and_patterns():
    block = """x='say "hi';y=/["']/;// don't
    var A=(()=>{t(1,"One text of a component, \\"quoted\\", long enough to stay")})();let B=(()=>{t(2,"Other text of the next component, also long enough")})();var c=1;
    r=[{path:"a",component:A,data:{title:"First"}},{path:"b",component:B,data:{title:"Second"}},{path:"z",component:Z,data:{title:"None"}}]"""
    found = assets.facts(block)
    assert found.pages == [("a", '# First\n\nOne text of a component, "quoted", long enough to stay'), ("b", "# Second\n\nOther text of the next component, also long enough")]
    assert assets.facts('import("./a.mjs");import("./b.css")').loads == [("./a.mjs", None)]
