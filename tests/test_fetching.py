from dataclasses import replace

import pytest

from driftloom.config import Config
from driftloom.plans import pipeline as P
from driftloom.functions.javascript import places_set
from driftloom.plans.discover import discover
from driftloom.sources import archive as A
from driftloom.sources import fetching as R
from driftloom.sources.http import Fetcher, run_bounded

E = "https://example.com"


def html(body, **headers):
    return R.Response(200, {"content-type": "text/html", **headers}, body.encode())


def served(table, seen=None, **kw):
    def transport(url, headers):
        if seen is not None:
            seen.append((url, headers.get("cookie")))
        answer = table.get(url, R.Response(404, {}))
        if isinstance(answer, Exception):
            raise answer
        return answer

    return Fetcher(transport, sleep=lambda s: None, **kw)


def got(table, url=f"{E}/", **kw):
    return served(table, **kw).fetch(url)[0]


def test_redirects_and_limits():
    hop = lambda to: R.Response(302, {"location": to})
    assert got({f"{E}/": hop("/a#x"), f"{E}/a": html("ok")}).at == f"{E}/a"
    assert got({f"{E}/": hop("http://127.0.0.1/x")}).failure_kind == "unsafe_url"
    assert got({f"{E}/": hop("ftp://e.com/x")}).failure_kind == "unsafe_url"
    loop = got({f"{E}/": hop("/a"), f"{E}/a": hop("/")} | {f"{E}/": hop("/a")})
    assert loop.error == "too many redirects" and loop.failure_kind == "http"
    assert got({f"{E}/": html("x" * 50)}, max_bytes=10).failure_kind == "too_large"
    assert got({f"{E}/": R.Response(202, {"x-amzn-waf-action": "challenge"})}).failure_kind == "blocked"
    assert got({}).failure_kind == "not_found"


def test_refreshes():
    meta = lambda to: html(f'<meta http-equiv="refresh" content="0; url={to}">')
    chain = {f"{E}/": meta("/1"), f"{E}/1": meta("/2"), f"{E}/2": meta("/3"), f"{E}/3": html('<p>Redirecting</p><script>const v = "/42/"; location.replace(v + "intro" + location.search)</script>'), f"{E}/42/intro": html("done")}
    assert got(chain).at == f"{E}/42/intro"
    assert got({f"{E}/": html('<noscript><meta http-equiv="refresh" content="0;url=/x"></noscript>stay')}).at == f"{E}/"
    assert got({f"{E}/": html('redirecting<script>location.replace("latest/" + window.location.search + location.hash)</script>'), f"{E}/latest/": html("x")}).at == f"{E}/latest/"
    assert got({f"{E}/": meta("http://localhost/")}).failure_kind == "unsafe_url"
    many = {f"{E}/{i}": meta(f"/{i + 1}") for i in range(12)}
    assert got(many, f"{E}/0").error == "too many meta refresh redirects"
    assert places_set("var a = '/x/'; location.replace(a + `b` + \"c\"); location.replace(f(x)); location.href = a\nlocation = `${a}`") == (["/x/bc"], ["/x/"])
    assert places_set("// don't\nx = /'/; if (location == 1) y = 'it\\'s'") == ([], [])
    assert R.meta_target("5; URL = /a;b") == "/a;b" and R.meta_target("5; /plain ") == "/plain" and R.meta_target("5") is None
    assert R.script_target('redirected <script>location = "/a"; window.location.href = "/b";</script>') == "/b"


@pytest.mark.parametrize(
    ("url", "there", "want"),
    [("/docs/topic.md", "/docs/topic", "/docs/topic"), ("/guide.md", "/docs/guide.md", "/docs/guide.md"), ("/quickstart.html", "/quickstart", "/quickstart"), ("/docs.md", "/docs", "/docs")],
)
def test_fallback_routes(url, there, want):
    assert got({E + there: html("text")}, E + url).at == E + want


def test_hollow_markdown():
    for body in ("", "---\na: b\n---\n"):
        assert got({f"{E}/d/x.md": R.Response(200, {"content-type": "text/markdown"}, body.encode()), f"{E}/d/x": html("y")}, f"{E}/d/x.md").at == f"{E}/d/x"


def test_retries_and_cookies():
    calls = []
    assert got({f"{E}/": ConnectionRefusedError("refused")}).failure_kind == "fetch"
    served({f"{E}/": ConnectionRefusedError("ECONNREFUSED refused")}, calls).fetch(f"{E}/")
    assert len(calls) == 1
    calls.clear()
    assert served({f"{E}/": R.Response(503, {})}, calls).fetch(f"{E}/")[0].error == "HTTP 503" and len(calls) == 3
    calls.clear()
    served({f"{E}/": R.Response(503, {})}, calls, retry_http=False).fetch(f"{E}/")
    assert len(calls) == 1
    calls.clear()
    sub = "https://docs.example.com"
    table = {f"{sub}/": R.Response(302, {"location": "/a"}, b"", ("s=1; Domain=.example.com; Secure", "h=2", "evil=3; Domain=other.org")), f"{sub}/a": html("x")}
    served(table, calls).fetch(f"{sub}/")
    assert calls[1] == (f"{sub}/a", "s=1; h=2; evil=3")
    jar = R.CookieJar()
    jar.store(f"{sub}/", ("s=1; Domain=example.com; Secure", "h=2"))
    assert jar.header(f"{E}/") == "s=1" and jar.header("http://example.com/") == ""
    assert R.retry_delay(0, "3", 0, 0) == 3 and R.retry_delay(0, "99", 0, 0) == 10 and R.retry_delay(9, None, 0, 1) == 2.5


def test_charsets():
    assert R.decode("é".encode("cp1252"), "text/html; charset=ISO-8859-1") == "é"
    assert R.decode('<meta charset="windows-1252">é'.encode("cp1252")).endswith("é")
    assert R.decode(b"\xff\xfe" + "é".encode("utf-16-le")) == "é" and R.decode(b"\xef\xbb\xbfa") == "a"
    assert R.decode("é".encode(), "text/html; charset=nonsense") == "é" and "�" in R.decode(b"\xff\xffabc")


def test_topics():
    page = '<html><body data-topic="t.json?x=1&amp;y=2"></body></html>'
    topic = R.Response(200, {}, b'{"a": [{"url": "/p"}, {"url": "https://o.com/"}, {"url": "q#f", "k": "</script>"}]}')
    body = got({f"{E}/": html(page), f"{E}/t.json?x=1&y=2": topic}).body
    assert f'href="{E}/p"' in body and f'href="{E}/q"' in body and "o.com" in body.split("<script")[1] and body.count("</script>") == 1


def test_run_bounded():
    import threading

    lock, busy, top = threading.Lock(), {}, {}

    def work(item):
        with lock:
            busy[item[0]] = busy.get(item[0], 0) + 1
            top[item[0]] = max(top.get(item[0], 0), busy[item[0]])
        threading.Event().wait(0.01)
        with lock:
            busy[item[0]] -= 1
        return item[1]

    items = [("a", i) for i in range(10)] + [("b", i) for i in range(10)]
    assert run_bounded(items, work, lambda x: x[0], 8, 2) == [i for _, i in items] and max(top.values()) <= 2
    assert run_bounded([], work, lambda x: x, 4, 2) == []


def archived(spark, table):
    rows = [(u, r.status, dict(r.headers), list(r.set_cookies), r.body) for u, r in table.items()]
    return spark.createDataFrame(rows, A.ARCHIVE)


def test_archive_agrees_with_the_fetcher(spark):
    table = {
        f"{E}/r": R.Response(301, {"Location": "/s"}),
        f"{E}/s": html('<meta http-equiv=refresh content="1;url=t">'),
        f"{E}/t": html("end"),
        f"{E}/x.md": R.Response(410, {}),
        f"{E}/docs/x.md": R.Response(200, {"content-type": "text/markdown"}, b"# X"),
        f"{E}/big": R.Response(200, {"content-length": "999999999"}),
        f"{E}/topic": html('<body data-topic="t.json">'),
        f"{E}/t.json": R.Response(200, {}, b'{"url": "/z"}'),
    }
    urls = [f"{E}/r", f"{E}/x.md", f"{E}/big", f"{E}/none", f"{E}/topic", "http://10.0.0.1/"]
    wanted = spark.createDataFrame([(i, u, "nav") for i, u in enumerate(urls)], "ord long, url string, source string")
    rows = {r.url: r for r in A.fetch(wanted, archived(spark, table)).collect()}
    for url in urls:
        one = A.fetch_one(table.get, url, R.Limits())
        assert (rows[url].final_url, rows[url].ok, rows[url].failure_kind, rows[url].body) == (one.at, one.ok, one.failure_kind, one.body), url
    assert rows[f"{E}/r"].final_url == f"{E}/t" and "topic-data" in rows[f"{E}/topic"].body


# Whole runs.

PROSE = "This page explains one part of the tool in a few plain sentences. It is long enough to be kept. " * 5
page = lambda title, *links: html(f"<html><body><nav>{''.join(f'<a href={u!r}>{u}</a>' for u in links)}</nav><main><h1>{title}</h1><p>{PROSE}</p></main></body></html>")
SHELL = html('<html><head><script src="/m.js"></script></head><body><div id="app"></div></body></html>')


def run(spark, tmp_path, table, **kw):
    config = Config(seed_url=f"{E}/", out_dir=str(tmp_path / "out"), **kw)
    fetch = lambda u: A.fetch_one(table.get, u, R.Limits())
    return P.run_site(spark, config, fetch)


def test_backfill(spark, tmp_path):
    table = {f"{E}/": page("Home", "/bad", "/good"), f"{E}/bad": SHELL, f"{E}/good": page("Good")}
    s = run(spark, tmp_path, table, max=2, max_explicit=True).summary
    assert (s["written"], s["failed"], s["discovered"]) == (2, 1, 3)
    assert len((tmp_path / "out/manifest.jsonl").read_text().splitlines()) == 3
    assert {"summary.json", "AGENT_README.md", "tree.txt", "index.md", "good.md"} <= {p.name for p in (tmp_path / "out").iterdir()}
    assert "Home" in (tmp_path / "out/index.md").read_text() and (tmp_path / "out/index.md").read_text().startswith('---\ntitle: "Home"\n')


@pytest.mark.parametrize("status", [404, 500])
def test_no_backfill_for_other_failures(spark, tmp_path, status):
    table = {f"{E}/": page("Home", "/missing", "/extra"), f"{E}/missing": R.Response(status, {}), f"{E}/extra": page("Extra")}
    s = run(spark, tmp_path, table, max=2, max_explicit=True, dry_run=True).summary
    assert (s["written"], s["failed"], s["discovered"]) == (1, 1, 2) and not (tmp_path / "out").exists()


def urls(table, seed=f"{E}/", **kw):
    return [(f.url, f.source) for f in discover(Config(seed_url=seed, **kw), lambda u: A.fetch_one(table.get, u, R.Limits()))]


def text(body):
    return R.Response(200, {"content-type": "text/plain"}, body.encode())


def test_discovery_order():
    table = {f"{E}/": page("H", "/a", "/b"), f"{E}/robots.txt": text("User-agent: *\nDisallow: /b\n"), f"{E}/sitemap.xml": R.Response(200, {}, f"<urlset><url><loc>{E}/m</loc></url></urlset>".encode())}
    assert urls(table)[:3] == [(f"{E}/", "seed"), (f"{E}/a", "nav"), (f"{E}/m", "sitemap")]
    assert urls(table, page_only=True) == [(f"{E}/", "seed")]
    assert (f"{E}/b", "nav") in urls(table, ignore_robots=True)
    blocked = discover(Config(seed_url=f"{E}/b/c"), lambda u: A.fetch_one({**table, f"{E}/b/c": page("x")}.get, u, R.Limits()))
    assert len(blocked) == 1 and blocked[0].fetched.error == "blocked by robots.txt"
    index = {**table, f"{E}/llms.txt": text("# Docs\n- [one](/one.md)\n- [two](/two.md)")}
    assert urls(index) == [(f"{E}/llms.txt", "llms"), (f"{E}/one.md", "llms"), (f"{E}/two.md", "llms")]
    assert len(urls(index, max=2, max_explicit=True)) == 2
    assert urls({}) == [(f"{E}/", "seed")]
    assert urls({}, f"{E}/docs/llms.txt") == []


def test_discovery_of_apps():
    block = 'var I=(function(){t(0,"Text of the first page, long enough to be kept as a page");})();var z=1;'
    js = block + 'r=[{path:"intro",component:I,data:{title:"Intro"}}]'
    table = {f"{E}/": SHELL, f"{E}/m.js": R.Response(200, {}, js.encode())}
    assert urls(table) == [(f"{E}/intro", "asset")]


def test_crawl_in_scope():
    table = {f"{E}/docs/": page("D", "/docs/a", "/blog"), f"{E}/docs/a": page("A", "/docs/deep/b"), f"{E}/docs/deep/b": page("B"), f"{E}/blog": page("Blog")}
    found = urls(table, f"{E}/docs/")
    assert (f"{E}/docs/deep/b", "crawl") in found and all("/blog" not in u for u, _ in found)


def test_corpus_run(spark):
    table = {f"{E}/a": page("A", "/b"), f"{E}/b": page("B"), f"{E}/b.html": R.Response(404, {})}
    wanted = spark.createDataFrame([(0, f"{E}/a", "nav"), (1, f"{E}/b", "nav"), (2, f"{E}/b.html", "nav")], "ord long, url string, source string")
    result = P.run_corpus(A.fetch(wanted, archived(spark, table)))
    assert result.summary["written"] == 2 and result.summary["deduped"] == 1 and result.summary["renderedFiles"] == 2


def test_non_page_finals(spark):
    rows = [(0, f"{E}/a", f"{E}/login", 200, "text/html", "x", 0.0, True, None, None, "nav"), (1, f"{E}/b", f"{E}/b", 200, "text/html", "x", 0.0, True, None, None, "nav")]
    out = {r.ord: r for r in A.reject_non_pages(spark.createDataFrame(rows, P._FETCHED)).collect()}
    assert (out[0].ok, out[0].failure_kind) == (False, "blocked") and out[1].ok


def test_limits_are_kept():
    assert replace(R.State.of("x"), rounds=2).rounds == 2 and R.Limits().max_bytes == 12 << 20


def test_http_source_refuses_without_a_request(spark):
    from driftloom.sources.http import HttpPages

    spark.dataSource.register(HttpPages)
    rows = spark.read.format("pages_http").option("urls", "http://127.0.0.1/ http://localhost/x").option("partitions", "2").load().collect()
    assert {(r.url, r.ok, r.failure_kind) for r in rows} == {("http://127.0.0.1/", False, "unsafe_url"), ("http://localhost/x", False, "unsafe_url")}
    assert spark.read.format("pages_http").load().count() == 0
