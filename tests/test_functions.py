import pytest
from pyspark.sql import functions as F

from driftloom.functions import address, classify, quality
from driftloom.functions import text as T
from driftloom.functions import urls as U
from driftloom.functions.markdown_clean import clean
from driftloom.functions.weburl import parse
from driftloom.sources.fetching import failure_kind


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], names).select(column.alias("v")).first().v


def test_white_space_of_the_web(spark):
    assert one(spark, T.whitespace_key("t"), t=" a  ﻿ b\t") == "a b"
    assert one(spark, T.word_count("t"), t=" a　b  c ") == 3 and one(spark, T.word_count("t"), t="") == 0
    assert one(spark, T.strip("t"), t="\n a  ") == "a"
    assert one(spark, T.length_utf16("t"), t="a\U0001f600") == 3


def test_unique_by_whitespace(spark):
    got = one(spark, T.unique_by_whitespace(F.split("t", "\\|")), t=" a b|a  b| |c|a b |d")
    assert got == [" a b", "c", "d"]
    assert one(spark, T.unique_by_whitespace(F.array().cast("array<string>"))) == []


def test_links(spark):
    md = 'x [a](u) ![i](p.png "t") [](v) [b]( ) [c](w x)'
    assert [tuple(r) for r in one(spark, T.markdown_links("t"), t=md)] == [("a", "u", ""), ("i", "p.png", ' "t"'), ("", "v", ""), ("c", "w", " x")]
    swap = T.replace_links("t", lambda x, i: F.when(i != 1, F.concat(F.lit("<"), x["href"], F.lit(">"))))
    assert one(spark, swap, t=md) == 'x <u> ![i](p.png "t") <v> [b]( ) <w>'
    assert one(spark, swap, t="") == "" and one(spark, swap, t="[a](b)") == "<b>"


def test_title(spark):
    f = F.lit("/path")
    assert one(spark, T.markdown_title("t", f), t="x\n#  One \n# Two") == "One"
    assert one(spark, T.markdown_title("t", f), t="## Two\ntext # no") == "/path"


CLEAN = [
    ("a\n\n\n\nb", "a\n\nb"),
    ("<Note>\n  inside\n</Note>\nafter", "inside\nafter"),
    ('<Card title="T" href="/x">\n  text\n</Card>', "### [T](/x)\ntext"),
    ('<Step title="S"/>\n  kept', "### S\n  kept"),
    ("<Unknown>\nx\n</Unknown>", "<Unknown>\nx\n</Unknown>"),
    ("    <Note>", "<Note>"),
    ('```ts title="x"\n<Note>\n```\nb', "```ts\n<Note>\n```\nb"),
    ("```{.py}\nx\n```", "```\nx\n```"),
    ("~~~~\n```\n~~~~", "~~~~\n```\n~~~~"),
    ("<iframe src='x'></iframe>", "<iframe src='x'></iframe>"),
    ("<iframe src='x'/>\na", "a"),
    ("<Card/>", "<Card/>"),
    ("> ## Documentation Index\n> Fetch the complete documentation index at: https://a.b/llms.txt\n> Use this file to discover all available pages before exploring further.\n\n# T", "# T"),
]


@pytest.mark.parametrize(("raw", "want"), CLEAN)
def test_clean_markdown(raw, want):
    assert clean(raw) == want


REJECTED = (
    "/blog/rss.xml /docs/auth0%E2%80%A6 /search /docs/genindex.html /docs/_sources/index.rst.txt /docs/COPYING_ja.html /++theme++2025/index.html /create-account /cgi-bin/browse-edgar "
    "/.well-known/captcha/565/botdetect/ /auth/sign-in /cdn-cgi/l/email-protection /page/index.md /index.html.md /api/article /en/Pages/youtube.com/watch /llm/json/chunked/index.json /mydocs /managewatches /robots.txt /sitemap-1.xml"
).split()


def test_page_filter(spark):
    rows = [(f"https://example.com{p}",) for p in REJECTED] + [("https://example.com/openapi.json",), ("HTTP://Example.com:80//a//b?q#f",), ("ftp://x.y/",)]
    got = {r.u: r.v for r in spark.createDataFrame(rows, "u string").select("u", U.normalise_url("u").alias("v")).collect()}
    for (url,) in rows:
        assert got[url] == U.normalise(url), url
    assert got["HTTP://Example.com:80//a//b?q#f"] == "http://example.com/a/b" and got["https://example.com/openapi.json"]
    assert sum(v is None for v in got.values()) == len(REJECTED) + 1


def test_resolution():
    base = "https://a.b/x/y?q#f"
    for raw, want in [
        ("z", "https://a.b/x/z"), ("../z/./w", "https://a.b/z/w"), ("/r", "https://a.b/r"), ("//c.d:443/e", "https://c.d/e"), ("?k=v", "https://a.b/x/y?k=v"), ("#g", "https://a.b/x/y?q#g"),
        ("http:\\\\E.f\\g", "http://e.f/g"), ("für", "https://a.b/x/f%C3%BCr"), (" a b ", "https://a.b/x/a%20b"), ("https://0x7f.1/", "https://127.0.0.1/"), ("https://[::FFFF:7f00:1]/", "https://[::ffff:7f00:1]/"),
        ("https://user:pw@h.i/", "https://user:pw@h.i/"), ("https://bücher.de", "https://xn--bcher-kva.de/"), ("%2e%2e/z", "https://a.b/z"), ("", "https://a.b/x/y?q"),
    ]:
        assert parse(raw, base).href == want, raw
    for bad in ("mailto:x@y.z", "javascript:1", "https://", "https://a b/", "https://1.2.3.999/", "https://h:99999/"):
        assert parse(bad, base) is None, bad
    assert parse("x") is None
    assert U.normalise("en/latest/index.md", "https://d.e/en/latest/llms.txt") == "https://d.e/en/latest/index.md"


def test_scopes(spark):
    for path, want in (("/docs", "/docs"), ("/docs/", "/docs/"), ("/docs/a.html", "/docs/"), ("/docs/a", "/docs/"), ("/docs/a/b", "/docs/a/"), ("/v1.2", "/"), ("", "/")):
        assert one(spark, U.scope_of("u"), u=f"https://e.com{path}") == want
    inside = lambda p, s: one(spark, U.path_in_scope(F.col("p"), F.col("s")), p=p, s=s)
    assert inside("/docs/x", "/docs") and inside("/docs", "/docs") and not inside("/docsx", "/docs") and inside("/a/b", "/a/") and not inside("/a", "/a/") and inside("/z", "/")


def test_keys(spark):
    a, b = "https://e.com/Web/Fetch_API/Using/", "https://e.com/Web/Fetch%5FAPI/Using.md"
    assert one(spark, U.route_key("u"), u=a) == one(spark, U.route_key("u"), u=b) == "route:https://e.com/Web/Fetch_API/Using"
    assert one(spark, U.route_key("u"), u="https://e.com/a/index.html") == "route:https://e.com/a"
    assert one(spark, U.route_key("u"), u="https://e.com/%ff+x") == "route:https://e.com/%ff+x"
    assert one(spark, U.url_key("u"), u="https://e.com:443/a//?q") == "url:https://e.com/a"
    assert one(spark, U.candidate_key("u"), u="https://e.com/a.mdx?x") == "https://e.com/a"


@pytest.mark.parametrize(
    ("url", "word"),
    [
        ("http://169.254.169.254/latest/meta-data", "private"), ("http://[::ffff:7f00:1]/private", "private"), ("http://[::7f00:1]/private", "private"), ("http://[fec0::1]/private", "private"), ("http://[ff02::1]/private", "private"),
        ("https://[2606:4700:4700::1111]/", None), ("ftp://a.b", "http"), ("http://u:p@a.b", "credentials"), ("http://x.localhost", "localhost"), ("http://intranet", "single-label"), ("http://100.64.0.1", "private"),
        ("http://100.128.0.1", None), ("http://172.32.0.1", None), ("http://0x7f000001/", "private"), ("no url", "invalid"), (None, "invalid"),
    ],
)
def test_public_addresses(url, word):
    error = address.refusal(url)
    assert (error is None) if word is None else (word in error)


def test_resolver_checks_every_address():
    now = [0.0]
    table = {"a.b": ["8.8.8.8"], "c.d": ["8.8.8.8", "10.0.0.1"], "e.f": []}
    calls = []
    r = address.Resolver(lambda h: calls.append(h) or table[h], clock=lambda: now[0])
    assert r.resolve("https://a.b/") == r.resolve("https://a.b/x") == "8.8.8.8" and calls == ["a.b"]
    now[0] = 61
    r.resolve("https://a.b/")
    assert calls == ["a.b", "a.b"]
    for bad in ("https://c.d/", "https://e.f/", "https://10.0.0.1/"):
        with pytest.raises(ValueError):
            r.resolve(bad)


WORDS = "word " * 50
QUALITY = [
    ("Dashboard sign in links only", "Widget", 0.55, ["thin content"]),
    ("x", None, 0.4, ["missing title", "thin content"]),
    (f"# T\n{WORDS}", "T", 1.0, []),
    (f"# T\n{WORDS}\n```", "T", 0.9, ["unbalanced code fences"]),
    (" ".join(["[a](b)"] * 30), None, 0.2, ["missing title", "thin content", "high link density"]),
    ("This library makes signals simple. It has a small core, good types, and no hidden state.\n\nRead on for more, it is short.", "Kit", 0.65, []),
]


@pytest.mark.parametrize(("markdown", "title", "confidence", "reasons"), QUALITY)
def test_quality(spark, markdown, title, confidence, reasons):
    frame = spark.createDataFrame([(markdown, title)], "m string, t string").select(quality.quality("m", "t").alias("q")).first().q
    assert (frame.confidence, frame.reasons) == (confidence, reasons)


def test_failure_kinds_agree(spark):
    cases = [(s, e) for s in (0, 200, 401, 404, 410, 429, 500) for e in ("", "HTTP 500", "blocked by client challenge", "response exceeds 5 bytes", "URL must use http or https", "timed out", "reset")]
    for r in spark.createDataFrame(cases, "s int, e string").withColumn("k", classify.failure_kind(F.col("s"), F.col("e"))).collect():
        assert r.k == failure_kind(r.s, r.e)


def test_functions_of_sql(spark):
    from driftloom.functions.register import register

    register(spark)
    got = spark.sql("""SELECT clean_markdown('a\n\n\n\nb') AS a, normalise_reference('../c?d', 'https://e.com/a/b/') AS b,
      normalise_references(array('x', 'x', 'mailto:y'), 'https://e.com/') AS c, public_url_error('http://10.0.0.1/') AS d, public_url_error('https://e.com/') AS e""").first()
    assert (got.a, got.b, got.c, got.e) == ("a\n\nb", "https://e.com/a/c", ["https://e.com/x"], None) and "private" in got.d
