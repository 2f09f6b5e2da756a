"""URL algebra: keys, scopes, filters and normal forms.

Columns take regular absolute http(s) URLs apart by expressions; `normalise`
and `normalise_urls` resolve references of any form in Arrow batches.
"""

from __future__ import annotations

import re
from dataclasses import replace as changed

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import SPACE, link_hrefs, text_column
from .weburl import WebUrl, parse

# Paths that are not pages, tested in either case. The ellipsis is sought in the whole URL.
NON_PAGE_PATHS = (
    r"%3c|%3e|[<>]",
    r"%7b|%7d|[{}]",
    r"(?:^|/)(?:%3a|:)[^/]+",
    r"(?:^|/)search/?$",
    r"(?:^|/)(?:genindex|search|py-modindex)\.html$",
    r"/(?:_sources|\+\+theme\+\+[^/]+)/",
    r"(?:^|/)(?:create-account|try)/?$",
    r"(?:^|/)cgi-bin/",
    r"/\.well-known/captcha/",
    r"/cdn-cgi/",
    r"(?:^|/)(?:login|sign-?in|sign-?up|signup|register)(?:/|$)",
    r"(?:^|/)(?:managewatches|mydocs)(?:/|$)",
    r"(?:^|/)(?:copyright|copying(?:_[a-z]+)?)\.html$",
    r"(?:^|/)page/index\.md$",
    r"\.x?html?\.md$",
    r"(?:^|/)api/(?:article|search)(?:/|$)",
    r"youtube\.com/watch",
    r"(?:^|/)(?:rss|feed|atom)\.xml$",
    r"(?:^|/)(?:chat|demo|playground|repl|test)/?$",
    r"/chunked/.*\.json$",
    r"(?:^|/)(?:robots\.txt|sitemap[^/]*\.xml)$",
)
ELLIPSIS = r"%e2%80%a6|\x{2026}"
# File endings outside any scope, and endings of documents.
IGNORED_FILES = r"\.(?:png|jpe?g|gif|svg|webp|ico|pdf|epub|zip|tar|gz|mp4|mp3|wav|woff2?|ttf|eot|css|js|mjs|map|rss|atom)$"
DOCUMENT_FILES = r"\.(?:html?|mdx?|txt)$"

NON_PAGE = "(?i)(?:" + "|".join(f"(?:{p})" for p in NON_PAGE_PATHS) + ")"
_NON_PAGE = re.compile(NON_PAGE[4:], re.IGNORECASE | re.ASCII)
_IGNORED = re.compile(IGNORED_FILES, re.IGNORECASE)


# Columns over regular absolute URLs.


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(text_column(url), r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(text_column(url), r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def hostname(url: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(authority(url), r"^[^@]*@", ""), r":[0-9]*$", "")


def origin(url: Column | str) -> Column:
    """Scheme and host, with the port unless it is the scheme's own."""
    place = F.regexp_replace(authority(url), r"^[^@]*@", "")
    kind = scheme(url)
    own = F.when(kind == "https", F.regexp_replace(place, r":(?:443)?$", "")).otherwise(F.regexp_replace(place, r":(?:80)?$", ""))
    return F.concat(kind, F.lit("://"), own)


def path(url: Column | str) -> Column:
    found = F.regexp_extract(text_column(url), r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", F.lit("/")).otherwise(found)


def search(url: Column | str) -> Column:
    return F.regexp_extract(text_column(url), r"(?s)^[^?#]*(\?[^#]+)", 1)


def without_query(url: Column | str) -> Column:
    return F.concat(origin(url), path(url))


def is_http(url: Column | str) -> Column:
    return text_column(url).rlike(r"(?i)^https?://[^/?#]")


def is_non_page(href: Column, page_path: Column) -> Column:
    return href.rlike(f"(?i){ELLIPSIS}") | page_path.rlike(NON_PAGE)


def normalise_url(url: Column | str) -> Column:
    """A regular absolute URL without query, fragment and doubled slashes; null if it is no page."""
    clean = F.regexp_replace(path(url), "/{2,}", "/")
    href = F.concat(origin(url), clean)
    return F.when(is_http(url) & ~is_non_page(href, clean), href)


def trim_slashes(page_path: Column) -> Column:
    return F.when(page_path == "/", page_path).otherwise(F.regexp_replace(page_path, "/+$", ""))


def candidate_key(url: Column | str) -> Column:
    cut = F.regexp_replace(trim_slashes(path(url)), f"(?i){DOCUMENT_FILES}", "")
    return F.concat(origin(url), F.when(cut == "", F.lit("/")).otherwise(cut))


def url_key(url: Column | str) -> Column:
    cut = trim_slashes(path(url))
    return F.concat(F.lit("url:"), origin(url), F.when(cut == "", F.lit("/")).otherwise(cut))


def decoded(value: Column) -> Column:
    """Percent-decoded, or as it was where the escapes are no UTF-8."""
    plain = F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))
    broken = plain.contains("�") & ~value.rlike("(?i)%ef%bf%bd")
    return F.when(plain.isNull() | broken, value).otherwise(plain)


def route_key(url: Column | str) -> Column:
    cut = F.regexp_replace(decoded(path(url)), "/+$", "")
    cut = F.regexp_replace(cut, r"(?i)/index(?:\.(?:html?|mdx?|txt))?$", "")
    cut = F.regexp_replace(cut, f"(?i){DOCUMENT_FILES}", "")
    return F.concat(F.lit("route:"), origin(url), F.when(cut == "", F.lit("/")).otherwise(cut))


def segments(page_path: Column) -> Column:
    return F.filter(F.split(page_path, "/"), lambda x: x != "")


def scope_of(url: Column | str) -> Column:
    """The part of a site that a seed stands for."""
    here = path(url)
    parts = segments(here)
    return (
        F.when(here.endswith("/"), here)
        .when(here.rlike(r"(?i)\.[a-z0-9]+$"), F.regexp_replace(here, "/[^/]*$", "/"))
        .when(F.size(parts) <= 1, here)
        .otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"), F.lit("/")))
    )


def path_in_scope(page_path: Column, scope: Column) -> Column:
    return (
        (scope == "/")
        | (scope.endswith("/") & page_path.startswith(scope))
        | (~scope.endswith("/") & ((page_path == scope) | page_path.startswith(F.concat(scope, F.lit("/")))))
    )


def in_scope(url: Column | str, seed: Column, scope: Column) -> Column:
    return (origin(url) == origin(seed)) & path_in_scope(path(url), scope) & ~path(url).rlike(f"(?i){IGNORED_FILES}")


def fence_language(url: Column | str) -> Column:
    ending = F.lower(F.regexp_extract(path(url), r"(?i)\.(ya?ml|json|xml|toml)$", 1))
    return F.when(ending == "yml", F.lit("yaml")).otherwise(ending)


def text_links(markdown: Column | str) -> Column:
    """References of a text: link targets, then bare URLs, then root-relative paths, as written."""
    stop = rf"{SPACE}<>\"'`)"
    bare = F.regexp_extract_all(text_column(markdown), F.lit(rf"https?://[^{stop}]+"), F.lit(0))
    rooted = F.regexp_extract_all(text_column(markdown), F.lit(rf"(?:^|[{SPACE}])(/[A-Za-z0-9][^{stop}]+)"), F.lit(1))
    return F.concat(link_hrefs(markdown), F.transform(F.concat(bare, rooted), lambda x: F.regexp_replace(x, r"[.,;:!?\]]+$", "")))


# References of any form.


def collapse(url: WebUrl, base: WebUrl | None) -> WebUrl:
    """One copy less where a Markdown file's path repeats the base's directory at its start."""
    if base is None or not url.path.endswith(".md") or url.origin != base.origin:
        return url
    here = [x for x in base.path.rpartition("/")[0].split("/") if x]
    parts = [x for x in url.path.split("/") if x]
    if here and parts[: len(here)] == here and parts[len(here) : 2 * len(here)] == here:
        return changed(url, path="/" + "/".join(parts[len(here) :]))
    return url


def non_page(url: WebUrl) -> bool:
    return "%e2%80%a6" in url.href.lower() or "…" in url.href or _NON_PAGE.search(url.path) is not None


def normalise(raw: str, base: WebUrl | str | None = None) -> str | None:
    """The page a reference means, without query and fragment; None if it is no page."""
    base = parse(base) if isinstance(base, str) else base
    url = parse(raw, base)
    if url is None:
        return None
    url = url.bare()
    url = collapse(changed(url, path=re.sub("/{2,}", "/", url.path) or "/"), base)
    return None if non_page(url) else url.href


def ignored_file(page_path: str) -> bool:
    return _IGNORED.search(page_path) is not None


def ordered(urls) -> list[str]:
    return [u for u in dict.fromkeys(urls) if u]


@F.pandas_udf(StringType())
def normalise_reference(href: pd.Series, base: pd.Series) -> pd.Series:
    """Column form of `normalise` for one reference and its base."""
    return pd.Series([None if h is None else normalise(h, b) for h, b in zip(href, base, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def normalise_references(hrefs: pd.Series, base: pd.Series) -> pd.Series:
    """Pages that the references mean, in order, each once."""
    out = []
    for row, b in zip(hrefs, base, strict=True):
        home = parse(b) if b else None
        out.append(None if row is None else ordered(normalise(h, home) for h in row))
    return pd.Series(out, dtype=object)


def same_scope_links(markdown: Column | str, base: Column) -> Column:
    return normalise_references(text_links(markdown), base)
