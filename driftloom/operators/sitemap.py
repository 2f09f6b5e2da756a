"""Sitemaps: candidates, entries, and the order in which an index's children are read."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import urls as U
from ..functions.weburl import parse

CHILDREN, DEPTH, BLOCKED_RUN = 50, 3, 5
# Where sites keep their sitemaps.
WELL_KNOWN = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap-0.xml")

_LOC = re.compile(r"<(?:\w+:)?loc\b[^>]*>(.*?)</(?:\w+:)?loc\s*>", re.IGNORECASE | re.DOTALL)
_ROOT = re.compile(r"<(?![?!])(?:\w+:)?(\w+)")
_SITEMAP = re.compile(r"(?:^|/)sitemap[^/]*\.xml$", re.IGNORECASE)
_XML = re.compile(r"\.xml$", re.IGNORECASE)
_NUMBER = re.compile(r"(?:^|/|[_-])(\d+)\.xml$", re.IGNORECASE)


def candidates(seed: str, named: list[str]) -> list[str]:
    """Sitemaps to try, in order: beside the seed, named by robots, well-known."""
    place = parse(seed)
    stem = place.path.removesuffix("/")
    own = [f"{place.origin}{stem}.sitemap.xml"] if stem and "." not in stem else []
    return list(dict.fromkeys([*own, *named, *(place.origin + p for p in WELL_KNOWN)]))


@dataclass(frozen=True)
class Entries:
    """What one sitemap lists: pages, child sitemaps, and whether it is an index."""

    is_index: bool
    pages: list[str]
    children: list[str]


def entries(body: str, url: str) -> Entries:
    body = re.sub(r"<!--.*?-->", "", body, flags=re.DOTALL)
    texts = [re.sub(r"<!\[CDATA\[(.*?)\]\]>", r"\1", x, flags=re.DOTALL) for x in _LOC.findall(body)]
    places = [p for p in (parse(unescape(t).strip(), url) for t in texts) if p]
    raw = [replace(p, fragment=None) for p in places]
    root = _ROOT.search(body)
    named = root is not None and root[1].lower() == "sitemapindex"
    maps = [p for p in raw if _SITEMAP.search(p.path)]
    if named:
        pages = [u for u in (U.normalise(p.href) for p in raw) if u and not _XML.search(parse(u).path)]
        return Entries(True, pages, [p.href for p in raw if _XML.search(p.path)])
    if maps and len(maps) == len(raw):
        return Entries(True, [], [p.href for p in maps])
    return Entries(False, [u for u in (U.normalise(p.href) for p in raw) if u], [])


def part_number(path: str) -> int:
    found = _NUMBER.search(path)
    return int(found[1]) if found else 0


def hint_score(path: str, scope: str) -> int:
    """How many parts of the scope a sitemap's name holds; locales count either way round."""
    score = 0
    for part in (p.lower() for p in scope.split("/") if len(p) > 2):
        forms = [part]
        if locale := re.fullmatch("([a-z]{2})-([a-z]{2})", part):
            forms.append(f"{locale[2]}-{locale[1]}")
        tests = [re.escape(f).replace(r"\-", "[_-]") for f in forms]
        score += any(re.search(rf"(?:^|[/_.-]){t}(?:[/_.-]|$)", path.lower()) for t in tests)
    return score


def in_path_scope(path: str, scope: str) -> bool:
    if scope.endswith("/"):
        return path.startswith(scope)
    return path == scope or path.startswith(scope + "/")


def prioritised(urls: list[str], scope: str) -> list[str]:
    """Children inside the scope first, then by hints and part numbers, downwards; ties keep their order."""
    rank = lambda u: (scope != "/" and in_path_scope(parse(u).path, scope), 10_000 * hint_score(parse(u).path, scope) + part_number(parse(u).path))
    return sorted(urls, key=rank, reverse=True) if scope != "/" else sorted(urls, key=lambda u: rank(u)[1], reverse=True)


def discover(seed: str, named: list[str], fetch: Callable, limit: float = float("inf"), scope: str | None = None, accept: Callable[[str], bool] = lambda u: True) -> list[str]:
    """Pages of a site's sitemaps. `fetch(url)` gives a state with ok, status, failure_kind and body."""
    if scope is None:
        parts = [p for p in parse(seed).path.split("/") if p]
        scope = f"/{parts[0]}/" if parts else "/"
    found: dict[str, None] = {}

    def take(urls: list[str]) -> None:
        for u in urls:
            if len(found) >= limit:
                return
            if accept(u):
                found.setdefault(u)

    def read(url: str, depth: int) -> bool:
        """Whether the sitemap was refused."""
        if depth > DEPTH or len(found) >= limit:
            return False
        state = fetch(url)
        if not state.ok:
            return state.status == 403 or state.failure_kind == "blocked"
        if "<" not in state.body:
            return False
        listed = entries(state.body, url)
        take(listed.pages)
        refused = 0
        for child in prioritised(listed.children, scope)[:CHILDREN]:
            if len(found) >= limit:
                break
            refused = refused + 1 if read(child, depth + 1) else 0
            if limit <= 10 and refused >= BLOCKED_RUN:
                break
        return False

    for url in candidates(seed, named):
        if len(found) >= limit:
            break
        read(url, 0)
    return list(found)


def entries_table(files: DataFrame) -> DataFrame:
    """Rows (url, pos, loc, kind, rank) of the sitemaps (url, body, scope): kind is `page` or `sitemap`, rank the reading order."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, body, scope in zip(batch.url, batch.body, batch.scope, strict=True):
                listed = entries(body or "", url)
                order = {u: i for i, u in enumerate(prioritised(listed.children, scope or "/"))}
                rows += [(url, i, u, "page", None) for i, u in enumerate(listed.pages)]
                rows += [(url, i, u, "sitemap", order[u]) for i, u in enumerate(listed.children)]
            yield pd.DataFrame(rows, columns=["url", "pos", "loc", "kind", "rank"])

    return files.select("url", "body", "scope").mapInPandas(read, "url string, pos long, loc string, kind string, rank double")
