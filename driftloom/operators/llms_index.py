"""Index files for language models: probes, links, ranking and expansion."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.weburl import WebUrl, parse
from .frontier import walk
from .sitemap import in_path_scope

INDEXES = 256
# Types an index may have, its larger siblings, and shapes of an index's lines.
INDEX_TYPES = ("text/markdown", "text/plain", "text/x-markdown", "application/markdown", "application/octet-stream")
SIBLINGS = ("llms-full.txt", "llms-ctx.txt", "llms-ctx-full.txt")
CORPUS_SHAPES = (
    r"\[[^\]]+\]\(([^)\s]+)[^)]*\)",
    r"(?m)(?:^|\n)\s*#\s+\S",
    r"(?m)(?:^|\n)\s*[-*]\s+\S",
    r"(?m)(?:^|\n)\s*https?://\S+",
    r"(?m)(?:^|\n)\s*/[^\s]+",
    r"(?i)\bllms-(?:full|ctx|ctx-full)\.txt\b",
)
HTML_HEADS = ("<!doctype html", "<html", "<head", "<body")
# How lines of an index refer to pages, which lines list languages, and directories of little worth.
_LINK = re.compile(r"\[([^\]]*)\]\(([^)\s]+)([^)]*)\)")
_BARE = re.compile(r"https?://[^\s<>\"'`)]+")
_ROOTED = re.compile(r"(?:^|\s)(/[a-z0-9][^\s<>\"'`)]+)", re.IGNORECASE)
_LANGUAGES = (re.compile(r"\b\d+\s+pages\b", re.IGNORECASE), re.compile(r"(?:^|\s)/docs(?:/[a-z]{2}(?:-[a-z]{2})?)?(?:\s|$)", re.IGNORECASE))
_LOW_VALUE = re.compile(r"(?:^|/)(?:widgets?|playground|chat)/", re.IGNORECASE)


def is_index(content_type: Column, body: Column) -> Column:
    """Text, not HTML, of a fitting type, with at least one line of a corpus' shape."""
    text = T.strip(body)
    kind = F.trim(F.lower(F.regexp_extract(content_type, "^[^;]*", 0)))
    head = F.lower(F.substring(text, 1, 512))
    html = F.lit(False)
    for mark in HTML_HEADS:
        html = html | F.contains(head, F.lit(mark))
    shaped = F.lit(False)
    for shape in CORPUS_SHAPES:
        shaped = shaped | text.rlike(shape)
    return (text != "") & ~html & ((kind == "") | kind.isin(*INDEX_TYPES)) & shaped


def is_index_here(content_type: str, body: str) -> bool:
    text, kind = body.strip(), content_type.partition(";")[0].strip().lower()
    if not text or any(m in text[:512].lower() for m in HTML_HEADS) or (kind and kind not in INDEX_TYPES):
        return False
    return any(re.search(s, text) for s in CORPUS_SHAPES)


def line_links(text: str, base: WebUrl) -> list[str]:
    """Pages a text refers to: links, bare URLs, root-relative paths."""
    loose = [*_BARE.findall(text), *_ROOTED.findall(text)]
    return U.ordered(U.normalise(x, base) for x in [*(m[1] for m in _LINK.findall(text)), *(re.sub(r"[.,;:!?\]]+$", "", x) for x in loose)])


def entry_links(body: str, base: WebUrl) -> list[str]:
    """The first link of each line; lines without one give what they mention, unless they list languages."""
    out: list[str | None] = []
    for line in body.split("\n"):
        if link := _LINK.search(line):
            out.append(U.normalise(link[2], base))
        elif not all(p.search(line) for p in _LANGUAGES):
            out += line_links(line, base)
    return U.ordered(out)


def index_links(body: str, base: str, ranked: bool) -> list[str]:
    """Links of an index and its mentioned siblings; ranked if the number of pages is limited."""
    home = parse(base)
    links = entry_links(body, home)
    hints = [U.normalise(n, home) for n in SIBLINGS if n in body and not any(parse(u).path.endswith("/" + n) for u in links)]
    links = U.ordered([*links, *hints])
    return sorted(links, key=lambda u: link_rank(u, home)) if ranked else links


def link_rank(url: str, base: WebUrl) -> int:
    path = parse(url).path
    outside = not in_path_scope(path, base.path.rpartition("/")[0] + "/")
    full = re.search(r"(?:^|/)llms-full\.txt$", path, re.IGNORECASE) is not None
    return outside + 2 * full + 10 * (_LOW_VALUE.search(path) is not None)


def probes(seed: str) -> list[str]:
    place = parse(seed)
    stem = place.path.rpartition("/")[0] + "/"
    own = [f"{place.path}llms.txt"] if place.path.endswith("/") else [] if re.search(r"\.[a-z0-9]+$", place.path, re.IGNORECASE) else [f"{place.path}/llms.txt"]
    return [place.origin + p for p in dict.fromkeys([*own, f"{stem}llms.txt", "/llms.txt"])]


def read_index(url: str, fetch: Callable, ranked: bool) -> tuple[tuple[str, str, list[str]] | None, list[str]]:
    """An index's asked and final address and links, or None; and the nested indexes among the links."""
    state = fetch(url)
    if not (state.ok and is_index_here(state.content_type, state.body)):
        return None, []
    links = [x for x in index_links(state.body, state.at, ranked) if parse(x).path != "/"]
    home = parse(state.at).origin
    return (url, state.at, links), [x for x in links if parse(x).origin == home and parse(x).path.endswith("/index.md")]


def discover(seed: str, fetch: Callable, most: int | None) -> list[str]:
    """URLs that a site's indexes name, nearest indexes first; at most `most` if given."""
    roots, asked = probes(seed), [0]

    def read(url: str):
        asked[0] += 1
        return read_index(url, fetch, most is not None) if asked[0] <= INDEXES else (None, [])

    found: dict[str, None] = {}
    for url, final, links in walk(roots, read):
        found.update(dict.fromkeys([final, *links] if url in roots else links))
        if most is not None and len(found) >= most:
            return list(found)[:most]
    return list(found)


def links_table(files: DataFrame, ranked: bool = False) -> DataFrame:
    """Rows (url, pos, link) of the index files (url, content_type, body) that are indexes."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(u, i, x) for u, b in zip(batch.url, batch.body, strict=True) for i, x in enumerate(index_links(b or "", u, ranked))]
            yield pd.DataFrame(rows, columns=["url", "pos", "link"])

    good = files.where(is_index(F.coalesce("content_type", F.lit("")), F.coalesce("body", F.lit(""))))
    return good.select("url", "body").mapInPandas(read, "url string, pos long, link string")
