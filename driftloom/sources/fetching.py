"""The rules of fetching one URL, apart from how responses are got.

`advance` takes a URL's state and one response to its next state: redirects,
refreshes, fallback routes, refusals, limits. The archive source drives it with
joins, the HTTP source with requests.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from email.utils import parsedate_to_datetime

from ..functions.address import refusal
from ..functions.javascript import places_set
from ..functions.weburl import parse

REFRESHES, REDIRECTS, ATTEMPTS, TOPIC_LINKS = 8, 8, 3, 200

# Wordings that tell kinds of failure.
UNSAFE = re.compile("private|internal|localhost|single-label|credentials|unsafe|scheme|resolve|must use http", re.IGNORECASE)
TIMEOUT = re.compile("timeout|timed out|abort", re.IGNORECASE)
BLOCKED = re.compile("blocked|challenge", re.IGNORECASE)


@dataclass(frozen=True)
class Response:
    status: int
    headers: dict[str, str]
    body: bytes = b""
    set_cookies: tuple[str, ...] = ()

    def header(self, name: str) -> str:
        return next((v for k, v in self.headers.items() if k.lower() == name), "") or ""


@dataclass(frozen=True)
class Limits:
    max_bytes: int = 12 << 20
    public_only: bool = True


@dataclass(frozen=True)
class State:
    url: str
    at: str
    start: str
    redirects: tuple[str, ...] = ()
    fallbacks: tuple[str, ...] = ()
    refreshes: tuple[str, ...] = ()
    rounds: int = 0
    done: bool = False
    status: int = 0
    content_type: str = ""
    body: str = ""
    ok: bool = False
    error: str | None = None
    failure_kind: str | None = None

    @classmethod
    def of(cls, url: str) -> State:
        return cls(url, url, url)


def failure_kind(status: int, error: str) -> str:
    """First that holds: not found, blocked, too large, unsafe, timeout, http, fetch."""
    if status in (404, 410):
        return "not_found"
    if status in (401, 403, 429) or BLOCKED.search(error):
        return "blocked"
    if "exceeds" in error.lower():
        return "too_large"
    if UNSAFE.search(error):
        return "unsafe_url"
    if TIMEOUT.search(error):
        return "timeout"
    return "http" if status > 0 else "fetch"


def failed(state: State, status: int, error: str, **more) -> State:
    return replace(state, done=True, ok=False, status=status, error=error, failure_kind=failure_kind(status, error), **more)


def advance(state: State, response: Response | None, limits: Limits, error: str | None = None) -> State:
    """What follows from a response, or from its absence, for the URL `state.at`."""
    if limits.public_only and (unsafe := refusal(state.at)):
        return failed(state, 0, unsafe)
    if response is None:
        return failed(state, 0, error or "no response in the archive")
    target = redirect_target(response, state.at)
    if target:
        if target in state.redirects or len(state.redirects) >= REDIRECTS:
            return failed(state, response.status, "too many redirects")
        return replace(state, at=target, redirects=(*state.redirects, target))
    declared = response.header("content-length")
    if max(len(response.body), int(declared) if declared.isdigit() else 0) > limits.max_bytes:
        return failed(state, response.status, f"response exceeds {limits.max_bytes} bytes")
    if response.header("x-amzn-waf-action"):
        return failed(state, response.status, "blocked by client challenge")
    got = replace(state, done=True, status=response.status, content_type=response.header("content-type"), body=decode(response.body, response.header("content-type")))
    got = replace(got, ok=True) if 200 <= response.status <= 299 else failed(got, response.status, f"HTTP {response.status}")
    route = fallback_route(got)
    if route and route not in state.fallbacks:
        return onward(state, route, fallbacks=(*state.fallbacks, route))
    target = refresh_target(got)
    if target and target not in state.refreshes:
        return onward(state, target, refreshes=(*state.refreshes, target))
    return got


def onward(state: State, target: str, **seen) -> State:
    after = replace(state, at=target, start=target, redirects=(), rounds=state.rounds + 1, **seen)
    return failed(after, 0, "too many meta refresh redirects") if after.rounds >= REFRESHES else after


def redirect_target(response: Response, base: str) -> str | None:
    location = response.header("location")
    if not 300 <= response.status <= 399 or not location:
        return None
    url = parse(location, base)
    if url is None:
        return location if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", location) else None
    return replace(url, fragment=None).href


# Where an answer sends the reader.

_TAG = re.compile(r"<(/?)(noscript|script|meta)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_HANDLER = re.compile(r"\son[a-z]+\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.IGNORECASE)
# Words by which a page says that it sends its reader on.
_SENDS_ON = re.compile("redirect(?:ing|ed)", re.IGNORECASE)


def elements(html: str) -> Iterator[tuple[str, dict[str, str], int]]:
    """Opening tags of metas and scripts outside noscript: name, attributes, end."""
    silent = False
    for m in _TAG.finditer(html):
        name = m[2].lower()
        if name == "noscript":
            silent = not m[1]
        elif not silent and not m[1]:
            yield name, {k.lower(): next((x for x in v if x), "") for k, *v in _ATTRIBUTE.findall(m[3])}, m.end()


def refresh_target(state: State) -> str | None:
    """Where a page sends its reader: the first meta refresh outside noscript, else a script that says it redirects."""
    if not state.ok or "html" not in state.content_type.lower():
        return None
    contents = (a.get("content", "") for name, a, _ in elements(state.body) if name == "meta" and a.get("http-equiv", "").strip().lower() == "refresh")
    target = meta_target(next(contents, "")) or script_target(state.body)
    url = parse(target.strip("'\""), state.at) if target else None
    return replace(url, fragment=None).href if url else None


def meta_target(content: str) -> str | None:
    """The address in `seconds; url=address`; the word and the equals sign may lack."""
    _, _, after = content.partition(";")
    for at, name in ((0, content), (len(content) - len(after), after)):
        key, equals, _ = name.partition("=")
        if equals and key.strip().lower() == "url":
            return content[at + len(key) + 1 :].strip() or None
    return after.strip() or None


def script_target(html: str) -> str | None:
    """Where scripts go: the first address that one replaces its place by, else the last that one assigns."""
    if not _SENDS_ON.search(html):
        return None
    starts = [end for name, _, end in elements(html) if name == "script"]
    bodies = [html[start : end if (end := html.lower().find("</script", start)) >= 0 else len(html)] for start in starts]
    found = [places_set(js) for js in (*bodies, *(a or b for a, b in _HANDLER.findall(html)))]
    replaced, assigned = ([x for pair in found for x in pair[i]] for i in (0, 1))
    return next(iter(replaced), None) or next(reversed(assigned), None)


def is_front_matter_only(text: str) -> bool:
    body = text.strip()
    end = body.find("\n---", 3)
    return body.startswith("---") and end >= 0 and not body[end + 4 :].strip()


def fallback_route(state: State) -> str | None:
    """Another route to try for documents that are not there under their file name."""
    url = parse(state.start)
    if url is None:
        return None
    gone = state.status in (404, 410)
    if url.path.endswith(".html"):
        return replace(url, path=url.path[:-5], fragment=None).href if gone else None
    hollow = state.ok and (not state.body.strip() or is_front_matter_only(state.body))
    if not url.path.endswith(".md") or not (gone or hollow):
        return None
    parts = [p for p in url.path.split("/") if p]
    if len(parts) == 1 and parts[0].lower() != "docs.md":
        return replace(url, path=f"/docs/{parts[0]}", fragment=None).href
    return replace(url, path=url.path[:-3], fragment=None).href


# Text of a body.

_BOMS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
_CHARSET = re.compile(r"\bcharset\s*=\s*(\"[^\"]+\"|'[^']+'|[^;\s]+)", re.IGNORECASE)
_META = re.compile(r"<meta\b[^>]*\bcharset\s*=\s*(\"[^\"]+\"|'[^']+'|[^\s\"'/>]+)", re.IGNORECASE)
_META_TYPE = re.compile(r"<meta\b[^>]*\bcontent\s*=\s*[\"'][^\"']*\bcharset\s*=\s*([^\"'\s;/>]+)", re.IGNORECASE)


def encodings(body: bytes, content_type: str) -> list[str]:
    """Encodings to try: byte order mark, header, the page's own word, UTF-8."""
    head = body[:4096].decode("latin-1")
    said = [next((name for mark, name in _BOMS if body.startswith(mark)), None)]
    for found in (_CHARSET.search(content_type), _META.search(head) or _META_TYPE.search(head)):
        said.append(found[1].strip().strip("\"'").lower() if found else None)
    # The web reads Latin-1 and ASCII as windows-1252.
    said = ["cp1252" if s in ("iso-8859-1", "latin1", "latin-1", "us-ascii", "ascii", "windows-1252") else s for s in said]
    return list(dict.fromkeys(s for s in [*said, "utf-8"] if s))


# The web reads the bytes that windows-1252 leaves open as controls.
codecs.register_error("c1", lambda fault: ("".join(map(chr, fault.object[fault.start : fault.end])), fault.end))


def decode(body: bytes, content_type: str = "") -> str:
    for name in encodings(body, content_type):
        try:
            return codecs.decode(body, name, "c1" if name == "cp1252" else "strict").removeprefix("﻿")
        except (LookupError, UnicodeError, TypeError):
            continue
    return body.decode("utf-8", "replace").removeprefix("﻿")


# Cookies and retries, for live requests.


@dataclass
class CookieJar:
    held: dict[tuple[str, str], tuple[str, bool, bool]] = field(default_factory=dict)

    def store(self, url: str, lines: tuple[str, ...]) -> None:
        host = parse(url).host
        for line in lines:
            pair, *rest = [x.strip() for x in line.split(";")]
            name, equals, value = pair.partition("=")
            if not equals or not name:
                continue
            options = {k.lower(): v for k, _, v in (x.partition("=") for x in rest)}
            asked = options.get("domain", "").removeprefix(".").lower()
            fits = "." in asked and (host == asked or host.endswith("." + asked))
            domain = asked if fits else host
            self.held[name, domain] = (value, domain == host and asked != host, "secure" in options)

    def header(self, url: str) -> str:
        place = parse(url)
        here = lambda domain, only: place.host == domain or (not only and place.host.endswith("." + domain))
        return "; ".join(f"{n}={v}" for (n, d), (v, only, secure) in self.held.items() if here(d, only) and (not secure or place.scheme == "https"))


def retry_delay(attempt: int, after: str | None, now: float, noise: float) -> float:
    """Seconds before the next attempt."""
    if after:
        try:
            return min(float(after), 10.0)
        except ValueError:
            try:
                return min(max(0.0, parsedate_to_datetime(after).timestamp() - now), 10.0)
            except ValueError:
                pass
    return min(0.25 * 2**attempt + 0.08 * noise, 2.5)


def may_retry_status(status: int, attempt: int, enabled: bool) -> bool:
    return enabled and attempt < ATTEMPTS - 1 and (status == 429 or status >= 500)


def may_retry_error(error: Exception) -> bool:
    text = f"{type(error).__name__} {error}"
    return not (TIMEOUT.search(text) or "refused" in text.lower() or UNSAFE.search(str(error)) or "exceeds" in text)


# Topic pages: text kept in a JSON file beside the page.

_TOPIC = re.compile(r"\bdata-topic\s*=\s*[\"']([^\"']{1,300}\.json(?:\?[^\"']*)?)[\"']", re.IGNORECASE)


def topic_url(html: str, base: str) -> str | None:
    found = _TOPIC.search(html)
    if found is None:
        return None
    url = parse(found[1].replace("&amp;", "&").replace("&quot;", '"').replace("&#39;", "'"), base)
    home = parse(base)
    return replace(url, fragment=None).href if url and home and url.origin == home.origin else None


def topic_links(topic: str, base: str) -> list[str]:
    """Values of `url` anywhere in the JSON that stay on the site, in order."""
    try:
        stack = [json.loads(topic)]
    except ValueError:
        return []
    home, out = parse(base), {}
    while stack:
        here = stack.pop()
        if isinstance(here, dict):
            url = parse(here["url"], home) if isinstance(here.get("url"), str) else None
            if url and url.origin == home.origin:
                out[replace(url, fragment=None).href] = None
            stack.extend(reversed(list(here.values())))
        elif isinstance(here, list):
            stack.extend(reversed(here))
    return list(out)[:TOPIC_LINKS]


def with_topic(html: str, topic: str, base: str) -> str:
    """The page with its topic's links as navigation and its JSON as a script."""
    from html import escape

    if not topic.strip():
        return html
    links = "".join(f'<a href="{escape(u)}">{escape(u)}</a>' for u in topic_links(topic, base))
    nav = f"<nav data-topic-links>{links}</nav>" if links else ""
    safe = re.sub("</script", r"<\\/script", topic.strip(), flags=re.IGNORECASE)
    return f'{html}\n{nav}<script type="application/json" id="topic-data">{safe}</script>'
