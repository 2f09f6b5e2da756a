"""One pass over HTML: a tolerant tree, its features and its main content as Markdown.

Used inside a single Arrow pass; everything that follows from the features is
Column expressions (`extract`).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser

from ..functions.javascript import tokens

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CHROME = frozenset("script style noscript template svg nav aside footer form button select iframe head header".split())
#: What a start tag closes if it is open within the nearest of the boundaries.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_SPACE = re.compile(r"\s+")
_REFERENCE = re.compile(r"&(?:(#[0-9]+;|#[xX][0-9A-Fa-f]+;)|([A-Za-z][A-Za-z0-9]*;))?")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def text(self, skip: frozenset[str] = frozenset()) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in skip:
                stack.extend(reversed(node.children))
        return "".join(out)

    def inside(self, test) -> bool:
        node = self.parent
        while node is not None:
            if test(node):
                return True
            node = node.parent
        return False


class _Builder(HTMLParser):
    def __init__(self, mark: str = ""):
        super().__init__(convert_charrefs=True)
        self.mark = mark
        self.root = Node("#document", {}, None)
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._leave({"p"}, {"article", "section", "div", "table", "li", "td", "th", "blockquote"})
        if rule := CLOSES.get(tag):
            self._leave(*rule)
        node = Node(tag, {k: self._plain(v or "") for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _leave(self, tags, boundary):
        node = self.at
        while node.parent is not None and node.tag not in boundary:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(self._plain(data))

    def _plain(self, text):
        return text.replace(self.mark, "&") if self.mark else text


def tree(html: str, strict: bool = False) -> Node:
    """The tree of a page. HTML also reads `&amp` and a few more without their semicolon; `strict` leaves those as they are."""
    mark = ""
    if strict:
        mark = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in html)
        html = _REFERENCE.sub(lambda m: m[0] if m[1] or m[2] in html5 else mark + m[0][1:], html)
    builder = _Builder(mark)
    builder.feed(html)
    builder.close()
    return builder.root


def squeeze(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def words(text: str) -> int:
    return len(text.split())


# Markdown of a subtree.


def _inline(node: Node | str) -> str:
    if isinstance(node, str):
        return _SPACE.sub(" ", node)
    tag = node.tag
    if tag in CHROME:
        return ""
    if tag == "br":
        return "\n"
    if tag == "img":
        source = node.attrs.get("src", "")
        return f"![{squeeze(node.attrs.get('alt', ''))}]({source})" if source else ""
    if tag == "code":
        return f"`{node.text()}`" if node.text().strip() else ""
    inner = "".join(map(_inline, node.children))
    if tag == "a" and (href := node.attrs.get("href", "").strip()) and inner.strip():
        return f"[{squeeze(inner)}]({href})"
    mark = {"strong": "**", "b": "**", "em": "*", "i": "*"}.get(tag, "")
    if mark and inner.strip():
        lead, trail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
        return f"{lead}{mark}{inner.strip()}{mark}{trail}"
    return inner


def _lines(text: str) -> str:
    return "\n".join(x for x in (re.sub(r"[ \t]+", " ", line).strip() for line in text.split("\n")) if x)


def _table(node: Node) -> str:
    rows = [[squeeze(_cell(c)).replace("|", "\\|") for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in node.all("tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    rule = ["---"] * width
    return "\n".join("| " + " | ".join(r) + " |" for r in [rows[0], rule, *rows[1:]])


def _cell(node: Node) -> str:
    return " ".join(filter(None, (_inline(c) for c in node.children)))


def _list(node: Node, depth: int) -> str:
    out, number = [], 0
    for item in node.children:
        if not isinstance(item, Node) or item.tag != "li":
            continue
        number += 1
        mark = f"{number}." if node.tag == "ol" else "-"
        body = [c for c in item.children if not (isinstance(c, Node) and c.tag in ("ul", "ol"))]
        line = squeeze("".join(_inline(c) for c in body))
        nested = [_list(c, depth + 1) for c in item.children if isinstance(c, Node) and c.tag in ("ul", "ol")]
        out += [f"{'  ' * depth}{mark} {line}"] * bool(line) + [n for n in nested if n]
    return "\n".join(out)


def markdown(node: Node) -> str:
    """Headings, paragraphs, lists, links, images, code, tables and quotes of a subtree."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        if text := _lines("".join(run)):
            out.append(text)
        run.clear()

    for child in node.children:
        tag = None if isinstance(child, str) else child.tag
        if tag is None or (tag not in BLOCKS and tag not in CHROME and not any(n.tag in BLOCKS for n in child.walk())):
            run.append(_inline(child))
            continue
        flush()
        if tag in CHROME:
            continue
        if re.fullmatch("h[1-6]", tag):
            if text := squeeze(_inline_all(child)):
                out.append(f"{'#' * int(tag[1])} {text}")
        elif tag == "pre":
            body = child.text().strip("\n")
            fence = "````" if "```" in body else "```"
            code = child.first("code")
            named = re.search(r"(?:language|lang)-([\w+#.-]+)", code.attrs.get("class", "")) if code else None
            out.append(f"{fence}{named[1] if named else ''}\n{body}\n{fence}")
        elif tag in ("ul", "ol"):
            out.append(_list(child, 0))
        elif tag == "table":
            out.append(_table(child))
        elif tag == "blockquote":
            out.append("\n".join(f"> {line}".rstrip() for line in markdown(child).split("\n")))
        elif tag == "hr":
            out.append("---")
        else:
            out.append(markdown(child))
    flush()
    return "\n\n".join(x for x in out if x.strip())


def _inline_all(node: Node) -> str:
    return "".join(map(_inline, node.children))


# Features.

_SIDE = re.compile("sidebar|navigation|toc", re.IGNORECASE)


def is_side(node: Node) -> bool:
    return node.tag in ("nav", "aside") or node.attrs.get("role") == "navigation" or _SIDE.search(node.attrs.get("class", "")) is not None


def main_content(root: Node) -> Node | None:
    """`main`, else `article`, else the block with the most text outside links, weighed against its size."""
    found = root.first("main") or root.first("article")
    if found is not None:
        return found
    best, most = root.first("body"), 0.0
    for node in root.all("div", "section", "td"):
        if is_side(node) or node.tag in CHROME or node.inside(lambda n: is_side(n) or n.tag in CHROME):
            continue
        direct = sum(len(squeeze(c.text(CHROME))) for c in node.children if isinstance(c, Node) and c.tag in ("p", "pre", "ul", "ol", "table", "blockquote"))
        linked = sum(len(squeeze(a.text())) for a in node.all("a"))
        if direct - linked > most:
            best, most = node, float(direct - linked)
    return best


def readable_text(node: Node) -> str:
    """All text of a subtree: pieces joined by spaces, none before punctuation."""
    pieces, stack = [], [node]
    while stack:
        here = stack.pop()
        if isinstance(here, str):
            pieces.append(here)
        else:
            stack.extend(reversed(here.children))
    return re.sub(r"\s+([,.;:!?])", r"\1", squeeze(" ".join(pieces)))


def page_text(root: Node) -> str:
    found = root.first("main") or root.first("article")
    if found is None:
        whole = [root.first("body"), root.first("html"), root]
        found = next((n for n in whole if n is not None and words(n.text()) >= 8), None)
    return readable_text(found) if found is not None else ""


def meta(root: Node, name: str) -> str | None:
    for node in root.all("meta"):
        key = node.attrs.get("name", node.attrs.get("property", ""))
        if key.lower() == name and (content := node.attrs.get("content", "").strip()):
            return content
    return None


def title_of(root: Node) -> str | None:
    for tag in ("h1", "title"):
        node = root.first(tag)
        if node is not None and (text := node.text().strip()):
            return text
    return meta(root, "og:title") or meta(root, "twitter:title")


def unique(values: list[str | None]) -> list[str]:
    """Distinct by their words, blank ones dropped, the first kept as it is."""
    kept: dict[str, str] = {}
    for value in values:
        if value and (key := squeeze(value)):
            kept.setdefault(key, value)
    return list(kept.values())


def metadata_markdown(root: Node, title: str | None) -> str | None:
    values = unique([f"# {title}" if title else None, *(meta(root, n) for n in ("description", "og:description", "twitter:description"))])
    return "\n\n".join(values) if words(" ".join(values)) >= 8 else None


# Headings of a page's frame rather than of its text.
_CHROME_HEADING = re.compile(r"(?:our api|hello world|support|sign in|search(?: developer site)?)\Z", re.IGNORECASE)
OUTLINE_CHARS, OUTLINE_ANCHORS = 2_000_000, 500


def outline(root: Node, html: str, title: str | None, anchors: int) -> str | None:
    """Headings of a huge page instead of its text."""
    if len(html) < OUTLINE_CHARS or anchors < OUTLINE_ANCHORS:
        return None
    heads = [squeeze(n.text()) for n in root.all("h1", "h2", "h3")]
    heads = unique([h for h in heads if not _CHROME_HEADING.match(h)])[:120]
    if len(heads) < 3:
        return None
    parts = [f"# {title}" if title else None, meta(root, "description"), "## Page Outline\n\n" + "\n".join(f"- {h}" for h in heads)]
    text = "\n\n".join(unique(parts))
    return text if words(text) >= 8 else None


# Text serialised in scripts.

_SCRIPT = re.compile(r"<script\b(?![^>]*\bsrc=)[^>]*>(.*?)</script>", re.IGNORECASE | re.DOTALL)
# Keys whose strings come first, in this order; commas from which a string is a list; shapes of strings that are not prose.
TELLING_KEYS, LISTED = ("children", "description", "title"), 5
NOT_PROSE = tuple(
    re.compile(p, f)
    for p, f in (
        (r"^(?:https?:|/|#|\$|[a-z]+-[a-z0-9-]+$)", re.IGNORECASE),
        (r"^[A-Z0-9_.$:-]+$", 0),
        (r"^[a-z0-9_-]{12,}$", re.IGNORECASE),
        (r"__", 0),
        (r"^(?:\d+\s*)+\d+px(?:\s+\d+)*$", re.IGNORECASE),
        (r"\.(?:css|js|mjs|woff2?|png|jpe?g|webp|svg)(?:\?|$)", re.IGNORECASE),
        (r"[{};]", 0),
        (r"\b(?:viewport|theme-color|max-image-preview|shortcut icon|index, follow)\b", re.IGNORECASE),
        (r"(?:className|data-|aria-|xmlns|viewBox|strokeWidth)", 0),
        (r"^(?:use strict|token(?:\s+\S+){0,3}|const\s+\S+)$", re.IGNORECASE),
        (r"page (?:could |was )?not be found|return home|report an issue", re.IGNORECASE),
    )
)
# Fixed value: a utility class name; three of them make a string a list of classes.
_UTILITY = re.compile(r"[a-z][a-z0-9:#[\]/.-]*-[a-z0-9:#[\]/.-]+\Z", re.IGNORECASE)


def is_prose(value: str) -> bool:
    text = squeeze(value)
    if not 3 <= len(text) <= 1200 or " " not in text or not re.search("[A-Za-z]{2}", text):
        return False
    if text.count(",") >= LISTED or any(p.search(text) for p in NOT_PROSE):
        return False
    return sum(_UTILITY.match(token) is not None for token in text.split()) < 3


@dataclass
class _Literals:
    """Strings of scripts by worth: a list for each telling key, the last for all strings."""

    ranked: list[list[str]] = field(default_factory=lambda: [[] for _ in (*TELLING_KEYS, "any")])

    def read(self, js: str, depth: int = 0) -> None:
        """Take in a script; strings that hold scripts themselves are read too, twice removed at most."""
        found = tokens(js, frozenset({"string", "name", "mark"}))
        for i, (kind, raw) in enumerate(found):
            if kind != "string" or not (value := _unquoted(raw)):
                continue
            nested = depth < 2
            key = _unquoted(found[i - 2][1]) if i >= 2 and found[i - 1][1] == ":" and found[i - 2][0] == "string" else None
            if key in TELLING_KEYS:
                self.ranked[TELLING_KEYS.index(key)].append(value)
                if nested and "\\" in value:
                    self.read(value, depth + 1)
            if nested and len(value) > 500:
                self.read(value, depth + 1)
            else:
                self.ranked[-1].append(value)


def _unquoted(literal: str) -> str:
    try:
        return str(json.loads(literal)).strip()
    except ValueError:
        return ""


def serialised_text(html: str, title: str | None) -> str | None:
    """Prose from inline scripts, strings under telling keys first; None below 40 words."""
    literals = _Literals()
    for body in _SCRIPT.findall(html):
        literals.read(body)
    known = squeeze(title) if title else ""
    values = [v for group in literals.ranked for v in group if squeeze(v) != known and is_prose(v)]
    parts = [squeeze(v) for v in unique(values)][:160]
    if words(" ".join(parts)) < 40:
        return None
    return "\n\n".join([f"# {title}"] * bool(title) + parts)


def is_control(node: Node) -> bool:
    """A link that opens a menu."""
    toggle = node.attrs.get("data-bs-toggle", node.attrs.get("data-toggle", ""))
    if toggle.lower() == "dropdown":
        return True
    return "dropdown-toggle" in node.attrs.get("class", "").split() and node.attrs.get("role") == "button" and "aria-expanded" in node.attrs


def hrefs(nodes: list[Node]) -> list[str]:
    return [h for n in nodes if not is_control(n) and (h := n.attrs.get("href", ""))]


def nav_hrefs(root: Node) -> list[str]:
    """Targets of navigation links, place by place: nav, aside, then classes and roles of sidebars."""
    anchors = [n for n in root.all("a") if "href" in n.attrs]
    named = lambda word: lambda n: word in n.attrs.get("class", "").lower()
    places = [lambda n: n.tag == "nav", lambda n: n.tag == "aside", named("sidebar"), named("navigation"), named("toc"), lambda n: n.attrs.get("role") == "navigation"]
    return hrefs([a for place in places for a in anchors if a.inside(place)])


def features(html: str, strict: bool = False) -> dict:
    """What extraction and discovery need of one page."""
    root = tree(html, strict)
    scripts = [n.attrs.get("src", n.attrs.get("href", "")) for n in root.all("script", "link") if ("src" if n.tag == "script" else "href") in n.attrs]
    for node in list(root.walk()):
        node.children = [c for c in node.children if isinstance(c, str) or c.tag not in ("script", "style")]
    title = title_of(root)
    canonical = next((n.attrs.get("href") for n in root.all("link") if n.attrs.get("rel") == "canonical"), None)
    anchors = root.all("a")
    linked = [n for n in anchors if "href" in n.attrs]
    main, body = main_content(root), root.first("body") or root
    return {
        "title": title,
        "canonical_href": canonical,
        "base_href": next((n.attrs["href"] for n in root.all("base") if "href" in n.attrs), None),
        "main_markdown": markdown(main) if main is not None else "",
        "page_text": page_text(root),
        "metadata": metadata_markdown(root, title),
        "outline": outline(root, html, title, len(anchors)),
        "serialised": serialised_text(html, title),
        "anchors": hrefs(linked),
        "nav": nav_hrefs(root),
        "scripts": scripts,
        "n_anchors": len(linked),
        "body_chars": len(squeeze(body.text(frozenset({"noscript"})))),
    }
