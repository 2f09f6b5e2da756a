"""Tokens of scripts, as far as reading routes, texts and redirects needs them."""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""(?P<line>\s*\n\s*)|(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<quoted>'(?:\\.|[^'\\\n])*')"""
    r"""|(?P<pattern>(?<=[(,=:\[!&|?{};])/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])*/)"""
    r"""|(?P<string>"(?:\\.|[^"\\])*")|(?P<template>`(?:\\.|[^`\\])*`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d+)|(?P<mark>=>|.)""",
    re.DOTALL,
)
PLAIN = frozenset({"string", "template", "name", "number", "mark"})

Token = tuple[str, str]


def tokens(js: str, kinds: frozenset[str] = PLAIN) -> list[Token]:
    """(kind, text) of the tokens of some kinds, in order."""
    return [(m.lastgroup, m[0]) for m in _TOKEN.finditer(js) if m.lastgroup in kinds]


_WITH_LINES = PLAIN | {"quoted", "line"}
#: Longest expression, in characters, that is read as an address.
LONGEST = 240


def _sum(terms: list[Token], names: dict[str, str]) -> str | None:
    """Value of a sum of strings and known names; the query and fragment of the place count as empty."""
    text = "".join(t for _, t in terms)
    if not terms or len(text) > LONGEST:
        return None
    out: list[str] = []
    part: list[Token] = []
    for token in [*terms, ("mark", "+")]:
        if token != ("mark", "+"):
            part.append(token)
            continue
        words = [t for _, t in part if t not in ("window", ".")]
        if words in (["location", "search"], ["location", "hash"]):
            value = ""
        elif len(part) != 1:
            return None
        elif part[0][0] in ("string", "quoted", "template"):
            value = part[0][1][1:-1]
            if part[0][0] == "template" and "$" in value:
                return None
        else:
            value = names.get(part[0][1])
        if value is None:
            return None
        out.append(value)
        part = []
    return "".join(out)


def places_set(js: str) -> tuple[list[str], list[str]]:
    """Addresses that a script replaces its place by, and those that it assigns to it, as far as they are constant."""
    found = tokens(js, _WITH_LINES)
    texts = [t.strip() or "\n" for _, t in found]
    names: dict[str, str] = {}
    replaced, assigned = [], []
    for i, (kind, _) in enumerate(found):
        before = texts[i - 1] if i else ""
        if kind == "name" and texts[i + 1 : i + 2] == ["="] and found[i + 2 : i + 3] and found[i + 2][0] in ("string", "quoted") and before in ("const", "let", "var", ",", ";"):
            names[texts[i]] = found[i + 2][1][1:-1]
    for i, text in enumerate(texts):
        if text != "location":
            continue
        if texts[i + 1 : i + 4] == [".", "replace", "("]:
            end = next((j for j in range(i + 4, len(texts)) if texts[j] == ")"), len(texts))
            replaced.append(_sum([t for t in found[i + 4 : end] if t[0] != "line"], names))
        at = i + 3 if texts[i + 1 : i + 3] == [".", "href"] else i + 1
        if texts[at : at + 1] == ["="] and texts[at + 1 : at + 2] != ["="]:
            end = next((j for j in range(at + 1, len(texts)) if texts[j] in (";", "\n")), len(texts))
            assigned.append(_sum(found[at + 1 : end], names))
    return [x for x in replaced if x], [x for x in assigned if x is not None]
