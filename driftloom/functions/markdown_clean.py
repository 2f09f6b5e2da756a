"""Cleaning of Markdown written with page components: one pass over lines, in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Components that only wrap, components that may carry a title, and the index banner.
WRAPPERS = frozenset("AccordionGroup CardGroup CodeGroup Frame Info Note Steps Tabs Tip Warning".split())
TITLED = frozenset("Accordion Card Step Tab".split())
BANNER = re.compile(
    r"\A> ## Documentation Index\n> Fetch the complete documentation index at: https?:\/\/\S+\n"
    r"> Use this file to discover all available pages before exploring further\.\n\n?"
)

_TAG = re.compile(r"<(/?)([A-Z][A-Za-z0-9]*)(?:\s[^>]*)?>\Z")
_FRAME = re.compile(r"<iframe\b[^>]*/?>\Z", re.IGNORECASE | re.ASCII)
_FENCE = re.compile(r"(\s*)(`{3,}|~{3,})(.*)\Z")
_LANGUAGE = re.compile(r"[A-Za-z0-9_#+.-]+")
_SPACES = "\t\n\x0b\x0c\r                  　﻿"


def _attribute(tag: str, name: str) -> str | None:
    found = re.search(rf"{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", tag)
    return next((g for g in found.groups() if g is not None), None) if found else None


def _component(line: str) -> tuple[int, str | None] | None:
    """Change of depth and heading of a component line; None if it is not one."""
    body = line.strip(_SPACES)
    margin = line[: len(line) - len(line.lstrip(_SPACES))]
    if len(margin) > 3 or not body.startswith("<"):
        return None
    if _FRAME.match(body):
        return 0, None
    tag = _TAG.match(body)
    if tag is None or tag[2] not in WRAPPERS | TITLED:
        return None
    if tag[1]:
        return -1, None
    heading = None
    if tag[2] in TITLED and (title := _attribute(body, "title")):
        href = _attribute(body, "href")
        heading = f"{margin}### [{title}]({href})" if href else f"{margin}### {title}"
    return (0 if body.endswith("/>") else 1), heading


def clean(markdown: str) -> str:
    """Without banner and components, fences with plain language tags, at most one blank line in a row."""
    kept: list[str] = []
    depth, fence = 0, ""
    for line in BANNER.sub("", markdown).split("\n"):
        lead = len(line) - len(line.lstrip(" "))
        line = line[2 * min(depth, lead // 2) :]
        if fence:
            kept.append(line)
            inner = line.strip(_SPACES)
            if inner.startswith(fence) and not inner.strip(fence[0]):
                fence = ""
        elif (component := _component(line)) is not None:
            step, heading = component
            depth = max(0, depth + step)
            if heading is not None:
                kept.append(heading)
        elif opening := _FENCE.match(line):
            fence = opening[2]
            language = _LANGUAGE.match(opening[3].strip(_SPACES))
            kept.append(opening[1] + fence + (language[0] if language else ""))
        else:
            kept.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip(_SPACES)


@F.pandas_udf(StringType())
def clean_markdown(markdown: pd.Series) -> pd.Series:
    return markdown.map(clean, na_action="ignore")
