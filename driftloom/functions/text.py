"""Text and Markdown primitives as Column expressions.

White space is the class of the web platform, which holds more than ASCII; it is
spelt out because Java's `\\s` is ASCII only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, inside brackets of a regular expression.
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same class for Java: the range in front settles most characters at once. (SQL's engine has no intersections.)
FAST_SPACE = r"\t-\r [\x{A0}-\x{FEFF}&&[\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
#: What ends a line for `^`, `$` and `.`.
LINE_END = r"\n\r\x{2028}\x{2029}"
LINE_START = rf"(?:^|(?<=[{LINE_END}]))"
#: An inline link: text, target, and what follows the target inside the parentheses.
LINK = rf"\[([^\]]*)\]\(([^){SPACE}]+)([^)]*)\)"


def text_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text_column(value), rf"^[{FAST_SPACE}]+|[{FAST_SPACE}]+\z", "")


def whitespace_key(value: Column | str) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text_column(value), rf"[{FAST_SPACE}]+", " "))


def word_count(value: Column | str) -> Column:
    """Number of runs of characters that are not white space."""
    return F.regexp_count(text_column(value), F.lit(rf"[^{FAST_SPACE}]++"))


def length_utf16(value: Column | str) -> Column:
    """Length in UTF-16 units: code points, and one more for each beyond U+FFFF."""
    value = text_column(value)
    return F.char_length(value) + F.regexp_count(value, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, also where lambdas inside use it."""
    return F.get(F.transform(F.array(value), body), 0)


def unique_by_whitespace(values: Column | str) -> Column:
    """The values whose key is not blank and new, in order, as they were."""
    pairs = F.transform(text_column(values), lambda v: F.struct(whitespace_key(v).alias("k"), v.alias("v")))

    def firsts(full: Column) -> Column:
        return bound(full["k"], lambda keys: F.filter(F.transform(full, lambda x, i: F.when(F.array_position(keys, x["k"]) == i + 1, x["v"])), lambda v: v.isNotNull()))

    return bound(F.filter(pairs, lambda x: x["k"] != ""), firsts)


def markdown_links(markdown: Column | str) -> Column:
    """Array of (text, href, suffix) of all inline links; images count."""
    found = [F.regexp_extract_all(text_column(markdown), F.lit(LINK), F.lit(i)) for i in (1, 2, 3)]
    zipped = F.arrays_zip(found[0].alias("text"), found[1].alias("href"), found[2].alias("suffix"))
    return F.transform(zipped, lambda x: F.struct(x["text"].alias("text"), x["href"].alias("href"), x["suffix"].alias("suffix")))


def link_hrefs(markdown: Column | str) -> Column:
    """Link targets in document order, repeats included, as written."""
    return F.regexp_extract_all(text_column(markdown), F.lit(LINK), F.lit(2))


def link_count(markdown: Column | str) -> Column:
    return F.regexp_count(text_column(markdown), F.lit(LINK))


def replace_links(markdown: Column | str, replace: Callable[[Column, Column], Column]) -> Column:
    """Each link becomes `replace(link, index)`; where that is null it stays.

    The text between links is what splitting leaves: one piece more than links.
    """
    markdown = text_column(markdown)
    whole = F.regexp_extract_all(markdown, F.lit(LINK), F.lit(0))
    paired = F.arrays_zip(markdown_links(markdown).alias("link"), whole.alias("whole"))
    new = F.transform(paired, lambda x, i: F.coalesce(replace(x["link"], i), x["whole"]))
    gaps = F.split(markdown, LINK, -1)
    return bound(new, lambda done: F.array_join(F.transform(gaps, lambda g, i: F.concat(F.coalesce(F.get(done, i - 1), F.lit("")), g)), ""))


def markdown_title(markdown: Column | str, fallback: Column) -> Column:
    """The first level-1 heading, else the fallback."""
    found = F.regexp_extract(text_column(markdown), rf"{LINE_START}#[{SPACE}]+([^{LINE_END}]+)", 1)
    return F.coalesce(F.nullif(strip(found), F.lit("")), fallback)


def is_page(ok: Column | str = "ok") -> Column:
    return text_column(ok) == F.lit(True)


def has_output(ok: Column | str = "ok", path: Column | str = "output_path") -> Column:
    return is_page(ok) & (F.coalesce(text_column(path), F.lit("")) != "")
