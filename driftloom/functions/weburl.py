"""URL parsing and resolution by the rules of the web platform, for http and https.

Python, for relative and irregular references; regular absolute URLs are taken
apart by Column expressions in `urls`.
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, replace
from urllib.parse import unquote_to_bytes

_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_PATH_SAFE = set(range(0x21, 0x7F)) - set(b'"#<>?`{}^')
_QUERY_SAFE = set(range(0x21, 0x7F)) - set(b"\"#<>'")
_HOST_BANNED = re.compile(r"[\x00-\x20\x7f#%/:<>?@\[\\\]^|]")
_USER_SAFE = _PATH_SAFE - set(b"/:;=@[\\]|")


@dataclass(frozen=True)
class WebUrl:
    scheme: str
    user: str
    host: str
    port: int | None
    path: str
    query: str | None
    fragment: str | None

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host}" + (f":{self.port}" if self.port is not None else "")

    @property
    def href(self) -> str:
        user = f"{self.user}@" if self.user else ""
        port = f":{self.port}" if self.port is not None else ""
        query = "" if self.query is None else f"?{self.query}"
        fragment = "" if self.fragment is None else f"#{self.fragment}"
        return f"{self.scheme}://{user}{self.host}{port}{self.path}{query}{fragment}"

    def bare(self) -> WebUrl:
        return replace(self, query=None, fragment=None)


def _escape(text: str, safe: set[int]) -> str:
    if all(ord(c) in safe for c in text):
        return text
    return "".join(chr(b) if b in safe else f"%{b:02X}" for b in text.encode("utf-8", "replace"))


def _ipv4_part(text: str) -> int | None:
    try:
        if text[:2].lower() == "0x":
            return int(text[2:] or "0", 16)
        if len(text) > 1 and text[0] == "0":
            return int(text, 8)
        return int(text) if text.isdecimal() and text.isascii() else None
    except ValueError:
        return None


def _ipv4(host: str) -> str | None:
    """Canonical dotted form if the last label is numeric; raises where it then is no address."""
    labels = host.split(".")
    if labels[-1] == "" and len(labels) > 1:
        labels.pop()
    last = labels[-1]
    if not (last.isascii() and last.isdecimal()) and not re.fullmatch(r"0[xX][0-9A-Fa-f]*", last):
        return None
    numbers = [_ipv4_part(x) if x else None for x in labels]
    if len(numbers) > 4 or None in numbers:
        raise ValueError("host")
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise ValueError("host")
    value = numbers[-1] + sum(n << (8 * (3 - i)) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def parse_host(raw: str) -> str:
    if raw.startswith("["):
        if not raw.endswith("]") or "%" in raw:
            raise ValueError("host")
        value = ipaddress.IPv6Address(raw[1:-1])
        return f"[{_ipv6_text(value)}]"
    host = unquote_to_bytes(raw).decode("utf-8", "replace")
    host = host.lower() if host.isascii() else host.encode("idna").decode("ascii").lower()
    if not host or _HOST_BANNED.search(host):
        raise ValueError("host")
    return _ipv4(host) or host


def _ipv6_text(value: ipaddress.IPv6Address) -> str:
    """Shortest form in hexadecimal groups; the first longest run of two or more zeros is cut."""
    groups = [f"{int(value) >> shift & 0xFFFF:x}" for shift in range(112, -1, -16)]
    best, run = (0, 0), 0
    for i, g in enumerate([*groups, "x"]):
        if g == "0":
            run += 1
            continue
        if run > best[1]:
            best = (i - run, run)
        run = 0
    if best[1] < 2:
        return ":".join(groups)
    return ":".join(groups[: best[0]]) + "::" + ":".join(groups[best[0] + best[1] :])


def _segments(path: str, before: list[str]) -> str:
    """Dot segments resolved, the rest escaped."""
    out, parts = list(before), re.split(r"[/\\]", path)
    for i, part in enumerate(parts):
        plain, last = part.lower().replace("%2e", "."), i == len(parts) - 1
        if plain == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(_escape(part, _PATH_SAFE | {0x25}))
    return "/" + "/".join(out)


def parse(raw: str, base: WebUrl | str | None = None) -> WebUrl | None:
    """The URL, resolved against an absolute base if given; None where the platform would raise or for other schemes."""
    try:
        return _parse(raw, parse(base) if isinstance(base, str) else base)
    except (ValueError, UnicodeError):
        return None


def _parse(raw: str, base: WebUrl | None) -> WebUrl | None:
    text = re.sub(r"[\t\n\r]", "", raw.strip("".join(map(chr, range(0x21)))))
    text, mark, after = text.partition("#")
    fragment = _escape(after, (_PATH_SAFE | set(b"#?{}%^")) - {0x60}) if mark else None
    scheme = _SCHEME.match(text)
    name = scheme[1].lower() if scheme else None
    if name is not None and name not in ("http", "https"):
        return None
    rest = text[scheme.end() :] if scheme else text
    slashed = rest.replace("\\", "/")
    head, mark, search = rest.partition("?")
    query = _escape(search, _QUERY_SAFE | {0x25}) if mark else None
    if name is None and base is None:
        return None
    if name is not None and not (base and base.scheme == name and not slashed.startswith("/")) or name is None and slashed.startswith("//"):
        authority, path = re.match(r"[/\\]*([^/\\]*)(.*)\Z", head, re.DOTALL).groups()
        user, _, place = authority.rpartition("@")
        found = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", place)
        if found is None:
            return None
        kind = name or base.scheme
        port = int(found[2]) if found[2] else None
        if port is not None and port > 65535:
            return None
        who, sep, secret = user.partition(":")
        known = _escape(who, _USER_SAFE | {0x25}) + (f":{_escape(secret, _USER_SAFE | {0x25})}" if sep and secret else "")
        return WebUrl(kind, known, parse_host(found[1]), None if port == _PORTS[kind] else port, _segments(path[1:], []) if path else "/", query, fragment)
    if not head:
        return replace(base, query=query if mark else base.query, fragment=fragment)
    if slashed.startswith("/"):
        return replace(base, path=_segments(head[1:], []), query=query, fragment=fragment)
    return replace(base, path=_segments(head, base.path.split("/")[1:-1]), query=query, fragment=fragment)
