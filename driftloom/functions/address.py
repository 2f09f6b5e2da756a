"""Which URLs may be fetched: public http(s) hosts only."""

from __future__ import annotations

import ipaddress
import socket
import time

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .weburl import parse

# Networks that are not public.
PRIVATE_V4 = tuple(
    map(
        ipaddress.IPv4Network,
        "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 100.64.0.0/10 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 "
        "192.88.99.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/3".split(),
    )
)
PUBLIC_V6 = ipaddress.IPv6Network("2000::/3")
PRIVATE_V6 = tuple(map(ipaddress.IPv6Network, "2001::/32 2001:2::/48 2001:10::/28 2001:20::/28 2001:db8::/32 2002::/16 3fff::/20".split()))


def is_public_address(text: str) -> bool:
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return False
    if address.version == 6 and address.ipv4_mapped is not None:
        address = address.ipv4_mapped
    if address.version == 4:
        return not any(address in n for n in PRIVATE_V4)
    return address in PUBLIC_V6 and not any(address in n for n in PRIVATE_V6)


def is_public_ipv4(host: Column) -> Column:
    """Column form for dotted addresses: the address as a number against the networks' ranges."""
    parts = F.split(host, r"\.")
    octets = [F.get(parts, i).try_cast("long") for i in range(4)]
    number = octets[0] * (1 << 24) + octets[1] * (1 << 16) + octets[2] * (1 << 8) + octets[3]
    inside = F.lit(False)
    for net in PRIVATE_V4:
        inside = inside | number.between(int(net.network_address), int(net.broadcast_address))
    valid = (F.size(parts) == 4) & F.forall(F.array(*octets), lambda x: x.isNotNull() & x.between(0, 255))
    return valid & ~inside


def refusal(raw: str | None) -> str | None:
    """Why a URL may not be fetched; None if it may."""
    if raw is None:
        return "invalid URL"
    text = raw.strip()
    url = parse(text)
    if url is None:
        head, colon, _ = text.partition(":")
        other = colon and head[:1].isalpha() and head.isascii() and head.lower() not in ("http", "https")
        return "URL must use http or https" if other else "invalid URL"
    if url.user:
        return "URL credentials are not allowed"
    host = url.host.strip("[]")
    if not host or host == "localhost" or host.endswith(".localhost"):
        return "localhost URLs are not allowed"
    try:
        ipaddress.ip_address(host)
    except ValueError:
        return None if "." in host else "single-label hostnames are not allowed"
    return None if is_public_address(host) else "private or internal IP addresses are not allowed"


@F.pandas_udf(StringType())
def public_url_error(url: pd.Series) -> pd.Series:
    return pd.Series([refusal(u) for u in url], dtype=object)


class Resolver:
    """Looks hosts up; every address must be public, the first is pinned for a minute."""

    def __init__(self, lookup=None, keep: float = 60.0, clock=time.monotonic):
        self.lookup = lookup or (lambda host: [x[4][0] for x in socket.getaddrinfo(host, None, type=socket.SOCK_STREAM)])
        self.keep, self.clock, self.known = keep, clock, {}

    def resolve(self, raw: str) -> str:
        if error := refusal(raw):
            raise ValueError(error)
        host = parse(raw).host.strip("[]")
        try:
            return str(ipaddress.ip_address(host))
        except ValueError:
            pass
        if host in self.known and self.known[host][1] > self.clock():
            return self.known[host][0]
        found = self.lookup(host)
        if not found:
            raise ValueError("hostname did not resolve")
        if not all(map(is_public_address, found)):
            raise ValueError("hostname resolves to a private or internal address")
        self.known[host] = (found[0], self.clock() + self.keep)
        return found[0]
