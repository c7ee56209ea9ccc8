"""Membership of IP literals in blocks that must not be dialled."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Blocked networks.
BLOCKED = (
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/8", "100.64.0.0/10", "198.18.0.0/15", "192.0.0.0/24", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/128", "::1/128", "fc00::/7", "fe80::/10", "2001:db8::/32", "ff00::/8",
)
MAPPED = "IPv4-mapped"
_NETWORKS = [ipaddress.ip_network(b) for b in BLOCKED]


def label_of(text: str | None) -> str | None:
    """The block that holds a literal, MAPPED for public IPv4 in IPv6 dress, null for public literals and for names."""
    try:
        ip = ipaddress.ip_address(text or "")
    except ValueError:
        return None
    low = int(ip)
    inner = ip.version == 6 and ((low >> 32 == 0 and low > 1) or low >> 32 == 0xFFFF)
    if inner:
        ip = ipaddress.IPv4Address(low & 0xFFFFFFFF)
    found = next((str(n) for n in _NETWORKS if n.version == ip.version and ip in n), None)
    return (found or MAPPED) if inner else found


@F.pandas_udf(T.StringType())
def blocked_label(ip: pd.Series) -> pd.Series:
    known = {x: label_of(x) for x in ip.unique()}
    return ip.map(known)
