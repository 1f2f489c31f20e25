"""Pages by address: every hop is checked before it is asked for.

The network itself is two functions of the caller: ``resolve(host)`` gives the
addresses of a host, ``get(url)`` gives ``status, location or None, body``.
They run in the tasks, an address at a time.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

#: fixed values: schemes that are fetched, redirects and bytes of a page at most
SCHEMES, REDIRECTS, PAGE_BYTES = ("http", "https"), 5, 20 << 20

Resolve = Callable[[str], list[str]]
Get = Callable[[str], tuple[int, str | None, bytes]]


def refusal(url: str, resolve: Resolve) -> str | None:
    """Why an address must not be fetched: another scheme, no host, or a host on this machine or a private network."""
    try:
        parts = urlsplit(url)
        host = parts.hostname
    except ValueError:
        return "not an address"
    if parts.scheme not in SCHEMES:
        return "only http and https addresses are fetched"
    if not host:
        return "the address has no host"
    try:
        found = resolve(host)
    except OSError as e:
        return f"cannot resolve {host}: {e}"
    for text in found:
        a = ipaddress.ip_address(text)
        if a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast or a.is_unspecified:
            return f"{host} is on this machine or a private network"
    return None if found else f"cannot resolve {host}"


def fetch_page(url: str, resolve: Resolve, get: Get) -> tuple[str, str | None, bytes | None]:
    """``status, reason, body``: converted with the page, or failed with the reason."""
    now = url
    for _ in range(REDIRECTS):
        why = refusal(now, resolve)
        if why:
            return "failed", why, None
        try:
            status, location, body = get(now)
        except Exception as e:  # noqa: BLE001  outcomes are rows
            return "failed", f"fetch failed: {e}"[:300], None
        if not (300 <= status < 400 and location):
            break
        now = urljoin(now, location)
    else:
        return "failed", f"more than {REDIRECTS} redirects", None
    if status >= 400:
        return "failed", f"fetch failed: status {status}", None
    if len(body) > PAGE_BYTES:
        return "failed", "over the size limit", None
    return ("converted", None, body) if body.strip() else ("failed", "no content returned", None)


def fetch(urls: DataFrame, resolve: Resolve, get: Get, column: str = "url") -> DataFrame:
    """``url, status, reason, content`` of each address."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = [(u, *fetch_page(u, resolve, get)) for u in df[column]]
            yield pd.DataFrame(rows, columns=["url", "status", "reason", "content"])

    return urls.select(column).mapInPandas(run, "url string, status string, reason string, content binary")
