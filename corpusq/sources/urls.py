"""A data source that fetches URLs in many tasks: redirects, sizes and times are bounded, and every URL gives a row.

    spark.dataSource.register(Urls)
    spark.read.format("urls").option("urls", json.dumps([...])).load()

gives (url, final_url, content, error).  Every hop of a redirect is checked as the first address is: other schemes than
http and https, and local or private hosts, are refused, names being resolved before.  The list travels in an option and is
for what a user names; ``imports.fetch`` takes a DataFrame of any length.
"""

from __future__ import annotations

import ipaddress
import json
import socket
import urllib.request
from collections.abc import Iterator
from urllib.error import HTTPError
from urllib.parse import urljoin, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST, REDIRECTS, SECONDS, PER_TASK = 100 << 20, 5, 30, 16
SCHEMA = "url string, final_url string, content binary, error string"


class Refused(ValueError):
    pass


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def check(url: str, allow: tuple[str, ...] = ()) -> None:
    """Raise where the address must not be fetched; ``allow`` names hosts that may be local."""
    parts = urlsplit(url)
    if parts.scheme.lower() not in ("http", "https") or not parts.hostname:
        raise Refused("this address is not allowed")
    host = parts.hostname.lower().rstrip(".")
    if host in allow:
        return
    if host == "localhost" or host.endswith((".localhost", ".local", ".internal")):
        raise Refused("this host is not allowed")
    try:
        found = {x[4][0] for x in socket.getaddrinfo(host, parts.port or 80, type=socket.SOCK_STREAM)}
    except OSError as e:
        raise ValueError(f"{host} is not known") from e
    if any(not ipaddress.ip_address(x.partition("%")[0]).is_global for x in found):
        raise Refused("this host is not allowed")


def get(url: str, most: int = MOST, redirects: int = REDIRECTS, seconds: float = SECONDS, allow: tuple[str, ...] = ()) -> tuple[str, bytes]:
    """The last address and its content."""
    opener = urllib.request.build_opener(_Stay)
    for _ in range(redirects + 1):
        check(url, allow)
        try:
            with opener.open(urllib.request.Request(url, headers={"User-Agent": "corpusq"}), timeout=seconds) as answer:
                content = answer.read(most + 1)
                if len(content) > most:
                    raise ValueError("too large")
                return url, content
        except HTTPError as e:
            if e.code not in (301, 302, 303, 307, 308) or not e.headers.get("Location"):
                raise ValueError(f"status {e.code}") from e
            url = urljoin(url, e.headers["Location"])
    raise ValueError("too many redirects")


def visit(url: str, **limits) -> tuple[str, str | None, bytes | None, str | None]:
    """A row of ``SCHEMA``."""
    try:
        final, content = get(url, **limits)
        return url, final, content, None
    except Exception as e:
        return url, None, None, str(e)[:500]


class Some(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class Reader(DataSourceReader):
    def __init__(self, urls: list[str], per_task: int, limits: dict) -> None:
        self.urls, self.per_task, self.limits = urls, per_task, limits

    def partitions(self) -> list[Some]:
        return [Some(self.urls[i : i + self.per_task]) for i in range(0, len(self.urls), self.per_task)] or [Some([])]

    def read(self, partition: Some) -> Iterator[tuple]:
        for url in partition.urls:
            yield visit(url, **self.limits)


class Urls(DataSource):
    """Options: ``urls`` (a JSON list), ``perTask``, ``most`` (bytes), ``redirects``, ``seconds``, ``allow`` (a JSON list of hosts)."""

    @classmethod
    def name(cls) -> str:
        return "urls"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        o = self.options
        limits = {"most": int(o.get("most", MOST)), "redirects": int(o.get("redirects", REDIRECTS)), "seconds": float(o.get("seconds", SECONDS)), "allow": tuple(json.loads(o.get("allow", "[]")))}
        return Reader(list(dict.fromkeys(json.loads(o.get("urls", "[]")))), int(o.get("pertask", PER_TASK)), limits)
