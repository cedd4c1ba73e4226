"""Fetching with manners: a host's addresses by one task, a pause between requests, and what robots.txt allows.

Addresses are dealt by host, so a host's pauses are kept however many tasks there are; hosts beside
each other run at once.  robots.txt is asked once a host and task; where it can't be had, all is allowed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .documents import FETCHED, Fetcher, _limited, fetch_one

#: Bytes of robots.txt that are read, at most.
MAX_ROBOTS_BYTES = 512 << 10


def robots_of(root: str, fetcher: Fetcher, agent: str) -> tuple[Callable[[str], bool], float]:
    """(whether an address is allowed, the pause that the host asks for, or 0)."""
    try:
        _, _, content = fetcher(f"{root}/robots.txt")
        parser = RobotFileParser()
        parser.parse(_limited(content, MAX_ROBOTS_BYTES).decode("utf-8", "replace").splitlines())
        return lambda url: parser.can_fetch(agent, url), float(parser.crawl_delay(agent) or 0)
    except Exception:  # no robots.txt, or none that can be read: all is allowed
        return lambda url: True, 0.0


def fetch_politely(
    urls: DataFrame, fetcher: Fetcher, resolve: Callable[[str], list[str]] | None = None, delay_s: float = 0.5, most_delay_s: float = 30.0, agent: str = "quern", sleep: Callable[[float], None] = time.sleep
) -> DataFrame:
    """As ``documents.fetch``: (url, final_url, kind, content, error) of ``urls`` (url), each distinct one once.

    Between two requests to a host lie ``delay_s``, or what its robots.txt asks for (``most_delay_s`` at most); what that forbids has
    the error ``robots``.  Addresses without a host are errors and ask nobody.
    """

    def root_of(url: str) -> str:
        parts = urlsplit(url or "")
        return f"{parts.scheme}://{parts.netloc}".lower() if parts.scheme in ("http", "https") and parts.hostname else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, allowed, pause, asked = None, None, 0.0, 0.0
        for batch in batches:
            for url in batch.column(1).to_pylist():
                here = root_of(url)
                if here != root:
                    root, asked = here, 0.0
                    checked = here and fetch_one(here, lambda u: (u, "text/html", b""), resolve)[3] is None
                    allowed, wish = robots_of(here, fetcher, agent) if checked else (lambda u: True, 0.0)
                    pause = min(max(delay_s, wish), most_delay_s)
                if not allowed(url):
                    row: tuple = (None, None, None, "robots")
                else:
                    if asked and root:
                        sleep(max(0.0, asked + pause - time.monotonic()))
                    row = fetch_one(url, fetcher, resolve)
                    asked = time.monotonic()
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((url, *row), FETCHED.values(), strict=True)], list(FETCHED))

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z]+://(?:[^/@?#]*@)?([^/?#]*)", 1))
    dealt = urls.select("url").distinct().select(host.alias("host"), "url").repartition("host").sortWithinPartitions("host", "url")
    return dealt.mapInArrow(run, ", ".join(f"{n} {'binary' if t == pa.binary() else 'string'}" for n, t in FETCHED.items()))
