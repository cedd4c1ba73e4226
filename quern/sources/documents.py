"""PDF files, fetched pages and manifests as DataFrames; extractors and fetchers are pluggable.

Failures are rows with an ``error``, never exceptions of a job.
"""

from __future__ import annotations

import ipaddress
import socket
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

MAX_PDF_BYTES = 50 * 1024 * 1024
MAX_PDF_PAGES = 500
MAX_WEB_PDF_BYTES = 30 * 1024 * 1024
MAX_HTML_BYTES = 5 * 1024 * 1024
HTML_TYPES = ("text/html", "application/xhtml+xml")

#: Of a file's bytes: the text of each page, or a ValueError with the reason (a password, a bad file).
Extractor = Callable[[bytes], list[str]]
#: Of a URL: (final URL, content type, the body as bytes or in pieces), or a ValueError.
Fetcher = Callable[[str], tuple[str, str, bytes | Iterable[bytes]]]


def scan_pdfs(spark: SparkSession, root: str) -> DataFrame:
    """(path, source, length, content) of all PDF files below a folder; ``source`` is the path within it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return files.select("path", F.regexp_replace(F.regexp_replace("path", r"^[A-Za-z]+:/*", ""), f"^\\Q{base}\\E/", "").alias("source"), "length", "content")


def one_pdf(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """The same of one file; its source is the path within ``root``, or outside of it the bare file name."""
    plain = lambda p: p.split(":", 1)[-1].lstrip("/")
    base, own = plain(root.rstrip("/")) + "/" if root else None, plain(path)
    source = own[len(base) :] if base and own.startswith(base) else own.rsplit("/", 1)[-1]
    return spark.read.format("binaryFile").load(path).select("path", F.lit(source).alias("source"), "length", "content")


def extract_pdfs(files: DataFrame, extractor: Extractor, max_bytes: int = MAX_PDF_BYTES) -> DataFrame:
    """(source, text, error): cleaned pages joined by blank lines; files too large are told by their length alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for content in batch.column(1):
                try:
                    pages = extractor(content.as_py() or b"")
                    if len(pages) > MAX_PDF_PAGES:
                        raise ValueError(f"more than {MAX_PDF_PAGES} pages")
                    texts.append(pages)
                    errors.append(None)
                except Exception as e:  # one file's failure is a row
                    texts.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.list_(pa.string())), pa.array(errors, pa.string())], ["source", "pages", "error"])

    large = files.where(F.col("length") > max_bytes).select("source", F.lit(None).cast("string").alias("text"), F.lit("too large").alias("error"))
    read = files.where(F.col("length") <= max_bytes).select("source", "content").mapInArrow(run, "source string, pages array<string>, error string")
    text = F.array_join(F.filter(F.transform("pages", lambda p: T.clean_page(p)), lambda p: p != ""), "\n\n")
    done = read.select("source", F.nullif(text, F.lit("")).alias("text"), "error").withColumn("error", F.when(F.col("text").isNull() & F.col("error").isNull(), "no text").otherwise(F.col("error")))
    return done.unionByName(large)


def address_allowed(address: str) -> bool:
    """Whether an address is public: not private, loopback, link-local, reserved, multicast or unspecified."""
    ip = ipaddress.ip_address(address)
    return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified)


def check_url(url: str, resolve: Callable[[str], list[str]] | None = None) -> str | None:
    """Why a URL must not be fetched, or None: its scheme, credentials in it, or where its host leads."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https"):
        return "scheme"
    if parts.username or parts.password:
        return "credentials"
    if not parts.hostname:
        return "host"
    resolve = resolve or (lambda h: [x[4][0] for x in socket.getaddrinfo(h, None)])
    try:
        return None if all(address_allowed(a) for a in resolve(parts.hostname)) else "address"
    except (OSError, ValueError):
        return "host"


class TooLarge(Exception):
    """A body went beyond its limit while it was read."""


def _limited(content: bytes | Iterable[bytes], limit: int) -> bytes:
    """The body, read no further than its limit."""
    if isinstance(content, (bytes, bytearray)):
        content = [content]
    held = bytearray()
    for piece in content:
        held += piece
        if len(held) > limit:
            raise TooLarge
    return bytes(held)


class _NoRedirects(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def http_fetcher(resolve: Callable[[str], list[str]] | None = None, timeout_s: float = 20, redirects: int = 5, agent: str = "quern", piece: int = 1 << 16) -> Fetcher:
    """A fetcher by the standard library: every redirect's target is checked before it is asked, and the body comes in pieces."""

    def get(url: str) -> tuple[str, str, Iterable[bytes]]:
        opener = urllib.request.build_opener(_NoRedirects)
        for _ in range(redirects + 1):
            if reason := check_url(url, resolve):
                raise ValueError(f"redirect: {reason}")
            try:
                answer = opener.open(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout_s)
            except urllib.error.HTTPError as e:
                with e:
                    if e.code not in (301, 302, 303, 307, 308) or not e.headers.get("Location"):
                        raise ValueError(f"status {e.code}") from None
                    url = urljoin(url, e.headers["Location"])
                continue

            def pieces():
                with answer:
                    while part := answer.read(piece):
                        yield part

            return url, answer.headers.get("Content-Type", ""), pieces()
        raise ValueError("redirect: too many")

    return get


#: What is known of a fetched address.
FETCHED = {"url": pa.string(), "final_url": pa.string(), "kind": pa.string(), "content": pa.binary(), "error": pa.string()}


def fetch_one(url: str, fetcher: Fetcher, resolve: Callable[[str], list[str]] | None = None) -> tuple[str | None, str | None, bytes | None, str | None]:
    """(final address, kind, content, error) of an address; the address after redirects must be one that may be fetched, too."""
    if reason := check_url(url or "", resolve):
        return None, None, None, reason
    try:
        final, content_type, content = fetcher(url)
        if reason := check_url(final, resolve) if final != url else None:
            return final, None, None, f"redirect: {reason}"
        kind = content_type.partition(";")[0].strip().lower()
        pdf = kind == "application/pdf" or urlsplit(final).path.lower().endswith(".pdf")
        if not pdf and kind not in HTML_TYPES:
            return final, None, None, f"content type {kind}"
        name, limit = ("pdf", MAX_WEB_PDF_BYTES) if pdf else ("html", MAX_HTML_BYTES)
        try:
            return final, name, _limited(content, limit), None
        except TooLarge:
            return final, name, None, "too large"
    except Exception as e:  # one address's failure is its own
        return None, None, None, str(e) or type(e).__name__


def fetch(urls: DataFrame, fetcher: Fetcher, resolve: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(url, final_url, kind, content, error) of ``urls`` (url): pages up to 5 MB, PDF files up to 30 MB.

    ``fetcher`` gives the address after redirects, the content type, and the body as bytes or in pieces, of which no
    more are taken than the limit allows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                row = (url, *fetch_one(url, fetcher, resolve))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, FETCHED.values(), strict=True)], list(FETCHED))

    return urls.select("url").mapInArrow(run, "url string, final_url string, kind string, content binary, error string")


def read_sources(spark: SparkSession, text: str) -> tuple[DataFrame, list[str]]:
    """(sources, failures) of a YAML list under ``web_sources``; an empty file has none, a bad entry is a failure."""
    import yaml

    loaded = yaml.safe_load(text) or {}
    if not isinstance(loaded, dict):
        raise ValueError("the root of a source list is a mapping")
    rows, bad = [], []
    for i, e in enumerate(loaded.get("web_sources") or []):
        if not isinstance(e, dict) or not e.get("url"):
            bad.append(f"entry {i}")
            continue
        rows.append((str(e["url"]), e.get("title"), bool(e.get("crawl", False)), int(e.get("max_depth", 1)), int(e.get("max_pages", 30)), bool(e.get("fetch_pdfs", True))))
    frame = spark.createDataFrame(rows, "url string, title string, crawl boolean, max_depth int, max_pages int, fetch_pdfs boolean")
    return frame.withColumn("kind", T.dispatch(F.col("url"), F.col("crawl"))), bad


def join_manifest(files: DataFrame, manifest: DataFrame, limit: int = 100_000) -> DataFrame:
    """``files`` (source) with the manifest's title, url and tables: by path, else by file name; the stem is a missing title."""
    fields = ["title", "url", "tables"]
    hint = F.broadcast if manifest.limit(limit + 1).count() <= limit else (lambda x: x)
    unique = manifest.groupBy("file").agg(F.min_by(F.struct(*fields), F.struct(*fields)).alias("m"))
    by_path = hint(unique.select(F.col("file").alias("source"), F.col("m").alias("_p")))
    by_name = hint(unique.select(F.col("file").alias("_name"), F.col("m").alias("_q")))
    out = files.withColumn("_name", F.regexp_extract("source", "([^/]*)$", 1)).join(by_path, "source", "left").join(by_name, "_name", "left")
    found = F.coalesce("_p", "_q")
    return out.withColumn("title", T.or_else(found["title"], T.stem(F.col("source")))).withColumn("url", found["url"]).withColumn("tables", F.coalesce(found["tables"], F.lit(True))).drop("_name", "_p", "_q")
