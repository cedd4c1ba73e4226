"""Pages to text: noise dropped, tables as Markdown, one line a text node; titles and links.

The standard library's parser reads the page; the tree is only as deep as what is open.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without content of their own, and elements that are noise.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = frozenset("script style nav footer header noscript iframe form svg aside button".split())
ROOTS = ("main", "article", "body")
#: Tables within tables that are tables of their own; rows of deeper ones are rows of the last of these.
NESTED = 64
#: Pages whose texts and links a task holds at once.
PAGES = 64


def table_markdown(rows: list[list[str]]) -> str:
    """Rows of cells as Markdown; rows without text are skipped, a rule follows the first of two rows or more."""
    rows = [r for r in rows if any(r)]
    lines = ["| " + " | ".join(c.replace("|", "/") for c in r) + " |" for r in rows]
    if len(rows) > 1:
        lines.insert(1, "| " + " | ".join("---" for _ in rows[0]) + " |")
    return "\n".join(lines)


class PageReader(HTMLParser):
    """Text nodes by root, the title, and the links of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.count: Counter[str] = Counter()  # of open elements by tag, so that none need be searched
        self.noise = 0
        self.nodes: dict[str, list[str]] = {r: [] for r in ("", *ROOTS)}
        self.done: set[str] = set()
        self.title: list[str] = []
        self.links: list[str] = []
        self.tables: list[dict] = []
        self.own: list[bool] = []  # for each open table, whether it is one of ``tables``

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)
        if tag in VOID:
            return
        self.open.append(tag)
        self.count[tag] += 1
        self.noise += tag in NOISE
        if tag == "table":
            self.own.append(not self.noise and len(self.tables) < NESTED)
            if self.own[-1]:
                self.tables.append({"rows": []})
        elif self.noise:
            pass
        elif self.tables and tag == "tr":
            self.tables[-1]["rows"].append([])
        elif self.tables and tag in ("td", "th") and self.tables[-1]["rows"]:
            self.tables[-1]["rows"][-1].append([])

    def handle_endtag(self, tag: str) -> None:
        if not self.count[tag]:
            return
        while self.open:
            last = self.open.pop()
            self.count[last] -= 1
            self.noise -= last in NOISE
            if last == "table" and self.own.pop():
                t = self.tables.pop()
                text = table_markdown([[" ".join(c) for c in row] for row in t["rows"]])
                if self.tables:
                    self.handle_data(text)
                elif text:
                    self._keep(text.split("\n"))
            if last in ROOTS and not self.count[last] and self.nodes[last]:
                self.done.add(last)  # the first of its kind is the root
            if last == tag:
                return

    def _keep(self, lines: list[str]) -> None:
        for root in self.nodes:
            if not root or (self.count[root] and root not in self.done):
                self.nodes[root] += lines

    def handle_data(self, data: str) -> None:
        if self.count["title"] and not self.count["body"] and not self.count["svg"]:
            self.title.append(data)
        if self.noise or self.count["title"]:
            return
        if self.tables:
            rows = self.tables[-1]["rows"]
            if rows and rows[-1] and data.strip():
                rows[-1][-1].append(" ".join(data.split()))
            return
        self._keep([s for line in data.split("\n") if (s := line.strip())])

    def text(self) -> str:
        root = next((r for r in ROOTS if self.nodes[r]), "")
        return "\n".join(self.nodes[root])


def read_page(html: str | None) -> PageReader:
    reader = PageReader()
    reader.feed(html or "")
    reader.close()
    while reader.open:
        reader.handle_endtag(reader.open[-1])
    return reader


def absolute_links(base: str | None, hrefs: list[str]) -> list[str]:
    """http(s) links made absolute, without fragments, each once, in order."""
    out = {}
    for href in hrefs:
        try:
            url = urldefrag(urljoin(base or "", href.strip()))[0]
            if urlsplit(url).scheme in ("http", "https"):
                out[url] = None
        except ValueError:
            continue
    return list(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, PAGES):
            batch = whole.slice(lo, PAGES)
            titles, texts, links = [], [], []
            for url, html in zip(batch.column(1), batch.column(2), strict=True):  # one page's text at a time
                url = url.as_py()
                page = read_page(html.as_py())
                titles.append(" ".join("".join(page.title).split()) or url)
                texts.append(page.text())
                links.append(absolute_links(url, page.links))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array(links, pa.list_(pa.string()))], ["page_id", "url", "title", "text", "links"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text, links) of ``pages`` (page_id, url, html); the title of an untitled page is its URL."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kind}, url string, title string, text string, links array<string>")


def link_table(extracted: DataFrame) -> DataFrame:
    """(page_id, url, link, kind) of every link; PDF addresses are told from pages by the path."""
    pdf = F.lower(F.regexp_extract("link", r"^[^?#]*", 0)).endswith(".pdf")
    return extracted.select("page_id", "url", F.explode("links").alias("link")).withColumn("kind", F.when(pdf, "pdf").otherwise("html"))
