"""Breadth-first reach over a table of links, one join a level, and crawls that fetch as they go."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import host, same_domain
from ..sources import html
from .store import written


def crawl(links: DataFrame, seeds: DataFrame, max_depth: int = 1, allowed: Column | None = None) -> DataFrame:
    """(url, depth): pages reached from ``seeds`` (url) over ``links`` (src, dst) in at most ``max_depth`` steps.

    Each level's frontier is joined to the links and loses what was visited; it is written to
    the shared folder, so a lost executor costs a level at most.  ``allowed`` is a condition on
    ``dst``; the driver sees one count a level.
    """
    if allowed is not None:
        links = links.where(allowed)
    visited = written(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    frontier = visited
    for depth in range(1, max_depth + 1):
        new = frontier.join(links, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct().join(visited.select("url"), "url", "left_anti")
        frontier = written(new.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def within(domain: str) -> Column:
    """A condition on ``dst``: its host is the domain or below it."""
    d = domain.lower().removeprefix("www.")
    return (host(F.col("dst")) == d) | host(F.col("dst")).endswith("." + d)


def budgeted(visited: DataFrame, max_pages: int) -> DataFrame:
    """The first ``max_pages`` visited pages by depth and URL: the crawl's page budget."""
    return visited.orderBy("depth", "url").limit(max_pages)


#: Of addresses (url, each once): (url, final_url, kind, content, error), as ``sources.documents.fetch`` gives them.
Fetch = Callable[[DataFrame], DataFrame]


def crawl_pages(seeds: DataFrame, fetch: Fetch, max_depth: int = 1, max_pages: int = 30, fetch_pdfs: bool = True) -> DataFrame:
    """(seed, url, depth, final_url, kind, content, error) of what was fetched from ``seeds`` (url), each seed's crawl on its own host and below it.

    At most ``max_pages`` pages of a seed are visited, those that fail included, by depth and then by URL.  PDF
    files that a visited page links are fetched at whatever depth, each once a seed, and don't count.  An
    address of several seeds is fetched once a level.  Failures are rows with ``error``.
    """

    def fetched(wanted: DataFrame, depth: int) -> DataFrame:
        got = written(fetch(wanted.select("url").distinct()))  # not fetched again by a retried task or a later level
        missing = F.when(F.col("_got").isNull(), "not fetched").otherwise(F.col("error"))
        joined = wanted.select("seed", "url").join(got.withColumn("_got", F.lit(True)), "url", "left")
        return joined.select("seed", "url", F.lit(depth).alias("depth"), "final_url", "kind", "content", missing.alias("error"))

    def linked(pages: DataFrame) -> DataFrame:
        read = pages.where("error IS NULL AND kind = 'html'").select("url", F.coalesce("final_url", "url").alias("final_url"), F.make_valid_utf8(F.col("content").cast("string")).alias("html")).dropDuplicates(["url"])
        links = html.link_table(html.extract_pages(read.select(F.col("url").alias("page_id"), F.col("final_url").alias("url"), "html"))).select(F.col("page_id").alias("url"), "link", F.col("kind").alias("link_kind"))
        return written(pages.select("seed", "url").join(links, "url").select("seed", F.col("link").alias("url"), "link_kind").distinct())

    frontier = seeds.where("url IS NOT NULL").select(F.col("url").alias("seed"), "url").distinct()
    levels, found, visited = [], [], None
    for depth in range(max_depth + 1):
        place = F.row_number().over(Window.partitionBy("seed").orderBy("url"))
        left = frontier.withColumn("_place", place).where(F.col("_place") <= max_pages)  # so many of a task's are shuffled, at most
        if visited is not None:
            left = left.join(visited.groupBy("seed").agg(F.count(F.lit(1)).alias("_n")), "seed", "left")
        budget = F.lit(max_pages) - (F.coalesce("_n", F.lit(0)) if visited is not None else F.lit(0))
        level = written(fetched(left.where(F.col("_place") <= budget), depth))
        levels.append(level)
        found.append(linked(level))
        visited = reduce(DataFrame.unionByName, [x.select("seed", "url") for x in levels])
        pages = found[-1].where(F.col("link_kind") == "html").where(same_domain(F.col("url"), host(F.col("seed"))))
        frontier = written(pages.select("seed", "url").join(visited, ["seed", "url"], "left_anti"))
        if frontier.isEmpty():
            break
    if fetch_pdfs:
        files = reduce(DataFrame.unionByName, found).where("link_kind = 'pdf'").select("seed", "url").distinct()
        levels.append(written(fetched(files.join(visited, ["seed", "url"], "left_anti"), max_depth + 1).withColumn("depth", F.lit(None).cast("int"))))
    return reduce(DataFrame.unionByName, levels)


def crawl_report(crawled: DataFrame) -> DataFrame:
    """(seed, visited, pages, pdfs, errors): of every seed the pages visited, those read, the PDF files read, and what failed of both."""
    good = F.col("error").isNull()
    return crawled.groupBy("seed").agg(
        F.count_if(F.col("depth").isNotNull()).alias("visited"),
        F.count_if(good & (F.col("kind") == "html")).alias("pages"),
        F.count_if(good & (F.col("kind") == "pdf")).alias("pdfs"),
        F.count_if(~good).alias("errors"),
    )
