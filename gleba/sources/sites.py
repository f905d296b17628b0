"""Sites as rows: where each begins, how it pages and by which layout its cards are read; all of them in one frame."""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleba.functions import text as T
from gleba.sources import html
from gleba.sources.rest import PagedHttp


@dataclass(frozen=True)
class Site:
    """name, first address (with {page} or {offset} where it counts), layout by name; base: what its links lead from, if not its address."""

    name: str
    url: str
    layout: str = "generic"
    paging: str = "number"
    base: str = ""


def site_pages(spark: SparkSession, sites: list[Site], **options: str) -> DataFrame:
    """(name, layout, page_id, page, html): the pages of all sites, a task a host."""
    spark.dataSource.register(PagedHttp)
    got = []
    for paging in sorted({s.paging for s in sites}):
        group = [s for s in sites if s.paging == paging]
        pages = spark.read.format("paged_http").options(paging=paging, urls="\n".join(s.url for s in group), **options).load()
        names = spark.createDataFrame([(s.url, s.name, s.layout) for s in group], "site string, name string, layout string")
        got.append(pages.where("body is not null").join(F.broadcast(names), "site"))  # a row a site is broadcast
    every = functools.reduce(DataFrame.unionByName, got)
    return every.select("name", "layout", F.xxhash64("name", "page").alias("page_id"), "page", F.col("body").alias("html"))


def site_cards(spark: SparkSession, sites: list[Site], **options: str) -> DataFrame:
    """The cards of all sites with their prices and sizes read; an address that a site shows on several pages counts on the first."""
    pages, got = site_pages(spark, sites, **options), []
    for site in sites:
        layout = replace(html.LAYOUTS[site.layout], base=site.base or site.url)
        mine = pages.where(F.col("name") == site.name)
        cards = html.cards(mine, layout, site.name).join(mine.select("page_id", "page"), "page_id")
        got.append(cards)
    cards = functools.reduce(DataFrame.unionByName, got)
    first = [c for c in cards.columns if c not in ("layout", "url")]
    cards = cards.groupBy("layout", "url").agg(F.min_by(F.struct(*first), F.struct("page", "pos")).alias("x")).select(F.col("layout").alias("source"), "url", "x.*")
    return cards.withColumns({"price": T.parse_price(T.clean(F.col("price_text"))), "size_m2": T.parse_size(T.clean(F.coalesce("size_text", "text")))})
