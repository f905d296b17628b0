"""Queries over paged sources: the pages are written down from the listings first, then read back as a site would be."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gleba.functions import text as T
from gleba.plans.listing_queries import card_html
from gleba.session import shared_folder, table
from gleba.sources import feeds, html
from gleba.sources.rest import PagedHttp
from gleba.sources.sites import Site, site_cards


def _stored(spark: SparkSession, pages: DataFrame, *by: str) -> str:
    """The address of a folder with the column body of each row in a folder of its own."""
    root = shared_folder(spark)
    root = f"{root if '://' in root else root if root.startswith('file:') else 'file://' + root}/pages-{uuid.uuid4().hex}"
    pages.repartition(*by).write.partitionBy(*by).text(root)
    return root.replace("file:///", "file:/").replace("file:/", "file:///")


def _site_pages(spark: SparkSession, sf_dir: str, size: int = 20) -> DataFrame:
    """(site, page, last, b): twenty cards a page, the pages of three sites, numbered from 1."""
    df = table(spark, sf_dir, "site_listings").where("url is not null and price is not null").withColumn("site", F.concat(F.lit("s"), F.pmod("listing_id", F.lit(3)).cast("string")))
    df = df.withColumn("page", F.expr(f"(row_number() over (partition by site order by listing_id) - 1) div {size} + 1"))
    cards = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("listing_id", card_html().alias("c")))), lambda s: s["c"]), "\n")
    pages = df.groupBy("site", "page").agg(cards.alias("b"))
    return pages.withColumn("last", F.max("page").over(Window.partitionBy("site")))


def _listings_of(cards: DataFrame) -> DataFrame:
    return cards.select("source", "url", "title", F.col("price.amount").alias("price"), "size_m2")


def pages_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sites, page after page, up to the page that isn't there."""
    root = _stored(spark, _site_pages(spark, sf_dir).select("site", "page", F.concat(F.lit("<html><body>"), "b", F.lit("</body></html>")).alias("body")), "site", "page")
    sites = [Site(f"s{i}", f"{root}/site=s{i}/page={{page}}", "object", "number", "https://x.example/") for i in range(3)]
    return _listings_of(site_cards(spark, sites, delay="0", most="100000"))


def pages_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sites, from link to link to the next page."""
    link = F.when(F.col("page") < F.col("last"), F.concat(F.lit('<a rel="next" href="page='), (F.col("page") + 1).cast("string"), F.lit('">more</a>'))).otherwise("")
    root = _stored(spark, _site_pages(spark, sf_dir).select("site", "page", F.concat(F.lit("<html><body>"), "b", link, F.lit("</body></html>")).alias("body")), "site", "page")
    sites = [Site(f"s{i}", f"{root}/site=s{i}/page=1", "object", "next", "https://x.example/") for i in range(3)]
    return _listings_of(site_cards(spark, sites, delay="0", most="100000"))


def pages_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street features from a service that gives 400 at a time, read into the dimension by their middle vertex."""
    step = 400
    line = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array("lon", "lat"), F.array(F.lit(1.0), F.lit(1.0)))
    feature = F.struct(F.struct(F.col("name").alias("STREETNAME"), F.col("ressort").alias("RESSORTNAM")).alias("properties"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"))
    rows = table(spark, sf_dir, "streets").select(feature.alias("f"), (F.expr(f"(row_number() over (order by street_id) - 1) div {step}") * step).alias("offset"))
    root = _stored(spark, rows.groupBy("offset").agg(F.to_json(F.struct(F.collect_list("f").alias("features"))).alias("body")), "offset")
    spark.dataSource.register(PagedHttp)
    pages = spark.read.format("paged_http").options(urls=f"{root}/offset={{offset}}", paging="offset", step=str(step), items=r'"STREETNAME":"', delay="0").load()
    read = feeds.json_pages(pages, "features array<string>").select(F.explode("read.features").alias("feature"))
    return feeds.street_dimension(read).select("name", "ressort", "lat", "lon")


def html_equal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose cards all begin with the same block and lie twenty elements deep, read without a layout."""
    deep = 20
    badge = F.lit('<div class="badge">Nieuw</div>')
    pages = _site_pages(spark, sf_dir).select(F.xxhash64("site", "page").alias("page_id"), F.concat(F.lit("<html><body>" + "<div>" * deep), F.replace("b", F.lit('<div class="object">'), F.concat(F.lit('<div class="object">'), badge)), F.lit("</div>" * deep + "</body></html>")).alias("html"))
    got = html.cards(pages, html.LAYOUTS["generic"], "generic")
    return got.select("url", T.find_price(T.clean(F.col("text")))["amount"].alias("price"))


def resort_district_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The district of each resort, from area features; of several the last."""
    feature = F.to_json(F.struct(F.struct(F.col("ressort").alias("RES_NM"), F.col("district").alias("DISTR_NM")).alias("attributes")))
    return feeds.resort_districts(table(spark, sf_dir, "streets").select(feature.alias("feature"), "street_id"), "street_id")


QUERIES = {f.__name__: f for f in (pages_numbered, pages_linked, pages_offset, html_equal_blocks, resort_district_table)}

_SITE = """
SELECT 's' || (listing_id % 3) AS source, url, regexp_replace(trim(title), '\\s+', ' ', 'g') AS title, round_even(price, 0) AS price, CASE WHEN round_even(size_m2, 0) > 0 THEN round_even(size_m2, 0) END AS size_m2
FROM (SELECT *, row_number() OVER (PARTITION BY url, listing_id % 3 ORDER BY listing_id) AS n FROM site_listings WHERE url IS NOT NULL AND price IS NOT NULL AND NOT isnan(price)) WHERE n = 1"""
#: Cards as the detected blocks show them: the digits of a size behind the price run on into it, and only what may be a price counts. One card a page repeats nothing.
_BLOCKS = """
SELECT page_id, url, CASE WHEN v BETWEEN 1000 AND 999999 THEN v END AS price FROM (
  SELECT page_id, listing_id, url, CAST(CAST(CAST(round_even(price, 0) AS BIGINT) AS VARCHAR) || coalesce(CAST(CAST(round_even(CASE WHEN NOT isnan(size_m2) THEN size_m2 END, 0) AS BIGINT) AS VARCHAR), '') AS DOUBLE) AS v,
    row_number() OVER (PARTITION BY page_id, url ORDER BY listing_id) AS n, count(*) OVER (PARTITION BY page_id) AS cards, size_m2 IS NOT NULL AND NOT isnan(size_m2) OR regexp_matches(lower(concat_ws(' ', title, district, resort)), 'perceel|percelen|kavel|bouwgrond|grond|plot|land') AS land
  FROM (SELECT *, {0} AS page_id FROM site_listings WHERE url IS NOT NULL AND price IS NOT NULL AND NOT isnan(price)))
WHERE n = 1 AND cards > 1 AND land"""

SQL = {
    "html_blocks": _BLOCKS.format("listing_id // 20"),
    "html_equal_blocks": f"SELECT url, price FROM ({_BLOCKS.format('(row_number() OVER (PARTITION BY listing_id % 3 ORDER BY listing_id) - 1) // 20 * 3 + listing_id % 3')})",
    "pages_numbered": _SITE,
    "pages_linked": _SITE,
    "pages_offset": "SELECT trim(name) AS name, trim(ressort) AS ressort, round_even(lat, 6) AS lat, round_even(lon, 6) AS lon FROM streets WHERE name <> ''",
    "resort_district_table": "SELECT lower(trim(ressort)) AS ressort, arg_max(trim(district), street_id) AS district FROM streets WHERE trim(ressort) <> '' GROUP BY 1",
}
