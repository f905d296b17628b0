"""Feeds and dimensions from JSON: manual adverts, REST listing rows, street features, boxes; with explicit schemas."""

from __future__ import annotations

import functools
import logging
import os

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleba.functions import text as T
from gleba.functions.geo import midpoint
from gleba.session import checkpointed

log = logging.getLogger(__name__)

FEED_SCHEMA = "url string, title string, street string, resort string, district string, price double, currency string, price_text string, size_m2 double, size_text string, phones array<string>, seller string, images array<string>, description string, location string, lat double, lon double, title_type string, posted string"
REST_SCHEMA = "id long, link string, date string, modified string, title struct<rendered:string>, content struct<rendered:string>, location array<long>, neighborhoods array<long>, purpose array<long>, _embedded struct<`wp:featuredmedia`:array<struct<source_url:string>>>"
STREET_SCHEMA = "struct<properties:struct<STREETNAME:string,RESSORTNAM:string>,geometry:struct<type:string,coordinates:array<array<double>>>>"


def json_feed(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """The manual feed; a path that isn't there gives no rows."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], FEED_SCHEMA)
    return spark.read.schema(FEED_SCHEMA).option("multiLine", str(multiline).lower()).json(path)


def feed_listings(feed: DataFrame, source: str = "feed") -> DataFrame:
    """Feed rows as listings: numbers from the texts only where they are missing, phones from the description, street from the title."""
    price = T.parse_price(T.clean(F.col("price_text")))
    number = F.nanvl("price", F.lit(None).cast("double"))
    amount = F.coalesce(number, price["amount"])
    currency = F.when(number.isNotNull(), F.col("currency")).otherwise(price["currency"])
    phones = F.when(T.truthy(F.col("phones"), "array"), F.col("phones")).otherwise(T.parse_phones(T.clean(F.col("description"))))
    tail = T.last_segment(F.coalesce("url", F.lit("")), 200)
    return feed.select(
        F.lit(source).alias("source"), F.concat(F.lit(source + ":"), F.when(tail != "", tail).otherwise(F.substring(F.coalesce("title", F.lit("")), 1, 40))).alias("source_id"), "url", "title",
        F.when(T.truthy(F.col("street")), F.col("street")).otherwise(F.col("title")).alias("street"), "resort", "district", amount.alias("price"), F.when(T.truthy(amount, "number"), F.coalesce(F.nullif(currency, F.lit("")), F.lit("SRD"))).alias("currency"),
        F.coalesce(F.nanvl("size_m2", F.lit(None).cast("double")), T.parse_size(T.clean(F.col("size_text")))).alias("size_m2"), T.clean_image_urls(F.col("images")).alias("images"), phones.alias("phones"), F.when(T.truthy(F.col("seller")), F.col("seller")).otherwise("seller").alias("agent"), "description", "lat", "lon",
    )


def rest_listings(rows: DataFrame, locations: DataFrame, hoods: DataFrame, purposes: DataFrame, districts: list[str]) -> DataFrame:
    """REST rows (REST_SCHEMA) as listings. The taxonomies are (id, name); Spark broadcasts them if they are small. Text fields are read from the cleaned body."""

    def term(ids: str, names: DataFrame, out: str) -> DataFrame:
        one = rows.select("id", F.posexplode(ids).alias("pos", "tid")).join(names.select(F.col("id").alias("tid"), F.col("name").alias("n")), "tid").where(T.truthy(F.col("n")))
        return one.groupBy("id").agg(F.min_by("n", "pos").alias(out))

    body, title = T.clean(F.col("content.rendered")), T.clean(F.col("title.rendered"))
    price = T.find_price(F.col("__body"))
    df = rows.withColumns({"__body": body, "__title": title}).join(term("location", locations, "__place"), "id", "left").join(term("neighborhoods", hoods, "resort"), "id", "left").join(term("purpose", purposes, "title_type"), "id", "left")
    place = F.coalesce(T.first_of(districts, F.col("__place")), F.col("__place"), T.first_of(districts, F.concat_ws(" ", "__body", "__title")))
    return df.select(
        F.col("id").alias("source_id"), F.col("link").alias("url"), F.col("__title").alias("title"), "resort", place.alias("district"), price["amount"].alias("price"), price["currency"].alias("currency"), T.labelled_size(F.col("__body")).alias("size_m2"), "title_type",
        F.try_element_at(F.col("_embedded.`wp:featuredmedia`.source_url"), F.lit(1)).alias("image"), T.parse_phones(F.col("__body")).alias("phones"), F.substring("__body", 1, 900).alias("description"), F.substring("date", 1, 10).alias("posted"),
    )


def publish_dates(rows: DataFrame, order: str) -> DataFrame:
    """(nurl, posted) of a date feed (link, date, order); the last row of a link counts."""
    rows = rows.where(T.truthy(F.col("link")) & T.truthy(F.col("date")))
    return rows.groupBy(T.normal_url(F.col("link")).alias("nurl")).agg(F.max_by(F.substring("date", 1, 10), order).alias("posted"))


def with_dates(listings: DataFrame, dates: DataFrame) -> DataFrame:
    """listings with posted from the date feed where it is empty."""
    joined = listings.withColumn("nurl", T.normal_url(F.col("url"))).join(dates.withColumnRenamed("posted", "__d"), "nurl", "left")
    return joined.withColumn("posted", F.when(T.truthy(F.col("posted")), F.col("posted")).otherwise(F.col("__d"))).drop("__d", "nurl")


def street_dimension(features: DataFrame, column: str = "feature") -> DataFrame:
    """(name, ressort, lat, lon) of GeoJSON line features: the middle vertex; features without a name or a point are left out."""
    f = F.from_json(column, STREET_SCHEMA)
    df = features.select(F.trim(f["properties"]["STREETNAME"]).alias("name"), F.trim(F.coalesce(f["properties"]["RESSORTNAM"], F.lit(""))).alias("ressort"), midpoint(f["geometry"]["coordinates"]).alias("m"))
    return df.where(T.truthy(F.col("name")) & F.col("m").isNotNull()).select("name", "ressort", F.col("m.lat").alias("lat"), F.col("m.lon").alias("lon"))


def split_location(location, mode: str, districts: list[str]):
    """struct(street, resort, district) of a location text, by how a site writes it: dash, ends, resort_first or street_first."""
    parts = F.filter(F.transform(F.split(location, ","), lambda p: F.trim(p)), lambda p: p != "")
    at, n, guess = lambda i: F.try_element_at(parts, F.lit(i)), F.size(parts), T.first_of(districts, location)
    none = F.lit(None).cast("string")
    if mode == "dash":
        has = location.contains(" - ")
        out = (none, F.when(has, F.trim(F.regexp_replace(location, r"^.*? - ", ""))), F.when(has, F.trim(F.substring_index(location, " - ", 1))).otherwise(guess))
    elif mode == "ends":
        has = location.contains(",")
        out = (none, F.when(has, at(1)), F.when(has, at(-1)).otherwise(guess))
    elif mode == "resort_first":
        out = (none, at(1), F.coalesce(guess, F.when(n > 1, at(-1))))
    else:
        out = (at(1), F.when(n > 2, at(2)), guess)
    return F.struct(out[0].alias("street"), out[1].alias("resort"), out[2].alias("district"))


def union_of(sources: dict, only: list[str] | None = None) -> DataFrame:
    """The union of what named sources give (each a function of no arguments); one that fails, while planned or while read, gives no rows.

    Each source is read and written down on its own, so that its failure is its own. Errors that aren't of Spark, of what it runs or of files aren't caught.
    """
    got = []
    for name, read in sources.items():
        if only and name not in only:
            continue
        try:
            got.append(checkpointed(read().withColumn("source", F.lit(name))))
        except (PySparkException, Py4JError, OSError) as e:  # noqa: PERF203 - a source that fails must not stop the others
            log.warning("source %s failed: %s", name, str(e)[:500])
    if not got:
        raise ValueError("no source gave rows")
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), got)


def json_pages(pages: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """Pages with their body read by a schema, as the column ``read``; null where the body is none or can't be read."""
    return pages.withColumn("read", F.from_json(body, schema, {"mode": "PERMISSIVE"}))


def resort_districts(features: DataFrame, order: str, column: str = "feature") -> DataFrame:
    """(ressort in lower case, district) of area features; the last row of a resort by order counts."""
    f = F.from_json(column, "struct<attributes:struct<RES_NM:string,DISTR_NM:string>>")["attributes"]
    rows = features.select(F.lower(F.trim(f["RES_NM"])).alias("ressort"), F.trim(f["DISTR_NM"]).alias("district"), F.col(order).alias("o")).where(T.truthy(F.col("ressort")))
    return rows.groupBy("ressort").agg(F.max_by("district", "o").alias("district"))


def with_details(cards: DataFrame, details: DataFrame) -> DataFrame:
    """Cards (url, size_m2, images, ...) with what their detail pages (url, body, gallery) add: the size where it is missing, the text, the pictures if there are any."""
    pages = details.select("url", T.clean(F.col("body")).alias("__body"), T.clean_image_urls(F.filter("gallery", lambda u: ~u.startswith("data:")), 8).alias("__gallery"))
    joined = cards.drop("__body", "__gallery").join(pages, "url", "left")
    out = {
        "size_m2": F.when(T.truthy(F.col("size_m2"), "number"), F.col("size_m2")).otherwise(T.detail_size(F.col("__body"))),
        "description": F.coalesce(F.nullif(F.substring("__body", 1, 900), F.lit("")), F.col("description") if "description" in cards.columns else F.lit(None)),
        "images": F.when(T.truthy(F.col("__gallery"), "array"), F.col("__gallery")).otherwise(F.col("images")),
    }
    return joined.withColumns(out).drop("__body", "__gallery")


def with_page_phones(cards: DataFrame, page_texts: DataFrame, most: int = 2) -> DataFrame:
    """Cards (page_id, ...) with the phones of their whole page (page_id, text)."""
    return cards.join(page_texts.select("page_id", T.parse_phones(T.clean(F.col("text")), most).alias("phones")), "page_id", "left")
