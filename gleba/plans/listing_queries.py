"""Queries of the relational operators: filters, joins, places, duplicates, runs, ranks."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gleba.functions import geo, text as T
from gleba.operators import dedup, places, runs
from gleba.operators.quantiles import quantiles
from gleba.operators.units import item_number
from gleba.session import table
from gleba.sources import feeds, html as pages, sinks

CENTRE = (5.8232, -55.1679)


def _listings(spark, sf_dir):
    return table(spark, sf_dir, "site_listings")


def listing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adverts that are no news pages and of which something is known."""
    df = table(spark, sf_dir, "documents")
    keep = T.is_listing(F.col("url"), T.truthy(F.col("agent")), T.truthy(F.col("posted")))
    return df.where(keep).select("doc_id", "doc_type")


def viewer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text, districts, a price range, a size range, photos only."""
    df = table(spark, sf_dir, "feed_items")
    words = F.lower(F.concat_ws(" ", "title", "street", "description"))
    return df.where(words.contains("kavel") & F.col("price").between(10_000, 200_000) & F.col("size_m2").between(200, 5_000) & (F.size("images") > 0)).select("record_id", "price", "size_m2")


def slider_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prices at 0, 10, ... 100 % of the adverts, for a slider that follows the spread."""
    stops = quantiles(_listings(spark, sf_dir).where("currency = 'EUR'"), "price", [i / 10 for i in range(11)])
    return stops.select("stop", F.round("value", 2).alias("price"))


def date_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication dates onto listings by normalised url; the last date of a url counts."""
    rows = _listings(spark, sf_dir)
    feed = rows.select(F.concat(F.replace("url", F.lit("https://"), F.lit("http://www.")), F.lit("/?a=1")).alias("link"), F.concat("first_seen", F.lit("T00:00:00")).alias("date"), "listing_id")
    out = feeds.with_dates(rows.select("listing_id", "url", "posted"), feeds.publish_dates(feed, "listing_id"))
    return out.select("listing_id", "posted")


def place_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The district of a listing's resort by the register, in lower case; empty where unknown."""
    names = table(spark, sf_dir, "streets").groupBy(F.lower("ressort").alias("r")).agg(F.min("district").alias("d"))
    rows = _listings(spark, sf_dir).withColumn("r", F.lower("resort"))
    return rows.join(names, "r", "left").select("listing_id", F.coalesce("d", F.lit("")).alias("district"))


def street_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings onto the register by folded name, preferring the resort, then the district named."""
    rows = _listings(spark, sf_dir).where("street is not null").withColumn("fold", T.street_fold(T.unaccented("street")))
    return places.exact(rows, table(spark, sf_dir, "streets"), "listing_id", "fold").select("listing_id", "street_id", "name")


def street_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.fuzzy(_listings(spark, sf_dir), table(spark, sf_dir, "streets"), "listing_id", "street")


def street_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first register street whose name holds the words given."""
    rows = _listings(spark, sf_dir).select("listing_id", F.trim("street").alias("asked"))
    return places.containing(rows, table(spark, sf_dir, "streets"), "listing_id", "asked").select("listing_id", "street_id")


def district_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.district_boxes(table(spark, sf_dir, "streets")).select("district", "box.*")


def box_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each address's guessed point lies in its district's box."""
    rows = table(spark, sf_dir, "needs_check").join(places.district_boxes(table(spark, sf_dir, "streets")), "district", "left")
    return rows.select("check_id", geo.in_box(F.col("guess_lat"), F.col("guess_lon"), F.col("box")).alias("inside"))


def verified_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked positions onto listings by address key."""
    streets = table(spark, sf_dir, "streets")
    checked = streets.select(T.address_key(F.col("name"), F.lit(""), F.col("ressort"), F.col("district")).alias("key"), "lat", "lon", "street_id").groupBy("key").agg(F.min_by("lat", "street_id").alias("lat"), F.min_by("lon", "street_id").alias("lon"))
    rows = _listings(spark, sf_dir).select("listing_id", T.address_key(F.col("street"), F.col("title"), F.col("resort"), F.col("district")).alias("key"))
    return rows.join(checked, "key").select("listing_id", "lat", "lon")


def _placed(spark: SparkSession, sf_dir: str, headline: bool) -> DataFrame:
    """The cascade over all listings: checked addresses (those of names that several resorts have), register streets, areas, none."""
    streets = table(spark, sf_dir, "streets")
    shared = streets.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    keyed = streets.join(shared, "name", "left_semi").select(T.address_key(F.col("name"), F.lit(""), F.col("ressort"), F.col("district")).alias("key"), "lat", "lon", "street_id")
    checked = runs.first_wins(keyed, "key", F.col("street_id")).select("key", "lat", "lon", F.lit("street").alias("confidence"))
    rows = _listings(spark, sf_dir).select("listing_id", "street", "title", "resort", "district", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    return places.cascade(rows, streets, checked, "listing_id", headline)


def geocode_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiers: headlines read, misspelt names, names that hold the one given."""
    return _placed(spark, sf_dir, True)


def geocode_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiers that SQL can say: checked addresses, the street of exactly that name, areas."""
    return _placed(spark, sf_dir, False).drop("geocode_how")


def placement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geocode_cascade(spark, sf_dir).groupBy("geocode_quality").agg(F.count("*").alias("n"))


def resort_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.resort_areas(table(spark, sf_dir, "streets")).select("resort", "district", F.round("area_lat", 4).alias("area_lat"), F.round("area_lon", 4).alias("area_lon"))


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "feed_items")
    return df.select("record_id", dedup.quality(df).alias("quality"))


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listings(spark, sf_dir).select("listing_id", dedup.size_bucket(F.col("size_m2")).cast("double").alias("size_bucket"), dedup.price_bucket(F.col("price"), F.col("currency")).cast("double").alias("price_bucket"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fingerprints of the listings, one a row."""
    rows = dedup.listing_key(_listings(spark, sf_dir))
    fps = dedup.fingerprints(F.col("key"), dedup.size_bucket(F.col("size_m2")), dedup.price_bucket(F.col("price"), F.col("currency")))
    return rows.select("listing_id", F.posexplode(fps).alias("k", "fingerprint")).select("listing_id", "fingerprint")


def dedup_source_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of an advert folded into one: each field's first present value by record_id."""
    df = table(spark, sf_dir, "feed_items").withColumn("source_id", item_number(F.col("url"))).where("source_id is not null")
    return dedup.fold_first(df, "source_id", F.col("record_id"), {"size_m2": "number", "price": "number", "district": "string", "resort": "string", "street": "string"}, [F.count("*").alias("rows")])


def dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each listing: kept, merged into another, or dropped."""
    rows = dedup.with_order(dedup.listing_key(_listings(spark, sf_dir)), "listing_id", dedup.quality(_listings(spark, sf_dir)))
    rows = rows.withColumn("fps", dedup.fingerprints(F.col("key"), dedup.size_bucket(F.col("size_m2")), dedup.price_bucket(F.col("price"), F.col("currency"))))
    return dedup.greedy(rows.withColumnRenamed("listing_id", "id")).select(F.col("id").alias("listing_id"), "fate", F.col("into").alias("merged_into"))


def merged_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept listings with what the merged ones add."""
    return dedup.deduplicated(_listings(spark, sf_dir), "listing_id")


def also_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where else the kept listings are listed."""
    return dedup.also_listed(_listings(spark, sf_dir), "listing_id").withColumnRenamed("head", "listing_id")


def image_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct images of an advert in order of appearance, at most ten."""
    df = table(spark, sf_dir, "feed_items").withColumn("source_id", item_number(F.col("url"))).where("source_id is not null")
    return dedup.ordered_union(df, "source_id", "record_id", "images", 10).select("source_id", F.array_join("images", " ").alias("images"))


def _runs(spark, sf_dir):
    """(rows, dates): the last capture of each advert in each delivery, and the deliveries."""
    df = table(spark, sf_dir, "feed_snapshots").withColumn("run_date", F.col("snapshot_date").cast("string"))
    rows = df.withColumn("key", item_number(F.col("url"))).where("key is not null and run_date is not null").select("run_date", "key", F.nanvl("price", F.lit(None).cast("double")).alias("price"), "loaded_at")
    last = rows.groupBy("run_date", "key").agg(F.max_by("price", F.struct("loaded_at", "price")).alias("price"))
    return last, runs.deliveries(df)


def run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each delivery but the first onto the one before: new or not, first seen, the price before."""
    merged = runs.merge_runs(*_runs(spark, sf_dir)).where("n > 1")
    return merged.select("run_date", "key", F.round("price", 2).alias("price"), "first_seen", "last_seen", "is_new", F.round("previous_price", 2).alias("previous_price"))


def run_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.gone_runs(*_runs(spark, sf_dir))


def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active, new and gone adverts of each delivery but the first, a row each."""
    rows, dates = _runs(spark, sf_dir)
    one = lambda df, active, new, gone: df.select("run_date", F.lit(active).alias("a"), new.cast("int").alias("n"), F.lit(gone).alias("g"))
    merged, lost = runs.merge_runs(rows, dates).where("n > 1"), runs.gone_runs(rows, dates)
    all_ = one(merged, 1, F.col("is_new"), 0).unionByName(one(lost, 0, F.lit(False), 1)).unionByName(one(dates.where("n > 1"), 0, F.lit(False), 0))
    return all_.groupBy("run_date").agg(*[F.sum(c).alias(k) for c, k in (("a", "active"), ("n", "new_this_run"), ("g", "gone_since_last_run"))])


def price_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each capture's price with the one before, where it changed."""
    df = table(spark, sf_dir, "feed_items").withColumn("source_id", item_number(F.col("url"))).where("price is not null and not isnan(price) and source_id is not null")
    out = runs.previous_values(df.select("source_id", "record_id", "seen_at", "price"), ["source_id"], ["seen_at", "record_id"], "price")
    return out.where("previous <> price").select("source_id", "record_id", "price", F.col("previous").alias("previous_price"))


def queue_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of each address key that isn't among the checked ones."""
    rows = table(spark, sf_dir, "needs_check").select("check_id", "tier", T.address_key(F.col("street"), F.lit(""), F.col("resort"), F.col("district")).alias("key")).where("trim(both '|' from key) <> ''")
    streets = table(spark, sf_dir, "streets").select(T.address_key(F.col("name"), F.lit(""), F.col("ressort"), F.col("district")).alias("key")).distinct()
    return runs.first_wins(rows, "key", F.col("check_id")).join(streets, "key", "left_anti").select("key", "check_id", "tier")


def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses a tier, with tiers that have none."""
    n = table(spark, sf_dir, "needs_check").groupBy("tier").agg(F.count("*").alias("n"))
    tiers = spark.range(1, 5).select(F.col("id").cast("int").alias("tier"))
    return tiers.join(n, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def store_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of checks (the whole register) into a store of checks (the districts of the first half of the alphabet): only keys that it lacks."""
    rows = table(spark, sf_dir, "streets").select(F.col("name").alias("key"), "lat", "lon", F.col("street_id").alias("arrival"), "district")
    store = runs.first_wins(rows.where("district < 'N'").drop("district"), "key", F.col("arrival")).drop("arrival")
    return runs.insert_absent(store, rows.drop("district"))


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))


def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listings(spark, sf_dir).agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of listings whose folded street the register has, by source."""
    folds = table(spark, sf_dir, "streets").select(T.street_fold(T.unaccented("name")).alias("fold")).distinct().withColumn("hit", F.lit(1))
    rows = _listings(spark, sf_dir).select("source", T.street_fold(T.unaccented(F.coalesce("street", F.lit("")))).alias("fold"))
    return rows.join(folds, "fold", "left").groupBy("source").agg(F.count("*").alias("tried"), F.count("hit").alias("found"))


def nearest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five register names nearest to each other name of their first letter, by edit distance, ties by name."""
    names = table(spark, sf_dir, "streets").select("name").distinct().withColumn("letter", F.substring("name", 1, 1))
    pairs = names.join(names.withColumnRenamed("name", "other"), "letter").where("name <> other").withColumn("d", F.levenshtein("name", "other"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("d", F.desc("other")))).where("rank <= 5").select("name", "other", "rank")


def final_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by district first, then distance of their resort, nulls last, in a defined order."""
    area = places.resort_areas(table(spark, sf_dir, "streets"))
    km = geo.haversine_km(F.lit(CENTRE[0]), F.lit(CENTRE[1]), F.col("area_lat"), F.col("area_lon"))
    rows = _listings(spark, sf_dir).join(area, ["resort", "district"], "left").withColumn("km", F.coalesce(km, F.lit(999.0)))
    return runs.ranked(rows.select("listing_id", "district", F.round("km", 1).alias("km")), F.col("district").isNull(), F.col("district"), F.col("km"), F.col("listing_id"))


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed written as JSON lines and read back with its schema."""
    lines = sinks.json_lines(table(spark, sf_dir, "feed_items").select("url", "title", "street", "resort", "district", "price", "currency", "size_m2", "images"))
    back = lines.select(F.from_json("value", feeds.FEED_SCHEMA).alias("x")).select("x.*")
    return back.select("url", "title", "street", F.nanvl("price", F.lit(None).cast("double")).alias("price"), F.coalesce(F.array_size("images"), F.lit(0)).alias("n_images"))


def street_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street features as GeoJSON, read into the dimension by their middle vertex."""
    line = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array("lon", "lat"), F.array(F.lit(1.0), F.lit(1.0)))
    feature = F.to_json(F.struct(F.struct(F.col("name").alias("STREETNAME"), F.col("ressort").alias("RESSORTNAM")).alias("properties"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry")))
    return feeds.street_dimension(table(spark, sf_dir, "streets").select(feature.alias("feature"))).select("name", "ressort", "lat", "lon")


def card_html():
    """A listing as a card of a page."""
    esc = functools.reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")], F.col("title"))
    return F.concat(F.lit('<div class="object"><a href="'), F.col("url"), F.lit('"><img class="object_img" src="/i/'), F.col("listing_id"), F.lit('.jpg"></a><span class="title">'), esc, F.lit('</span><p class="locatie">'), F.concat_ws(" - ", F.coalesce("district", F.lit("?")), F.coalesce("resort", F.lit("?"))), F.lit('</p><b class="prijs">'), F.concat_ws(" ", "currency", F.bround("price", 0).cast("long").cast("string")), F.lit('</b><i class="perceel">'), F.coalesce(F.concat(F.bround(F.nanvl("size_m2", F.lit(None).cast("double")), 0).cast("long").cast("string"), F.lit(" m2")), F.lit("")), F.lit("</i></div>"))


def _card_pages(spark, sf_dir):
    """Pages of twenty cards each, built from the listings."""
    df = _listings(spark, sf_dir).where("url is not null and price is not null")
    body = df.withColumn("page_id", F.expr("listing_id div 20")).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("listing_id", card_html().alias("c")))), lambda s: s["c"]), "\n").alias("b"))
    return body.select("page_id", F.concat(F.lit("<html><body><nav><a href='/'>home</a></nav>"), F.col("b"), F.lit("</body></html>")).alias("html"))


def html_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adverts read from pages by a layout, with their prices and sizes parsed."""
    got = pages.cards(_card_pages(spark, sf_dir), pages.LAYOUTS["object"], "object")
    return got.select("url", "title", T.parse_price(T.clean(F.col("price_text")))["amount"].alias("price"), T.parse_size(T.clean(F.col("size_text"))).alias("size_m2"))


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages read without a layout, by the repeated blocks detected in them."""
    got = pages.cards(_card_pages(spark, sf_dir), pages.LAYOUTS["generic"], "generic")
    return got.select("page_id", "url", T.find_price(T.clean(F.col("text")))["amount"].alias("price"))


def rest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as REST documents with taxonomies of ids, read back: terms looked up, prices and sizes found in the text."""
    df = _listings(spark, sf_dir).where("price is not null and not isnan(price)").withColumn("m2", F.bround(F.nanvl("size_m2", F.lit(None).cast("double")), 0).cast("long"))
    terms = lambda c, by: df.where(f"{c} is not null").select(c).distinct().select(F.abs(F.xxhash64(c)).alias("id"), F.col(c).alias("name"))  # noqa: E731, ARG005
    body = F.concat(F.lit("<p>Kavel &amp; huis. Perceelgrootte: "), F.coalesce("m2", F.lit(0)).cast("string"), F.lit(" m2. Vraagprijs: "), F.col("currency"), F.lit(" "), F.bround("price", 0).cast("long").cast("string"), F.lit(",00; tel 854-3210</p>"))
    ids = lambda c: F.array_compact(F.array(F.abs(F.xxhash64(c)) * F.when(F.col(c).isNotNull(), 1)))
    row = F.to_json(F.struct(F.col("listing_id").alias("id"), F.col("url").alias("link"), F.concat("first_seen", F.lit("T08:00:00")).alias("date"), F.struct(F.col("title").alias("rendered")).alias("title"), F.struct(body.alias("rendered")).alias("content"), ids("district").alias("location"), ids("resort").alias("neighborhoods"), ids("title_type").alias("purpose")))
    rows = df.select(row.alias("j")).select(F.from_json("j", feeds.REST_SCHEMA).alias("x")).select("x.*")
    got = feeds.rest_listings(rows, terms("district", 0), terms("resort", 0), terms("title_type", 0), ["no such district"])
    return got.select(F.col("source_id").alias("listing_id"), "url", "resort", "district", "title_type", "size_m2", "posted", F.element_at("phones", -1).alias("phones"))


def detail_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing cards with the sizes and texts of their detail pages."""
    df = _listings(spark, sf_dir)
    cards = df.select("listing_id", "url", F.lit(None).cast("double").alias("size_m2"), F.array().cast("array<string>").alias("images"))
    whole = F.bround(F.nanvl("size_m2", F.lit(None).cast("double")), 0).cast("long").cast("string")
    details = df.where("size_m2 is not null and not isnan(size_m2)").select("url", F.concat(F.lit("<p>Terrein: "), whole, F.lit(" m2</p>")).alias("body"), F.array(F.lit("data:x"), F.concat(F.lit("//img.example/"), F.col("listing_id"))).alias("gallery"))
    return feeds.with_details(cards, details).select("listing_id", "size_m2", F.array_join("images", " ").alias("images"))


def street_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an address looks like a street."""
    return table(spark, sf_dir, "needs_check").select("check_id", T.looks_like_street(F.col("street")).alias("streety"))


def land_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adverts whose title names land."""
    return table(spark, sf_dir, "feed_items").where(T.land_type(F.col("title"))).select("record_id")


def within_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings whose resort lies within 20 km of the centre; unknown distances fail."""
    area = places.resort_areas(table(spark, sf_dir, "streets"))
    km = geo.haversine_km(F.lit(CENTRE[0]), F.lit(CENTRE[1]), F.col("area_lat"), F.col("area_lon"))
    return _listings(spark, sf_dir).join(area, ["resort", "district"]).where(km <= 20.0).select("listing_id")


def viewport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streets in a window of the map."""
    return table(spark, sf_dir, "streets").where(F.col("lat").between(5.5, 5.8) & F.col("lon").between(-55.3, -55.0)).select("street_id", "lat", "lon")


def quality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many adverts have which quality, the commonest first."""
    df = table(spark, sf_dir, "feed_items")
    return df.groupBy(dedup.quality(df).alias("quality")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "quality")


def area_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clamped radius of each plot as a circle, in metres."""
    return _listings(spark, sf_dir).select("listing_id", geo.radius_m(F.nanvl("size_m2", F.lit(None).cast("double")) * 1000).alias("radius_m"))


def absolute_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pictures against the page's, and the currency that an element's class names."""
    return _listings(spark, sf_dir).select("listing_id", T.absolute_url(F.lit("https://x.example/a/b/"), F.concat(F.lit("../i/"), F.col("listing_id").cast("string"), F.lit(".jpg"))).alias("image"), T.currency_of_class(F.concat(F.lit("cur-"), F.lower("currency"))).alias("currency"))


def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both kinds of source under one schema, a source that fails left out."""
    sources = {
        "sites": lambda: _listings(spark, sf_dir).select("url", "title", "price"),
        "feed": lambda: table(spark, sf_dir, "feed_items").select("url", "title", "price", "size_m2"),
        "broken": lambda: table(spark, sf_dir, "no_such_table"),
    }
    return feeds.union_of(sources).groupBy("source").agg(F.count("*").alias("n"), F.count("url").alias("with_url"))


QUERIES = {
    f.__name__: f
    for f in (
        listing_filter, viewer_filter, slider_stops, date_join, place_lookup, street_exact, street_fuzzy, street_containing, district_boxes, box_join, verified_apply, geocode_cascade, geocode_exact, placement_counts, resort_areas, quality_score, buckets, fingerprints, dedup_source_id, dedup_greedy,
        merged_listings, also_listed, image_union, run_merge, run_gone, run_counts, price_change, queue_first, tier_counts, store_insert, source_counts, source_list, match_rate, nearest_names, final_rank, json_round_trip, street_dimension, html_cards, html_blocks, rest_rows, detail_join, source_union, street_words, land_types, within_distance, viewport, quality_histogram, area_radius, absolute_urls,
    )
}

from gleba.plans import text_queries as TQ  # noqa: E402

_EUR = TQ._EUR
_KEY = "concat_ws('|', " + TQ._PART.replace("{0}", "norm") + ", " + TQ._PART.format("r") + ", " + TQ._PART.format("d") + ")"
_KEYED = "SELECT *, " + _KEY + " AS key FROM (SELECT *, " + TQ._NORM + " AS norm FROM (SELECT *, " + TQ._CLEAN.format("s") + " AS t FROM ({0})))"
_STREET_KEYS = _KEYED.replace("{0}", "SELECT street_id, lat, lon, name AS s, ressort AS r, district AS d FROM streets")
_LISTING_KEYS = _KEYED.replace("{0}", "SELECT listing_id, CASE WHEN street <> '' THEN street ELSE title END AS s, resort AS r, district AS d FROM site_listings")
_FOLDED = f"SELECT *, coalesce({TQ._FOLD}, '') AS fold FROM (SELECT *, regexp_replace(lower(strip_accents({{0}})), '[^a-z0-9]+', '', 'g') AS k FROM {{1}})"
_ITEM = r"regexp_extract(url, '(?i)/item/(\d+)', 1)"
_SB, _PB = "CASE WHEN size_m2 <> 0 AND NOT isnan(size_m2) THEN CAST(round_even(size_m2 / 5, 0) AS BIGINT) END", f"CASE WHEN {_EUR} <> 0 AND NOT isnan({_EUR}) THEN CAST(round_even({_EUR} / 500, 0) AS BIGINT) END"


#: The last capture of each advert (k) in each delivery (d) with its price (p), the deliveries numbered (n), each with the one before (o).
_RUNS = f"""
WITH c AS (SELECT CAST(snapshot_date AS VARCHAR) AS d, {_ITEM} AS k, loaded_at, CASE WHEN isnan(price) THEN NULL ELSE price END AS p FROM feed_snapshots WHERE snapshot_date IS NOT NULL),
l AS (SELECT d, k, p FROM c WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY d, k ORDER BY loaded_at DESC NULLS LAST, p DESC NULLS LAST) = 1),
dd AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM (SELECT DISTINCT d FROM c)),
x AS (SELECT l.*, n FROM l JOIN dd USING (d)),
m AS (SELECT x.d, x.k, x.p, x.n, o.k IS NULL AS is_new, o.p AS op FROM x LEFT JOIN x o ON x.k = o.k AND o.n = x.n - 1),
s AS (SELECT m.*, (SELECT max(e.d) FROM m e WHERE e.k = m.k AND e.n <= m.n AND e.is_new) AS first_seen FROM m)"""
_FIRST = "arg_min({0}, record_id) FILTER (WHERE {1})"
_NO_NEWS = " AND ".join(f"coalesce(lower(url), '') NOT LIKE '%{x}%'" for x in T.NO_LISTING)

_CASCADE = f"""
WITH k AS ({_KEYED.replace("{0}", "SELECT listing_id, CASE WHEN street IS NOT NULL AND street <> '' THEN street ELSE title END AS s, resort AS r, district AS d, street, title, resort, district FROM site_listings")}),
v AS (SELECT key, arg_min(lat, street_id) AS v_lat, arg_min(lon, street_id) AS v_lon FROM ({_STREET_KEYS}) WHERE s IN (SELECT name FROM streets GROUP BY 1 HAVING count(*) > 1) GROUP BY 1),
n AS (SELECT *, {TQ._NORM} AS normal FROM (SELECT listing_id, {TQ._CLEAN.format("coalesce(resort, '')")} AS resort, {TQ._CLEAN.format("coalesce(district, '')")} AS district, {TQ._CLEAN.format('coalesce(street, title)')} AS t FROM site_listings)),
l AS ({_FOLDED.format('normal', 'n')}), s AS ({_FOLDED.format('name', 'streets')}),
h AS (SELECT listing_id, s.lat AS s_lat, s.lon AS s_lon FROM (SELECT *, CASE WHEN coalesce(l.resort, '') <> '' AND contains(lower(s.ressort), lower(l.resort)) THEN 0 WHEN coalesce(l.district, '') <> '' AND lower(s.district) = lower(l.district) THEN 1 WHEN coalesce(l.district, '') = '' THEN 2 END AS pref
  FROM l JOIN s ON l.fold = s.fold AND l.fold <> '') s WHERE pref IS NOT NULL QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY pref, street_id) = 1),
b AS (SELECT district AS bd, min(lat) AS a1, max(lat) AS a2, min(lon) AS o1, max(lon) AS o2 FROM streets GROUP BY 1),
m AS (SELECT listing_id, nullif({TQ._CLEAN.format("coalesce(resort, '')")}, '') AS cr, nullif({TQ._CLEAN.format("coalesce(district, '')")}, '') AS cd FROM site_listings),
a AS (SELECT ressort AS ar, district AS ad, round_even(avg(lat), 6) AS a_lat, round_even(avg(lon), 6) AS a_lon FROM streets GROUP BY 1, 2),
w AS (SELECT lower(district) AS wd, round_even(avg(lat), 6) AS w_lat, round_even(avg(lon), 6) AS w_lon FROM streets GROUP BY 1),
r AS (SELECT cr AS rr, cd AS rd, a_lat, a_lon FROM (SELECT DISTINCT cr, cd FROM m) JOIN a ON contains(lower(ar), lower(cr)) AND (cd IS NULL OR lower(ad) = lower(cd)) QUALIFY row_number() OVER (PARTITION BY cr, cd ORDER BY lower(ar) <> lower(cr), ar, ad) = 1),
z AS (SELECT listing_id, coalesce(a_lat, w_lat) AS z_lat, CASE WHEN a_lat IS NOT NULL THEN a_lon ELSE w_lon END AS z_lon FROM m LEFT JOIN r ON cr = rr AND cd IS NOT DISTINCT FROM rd LEFT JOIN w ON lower(cd) = wd),
j AS (SELECT *, s_lat IS NOT NULL AND (bd IS NULL OR (s_lat BETWEEN a1 - 0.02::DOUBLE AND a2 + 0.02::DOUBLE AND s_lon BETWEEN o1 - 0.02::DOUBLE AND o2 + 0.02::DOUBLE)) AS on_street
  FROM k LEFT JOIN v USING (key) LEFT JOIN h USING (listing_id) LEFT JOIN m USING (listing_id) LEFT JOIN b ON cd = bd LEFT JOIN z USING (listing_id)),
t AS (SELECT *, CASE WHEN v_lat IS NOT NULL THEN 'checked' WHEN on_street THEN 'street' WHEN z_lat IS NOT NULL THEN 'area' ELSE 'none' END AS q FROM j)
SELECT listing_id, q AS geocode_quality, CASE q WHEN 'checked' THEN v_lat WHEN 'street' THEN s_lat END AS lat, CASE q WHEN 'checked' THEN v_lon WHEN 'street' THEN s_lon END AS lon,
  CASE WHEN q = 'area' THEN z_lat END AS area_lat, CASE WHEN q = 'area' THEN z_lon END AS area_lon, CASE WHEN q = 'area' THEN 1500 END AS area_radius_m FROM t"""

SQL = {
    "geocode_exact": _CASCADE,
    "listing_filter": f"SELECT doc_id, doc_type FROM documents WHERE {_NO_NEWS} AND (coalesce(agent, '') <> '' OR coalesce(posted, '') <> '')",
    "viewer_filter": "SELECT record_id, price, size_m2 FROM feed_items WHERE lower(concat_ws(' ', title, street, description)) LIKE '%kavel%' AND price BETWEEN 10000 AND 200000 AND size_m2 BETWEEN 200 AND 5000 AND len(images) > 0",
    "slider_stops": "SELECT CAST(i AS INTEGER) AS stop, round(p[i + 1], 2) AS price FROM (SELECT quantile_cont(price, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS p FROM site_listings WHERE currency = 'EUR' AND price IS NOT NULL AND NOT isnan(price)), range(11) t(i)",
    "date_join": "SELECT listing_id, CASE WHEN posted <> '' THEN posted ELSE arg_max(first_seen, listing_id) OVER (PARTITION BY lower(url)) END AS posted FROM site_listings",
    "place_lookup": "SELECT listing_id, coalesce(d, '') AS district FROM site_listings LEFT JOIN (SELECT lower(ressort) AS r, min(district) AS d FROM streets GROUP BY 1) ON lower(resort) = r",
    "street_exact": f"""
WITH s AS ({_FOLDED.format('name', 'streets')}), l AS ({_FOLDED.format('street', '(SELECT * FROM site_listings WHERE street IS NOT NULL)')}),
p AS (SELECT listing_id, street_id, name, CASE WHEN coalesce(l.resort, '') <> '' AND contains(lower(s.ressort), lower(l.resort)) THEN 0 WHEN coalesce(l.district, '') <> '' AND lower(s.district) = lower(l.district) THEN 1 WHEN coalesce(l.district, '') = '' THEN 2 END AS pref
  FROM l JOIN s ON l.fold = s.fold AND l.fold <> '')
SELECT listing_id, street_id, name FROM p WHERE pref IS NOT NULL QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY pref, street_id) = 1""",
    "street_containing": "SELECT listing_id, min(street_id) AS street_id FROM (SELECT listing_id, upper(trim(street)) AS a FROM site_listings WHERE length(trim(street)) >= 4) JOIN streets ON contains(upper(name), a) GROUP BY 1",
    "district_boxes": "SELECT district, min(lat) AS lat_min, min(lon) AS lon_min, max(lat) AS lat_max, max(lon) AS lon_max FROM streets GROUP BY 1",
    "box_join": "SELECT check_id, CASE WHEN guess_lat IS NOT NULL AND NOT isnan(guess_lat) AND d IS NOT NULL THEN guess_lat BETWEEN a - 0.02::DOUBLE AND c + 0.02::DOUBLE AND guess_lon BETWEEN b - 0.02::DOUBLE AND e + 0.02::DOUBLE ELSE NOT coalesce(isnan(guess_lat) AND d IS NOT NULL, false) END AS inside FROM needs_check LEFT JOIN (SELECT district AS d, min(lat) AS a, min(lon) AS b, max(lat) AS c, max(lon) AS e FROM streets GROUP BY 1) ON district = d",
    "verified_apply": f"SELECT listing_id, lat, lon FROM ({_LISTING_KEYS}) l JOIN (SELECT key, arg_min(lat, street_id) AS lat, arg_min(lon, street_id) AS lon FROM ({_STREET_KEYS}) GROUP BY 1) s ON l.key = s.key",
    "resort_areas": "SELECT ressort AS resort, district, round(round_even(avg(lat), 6), 4) AS area_lat, round(round_even(avg(lon), 6), 4) AS area_lon FROM streets GROUP BY 1, 2",
    "quality_score": "SELECT record_id, CAST(CASE WHEN size_m2 <> 0 AND NOT isnan(size_m2) THEN 3 ELSE 0 END + CASE WHEN price <> 0 AND NOT isnan(price) THEN 3 ELSE 0 END + CASE WHEN len(images) > 0 THEN 2 ELSE 0 END + CASE WHEN description <> '' THEN 2 ELSE 0 END + CASE WHEN district <> '' THEN 1 ELSE 0 END + CASE WHEN len(phones) > 0 THEN 1 ELSE 0 END AS INTEGER) AS quality FROM feed_items",
    "buckets": f"SELECT listing_id, CAST({_SB} AS DOUBLE) AS size_bucket, CAST({_PB} AS DOUBLE) AS price_bucket FROM site_listings",
    "fingerprints": f"WITH f AS (SELECT listing_id, nullif(street_key, '') AS k, CAST({_SB} AS VARCHAR) AS s, CAST({_PB} AS VARCHAR) AS p FROM site_listings JOIN ({TQ.SQL['street_key']}) USING (listing_id)) SELECT listing_id, unnest(list_filter(['a|' || k || '|' || s || '|' || p, 'b|' || k || '|' || s, 'd|' || k || '|' || p], lambda x: x IS NOT NULL)) AS fingerprint FROM f",
    "dedup_source_id": f"SELECT k AS source_id, {_FIRST.format('size_m2', 'size_m2 <> 0 AND NOT isnan(size_m2)')} AS size_m2, {_FIRST.format('price', 'price <> 0 AND NOT isnan(price)')} AS price, " + ", ".join(f"{_FIRST.format(c, c + chr(32) + '<> ' + chr(39) * 2)} AS {c}" for c in ("district", "resort", "street")) + f", count(*) AS rows FROM (SELECT *, {_ITEM} AS k FROM feed_items) WHERE k <> '' GROUP BY 1",
    "image_union": f"SELECT source_id, string_agg(x, ' ' ORDER BY n) AS images FROM (SELECT source_id, x, row_number() OVER (PARTITION BY source_id ORDER BY r, pos) AS n FROM (SELECT source_id, x, min(r) AS r, arg_min(pos, (r, pos)) AS pos FROM (SELECT {_ITEM} AS source_id, record_id AS r, unnest(images) AS x, generate_subscripts(images, 1) AS pos FROM feed_items) WHERE source_id <> '' AND x IS NOT NULL GROUP BY 1, 2)) WHERE n <= 10 GROUP BY 1",
    "run_merge": f"{_RUNS} SELECT d AS run_date, k AS key, round(p, 2) AS price, first_seen, d AS last_seen, is_new, CASE WHEN op <> 0 AND p <> 0 AND op <> p THEN round(op, 2) END AS previous_price FROM s WHERE n > 1",
    "run_gone": f"{_RUNS} SELECT dd.d AS run_date, x.k AS key, false AS still_listed FROM x JOIN dd ON dd.n = x.n + 1 WHERE NOT EXISTS (FROM x y WHERE y.k = x.k AND y.n = x.n + 1)",
    "run_counts": f"{_RUNS} SELECT d AS run_date, (SELECT count(*) FROM x WHERE x.n = dd.n) AS active, (SELECT count(*) FROM m WHERE m.n = dd.n AND is_new) AS new_this_run, (SELECT count(*) FROM x WHERE x.n = dd.n - 1 AND NOT EXISTS (FROM x y WHERE y.k = x.k AND y.n = dd.n)) AS gone_since_last_run FROM dd WHERE n > 1",
    "price_change": f"SELECT source_id, record_id, price, previous AS previous_price FROM (SELECT source_id, record_id, price, lag(price) OVER (PARTITION BY source_id ORDER BY seen_at NULLS FIRST, record_id) AS previous FROM (SELECT *, {_ITEM} AS source_id FROM feed_items) WHERE price IS NOT NULL AND NOT isnan(price) AND source_id <> '') WHERE previous <> price",
    "queue_first": f"SELECT key, min(check_id) AS check_id, arg_min(tier, check_id) AS tier FROM ({_KEYED.replace('{0}', 'SELECT check_id, tier, CASE WHEN street <> ' + chr(39) * 2 + ' THEN street ELSE ' + chr(39) * 2 + ' END AS s, resort AS r, district AS d FROM needs_check')}) WHERE trim(key, '|') <> '' AND key NOT IN (SELECT key FROM ({_STREET_KEYS})) GROUP BY 1",
    "tier_counts": "SELECT CAST(t AS INTEGER) AS tier, count(check_id) AS n FROM range(1, 5) r(t) LEFT JOIN needs_check ON tier = t GROUP BY 1",
    "store_insert": "WITH a AS (SELECT name AS key, arg_min(lat, street_id) AS lat, arg_min(lon, street_id) AS lon FROM streets WHERE district < 'N' GROUP BY 1), b AS (SELECT name AS key, arg_min(lat, street_id) AS lat, arg_min(lon, street_id) AS lon FROM streets GROUP BY 1) SELECT * FROM a UNION ALL SELECT * FROM b WHERE key NOT IN (SELECT key FROM a)",
    "source_counts": "SELECT source, count(*) AS n FROM documents GROUP BY 1",
    "source_list": "SELECT string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM site_listings",
    "match_rate": f"SELECT source, count(*) AS tried, count(hit) AS found FROM ({_FOLDED.format('coalesce(street, ' + chr(39) * 2 + ')', 'site_listings')}) l LEFT JOIN (SELECT DISTINCT fold AS hit FROM ({_FOLDED.format('name', 'streets')})) s ON l.fold = s.hit GROUP BY 1",
    "nearest_names": "WITH n AS (SELECT DISTINCT name, substring(name, 1, 1) AS l FROM streets) SELECT a.name, b.name AS other, CAST(row_number() OVER (PARTITION BY a.name ORDER BY levenshtein(a.name, b.name), b.name DESC) AS INTEGER) AS rank FROM n a JOIN n b USING (l) WHERE a.name <> b.name QUALIFY rank <= 5",
    "final_rank": "SELECT listing_id, l.district, round(coalesce(round_even(2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin(radians(a - 5.8232::DOUBLE) / 2), 2) + cos(radians(5.8232::DOUBLE)) * cos(radians(a)) * pow(sin(radians(o - -55.1679::DOUBLE) / 2), 2))), 3), 999.0::DOUBLE), 1) AS km FROM site_listings l LEFT JOIN (SELECT ressort, district, round_even(avg(lat), 6) AS a, round_even(avg(lon), 6) AS o FROM streets GROUP BY 1, 2) s ON l.resort = s.ressort AND l.district = s.district",
    "json_round_trip": "SELECT url, title, street, CASE WHEN isnan(price) THEN NULL ELSE price END AS price, coalesce(CAST(len(images) AS INTEGER), 0) AS n_images FROM feed_items",
    "street_dimension": "SELECT trim(name) AS name, trim(ressort) AS ressort, round_even(lat, 6) AS lat, round_even(lon, 6) AS lon FROM streets WHERE name <> ''",
    "html_cards": "SELECT url, regexp_replace(trim(title), '\\s+', ' ', 'g') AS title, round_even(price, 0) AS price, CASE WHEN round_even(size_m2, 0) > 0 THEN round_even(size_m2, 0) END AS size_m2 FROM site_listings WHERE url IS NOT NULL AND price IS NOT NULL AND NOT isnan(price)",
    "rest_rows": "SELECT listing_id, url, resort, district, title_type, CASE WHEN round_even(size_m2, 0) > 0 THEN round_even(size_m2, 0) END AS size_m2, first_seen AS posted, '+5978543210' AS phones FROM site_listings WHERE price IS NOT NULL AND NOT isnan(price)",
    "detail_join": "SELECT listing_id, CASE WHEN isnan(size_m2) OR round_even(size_m2, 0) <= 0 THEN NULL ELSE round_even(size_m2, 0) END AS size_m2, CASE WHEN size_m2 IS NULL OR isnan(size_m2) THEN '' ELSE 'https://img.example/' || listing_id END AS images FROM site_listings",
    "street_words": "SELECT check_id, " + " OR ".join(f"contains(lower(coalesce(street, '')), '{w}')" for w in T.STREETY) + " AS streety FROM needs_check",
    "land_types": "SELECT record_id FROM feed_items WHERE regexp_matches(title, '(?i)perceel|percelen|kavel|grond|land|plot')",
    "within_distance": "SELECT listing_id FROM site_listings l JOIN (SELECT ressort, district, round_even(avg(lat), 6) AS a, round_even(avg(lon), 6) AS o FROM streets GROUP BY 1, 2) s ON l.resort = s.ressort AND l.district = s.district WHERE round_even(2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin(radians(a - 5.8232::DOUBLE) / 2), 2) + cos(radians(5.8232::DOUBLE)) * cos(radians(a)) * pow(sin(radians(o - -55.1679::DOUBLE) / 2), 2))), 3) <= 20",
    "viewport": "SELECT street_id, lat, lon FROM streets WHERE lat BETWEEN 5.5 AND 5.8 AND lon BETWEEN -55.3 AND -55.0",
    "area_radius": "SELECT listing_id, CAST(greatest(400, least(6000, CASE WHEN size_m2 <> 0 AND NOT isnan(size_m2) THEN floor(sqrt(abs(size_m2 * 1000) / pi())) ELSE 1500 END)) AS INTEGER) AS radius_m FROM site_listings",
    "absolute_urls": "SELECT listing_id, 'https://x.example/a/i/' || listing_id || '.jpg' AS image, CASE WHEN currency IN ('USD', 'SRD') THEN currency ELSE 'EUR' END AS currency FROM site_listings",
    "source_union": "SELECT 'sites' AS source, count(*) AS n, count(url) AS with_url FROM site_listings UNION ALL SELECT 'feed', count(*), count(url) FROM feed_items",
}

#: The greedy rule as it is said: adverts one after the other, with a map of the fingerprints claimed so far. Only those that share one need a step.
_GREEDY = """WITH RECURSIVE f AS MATERIALIZED ({0}),
n AS MATERIALIZED (SELECT listing_id, list(fingerprint ORDER BY left(fingerprint, 1)) AS fps FROM f GROUP BY 1),
p AS MATERIALIZED (SELECT listing_id, bool_or(many) AS shared FROM (SELECT listing_id, count(*) OVER (PARTITION BY fingerprint) > 1 AS many FROM f) GROUP BY 1),
a AS MATERIALIZED (SELECT l.listing_id AS id, l.source, l.url, coalesce(n.fps, []) AS fps, coalesce(p.shared, false) AS shared,
  CASE WHEN size_m2 <> 0 AND NOT isnan(size_m2) THEN 3 ELSE 0 END + CASE WHEN price <> 0 AND NOT isnan(price) THEN 3 ELSE 0 END + CASE WHEN district <> '' THEN 1 ELSE 0 END AS score
  FROM site_listings l LEFT JOIN n USING (listing_id) LEFT JOIN p USING (listing_id)),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS i FROM a WHERE shared),
s AS (
  SELECT 0::BIGINT AS i, MAP([]::VARCHAR[], []::STRUCT(id BIGINT, source VARCHAR, url VARCHAR)[]) AS m, NULL::BIGINT AS id, NULL::VARCHAR AS fate, NULL::BIGINT AS into_id
  UNION ALL
  SELECT i, CASE WHEN fate = 'kept' THEN map_concat(map_from_entries([{{'k': x, 'v': {{'id': id, 'source': source, 'url': url}}}} FOR x IN fps IF NOT map_contains(m, x)]), m) ELSE m END, id, fate, CASE WHEN fate = 'merged' THEN hit.id END
  FROM (SELECT *, CASE WHEN hit IS NULL THEN 'kept' WHEN source IS DISTINCT FROM hit.source THEN 'merged' WHEN url IS NOT DISTINCT FROM hit.url THEN 'dropped' WHEN hit_at = fps[1] THEN 'merged' ELSE 'kept' END AS fate
    FROM (SELECT *, CASE WHEN hit_at IS NOT NULL THEN m[hit_at] END AS hit FROM (SELECT o.*, s.m, list_filter(o.fps, lambda x: map_contains(s.m, x))[1] AS hit_at FROM s JOIN o ON o.i = s.i + 1))))
SELECT id AS listing_id, fate, into_id AS merged_into FROM s WHERE i > 0 UNION ALL SELECT id, 'kept', NULL FROM a WHERE NOT shared"""
SQL["dedup_greedy"] = _GREEDY.format(SQL["fingerprints"])
_FIRST_BY = "arg_min({0}, (-score, id)) FILTER (WHERE {1}) AS {0}"
_GROUPS = f"""(SELECT l.*, l.listing_id AS id, coalesce(g.merged_into, g.listing_id) AS head, g.fate = 'merged' AS merged,
  CASE WHEN size_m2 <> 0 AND NOT isnan(size_m2) THEN 3 ELSE 0 END + CASE WHEN price <> 0 AND NOT isnan(price) THEN 3 ELSE 0 END + CASE WHEN district <> '' THEN 1 ELSE 0 END AS score
  FROM ({SQL["dedup_greedy"]}) g JOIN site_listings l USING (listing_id) WHERE fate <> 'dropped')"""
SQL["merged_listings"] = "SELECT head AS listing_id, count(*) FILTER (WHERE merged) AS merged_in, " + ", ".join(
    [*(_FIRST_BY.format(c, f"{c} <> 0 AND NOT isnan({c})") for c in ("size_m2", "price")), *(_FIRST_BY.format(c, f"{c} <> ''") for c in ("currency", "district", "resort", "street", "title_type", "posted")), *(f"arg_min({c}, (-score, id)) AS {c}" for c in ("source", "url", "source_id"))]
) + f" FROM {_GROUPS} GROUP BY 1"
SQL["also_listed"] = f"WITH g AS {_GROUPS} SELECT a.head AS listing_id, a.source, a.url, a.agent, a.price, a.currency FROM g a JOIN g o ON a.head = o.head AND a.merged AND NOT o.merged AND a.url IS DISTINCT FROM o.url QUALIFY row_number() OVER (PARTITION BY a.head, a.url ORDER BY a.score DESC, a.id) = 1"
SQL["quality_histogram"] = f"SELECT quality, count(*) AS n FROM ({SQL['quality_score']}) GROUP BY 1"
