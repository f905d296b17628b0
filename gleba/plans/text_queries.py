"""Queries of the scalar functions: text to typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleba.functions import geo, text as T
from gleba.session import table
from gleba.sources import feeds

CENTRE = (5.8232, -55.1679)


def _feed(spark, sf_dir):
    return table(spark, sf_dir, "feed_items")


def clean_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(T.clean(F.col("text"))).alias("cleaned"))


def clean_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_unicode("text").alias("cleaned"))


def slug_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "site_listings").select("listing_id", T.slug(T.unaccented(F.coalesce("title", F.lit("")))).alias("slug"))


def street_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "site_listings")
    return df.select("listing_id", F.substring(T.slug(T.unaccented(T.street_key(F.col("street"), F.col("title"), F.col("resort")))), 1, 60).alias("street_key"))


def street_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "site_listings").where("street is not null").select("listing_id", T.street_fold(T.unaccented("street")).alias("fold"))


def parse_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(spark, sf_dir).where("price_text is not null").select("record_id", T.parse_price(T.clean(F.col("price_text"))).alias("p")).select("record_id", "p.*")


def parse_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(spark, sf_dir).where("size_text is not null").select("record_id", T.parse_size(T.clean(F.col("size_text"))).alias("size_m2"))


def find_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", T.find_price(T.clean(F.col("text"))).alias("p")).select("doc_id", "p.*").where("amount is not null")


def labelled_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(spark, sf_dir).where("description is not null").select("record_id", T.labelled_size(T.clean(F.col("description"))).alias("size_m2"), T.detail_size(T.clean(F.col("description"))).alias("detail_m2"))


def find_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(spark, sf_dir).select("record_id", F.array_join(T.parse_phones(T.clean(F.col("description"))), ",").alias("phones")).where("phones <> ''")


def price_eur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "site_listings").select("listing_id", T.price_eur(F.col("price"), F.col("currency")).alias("price_eur"))


def eur_per_m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    eur = T.price_eur(F.col("price"), F.col("currency"))
    both = T.truthy(eur, "number") & T.truthy(F.col("size_m2"), "number")
    return table(spark, sf_dir, "site_listings").select("listing_id", F.when(both, F.bround(eur / F.col("size_m2"), 1)).alias("eur_per_m2"))


def _districts(spark, sf_dir) -> list[str]:
    names = [r[0] for r in table(spark, sf_dir, "streets").select("district").distinct().limit(1001).collect() if r[0]]
    if len(names) > 1000:
        raise ValueError("more than 1000 districts")
    return sorted(names)


def guess_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _districts(spark, sf_dir)
    return _feed(spark, sf_dir).select("record_id", T.first_of(names, F.concat_ws(" ", "district", "title")).alias("district"))


def title_type_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(spark, sf_dir).where("title_type is not null").select("record_id", T.last_of(["Grondhuur", "Eigendom", "Erfpacht", "Huurgrond", "Plantagegrond"], F.col("title_type")).alias("title_type"))


def image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = T.clean_image_urls(F.transform("images", lambda u: F.concat(F.lit("https:"), u)))
    return _feed(spark, sf_dir).where("images is not null").select("record_id", F.size(urls).alias("n"), F.array_join(urls, " ").alias("images"))


def thumb_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(spark, sf_dir).where("size(images) > 0").select("record_id", T.thumb_name(F.col("images")[0]).alias("thumb"))


def source_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "site_listings").select("listing_id", T.last_segment(F.col("url"), 40).alias("sid"), T.normal_url(F.col("url")).alias("nurl"))


def address_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "site_listings").select("listing_id", T.address_key(F.col("street"), F.col("title"), F.col("resort"), F.col("district")).alias("key"))


def extract_street(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.extract_street(T.clean(F.col("title")))
    return table(spark, sf_dir, "site_listings").select("listing_id", s["street"].alias("street"), T.normalise_street(T.clean(F.col("street"))).alias("normal"))


def maps_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "needs_check").select("check_id", T.maps_url(F.col("street"), F.col("resort"), F.col("district")).alias("maps_url"))




def location_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _districts(spark, sf_dir)
    df = table(spark, sf_dir, "streets").withColumns({"p": F.concat_ws(", ", "name", "ressort", "district"), "q": F.concat_ws(" - ", "district", "ressort")})
    for mode, col in (("street_first", "p"), ("resort_first", "p"), ("ends", "p"), ("dash", "q")):
        df = df.withColumn(mode, feeds.split_location(F.col(col), mode, names))
    return df.select("street_id", F.col("street_first.street").alias("street"), F.col("street_first.resort").alias("resort"), F.col("ends.resort").alias("ends_resort"), F.col("ends.district").alias("ends_district"), F.col("resort_first.resort").alias("first_resort"), F.col("dash.district").alias("dash_district"), F.col("dash.resort").alias("dash_resort"))


def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    km = geo.haversine_km(F.lit(CENTRE[0]), F.lit(CENTRE[1]), F.col("lat"), F.col("lon"))
    return table(spark, sf_dir, "streets").select("street_id", km.alias("km_from_centre"))


def feed_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = feeds.feed_listings(_feed(spark, sf_dir).withColumn("rid", F.col("record_id")))
    return df.groupBy("currency").agg(F.count("*").alias("n"), F.count("price").alias("priced"), F.count("size_m2").alias("sized"), F.count_if(F.size("phones") > 0).alias("with_phone"))


QUERIES = {f.__name__: f for f in (clean_markup, clean_unicode, slug_key, street_key, street_fold, parse_price, parse_size, find_price, labelled_size, find_phones, price_eur, eur_per_m2, guess_district, title_type_keyword, image_urls, thumb_name, source_id, address_key, extract_street, maps_url, location_parts, haversine, feed_fallbacks)}

# ---- the same in SQL

_CLEAN = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(translate(coalesce({0}, ''), '²³¹ｍ', '231m'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&euro;', '€'), '&amp;', '&'), '[\s ]+', ' ', 'g'))".replace('\\"', '"')


def _decimal_sql(raw: str, comma: str) -> str:
    return f"""(CASE WHEN {raw} LIKE '%,%' AND {raw} LIKE '%.%' THEN CASE WHEN length(split_part({raw}, ',', -1)) < length(split_part({raw}, '.', -1)) THEN replace(replace({raw}, '.', ''), ',', '.') ELSE replace({raw}, ',', '') END
  WHEN {raw} LIKE '%,%' THEN CASE WHEN regexp_matches({raw}, ',\\d{{{comma}}}$') THEN replace({raw}, ',', '.') ELSE replace({raw}, ',', '') END
  WHEN regexp_full_match({raw}, '\\d*(\\.\\d{{3}})+') THEN replace({raw}, '.', '') ELSE {raw} END)"""


_NUM = r"CASE WHEN regexp_full_match({0}, '\d+(\.\d*)?') THEN CAST(rtrim({0}, '.') AS DOUBLE) END"
_EUR = "round_even(price * CASE currency WHEN 'EUR' THEN 1.0::DOUBLE WHEN 'USD' THEN 0.92::DOUBLE WHEN 'SRD' THEN 0.023::DOUBLE ELSE 1.0::DOUBLE END, 2)"
_PRICE = rf"""
SELECT *, CASE WHEN NOT none AND v > 0 THEN v END AS amount_, CASE WHEN NOT none THEN tok END AS code_ FROM (
  SELECT *, {_NUM.format('d')} AS v FROM (
    SELECT *, {_decimal_sql('raw', '2')} AS d FROM (
      SELECT *, t = '' OR t LIKE '%op aanvraag%' OR t LIKE '%on request%' OR t LIKE '%n.o.t.k%' OR t LIKE '%prijs op%' AS none,
        regexp_replace(regexp_extract(t, '(\d[\d.,\s]{{2,}})', 1), '\s', '', 'g') AS raw,
        CASE WHEN t LIKE '%eur%' OR t LIKE '%€%' THEN 'EUR' WHEN t LIKE '%usd%' OR t LIKE '%$%' THEN 'USD' WHEN t LIKE '%srd%' THEN 'SRD' END AS tok,
        regexp_matches(t, 'p(er)?\s*/?\s*m.?2|p/m') AS per
      FROM src)))
"""
_SIZE = rf"""
SELECT *, CASE WHEN m > 0 THEN round_even(m, 1) END AS size_ FROM (
  SELECT *, CASE WHEN unit LIKE 'ha%' THEN v * 10000 WHEN unit LIKE 'acre%' THEN v * 4046.86::DOUBLE ELSE v END AS m FROM (
    SELECT *, {_NUM.format('d')} AS v FROM (
      SELECT *, {_decimal_sql('raw', '0,2')} AS d FROM (
        SELECT *, regexp_extract(t, '(?i)(\d[\d.,]*)\s*(m\s*[²2]|m2|vierkante meter|sq\s?m|ha\b|hectare|acre)', 1) AS raw,
          lower(regexp_extract(t, '(?i)(\d[\d.,]*)\s*(m\s*[²2]|m2|vierkante meter|sq\s?m|ha\b|hectare|acre)', 2)) AS unit FROM src))))
"""
_PHONES = r"""list_filter(list_transform(list_transform(regexp_extract_all(t, '(\+?\d[\d\s\-().]{5,18}\d)', 1), lambda m: regexp_replace(m, '[^\d+]', '', 'g')),
  lambda p: CASE WHEN length(regexp_replace(p, '\D', '', 'g')) BETWEEN 6 AND 15 THEN CASE WHEN starts_with(regexp_replace(p, '\D', '', 'g'), '597') AND length(regexp_replace(p, '\D', '', 'g')) >= 9 THEN '+' || regexp_replace(p, '\D', '', 'g')
    WHEN length(regexp_replace(p, '\D', '', 'g')) IN (6, 7) THEN '+597' || regexp_replace(p, '\D', '', 'g') WHEN starts_with(regexp_replace(p, '\D', '', 'g'), '31') AND length(regexp_replace(p, '\D', '', 'g')) >= 10 THEN '+' || regexp_replace(p, '\D', '', 'g') ELSE p END END), lambda p: p IS NOT NULL)"""
_FOLD = "replace(replace(replace(replace(replace(replace(list_aggregate(list_filter(string_split(k, ''), lambda c, i: i = 1 OR c <> string_split(k, '')[i - 1]), 'string_agg', ''), 'ij', 'y'), 'ck', 'k'), 'th', 't'), 'ph', 'f'), 'z', 's'), 'ie', 'i')"
_SUFFIX = "straat|weg|laan|pad|dreef|gracht|plein|steeg|kanaal|polder|serie|kade|singel|boulevard"
_TOKENS = rf"list_filter(list_transform(regexp_extract_all(translate({{0}}, '’‘', ''''''), '(?i)(?:^|[^\p{{{{L}}}}\p{{{{N}}}}_])([A-Za-z][\p{{{{L}}}}\p{{{{N}}}}_''.-]+?(?:{_SUFFIX}))\b', 1), lambda s: trim(s, ' -.')), lambda s: length(s) >= 6 AND lower(s) NOT IN ({', '.join(repr(s) for s in T.NO_STREETS)}))"
_LONGEST = "list_filter({0}, lambda s: length(s) = list_max(list_transform({0}, lambda x: length(x))))[1]"
_NOISE = T.STREET_NOISE.replace("'", "''")
_NORMAL = rf"coalesce({_LONGEST.format(_TOKENS)}, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(split_part(translate({{0}}, '’‘', ''''''), ',', 1), '|', 1), '{_NOISE}', ' ', 'g'), '[#(].*$', '', 'g'), '\b\d+\s*[a-z]?\b\s*$', '', 'g'), '\s{{{{2,}}}}', ' ', 'g'), ' ,.;:-–—'))"


def _fmt(template: str, arg: str) -> str:
    return template.replace("{0}", arg).replace("{{", "{").replace("}}", "}")


_NORM = _fmt(_NORMAL.replace("{{0}}", "{0}"), "t")
_PART = "trim(lower(" + _CLEAN + "), ' ,.;:-')"
_DISTRICT = "(SELECT min(district) FROM (SELECT DISTINCT district FROM streets WHERE district <> '') d WHERE regexp_matches({0}, '(?i)\\b' || d.district || '\\b'))"

_PRICE_OF = _PRICE.strip()
_FALLBACK = f"""
WITH src AS (SELECT record_id, lower({_CLEAN.format('price_text')}) AS t FROM feed_items),
p AS (SELECT record_id, amount_ AS amount, CASE WHEN amount_ IS NOT NULL THEN coalesce(code_, 'EUR') ELSE code_ END AS cur FROM ({_PRICE_OF})),
z AS (WITH src AS (SELECT record_id, {_CLEAN.format('size_text')} AS t FROM feed_items) SELECT record_id, size_ FROM ({_SIZE.strip()})),
d AS (SELECT record_id, len({_PHONES}) AS n FROM (SELECT record_id, {_CLEAN.format('description')} AS t FROM feed_items)),
j AS (SELECT f.record_id, CASE WHEN isnan(price) THEN NULL ELSE price END AS own, amount, cur, currency, phones, CASE WHEN isnan(size_m2) THEN NULL ELSE size_m2 END AS s, size_, d.n AS found FROM feed_items f JOIN p USING (record_id) JOIN z USING (record_id) JOIN d USING (record_id)),
e AS (SELECT coalesce(own, amount) AS price, CASE WHEN coalesce(own, amount) <> 0 THEN coalesce(nullif(CASE WHEN own IS NOT NULL THEN currency ELSE cur END, ''), 'SRD') END AS currency, coalesce(s, size_) AS size, CASE WHEN len(phones) > 0 THEN len(phones) ELSE found END AS n_phones FROM j)
SELECT currency, count(*) AS n, count(price) AS priced, count(size) AS sized, count(*) FILTER (WHERE n_phones > 0) AS with_phone FROM e GROUP BY 1"""

_FIND = f"""
WITH base AS (SELECT doc_id, {_CLEAN.format('text')} AS c FROM documents WHERE text IS NOT NULL),
cand AS (SELECT doc_id, 0 AS pos, regexp_extract(c, '{T.PRICE_LABEL}', 1) AS m FROM base
  UNION ALL SELECT doc_id, unnest(generate_series(1, len(l))), unnest(l) FROM (SELECT doc_id, regexp_extract_all(c, '{T.PRICE_NEAR}', 1) AS l FROM base)),
src AS (SELECT doc_id, pos, m, lower(m) AS t FROM cand), p AS ({_PRICE_OF})
SELECT doc_id, amount_ AS amount, coalesce(code_, 'EUR') AS currency, per AS per_m2 FROM p
WHERE amount_ BETWEEN 1000 AND 3000000 AND (amount_ < 1000000 OR regexp_matches(m, '[.,]'))
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos > 0, amount_ DESC, pos) = 1"""
_LABELS = ", ".join(f"({i}, '{label}')" for i, label in enumerate(T.DETAIL_LABELS))
_LABELLED = f"""
WITH base AS (SELECT record_id, {_CLEAN.format('description')} AS c FROM feed_items WHERE description IS NOT NULL),
src AS (SELECT record_id, 'a' AS kind, 0 AS pos, regexp_extract(c, '{T.SIZE_LABEL}', 1) AS t FROM base
  UNION ALL SELECT record_id, 'b', i, substring(c, instr(lower(c), l), 90) FROM base, (VALUES {_LABELS}) x(i, l) WHERE contains(lower(c), l)
  UNION ALL SELECT record_id, k, 99, c FROM base, (VALUES ('a'), ('b')) y(k)),
z AS ({_SIZE.strip()})
SELECT record_id, arg_min(size_, pos) FILTER (WHERE kind = 'a' AND size_ IS NOT NULL) AS size_m2, arg_min(size_, pos) FILTER (WHERE kind = 'b' AND size_ IS NOT NULL) AS detail_m2 FROM z GROUP BY 1"""

SQL = {
    "find_price": _FIND,
    "labelled_size": _LABELLED,
    "feed_fallbacks": _FALLBACK,
    "clean_markup": f"SELECT doc_id, md5({_CLEAN.format('text')}) AS cleaned FROM documents WHERE text IS NOT NULL",
    "slug_key": "SELECT listing_id, trim(regexp_replace(lower(strip_accents(coalesce(title, ''))), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM site_listings",
    "street_key": rf"""
WITH r AS (SELECT listing_id, {_CLEAN.format("concat_ws(' ', nullif(CASE WHEN coalesce(street, '') <> '' THEN street ELSE coalesce(title, '') END, ''), nullif(resort, ''))")} AS raw FROM site_listings),
s AS (SELECT listing_id, regexp_replace(regexp_replace(raw, '{T.KEY_NOISE}', ' ', 'g'), '(?i)\b(pc|p\.?c\.?|perc)\.?\s*\d+[a-z]?\b', ' ', 'g') AS raw FROM r)
SELECT listing_id, substring(trim(regexp_replace(lower(strip_accents(raw)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS street_key FROM s""",
    "street_fold": f"SELECT listing_id, coalesce({_FOLD}, '') AS fold FROM (SELECT listing_id, regexp_replace(lower(strip_accents(street)), '[^a-z0-9]+', '', 'g') AS k FROM site_listings WHERE street IS NOT NULL)",
    "parse_price": f"WITH src AS (SELECT record_id, lower({_CLEAN.format('price_text')}) AS t FROM feed_items WHERE price_text IS NOT NULL) SELECT record_id, amount_ AS amount, CASE WHEN amount_ IS NOT NULL THEN coalesce(code_, 'EUR') ELSE code_ END AS currency, NOT none AND per AS per_m2 FROM ({_PRICE})",
    "parse_size": f"WITH src AS (SELECT record_id, {_CLEAN.format('size_text')} AS t FROM feed_items WHERE size_text IS NOT NULL) SELECT record_id, size_ AS size_m2 FROM ({_SIZE})",
    "find_phones": f"SELECT * FROM (SELECT record_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:4], ',') AS phones FROM (SELECT record_id, {_PHONES} AS l FROM (SELECT record_id, {_CLEAN.format('description')} AS t FROM feed_items))) WHERE phones <> ''",
    "price_eur": f"SELECT listing_id, {_EUR} AS price_eur FROM site_listings",
    "eur_per_m2": f"SELECT listing_id, CASE WHEN {_EUR} <> 0 AND NOT isnan({_EUR}) AND size_m2 <> 0 AND NOT isnan(size_m2) THEN round_even({_EUR} / size_m2, 1) END AS eur_per_m2 FROM site_listings",
    "guess_district": f"SELECT record_id, {_DISTRICT.replace('{0}', 'x')} AS district FROM (SELECT record_id, concat_ws(' ', district, title) AS x FROM feed_items)",
    "title_type_keyword": "SELECT record_id, CASE WHEN lower(title_type) LIKE '%plantagegrond%' THEN 'Plantagegrond' WHEN lower(title_type) LIKE '%huurgrond%' THEN 'Huurgrond' WHEN lower(title_type) LIKE '%erfpacht%' THEN 'Erfpacht' WHEN lower(title_type) LIKE '%eigendom%' THEN 'Eigendom' WHEN lower(title_type) LIKE '%grondhuur%' THEN 'Grondhuur' END AS title_type FROM feed_items WHERE title_type IS NOT NULL",
    "image_urls": "SELECT record_id, CAST(len(u) AS INTEGER) AS n, array_to_string(u, ' ') AS images FROM (SELECT record_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:10] AS u FROM (SELECT record_id, list_filter(list_transform(images, lambda x: trim(x)), lambda x: starts_with(x, 'http')) AS l FROM feed_items WHERE images IS NOT NULL))",
    "thumb_name": "SELECT record_id, substring(sha1(images[1]), 1, 16) || '.webp' AS thumb FROM feed_items WHERE len(images) > 0",
    "source_id": f"SELECT listing_id, substring(split_part(rtrim(url, '/'), '/', -1), 1, 40) AS sid, replace(replace(replace(rtrim(split_part(lower({_CLEAN.format('url')}), '?', 1), '/'), 'https://', ''), 'http://', ''), 'www.', '') AS nurl FROM site_listings",
    "address_key": f"SELECT listing_id, concat_ws('|', {_PART.replace('{0}', 'norm')}, {_PART.format('resort')}, {_PART.format('district')}) AS key FROM (SELECT *, {_NORM} AS norm FROM (SELECT *, {_CLEAN.format(chr(67) + 'ASE WHEN street <> ' + chr(39) * 2 + ' THEN street ELSE title END')} AS t FROM site_listings))",
    "extract_street": f"SELECT listing_id, {_LONGEST.replace('{0}', _fmt(_TOKENS, "u"))} AS street, {_NORM} AS normal FROM (SELECT listing_id, {_CLEAN.format('title')} AS u, {_CLEAN.format('street')} AS t FROM site_listings)",
    "maps_url": "SELECT check_id, 'https://www.google.com/maps/search/?api=1&query=' || concat_ws('+', nullif(replace(street, ' ', '+'), ''), nullif(replace(resort, ' ', '+'), ''), nullif(replace(district, ' ', '+'), ''), 'Suriname') AS maps_url FROM needs_check",
    "location_parts": "SELECT street_id, name AS street, ressort AS resort, name AS ends_resort, district AS ends_district, name AS first_resort, district AS dash_district, ressort AS dash_resort FROM streets",
    "haversine": "SELECT street_id, round_even(2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin(radians(lat - 5.8232::DOUBLE) / 2), 2) + cos(radians(5.8232::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lon - -55.1679::DOUBLE) / 2), 2))), 3) AS km_from_centre FROM streets",
}
