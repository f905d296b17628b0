"""Text to typed columns: cleaning, keys, prices, areas, phones, places, urls.

All are Column expressions; ``clean_unicode`` and ``unaccented`` need Python (Spark has neither compatibility forms nor entity decoding) and travel in
Arrow batches. A missing text and an empty one mean the same (``truthy``).
"""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# ---- fixed values: what the parsing rules look for, in the order in which they look
CURRENCY_TOKENS = (("eur", "EUR"), ("€", "EUR"), ("usd", "USD"), ("$", "USD"), ("us$", "USD"), ("srd", "SRD"), ("sr$", "SRD"), ("srd.", "SRD"))
ON_REQUEST = ("op aanvraag", "on request", "n.o.t.k", "prijs op")
PER_M2 = r"p(er)?\s*/?\s*m.?2|p/m"
PRICE_NUMBER = r"(\d[\d.,\s]{2,})"
SIZE_NUMBER = r"(?i)(\d[\d.,]*)\s*(m\s*[²2]|m2|vierkante meter|sq\s?m|ha\b|hectare|acre)"
PHONE_RUN = r"(\+?\d[\d\s\-().]{5,18}\d)"
PRICE_LABEL = r"(?i)(?:vraag|koop|verkoop)?prijs\w*\s*[:\-]?\s*([^\n;|]{0,45})"
PRICE_NEAR = r"(?i)((?:€|eur|usd|srd|us\$|sr\$|\$)\s*[\d][\d.,\s]{2,}|[\d][\d.,\s]{2,}\s*(?:€|eur|usd|srd|euro|dollar))"
ACRE, HECTARE = 4046.86, 10000.0
RATES = {"EUR": 1.0, "USD": 0.92, "SRD": 0.023}
SOUND_STEPS = (("ij", "y"), ("ck", "k"), ("th", "t"), ("ph", "f"), ("z", "s"), ("ie", "i"))
STREET_SUFFIXES = ("straat", "weg", "laan", "pad", "dreef", "gracht", "plein", "steeg", "kanaal", "polder", "serie", "kade", "singel", "boulevard")
NO_STREETS = ("onderweg", "toegangsweg", "zijweg", "hoofdweg", "snelweg", "ontsluitingsweg", "doorgaandeweg", "verharde weg", "zandweg", "hoofdstraat", "zijstraat", "hoekstraat", "dwarsstraat", "openbareweg", "asfaltweg", "bouwkade", "achterweg", "landweg", "toegangspad", "voetpad", "wandelpad", "fietspad")
STREET_NOISE = r"(?i)\b(te\s+koop|for\s+sale|aangeboden|verkoop|eigendoms?perceel|eigendoms?kavel|bouwperceel|bouwkavel|perceel(en)?|kavel(s)?|plot|grondhuur|eigendom|investerings?\s*object|project|verkaveling|zijstr(aat)?\.?|hoek(perceel)?|nabij|gelegen\s+aan|aan\s+de|ruim(e)?|mooi(e)?|\d+\s*ha)\b"
KEY_NOISE = r"(?i)\b(te koop|for sale|perceel|percelen|kavel|bouwkavel|plot|land|grond|in suriname|suriname|nr|no|nummer|#)\b"
SIZE_LABEL = r"(?i)(?:perceel\s*(?:grootte|oppervlakte)|kavelgrootte|oppervlakte\s*perceel|terreingrootte|perceelgrootte)\s*[:\-]?\s*([^\n.;]{0,40})"
DETAIL_LABELS = ("perceeloppervlakte", "perceel opp", "kaveloppervlakte", "oppervlakte", "plot size", "terrein")
STREETY = ("straat", "weg", "laan", "pad", "dreef", "kanaal", "project", "plein", "steeg", "gracht", "polder", "serie", "km ", "kmr")
NO_LISTING = ("/informatiebron/", "/blog/", "/nieuws/", "/news/", "/artikel/", "/article/", "/tips/", "/category/", "/author/")


def truthy(c: Column, kind: str = "string") -> Column:
    """Whether a value counts as present: not null, and not empty, zero or an empty list."""
    return F.coalesce({"string": c != "", "number": (c != 0) & ~F.isnan(c.cast("double")), "array": F.size(c) > 0}[kind], F.lit(False))


def let(value: Column, use) -> Column:
    """use(value) with value worked out once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def clean(c: Column) -> Column:
    """Without tags, entities of mark-up decoded, superscripts as digits, white space squeezed; empty for null."""
    c = F.translate(F.coalesce(c, F.lit("")), "²³¹ｍ", "231m")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&euro;", "€"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return squeeze(c)


@F.pandas_udf(StringType())
def clean_unicode(texts: pd.Series) -> pd.Series:
    """``clean`` for any text: compatibility forms first, then tags, every entity, white space."""
    tag, space = re.compile(r"<[^>]+>"), re.compile(r"\s+")

    def one(t):
        if not t:
            return ""
        t = tag.sub(" ", t if t.isascii() else unicodedata.normalize("NFKC", t))
        return space.sub(" ", html.unescape(t) if "&" in t else t).strip()

    return texts.map(one, na_action=None)


@F.pandas_udf(StringType())
def unaccented(texts: pd.Series) -> pd.Series:
    """Letters without their accents (compatibility decomposition, combining marks dropped)."""
    return texts.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def slug(plain: Column) -> Column:
    """Of an unaccented text: lower case, everything but letters and digits as one hyphen."""
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), F.lit("-"))


def street_fold(plain: Column) -> Column:
    """Of an unaccented street name: what makes it recognisable in spite of spelling."""
    c = F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", ""), r"(.)\1+", "$1")
    for a, b in SOUND_STEPS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def street_key(street: Column, title: Column, resort: Column) -> Column:
    """The key of a plot's place for duplicate detection, before ``unaccented`` and ``slug``: street (else title) and resort without noise words and plot numbers."""
    raw = F.concat_ws(" ", F.nullif(F.when(truthy(street), street).otherwise(F.coalesce(title, F.lit(""))), F.lit("")), F.nullif(resort, F.lit("")))
    raw = F.regexp_replace(clean(raw), KEY_NOISE, " ")
    return F.regexp_replace(raw, r"(?i)\b(pc|p\.?c\.?|perc)\.?\s*\d+[a-z]?\b", " ")


def _decimal(raw: Column, comma_digits: str) -> Column:
    """A double from digits and separators. comma_digits: how many digits after a lone comma make it a decimal one."""
    both = raw.contains(",") & raw.contains(".")
    comma_last = F.length(F.substring_index(raw, ",", -1)) < F.length(F.substring_index(raw, ".", -1))
    drop = lambda c, x: F.replace(c, F.lit(x), F.lit(""))
    point = lambda c: F.replace(c, F.lit(","), F.lit("."))
    text = (
        F.when(both & comma_last, point(drop(raw, ".")))
        .when(both, drop(raw, ","))
        .when(raw.contains(","), F.when(raw.rlike(rf",\d{{{comma_digits}}}$"), point(raw)).otherwise(drop(raw, ",")))
        .otherwise(F.when(raw.rlike(r"^\d*(\.\d{3})+$"), drop(raw, ".")).otherwise(raw))
    )
    return F.when(text.rlike(r"^\d+(\.\d*)?$"), F.rtrim(text, F.lit(".")).cast("double"))


def currency_token(t: Column) -> Column:
    """The currency of the first token, in the fixed order, that a lower-case text holds."""
    return F.coalesce(*[F.when(t.contains(token), F.lit(code)) for token, code in CURRENCY_TOKENS])


def parse_price(cleaned: Column) -> Column:
    """struct(amount, currency, per_m2) of a cleaned text: its first number."""

    def read(t: Column) -> Column:
        none = (t == "") | F.reduce(F.array(*[t.contains(w) for w in ON_REQUEST]), F.lit(False), lambda a, b: a | b)
        raw = F.regexp_replace(F.regexp_extract(t, PRICE_NUMBER, 1), r"\s", "")
        return let(F.struct(none.alias("none"), let(raw, lambda r: _decimal(r, "2")).alias("value"), currency_token(t).alias("code"), t.rlike(PER_M2).alias("per")), told)

    def told(x: Column) -> Column:
        amount = F.when(~x["none"] & (x["value"] > 0), x["value"])
        code = F.when(~x["none"], x["code"])
        return F.struct(amount.alias("amount"), F.when(amount.isNotNull(), F.coalesce(code, F.lit("EUR"))).otherwise(code).alias("currency"), (~x["none"] & x["per"]).alias("per_m2"))

    return let(F.lower(cleaned), read)


def price_eur(amount: Column, currency: Column) -> Column:
    rate = F.coalesce(*[F.when(currency == c, F.lit(r)) for c, r in RATES.items()], F.lit(1.0))
    return F.bround(amount * rate, 2)


def parse_size(cleaned: Column) -> Column:
    """Square metres of the first area in a cleaned text. Only "ha" itself counts as hectares: the unit "hectare" starts with it."""
    raw, unit = let(F.regexp_extract(cleaned, SIZE_NUMBER, 1), lambda r: _decimal(r, "0,2")), F.lower(F.regexp_extract(cleaned, SIZE_NUMBER, 2))

    def metres(x: Column) -> Column:
        value = F.when(x["unit"].startswith("ha"), x["value"] * HECTARE).when(x["unit"].startswith("acre"), x["value"] * ACRE).otherwise(x["value"])
        return F.when(value > 0, F.bround(value, 1))

    return let(F.struct(raw.alias("value"), unit.alias("unit")), metres)


def labelled_size(cleaned: Column) -> Column:
    """The area after a size label, else the first one of the text."""
    return let(cleaned, lambda c: F.coalesce(parse_size(F.regexp_extract(c, SIZE_LABEL, 1)), parse_size(c)))


def detail_size(cleaned: Column) -> Column:
    """The area in the 90 characters from the first label that has one, else the first one of the text."""

    def read(x: Column) -> Column:
        at = lambda label: F.when(x["low"].contains(label), parse_size(F.substring(x["c"], F.instr(x["low"], label), F.lit(90))))
        return F.coalesce(*[at(label) for label in DETAIL_LABELS], parse_size(x["c"]))

    return let(let(cleaned, lambda c: F.struct(c.alias("c"), F.lower(c).alias("low"))), read)


def parse_phones(cleaned: Column, most: int = 4) -> Column:
    """The phone numbers of a cleaned text in order, without repeats."""
    bare = F.transform(F.regexp_extract_all(cleaned, F.lit(PHONE_RUN), 1), lambda m: F.regexp_replace(m, r"[^\d+]", ""))

    def norm(p: Column) -> Column:
        d = F.regexp_replace(p, r"\D", "")
        n = F.length(d)
        return F.when(n.between(6, 15), F.when(d.startswith("597") & (n >= 9), F.concat(F.lit("+"), d)).when(n.isin(6, 7), F.concat(F.lit("+597"), d)).when(d.startswith("31") & (n >= 10), F.concat(F.lit("+"), d)).otherwise(p))

    return F.slice(F.array_distinct(F.filter(F.transform(bare, norm), lambda p: p.isNotNull())), 1, most)


def sane_price(amount: Column, written: Column) -> Column:
    """Whether an amount may be an asking price: not a phone number or an object number without separators."""
    return F.coalesce(amount.between(1000, 3_000_000) & ((amount < 1_000_000) | written.rlike(r"[.,]")), F.lit(False))


def find_price(cleaned: Column) -> Column:
    """struct(amount, currency, per_m2) of an advert: behind the first price label, else the largest sane amount beside a currency (the first of equals)."""
    return let(cleaned, _find_price)


def _find_price(cleaned: Column) -> Column:
    near = F.transform(F.regexp_extract_all(cleaned, F.lit(PRICE_NEAR), 1), lambda m: F.struct(parse_price(m).alias("p"), m.alias("m")))
    sane = F.filter(near, lambda x: sane_price(x["p"]["amount"], x["m"]))
    best = F.aggregate(sane, F.lit(None).cast("struct<amount:double,currency:string,per_m2:boolean>"), lambda acc, x: F.when(acc.isNull() | (x["p"]["amount"] > acc["amount"]), x["p"]).otherwise(acc))
    named = let(F.regexp_extract(cleaned, PRICE_LABEL, 1), lambda label: F.struct(parse_price(label).alias("p"), label.alias("m")))
    return let(named, lambda n: F.when(sane_price(n["p"]["amount"], n["m"]), n["p"]).otherwise(best))


def first_of(names: list[str], text: Column) -> Column:
    """The first of some names, in the list's order, that stands as a word in a text."""
    return F.coalesce(*[F.when(text.rlike(rf"(?i)\b{re.escape(n)}\b"), F.lit(n)) for n in names])


def last_of(words: list[str], text: Column) -> Column:
    """The last of some words, in the list's order, that a text holds in any case."""
    return F.coalesce(*[F.when(F.lower(text).contains(w.lower()), F.lit(w)) for w in reversed(words)])


def clean_image_urls(urls: Column, most: int = 10) -> Column:
    """Web addresses in order without repeats: doubled schemes and missing ones repaired, the rest dropped."""
    fixed = F.transform(urls, lambda u: F.regexp_replace(F.regexp_replace(F.trim(u), r"(?i)^https?:(?=https?://)", ""), r"^//", "https://"))
    return F.slice(F.array_distinct(F.filter(fixed, lambda u: F.coalesce(u.startswith("http"), F.lit(False)))), 1, most)


def extract_street(cleaned: Column) -> Column:
    """struct(street, rest): the longest word of a headline that ends like a street (the first of equals), and what follows it up to a mark."""
    token = r"(?iU)\b([A-Za-z][\w'.-]+?(?:" + "|".join(STREET_SUFFIXES) + r"))\b"
    straight = F.translate(cleaned, "’‘", "''")
    found = F.filter(F.transform(F.regexp_extract_all(straight, F.lit(token), 1), lambda s: F.trim(s, F.lit(" -."))), lambda s: (F.length(s) >= 6) & ~F.lower(s).isin(*NO_STREETS))
    best = F.aggregate(found, F.lit(None).cast("string"), lambda acc, s: F.when(acc.isNull() | (F.length(s) > F.length(acc)), s).otherwise(acc))
    rest = F.call_function("substring_index", straight, best, F.lit(-1))
    rest = F.regexp_replace(F.regexp_replace(rest, r"^[\s,;:.\-–—()]+", ""), r"[,()|].*$", "")
    return F.struct(best.alias("street"), F.when(best.isNotNull(), F.regexp_replace(F.trim(rest), r"(?i)^(omgeving|nabij|te|nabij\s+de|bij)\s+", "")).alias("rest"))


def normalise_street(cleaned: Column) -> Column:
    """The street of a headline, else the headline without noise words, tails and a house number."""
    s = F.substring_index(F.substring_index(F.translate(cleaned, "’‘", "''"), ",", 1), "|", 1)
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, STREET_NOISE, " "), r"[#(].*$", ""), r"\b\d+\s*[a-z]?\b\s*$", "")
    return F.coalesce(extract_street(cleaned)["street"], F.trim(F.regexp_replace(s, r"\s{2,}", " "), F.lit(" ,.;:-–—")))


def normal_url(url: Column) -> Column:
    u = F.rtrim(F.substring_index(F.lower(clean(url)), "?", 1), F.lit("/"))
    for part in ("https://", "http://", "www."):
        u = F.replace(u, F.lit(part), F.lit(""))
    return u


def address_key(street: Column, title: Column, resort: Column, district: Column) -> Column:
    """street|resort|district, normalised; the same for every advert of an address."""
    part = lambda c: F.trim(F.lower(clean(c)), F.lit(" ,.;:-"))
    return F.concat_ws("|", part(normalise_street(clean(F.when(truthy(street), street).otherwise(title)))), part(resort), part(district))


def maps_url(street: Column, resort: Column, district: Column, country: str = "Suriname") -> Column:
    parts = [F.nullif(F.replace(c, F.lit(" "), F.lit("+")), F.lit("")) for c in (street, resort, district)]
    return F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), F.concat_ws("+", *parts, F.lit(country)))


def last_segment(url: Column, most: int = 80) -> Column:
    return F.substring(F.substring_index(F.rtrim(url, F.lit("/")), "/", -1), 1, most)


def thumb_name(url: Column) -> Column:
    return F.concat(F.substring(F.sha1(url), 1, 16), F.lit(".webp"))


def is_listing(url: Column, *present: Column) -> Column:
    """Whether a page is an advert: not of a news section, and something is known of the plot."""
    low = F.lower(F.coalesce(url, F.lit("")))
    news = F.reduce(F.array(*[low.contains(x) for x in NO_LISTING]), F.lit(False), lambda a, b: a | b)
    return ~news & F.greatest(*[p.cast("int") for p in present], F.lit(0)).cast("boolean")


#: Fixed value: names of kinds of property that are land.
LAND_TYPE = r"(?i)perceel|percelen|kavel|grond|land|plot"


def land_type(name: Column) -> Column:
    """Whether a kind of property, by its name, is land."""
    return F.coalesce(name.rlike(LAND_TYPE), F.lit(False))


def currency_of_class(classes: Column) -> Column:
    """The currency that the class of an element names; EUR where it names none."""
    low = F.lower(F.coalesce(classes, F.lit("")))
    return F.when(low.contains("usd"), "USD").when(low.contains("srd"), "SRD").otherwise("EUR")


@F.pandas_udf(StringType())
def absolute_url(bases: pd.Series, urls: pd.Series) -> pd.Series:
    """Addresses against their pages'; null where there is none or it can't be one."""

    def one(base, url):
        try:
            return urljoin(base or "", url.strip()) if url and url.strip() else None
        except ValueError:
            return None

    return pd.Series([one(b, u) for b, u in zip(bases, urls)], dtype=object)


def looks_like_street(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.reduce(F.array(*[low.contains(x) for x in STREETY]), F.lit(False), lambda a, b: a | b)
