import pytest
from gleba.functions import geo, text as T
from gleba.operators import dedup
from pyspark.sql import functions as F


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("€ 21.500", (21500.0, "EUR", False)), ("USD 1,250,000.00", (1250000.0, "USD", False)), ("1.234.567,89", (1234567.89, "EUR", False)), ("EUR 25 per m2", (25.0, "EUR", True)), ("€ 25/m2", (None, "EUR", False)), ("SR$ 450.000", (450000.0, "USD", False)), ("€ 12,5", (125.0, "EUR", False)),
        ("21.500,-", (21500.0, "EUR", False)), ("€ 95", (None, "EUR", False)), ("Prijs op aanvraag", (None, None, False)), ("", (None, None, False)), (None, (None, None, False)),
    ],
)
def test_parse_price(spark, text, want):
    assert tuple(one(spark, text, T.parse_price(T.clean(F.col("x"))))) == want


@pytest.mark.parametrize(("text", "want"), [("526,59 m²", 526.6), ("1,96 ha", 19600.0), ("2 hectare", 2.0), ("0.5 acre", 2023.4), ("1.250 m2", 1250.0), ("geen", None), (None, None)])
def test_parse_size(spark, text, want):
    assert one(spark, text, T.parse_size(T.clean(F.col("x")))) == want


@pytest.mark.parametrize(("text", "want"), [("854-3210", ["+5978543210"]), ("475544", []), ("bel +597 854 3210 of 854-3210", ["+5978543210"]), ("0031 6 12345678", ["0031612345678"]), (None, [])])
def test_parse_phones(spark, text, want):
    assert one(spark, text, T.parse_phones(T.clean(F.col("x")))) == want


def test_find_price(spark):
    get = lambda t: one(spark, t, T.find_price(T.clean(F.col("x"))))
    assert tuple(get("Vraagprijs: EUR 27.500; tel 8543210")) == (27500.0, "EUR", False)
    assert get("kavel 9123456 eur") is None
    assert get("nu EUR 5.000 of EUR 15.000")["amount"] == 15000.0


@pytest.mark.parametrize(("text", "want"), [("Leiding 11", "leiding1"), ("Nickeriestraat", "nikeristrat"), ("Weytinghweg", "weytinghweg"), ("", "")])
def test_street_fold(spark, text, want):
    assert one(spark, text, T.street_fold(T.unaccented("x"))) == want


def test_extract_street(spark):
    get = lambda t: one(spark, t, T.extract_street(T.clean(F.col("x"))))
    assert tuple(get("Ruby-Sarahweg Welgedacht C")) == ("Ruby-Sarahweg", "Welgedacht C")
    assert tuple(get("Tout Lui Faut kanaalweg")) == ("kanaalweg", "")
    assert get("mooie plek")["street"] is None
    assert one(spark, "Weidepark 12, Centrum", T.normalise_street(F.col("x"))) == "Weidepark"


def test_small_functions(spark):
    assert one(spark, "https://www.a.example/x/?y=1", T.normal_url(F.col("x"))) == "a.example/x"
    assert one(spark, "Wanica, near Paramaribo", T.first_of(["Paramaribo", "Wanica"], F.col("x"))) == "Paramaribo"
    assert one(spark, 12.5, dedup.size_bucket(F.col("x")), "double") == 2
    assert one(spark, 0.0, dedup.size_bucket(F.col("x")), "double") is None
    km = geo.haversine_km(F.lit(5.8232), F.lit(-55.1679), F.lit(5.8611709), F.lit(-55.2971196))
    assert one(spark, "", km) == 14.904
    assert one(spark, "<p>a&amp;b m&sup2;</p>\xa0 x", T.clean_unicode("x")) == "a&b m² x"
    assert one(spark, ["https:https://a/1", "//b/2", "data:x", None, " https://a/1"], T.clean_image_urls(F.col("x")), "array<string>") == ["https://a/1", "https://b/2"]
    assert one(spark, None, geo.radius_m(F.col("x")), "double") == 1500 and one(spark, 1e9, geo.radius_m(F.col("x")), "double") == 6000
