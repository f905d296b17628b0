import datetime as dt
import math

from gleba.operators import units as U
from pyspark.sql import functions as F

RATES = {("price", "EUR"): 1.0, ("price", "USD"): 0.92, ("price", "SRD"): 0.023, ("size", "m2"): 1.0, ("size", "ha"): 10_000.0, ("size", "are"): 100.0, ("size", "acre"): 4046.86, ("size", "sqft"): 0.092903}
SCHEMA = "record_id long, url string, price double, currency string, price_text string, size_m2 double, size_text string, seen_at timestamp, area_m2 string, price_eur string"


def rows(spark, *given):
    """record_id, price, currency, price_text, size_m2, size_text, item"""
    data = [(i, None if item is None else f"https://x.example/item/{item}", p, c, pt, s, st, dt.datetime(2025, 1, 1) + dt.timedelta(days=i), "clash", "clash") for i, (p, c, pt, s, st, item) in enumerate(given)]
    return spark.createDataFrame(data, SCHEMA)


def read(spark, *given):
    got = U.readings(rows(spark, *given), RATES).select("record_id", "price_eur", "price_plain", "area_m2", "area_plain").collect()
    return [(r.price_eur and round(r.price_eur, 2), r.price_plain, r.area_m2 and round(r.area_m2, 2), r.area_plain) for r in sorted(got)]


def test_price_readings(spark):
    cases = [
        (29250.0, "EUR", None, 29250.0, True), (29250.0, "€", "EUR 29.250", 29250.0, True), (None, None, "EUR 29.250,-", 29250.0, False), (None, None, "€31,000", 31000.0, False), (None, None, "18.950,00 euro", 18950.0, False),
        (19.5, None, "19,5 duizend euro", 19500.0, False), (None, "EUR", "€ 48K", 48000.0, False), (12800.0, None, "12.8k USD", 11776.0, False), (None, None, "srd 3.28 miljoen", 75440.0, False), (None, None, "Surinaamse dollar 520.000", 11960.0, False),
        (21.0, "EUR", "21 EUR/m²", 21000.0, False), (4.5, "EUR", "€ 4,5 p/m2", 4500.0, False), (1067.0, "EUR", "1.067 EUR/m²", 1_067_000.0, False), (5600.0, "US$", None, 5152.0, False), (110000.0, "EUR", "EUR 110 mille", 110000.0, True),
        (123456.0, "EUR", None, None, False), (0.0, "EUR", None, None, False), (99999999.0, "EUR", None, None, False), (123.0, "EUR", None, None, False), (None, None, "Prijs op aanvraag", None, False), (math.nan, None, "  ", None, False), (5000.0, None, None, None, False), (111.0, None, "111k euro", 111000.0, False),
    ]
    got = read(spark, *[(p, c, t, 1000.0, None, i) for i, (p, c, t, _, _) in enumerate(cases)])
    assert [g[:2] for g in got] == [c[3:] for c in cases]


def test_size_readings(spark):
    cases = [
        (837.25, "837,25 m²", 837.25, True), (3541.87, "3541.87 m2", 3541.87, True), (10452.0, "10.452 m²", 10452.0, True), (None, "7.734 m2", 7734.0, False), (0.1, "0,1 ha", 1000.0, False), (0.1, None, None, False), (0.265, "0,265ha", 2650.0, False), (None, "2.34 acres", 9469.65, False), (5.1, "5.1 ares", 510.0, False),
        (None, "13,250 sq ft", 1230.96, False), (None, "24 bij 265,2 meter", 6364.8, False), (None, "29m × 265.9m", 7711.1, False), (None, "12 m breed en 50,9 m diep", 610.8, False), (None, "ca 1124 vk. m", 1124.0, False), (None, "159 vierkante meter", 159.0, False), (99999999.0, None, None, False), (1.0, None, None, False), (None, "", None, False), (math.nan, None, None, False), (12000.0, "1,2 ha", 12000.0, True),
    ]
    got = read(spark, *[(None, None, None, s, t, i) for i, (s, t, _, _) in enumerate(cases)])
    assert [g[2:] for g in got] == [c[2:] for c in cases]


def test_viterbi_decodes_open_units(spark):
    price = [(p, c, None, None, None, 7) for p, c in [(19500.0, "EUR"), (19600.0, "EUR"), (19.6, "EUR"), (847_826.0, None), (19500.0, "EUR"), (123.0, "EUR"), (777.7, "EUR")]]
    size = [(None, None, None, s, None, 8) for s in [5000.0, 0.5, 50.2, 5010.0, 3.3]]
    alone = [(19.6, "EUR", None, None, None, 9), (None, None, None, 0.5, None, None)]
    got = {(r.record_id, r.field): r.common_amount for r in U.common_amounts(rows(spark, *price, *size, *alone), RATES).collect()}
    assert got == {(2, "price"): 19600, (3, "price"): 19500, (8, "size_m2"): 5000}  # 50.2 m² may be meant, and nothing explains the others


def test_blocks_of_a_long_chain_agree_with_one(spark):
    given = [(19500.0 + i, "EUR", None, None, None, 1) if i % 3 else (19.5, "EUR", None, None, None, 1) for i in range(60)]
    df = U.readings(rows(spark, *given).withColumn("d", F.lit("x")), RATES)
    one = {tuple(r) for r in U.decode(df, RATES, "d", "seen_at", "record_id").collect()}
    many = {tuple(r) for r in U.decode(df, RATES, "d", "seen_at", "record_id", chain=7).collect()}
    assert len(one) == 20 and {r[0] for r in one} == {r[0] for r in many} and all(abs(r[2] - 19500) < 1e-6 for r in one | many)


def test_empty_and_repeated(spark):
    assert U.common_amounts(rows(spark), RATES).count() == 0
    got = U.common_amounts(rows(spark, *[(None, None, "EUR 5 mille", None, None, 1)] * 2), RATES).collect()
    assert [r.common_amount for r in got] == [5000, 5000]


def test_planted_units_are_decoded(spark, sf):
    feed = spark.read.parquet(f"{sf}/feed_items.parquet")
    by = {r.kind: r for r in U.planted(feed, RATES).collect()}
    settled = [r for k, r in by.items() if k != "alone in its advert"]
    assert sum(r.planted for r in settled) > 20 and all(r.alone == 0 or r.kind == "USD" for r in settled)
    assert sum(r.right for r in settled) >= 0.7 * sum(r.planted for r in settled)


def test_small_numbers_are_open_and_stand_ins_on_request(spark):
    given = [(5000.0, "EUR", None, None, None, 1), (5.0, "EUR", None, None, None, 1), (111_000.0, "EUR", None, None, None, 2), (111.0, "EUR", None, None, None, 2), (22_000.0, "EUR", None, None, None, 3), (5.0, "EUR", None, None, None, 3)]
    assert {tuple(r) for r in U.common_amounts(rows(spark, *given), RATES).collect()} == {(1, "price", 5000)}
    df = U.readings(rows(spark, *given), RATES, stand_ins=True).withColumn("d", U.item_number(F.col("url")))
    got = {(r.record_id, round(r.value)) for r in U.decode(df, RATES, "d", "seen_at", "record_id").where("value is not null").collect()}
    assert got == {(1, 5000), (3, 111_000)}
