"""Matching records of two tables without a shared key: heuristic votes on candidates, weighed by a generative label model.

Both tables are read into comparable attributes: the register street (``streets.with_street``), EUR and m² (``operators.units``), resort and district.
Candidates never come from a cross join. Two records are candidates if they mean a street of the same name and fall into the same or neighbouring steps of
a 1 % scale of sizes and of a 3 % scale of prices, as far as both have them (one of the two at least). p3_found loses nothing by asking for both steps, as
its exact check asks for both; for noisier matches ``either`` makes one of the two steps enough. The candidates are written down once. Each gets five votes (for, against, or
none): street, resort, size, price, price per m². Only the counts of the vote patterns (at most 243) go to the driver. There the label model learns the
votes' accuracies by EM, finds votes that depend on each other within a class, models those jointly, and gives each pattern a posterior confidence.

The rows of p3_found pass an exact check after that: the same register street, sizes within 1 % and prices within 3 % of the larger, each where both
sides have a real value, and at least one of the two compared.

A street that holds a third of all rows is split by its size or price steps; AQE splits what remains. Defined results: rows without a street, or of
none of the register's, match nothing; filler amounts count as missing; every capture counts; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from gleba.llm.latent import label_model
from gleba.llm.streets import with_street
from gleba.operators.units import readings
from gleba.session import checkpointed

SIZE_STEP, PRICE_STEP = -math.log(0.99), -math.log(0.97)
VOTES = ["v_street", "v_place", "v_size", "v_price", "v_rate"]
FOR, AGAINST, NONE = 0, 1, 2
#: Believed shares of votes (for, against, none) among non-matches and among matches: what a vote function is written to say.
BELIEF = [[[0.4, 0.4, 0.2], [0.8, 0.02, 0.18]], [[0.5, 0.3, 0.2], [0.8, 0.02, 0.18]], [[0.3, 0.5, 0.2], [0.78, 0.02, 0.2]], [[0.2, 0.6, 0.2], [0.78, 0.02, 0.2]], [[0.2, 0.6, 0.2], [0.68, 0.02, 0.3]]]


def attributes(df: DataFrame, streets: DataFrame, rates: dict, row_id: str) -> DataFrame:
    """row_id, street_id, sound (the name's key), place (resort as register id of the street), eur, m2."""
    for c, kind in (("price_text", "string"), ("size_text", "string")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    read = readings(df.where(f"{row_id} is not null").select(row_id, "street", "resort", "district", "price", "currency", "price_text", "size_m2", "size_text"), rates)
    # filtered behind the look-up: before it, Catalyst would copy every pattern of the readings into the filter
    found = with_street(read, streets, [row_id, "price_eur", "area_m2"]).where("street_id >= 0 and (price_eur is not null or area_m2 is not null)")
    return found.select(row_id, F.col("price_eur").alias("eur"), F.col("area_m2").alias("m2"), "street_id", "cost")


def step(value: Column, width: float) -> Column:
    return F.floor(F.log(value) / width)


def _near(a: str, b: str, share: float) -> Column:
    return F.abs(F.col(a) - F.col(b)) <= share * F.greatest(F.col(a), F.col(b)) + 1e-9


def _vote(a: str, b: str, share: float) -> Column:
    return F.when(F.col(a).isNull() | F.col(b).isNull(), NONE).when(_near(a, b, share), FOR).otherwise(AGAINST)


def candidates(a: DataFrame, b: DataFrame, names: DataFrame, either: bool = False) -> DataFrame:
    """Pairs with their votes. a and b: attributes with ids a_id and b_id; names: (street_id, name_id, place_id) of the register. either: one shared step will do."""
    a = a.join(names, "street_id").select("a_id", F.col("street_id").alias("sa"), "name_id", F.col("place_id").alias("pa"), F.col("eur").alias("ea"), F.col("m2").alias("ma"), F.col("cost").alias("ca"))
    b = b.join(names, "street_id").select("b_id", F.col("street_id").alias("sb"), "name_id", F.col("place_id").alias("pb"), F.col("eur").alias("eb"), F.col("m2").alias("mb"), F.col("cost").alias("cb"))
    at, around = lambda c, w: step(F.col(c), w), lambda c, w: F.array(*[step(F.col(c), w) + F.lit(i).cast("long") for i in (-1, 0, 1)])
    a = a.withColumns({"ks": at("ma", SIZE_STEP), "kp": at("ea", PRICE_STEP)})
    b = b.withColumns({"ns": around("mb", SIZE_STEP), "np": around("eb", PRICE_STEP)})
    sized, priced = lambda d, m: d.where(f"{m} is not null"), lambda d, e: d.where(f"{e} is not null")
    lacks = lambda d, c: d.where(f"{c} is null")
    by_s, by_p = lambda d: d.withColumn("ks", F.explode("ns")), lambda d: d.withColumn("kp", F.explode("np"))
    keys_s, keys_p = ["name_id", "ks"], ["name_id", "kp"]
    full_a, full_b = priced(sized(a, "ma"), "ea"), priced(sized(b, "mb"), "eb")
    cut = lambda d: d.drop("ks", "kp", "ns", "np")
    # what both sides have decides which steps they must share; each pair comes up in one of the five joins only
    both_full = cut(full_a.join(by_p(by_s(full_b)), ["name_id", "ks", "kp"]))
    if either:  # the same size step, or the same price step and no size step
        by_price = full_a.withColumnRenamed("ks", "own").join(by_p(full_b), keys_p).where(~F.array_contains("ns", F.col("own"))).drop("own")
        both_full = cut(full_a.join(by_s(full_b), keys_s)).unionByName(cut(by_price))
    pairs = (
        both_full
        .unionByName(cut(lacks(sized(a, "ma"), "ea").join(by_s(sized(b, "mb")), keys_s)))
        .unionByName(cut(full_a.join(by_s(lacks(sized(b, "mb"), "eb")), keys_s)))
        .unionByName(cut(lacks(priced(a, "ea"), "ma").join(by_p(priced(b, "eb")), keys_p)))
        .unionByName(cut(full_a.join(by_p(lacks(priced(b, "eb"), "mb")), keys_p)))
    )
    pairs = pairs.withColumns({"ra": F.col("ea") / F.col("ma"), "rb": F.col("eb") / F.col("mb")})
    return pairs.select(
        "a_id", "b_id", "sa", "sb", "ea", "eb", "ma", "mb",
        F.when(F.col("sa") == F.col("sb"), F.when((F.col("ca") <= 0.35) & (F.col("cb") <= 0.35), FOR).otherwise(NONE)).otherwise(AGAINST).alias("v_street"),
        F.when(F.col("pa").isNull() | F.col("pb").isNull(), NONE).when(F.col("pa") == F.col("pb"), FOR).otherwise(AGAINST).alias("v_place"),
        _vote("ma", "mb", 0.01).alias("v_size"), _vote("ea", "eb", 0.03).alias("v_price"), _vote("ra", "rb", 0.04).alias("v_rate"),
    )


def matched(a: DataFrame, b: DataFrame, streets: DataFrame, rates: dict, a_key: str, b_key: str, threshold: float = 0.5, either: bool = False) -> DataFrame:
    """(a_key, b_key, confidence, sa, sb, ea, eb, ma, mb): candidates whose posterior is at least threshold."""
    names = streets.where("street_id is not null and name is not null").select(
        F.col("street_id").cast("long").alias("street_id"), F.xxhash64(F.lower("name")).alias("name_id"), F.when(F.col("ressort").isNotNull(), F.xxhash64("ressort", "district")).alias("place_id")
    )
    left = checkpointed(attributes(a, streets, rates, a_key).withColumnRenamed(a_key, "a_id"))
    right = checkpointed(attributes(b, streets, rates, b_key).withColumnRenamed(b_key, "b_id"))
    pairs = checkpointed(candidates(left, right, names, either))
    got = pairs.groupBy(*VOTES).agg(F.count("*").alias("n")).collect()  # at most 3 ** 5 rows
    patterns, counts = np.array([[r[v] for v in VOTES] for r in got], dtype=int).reshape(len(got), len(VOTES)), np.array([r.n for r in got], dtype=float)
    # first guess: more votes for than against, none of them against in street or size
    start = np.array([0.9 if AGAINST not in p and FOR in p[2:] else 0.05 for p in patterns.tolist()])
    model = label_model(patterns, counts, [3] * len(VOTES), start, belief=BELIEF)
    scored = [(*map(int, p), float(x)) for p, x in zip(patterns, model.posterior(patterns))]
    table = a.sparkSession.createDataFrame(scored, ", ".join(f"{v} int" for v in VOTES) + ", confidence double")
    return pairs.join(F.broadcast(table), VOTES).where(F.col("confidence") >= threshold).drop(*VOTES).withColumnsRenamed({"a_id": a_key, "b_id": b_key})


def same_plots(feed: DataFrame, listings: DataFrame, streets: DataFrame, rates: dict) -> DataFrame:
    """(record_id, listing_id, confidence) that pass the exact check."""
    pairs = matched(feed, listings, streets, rates, "record_id", "listing_id")
    ok = lambda a, b, share: F.coalesce(_near(a, b, share), F.lit(True))
    compared = (F.col("ma").isNotNull() & F.col("mb").isNotNull()) | (F.col("ea").isNotNull() & F.col("eb").isNotNull())
    return pairs.where((F.col("sa") == F.col("sb")) & ok("ma", "mb", 0.01) & ok("ea", "eb", 0.03) & compared).select("record_id", "listing_id", "confidence")


def planted(listings: DataFrame, streets: DataFrame, rates: dict, threshold: float = 0.5) -> DataFrame:
    """(method, pairs, right, true_pairs): pairs found of two noisy descriptions of one made-up plot a listing, by the label model and without it.

    A plot has a register street, one of forty sizes and a price that follows the size. The first description is exact. The second may lack its places, misspell
    its street, and lack, round or miss its size and its price. Ways of finding pairs: every candidate; the exact check of p3_found; the label model's posterior.
    """
    chance = lambda *c: F.pmod(F.xxhash64(*c), F.lit(10_000)) / 10_000.0
    n = streets.where("street_id is not null and name is not null").select("name", "ressort", "district", F.row_number().over(Window.orderBy("street_id")).alias("k"))
    of = F.lit(max(1, n.count()))
    plots = listings.where("listing_id is not null").select(F.col("listing_id").alias("id")).distinct().withColumn("k", F.pmod(F.xxhash64("id", F.lit("street")), of) + 1).join(n, "k")
    plots = plots.withColumn("m2", F.round(150 * F.pow(F.lit(1.1), F.floor(40 * chance("id", F.lit("size"))))))
    plots = plots.withColumn("eur", F.round(F.col("m2") * (20 + 25 * chance("id", F.lit("price"))), -2))
    none = F.lit(None).cast("string")
    shape = lambda street, place, size, price, key: plots.select(F.col("id").alias(key), street.alias("street"), F.when(place, F.col("ressort")).alias("resort"), F.when(place, F.col("district")).alias("district"), size.alias("size_m2"), none.alias("size_text"), price.alias("price"), F.lit("EUR").alias("currency"), none.alias("price_text"))
    dice = lambda name: chance("id", F.lit(name))
    slip = F.floor(F.length("name") * dice("slip")).cast("int")
    street = F.when(dice("misspelt") < 0.25, F.concat(F.col("name").substr(F.lit(1), slip), F.col("name").substr(slip + 2, F.lit(100)))).otherwise(F.col("name"))
    size = F.when(dice("s") < 0.1, None).when(dice("s") < 0.25, F.col("m2") * (1.01 + 0.1 * dice("s2"))).otherwise(F.col("m2") * (1 + 0.008 * dice("s2")))
    price = F.when(dice("p") < 0.1, None).when(dice("p") < 0.35, F.col("eur") * (1.03 + 0.15 * dice("p2"))).otherwise(F.col("eur") * (1 + 0.02 * dice("p2")))
    a, b = shape(F.col("name"), F.lit(True), F.col("m2"), F.col("eur"), "a"), shape(street, dice("places") > 0.3, size, price, "b")
    got = checkpointed(matched(a, b, streets, rates, "a", "b", -1.0, either=True))
    ok = lambda x, y, share: F.coalesce(_near(x, y, share), F.lit(True))
    ways = {"every candidate": F.lit(True), "exact check": (F.col("sa") == F.col("sb")) & ok("ma", "mb", 0.01) & ok("ea", "eb", 0.03), "label model": F.col("confidence") >= threshold}
    counts = got.agg(*[x for i, way in enumerate(ways.values()) for x in (F.count_if(way).alias(f"pairs{i}"), F.count_if(way & (F.col("a") == F.col("b"))).alias(f"right{i}"))])
    rows = F.array(*[F.struct(F.lit(name).alias("method"), F.col(f"pairs{i}").alias("pairs"), F.col(f"right{i}").alias("right")) for i, name in enumerate(ways)])
    return counts.select(F.inline(rows)).withColumn("true_pairs", F.lit(plots.count()))
