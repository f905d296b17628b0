"""Which address records denote the same location: street-sound blocks, compared components, linkage weights by expectation-maximisation.

Each record is read into components: the sound key of its street (as the register spells it, where it has the street), the house number and letter, the
resort and the district. Records block on sound key and house number. Within a block only *classes* of equal components are compared, so copies cost
nothing; every comparison gives a pattern of agreement levels, in which a missing component is a level of its own. The weights of the levels are fitted
by EM on the counts of the patterns (at most 54 rows), and class pairs above ``threshold`` are matches. An exact check follows: both mean the same street
of the register and the same number and letter. Last the classes are expanded into pairs of records, spread by a salt in proportion to a class's size.

Defined results: records without a street, without a house number or of no register street have no pairs; a missing letter equals only a missing letter;
repeated rows are pairs like any other; an id that occurs twice isn't paired with itself; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from gleba.llm.latent import TwoClasses
from gleba.llm.streets import with_street
from gleba.session import checkpointed

COMPONENTS = ["sound", "number", "letter", "resort", "district", "street_id", "exact"]
#: Levels of the comparisons: street written alike or not; letter same, other, missing on one side; resort and district same, other, missing.
LEVELS = [2, 3, 3, 3]
#: Believed shares of the levels among non-matches and among matches of a block.
BELIEF = [[[0.5, 0.5], [0.6, 0.4]], [[0.3, 0.4, 0.3], [0.97, 0.015, 0.015]], [[0.3, 0.4, 0.3], [0.68, 0.02, 0.3]], [[0.3, 0.4, 0.3], [0.68, 0.02, 0.3]]]


def components(df: DataFrame, streets: DataFrame, row_id: str, most: int = 100_000) -> DataFrame:
    """row_id + COMPONENTS. number is empty where the address has none, street_id -1 where the register lacks the street. most: as in ``with_street``."""
    found = with_street(df.where(f"{row_id} is not null").select(row_id, "street", "resort", "district"), streets, [row_id], most=most, read=True)
    return found.where("street_id is not null").select(row_id, "sound", F.col("house_number").alias("number"), F.col("house_letter").alias("letter"), F.col("resort_read").alias("resort"), F.col("district_read").alias("district"), "street_id", (F.col("cost") <= 0.35).alias("exact"))


def _level(a: str, b: str) -> F.Column:
    return F.when((F.col(a) == "") & (F.col(b) == ""), 2).when((F.col(a) == "") | (F.col(b) == ""), 2).when(F.col(a) == F.col(b), 0).otherwise(1)


def class_pairs(classes: DataFrame) -> DataFrame:
    """Pairs of classes of one block (a class with itself too), with their pattern and the number of record pairs behind them."""
    a = classes.select(*[F.col(c).alias(f"{c}_a") for c in classes.columns])
    b = classes.select(*[F.col(c).alias(f"{c}_b") for c in classes.columns])
    pairs = a.join(b, (F.col("sound_a") == F.col("sound_b")) & (F.col("number_a") == F.col("number_b")) & (F.col("cls_a") <= F.col("cls_b")))
    n = F.when(F.col("cls_a") == F.col("cls_b"), F.expr("n_a * (n_a - 1) / 2")).otherwise(F.expr("n_a * n_b")).cast("double")
    letter = F.when(F.col("letter_a") == F.col("letter_b"), 0).when((F.col("letter_a") == "") | (F.col("letter_b") == ""), 2).otherwise(1)
    return pairs.select(
        "cls_a", "cls_b", "n_a", "n_b", n.alias("pairs"), "street_id_a", "street_id_b", "letter_a", "letter_b",
        F.when(F.col("exact_a") & F.col("exact_b"), 0).otherwise(1).alias("l0"), letter.alias("l1"), _level("resort_a", "resort_b").alias("l2"), _level("district_a", "district_b").alias("l3"),
    ).where("pairs > 0")


def link_weights(pairs: DataFrame) -> tuple[TwoClasses, np.ndarray, np.ndarray]:
    """The model fitted to the counts of the patterns."""
    got = pairs.groupBy("l0", "l1", "l2", "l3").agg(F.sum("pairs").alias("n")).collect()  # at most 54 rows
    patterns = np.array([[r.l0, r.l1, r.l2, r.l3] for r in got], dtype=int).reshape(len(got), 4)
    counts = np.array([r.n for r in got], dtype=float)
    # a first guess: agreement speaks for a match, disagreement in the letter or in a place against one
    start = np.where((patterns[:, 1] == 0) & (patterns[:, 2] != 1) & (patterns[:, 3] != 1), 0.9, 0.05) if len(got) else np.zeros(0)
    return TwoClasses(LEVELS, belief=BELIEF).fit(patterns, counts, start), patterns, counts


def linked(df: DataFrame, streets: DataFrame, row_id: str, most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(members, class pairs): (id, cls) of each record that can be linked; the pairs of classes of a block with their probability."""
    records = checkpointed(components(df, streets, row_id, most).where("number <> '' and street_id >= 0"))
    classes = checkpointed(records.groupBy(*COMPONENTS).agg(F.count("*").alias("n")).withColumn("cls", F.xxhash64(*COMPONENTS)))
    pairs = checkpointed(class_pairs(classes))
    model, patterns, _ = link_weights(pairs)
    scored = [(*map(int, p), float(x)) for p, x in zip(patterns, model.posterior(patterns))]
    table = df.sparkSession.createDataFrame(scored, "l0 int, l1 int, l2 int, l3 int, probability double")
    return records.select(F.col(row_id).alias("id"), F.xxhash64(*COMPONENTS).alias("cls")), pairs.join(F.broadcast(table), ["l0", "l1", "l2", "l3"])  # at most 54 rows are broadcast


def expanded(members: DataFrame, pairs: DataFrame, spread: int = 1000) -> DataFrame:
    """(a, b, probability), a < b: the pairs of records behind pairs of classes; a class of many records is spread over tasks by a salt."""
    pairs = pairs.select("cls_a", "cls_b", "probability", F.ceil(F.col("n_a") / spread).cast("int").alias("parts"))
    left = pairs.join(members.select(F.col("id").alias("a"), F.col("cls").alias("cls_a")), "cls_a").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("parts")))
    right = members.select(F.col("id").alias("b"), F.col("cls").alias("cls_b"))
    right = right.join(pairs.groupBy("cls_b").agg(F.max("parts").alias("most")), "cls_b").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most").cast("long") - 1))).drop("most")
    both = left.join(right, ["cls_b", "salt"]).where("a <> b and (cls_a <> cls_b or a < b)")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "probability").distinct()


def same_addresses(df: DataFrame, streets: DataFrame, row_id: str = "check_id", threshold: float = 0.5, spread: int = 1000, most: int = 100_000) -> DataFrame:
    """(row_id_a, row_id_b, probability), a < b."""
    members, pairs = linked(df, streets, row_id, most)
    exact = pairs.where((F.col("probability") >= threshold) & F.expr("street_id_a = street_id_b and letter_a = letter_b"))
    return expanded(members, exact, spread).withColumnsRenamed({"a": f"{row_id}_a", "b": f"{row_id}_b"})


def planted(df: DataFrame, streets: DataFrame, row_id: str = "check_id", threshold: float = 0.5) -> DataFrame:
    """(method, pairs, right, true_pairs): pairs found of made-up records of known addresses, one a row of df, about three an address, by the weights and without.

    A record may misspell its street, and lack or confuse its resort, its district and its letter. Ways of finding pairs: the whole block; the exact check of
    p6_found; the weights fitted by EM; the exact check behind the weights.
    """
    ids = df.where(f"{row_id} is not null").select(F.col(row_id).alias("id")).distinct()
    n = ids.count()
    register = streets.where("street_id is not null and trim(name) <> ''").select("name", "ressort", "district", F.row_number().over(Window.orderBy("street_id")).alias("k"))
    of = F.lit(max(1, register.count()))
    chance = lambda *c: F.pmod(F.xxhash64(*c), F.lit(10_000)) / 10_000.0
    dice = lambda name: chance("id", F.lit(name))
    rows = ids.withColumn("at", F.pmod(F.xxhash64("id", F.lit("address")), F.lit(max(1, n // 3))))
    rows = rows.withColumns({"k": F.pmod(F.xxhash64("at", F.lit("street")), of) + 1, "number": 1 + F.pmod(F.xxhash64("at", F.lit("number")), F.lit(40)), "letter": F.when(chance("at", F.lit("letter")) < 0.3, F.element_at(F.array(*map(F.lit, "ab")), (1 + F.pmod("at", F.lit(2))).cast("int"))).otherwise("")}).join(register, "k")
    slip = F.floor(F.length("name") * dice("slip")).cast("int")
    name = F.when(dice("misspelt") < 0.25, F.concat(F.col("name").substr(F.lit(1), slip), F.col("name").substr(slip + 2, F.lit(100)))).otherwise(F.col("name"))
    letter = F.when(dice("letter") < 0.08, "").otherwise(F.col("letter"))
    made = checkpointed(rows.select("id", F.xxhash64("k", "number", "letter").alias("at"), F.concat(name, F.lit(" "), "number", letter).alias("street"), F.when(dice("resort") < 0.5, F.col("ressort")).alias("resort"), F.when(dice("district") < 0.6, F.col("district")).alias("district")))
    members, pairs = linked(made, streets, "id")
    pairs = pairs.where("probability is not null")
    at = made.select("id", "at")
    exact = F.expr("street_id_a = street_id_b and letter_a = letter_b")
    ways = {"whole block": F.lit(True), "exact check": exact, "weights": F.col("probability") >= threshold, "weights, then exact check": exact & (F.col("probability") >= threshold)}
    true = at.groupBy("at").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("n")).first().n
    out = None
    for method, way in ways.items():
        got = expanded(members, pairs.where(way)).join(at.select(F.col("id").alias("a"), F.col("at").alias("at_a")), "a").join(at.select(F.col("id").alias("b"), F.col("at").alias("at_b")), "b")
        one = got.agg(F.count("*").alias("pairs"), F.count_if(F.col("at_a") == F.col("at_b")).alias("right")).select(F.lit(method).alias("method"), "pairs", "right")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("true_pairs", F.lit(true))
