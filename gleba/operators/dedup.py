"""Duplicate adverts within and across sources, in a defined order, without ever holding a group in one task.

The greedy rule visits adverts by quality (then arrival). Each has up to four fingerprints in a fixed order; the first of them that a kept advert has
already claimed is its hit. It is merged into the hit if that is of another source or if the fingerprint is its own first one, dropped if the hit has the
same url, and else kept, claiming those of its fingerprints that are free. ``greedy`` decides this in rounds: an advert is decided as soon as what stands
before it under its fingerprints is decided. Each round is a few aggregations and joins over what is still open; the number of rounds is the longest chain of adverts that wait for
each other, not the size of a group. The result is the sequential one.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleba.functions import text as T
from gleba.session import checkpointed

FIELDS = {"size_m2": "number", "price": "number", "currency": "string", "district": "string", "resort": "string", "street": "string", "title_type": "string", "description": "string", "lat": "number", "lon": "number", "geocode_quality": "string", "posted": "string"}


def quality(df: DataFrame) -> Column:
    """0 to 12: how complete an advert is."""
    parts = (("size_m2", "number", 3), ("price", "number", 3), ("images", "array", 2), ("description", "string", 2), ("district", "string", 1), ("phones", "array", 1))
    return sum((F.when(T.truthy(F.col(c), kind), n).otherwise(0) for c, kind, n in parts if c in df.columns), F.lit(0))


def size_bucket(size: Column) -> Column:
    return F.when(T.truthy(size, "number"), F.bround(size / 5, 0).cast("long"))


def price_bucket(price: Column, currency: Column) -> Column:
    eur = T.price_eur(price, currency)
    return F.when(T.truthy(eur, "number"), F.bround(eur / 500, 0).cast("long"))


def fingerprints(key: Column, size: Column, price: Column, lat: Column | None = None, lon: Column | None = None) -> Column:
    """The fingerprints of an advert in order; only those whose parts exist. key: its slugged street key, size and price: its buckets."""
    k = F.nullif(key, F.lit(""))
    parts = [F.concat(F.lit("a|"), k, F.lit("|"), size, F.lit("|"), price), F.concat(F.lit("b|"), k, F.lit("|"), size)]
    if lat is not None:
        place = T.truthy(lat, "number") & T.truthy(lon, "number")
        parts.append(F.when(place, F.concat(F.lit("c|"), F.bround(lat, 4).cast("string"), F.lit("|"), F.bround(lon, 4).cast("string"), F.lit("|"), size)))
    parts.append(F.concat(F.lit("d|"), k, F.lit("|"), price))
    return F.array_compact(F.array(*parts))


def fold_first(df: DataFrame, key: str, order: Column, fields: dict[str, str], also: list[Column] | None = None) -> DataFrame:
    """One row a key: each field's first present value by order. Partial aggregation only."""
    aggs = [F.min_by(F.col(c), F.when(T.truthy(F.col(c), kind), order)).alias(c) for c, kind in fields.items() if c in df.columns]
    return df.groupBy(key).agg(*aggs, *(also or []))


def ordered_union(df: DataFrame, key: str, order: str, array: str, most: int) -> DataFrame:
    """(key, array): the distinct elements of the arrays of a key by first appearance, at most so many."""
    items = df.select(key, order, F.posexplode(array).alias("pos", "x")).where("x is not null")
    first = items.groupBy(key, "x").agg(F.min(F.struct(order, "pos")).alias("at"))
    top = first.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("n") <= most)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]).alias(array))


def greedy(items: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(id, ord, fate, into) from items (id, ord unique and increasing, source, url, fps). fate: kept, merged or dropped; into: the id merged into.

    Goes on until every advert is decided: the first open one by ord waits for none, so each round decides one at least. With most_rounds it raises an error
    if more are needed. A round reads and writes what is still open and the owners of the fingerprints that this waits for; what is decided is written once.
    """
    id_type = items.schema["id"].dataType
    base = checkpointed(items.select("id", "ord", "source", "url", "fps"))
    fps = base.select("id", "ord", "source", "url", F.posexplode("fps").alias("k", "fp"))
    # a fingerprint that nobody shares decides nothing, but for being somebody's first
    shared = fps.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    waiting = checkpointed(fps.join(shared, "fp", "left_semi"))
    decided = [base.join(waiting.select("id").distinct(), "id", "left_anti").select("id", "ord", F.lit("kept").alias("fate"), F.lit(None).cast(id_type).alias("into"))]
    owner = None
    for done in itertools.count():
        if waiting.isEmpty():
            break
        if done == most_rounds:
            raise RuntimeError(f"adverts are undecided after {most_rounds} rounds")
        first = waiting.groupBy("fp").agg(F.min("ord").alias("u"))
        seen = waiting.join(first, "fp")
        seen = seen.join(owner, "fp", "left") if owner is not None else seen.withColumn("o", F.lit(None).cast(seen.select(F.struct("ord", "id", "source", "url")).schema[0].dataType))
        claimed = F.coalesce(F.col("o.ord") < F.col("ord"), F.lit(False))
        before = F.col("u") < F.col("ord")
        state = F.when(claimed & (~before | (F.col("u") > F.col("o.ord"))), "claimed").when(~claimed & ~before, "free").otherwise("open")
        # the first fingerprint that isn't known to be free decides, or makes the advert wait
        told = F.min(F.when(state != "free", F.struct("k", state.alias("s"), "o"))).alias("m")
        ready = seen.groupBy("id", "ord", "source", "url").agg(told).where("m is null or m.s = 'claimed'")
        other, same_url = ~F.col("source").eqNullSafe(F.col("m.o.source")), F.col("url").eqNullSafe(F.col("m.o.url"))
        fate = F.when(F.col("m").isNull(), "kept").when(other, "merged").when(same_url, "dropped").when(F.col("m.k") == 0, "merged").otherwise("kept")
        now = checkpointed(ready.select("id", "ord", fate.alias("fate"), F.when(fate == "merged", F.col("m.o.id")).alias("into")))
        decided.append(now)
        left = checkpointed(waiting.join(now.select("id"), "id", "left_anti"))
        new = waiting.join(now.where("fate = 'kept'").select("id"), "id", "left_semi").select("fp", F.struct("ord", "id", "source", "url").alias("o"))
        owner = (new if owner is None else owner.unionByName(new)).join(left.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("o").alias("o"))
        waiting, owner = left, checkpointed(owner)
        if len(decided) == 32:  # a chain of many rounds must not become a plan of as many parts
            decided = [checkpointed(functools.reduce(DataFrame.unionByName, decided))]
    return functools.reduce(DataFrame.unionByName, decided)


def with_order(df: DataFrame, arrival: str, score: Column) -> DataFrame:
    """Adds ord: a number that sorts by score, highest first, then by arrival (a unique long)."""
    return df.withColumn("ord", (F.lit(99) - score).cast("decimal(20,0)") * F.lit(10**18).cast("decimal(20,0)") + F.col(arrival).cast("decimal(20,0)"))


def listing_key(df: DataFrame) -> DataFrame:
    """Adds key, the slugged street key."""
    return df.withColumn("key", F.substring(T.slug(T.unaccented(T.street_key(F.col("street"), F.col("title"), F.col("resort")))), 1, 60))


def _grouped(df: DataFrame, arrival: str) -> DataFrame:
    """The adverts that are kept or merged, with head (the kept one) and merged."""
    rows = with_order(listing_key(df), arrival, quality(df))
    has = "lat" in df.columns
    fps = fingerprints(F.col("key"), size_bucket(F.col("size_m2")), price_bucket(F.col("price"), F.col("currency")), F.col("lat") if has else None, F.col("lon") if has else None)
    rows = checkpointed(rows.withColumn("fps", fps).withColumn("id", F.col(arrival)))
    fate = greedy(rows)
    return rows.join(fate.where("fate <> 'dropped'").select("id", F.coalesce("into", "id").alias("head"), (F.col("fate") == "merged").alias("merged")), "id")


def also_listed(df: DataFrame, arrival: str) -> DataFrame:
    """(head, source, url, agent, price, currency): where else each kept advert is listed, each address once, the first of it; a table, so that no advert's list is held in one row."""
    group = _grouped(df, arrival)
    own = group.where("not merged").select("head", F.col("url").alias("own"))
    else_ = group.where("merged").join(own, "head").where(~F.col("url").eqNullSafe(F.col("own")))
    return else_.groupBy("head", "url").agg(F.min(F.struct("ord", "source", "agent", "price", "currency")).alias("x")).select("head", "x.source", "url", "x.agent", "x.price", "x.currency")


def deduplicated(df: DataFrame, arrival: str) -> DataFrame:
    """The kept adverts with what merged ones add: first present value of each field, ordered images and phones. df: one row a source_id. ``also_listed`` says where else they stand."""
    group = _grouped(df, arrival)
    folded = fold_first(group, "head", F.col("ord"), FIELDS, [F.count_if("merged").alias("merged_in"), *[F.min_by(c, "ord").alias(c) for c in ("source", "url", "source_id") if c in df.columns]])
    for c, n in (("images", 10), ("phones", 6)):
        if c in df.columns:
            folded = folded.join(ordered_union(group, "head", "ord", c, n), "head", "left")
    return folded.withColumnRenamed("head", arrival)
