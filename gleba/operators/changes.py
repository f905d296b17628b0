"""What changed between full snapshots, by Merkle trees over hash ranges.

The keys of a snapshot are spread over ``fanout ** depth`` ranges of their hash, as many as the number of keys calls for. A leaf's digest is the count, the sum and the exclusive or of the hashes of
its rows, an inner node's digest combines its children's: both are commutative, so they are built by partial aggregation and no task sees a whole range.
Two consecutive snapshots are compared from the root down: a level looks only at children of nodes that differed. Rows are diffed only in leaves that differ.

Defined results: rows without a key or a date are no records; of several rows of a key in a snapshot the one loaded last counts (then the largest
by value, so that ties don't depend on order); the first snapshot has no changes; a null value equals a null value; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gleba.session import checkpointed


def latest(df: DataFrame, snapshot: Column, key: Column, value: Column, loaded: Column) -> DataFrame:
    """(snap, key, value): one row of each key in each snapshot. value must be orderable."""
    df = df.select(snapshot.alias("snap"), key.alias("key"), F.struct(loaded.alias("l"), value.alias("value")).alias("x")).where("snap is not null and key is not null")
    return df.groupBy("snap", "key").agg(F.max("x").alias("x")).select("snap", "key", "x.value")


def snapshot_changes(rows: DataFrame, fanout: int = 16, depth: int | None = None, leaf: int = 64, most: int = 10_000) -> DataFrame:
    """(snap, key, change_kind) from (snap, key, value), one row a key and snapshot; snap is the later of two consecutive snapshots.

    depth: levels below the root; by default as many as leave about ``leaf`` keys of the largest snapshot in a range. More than ``most`` snapshots are an error:
    their list goes to the driver and back.
    """
    # written down once: the digests, the comparison of each level and the final diff all read it, and each level's plan stays small
    rows = checkpointed(rows.select("snap", "key", F.xxhash64("key").alias("at"), F.xxhash64("key", "value").alias("h")))
    snaps = rows.groupBy("snap").agg(F.count("*").alias("n")).orderBy("snap").limit(most + 1).collect()
    if len(snaps) > most:
        raise ValueError(f"more than {most} snapshots")
    if depth is None:
        depth = next(d for d in range(1, 16) if leaf * fanout**d >= max((r.n for r in snaps), default=0) or fanout ** (d + 1) > 1 << 40)
    number = F.broadcast(rows.sparkSession.createDataFrame([(r.snap, i) for i, r in enumerate(snaps)], StructType([rows.schema["snap"], StructField("step", IntegerType())])))
    rows = rows.join(number, "snap").select("step", F.pmod("at", F.lit(fanout**depth)).alias("node"), "key", "h")
    # a snapshot is the new side of its own step and the old side of the next
    sides = F.filter(F.array(*[F.struct((F.col("step") + (1 - new)).alias("step"), F.lit(new).alias("new")) for new in (0, 1)]), lambda x: x["step"].between(1, len(snaps) - 1))
    both = lambda df, *keep: df.select(F.explode(sides).alias("x"), *keep).select("x.*", *keep)
    digest = [F.sum("n").alias("n"), F.sum("s").alias("s"), F.bit_xor("x").alias("x")]
    # decimal sums can't overflow, so any number of rows has a digest
    level = [checkpointed(rows.groupBy("step", "node").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s"), F.bit_xor("h").alias("x")))]
    for _ in range(depth):
        level.append(checkpointed(level[-1].groupBy("step", F.expr(f"node div {fanout}").alias("node")).agg(*digest)))
    differ = None  # (step, node) of the nodes that differ on the level above
    for nodes in reversed(level):
        pairs = both(nodes.withColumnRenamed("x", "xor"), "node", "n", "s", "xor")
        if differ is not None:
            pairs = pairs.withColumn("up", F.expr(f"node div {fanout}")).join(differ.withColumnRenamed("node", "up"), ["step", "up"], "left_semi").drop("up")
        differ = pairs.groupBy("step", "node").agg(F.count("*").alias("c"), *[f(k).alias(f"{a}_{k}") for k in ("n", "s", "xor") for a, f in (("lo", F.min), ("hi", F.max))])
        differ = checkpointed(differ.where("c = 1 or lo_n <> hi_n or lo_s <> hi_s or lo_xor <> hi_xor").select("step", "node"))
    diff = both(rows, "node", "key", "h").join(differ, ["step", "node"], "left_semi")
    diff = diff.groupBy("step", "key").agg(F.max(F.when(F.col("new") == 0, F.col("h"))).alias("a"), F.max(F.when(F.col("new") == 1, F.col("h"))).alias("b"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return diff.select("step", "key", kind.alias("change_kind")).where("change_kind is not null").join(number, "step").select("snap", "key", "change_kind")


def price_value(price: Column, currency: Column) -> Column:
    """What makes a price another one: its cents and its currency in any spelling; null where there is no amount."""
    from gleba.functions.amounts import currency_code, squeezed

    cents = F.round(F.nanvl(price, F.lit(None).cast("double")) * 100).cast("long")
    return F.when(cents.isNotNull(), F.concat_ws(" ", cents.cast("string"), F.coalesce(currency_code(currency), F.upper(squeezed(currency)), F.lit("-"))))
