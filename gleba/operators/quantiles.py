"""Exact quantiles without a global sort in one task: counts by value, ranges of values, and the few values at the ranks asked for."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from gleba.session import checkpointed


def quantiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(stop, value): for each share the value at that part of the way through the ordered values, interpolated between neighbours; stops count from 0.

    Equal values are counted before anything is sorted. The ranges are written down, so their totals (a row a partition) hold for what follows. Null and NaN
    values don't count; no values give no rows.
    """
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("x")
    counts = df.select(x).where("x is not null").groupBy("x").agg(F.count("*").alias("n"))
    ranged = checkpointed(counts.repartitionByRange("x").withColumn("part", F.spark_partition_id()))
    parts, offsets, total = sorted(ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()), {}, 0
    for p, n in parts:
        offsets[p], total = total, total + n
    spark = df.sparkSession
    if not total:
        return spark.createDataFrame([], "stop int, value double")
    at = [s * (total - 1) for s in shares]
    ranks = sorted({r for a in at for r in (math.floor(a), math.ceil(a))})
    before = spark.createDataFrame(list(offsets.items()), "part int, before long")
    up_to = F.sum("n").over(Window.partitionBy("part").orderBy("x")) + F.col("before")
    hit = ranged.join(F.broadcast(before), "part").withColumn("up_to", up_to)  # a row a partition is broadcast
    hit = hit.select("x", F.explode(F.filter(F.array(*map(F.lit, ranks)), lambda r: (r >= F.col("up_to") - F.col("n")) & (r < F.col("up_to")))).alias("r"))
    found = {r.r: r.x for r in hit.collect()}  # two values a share at most
    between = lambda a: found[math.floor(a)] + (found[math.ceil(a)] - found[math.floor(a)]) * (a - math.floor(a))
    return spark.createDataFrame([(i, between(a)) for i, a in enumerate(at)], "stop int, value double")
