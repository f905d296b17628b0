"""The feed as a stream: captures without repeats, windowed counts, and the state of each advert across captures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleba.operators.units import item_number

STATE = "first_seen timestamp, last_seen timestamp, price double, priced timestamp, changes long"
OUT = "source_id string, first_seen timestamp, last_seen timestamp, price double, previous_price double, changes long"


def captures(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    """Captures as they arrive as parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("source_id", item_number(F.col("url")))


def distinct_captures(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Each capture (advert and time) once; rows later than the watermark are let go, and their state with them."""
    return stream.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["source_id", "seen_at"])


def windowed_counts(stream: DataFrame, window: str = "7 days", late: str = "30 days") -> DataFrame:
    """Captures and adverts (approximately) a window of event time."""
    w = stream.withWatermark("seen_at", late).groupBy(F.window("seen_at", window).alias("w"))
    return w.agg(F.count("*").alias("captures"), F.approx_count_distinct("source_id").alias("adverts")).select(F.col("w.start").alias("window_start"), "captures", "adverts")


def price_states(stream: DataFrame, late: str = "30 days", idle: str = "365 days") -> DataFrame:
    """Per advert: first and last seen, its price, the price before the last change, and the number of changes, kept as state.

    Captures are taken in order of their time; one that is older than the newest price known counts as seen, but its price is no news. The state of an advert
    that the watermark is ``idle`` past is dropped; if it comes back it is new.
    """
    keep = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, last, price, priced, changes = state.get if state.exists else (None, None, None, None, 0)
        previous, rows = None, pd.concat(list(batches)).sort_values("seen_at", kind="stable")
        for seen, p in zip(rows["seen_at"], rows["price"]):
            first, last = seen if first is None else min(first, seen), seen if last is None else max(last, seen)
            if p == p and p is not None and (priced is None or seen >= priced):
                if price is not None and p != price:
                    previous, changes = price, changes + 1
                price, priced = float(p), seen
        state.update((first, last, price, priced, changes))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + keep)
        yield pd.DataFrame([(key[0], first, last, price, previous, changes)], columns=["source_id", "first_seen", "last_seen", "price", "previous_price", "changes"])

    rows = stream.where("source_id is not null and seen_at is not null").select("source_id", "seen_at", "price").withWatermark("seen_at", late)
    return rows.groupBy("source_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
