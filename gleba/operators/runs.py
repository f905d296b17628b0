"""What a run adds to the run before: first and last seen, new, gone, changed prices; queues by address; counts; ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleba.functions import text as T


def last_wins(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key by order, by aggregation."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def first_wins(df: DataFrame, key: str, order: Column) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def merge_run(previous: DataFrame, fresh: DataFrame, run_date: str) -> DataFrame:
    """fresh with first_seen, last_seen, is_new, previous_price. Both: key, price, ...; previous: first_seen too, one row a key."""
    old = previous.select("key", F.col("first_seen").alias("__f"), F.col("price").alias("__p"))
    joined = fresh.drop("first_seen", "last_seen", "is_new", "previous_price").join(old, "key", "left")
    both = T.truthy(F.col("__p"), "number") & T.truthy(F.col("price"), "number")
    return joined.withColumns(
        {"first_seen": F.coalesce("__f", F.lit(run_date)), "last_seen": F.lit(run_date), "is_new": F.col("__f").isNull(), "previous_price": F.when(both & (F.col("__p") != F.col("price")), F.col("__p"))}
    ).drop("__f", "__p")


def gone(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    return previous.join(fresh.select("key"), "key", "left_anti").withColumn("still_listed", F.lit(False))


def deliveries(dates: DataFrame) -> DataFrame:
    """(run_date, n, next_date): the distinct dates of deliveries, numbered in order. A few rows, so one task numbers them."""
    w = Window.orderBy("run_date")
    return dates.select("run_date").where("run_date is not null").distinct().select("run_date", F.row_number().over(w).alias("n"), F.lead("run_date").over(w).alias("next_date"))


def merge_runs(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """rows of all deliveries (run_date, key, price; one a run and key) with what ``merge_run``, delivery after delivery, gives them: first_seen, last_seen, is_new, previous_price; and n, their delivery's number.

    An advert that misses a delivery is new when it comes back. A key has no more rows than there are deliveries.
    """
    w = Window.partitionBy("key").orderBy("n")
    out = rows.join(dates.select("run_date", "n"), "run_date")
    out = out.withColumn("is_new", ~F.coalesce(F.lag("n").over(w) == F.col("n") - 1, F.lit(False))).withColumn("__p", F.when(~F.col("is_new"), F.lag("price").over(w)))
    both = T.truthy(F.col("__p"), "number") & T.truthy(F.col("price"), "number")
    first = F.last(F.when(F.col("is_new"), F.col("run_date")), ignorenulls=True).over(w)
    return out.withColumns({"first_seen": first, "last_seen": F.col("run_date"), "previous_price": F.when(both & (F.col("__p") != F.col("price")), F.col("__p"))}).drop("__p")


def gone_runs(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """(run_date, key, still_listed): what each delivery but the first lacks of the one before."""
    w = Window.partitionBy("key").orderBy("n")
    back = F.coalesce(F.lead("n").over(w) == F.col("n") + 1, F.lit(False))
    out = rows.select("run_date", "key").join(dates, "run_date").withColumn("back", back).where("not back and next_date is not null")
    return out.select(F.col("next_date").alias("run_date"), "key", F.lit(False).alias("still_listed"))


def insert_absent(store: DataFrame, batch: DataFrame, key: str = "key", arrival: str = "arrival") -> DataFrame:
    """store with the rows of batch whose key it lacks (the first of each by the column arrival, which isn't kept)."""
    new = first_wins(batch, key, F.col(arrival)).drop(arrival)
    return store.unionByName(new.join(store.select(key), key, "left_anti"), allowMissingColumns=True)


def previous_values(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Adds previous: the value of the row before, of a key, by order."""
    return df.withColumn("previous", F.lag(value).over(Window.partitionBy(*key).orderBy(*order)))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    return df.orderBy(*order)
