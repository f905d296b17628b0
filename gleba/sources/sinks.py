"""Where results go: a run's snapshot as one JSON document or as tables, checked addresses, thumbnails' names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, overwritten as a whole."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def json_lines(df: DataFrame) -> DataFrame:
    """(value): each row as compact JSON with its nulls, letters beyond ASCII kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def snapshot_document(listings: DataFrame, archived: DataFrame, counts: DataFrame, order: str, archived_order: str, most_archived: int = 400) -> DataFrame:
    """(value): one JSON document {counts, listings, archived}, for readers that want a single file; the first most_archived of the archived. All of it passes
    through one task, so it is for a published list of bounded length; ``write_snapshot`` writes any number in parallel."""
    whole = {"ignoreNullFields": "false"}

    def listed(df: DataFrame, by: str, name: str) -> DataFrame:
        sorted_ = F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("__o"), F.struct(*df.columns).alias("x")))), lambda s: s["x"])
        return df.agg(F.to_json(sorted_, whole).alias("j")).select(F.lit(name).alias("part"), "j")

    parts = counts.select(F.lit("counts").alias("part"), F.to_json(F.struct(*counts.columns), whole).alias("j"))
    parts = parts.unionByName(listed(listings, order, "listings")).unionByName(listed(archived.orderBy(archived_order).limit(most_archived), archived_order, "archived"))
    piece = lambda name: F.concat(F.lit(f'"{name}":'), F.max(F.when(F.col("part") == name, F.col("j"))))
    return parts.agg(F.concat(F.lit("{"), piece("counts"), F.lit(","), piece("listings"), F.lit(","), piece("archived"), F.lit("}")).alias("value"))


def write_snapshot(listings: DataFrame, archived: DataFrame, counts: DataFrame, path: str) -> None:
    """listings, archived and counts as JSON lines under a folder, in parallel; one document for all would need one task."""
    for name, df in (("listings", listings), ("archived", archived), ("counts", counts)):
        json_lines(df).write.mode("overwrite").text(f"{path}/{name}")
