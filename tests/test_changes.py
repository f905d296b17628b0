import random

import pytest

from gleba.operators.changes import latest, price_value, snapshot_changes
from pyspark.sql import functions as F


def brute(rows):
    snaps = sorted({s for s, _, _ in rows})
    by = {s: {k: v for t, k, v in rows if t == s} for s in snaps}
    out = set()
    for a, b in zip(snaps, snaps[1:]):
        for k in by[a].keys() | by[b].keys():
            if k not in by[a] or k not in by[b] or by[a][k] != by[b][k]:
                out.add((b, k, "added" if k not in by[a] else "removed" if k not in by[b] else "changed"))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(s, f"k{k}", rng.choice(["1", "2", None])) for s in ("2025-01-01", "2025-01-08", "2025-01-20") for k in range(300) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "snap string, key string, value string")
    for fanout, depth in ((16, 3), (2, 2), (4, 1), (16, None), (2, None)):
        assert {tuple(r) for r in snapshot_changes(df, fanout, depth).collect()} == brute(rows)


def test_edges(spark):
    schema = "d string, k string, price double, currency string, loaded int, snap string, value int"
    rows = [("a", "1", 10.0, "EUR", 1, "x", 1), ("a", "1", 11.0, "EUR", 2, "x", 1), ("b", "1", 11.0000001, "€", 1, "x", 1), ("b", "2", None, None, None, "x", 1), ("c", "2", None, " eur", 1, "x", 1), ("c", None, 1.0, "EUR", 1, "x", 1), (None, "3", 1.0, "EUR", 1, "x", 1), ("c", "1", 11.0, "USD", 1, "x", 1), ("c", "1", 11.0, "USD", 1, "x", 1)]
    df = spark.createDataFrame(rows, schema)
    one = lambda d: latest(d, F.col("d"), F.col("k"), price_value(F.col("price"), F.col("currency")), F.col("loaded"))
    assert {tuple(r) for r in snapshot_changes(one(df)).collect()} == {("b", "2", "added"), ("c", "1", "changed")}
    assert snapshot_changes(one(df.limit(0))).count() == 0
    assert snapshot_changes(one(df.where("d = 'a'"))).count() == 0
    with pytest.raises(ValueError, match="snapshots"):
        snapshot_changes(one(df), most=2)
