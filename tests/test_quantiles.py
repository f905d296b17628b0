import random

from gleba.operators.quantiles import quantiles


def test_against_sorting(spark):
    rng = random.Random(3)
    for values in ([1.0], [2.0, 1.0], [rng.choice([1.0, 2.5, 7.0]) for _ in range(50)], [rng.uniform(-5, 5) for _ in range(400)]):
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
        shares, ordered = [0.0, 0.1, 0.37, 0.5, 1.0], sorted(values)
        got = {r.stop: r.value for r in quantiles(df, "v", shares).collect()}
        for i, s in enumerate(shares):
            a = s * (len(values) - 1)
            lo, hi = ordered[int(a)], ordered[min(int(a) + 1, len(values) - 1)]
            assert abs(got[i] - (lo + (hi - lo) * (a - int(a)))) < 1e-9
    assert quantiles(df.limit(0), "v", [0.5]).count() == 0
