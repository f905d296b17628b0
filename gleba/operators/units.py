"""Quantities recorded in different units: one scale for all of them.

``readings`` turns what a row says, in its number column, its text column or both, into EUR and m². Where the row leaves the unit open (a number
with no currency, or one that no plot could have in the unit it names) ``decode`` settles it with a hidden Markov model per device (an advert): the
unit is the hidden state, the captures of the device in time are the sequence, and Viterbi finds the cheapest path. A state's cost at a capture is the
distance of the logarithm of the converted value from the smooth level of the device's certain captures; switching units costs extra.

Only captures with an open unit can take more than one state, so a device without one needs no decoding: its path is fixed. Nor does a device none of whose
open numbers comes near the range of its certain values in any unit: every unit would cost more than none (``reach``). Both are exact, and they keep the
shuffle down to the devices in doubt. A device of any number of captures is cut into blocks of ``chain`` captures (by a prefix sum over hours,
so no task sees a whole hot device); each block is decoded on its own, with the level of its own certain captures, else that of the whole device.

Defined results: null, blank and filler amounts are no amounts; a price per m² without a size of the same row has none either; an open unit without
any level to hold it against stays open (null); numbers typed to get past a form (``FILLERS``: 1, 111, 123 and the like) are no amounts, whatever the level, unless
``stand_ins`` lets the level speak for them; extra columns pass through untouched unless they bear the name of an output column, which is replaced.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gleba.functions import amounts as A
from gleba.session import checkpointed

OUTPUT = ("price_eur", "price_plain", "area_m2", "area_plain", "price_open", "area_open", "price_unit", "area_unit")
OPEN_AREA_UNITS = ("m2", "ha", "are", "acre", "sqft")
OPEN_SCALES = (1.0, 1e3, 1e6)


def rate_map(rates: DataFrame, most: int = 1000) -> dict[tuple[str, str], float]:
    """(quantity, unit code) -> factor. A list of units is small by nature; a longer one is refused, not collected."""
    rows = rates.select("quantity", "unit_code", "factor").where("quantity is not null and unit_code is not null and factor is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} units")
    return {(r.quantity, r.unit_code): r.factor for r in rows}


def _factor(code: Column, quantity: str, rates: dict) -> Column:
    return reduce(lambda out, kv: F.when(code == kv[0][1], kv[1]).otherwise(out), [(k, v) for k, v in sorted(rates.items()) if k[0] == quantity], F.lit(None).cast("double"))


def readings(df: DataFrame, rates: dict, stand_ins: bool = False) -> DataFrame:
    """Adds, row by row: price_eur and area_m2 (null: no amount, or an open unit), *_plain (the number column already holds that amount in EUR or m²), *_open and *_unit. stand_ins: short fillers are open too."""
    df = A.with_text_readings(df.drop(*OUTPUT), "price_text", "size_text").withColumn("__pc", A.currency_code(F.col("currency")))
    df = df.withColumns({"__s2": F.col("__s_amount") * _factor(F.col("__s_unit"), "size", rates), "__size": F.nanvl("size_m2", F.lit(None).cast("double")), "__price": F.nanvl("price", F.lit(None).cast("double"))})
    number, text = F.col("__size"), F.col("__s2")
    plain = A.real_size(number) & (text.isNull() | (F.abs(number - text) <= 0.01 * text))
    told = F.col("__p_amount").isNotNull()
    df = df.withColumns(
        {
            "area_m2": F.when(plain, number).when(A.real_size(text), text).when(text.isNull() & A.real_size(number), number),
            "area_plain": F.coalesce(plain, F.lit(False)),
            "area_open": F.coalesce((number > 0) & (number < A.SIZE_RANGE[0]) & F.col("__s_amount").isNull() & (F.lit(stand_ins) | ~number.isin(A.FILLERS)), F.lit(False)),
            "area_unit": F.when(text.isNotNull() & ~F.coalesce(plain, F.lit(False)), F.col("__s_unit")).otherwise(F.lit("m2")),
            "__raw": F.when(told, F.col("__p_amount")).otherwise(F.col("__price")),
            "price_unit": F.when(told, F.coalesce("__p_currency", "__pc", F.lit("EUR"))).otherwise(F.col("__pc")),
            "__filler": F.coalesce(~told & F.col("__price").isin([x for x in A.FILLERS if x < 1000 or x in A.LONG_FILLERS]), F.lit(False)),
            "__told": told,
        }
    )
    df = df.withColumn("__eur", F.col("__raw") * _factor(F.col("price_unit"), "price", rates))
    whole = F.col("__eur") * F.when(F.col("__p_per"), F.col("area_m2")).otherwise(1.0)
    df = df.withColumn("price_eur", F.when(A.real_price(whole) & ~F.col("__filler"), whole))
    eur = F.col("price_eur")
    plain = (F.col("__pc") == "EUR") & (F.abs(F.col("__price") - eur) <= 0.005 * F.greatest(F.lit(1.0), eur / 1000)) & ~F.col("__p_per")
    open_ = ~F.col("__told") & (F.lit(stand_ins) | ~F.col("__filler")) & ~F.col("__price").isin(A.LONG_FILLERS) & (F.col("__price") >= 1) & (F.col("price_unit").isNull() | (F.col("__eur") < A.PRICE_RANGE[0])) & ~F.col("__p_per")
    df = df.withColumns({"price_plain": F.coalesce(plain, F.lit(False)), "price_open": F.coalesce(open_, F.lit(False))})
    df = df.drop("__p_amount", "__p_currency", "__p_per", "__s_amount", "__s_unit", "__pc", "__s2", "__size", "__price", "__raw", "__filler", "__told", "__eur")
    # a generator ends it: a filter on these columns would else be pushed into every pattern, and its code grow beyond what can be compiled
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def _viterbi(levels: np.ndarray, states: list[list[float]], certain: list[bool], switch: float, sigma: float, none: float) -> list[int]:
    """For each capture the index of its unit, -1 for none. states: the log value in each unit (nan: impossible); levels: the smooth level (nan: unknown)."""
    cost: dict[int, float] = {}
    back: list[dict[int, int | None]] = []
    for level, values, sure in zip(levels, states, certain):
        if sure:
            emit = {k: 0.0 for k, v in enumerate(values) if not np.isnan(v)}
        else:
            emit = {-1: none}
            if not np.isnan(level):
                emit |= {k: ((v - level) / sigma) ** 2 / 2 for k, v in enumerate(values) if not np.isnan(v)}
        best, now = {}, {}
        for k, e in emit.items():
            # an amount that means nothing leaves the unit as it was, so it costs no switch
            j = min(cost, key=lambda j: (cost[j] + switch * (j != k and -1 not in (j, k)), j), default=None)
            now[k] = e if j is None else e + cost[j] + switch * (j != k and -1 not in (j, k))
            best[k] = j
        cost = now
        back.append(best)
    path, k = [], min(cost, key=lambda j: (cost[j], j), default=None)
    for best in reversed(back):
        path.append(k)
        k = best[k]
    return path[::-1]


def decode(df: DataFrame, rates: dict, device: str, time: str, row_id: str, chain: int = 4096, switch: float = 2.0, sigma: float = 0.03, none: float = 8.0) -> DataFrame:
    """(row_id, field, value) for the rows of ``readings`` whose unit is open, decoded by Viterbi. value null: no unit fits."""
    units = [(c, s) for q, c in sorted(rates) if q == "price" for s in OPEN_SCALES]
    price_states = F.array(*[F.when(A.real_price(F.col("price") * rates["price", c] * s) & (F.col("__c").isNull() | (F.col("__c") == c)), F.log(F.col("price") * rates["price", c] * s)).otherwise(F.lit(float("nan"))) for c, s in units])
    area_states = F.array(*[F.when(A.real_size(F.col("size_m2") * rates["size", u]), F.log(F.col("size_m2") * rates["size", u])).otherwise(F.lit(float("nan"))) for u in OPEN_AREA_UNITS if ("size", u) in rates])
    one = df.select(
        F.col(device).alias("__d"), F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(0)).alias("__t"), F.col(row_id).alias("__r"), "price", A.currency_code(F.col("currency")).alias("__c"), "size_m2", "price_eur", "price_open", "price_unit", "area_m2", "area_open", "area_unit"
    ).where("__d is not null")
    nan = F.lit(float("nan"))
    sure_price = F.array(*[F.when((F.col("price_unit") == c) & F.lit(s == 1.0), F.log("price_eur")).otherwise(nan) for c, s in units])
    sure_area = F.array(*[F.when(F.col("area_unit") == u, F.log("area_m2")).otherwise(nan) for u in OPEN_AREA_UNITS if ("size", u) in rates])
    long = one.select(
        "__d", "__t", "__r",
        F.explode(F.array(
            F.struct(F.lit("price").alias("field"), F.when(F.col("price_open"), price_states).when(F.col("price_eur").isNotNull(), sure_price).alias("states"), F.col("price_open").alias("open")),
            F.struct(F.lit("size_m2").alias("field"), F.when(F.col("area_open"), area_states).when(F.col("area_m2").isNotNull(), sure_area).alias("states"), F.col("area_open").alias("open")),
        )).alias("x"),
    ).select("__d", "__t", "__r", "x.*").where("states is not null")
    reach = sigma * float(np.sqrt(2 * none))  # beyond it a unit costs more than none
    known = F.array_max(F.filter("states", lambda v: ~F.isnan(v)))
    levels = long.where("not open").groupBy("__d", "field").agg(F.min(known).alias("lo"), F.max(known).alias("hi"))
    near = F.exists("states", lambda v: ~F.isnan(v) & v.between(F.col("lo") - reach, F.col("hi") + reach))
    doubt = long.where("open").select("__d", "field", "states").join(levels, ["__d", "field"]).where(near).select("__d", "field").distinct()
    long = long.join(doubt, ["__d", "field"], "left_semi").withColumn("__h", F.expr("__t div 3600000000"))
    before = long.groupBy("__d", "field", "__h").agg(F.count("*").alias("n"))
    before = before.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("__d", "field").orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    whole = long.where("not open").groupBy("__d", "field").agg(F.avg(F.array_max(F.filter("states", lambda v: ~F.isnan(v)))).alias("whole"))
    placed = (
        long.join(before, ["__d", "field", "__h"])
        .withColumn("block", F.expr(f"(start + row_number() over (partition by __d, field, __h order by __t, __r) - 1) div {chain}"))
        .join(whole, ["__d", "field"], "left")
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__t", "__r"], kind="stable")
        states = [list(s) for s in pdf["states"]]
        certain = pd.Series([np.nan if o else np.nanmax(s) for s, o in zip(states, pdf["open"])])
        smooth = certain.rolling(7, min_periods=1, center=True).median().interpolate(limit_direction="both")
        level = smooth.fillna(pdf["whole"].reset_index(drop=True)).to_numpy(float)
        path = _viterbi(level, states, [not o for o in pdf["open"]], switch, sigma, none)
        value = [np.exp(s[k]) if k >= 0 else None for s, k in zip(states, path)]
        out = pd.DataFrame({"row_id": pdf["__r"].to_numpy(), "field": pdf["field"].to_numpy(), "value": pd.Series(value, dtype="float64")})
        return out[pdf["open"].to_numpy()]

    kind = df.schema[row_id].dataType.simpleString()
    return placed.groupBy("__d", "field", "block").applyInPandas(run, f"row_id {kind}, field string, value double").withColumnRenamed("row_id", row_id)


def item_number(url: Column) -> Column:
    """The digits after /item/ in a url, null where there are none."""
    return F.nullif(F.regexp_extract(url, r"(?i)/item/(\d+)", 1), F.lit(""))


def common_amounts(df: DataFrame, rates: dict, row_id: str = "record_id", device: Column | None = None, time: str = "seen_at") -> DataFrame:
    """(row_id, field, common_amount): every amount that isn't already the plain number of EUR in price or of m² in size_m2, rounded to a whole number."""
    keep = df.select(row_id, time, (item_number(F.col("url")) if device is None else device).alias("__device"), "price", "currency", "price_text", "size_m2", "size_text")
    read = readings(keep, rates)
    price, area = F.when(~F.col("price_plain"), F.col("price_eur")), F.when(~F.col("area_plain"), F.col("area_m2"))
    # one pass over the texts; only rows with something to say are written down
    each = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value"), F.col(o).alias("open")) for f, v, o in (("price", price, "price_open"), ("size_m2", area, "area_open"))])
    # the filter stands behind a generator: before it, Catalyst would copy every pattern into the filter
    told = checkpointed(read.select(row_id, "__device", F.explode(each).alias("x")).select(row_id, "__device", "x.*").where("value is not null or open"))
    certain = told.select(row_id, "field", "value")
    doubt = told.where("open").select("__device").distinct()
    if not doubt.isEmpty():
        certain = certain.unionByName(decode(readings(keep.join(doubt, "__device", "left_semi"), rates), rates, "__device", time, row_id))
    return certain.where("value is not null").select(row_id, "field", F.rint("value").cast("long").alias("common_amount"))


def planted(feed: DataFrame, rates: dict, row_id: str = "record_id", time: str = "seen_at") -> DataFrame:
    """(kind, planted, alone, decoded, right): open units planted into the feed's plain EUR prices, how many a row alone settles, and how many decoding gives back.

    By a hash of its row id a price that stands in EUR is written in thousands, or in USD or SRD with its currency and its texts taken away. right: within 1 % of
    what was there. Decoding needs another capture of the advert whose unit is certain; kind "alone in its advert" counts planted prices that have none.
    """
    read = readings(feed.select(row_id, time, item_number(F.col("url")).alias("__device"), "price", "currency", "price_text", "size_m2", "size_text"), rates)
    base = checkpointed(read.where("__device is not null").select(row_id, time, "__device", F.when(F.col("price_plain"), F.col("price_eur")).alias("true_price")).where("true_price is not null"))
    dice = F.pmod(F.xxhash64(row_id, F.lit("unit")), F.lit(100))
    kind = F.when(dice < 15, "thousands").when(dice < 25, "USD").when(dice < 35, "SRD")
    made = base.withColumn("kind", kind)
    none = F.lit(None).cast("string")
    price = F.when(F.col("kind") == "thousands", F.col("true_price") / 1000).when(F.col("kind") == "USD", F.col("true_price") / rates["price", "USD"]).when(F.col("kind") == "SRD", F.col("true_price") / rates["price", "SRD"]).otherwise(F.col("true_price"))
    made = made.select(row_id, time, "__device", "kind", "true_price", price.alias("price"), F.when(F.coalesce("kind", F.lit("thousands")) == "thousands", "EUR").alias("currency"), none.alias("price_text"), F.lit(None).cast("double").alias("size_m2"), none.alias("size_text"))
    read = readings(made, rates)
    value = decode(read, rates, "__device", time, row_id).where("field = 'price'").select(row_id, "value")
    certain = read.where("kind is null").select("__device").distinct().withColumn("certain", F.lit(True))
    rows = made.where("kind is not null").join(read.select(row_id, "price_eur"), row_id).join(value, row_id, "left").join(certain, "__device", "left")
    rows = rows.withColumn("kind", F.when(F.col("certain").isNull(), "alone in its advert").otherwise(F.col("kind")))
    right = lambda c: F.abs(F.col(c) - F.col("true_price")) <= 0.01 * F.col("true_price")
    return rows.groupBy("kind").agg(F.count("*").alias("planted"), F.count_if(right("price_eur")).alias("alone"), F.count("value").alias("decoded"), F.count_if(right("value")).alias("right"))
