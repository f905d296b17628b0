"""Amounts of money and of land, read from a number column and a text column.

Everything here is a Column expression, so it stays inside code generation. A *reading* is what one row says about one quantity: the number,
the unit it is in, the scale (1, 1,000 or 1,000,000), and whether it is per square metre.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Currencies by the marks that name them, in the order in which they are looked for ("Surinaamse dollar" holds "dollar").
CURRENCY_MARKS = (("SRD", r"srd|sr\$|surinaam"), ("USD", r"usd|us\$|dollar|\$"), ("EUR", r"eur|€"))
#: Units of land by the marks that name them.
AREA_MARKS = (
    ("sqft", r"sq\.? ?ft|square f|ft2|ft²|sqft"),
    ("acre", r"acres?\b"),
    ("ha", r"\d ?ha\b|hectare"),
    ("are", r"\bares?\b|\dares?\b"),
    ("m2", r"m2|m²|sqm|sq\.? ?m\b|vk\.? ?m|vierkante m|square m|centiare"),
)
THOUSAND, MILLION = r"\d ?k\b|duizend|mille|thousand", r"mln|miljoen|million|\bmio\b"
PER_AREA = r"p(er)?\.? ?/? ?(m2|m²|vk\.? ?m|vierkante|square m|sqm)|/ ?(m2|m²|sqm|vk)|p/m"
#: No plot is offered under or over these, in EUR and in m²; such an amount only fills its field.
PRICE_RANGE, SIZE_RANGE = (1_000.0, 10_000_000.0), (10.0, 10_000_000.0)
#: Numbers typed to get past a form: 0, 0.1, 1, a run up from one of three digits or more, or one digit three times or more. Beside a text that explains it, a
#: short one may be meant. Other small numbers (5, 22) are in some unit, which the advert's other captures may tell.
RUNS_UP = [float("123456789"[:n]) for n in range(1, 10)]
REPEATS = [float(str(d) * n) for d in range(1, 10) for n in range(1, 10)]
FILLERS = sorted({0.0, 0.1, 1.0, *RUNS_UP[2:], *(r for r in REPEATS if r > 99)})
LONG_FILLERS = sorted({*RUNS_UP[3:], *(r for r in REPEATS if r > 9999)})


def squeezed(text: Column) -> Column:
    """Lower case, any run of white space (no-break spaces too) as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s   ]+", " "))


def first_mark(text: Column, marks: tuple) -> Column:
    out = F.lit(None).cast("string")
    for code, pattern in reversed(marks):
        out = F.when(text.rlike(pattern), code).otherwise(out)
    return out


def currency_code(currency: Column) -> Column:
    """EUR, USD or SRD for any spelling; null for null, blank or unknown."""
    return F.when(currency.isin("EUR", "eur", "€"), "EUR").when(currency.isNotNull(), first_mark(squeezed(currency), CURRENCY_MARKS))


def digits_in(text: Column) -> Column:
    """The first number of a text with its separators; empty where there is none."""
    return F.regexp_replace(F.regexp_extract(text, r"\d{1,3}(?: \d{3})+(?:[.,]\d+)?(?!\d)|\d[\d.,]*", 0), r"[.,]+$| ", "")


def to_number(raw: Column, decimals: Column) -> Column:
    """A double from digits with separators. decimals: a lone separator before three digits is a decimal point (otherwise it parts thousands)."""
    dots, commas = r"^\d{1,3}(\.\d{3})+(,\d+)?$", r"^\d{1,3}(,\d{3})+(\.\d+)?$"
    lone = raw.rlike(r"^\d+[.,]\d+$") & (decimals | raw.rlike(r"^0[.,]"))
    plain = (
        F.when(lone, F.replace(raw, F.lit(","), F.lit(".")))
        .when(raw.rlike(dots), F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(raw.rlike(commas), F.replace(raw, F.lit(","), F.lit("")))
        .otherwise(F.replace(raw, F.lit(","), F.lit(".")))
    )
    return F.when(plain.rlike(r"^\d+(\.\d+)?$"), plain.cast("double"))


SIDE = r"(\d+(?:[.,]\d+)?)"
SIDES = SIDE + r" ?(?:m(?:eter)?)? ?(?:breed|wide|lang|diep)? ?(?:x|×|\*|bij|by|en|and) ?" + SIDE


def with_text_readings(df: DataFrame, price_text: str, size_text: str) -> DataFrame:
    """Adds what the texts say: __p_amount (scaled), __p_currency, __p_per (per m²); __s_amount, __s_unit (m2 where two sides are given).

    Done in steps, each a projection of its own: every pattern runs once a row, and only over texts that hold a digit.
    """
    has = lambda c: F.when(c.rlike(r"\d"), squeezed(c))
    df = df.withColumns({"__pt": has(F.col(price_text)), "__st": has(F.col(size_text))})
    p, s = F.col("__pt"), F.col("__st")
    # the digits of "m2" are no amount
    number_in = lambda c: F.when(c.isNotNull(), digits_in(F.replace(F.replace(c, F.lit("m2"), F.lit("m²")), F.lit("ft2"), F.lit("ft²"))))
    df = df.withColumns(
        {
            "__pn": number_in(p), "__p_scale": F.when(p.rlike(MILLION), 1e6).when(p.rlike(THOUSAND), 1e3).otherwise(1.0), "__p_currency": F.when(p.isNotNull(), first_mark(p, CURRENCY_MARKS)), "__p_per": F.coalesce(p.rlike(PER_AREA), F.lit(False)),
            "__sn": number_in(s), "__s_mark": F.when(s.isNotNull(), first_mark(s, AREA_MARKS)), "__s_a": F.when(s.isNotNull(), F.regexp_extract(s, SIDES, 1)), "__s_b": F.when(s.isNotNull(), F.regexp_extract(s, SIDES, 2)),
        }
    )
    side = lambda c: F.replace(F.col(c), F.lit(","), F.lit(".")).try_cast("double")
    sides = F.coalesce(F.col("__s_a") != "", F.lit(False))
    return df.withColumns(
        {
            "__p_amount": F.when(F.col("__pn") != "", to_number(F.col("__pn"), F.col("__p_scale") > 1)) * F.col("__p_scale"),
            "__s_amount": F.when(sides, side("__s_a") * side("__s_b")).when(F.col("__sn") != "", to_number(F.col("__sn"), F.col("__s_mark").isin("ha", "acre", "are"))),
            "__s_unit": F.when(sides, F.lit("m2")).otherwise(F.col("__s_mark")),
        }
    ).drop("__pt", "__st", "__pn", "__p_scale", "__sn", "__s_mark", "__s_a", "__s_b")


def real_price(eur: Column, raw: Column | None = None) -> Column:
    """Whether an amount in EUR may be meant. raw: the number as recorded, to spot fillers."""
    ok = eur.between(*PRICE_RANGE)
    return ok if raw is None else ok & ~F.coalesce(raw.isin(LONG_FILLERS), F.lit(False))


def real_size(m2: Column) -> Column:
    """Whether a number of m² may be meant."""
    return m2.between(*SIZE_RANGE)
