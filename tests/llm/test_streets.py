import random
import re

import pytest
from gleba.llm import addresses as A, matching as M, streets as S
from pyspark.sql import functions as F

ROWS = [
    (1, "Kerkstraat", "Noord", "Alfa"), (2, "Kerkstraat", "Zuid", "Beta"), (3, "Rikviposbospad", "Noord", "Alfa"), (4, "Weytinghweg", "West", "Alfa"), (5, "Leidingtor 7", "Oost", "Beta"), (6, "Leidingtor 17", "Oost", "Beta"), (7, "Sennesennemerlaan", "Oost", "Beta"), (8, "Gamteboerustdreef", "West", "Alfa"),
]


@pytest.fixture(scope="module")
def register():
    return S.Register(ROWS)


@pytest.mark.parametrize(
    ("typed", "want"),
    [
        (("Kerkstraat", "Zuid", None), 2), (("KERKSTR. 12", None, "district beta"), 2), (("kerk straat", "ress. Noord", None), 1), (("Kerckstraat te Zuid", None, None), 2), (("Riksiposbospd", "Nord", "Alfa"), 3), (("Perceel aan de Weitingweg nr. 4", None, None), 4), (("Leidingtor no. 17", None, None), 6), (("leidingtor7", None, None), 5),
        (("Leid. 7", None, None), 5), (("Sennesénnemer lane", "Oost", "Beta"), 7), (("hk SENNESENNEMERSTRAAT", "Oost", None), 7), (("Gamteboerust", "West", "Alfa"), 8), (("buitengebied", "Noord", "Alfa"), -1), (("zie kaart", None, None), -1), (("Zonderlingenpad", "Noord", "Alfa"), -1), (("", "Noord", "Alfa"), None), (("  ", None, None), None), ((None, None, None), None), (("12", None, None), -1), (("x" * 5000, None, None), -1), (("Kerkstraat / Zuid", None, None), 2), (("Kerkstraat", None, None), 1),
    ],
)
def test_resolve(register, typed, want):
    assert register.resolve(*typed)[0] == want


@pytest.mark.parametrize(
    ("street", "number"), [("Kerkstraat nr 15 b", ("15", "b")), ("Kerkstraat, 3-A", ("3", "a")), ("No. 26 KERKSTR.", ("26", "")), ("46 a Kerkstraat", ("46", "a")), ("Zuid, Kerkstraat huisnr. 49 b", ("49", "b")), ("Kerkstraat #014", ("14", "")), ("Leidingtor 7 no. 12c", ("12", "c")), ("Kerkstraat kavel 59", ("", "")), ("Kerkstraat", ("", ""))]
)
def test_house_numbers(register, street, number):
    assert register.resolve(street)[2:] == number


def test_distance_against_plain_dynamic_programming():
    def plain(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        for most in (1, 2, 3):
            assert S.edits(a, b, most) == min(plain(a, b), most + 1), (a, b, most)


def test_delete_index_finds_all_within_its_bounds():
    rng = random.Random(4)
    keys = {"".join(rng.choice("abcd") for _ in range(rng.randrange(3, 14))) for _ in range(300)}
    index = S.DeleteIndex(keys, 2, 10)
    for k in list(keys)[:150]:
        typed = "".join(c for c in k if rng.random() > 0.1) + rng.choice(["", "a"])
        want = {o for o in keys if S.edits(typed, o, 2) <= min(index.bound(o), index.bound(typed))}
        assert set(index.near(typed)) == want


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "record_id long, street string, resort string, district string, street_id string")


def test_table_forms_agree(spark):
    streets = spark.createDataFrame([(*r, 0.0) for r in ROWS], "street_id long, name string, ressort string, district string, lat double")
    typed = [("Kerkstraat", "Zuid", "Beta"), ("Kerckstraat", "Zuid", None), ("riksiposbospad", None, None), ("op aanvraag", "Noord", None), (None, "Noord", None), (" ", None, None), ("Sennesenemerlaan 5", None, "Beta")] + [("Gamtebomerustpad", None, None)] * 3
    df = frame(spark, typed)
    assert {tuple(r) for r in S.mapped_streets(df, streets).collect()} == {(1, 2), (2, 3), (3, -1), (6, 7), (7, 8), (8, 8), (9, 8)}
    a = {tuple(r) for r in S.with_street(df, streets, ["record_id"]).select("record_id", "street_id").collect()}
    b = {tuple(r) for r in S.with_street(df, streets, ["record_id"], most=2).select("record_id", "street_id").collect()}
    assert a == b
    assert S.mapped_streets(df.limit(0), streets).count() == 0
    assert {r.street_id for r in S.mapped_streets(df, streets.limit(0)).collect()} == {-1}


def spellings(rows, n, seed):
    """Freely typed addresses: slips, endings cut or changed, numbers in any place, words before the name, places shortened, swapped or missing."""
    rng = random.Random(seed)
    for i in range(n):
        _, name, resort, district = rng.choice(rows)
        t = list(name)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], [t[k]] * 2, [rng.choice("abcdeghikostvwz")], [rng.choice("aeiou"), t[k]]])
            t = t or ["a"]
        name = "".join(t)
        if rng.random() < 0.3:
            name = re.sub(r"(straat|weg|laan|pad|dreef)", lambda m: rng.choice([m.group()[:3] + ".", m.group()[:2], "", "str.", " " + m.group()]), name)
        if rng.random() < 0.15:
            name = name[: rng.randrange(3, 8)].rstrip() + "."
        name = rng.choice(["", "", "", "Perceel aan de ", "hk ", "nabij "]) + name + rng.choice(["", "", f" {rng.randrange(1, 200)}", f" nr. {rng.randrange(1, 99)}b", f" 7 no. {rng.randrange(1, 30)}", f", {resort}", f" te {district[:4]}"])
        yield rng.choice([name, name.upper(), name.lower()]), rng.choice([None, resort, resort[:4], "district " + district, "zz"]), rng.choice([None, district, district.lower(), resort])


def test_both_forms_of_the_register_agree_on_generated_spellings(sf):
    import duckdb

    rows = [*ROWS, *duckdb.sql(f"SELECT street_id + 100, name, ressort, district FROM '{sf}/streets.parquet'").fetchall()]
    whole, by = S.Register(rows), {}
    for row in rows:
        for x in S.Register([row], places=whole.where).answers():
            by.setdefault(x, set()).add(row)
    typed = [("Leid. 7", None, None), ("leid. 17", "Oost", None), ("Leid. 7 no. 3", None, None), ("12", None, None), ("x" * 5000, None, None), *rows[:50], *((s, r, d) for s, r, d in spellings(rows, 1000, 11))]
    hits = 0
    for v in (x[-3:] for x in typed):
        want = whole.read(*v)
        part = S.Register({row for x in whole.asked(v[0]) for row in by.get(x, ())}, places=whole.where)
        assert part.read(*v) == want, v
        hits += want[0] > 0
    assert hits > 500 and whole.resolve("Leid. 7")[0] == 5


def test_join_form_reads_what_the_broadcast_form_reads(spark, sf):
    streets = spark.read.parquet(f"{sf}/streets.parquet").select("street_id", "name", "ressort", "district").union(spark.createDataFrame([(i + 10**6, *r) for i, *r in ROWS], "street_id long, name string, ressort string, district string"))
    rows = [tuple(r) for r in streets.collect()]
    df = frame(spark, [*spellings(rows, 60, 3), ("Leid. 7", None, None), (None, "Noord", None), (" ", "x", None), ("zie kaart", None, None)])
    a, b = ({tuple(r) for r in S.with_street(df, streets, ["record_id"], most=m, read=True).collect()} for m in (100_000, 10))
    assert a == b and len(a) == 64
    with pytest.raises(ValueError, match="distinct"):
        S.places_of(streets, 2)


def test_same_addresses_against_brute_force(spark):
    streets = spark.createDataFrame(ROWS, "street_id long, name string, ressort string, district string")
    rng, rows = random.Random(5), []
    for i in range(400):
        _, name, resort, district = rng.choice(ROWS)
        n, x = rng.randrange(1, 4), rng.choice(["", "a", "b"])
        rows.append((i, f"{name} nr {n}{x}" if rng.random() < 0.9 else name.upper(), resort if rng.random() < 0.7 else None, district if rng.random() < 0.7 else None))
    rows += [(400, None, None, None), (401, "op aanvraag 3", None, None), (402, "", "Noord", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "check_id long, street string, resort string, district string, number string")
    register = S.Register(ROWS)
    meant = {i: register.resolve(*v) for i, *v in rows}
    keys = {i: (m[0], m[2], m[3]) for i, m in meant.items() if m[0] and m[0] > 0 and m[2]}
    want = {(a, b) for a in keys for b in keys if a < b and keys[a] == keys[b]}
    for spread in (1000, 3):
        got = A.same_addresses(df, streets, spread=spread).collect()
        assert len(got) == len({(r.check_id_a, r.check_id_b) for r in got}) and {(r.check_id_a, r.check_id_b) for r in got} == want
    assert A.same_addresses(df.limit(0), streets).count() == 0


def test_same_plots_against_brute_force(spark):
    from gleba.operators.units import readings

    rates = {("price", "EUR"): 1.0, ("price", "USD"): 0.92, ("price", "SRD"): 0.023, ("size", "m2"): 1.0, ("size", "ha"): 10_000.0}
    streets = spark.createDataFrame(ROWS, "street_id long, name string, ressort string, district string")
    rng = random.Random(6)

    def side(n):
        out = []
        for i in range(n):
            _, name, resort, district = rng.choice(ROWS)
            out.append((i, name, resort, district, rng.choice([None, 0.0, 20_000.0 * rng.uniform(0.95, 1.05), 123456.0]), rng.choice(["EUR", "USD"]), rng.choice([None, 1.0, 500.0 * rng.uniform(0.98, 1.02)])))
        return [*out, (n, None, None, None, 1.0, None, None), (n + 1, "zie kaart", None, None, 20_000.0, "EUR", 500.0)]

    names = "street string, resort string, district string, price double, currency string, size_m2 double"
    feed = spark.createDataFrame(side(150), f"record_id long, {names}").withColumns({"price_text": F.lit(None).cast("string"), "size_text": F.lit(None).cast("string"), "eur": F.lit("clash")})
    sites = spark.createDataFrame(side(120), f"listing_id long, {names}")
    a = M.attributes(feed, streets, rates, "record_id").collect()
    b = M.attributes(sites, streets, rates, "listing_id").collect()
    near = lambda x, y, p: x is None or y is None or abs(x - y) <= p * max(x, y) + 1e-9
    want = {(x.record_id, y.listing_id) for x in a for y in b if x.street_id == y.street_id and near(x.m2, y.m2, 0.01) and near(x.eur, y.eur, 0.03) and ((x.m2 and y.m2) or (x.eur and y.eur))}
    got = M.same_plots(feed, sites, streets, rates).collect()
    assert len(got) == len({(r.record_id, r.listing_id) for r in got})
    found = {(r.record_id, r.listing_id) for r in got}
    assert found <= want and len(found) >= 0.98 * len(want) > 100
    assert all(0.5 <= r.confidence <= 1 for r in got)
    assert M.same_plots(feed.limit(0), sites, streets, rates).count() == 0
    assert readings(feed, rates).columns.count("eur") == 1


def test_latent_classes_recover_a_planted_model():
    import numpy as np
    from gleba.llm.latent import TwoClasses, label_model

    rng = np.random.default_rng(0)
    truth = rng.random(40_000) < 0.3
    votes = np.stack([np.where(rng.random(40_000) < acc, truth, ~truth).astype(int) for acc in (0.95, 0.9, 0.8)], axis=1)
    votes = np.column_stack([votes, np.where(rng.random(40_000) < 0.9, votes[:, 2], 1 - votes[:, 2])])  # leans on the third
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    start = np.where(patterns[:, 0] + patterns[:, 1] == 2, 0.9, 0.1)
    model = label_model(patterns, counts.astype(float), [2] * 4, start)
    assert (2, 3) in model.cliques and abs(model.prior - 0.3) < 0.02
    assert ((model.posterior(patterns)[inverse] > 0.5) == truth).mean() > 0.95
    assert len(TwoClasses([2, 2]).fit(np.zeros((0, 2), int), np.zeros(0), np.zeros(0)).posterior(np.zeros((0, 2), int))) == 0


def test_no_closer_street_is_missed_by_stopping_early():
    class All(S.Register):
        SURE = (-1.0, -1.0, 99.0)

    rng = random.Random(5)
    stems = sorted({"".join(rng.choice("bpdtgh") + rng.choice("aou") for _ in range(3)) for _ in range(400)})
    rows = [(i, stem.capitalize() + "weg", f"R{i % 5}x", ("Alfa", "Beta")[i % 2]) for i, stem in enumerate(stems)]
    few, every = S.Register(rows), All(rows)
    for _ in range(300):
        _, name, _, district = rng.choice(rows)
        typed = "".join({"b": "p", "d": "t", "a": "o"}.get(c, c) if rng.random() < 0.3 else c for c in name[:-3].lower()) + "weg"
        assert few.resolve(typed, None, district)[:2] == every.resolve(typed, None, district)[:2], (typed, district)


def test_models_change_rows_of_planted_tables(spark, sf):
    sf = sf.replace("0.001", "0.01")  # enough plots that some are alike
    rates = {("price", "EUR"): 1.0, ("size", "m2"): 1.0}
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    plots = {r.method: r for r in M.planted(read("site_listings"), read("streets"), rates).collect()}
    model, check, every = plots["label model"], plots["exact check"], plots["every candidate"]
    assert model.right > check.right and model.right / model.pairs > every.right / every.pairs + 0.02
    places = {r.method: r for r in A.planted(read("needs_check"), read("streets")).collect()}
    weights, check, block = places["weights"], places["exact check"], places["whole block"]
    assert weights.right >= check.right and weights.pairs <= block.pairs and weights.right / weights.pairs >= block.right / block.pairs


def test_rounds_that_do_not_converge_are_an_error():
    import numpy as np
    from gleba.llm.latent import TwoClasses

    patterns, counts = np.array([[0, 0], [0, 1], [1, 0], [1, 1]]), np.array([40.0, 10.0, 10.0, 40.0])
    with pytest.raises(RuntimeError):
        TwoClasses([2, 2]).fit(patterns, counts, np.array([0.9, 0.4, 0.6, 0.1]), rounds=1, tolerance=0.0)
