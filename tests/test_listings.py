import random

from gleba.operators import dedup, places, runs
from gleba.operators.units import item_number
from gleba.sources import feeds, html, sinks
from gleba.sources.rest import PagedHttp, fetch
from pyspark.sql import functions as F


def sequential(items):
    """The greedy rule as it is stated: items in order, (id, source, url, fingerprints)."""
    index, out = {}, {}
    for i, source, url, fps in items:
        hit = next((index[f] for f in fps if f in index), None)
        if hit and hit[1] != source:
            out[i] = ("merged", hit[0])
        elif hit and hit[2] == url:
            out[i] = ("dropped", None)
        elif hit and fps[0] in index:
            out[i] = ("merged", hit[0])
        else:
            out[i] = ("kept", None)
            for f in fps:
                index.setdefault(f, (i, source, url))
    return out


def test_greedy_equals_the_sequential_rule(spark):
    for seed in range(4):
        rng = random.Random(seed)
        items = [(i, rng.choice("ab"), rng.choice("uvwxyz"), [f"{c}{rng.randrange(12)}" for c in "abd" if rng.random() < 0.8]) for i in range(150)]
        df = spark.createDataFrame([(i, i, s, u, f) for i, s, u, f in items], "id long, ord long, source string, url string, fps array<string>")
        got = {r.id: (r.fate, r["into"]) for r in dedup.greedy(df).collect()}
        want = {i: (f, None if f != "merged" else into) for i, (f, into) in sequential(items).items()}
        assert got == want


def test_greedy_of_copies_and_of_nothing(spark):
    schema = "id long, ord long, source string, url string, fps array<string>"
    copies = spark.createDataFrame([(i, i, "s", "u", ["a", "b"]) for i in range(500)], schema)
    assert {r.fate: r["count"] for r in dedup.greedy(copies).groupBy("fate").count().collect()} == {"kept": 1, "dropped": 499}
    assert dedup.greedy(copies.limit(0)).count() == 0


def test_ordered_union(spark):
    df = spark.createDataFrame([(1, 1, ["a", "b", "a"]), (1, 0, ["c", None]), (1, 2, None), (2, 0, [])], "k int, o int, x array<string>")
    assert {r.k: r.x for r in dedup.ordered_union(df, "k", "o", "x", 2).collect()} == {1: ["c", "a"]}


def test_runs(spark):
    old = spark.createDataFrame([("a", 1.0, "2025"), ("b", None, "2025"), ("c", 3.0, "2025")], "key string, price double, first_seen string")
    new = spark.createDataFrame([("a", 2.0), ("b", 5.0), ("d", 4.0)], "key string, price double")
    got = {r.key: (r.first_seen, r.is_new, r.previous_price) for r in runs.merge_run(old, new, "2026").collect()}
    assert got == {"a": ("2025", False, 1.0), "b": ("2025", False, None), "d": ("2026", True, None)}
    assert [r.key for r in runs.gone(old, new).collect()] == ["c"]
    again = runs.merge_run(runs.merge_run(old, new, "2026"), new, "2027")
    assert again.where("is_new").count() == 0 and runs.gone(runs.merge_run(old, new, "2026"), new).count() == 0


def test_places(spark):
    streets = spark.createDataFrame([(1, "Adriaanstraat", "R1", "D1", 5.0, -55.0), (2, "Adrianusstraat", "R2", "D1", 5.1, -55.1), (3, "Kerkweg", "R1", "D1", 5.2, -55.2), (4, "Kerkweg", "R3", "D2", 5.9, -55.9)], "street_id long, name string, ressort string, district string, lat double, lon double")
    ask = spark.createDataFrame([(1, "Kerckweg", "R3", None), (2, "Kerkweg", None, "D2"), (3, "Kerkweg", None, "D9"), (4, "Adriaenstraat", None, None), (5, None, None, None)], "id long, street string, resort string, district string")
    from gleba.functions import text as T

    exact = places.exact(ask.withColumn("fold", T.street_fold(T.unaccented(F.coalesce("street", F.lit(""))))), streets, "id", "fold")
    assert {r.id: r.street_id for r in exact.collect()} == {1: 4, 2: 4}
    assert {r.id: r.street_id for r in places.fuzzy(ask.where("id = 4"), streets, "id", "street").collect()} == {4: 1}
    texts = ["Te koop Baas Adriaanstraat 7", None, "", "12", "hk de Kerkweg, KERKWEG 3", "Leiding 7a"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", places.candidates(F.col("t")).alias("c")).collect()
    assert [r.c for r in sorted(got)] == [["Baas Adriaanstraat 7", "Baas Adriaanstraat", "Adriaanstraat 7", "Adriaanstraat"], [], [], [], ["Kerkweg KERKWEG 3", "Kerkweg KERKWEG", "KERKWEG 3", "Kerkweg"], ["Leiding 7a"]]
    assert round(places.gestalt("tide", "diet"), 2) == 0.25 and round(places.gestalt("diet", "tide"), 2) == 0.5


def test_html_cards_and_blocks():
    page = """<html><body><div class=menu><a href="/">home</a></div>
    <div class="item big"><a href="/lo/1/x"><img data-src="//img/1.jpg" src="data:abc"></a><h3>Kavel &amp; A</h3><span>EUR 12.000</span> 500 m2</div>
    <div class="big item"><a href="/lo/2/y"><h3>Kavel B</h3></a><p>600 m2 <b>unclosed</div>
    <div class="item big"><a href="/lo/2/y">again</a> 600 m2 of more</div></body>"""
    got = html.cards_of(page, html.Layout(None, (("title", "h1,h2,h3", None),), "https://s.example/"))
    assert [(c["url"], c["title"]) for c in got] == [("https://s.example/lo/1/x", "Kavel & A"), ("https://s.example/lo/2/y", "Kavel B")]
    assert got[0]["image"] == "https://img/1.jpg"
    assert html.cards_of(None, html.LAYOUTS["object"]) == [] and html.cards_of("<div class='object'>no link</div>", html.LAYOUTS["object"]) == []
    assert html.style_url(html.parse("<div><p style='background:url(\"//i.example/a.jpg\")'></p></div>")) == "https://i.example/a.jpg"


def test_feed_file_and_rest_source(spark, tmp_path):
    path = tmp_path / "feed.json"
    path.write_text('[{"url":"https://feed.example/item/1/","title":"Perceel Testweg","price_text":"EUR 15.000","size_text":"0,5 ha","description":"bel 854-3210"}]')
    row = feeds.feed_listings(feeds.json_feed(spark, str(path))).first()
    assert (row.source_id, row.street, row.price, row.currency, row.size_m2, row.phones) == ("feed:1", "Perceel Testweg", 15000.0, "EUR", 5000.0, ["+5978543210"])
    assert feeds.json_feed(spark, str(tmp_path / "none.json")).count() == 0
    spark.dataSource.register(PagedHttp)
    urls = f"file://{path}\nfile://{tmp_path}/missing"
    got = spark.read.format("paged_http").options(urls=urls, delay="0").load().collect()
    assert [(r.status, r.body is None) for r in sorted(got, key=lambda r: r.page)] == [(200, False), (404, True)]
    assert fetch("http://127.0.0.1:9/x", "a", 2, 0.2, wait=lambda s: None) == (None, 0)


def test_rest_rows(spark):
    row = '{"id":5,"link":"https://a.example/p/5","date":"2025-01-02T10:00:00","title":{"rendered":"Kavel X"},"content":{"rendered":"<p>Perceelgrootte: 800 m2. Vraagprijs EUR 20.000; zie kaart</p> 1 m2"},"location":[7,8],"neighborhoods":[],"purpose":[1],"_embedded":{"wp:featuredmedia":[{"source_url":"https://i"}]}}'
    rows = spark.createDataFrame([(row,)], "j string").select(F.from_json("j", feeds.REST_SCHEMA).alias("x")).select("x.*")
    names = lambda *v: spark.createDataFrame(list(v), "id long, name string")
    got = feeds.rest_listings(rows, names((8, "Noord Wanica"), (7, "")), names((1, "z")), names((1, "Koop")), ["Wanica"]).first()
    assert (got.district, got.title_type, got.size_m2, got.price, got.posted, got.image) == ("Wanica", "Koop", 800.0, 20000.0, "2025-01-02", "https://i")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "é")], "a int, b string")
    sinks.write_snapshot(df, df.limit(0), df.agg(F.count("*").alias("n")), str(tmp_path / "s"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "s/listings")).collect()) == ['{"a":1,"b":null}', '{"a":2,"b":"é"}']
    sinks.write_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_streaming(spark, sf, tmp_path):
    from gleba.streaming import runs as S

    feed = spark.read.parquet(f"{sf}/feed_items.parquet")
    feed.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = S.captures(spark, str(tmp_path / "in"), feed.schema)
    for name, df, mode in (("distinct_captures", S.distinct_captures(stream).select("source_id", "seen_at"), "append"), ("weeks", S.windowed_counts(stream), "complete"), ("states", S.price_states(stream), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    keyed = feed.withColumn("source_id", item_number(F.col("url")))
    assert spark.table("distinct_captures").count() == keyed.select("source_id", "seen_at").distinct().count()
    assert spark.table("weeks").agg(F.sum("captures")).first()[0] == feed.count()
    assert spark.table("states").select("source_id").distinct().count() == keyed.select("source_id").distinct().count()


def test_details_and_page_phones(spark):
    cards = spark.createDataFrame([(1, "u1", 0.0, ["a"]), (1, "u2", 300.0, ["b"]), (2, None, None, None)], "page_id int, url string, size_m2 double, images array<string>")
    details = spark.createDataFrame([("u1", "<p>Oppervlakte 450 m2</p>", ["data:x", "//c"]), ("u2", None, None)], "url string, body string, gallery array<string>")
    got = {r.url: (r.size_m2, r.images) for r in feeds.with_details(cards, details).collect()}
    assert got == {"u1": (450.0, ["https://c"]), "u2": (300.0, ["b"]), None: (None, None)}
    pages = spark.createDataFrame([(1, "bel 854-3210 of 854-3211 of 854-3212")], "page_id int, text string")
    assert {r.url: r.phones for r in feeds.with_page_phones(cards, pages).collect()} == {"u1": ["+5978543210", "+5978543211"], "u2": ["+5978543210", "+5978543211"], None: None}


def test_location_parts(spark):
    df = spark.createDataFrame([("Kerkweg 1, Noord, Wanica", "Wanica - Noord - Oost"), ("Noord", "ergens in Para"), (None, None)], "p string, q string")
    names = ["Para", "Wanica"]
    get = lambda c, mode: [tuple(r.x) for r in df.select(feeds.split_location(F.col(c), mode, names).alias("x")).collect()]
    assert get("p", "street_first") == [("Kerkweg 1", "Noord", "Wanica"), ("Noord", None, None), (None, None, None)]
    assert get("p", "ends") == [(None, "Kerkweg 1", "Wanica"), (None, None, None), (None, None, None)]
    assert get("p", "resort_first") == [(None, "Kerkweg 1", "Wanica"), (None, "Noord", None), (None, None, None)]
    assert get("q", "dash") == [(None, "Noord - Oost", "Wanica"), (None, None, "Para"), (None, None, None)]


def test_nearest_names_are_those_of_the_first_letter(spark, sf):
    import duckdb
    from gleba.plans.listing_queries import nearest_names

    near = f"SELECT a.name, b.name AS other, row_number() OVER (PARTITION BY a.name ORDER BY levenshtein(a.name, b.name), b.name DESC) AS rank FROM n a, n b WHERE left(a.name, 1) = left(b.name, 1) AND a.name <> b.name QUALIFY rank <= 5"
    want = duckdb.sql(f"WITH n AS (SELECT DISTINCT name FROM '{sf}/streets.parquet') {near}").fetchall()
    assert sorted(tuple(r) for r in nearest_names(spark, sf).collect()) == sorted(want)


def place_of(asked, heads, normals, rest, normal, resort, district, register, folds):
    """The cascade for one advert without own or checked coordinates, over plain lists. register: (name, ressort, district, lat, lon) in order; folds: of each name."""
    import difflib

    by_key = {}
    for r in register:
        by_key.setdefault(folds[r[0]][0], []).append(r)
    low = lambda v: (v or "").lower()

    def pick(rows):
        for r in rows:
            if resort and low(resort) in low(r[1]):
                return r
        if district:
            here = [r for r in rows if low(r[2]) == low(district)]
            return here[0] if here else None if any(r[2] for r in rows) else rows[0]
        return rows[0]

    def find(name, fuzzy):
        k = folds[name][0]
        if k in by_key:
            return pick(by_key[k])
        if not (k and fuzzy):
            return None
        pool = [x for x, rows in by_key.items() if not district or any(low(r[2]) == low(district) for r in rows)] or list(by_key)
        digits = lambda v: "".join(c for c in v if c.isdigit())
        for x in difflib.get_close_matches(k, [x for x in pool if x[:1] == k[:1]], n=5, cutoff=0.88):
            name_there = by_key[x][0][0]
            if digits(name_there) == digits(name) and places.gestalt(folds[name_there][1], folds[name][1]) >= 0.87 and pick(by_key[x]):
                return pick(by_key[x])
        return None

    resort, district = resort or (rest if rest and 3 < len(rest) < 30 else None), district or None
    tried = [(c, fuzzy) for names in (heads, normals) for fuzzy in (False, True) for c in names]
    hit = next((h for c, fuzzy in tried if (h := find(c, fuzzy))), None) or (find(normal, False) if folds[normal][0] else None)
    mean = lambda rows: (sum(r[3] for r in rows) / len(rows), sum(r[4] for r in rows) / len(rows))
    box = [r for r in register if r[2] == district and district]
    inside = lambda h: not box or all(min(r[i] for r in box) - 0.02 <= h[i] <= max(r[i] for r in box) + 0.02 for i in (3, 4))
    holding = [r for r in register if len(normal) >= 4 and normal.upper() in r[0].upper()]
    holding = [r for r in holding if resort and resort.upper() in r[1].upper()] or holding
    for h in (hit, holding[0] if holding else None):
        if h and inside(h):
            return ("street", *h[3:])
    areas = sorted({(low(r[1]) != low(resort), r[1], r[2]) for r in register if resort and r[1] and low(resort) in low(r[1]) and (not district or low(r[2]) == low(district))})
    rows = [r for r in register if areas and (r[1], r[2]) == areas[0][1:]] or [r for r in register if district and low(r[2]) == low(district)]
    return ("area", *mean(rows)) if rows else ("none", None, None)


def test_cascade_reads_headlines_misspelt_names_and_districts(spark, sf):
    from gleba.functions import text as T

    streets = spark.read.parquet(f"{sf}/streets.parquet")
    a, b = next((x, y) for x in streets.where("name rlike '^[A-Za-z]{6,}straat$'").orderBy("street_id").collect() for y in [streets.where(F.col("district") != x.district).first()])
    slip = a.name[:3] + a.name[4:]
    planted = [(-1, f"hk {a.name} 12 te koop", None, a.ressort, a.district), (-2, f"perceel {a.name} nr. 78", None, None, a.district), (-3, slip, None, None, a.district), (-4, None, f"Bouwkavel {a.name} {a.ressort}", None, None),
               (-5, "zomaar iets", None, None, a.district), (-6, "zomaar iets", None, "Nergens", a.district), (-7, "zomaar iets", None, a.ressort, None), (-8, a.name, None, None, b.district), (-9, "", None, None, None), (-10, slip, "x", "Nergens", "Nergens")]
    rows = spark.createDataFrame(planted, "listing_id long, street string, title string, resort string, district string")
    rows = rows.unionByName(spark.read.parquet(f"{sf}/site_listings.parquet").select(*rows.columns))
    none = F.lit(None).cast("double")
    checked = spark.createDataFrame([], "key string, lat double, lon double, confidence string")
    got = {r.listing_id: r for r in places.cascade(rows.withColumns({"lat": none, "lon": none}), streets, checked, "listing_id").collect()}
    head = T.clean(F.when(T.truthy(F.col("street")), F.col("street")).otherwise(F.col("title")))
    shown = F.when(T.truthy(F.col("street")), F.col("street")).otherwise(F.col("title"))
    asked = rows.withColumns({"normal": T.normalise_street(head), "rest": T.extract_street(head)["rest"], "resort": T.clean(F.col("resort")), "district": T.clean(F.col("district"))})
    asked = asked.withColumns({"heads": places.candidates(shown), "normals": places.candidates(F.col("normal"))}).collect()
    register = [(r.name, r.ressort, r.district, r.lat, r.lon) for r in streets.orderBy("street_id").collect()]
    names = sorted({r[0] for r in register} | {n for r in asked for n in (*r.heads, *r.normals, r.normal)})
    folds = {r.n: (r.f, r.s) for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", places.fold(F.col("n")).alias("f"), places.stem(F.col("n")).alias("s")).collect()}
    assert len(got) == len(asked)
    for r in asked:
        want, found = place_of(r, r.heads, r.normals, r.rest, r.normal, r.resort, r.district, register, folds), got[r.listing_id]
        assert found.geocode_quality == want[0], r
        at = (found.lat, found.lon) if want[0] == "street" else (found.area_lat, found.area_lon)
        assert (found.lat is None) == (want[0] != "street") and (found.area_radius_m == 1500) == (want[0] == "area")
        assert want[1] is None or max(abs(at[0] - want[1]), abs(at[1] - want[2])) < 2e-6, r
    assert [got[i].geocode_quality for i in (-1, -2, -3, -4, -5, -6, -7)] == ["street"] * 4 + ["area"] * 3


def test_run_queries_take_every_delivery(spark, sf):
    import duckdb
    from gleba.plans import listing_queries as Q

    rows = spark.read.parquet(f"{sf}/feed_snapshots.parquet").withColumn("key", item_number(F.col("url"))).select(F.col("snapshot_date").cast("string").alias("day"), "key", F.nanvl("price", F.lit(None).cast("double")).alias("price"), "loaded_at").collect()
    days, last = sorted({r.day for r in rows}), {}
    for r in rows:
        at = (r.loaded_at, r.price is not None, r.price or 0.0)
        if r.key is not None and at >= last.get((r.day, r.key), (at,))[0]:
            last[r.day, r.key] = (at, r.price)
    seen, merged, lost, counts = {}, {}, set(), {}
    for i, day in enumerate(days):
        fresh = {k: p for (d, k), (_, p) in last.items() if d == day}
        state = {k: (p, seen[k][1] if k in seen else day) for k, p in fresh.items()}
        if i:
            out = {(day, k): (p, f, k not in seen, seen[k][0] if k in seen and seen[k][0] and p and seen[k][0] != p else None) for k, (p, f) in state.items()}
            away = {(day, k) for k in seen if k not in fresh}
            merged, lost, counts[day] = merged | out, lost | away, (len(out), sum(x[2] for x in out.values()), len(away))
        seen = state
    two = lambda v: v if v is None else round(v, 2)
    got = Q.run_merge(spark, sf).collect()
    assert {(r.run_date, r.key): (r.price, r.first_seen, r.is_new, r.previous_price) for r in got} == {k: (two(p), f, n, two(b)) for k, (p, f, n, b) in merged.items()} and len(got) == len(merged)
    assert all(r.last_seen == r.run_date for r in got) and len({r.run_date for r in got}) == len(days) - 1
    away = Q.run_gone(spark, sf).collect()
    assert {(r.run_date, r.key) for r in away} == lost and len(away) == len(lost) and not any(r.still_listed for r in away)
    assert {r.run_date: (r.active, r.new_this_run, r.gone_since_last_run) for r in Q.run_counts(spark, sf).collect()} == counts
    con = duckdb.connect()
    con.execute(f"CREATE VIEW feed_snapshots AS SELECT * FROM '{sf}/feed_snapshots.parquet'")
    step = con.execute(f"SELECT run_date, key, first_seen, is_new FROM ({Q.SQL['run_merge']})").fetchall()
    assert sorted(step) == sorted((r.run_date, r.key, r.first_seen, r.is_new) for r in got)


def test_an_advert_that_comes_back_is_new(spark):
    rows = spark.createDataFrame([("1", "a", 1.0), ("2", "a", 2.0), ("4", "a", 3.0), ("1", "b", 1.0), ("3", "b", 5.0), ("4", "b", 6.0)], "run_date string, key string, price double")
    dates = runs.deliveries(spark.createDataFrame([(d,) for d in "12344"] + [(None,)], "run_date string"))
    got = {(r.run_date, r.key): (r.first_seen, r.is_new, r.previous_price) for r in runs.merge_runs(rows, dates).collect()}
    assert got == {("1", "a"): ("1", True, None), ("2", "a"): ("1", False, 1.0), ("4", "a"): ("4", True, None), ("1", "b"): ("1", True, None), ("3", "b"): ("3", True, None), ("4", "b"): ("3", False, 5.0)}
    assert {(r.run_date, r.key) for r in runs.gone_runs(rows, dates).collect()} == {("3", "a"), ("2", "b")}


def test_greedy_leaves_no_advert_undecided(spark):
    import pytest

    chain = spark.createDataFrame([(i, i, "s", f"u{i}", [f"f{i}", f"f{i + 1}"]) for i in range(6)], "id long, ord long, source string, url string, fps array<string>")
    assert dedup.greedy(chain).count() == 6
    with pytest.raises(RuntimeError):
        dedup.greedy(chain, 2)


def test_checked_areas_and_looked_up_roads(spark):
    streets = spark.createDataFrame([(1, "Kerkstraat", "Noord", "Alfa", 5.0, -55.0), (2, "Weytinghweg", "Zuid", "Beta", 5.5, -55.5)], "street_id long, name string, ressort string, district string, lat double, lon double")
    rows = [(1, "Onbekendpad", "Noord", "Alfa"), (2, "Anderpad", "Noord", "Alfa"), (3, "Roodpad", "Noord", "Alfa"), (4, "Groenpad", "Noord", "Alfa"), (5, "Blauwpad", "Noord", "Alfa"), (6, "Kerk", "Noord", "Alfa"), (7, "Weyt", None, "Alfa")]
    none = F.lit(None).cast("double")
    df = spark.createDataFrame(rows, "id long, street string, resort string, district string").withColumns({"title": F.lit(None).cast("string"), "lat": none, "lon": none})
    checked = spark.createDataFrame([("onbekendpad|noord|alfa", 5.1, -55.1, "area", 700), ("anderpad|noord|alfa", 5.1, -55.1, "unknown", None)], "key string, lat double, lon double, confidence string, radius_m int")
    told = spark.createDataFrame([("roodpad|noord|alfa", 5.01, -55.01, "road", "Roodpad, Alfa"), ("groenpad|noord|alfa", 9.0, -50.0, "road", "Groenpad, Alfa"), ("blauwpad|noord|alfa", 5.0, -55.0, "shop", "Alfa")], "key string, lat double, lon double, kind string, shown string")
    got = {r.id: (r.geocode_quality, r.geocode_how, r.lat, r.area_lat, r.area_radius_m) for r in places.cascade(df, streets, checked, "id", answers=told).collect()}
    assert got == {1: ("area", "checked", None, 5.1, 700), 2: ("none", None, None, None, None), 3: ("street", "looked up", 5.01, None, None), 4: ("area", None, None, 5.0, 1500), 5: ("area", None, None, 5.0, 1500), 6: ("street", "containing", 5.0, None, None), 7: ("area", None, None, 5.0, 1500)}


def test_snapshot_as_one_document(spark):
    import json

    df = spark.createDataFrame([(i, f"é{i}", None if i else 1.0) for i in range(6)], "id long, name string, price double")
    got = json.loads(sinks.snapshot_document(df.where("id < 2"), df.where("id >= 2"), spark.range(1).selectExpr("2L as active"), "id", "id", 3).first().value)
    assert got == {"counts": {"active": 2}, "listings": [{"id": 0, "name": "é0", "price": 1.0}, {"id": 1, "name": "é1", "price": None}], "archived": [{"id": i, "name": f"é{i}", "price": None} for i in (2, 3, 4)]}
