import pytest
from gleba.sources import feeds, html
from gleba.sources.rest import PagedHttp
from gleba.sources.sites import Site, site_cards

CARD = '<div class="object"><a href="/p/{0}">x</a><span class="title">Kavel {0}</span><b class="prijs">EUR 1{0}.000</b><i class="perceel">500 m2</i></div>'


def write(tmp_path, **pages):
    for name, body in pages.items():
        (tmp_path / name).write_text(body)
    return f"file://{tmp_path}"


def urls(spark, **options):
    spark.dataSource.register(PagedHttp)
    return [(r.url.rsplit("/", 1)[-1], r.status) for r in sorted(spark.read.format("paged_http").options(delay="0", tries="1", **options).load().collect(), key=lambda r: r.page)]


def test_numbers_end_at_a_missing_page_or_where_nothing_is_fresh(spark, tmp_path):
    root = write(tmp_path, p1='<a href="1">', p2='<a href="2">', p4='<a href="4">', q1='<a href="1">', q2='<a href="1">', q3='<a href="1">', q4='<a href="5">')
    assert urls(spark, urls=root + "/p{page}", paging="number") == [("p1", 200), ("p2", 200), ("p3", 404)]
    assert urls(spark, urls=root + "/q{page}", paging="number") == [("q1", 200), ("q2", 200), ("q3", 200)]
    assert urls(spark, urls=root + "/q{page}", paging="number", most="2") == [("q1", 200), ("q2", 200)]


def test_links_and_offsets(spark, tmp_path):
    root = write(tmp_path, a='<a href="1"><a class="next" rel="next" href="b">', b='<a href="2"><a rel="next" href="c">', c='<a href="3"><a rel="next" href="a">', o0='{"x":[{"n":1},{"n":2}]}', o2='{"x":[{"n":3}]}', o4='{"x":[]}')
    assert urls(spark, urls=root + "/a", paging="next") == [("a", 200), ("b", 200), ("c", 200)]
    assert urls(spark, urls=root + "/o{offset}", paging="offset", step="2", items='"n":') == [("o0", 200), ("o2", 200)]
    with pytest.raises(Exception, match="paging"):
        urls(spark, urls=root, paging="sideways")


def test_sites_as_rows(spark, tmp_path):
    root = write(tmp_path, p1=CARD.format(1) + CARD.format(2), p2=CARD.format(2) + CARD.format(3), z1=CARD.format(7))
    sites = [Site("one", root + "/p{page}", "object", "number", "https://one.example/"), Site("two", root + "/z1", "object", "none", "https://two.example/")]
    got = {(r.source, r.url, r.page, r.price.amount, r.size_m2) for r in site_cards(spark, sites, delay="0", tries="1").collect()}
    assert got == {("one", f"https://one.example/p/{i}", int(i == 3), 10_000.0 + 1000 * i, 500.0) for i in (1, 2, 3)} | {("two", "https://two.example/p/7", 0, 17_000.0, 500.0)}


def test_equal_blocks_deep_nesting_and_broken_pages(spark):
    card = '<div class="card"><div class="badge">Nieuw</div><a href="/{0}">Kavel {0} te koop</a> EUR 1{0}.000</div>'
    page = "<div>" * 5000 + "".join(card.format(i) for i in range(3)) + "</div>" * 5000
    assert [c["url"] for c in html.cards_of(page, html.LAYOUTS["generic"])] == ["/0", "/1", "/2"]
    assert len(html.parse(page).select("div.badge")) == 3 and html.parse(page).first("div.card a").text() == "Kavel 0 te koop"
    wrapped = '<div class="wrap">' + card.format(1) + '</div><div class="wrap">' + card.format(2) + card.format(3) + "</div>"
    assert [n.attrs["class"] for n in html.repeated_blocks(html.parse(wrapped))] == ["card"] * 3
    df = spark.createDataFrame([(1, "<![x" + card.format(1)), (2, None), (3, ""), (4, '<div class="object"><a href="http://[x/">a</a></div>' + CARD.format(4))], "page_id long, html string")
    assert [(r.page_id, r.url) for r in html.cards(df, html.LAYOUTS["object"], "o").collect()] == [(4, "/p/4")]
    row = html.cards_of('<div class="wpv-block-loop-item"><a href="https://x.example/kavel-aan-de-weg/">zie</a></div><div class="object"><a href="/y">y</a><b class="objectnummer">#12</b></div>', html.LAYOUTS["loop"])
    assert row[0]["title"] == "Kavel Aan De Weg"
    assert html.cards_of('<div class="object"><a href="/y">y</a><b class="objectnummer"># 12</b></div>', html.LAYOUTS["object"])[0]["number"] == "12"
    assert [c["url"] for c in html.cards_of('<article><a href="/a">a</a> Mooi perceel op goede stand</article><article><a href="/b">b</a> Huis met tuin en garage te huur</article>', html.LAYOUTS["land"])] == ["/a"]


def test_a_source_that_fails_while_read_gives_no_rows(spark):
    from pyspark.sql import functions as F

    bad = lambda: spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    assert {(r.source, r.id) for r in feeds.union_of({"good": lambda: spark.range(2), "bad": bad}).collect()} == {("good", 0), ("good", 1)}
    with pytest.raises(ZeroDivisionError):
        feeds.union_of({"bug": lambda: 1 / 0})
