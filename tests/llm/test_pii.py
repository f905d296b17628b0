import hypothesis.strategies as st
import pytest
from gleba.llm import pii as P
from hypothesis import given, settings

KEY = b"k" * 32


def found(text):
    return [(k, v) for _, _, k, v in P.find_personal(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Bel 918-6367 voor info.", [("phone", "9186367")]), ("whatsapp +597-946-86-26!!", [("phone", "9468626")]), ("Tel: 9 2 3 7 0 7 2 Goed", [("phone", "9237072")]), ("Info op (597) 974 1338.", [("phone", "9741338")]), ("Bel 00597-9542063 en 92 65 003", [("phone", "9542063"), ("phone", "9265003")]), ("Call 0000000 now", []), ("Tel: 475-544.", [("phone", "475544")]),
        ("Objectnr. 8043945. Kadasterkaart nr. 19606. GLIS-dossier B588-5868. Ref 666228/79. Perceelkaart d.d. 15-2-2011. Nu 14.500 499 m2. Grootte 16228.9 m2.", []),
        ("Mail: <Asha.Rima@firma.example> graag", [("email", "asha.rima@firma.example")]), ("aan ruwan-grond [at] firma punt example met", [("email", "ruwan-grond@firma.example")]), ("k_lo(at)garal.example voor", [("email", "k_lo@garal.example")]), ("mail feroz.ju @ tato.example met", [("email", "feroz.ju@tato.example")]), ("mailto:X@Y.EXAMPLE.", [("email", "x@y.example")]),
        ("Volmacht op ID HT 297 492.", [("id", "HT297492")]), ("ID-nr. fl-573213 is op naam", [("id", "FL573213")]), ("partij AB 123456 hout", []),
        ("Mijn adres is Wanplosenmaboestr. 167b. Bezichtiging", [("address", "Wanplosenmaboestr. 167b")]), ("Ik woon op Renveroedasoeln 102, kom", [("address", "Renveroedasoeln 102")]), ("Sleutel ophalen: X-weg no. 18A.", [("address", "X-weg no. 18A")]), ("Kantoor: Grote Kerkstraat 12, Noord", [("address", "Grote Kerkstraat 12")]), ("Tweede zijstraat links vanaf de Kerkweg. 423 m² groot. Op 12 min van de Kerkweg.", []),
        ("Vraag naar RAVINDRA NARAL.", [("name", "RAVINDRA NARAL")]), ("Eigenaar is dhr. M.A. Jusol.", [("name", "M.A. Jusol")]), ("U kunt mevr. sunita laka bereiken.", [("name", "sunita laka")]), ("U kunt mevr. Roslien bereiken.", [("name", "Roslien")]), ("Contactpersoon: Asha E-mail x", [("name", "Asha")]), ("Contactpersoon: Soeraya Ruilen met een auto", [("name", "Soeraya")]), ("Contactpersoon: Soeraya Lakan-Tona Hoekkavel met", [("name", "Soeraya Lakan-Tona")]), ("hoek. Glenda Rita heeft de sleutel", [("name", "Glenda Rita")]),
        ("Bel Asha Rita op 918-6367.", [("phone", "9186367"), ("name", "Asha Rita")]), ("Ruwan, 980/3667 (geen sms)", [("phone", "9803667"), ("name", "Ruwan")]), ("Aangeboden door Noord Vastgoed. Verkoop namens Makelaardij Baral. Zie www.firma.example", []), ("Bezichtiging alleen (lees meer)", []), ("", []), ("geb. 1-2-1980", [("birth", "1980-02-01")]),
    ],
)
def test_finds(text, want):
    assert sorted(found(text)) == sorted(want)


@pytest.mark.parametrize(("text", "want"), [("943.3741 / jugo.25@taba.example", [("email", "jugo.25@taba.example")]), ("941/0809 vragen naar Ravindra Mado", [("name", "Ravindra Mado")]), ("Asha Trofe: +597 933-0585", [("name", "Asha Trofe")]), ("931-1788 (O. Belo)", [("name", "O. Belo")]), ("zie tekst", []), ("bel na 17u", []), ("+5979166719", [])])
def test_finds_in_phones(text, want):
    assert [(k, v) for _, _, k, v in P.find_in_phones(text)] == want


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**7 - 1), st.integers(1, 12))
def test_feistel_is_a_permutation_within_its_format(n, digits):
    n %= 10**digits
    y = P.feistel(n, 10**digits, KEY, b"t")
    assert 0 <= y < 10**digits and P.feistel(y, 10**digits, KEY, b"t", back=True) == n


def test_small_formats_map_onto_themselves():
    for size in (1, 2, 3, 7, 100, 676):
        assert sorted(P.feistel(i, size, KEY, b"t") for i in range(size)) == list(range(size))


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_any_text_is_read_and_kept(text):
    finds = P.find_personal(text)
    assert all(a < b for a, b, _, _ in finds) and all(x[1] <= y[0] for x, y in zip(finds, finds[1:]))
    if not finds:
        assert P.redact(text, KEY) == text


def test_tables(spark):
    rows = [(1, "Bel 918-6367. Bel 9186367.", ["Asha: 918-6367", None], "clash"), (2, None, None, "x"), (3, "", [], "x"), (4, "Bel +597 918-6367", ["zie tekst"], "x"), (5, "woord " * 50_000 + "Bel 918-6367.", None, "x")]
    df = spark.createDataFrame(rows, "record_id long, description string, phones array<string>, d string")
    got = sorted(tuple(r) for r in P.personal_finds(df).collect())
    assert got == [(1, "description", "phone", "9186367"), (1, "phones", "name", "Asha"), (4, "description", "phone", "9186367"), (5, "description", "phone", "9186367")]
    out = {r.record_id: r for r in P.pseudonymised(df, "secret").collect()}
    assert len(out) == 5 and out[2].description is None and out[3].description == "" and out[3].phones == [] and out[1].phones[1] is None
    tag = out[4].description.removeprefix("Bel ")
    assert tag.startswith("[phone ") and out[1].description == f"Bel {tag}. Bel {tag}." and "9186367" not in tag and out[1].phones[0].count("[") == 2
    assert P.personal_finds(df.limit(0)).count() == 0


def test_no_text_with_a_find_is_passed_over(spark):
    texts = ["a@b.c", "Oom Johan Pinas bellen.", "Zus Asha Rita bellen.", "918-6367", "ID AB123456", "Man Asha bellen", "Bel A.B. Rita op +597 918-6367", "x", " ", "5"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "record_id long, description string, phones array<string>")
    got = {(r.record_id, r.kind, r.found) for r in P.personal_finds(df).collect()}
    assert got == {(i, k, v) for i, t in enumerate(texts) for _, _, k, v in P.find_personal(t)} and {(0, "email", "a@b.c"), (1, "name", "Johan Pinas"), (2, "name", "Asha Rita")} <= got


def test_no_key_is_known_beforehand(spark):
    from gleba.llm import queries as Q

    assert len(Q.pseudonym_key(spark)) >= 32
    spark.conf.set("gleba.pseudonym.key", "ours")
    try:
        assert Q.pseudonym_key(spark) == "ours"
    finally:
        spark.conf.unset("gleba.pseudonym.key")
