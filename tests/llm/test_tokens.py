import base64
import random

import hypothesis.strategies as st
import pytest
import tiktoken
from gleba.llm import pieces as S, tokens as T
from hypothesis import given, settings


@pytest.fixture(scope="module")
def enc():
    return T.Encoder()


@pytest.fixture(scope="module")
def public():
    with open(T.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    return tiktoken.Encoding("own", pat_str=T.PRETOKEN, mergeable_ranks=ranks, special_tokens={})


def test_whole_tables_and_odd_texts(spark, sf, public):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: public.encode_ordinary(r.text) if r.text else [] for r in docs.collect()}
    assert {r.doc_id: r.ids for r in T.encoded(docs).collect()} == want
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (None, "a")], "doc_id long, text string")
    assert {r.doc_id: r.ids for r in T.encoded(df).collect()} == {1: [], 2: [], 3: [220], None: [64]}
    assert T.encoded(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=120))
def test_any_text(enc, public, text):
    text = text.encode("utf-8", "ignore").decode()
    assert enc.encode(text) == public.encode_ordinary(text)


def test_long_runs(enc, public):
    rng = random.Random(1)
    for s in ("a" * 20_000, " " * 9_999, "\n" * 5_000, "".join(rng.choice("abcdefgh") for _ in range(30_000)), "漢é🌴" * 3_000, "0123456789" * 900, "<|endoftext|>"):
        assert enc.encode(s) == public.encode_ordinary(s)


def check(text, limit, overlap, enc):
    cut = S.split(text, limit, overlap, enc=enc)
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    for s, e, n in cut:
        assert s < e and n == enc.count(text[s:e]) <= limit
    for (s, e, _), (s2, e2, _) in zip(cut, cut[1:]):
        assert s < s2 <= e < e2
        assert enc.count(text[s2:e]) <= overlap + 2
    return cut


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["Een zin. ", "Nog een zin, met meer! ", "\n\n", "\r\n", "# Kop\n", "woord ", "漢字", "  ", "<p>x</p>"]), min_size=1, max_size=300))
def test_pieces_cover_and_fit(enc, parts):
    check("".join(parts), 64, 8, enc)


def test_pieces_of_odd_texts(enc):
    for t in ("a" * 30_000, " " * 9_000, "漢" * 5_000, "!?" * 4_000, "".join(map(chr, range(32, 2000))) * 3):
        check(t, 256, 16, enc)
    assert S.split("", enc=enc) == [] and S.split(None, enc=enc) == [] and S.split(" ", enc=enc) == [(0, 1, 1)]


def test_cuts_fall_on_the_strongest_boundary(enc):
    text = "Zin een is hier. " * 30 + "\n\n" + "Zin twee is daar. " * 30
    cut = S.split(text, 250, 20, enc=enc)
    assert any(text[:e].endswith("\n\n") for _, e, _ in cut)
    assert all(text[:e].rstrip().endswith(".") for _, e, _ in cut)


def test_range_maximum():
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.integers(0, 4, 200)
    top = S.RangeMaximum(v, 64)
    for lo in range(0, 190, 7):
        for hi in range(lo, min(200, lo + 64)):
            w = v[lo : hi + 1]
            assert top.top(lo, hi) == lo + max(i for i in range(len(w)) if w[i] == w.max())


def test_pieces_table(spark, enc):
    df = spark.createDataFrame([(1, "kort"), (2, None), (3, ""), (4, "Zin. " * 3000), (5, "Zin. " * 3000)], "doc_id long, text string")
    assert {r.doc_id for r in S.pieces(df).collect()} == {4, 5}
    assert {r.doc_id for r in S.pieces(df, oversized=False).collect()} == {1, 4, 5}
    assert S.pieces(df.limit(0)).count() == 0
