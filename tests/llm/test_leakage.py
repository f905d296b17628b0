import random
import re
import unicodedata

import numpy as np
from gleba.llm import leakage as L

RNG = random.Random(0)
VOCAB = ["".join(RNG.choice("bdfgklmnprstvz") + RNG.choice("aeiou") for _ in range(RNG.randrange(2, 5))) for _ in range(400)]


def words(n):
    return [RNG.choice(VOCAB) for _ in range(n)]


def brute(item, doc):
    """Whether 25 or more item words, the first and last of them unaltered, stand in doc with at most a tenth altered or left out: every item window."""
    m, n = len(item), len(doc)
    for i in range(m - 24):
        for length in range(25, m - i + 1):
            w, k = item[i : i + length], int(0.1 * length)
            last = [0] * (n + 1)  # cost of aligning a prefix of w to a stretch that ends here; words put in cost a fraction
            for a, x in enumerate(w, 1):
                edge = 99 if a in (1, length) else 1
                row = [last[0] + edge] + [0] * n
                for j in range(1, n + 1):
                    row[j] = min(last[j - 1] + edge * (x != doc[j - 1]), last[j] + edge, row[j - 1] + 0.5)
                last = row
            if min(last) <= k:
                return True
    return False


def alter(ws, share):
    return [RNG.choice(VOCAB) if RNG.random() < share else w for w in ws if RNG.random() >= share / 4]


def test_against_brute_force():
    items = [(i, " ".join(words(60))) for i in range(4)]
    chunk = L.Items(items)
    for _ in range(25):
        i, n = RNG.randrange(4), RNG.choice([12, 20, 24, 25, 30, 45])
        at = RNG.randrange(60 - n)
        passage = items[i][1].split()[at : at + n]
        if RNG.random() < 0.5:
            passage = alter(passage, 0.06)
        doc = words(20) + passage + words(20)
        want = [k for k, t in items if brute(t.split(), doc)]
        assert chunk.leaked(" ".join(doc)) == want, (n, len(passage))


def test_seed_bound_holds():
    n, length = L.N, 25
    for length in range(25, 120):
        for _ in range(60):
            bad = set(RNG.sample(range(length), int(0.1 * length)))
            assert sum(not bad & set(range(i, i + n)) for i in range(length - n + 1)) >= L.seed_bound()


def test_marks_and_markup():
    item = words(40)
    text = " ".join(item)
    chunk = L.Items([(7, text)])
    forms = [text.upper(), "> " + "\n> ".join(" ".join(item[i : i + 5]) for i in range(0, 40, 5)), "<p>" + "</p><p class='x'>".join(item) + "</p>", "  ".join(w.replace("a", "á") for w in item), ", ".join(item), " ".join(item[:20]) + " " + item[20][:3] + "-\n" + item[20][3:] + " " + " ".join(item[21:])]
    for f in forms:
        assert chunk.leaked("Iets vooraf. " + f + " En iets erna.") == [7], f[:80]
    assert chunk.leaked(" ".join(item[:24])) == [] and chunk.leaked(None) == [] and chunk.leaked("") == []
    assert chunk.leaked(" ".join(item * 30)) == [7]


def test_tables(spark):
    items = [(i, " ".join(words(50))) for i in range(7)] + [(8, None), (9, "kort")]
    docs = [(1, items[0][1] + " x " + items[3][1]), (2, items[0][1]), (2, items[0][1]), (3, None), (4, ""), (5, "woord " * 100_000)]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for bits in (None, 1 << 6):  # so small a filter lets everything through
        assert sorted(tuple(r) for r in L.leaks(d, e, bits=bits).collect()) == [(1, 0), (1, 3), (2, 0), (2, 0)]
    assert L.leaks(d.limit(0), e).count() == 0 and L.leaks(d, e.limit(0)).count() == 0


def test_qualifies():
    same = np.ones(30, dtype=bool)
    q = L.Items([]).qualifies
    same[[3, 13, 23]] = False
    assert q(same)  # three of thirty
    assert not q(same[:25]) or same[:25].sum() >= 22.5
    assert not q(np.ones(24, dtype=bool))


def test_every_passage_is_judged():
    """A good passage leaks whatever stands behind it, even a longer, worse one that aligns better."""
    item = words(90)
    spoilt = [RNG.choice(VOCAB) if i % 9 in (3, 6) else w for i, w in enumerate(item[10:90])]
    chunk = L.Items([(1, " ".join(item))])
    assert chunk.leaked(" ".join(spoilt)) == []
    assert chunk.leaked(" ".join(item[:30] + words(3) + spoilt)) == [1] == chunk.leaked(" ".join(spoilt + item[:30]))
    assert chunk.leaked(" ".join(item[:30] + spoilt[20:])) == [1] and chunk.leaked(" ".join(item[40:70])) == [1]


def test_words_left_out_and_put_in():
    item = words(60)
    chunk = L.Items([(1, " ".join(item))])
    assert chunk.leaked(" ".join(item[5:15] + item[16:36])) == [1]
    assert chunk.leaked(" ".join(item[5:17] + ["zz"] + item[17:36])) == [1]
    assert chunk.leaked(" ".join(item[5:15] + item[16:22] + item[23:27] + item[28:34] + item[35:40])) == []  # four of 35 left out
    assert chunk.leaked(" ".join(item[5:28])) == [] and chunk.leaked(" ".join(["zz", *item[5:28], "zz"])) == []


def test_short_words_and_long_tags():
    item = [a for a in "abcdefghijklmnopqrstuvwxyz"][:25]
    chunk = L.Items([(1, " ".join(item))])
    assert len(" ".join(item)) == 49 and chunk.leaked(" ".join(item)) == [1] and chunk.leaked(".".join(item[:8] + item[9:])) == [1]
    long = words(30)
    tag = "<a href='" + "x y " * 200 + "'>"
    assert L.Items([(2, " ".join(long))]).leaked((" " + tag + " ").join(long)) == [2]


def test_common_phrases_are_no_seeds_and_no_passage_loses_all():
    rng = random.Random(9)
    for _ in range(30):
        m = rng.randrange(20, 120)
        counts = np.array([rng.choice([1, 1, 2, 50]) for _ in range(m)])
        keep = L.rare(counts)
        assert keep[counts < 50].all()
        for length in range(L.WORDS, L.longest() + 1):
            width = length - L.N + 1
            for a in range(m - width + 1):
                assert (~keep[a : a + width]).sum() < L.whole(length)
    phrase = words(9)
    items = [(i, " ".join(words(20) + phrase + words(20))) for i in range(40)]
    chunk = L.Items(items)
    assert all(not chunk.seeds.get(g) for g in L.grams(L.hashed(" ".join(phrase))).tolist())
    assert chunk.leaked(items[7][1]) == [7] and chunk.leaked(" ".join(phrase)) == []


def test_bloom_has_what_was_added():
    g = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    bloom = L.Bloom(1 << 16)
    bloom.add(g[:2500])
    assert bloom.has(g[:2500]).all() and bloom.has(g[2500:]).mean() < 0.05 and not len(bloom.has(g[:0]))


def test_hashes_of_words():
    rng = random.Random(4)
    texts = ["", " ", "a", "Één twee; TWEE 3drie", "x" * 200_000 + " y" * 100_000, "ab cd " * 100_000, "  ".join(words(70_000)), "<b>één</b>&amp;\u00ad twee"]
    plain = ["".join(rng.choice("ab 1É.-") for _ in range(rng.randrange(30))) for _ in range(300)]
    known: dict = {}
    for t in [*texts, *plain]:
        bare = unicodedata.normalize("NFKD", L.unmarked(t).replace("\u00ad", ""))
        want = re.findall("[a-z0-9]+", "".join(c for c in bare if not unicodedata.combining(c)).lower())
        got = L.hashed(t).tolist()
        assert len(got) == len(want) and all(got) and all(known.setdefault(w, g) == g for w, g in zip(want, got))
    assert len(set(known.values())) == len(known)
