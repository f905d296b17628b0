"""Evaluation texts that leak into training texts: rare n-gram seeds find places, Smith-Waterman alignment judges them.

Both sides are reduced to words: markup, quotation marks at line starts, case, accents, punctuation and spacing fall away. Every ``n`` successive words of
an item are a gram. A passage of ``words`` or more item words with at most a share altered or left out keeps a least number of grams whole (``seed_bound``).

Items are a table, never gathered in one place. What travels to the corpus is a Bloom filter of their grams, of ``MOST_BITS`` bits at most whatever their number.
Every corpus text is read alone and whole, in one pass; only *stretches* in which enough grams stand close together go on. There the seeds decide: a seed
is a gram of an item, and common grams, which many items share, are left out as far as every possible passage still keeps a seed (``rare``). So phrases that
all items share join nothing, and no passage is lost. Stretches and items that share a seed are aligned.

The alignment is Smith-Waterman's with a count in place of a score: from every item word on, the least number of words altered or left out along any path in
a band of diagonals; words put in cost nothing. A passage that is good enough holds one of ``longest`` words or fewer that is, so only so many starts are open at
a time, and every passage is judged, not only the best path's. Passages without left-out words are seen on their diagonal already.

Defined results: null and empty texts and items leak nothing; a run of more than 2 ** 18 letters counts as several words; items shorter than ``words`` words can't leak; the first and the last word of a passage are
unaltered; a text that holds an item twice has it once; repeated texts each have their rows; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleba.session import checkpointed

N, WORDS, SHARE = 6, 25, 0.1
#: A gram that more items than this have is no seed, where the item can do without it.
COMMON = 16
#: Words that may be put into a passage, and the filter's size: bits a gram, at most so many (32 MB).
PUT_IN, BITS_A_GRAM, MOST_BITS = 8, 256, 1 << 28
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_UNSEEN = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"


def unmarked(text: str) -> str:
    """A text without markup."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    return html.unescape(text) if "&" in text else text


#: For each character a random number if it is a letter or digit of a word, in either case, and 0 if it parts words; whether it is an accent or an unseen mark.
_LETTERS, _MARKS = np.zeros(0x1F000, np.uint64), np.zeros(0x1F000, bool)
for _c, _r in zip("abcdefghijklmnopqrstuvwxyz0123456789", np.random.default_rng(20_240_607).integers(1, 2**63, 36, dtype=np.uint64)):
    _LETTERS[ord(_c)] = _LETTERS[ord(_c.upper())] = _r
_MARKS[[c for c in range(len(_MARKS)) if unicodedata.combining(chr(c)) or chr(c) in _UNSEEN]] = True


def _values(text: str) -> np.ndarray:
    if text.isascii():
        return _LETTERS[np.frombuffer(text.encode("ascii"), np.uint8)]
    codes = np.frombuffer(unicodedata.normalize("NFKD", text).encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(codes < len(_LETTERS), codes, 32)
    return _LETTERS[codes[~_MARKS[codes]]]


_BASE, _PIECE = 0x9E3779B97F4A7C15, 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


_UP, _DOWN = _powers(_BASE, _PIECE), _powers(pow(_BASE, -1, 1 << 64), _PIECE)


def hashed(text: str | None) -> np.ndarray:
    """64 bits a word (a run of letters and digits, in any case and with any accents), the same in every process, by sums over the whole text at once."""
    out, left = [], np.zeros(0, np.uint64)
    values = _values(unmarked(text or ""))
    at = 0
    while at < len(values):  # in pieces, so that memory and powers are bounded; a word that the end of a piece cuts is carried over
        part = np.concatenate([left, values[at : at + _PIECE - len(left)]])
        at += _PIECE - len(left)
        is_word = part != 0
        left = np.zeros(0, np.uint64)
        if at < len(values) and is_word[-1]:
            stop = int(np.flatnonzero(~is_word)[-1]) + 1 if not is_word.all() else 0
            if stop:
                left, part, is_word = part[stop:], part[:stop], is_word[:stop]
        edge = np.diff(np.concatenate([[False], is_word, [False]]).astype(np.int8))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _UP[: len(part)], dtype=np.uint64)])
        h = (sums[b] - sums[a]) * _DOWN[np.minimum(a, len(_DOWN) - 1)]
        out.append(h ^ (h >> np.uint64(31)) | np.uint64(1))
    return np.concatenate(out) if out else left


def grams(h: np.ndarray, n: int = N) -> np.ndarray:
    """A hash of each n successive words."""
    k = max(0, len(h) - n + 1)
    out = np.zeros(k, np.uint64)
    for i in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : i + k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


# ---------------------------------------------------------------- bounds


def longest(words: int = WORDS, share: float = SHARE) -> int:
    """Any passage that qualifies holds one of at most so many item words: of a longer one's halves one qualifies, less the altered words at its ends."""
    return int(2 * words / (1 - share)) + 2


def whole(length: int, n: int = N, share: float = SHARE) -> int:
    """The least number of whole grams in a passage of so many item words: each word altered or left out spoils at most n."""
    return length - n + 1 - n * int(share * length + 1e-9)


def seed_bound(n: int = N, words: int = WORDS, share: float = SHARE) -> int:
    return max(1, min(whole(length, n, share) for length in range(words, longest(words, share) + 1)))


def rare(counts: np.ndarray, n: int = N, words: int = WORDS, share: float = SHARE, common: int = COMMON) -> np.ndarray:
    """Which of an item's grams are its seeds. counts: how many items have each gram. The commonest are left out first, none that ``common`` items or fewer have, and none
    where a passage of the words around it could then lose all its seeds."""
    keep = np.ones(len(counts), bool)
    limits = [(length - n + 1, whole(length, n, share) - 1) for length in range(words, longest(words, share) + 1)]
    if min(most for _, most in limits) <= 0:
        return keep
    for p in sorted(np.flatnonzero(counts > common), key=lambda i: (-counts[i], i)):
        keep[p] = False
        for width, most in limits:
            lo = max(0, p - width + 1)
            left = np.cumsum(np.concatenate([[0], ~keep[lo : p + width]]))
            if (left[min(width, len(left) - 1) :] - left[: len(left) - min(width, len(left) - 1)]).max() > most:
                keep[p] = True
                break
    return keep


def needed(keep: np.ndarray, g: np.ndarray, n: int = N, words: int = WORDS, share: float = SHARE) -> int:
    """How many different seeds a passage of the item shares with any text at least: the bound, less what a stretch of the longest passage may hold of grams that
    are no seeds or that the item has twice."""
    again = np.ones(len(g), bool)
    again[np.unique(g, return_index=True)[1]] = False
    width = longest(words, share) - n + 1
    lost = np.cumsum(np.concatenate([[0], ~keep | again]))
    width = min(width, len(g))
    return max(1, seed_bound(n, words, share) - int((lost[width:] - lost[: len(lost) - width]).max()))


# ---------------------------------------------------------------- one text


class Bloom:
    """A filter of hashes with two probes; never false of one that is in it."""

    def __init__(self, bits: int, parts: dict[int, bytes] | None = None, part: int = 1 << 16):
        self.mask, self.bytes = np.uint64(bits - 1), np.zeros(bits >> 3, np.uint8)
        for i, b in (parts or {}).items():
            self.bytes[i * part : i * part + len(b)] |= np.frombuffer(b, np.uint8)

    def places(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return g & self.mask, (g >> np.uint64(32)) & self.mask

    def add(self, g: np.ndarray) -> None:
        for at in self.places(g):
            np.bitwise_or.at(self.bytes, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8), dtype=np.uint8))

    def has(self, g: np.ndarray) -> np.ndarray:
        a, b = self.places(g)
        hit = (self.bytes[(a >> np.uint64(3)).astype(np.int64)] >> (a & np.uint64(7)).astype(np.uint8)) & 1
        at = np.flatnonzero(hit)
        b = b[at]
        out = np.zeros(len(g), bool)
        out[at] = (self.bytes[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1
        return out


def stretches(h: np.ndarray, bloom: Bloom, n: int = N, words: int = WORDS, share: float = SHARE) -> list[tuple[int, int, np.ndarray]]:
    """(start, end, grams hit) of the stretches of a text in which enough grams of items stand close enough for a passage; what a passage could reach around them is in."""
    reach, bound = longest(words, share) + PUT_IN, seed_bound(n, words, share)
    g = grams(h, n)
    at = np.flatnonzero(bloom.has(g)) if len(g) else g
    if len(at) < bound:
        return []
    near = np.flatnonzero(at[bound - 1 :] - at[: len(at) - bound + 1] < reach)
    out: list[tuple[int, int, np.ndarray]] = []
    for i in near:
        a, b = max(0, int(at[i]) - reach), min(len(h), int(at[i + bound - 1]) + n + reach)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), None)
        else:
            out.append((a, b, None))
    return [(a, b, g[at[(at >= a) & (at <= b - n)]]) for a, b, _ in out]


def qualifies(same: np.ndarray, words: int = WORDS, share: float = SHARE) -> bool:
    """Whether some run of ``words`` or more, its ends the same, has at most a share that isn't the same."""
    m = len(same)
    if m < words:
        return False
    over = np.concatenate([[0.0], np.cumsum(np.where(same, -share, 1 - share))])
    # a run i .. j qualifies if over[j] <= over[i]; the best start is the largest over so far, at a word that is the same
    largest = np.maximum.accumulate(np.where(same, over[:-1], -np.inf)[: m - words + 1])
    return bool(((over[words:] <= largest + 1e-9) & same[words - 1 :]).any())


def holds(text: np.ndarray, item: np.ndarray, n: int = N, words: int = WORDS, share: float = SHARE) -> bool:
    """Whether a text (hashed words) holds a passage of an item."""
    a, b = grams(text, n), grams(item, n)
    if not len(a) or len(item) < words:
        return False
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return False
    places = np.repeat(hit, hi[hit] - lo[hit])
    diagonals = places - np.concatenate([order[lo[j] : hi[j]] for j in hit])
    if len(hit) < seed_bound(n, words, share):
        return False
    for d in np.unique(diagonals):
        first, last = max(0, -d), min(len(item), len(text) - d)
        if qualifies(text[first + d : last + d] == item[first:last], words, share):
            return True
    slack = PUT_IN
    ds, bands = np.unique(diagonals), []
    for d in ds:
        if bands and d - bands[-1][1] <= slack and d - bands[-1][0] <= 4 * slack:
            bands[-1][1] = d
        else:
            bands.append([d, d])
    return any(_aligned(text, item, int(lo) - slack, int(hi) + slack, words, share) for lo, hi in bands)


def _aligned(text: np.ndarray, item: np.ndarray, low: int, high: int, words: int, share: float) -> bool:
    """Local alignment on the diagonals low .. high, from every item word that is there on: the least number of words altered or left out."""
    width, m, open_ = high - low + 1, len(item), longest(words, share)
    padded = np.zeros(width + m, np.uint64)  # no word's hash is 0
    a, b = max(0, low), min(len(text), low + width + m)
    if b > a:
        padded[a - low : b - low] = text[a:b]
    # costs in thousandths of a word; a word put in costs one
    ramp = np.arange(width, dtype=np.int16)
    cost = np.full((open_, width), 20_000, np.int16)  # row k: the start at item word i - 1 - k
    enough = (1000 * np.floor(share * np.arange(2, open_ + 1) + 1e-9) + 500).astype(np.int16)[words - 2 :, None]
    every = padded[np.arange(m)[:, None] + np.arange(width)] == item[:, None]
    moved, beside = np.empty_like(cost), np.empty((open_, width - 1), np.int16)
    for i in range(m):
        same = every[i]
        # rows of the starts with words or more item words that end here
        if same.any() and i >= words - 1 and (cost[words - 2 : -1][:, same] <= enough).any():
            return True
        np.add(cost, np.where(same, 0, 1000).astype(np.int16), out=moved)
        np.add(cost[:, 1:], 1000, out=beside)
        np.minimum(moved[:, :-1], beside, out=moved[:, :-1])
        moved -= ramp
        np.minimum.accumulate(moved, axis=1, out=moved)
        moved += ramp
        np.minimum(moved[:-1], 20_000, out=cost[1:])
        cost[0] = np.where(same, 0, 20_000)
    return False


class Items:
    """A few items in one process: the reference of ``leaks``."""

    def __init__(self, rows, n: int = N, words: int = WORDS, share: float = SHARE):
        self.n, self.words, self.share = n, words, share
        self.items = [(item, h) for item, text in rows if len(h := hashed(text)) >= words]
        counts: dict = defaultdict(int)
        for _, h in self.items:
            for g in set(grams(h, n).tolist()):
                counts[g] += 1
        self.bloom = Bloom(1 << 20)
        self.seeds: dict = defaultdict(set)
        self.need: list = []
        for k, (_, h) in enumerate(self.items):
            g = grams(h, n)
            self.bloom.add(g)
            keep = rare(np.array([counts[x] for x in g.tolist()]), n, words, share)
            self.need.append(needed(keep, g, n, words, share))
            for x in g[keep].tolist():
                self.seeds[x].add(k)

    def leaked(self, text: str | None) -> list:
        """The items that leak into a text."""
        h, out = hashed(text), set()
        for a, b, hit in stretches(h, self.bloom, self.n, self.words, self.share):
            shared = Counter(k for x in set(hit.tolist()) for k in self.seeds.get(x, ()))
            for k, n in shared.items():
                if n >= self.need[k] and holds(h[a:b], self.items[k][1], self.n, self.words, self.share):
                    out.add(self.items[k][0])
        return sorted(out)

    def qualifies(self, same: np.ndarray) -> bool:
        return qualifies(same, self.words, self.share)


# ---------------------------------------------------------------- tables


def _bloom_of(all_grams: DataFrame, bits: int | None, part: int = 1 << 16) -> Bloom:
    """The filter of the grams in column g, put together from parts; MOST_BITS bounds what comes to the driver."""
    if bits is None:
        bits = 1 << int(np.clip(int(np.ceil(np.log2(max(1, all_grams.count()) * BITS_A_GRAM))), 10, np.log2(MOST_BITS)))
    mask = F.lit(bits - 1)
    at = all_grams.select(F.explode(F.array(F.col("g").bitwiseAND(mask), F.shiftrightunsigned("g", 32).bitwiseAND(mask))).alias("at")).distinct()
    at = at.select(F.expr(f"at div {8 * part}").alias("i"), (F.col("at") % (8 * part)).alias("k"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(min(part, bits >> 3), np.uint8)
        k = pdf["k"].to_numpy()
        np.bitwise_or.at(out, k >> 3, np.left_shift(1, k & 7).astype(np.uint8))
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "b": [out.tobytes()]})

    return Bloom(bits, {r.i: r.b for r in at.groupBy("i").applyInPandas(one, "i long, b binary").collect()}, part)


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", n: int = N, words: int = WORDS, share: float = SHARE, bits: int | None = None) -> DataFrame:
    """(doc_id, item_id): the items of which each text holds a passage. bits: of the filter, a power of two; worked out from the number of grams if None."""
    doc_kind, item_kind = (x.schema[c].dataType.simpleString() for x, c in ((documents, doc_id), (items, item_id)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, i, h.view(np.int64), grams(h, n).view(np.int64)) for k, i, t in zip(pdf["k"], pdf["i"], pdf["t"]) if len(h := hashed(t)) >= words]
            yield pd.DataFrame(out, columns=["k", "item", "words", "grams"])

    table = items.where(F.col(item_id).isNotNull() & F.col("text").isNotNull()).select(F.monotonically_increasing_id().alias("k"), F.col(item_id).alias("i"), F.col("text").alias("t"))
    table = checkpointed(table.mapInPandas(read, f"k long, item {item_kind}, words array<long>, grams array<long>"))
    each = table.select("k", F.posexplode("grams").alias("pos", "g"))
    bloom = documents.sparkSession.sparkContext.broadcast(_bloom_of(each.select("g").distinct(), bits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, starts, docs, texts, hit = [], [], [], [], []
            for j in range(batch.num_rows):
                h = hashed(batch.column(2)[j].as_py())
                for a, b, g in stretches(h, bloom.value, n, words, share):
                    rids.append(batch.column(0)[j].as_py())
                    docs.append(j)
                    starts.append(a)
                    texts.append(h[a:b].view(np.int64))
                    hit.append(np.unique(g).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(starts, pa.int32()), batch.column(1).take(pa.array(docs, pa.int32())), pa.array(texts, longs), pa.array(hit, longs)], names=["rid", "start", "doc", "text", "hits"])

    rows = documents.where(F.col("text").isNotNull()).select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id), F.col("text"))
    found = checkpointed(rows.mapInArrow(scan, f"rid long, start int, doc {doc_kind}, text array<long>, hits array<long>"))

    common = each.select("g", "k").distinct().groupBy("g").agg(F.count("*").alias("items")).where("items > 1")
    listed = each.join(common, "g", "left").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "g", F.coalesce("items", F.lit(1)).alias("items")))).alias("x"))  # no longer than an item

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, xs in zip(pdf["k"], pdf["x"]):
                g, keep = np.array([x["g"] for x in xs], np.int64), rare(np.array([x["items"] for x in xs]), n, words, share)
                need = needed(keep, g, n, words, share)
                out += [(k, x, need) for x in set(g[keep].tolist())]
            yield pd.DataFrame(out, columns=["k", "g", "need"])

    seeds = listed.mapInPandas(choose, "k long, g long, need int")
    pairs = found.select("rid", "start", F.explode("hits").alias("g")).join(seeds, "g").groupBy("rid", "start", "k").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").drop("n", "need")
    pairs = pairs.join(found.select("rid", "start", "doc", "text"), ["rid", "start"]).join(table.select("k", "item", "words"), "k").select("rid", "doc", "item", "text", "words")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [holds(np.asarray(t, np.int64).view(np.uint64), np.asarray(w, np.int64).view(np.uint64), n, words, share) for t, w in zip(pdf["text"], pdf["words"])]
            yield pdf.loc[ok, ["rid", "doc", "item"]]

    judged = pairs.mapInPandas(judge, f"rid long, doc {doc_kind}, item {item_kind}").distinct()
    return judged.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id))
