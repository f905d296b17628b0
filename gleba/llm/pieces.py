"""Splitting oversized texts at natural boundaries, by a range-maximum index over boundary strengths.

Every gap between pretokens has a strength: 5 before a section (a heading or a rule), 4 between paragraphs, 3 between lines, 2 after a sentence, 1 after
a comma or the like, 0 elsewhere. A sparse table answers "the strongest gap in this window, the rightmost of equals" in constant time. A piece ends at the
strongest gap in the window of permissible lengths, from ``least`` of the limit to the limit; the next piece begins at the strongest gap of the last
``overlap`` tokens, so it repeats no more than that. The table has only the levels that the window needs, so its size is linear in the text.

A pretoken longer than the limit (a run of one kind of character) is itself cut between characters, at the limit.

Defined results: null, empty and blank texts are one piece if they have a token and none if not; a text at or under the limit is one piece; pieces cover
the text from its first to its last character; every piece, encoded alone, has at most ``limit`` tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gleba.llm.tokens import VOCABULARY, Encoder, encoder, may_exceed

LIMIT, OVERLAP, LEAST = 2048, 64, 0.5
_SECTION = re.compile(r"(?:^|\n)[ \t]*(?=#{1,6}\s|={3,}|-{3,}|\*{3,}|(?:hoofdstuk|artikel|paragraaf|chapter|section|deel)\s+\w+|\d+(?:\.\d+)*\.?\s+[^\n]{1,80}\n|<(?:h[1-6]|section|article|hr)\b)", re.I)
_HEADING_CAPS = re.compile(r"\n[ \t]*(?=[A-Z][A-Z \d'&-]{5,80}\r?\n)")


def strengths(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """The strength of the gap before each pretoken, and of the end of the text."""
    out = np.zeros(len(spans) + 1, dtype=np.int8)
    sections = {m.end() for pattern in (_SECTION, _HEADING_CAPS) for m in pattern.finditer(text)}
    marks = {a - 1 for a in sections} | sections  # a pretoken may carry the blank before it
    for i, (a, _, _) in enumerate(spans):
        if not i or (text[a - 1].isalnum() and a not in marks):
            continue  # inside a word, or between two words: no boundary
        here, before = text[a], text[max(0, a - 6) : a]
        word = before.rstrip()
        run, stem = before[len(word) :], word[-1:]
        breaks = run.replace("\r\n", "\n").replace("\r", "\n").count("\n")
        if here.isspace() and here != " ":
            continue  # never inside a run of white space
        if a in sections or (here == " " and a + 1 in sections):
            out[i] = 5
        elif breaks >= 2 or before[-4:].lower() in ("</p>", "/li>", "div>"):
            out[i] = 4
        elif breaks == 1:
            out[i] = 3
        elif run or here == " ":
            out[i] = 2 if stem and stem in ".!?…" else 1 if stem and stem in ",;:" else 0
    out[0] = out[-1] = 6
    return out


class RangeMaximum:
    """The rightmost largest value of any window of up to ``widest``, by a sparse table."""

    def __init__(self, values: np.ndarray, widest: int):
        self.values = values
        index = np.arange(len(values), dtype=np.int32)
        self.levels, width = [index], 1
        while 2 * width <= min(widest, len(values)):
            last = self.levels[-1]
            a, b = last[: len(last) - width], last[width:]
            self.levels.append(np.where(values[a] > values[b], a, b).astype(np.int32))
            width *= 2

    def top(self, lo: int, hi: int) -> int:
        """The rightmost place of the largest value in lo .. hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        a, b = int(self.levels[k][lo]), int(self.levels[k][hi - (1 << k) + 1])
        return a if self.values[a] > self.values[b] else b


def _fine(text: str, spans: list[tuple[int, int, int]], limit: int, enc: Encoder) -> list[tuple[int, int, int]]:
    """Pretokens with those beyond the limit cut between characters."""
    out = []
    for a, b, n in spans:
        if n <= limit // 2:
            out.append((a, b, n))
            continue
        step = max(1, limit // 8)
        while a < b:
            e = min(b, a + step)
            out.append((a, e, max(1, len(text[a:e].encode()))))  # a bound: a byte each
            a = e
    return out


def split(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP, least: float = LEAST, enc: Encoder | None = None) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece, in characters."""
    if not text:
        return []
    enc = enc or encoder()
    total = enc.count(text)
    if total <= limit:
        return [(0, len(text), total)]
    whole = enc.pretokens(text)
    spans = _fine(text, whole, limit, enc)
    ends = np.cumsum([0] + [n for _, _, n in spans])  # tokens before each gap
    top = RangeMaximum(strengths(text, spans), limit + 1)
    at = lambda i: spans[i][0] if i < len(spans) else len(text)
    out, start, last = [], 0, len(spans)

    def size(end: int) -> int:
        """Tokens of the piece start .. end, encoded alone: only white space at its end may encode otherwise than in the text."""
        if len(spans) != len(whole):
            return enc.count(text[at(start) : at(end)])
        k = end
        while k > start and text[at(k - 1) : at(k)].isspace():
            k -= 1
        return int(ends[k] - ends[start]) + enc.count(text[at(k) : at(end)])

    while True:
        hi = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
        if hi >= last:
            end = last
        else:
            lo = int(np.searchsorted(ends, ends[start] + int(limit * least), side="left"))
            end = top.top(max(start + 1, min(lo, hi)), max(hi, start + 1))
        n = size(end)
        while n > limit and end > start + 1:  # a cut may leave white space that encodes otherwise
            end -= 1
            n = size(end)
        out.append((at(start), at(end), n))
        if end >= last:
            return out
        lo = int(np.searchsorted(ends, ends[end] - overlap, side="left"))
        start = max(start + 1, top.top(min(lo, end - 1), end - 1) if lo < end else end)


def pieces(df: DataFrame, row_id: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, path: str = VOCABULARY, oversized: bool = True) -> DataFrame:
    """(row_id, piece_no, start, length, tokens, piece): the pieces of each text; of texts over the limit only, if oversized."""
    kind = df.schema[row_id].dataType.simpleString()
    rows = df.select(F.col(row_id).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    if oversized:
        rows = rows.where(may_exceed(F.col("t"), limit))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            for a in range(0, len(pdf), 256):  # bounds the memory of what comes out
                out = []
                for i, t in zip(pdf["i"].iloc[a : a + 256], pdf["t"].iloc[a : a + 256]):
                    cut = split(t, limit, overlap, LEAST, enc)
                    if len(cut) > 1 or not oversized:
                        out += [(i, k, s, e - s, n, t[s:e]) for k, (s, e, n) in enumerate(cut)]
                yield pd.DataFrame(out, columns=[row_id, "piece_no", "start", "length", "tokens", "piece"])

    return rows.mapInPandas(run, f"`{row_id}` {kind}, piece_no int, start int, length int, tokens int, piece string")
