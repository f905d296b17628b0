"""Encoding a corpus with a public byte-level BPE vocabulary, exactly and in linear time.

The bytes of a pretoken are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds every vocabulary entry at every position
in one pass. The encoder takes the longest entry at each position and backs off to shorter ones, or up to the token before, where two neighbours are
*incompatible*: where merging their joined bytes by rank would not give just these two. An encoding whose neighbours are all compatible is the one
that the merges give, so the result is exact; a dead position is marked, so no position is tried twice. Compatibility of a pair is worked out once and kept.

The vocabulary comes from a file whose path is a parameter (one on each executor, or in a shared folder). Each Python worker loads it once. Pretokens
that come again are kept in a table bounded by ``kept``. Rows are encoded alone in Arrow batches: no shuffle.

Defined results: null, empty: an empty list; blanks are text and have tokens; texts of any length are encoded whole; special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

VOCABULARY = os.environ.get("GLEBA_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how the vocabulary's makers cut text into pretokens.
PRETOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    def __init__(self, path: str = VOCABULARY, pattern: str = PRETOKEN, kept: int = 200_000):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.words = {i: w for w, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for w in self.ranks:
            self.automaton.add_word(w, len(w))
        self.automaton.make_automaton()
        self.kept, self.known, self.pairs = kept, {}, {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of two tokens gives just these two."""
        key = (a, b)
        found = self.pairs.get(key)
        if found is None:
            x, y = self.words[a], self.words[b]
            found = self.merged(x + y) == [x, y]
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def merged(self, s: str) -> list[str]:
        """Merging by rank as it is defined: always the lowest-ranked pair, leftmost first. Only for short strings."""
        parts, ranks = list(s), self.ranks
        while len(parts) > 1:
            best = min(((ranks.get(x + y, 1 << 30), i) for i, (x, y) in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 30:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def encode_pretoken(self, s: str) -> tuple[int, ...]:
        """s: a pretoken's bytes as Latin-1."""
        whole = self.ranks.get(s)
        if whole is not None:
            return (whole,)
        n, ranks = len(s), self.ranks
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, length in self.automaton.iter(s):
            starts[end - length + 1].append(length)  # in order of their ends: growing lengths
        dead, out, at = bytearray(n + 1), [], [(0, len(starts[0]) - 1)]
        while True:
            pos, k = at[-1]
            if pos == n:
                return tuple(out)
            lengths, last, moved = starts[pos], out[-1] if out else None, False
            while k >= 0:
                end = pos + lengths[k]
                if not dead[end]:
                    token = ranks[s[pos:end]]
                    if last is None or self.compatible(last, token):
                        at[-1] = (pos, k)
                        out.append(token)
                        at.append((end, len(starts[end]) - 1 if end < n else -1))
                        moved = True
                        break
                k -= 1
            if not moved:
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                dead[pos] = 1
                at.pop()
                out.pop()
                pos, k = at[-1]
                at[-1] = (pos, k - 1)

    def _ids(self, piece: str) -> tuple[int, ...]:
        ids = self.known.get(piece)
        if ids is None:
            ids = self.encode_pretoken(piece.encode("utf-8", "replace").decode("latin-1"))
            if len(piece) <= 64:
                if len(self.known) >= self.kept:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            get, ids = self.known.get, self._ids
            for piece in self.split(text):
                out += get(piece) or ids(piece)
        return out

    def pretokens(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, number of tokens) of each pretoken of a text, in characters."""
        get, ids, out, at = self.known.get, self._ids, [], 0
        for piece in self.split(text):  # the pretokens cover the text without gaps
            end = at + len(piece)
            out.append((at, end, len(get(piece) or ids(piece))))
            at = end
        return out

    def count(self, text: str | None) -> int:
        get, ids = self.known.get, self._ids
        return sum(len(get(p) or ids(p)) for p in self.split(text)) if text else 0


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """This process's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(df: DataFrame, row_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(row_id, ids): the token ids of each text."""
    kind = df.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            ids = pa.array((encode(t.as_py()) for t in batch.column(1)), pa.list_(pa.int32()), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[row_id, "ids"])

    return df.select(F.col(row_id), F.col(text).cast("string")).mapInArrow(run, f"`{row_id}` {kind}, ids array<int>")


def may_exceed(text: Column, tokens: int) -> Column:
    """False only where a text can't have more tokens than that: no token is shorter than a byte."""
    return F.octet_length(text) > tokens
