"""Mapping freely typed streets to a register: symmetric deletes, weighted Damerau-Levenshtein, register frequency.

A register name is folded to a sound key (accents, doubled letters and the usual Dutch spelling variants fall away) and stored under every key that
arises by deleting up to ``distance`` letters of its first ``prefix`` ones. A typed name is looked up by the same deletes: two names within the
distance share at least one. Candidates are ranked by the weighted edit distance of the unfolded spelling, by how well the resort and district agree,
by how often the register has the name (a commoner name first), then by the lowest street_id. What stays beyond the bound is a miss, -1.

The register travels to the workers as one pickled broadcast, which is built only below ``most`` rows (100,000 names of 200 bytes each are 20 MB).
Beyond it ``resolve_by_join`` gives the same rows: every key under which a look-up may ask for names (``Register.asked``) is a row, as is every key under which
the register has a name (``Register.answers``), and each address ranks what the join brings it. The distinct resorts and districts, by which an address is
taken apart, are broadcast in either form; more than ``MOST_PLACES`` of them are an error. No row is shuffled in the broadcast form and each row is
resolved alone, so a street that a third of all rows name is no hot spot.

Defined results: a null or blank street gives null (there is nothing to map); null resort or district leaves the choice to the rest; an empty
register gives -1; ties go to the lowest street_id; texts of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: What a street name ends in, by the canonical ending: written out, shortened, in English.
ENDINGS = {
    "straat": ("straat", "strt", "str", "st", "street"),
    "weg": ("weg", "wg", "w", "road", "rd"),
    "laan": ("laan", "ln", "la", "lane"),
    "pad": ("pad", "pd", "path"),
    "dreef": ("dreef", "drf", "dr", "drive"),
    "plein": ("plein", "pln", "square"),
    "kade": ("kade", "kd"),
    "gracht": ("gracht", "gr"),
    "steeg": ("steeg", "stg", "alley"),
    "singel": ("singel", "sngl"),
    "hof": ("hof",),
    "kanaal": ("kanaal",),
    "boulevard": ("boulevard", "blvd"),
}
ENDING_OF = {form: ending for ending, forms in ENDINGS.items() for form in forms}
_FORMS = "|".join(sorted(ENDING_OF, key=len, reverse=True))
_ATTACHED = re.compile(rf"^(.{{3,}}?)[\s-]*({_FORMS})\.?$")
#: Words before a street that say where along it a plot lies, or that there is a plot.
_LEAD = re.compile(r"^(?:(?:(?:bouw|eigendoms?)?(?:perceel|percelen|kavels?)|perc\.?|plot|grond|te koop|hoek(?: van)?|hk\.?|t\.? ?h\.? ?v\.?|a/d|a\.d\.|aan|nabij|bij|achter|naast|omg(?:eving)?\.?|de|den|het|adres:?)\s+)+")
_PARCEL = re.compile(r"\b(?:kavel|perceel|perc|pc|plot|lot)\b\.?\s*(?:nr\.?|no\.?|#)?\s*\d+\s?[a-z]?\b")
_NUMBER = r"(?:huis(?:nr|nummer|no)\.?|nummer|num\.?|nr\.?|no\.?|n°|#)"
_TAIL = re.compile(rf"^(.*?)[\s,]*(?:{_NUMBER}\s*)?\b(\d{{1,5}})(?:\s?-?\s?([a-z]))?$")
_HEAD = re.compile(rf"^(?:{_NUMBER}\s*)?(\d{{1,5}})(?:\s?-?\s?([a-z]))?[\s,]+(?=[^\d\s])(.*)$")
_PLACE_WORD = re.compile(r"^(?:ressort|ress?|resort|district|distr?|te|in)\b\.?\s*")
_ONLY_NUMBER = re.compile(rf"^(?:{_NUMBER}\s*)?(\d{{1,5}})(?:\s?-?\s?([a-z]))?$")
_GLUED = re.compile(r"([a-z]{3})(\d)")
_SEGMENT = re.compile(r"\s*[,;()|]\s*|\s+/\s+|\s+te\s+")


@lru_cache(1 << 16)
def plain(text: str) -> str:
    """Lower case, without accents, one space for any white space."""
    if text.isascii():
        return " ".join(text.lower().split())
    text = unicodedata.normalize("NFKD", text.translate(_LETTERS)).lower()
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).split())


_LETTERS = str.maketrans({"’": "'", "‘": "'", "–": "-", "—": "-", "ø": "o", "ł": "l", "đ": "d"})


_NO_LETTERS = re.compile(r"[\W_]+")


def letters(text: str) -> str:
    return _NO_LETTERS.sub("", text)


#: Spellings that sound alike, applied in this order to a name of letters and digits only.
SOUNDS = (("ij", "y"), ("ei", "y"), ("ck", "k"), ("th", "t"), ("ph", "f"), ("z", "s"), ("v", "f"), ("w", "f"), ("oe", "u"), ("ie", "i"), ("c", "k"), ("q", "k"), ("dt", "t"))
_DOUBLED = re.compile(r"([a-z])\1+")


@lru_cache(1 << 16)
def sound_key(name: str) -> str:
    """What makes a street name recognisable: how it sounds. Runs of digits stay as they are."""
    key = letters(name)
    for a, b in SOUNDS:
        key = key.replace(a, b)
    return _DOUBLED.sub(r"\1", key)


_CLASSES = {c: i for i, group in enumerate(("vwf", "sz", "ckq", "iyj", "dt", "bp", "gh", "mn", "oau", "ei")) for c in group}


@lru_cache(1 << 17)
def weighted_distance(a: str, b: str, most: float = 9.0) -> float:
    """Damerau-Levenshtein (neighbours may swap), cheaper for letters that sound alike (0.4), for doubled letters (0.3) and for swaps (0.8)."""
    if a == b:
        return 0.0
    # equal ends cost nothing; two letters of either are kept, as a doubled or swapped letter leans on its neighbour
    start, end, least = 0, 0, min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    start, end = max(0, start - 2), max(0, end - 2)
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    # what putting in a letter of b costs, and its class; of each letter of a below
    put, kinds = [0.3 if j and b[j] == b[j - 1] else 1.0 for j in range(len(b))], [_CLASSES.get(c, -2) for c in b]
    before, last = None, [0.0]
    for cost in put:
        last.append(last[-1] + cost)
    for i, ca in enumerate(a):
        drop, kind, left = 0.3 if i and ca == a[i - 1] else 1.0, _CLASSES.get(ca, -1), last[0]
        best = least = left + drop
        row = [best]
        for j, cb in enumerate(b):
            above = last[j + 1]
            if ca == cb:
                best = left
            else:
                best += put[j]
                x = left + (0.4 if kind == kinds[j] else 1.0)
                if x < best:
                    best = x
                x = above + drop
                if x < best:
                    best = x
                if i and j and ca == b[j - 1] and a[i - 1] == cb:
                    x = before[j - 1] + 0.8
                    if x < best:
                        best = x
            if best < least:
                least = best
            row.append(best)
            left = above
        if least > most:
            return most + 1
        before, last = last, row
    return last[-1]


def edits(a: str, b: str, most: int) -> int:
    """Plain Damerau-Levenshtein distance, most + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    start, end = 0, 0
    least = min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    if most == 1:  # one letter changed, or two swapped
        return 1 if (len(a) == len(b) == 1) or (len(a) == len(b) == 2 and a[0] == b[1] and a[1] == b[0]) else 2
    before, last = None, list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        row = [i]
        for j, cb in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def deletes(key: str, distance: int, prefix: int) -> set[str]:
    """Every string that arises by deleting up to distance letters of the first prefix ones."""
    head = key[:prefix]
    out, last = {head}, {head}
    for _ in range(min(distance, len(head) - 1)):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out |= last
    return out


class DeleteIndex:
    """Keys within an edit distance of a given one, by symmetric deletes."""

    def __init__(self, keys, distance: int = 2, prefix: int = 10):
        self.distance, self.prefix, self.by, self.keys = distance, prefix, defaultdict(list), set(keys)
        for key in sorted(self.keys):
            for d in deletes(key, self.bound(key), prefix):
                self.by[d].append(key)
        self.by.default_factory = None

    def bound(self, key: str) -> int:
        """Short keys may differ less: two of five letters make another word."""
        return self.distance if len(key) >= 7 else min(1, self.distance) if len(key) >= 4 else 0

    def near(self, key: str, within: int = 9) -> dict[str, int]:
        most = min(within, self.bound(key))
        if most == 0:
            return {key: 0} if key in self.keys else {}
        others, get = set(), self.by.get
        if len(self.keys) <= 32:  # fewer keys than deletes: each is compared
            mine = set(key)  # an edit changes two letters of the set at most
            others = {k for k in self.keys if abs(len(k) - len(key)) <= most and len(mine.symmetric_difference(k)) <= 2 * most}
        else:
            for d in deletes(key, most, self.prefix):
                if hit := get(d):
                    others.update(hit)
        found = {}
        for other in others:
            bound = min(self.bound(other), most)
            n = edits(key, other, bound)
            if n <= bound:
                found[other] = n
        return found


_BY_LENGTH = sorted(ENDING_OF, key=len, reverse=True)


@lru_cache(1 << 10)
def _attached(forms: tuple[str, ...]) -> re.Pattern:
    return re.compile(rf"^(.{{3,}}?)[\s-]*({'|'.join(map(re.escape, forms))})\.?$")


def ending_readings(name: str) -> list[tuple[str, str | None]]:
    """(stem, ending) readings of a plain name: with the ending that it seems to have, and as if it had none."""
    out = []
    m = _ATTACHED.match(name)
    while m:
        stem, form = m.group(1).rstrip(" -."), m.group(2)
        out.append((stem, ENDING_OF[form]))
        bare = name.rstrip(".")
        shorter = tuple(f for f in _BY_LENGTH if len(f) < len(form) and bare.endswith(f))
        m = _attached(shorter).match(name) if shorter else None
    return [*out, (name.rstrip("."), None)]


def _keep(seen: dict, key, value):
    """value, kept in a table of bounded size; what is dropped is worked out again."""
    if len(seen) > 400_000:
        seen.clear()
    seen[key] = value
    return value


class Places:
    """The resorts and districts of a register, and how a typed street is taken apart by them; picklable."""

    def __init__(self, pairs):
        """pairs: (resort, district)"""
        self.places = {"resort": {}, "district": {}}
        for kind, given in zip(self.places, zip(*pairs)):
            for place in sorted(x for x in set(given) if x):
                self.places[kind].setdefault(sound_key(plain(place)), plain(place))
        self.index = {kind: DeleteIndex(keys, 2, 8) for kind, keys in self.places.items()}
        self.spelt = {kind: {letters(p): p for p in keys.values()} for kind, keys in self.places.items()}
        self.spelt_index = {kind: DeleteIndex(keys, 2, 8) for kind, keys in self.spelt.items()}
        self._seen: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}}

    def place(self, segment: str) -> tuple[frozenset, frozenset] | None:
        """(resorts, districts) that a plain text may mean; None where it means neither."""
        if segment not in self._seen:
            _keep(self._seen, segment, self._place(segment))
        return self._seen[segment]

    def _place(self, segment: str) -> tuple[frozenset, frozenset] | None:
        bare = _PLACE_WORD.sub("", segment).strip(" .,-")
        says = re.match(r"^(ress|resort|dist)", segment)
        key = sound_key(bare)
        if not key:
            return None
        out = {}
        for kind, keys in self.places.items():
            hits = {keys[key]} if key in keys else set()
            if not hits and len(bare) >= 3 and len(bare) <= 7:
                hits = {p for p in keys.values() if p.startswith(bare) and p != bare}
            out[kind] = hits
        if not any(out.values()):
            near = {kind: {} for kind in out}
            for kind in out:
                hits = [(self.places[kind][k], n) for k, n in self.index[kind].near(key).items()] + [(self.spelt[kind][k], n) for k, n in self.spelt_index[kind].near(letters(bare)).items()]
                for p, n in hits:
                    near[kind][p] = min(n, near[kind].get(p, 9))
            least = min((n for x in near.values() for n in x.values()), default=9)
            out = {kind: {p for p, n in x.items() if n == least} for kind, x in near.items()}
        if says:
            kind = "district" if says.group(1) == "dist" else "resort"
            if out[kind]:
                out = {kind: out[kind], ({"resort", "district"} - {kind}).pop(): set()}
        return (frozenset(out["resort"]), frozenset(out["district"])) if any(out.values()) else None

    def place_of(self, text: str | None) -> tuple[frozenset, frozenset, bool]:
        """(resorts, districts, whether something was given) of a resort or district field."""
        if not text or not text.strip():
            return frozenset(), frozenset(), False
        key = ("place", text)
        if key not in self._seen:
            resorts, districts = frozenset(), frozenset()
            for part in _SEGMENT.split(plain(text)):
                if part and (hit := self.place(part)):
                    resorts, districts = resorts | hit[0], districts | hit[1]
            _keep(self._seen, key, (resorts, districts, True))
        return self._seen[key]

    def parse(self, street: str) -> tuple[list[str], frozenset, frozenset, str, str]:
        """(street segments, resorts, districts, house number, its letter) of a typed street."""
        text = _PARCEL.sub(" ", _LEAD.sub("", plain(street).replace("a/d", "aan"))).strip()
        text = _GLUED.sub(r"\1 \2", _LEAD.sub("", text + " ").strip())
        resorts, districts, names, number, letter = frozenset(), frozenset(), [], "", ""
        parts = [x.strip(" .,-") if len(x) > 4 else x.strip(" ,-") for x in _SEGMENT.split(text) if x and x.strip(" .,-")]
        for i, part in enumerate(parts):
            if m := _ONLY_NUMBER.match(part):
                number, letter = m.group(1), m.group(2) or ""
                continue
            if len(parts) > 1 and not re.search(r"\d", part) and (hit := self.place(part)) and (i or any(j for j in parts[1:] if not self.place(j))):
                resorts, districts = resorts | hit[0], districts | hit[1]
                continue
            names.append(part)
        return names, resorts, districts, number, letter

    def split_number(self, name: str) -> tuple[str, str, str]:
        """(name, house number, letter); the number may stand before or after the name."""
        if m := _TAIL.match(name):
            if m.group(1).strip():
                return _MARK.sub("", m.group(1)).strip(" ,-"), m.group(2), m.group(3) or ""
        if m := _HEAD.match(name):
            return m.group(3).strip(), m.group(1), m.group(2) or ""
        return name, "", ""


class Register:
    """The street register, ready for look-ups; picklable."""

    #: Costs of a resort or district that is given and isn't the street's, of a missing or of another ending.
    WRONG_RESORT, WRONG_DISTRICT, UNKNOWN_PLACE, NO_ENDING, OTHER_ENDING = 1.6, 1.2, 0.2, 0.35, 0.9
    #: A name is a miss beyond this cost of its spelling; SOUNDS_ALIKE is what a name costs that only sounds the same.
    BOUND, SOUNDS_ALIKE = 3.2, 0.3
    #: At these costs, places included, a look-up by the same key, or by one edit, needs no candidates further off: they would cost as much. The cheapest two edits cost 0.6.
    SURE = (0.4, 0.59, 99.0)

    def __init__(self, rows, distance: int = 2, prefix: int = 10, places: Places | None = None):
        """rows: (street_id, name, resort, district); rows without id or name are no streets. places: of the whole register, where rows are a part of it."""
        self.rows = sorted((int(i), str(n), r or "", d or "") for i, n, r, d in rows if i is not None and n and n.strip())
        self.where = places or Places((r, d) for _, _, r, d in self.rows)
        by_full, by_stem, names, spelt = defaultdict(set), defaultdict(set), defaultdict(list), defaultdict(set)
        families, families_spelt = set(), set()
        for k, (_, name, _, _) in enumerate(self.rows):
            names[plain(name)].append(k)
        self.names, self.parts = dict(names), {}
        for p in self.names:
            m = re.match(r"^(.*\D)\s+(\d+\s?[a-z]?)$", p)
            base, number = (m.group(1), letters(m.group(2))) if m else (p, "")
            end = next((e for e in sorted(ENDINGS, key=len, reverse=True) if base.endswith(e) and len(base) > len(e) + 2), None)
            stem = base[: -len(end)].rstrip(" -") if end else base
            self.parts[p] = full, short, _, _ = letters(base), letters(stem), end, number
            by_full[sound_key(base)].add(p)
            by_stem[sound_key(stem)].add(p)
            # the spelling itself is a second key: a slip inside a pair of letters that make one sound changes the sound key by more than the slip
            spelt[full].add(p)
            spelt[short].add(p)
            if number:
                families.add(sound_key(base))
                families_spelt |= {full, short}
        self.by_full, self.by_stem, self.spelt = ({k: sorted(v) for k, v in x.items()} for x in (by_full, by_stem, spelt))
        self.index, self.spelt_index = DeleteIndex([*self.by_full, *self.by_stem], distance, prefix), DeleteIndex(self.spelt, distance, prefix)
        self.families, self.families_spelt = DeleteIndex(families, distance, prefix), DeleteIndex(families_spelt, distance, prefix)
        self.spelled = {(n, r, d): i for i, n, r, d in reversed(self.rows)}
        self.own = {i: (sound_key(plain(n)), plain(r), plain(d)) for i, n, r, d in self.rows}
        self._seen: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}}

    def candidates(self, name: str, number: str, depth: int = 2) -> dict[str, float]:
        """Register names near a plain typed one (without house number), with the cost of the spelling. depth: edits between the keys; 0: the very same key."""
        key = ("near", name, depth)
        costs = self._seen.get(key)
        if costs is None:
            costs = _keep(self._seen, key, self._costs(name, depth))
        # a name with a number of its own is meant only with that number, or, at a cost, with none
        parts = self.parts
        found = {p: c + (1 if own and not number else 0) for p, c in costs.items() if not ((own := parts[p][3]) and number and own != number)}
        if depth > 1 and not found and (start := cut_short(name)):
            found = {p: 0.8 if own else 1.0 for p, (full, _, _, own) in parts.items() if full.startswith(start) and (not own or own == number) and full != start}
        return {p: c for p, c in found.items() if c <= self.BOUND}

    def _costs(self, name: str, depth: int) -> dict[str, float]:
        found: dict[str, float] = {}
        for typed, end in ((letters(s), e) for s, e in ending_readings(name)):
            key = sound_key(typed)
            if len(key) < 3:
                continue
            near = {p for k in (self.index.near(key, depth) if depth else (key,)) for p in (*self.by_stem.get(k, ()), *self.by_full.get(k, ()))}
            near |= {p for k in (self.spelt_index.near(typed, depth) if depth else (typed,)) for p in self.spelt.get(k, ())}
            for p in near:
                full, stem, ending, _ = self.parts[p]
                ends = 0 if end == ending else self.NO_ENDING if end is None or ending is None else self.OTHER_ENDING
                cost = min(self._unlike(typed, stem) + ends, self._unlike(typed, full) if end is None else 99.0)
                found[p] = min(cost, found.get(p, 99.0))
        return found

    def _unlike(self, a: str, b: str) -> float:
        cost = weighted_distance(a, b, 4)
        return cost if cost <= self.SOUNDS_ALIKE else min(cost, self.SOUNDS_ALIKE + weighted_distance(sound_key(a), sound_key(b), 4))

    def named(self, street: str, depth: int = 2) -> tuple[dict[str, float], frozenset, frozenset, str, str]:
        """(register names near, resorts, districts, house number, letter) of a typed street; kept, since streets come again."""
        key = (street, depth)
        if key not in self._seen:
            names, resorts, districts, number, letter = self.where.parse(street)
            best: dict[str, float] = {}
            for name in names:
                bare, n, x = self.where.split_number(name)
                bare = unled(bare)
                own = n + x
                if n and self._family(bare):
                    inner, n2, x2 = self.where.split_number(bare)
                    if n2 and self._family(inner):  # "Leiding 7 no. 12": the first number is the street's
                        bare, own, n, x = inner, n2 + x2, n, x
                    else:
                        own, n, x = n + x, "", ""
                got = self.candidates(bare, own, depth)
                if got and (not best or min(got.values()) < min(best.values())):
                    best = got
                    if n:
                        number, letter = n, x
                elif n and not number:
                    number, letter = n, x
            _keep(self._seen, key, (best, resorts, districts, number.lstrip("0") or number, letter))
        return self._seen[key]

    def _family(self, name: str) -> bool:
        """Whether the register has streets of this name with a number of their own."""
        if not self.families.keys:
            return False
        known = self._seen.get(("family", name))
        if known is None:
            base, start = family_base(name)
            key = sound_key(base)
            known = len(key) >= 3 and (bool(self.families.near(key)) or (start and any(k.startswith(key) for k in self.families.keys)) or bool(self.families_spelt.near(letters(base))))
            _keep(self._seen, ("family", name), known)
        return known

    def read(self, street: str | None, resort: str | None = None, district: str | None = None) -> tuple:
        """resolve's four, then the sound of the street, the resort and the district meant (empty where none is given)."""
        sid, cost, number, letter = self.resolve(street, resort, district)
        if sid is None:
            return sid, cost, number, letter, "", "", ""
        _, inner_r, inner_d, _, _ = self.named(street, 0)  # the places in a street don't depend on how far the name is looked up
        (r1, d1, _), (r2, d2, _) = self.where.place_of(resort), self.where.place_of(district)
        sound, own_r, own_d = self.own.get(sid) or (sound_key(plain(street)), "", "")
        # a shortened place may mean several: it agrees with the street's own if that is among them
        pick = lambda given, own: "" if not given else own if own in given else min(given)
        return sid, cost, number, letter, sound, pick(inner_r | r1 | r2, own_r), pick(inner_d | d1 | d2, own_d)

    def asked(self, street: str) -> set[str]:
        """Every key under which a look-up of a typed street may ask for names: deletes of sounds, of spellings ("="), beginnings ("<", "~"), the text itself ("!")."""
        out = {"!" + plain(street)}
        for name in self.where.parse(street)[0]:
            bare = unled(self.where.split_number(name)[0])
            for x in {bare, self.where.split_number(bare)[0]}:
                base, start = family_base(x)
                if start:
                    out.add("~" + sound_key(base))
                if start := cut_short(x):
                    out.add("<" + start)
                for typed in {letters(base), *(letters(stem) for stem, _ in ending_readings(x))}:
                    key = sound_key(typed)
                    out |= deletes(key, self.index.bound(key), self.index.prefix)
                    out |= {"=" + d for d in deletes(typed, self.index.bound(typed), self.index.prefix)}
        return out

    def answers(self) -> set[str]:
        """The keys under which a register of one street gives it."""
        out = {"!" + p for p in self.names} | set(self.index.by) | {"=" + d for d in self.spelt_index.by}
        for full, _, _, number in self.parts.values():
            out |= {"<" + full[:i] for i in range(1, len(full) + 1)}
            if number:
                key = sound_key(full)
                out |= {"~" + key[:i] for i in range(1, len(key) + 1)}
        return out

    def resolve(self, street: str | None, resort: str | None = None, district: str | None = None) -> tuple[int | None, float, str, str]:
        """(street_id, cost, house number, letter); -1 where no street is meant, None where there is no text."""
        if not street or not street.strip():
            return None, 0.0, "", ""
        exact = self.spelled.get((street, resort or "", district or "")) if resort and district else None
        if exact is not None:
            return exact, 0.0, "", ""
        r1, d1, given_r = self.where.place_of(resort)
        r2, d2, given_d = self.where.place_of(district)
        for depth, sure in enumerate(self.SURE):
            best, resorts, districts, number, letter = self.named(street, depth)
            resorts, districts = resorts | r1 | r2, districts | d1 | d2
            choice = None
            for p, cost in best.items():
                for k in self.names[p]:
                    i, _, r, d = self.rows[k]
                    c = cost
                    if resorts:
                        c += 0 if plain(r) in resorts else self.WRONG_RESORT
                    elif given_r:
                        c += self.UNKNOWN_PLACE
                    if districts:
                        c += 0 if plain(d) in districts else self.WRONG_DISTRICT
                    elif given_d:
                        c += self.UNKNOWN_PLACE
                    rank = (round(c, 6), -len(self.names[p]), i)
                    if choice is None or rank < choice[0]:
                        choice = rank, i, cost
            if choice and choice[0][0] <= sure:
                break
        return (choice[1], choice[2], number, letter) if choice else (-1, 9.0, number, letter)


def cut_short(name: str) -> str:
    """The letters of a plain name that a full stop ends ("leid."), else an empty text."""
    return letters(name) if re.fullmatch(r"[a-z][a-z' -]{2,}\.", name) else ""


def unled(name: str) -> str:
    return _LEAD.sub("", name + " ").strip()


def family_base(name: str) -> tuple[str, bool]:
    """(name without a number, whether it is cut short)."""
    bare = _MARK.sub("", name).strip()
    return _OWN_NUMBER.sub("", bare), bare.endswith(".")


_MARK, _OWN_NUMBER = re.compile(rf"[\s,]*{_NUMBER}?$"), re.compile(r"\s*\d+\s?[a-z]?$")
#: More distinct resorts, or districts, than this are an error: they are broadcast.
MOST_PLACES = 50_000


def register_of(streets: DataFrame, most: int = 100_000) -> Register | None:
    """The register on the driver, or None where it has more than ``most`` rows (resolve_by_join takes those)."""
    rows = streets.select("street_id", "name", "ressort", "district").limit(most + 1).collect()
    return Register([tuple(r) for r in rows]) if len(rows) <= most else None


def shared(df: DataFrame, register: Register):
    """The register as a broadcast variable; its size is proven by the bound of register_of."""
    return df.sparkSession.sparkContext.broadcast(register)


#: What ``with_street`` adds; the last three only if asked for.
FOUND = (("street_id", "long", pa.int64()), ("cost", "double", pa.float64()), ("house_number", "string", pa.string()), ("house_letter", "string", pa.string()), ("sound", "string", pa.string()), ("resort_read", "string", pa.string()), ("district_read", "string", pa.string()))


def with_street(df: DataFrame, streets: DataFrame, keep: list[str], street: str = "street", resort: str = "resort", district: str = "district", most: int = 100_000, read: bool = False) -> DataFrame:
    """keep + (street_id long, cost double, house_number, house_letter): each row's street by the register, without a shuffle. read: sound, resort_read and district_read too."""
    register = register_of(streets, most)
    if register is None:
        return resolve_by_join(df, streets, keep, street, resort, district, read)
    register = shared(df, register)
    rest = df.select(*keep, F.col(street).alias("__s"), F.col(resort).alias("__r"), F.col(district).alias("__d"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields if f.name in keep]
    n, more = len(keep), FOUND if read else FOUND[:4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = register.value.read if read else register.value.resolve
        for batch in batches:  # the kept columns pass through as they are
            got = [find(*v) for v in zip(*(batch.column(n + i).to_pylist() for i in range(3)))]
            new = [pa.array([g[i] for g in got], kind) for i, (_, _, kind) in enumerate(more)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *new], names=[*keep, *(name for name, _, _ in more)])

    return rest.mapInArrow(run, ", ".join([*fields, *(f"{name} {kind}" for name, kind, _ in more)]))


def places_of(streets: DataFrame, most: int = MOST_PLACES) -> Places:
    """The distinct places of a register of any size; an error where they are too many to broadcast."""
    out = []
    for i, c in enumerate(("ressort", "district")):
        names = [r[0] for r in streets.where(F.col(c).isNotNull() & F.col("street_id").isNotNull() & (F.trim("name") != "")).select(c).distinct().limit(most + 1).collect()]
        if len(names) > most:
            raise ValueError(f"more than {most} distinct values of {c}")
        out += [(x, "") if i == 0 else ("", x) for x in names]
    return Places(out)


def resolve_by_join(df: DataFrame, streets: DataFrame, keep: list[str], street: str = "street", resort: str = "resort", district: str = "district", read: bool = False) -> DataFrame:
    """``with_street`` for registers too large to broadcast: the keys of both sides are joined, then each address ranks its own candidates. The same rows."""
    places = df.sparkSession.sparkContext.broadcast(places_of(streets))
    typed = df.select(F.col(street).alias("__s"), F.col(resort).alias("__r"), F.col(district).alias("__d")).where(F.trim(F.regexp_replace("__s", r"[\s\u00a0]+", " ")) != "").distinct()
    more = FOUND if read else FOUND[:4]
    row, one = ["street_id", "name", "ressort", "district"], "street_id long, name string, ressort string, district string"

    def typed_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape = Register([], places=places.value)
        for pdf in batches:
            yield pd.DataFrame([(x, s, r, d) for s, r, d in zip(pdf["__s"], pdf["__r"], pdf["__d"]) for x in shape.asked(s)], columns=["x", "__s", "__r", "__d"])

    def register_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(x, *v) for v in pdf.itertuples(index=False, name=None) for x in Register([v], places=places.value).answers()], columns=["x", *row])

    a = typed.mapInPandas(typed_keys, "x string, __s string, __r string, __d string")
    known = streets.where("street_id is not null and trim(name) <> ''").select(F.col("street_id").cast("long").alias("street_id"), "name", "ressort", "district")
    pairs = a.join(known.mapInPandas(register_keys, f"x string, {one}"), "x").select("__s", "__r", "__d", *row).distinct()
    # an address of no candidate at all is still taken apart
    pairs = pairs.unionByName(typed.selectExpr("*", "cast(null as long) as street_id", "cast(null as string) as name", "cast(null as string) as ressort", "cast(null as string) as district"))

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        s, r, d = (None if pd.isna(x) else x for x in pdf.iloc[0][["__s", "__r", "__d"]])
        rows = [(int(i), n, None if pd.isna(a) else a, None if pd.isna(b) else b) for i, n, a, b in pdf[row].itertuples(index=False, name=None) if not pd.isna(i)]
        one = Register(rows, places=places.value)
        return pd.DataFrame([(s, r, d, *(one.read if read else one.resolve)(s, r, d))], columns=["__s", "__r", "__d", *(name for name, _, _ in more)])

    best = pairs.groupBy("__s", "__r", "__d").applyInPandas(rank, "__s string, __r string, __d string, " + ", ".join(f"{name} {kind}" for name, kind, _ in more))
    rows = df.select(*keep, F.col(street).alias("__s0"), F.col(resort).alias("__r0"), F.col(district).alias("__d0"))
    joined = rows.join(best, (F.col("__s0") == F.col("__s")) & F.col("__r0").eqNullSafe(F.col("__r")) & F.col("__d0").eqNullSafe(F.col("__d")), "left")
    none = {"cost": F.lit(0.0)} | {name: F.lit("") for name, _, _ in more[2:]}
    return joined.select(*keep, "street_id", *(F.coalesce(name, none[name]).alias(name) for name, _, _ in more[1:]))


def mapped_streets(df: DataFrame, streets: DataFrame, row_id: str = "record_id") -> DataFrame:
    """(row_id, street_id): every row with a street whose (street, resort, district) isn't, character by character, one of the register; -1: a miss."""
    rows = df.where(F.trim(F.regexp_replace("street", r"[\s ]+", " ")) != "").select(row_id, "street", "resort", "district")
    known = streets.select(F.col("name").alias("street"), F.col("ressort").alias("resort"), "district").distinct()
    rows = rows.join(known, ["street", "resort", "district"], "left_anti")  # Spark broadcasts the register only if it is small
    return with_street(rows, streets, [row_id]).select(row_id, "street_id")
