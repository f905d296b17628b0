"""Personal information in free text: finding it, and replacing it by typed placeholders that keep equal values linked.

Numbers of phones and of identity cards and dates of birth get a *format-preserving* pseudonym: a Feistel network, keyed with BLAKE2b, permutes the values of
a format (seven digits onto seven digits, two letters and six digits onto the same, a day onto a day). A permutation has no collisions, so equal values stay
equal, different ones stay different, in every document and on every executor without a shuffle or a table; who has the key can turn it back.
Names, street addresses and mail addresses get a keyed digest as their tag. ``[phone 4711223]`` reads as a phone and links as one.

Every row is read alone in Arrow batches. Before each pattern stands a plain search for what any of its finds holds (a digit, an @, a cue word), so texts that
can hold nothing cost little; no text is passed over by any other test.

Defined results: null texts stay null, empty texts and empty lists stay what they are, null elements stay null; a text of any length is read whole;
finds never overlap: mail addresses come first, then identity numbers, addresses, phones, names; repeated finds of a row are one row of p5_found.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# ---------------------------------------------------------------- patterns

_MAIL = re.compile(
    r"(?:mailto:)?\b([A-Za-z0-9][A-Za-z0-9._%+-]*?)(?:\s?@\s?|\s?[(\[{]\s?(?:at|apenstaartje|@)\s?[)\]}]\s?)"
    r"([A-Za-z0-9][A-Za-z0-9-]*(?:(?:\.|\s?[(\[]?\b(?:punt|dot)\b[)\]]?\s?)[A-Za-z0-9][A-Za-z0-9-]*)+)"
)
_DOT = re.compile(r"\s?[(\[]?\b(?:punt|dot)\b[)\]]?\s?")
_ID = re.compile(r"\b([A-Za-z]{2})[ -]?(\d{3}) ?(\d{3})\b(?![-./]?\d)")
_ID_CUE = re.compile(r"(?:\bid\b|identiteit|legitimatie|paspoort|id-?(?:nr|nummer|kaart)|identity)[^.!?]{0,25}$|(?:\bid|identiteit|legitimatie|paspoort)[\w-]*\s?(?:nr|no|nummer)?\.?[:\s]*$", re.I)
#: The ways to write seven digits; a country code may stand before them.
_GROUPS = r"\d{7}|\d{3}[-./ ]\d{4}|\d{3}([-. ])\d{2}\2\d{2}|\d{2}([-. ])\d{2}\3\d{3}|\d{2}([-. ])\d{3}\4\d{2}|\d(?:[ .-]\d){6}|\d{4}[-./ ]\d{3}"
_PHONE = re.compile(rf"(?<![\w/.,+-])(?:(?:\+|00)\s?597[-./ ]?|\(\s?(?:\+|00)?597\s?\)\s?|597[-./ ]?)?((?:{_GROUPS.replace(chr(92) + '2', chr(92) + '2')}))(?![\w]|[-./]\d|,\d|\s?(?:m2|m²|x\s?\d|ha\b|euro|eur\b|usd|srd|are\b))", re.I)
_ABROAD = re.compile(r"(?<![\w/.,-])(?:\+|00)(31|32|1|594|592|599)[-./ ]?((?:\d[-./ ]?){8,9}\d)(?!\w)")
_SHORT_PHONE = re.compile(r"(?:\btel(?:efoon)?|\bbel(?:len)?|\bcall|\bapp naar|whatsapp|\binfo op)\s*(?:nr\.?|naar|op)?[:.\s]*((?:\d{6}|\d{3}[-. ]\d{3}))(?![\w]|[-./]\d|\s?(?:m2|m²))", re.I)
#: What a number is that isn't a phone's: of an object, a dossier, a map, a register, a reference, a parcel, a price or a date.
_NO_PHONE = re.compile(r"(?:object|dossier|kaart|\bref|kkf|glis|referentie|perceel|kavels?|advert\w*|code|bouwnr|project|fase|rekening|prijs|nu|€|\$|eur|usd|srd)[\w-]*\.?\s*(?:nr\.?|no\.?|nummer|d\.d\.|id)?[:\s#]*[A-Z]?-?$", re.I)
_DATE_LIKE = re.compile(r"\d{1,2}[-./ ]\d{1,2}[-./ ]\d{4}$")
_BIRTH = re.compile(r"\b(?:geb(?:oren)?(?:\.|datum)?|born|birth\w*)\W{1,4}(?:op\s)?(\d{1,2})[-./](\d{1,2})[-./](\d{4})\b", re.I)

#: Short endings that a full stop marks as such; "st." and "w." end other words too.
_SHORT = r"strt|str|wg|ln|pd|drf|dr"
_FULL = r"straat|street|weg|road|laan|lane|pad|path|dreef|drive|plein|kade|gracht|steeg|singel|kanaal|boulevard"
_NR = r"(?:(?:huis)?(?:nr|no|nummer|num)\.?\s?|#\s?)"
_HOUSE = rf"{_NR}?\d{{1,4}}(?:[A-Za-z](?![A-Za-z])| ?-?[A-Za-z](?=[.,;)]|\s*$))?(?![\w]|[.,/-]\d|\s?(?:m2|m²|m\b|x\s?\d|min\b|meter|ha\b|km|euro|t/m|op de kaart))"
_CUED = re.compile(rf"(?:adres(?:\s+is|:)?|woon(?:t|achtig)?\s+(?:op|aan|in)(?:\s+de)?|aan huis,?|ophalen:|langskomen:?|wonend(?:e)?\s+(?:op|aan)|live at|address(?:\s+is|:)?)\s+(?:de\s+)?((?:[^\W\d_][\w'.-]*\s+){{1,4}}?{_HOUSE}(?:\s{_NR}\d{{1,4}}[A-Za-z]?\b)?)", re.I)
_OPEN = re.compile(rf"\b((?:[A-Z][\w'-]*\s)?(?!zijstraat|hoofdweg|toegangsweg)[^\W\d_][\w'-]{{2,}}(?:[ -](?:{_FULL})|(?:{_FULL}))\s{_HOUSE}(?:\s{_NR}\d{{1,4}}[A-Za-z]?\b)?|[^\W\d_][\w'-]{{3,}}(?:{_SHORT})\.\s{_HOUSE})", re.I)

_W = r"[^\W\d_]+(?:['’][^\W\d_]+)?"
_LAST = rf"{_W}(?:-{_W})?"
_TUSSEN = r"(?:(?:van|de|der|den|ten|ter|el|la)\s){0,2}"
_NO_LAST = r"(?!(?:bereiken|bellen|mailen|appen|op|heeft|staat|voor|en|of|via)\b)"
_NAME = rf"(?:(?:[A-Za-z]\.){{1,4}}\s?{_TUSSEN}{_LAST}|{_LAST}(?:\s{_TUSSEN}{_NO_LAST}{_LAST})?)"
_TITLE = r"(?:(?:mevr(?:ouw)?|dhr|heer|de heer|meneer|mw|mr|mrs|ms|drs|ing|ir|dr)\b\.?\s+)?"
#: Cue, name, and what ends the name.
_NAME_BEFORE = re.compile(
    rf"(?:\b(?:mevr|mevrouw|dhr|de heer|meneer|mw|mrs|mr)\b\.?|\bnamens|\b(?:oom|tante|neef|nicht|broer|zus|vader|moeder|man|vrouw|buurman)\b(?=\s+[A-Za-z])|\bask for|\b(?:groetjes|groeten|groet|mvg|met vriendelijke groet),?|\bafspraak maken met|\b(?:vraag|vragen) naar|\bmijn naam is|\bik ben|\bmy name is)\s+{_TITLE}"
    rf"({_NAME})(?=\s+(?:bereiken|bellen|op\b)|\s*[.,;!?)…]|\s*$)",
    re.I,
)
_NAME_CALL = re.compile(rf"\b(?:bel|call|app|contact)\s+(?:met\s+)?{_TITLE}({_NAME})\s+(?:op|on|via)\s+(?=\+|\(?\d|\(\+)|\bbezichtiging\s+(?:bel\s+)?{_TITLE}({_NAME})\s+(?=\+|\(?\d|\(\+)", re.I)
_NAME_AFTER = re.compile(rf"(?:^|(?<=\s))((?:[A-Za-z]\.){{1,4}}\s?{_LAST}|{_LAST}\s{_LAST}|{_LAST})\s+(?:heeft de sleutel|staat u graag|helpt u graag|is de eigenaar|has the key)", re.I)
_NAME_PHONE = re.compile(rf"(?:^|(?<=\s))((?:[A-Za-z]\.){{1,4}}\s?{_LAST}|{_LAST}\s{_LAST}|{_LAST}),\s+(?=[+(\d][\d\s()./+-]{{5,}}\s?\((?:geen|no))", re.I)
_NAME_OPEN = re.compile(rf"\b(?:contactpersoon|contact|naam|eigenaar|verkoper)\s?:\s+{_TITLE}((?:[A-Za-z]\.){{1,4}}\s?{_LAST}|{_LAST})(?:\s({_LAST}))?(?=(\S*\s*)(\S*))", re.I)
_FIRM = re.compile(r"makelaar|vastgoed|real\b|estate|percelen|kavel|grond|huis\b|\bn\.?v\b|\bb\.?v\b|stichting|bank|invest|project|notaris|kantoor|winkel|bouw", re.I)
#: Words that start a sentence of an advert and are no surnames; a name that no mark ends may run into one.
_STARTERS = frozenset(
    "aan aangeboden achter afgebakend afmeting afspraak alle app appartement ask bel beschikbaar betaling betegelde bezichtiging bij binnen bouwkavel bouwrijp busroute call centrum contact contactpersoon de deze dit door e een eigenaar eigendom er eventueel geen gelegen geschikt glis goed groetjes grond grondhuur grootte het heel hier hoek hoekkavel id ideaal identiteitskaart ik in inclusief info is kadasterkaart kavel kavels kijk kkf kom koop ligging mail maat met mijn mooi mooie mogelijk naast nabij neem nette nu objectnr objectnummer of omgeving omheind onder ons ook op oppervlakte papieren perceel perceelkaart plot prijs project quiet ref reageer rechthoekig rustig rustige ruilen scholen see serieuze sleutel stroom stuur te tegen tel tevens tweede u uitzicht unieke van vanaf veilig verkoop via volgens volmacht voor vraag vraagprijs vruchtbare vrij wat water we whatsapp wij woon zeer zie zonder".split()
)
#: Cheap tests before the patterns: one of these stands in every text in which the pattern can match.
_ADDRESS_CUES = ("adres", "woon", "wonend", "aan huis", "ophalen", "langskomen", "live at", "address")
_NAME_CUES = ("mevr", "dhr", "heer", "meneer", "mw", "mr", "namens", "oom", "tante", "neef", "nicht", "broer", "zus", "vader", "moeder", "man", "vrouw", "buurman", "ask for", "groet", "mvg", "afspraak maken", "vraag naar", "vragen naar", "mijn naam", "ik ben", "my name")
_ID_CUES = ("id", "legitim", "paspoort")
_CALL_CUES = ("bel ", "call ", "app ", "contact", "bezichtiging ")
_OPEN_CUES = ("contact", "naam", "eigenaar", "verkoper")
_AFTER_CUES = ("heeft de sleutel", "staat u graag", "helpt u graag", "is de eigenaar", "has the key")
_WORD_NUMBER = re.compile(rf"([^\W\d_][\w'-]*\.?)\s{_NR}?\d")
_SIX = re.compile(r"\b\d{3}[-. ]?\d{3}\b")
_FULL_ENDS, _ENDS = tuple(_FULL.split("|")), tuple(_SHORT.split("|"))


def _ends_as_street(word: str) -> bool:
    return word.endswith(_FULL_ENDS) or (word[-1] == "." and word[:-1].endswith(_ENDS) and len(word) > 5)


def _overlaps(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    return any(a < y and x < b for x, y in taken)


def _is_name(name: str) -> bool:
    words = name.split()
    return not _FIRM.search(name) and not (len(words) == 1 and (words[0].lower() in _STARTERS or len(words[0]) < 3)) and words[0].lower() not in _STARTERS


def _alike(a: str, b: str) -> bool:
    """Whether two words are written in one manner: capitals, a capital first, or none."""
    kind = lambda w: 0 if w.isupper() else 1 if w[:1].isupper() else 2
    return kind(a) == kind(b) or (bool(re.match(r"^[A-Z]\.", a)) and kind(b) < 2)


def find_personal(text: str, phones_too: bool = True) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of every find in a text, in order, without overlaps."""
    out, taken = [], []

    def take(a: int, b: int, kind: str, value: str) -> None:
        if a < b and not _overlaps(taken, a, b):
            taken.append((a, b))
            out.append((a, b, kind, value))

    if "@" in text or "at)" in text or "at]" in text or "at}" in text or "aartje" in text or "AT" in text:
        for m in _MAIL.finditer(text):
            take(*m.span(), "email", f"{m.group(1)}@{_DOT.sub('.', m.group(2))}".lower())
    low = text.lower()
    digits = re.search(r"\d", text)
    if digits:
        for m in _ID.finditer(text) if any(cue in low for cue in _ID_CUES) else ():
            if _ID_CUE.search(text[max(0, m.start() - 40) : m.start()]):
                take(*m.span(), "id", (m.group(1) + m.group(2) + m.group(3)).upper())
        if any(cue in low for cue in _ADDRESS_CUES):
            for m in _CUED.finditer(text):
                take(*m.span(1), "address", m.group(1))
        if any(_ends_as_street(m.group(1)) for m in _WORD_NUMBER.finditer(low)):
            for m in _OPEN.finditer(text):
                take(*m.span(1), "address", m.group(1))
        for m in _BIRTH.finditer(text) if "geb" in low or "born" in low or "birth" in low else ():
            take(*m.span(), "birth", f"{int(m.group(3)):04}-{int(m.group(2)):02}-{int(m.group(1)):02}")
        if phones_too:
            for m in _PHONE.finditer(text):
                number = re.sub(r"\D", "", m.group(1))
                if number.strip("0") and not _DATE_LIKE.match(m.group(1)) and not _NO_PHONE.search(text[max(0, m.start() - 30) : m.start()]):
                    take(*m.span(), "phone", number)
            for m in _ABROAD.finditer(text) if "+" in text or "00" in text else ():
                take(*m.span(), "phone", re.sub(r"\D", "", m.group(2)))
            for m in _SHORT_PHONE.finditer(text) if _SIX.search(text) else ():
                take(*m.span(1), "phone", re.sub(r"\D", "", m.group(1)))
    for m in _NAME_BEFORE.finditer(text) if any(cue in low for cue in _NAME_CUES) else ():
        if _is_name(m.group(1)):
            take(*m.span(1), "name", m.group(1))
    for m in _NAME_CALL.finditer(text) if digits and any(cue in low for cue in _CALL_CUES) else ():
        k = 1 if m.group(1) else 2
        if _is_name(m.group(k)):
            take(*m.span(k), "name", m.group(k))
    for m in _NAME_OPEN.finditer(text) if any(cue in low for cue in _OPEN_CUES) else ():
        first, second, gap, after = m.group(1), m.group(2), m.group(3), m.group(4)
        end = m.end(1)
        if second and not ("." in first and " " in first) and "." not in first:
            ended = bool(re.match(r"\s*[.,;!?)…]", text[m.end(2) :])) or m.end(2) == len(text.rstrip())
            surname = second.lower().split("-")[0] not in _STARTERS and _alike(first, second)
            if surname and (ended or not first.istitle() or not after[:1].islower() or after.lower().rstrip(":") in ("whatsapp", "mail", "identiteitskaart", "tel", "app")):
                end = m.end(2)
            elif surname and first.istitle() and after[:1].islower() and re.match(r"^\S+\s", text[m.end(2) :].lstrip()) and _starts_lower(text, m.end(2)):
                end = m.end(2)
        if _is_name(text[m.start(1) : end]):
            take(m.start(1), end, "name", text[m.start(1) : end])
    for pattern, cues in ((_NAME_AFTER, _AFTER_CUES), (_NAME_PHONE, ("(geen", "( geen", "(no"))):
        for m in pattern.finditer(text) if any(cue in low for cue in cues) else ():
            a, name = m.start(1), m.group(1)
            words = name.split()
            if len(words) == 2 and "." not in words[0]:
                if not _alike(*words) or words[0].lower() in _STARTERS or "-" in words[0] or _overlaps(taken, a, a + len(words[0])):
                    a, name = m.end(1) - len(words[1]), words[1]
            if _is_name(name):
                take(a, a + len(name), "name", name)
    return sorted(out)


def _starts_lower(text: str, at: int) -> bool:
    """Whether a name written in lower case starts the next sentence ("jerrel witamnore heeft de sleutel")."""
    return bool(re.match(rf"\s+{_LAST}(?:\s{_LAST})?\s+(?:heeft de sleutel|staat u graag)", text[at:], re.I))


_PHONES_NAME = re.compile(rf"^\s*{_TITLE}({_NAME})\s*[:,-]\s*(?=[+(\d])|\(\s*{_TITLE}({_NAME})\s*\)|\b(?:vragen naar|vraag naar|ask for|t\.a\.v\.|contact)\s+{_TITLE}({_NAME})|^\s*({_NAME})\s+(?=[+(\d][\d\s()./+-]{{5,}}$)|(?<=\d)\s+[-/]?\s*({_NAME})\s*$", re.I)
_NO_PHONES_NAME = frozenset("bel na tot en of u uur zie tekst geen sms whatsapp app tel telefoon mobiel thuis werk kantoor fax avond overdag weekend alleen via in op de het".split())


def find_in_phones(text: str) -> list[tuple[int, int, str, str]]:
    """Finds in an element of phones, where a number is what belongs there."""
    out = [x for x in find_personal(text, phones_too=False) if x[2] != "name"]
    taken = [(a, b) for a, b, _, _ in out]
    rest = "".join(" " if any(x <= i < y for x, y in taken) else c for i, c in enumerate(text))
    for m in _PHONES_NAME.finditer(rest):
        k = next(i for i in range(1, 6) if m.group(i))
        words = m.group(k).lower().split()
        if _is_name(m.group(k)) and not _NO_PHONES_NAME & set(words) and not _overlaps(taken, *m.span(k)):
            taken.append(m.span(k))
            out.append((*m.span(k), "name", m.group(k)))
    return sorted(out)


# ---------------------------------------------------------------- format-preserving pseudonyms


def feistel(value: int, size: int, key: bytes, tweak: bytes, rounds: int = 8, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1 (cycle walking keeps it inside)."""
    if size < 2:
        return value
    b = max(2, int(size**0.5))
    while b * b < size:
        b += 1
    order = range(rounds - 1, -1, -1) if back else range(rounds)
    while True:
        left, right = divmod(value, b)
        for i in order:
            if back:
                left, right = (right - _round(left, i, key, tweak)) % b, left
            else:
                left, right = right, (left + _round(right, i, key, tweak)) % b
        value = left * b + right
        if value < size:
            return value


def _round(half: int, i: int, key: bytes, tweak: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"%d|%d|" % (i, half) + tweak, key=key, digest_size=8).digest(), "big")


_DAY0, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049


@lru_cache(1 << 16)
def pseudonym(kind: str, value: str, key: bytes) -> str:
    """What stands for a value: a number of the same format, or a short keyed tag."""
    tweak = kind.encode()
    if kind == "phone" and value.isdigit():
        return f"{feistel(int(value), 10 ** len(value), key, tweak + str(len(value)).encode()):0{len(value)}}"
    if kind == "id" and re.fullmatch(r"[A-Z]{2}\d{6}", value):
        n = ((ord(value[0]) - 65) * 26 + ord(value[1]) - 65) * 10**6 + int(value[2:])
        n, digits = divmod(feistel(n, 676 * 10**6, key, tweak), 10**6)
        return f"{chr(65 + n // 26)}{chr(65 + n % 26)}{digits:06}"
    if kind == "birth":
        try:
            day = datetime.date.fromisoformat(value).toordinal() - _DAY0
        except ValueError:
            day = -1
        if 0 <= day < _DAYS:
            return datetime.date.fromordinal(_DAY0 + feistel(day, _DAYS, key, tweak)).isoformat()
    return hashlib.blake2b(" ".join(value.lower().split()).encode(), key=key, digest_size=4, person=tweak[:16]).hexdigest()


def redact(text: str | None, key: bytes, phones: bool = False) -> str | None:
    """The text with a placeholder for each find and all else unchanged."""
    if not text:
        return text
    out, last = [], 0
    finds = find_personal(text)
    if phones:  # numbers and names in phones
        finds = sorted(dict.fromkeys([*find_in_phones(text), *(x for x in find_personal(text) if x[2] == "phone")]))
    for a, b, kind, value in finds:
        if a >= last:
            out += [text[last:a], f"[{kind} {pseudonym(kind, value, key)}]"]
            last = b
    return "".join([*out, text[last:]])


# ---------------------------------------------------------------- over tables


def personal_finds(df: DataFrame, row_id: str = "record_id") -> DataFrame:
    """(row_id, field, kind, found): one row per distinct find in description and phones."""
    kind = df.schema[row_id].dataType.simpleString()
    told = F.nullif("description", F.lit("")).alias("d")
    listed = F.filter("phones", lambda p: p.rlike(r"\p{L}|@") & ~p.isin("zie tekst", "-", ""))
    rows = df.select(F.col(row_id).alias("i"), told, F.when(F.size(listed) > 0, listed).alias("p")).where("d is not null or p is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, d, p in zip(pdf["i"], pdf["d"], pdf["p"]):
                if isinstance(d, str):
                    out += dict.fromkeys((i, "description", k, v) for _, _, k, v in find_personal(d) if k != "birth")
                if p is not None and not isinstance(p, float):
                    out += dict.fromkeys((i, "phones", k, v) for x in p if x for _, _, k, v in find_in_phones(x) if k != "birth")
            yield pd.DataFrame(out, columns=[row_id, "field", "kind", "found"])

    return rows.mapInPandas(run, f"`{row_id}` {kind}, field string, kind string, found string")


def pseudonymised(df: DataFrame, key: str, row_id: str = "record_id") -> DataFrame:
    """(row_id, description, phones) with placeholders; every row of df comes out."""
    kind, secret = df.schema[row_id].dataType.simpleString(), hashlib.blake2b(key.encode(), digest_size=32).digest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.copy()
            out["description"] = [redact(x, secret) if isinstance(x, str) else None for x in pdf["description"]]
            out["phones"] = [None if p is None else [redact(x, secret, phones=True) for x in p] for p in pdf["phones"]]
            yield out

    return df.select(row_id, "description", "phones").mapInPandas(run, f"`{row_id}` {kind}, description string, phones array<string>")
