"""Personal information inside free text (problem 6).

Candidates are found by shape: addresses of mail, runs of digits, street names with a number, and pairs of words
that may be names. Labelers then vote for a kind, against, or not at all:

* shapes (regular expressions of each kind and of things that only look alike),
* gazetteers (the table of given names, and the family and given names that stand in telling places of this collection),
* the context before and behind.

Expectation-maximisation over the patterns of votes (Dawid and Skene 1979) estimates how reliable each labeler is, without labels. Its
posteriors train the span classifier, a softmax regression over votes and shape features, which decides.

All counts cover all documents: the patterns of votes with the shape features are few, and are counted in Spark.

Defined results: null and empty texts have none; a span that several candidates claim goes to the likeliest, then to the longest;
repeated rows of one id count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage, spread

KINDS = ("none", "email", "phone", "id_number", "address", "person")
NONE, EMAIL, PHONE, ID, ADDRESS, PERSON = range(6)
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS[1:]}

# --- shapes -------------------------------------------------------------------------------------------------------
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\s+dot\s+)"
_AT = r"(?:@|\s?[\[({]\s?at\s?[\])}]\s?|\s+at\s+(?=\S+\s?[\[(]?\s?dot))"
_MAIL = re.compile(rf"[^\W_][\w+%'-]*(?:{_DOT}[\w+%'-]+)*{_AT}[^\W_](?:[\w-]*[^\W_])?(?:{_DOT}[^\W_](?:[\w-]*[^\W_])?)+", re.I)
_SEP = r"[  .\-‐‑–/]"
_DIGITS = re.compile(
    r"(?<![\w#@.{])(?:"
    rf"(?:\+\s?|\(\s?\+?(?=[\d ]{{2,6}}\)))?\d(?:(?:{_SEP}{{1,3}}|\)\s?{_SEP}?|\s?\()?\d)+\d(?:\s?-\s?[A-Z](?![\w]))?"
    r"(?:,?\s?(?:ext|extension|poste|durchwahl|dw|x)\.?\s?\d{1,5})?"
    rf"|[A-Z]{{2}}(?: ?\d){{5,7}}(?: ?[A-Z])?(?!{_SEP}?\d)"
    r")(?![\w#])",
    re.I,
)
_RUN = re.compile(r"\d(?:[\s().\-‐‑–/]{0,4}\d){4,}")
#: Digits in words.
_SPELT = {
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "oh", "null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun",
    "zéro", "un", "deux", "trois", "quatre", "cinq", "sept", "huit", "neuf", "cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve",
}
_SPOKEN = re.compile(rf"(?<!\w)(?:(?:double |plus )?(?:{'|'.join(sorted(_SPELT))})(?:[ ,-]{{1,2}}|(?!\w))){{7,}}(?<=\w)", re.I)
#: Forms of telephone numbers.
_PHONE = re.compile(
    rf"(?:(?:\+|00)\s?\d{{1,3}}(?:{_SEP}{{0,3}}\(?\d{{1,5}}\)?){{2,6}}|\(\d{{3}}\)\s?\d{{3}}{_SEP}{{1,3}}\d{{4}}|1?{_SEP}?\d{{3}}{_SEP}{{1,3}}\d{{3}}{_SEP}{{1,3}}\d{{4}}"
    rf"|0\d{{2,4}}\s?/\s?\d{{4,8}}|0\d(?:[ .]\d\d){{4}}|0\d{{2,4}} \d{{4}} \d{{4}}|0\d{{2,4}} \d{{3}} \d{{4}}|0\d{{9,10}}|[1-9]\d{{9}})(?:,?\s?(?:ext|extension|poste|durchwahl|dw|x)\.?\s?\d{{1,5}})?",
    re.I,
)
#: Forms of identity, tax, passport and licence numbers.
_ID = re.compile(r"(?:\d{3}([- ]?)\d{2}\1\d{4}|\d\d\.\d\d\.\d\d-\d{3}\.\d\d|\d{8}-?[A-Z]|[A-Z]{2}\d{7}|[A-Z]{2}(?: ?\d){5,6} ?[A-Z]|\d{3}\.\d{3}\.\d{3}-\d\d|\d{11})", re.I)
#: Things with digits that are nobody's.
_OTHER = re.compile(r"(?:(?:19|20)\d\d-\d{1,2}-\d{1,2}|(?:19|20)\d\d[-/]\d{1,4}[-/]\d{1,4}|\d{1,3}(?:\.\d{1,3}){2,3}|\d{1,5}[-/]\d{1,3}|\d{1,6})")

_STREET = r"(?:street|st|road|rd|lane|ln|drive|dr|avenue|ave|court|ct|terrace|place|pl|square|sq|boulevard|blvd|way|crescent|close|row|hill)"
_FLAT = r"(?:,?\s(?:apt|apartment|flat|unit|suite|wohnung|whg|appt?|appartement|piso|puerta)\.?\s?\d{0,4}\s?[a-z]?\b)"
_NAME = r"[^\W\d_][^\W\d_'’-]+"
_NUMBER_FIRST = re.compile(
    r"\d(?:"
    rf"\d{{0,3}}\s?[a-z]?\s{_NAME}(?:\s{_NAME})?\s{_STREET}\b(?!\w){_FLAT}?"
    rf"|\d{{0,3}}(?:\s?(?:bis|ter|[a-d]))?,?\s(?:rue|avenue|place|chemin|boulevard|allée|impasse|quai|cours)\s(?:d[eu]s?\s(?:la\s)?|d['’])?{_NAME}{_FLAT}?"
    r")",
    re.I,
)
_NUMBER_LAST = re.compile(
    r"(?<![\w#/.-])(?:"
    rf"(?:calle|avenida|avda\.?|plaza|paseo|camino|carrer|ronda)\s(?:de\s(?:la\s|los\s)?|del\s)?{_NAME},?\s(?:n[.º°o]+\s?)?\d{{1,4}}(?:\s?[a-d]\b)?(?![\w])(?:,\s?\d{{1,2}}\s?[ºª°](?:\s?[a-z]\b)?)?{_FLAT}?"
    rf"|(?:{_NAME}[- ](?:allee|straße|strasse|str\.|weg|platz|gasse|ring|ufer|damm)|{_NAME}(?:allee|straße|strasse|str\.|weg|platz|gasse|ring|ufer|damm))\s\d{{1,4}}(?:\s?[a-d]\b)?(?![\w]){_FLAT}?"
    r")",
    re.I,
)
#: Parts of street names that stand before their number.
_STREET_WORDS = ("calle", "avenida", "avda", "plaza", "paseo", "camino", "carrer", "ronda", "allee", "straße", "strasse", "str.", "weg ", "platz", "gasse", "ufer ", "damm ")

_PART = r"[^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_]))+"
_FAMILY = rf"{_PART}(?:-{_PART})*"
_INITIALS = r"(?:[^\W\d_]\.\s?){0,3}"
_FULL = re.compile(rf"({_PART}(?:-{_PART})?)\s({_INITIALS})({_FAMILY})")
_TURNED = re.compile(rf"({_FAMILY}),\s({_PART})((?:\s[^\W\d_]\.)*)")
#: Words that a person's name follows.
_BEFORE = re.compile(
    r"(?:\b(?:name|nombre|nom|nome|naam|namn)\s?:\s*|\bmy name is |\bi am called |\bje m['’]appelle |\bme llamo |\bmein name ist |\bich heiße |\bmi nombre es |\bmon nom est |\b(?:sign(?:ed)?|written|sent|approved) (?:as|by) |\bregards,\s+|\bsincerely,\s+|\bgrüßen,?\s+|\bcordialement,\s+|\bsaludos,\s+"
    r"|\bsignée? par |\bfirmad[oa] por |\bunterschrieben von |\battn:? |\bask |\bcontact |\bdear |\bpregunte? (?:a|por) |\bdemandez |\bfragen sie |\b(?:mr|mrs|ms|dr|prof|herr|frau|mme|m|sra?|srta|madame|monsieur|señora?)\.?\s)$",
    re.I,
)
#: Where a field or a line ends behind a person's name.
_AFTER = re.compile(r"^\s*(?:[|;\t\n]|$)")
_TITLE = re.compile(r"^(?:mr|mrs|ms|dr|prof|herr|frau|mme|sra?|srta|madame|monsieur|señora?)\.?$", re.I)
#: Words before a number, by what they announce.
_SAY_PHONE = re.compile(r"(?:\b(?:tel|phone|call|mobile|cell|text|fax|portable|móvil|telefon|handynummer|téléphone|teléfono|appelez-moi|llámame|rufen sie|erreichbar unter|reachable (?:at|on)|ring|number is)\b[^\d|;\n]{0,24})$", re.I)
_SAY_ID = re.compile(r"(?:\b(?:id|identity|social security|sécurité sociale|seguridad social|identité|identidad|identificación|passport|passeport|pasaporte|reisepass\w*|licen[cs]e|permis|führerschein\w*|ausweis\w*|steuer\w*|tax|national|nif|dni|nie|ssn|fiscal\w*|personalausweis\w*)\b[^\d|;\n]{0,24})$", re.I)
_SAY_AFTER_ID = re.compile(r"^\W{0,2}\s?(?:expires|expired|valid|caduca|caducó|válid[oa]|valable|expire|läuft|gültig|gilt)", re.I)
_SAY_OTHER = re.compile(r"(?:\b(?:ticket|version|room|building|floor|shipped|address|range|order|item|page|chapter|since|seit|depuis|desde|dal|qty|port|line|units?|percent|invoice|code)\b[^\d\n]{0,12}|[#$€£=<>{x]\s?)$", re.I)
_SAY_PLACE = re.compile(r"(?:\b(?:address|ship to|deliver(?:y|ed)?(?: it)?(?: to)?|office is|live (?:at|in)|adresse|anschrift|dirección|livraison au|habite|vivo en|entrega en|wohnt? in der|lieferung (?:bitte )?an|oficina|bureau|büro)\b\W{0,3}(?:\w{1,3}\s)?)$", re.I)
_SAY_MAIL = re.compile(r"(?:\b(?:mail|e-mail|courriel|correo|cc|to|at|login is|écrire à|reach me at|schreiben|unter)\b\W{0,3})$", re.I)


@dataclass
class Names:
    """Gazetteers: given names of the table, and names that stand in telling places of the collection (bounded)."""

    given: frozenset[str]
    learned_given: frozenset[str] = frozenset()
    learned_family: frozenset[str] = frozenset()

    def finder(self) -> ahocorasick.Automaton:
        """Names by their length, telling words by minus one; made once a worker."""
        found = self.__dict__.get("_finder")
        if found is None:
            found = ahocorasick.Automaton()
            for w in _ANCHORS:
                found.add_word(w, -1)
            for w in self.given | self.learned_given | self.learned_family:
                found.add_word(w, len(w))
            found.make_automaton()
            self.__dict__["_finder"] = found
        return found

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_finder"}


def _votes(kind: int, *ballots: int | None) -> str:
    """Votes as text: a kind's digit, or a dot for none; the candidate's own kind first."""
    return str(kind) + "".join("." if b is None else str(b) for b in ballots)


def _case(word: str) -> str:
    return "A" if word.isupper() and len(word) > 1 else "a" if word.islower() else "T" if word[:1].isupper() else "m"


def candidates(text: str, names: Names) -> Iterator[tuple[int, int, int, str, str]]:
    """(begin, end, kind, votes, shape) of every span that may be personal information."""
    low = text.lower()
    if "@" in low or any(x in low for x in ("at]", "at)", "at ]", "at )", "at}", " dot ")):
        for m in _MAIL.finditer(text):
            before = text[max(0, m.start() - 30) : m.start()]
            made = "@" in m[0]
            yield m.start(), m.end(), EMAIL, _votes(EMAIL, EMAIL, EMAIL if made else None, EMAIL if _SAY_MAIL.search(before) else None), "mail" if made else "mail words"
    done = -1
    for run in _RUN.finditer(text):
        if run.start() < done:
            continue
        for m in _DIGITS.finditer(text, max(done, run.start() - 5, 0), min(len(text), run.end() + 24)):
            if m.start() >= run.end():
                break
            done = m.end()
            if (x := _number(text, m.start(), m.end())) is not None:
                yield x
    if sum(w in low for w in ("zero", "five", "nine", "zéro", "cinq", "neuf", "cero", "cinco", "nueve", "null", "fünf", "neun")) > 1:
        for m in _SPOKEN.finditer(text):
            before = text[max(0, m.start() - 48) : m.start()]
            yield m.start(), m.end(), PHONE, _votes(PHONE, PHONE, None, None, ID if _SAY_ID.search(before) else PHONE if _SAY_PHONE.search(before) else None), "spoken"
    yield from _places(text, _NUMBER_FIRST)
    if any(w in low for w in _STREET_WORDS):
        yield from _places(text, _NUMBER_LAST)
    yield from _people(text, low, names)


def _number(text: str, begin: int, end: int) -> tuple[int, int, int, str, str] | None:
    s = text[begin:end]
    n = sum(c.isdigit() for c in s)
    lettered = s[:2].isalpha()
    if lettered and s[:2].lower() in _COMMON | _JOINING:
        # a word before the number, not its series
        begin, lettered = begin + len(s) - len(s[2:].lstrip()), False
        s = re.sub(r" [^\W\d_]$", "", text[begin:end])
        end = begin + len(s)
    if n > 18 or n < (5 if lettered else 7) or lettered and not _ID.fullmatch(s):
        return None
    before, after = text[max(0, begin - 48) : begin], text[end : end + 24]
    phone, id_, other = bool(_PHONE.fullmatch(s)), bool(_ID.fullmatch(s)), bool(_OTHER.fullmatch(s))
    kind = ID if id_ and not phone else PHONE
    said = ID if _SAY_ID.search(before) or _SAY_AFTER_ID.search(after) else PHONE if _SAY_PHONE.search(before) else NONE if _SAY_OTHER.search(before) else None
    size = ID if n < 10 else PHONE
    shape = re.sub(r"\d+", lambda d: str(min(len(d[0]), 9)), re.sub(r"[^\W\d_]", "A", s))[:24]
    return begin, end, kind, _votes(kind, PHONE if phone else None, ID if id_ else None, NONE if other and not (phone or id_) else None, said, size, NONE if not (phone or id_) else None), shape


def _places(text: str, form: re.Pattern) -> Iterator[tuple[int, int, int, str, str]]:
    for m in form.finditer(text):
        before = text[max(0, m.start() - 40) : m.start()]
        if before and (before[-1].isalnum() or before[-1] in "_#/.-"):
            continue
        words = re.findall(_NAME, m[0])
        common = any(w.lower() in _COMMON - _LINKS for w in words)
        told = bool(_SAY_PLACE.search(before))
        yield m.start(), m.end(), ADDRESS, _votes(ADDRESS, ADDRESS, ADDRESS if told else None, NONE if common else ADDRESS, NONE if _SAY_OTHER.search(before) and not told else None), "place" + str(len(words)) + ("f" if re.search(_FLAT, m[0], re.I) else "")


#: Ordinary words that stand between a number and a word like "place" by chance.
_COMMON = frozenset("the a of in on for to is was and or guests words days weeks minutes years units percent invoice first second one per your my this that our la el los de des le les mit und für en of er et un une una this same own".split())


_LINKS = frozenset("de la los del des le les du of the".split())
#: Words that a place for a name may follow.
_ANCHORS = (
    "name:", "name :", "name is", "name ist", "nombre:", "nombre :", "nombre es", "nom:", "nom :", "nom est", "nome:", "naam:", "namn:", "am called", "appelle", "llamo", "heiße", "sign as", "sign by", "signed as", "signed by", "written by", "sent by", "approved by", "signé par", "signée par", "firmado por", "firmada por", "unterschrieben von", "attn",
    "regards", "sincerely", "cordialement", "saludos", "grüßen", " ask", "\nask", "contact", "dear", " mr", " ms", " dr", "prof.", "herr", "frau", " mme", "madame", "monsieur", "señor", " sra", "srta", "pregunt", "demandez", "fragen sie",
)


def _openings(text: str, ends: list[int]) -> Iterator[int]:
    """Places behind telling words where a name may begin."""
    last = -1
    for e in ends:
        for k, m in enumerate(_GAP.finditer(text, max(e - 1, last + 1), min(len(text), e + 30))):
            if k > 2:
                break
            at = m.end()
            if at > last and text[at : at + 1].isalpha():
                last = at
                if _BEFORE.search(text[max(0, at - 30) : at]):
                    yield at


_GAP = re.compile(r"[\s:]+")


def _people(text: str, low: str, names: Names) -> Iterator[tuple[int, int, int, str, str]]:
    if len(low) != len(text):  # a letter that is longer in lower case would shift what follows
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    told, named = [3] if low.startswith("ask ") else [], []
    for e, n in names.finder().iter(low):
        begin = e - n + 1
        if n < 0:
            told.append(e + 1)
        elif (begin == 0 or not (low[begin - 1].isalnum() or low[begin - 1] in "_'’@.-")) and low[e + 1 : e + 2] in (" ", ",", "-", " "):
            named.append(begin)
    seen: set[int] = set()
    for at in _openings(text, told):
        seen.add(at)
        yield from _person(text, at, names, True)
    for at in named:
        if at not in seen:
            yield from _person(text, at, names, False)


def _person(text: str, at: int, names: Names, told: bool) -> Iterator[tuple[int, int, int, str, str]]:
    m, turned = _FULL.match(text, at), False
    if not m or "," in text[at : m.end()]:
        m, turned = _TURNED.match(text, at), True
        if not m:
            return
    if turned:
        family, given, initials = m[1], m[2], m[3]
    else:
        given, initials, family = m[1], m[2], m[3]
    if _TITLE.match(given) or "\n" in m[0]:
        return
    g, f = given.lower(), family.lower()
    known_g = g in names.given
    learned = g in names.learned_given
    fam = f in names.learned_family or "-" in f and any(x in names.learned_family for x in f.split("-"))
    if not told and not (known_g or learned) and not fam:
        return
    # in running text a word of the gazetteers may be any word: then the case or the other word must say that it is a name
    if not told and not (fam and (known_g or learned or _case(given) != "a")) and _case(given) + _case(family.split("-")[0]) != "TT":
        return
    before, after = text[max(0, at - 30) : at], text[m.end() : m.end() + 16]
    case = _case(given) + _case(family.split("-")[0])
    even = case in ("TT", "AA", "aa")
    plain = case == "aa" or case == "Ta"
    tail = bool(_AFTER.match(after))
    votes = _votes(
        PERSON,
        PERSON if told else None,
        PERSON if known_g else None,
        PERSON if learned else None,
        PERSON if fam else None,
        PERSON if tail and told else None,
        NONE if plain and not told and not fam else None,
        None if even else NONE,
        NONE if f in _COMMON or g in _COMMON or f in _JOINING else None,
    )
    yield at, m.end(), PERSON, votes, "turned " + case if turned else ("initial " if initials.strip() else "full ") + case


#: Words that follow a name or a word without being one.
_JOINING = frozenset("and y et und from is has was who will ist hat est es a the for with over om op er period garden een in of to von de la le on that this i".split())


# --- statistics over the collection -----------------------------------------------------------------------------------
def learn_names(docs: DataFrame, given: frozenset[str], min_count: int = 2, max_names: int = 100_000) -> Names:
    """Names that stand in telling places, counted over all documents.

    A name counts from ``min_count`` places on and from a share of one in ``max_names`` of all places, so there are never more than that.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, finder, c = Names(given), Names(frozenset()).finder(), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                low = t.lower()
                for at in _openings(t, [e + 1 for e, _ in finder.iter(low)]) if len(low) == len(t) else ():
                    for begin, end, *_, shape in _person(t, at, names, True):
                        if shape.startswith("full") and shape[-2:] in ("TT", "AA"):
                            g, *_, f = t[begin:end].lower().split()
                            c["g" + g] += 1
                            c["f" + f] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["name", "n"])

    rows = cut_lineage(spread(docs.select("text")).mapInArrow(tell, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "names")
    total = rows.agg(F.sum("n")).first()[0] or 0
    top = rows.where(F.col("n") * max_names >= total).collect()
    word = lambda s: s not in _JOINING and s not in _COMMON
    return Names(given, frozenset(r[0][1:] for r in top if r[0][0] == "g" and word(r[0][1:])), frozenset(r[0][1:] for r in top if r[0][0] == "f" and word(r[0][1:])))


class SpanModel:
    """Reliabilities of the labelers by expectation-maximisation, and the classifier trained on its posteriors."""

    def __init__(self, rows: list[tuple[str, str, int]], rounds: int = 25, epochs: int = 300) -> None:
        self.features: dict[str, int] = {}
        self.right: dict[tuple[str, int], float] = {}
        weight = np.array([r[2] for r in rows], float)
        post = self._em([r[0] for r in rows], weight, rounds)
        each = [self._active(v, s, grow=True) for v, s, _ in rows]
        self.w = np.zeros((len(self.features), len(KINDS)))
        if not rows:
            return
        # the features of a row as a list of numbers: a row has a dozen of them, whatever their number in all
        flat, first = np.concatenate(each), np.cumsum([0, *map(len, each[:-1])])
        owner = np.repeat(np.arange(len(rows)), list(map(len, each)))
        share = np.sqrt(weight) / np.sqrt(weight).sum()
        for _ in range(epochs):
            z = np.add.reduceat(self.w[flat], first, axis=0)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            off = ((p - post) * share[:, None])[owner]
            self.w -= 4.0 * (np.stack([np.bincount(flat, off[:, k], len(self.w)) for k in range(len(KINDS))], 1) + 1e-5 * self.w)

    def _em(self, votes: list[str], weight: np.ndarray, rounds: int) -> np.ndarray:
        """Posterior over kinds per pattern. A labeler is (kind of candidate, place in the pattern); kinds other than the candidate's or
        one that was voted for are out. Estimated are the chance that a labeler's vote is right, and how many candidates of a kind are nothing;
        before any count these are eight of ten, and a third."""
        n, width = len(votes), max((len(v) for v in votes), default=1) - 1
        kind = np.array([int(v[0]) for v in votes], np.int64)
        vote = np.full((n, width), -1)
        for i, v in enumerate(votes):
            vote[i, : len(v) - 1] = [-1 if c == "." else int(c) for c in v[1:]]
        cast = vote >= 0
        allowed = (np.arange(len(KINDS)) == kind[:, None]) | (np.arange(len(KINDS)) == NONE)
        for j in range(width):
            allowed |= (np.arange(len(KINDS)) == vote[:, j : j + 1]) & cast[:, j : j + 1]
        others = np.maximum(2, allowed.sum(axis=1)) - 1
        right, nothing = np.full((len(KINDS), width), 0.8), np.full(len(KINDS), 0.35)
        post = np.zeros((n, len(KINDS)))
        for _ in range(rounds):
            none = nothing[kind][:, None]
            logs = np.where(np.arange(len(KINDS)) == NONE, np.log(none), np.log(1 - none))
            for j in range(width):
                r = right[kind, j][:, None]
                said = np.where(np.arange(len(KINDS)) == vote[:, j : j + 1], np.log(r), np.log((1 - r) / others[:, None]))
                logs = logs + np.where(cast[:, j : j + 1], said, 0.0)
            logs = np.where(allowed, logs, -np.inf)
            post = np.exp(logs - logs.max(axis=1, keepdims=True))
            post /= post.sum(axis=1, keepdims=True)
            for j in range(width):
                at = np.flatnonzero(cast[:, j])
                hit = np.bincount(kind[at], weight[at] * post[at, vote[at, j]], len(KINDS))
                right[:, j] = (8 + hit) / (10 + np.bincount(kind[at], weight[at], len(KINDS)))
            right = np.clip(right, 0.55, 0.99)  # no labeler is taken for certain, or for a contrarian
            nothing = np.clip((35 + np.bincount(kind, weight * post[:, NONE], len(KINDS))) / (100 + np.bincount(kind, weight, len(KINDS))), 0.05, 0.95)
        self.right = {(KINDS[k], j): float(right[k, j]) for k in range(1, len(KINDS)) for j in range(width)}
        self.nothing = {KINDS[k]: float(nothing[k]) for k in range(1, len(KINDS))}
        return post

    def _active(self, votes: str, shape: str, grow: bool = False) -> list[int]:
        names = ["1", "k" + votes[0], "s" + votes[0] + shape, "v" + votes, *(f"{votes[0]}{j}{c}" for j, c in enumerate(votes[1:]))]
        if grow:
            return [self.features.setdefault(f, len(self.features)) for f in names]
        return [self.features[f] for f in names if f in self.features]

    def decide(self, votes: str, shape: str) -> tuple[int, float]:
        z = self.w[self._active(votes, shape)].sum(axis=0)
        ok = np.zeros(len(KINDS), bool)
        ok[[NONE, int(votes[0]), *(int(c) for c in votes[1:] if c != ".")]] = True
        z = np.where(ok, z, -np.inf)
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return k, float(p[k] / p.sum())


class PersonalInformation:
    """Found spans and redacted texts of a table of documents."""

    def __init__(self, docs: DataFrame, given_names: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_patterns: int = 20_000, max_given: int = 1_000_000) -> None:
        """The table of given names goes to all tasks; more than ``max_given`` of them are an error."""
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
        given = frozenset(r[0].lower() for r in given_names.select("given_name").where("given_name IS NOT NULL").distinct().limit(max_given + 1).collect())
        if len(given) > max_given:
            raise ValueError(f"more than {max_given} given names")
        names = learn_names(self.docs, given)
        self.shared_names = docs.sparkSession.sparkContext.broadcast(names)  # bounded by max_names
        shared = self.shared_names

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cols: list[list] = [[] for _ in range(6)]
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for begin, end, _, votes, shape in candidates(t, shared.value):
                        for c, v in zip(cols, (d, begin, end, t[begin:end], votes, shape)):
                            c.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "begin", "end", "found", "votes", "shape"])

        self.spans = cut_lineage(spread(self.docs).mapInArrow(find, "doc_id long, begin int, end int, found string, votes string, shape string"), "candidates")
        # the classifier sees the commonest patterns, at most max_patterns; every span is judged
        rows = self.spans.groupBy("votes", "shape").count().orderBy(F.desc("count"), "votes", "shape").limit(max_patterns).collect()
        self.model = SpanModel([tuple(r) for r in rows])

    def found(self) -> DataFrame:
        """(doc_id, begin, end, kind, found_text, confidence) of every span that holds personal information."""
        shared = self.docs.sparkSession.sparkContext.broadcast(self.model)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[tuple[str, str], tuple[int, float]] = {}
            for b in batches:
                kinds, sure = [], []
                for key in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
                    if key not in known:
                        known[key] = shared.value.decide(*key)
                    k, p = known[key]
                    kinds.append(KINDS[k])
                    sure.append(round(p, 6))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(kinds, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "begin", "end", "found_text", "kind", "confidence"])

        named = self.spans.mapInArrow(judge, "doc_id long, begin int, end int, found_text string, kind string, confidence double").where("kind <> 'none'").distinct()
        # of spans that overlap the longest stays, then the surest; a document's spans are few beside its text
        each = named.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((F.col("begin") - F.col("end")).alias("o"), (-F.col("confidence")).alias("c"), "begin", "end", "kind", "found_text", "confidence"))).alias("s"))
        taken = F.aggregate(
            "s",
            F.expr("cast(array() as array<struct<o:int,c:double,begin:int,end:int,kind:string,found_text:string,confidence:double>>)"),
            lambda acc, x: F.when(F.exists(acc, lambda y: (y["begin"] < x["end"]) & (x["begin"] < y["end"])), acc).otherwise(F.concat(acc, F.array(x))),
        )
        return each.select("doc_id", F.explode(taken).alias("x")).select("doc_id", "x.begin", "x.end", "x.kind", "x.found_text", "x.confidence")

    def pieces(self) -> DataFrame:
        """(doc_id, kind, found_text): each distinct piece of a document once."""
        return self.found().select("doc_id", "kind", "found_text").distinct()

    def redacted(self) -> DataFrame:
        """(doc_id, text, n_found) with a typed placeholder in the place of every span."""
        by = self.found().groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("begin", "end", "kind"))).alias("s"))

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, n = [], []
                for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    parts, at = [], 0
                    for x in s or ():
                        parts += [t[at : x["begin"]], PLACEHOLDER[x["kind"]]]
                        at = x["end"]
                    texts.append("".join((*parts, t[at:])))
                    n.append(len(s or ()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int32())], names=["doc_id", "text", "n_found"])

        return self.docs.join(by, "doc_id", "left").mapInArrow(put, "doc_id long, text string, n_found int")
