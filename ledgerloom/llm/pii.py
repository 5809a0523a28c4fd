"""Personal data in free text (problem 7).

A semi-Markov conditional random field over whole spans: every place of a text
where a mention could begin yields candidate segments with a type and features
of the span as a whole and of what surrounds it.  The score of a segmentation is
the sum of its segments' scores, text outside has none, and segments do not
overlap; dynamic programming over the segments' ends finds the best one, so that
boundaries and types are settled together.

What the field knows comes from the data: given names from the name columns, towns
and countries from the address columns, common words from the texts.  The weights
are fitted by gradient ascent on the conditional likelihood, summed over all
segmentations by the forward and backward recursions, of texts that repeat what
their record holds in a column, or that name a person by a known given name; in
half of these the given name is hidden, so that the words around a name are
learnt and tell names that no list holds.
"""

from __future__ import annotations

import bisect
import functools
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import names as nm
from ledgerloom.llm.addresses import mine_towns
from ledgerloom.llm.addresses import read as read_address
from ledgerloom.llm.names import plain
from ledgerloom.llm.tries import Trie, errors_allowed
from ledgerloom.session import written

#: The weights are fitted on so many labelled texts at most, those of the smallest hash and of so many characters or less, in so many rounds.
FIT_CHARS = 20_000
FIT_TEXTS, EPOCHS, RATE, PULL = 5_000, 30, 0.3, 0.0003
#: Share of the labelled texts whose given names and kinds of street the fit does not see.
HIDDEN = 0.5
#: A word is common if it is one in so many of all words, so that there are at most so many, and is mostly written small.
COMMON_ONE_IN = 1_000_000
#: Longest mention in characters, by type: the bound of the segments.
LONGEST = {"EMAIL": 254, "PHONE": 40, "ID": 30, "ADDRESS": 200, "NAME": 80}

# Shapes of the parts.
_UP = r"A-ZÀ-ÖØ-Þ"
_LETTER = r"A-Za-zÀ-ÖØ-öø-ÿ"
_AT = r"(?:\s?@\s?|\s?[(\[{]at[)\]}]\s?|\sat\s)"
_DOT = r"(?:\.|\s?[(\[{](?:dot|\.)[)\]}]\s?|\sdot\s)"
EMAIL = re.compile(rf"(?<![\w.+@-])[A-Za-z0-9](?:[\w.+-]*[A-Za-z0-9_])?{_AT}[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,12}}(?![\w@])", re.I)
PHONE = re.compile(
    r"(?<![\w.+/-])(?:\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d(?:[ .-]?\d){6,12}|00\d{2}[ -]\d(?:[ -]?\d){6,11}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|0\d(?:\.\d{2}){4}|0\d(?: \d{2}){4}|0\d{2,4}/\d{5,9}|0\d{2,4} \d{3,4} \d{3,4})(?: ?(?:ext\.?|x) ?\d{1,5})?(?![\w-]|\.\d|/\d)"
)
ID_CUES = r"SSN|social security (?:no\.?|number)|NINO|NI (?:number|no\.?)|national insurance (?:no\.?|number)|Personalausweis(?:-?Nr\.?|nummer)?|Ausweis-?Nr\.?|Reisepass(?:-?Nr\.?|nummer)?|carte d['’]identité(?: n°)?|passeport(?: n°)?|passport(?: (?:no\.?|number))?|Steuer-?ID(?:-?Nr\.?)?|driving licen[cs]e(?: no\.?)?|driver['’]s licen[cs]e|Führerschein(?:-?Nr\.?)?|DNI|NIE|NIR|ID card(?: no\.?)?|n° (?:de )?sécurité sociale|Sozialversicherungs(?:nummer|-?Nr\.?)"
ID_SHAPE = r"\d{3}[- ]\d{2}[- ]\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]\d[A-Z]\d{6,7}|[A-Z]{2}\d{7}|\d{2} \d{3} \d{3} \d{3}|[A-Z]{5}\d{6}[A-Z0-9]{3,5}|\d{8}[A-Z]|[XYZ]\d{7}[A-Z]|\d{12}|\d \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?|[A-Z0-9]{8,12}"
_NUM = r"(?:(?:[Nn][or]\.?|NO\.|NR\.|[Nn]°|N°|#) ?)?\d{1,4}(?:[ -]?[a-hA-H](?![\w.']))?"
_WORD = rf"[{_LETTER}][{_LETTER}0-9'’]+"
_KIND = r"(?i:street|str\.?|st\.?|road|rd\.?|avenue|ave\.?|av\.?|lane|ln\.?|la\.?|drive|dr\.?|square|sq\.?|close|cl\.?|boulevard|blvd\.?|boul\.?|bd\.?|court|ct\.?|way|terrace|place|pl\.?|plaza|crescent)"
_FRENCH = r"(?i:rue|r\.?|avenue|ave\.?|av\.?|boulevard|boul\.?|bd\.?|blvd\.?|place|pl\.?|pce|chemin|quai|allée)"
_SMALL = r"(?:(?:de|du|des|la|le|les) |l['’]|d['’])*"
_GERMAN = rf"[{_LETTER}0-9]{{3,}}(?i:stra(?:ß|ss)e|platz|weg|allee|gasse|str\.|pl\.|w\.|al\.)"
_SEP = r"(?:\s*[,;|]\s*|\s+-\s+|\s*\n|\s+)"
STREET = re.compile(
    rf"(?<![\w#°])(?:{_NUM}(?:,? )(?:[{_UP}][{_LETTER}'’]+ ){{0,3}}{_WORD} {_KIND}(?![{_LETTER}])|{_NUM},? {_FRENCH} {_SMALL}{_WORD}|{_NUM},? {_GERMAN}(?![{_LETTER}])|{_GERMAN} {_NUM}|{_WORD} (?:Str|STR|str)\.? {_NUM}|{_WORD} {_KIND} {_NUM}|{_FRENCH} {_SMALL}{_WORD},? {_NUM})(?![\w])"
)
#: A number and capitalised words, whatever the kind of street is called; only with a town or a code behind.
UNNAMED_STREET = re.compile(rf"(?<![\w#°.,-]){_NUM},? (?:[{_UP}][{_LETTER}'’]+ ){{0,3}}[{_UP}][{_LETTER}'’]{{2,}}(?=\s*[,;|]|\s+-\s|\s*\n)")
#: One of these words, or a word with one of these ends, is in every street.
_KIND_WORDS = frozenset(("street", "str", "st", "road", "rd", "avenue", "ave", "av", "lane", "ln", "la", "drive", "dr", "square", "sq", "close", "cl", "boulevard", "blvd", "boul", "bd", "court", "ct", "way", "terrace", "place", "pl", "plaza", "crescent", "rue", "r", "pce", "chemin", "quai", "allée"))
_KIND_ENDS, _KIND_SHORT = ("straße", "strasse", "platz", "weg", "allee", "gasse"), ("str.", "pl.", "w.", "al.")
_LETTERS = re.compile(rf"[{_LETTER}]+")
_SEPARATOR = re.compile(_SEP)
_UNIT = re.compile(rf"{_SEP}(?i:(?:unit|suite|ste\.?|apt\.?|floor|room|bldg\.?|building|etage|stock)\s*[#.]?\s*(?:\d+[a-z]?|[a-z])\b|\d+(?:st|nd|rd|th|er|e) (?:floor|étage)|hinterhaus|vorderhaus|attn:? ?\w+)")
_CODE = re.compile(rf"{_SEP}(\d{{5}})(?!\d)")
_REGION = re.compile(rf"(?:{_SEP}([A-Z]{{2}}|[a-z]{{2}})(?= \d{{5}}|\s*(?:[,;|]|\n|$)|[.)]| - )|(?:, ?| \| |; ?| )([A-Z]{{2}})(?= ))")
_TOWNWORD = re.compile(rf"[{_LETTER}][{_LETTER}0-9'’.]*(?:-[{_LETTER}0-9]+)*")
_TITLE = r"(?:(?i:mr|mrs|ms|mx|miss|dr|prof|hon|herr|frau|mme|mlle|m)\.?) "
_INITIAL = rf"[{_UP}a-z]\.?"
_SUR = rf"[{_LETTER}][{_LETTER}0-9'’]{{3,}}(?:-[{_LETTER}][{_LETTER}0-9'’]{{3,}})?"
_ANY = rf"[{_UP}][{_LETTER}'’]{{2,}}"
_WORDS = re.compile(rf"(?<![\w@.'’-])[{_LETTER}]{{2,30}}(?![\w@'’])")
#: Capitalised words in a row, with initials among them.
_CAPITALS = re.compile(rf"(?<![\w@.'’&/-])[{_UP}][{_LETTER}'’]+(?:-[{_UP}][{_LETTER}'’]+)?(?: [{_UP}]\.?(?= ))*(?: [{_UP}][{_LETTER}'’]+(?:-[{_UP}][{_LETTER}'’]+)?){{1,2}}(?![\w@'’])")
_AFTER_GIVEN = re.compile(rf"\.?(?: {_INITIAL}(?= ))* (?:{_SUR})(?![\w@'’])")
_SURNAME_BEFORE = re.compile(rf"(?<![\w@.'’-])(?:{_SUR})(,?) $")
_INITIAL_BEHIND = re.compile(rf"(?:\.?(?: [{_UP}a-z]\.|(?: [{_UP}])(?![\w.])))?")
#: Forms that only count where something speaks for a person.
SPOKEN_FORMS = (
    ("initials", re.compile(rf"[{_UP}a-z]\.?(?: [{_UP}a-z]\.?)* (?:{_SUR})(?![\w@'’])")),
    ("initial_last", re.compile(rf"(?:{_SUR}),? [{_UP}](?:\.|(?= |$|\n))(?: ?[{_UP}]\.)?")),
    ("two_words", re.compile(rf"{_ANY} (?:[{_UP}]\. )?{_SUR}(?![\w@'’])")),
)
#: Words before and after a person's name; the fit adds those of the data.
BEFORE = re.compile(rf"(?:(?i:signed|signé|gez\.|cc|verified by|approved by|served by|please call|call|contact ?:|queries to|mailed to|attn:?|c/o|member:|cashier:|kassierer:|kassiererin:|es bediente sie|ihr kassierer|rückfragen bitte an|livraison chez|bitte an|ask for|chez)|\b(?:and|und|et)) (?:{_TITLE})?$")
PARTY = re.compile(rf"(?:^|\n)(?i:bill to|client|kunde|customer|sold to) ?: ?(?:{_TITLE})?$")
AFTER = re.compile(r"^(?: asked us| on the phone| on \+?[\d(]| \(Tel|\.?(?:\n|$)| - |, [\w.+-]+ ?[@(\[]|, [\w.+-]+ at | before dispatch| at \S| and | / |\. )")
#: Words that announce a name, in small letters; those that end in a colon may have a blank before it.
_CUES = ("signed", "signé", "gez.", "verified by", "approved by", "served by", "please call", "call", "queries to", "mailed to", "attn", "attn:", "c/o", "member:", "cashier:", "kassierer:", "kassiererin:", "es bediente sie", "ihr kassierer", "rückfragen bitte an", "livraison chez", "bitte an", "ask for", "chez")
_CUES += tuple(w + c for w in ("contact", "bill to", "client", "kunde", "customer", "sold to") for c in (":", " :"))
_TITLE_WORDS = frozenset({"m", "mr", "mrs", "dr", "mme", "mlle", "ms", "mx", "miss", "prof", "hon", "herr", "frau"})
#: Those that must begin a word.
_WHOLE = ("cc", "and", "und", "et", *(t + dot for t in sorted(_TITLE_WORDS) for dot in ("", ".")))
_TITLE_AT = re.compile(_TITLE)
TITLED = re.compile(rf"(?<!\w){_TITLE}$")
FIRM = re.compile(r"^[ ,]*(?:&|\+|(?i:ltd|limited|gmbh|mbh|ag|llc|inc|sarl|b\.?v\.?|a\.g\.|co\b|company|electrical|technologies|freight|consulting|publishing|wholesale|manufacturing|chemicals|packaging|marine|landscaping|insurance|engineering|trading|property|foods|textiles|furniture|logistics|dental|printing|coffee|supermarket|pharmacy|restaurant|bakery|hardware|filling|garden|bookshop|butchers)\b)")
WHERE = re.compile(r"(?i:lieferadresse|ship to|deliver to|tenant at|mailed to .{3,60} at|livraison chez .{3,60}|address|adresse|ring|at|to|:)[:, ]*$")
_NOT_NAME = {"bill", "tax", "order", "date", "from", "total", "rack", "room", "meter", "valid", "late", "our", "all", "the", "ship", "lot", "signed", "please", "reverse", "payment", "warranty", "partial", "prices", "goods", "delivery", "tracking", "firmware", "batch", "follow", "amounts", "figures", "payee", "quantities", "replaces", "thank", "merci", "contact", "zahlbar", "montants", "settlement", "payable", "totals", "values", "angaben", "served", "member", "paid"}

#: Start of the fit: what a span of each kind is worth, and what its surroundings add.
PRIOR = {
    "EMAIL": 4.0, "EMAIL:spaced": -0.5, "EMAIL:word_at": -2.5, "EMAIL:hidden_dot": 3.0, "PHONE": 3.0, "PHONE:long": 1.0, "ID:cue": 5.0, "ID:bare": -6.0, "ID:marked": 4.5,
    "ADDRESS": 1.0, "ADDRESS:code": 2.0, "ADDRESS:town": 2.0, "ADDRESS:region": 0.5, "ADDRESS:unit": 0.5, "ADDRESS:country": 0.5, "ADDRESS:where": 1.0, "ADDRESS:front": 1.0, "ADDRESS:part": 0.3,
    "PRICED": -0.5, "ADDRESS:unnamed": -2.5, "NAME:capitals": -3.5, "NAME:trade": -3.0, "NAME:inside": -1.0, "NAME:place": -2.0,
    "NAME:given_first": 2.0, "NAME:given_last": 1.5, "NAME:given_after": 0.5, "NAME:initials": -2.0, "NAME:initial_last": -3.5, "NAME:two_words": -4.0, "NAME:before": 3.0, "NAME:party": 2.5, "NAME:after": 0.8, "NAME:title": 2.5, "NAME:firm": -9.0, "NAME:common": -9.0, "NAME:size": 0.1,
}


@functools.lru_cache(maxsize=200_000)
def _key(word: str) -> str:
    """:func:`plain` of a word, kept for the next time."""
    return plain(word)


class Gazetteer:
    """What the columns teach: texts of towns, towns near which a misspelt text is one, what follows a town, given names, common words, words of trades."""

    def __init__(self, towns, names, countries, given=(), common=(), trades=()):
        self.towns, self.countries = frozenset(towns), frozenset(countries)
        self.given, self.common, self.kinds = frozenset(given), frozenset(common), True
        self.trades = frozenset(trades)
        self.town_words = frozenset(w for t in self.towns for w in t.split())
        self.trie = Trie()
        for n in names:
            if len(n) > 4:
                self.trie.add(n, n.count(" "))

    @functools.lru_cache(maxsize=100_000)  # noqa: B019 - one object a worker
    def is_town(self, text: str, near: bool) -> bool:
        t = re.sub(r"\s+", " ", re.sub(r"[^a-z]+", " ", plain(text))).strip()
        if len(t) < 3:
            return False
        if t in self.towns:
            return True
        return near and len(t) > 4 and any(blanks == t.count(" ") for _, blanks, _ in self.trie.within(t, errors_allowed(len(t))))


@functools.lru_cache(maxsize=2)
def loaded(files: tuple[str, ...]) -> Gazetteer:
    """The gazetteer from the files of the shared folder, once a worker."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    held: dict[str, list[str]] = {}
    for f in files:
        system, path = fs.FileSystem.from_uri(f)
        t = pq.read_table(path, filesystem=system, columns=["kind", "text"])
        for k, x in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
            held.setdefault(k, []).append(x)
    return Gazetteer(*(held.get(k, ()) for k in ("town", "name", "country", "given", "common", "trade")))


Places = Gazetteer | tuple[str, ...]


def _places(places: Places) -> Gazetteer:
    return places if isinstance(places, Gazetteer) else loaded(places)


def _tail(text: str, at: int, places: Gazetteer, features: dict[str, float], lines: bool | None = None) -> Iterator[tuple[int, dict[str, float]]]:
    """Ends of an address whose street ends at ``at``, each with its features so far.

    ``lines``: whether its parts stand on lines of their own; the first part after
    the street tells.
    """
    yield at, features
    parts = features.get("ADDRESS:part", 0) + 1
    gap = _SEPARATOR.match(text, at)
    if not gap:
        return
    new = "\n" in gap[0]
    if lines is not None and new and not lines:
        return
    for pattern, name in ((_UNIT, "unit"), (_CODE, "code"), (_REGION, "region")):
        if f"ADDRESS:{name}" not in features and (m := pattern.match(text, at)) and not (name == "region" and "ADDRESS:town" not in features):
            # a number on a line of its own is a code only beside a town, or where the parts before it have such lines
            if name == "code" and new and lines is None and not re.match(rf" [{_LETTER}]", text[m.end() : m.end() + 2]):
                continue
            yield from _tail(text, m.end(), places, features | {f"ADDRESS:{name}": 1.0, "ADDRESS:part": parts}, new if lines is None else lines)
    if m := gap:
        lines = new if lines is None else lines
        ends, pos = [], m.end()
        for _ in range(4):
            w = _TOWNWORD.match(text, pos)
            if not w:
                break
            ends.append(w.end())
            if text[w.end() : w.end() + 1] != " ":
                break
            pos = w.end() + 1
        for e in reversed(ends):
            word = text[m.end() : e].rstrip(".")
            e = m.end() + len(word)
            if "ADDRESS:town" not in features and places.is_town(word, True):
                yield from _tail(text, e, places, features | {"ADDRESS:town": 1.0, "ADDRESS:part": parts}, lines)
                break
            if "ADDRESS:country" not in features and ("ADDRESS:town" in features or "ADDRESS:code" in features) and plain(word).replace("-", " ") in places.countries:
                yield e, features | {"ADDRESS:country": 1.0, "ADDRESS:part": parts}
                break


def _front(text: str, at: int, places: Gazetteer) -> list[tuple[int, dict[str, float]]]:
    """Beginnings of an address that names the town before the street."""
    line = max(text.rfind("\n", 0, max(0, at - 2)), at - 70, -1)
    head = text[line + 1 : at]
    if len(head) < 4:
        return []
    m = re.search(rf"(?:(\d{{5}}) )?((?:[{_LETTER}0-9'’.-]+ ){{0,3}}[{_LETTER}0-9'’.-]+)(?:{_SEP}([A-Za-z]{{2}}))?(?: (\d{{5}}))?{_SEP}$", head)
    out = []
    if code := re.search(r"(?<!\d)(\d{5})(?:, ?| \| |; ?| - )$", head):
        out.append((line + 1 + code.start(1), {"ADDRESS:front": 1.0, "ADDRESS:code": 1.0}))
    if m:
        words = m[2].split(" ")
        for k in range(len(words)):
            name = " ".join(words[k:])
            if places.is_town(name, k == 0) and (k == 0 or not m[1]):
                begin = line + 1 + (m.start(1) if m[1] else m.start(2) + len(" ".join(words[:k])) + (1 if k else 0))
                out.append((begin, {"ADDRESS:front": 1.0, "ADDRESS:town": 1.0} | ({"ADDRESS:code": 1.0} if m[1] or m[4] or re.search(r"(?<!\d)\d{5}$", name) else {}) | ({"ADDRESS:region": 1.0} if m[3] else {})))
                break
    return out


#: A line that ends in amounts.
_PRICED = re.compile(r"[^\n]{2,40} {2,}-?[\d.,]+(?: \d{3})*(?:[.,]\d+)?(?: {2,}-?[\d.,  ]+)?(?=\n|$)")
#: What every e-mail address, and every phone number, holds.
_PHONE_DIGITS = re.compile(r"\d\D{0,3}\d\D{0,3}\d\D{0,3}\d\D{0,3}\d\D{0,3}\d\D{0,3}\d")
_HIDDEN_AT = re.compile(r"[\[({]at[\])}]|\sat\s", re.I)
#: A part of every cue of :data:`ID_CUES`, in small letters.
_ID_PARTS = ("ssn", "social", "nino", "ni n", "national", "ausweis", "pass", "carte", "steuer", "licen", "schein", "dni", "nie", "nir", "id card", "sécurité", "sozial")
_ID_CUE = re.compile(rf"(?<!\w)(?:{ID_CUES})\s*[:=]?\s*", re.I)
_ID_VALUE = re.compile(rf"(?:{ID_SHAPE})(?![\w-])")
_ID_MARKED = re.compile(r"(?<![\w.-])(?:QQ ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8}[A-Z]|[A-Z]{5}\d{6}[A-Z0-9]{3})(?![\w-])")


_BEFORE_SIGN = re.compile(r"([^\W\d_]+ ?:|[^\W\d_]+|\d|[^\w\s]|\n|^)[ \t]*$")
_AFTER_SIGN = re.compile(r"[ \t]*([^\W\d_]+|\d|[^\w\s]|\n|$)")
_GLUED = re.compile(r"[\w@.'’-]")
_FIRM_INSIDE = re.compile(r"(?i)\b(?:ltd|gmbh|llc|inc|sarl|& co)\b")
_CAPITAL_BEFORE = re.compile(rf"(?<![\w]){_ANY} $")


def _sign(m: re.Match | None) -> str:
    return "" if m is None else "0" if m[1].isdigit() else m[1].lower().replace(" ", "")


def _name(text: str, begin: int, end: int, form: str, places: Gazetteer) -> tuple[int, int, str, dict[str, float]] | None:
    value = text[begin:end].rstrip(" \n")
    end = begin + len(value)
    if end - begin > LONGEST["NAME"] or begin and _GLUED.match(text, begin - 1):
        return None
    words = [w.strip(".,").lower() for w in value.split()]
    f = {f"NAME:{form}": 1.0, "NAME:size": float(sum(len(w) > 1 for w in words))}
    behind = _sign(_AFTER_SIGN.match(text, end, end + 30))
    if any(_key(w) in places.trades or w.replace(".", "") in nm.LEGAL for w in (*words, behind)):
        f["NAME:trade"] = 1.0
        if form == "capitals":  # a firm's name, whatever stands around it
            return begin, end, "NAME", f
    before, after = text[max(0, begin - 48) : begin], text[end : end + 40]
    if form != "capitals":  # what stands around these is learnt
        if PARTY.search(before):
            f["NAME:party"] = 1.0
            if after[:1] not in ("", "\n"):
                f["NAME:firm"] = 0.5
        elif BEFORE.search(before):
            f["NAME:before"] = 1.0
        if TITLED.search(before):
            f["NAME:title"] = 1.0
        if AFTER.match(after):
            f["NAME:after"] = 1.0
    if FIRM.match(after) or _FIRM_INSIDE.search(value):
        f["NAME:firm"] = 1.0
    if (words[0] in _NOT_NAME and form != "given_first") or (words[0] in _TITLE_WORDS and (words[0], form) != ("m", "initials")) or any(w in _NOT_NAME and w != "bill" for w in words[1:]):
        f["NAME:common"] = 1.0
    if form == "capitals":
        known = sum(any(part in places.common for part in w.split("-")) for w in words)
        if known:
            f["NAME:common"] = f.get("NAME:common", 0.0) + 0.3 * known
        upper = sum(w.isupper() for w in value.split() if len(w.strip(".")) > 1)
        if upper:
            f["NAME:upper" if upper == len(words) else "NAME:mixed"] = 1.0
        keys = [_key(w) for w in words]
        if any(k in places.towns or k.replace("-", " ") in places.countries for k in keys) or (keys[0] in places.town_words and places.is_town(value, False)):
            f["NAME:place"] = 1.0
    title = TITLED.search(before)
    one, other = _sign(_BEFORE_SIGN.search(before[: len(before) - len(title[0])][-24:] if title else before[-24:])), behind
    if "NAME:trade" not in f and (_key(one) in places.trades or one.replace(".", "") in nm.LEGAL):
        f["NAME:trade"] = 1.0
    if one.isalpha() and text[begin - 1 : begin] == " " and _CAPITAL_BEFORE.search(before[-24:]):
        f["NAME:inside"] = 1.0
    f[f"NAME:prev={one}"] = f[f"NAME:next={other}"] = 1.0
    if one.isalpha() and text[begin - 2 : begin - 1].islower():
        f["NAME:after_small"] = 1.0
    if other.isalpha() and text[end + 1 : end + 2].islower():
        f["NAME:before_small"] = 1.0
    return begin, end, "NAME", f


#: The announcing words by their last word, each with whether it must begin a word.
_BY_LAST: dict[str, list[tuple[str, bool]]] = {}
for _cues, _whole in ((_CUES, False), (_WHOLE, True)):
    for _cue in _cues:
        _BY_LAST.setdefault(_LETTERS.findall(_cue)[-1], []).append((_cue + " ", _whole))


def _announced(text: str, low: str, words: set[str]) -> set[int]:
    """Where a name would begin behind a word that announces one, with and without a title between: M. is a title or an initial."""
    if len(low) != len(text):  # a letter whose small form is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out = set()
    for word in words & _BY_LAST.keys():
        for cue, whole in _BY_LAST[word]:
            at = low.find(cue)
            while at >= 0:
                end = at + len(cue)
                if not whole or not at or not (low[at - 1].isalnum() or low[at - 1] == "_"):
                    out.add(end)
                    if title := _TITLE_AT.match(text, end):
                        out.add(title.end())
                at = low.find(cue, end - 1)
    return out


def candidates(text: str, places: Gazetteer) -> list[tuple[int, int, str, dict[str, float]]]:
    """``(begin, end, type, features)`` of every span that could be a mention.

    The whole text is read; that a span stands on a line of priced items is one of
    its features.
    """
    out: list[tuple[int, int, str, dict[str, float]]] = []
    if "@" in text or _HIDDEN_AT.search(text):
        for m in EMAIL.finditer(text):
            v = m[0]
            f = {"EMAIL": 1.0}
            if re.search(r"\sat\s", v):
                f["EMAIL:word_at"] = 1.0
            elif " " in v:
                f["EMAIL:spaced"] = 1.0
            if re.search(r"[\[({](?:dot|\.)[\])}]|\sdot\s", v, re.I):
                f["EMAIL:hidden_dot"] = 1.0
            elif "EMAIL:word_at" in f and re.search(r"[._+\d-]", v.split(" ")[0]):
                f["EMAIL:hidden_dot"] = 0.8
            if len(v) <= LONGEST["EMAIL"]:
                out.append((m.start(), m.end(), "EMAIL", f))
    low = text.lower()
    named: set[tuple[int, int]] = set()  # one reading a span: the first, which is the more telling form

    def name(begin: int, end: int, form: str) -> None:
        if (begin, end) not in named:
            named.add((begin, end))
            if c := _name(text, begin, end, form, places):
                out.append(c)

    for m in PHONE.finditer(text) if _PHONE_DIGITS.search(text) else ():
        out.append((m.start(), m.end(), "PHONE", {"PHONE": 1.0} | ({"PHONE:long": 1.0} if sum(c.isdigit() for c in m[0]) >= 10 else {})))
    for m in _ID_CUE.finditer(text) if any(x in low for x in _ID_PARTS) else ():
        if (v := _ID_VALUE.match(text, m.end())) and any(c.isdigit() for c in v[0]):
            out.append((v.start(), v.end(), "ID", {"ID:cue": 1.0}))
    for m in _ID_MARKED.finditer(text):
        out.append((m.start(), m.end(), "ID", {"ID:bare": 1.0, "ID:marked": 1.0}))
    words = set(_LETTERS.findall(low))
    street = places.kinds and (not words.isdisjoint(_KIND_WORDS) or any(w.endswith(_KIND_ENDS) for w in words) or any(x in low for x in _KIND_SHORT))
    streets = [(m, {}) for m in STREET.finditer(text)] if street else []
    streets += [(m, {"ADDRESS:unnamed": 1.0}) for m in UNNAMED_STREET.finditer(text)]
    for m, how in streets:
        where = {"ADDRESS:where": 1.0} if WHERE.search(text[max(0, m.start() - 80) : m.start()]) else {}
        for begin, front in [(m.start(), {}), *_front(text, m.start(), places)]:
            for end, f in _tail(text, m.end(), places, {"ADDRESS": 1.0, **how, **where, **front}):
                if end - begin <= LONGEST["ADDRESS"]:
                    out.append((begin, end, "ADDRESS", f))
    if not places.given.isdisjoint(words):
        for w in _WORDS.finditer(text):
            if w[0].lower() not in places.given:
                continue
            if m := _AFTER_GIVEN.match(text, w.end()):
                name(w.start(), m.end(), "given_first")
            if m := _SURNAME_BEFORE.search(text, max(0, w.start() - 60), w.start()):
                behind = _INITIAL_BEHIND.match(text, w.end())
                for end in {w.end(), behind.end()}:
                    name(m.start(), end, "given_last" if m[1] else "given_after")
    for begin in _announced(text, low, words) if places.kinds else ():
        for form, pattern in SPOKEN_FORMS:
            if v := pattern.match(text, begin):
                name(begin, v.end(), form)
    for m in _CAPITALS.finditer(text):
        # a span of three words may begin with the word before a name
        for v in (m, _CAPITALS.match(text, m.start() + m[0].index(" ") + 1)):
            if v:
                name(v.start(), v.end(), "capitals")
    once: dict[tuple, dict[str, float]] = {}
    for b, e, t, f in out:
        once.setdefault((b, e, t), f)
    if once and "  " in text:
        lines: dict[tuple[int, int], bool] = {}
        for (b, e, _), f in once.items():
            line = (text.rfind("\n", 0, b) + 1, text.find("\n", b))
            line = (line[0], line[1] if line[1] >= 0 else len(text))
            if line not in lines:
                lines[line] = _PRICED.fullmatch(text, *line) is not None
            if lines[line] and e <= line[1]:
                f["PRICED"] = 1.0
    return [(*k, f) for k, f in once.items()]


def _scored(spans, weights) -> list[tuple[int, int, str, float]]:
    return [(b, e, t, sum(weights.get(k, 0.0) * v for k, v in f.items())) for b, e, t, f in spans]


def best(text: str, places: Gazetteer, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The segmentation of the highest score: ``(begin, end, type)``, in order."""
    spans = sorted((s for s in _scored(candidates(text, places), weights) if s[3] > 0), key=lambda s: s[1])
    if not spans:
        return []
    ends = [s[1] for s in spans]
    total, choice = [0.0], [None]
    for i, (b, _, _, score) in enumerate(spans):
        j = bisect.bisect_right(ends, b, 0, i)
        take = total[j] + score
        if take > total[i]:
            total.append(take)
            choice.append((i, j))
        else:
            total.append(total[i])
            choice.append(None)
    out, i = [], len(spans)
    while i:
        if choice[i] is None:
            i -= 1
        else:
            k, i = choice[i]
            out.append(spans[k][:3])
    return out[::-1]


def marginals(spans: list[tuple[int, int, str, float]]) -> list[float]:
    """Probability of every segment, by the forward and backward recursions."""
    points = sorted({p for s in spans for p in s[:2]})
    at = {p: i for i, p in enumerate(points)}
    n = len(points)
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    forward, backward = [0.0] * n, [0.0] * n
    by_end: dict[int, list] = {}
    by_begin: dict[int, list] = {}
    for b, e, _, score in spans:
        by_end.setdefault(at[e], []).append((at[b], score))
        by_begin.setdefault(at[b], []).append((at[e], score))
    for i in range(1, n):
        forward[i] = forward[i - 1]
        for j, score in by_end.get(i, ()):
            forward[i] = add(forward[i], forward[j] + score)
    for i in range(n - 2, -1, -1):
        backward[i] = backward[i + 1]
        for j, score in by_begin.get(i, ()):
            backward[i] = add(backward[i], backward[j] + score)
    z = forward[n - 1] if n else 0.0
    return [math.exp(min(0.0, forward[at[b]] + score + backward[at[e]] - z)) for b, e, _, score in spans]


def fit(texts: list[tuple[str, list[tuple[int, int, str]]]], places: Gazetteer, start: dict[str, float] = PRIOR, epochs: int = EPOCHS, seed: int = 7) -> dict[str, float]:
    """Weights of the highest likelihood of labelled ``(text, mentions)``, pulled towards ``start``.

    What is labelled of a text is true, what is not is open: addresses, e-mail
    addresses, phone and identity numbers beside no label, names within such an
    address, and names of initials are left out.  Of the texts ``HIDDEN`` are seen
    without the known given names, kinds of street and words that announce a name.
    """
    r = random.Random(seed)
    bare = Gazetteer([], [], [])
    bare.trades, bare.town_words = places.trades, places.town_words
    bare.towns, bare.countries, bare.common, bare.trie, bare.kinds = places.towns, places.countries, places.common, places.trie, False
    data = []
    for text, gold in texts:
        mine = set(gold)
        told = [(b, e) for b, e, _ in gold]
        full = candidates(text, places)
        every = candidates(text, bare) if r.random() < HIDDEN else full
        placed = [(b, e) for b, e, t, f in full if t == "ADDRESS" and f.keys() & {"ADDRESS:town", "ADDRESS:code"}]
        open_ = lambda c: any(b < c[1] and c[0] < e for b, e in placed) or c[3].keys() & {"NAME:initials", "NAME:initial_last"}
        spans = [c for c in every if c[:3] in mine or any(b < c[1] and c[0] < e for b, e in told) or (c[2] == "NAME" and not open_(c))]
        if spans:
            data.append((spans, [1.0 if (b, e, t) in mine else 0.0 for b, e, t, _ in spans]))
    weights, squares = dict(start), {}
    for _ in range(epochs):
        slope: dict[str, float] = {}
        for spans, gold in data:
            for (_, _, _, f), p, y in zip(spans, marginals(_scored(spans, weights)), gold, strict=True):
                if abs(y - p) > 1e-4:
                    for k, v in f.items():
                        slope[k] = slope.get(k, 0.0) + (y - p) * v
        for k, g in slope.items():
            g -= PULL * len(data) * (weights.get(k, 0.0) - start.get(k, 0.0))
            squares[k] = squares.get(k, 0.0) + g * g
            weights[k] = weights.get(k, 0.0) + RATE * g / math.sqrt(squares[k] + 1e-9)
    return weights


def labels(text: str, parts: dict[str, list[str]], places: Gazetteer) -> list[tuple[int, int, str]]:
    """Mentions that are sure: column texts (``parts``, by type) found word for word, and known given names beside a surname."""
    gold = []
    for kind, values in parts.items():
        for v in values:
            at = text.find(v)
            behind = text[at + len(v) : at + len(v) + 1]
            # an address may go on beyond what the column holds, unless it has its line to itself
            if at >= 0 and not re.match(r"\w", behind) and not (at and text[at - 1].isalnum()) and (kind != "ADDRESS" or (behind in ("", "\n") and text[at - 1 : at] in ("", "\n"))):
                gold.append((at, at + len(v), kind))
    every = candidates(text, places)
    others = [(b, e) for b, e, t, _ in every if t != "NAME"]
    given = [c for c in every if c[2] == "NAME" and not any(b < c[1] and c[0] < e for b, e in others) and c[3].keys() & {"NAME:given_first", "NAME:given_last"} and not c[3].keys() & {"NAME:firm", "NAME:common", "NAME:trade"}]
    for b, e, t, _ in sorted(given, key=lambda c: c[0] - c[1]):  # the longest first
        if not any(x < e and b < y for x, y, _ in gold):
            gold.append((b, e, t))
    return sorted(gold)


def gazetteer(addresses: DataFrame, words: DataFrame | None = None, texts: DataFrame | None = None, terms: DataFrame | None = None) -> tuple[str, ...]:
    """Files of the gazetteer of ``addresses(field, id, n, spelling)``, ``words`` (names in words), ``texts`` and ``terms(text)``, which name no person, written to the shared folder.

    All towns, countries and given names that the columns teach are in it; the
    common words are bounded by ``COMMON_ONE_IN``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for x in (read_address(s) for s in b.column(0).to_pylist()) if x]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in (("postcode", pa.string()), ("beside", pa.string()), ("towns", pa.list_(pa.string())))], names=["postcode", "beside", "towns"])

    rows = written(addresses.select("spelling").mapInArrow(run, "postcode string, beside string, towns array<string>"), "gazetteer-read")
    texts_, _, _ = mine_towns(rows)
    seen = rows.where("beside is not null").groupBy(F.col("beside").alias("text")).agg(F.count("*").alias("n"))
    # what mostly stands last, behind the town, is a country
    last = rows.where("postcode is not null and size(towns) > 0").select(F.element_at("towns", -1).alias("text"), "beside").where("text <> beside").groupBy("text").agg(F.count("*").alias("m"))
    town = written(texts_.join(seen.join(last, "text", "left").where("m is null or m < n"), "text").select("text", "town"), "gazetteer-towns")
    tails = town.where("text like '% %'").select(F.substring_index("text", " ", -1).alias("text")).unionByName(town.where("text like '% %'").select(F.expr("substring(text, instr(text, ' ') + 1)").alias("text"))).distinct()
    country = last.where("m >= 3").select("text").join(town.select("text"), "text", "left_anti").join(tails, "text", "left_anti")
    parts = [("town", town.select("text")), ("name", town.where("text = town").select("text")), ("country", country)]
    if words is not None:
        known = nm.vocabulary(words)
        parts += [(kind, known.where(F.col("role") == kind).select(F.explode(F.split("run", " ")).alias("text")).distinct()) for kind in ("given", "trade")]
    if texts is not None:
        common = common_words(texts)
        if terms is not None:
            common = common.unionByName(terms.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("text")).where("length(text) > 2")).distinct()
        parts.append(("common", common))
    out = parts[0][1].select(F.lit(parts[0][0]).alias("kind"), "text")
    for kind, df in parts[1:]:
        out = out.unionByName(df.select(F.lit(kind).alias("kind"), "text"))
    return tuple(sorted(written(out, "gazetteer").inputFiles()))


def common_words(texts: DataFrame) -> DataFrame:
    """``(text)``: words of ``texts(text)`` mostly written small, one in ``COMMON_ONE_IN`` of all or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = Counter(_WORDS.findall("\n".join(t for t in b.column(0).to_pylist() if t)))
            yield pa.RecordBatch.from_arrays([pa.array([w.lower() for w in seen], pa.string()), pa.array([n if w.islower() else 0 for w, n in seen.items()], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["text", "small", "n"])

    counts = written(texts.select("text").mapInArrow(run, "text string, small long, n long").groupBy("text").agg(F.sum("small").alias("small"), F.sum("n").alias("n")), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.where((F.col("n") >= max(2.0, total / COMMON_ONE_IN)) & (F.col("small") * 2 > F.col("n"))).select("text")


def labelled(texts: DataFrame, parties: DataFrame, places: Places, most: int = FIT_TEXTS) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """At most ``most`` labelled texts, those of the smallest hashes, to the driver: the bounded sample of the fit.

    ``parties(row_id, part, value)`` holds what the columns of a text's record say,
    by type of mention.
    """
    some = texts.where(F.length("text").between(1, FIT_CHARS)).withColumn("_h", F.xxhash64("field", "row_id", "result_no")).orderBy("_h", "row_id").limit(most)
    beside = some.join(parties, "row_id", "left").groupBy("field", "row_id", "result_no").agg(F.first("text").alias("text"), F.collect_list(F.struct("part", "value")).alias("parts"))
    out = []
    known = _places(places)
    for row in sorted(beside.collect(), key=lambda x: (x["field"], x["row_id"], x["result_no"])):
        parts: dict[str, list[str]] = {}
        for x in row["parts"]:
            if x["value"] and len(x["value"].strip()) > 5:
                parts.setdefault(x["part"], []).append(x["value"].strip())
        parts["NAME"] = [v for v in parts.get("NAME", []) if any(w.lower() in known.given for w in v.replace(",", " ").split())]
        out.append((row["text"], labels(row["text"], parts, known)))
    return out


def parties(invoices: DataFrame, receipts: DataFrame) -> DataFrame:
    """``(row_id, part, value)`` of the columns that a page may repeat, by the harvest of the record."""
    pick = lambda df, *cs: [df.select(F.col("harvest_id").cast("long").alias("row_id"), F.lit(t).alias("part"), F.col(c).cast("string").alias("value")) for c, t in cs]
    rows = pick(invoices, ("customer_name", "NAME"), ("vendor_address", "ADDRESS"), ("customer_address", "ADDRESS"), ("vendor_email", "EMAIL"), ("customer_email", "EMAIL"), ("customer_phone", "PHONE")) + pick(receipts, ("merchant_address", "ADDRESS"))
    return functools.reduce(DataFrame.unionByName, rows).where("row_id is not null and value is not null")


_FOUND = "field string, row_id long, result_no int, pii_type string, begin int, finish int, value string"


def mentions(texts: DataFrame, places: Places, weights: dict[str, float] | None = None) -> DataFrame:
    """``(field, row_id, result_no, pii_type, begin, finish, value)`` of every mention in ``texts(field, row_id, result_no, text)``.

    Null and empty texts have none.  Places are counted in characters.
    """
    used = weights or PRIOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _places(places)
        for b in batches:
            out: list[tuple] = []
            for field, row, no, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if text:
                    out.extend((field, row, no, t, s, e, text[s:e]) for s, e, t in best(text, known, used))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["field", "row_id", "result_no", "pii_type", "begin", "finish", "value"])

    return texts.select("field", F.col("row_id").cast("long"), F.col("result_no").cast("int"), "text").mapInArrow(run, _FOUND)


def redacted(texts: DataFrame, places: Places, weights: dict[str, float] | None = None) -> DataFrame:
    """``texts`` with every mention replaced by its type in brackets, all else unchanged; null stays null."""
    used = weights or PRIOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _places(places)
        for b in batches:
            out = []
            for text in b.column(3).to_pylist():
                if text:
                    for s, e, t in reversed(best(text, known, used)):
                        text = f"{text[:s]}[{t}]{text[e:]}"
                out.append(text)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(out, pa.string())], names=["field", "row_id", "result_no", "text"])

    return texts.select("field", F.col("row_id").cast("long"), F.col("result_no").cast("int"), F.col("text").cast("string")).mapInArrow(run, "field string, row_id long, result_no int, text string")


def free_texts(invoices: DataFrame, harvests: DataFrame) -> DataFrame:
    """Notes of invoices and raw texts of results, long."""
    notes = invoices.where("notes is not null").select(F.lit("notes").alias("field"), F.col("record_id").alias("row_id"), F.lit(0).alias("result_no"), F.col("notes").alias("text"))
    raw = harvests.select("harvest_id", F.posexplode("extraction_results").alias("result_no", "r")).where("r.raw_text is not null").select(F.lit("raw_text").alias("field"), F.col("harvest_id").alias("row_id"), "result_no", F.col("r.raw_text").alias("text"))
    return notes.unionByName(raw)


def list_terms(*lists: DataFrame) -> DataFrame:
    """``(text)``: labels and local names of reference lists."""
    return functools.reduce(DataFrame.unionByName, (x.select(F.explode(F.concat(F.array("label"), F.coalesce("local_names", F.array().cast("array<string>")))).alias("text")) for x in lists)).where("text is not null")


def found(invoices: DataFrame, receipts: DataFrame, harvests: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """:func:`mentions` in notes and raw texts, by what the columns of the same tables teach."""
    texts = free_texts(invoices, harvests)
    typed = [df.select(F.col(c).cast("string").alias("text")).where("text is not null").distinct() for df, c in ((invoices, "currency"), (receipts, "payment_method"))]
    terms = functools.reduce(DataFrame.unionByName, typed if terms is None else [terms, *typed])
    known = nm.spellings([(invoices, ("vendor_address", "customer_address")), (receipts, ("merchant_address",))])
    places = gazetteer(known, nm.name_words(invoices, receipts), texts, terms)
    weights = fit(labelled(texts, parties(invoices, receipts), places), _places(places))
    return mentions(texts, places, weights)
