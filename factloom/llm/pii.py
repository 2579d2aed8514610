"""Personal information in free text: found, typed, and replaced by placeholders.

Regular expressions propose spans. Each has a score to start with; checksums confirm it or rule it out (remainder by 23 of Spanish
identity numbers, mod-97 of French ones, Luhn of Swedish and Canadian ones, weighted sums of Polish ones and Italian tax codes; card
numbers that satisfy Luhn and bank accounts that satisfy mod-97 are no identity numbers), words before and behind adjust it. Spans
that reach the threshold are kept, the surer and longer one where two overlap; a name inside an address or email is no piece.

Person names are proposed by shape: runs of capitalised words, initials, words behind titles, `Family, Given`, and words in any
case that a name model knows. The model is learned from all of entities.name: for each word, whether it stands in front or at the end
of persons' names or in other names, and which endings family names have. It has a fixed size (bitmaps with four hashes, and counts
of endings), however many names there are; common given names of many countries and a nickname table add to it.

Positions are code points, end exclusive. Null and empty texts have none, and long texts are read whole, in one pass a pattern.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.names import NICKNAMES
from factloom.session import spread

THRESHOLD = 0.5

# Common given names of many countries; short forms come from the nickname table.
GIVEN = """aaliyah abdullah ahmed aisha alejandro aleksandra ali amina amit ana anastasia andrea andrew anita anna antonio arjun ashley barbara bashir benjamin
boris brian carlos carmen catherine charles chen chiara chinwe christine claire daniel david deborah diego dmitri donna elena emily emma eric esther
fatima fatou fernando francesco george giovanni giulia hannah hans hassan helen henry hiroshi hugo ibrahim igor ingrid irina isabel ivan jacob jacques
james jennifer jessica joão john jorge joseph juan julia jürgen karen karim kenji kevin khadija kofi kwame lars laura layla leila linda lisa lucas
luis magdalena mahmoud maria marie martin mary matthew maya mehmet mei michael michelle mohammed nadia nancy natalia nia nicole nikolai noor olga
olivia omar pablo patricia paul pedro peter piotr priya rachel rahul ravi rebecca richard rosa ruth samuel sandra sanjay sara sarah sergei sofia
sophie sunita susan sven takeshi tariq thomas tuan victor wei yasmin yuki yusuf zainab""".split()
# Endings of family names in many languages; those of the texts' own names are learned.
FAMILY_ENDINGS = "sson ssen sen son ova ovic ovich enko ić ez ski ska sky mann berg strom ström owicz etti elli idis poulos yan ian oglu wicz".split()
# Words that come before or behind a person's name, and words that come before a number of another sort.
NAME_BEFORE = {"call", "met", "and", "signed", "name", "contact", "dr", "mr", "mrs", "ms", "miss", "prof", "frau", "herr", "sra", "sr", "mme", "m", "that", "did", "ask", "asked", "with", "from", "by", "dear", "for", "to", "hi", "hello", "regards", "cheers", "thanks", "love", "sincerely", "user"}
NAME_BEHIND = {"wrote", "moved", "ever", "is", "on", "at", "and", "has", "said", "asked", "email", "tel", "about", "in", "for", "can", "will", "was"}
TITLES = {"dr", "mr", "mrs", "ms", "miss", "prof", "frau", "herr", "sra", "sr", "mme", "hr", "fr"}
# Words that a person alone does, words that only a person stands behind, and words that are part of no person's name.
PERSON_BEHIND = set("called wrote said says told asked asks phoned emailed texted replied married thinks wants lives lived moved smiled laughed introduced wished remembers".split())
PERSON_BEFORE = set("call called met meet dear signed ask asked told tell contact named phone email mail text invited married regards cheers sincerely colleague friend neighbour neighbor brother sister husband wife boss landlord dentist doctor teacher uncle aunt cousin".split())
NO_PERSON = set("street road avenue lane way close crescent terrace drive court square place gardens park hill station bridge river lake mount north south east west new saint university college school institute hospital clinic museum library church hotel airport bank labs lab studio design works data foods health partners robotics analytics systems software solutions services group holdings inc llc ltd gmbh corp company co agency office department team project plan club bar restaurant café cafe market store shop foundation association council university monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december english german french spanish chinese thai fact question answer session turn known".split())
OTHER_NUMBER = re.compile(r"(?:order|ticket|reference|ref|fact|invoice|build|version|platform|seats?|session|turn|case|no\. of)\W{0,3}(?:no\.?|number|id|nr\.?)?\W{0,3}$", re.I)
ID_BEFORE = re.compile(r"\b(?:id|ids|identity|national|passport|ssn|nino|dni|nif|nie|insurance|social security|ausweis|personalausweis|on file)\b[^.!?\n]{0,25}$", re.I)
PHONE_BEFORE = re.compile(r"\b(?:phone|call|tel|cell|mobile|work|reach|number|nummer|fax|whatsapp|text|it's|on|contact)\b[^!?\n]{0,60}$", re.I)

EMAIL = re.compile(
    r"(?<![\w@.+-])[^\W_](?:[\w.+%-]*\w)?(?:\s+dot\s+[\w+-]+)*(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?)[^\W_](?:[\w-]*\w)?(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\s+dot\s+)[^\W_](?:[\w-]*\w)?)+"
    r"|(?<![\w@.+-])[^\W_](?:[\w.+%-]*\w)?(?:\s+dot\s+[\w+-]+)*\s+at\s+[^\W_](?:[\w-]*\w)?(?:\s+dot\s+[^\W_](?:[\w-]*\w)?)+",
    re.I,
)
#: Shapes of phone numbers with the score each starts with; one pattern reads a text for all of them.
PHONE_SHAPES = {
    "plus": (r"(?<!\w)\+\d{1,3}(?:[ .-]?\(0\)[ .-]?|[ .-]?\(\d{1,4}\)[ .-]?|[ .-]?)\d{1,5}(?:[ ./-]?\d{2,8}){1,4}(?!\w|[-.]\d)", 0.9),
    "zeros": (r"(?<!\w)00\d{1,3}[ ./-]\d{1,5}(?:[ ./-]\d{2,8}){1,4}(?![\w]|[-.]\d)", 0.8),
    "bracket": (r"\(\d{2,5}\) ?\d{3,4}[ -]?\d{3,4}(?!\w|[-.]\d)", 0.8),
    "ten": (r"(?<![.-])\d{3}(?P<t>[-.])\d{3}(?P=t)\d{4}(?!\w|[-.]\d)", 0.7),
    "trunk": (r"(?<![./-])0\d{2,4}[/ ]\d{5,8}(?!\w|[-.]\d)", 0.6),
    "trunk3": (r"(?<![./-])0\d{2,4} \d{3,4} \d{3,4}(?!\w|[-.]\d)", 0.6),
    "film": (r"(?<![./-])555-\d{4}(?!\w|[-.]\d)", 0.6),
    "seven": (r"(?<![./-])\d{3}-\d{4}(?!\w|[-.]\d)", 0.35),
    "plain": (r"(?<![./#-])1[2-9]\d{2}[2-9]\d{6}(?!\w|[-.]\d)", 0.45),
}
#: Shapes of identity and passport numbers.
ID_SHAPES = {
    "dni": (r"\d{8}-?[A-Z](?![\w-])", 0.3),
    "nie": (r"[XYZ]-?\d{7}-?[A-Z](?![\w-])", 0.3),
    "nino": (r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])", 0.7),
    "ssn": (r"\d{3}(?P<a>[- ])\d{2}(?P=a)\d{4}(?!\w|[-.]\d)", 0.65),
    "marked": (r"P<\d{6,9}(?![\w<-])", 0.8),
    "passport": (r"(?<!#)[A-Z]{1,2}\d{7,8}(?![\w-])", 0.6),
    "digits": (r"(?<!#)\d{9}(?![\w-])", 0.2),
    "nir": (r"(?<![#+])[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}(?![\w-])", 0.1),
    "pesel": (r"(?<![#+])\d{11}(?![\w-])", 0.1),
    "personnummer": (r"(?<![#+])\d{6}[-+]\d{4}(?![\w-])", 0.1),
    "sin": (r"(?<![#+])\d{3}(?P<b>[ -])\d{3}(?P=b)\d{3}(?![\w-]|[ ]\d)", 0.1),
    "codice": (r"(?<!#)[A-Z]{6}\d{2}[A-EHLMPRST]\d{2}[A-Z]\d{3}[A-Z](?![\w-])", 0.3),
}
PHONE = re.compile(r"(?<![\w+])(?=[\d+(])(?:" + "|".join(f"(?P<{k}>{p})" for k, (p, _) in PHONE_SHAPES.items()) + ")")
ID = re.compile(r"(?<![\w.-])(?=[\dA-Z])(?:" + "|".join(f"(?P<{k}>{p})" for k, (p, _) in ID_SHAPES.items()) + ")")
#: Street addresses by language, each with the words of which a text must hold one.
STREETS = [
    ("street,road,avenue,lane,way,close,crescent,terrace,drive,court,square,place,garden, st, rd, ave, ln, dr",
     r"(?<![\w-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite) \d+[a-z]?, ?)?\d{1,4}(?: ?[a-d])? (?:(?:St\.|[A-Z][\w'’]*) ){1,3}(?:Street|Road|Avenue|Lane|Way|Close|Crescent|Terrace|Drive|Court|Square|Place|Gardens|St|Rd|Ave|Ln|Dr)\b(?:\.(?=,))?(?:, ?(?:Flat|Apt\.?|Apartment|Unit|Suite|Floor) ?\d+[a-z]?)?", 0),
    ("rue,avenue,impasse,boulevard,bd,place,allée,chemin,quai,cours,passage,route,square",
     r"(?<![\w-])\d{1,4}(?: ?(?:bis|ter|quater))?, ?(?:rue|avenue|impasse|boulevard|bd|place|allée|chemin|quai|cours|passage|route|square)(?: (?:de la|de l['’]|du|des|de|d['’]))?(?: ?(?-i:[^\W\d_a-zà-öø-ÿ])[\w'’-]*){1,3}", re.I),
    ("calle,plaza,avenida,avda,paseo,camino,ronda,carrera,c/",
     r"(?<![\w-])(?:Calle|Plaza|Avenida|Avda\.|Paseo|Camino|Ronda|Carrera|C/)(?: (?:de la|de los|de las|del|de|el|la))?(?: (?-i:[^\W\d_a-zà-öø-ÿ])[\w'’-]*){1,3},? \d{1,4}(?:, ?\d{1,2} ?[ºª°](?: ?[A-Z]\b)?)?", re.I),
    ("via ,viale,piazza,corso ,largo ,vicolo,rua ,travessa,praça,avenida,ulica,ul.,aleja,al.",
     r"(?<![\w-])(?:Via|Viale|Piazza|Piazzale|Corso|Largo|Vicolo|Rua|Travessa|Praça|Avenida|ulica|ul\.|aleja|al\.)(?: (?:del|della|dei|di|da|do|dos|das|de))?(?: (?-i:[^\W\d_a-zà-öø-ÿ])[\w'’-]*){1,3},? \d{1,4}(?:[/ ]?[a-dA-D]\b|/\d{1,3})?", re.I),
    ("straat,laan,gracht,plein,gata,vägen,veien,vej,gade,katu,tie",
     r"(?<![\w-])[A-ZÅÄÖØÆ][\w-]*(?:straat|laan|gracht|plein|gatan|gata|vägen|veien|vej|gade|katu|tie) \d{1,4}(?: ?[a-dA-D]\b)?", 0),
    ("straße,strasse,str.,allee,weg,platz,ring,gasse,ufer,damm,am ,an der,im ,auf d,zum ,zur ,in der",
     r"(?<![\w-])(?:(?:Am|An der|Im|Auf dem|Auf der|Zum|Zur|In der) [A-ZÄÖÜ][\wäöüß-]+|[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|allee|weg|platz|ring|gasse|ufer|damm)|[A-ZÄÖÜ][\wäöüß-]+er (?:Weg|Straße|Str\.|Platz|Allee|Ring|Damm|Ufer)) \d{1,4}(?: ?[a-d]\b)?", re.I),
]
STREETS = [(ws.split(","), re.compile(p, f)) for ws, p, f in STREETS]
WORD = re.compile(r"[^\W\d_](?:[\w]|['’-](?=[^\W\d_]))*")

_FOLD = str.maketrans("éèëêáàäâãåíìïîóòöôõøúùüûñçšłğýž", "eeeeaaaaaaiiiioooooouuuuncslgyz")


def _fold(w: str) -> str:
    return w.lower().translate(_FOLD)


_ENDINGS = tuple(_fold(e) for e in FAMILY_ENDINGS)
_GIVEN = {_fold(g) for g in GIVEN} | {_fold(g) for g in NICKNAMES}
_SHORT = {s for forms in NICKNAMES.values() for s in forms}
_BITS, _HASHES, _TAILS = 1 << 24, 4, 1 << 16
#: What a word may be in a name.
IS_GIVEN, IS_FAMILY, IS_OTHER, IS_SHORT = 1, 2, 4, 8


def _slots(word: str, size: int = _BITS) -> list[int]:
    """The places of a word in a bitmap, by four hashes."""
    raw = word.encode("utf-8", "ignore")
    a, b = zlib.crc32(raw), zlib.adler32(raw) * 2654435761 | 1
    return [(a + i * b) % size for i in range(_HASHES)]


class NameModel(dict):
    """What each folded word may be in a name: bits of IS_GIVEN, IS_FAMILY, IS_OTHER and IS_SHORT."""

    def __init__(self, raw: bytes | None = None):
        self.bits = self.tails = None
        if raw:
            m = np.frombuffer(raw, np.uint8)
            self.bits = m[: 3 * _BITS // 8].reshape(3, -1)
            self.tails = m[3 * _BITS // 8 :].view(np.int64).reshape(2, -1)

    def _in(self, role: int, slots: list[int]) -> bool:
        row = self.bits[role]
        return all(row[x >> 3] >> (x & 7) & 1 for x in slots)

    def __missing__(self, word: str) -> int:
        out = IS_GIVEN * (word in _GIVEN) | IS_SHORT * (word in _SHORT) | IS_FAMILY * (len(word) > 4 and word.endswith(_ENDINGS))
        if self.bits is not None and len(word) > 1:
            slots = _slots(word)
            given, family, other = (self._in(i, slots) for i in range(3))
            out |= IS_GIVEN * given | IS_FAMILY * family | IS_OTHER * other
            if not out & IS_FAMILY and len(word) > 4:
                out |= IS_FAMILY * any(self._tail(word[-n:]) for n in (4, 3, 5) if len(word) > n + 1)
        if len(self) > 500_000:
            self.clear()
        self[word] = out
        return out

    def _tail(self, end: str) -> bool:
        """Whether three times as many family names as other words end so."""
        i = zlib.crc32(end.encode("utf-8", "ignore")) % _TAILS
        family, other = int(self.tails[0, i]), int(self.tails[1, i])
        return family >= 8 and family >= 3 * other


# What a text must have for the fuller search to find anything.
_PLAIN_WORD = re.compile(r"[^\W\d_][\w'’-]*")
_INITIAL = re.compile(r"(?<![\w'’])(?:(?![IA] )[^\W\d_a-zß-öø-ÿ](?:\. ?| )|[^\W\d_]\. )[^\W\d_]{3}")
_DIGIT = re.compile(r"\d")
_DIGITS = re.compile(r"\d(?:[ ()./-]{0,3}\d){5}|\d{2}[A-Z]\d{2}[A-Z]\d{3}")


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return len(digits) >= 13 and total % 10 == 0


def mod97(account: str) -> bool:
    a = account.replace(" ", "").upper()
    return 15 <= len(a) <= 34 and int("".join(str(int(c, 36)) for c in a[4:] + a[:4])) % 97 == 1


def dni(number: str) -> bool:
    n = number.replace("-", "")
    digits = n[:-1].translate(str.maketrans("XYZ", "012"))
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == n[-1]


def luhn10(number: str) -> bool:
    """Luhn of nine or ten digits."""
    ds = [int(c) for c in number if c.isdigit()]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(ds))) % 10 == 0


def nir(number: str) -> bool:
    n = number.replace(" ", "")
    return 97 - int(n[:13]) % 97 == int(n[13:])


def pesel(number: str) -> bool:
    ds = list(map(int, number))
    return sum(w * d for w, d in zip((1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1), ds, strict=True)) % 10 == 0 and 1 <= int(number[2:4]) % 20 <= 12 and 1 <= int(number[4:6]) <= 31


# What a sign in an odd place counts, 0 to 9 and A to Z alike by their order.
_ODD = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]


def codice(number: str) -> bool:
    order = [int(c) if c.isdigit() else ord(c) - 65 for c in number]
    return sum(_ODD[v] if i % 2 == 0 else v for i, v in enumerate(order[:15])) % 26 == order[15]


#: Sorts of numbers with a check that confirms them.
CHECKED = {"dni": dni, "nie": dni, "nir": nir, "pesel": pesel, "personnummer": luhn10, "sin": luhn10, "codice": codice}

_ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_CARD = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w)")


def _numbers(text: str) -> list[tuple[int, int, str, float]]:
    out = []
    no = [m.span() for m in _ACCOUNT.finditer(text) if mod97(m[0])] + [m.span() for m in _CARD.finditer(text) if luhn(re.sub(r"\D", "", m[0]))]
    for m in PHONE.finditer(text):
        before = text[max(0, m.start() - 70) : m.start()]
        s = PHONE_SHAPES[m.lastgroup][1] + 0.3 * bool(PHONE_BEFORE.search(before)) - 0.6 * bool(OTHER_NUMBER.search(before))
        out.append((*m.span(), "phone", s))
    for m in ID.finditer(text):
        before, sort = text[max(0, m.start() - 40) : m.start()], m.lastgroup
        s = ID_SHAPES[sort][1] + 0.35 * bool(ID_BEFORE.search(before)) - 0.6 * bool(OTHER_NUMBER.search(before))
        if sort in CHECKED:
            s += 0.4 if CHECKED[sort](m[0]) else -0.1
        out.append((*m.span(), "id_number", s))
    return [x for x in out if x[3] > 0.75 and x[2] == "phone" or not any(a <= x[0] and x[1] <= b for a, b in no)]


def _family(word: str, strict: bool, model: NameModel) -> bool:
    """Whether a word can be a family name: by the model, or, where that isn't asked for, by its capital."""
    if _fold(word) in NO_PERSON:
        return False
    if all(model[_fold(p)] & IS_FAMILY for p in word.split("-")):
        return True
    return not strict and word[0].isupper() and len(word) > 2 and not model[_fold(word)] & IS_GIVEN


_BEFORE = TITLES | PERSON_BEFORE | NAME_BEFORE
_CAPITAL = r"[^\W\d_a-zß-öø-ÿ](?:\w|['’-](?=[^\W\d_]))*"
_RUN = re.compile(rf"(?<![\w'’@#/.-]){_CAPITAL}(?:(?: |\. ){_CAPITAL}){{1,4}}")
_LAST_WORD = re.compile(r"([^\W\d_][\w'’]*)[.,:]?\s{1,2}$")
_NEXT_WORD = re.compile(r"[ ,]{1,2}([^\W\d_][\w'’]*)")


def _runs(text: str, model: NameModel) -> list[tuple[int, int, str, float]]:
    """Runs of capitalised words of any vocabulary, scored by the model and by what stands around them."""
    out = []
    for m in _RUN.finditer(text):
        ws = [(m.start() + x.start(), m.start() + x.end(), x[0]) for x in WORD.finditer(m[0])]
        before = _LAST_WORD.search(text[max(0, m.start() - 30) : m.start()])
        cue = before[1].lower() if before else ""
        while ws and (ws[0][2].lower() in _BEFORE or _sentence(ws[0][2])):
            cue = ws.pop(0)[2].lower()
        part = 0  # a full stop behind a whole word ends a sentence
        for a, b in zip(ws, ws[1:], strict=False):
            part += 1
            if text[a[1] : b[0]] == ". " and len(a[2]) > 1:
                ws = ws[:part]
                break
        if not 2 <= len(ws) <= 4 or not all(w[0].isupper() for _, _, w in ws) or len(ws[-1][2]) < 2 or any(len(w) > 1 and w.isupper() for _, _, w in ws):
            continue
        is_ = [model[_fold(w)] for _, _, w in ws]
        if any(_fold(w) in NO_PERSON or _sentence(w) or k & IS_OTHER and not k & (IS_GIVEN | IS_FAMILY) for (_, _, w), k in zip(ws, is_, strict=True)):
            continue
        behind = _NEXT_WORD.match(text, ws[-1][1])
        after = behind[1].lower() if behind else ""
        given, family = any(k & (IS_GIVEN | IS_SHORT) for k in is_[:1]), bool(is_[-1] & IS_FAMILY)
        score = 0.15 + 0.55 * (cue in TITLES) + 0.35 * (cue in PERSON_BEFORE) + 0.1 * (cue in NAME_BEFORE) + 0.35 * (after in PERSON_BEHIND) + 0.1 * (after in NAME_BEHIND) + 0.35 * given + 0.1 * family + 0.25 * (given and family)
        out.append((ws[0][0], ws[-1][1], "person_name", score))
    return out


class _Taken:
    """Spans that don't overlap, kept in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.spans: list[tuple] = []

    def add(self, x: tuple) -> bool:
        """Takes a span unless it overlaps one that is taken."""
        i = bisect.bisect_left(self.starts, x[1])
        if i and self.spans[i - 1][1] > x[0]:
            return False
        self.starts.insert(i, x[0])
        self.spans.insert(i, x)
        return True

    def hits(self, x: tuple) -> bool:
        i = bisect.bisect_left(self.starts, x[1])
        return bool(i) and self.spans[i - 1][1] > x[0]


def _names(text: str, model: NameModel) -> list[tuple[int, int, str, float]]:
    listed = _listed(text, model)
    sure = _Taken()
    for x in listed:
        if x[3] >= THRESHOLD:
            sure.add(x)
    return listed + [x for x in _runs(text, model) if not sure.hits(x)]


def _listed(text: str, model: NameModel) -> list[tuple[int, int, str, float]]:
    """Names with a word that the model knows as a given name, with an initial or with a title."""
    plain = set(_PLAIN_WORD.findall(_fold(text)))
    if TITLES.isdisjoint(plain) and not any(model[w] & (IS_GIVEN | IS_SHORT) for w in plain) and not _INITIAL.search(text):
        return []
    words = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text)]
    out: list[tuple[int, int, str, float]] = []
    n, i = len(words), 0

    def gap(a: int, b: int) -> str:
        return text[words[a][1] : words[b][0]]

    def given(j: int) -> int:
        """0, 1 for a short form, 2 for a full given name."""
        if j >= n:
            return 0
        k = model[_fold(words[j][2])]
        return 2 if k & IS_GIVEN else 1 if k & IS_SHORT else 0

    def initial(j: int) -> bool:
        return j < n and len(words[j][2]) == 1 and words[j][2] not in "Iay" or (j < n and len(words[j][2]) == 1 and text[words[j][1] : words[j][1] + 1] == ".")

    def cue(a: int, b: int) -> float:
        before = words[a - 1][2].lower() in NAME_BEFORE if a else False
        behind = words[b + 1][2].lower() in NAME_BEHIND if b + 1 < n else False
        return 0.2 * before + 0.15 * behind

    while i < n:
        s, e, w = words[i]
        if w.lower() in TITLES and text[e : e + 1] in (".", " "):
            i += 1
            continue
        g = given(i)
        # Family, Given or Family, I.
        if i + 1 < n and gap(i, i + 1) in (", ", ",") and not g and not _sentence(w) and (given(i + 1) or (initial(i + 1) and text[words[i + 1][1] : words[i + 1][1] + 1] == ".")) and _family(w, model=model, strict=not (w[0].isupper() and (i and words[i - 1][2].lower() in NAME_BEFORE))):
            j = i + 1
            end = words[j][1]
            if initial(j):
                end += 1
            elif j + 1 < n and initial(j + 1) and gap(j, j + 1) == " " and text[words[j + 1][1] : words[j + 1][1] + 1] == ".":
                j += 1
                end = words[j][1] + 1
            out.append((s, end, "person_name", 0.7 + cue(i, j)))
            i = j + 1
            continue
        if g:
            j, end, score = i, e, 0.0
            if j + 1 < n and gap(j, j + 1) == " " and len(words[j + 1][2]) > 1 and model[_fold(w) + _fold(words[j + 1][2])] & IS_GIVEN:
                j, g = j + 1, 2
                end = words[j][1]
            k = j + 1
            if k < n and gap(j, k) == " " and initial(k) and words[k][2].isupper() and text[words[k][1] : words[k][1] + 2] == ". ":
                k += 1
            elif k + 1 < n and gap(j, k) == " " and initial(k) and words[k][2].isupper() and gap(k, k + 1) == " " and _family(words[k + 1][2], model=model, strict=True):
                k += 1
            ok = k < n and (gap(k - 1, k) in (" ", ". ") if k > j + 1 else gap(j, k) == " " or (gap(j, k) == ". " and g == 1))
            if ok and _family(words[k][2], model=model, strict=not (w[0].isupper() and g == 2)) and not (words[k][2][0].isupper() and _sentence(words[k][2])):
                score = 0.8 if _family(words[k][2], model=model, strict=True) else 0.55
                j, end = k, words[k][1]
            elif g == 2 and w[0].isupper():
                score = 0.5
            elif g == 2:
                score = 0.3
            else:
                score = 0.2 if w[0].isupper() else 0.0  # a short form alone is often a word of its own
            if score < 0.55:
                score += cue(i, j)
            if j == i and i + 1 < n and gap(i, i + 1) == " " and words[i + 1][2][0].isupper() and _fold(words[i + 1][2]) in NO_PERSON:
                score = 0.0  # a street, a station, a college
            out.append((s, end, "person_name", score))
            i = j + 1
            continue
        if initial(i) and i + 1 < n:
            j = i + 1
            dotted = gap(i, j) == ". "
            if (dotted or gap(i, j) == " ") and w.isupper() and initial(j) and j + 1 < n and gap(j, j + 1) in (". ", " "):
                j += 1  # two initials
                dotted = True
            if gap(j - 1, j) in (". ", " ", ".") and _family(words[j][2], model=model, strict=True) and (dotted or w.isupper()) and not given(j):
                out.append((s, words[j][1], "person_name", 0.6 + cue(i, j)))
                i = j + 1
                continue
        # A family name alone, behind a title
        if i and words[i - 1][2].lower() in TITLES and w[0].isupper() and gap(i - 1, i) in (". ", " ") and _family(w, model=model, strict=False):
            j = i
            while j + 1 < n and j < i + 2 and gap(j, j + 1) == " " and len(words[j + 1][2]) > 1 and words[j + 1][2][0].isupper() and _fold(words[j + 1][2]) not in NO_PERSON and not _sentence(words[j + 1][2]):
                j += 1
            out.append((s, words[j][1], "person_name", 0.6))
            i = j
        i += 1
    return out


# Words that begin a sentence and are no family name.
_STARTERS = set("what how i i'm it the a an my your you do did never please follow order ticket fact reference version build platform according noted here that call signed deliver send dr mr mrs ms user meine mi contact emergency passport ssn would for and we they he she this there when where who why no yes not".split())


def _sentence(word: str) -> bool:
    return word.lower() in _STARTERS or word.lower().replace("’", "'") in _STARTERS


_PLAIN = NameModel()


def spans(text: str | None, model: NameModel = _PLAIN) -> list[tuple[int, int, str]]:
    """start, end, kind of each piece, in order."""
    if not text:
        return []
    found: list[tuple[int, int, str, float]] = []
    low = text.lower()
    if "@" in text or "at" in low and ("(at" in low or "[at" in low or "dot" in low):
        found += [(*m.span(), "email", 1.0) for m in EMAIL.finditer(text)]
    if _DIGIT.search(text):
        for ws, p in STREETS:
            if any(w in low for w in ws):
                found += [(*m.span(), "street_address", 0.95) for m in p.finditer(text)]
        if _DIGITS.search(text):
            found += _numbers(text)
    found += _names(text, model)
    kept = _Taken()
    for x in sorted((x for x in found if x[3] >= THRESHOLD), key=lambda x: (x[2] == "person_name", -x[3], x[0] - x[1])):
        kept.add(x)
    return [x[:3] for x in kept.spans]


def redact(text: str | None, model: NameModel = _PLAIN) -> str | None:
    """text with [KIND] in place of each piece."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in spans(text, model):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def name_words(entities: DataFrame) -> DataFrame:
    """word, given, family, other: how often each folded word stands in front or at the end of persons' names, or in other names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, kind in zip(b["name"], b["entity_type"], strict=True):
                family, comma, rest = name.partition(",")
                ws = [w for w in (_fold(w) for w in WORD.findall(f"{rest} {family}" if comma else name)) if w not in TITLES]
                if kind != "person":
                    rows += [(w, 0, 0, 1) for w in ws if len(w) > 1]
                elif ws not in (["user"], ["assistant"]) and len(ws) <= 4 and not any(w in NO_PERSON or _sentence(w) for w in ws):
                    rows += [(ws[0], 1, 0, 0)] if ws and len(ws[0]) > 1 else []
                    rows += [(ws[-1], 0, 1, 0)] if len(ws) > 1 and len(ws[-1]) > 1 else []
            yield pd.DataFrame(rows, columns=["word", "given", "family", "other"])

    e = entities.where("name is not null and entity_type is not null").select("name", "entity_type")
    return e.mapInPandas(run, "word string, given bigint, family bigint, other bigint").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("given", "family", "other")])


def learned(words: DataFrame) -> bytes:
    """The model of name_words, of one size for any number of words: parts made on the executors meet in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, tails = np.zeros((3, _BITS // 8), np.uint8), np.zeros((2, _TAILS), np.int64)
        for b in batches:
            for w, given, family, other in zip(*(b.column(c).to_pylist() for c in ("word", "given", "family", "other")), strict=True):
                roles = [given > other and given >= family, family > other and family >= given, other > 0]
                for x in _slots(w):
                    for i, yes in enumerate(roles):
                        if yes:
                            bits[i, x >> 3] |= 1 << (x & 7)
                for n in (3, 4, 5):
                    if len(w) > n + 1:
                        tails[0 if roles[1] else 1, zlib.crc32(w[-n:].encode("utf-8", "ignore")) % _TAILS] += 1
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes() + tails.tobytes()], pa.binary())], ["model"])

    def both(a: bytes, b: bytes) -> bytes:
        n = 3 * _BITS // 8
        x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        return (x[:n] | y[:n]).tobytes() + (x[n:].view(np.int64) + y[n:].view(np.int64)).tobytes()

    parts = words.coalesce(words.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "model binary")
    rdd = parts.rdd.map(lambda r: bytes(r[0]))
    return rdd.treeReduce(both) if rdd.getNumPartitions() else b""


def _model(texts: DataFrame, entities: DataFrame | None):
    """A function that gives each worker the model: of entities, or the general one."""
    held = None if entities is None else texts.sparkSession.sparkContext.broadcast(learned(name_words(entities)))
    return lambda: NameModel(None if held is None else held.value)


def found(texts: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """origin, record_id, start_at, end_at, kind of each piece in texts (origin, record_id, text). entities: name, entity_type."""
    made = _model(texts, entities)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = made()
        for b in batches:
            rows = [(o, r, *x) for o, r, t in zip(b["origin"], b["record_id"], b["text"], strict=True) for x in spans(t, model)]
            yield pd.DataFrame(rows, columns=["origin", "record_id", "start_at", "end_at", "kind"])

    return texts.where("text <> ''").mapInPandas(run, "origin string, record_id bigint, start_at int, end_at int, kind string")


def redacted(texts: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """origin, record_id, text with placeholders."""
    made = _model(texts, entities)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = made()
        for b in batches:
            yield b.assign(text=[redact(t, model) for t in b["text"]])

    return texts.select("origin", "record_id", "text").mapInPandas(run, "origin string, record_id bigint, text string")


def texts(turns: DataFrame, facts: DataFrame) -> DataFrame:
    t = turns.select(F.lit("turn").alias("origin"), F.col("turn_id").alias("record_id"), F.col("content").alias("text"))
    f = facts.select(F.lit("fact").alias("origin"), F.col("log_id").alias("record_id"), F.col("snippet").alias("text"))
    return spread(t).unionByName(spread(f))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark.read.parquet(f"{d}/turns.parquet"), spark.read.parquet(f"{d}/facts.parquet"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return found(_texts(spark, d), spark.read.parquet(f"{d}/entities.parquet"))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redacted(_texts(spark, d), spark.read.parquet(f"{d}/entities.parquet"))


QUERIES = {"p6_found": p6_found, "p6_redacted": p6_redacted}
