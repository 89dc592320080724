"""Personal data inside free text (problem 1).

Transducers rewrite a text to a plain form and keep, for every character of it,
where it came from: invisible characters fall out, look-alike letters and wide
digits become plain ones, digits spelled as words become digits, and the usual
disguises of ``@`` and ``.`` in addresses are undone.  Detectors run over the
plain form; the spans they find are mapped back to the source characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridrome.llm import personal_words as W

KINDS = ("email", "phone", "id_number", "address", "name")

#: Letters of other scripts that look Latin.
LOOKS = str.maketrans("аеорсухіјѕԁһАВЕКМНОРСТУХІЈЅοΟΑΒΕΖΗΙΚΜΝΡΤΥΧ", "aeopcyxijsdhABEKMHOPCTYXIJSoOABEZHIKMNPTYX")
ODD = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ſ]")
_NUM = "|".join(sorted(W.DIGITS, key=len, reverse=True))
_TIMES = {"double": 2, "triple": 3}
_DIGIT = rf"(?:(?:double|triple)[\s-]+)?(?:{_NUM})"
SPELLED = re.compile(rf"\b{_DIGIT}(?:[\s,-]+{_DIGIT}){{5,}}\b", re.I)
DIGIT_WORDS, WORDS = frozenset(W.DIGITS), re.compile(r"[^\W\d_]+")
ONE_DIGIT = re.compile(rf"\b(?:(double|triple)[\s-]+)?({_NUM})\b", re.I)
_ATS, _DOTS = "|".join(W.AT_DOT), "|".join(dict.fromkeys(d for ds in W.AT_DOT.values() for d in ds))
_AT = rf"(?:\s*[(\[{{<]\s*(?:{_ATS})\s*[)\]}}>]\s*|\s+(?:{_ATS})\s+|\s*@\s*)"
_DOT = rf"(?:\s*[(\[{{<]\s*(?:{_DOTS})\s*[)\]}}>]\s*|\s+(?:{_DOTS})\s+|\.)"
DISGUISED = re.compile(rf"(?<![\w.+-])([\w+-]+(?:{_DOT}[\w+-]+){{0,6}}?)({_AT})([\w-]+(?:{_DOT}[\w-]+){{1,8}})", re.I)
DOTS, HINT = re.compile(_DOT, re.I), re.compile(rf"@|dot|punkt|arroba|arobase|[(\[{{<]\s*(?:{_ATS})", re.I)
SPELLED_DOT, SPOKEN = re.compile(_DOTS, re.I), re.compile(rf"\b(?:{_DOTS})\b", re.I)


class Plain:
    """A plain form ``text`` with the source span of each of its characters."""

    def __init__(self, source: str):
        self.text, self.starts, self.ends = source, None, None  # None: identity
        if ODD.search(source):
            self._letters(source)
        # six words at least make a spelled number
        if sum(w in DIGIT_WORDS for w in WORDS.findall(self.text.lower())) >= 6:
            self._rewrite(SPELLED, self._digits)
        if HINT.search(self.text):
            self._rewrite(DISGUISED, self._address)

    def _letters(self, source: str) -> None:
        out, starts, ends = [], [], []
        for i, c in enumerate(source):
            if unicodedata.category(c) == "Cf":
                continue
            if out and unicodedata.combining(c):  # a letter and its mark are one character
                one = unicodedata.normalize("NFC", out[-1] + c)
                if len(one) == 1:
                    out[-1], ends[-1] = one, i + 1
                    continue
            if ord(c) > 127:
                c = c.translate(LOOKS)
                n = unicodedata.normalize("NFKC", c)
                c = n if len(n) == 1 else c
            out.append(c)
            starts.append(i)
            ends.append(i + 1)
        self.text, self.starts, self.ends = "".join(out), starts, ends

    def _rewrite(self, pattern: re.Pattern, edit) -> None:
        hits = [(m.start(), m.end(), new) for m in pattern.finditer(self.text) if (new := edit(m)) is not None]
        if not hits:
            return
        if self.starts is None:
            self.starts = list(range(len(self.text)))
            self.ends = [i + 1 for i in self.starts]
        text, starts, ends, at = [], [], [], 0
        for a, b, pieces in hits:
            text.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            for c, x, y in pieces:
                text.append(c)
                starts.append(self.starts[x])
                ends.append(self.ends[y - 1])
            at = b
        text.append(self.text[at:])
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]
        self.text = "".join(text)

    @staticmethod
    def _digits(m: re.Match):
        # doubled digits stand for several characters with one place
        at, out = m.start(), []
        for w in ONE_DIGIT.finditer(m[0]):
            out += [(W.DIGITS[w[2].lower()], w.start() + at, w.end() + at)] * _TIMES.get((w[1] or "").lower(), 1)
        return out if len(out) >= 7 else None

    @staticmethod
    def _address(m: re.Match):
        at, host = m[2], m[3]
        plain_at = at.strip() == "@"
        if at == "@" and not SPELLED_DOT.search(m[0]):
            return None  # nothing to undo
        if not plain_at and "(" not in at and "[" not in at and "{" not in at and "<" not in at:
            # a bare word "at" stands between an address's parts only if the dots are spelled too
            said = {d.lower() for d in SPOKEN.findall(host)}
            if not said <= set(W.AT_DOT.get(at.strip().lower(), ())) or not said and (at.strip().lower() != "at" or not re.search(r"[\d._+-]", m[1])):
                return None
        out, i = [], m.start()
        marks = [(m.start(2), m.end(2), "@")]
        for part, base in ((m[1], m.start(1)), (host, m.start(3))):
            marks += [(base + d.start(), base + d.end(), ".") for d in DOTS.finditer(part)]
        s = m.string
        for a, b, c in sorted(marks):
            out += [(s[k], k, k + 1) for k in range(i, a)]
            out.append((c, a, b))
            i = b
        return out + [(s[k], k, k + 1) for k in range(i, m.end())]

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Source span of a plain one."""
        return (a, b) if self.starts is None else (self.starts[a], self.ends[b - 1])


_L = r"[^\W\d_]"
_WORD = rf"{_L}{{2,}}(?:[-'’]{_L}{{2,}})*"
_SUR = rf"{_L}{{3,}}(?:[-'’]{_L}{{3,}})*"
_INIT = rf"{_L}\."
_BIG = r"(?-i:[A-ZÀ-Þ])[\w'’-]*"
#: Words that open a sentence behind a number and so begin no street name.
_OPENER = r"(?:the|a|an|in|no|each|two|only|under|after|if|for|please|several|staff|records|members|guidance|costs|it|when|that|this)"
_STREET = "|".join(W.STREET)
_UNIT = r"(?:flat|apt\.?|apartment|suite|unit|ste\.?|room|floor|no\.?)\s*#?\d+[a-z]?(?!\w)"

EMAIL = re.compile(r"(?<![\w.+@-])[\w][\w.+'-]*@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}(?![\w@])", re.I)
_EXT = r"(?:\s*,?\s*(?:ext\.?|extension|x|durchwahl|poste)\s*\d{1,6})?"
PHONE = re.compile(
    rf"(?<![\w.+/-])(?:(?:\+|00)\d{{1,3}}[\s.-]?(?:\(0\)\s?)?(?:\(\d{{1,5}}\)[\s.-]?)?\d{{1,10}}(?:[\s.-]\d{{2,10}}){{0,5}}"
    rf"|\(\d{{3}}\)\s?\d{{3}}[\s.-]?\d{{4}}|[2-9]\d{{2}}([\s.-])\d{{3}}\1\d{{4}}|[2-9]\d{{2}}[2-9]\d{{6}}|0[1-9]\d{{8,9}}|(?:\(0\d{{2,4}}\)|0\d{{2,4}})[\s-]\d{{3,4}}[\s-]?\d{{3,5}}){_EXT}(?![\w-]|\.\d|/\d)",
    re.I,
)
IDENTITY = re.compile(
    r"(?<![\w./-])(?:\d{3}([-\s.])\d{2}\1\d{4}|\d{9}|[A-Z]{2}\s?\d{7}|[A-Z]{2}(\s?)\d{3}\2\d{3}\2[A-Z]|[A-Z]\d{4}-\d{4}-\d{2}|\d{2}/\d{3}/\d{5}|\d{8}-?[A-Z]|\d{2}-\d{7})(?![\w/-]|\.\d)",
    re.I,
)
PLAIN_NUMBER = re.compile(r"\d{9}|\d{8}-?[A-Z]|\d{2}-\d{7}", re.I)
THINGS = re.compile(rf"\b{W.THINGS}(?:\s+(?:no\.?|number|nr\.?|id))?[\s:#]*(?:[\d.:/-]+\s+(?:and|to|through)\s+)?$", re.I)
LABELS = re.compile(rf"\b{W.LABELS}", re.I)
_CALLE, _RUE = "calle avenida avda plaza paseo camino carrera".split(), "rue avenue boulevard place quai impasse chemin allée".split()
_WEG = ("str", "straße", "strasse", "weg", "gasse", "platz", "allee", "ufer", "ring", "damm")
#: Forms of addresses, each with words, or ends of words, without which it is not tried.
ADDRESSES = [
    (frozenset(words), ends, re.compile(form, re.I))
    for words, ends, form in (
        (W.STREET, (), rf"(?<![\w/-])(?:{_UNIT},\s*)?\d{{1,5}}\s?[A-Za-z]?(?:\s?[-/]\s?\d{{1,4}}[A-Za-z]?)?\s+(?!{_OPENER}\b)(?:(?:st\.|{_L}[\w'’-]*)\s+){{1,4}}?(?:{_STREET})\b\.?(?:,\s*{_UNIT})?"),
        (_CALLE, (), rf"(?<!\w)(?:calle|avenida|avda\.?|plaza|paseo|camino|carrera)\s+(?:(?:de|del|la|las|los|el)\s+)*(?:{_L}[\w'’-]*\s+){{1,3}}\d{{1,4}}[a-z]?(?!\w)(?:,\s*{_UNIT})?"),
        ((), _WEG, rf"(?<!\w){_L}[\w'’-]*(?:str\.|straße|strasse|weg|gasse|platz|allee|ufer|ring|damm)\s+\d{{1,4}}[a-z]?(?!\w)(?:,\s*{_UNIT})?"),
        (_RUE, (), rf"(?<![\w/-])\d{{1,4}}(?:[a-z](?!\w))?(?:\s?(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|place|quai|impasse|chemin|allée)\s+(?:(?:de|du|des|la|le|les)\s+|(?:d|l)['’])*{_BIG}(?:\s+{_BIG})?"),
    )
]


GERMAN_STREET = re.compile(rf"(?:str\.|{'|'.join(_WEG[1:])})\s+\d", re.I)


@lru_cache(maxsize=50_000)
def _fold(w: str) -> str:
    if w.isascii():
        return w.lower()
    return "".join(c for c in unicodedata.normalize("NFD", w.lower()) if not unicodedata.combining(c)).replace("ø", "o").replace("ł", "l")


#: Words that introduce a person by themselves.
NAMING = frozenset("contact names named phone called colleague neighbour frau herr kollege kollegin".split())
GIVEN = frozenset(W.GIVEN)
STOP = frozenset(W.NO_SURNAME)
TOKEN = re.compile(rf"{_L}+(?:[-'’]{_L}+)*\.?")
LETTERS = re.compile(rf"{_L}+")
TITLE_WORDS, CUE_WORDS = frozenset(W.TITLES), frozenset(W.CUE_WORDS)
_TITLES = "|".join(W.TITLES)
TITLED = re.compile(rf"\b((?:(?:{_TITLES})\b\.?\s+){{1,3}})((?:{_INIT}\s*)*(?:{_WORD}\s+)?{_SUR})", re.I)
CUED = re.compile(rf"(?:\b(?:{'|'.join(W.CUES)}))\s*", re.I)
#: Two or three words written like a name, outside longer rows of such words.
_CAP = r"(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:[-'’][A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)*)"
CAPITALS = re.compile(rf"(?<![\w.'’-])({_CAP}(?: (?:{_CAP}|[A-Z]\.)){{1,2}})(?![\w'’-])")
LAST_WORD, NEXT_WORD = re.compile(rf"({_L}+)[,:]?\s+$"), re.compile(rf"\s+({_L}+)")
BEFORE_PERSON, BEHIND_PERSON, NO_PERSON = frozenset(W.BEFORE_PERSON), frozenset(W.BEHIND_PERSON), frozenset(W.NO_PERSON)
INITIALS = re.compile(rf"(?<![\w.])((?:{_INIT}\s?){{1,2}})({_SUR})(?!\w)")


def _style(w: str) -> str:
    letters = [c for c in w if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return "upper"
    return "title" if letters and letters[0].isupper() else "lower"


def _surname(w: str, style: str) -> bool:
    return len(w) >= 4 and _fold(w) not in STOP and (_style(w) == style or style == "any")


def _names(text: str, taken: bytearray, words: set[str]) -> list[tuple[int, int]]:
    """Spans of names in a plain text, outside the places that are taken (and marks them)."""
    found: list[tuple[int, int]] = []

    def add(a: int, b: int) -> None:
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            found.append((a, b))

    known = not GIVEN.isdisjoint(words) or not text.isascii() and any(_fold(w) in GIVEN for w in words if not w.isascii())
    tokens = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)] if known else []
    given = [_fold(t.rstrip(".")) in GIVEN for _, _, t in tokens]
    joined = lambda i: i + 1 < len(tokens) and text[tokens[i][1] : tokens[i + 1][0]].isspace()
    is_init = lambda t: len(t) == 2 and t[1] == "."
    last = -1
    for i, ok in enumerate(given):  # given name, more given names or initials, surname
        if not ok or i <= last or tokens[i][2].endswith("."):
            continue
        style, j = _style(tokens[i][2]), i
        while joined(j) and (given[j + 1] or is_init(tokens[j + 1][2])) and _style(tokens[j + 1][2]) in (style, "title") and not (given[j + 1] and tokens[j + 1][2].endswith(".")):
            j += 1
        last = j  # names inside the chain have been looked at
        if joined(j) and _surname(tokens[j + 1][2].rstrip("."), style):
            add(tokens[i][0], tokens[j + 1][0] + len(tokens[j + 1][2].rstrip(".")))
    for m in TITLED.finditer(text) if not TITLE_WORDS.isdisjoint(words) else ():
        name, a = m[2], m.start(2)
        parts = name.split()
        last = parts[-1]
        if _fold(last) in STOP or _style(last) == "lower" and _style(m[1]) != "lower":
            if len(parts) < 2 or _fold(parts[-2]) in STOP or not (_style(parts[-2]) == _style(m[1]) or _style(parts[-2]) == "title"):
                continue
            name = name[: name.rindex(last)].rstrip()
        add(a, a + len(name))
    for m in INITIALS.finditer(text):
        if _style(m[2]) in ("title", "upper") and _fold(m[2]) not in STOP and len(m[2]) >= 4:
            add(m.start(), m.end())
    for i, ok in enumerate(given):  # surname, comma, given name
        if ok and i and text[tokens[i - 1][1] : tokens[i][0]] in (", ", ","):
            a, b, w = tokens[i - 1]
            e = tokens[i][1] - tokens[i][2].endswith(".")
            if _surname(w, _style(tokens[i][2])) and _style(w) != "lower" and SURNAME_END.search(_fold(w)):
                add(a, e + (3 if re.match(rf" {_L}\.(?!\w)", text[e : e + 4]) else 0))
    for m in CUED.finditer(text) if not CUE_WORDS.isdisjoint(words) else ():  # after an announcement, names that no list has
        n = re.match(rf"(?:[^\W\d_a-zà-ÿ]{_L}+|{_L}\.)(?:\s+(?:[^\W\d_a-zà-ÿ]{_L}+(?:-{_L}+)?|{_L}\.)){{1,2}}", text[m.end() :])
        if n and not any(_fold(w.rstrip(".")) in STOP for w in n[0].split()) and not n[0].endswith("."):
            add(m.end(), m.end() + n.end())
    for m in CAPITALS.finditer(text):  # names that no list has, by their form and the words around them
        a, parts = m.start(), m[1].split()
        before = LAST_WORD.search(text[max(0, a - 24) : a])
        if parts[0].lower() in BEFORE_PERSON and len(parts) > 2:  # "Contact" at the start of a sentence
            before, a, parts = re.match(r".*", parts[0]), a + len(parts[0]) + 1, parts[1:]
        if any(_fold(w) in STOP or _fold(w) in NO_PERSON for w in parts):
            continue
        behind = NEXT_WORD.match(text, m.end())
        left, right = (before[before.lastindex or 0].lower() if before else ""), (behind[1].lower() if behind else "")
        if right in BEHIND_PERSON and (not left or left in BEFORE_PERSON or text[:a].rstrip()[-1:] in ("", ".", "!", "?", "\n")) or left in NAMING and right not in NO_PERSON:
            add(a, m.end())
    # parts of a name found above, where they stand alone
    whole = [text[a:b] for a, b in found if len(text[a:b].split()) > 1]
    surnames = {s for n in whole if _fold(s := n.partition(",")[0].split()[-1]) not in GIVEN}
    for a, b, w in (tokens or ((m.start(), m.end(), m[0]) for m in TOKEN.finditer(text))) if surnames else ():
        if w.rstrip(".") in surnames and _style(w) == "title":
            add(a, a + len(w.rstrip(".")))
    return found


#: Endings by which a word before a comma is taken for a surname.
SURNAME_END = re.compile(r"(?:gard|mund|drel|yen|ottavi|shiro|vian|cost|ova|ova|tino|brook|wicke|verly|doux|ska|ski|mmel|son|sen|ez|es|ini|elli|mann|stein|berg|feld|bauer|ovic|enko|ian|ova|eau|ier|man|ton|ley|ham|worth|field|ing|oglu|kaya|oto|ura|moto|da|ta|to|ra|ri|va|li|ni|no|el|er|an|en|on|is|os|as)$")


def detect(source) -> list[tuple[str, int, int]]:
    """Pieces of personal data of a text: (kind, start, end), half-open in its code points.

    Pieces do not overlap; of two candidates the one of the earlier kind wins
    (address before phone and identity number).  Null and empty texts have none.
    """
    if not isinstance(source, str) or not source:
        return []
    plain = Plain(source)
    text = plain.text
    out: list[tuple[str, int, int]] = []
    taken = bytearray(len(text))

    def add(kind: str, a: int, b: int) -> None:
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            out.append((kind, *plain.span(a, b)))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add("email", m.start(), m.end())
    words = set(LETTERS.findall(text.lower()))
    for hints, ends, form in ADDRESSES:
        if not hints.isdisjoint(words) or ends and any(w.endswith(ends) for w in words) and GERMAN_STREET.search(text):
            for m in form.finditer(text):
                a, b = _trim_address(m)
                if a < b:
                    add("address", a, b)
    for m in IDENTITY.finditer(text):
        before = text[max(0, m.start() - 40) : m.start()]
        if THINGS.search(before):
            continue
        # nine digits say nothing without a label close by, with or without a hyphen, and neither do eight with a letter
        if PLAIN_NUMBER.fullmatch(m[0]) and not LABELS.search(text[max(0, m.start() - 40) : m.end() + 50]):
            continue
        add("id_number", m.start(), m.end())
    for m in PHONE.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        if 9 <= digits <= 20 and not THINGS.search(text[max(0, m.start() - 40) : m.start()]):
            add("phone", m.start(), m.end())
    for a, b in _names(text, taken, words):
        out.append(("name", *plain.span(a, b)))
    return sorted(out, key=lambda x: x[1:])


ABBREVIATED = re.compile(r"(?:\bst|\brd|\bave|\bln|\bdr|\bct|\bpl|\bsq|\bblvd)\.$", re.I)


def _trim_address(m: re.Match) -> tuple[int, int]:
    """Drop a full stop that ends the sentence; reject pieces whose street is not written like a name."""
    s = m[0]
    words = re.findall(rf"{_L}[\w'’-]*", s)
    named = [w for w in words if len(w) > 2]
    if not named or not any(_style(w) != "lower" for w in named):
        return 0, 0
    if re.match(r"\d", s) and _style(re.search(rf"\s({_L})", s)[1]) == "lower" and not re.match(r"\d+[a-z]?(?:\s?(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|place|quai|impasse|chemin|allée)", s, re.I):
        return 0, 0
    b = m.end()
    if s.endswith(".") and not re.search(r"\bst\.$", s, re.I):
        # "St." is written with its point; behind other street words a point may end the sentence
        if not ABBREVIATED.search(s) or not re.match(r"\s*[,;)a-z]", m.string[b:]):
            b -= 1
    return m.start(), b


@lru_cache(maxsize=1)
def _placeholders() -> dict[str, str]:
    return {k: f"[{k.upper()}]" for k in KINDS}


def redact(source):
    """A text with its personal data replaced by typed placeholders; all else is kept."""
    if not isinstance(source, str):
        return source
    out, at = [], 0
    for kind, a, b in detect(source):
        out += [source[at:a], _placeholders()[kind]]
        at = b
    return "".join(out) + source[at:]


def find(rows: DataFrame, table_name: str, key: str, text: str) -> DataFrame:
    """Personal data of a table: distinct (table_name, record_id, kind, start_pos, end_pos).

    One pass without a shuffle of texts; only the small result is unified, for
    rows delivered more than once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            hits = [(k, *h) for k, t in zip(pdf["k"], pdf["t"]) for h in detect(t)]
            yield pd.DataFrame(hits, columns=["record_id", "kind", "start_pos", "end_pos"])

    slim = rows.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    found = slim.mapInPandas(run, "record_id string, kind string, start_pos int, end_pos int").distinct()
    return found.select(F.lit(table_name).alias("table_name"), "record_id", "kind", "start_pos", "end_pos")


def redacted(c: Column) -> Column:
    """Column function of :func:`redact`."""
    return F.pandas_udf(lambda s: s.map(redact), "string")(c)
