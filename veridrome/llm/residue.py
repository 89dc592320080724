"""Template residue, filler and error pages (problem 7).

Labelled exemplars of residue are kept in an inverted index of their words.
Each passage window of a record (a line, or a span in the form of a template
slot) retrieves the exemplars that share a word with it; its coverage is the
TF-IDF weight of its words that the best exemplar contains.  A record is residue
if it holds an unfilled slot anywhere, or if, apart from lines around the
article, its windows are covered.  Word weights are counted over all records.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridrome.llm import pages

#: Labelled exemplars (kind, text).
EXEMPLARS = (
    ("error", "404 page not found"), ("error", "404 we cannot find that page"), ("error", "404 nothing lives at this address"), ("error", "the link may be old reference"), ("error", "500 internal server error"), ("error", "503 service unavailable"), ("error", "http 502 bad gateway"), ("error", "504 gateway timeout"),
    ("error", "error 503"), ("error", "http error"), ("error", "fatal error call to undefined function render on line"), ("error", "the server is not able to answer try again in minutes"), ("error", "the server in the town is not able to answer try again in minutes"), ("error", "down for maintenance pages return tonight shortly tomorrow soon later on monday"),
    *(("error", f"{a} your address was blocked please sign in ask your administrator incident") for a in ("access denied", "forbidden", "403 forbidden", "you are not allowed to open this document", "you do not have permission")),
    ("error", "your session has expired start over log in again reload the page"), ("error", "session timed out log in again start over reload the page"), ("error", "you have been logged out log in again start over reload the page"),
    ("error", "sorry something went wrong while loading retry we have been told go back to the start page"), ("error", "oops something went wrong while loading retry we have been told go back to the start page"), ("error", "hmm something went wrong while loading retry we have been told go back to the start page"), ("error", "checking that you are not a robot wait seconds ray"), ("error", "too many requests wait seconds ray"), ("error", "rate limit reached wait seconds ray"), ("error", "verify that you are human captcha"),
    ("script", "javascript is required to view this page viewer"), ("script", "javascript is disabled in your browser"), ("script", "this application needs javascript to run viewer"), ("script", "please turn on scripts in your browser viewer"), ("script", "please enable javascript to continue"), ("script", "you need to enable scripts to read this notice viewer"), ("script", "your browser does not support scripting content hidden viewer"), ("script", "scripts are switched off switch them on and reload viewer"),
    ("filler", "placeholder copy for layout only do not publish goes here to be replaced"), ("filler", "placeholder text for layout only do not publish goes here to be replaced"), ("filler", "example content for layout only do not publish goes here to be replaced"), ("filler", "dummy body text for layout only do not publish goes here to be replaced"), ("filler", "sample paragraph for layout only do not publish goes here to be replaced"), ("filler", "content coming soon"), ("filler", "coming soon"), ("filler", "under construction"),
    ("filler", "todo write this section"), ("filler", "tbd"), ("filler", "tbc"), ("filler", "to be completed"), ("filler", "to be announced"), ("filler", "n/a awaiting copy"), ("filler", "test"), ("filler", "asdf"), ("filler", "qwerty"), ("filler", "blah"), ("filler", "text"), ("filler", "xxx"), ("filler", "foo bar baz"), ("filler", "dummy"), ("filler", "untitled"), ("filler", "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"),
    # the same in other words and languages
    ("error", "we couldn't find what you were looking for"), ("error", "we could not find the page that you requested it may have been moved or deleted"), ("error", "this page does not exist or has been removed"), ("error", "gateway error upstream unavailable"), ("error", "bad gateway upstream server did not respond"), ("error", "the service is temporarily unavailable please try again later"), ("error", "an unexpected error occurred please try again later"), ("error", "connection timed out"),
    ("error", "fehler 404 seite nicht gefunden"), ("error", "die angeforderte seite wurde nicht gefunden oder existiert nicht mehr"), ("error", "zugriff verweigert bitte melden sie sich an"), ("error", "interner serverfehler bitte versuchen sie es später erneut"), ("error", "ihre sitzung ist abgelaufen bitte melden sie sich erneut an"), ("error", "wartungsarbeiten die seite ist vorübergehend nicht verfügbar"),
    ("error", "erreur 404 page introuvable"), ("error", "la page demandée est introuvable ou n'existe plus"), ("error", "accès refusé veuillez vous connecter"), ("error", "erreur interne du serveur veuillez réessayer plus tard"), ("error", "votre session a expiré veuillez vous reconnecter"), ("error", "site en maintenance"),
    ("error", "error 404 página no encontrada"), ("error", "la página solicitada no existe o ha sido eliminada"), ("error", "acceso denegado inicie sesión"), ("error", "error interno del servidor inténtelo de nuevo más tarde"), ("error", "su sesión ha caducado vuelva a iniciar sesión"), ("error", "sitio en mantenimiento"),
    ("script", "javascript muss aktiviert sein um diese seite anzuzeigen"), ("script", "bitte aktivieren sie javascript in ihrem browser"), ("script", "veuillez activer javascript dans votre navigateur pour afficher cette page"), ("script", "active javascript en su navegador para ver esta página"), ("script", "this site requires javascript to work correctly"),
    ("filler", "insert headline here"), ("filler", "insert text here"), ("filler", "your text goes here"), ("filler", "type your title here"), ("filler", "click to edit this text"), ("filler", "hier text einfügen"), ("filler", "platzhaltertext"), ("filler", "hier entsteht eine neue seite"), ("filler", "insérer le texte ici"), ("filler", "texte à venir"), ("filler", "insertar texto aquí"), ("filler", "próximamente"), ("filler", "texto de ejemplo"),
    ("filler", "⟦latin⟧"), ("slot", "⟦slot⟧"),
)
_NAME = r"[A-Za-z][\w.]*(?: [\w.]+){0,3}"
#: Forms of unfilled slots.
SLOT = re.compile(
    rf"\{{\{{\s*{_NAME}\s*(?:\|[^{{}}\n]*)?\}}\}}|\{{%[^%\n]*%\}}|\$\{{\s*{_NAME}\s*\}}|\#\{{\s*{_NAME}\s*\}}|(?<![\w{{$#])\{{{_NAME}\}}|<%=?\s*{_NAME}\s*%>|<<\s*{_NAME}\s*>>|%%\s*{_NAME}\s*%%"
    rf"|(?<![\w{{$#])\{{\d\}}|@@\s*{_NAME}\s*@@|(?<!\w)__[A-Za-z]\w*?__(?!\w)|\[\[\s*{_NAME}\s*\]\]|\[(?:insert|your|enter|add|type)\s+{_NAME}\]",
    re.I,
)
#: Syllables of which filler in mock Latin is made.
LATIN = re.compile(r"(?:lor|em|ip|sum|dol|or|sit|amet|con|sect|etur|tur|adi|pisc|ing|eli|elit|sed|vel|mag|na|qua|rus|ner|por|vit|di|um|tem)+")
#: A note behind a window: one in brackets, or a few words behind a dash.
NOTE = re.compile(r"(?:\s*\([^()\n]{1,30}\)|\s+-\s+[^\W_]+(?: [^\W_]+)?)\s*$")
WORD = re.compile("⟦slot⟧|⟦latin⟧|n/a|[^\\W_]+(?:['’][^\\W_]+)*")
OPENS = re.compile(r"[{\[<%@]|\$\{|__")
REFERENCE = re.compile(r"^(?=.*\d)[0-9a-f]+$|^render.*$")
#: A window is residue from this share of its weight, a record from this share of its windows' words.
COVERED, RECORD = 0.68, 0.9


def tokens(text: str) -> list[str]:
    """Words of a window; slots become one mark, reference numbers other than status codes fall out."""
    text = NOTE.sub("", " ".join(text.split()))
    marked = (SLOT.sub(" ⟦slot⟧ ", text) if OPENS.search(text) else text).lower()
    out = []
    for w in WORD.findall(marked.replace("_", " ")):
        if w in CODES or not (w[0] in "0123456789abcdefr" and REFERENCE.match(w)):
            out.append(w)
    mock = [bool(LATIN.fullmatch(w)) for w in out]
    if len(out) >= 4 and sum(mock) >= 0.6 * len(out):
        return ["⟦latin⟧" if m else w for w, m in zip(out, mock)]
    return out


CODES = frozenset("403 404 500 502 503 504".split())


class Index:
    """Inverted index of the exemplars, with word weights."""

    def __init__(self, df: dict[str, int], n: int):
        self.words = [frozenset(tokens(t)) for _, t in EXEMPLARS]
        self.idf = {w: math.log((n + 2) / (df.get(w, 0) + 1)) for ws in self.words for w in ws}
        #: a word of no exemplar speaks against residue with the weight of a middling word
        self.other = math.log(n + 2) / 2
        self.where: dict[str, list[int]] = defaultdict(list)
        for i, ws in enumerate(self.words):
            for w in ws:
                self.where[w].append(i)
        self.mass = [sum(self.idf[w] for w in ws) for ws in self.words]

    def coverage(self, window: str) -> float:
        """Share of a window's weight that its best exemplar contains, if that is a fair part of the exemplar."""
        ws = Counter(tokens(window))
        total = sum(self.idf.get(w, self.other) for w in ws)
        if not total:
            return 0.0
        got: dict[int, float] = defaultdict(float)
        for w in ws:
            for i in self.where.get(w, ()):
                got[i] += self.idf[w]
        return max((g / total for i, g in got.items() if g >= 0.2 * self.mass[i] or EXEMPLARS[i][0] == "filler"), default=0.0)

    def residue(self, windows: list[str]) -> bool:
        """Whether the windows together are residue; long windows are looked at first."""
        sizes = [max(1, len(w.split())) for w in windows]
        free = (1 - RECORD) * sum(sizes)
        for n, w in sorted(zip(sizes, windows), reverse=True):
            if self.coverage(w) < COVERED:
                free -= n
                if free < 0:
                    return False
        return bool(windows)


def word_weights(records: DataFrame, columns: tuple[str, ...] = ("content", "title")) -> tuple[dict[str, int], int]:
    """Records that hold each exemplar word, and their number, over all records.

    One job; what reaches the driver has the size of the exemplars' vocabulary.
    """
    known = frozenset(w for _, t in EXEMPLARS for w in tokens(t))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for pdf in frames:
            for row in zip(*(pdf[k] for k in columns)):
                c[""] += 1
                words = {w for x in row if isinstance(x, str) for w in WORD.findall(x.lower())}
                c.update(known & words)
        yield pd.DataFrame(list(c.items()), columns=["w", "n"])

    rows = records.select(*columns).mapInPandas(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    df = {r.w: r.n for r in rows}
    return df, df.pop("", 0)


def content_is_residue(index: Index, title, content, lines: list[str], outside) -> bool:
    """Whether a content holds a slot or, without the lines around the article, only residue.

    ``lines`` are its non-blank lines and ``outside`` tells which of them stand
    around the article.
    """
    if not lines:
        return False
    if _slot(index, content):
        return True
    t = pages.plain(title) if isinstance(title, str) else None
    body = [x for x, b in zip(lines, outside) if not b and pages.plain(x) != t]
    if body:
        return index.residue(body)
    # all that is left may be residue that reads like a line around an article
    return any(index.coverage(x) >= COVERED for x in lines if pages.plain(x) != t)


def find(records: DataFrame, index: Index | None = None) -> DataFrame:
    """Fields of (id, title, content) that are residue: distinct (id, field).

    Null, empty and blank fields are none.  Contents are reduced to their
    article first; a line that repeats the title says nothing of the content.
    """
    index = index or Index(*word_weights(records))
    model = pages.page_model()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            every = [pages.split_lines(t)[1] for t in pdf["content"]]
            for i, title, content, lines, outside in zip(pdf["id"], pdf["title"], pdf["content"], every, model.around_all(every)):
                if isinstance(title, str) and title.strip() and (_slot(index, title) or index.residue([title])):
                    rows.append((i, "title"))
                if content_is_residue(index, title, content, lines, outside):
                    rows.append((i, "content"))
            yield pd.DataFrame(rows, columns=["id", "field"])

    return records.select("id", "title", "content").mapInPandas(run, "id string, field string").distinct()


def _slot(index: Index, text: str) -> bool:
    """Whether a window in the form of a slot stands in the text."""
    return bool(OPENS.search(text)) and any(index.coverage(m[0]) >= COVERED for m in SLOT.finditer(text))


def skipper(index: Index):
    """A predicate for :func:`pages.lines_around`: the content is residue."""
    return lambda title, content, lines, outside: content_is_residue(index, title, content, lines, outside)
